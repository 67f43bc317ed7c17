"""Golden results of the relational vocabulary, unevaluated trees, settings and invariances."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import relational as R
from plumbline.plans import H, Node, Settings, Sym, evaluate, register
from plumbline.sources import table_literal

y = Sym
VALUE = H.Table(H.Value(H.List(5, 3, 1, 4, 1)))
VALUE2 = H.Table(H.Value1(H.List(5, 3, 1, 4, 1)), H.Value2(H.List(1, 2, 3, 4, 5)))
SPANS = H.Table(H.key(H.List(0, 1), H.List(2, 3)), H.payload(H.List(4, 5), H.List(6, 7)))
TENS = H.Table(H.Value(H.List(10, 20, 30, 40, 50)))


def rows(x):
    return sorted(tuple(r) for r in x.collect())


def run(spark, t, **k):
    return evaluate(t, spark, **k)


@pytest.mark.parametrize(
    "table,p,want",
    [
        (VALUE, H.Equal(y("Value"), 1), [(1,), (1,)]),
        (VALUE, H.Greater(y("Value"), 3), [(4,), (5,)]),
        (VALUE, H.Greater(3, y("Value")), [(1,), (1,)]),
        (VALUE, H.Equal(y("Value"), 6), []),
        (VALUE, H.Greater(y("Value"), 3.7), [(4,), (5,)]),
        (VALUE, H.Greater(3.7, y("Value")), [(1,), (1,)]),
        (VALUE2, H.And(H.Greater(y("Value1"), 3), H.Greater(5, y("Value1"))), [(4, 4)]),
        (VALUE2, H.And(H.Greater(y("Value2"), 1), H.Greater(5, y("Value2")), H.Greater(y("Value1"), 2)), [(3, 2), (4, 4)]),
        (VALUE2, H.And(H.Greater(y("Value1"), 3), H.Greater(3, y("Value1"))), []),
        (SPANS, H.And(H.Greater(y("key"), 0), H.Greater(7, y("payload"))), [(1, 5), (2, 6)]),
    ],
)
def test_select(spark, table, p, want):
    assert rows(run(spark, H.Select(table, H.Where(p)))) == want


@pytest.mark.parametrize(
    "e,want",
    [
        (H.Plus(y("Value"), 5), [15, 25, 35, 45, 55]), (H.Times(y("Value"), 2), [20, 40, 60, 80, 100]), (H.Divide(y("Value"), 10), [1, 2, 3, 4, 5]),
        (H.Minus(y("Value"), 10), [0, 10, 20, 30, 40]), (H.Minus(0, y("Value")), [-50, -40, -30, -20, -10]),
        (H.Plus(H.Times(y("Value"), 2), 5), [25, 45, 65, 85, 105]), (H.Times(H.Plus(y("Value"), 5), 2), [30, 50, 70, 90, 110]),
        (H.Plus(y("Value"), y("Value"), y("Value")), [30, 60, 90, 120, 150]), (H.Divide(y("Value"), y("Value")), [1] * 5), (H.Divide(y("Value"), 4), [2, 5, 7, 10, 12]),
    ],
)
def test_project(spark, e, want):
    df = run(spark, H.Project(TENS, H.As(y("v"), e)))
    assert [r[0] for r in rows(df)] == want and df.dtypes == [("v", "int")]


def test_scalars(spark):
    assert run(spark, H.Plus(5, 2, 2)) == 9 and run(spark, H.Divide(H.Divide(12, 3), 2)) == 2 and run(spark, H.Times(H.Times(2, 3), 2, 2)) == 24
    assert run(spark, H.Minus(5, 4)) == 1 and run(spark, H.Divide(-7, 2)) == -3 and run(spark, H.Plus(1, 2.5)) == 3.5 and run(spark, H.Greater(5, 4)) is True
    assert run(spark, H.Plus(H.List(1, 2, 3))) == 6 and run(spark, H.StringJoin("a", "b")) == "ab" and run(spark, H.DateObject("1999-01-01")) == 10592


def test_years(spark):
    t = H.Table(H.date(H.List(8033, 8034, 8035, 8036, 10591, 10592)))
    assert [r[0] for r in run(spark, H.Project(t, H.As(y("v"), H.Year(y("date"))))).collect()] == [1991, 1991, 1992, 1992, 1998, 1999]
    assert [r[0] for r in run(spark, H.Project(t, H.As(y("v"), H.YearApprox(y("date"))))).collect()] == [1991, 1991, 1991, 1991, 1998, 1998]


def test_groups(spark):
    t = H.Table(H.NATION(H.List(1, 2, 1, 2, 1, 1, 3)), H.YEAR(H.List(1985, 2035, 1800, 2035, 1800, 2035, 1985)), H.Q(H.List(17, 21, 8, 5, 8, 7, 3)))
    got = run(spark, H.Group(t, H.By(y("NATION"), y("YEAR")), H.As(y("n"), H.Count(y("Q")), y("s"), H.Sum(y("Q")))))
    assert rows(got) == [(1, 1800, 2, 16), (1, 1985, 1, 17), (1, 2035, 1, 7), (2, 2035, 2, 26), (3, 1985, 1, 3)]
    for b in (5, 15423, 4194004, 1073741124):
        t = H.Table(H.k(H.List(b, b + 1, b + 2), H.List(b, b + 1, b + 2)), H.v(H.List(4, 5, 6), H.List(1, 2, 3)))
        got = run(spark, H.Group(t, H.By(y("k")), H.As(y("c"), H.Count(y("v")), y("s"), H.Sum(y("v")), y("a"), H.Min(y("v")), y("b"), H.Max(y("v")))))
        assert rows(got) == [(b, 2, 5, 1, 4), (b + 1, 2, 7, 2, 5), (b + 2, 2, 9, 3, 6)]
    assert rows(run(spark, H.Group(SPANS, H.As(y("s"), H.Sum(y("key")), y("n"), H.Count(y("key")))))) == [(6, 4)]


def test_many_groups_and_negative_keys(spark):
    df = R.group(spark.range(600_000).select((F.col("id") - 300_000).alias("k")), ["k"], {"n": F.count("k")})
    assert df.count() == 600_000


LINE = H.Table(
    H.L_ORDERKEY(H.List(1, 1, 2, 3)), H.L_QUANTITY(H.List(17, 21, 8, 5)), H.L_EXTENDEDPRICE(H.List(17954.55, 34850.16, 7712.48, 25284.00)),
    H.L_DISCOUNT(H.List(0.10, 0.05, 0.06, 0.06)), H.L_TAX(H.List(0.02, 0.06, 0.02, 0.06)), H.L_SHIPDATE(H.List(8400, 9130, 9861, 9130)),
)


def test_line_slices(spark):
    six = H.Select(LINE, H.Where(H.And(H.Greater(24, y("L_QUANTITY")), H.Greater(y("L_DISCOUNT"), 0.0499), H.Greater(0.07001, y("L_DISCOUNT")), H.Greater(y("L_SHIPDATE"), H.DateObject("1993-12-31")), H.Greater(H.DateObject("1995-01-01"), y("L_SHIPDATE")))))
    got = run(spark, H.Group(H.Project(six, H.As(y("r"), H.Times(y("L_EXTENDEDPRICE"), y("L_DISCOUNT")))), H.As(y("revenue"), H.Sum(y("r"))))).collect()
    assert got[0][0] == pytest.approx(3259.548)
    assert run(spark, H.Group(LINE, H.As(y("s"), H.Sum(y("L_DISCOUNT"))))).collect()[0][0] == pytest.approx(0.27)
    got = run(spark, H.Project(LINE, H.As(y("a"), H.Minus(H.Times(y("L_EXTENDEDPRICE"), H.Minus(1, y("L_DISCOUNT"))), H.Times(y("L_EXTENDEDPRICE"), y("L_TAX"))), y("yr"), H.Year(y("L_SHIPDATE")))))
    assert [(round(a, 1), b) for a, b in got.collect()] == [(15800.0, 1992), (31016.6, 1994), (7095.5, 1996), (22249.9, 1994)]


@pytest.mark.parametrize(
    "lk,rk,want",
    [([500, 2, 1, 984, 871], [7, 8, 1, 2], [1, 2]), ([4000001, 4000002, 20009, 5, 4], [5, 4, 20009, 4000002], [4, 5, 20009, 4000002]), ([1, 2, 3, 100, 101, 102], [10000, 10001, 10002, 1, 2, 3], [1, 2, 3]), ([100, 101], [1, 2], [])],
)
def test_joins(spark, lk, rk, want):
    t = {"L": table_literal(spark, {"k": lk, "v": list(range(len(lk)))}), "R": table_literal(spark, {"o": rk, "w": list(range(len(rk)))})}
    for head in ("Join", "PartitionedJoin"):
        got = run(spark, Node(head, (y("L"), y("R"), H.Where(H.Equal(y("k"), y("o"))))), tables=t)
        assert sorted(r["k"] for r in got.collect()) == want and got.columns == ["k", "v", "o", "w"]


def test_partitioned_inputs_and_gather(spark):
    t = {"L": table_literal(spark, {"k": [1, 2, 3, 4]}), "R": table_literal(spark, {"o": [2, 4, 6]})}
    part = lambda n, k: H.RadixPartition(y(n), H.Partition(y(k)))
    got = run(spark, H.Join(part("L", "k"), part("R", "o"), H.Where(H.Equal(y("k"), y("o")))), tables=t)
    assert rows(got) == [(2, 2), (4, 4)] and run(spark, H.Gather(y("none"), H.List(0))) == H.Gather(y("none"), H.List(0))
    left = run(spark, H.Gather(y("R"), H.List(0)), tables=t)  # of row places it is left to others
    assert isinstance(left, Node) and left.head == "Gather"
    grouped = R.group(R.partition(t["L"], "k", 3), ["k"], {"n": F.count("k")})
    assert grouped._jdf.queryExecution().toString().count("Exchange hashpartitioning") <= 2 and grouped.count() == 4
    assert run(spark, H.RadixPartition(y("none"))) == H.RadixPartition(y("none"))


def test_composite_join_and_names(spark):
    t = {"L": table_literal(spark, {"a": [1, 2], "b": [5, 6], "n": [1, 1]}), "R": table_literal(spark, {"c": [1, 2], "d": [5, 7], "n": [9, 9]})}
    keys = H.Where(H.Equal(H.List(y("a"), y("b")), H.List(y("c"), y("d"))))
    got = run(spark, H.Join(y("L"), y("R"), keys), tables=t)
    assert got.columns == ["a", "b", "n", "c", "d"] and rows(got) == [(1, 5, 1, 1, 5)]
    assert isinstance(run(spark, H.PartitionedJoin(y("L"), y("R"), keys), tables=t), Node)


def test_indexed_tables(spark):
    big = 1 << 32
    left = H.Table(H.k(H.List(1, 2), H.List(3)), H.v(H.List("a", "b"), H.List("c")))
    right = H.Table(H.Column(y("o"), H.List(7, 8)), H.Column(y("v"), H.List("x", "y")))
    t = H.TableIndexed(left, H.List(0, big, 1), right, H.List(1, 0, 1))
    got = run(spark, H.Project(t, H.As(y("k"), y("k"), y("v"), y("v"), y("s"), H.Plus(y("k"), y("o")))))
    assert [tuple(r) for r in got.collect()] == [(1, "a", 9), (3, "c", 10), (2, "b", 10)]
    assert run(spark, H.TableIndexed(y("x"), H.List(0), right, H.List(0))).head == "TableIndexed"


@pytest.mark.parametrize(
    "t",
    [H.Select(y("Dummy"), H.Where(H.And(H.Greater(y("a"), 1), H.Greater(y("b"), 2)))), H.Select(H.NotTable(H.x(1)), H.Where(H.Greater(y("x"), 1))), H.Project(y("Dummy"), H.As(y("a"), y("b"))), H.UndefinedFunction(9), H.Set(y("Other"), 1)],
)
def test_unevaluated(spark, t):
    assert run(spark, t) == t


def test_partial(spark):
    got = run(spark, H.Select(VALUE, H.Where(y("Dummy"))))
    assert isinstance(got, Node) and got.args[1] == H.Where(y("Dummy")) and got.args[0].columns == ["Value"]
    assert run(spark, H.Unknown(H.Plus(1, 2))) == H.Unknown(3)


def test_errors(spark):
    bad = H.Select(VALUE, H.Where(H.Greater(y("none"), 3)))
    with pytest.raises(KeyError, match="unknown symbol"):
        run(spark, bad)
    assert run(spark, bad, on_error="expr").head == "ErrorWhenEvaluatingExpression"
    with pytest.raises(ValueError, match="Let has no option"):
        run(spark, H.Let(VALUE, H.Other(1)))
    with pytest.raises(ValueError, match="unknown select mode"):
        run(spark, H.Set(y("SelectMode"), y("Nope")))


@pytest.mark.parametrize("mode", [("SelectMode", "Branch"), ("PartitionMode", "RadixBitsFixedMin"), ("GroupMode", "Sort"), ("GroupMode", "Hash"), ("RadixJoinMinPartitionSize", 10), ("DeferGatherPhase", True)])
def test_modes_keep_answers(spark, mode):
    s = Settings()
    assert run(spark, H.Set(y(mode[0]), mode[1] if not isinstance(mode[1], str) else y(mode[1])), settings=s) is True
    got = rows(run(spark, H.Group(H.Select(VALUE2, H.Where(H.Greater(y("Value1"), 0))), H.By(y("Value1")), H.As(y("s"), H.Sum(y("Value2")))), settings=s))
    assert got == [(1, 8), (3, 2), (4, 4), (5, 1)]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def grouped(by="k"):
    return H.Group(y("T"), H.By(y(by)), H.As(y("s"), H.Sum(y("v"))))


@pytest.fixture
def many(spark):
    return {"T": spark.range(5000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))}


def test_sort_mode_sorts_and_hash_mode_hashes(spark, many):
    s = Settings()
    s.put("GroupMode", "Sort")
    plan = plan_of(run(spark, grouped(), tables=many, settings=s))
    assert "SortAggregate" in plan and "SortAggregate" not in plan_of(run(spark, grouped(), tables=many))
    assert rows(run(spark, grouped(), tables=many, settings=s)) == rows(run(spark, grouped(), tables=many))


def test_parallel_counts_for_its_tree_only(spark, many):
    s, before = Settings(), spark.conf.get("spark.sql.shuffle.partitions")
    assert run(spark, H.Let(grouped(), H.Parallel(7)), tables=many, settings=s).rdd.getNumPartitions() == 7
    assert s.options["Parallel"] == 1 and spark.conf.get("spark.sql.shuffle.partitions") == before != "7"
    assert "hashpartitioning(k#" in (plan := plan_of(run(spark, grouped(), tables=many, settings=s))) and f", {before})" in plan
    inner = run(spark, H.Join(H.Let(grouped(), H.Parallel(3)), H.Project(y("T"), H.As(y("j"), y("k"), y("w"), y("v"))), H.Where(H.Equal(y("k"), y("j")))), tables=many)
    assert inner.count() == 5000 and inner.sparkSession is spark


def test_partition_settings_reach_the_plan(spark, many):
    s = Settings()
    s.put("PartitionMode", "RadixBitsFixedMax")
    assert run(spark, grouped(), tables=many, settings=s).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = Settings()
    s.put("RadixJoinMinPartitionSize", 10)
    df = run(spark, grouped(), tables=many, settings=s)
    assert df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize") == "640" and df.count() == 50


def test_deferred_select(spark):
    s = Settings()
    s.put("DeferGatherPhase", True)
    t = H.Select(VALUE, H.Where(H.Greater(y("Value"), 3)))
    got = run(spark, t, settings=s)
    assert isinstance(got, Node) and got.head == "Gather" and got.args[0].columns == ["Value"] and got.args[1].head == "Selection"
    assert rows(run(spark, got)) == [(4,), (5,)]  # taken up without the setting
    assert rows(run(spark, H.Project(t, H.As(y("v"), H.Plus(y("Value"), 1))), settings=s)) == [(5,), (6,)]


def test_names_with_signs(spark):
    t = {"T": spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "`a.b` int, `c d` int, `e``f` int"), "U": spark.createDataFrame([(4, 9)], "`a.b` int, `x.y` int")}
    got = run(spark, H.Project(H.Select(y("T"), H.Where(H.Greater(y("a.b"), 1))), H.As(y("s.t"), H.Plus(y("a.b"), y("c d"), y("e`f")))), tables=t)
    assert got.columns == ["s.t"] and rows(got) == [(15,)]
    assert rows(run(spark, H.Join(y("T"), y("U"), H.Where(H.Equal(y("a.b"), y("a.b")))), tables=t)) == [(4, 5, 6, 9)]
    assert rows(run(spark, H.Group(y("T"), H.By(y("a.b")), H.As(y("m.n"), H.Max(y("c d")))), tables=t)) == [(1, 2), (4, 5)]
    assert [r[0] for r in run(spark, H.Order(y("T"), H.By(y("a.b"), y("desc"))), tables=t).collect()] == [4, 1]


@pytest.mark.parametrize("stretches", [2, 5, 300])
def test_interpolate_in_stretches(spark, stretches):
    import random

    r = random.Random(stretches)
    data = [(i, None if r.random() < 0.4 else float(r.randint(0, 99)), f"n{i}") for i in r.sample(range(10_000), 400)]
    df = spark.createDataFrame(data, "k int, p double, `__s` string").withColumnRenamed("__s", "note").repartition(4)
    p = [x[1] for x in sorted(data)]
    at = lambda i: p[i] if 0 <= i < len(p) else None
    mean = lambda a, b: None if a is None or b is None else (a + b) / 2
    want = [(x[0], x[1] if x[1] is not None else mean(at(i - 1), at(i + 1))) for i, x in enumerate(sorted(data))]
    got = R.interpolate(df, "p", "k", "v", stretches)
    assert got.columns == ["k", "p", "note", "v"] and sorted((x["k"], x["v"]) for x in got.collect()) == want
    assert R.interpolate(df.limit(0), "p", "k", "v", stretches).count() == 0


def d_tables(spark):
    """The four-row tables of the fixtures."""
    day = lambda *x: [S.date_days(i) for i in x]
    t = {
        "nation": {"n_nationkey": [1, 2, 3, 4], "n_regionkey": [1, 1, 2, 3], "n_name": ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA"]},
        "part": {"p_partkey": [4, 3, 2, 1], "p_retailprice": [100.01] * 4, "p_name": ["spring green yellow purple cornsilk", "cornflower chocolate smoke green pink", "moccasin green thistle khaki floral", "green blush tomato burlywood seashell"]},
        "supplier": {"s_suppkey": [1, 4, 2, 3], "s_nationkey": [1, 1, 2, 3]},
        "partsupp": {"ps_partkey": [1, 2, 3, 4], "ps_suppkey": [1, 2, 3, 4], "ps_supplycost": [771.64, 993.49, 337.09, 357.84]},
        "customer": {"c_custkey": [4, 7, 1, 4], "c_nationkey": [3, 3, 1, 4], "c_acctbal": [711.56, 121.65, 7498.12, 2866.83], "c_name": [f"Customer#00000000{i}" for i in (1, 2, 3, 4)], "c_mktsegment": ["AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "BUILDING"]},
        "orders": {"o_orderkey": [1, 0, 2, 3], "o_custkey": [4, 7, 1, 4], "o_totalprice": [178821.73, 154260.84, 202660.52, 155680.60], "o_orderdate": day("1998-01-24", "1992-05-01", "1992-12-21", "1994-06-18"), "o_shippriority": [1] * 4},
        "lineitem": {
            "l_orderkey": [1, 1, 2, 3], "l_partkey": [1, 2, 3, 4], "l_suppkey": [1, 2, 3, 4], "l_returnflag": list("NNAA"), "l_linestatus": list("OOFF"), "l_quantity": [17, 21, 8, 5],
            "l_extendedprice": [17954.55, 34850.16, 7712.48, 25284.0], "l_discount": [0.10, 0.05, 0.06, 0.06], "l_tax": [0.02, 0.06, 0.02, 0.06], "l_shipdate": day("1992-03-13", "1994-04-12", "1996-02-28", "1994-12-31"),
        },
    }
    return {n: table_literal(spark, c, {k: "bigint" for k in c if k.endswith("key") or k == "l_quantity"}) for n, c in t.items()}


def test_tpch_trees(spark):
    from plumbline.plans import tpch as T

    t = d_tables(spark)
    got = lambda tree: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in run(spark, tree, tables=t).collect()]
    day = S.date_days
    assert got(T.q1_tree("1998-08-31")) == [
        ("A", "F", 13, 32996.48, 31016.6912, 32587.703424, 6.5, 16498.24, 0.06, 2), ("N", "O", 38, 52804.71, 49266.747, 51576.38802, 19.0, 26402.355, 0.075, 2),
    ]
    assert got(T.q6_tree("1993-12-31", "1995-01-01")) == [(3259.548,)]
    assert got(T.q3_tree("1995-03-15", "1993-03-15", ("l_orderkey", "o_orderdate", "o_shippriority"))) == [(3, day("1994-06-18"), 1, 23766.96)]
    costs, keys = H.Join(T.parts_named("green"), y("partsupp"), H.Where(H.Equal(y("p_partkey"), y("ps_partkey")))), (("ps_partkey", "ps_suppkey"), ("l_partkey", "l_suppkey"))
    assert got(T.q9_tree(costs, *keys)) == [("ALGERIA", 1998, 3041.215), ("ALGERIA", 1994, 21977.76), ("ARGENTINA", 1998, 12244.362), ("BRAZIL", 1992, 4553.0112)]
    assert got(T.q9_tree(costs, *keys, "n_regionkey")) == [(1, 1998, 15285.577), (1, 1994, 21977.76), (2, 1992, 4553.0112)]
    c = lambda i: f"Customer#00000000{i}"
    want = [(c(3), 1, 2, day("1992-12-21"), 202660.52, 8), (c(1), 4, 1, day("1998-01-24"), 178821.73, 38), (c(4), 4, 1, day("1998-01-24"), 178821.73, 38), (c(1), 4, 3, day("1994-06-18"), 155680.6, 5), (c(4), 4, 3, day("1994-06-18"), 155680.6, 5)]
    assert sorted(got(T.q18_tree(1))) == sorted(want) and [x[4] for x in got(T.q18_tree(1))] == [x[4] for x in want]
    of = {c(1): 711.56, c(3): 7498.12, c(4): 2866.83}
    assert sorted(got(T.q18_tree(1, "c_acctbal"))) == sorted((of[x[0]], *x[1:]) for x in want)


def test_int_keys_meet_bigint_keys(spark):
    t = {"L": table_literal(spark, {"k": [1, 2, 3]}), "R": table_literal(spark, {"o": [2, 3, 2**40]})}
    assert t["L"].dtypes == [("k", "int")] and t["R"].dtypes == [("o", "bigint")]
    for head in ("Join", "PartitionedJoin"):
        assert rows(run(spark, Node(head, (y("L"), y("R"), H.Where(H.Equal(y("k"), y("o"))))), tables=t)) == [(2, 2), (3, 3)]
        assert rows(run(spark, Node(head, (y("R"), y("L"), H.Where(H.Equal(y("o"), y("k"))))), tables=t)) == [(2, 2), (3, 3)]


def test_entry_without_the_text_operators(monkeypatch):
    """A package that the text operators need and that is missing leaves the engine's queries."""
    import sys

    import __spark_entry__ as E

    for name in [m for m in sys.modules if m.startswith("plumbline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "q1" in E.queries() and "pipeline" not in E.queries() and "q1" in E.oracle_sql()


def test_shared_folder(spark):
    from types import SimpleNamespace

    from plumbline.session import shared_dir

    assert shared_dir(spark)
    unset = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(far)


def test_order_top_strings(spark):
    p = H.Table(H.ID(H.List(1, 2, 3)), H.LastName(H.DictionaryEncodedList(H.List(0, 8, 14, 20), "McCarthyMaddenLiskov")), H.Index(H.List(1)))
    assert [r["ID"] for r in run(spark, H.Sort(p, H.By(y("LastName")))).collect()] == [3, 2, 1]
    assert [r["ID"] for r in run(spark, H.Top(p, H.By(y("ID"), y("desc")), 2)).collect()] == [3, 2]
    assert [r["ID"] for r in run(spark, H.Select(p, H.Where(H.StringContainsQ(y("LastName"), "Madden")))).collect()] == [2]
    assert run(spark, H.Table(H.Column(y("a"), H.List(1, 2)))).columns == ["a"]
    xy = H.Table(H.o(H.List(1, 2, 3)), H.v(H.List(1.0, 5.0, 3.0)))
    df = run(spark, xy).withColumn("v", F.when(F.col("o") != 2, F.col("v")))
    assert [r[0] for r in df.select(S.interpolate(F.col("v"), F.col("o"))).collect()] == [1.0, 2.0, 3.0]


def test_register(spark):
    register("Twice", lambda args, env: args[0] * 2)
    assert run(spark, H.Twice(21)) == 42


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-1000, 1000)), min_size=1, max_size=40), st.integers(1, 5))
def test_partitions_do_not_matter(spark, data, n):
    df = spark.createDataFrame(data, "k int, v int").repartition(n)
    got = rows(R.group(R.select(df, S.greater(df, F.col("k"), -10)), ["k"], {"s": F.sum("v"), "n": F.count("v")}))
    want = {}
    for k, v in data:
        if k > -10:
            a = want.setdefault(k, [0, 0])
            a[0] += v
            a[1] += 1
    assert got == sorted((k, *v) for k, v in want.items())


def test_pushdown(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = R.project(R.select(li, F.col("l_quantity") > 45), {"l_tax": "l_tax"})._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


@pytest.mark.parametrize("n,k", [(1, 1), (10, 3), (1000, 37)])
def test_generated_columns(spark, n, k):
    from plumbline import sources as G

    df = G.rows(spark, n, {"u": G.unique(n, 3), "c": G.of_cardinality(k, 5), "r": G.uniform(7, -5, 5)})
    got = df.collect()
    assert sorted(r["u"] for r in got) == list(range(n)) and {r["c"] for r in got} == set(range(k)) and all(-5 <= r["r"] <= 5 for r in got)
    assert got == df.repartition(3).orderBy("u").collect() or sorted(got) == sorted(df.repartition(3).collect())
