"""Named queries over the given tables, most of them through the symbolic front end, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..sources import load, table_literal
from ..streaming import read_growing, run_available  # noqa: F401  (part of the public surface)
from . import tpch
from .settings import Settings
from .symbolic import H, Sym, evaluate

y = Sym


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations the symbolic queries name: dates as day numbers, flags as character codes."""
    li = load(spark, d, "lineitem")
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    return {
        "lineitem": li.withColumns({"l_shipdate": days("l_shipdate"), "rf_int": F.ascii("l_returnflag"), "ls_int": F.ascii("l_linestatus")}),
        "orders": load(spark, d, "orders").withColumn("o_orderdate", days("o_orderdate")),
        **{t: load(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part")},
    }


def sym(tree, settings: Settings | None = None, mode: str = "narrow"):
    """A query function for a tree; its relation must come out whole."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = evaluate(tree, spark, tables(spark, d), settings, literal_mode=mode)
        if not isinstance(out, DataFrame):
            raise TypeError(f"left unevaluated: {out}")
        return out

    return run


def where(p):
    return H.Where(p)


def As(*xs):
    return H.As(*[y(x) if isinstance(x, str) and i % 2 == 0 else x for i, x in enumerate(xs)])


LI, OR, CU, NA, PA = y("lineitem"), y("orders"), y("customer"), y("nation"), y("part")
KEYS = H.Project(LI, As("l_orderkey", y("l_orderkey"), "l_linenumber", y("l_linenumber"), "l_quantity", y("l_quantity"), "l_partkey", y("l_partkey")))
FIVE = As("n", H.Count(y("l_orderkey")), "sum_part", H.Sum(y("l_partkey")), "sum_line", H.Sum(y("l_linenumber")), "min_disc", H.Min(y("l_discount")), "max_price", H.Max(y("l_extendedprice")))
FIVE_SQL = "count(l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS sum_part, CAST(sum(l_linenumber) AS BIGINT) AS sum_line, min(l_discount) AS min_disc, max(l_extendedprice) AS max_price"
KEYCOLS = "l_orderkey, l_linenumber, l_quantity, l_partkey"


def group_mode(mode: str):
    s = Settings()
    s.put("GroupMode", mode)
    return s


def partitioned_keys(spark, d):
    """Which keys meet, by the partitioned join and by the reduction that drops parts without partner."""
    t = tables(spark, d)
    left = t["orders"].filter(F.col("o_totalprice") > 200000).select("o_orderkey")
    right = t["lineitem"].select("l_orderkey")
    return R.semi_reduce(left, right, "o_orderkey", "l_orderkey").join(R.semi_reduce(right, left, "l_orderkey", "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey").distinct()


def streamed_group(spark, d):
    """The keyed group as a stream over the orders file, kept per key."""
    schema = load(spark, d, "orders").schema
    df = read_growing(spark, f"{d}/orders.parquet", schema)
    agg = R.group(df, ["o_orderstatus"], {"n": F.count("o_orderkey"), "max_price": F.max("o_totalprice")})
    return run_available(agg)


def mixed_join(spark, d):
    """Keys of either width meet: an int column with a bigint one, either way round."""
    t = tables(spark, d)
    lines = t["lineitem"].select("l_orderkey", "l_linenumber").withColumn("k", F.col("l_orderkey").cast("int"))
    both = {"L": lines.select("k", "l_linenumber"), "O": t["orders"].select(F.col("o_orderkey").cast("long").alias("o"), "o_custkey")}
    a = evaluate(H.PartitionedJoin(y("L"), y("O"), where(H.Equal(y("k"), y("o")))), spark, both).select("k", "l_linenumber", "o_custkey")
    b = evaluate(H.Join(y("O"), y("L"), where(H.Equal(y("o"), y("k")))), spark, both)
    return a.join(b.groupBy("o").agg(F.count("k").alias("n")), F.col("k") == F.col("o")).select("k", "l_linenumber", "o_custkey", "n")


def span_plus(spark, d):
    """Plus over a span of the values of a literal column, as a literal of a projection."""
    total = evaluate(H.Plus(H.List(H.Span(1, 2, 3), H.Span(4))), spark)
    return evaluate(H.Project(NA, As("n_nationkey", y("n_nationkey"), "v", H.Plus(y("n_nationkey"), total))), spark, tables(spark, d))


#: The rows of the literal tables are those of the fixtures.
PEOPLE = H.Table(H.ID(H.List(1, 2, 3)), H.LastName(H.DictionaryEncodedList(H.List(0, 8, 14, 20), "McCarthyMaddenLiskov")), H.Index(H.List(1)))
INDEXED = H.TableIndexed(
    H.Table(H.k(H.List(1, 2), H.List(3)), H.v(H.List("a", "b"), H.List("c"))), H.List(0, 1 << 32, 1), H.Table(H.Column(y("o"), H.List(7, 8)), H.Column(y("v"), H.List("x", "y"))), H.List(1, 0, 1)
)


def deferred_then_grouped(spark, d):
    """A deferred filter taken up by the operator after it."""
    s = Settings()
    s.put("DeferGatherPhase", True)
    return evaluate(H.Group(H.Select(LI, where(H.Greater(y("l_linenumber"), 5))), H.By(y("l_linenumber")), As("n", H.Count(y("l_orderkey")))), spark, tables(spark, d), s)


def option(name: str, value):
    s = Settings()
    s.put(name, value)
    return s


def literal_join(spark, d):
    """The rows are those of the fixtures."""
    a = table_literal(spark, {"l_key": [4000001, 4000002, 20009, 5, 4], "l_value": [1, 2, 3, 4, 5]})
    b = table_literal(spark, {"o_key": [5, 4, 20009, 4000002], "o_value": [1, 2, 3, 4]})
    return R.partitioned_join(a, b, "l_key", "o_key")


Q: dict = {
    # filters
    "select_greater": (sym(H.Select(KEYS, where(H.Greater(y("l_quantity"), 45)))), f"SELECT {KEYCOLS} FROM lineitem WHERE l_quantity > 45"),
    "select_literal_first": (sym(H.Select(KEYS, where(H.Greater(3, y("l_quantity"))))), f"SELECT {KEYCOLS} FROM lineitem WHERE 3 > l_quantity"),
    "select_equal": (sym(H.Select(KEYS, where(H.Equal(y("l_linenumber"), 4)))), f"SELECT {KEYCOLS} FROM lineitem WHERE l_linenumber = 4"),
    "select_and": (
        sym(H.Select(KEYS, where(H.And(H.Greater(y("l_quantity"), 10), H.Greater(20, y("l_quantity"), H.PredicateID(1)), H.Equal(y("l_linenumber"), 2))))),
        f"SELECT {KEYCOLS} FROM lineitem WHERE l_quantity > 10 AND 20 > l_quantity AND l_linenumber = 2",
    ),
    "select_nested": (
        sym(H.Select(H.Select(KEYS, where(H.Greater(y("l_linenumber"), 3))), where(H.Greater(y("l_quantity"), 40)))),
        f"SELECT {KEYCOLS} FROM lineitem WHERE l_linenumber > 3 AND l_quantity > 40",
    ),
    "select_empty": (sym(H.Select(KEYS, where(H.And(H.Greater(y("l_quantity"), 20), H.Greater(10, y("l_quantity")))))), f"SELECT {KEYCOLS} FROM lineitem WHERE false"),
    "select_on_expression": (
        sym(H.Select(KEYS, where(H.Greater(H.Plus(H.Times(y("l_linenumber"), 2), 1), 13)))), f"SELECT {KEYCOLS} FROM lineitem WHERE l_linenumber * 2 + 1 > 13",
    ),
    "select_columns_compared": (sym(H.Select(KEYS, where(H.Greater(y("l_linenumber"), y("l_quantity"))))), f"SELECT {KEYCOLS} FROM lineitem WHERE l_linenumber > l_quantity"),
    "select_all": (sym(H.Select(NA, H.Function(True))), "SELECT * FROM nation"),
    "select_none": (sym(H.Select(NA, H.Function(False))), "SELECT * FROM nation WHERE false"),
    "select_string_carry": (
        sym(H.Project(H.Select(CU, where(H.Greater(y("c_nationkey"), 22))), As("c_name", y("c_name"), "c_mktsegment", y("c_mktsegment")))),
        "SELECT c_name, c_mktsegment FROM customer WHERE c_nationkey > 22",
    ),
    "select_deferred": (sym(H.Gather(H.Select(NA, where(H.Greater(y("n_regionkey"), 2))))), "SELECT * FROM nation WHERE n_regionkey > 2"),
    "narrow_literal": (sym(H.Select(KEYS, where(H.Greater(y("l_linenumber"), 3.7)))), f"SELECT {KEYCOLS} FROM lineitem WHERE l_linenumber > 3"),
    "narrow_literal_first": (sym(H.Select(KEYS, where(H.Greater(3.7, y("l_linenumber"))))), f"SELECT {KEYCOLS} FROM lineitem WHERE 3 > l_linenumber"),
    "sql_literal": (sym(H.Select(KEYS, where(H.Greater(3.7, y("l_linenumber")))), mode="sql"), f"SELECT {KEYCOLS} FROM lineitem WHERE 3.7 > l_linenumber"),
    "string_contains": (sym(H.Select(PA, where(H.StringContainsQ(y("p_name"), "widget")))), "SELECT * FROM part WHERE p_name LIKE '%widget%'"),
    # projection and scalars
    "project_rename": (sym(H.Project(CU, As("Key", y("c_custkey"), "Name", y("c_name")))), 'SELECT c_custkey AS "Key", c_name AS "Name" FROM customer'),
    "project_prune": (sym(H.Project(LI, As("l_tax", y("l_tax")))), "SELECT l_tax FROM lineitem"),
    "project_twice": (sym(H.Project(NA, As("a", y("n_nationkey"), "b", y("n_nationkey")))), "SELECT n_nationkey AS a, n_nationkey AS b FROM nation"),
    "project_nary_times": (
        sym(H.Project(LI, As("v", H.Times(y("l_linenumber"), y("l_orderkey"), 3), "w", H.Plus(y("l_linenumber"), y("l_linenumber"), y("l_linenumber"))))),
        "SELECT l_linenumber * l_orderkey * 3 AS v, l_linenumber + l_linenumber + l_linenumber AS w FROM lineitem",
    ),
    "project_minus_literal_first": (
        sym(H.Project(LI, As("v", H.Minus(100, y("l_linenumber")), "w", H.Minus(y("l_orderkey"), y("l_linenumber"), 1)))),
        "SELECT 100 - l_linenumber AS v, l_orderkey - l_linenumber - 1 AS w FROM lineitem",
    ),
    "project_int_divide": (
        sym(H.Project(LI, As("v", H.Divide(H.Minus(y("l_linenumber"), 5), 2), "w", H.Divide(y("l_orderkey"), 7), "x", H.Divide(y("l_quantity"), 4)))),
        "SELECT CAST((l_linenumber - 5) // 2 AS INTEGER) AS v, l_orderkey // 7 AS w, l_quantity / 4 AS x FROM lineitem",
    ),
    "project_nested_arith": (
        sym(H.Project(LI, As("disc_price", H.Times(y("l_extendedprice"), H.Minus(1.0, y("l_discount"))), "charge", H.Times(H.Times(y("l_extendedprice"), H.Minus(1.0, y("l_discount"))), H.Plus(y("l_tax"), 1.0))))),
        "SELECT l_extendedprice * (1.0::DOUBLE - l_discount) AS disc_price, l_extendedprice * (1.0::DOUBLE - l_discount) * (l_tax + 1.0::DOUBLE) AS charge FROM lineitem",
    ),
    "project_constant_fold": (sym(H.Project(NA, As("v", H.Plus(H.Times(2, 3), 2, 2), "w", H.Divide(H.Divide(12, 3), 2)))), "SELECT 10 AS v, 2 AS w FROM nation"),
    "project_bool": (
        sym(H.Project(CU, As("c_custkey", y("c_custkey"), "rich", H.Greater(y("c_acctbal"), 5000.0), "both", H.And(H.Greater(y("c_acctbal"), 0.0), H.Equal(y("c_nationkey"), 3))))),
        "SELECT c_custkey, c_acctbal > 5000.0 AS rich, c_acctbal > 0.0 AND c_nationkey = 3 AS both FROM customer",
    ),
    "string_join": (sym(H.Project(CU, As("v", H.StringJoin(y("c_name"), "/", y("c_mktsegment"))))), "SELECT c_name || '/' || c_mktsegment AS v FROM customer"),
    "symbol_call": (sym(H.Project(NA, As("v", H.Symbol("n_name")))), "SELECT n_name AS v FROM nation"),
    "date_filter": (
        sym(H.Project(H.Select(OR, where(H.And(H.Greater(y("o_orderdate"), H.DateObject("1996-06-30")), H.Greater(H.DateObject("1997-01-01"), y("o_orderdate"))))), As("o_orderkey", y("o_orderkey"), "o_orderdate", y("o_orderdate")))),
        "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30' AND o_orderdate < TIMESTAMP '1997-01-01'",
    ),
    "year_exact": (sym(H.Project(OR, As("o_orderkey", y("o_orderkey"), "v", H.Year(y("o_orderdate"))))), "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS v FROM orders"),
    "year_approx": (
        sym(H.Project(OR, As("o_orderkey", y("o_orderkey"), "v", H.YearApprox(y("o_orderdate"))))),
        "SELECT o_orderkey, CAST(trunc((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::DOUBLE + 719563.285::DOUBLE) / 365.265::DOUBLE) AS INTEGER) AS v FROM orders",
    ),
    "interpolate": (
        lambda spark, d: load(spark, d, "orders").select("o_orderkey", "o_custkey", S.interpolate(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("double")), F.col("o_orderkey"), F.col("o_custkey")).alias("v")),
        "SELECT o_orderkey, o_custkey, coalesce(p, (lag(p) OVER w + lead(p) OVER w) / 2) AS v FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::DOUBLE END AS p FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    # groups
    "group_none": (sym(H.Group(LI, FIVE)), f"SELECT {FIVE_SQL} FROM lineitem"),
    "group_one_key": (sym(H.Group(LI, H.By(y("l_linenumber")), FIVE)), f"SELECT l_linenumber, {FIVE_SQL} FROM lineitem GROUP BY 1"),
    "group_two_keys": (sym(H.Group(LI, H.By(y("rf_int"), y("ls_int")), FIVE)), f"SELECT ascii(l_returnflag) AS rf_int, ascii(l_linestatus) AS ls_int, {FIVE_SQL} FROM lineitem GROUP BY 1, 2"),
    "group_three_keys": (
        sym(H.Group(LI, H.By(y("l_returnflag"), y("l_linestatus"), y("l_linenumber")), As("n", H.Count(y("l_orderkey"))))),
        "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
    ),
    "group_min": (sym(H.Group(OR, H.By(y("o_custkey")), As("v", H.Min(y("o_totalprice"))))), "SELECT o_custkey, min(o_totalprice) AS v FROM orders GROUP BY 1"),
    "group_max": (sym(H.Group(OR, H.By(y("o_custkey")), As("v", H.Max(y("o_totalprice"))))), "SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1"),
    "group_sum": (sym(H.Group(LI, H.By(y("l_suppkey")), As("v", H.Sum(y("l_partkey"))))), "SELECT l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem GROUP BY 1"),
    "group_count": (sym(H.Group(LI, H.By(y("l_suppkey")), As("v", H.Count(y("l_partkey"))))), "SELECT l_suppkey, count(l_partkey) AS v FROM lineitem GROUP BY 1"),
    "group_large_key": (sym(H.Group(LI, H.By(y("l_orderkey")), FIVE)), f"SELECT l_orderkey, {FIVE_SQL} FROM lineitem GROUP BY 1"),
    "group_hash_mode": (sym(H.Group(LI, H.By(y("l_partkey")), FIVE), group_mode("Hash")), f"SELECT l_partkey, {FIVE_SQL} FROM lineitem GROUP BY 1"),
    "group_sort_mode": (sym(H.Group(LI, H.By(y("l_partkey")), FIVE), group_mode("Sort")), f"SELECT l_partkey, {FIVE_SQL} FROM lineitem GROUP BY 1"),
    "group_avg": (sym(H.Group(LI, H.By(y("l_linenumber")), As("v", H.Avg(y("l_linenumber")), "w", H.Avg(y("l_partkey"))))), "SELECT l_linenumber, avg(l_linenumber) AS v, avg(l_partkey) AS w FROM lineitem GROUP BY 1"),
    "group_constant_key": (sym(H.Group(LI, H.Function(7), As("v", H.Sum(y("l_partkey"))))), 'SELECT 7 AS "Function", CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem GROUP BY 1'),
    "group_bare": (sym(H.Group(LI, H.Sum(y("l_partkey")))), "SELECT CAST(sum(l_partkey) AS BIGINT) AS l_partkey FROM lineitem"),
    "count_star": (sym(H.Group(CU, H.By(y("c_nationkey")), As("n", H.Count(y("*"))))), "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1"),
    "group_empty": (sym(H.Group(H.Select(LI, H.Function(False)), As("n", H.Count(y("l_orderkey")), "s", H.Sum(y("l_partkey"))))), "SELECT count(l_orderkey) AS n, CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem WHERE false"),
    "having": (
        sym(H.Select(H.Group(OR, H.By(y("o_custkey")), As("n", H.Count(y("o_orderkey")))), where(H.Greater(y("n"), 14)))),
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14",
    ),
    # joins
    "join_partitioned": (
        sym(H.Project(H.PartitionedJoin(OR, LI, where(H.Equal(y("o_orderkey"), y("l_orderkey")))), As("o_orderkey", y("o_orderkey"), "l_linenumber", y("l_linenumber"), "o_custkey", y("o_custkey")))),
        "SELECT o_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    ),
    "join_partitioned_matched_keys": (partitioned_keys, "SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000"),
    "join_literal": (literal_join, "SELECT * FROM (VALUES (4000001,1),(4000002,2),(20009,3),(5,4),(4,5)) a(l_key,l_value) JOIN (VALUES (5,1),(4,2),(20009,3),(4000002,4)) b(o_key,o_value) ON l_key = o_key"),
    "join_int_bigint": (
        mixed_join,
        "SELECT CAST(l_orderkey AS INTEGER) AS k, l_linenumber, o_custkey, n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN (SELECT l_orderkey AS q, count(*) AS n FROM lineitem GROUP BY 1) ON q = o_orderkey",
    ),
    "join_fixed_partitions": (
        sym(H.Project(H.PartitionedJoin(OR, LI, where(H.Equal(y("o_orderkey"), y("l_orderkey")))), As("o_orderkey", y("o_orderkey"), "l_linenumber", y("l_linenumber"))), option("PartitionMode", "RadixBitsFixedMin")),
        "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    ),
    "join_minimum_partition": (
        sym(H.Project(H.PartitionedJoin(OR, LI, where(H.Equal(y("o_orderkey"), y("l_orderkey")))), As("o_orderkey", y("o_orderkey"), "l_linenumber", y("l_linenumber"))), option("RadixJoinMinPartitionSize", 1000)),
        "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    ),
    "join_all_columns": (sym(H.Join(NA, y("region"), where(H.Equal(y("n_regionkey"), y("r_regionkey"))))), "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_then_project": (
        sym(H.Project(H.Join(CU, NA, where(H.Equal(y("c_nationkey"), y("n_nationkey")))), As("c_custkey", y("c_custkey"), "v", H.Plus(y("n_regionkey"), y("c_nationkey"))))),
        "SELECT c_custkey, n_regionkey + c_nationkey AS v FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "join_empty_side": (sym(H.Join(H.Select(NA, H.Function(False)), y("region"), where(H.Equal(y("n_regionkey"), y("r_regionkey"))))), "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE false"),
    "join_composite": (
        sym(H.Join(H.Project(LI, As("a", y("l_orderkey"), "b", y("l_linenumber"))), H.Project(LI, As("c", y("l_orderkey"), "d", y("l_linenumber"), "p", y("l_partkey"))), where(H.Equal(H.List(y("a"), y("b")), H.List(y("c"), y("d")))))),
        "SELECT l.l_orderkey AS a, l.l_linenumber AS b, r.l_orderkey AS c, r.l_linenumber AS d, r.l_partkey AS p FROM lineitem l JOIN lineitem r USING (l_orderkey, l_linenumber)",
    ),
    "join_left_name_wins": (
        sym(H.Join(H.Project(NA, As("k", y("n_nationkey"), "name", y("n_name"), "rk", y("n_regionkey"))), H.Project(y("region"), As("rk2", y("r_regionkey"), "name", y("r_name"))), where(H.Equal(y("rk"), y("rk2"))))),
        "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS rk, r_regionkey AS rk2 FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    # order, top, streams
    "order_desc": (sym(H.Order(H.Project(CU, As("c_custkey", y("c_custkey"), "c_nationkey", y("c_nationkey"))), H.By(y("c_nationkey"), y("desc"), y("c_custkey")))), "SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_custkey"),
    "sort_asc": (sym(H.Sort(H.Project(NA, As("n_name", y("n_name"))), H.By(y("n_name")))), "SELECT n_name FROM nation ORDER BY n_name"),
    "top_k": (
        sym(H.Top(H.Project(OR, As("o_orderkey", y("o_orderkey"), "o_totalprice", y("o_totalprice"))), H.By(y("o_totalprice"), y("desc"), y("o_orderkey")), 10)),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "let_parallel": (sym(H.Let(H.Group(LI, H.By(y("l_linenumber")), FIVE), H.Parallel(4))), f"SELECT l_linenumber, {FIVE_SQL} FROM lineitem GROUP BY 1"),
    "streamed_group": (streamed_group, "SELECT o_orderstatus, count(o_orderkey) AS n, max(o_totalprice) AS max_price FROM orders GROUP BY 1"),
    "dictionary_table": (sym(H.Select(PEOPLE, where(H.StringContainsQ(y("LastName"), "i")))), """SELECT * FROM (VALUES (3, 'Liskov')) t("ID", "LastName")"""),
    "indexed_table": (sym(H.Project(INDEXED, As("k", y("k"), "v", y("v"), "s", H.Plus(y("k"), y("o"))))), "SELECT * FROM (VALUES (1, 'a', 9), (3, 'c', 10), (2, 'b', 10)) t(k, v, s)"),
    "span_plus": (span_plus, "SELECT n_nationkey, n_nationkey + 10 AS v FROM nation"),
    "select_deferred_then_group": (deferred_then_grouped, "SELECT l_linenumber, count(l_orderkey) AS n FROM lineitem WHERE l_linenumber > 5 GROUP BY 1"),
    "let_stats": (sym(H.Let(H.Group(OR, H.By(y("o_orderstatus")), As("n", H.Count(y("o_orderkey")))), H.Stats(0))), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "interpolate_tree": (
        lambda spark, d: evaluate(
            H.Project(y("T"), As("k", y("k"), "v", H.Interpolate(y("p"), y("k")))), spark,
            {"T": load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("double")).alias("p"))},
        ),
        "SELECT o_orderkey AS k, coalesce(p, (lag(p) OVER w + lead(p) OVER w) / 2) AS v FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey::DOUBLE END AS p FROM orders) WINDOW w AS (ORDER BY o_orderkey)",
    ),
    "inline_table": (
        sym(H.Group(H.Table(H.NATION(H.List(H.Span(1, 2, 1), H.Span(2, 1, 1, 3))), H.YEAR(H.List(1985, 2035, 1800, 2035, 1800, 2035, 1985)), H.QUANTITY(H.List(17, 21, 8, 5, 8, 7, 3))), H.By(y("NATION"), y("YEAR")), As("n", H.Count(y("QUANTITY")), "s", H.Sum(y("QUANTITY")), "lo", H.Min(y("QUANTITY")), "hi", H.Max(y("QUANTITY"))))),
        'SELECT a AS "NATION", b AS "YEAR", count(*) AS n, CAST(sum(c) AS BIGINT) AS s, min(c) AS lo, max(c) AS hi FROM (VALUES (1,1985,17),(2,2035,21),(1,1800,8),(2,2035,5),(1,1800,8),(1,2035,7),(3,1985,3)) t(a,b,c) GROUP BY 1, 2',
    ),
    **tpch.QUERIES,
}
