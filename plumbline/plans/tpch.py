"""Five TPC-H shapes over the given tables (no partsupp and no ship priority there; the part's price stands for the cost).

They stand here twice: by the DataFrame operators, and as trees of the symbolic front end, which any tables with these column
names can be evaluated under (`q1_tree` to `q18_tree`; dates are day numbers there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load
from .symbolic import H, Sym, evaluate

MONEY = "decimal(30,6)"


def dec(c):
    """Exact sums: doubles with two decimals become decimals before they are added, so partition order can't show."""
    return c.cast("decimal(18,2)")


def disc_price():
    return dec(F.col("l_extendedprice")) * (1 - dec(F.col("l_discount")))


def total(c, name: str):
    return F.sum(c).cast("double").alias(name)


def q1(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-08-31").cast("timestamp_ntz"))
    q, p, di = (dec(F.col(f"l_{x}")) for x in ("quantity", "extendedprice", "discount"))
    return (
        li.groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(q, "sum_qty"), total(p, "sum_base_price"), total(disc_price(), "sum_disc_price"),
            total(disc_price() * (1 + dec(F.col("l_tax"))), "sum_charge"),
            F.round(F.sum(q).cast("double") / F.count("*"), 6).alias("avg_qty"), F.round(F.sum(p).cast("double") / F.count("*"), 6).alias("avg_price"),
            F.round(F.sum(di).cast("double") / F.count("*"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


def _q3(spark: SparkSession, d: str, early: bool) -> DataFrame:
    """early: the segment filter reduces orders by a semi-join before anything else."""
    cust = load(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    orders = load(spark, d, "orders").filter(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") > day).select("l_orderkey", "l_extendedprice", "l_discount")
    o = orders.join(cust, orders.o_custkey == cust.c_custkey, "left_semi" if early else "inner")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy("l_orderkey", "o_orderdate").agg(total(disc_price(), "revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)
    )


def q3(spark, d):
    return _q3(spark, d, False)


def q3_semi(spark, d):
    return _q3(spark, d, True)


def _q6_rows(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return load(spark, d, "lineitem").filter(
        (c("l_shipdate") > F.lit("1995-12-31").cast("timestamp_ntz")) & (c("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & (c("l_discount") > 0.0499) & (c("l_discount") < 0.07001) & (c("l_quantity") < 24)
    )


def q6(spark, d):
    return _q6_rows(spark, d).agg(total(dec(F.col("l_extendedprice")) * dec(F.col("l_discount")), "revenue"))


def q6_projected(spark, d):
    """The same with the product projected first, as a hand-pushed variant."""
    return _q6_rows(spark, d).select((dec(F.col("l_extendedprice")) * dec(F.col("l_discount"))).alias("r")).agg(total(F.col("r"), "revenue"))


def _q9(spark: SparkSession, d: str, key: str) -> DataFrame:
    part = load(spark, d, "part").filter(F.col("p_name").contains("widget")).select("p_partkey", "p_retailprice")
    nation = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    supp = load(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    o = load(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("o_year"))
    amount = disc_price() - dec(F.col("p_retailprice")) * dec(F.col("l_quantity")) / 100
    return (
        li.join(part, li.l_partkey == part.p_partkey).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(key, "o_year").agg(F.round(F.sum(amount).cast("double"), 2).alias("sum_profit"))
    )


def q9(spark, d):
    return _q9(spark, d, "n_name").orderBy("n_name", F.desc("o_year"))


def q9_region(spark, d):
    return _q9(spark, d, "n_regionkey").orderBy("n_regionkey", F.desc("o_year"))


def _q18(spark: SparkSession, d: str, key: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    big = li.groupBy("l_orderkey").agg(total(dec(F.col("l_quantity")), "sum_qty")).filter(F.col("sum_qty") > 180)
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice")
    c = load(spark, d, "customer").select("c_custkey", *{key})
    return (
        big.join(o, big.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
        .select(key, "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty")
        .orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)
    )


def q18(spark, d):
    return _q18(spark, d, "c_name")


def q18_acctbal(spark, d):
    return _q18(spark, d, "c_acctbal")


def names(*columns: str, **made) -> object:
    """As(...) of columns under their own names, then of expressions."""
    out = [x for c in columns for x in (Sym(c), Sym(c))]
    return H.As(*out, *[x for n, e in made.items() for x in (Sym(n), e)])


def _y(name: str) -> Sym:
    return Sym(name)


def _where(*ps) -> object:
    return H.Where(ps[0] if len(ps) == 1 else H.And(*ps))


def _on(a, b) -> object:
    side = lambda k: H.List(*map(_y, k)) if isinstance(k, tuple) else _y(k)
    return H.Where(H.Equal(side(a), side(b)))


_DISCOUNTED = H.Times(_y("l_extendedprice"), H.Minus(1, _y("l_discount")))


def q1_tree(before: str):
    rows = H.Select(_y("lineitem"), _where(H.Greater(H.DateObject(before), _y("l_shipdate"))))
    rows = H.Project(rows, names("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", disc_price=_DISCOUNTED, charge=H.Times(_DISCOUNTED, H.Plus(_y("l_tax"), 1))))
    sums = dict(sum_qty="l_quantity", sum_base_price="l_extendedprice", sum_disc_price="disc_price", sum_charge="charge")
    means = dict(avg_qty="l_quantity", avg_price="l_extendedprice", avg_disc="l_discount")
    aggs = names(**{n: H.Sum(_y(c)) for n, c in sums.items()}, **{n: H.Avg(_y(c)) for n, c in means.items()}, count_order=H.Count(_y("l_quantity")))
    return H.Order(H.Group(rows, H.By(_y("l_returnflag"), _y("l_linestatus")), aggs), H.By(_y("l_returnflag"), _y("l_linestatus")))


def q3_tree(ordered_before: str, shipped_after: str, keys: tuple = ("l_orderkey", "o_orderdate")):
    customers = H.Project(H.Select(_y("customer"), _where(H.Equal(_y("c_mktsegment"), "BUILDING"))), names("c_custkey"))
    orders = H.Select(_y("orders"), _where(H.Greater(H.DateObject(ordered_before), _y("o_orderdate"))))
    lines = H.Project(H.Select(_y("lineitem"), _where(H.Greater(_y("l_shipdate"), H.DateObject(shipped_after)))), names("l_orderkey", "l_extendedprice", "l_discount"))
    rows = H.Join(H.Join(customers, orders, _on("c_custkey", "o_custkey")), lines, _on("o_orderkey", "l_orderkey"))
    rows = H.Group(H.Project(rows, names(*keys, part=_DISCOUNTED)), H.By(*map(_y, keys)), names(revenue=H.Sum(_y("part"))))
    return H.Top(rows, H.By(_y("revenue"), _y("desc"), _y("o_orderdate"), _y("l_orderkey")), 10)


def q6_tree(shipped_after: str, shipped_before: str):
    lines = H.Select(_y("lineitem"), _where(
        H.Greater(24, _y("l_quantity")), H.Greater(_y("l_discount"), 0.0499), H.Greater(0.07001, _y("l_discount")),
        H.Greater(_y("l_shipdate"), H.DateObject(shipped_after)), H.Greater(H.DateObject(shipped_before), _y("l_shipdate")),
    ))
    return H.Group(H.Project(lines, names(part=H.Times(_y("l_extendedprice"), _y("l_discount")))), names(revenue=H.Sum(_y("part"))))


def q9_tree(costs, cost_keys, line_keys, nation: str = "n_name"):
    """`costs`: a relation with ps_supplycost and the keys that lines meet it by."""
    suppliers = H.Project(H.Join(_y("nation"), _y("supplier"), _on("n_nationkey", "s_nationkey")), names("s_suppkey", nation))
    rows = H.Join(H.Join(costs, _y("lineitem"), _on(cost_keys, line_keys)), suppliers, _on("l_suppkey", "s_suppkey"))
    rows = H.Join(rows, H.Project(_y("orders"), names("o_orderkey", o_year=H.Year(_y("o_orderdate")))), _on("l_orderkey", "o_orderkey"))
    rows = H.Project(rows, names(nation, "o_year", amount=H.Minus(_DISCOUNTED, H.Times(_y("ps_supplycost"), _y("l_quantity")))))
    return H.Order(H.Group(rows, H.By(_y(nation), _y("o_year")), names(sum_profit=H.Sum(_y("amount")))), H.By(_y(nation), _y("o_year"), _y("desc")))


def parts_named(word: str):
    return H.Select(_y("part"), _where(H.StringContainsQ(_y("p_name"), word)))


def q18_tree(more_than: int, customer: str = "c_name"):
    big = H.Select(H.Group(_y("lineitem"), H.By(_y("l_orderkey")), names(sum_qty=H.Sum(_y("l_quantity")))), _where(H.Greater(_y("sum_qty"), more_than)))
    rows = H.Join(H.Join(_y("customer"), _y("orders"), _on("c_custkey", "o_custkey")), big, _on("o_orderkey", "l_orderkey"))
    rows = H.Project(rows, names(*dict.fromkeys((customer, "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "sum_qty"))))
    return H.Top(rows, H.By(_y("o_totalprice"), _y("desc"), _y("o_orderdate"), _y("o_orderkey")), 100)


def tree_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations of the trees: day numbers for dates, and decimals for what is summed, so that sums are exact."""
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    small = lambda df, *cs: df.withColumns({c: F.col(c).cast("decimal(12,2)") for c in cs})
    return {
        "lineitem": small(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", "l_tax").withColumn("l_shipdate", days("l_shipdate")),
        "orders": load(spark, d, "orders").withColumn("o_orderdate", days("o_orderdate")), "part": small(load(spark, d, "part"), "p_retailprice"),
        **{t: load(spark, d, t) for t in ("nation", "customer", "supplier")},
    }


def _tree(tree):
    """A query function for a tree; decimals come out as doubles."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = evaluate(tree, spark, tree_tables(spark, d))
        return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])

    return run


_DISC = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"
_Q3 = f"""SELECT l_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(sum({_DISC}) AS DOUBLE) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY 1, 2 ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
_Q6 = """SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem
WHERE l_shipdate > TIMESTAMP '1995-12-31' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount > 0.0499 AND l_discount < 0.07001 AND l_quantity < 24"""


def _q9_sql(key: str) -> str:
    return f"""SELECT {key}, CAST(year(o_orderdate) AS INTEGER) AS o_year,
round(CAST(sum({_DISC} - CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2)) * CAST('0.01' AS DECIMAL(4,2))) AS DOUBLE), 2) AS sum_profit
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN orders ON l_orderkey = o_orderkey WHERE p_name LIKE '%widget%' GROUP BY 1, 2"""


def _q18_sql(key: str) -> str:
    cols = f"{key}, c_custkey"
    return f"""SELECT {cols}, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, sum_qty
FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty FROM lineitem GROUP BY 1) q
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE sum_qty > 180
ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"""


_Q1 = f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price, CAST(sum({_DISC}) AS DOUBLE) AS sum_disc_price,
CAST(sum({_DISC} * (1 + CAST(l_tax AS DECIMAL(18,2)))) AS DOUBLE) AS sum_charge,
round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_qty,
round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_price,
round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-31' GROUP BY 1, 2"""

_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)"
_COSTS = H.Project(parts_named("widget"), names(ps_partkey=Sym("p_partkey"), ps_supplycost=Sym("p_retailprice")))


def _tree_q9_sql(key: str) -> str:
    return f"""SELECT {key}, CAST(year(o_orderdate) AS INTEGER) AS o_year,
CAST(sum({_DISC} - CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_profit
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN orders ON l_orderkey = o_orderkey WHERE p_name LIKE '%widget%' GROUP BY 1, 2"""


TREES = {
    "tree_q1": (_tree(q1_tree("2001-09-01")), _Q1.replace("<= TIMESTAMP '2001-08-31'", "< TIMESTAMP '2001-09-01'")),
    "tree_q3": (_tree(q3_tree("1998-03-15", "1998-03-15")), _Q3.replace("CAST(o_orderdate AS DATE) AS o_orderdate", f"{_DAY} AS o_orderdate").replace("l_shipdate > TIMESTAMP '1998-03-15'", "CAST(l_shipdate AS DATE) > DATE '1998-03-15'")),
    "tree_q6": (_tree(q6_tree("1995-12-31", "1997-01-01")), _Q6.replace("l_shipdate > TIMESTAMP '1995-12-31'", "CAST(l_shipdate AS DATE) > DATE '1995-12-31'")),
    "tree_q9": (_tree(q9_tree(_COSTS, "ps_partkey", "l_partkey")), _tree_q9_sql("n_name")),
    "tree_q9_region": (_tree(q9_tree(_COSTS, "ps_partkey", "l_partkey", "n_regionkey")), _tree_q9_sql("n_regionkey")),
    "tree_q18": (_tree(q18_tree(180)), _q18_sql("c_name").replace("CAST(o_orderdate AS DATE) AS o_orderdate", f"{_DAY} AS o_orderdate")),
    "tree_q18_acctbal": (_tree(q18_tree(180, "c_acctbal")), _q18_sql("c_acctbal").replace("CAST(o_orderdate AS DATE) AS o_orderdate", f"{_DAY} AS o_orderdate")),
}
QUERIES = {
    "q1": (q1, _Q1), "q3": (q3, _Q3), "q3_semi": (q3_semi, _Q3), "q6": (q6, _Q6), "q6_projected": (q6_projected, _Q6),
    "q9": (q9, _q9_sql("n_name")), "q9_region": (q9_region, _q9_sql("n_regionkey")), "q18": (q18, _q18_sql("c_name")), "q18_acctbal": (q18_acctbal, _q18_sql("c_acctbal")),
    **TREES,
}
