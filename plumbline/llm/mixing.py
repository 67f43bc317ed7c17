"""Mixing sources to target weights by hierarchical budgeting.

Sources stand in a tree domain - language - source. A token budget for the whole is shared out from the root: a node's budget
goes to its children in proportion to their weights, but no child gets more than all its leaves can supply. What a short
child leaves over goes to its siblings (again by weight, as far as they can take it), and only what the whole family can't
take is missing there, which the family's own parent has already given to the family's siblings. This is water filling at
each level, with closed-form levels from running sums, so no loop and no rounding that depends on the order of rows.

A leaf supplies its tokens `max_epochs` times. Its budget is met by whole epochs and then a prefix of one more: the rows in
that epoch's own seeded order, as long as the running sum of tokens stays within what is left. The running sum is found by
ranges of the seeded key (sums per range, offsets over coarse and then over fine ranges, sums within a range), so no window ever
holds a whole leaf, or more than a few hundred ranges of it.

Which domain a source is of says a table (source, domain); sources that aren't in it are of the domain `other`, and where it
names one more than once the least domain holds. Such a table, and that of the leaves, is sent to the tasks if it is small.

All arithmetic is on whole numbers. A row's tokens are a quarter of its UTF-8 bytes, rounded up, unless `tokens` says otherwise. Null
text has none; rows without tokens are taken in an epoch that reaches them. Null language or source is a node of its own
(empty name). Rows equal in id and leaf share a key; ties go by tokens. Weights not given are `default`; a node of weight 0 gets
nothing. Texts of any length count whole. Empty input gives an empty result. Other columns pass, null or not, under any name; columns
named as a result (tokens, leaf_budget, epochs) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, same, small, table, unused

#: Ranges of the seeded key in a leaf: three hexadecimal digits, the first two of them a coarse range.
HEX, COARSE = 3, 2
#: Leaves up to which the leaf table is sent to every task; beyond it is joined by key.
SMALL_LEAVES = 5_000
LEVELS = ("domain", "language", "source_name")
BIG = "decimal(38,0)"


def byte_tokens() -> Column:
    return F.expr("coalesce((octet_length(text) + 3) div 4, 0L)")


def weight(levels: tuple[str, ...], weights: Mapping[str, int], default: int) -> Column:
    """Whole-number weight of a node: that of its own name at its level, as "level:name", else the default."""
    c = F.lit(default)
    for k, w in weights.items():
        level, _, name = k.partition(":")
        if level == levels[-1]:
            c = F.when(F.col(level) == name, F.lit(int(w))).otherwise(c)
    return c


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `given`: the share of `budget` (same in a family) each child gets under `cap` and `w`, to the whole token below.

    Children in order of cap / w are full one after another while the level, what is left over the weights left, reaches them.
    """
    live = nodes.withColumn("__r", F.when(F.col("w") > 0, F.col("cap") / F.col("w")))  # order only; ties don't matter
    w = Window.partitionBy(*parent).orderBy(F.col("__r").asc_nulls_last(), F.col(name))
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))
    d = live.withColumns({"__capped": F.coalesce(F.sum(cap).over(up), F.lit(0)).cast(BIG), "__w": F.sum("w").over(Window.partitionBy(*parent)).cast(BIG) - F.coalesce(F.sum("w").over(up), F.lit(0)).cast(BIG)})
    left = F.greatest(F.col("budget").cast(BIG) - F.col("__capped"), F.lit(0).cast(BIG))
    d = d.withColumn("__left", left).withColumn("__full", (F.col("w") > 0) & (F.col("cap").cast(BIG) * F.col("__w") <= F.col("__left") * F.col("w")))
    # the level stays the same from the first child that isn't full
    first = Window.partitionBy(*parent)
    stop = F.min(F.when(~F.col("__full") & (F.col("w") > 0), F.struct(F.col("__r"), F.col(name), F.col("__left").alias("l"), F.col("__w").alias("v")))).over(first)
    d = d.withColumn("__s", stop)
    share = F.expr("cast((__s.l * cast(w as decimal(20,0))) div __s.v as bigint)")
    given = F.when(F.col("w") <= 0, F.lit(0)).when(F.col("__full"), F.col("cap")).otherwise(F.least(F.col("cap"), share))
    return d.withColumn("given", given.cast("long")).drop("__r", "__capped", "__w", "__left", "__full", "__s")


def budgets(leaves: DataFrame, total: tuple[int, int] | int, weights: Mapping[str, int], default: int = 1, max_epochs: int = 1) -> DataFrame:
    """leaves (domain, language, source_name, supply) with `budget`: the tokens each is to give. `total`: tokens, or share of the supply as (num, den)."""
    leaf = leaves.withColumn("cap", F.col("supply") * max_epochs)
    d = leaf.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("__supply"))
    d = d.withColumns({"w": weight(LEVELS[:1], weights, default), "__root": F.lit(0)})
    if isinstance(total, tuple):  # a share of what all domains have
        d = d.withColumn("__all", F.sum("__supply").over(Window.partitionBy("__root")))
        total = F.expr(f"cast((cast(__all as decimal(38,0)) * {int(total[0])}) div {int(total[1])} as bigint)")
    d = d.withColumn("budget", F.lit(total).cast("long") if isinstance(total, int) else total)
    d = fill(d, ["__root"], "domain").select("domain", F.col("given").alias("budget"))
    la = leaf.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).join(d, "domain")
    la = fill(la.withColumn("w", weight(LEVELS[:2], weights, default)), ["domain"], "language").select("domain", "language", F.col("given").alias("budget"))
    so = leaf.join(la, ["domain", "language"])
    return fill(so.withColumn("w", weight(LEVELS, weights, default)), ["domain", "language"], "source_name").select(*LEVELS, "supply", F.col("given").alias("budget"))


def mix(
    docs: DataFrame, *, total: tuple[int, int] | int, weights: Mapping[str, int] = {}, default: int = 1, max_epochs: int = 1, seed: int = 0,
    id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None, domains: DataFrame | None = None,
) -> DataFrame:
    """All rows and columns with tokens, leaf_budget and `epochs`: how many times the row is in the mixture (0: left out).

    `domains` is a table (source, domain).
    """
    docs = docs.drop("tokens", "leaf_budget", "epochs")
    dom, lang, src, key, rng, run, whole, rest, ahead, own = unused(docs, *"__domain __language __source __key __range __run __whole __rest __ahead __own".split())
    ld, ll, ls = unused(docs, "__l_domain", "__l_language", "__l_source")
    rows = docs.withColumns({
        "tokens": (byte_tokens() if tokens is None else tokens).cast("long"),
        lang: F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("")), src: F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("")),
    })
    if domains is None:
        rows = rows.withColumn(dom, F.lit("other"))
    else:
        tree = table(domains.groupBy(F.col("source").cast("string").alias(own)).agg(F.min("domain").alias(dom)), "domains")
        rows = rows.join(small(tree, SMALL_LEAVES), F.col(src) == F.col(own), "left").drop(own).withColumn(dom, F.coalesce(dom, F.lit("other")))
    leaf = [F.col(a).alias(b) for a, b in zip((dom, lang, src), LEVELS, strict=True)]
    leaves = table(budgets(rows.groupBy(*leaf).agg(F.sum("tokens").alias("supply")), total, weights, default, max_epochs), "leaf-budgets")
    lv = [ld, ll, ls]
    plan = leaves.select(
        *[F.col(b).alias(c) for b, c in zip(LEVELS, lv, strict=True)], F.col("budget").alias("leaf_budget"),
        F.expr("case when supply > 0 then budget div supply else 0L end").alias(whole), F.expr("case when supply > 0 then budget % supply else 0L end").alias(rest),
    )
    on = (F.col(dom) == F.col(ld)) & (F.col(lang) == F.col(ll)) & (F.col(src) == F.col(ls))
    rows = rows.join(small(plan, SMALL_LEAVES), on)
    # the order of the epoch that is cut: its seed, its number and the row's id
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(whole).cast("string"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))))
    rows = rows.withColumn(key, order).withColumn(rng, F.substring(key, 1, HEX))
    before = lambda *p: Window.partitionBy(*p).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(lv, "dls", strict=True)], F.col(rng).alias("g")).agg(F.sum("tokens").alias("t"))
    ranges = table(ranges.withColumn("c", F.substring("g", 1, COARSE)), "ranges")
    coarse = ranges.groupBy("d", "l", "s", F.col("c").alias("g")).agg(F.sum("t").alias("t")).select("d", "l", "s", F.col("g").alias("c"), F.coalesce(F.sum("t").over(before("d", "l", "s")), F.lit(0)).alias("far"))
    ranges = ranges.withColumn("near", F.coalesce(F.sum("t").over(before("d", "l", "s", "c")), F.lit(0))).join(coarse, ["d", "l", "s", "c"])
    ranges = ranges.select("d", "l", "s", "g", (F.col("far") + F.col("near")).alias(ahead))
    inside = Window.partitionBy(*lv, rng).orderBy(key, "tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(run, F.sum("tokens").over(inside))
    ranges = ranges.select(*[F.col(n).alias(f"{c}_") for c, n in zip(lv, "dls", strict=True)], F.col("g").alias(f"{rng}_"), ahead)
    match = F.col(rng) == F.col(f"{rng}_")
    for c in lv:
        match = match & (F.col(c) == F.col(f"{c}_"))
    taken = F.col(ahead) + F.col(run) <= F.col(rest)
    return rows.join(ranges, match).select(*same(docs), "tokens", "leaf_budget", (F.col(whole) + F.when(taken & (F.col(rest) > 0), 1).otherwise(0)).cast("int").alias("epochs"))


#: Production parameters of the query: half of all tokens, at most four epochs.
WEIGHTS = {"domain:domain0": 4, "domain:domain1": 3, "domain:domain2": 2, "language:en": 5, "language:de": 3, "source_name:src0": 2}
TOTAL = (1, 2)
EPOCHS = 4
SEED = 11
#: The tree above the sources of the query: twenty sources in four domains.
DOMAINS = tuple((f"src{i}", f"domain{i // 5}") for i in range(20))


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, DOMAINS))} AS t(source, domain)")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = mix(docs, total=TOTAL, weights=WEIGHTS, max_epochs=EPOCHS, seed=SEED, domains=domain_table(spark))
    return out.select("doc_id", "lang", "source", "tokens", "leaf_budget", "epochs")


QUERIES = {"op9_mixing": op9_mixing}


def _w(level: str) -> str:
    own = [(k.partition(":")[2], w) for k, w in WEIGHTS.items() if k.startswith(f"{level}:")]
    return f"CASE {level} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in own) + " ELSE 1 END" if own else "1"


def _fill_sql(src: str, parent: str, name: str, keys: str) -> str:
    """One level in SQL; all numbers are HUGEINT."""
    return f"""(SELECT {keys}, CASE WHEN w <= 0 THEN 0 WHEN capped_full THEN cap ELSE least(cap, (first_value(CASE WHEN NOT capped_full AND w > 0 THEN lft END IGNORE NULLS) OVER f * w)
 // first_value(CASE WHEN NOT capped_full AND w > 0 THEN wl END IGNORE NULLS) OVER f) END AS budget
FROM (SELECT *, w > 0 AND cap * wl <= lft * w AS capped_full FROM (SELECT *, greatest(budget - coalesce(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) OVER u, 0), 0) AS lft, sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER u, 0) AS wl
FROM (SELECT *, CASE WHEN w > 0 THEN cap::DOUBLE / w END AS r FROM {src}) WINDOW u AS (PARTITION BY {parent} ORDER BY r NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
WINDOW f AS (PARTITION BY {parent} ORDER BY r NULLS LAST, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


ORACLE = {
    "op9_mixing": f"""WITH tree(src, domain) AS (VALUES {", ".join(map(str, DOMAINS))}),
d AS (SELECT doc_id, lang, source, (coalesce(strlen(text), 0) + 3) // 4 AS tokens, coalesce(lang, '') AS language, coalesce(source, '') AS source_name,
coalesce(domain, 'other') AS domain FROM documents LEFT JOIN tree ON src = source),
leaf AS (SELECT domain, language, source_name, sum(tokens)::HUGEINT AS supply, sum(tokens)::HUGEINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
d1 AS (SELECT domain, sum(cap)::HUGEINT AS cap, (SELECT sum(supply)::HUGEINT * {TOTAL[0]} // {TOTAL[1]} FROM leaf) AS budget, ({_w('domain')})::HUGEINT AS w FROM leaf GROUP BY 1),
b1 AS {_fill_sql('d1', '1=1', 'domain', 'domain')},
d2 AS (SELECT domain, language, sum(cap)::HUGEINT AS cap, any_value(b1.budget) AS budget, ({_w('language')})::HUGEINT AS w FROM leaf JOIN b1 USING (domain) GROUP BY 1, 2),
b2 AS {_fill_sql('d2', 'domain', 'language', 'domain, language')},
d3 AS (SELECT leaf.*, b2.budget, ({_w('source_name')})::HUGEINT AS w FROM leaf JOIN b2 USING (domain, language)),
b3 AS {_fill_sql('d3', 'domain, language', 'source_name', 'domain, language, source_name, supply')},
e AS (SELECT d.*, budget, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS whole, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest FROM d JOIN b3 USING (domain, language, source_name)),
g AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source_name ORDER BY md5('{SEED}|' || whole::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')), tokens ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT doc_id, lang, source, tokens, budget::BIGINT AS leaf_budget, (whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END)::INTEGER AS epochs FROM g"""
}
