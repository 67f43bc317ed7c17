"""Sharding by proportional stratified interleaving.

Rows of a source are put in a seeded random order; a row's fractional rank is (rank + 1/2) / rows of its source. Sorting all
rows by fractional rank interleaves the sources in proportion, so any stretch of that order, and so any shard, holds the
mixture of the whole. The order is cut into shards whose row counts differ by one at most (law `rows`).

Both ranks are found without a global sort or a window over a whole source: rows are dealt into fine ranges of the sort key,
ranges are counted, and a row's rank is its range's offset plus its place in the range. The ranges' size doesn't depend on
how the rows spread over the sources: the seeded key is uniform within a source, and fractional ranks are uniform by
construction. Groups of equal texts are dealt like any other rows: keeping a group of any size whole would break the law.

The seeded order is that of md5(seed | id | source), then id, checksum and size: rows that agree in all of them may change places
with each other only. Null source is a source of its own; null text has no bytes and the checksum of the empty text; texts of any
length are read whole; a null id is an empty one in the key. Empty input gives an empty result. `interleave` returns its five
columns and reads no others; `write_shards` writes all columns of the input, under any name, but replaces `shard` and `slot`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, same, table, text_of, unused

#: Least and most rows aimed at in a range of keys, which is what one window sorts; between them, ten thousand ranges.
RANGE_ROWS = (500, 50_000)


def ranged_rank(df: DataFrame, part: Column, key: list[Column], rng: Column, name: str) -> DataFrame:
    """0-based rank by `key` within `part`, by ranges: `rng` must be whole-numbered and rise with the key."""
    d = df.withColumns({"__p": part, "__g": rng})
    counts = d.groupBy("__p", "__g").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__p").alias("__bp"), F.col("__g").alias("__bg"), (F.sum("__n").over(Window.partitionBy("__p").orderBy("__g")) - F.col("__n")).alias("__before"))
    local = d.withColumn("__i", F.row_number().over(Window.partitionBy("__p", "__g").orderBy(*key)) - 1)
    return local.join(before, (F.col("__p") == F.col("__bp")) & (F.col("__g") == F.col("__bg"))).select(
        *df.columns, (F.col("__before") + F.col("__i")).cast("long").alias(name)
    )


def interleave(docs: DataFrame, shards: int, *, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Narrow rows (id, size, text_crc32, shard, slot): where each row of `docs` goes."""
    if shards < 1:
        raise ValueError("shards must be positive")
    source = F.col(quoted(source_col)).cast("string")
    narrow = docs.select(
        F.col(quoted(id_col)).alias("id"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("s"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), "s")))
    narrow = table(narrow, "shard-keys")
    per = narrow.groupBy("s").agg(F.count(F.lit(1)).alias("of"))
    total = narrow.count()
    grain = max(1, -(-total // min(max(RANGE_ROWS[0], total // 10_000), RANGE_ROWS[1])))  # ranges that the largest source, or all rows, are cut into
    # the top 24 bits of the seeded key give the range
    rng = F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * grain / (1 << 24)).cast("long")
    key = [F.col(c) for c in ("h", "id", "text_crc32", "size")]
    ranked = ranged_rank(narrow, F.col("s"), key, rng, "rank")
    ranked = ranked.join(per, "s").withColumn("f", (F.col("rank") + F.lit(0.5)) / F.col("of"))
    place = ranged_rank(ranked, F.lit(0), [F.col(c) for c in ("f", "s", "rank")], F.floor(F.col("f") * grain).cast("long"), "place")
    # shard k holds the places from ceil(k * total / shards)
    shard = F.expr(f"(place * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return place.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("place") - first).cast("long")).select("id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, *, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> None:
    """The shards as folders shard=K of Parquet files, each in slot order. Ids must be unique here, as rows find their place by id."""
    docs = docs.drop("shard", "slot")
    (i,) = unused(docs, "__id")
    at = interleave(docs, shards, seed=seed, id_col=id_col, source_col=source_col).select(F.col("id").alias(i), "shard", "slot")
    rows = docs.join(at, F.col(quoted(id_col)) == F.col(i)).select(*same(docs), "shard", "slot")
    rows.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return interleave(docs, 24, seed=17).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op10_sharding": op10_sharding}
#: CRC-32 by bytes: the table follows from its polynomial.
_CRC = """t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, text, source, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)) AS b FROM documents),
c AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s, (coalesce(strlen(text), 0) + 8)::BIGINT AS size,
xor(list_reduce(b, lambda x, y: xor(x // 256, tab[xor(x % 256, y) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, t)"""
ORACLE = {
    "op10_sharding": f"""WITH {_CRC},
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || s), doc_id, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY s) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, s, rank) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 24 // total)::INTEGER AS shard, (place - ((place * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p"""
}
