"""Exact deduplication by a stream with disk-backed keyed state.

Documents arrive as rows (key, id, locator). A streaming aggregation keeps one state entry per key in RocksDB, without
expiry: the number of rows seen, and the stable identifier and content locator of the row that stays. The state lives in the
stream's checkpoint in the shared folder, so a later run on the same folder goes on where the last one stopped, and a lost
executor's part is restored from there. No text is kept in the state.

The key is the digest. On a hit, of rows of this run with each other or with an entry of an earlier run, the full bytes are
compared before anything enters the state: the texts of this run, and the text that the entry's locator leads to, read again
from its file. Texts that share a digest but not their bytes get keys of their own, digest and bytes, in this and in every
later run; so all rows under a key have the same bytes, and any of them may stand for the others.

Only texts with a hit move: their digests are sent to all tasks where they are counted to be at most SENT; beyond that, each
task sends one text per digest at most twice (the least and the greatest), so a group of copies of any size is combined first.

Null text counts as empty; texts of any length are compared whole. Of equal texts the row with the largest id stays; among rows
with that same id too, equal rows among them, the one with the largest locator. A null id is smaller than any other. Empty input
gives an empty result. Rows that don't come straight from files are written first, so that each has a locator; those a
lasting state refers to stay beside it. Other columns pass, null or not, under any name; columns named as a result (keep_id,
group_size, kept, text_sha256) are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_exit, file_system, fresh_path, has_rows, noted, packed, quoted, same, scans_files, small, table, text_of, unused

#: Digests with a hit that are sent to every task, at most; 64 characters each.
SENT = 500_000
#: Disk-backed state. Space isn't allocated ahead: with many stores of little state each, that would be most of the disk used.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class KeyedState:
    """Key -> rows seen and who stays, kept by a stream in `folder`. `take` may be called again with new arrivals.

    The number of state partitions is that of the first run: `partitions`, or the session's shuffle partitions.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, partitions: int | None = None):
        self.spark, self.folder, self.own = spark, folder or fresh_path(spark, "dedup-state"), folder is None
        self.arrived = f"{self.folder}-arrivals"
        self.conf = STATE_CONF | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
        if self.own:
            noted(self.arrived)

    def started(self) -> bool:
        fs, p = file_system(self.spark, f"{self.folder}/commits")
        return fs.exists(p)

    def content(self, rows: DataFrame) -> DataFrame:
        """The rows, written where their locators stay good as long as the state does."""
        if self.own:
            return table(rows, "located")
        path = f"{self.folder}-content/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def take(self, log: DataFrame) -> None:
        """Append the arrivals to the stream's input and run it over what it hasn't taken in yet; returns when that is in the state."""
        log.write.mode("append").parquet(self.arrived)
        old = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)
        try:
            stream = self.spark.readStream.schema(log.schema).parquet(self.arrived)
            seen = stream.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("stays"))
            (
                seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", self.folder)
                .trigger(availableNow=True).start().awaitTermination()
            )
            if self.own:  # a state without a folder of its user's lasts as long as the application
                at_exit(self.spark, self.folder)
                at_exit(self.spark, self.arrived)
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def entries(self) -> DataFrame:
        """(key, n, stays) as the state holds them now."""
        s = self.spark.read.format("statestore").load(self.folder)
        v = [f.name for f in s.schema["value"].dataType.fields]
        return s.select(F.col("key.key").alias("key"), F.col(f"value.`{v[0]}`").alias("n"), F.col(f"value.`{v[1]}`").alias("stays"))


def place() -> tuple[Column, Column]:
    """File and row of a scan's row."""
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


def texts_at(spark: SparkSession, places: DataFrame, text_col: str) -> DataFrame:
    """(digest, t) for places (digest, file, row), read again from the files named. The driver learns the files, not the rows."""
    files = [r["file"] for r in places.select("file").distinct().collect()]
    if not files:
        return places.select("digest", F.lit(None).cast("string").alias("t")).limit(0)
    file, row = place()
    rows = spark.read.schema(f"{quoted(text_col)} string").parquet(*files).select(text_of(text_col).alias("t"), file.alias("f"), row.alias("r"))
    p = small(places, SENT)
    return rows.join(p, (F.col("f") == F.col("file")) & (F.col("r") == F.col("row"))).select("digest", "t")


def collisions(texts: DataFrame, log: DataFrame, state: KeyedState, text_col: str) -> DataFrame:
    """(digest, ref): digests whose texts aren't all the same bytes, here or with the state's entry, and the text that keeps the plain key.

    `texts` has digest and t for every row, `log` digest alone.
    """
    spark = texts.sparkSession
    hits = log.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest")
    earlier = None
    if state.started():
        known = state.entries().select(F.col("key").alias("digest"), F.col("stays.file").alias("file"), F.col("stays.row").alias("row"))
        known = table(known.join(log.select("digest").distinct(), "digest", "left_semi"), "earlier-hits")
        earlier = texts_at(spark, known, text_col)
        hits = hits.unionByName(known.select("digest")).distinct()
    hits = table(packed(hits, log), "hits")
    few = hits.limit(SENT + 1).count() <= SENT
    if few:  # only texts with a hit leave their task
        texts = texts.join(hits.hint("broadcast"), "digest", "left_semi")
    old = lambda v: F.lit(v).alias("old")
    both = texts.select("digest", "t", old(False))
    if earlier is not None:
        both = both.unionByName(earlier.select("digest", "t", old(True)))
    ends = both.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max(F.when(F.col("old"), F.col("t"))).alias("ref"))
    bad = ends.filter(F.col("a") != F.col("b")).select("digest", F.coalesce("ref", "a").alias("ref"))
    return bad if few else bad.join(hits, "digest", "left_semi")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", state: KeyedState | None = None, digest: Callable[[Column], Column] = sha256, text_col: str = "text"
) -> DataFrame:
    """All rows and columns of `docs` with keep_id, group_size, kept and text_sha256.

    A given `state` also counts what it took in before this call.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    spark, out = docs.sparkSession, same(docs)
    state = state or KeyedState(spark)
    if not scans_files(docs):
        docs = state.content(docs)
    text, dig = text_of(text_col), digest(text_of(text_col)).cast("string")
    file, row = place()
    at = F.struct(F.col(quoted(id_col)).alias("id"), file.alias("file"), row.alias("row"))
    log = table(docs.select(dig.alias("digest"), at.alias("at")), "dedup-log")
    bad = table(collisions(docs.select(dig.alias("digest"), text.alias("t")), log, state, text_col), "collisions")
    d, a, k, n, stays, of, ref = unused(docs, *"__digest __at __key __n __stays __of __ref".split())
    rows = docs.select(*out, sha256(text).alias("text_sha256"), dig.alias(d), at.alias(a))
    if has_rows(bad):  # never yet with SHA-256: a text that isn't the one meant by the plain key is keyed by its bytes too
        rows = rows.join(bad.select(F.col("digest").alias(of), F.col("ref").alias(ref)), F.col(d) == F.col(of), "left")
        rows = rows.withColumn(k, F.when(F.col(of).isNotNull() & (text != F.col(ref)), F.concat(F.col(d), F.lit("\0"), text)).otherwise(F.col(d)))
        state.take(rows.select(F.col(k).alias("key"), F.col(a).alias("at")))
    else:
        rows = rows.withColumn(k, F.col(d))
        state.take(log.withColumnRenamed("digest", "key"))
    entries = table(packed(state.entries(), log), "state-entries").select(F.col("key").alias(of), F.col("n").alias(n), F.col("stays").alias(stays))
    result = [F.col(f"{stays}.id").alias("keep_id"), F.col(n).alias("group_size"), F.expr(f"{stays} <=> {a}").alias("kept"), F.col("text_sha256")]
    return rows.drop(of, ref).join(entries, F.col(k) == F.col(of)).select(*out, *result)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {
    "op6_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
