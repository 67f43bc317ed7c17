import hashlib
import sys
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, messy_rows, nothing

from plumbline.llm import exact_dedup as E
from plumbline.llm.common import scans_files


def want(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1] or ""].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in by[r[1] or ""] if i is not None]
        out.append((r[0], max(ids, default=None), len(by[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, digest):
    rows = messy_rows()
    got = E.deduplicate(messy(spark), digest=digest)
    assert got.columns == [*[c for c in messy(spark).columns if c != "kept"], "keep_id", "group_size", "kept", "text_sha256"]
    got = got.select("doc_id", "text", "keep_id", "group_size", "text_sha256", "kept").collect()
    assert sorted([(r[0], r[2], r[3], r[4]) for r in got], key=str) == want(rows)
    assert sum(r["kept"] for r in got) == len({r[1] or "" for r in rows})  # one row of each text, repeated rows too
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_brute_force(spark):
    check(spark, E.sha256)


def test_colliding_digest_is_told_apart_by_bytes(spark):
    check(spark, lambda t: (F.crc32(t) % 3).cast("string"))


def test_state_goes_on(spark):
    state = E.KeyedState(spark)
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "x"), (4, "z")], "doc_id long, text string")
    E.deduplicate(a, state=state).collect()
    got = {r["doc_id"]: r for r in E.deduplicate(b, state=state).collect()}
    assert got[5]["group_size"] == 2 and got[5]["kept"] and got[4]["group_size"] == 1
    assert state.entries().count() == 3


def test_state_compares_bytes_across_runs(spark, tmp_path):
    """Texts that collide with one of an earlier run are told apart from it, whichever of them has the larger id, run after run."""
    digest = lambda t: F.concat(F.lit("same"), F.substring(t, 1, 0))
    state = lambda: E.KeyedState(spark, str(tmp_path / "state"), partitions=3)
    runs = [[(9, "alpha"), (1, "alpha")], [(3, "beta"), (2, "alpha")], [(20, "beta"), (21, "alpha"), (22, "gamma")], [(5, "gamma"), (4, None), (6, "")]]
    seen = {}
    for rows in runs:
        got = E.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), state=state(), digest=digest).collect()
        for i, t in rows:
            seen.setdefault(t or "", []).append(i)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == {i: (max(seen[t or ""]), len(seen[t or ""]), i == max(seen[t or ""])) for i, t in rows}


def test_only_hits_move(spark, tmp_path):
    """The texts without a copy stay where they are."""
    rows = [(i, f"{i} " * 50) for i in range(300)] + [(900, "7 " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    log = docs.select(E.sha256(F.col("text")).alias("digest"))
    plan = E.collisions(docs.select(E.sha256(F.col("text")).alias("digest"), F.col("text").alias("t")), log, E.KeyedState(spark), "text")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan or "broadcast" in plan.lower()
    got = E.deduplicate(docs).collect()
    assert sum(not r["kept"] for r in got) == 1 and {r["keep_id"] for r in got if r["group_size"] == 2} == {900}


def test_many_hits_without_sending_them(spark, monkeypatch):
    monkeypatch.setattr(E, "SENT", 0)
    check(spark, E.sha256)
    check(spark, lambda t: (F.crc32(t) % 3).cast("string"))


def test_scans_files(spark, tmp_path):
    df = messy(spark)
    df.write.parquet(str(tmp_path / "m"))
    f = spark.read.parquet(str(tmp_path / "m"))
    assert scans_files(f) and scans_files(f.filter("doc_id > 1").select("doc_id", "text"))
    assert not scans_files(df) and not scans_files(f.join(f.select("doc_id"), "doc_id")) and not scans_files(f.union(f)) and not scans_files(f.distinct())


def test_private_names_do_not_clash(spark):
    names = "__digest __at __key __n __stays __of __ref file row".split()
    df = spark.createDataFrame([(1, "x", *names), (2, "x", *names)], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    got = E.deduplicate(df).collect()
    assert all([r[n] for n in names] == names and r["group_size"] == 2 and r["keep_id"] == 2 for r in got)


def test_empty(spark):
    assert E.deduplicate(nothing(spark)).count() == 0


def test_query_on_file(spark):
    d = "/root/testdata/sf0.001"
    got = E.op6_exact_dedup(spark, d).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=str) == want(rows)
