import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import language_id as L
from plumbline.llm import mixing as M

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, nothing
from test_language_id import plain_infer
from test_minhash import brute
from test_mixing import brute as budgets
from test_packing import whole

D = "/root/testdata/sf0.001"


def mixed(rows):
    """Ids of the rows in the mixture, by loops."""
    domain, leaf, out = dict(M.DOMAINS), defaultdict(list), set()
    tokens = lambda r: (len((r["text"] or "").encode()) + 3) // 4
    for r in rows:
        leaf[domain.get(r["source"], "other"), r["lang"] or "", r["source"] or ""].append(r)
    supply = {k: sum(map(tokens, v)) for k, v in leaf.items()}
    for k, budget in budgets(supply, sum(supply.values()) * P.TOTAL[0] // P.TOTAL[1], P.WEIGHTS, 1).items():
        whole, rest = divmod(budget, supply[k]) if supply[k] else (0, 0)
        run = 0
        for r in sorted(leaf[k], key=lambda r: (hashlib.md5(f"{P.SEED}|{whole}|{r['doc_id']}".encode()).hexdigest(), tokens(r))):
            run += tokens(r)
            if whole or rest and run <= rest:
                out.add(r["doc_id"])
    return out


def test_stages(spark):
    """Each stage on what the one before kept, against brute force."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = spark.createDataFrame([(900, "12 34 5 !!", "en", "src0", 10), (901, None, "en", "src0", 0), (902, "", None, None, 0)], docs.schema)
    docs, kept = docs.unionByName(extra), {}
    cur = docs
    for name, f in P.STAGES:
        cur = P.table(f(spark, cur, D), f"test-{name}")
        if name != "packing":
            assert cur.columns == docs.columns
            kept[name] = {r["doc_id"]: r for r in cur.collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert set(before) - set(kept["language_id"]) == {900, 901, 902}
    model = L.fit(docs, F.when(~L.held_out(), F.col("lang")))
    plain = {i: plain_infer(model, r["text"] or "") for i, r in before.items()}
    assert set(kept["language_id"]) == {i for i, (lang, share) in plain.items() if lang != "und" and share >= P.LEAST_SHARE}
    by = defaultdict(list)
    for i, r in kept["language_id"].items():
        by[r["text"]].append(i)
    assert set(kept["exact_dedup"]) == {max(v) for v in by.values()}
    assert set(kept["near_dedup"]) == {i for i, _, c in brute([(i, r["text"]) for i, r in kept["exact_dedup"].items()], 5, 80) if i == c}
    assert set(kept["mixing"]) == mixed(kept["near_dedup"].values())
    pieces = defaultdict(list)
    fill = Counter()
    for r in cur.collect():
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        fill[r["sequence_id"]] += r["length"]
    assert set(pieces) == set(kept["mixing"]) and max(fill.values()) <= 2048
    for i, p in pieces.items():
        assert b"".join(b for _, b in sorted(p)) == whole([kept["mixing"][i]["text"]])[0].tobytes()


def test_messy_and_empty(spark):
    for docs in (messy(spark), nothing(spark)):
        for _, f in P.STAGES:
            docs = P.table(f(spark, docs, D), "test-messy")
        docs.collect()


def test_no_labels_reject_nothing_but_the_letterless(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in P.languages(spark, docs, D).collect()] == [1]


def test_files_grow_with_the_data_and_not_with_the_partitions(spark, monkeypatch):
    """Tables between the steps of the dedup stages, at many shuffle partitions with little in each."""
    from plumbline.llm import exact_dedup, minhash
    from plumbline.session import scoped_conf

    files, write = {}, P.table

    def noting(df, name, path=None):
        out = write(df, name, path)
        files[name] = len(out.inputFiles())
        return out

    docs = write(spark.read.parquet(f"{D}/documents.parquet").coalesce(1), "test-docs")
    monkeypatch.setattr(exact_dedup, "table", noting)
    monkeypatch.setattr(minhash, "table", noting)
    with scoped_conf(spark, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        once = write(P.exact(spark, docs, D), "test-once")
        rows = [(r["doc_id"], r["text"]) for r in once.collect()]
        kept = {r["doc_id"] for r in P.near(spark, once.coalesce(1), D).collect()}
    assert kept == {i for i, _, c in brute(rows, 5, 80) if i == c}
    assert {"hits", "state-entries", "classes", "bucket-keys", "bucket-members", "pairs", "links-star", "links"} <= set(files)
    assert max(files.values()) <= 2 * spark.sparkContext.defaultParallelism, files


def test_runs_delete_their_own_tables_only(spark):
    """Two runs at a time in one driver."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda _: sorted(map(tuple, P.run(spark, D).drop("ids", "sequence_id", "offset").collect())), range(2))
    assert a == b and len(a) > 100


def test_query(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"](spark, D).count() > 0 and "pipeline" not in E.oracle_sql()
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in E.queries() if n.startswith("op")}
