import math
import random
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, messy_rows, nothing, words

from plumbline.llm import fertility as Q


def base(text):
    """The row contract, word for word."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    in_repeat = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(w) < 3000 else set()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(in_repeat)


def test_base_counts(spark):
    r = random.Random(2)
    extra = ["a b c a b c", "a a a a", "x\ny\nx\n\n\nx \nx", "# $ %% | <b> & *", "a\x0bb\x0cc\rd", "line\n" * 40, " ".join(["one two three four"] * 30), "   x y"]
    rows = [*messy_rows(), *[(100 + i, t, *messy_rows()[0][2:]) for i, t in enumerate(extra)]]
    from helpers import MESSY

    got = Q.judge(spark.createDataFrame(rows, MESSY)).collect()
    key = lambda x: tuple(map(str, x))
    want = sorted([(x[0], *base(x[1])) for x in rows], key=key)
    assert sorted([(x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in got], key=key) == want
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["base_failed"] and x["kept"]) and x["kept"] is not None
    assert r


def test_query_and_quality(spark):
    d = "/root/testdata/sf0.1"
    got = {x["doc_id"]: x for x in Q.op5_fertility(spark, d).collect()}
    q = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = [got[i] for i, v in q.items() if v == 1 and not got[i]["base_failed"]]
    junk = [got[i] for i, v in q.items() if v == 0 and not got[i]["base_failed"]]
    assert sum(x["kept"] for x in clean) >= 0.998 * len(clean) and sum(not x["kept"] for x in junk) > 0.6 * len(junk)


def test_noise_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    r = random.Random(1)
    bad = ["".join(chr(r.randint(0xE000, 0xE800)) + " " * (r.random() < 0.2) for _ in range(900)), " ".join("%08x" % r.getrandbits(32) for _ in range(300))]
    more = spark.createDataFrame([(10_000 + i, t, "en") for i, t in enumerate(bad)], docs.schema)
    got = {x["doc_id"]: x for x in Q.judge(docs.unionByName(more)).filter("doc_id >= 10000").collect()}
    assert not got[10_000]["kept"] and got[10_000]["byte_share"] > 0.5 and not got[10_001]["kept"]


def test_thin_groups_are_judged(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    got = {x["doc_id"]: x for x in Q.judge(docs).collect()}
    size = {}
    group = lambda x: (x["lang"], int(2 * math.log2(x["n_tokens"])))
    for x in got.values():
        if not x["base_failed"] and x["n_tokens"] >= 100:
            size[group(x)] = size.get(group(x), 0) + 1
    q = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    thin = [(got[i]["kept"], v) for i, v in q.items() if not got[i]["base_failed"] and got[i]["n_tokens"] >= 100 and size[group(got[i])] < 30]
    junk, clean = [k for k, v in thin if v == 0], [k for k, v in thin if v == 1]
    assert len(junk) >= 5 and len(clean) > 100
    assert sum(junk) <= 0.2 * len(junk) and sum(clean) >= 0.99 * len(clean)


def test_noise_is_rejected_at_every_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("doc_id < 300")
    r = random.Random(1)
    noise = "".join(chr(r.randint(0xE000, 0xE800)) + " " * (r.random() < 0.2) for _ in range(900))
    rare = " ".join(r.choice("все люди рождаются свободными и равными в своем достоинстве правах они наделены разумом совестью должны поступать отношении друг друга духе братства".split()) for _ in range(120))
    more = spark.createDataFrame([(10_000, noise, "xx"), (10_001, noise, None), (10_002, rare, "ru")], docs.schema)
    for some in (docs.limit(0), docs.limit(5), docs):
        got = {x["doc_id"]: x for x in Q.judge(some.unionByName(more)).filter("doc_id >= 10000").collect()}
        assert not got[10_000]["kept"] and not got[10_001]["kept"] and got[10_002]["kept"]


def test_measures_match_the_library(spark):
    from plumbline.llm.tokens import ByteBpe, PieceBpe

    bpe, multi, r = PieceBpe(), ByteBpe(), random.Random(4)
    t = words(r, 300)
    row = Q.measure([t], bpe, multi)[0]
    assert row[5] == len(bpe.t.encode(t)) and Q.measure([""], bpe, multi)[0][5:10] == (0, 0.0, 0.0, 0.0, 0.0)
    assert row[7] == row[1] / len(multi.t.encode_ordinary(" " + t)) and multi.count_words([["naïve", "漢字"], []]) == [len(multi.t.encode_ordinary(" naïve")) + len(multi.t.encode_ordinary(" 漢字")), 0]
    assert Q.script_of("привет мир") == "cyrillic" and Q.script_of("hello") == "latin" and Q.script_of("漢字 ab") == "han"


def plain_verdicts(rows, min_tokens=100, min_group=30):
    """outside of every row, by loops over rows (lang, text, measures as a dict)."""
    bad = lambda m: m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    groups = lambda lang, m: [(0, lang or "script:" + m["script"], math.floor(2 * math.log2(max(1, m["n_tokens"])))), (1, lang or "script:" + m["script"]), (2, m["script"]), (3,)]
    value = lambda m, f, level: m[f] + Q.DRIFT[0] * max(1, m["n_tokens"]) ** Q.DRIFT[1] if f == "entropy" and level else m[f]
    half_up = lambda x: math.floor(x + 0.5)
    median = lambda v: sorted(v)[(len(v) - 1) // 2]
    cells = {}
    for (lang, _), m in {(lang, t): m for lang, t, m in rows}.items():  # one of each text
        if not bad(m) and m["n_tokens"] >= min_tokens:
            for level, g in enumerate(groups(lang, m)):
                for f in Q.FIGURES:
                    cells.setdefault((g, f), []).append(half_up(value(m, f, level) * Q.GRID[f]))
    band = {}
    for (g, f), v in cells.items():
        if len(v) >= min_group:
            mid = median(v)
            dev = median([abs(x - mid) for x in v])
            lo, hi = (max(dev / Q.GRID[f] * Q.WIDTH[f][side], Q.FLOORS[g[0]][f][side]) for side in (0, 1))
            band[g, f] = mid / Q.GRID[f] - lo, mid / Q.GRID[f] + hi
    out = []
    for lang, _, m in rows:
        gs = [(level, g) for level, g in enumerate(groups(lang, m)) if (g, "entropy") in band]
        level, g = gs[0] if gs else (0, None)
        limits = {f: band[g, f] if gs else Q.LIMITS[f] for f in Q.FIGURES}
        outside = [f for f in Q.FIGURES if not limits[f][0] <= value(m, f, level if gs else 0) <= limits[f][1]] if m["n_tokens"] >= min_tokens else []
        out.append((outside, not bad(m) and not outside))
    return out


def test_bands_by_brute_force(spark):
    """Bands and verdicts on the given texts, copies among them and rows without a language, against loops."""
    from plumbline.llm.tokens import byte_bpe, piece_bpe

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = docs.filter("doc_id = 10").withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(700)))).select((F.col("c") + 100_000).alias("doc_id"), "text", "lang")
    docs = docs.unionByName(docs.filter("doc_id % 5 = 1").select((F.col("doc_id") + 200_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))).unionByName(extra)
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    names = [x.split()[0] for x in Q.MEASURES.split(", ")]
    measures = dict(zip({t for _, _, t in rows}, Q.measure([t or "" for t in {t for _, _, t in rows}], piece_bpe(), byte_bpe()), strict=True))
    want = plain_verdicts([(lang, t, dict(zip(names, measures[t], strict=True))) for _, lang, t in rows])
    got = {r["doc_id"]: (list(r["outside"]), r["kept"]) for r in Q.judge(docs.repartition(7)).collect()}
    assert got == {r[0]: w for r, w in zip(rows, want, strict=True)} and 20 < sum(not k for _, k in got.values()) < len(got) / 2


def test_copies_do_not_set_the_norm(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    junk = " ".join("%08x" % random.Random(3).getrandbits(32) for _ in range(300))
    many = spark.range(3000).select((F.col("id") + 50_000).alias("doc_id"), F.lit(junk).alias("text"), F.lit("en").alias("lang"))
    alone = {x["doc_id"]: x["kept"] for x in Q.judge(docs).collect()}
    got = {x["doc_id"]: x["kept"] for x in Q.judge(docs.unionByName(many)).collect()}
    assert not any(got[i] for i in range(50_000, 53_000)) and sum(got[i] != k for i, k in alone.items()) <= 2


def test_empty(spark):
    assert Q.judge(nothing(spark)).count() == 0 and Q.judge(messy(spark), lang_col=None).count() == messy(spark).count()
    assert F
