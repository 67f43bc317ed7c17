import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, messy_rows, nothing, words

from plumbline.llm import components as C
from plumbline.llm import minhash as M


CONTRACT = M.Rule(3, 85)


def shingles(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=3, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= percent * (len(a) + len(b) - k):
                    pairs.append((i, j))
    r = C.roots(iter(pairs))
    comp = {}
    for i in range(len(rows)):
        comp.setdefault(r.get(i, i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in comp.items()}
    return sorted([(rows[i][0], len(sets[i]), least[r.get(i, i)]) for i in range(len(rows))], key=str)


def family(r, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = words(r, 1)
        out.append(" ".join(w))
    return out


def got_of(df, rule=CONTRACT):
    return sorted([(r["id"], r["n"], r["component_id"]) for r in M.cluster(df, rule=rule).collect()], key=str)


def test_families_chains_and_hubs(spark):
    r = random.Random(3)
    texts = [words(r, r.randint(1, 60)) for _ in range(150)]
    for _ in range(12):
        texts += family(r, words(r, r.randint(20, 150)), r.randint(2, 12), 3)
    texts += family(r, words(r, 150), 220, 7)  # one large family, most of it not linked to each other: blocks
    passage = words(r, 60)
    texts += [f"{words(r, 25)} {passage} {words(r, 20)}" for _ in range(120)]  # share most of their text, but don't link
    chain = words(r, 150).split()
    for i in range(10):  # each links with the next only
        chain = chain[:]
        chain[i * 12 + 5] = f"new{i}"
        texts.append(" ".join(chain))
    texts += [texts[0]] * 40 + ["", "   ", "One", "one", "a b", "A  B"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_of(df) == brute(rows)


def test_messy(spark):
    assert got_of(messy(spark)) == brute([(r[0], r[1]) for r in messy_rows()])


def test_one_row_of_each_component_stays(spark):
    rows = messy_rows()
    got = M.deduplicate(messy(spark), rule=CONTRACT)
    assert got.columns == messy(spark).columns
    full = [i for i, r in enumerate(rows) if shingles(r[1])]
    sets = {i: shingles(rows[i][1]) for i in full}
    roots = C.roots((i, j) for i in full for j in full if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    groups = {}
    for i in full:
        groups.setdefault(roots.get(i, i), []).append(rows[i][0])
    want = [min(g, key=lambda x: (x is None, x)) for g in groups.values()] + [r[0] for r in rows if not shingles(r[1])]
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)


def test_null_ids_bridge_and_stay(spark):
    r = random.Random(8)
    base = words(r, 200).split()
    chain = [base]
    for i in range(2):
        chain.append([f"new{i}" if i * 40 <= j < i * 40 + 4 else w for j, w in enumerate(chain[-1])])
    rows = [(5, " ".join(chain[0])), (None, " ".join(chain[1])), (3, " ".join(chain[2])), (None, "a text of no number that is like no other one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_of(df) == brute(rows)
    assert sorted((x["doc_id"] or 0) for x in M.deduplicate(df, rule=CONTRACT).collect()) == [0, 3]


def test_default_rule(spark):
    """Five words and four fifths."""
    assert (M.Rule().size, M.Rule().percent) == (5, 80)
    r = random.Random(9)
    rows = list(enumerate([t for _ in range(25) for t in family(r, words(r, r.randint(30, 120)), 8, 3)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got_of(df, M.Rule()) == brute(rows, 5, 80)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_miss_next_to_nothing(percent):
    rule = M.Rule(3, percent)
    assert rule.rows * rule.bands <= M.MINIMA and (1 - (percent / 100) ** rule.rows) ** rule.bands <= M.MISSED


def test_parts_and_salts_change_nothing(spark, monkeypatch):
    r = random.Random(6)
    rows = list(enumerate(family(r, words(r, 120), 120, 4) + family(r, words(r, 90), 60, 9)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("CHUNK", 7), ("SPREAD", 3), ("SENT", 0), ("LARGE", 8), ("BLOCK", 16)):
        monkeypatch.setattr(M, name, value)
    assert got_of(df) == want


def test_empty(spark):
    assert M.cluster(nothing(spark)).count() == 0


def test_estimate(spark):
    """The collision-corrected estimate is unbiased enough and the floor is below every linked pair."""
    r, xor_mul = np.random.default_rng(1), M.functions_of(M.MINIMA)
    for j in (0.3, 0.85, 0.95):
        est = []
        for _ in range(60):
            n, k = 400, round(800 * j / (1 + j))
            both = r.integers(0, 2**63, k, np.uint64)
            a, b = (M.minima(np.concatenate([both, r.integers(0, 2**63, n - k, np.uint64)]) * np.uint64(2), *xor_mul) for _ in "ab")
            p = M.signatures(np.array([a, b]), CONTRACT)[1]
            row = spark.range(1).select(M.similarity(F.array(*map(F.lit, p[0].tolist())), F.array(*map(F.lit, p[1].tolist()))).alias("s"), M.matches(F.array(*map(F.lit, p[0].tolist())), F.array(*map(F.lit, p[1].tolist()))).alias("m")) if len(est) < 3 else None
            low = ((a[:128] & 15) == (b[:128] & 15)).sum()
            if row is not None:
                s, m = row.collect()[0]
                assert m == low and s == pytest.approx((low / 128 - 1 / 16) / (15 / 16))
            est.append((low / 128 - 1 / 16) / (15 / 16))
            assert j < 0.85 or est[-1] >= CONTRACT.least
        assert np.mean(est) == pytest.approx(j, abs=0.03)


@pytest.mark.parametrize("most,chain", [(20, 30), (1000, 30), (12, 60)])
def test_components(spark, most, chain):
    r = random.Random(1)
    pairs = [(r.randrange(120), r.randrange(120)) for _ in range(90)] * (chain < 60) + [(i, i + 1) for i in range(200, 200 + chain)]
    r.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    got = {x["v"]: x["component"] for x in C.components(df, most).collect()}
    assert got == C.roots(iter(pairs))


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = M.op3_minhash(spark, d).collect()
    assert sorted([(r[0], r[1], r[2]) for r in got], key=str) == brute(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
