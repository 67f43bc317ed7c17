import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, nothing

from plumbline.llm import language_id as L

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    return L.fit(docs, F.when(~L.held_out(), F.col("lang")))


def test_held_out_accuracy(spark):
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in L.op4_language_id(spark, D).collect() if r["held_out"]]
    assert len(got) > 100 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").filter("n_chars between 3000 and 5000").collect()}
    de, fr = docs["de"][:2400], docs["fr"][:1600]
    names, score, p = model.infer([de + " " + fr, de, "", "12 34 !?", None or ""])
    mix = dict(zip(model.languages, p[0]))
    assert names[0] == "de" and 0.5 < mix["de"] < 0.7 and 0.3 < mix["fr"] < 0.5 and mix["en"] < 0.02
    assert names[1] == "de" and names[2:] == ["und"] * 3 and list(score[2:]) == [0, 0, 0]


def test_likelihood_never_falls(model):
    h, n = L.histograms(["der die das und the of and to le la les", "ein"])
    import numpy as np

    k = len(model.languages)
    pi, last = np.full((2, k), 1 / k), -np.inf
    for steps in (1, 2, 5, 20):
        L.ITERATIONS, old = steps, L.ITERATIONS
        _, ll = model.em(h, h.sum(1), np.ones((2, k), np.float32))
        L.ITERATIONS = old
        assert ll.sum() >= last - 1e-2
        last = ll.sum()


def test_messy(spark, model):
    got = L.identify(messy(spark), model)
    assert got.columns == [*messy(spark).columns, "lang_pred", "lang_score", "lang_mixture"]
    rows = got.select("text", "lang_pred").collect()
    assert len(rows) == messy(spark).count() and all(r[1] == "und" for r in rows if not any(c.isalpha() for c in r[0] or ""))


def test_nothing_learned(spark):
    m = L.fit(nothing(spark), F.col("lang"))
    assert m.infer(["abc"])[0] == ["und"] and L.identify(nothing(spark), m).count() == 0


def test_counts_cover_all_text(spark):
    df = spark.createDataFrame([("en", "abc"), ("en", "abc abd"), ("de", "abc"), (None, "zzz"), ("en", None)], "lang string, text string").repartition(3)
    assert {r["label"]: r["n"] for r in L.count(df, F.col("lang")).groupBy("label").agg(F.sum("n").alias("n")).collect()} == {"en": 9, "de": 3}


def plain_histogram(text):
    """Buckets by a loop over characters."""
    import numpy as np

    m, out = 0xFFFFFFFF, np.zeros(L.BUCKETS)
    codes = [ord(c) if c.isalpha() else 0 for c in f"\n{text.lower()}\n"]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & m
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & m
            out[h >> (32 - L.BITS)] += 1
    return out


def plain_infer(model, text):
    """Expectation-maximisation and the choice of languages for one text, by loops over languages, in double precision."""
    import numpy as np

    h, k = plain_histogram(text), len(model.languages)
    p, n = model.p.astype(float), h.sum()
    if not n:
        return "und", 0.0

    def em(allowed):
        pi = np.array([i in allowed for i in range(k)], float) / len(allowed)
        for _ in range(L.ITERATIONS):
            mix = np.maximum(pi @ p, 1e-30)
            pi = np.array([pi[i] * (h / mix * p[i]).sum() / n for i in range(k)])
        return pi, (h * np.log(np.maximum(pi @ p, 1e-30))).sum()

    single = [(h * np.log(p[i])).sum() for i in range(k)]
    first = int(np.argmax(single))
    best, ll = np.eye(k)[first], single[first]
    order = np.argsort(-em(range(k))[0])
    for size in range(2, k + 1):
        pi, got = em(set(order[:size].tolist()))
        if got - ll <= L.PENALTY * 0.5 * np.log(max(n, 2)) + L.LEAST_GAIN * n:
            break
        best, ll = pi, got
    return model.languages[int(best.argmax())], float(best.max())


def test_against_one_text_at_a_time(spark, model):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("doc_id % 13 = 1").select("doc_id", "text")
    mixed = [r["text"] for r in docs.limit(12).collect()]
    more = spark.createDataFrame([(10_000 + i, a + " " + b) for i, (a, b) in enumerate(zip(mixed, mixed[1:]))] + [(20_000, "Ab"), (20_001, None), (20_002, "1 2")], docs.schema)
    got = L.identify(docs.unionByName(more).repartition(5), model).collect()
    for r in got:
        lang, score = plain_infer(model, r["text"] or "")
        assert (r["lang_pred"], r["lang_score"]) == (lang, pytest.approx(score, abs=2e-3)), r["doc_id"]


def test_any_number_of_labels(spark):
    rows = [(f"l{i}", chr(0x4E00 + i) * 5 + "abc") for i in range(1200)]
    m = L.fit(spark.createDataFrame(rows, "lang string, text string"), F.col("lang"))
    assert len(m.languages) == 1200 and m.infer([chr(0x4E00 + 700) * 9])[0] == ["l700"]


def test_names_do_not_clash(spark, model):
    df = spark.createDataFrame([("mine", "der und die", 1)], "`__r` string, text string, `a.b` int")
    (r,) = L.identify(df, model).collect()
    assert (r["__r"], r["a.b"], r["lang_pred"]) == ("mine", 1, "de")
