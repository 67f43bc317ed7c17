"""Language identification as inference of a mixture.

Each language is a distribution over letter trigrams (hashed to BUCKETS, case folded, anything but letters a blank), counted
over all training texts. A document is taken as drawn from a mixture of languages: expectation-maximisation finds the
proportions that make its trigrams likeliest. Which languages take part is chosen by penalised likelihood: sets grow by the
order of proportions under all languages, and a further language must raise the log-likelihood by more than the penalty,
PENALTY times half the log of the trigram count, plus LEAST_GAIN for each trigram, since neighbours in a text aren't independent
draws. The language of the largest proportion in the chosen set is the prediction, and that proportion its score.

Null texts and those without a letter are `und` with score 0; so is everything if there is nothing to learn from. Texts of
any length are read whole, some twenty bytes of memory to a character at a time. Labels that are null teach nothing. Only the text
enters a prediction. Rows with equal ids or texts each get their own result; an empty table gives an empty one; other columns pass,
null or not, under any name, but columns named as a result (lang_pred, lang_score, lang_mixture) are replaced. Any number of labels
is learned; the model, sent to all tasks, is their number times BUCKETS.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, quoted, same, ship, unused
from .tokens import cuts, slices

#: Trigram buckets, a power of two.
BITS = 12
BUCKETS = 1 << BITS
ITERATIONS = 20
PENALTY = 2.0
LEAST_GAIN = 0.01
#: Pseudo-count of every bucket.
SMOOTH = 0.5
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter; white and other signs are not."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every trigram around a letter, and the number of letters of each document."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in low])
    a = np.frombuffer(("\n" + "\n\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int64), sizes)
    is_letter = letters()[a]
    a = np.where(is_letter, a, 0)
    h = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    mid = is_letter[1:-1]
    return doc[1:-1][mid], (h >> np.uint32(32 - BITS))[mid].astype(np.int64), np.bincount(doc[is_letter], minlength=len(low))


def histograms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if not texts:
        return np.zeros((0, BUCKETS), np.float32), np.zeros(0, int)
    doc, bucket, n = trigrams(texts)
    return np.bincount(doc * BUCKETS + bucket, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS).astype(np.float32), n


def count(docs: DataFrame, label: Column, text_col: str = "text") -> DataFrame:
    """(label, bucket, n) over all rows with a label; sums are made in each task before they are sent."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lo, hi in cuts(map(len, b["text"])):
                part = b.iloc[lo:hi]
                doc, bucket, _ = trigrams(list(part["text"]))
                lab, names = pd.factorize(part["label"])
                got = np.bincount(lab[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, got, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pd.DataFrame({"label": name, "bucket": at, "n": row[at]})

    rows = docs.select(label.cast("string").alias("label"), F.col(quoted(text_col)).alias("text")).filter("label is not null and text is not null")
    return rows.mapInPandas(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts + SMOOTH
        self.p = (c / c.sum(1, keepdims=True)).astype(np.float32)
        self.logp = np.log(self.p)

    def em(self, h: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of each document among its allowed languages, and the log-likelihood."""
        pi = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ITERATIONS):
            pi = pi * ((h / np.maximum(pi @ self.p, 1e-30)) @ self.p.T) / n[:, None]
        return pi, (h * np.log(np.maximum(pi @ self.p, 1e-30))).sum(1)

    def infer(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Prediction, score and the proportions (0 outside the chosen set) for each text."""
        k = len(self.languages)
        h, letters_in = histograms(texts)
        out = np.zeros((len(texts), k), np.float32)
        live = np.flatnonzero(letters_in > 0) if k else np.array([], int)
        if len(live):
            h = h[live]
            n = h.sum(1)
            single = h @ self.logp.T
            chosen = np.zeros((len(live), k), np.float32)
            chosen[np.arange(len(live)), single.argmax(1)] = 1
            best, ll = chosen.copy(), single.max(1)
            if k > 1:
                pi, _ = self.em(h, n, np.ones((len(live), k), np.float32))
                order = np.argsort(-pi, 1)
                cost = PENALTY * 0.5 * np.log(np.maximum(n, 2)) + LEAST_GAIN * n
                grow = np.arange(len(live))
                for size in range(2, k + 1):  # a set that didn't pay doesn't grow further
                    allowed = np.zeros((len(grow), k), np.float32)
                    np.put_along_axis(allowed, order[grow, :size], 1, 1)
                    got, gll = self.em(h[grow], n[grow], allowed)
                    pays = gll - ll[grow] > cost[grow]
                    grow, got, gll = grow[pays], got[pays], gll[pays]
                    best[grow], ll[grow] = got, gll
                    if not len(grow):
                        break
            out[live] = best
        top = out.argmax(1) if k else np.zeros(len(texts), int)
        score = out.max(1) if k else np.zeros(len(texts))
        names = [self.languages[t] if s > 0 else UNKNOWN for t, s in zip(top, score, strict=True)]
        return names, np.clip(score.astype(float), 0, 1), out


def fit(docs: DataFrame, label: Column, text_col: str = "text") -> Model:
    rows = count(docs, label, text_col).toPandas()  # at most languages times BUCKETS
    at, names = pd.factorize(rows["label"], sort=True)
    names = [str(x) for x in names]
    counts = np.zeros((len(names), BUCKETS))
    counts[at, rows["bucket"].to_numpy(int)] = rows["n"]
    return Model(names, counts)


RESULT = "struct<lang_pred:string,lang_score:double,lang_mixture:map<string,double>>"


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns with lang_pred, lang_score and lang_mixture (proportions of the chosen languages)."""
    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_mixture")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            names, scores, mixes = [], [], []
            for part in slices(["" if t is None else t for t in b]):
                x, s, p = m.infer(part)
                names += x
                scores += list(s)
                mixes += [{m.languages[j]: float(q[j]) for j in np.flatnonzero(q)} for q in p]
            yield pd.DataFrame({"lang_pred": names, "lang_score": scores, "lang_mixture": mixes})

    (r,) = unused(docs, "__r")
    return docs.withColumn(r, run(F.col(quoted(text_col)))).select(*same(docs), f"{r}.lang_pred", f"{r}.lang_score", f"{r}.lang_mixture")


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 4) == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, F.when(~held_out(), F.col("lang")))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_mixture").alias("mixture")
    )


QUERIES = {"op4_language_id": op4_language_id}
