"""Toxicity after noisy-channel deobfuscation.

Writers hide words by leetspeak (1d10t), by spacing or separators (i d i o t, i.d.i.o.t) and by repetition (idiooot). A token
that shows such signs becomes a lattice: every character may be a letter it stands for, may be itself, or may be deleted, each
at a channel cost. Viterbi finds the likeliest letter string under a character trigram model, whose counts come from all
texts of the corpus, each text by itself. Tokens and spaced runs are decoded whole, at any length and with any gaps, in time
linear in it: the state is two letters, and what all surviving paths agree on is put away as it comes. Spaced runs start with
and hold any letter, digit or sign that stands for a letter; links (`://`) and what has no letter are read as they are.

Texts are scored after restoring. Signs of toxicity are restored words and their beginnings (for inflected forms); the score is
a noisy-or of the signs a text holds, each with the lower bound of the share of toxic texts among those that hold it. Which
beginnings and words are signs is learned on labelled texts: a sign must be in LEAST toxic texts, SURE of those that hold it
must be toxic by that bound, and so many of them must be unlikely by chance at the base rate. As a great many candidates are tried,
the probabilities are held against their ranks (Benjamini and Hochberg), so that a share of ALPHA of the signs at most is expected to be chance. Near copies count as one text there, as they would make chance words of one text look sure.

The counts of the language model cover every document. Signs are learned on at most SAMPLE labelled documents, the first by a
hash of their id; their texts are restored in the tasks, and the driver gets their words. Null and empty texts have no signs and
get the base rate's score. Only the text enters a score; texts of any length are read whole. Several labels of one id count as
toxic if one is. With no labels, or labels of one kind only, every score is that kind's rate (0 without labels). An empty table
gives an empty one. Rows with equal ids or texts each get their score; other columns pass under any name, but `score` is replaced.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, quoted, ship, table
from .tokens import slices

#: Letters of the character model; 0 is the word boundary, and the last code is any other letter.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
OTHER = len(ALPHABET) + 1
SYMBOLS = 64
CODE = {c: i + 1 for i, c in enumerate(ALPHABET)}
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "¡": "i",
}
#: Signs that may stand between the letters of a word.
SEPARATORS = " .-_*·"
#: Channel costs in nats: a sign read as a letter, a sign or separator dropped, a repeated letter dropped, a space kept.
COST_LEET, COST_DROP, COST_REPEAT, COST_SPACE = 0.5, 8.0, 0.7, 1.5
#: Signs after which what all paths agree on is put away.
STRETCH = 4096
#: Longest token whose words are remembered.
SHORT = 64
#: Labelled documents that signs are learned from, at most.
SAMPLE = 12_000
#: Toxic documents a sign must be in, the lower bound of the share of toxic ones among all it is in, and the share of signs that may be chance.
LEAST, SURE, ALPHA = 6, 0.6, 0.02
#: Least values of hashes of 3-word shingles by which near copies are known, and how many two texts must share.
SKETCH, ALIKE = 16, 4
PREFIXES = (4, 5, 6, 7)
MEMO = 300_000

SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+€£¡])(?:[ \t.\-_*·]+(?:[^\W_]|[@$!|+€£¡])){2,}(?![^\W_])")
GAP = re.compile(r"[ \t.\-_*·]+")
WIDE = re.compile(r"[ \t]{2,}")
SIGNS = "@$!|+€£¡"
SIGN_RUN = re.compile(r"([@$!|+€£¡])\1+")
EDGE = "\"'`.,;:?()[]{}<>«»“”‘’…–—#%&*/\\~^=-_"
PLAIN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
RUN = re.compile(r"([^\W\d_])\1\1")
#: Signs after or before plain letters are ornament; where they may stand for letters, both readings count.
TAIL = re.compile(r"^[^\w]*([^\W\d_]+)[^\w]*$")


#: Stands between texts that are counted together; no character.
BETWEEN = "\U0010ffff"


def code_table() -> np.ndarray:
    t = np.fromiter((OTHER if chr(i).isalpha() else 0 for i in range(0x110000)), np.int64, 0x110000)
    for c, i in CODE.items():
        t[ord(c)] = i
    return t


def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): letter trigrams of all texts, runs of anything else counting as one boundary; summed in each task first."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, sums = code_table(), np.zeros(SYMBOLS**3, np.int64)
        table[ord(BETWEEN)] = SYMBOLS - 1
        for b in batches:
            for part in slices(b["text"].tolist()):
                # every text stands between two boundaries of its own, so counts don't hang on what comes next to it
                text = "".join(f"{BETWEEN}\n{t.lower().replace(BETWEEN, ' ')}\n" for t in part) + BETWEEN + "\n"
                a = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
                a = a[np.r_[True, (a[1:] != 0) | (a[:-1] != 0)]]
                a[a == SYMBOLS - 1] = 0
                sums += np.bincount((a[:-2] * SYMBOLS + a[1:-1]) * SYMBOLS + a[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"code": at, "n": sums[at]})

    return docs.select(F.col(quoted(text_col)).alias("text")).filter("text is not null").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """log P(c | a, b), interpolated from trigram, bigram and single counts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 0.1) / (c1 + 0.1).sum()
        p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
        self.logp = np.log(p3).astype(np.float32)

    def start(self) -> None:
        self.rows = self.logp.tolist() if not hasattr(self, "rows") else self.rows

    def __getstate__(self):
        return {"logp": self.logp}

    def decode(self, token: str) -> str:
        """The likeliest reading of a noisy token (lower case); spaces that stay are in it."""
        self.start()
        lp = self.rows
        states: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}  # texts are linked from their ends
        done: list[str] = []
        for at, ch in enumerate(token, 1):
            if at % STRETCH == 0:
                texts = {k: self.joined(out) for k, (_, out, _) in states.items()}
                done.append(os.path.commonprefix(list(texts.values())))
                states = {k: (s, self.linked(texts[k][len(done[-1]) :]), last) for k, (s, _, last) in states.items()}
            options: list[tuple[str, float]] = []
            if ch in CODE:
                options.append((ch, 0.0))
            elif ch.isalpha():
                options.append((ch, 0.0))
            elif ch in LEET:
                options = [(x, COST_LEET) for x in LEET[ch]] + [("", COST_DROP)]
            elif ch == " ":
                options = [("", 0.0), (" ", COST_SPACE)]
            else:
                options = [("", 0.5 if ch in SEPARATORS else COST_DROP)]
            new: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
            for (a, b), (s, out, last) in states.items():
                opts = options + [("", COST_REPEAT)] if ch.isalpha() and ch == last else options
                for x, cost in opts:
                    if x == "":
                        key, score, text = (a, b), s - cost, out
                    else:
                        c = 0 if x == " " else CODE.get(x, OTHER)
                        key, score, text = (b, c), s - cost + lp[a][b][c], (out, x)
                    if key not in new or new[key][0] < score:
                        new[key] = (score, text, ch)
            states = new
        ends = [(s + lp[a][b][0], out) for (a, b), (s, out, _) in states.items()]
        best = max(s for s, _ in ends)
        return "".join(done) + max(self.joined(out) for s, out in ends if s == best)

    @staticmethod
    def linked(text: str) -> tuple | None:
        out = None
        for x in text:
            out = (out, x)
        return out

    @staticmethod
    def joined(out: tuple | None) -> str:
        letters = []
        while out:
            out, x = out
            letters.append(x)
        return "".join(reversed(letters))


class Restorer:
    """Words of a text with its noisy tokens decoded. Decodings are remembered, in a bounded memo."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, {}

    def read(self, token: str) -> list[str]:
        """The words of the likeliest reading."""
        return self.model.decode(token).split()

    def readings(self, token: str) -> list[str]:
        """Words of the token, and of it with repeated signs as one."""
        once = SIGN_RUN.sub(r"\1", token)
        return self.read(token) + (self.read(once) if once != token else [])

    def token_words(self, token: str) -> tuple[str, ...]:
        """The words a white-space token (lower case) is read as."""
        m = TAIL.match(token)
        if m and not RUN.search(token):
            core = m[1]
            tail = token.strip(EDGE)
            if tail != core and len(core) >= 2 and (tail[0] in SIGNS or tail[-1] in SIGNS):
                return tuple(dict.fromkeys([core, *self.readings(tail)]))
            return (core,)
        core = token.strip(EDGE)
        if not any(c.isalpha() for c in core):
            core = token
        plain = PLAIN.findall(core)
        noisy = bool(RUN.search(core)) or any(c in LEET or c in SEPARATORS for c in core)
        if not noisy or not any(c.isalpha() for c in core) or "://" in core:
            return tuple(plain)
        read = self.readings(core)
        if (inner := core.strip(SIGNS)) != core:
            read += self.read(inner)
        parts = GAP.split(core)  # words that a separator joins
        for p in {p for p in parts if len(p) > 2} if len(parts) > 1 else ():
            read += self.readings(p)
        return tuple(dict.fromkeys([*(p for p in plain if len(p) > 2), *read]))

    def spaced_words(self, run: str) -> list[str]:
        """The words of a run of single signs: as one, and cut at its wide gaps if it has narrow ones too."""
        out = []
        for part in {run, *WIDE.split(run)}:
            part = GAP.sub(" ", part)
            for p in {part, part.strip(SIGNS + " ")}:
                if any(c.isalpha() for c in p) and len(p) > 2:
                    out += self.read(p)
        return out

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out: set[str] = set()
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for t in set(low.split()):
            w = memo.get(t)
            if w is None:
                w = self.token_words(t)
                if len(t) <= SHORT:
                    memo[t] = w
            out.update(w)
        for m in SPACED.finditer(low):
            out.update(self.spaced_words(m[0]))
        return out


def features(words: set[str]) -> set[str]:
    out = {"=" + w for w in words if len(w) > 2}
    for k in PREFIXES:
        out.update(w[:k] for w in words if len(w) >= k)
    return out


class Scorer:
    """Noisy-or: a text is toxic unless each sign in it fails to make it so. weights: feature -> -log(1 - its probability)."""

    def __init__(self, model: CharModel, weights: dict[str, float], base: float):
        self.model, self.weights, self.base = model, weights, base

    def start(self) -> None:
        self.restore, self.hits = Restorer(self.model), {}

    def hit(self, w: str) -> tuple[str, ...]:
        return tuple(f for f in features({w}) if f in self.weights)

    def score(self, text: str) -> float:
        found: set[str] = set()
        if len(self.hits) > MEMO:
            self.hits.clear()
        hits = self.hits
        for w in self.restore.words(text):
            h = hits.get(w)
            if h is None:
                h = hits[w] = self.hit(w)
            if h:
                found.update(h)
        return 1 - (1 - self.base) * math.exp(-sum(self.weights[f] for f in sorted(found)))


def wilson(a: int, b: int, z: float = 2.0) -> float:
    """Lower bound of the share a / (a + b)."""
    n = a + b
    p = a / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def by_chance(k: int, n: int, rate: float) -> float:
    """Probability of k or more of n at that rate."""
    lg = math.lgamma
    return sum(math.exp(lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)) for i in range(k, n + 1))


def sketch(text: str) -> list[int]:
    """Least hashes of the text's 3-word shingles, by which near copies are known."""
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split()], np.uint64)
    if not len(h):
        return []
    k = min(3, len(h))
    x = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    out = []
    for i in range(SKETCH):
        y = (x ^ np.uint64(0xBF58476D1CE4E5B9 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x94D049BB133111EB)
        out.append(int((y ^ (y >> np.uint64(31))).min() >> np.uint64(1)))
    return out


def one_of_each(rows: Iterable[tuple[float, list[int], list[str]]]) -> Iterator[tuple[float, list[str]]]:
    """(kind, words) of the rows, without those that are near copies of one before of the same kind."""
    seen: dict[tuple, int] = {}
    for number, (kind, marks, words) in enumerate(rows):
        keys = [(kind, i, x) for i, x in enumerate(marks)]
        met = Counter(seen[k] for k in keys if k in seen)
        if met and max(met.values()) >= ALIKE:
            continue
        for k in keys:
            seen.setdefault(k, number)
        yield kind, words


def learn(model: CharModel, rows: Iterable[tuple[float, list[int], list[str]]]) -> Scorer:
    """The scorer from (1 or 0, sketch, restored words) of labelled texts, read once."""
    vocabulary, docs, kinds = {}, [], []
    for kind, w in one_of_each(rows):  # documents as numbers of their words
        docs.append(np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in w), np.int32))
        kinds.append(kind)
    if len(set(kinds)) < 2:
        return Scorer(model, {}, float(kinds[0]) if kinds else 0.0)
    words = list(vocabulary)
    del vocabulary
    rate = sum(kinds) / len(kinds)
    # signs of every word, as numbers; how many texts each is in
    signs: dict[str, int] = {}
    per = [[signs.setdefault(f, len(signs)) for f in features({w})] for w in words]
    ends = np.cumsum([0, *map(len, per)])
    flat = np.fromiter((i for p in per for i in p), np.int32, ends[-1])
    del per, words
    every, toxic = np.zeros(len(signs), np.int32), np.zeros(len(signs), np.int32)
    in_doc = []
    for d, kind in zip(docs, kinds, strict=True):
        held = np.unique(np.concatenate([flat[ends[i] : ends[i + 1]] for i in d.tolist()])) if len(d) else np.zeros(0, np.int32)
        every[held] += 1
        toxic[held] += int(kind)
        in_doc.append(held)
    names = list(signs)
    bound = {i: wilson(int(toxic[i]), int(every[i] - toxic[i])) for i in np.flatnonzero(toxic >= LEAST).tolist()}
    tried = int((every >= LEAST).sum())
    odds = sorted((by_chance(int(toxic[i]), int(every[i]), rate), names[i], i) for i, b in bound.items() if b >= SURE)
    passed = max((k for k, (p, _, _) in enumerate(odds, 1) if p * tried <= ALPHA * k), default=0)
    good = {i: f for _, f, i in odds[:passed]}
    docs_of: dict[int, list[int]] = {i: [] for i in good}
    for row, held in enumerate(in_doc):
        for i in held[np.isin(held, list(good))].tolist():
            docs_of[i].append(row)
    chosen, places, covered = {}, {}, set()
    for i in sorted(good, key=lambda i: (good[i][0] == "=", -len(good[i]), good[i])):  # longest beginnings first; a shorter one must be right beyond the words that the longer ones of it stand for
        f = good[i]
        longer = [x for x in chosen if x.startswith(f) or f[0] == "=" and f[1:].startswith(x)]
        held = set(docs_of[i])
        alone = held.difference(*(docs_of[places[x]] for x in longer))
        if longer and (alone and (sum(kinds[r] for r in alone) + 0.5) / (len(alone) + 1) < 0.75 or not alone and (f[0] == "=" or len(longer) < 3)):
            continue
        covered |= held
        chosen[f], places[f] = -math.log(1 - bound[i]), i
    rest = [k for i, k in enumerate(kinds) if i not in covered]
    return Scorer(model, chosen, min(0.45, (sum(rest) + 0.5) / (len(rest) + 1)))


def restored(docs: DataFrame, model: CharModel) -> DataFrame:
    """y, a hash of the text, its sketch and its restored words, of rows (text, y)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(sent.value)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.iloc[lo : lo + 256]
                yield pd.DataFrame({"y": part["y"], "h": part["h"], "marks": [sketch(t) for t in part["text"]], "words": [sorted(restore.words(t)) for t in part["text"]]})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("double").alias("y"), F.xxhash64("text").alias("h"))
    return rows.mapInPandas(run, "y double, h long, marks array<long>, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "toxic") -> Scorer:
    """Character counts over all `docs`, then the scorer from at most `sample` of the labelled ones."""
    counts = np.zeros(SYMBOLS**3)
    for r in count_trigrams(docs).collect():  # at most SYMBOLS cubed
        counts[r["code"]] = r["n"]
    model = CharModel(counts)
    chosen = labels.filter(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, "text").join(chosen.hint("broadcast"), id_col).select("text", "y").limit(2 * sample)
    rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # a limit leaves them in one task
    # in an order of their own, so that which near copy is learned from doesn't hang on how rows are dealt
    got = table(restored(rows, model), "labelled-words").orderBy("y", "h")
    return learn(model, ((r["y"], r["marks"], r["words"]) for r in got.toLocalIterator()))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with the score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = sent.value
        s.start()
        for b in batches:
            yield pd.Series([s.score("" if t is None else t) for t in b])

    return docs.drop(name).withColumn(name, run(F.col(quoted(text_col))))


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 5) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, fit(docs, labels.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
