"""Quality rules from tokeniser fertility, beside base counts.

Two public vocabularies read every word of a text: one with byte fallback, one of bytes made for many languages. Four figures
come of it: characters per token under either (low for text the vocabulary doesn't know, as noise, codes or broken encoding), the
share of byte-fallback tokens, and the entropy of the first one's tokens in bits (low for repetition and for signs strewn between
words). A text is rejected if a figure lies outside the band of its group. The entropy grows with length, so a group is a
language, where it is known, else a script, and a length class of half a power of two in tokens. Bands are set from all
distinct texts of the group that pass the base rules (copies would make one text the norm): the
median, WIDTH times the median deviation from it to either side, but FLOOR at least. A group under `min_group` texts is judged by
the next coarser one that has as many: the language over all lengths, then the script, then all texts, whose entropy is taken
less its growth with length (DRIFT). Script and all texts have wider floors, as clean texts of a rare language differ from the
others. Where all texts are too few, LIMITS hold. Only texts under `min_tokens` tokens are judged by the base rules alone.

Medians are exact on a GRID: figures are counted by grid cell in every group, which is summed in any order to the same numbers,
and median and deviation are read from the counts. Of an even number the lower one is the median, so ties need no rule.

Base rules: words are `[^\\x20\\x09-\\x0D]+`; a text fails with under 50 words, or if over half of its words lie in 3-word windows
that occur twice or more in it (the first occurrence too). Null text has no words. Empty texts fail. Texts of any length are read
whole. Rows that repeat an id or a text each get their result; the key may be null. An empty table gives an empty one. Columns
other than key, text and language aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import quoted, ship, small, table
from .tokens import ByteBpe, PieceBpe, byte_bpe, cuts, piece_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to Python that is part of a word here.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SYMBOLS = "#*$%&|<>"
#: Ranges that name a script, by first and last code point.
SCRIPTS = (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
FIGURES = ("chars_per_token", "multi_chars_per_token", "byte_share", "entropy")
#: Cells to a unit, for the counts that medians are read from.
GRID = {"chars_per_token": 200, "multi_chars_per_token": 200, "byte_share": 2000, "entropy": 200}
#: Median deviations below and above the median that the band reaches, and its least half-widths.
WIDTH = {"chars_per_token": (12, 12), "multi_chars_per_token": (12, 12), "byte_share": (12, 12), "entropy": (7.5, 12)}
FLOOR = {"chars_per_token": (0.45, 0.45), "multi_chars_per_token": (0.6, 0.6), "byte_share": (0.06, 0.06), "entropy": (0.4, 0.8)}
#: The same where languages, and where scripts are mixed.
MIXED_FLOOR = (
    {"chars_per_token": (1.2, 1.2), "multi_chars_per_token": (1.6, 1.6), "byte_share": (0.15, 0.15), "entropy": (1.0, 1.2)},
    {"chars_per_token": (1.6, 1.6), "multi_chars_per_token": (2.0, 2.0), "byte_share": (0.2, 0.2), "entropy": (2.0, 2.0)},
)
FLOORS = (FLOOR, FLOOR, *MIXED_FLOOR)
#: What entropy lacks at n tokens of what it comes to in long texts: DRIFT[0] * n ** DRIFT[1], from medians by length of the given texts.
DRIFT = (15.9, -4 / 7)
#: Least and greatest figures of texts in any language, for tables too small to set a band from.
LIMITS = {"chars_per_token": (0.6, 4.5), "multi_chars_per_token": (0.6, 6.5), "byte_share": (0.0, 0.25), "entropy": (3.5, 9.5)}
#: Groups up to which their figures are sent to every task.
GROUPS = 20_000
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, multi_chars_per_token double, byte_share double, entropy double, script string"


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeat_words(w: list[str]) -> int:
    """Words in 3-word windows that occur at least twice."""
    n = len(w) - 2
    if n < 2:
        return 0
    grams = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    hit = np.zeros(n + 2, bool)
    at = np.array([count[g] > 1 for g in grams])
    hit[:-2] |= at
    hit[1:-1] |= at
    hit[2:] |= at
    return int(hit.sum())


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script, of those with most characters in the text, that over a third of all its characters are in; else latin."""
    if text.isascii():
        return "latin"
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    best, most = "latin", len(a) // 3
    for name, lo, hi in SCRIPTS:
        k = int(((a >= lo) & (a <= hi)).sum())
        if k > most:
            best, most = name, k
    return best


def measure(texts: list[str], bpe: PieceBpe, multi: ByteBpe) -> list[tuple]:
    split = [words_of(t) for t in texts]
    out = []
    for t, w, ids, k in zip(texts, split, bpe.encode_words(split), multi.count_words(split), strict=True):
        chars = sum(map(len, w))
        a = np.frombuffer(ids, "<u2")
        n = len(a)
        if n:
            c = np.bincount(a)
            share = float(c[: bpe.size][bpe.bytes[: len(c)]].sum()) / n
            c = c[c > 0] / n
            h = abs(float((c * np.log2(c)).sum()))
        else:
            share, h = 0.0, 0.0
        out.append((len(w), chars, sum(map(t.count, SYMBOLS)), dup_lines(t), repeat_words(w), n, chars / n if n else 0.0, chars / k if k else 0.0, share, h, script_of(t)))
    return out


def measured(docs: DataFrame, key: str = "doc_id", lang_col: str | None = "lang", folder: str | None = None, text_col: str = "text") -> DataFrame:
    """Narrow rows: the key, the language (null if not known), a hash of the text and the measures of every text."""
    ship(docs.sparkSession)
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, multi = piece_bpe(folder=folder), byte_bpe(folder=folder)
        for b in batches:
            for lo, hi in cuts(0 if t is None else len(t) for t in b["text"]):
                part = b.iloc[lo:hi]
                out = pd.DataFrame(measure(["" if t is None else t for t in part["text"]], bpe, multi), columns=names)
                yield pd.concat([part[["key", "lang", "text_hash"]].reset_index(drop=True), out], axis=1)

    lang = F.col(quoted(lang_col)).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    text = F.col(quoted(text_col))
    # keys go as text: pandas would make numbers with a null among them inexact
    m = docs.select(F.col(quoted(key)).cast("string").alias("key"), lang.alias("lang"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return m.mapInPandas(run, f"key string, lang string, text_hash long, {MEASURES}").withColumn("key", F.col("key").cast(kind))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def groups_of() -> list:
    """The groups a text is in, from fine to coarse."""
    half_power = F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1)))).cast("string")
    unit = F.coalesce("lang", F.concat(F.lit("script:"), "script"))
    return [F.concat_ws("/", F.lit("0"), unit, half_power), F.concat_ws("/", F.lit("1"), unit), F.concat_ws("/", F.lit("2"), "script"), F.lit("3")]


def figure(f: str, level):
    """The figure as groups of that level compare it: where lengths are mixed, entropy is less its growth."""
    long = F.col(f) + DRIFT[0] * F.pow(F.greatest("n_tokens", F.lit(1)).cast("double"), F.lit(DRIFT[1]))
    return F.when(level > 0, long).otherwise(F.col(f)) if f == "entropy" else F.col(f)


def weighted_median(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, `name` (the least value that half of the weight `w` reaches) and `n` (all weight), for rows (keys, value, w)."""
    up = Window.partitionBy(*keys).orderBy(value)
    c = counts.withColumns({"__up": F.sum("w").over(up), "__n": F.sum("w").over(Window.partitionBy(*keys))})
    return c.filter(2 * F.col("__up") >= F.col("__n")).groupBy(*keys).agg(F.min(value).alias(name), F.first("__n").alias("n"))


def bands(m: DataFrame, min_tokens: int, min_group: int) -> DataFrame:
    """level, grp, and lo_ / hi_ of each figure: median and median deviation over all distinct texts that pass the base rules."""
    good = m.filter(~F.col("base_failed") & (F.col("n_tokens") >= min_tokens)).select("lang", "text_hash", "script", "n_tokens", *FIGURES).dropDuplicates(["lang", "text_hash"])
    good = good.select("n_tokens", *FIGURES, F.posexplode(F.array(*groups_of())).alias("level", "grp"))
    cells = F.array(*[F.struct(F.lit(f).alias("figure"), F.round(figure(f, F.col("level")) * GRID[f]).cast("long").alias("cell")) for f in FIGURES])
    counts = good.select("level", "grp", F.explode(cells).alias("c")).groupBy("level", "grp", "c.figure", "c.cell").agg(F.count(F.lit(1)).alias("w"))
    counts = table(counts, "fertility-counts")  # a row for each cell of each group
    keys = ["level", "grp", "figure"]
    mid = weighted_median(counts, keys, "cell", "mid").filter(F.col("n") >= min_group).drop("n")
    off = counts.join(mid, keys).withColumn("off", F.abs(F.col("cell") - F.col("mid"))).groupBy(*keys, "mid", "off").agg(F.sum("w").alias("w"))
    dev = weighted_median(off, [*keys, "mid"], "off", "dev")
    # one row a group
    unit = {f: F.max(F.when(F.col("figure") == f, F.struct("mid", "dev"))) for f in FIGURES}
    dev = dev.groupBy("level", "grp").agg(*[c.alias(f) for f, c in unit.items()])
    floor = lambda f, side: F.element_at(F.array(*[F.lit(x[f][side]) for x in FLOORS]), F.col("level") + 1)
    reach = lambda f, side: F.greatest(F.col(f"{f}.dev") / GRID[f] * WIDTH[f][side], floor(f, side))
    return dev.select(
        "level", "grp", *[(F.col(f"{f}.mid") / GRID[f] - reach(f, 0)).alias(f"lo_{f}") for f in FIGURES], *[(F.col(f"{f}.mid") / GRID[f] + reach(f, 1)).alias(f"hi_{f}") for f in FIGURES]
    )


def judge(docs: DataFrame, key: str = "doc_id", lang_col: str | None = "lang", *, min_tokens: int = 100, min_group: int = 30, folder: str | None = None, text_col: str = "text") -> DataFrame:
    """Per row: the key, all measures, base_failed, outside (names of the figures out of band) and kept. Keys may repeat."""
    m = table(measured(docs, key, lang_col, folder, text_col).withColumn("base_failed", base_failed()), "fertility")
    b = table(bands(m, min_tokens, min_group), "fertility-bands")
    j, verdicts = m, []
    for level, grp in enumerate(groups_of()):
        at = b.filter(F.col("level") == level)
        at = at.select(F.col("grp").alias(f"grp{level}"), *[F.col(f"{side}_{f}").alias(f"{side}{level}_{f}") for f in FIGURES for side in ("lo", "hi")])
        j = j.join(small(at, GROUPS) if level < 2 else at.hint("broadcast"), grp == F.col(f"grp{level}"), "left")
        x = {f: figure(f, F.lit(level)) for f in FIGURES}
        out = [F.when((x[f] < F.col(f"lo{level}_{f}")) | (x[f] > F.col(f"hi{level}_{f}")), F.lit(f)) for f in FIGURES]
        verdicts.append(F.when(F.col(f"grp{level}").isNotNull(), F.array_compact(F.array(*out))))
    verdicts.append(F.array_compact(F.array(*[F.when(~F.col(f).between(*LIMITS[f]), F.lit(f)) for f in FIGURES])))
    j = j.withColumn("outside", F.when(F.col("n_tokens") >= min_tokens, F.coalesce(*verdicts)).otherwise(F.array().cast("array<string>")))
    cols = [c for c in m.columns if c not in ("key", "text_hash")]
    return j.select(F.col("key").alias(key), *cols, "outside", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "multi_chars_per_token", "byte_share", "entropy", "outside"
    )


QUERIES = {"op5_fertility": op5_fertility}
