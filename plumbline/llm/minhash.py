"""Near-duplicates by b-bit MinHash, links confirmed on full sets.

A text's words (A-Z in lower case, split at space and tab to carriage return) give its set: distinct shingles of `size` words as
64-bit hashes, or the whole sequence as one where there are fewer words. Texts link at a Jaccard similarity of `percent` or more.
The query's contract says three words and 85; elsewhere five words and 80 are the default.

1. Rows are numbered and written; one pass over the texts gives set size, set digest, minima under MINIMA hash functions; a band
   key of each few minima, and the low BITS bits of the first WORDS * 64 minima packed in bit planes.
2. Rows with one set digest are one class; only its representative goes on. Copies are so never paired.
3. Representatives with a band key in common are candidates (`Rule` chooses bands so that a link is missed with a probability
   under MISSED). In each bucket all are compared with one hub only, the member with the fullest buckets: XOR and bit counts of
   the planes give the number of equal low bits, and from it, less the matches by chance, the estimated similarity. Pairs
   whose estimate is under the threshold by over five standard errors are dropped, the rest confirmed on full sets.
4. Buckets whose members are then in one component are done. In the others, only pairs of different components are left,
   compared by the same estimate: small buckets by a join on the key, large ones cut in blocks, any two blocks in a task, out of which
   come not pairs but the members that have a partner left there. Only signatures go into buckets and blocks; texts are fetched for
   the pairs and members that are left, those of two blocks to be compared by a product of incidence matrices.
5. Components over all confirmed links.

No key gathers rows without bound: a hub's bucket is salted by CHUNK members, a block has BLOCK, and the partners of one text are
confirmed in SPREAD parts, each read row by row. What is quadratic is a bucket of very many texts that all lie just under the
threshold to each other: their signatures are compared pair by pair, and those within the error of the estimate by their sets, a
text being fetched once for every BLOCK others. Out of that, too, come only links, one for any two components of two blocks.

Empty and null texts have an empty set, link with nothing and are a component each. Texts of any length are read whole. Rows that
repeat an id or a text count each. The component is the least id reachable; null ids are passed over, and a component of null ids
only has a null one. An empty table gives an empty one. `deduplicate` keeps one row of every component, that of the least id (a
null id last), and passes all columns under any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, quoted, ship, small, table, unused
from .components import components
from .tokens import cuts

#: Hash functions, and the probability that no band of a linked pair agrees.
MINIMA, MISSED = 130, 1e-6
BITS, WORDS = 4, 2
#: Standard errors of the estimate under the threshold from which a pair is dropped.
ERRORS = 5
#: Members from which a bucket is compared in blocks, and the members of a block.
LARGE, BLOCK = 64, 256
#: Members compared with a copy of their hub's signature in one group, and parts in which a text's partners are confirmed.
CHUNK, SPREAD = 4096, 32
#: Numbers of texts that are sent to every task, at most; beyond it is joined by number.
SENT = 500_000
#: Words whose hashes a worker remembers.
MEMO = 1_000_000



@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the per cent of the union that the intersection of linked sets must reach."""

    size: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Minima of a band: as many as leave a linked pair a probability of MISSED at most to agree in no band."""
        t = self.percent / 100
        return next((r for r in range(12, 1, -1) if (1 - t**r) ** (MINIMA // r) <= MISSED), 1)

    @property
    def bands(self) -> int:
        return MINIMA // self.rows

    @property
    def least(self) -> float:
        """The estimate of a pair at the threshold, less ERRORS standard errors."""
        c, t = 2.0**-BITS, self.percent / 100
        p = c + (1 - c) * t
        return t - ERRORS * (p * (1 - p) / (WORDS * 64)) ** 0.5 / (1 - c)


_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, size: int):
        import xxhash

        self.size, self.hash, self.memo = size, xxhash.xxh64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            h = np.array([memo[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words):
                if w not in memo:
                    memo[w] = self.hash(w)
            h = np.array([memo[w] for w in words], np.uint64)
        k = min(self.size, len(h))
        x = np.full(len(h) - k + 1, np.uint64(k * 0x2545F491), np.uint64)
        for i in range(k):
            x = mix(x * _M + h[i : len(h) - k + 1 + i])
        return np.unique(x)


def functions_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**32, n, np.uint32), r.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def minima(x: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the set, in chunks so that long texts take no more memory."""
    x32 = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x32), 2048):
        np.minimum(out, ((x32[i : i + 2048, None] ^ xor) * mul).min(0), out=out)
    return out


def signatures(m: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed planes) of a matrix of minima: low bit p of minima 64w .. 64w+63 is word p * WORDS + w."""
    n, bands, per = len(m), rule.bands, rule.rows
    key = np.full((n, bands), np.uint64(0), np.uint64) + np.arange(bands, dtype=np.uint64) * _M
    rows = m[:, : bands * per].reshape(n, bands, per).astype(np.uint64)
    for r in range(per):
        key = mix(key * _M + rows[:, :, r])
    low = m[:, : WORDS * 64]
    planes = [np.packbits((low >> np.uint32(p)) & np.uint32(1), axis=1).view("<u8") for p in range(BITS)]
    return key.view(np.int64), np.concatenate(planes, 1).view(np.int64)


def numbered(docs: DataFrame, columns: list, number: str = "v") -> DataFrame:
    """The columns with a number for every row, written, so that a number stays with its row."""
    return table(docs.select(F.monotonically_increasing_id().alias(number), *columns), "numbered")


def sketches(rows: DataFrame, rule: Rule) -> DataFrame:
    """For rows (v, id, text): v, id, n (set size), digest of the set ('' if empty), planes and bands."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingle, (xor, mul) = Shingler(rule.size), functions_of(MINIMA)
        for b in batches:
            for lo, hi in cuts(0 if t is None else len(t) for t in b["text"]):
                part = b.iloc[lo:hi]
                sets = [shingle(t) for t in part["text"]]
                keys, planes = signatures(np.array([minima(s, xor, mul) for s in sets]), rule)
                yield pd.DataFrame(
                    {"v": part["v"], "id": part["id"], "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else "" for s in sets], "planes": list(planes), "bands": list(keys)}
                )

    # ids go as text: pandas would make numbers with a null among them inexact
    s = rows.select("v", F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "v long, id string, n long, digest string, planes array<long>, bands array<long>")
    return s.withColumn("id", F.col("id").cast(kind))


def matches(p: Column, q: Column) -> Column:
    """Equal low-bit groups of two signatures, by bit counts."""
    total = F.lit(WORDS * 64)
    for w in range(WORDS):
        diff = None
        for b in range(BITS):
            x = p[b * WORDS + w].bitwiseXOR(q[b * WORDS + w])
            diff = x if diff is None else diff.bitwiseOR(x)
        total = total - F.bit_count(diff)
    return total


def similarity(p: Column, q: Column) -> Column:
    """Estimated Jaccard similarity: the share of matches less those by chance."""
    c = 2.0**-BITS
    return (matches(p, q) / (WORDS * 64) - c) / (1 - c)


def may_link(n: tuple[str, str], planes: tuple[str, str], rule: Rule) -> Column:
    """Whether two sets, by their sizes and the estimate, may reach the threshold."""
    a, b = map(F.col, n)
    return (F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent) & (similarity(*map(F.col, planes)) >= rule.least)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(np.intersect1d(a, b, True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def with_texts(wanted: DataFrame, number: str, rows: DataFrame) -> DataFrame:
    """The rows of a written table with the texts of the numbers in them; no other texts move where those are few."""
    few = wanted.select(F.col(number).alias("u")).distinct()
    texts = rows.select(F.col("v").alias("tv"), "text").join(small(few, SENT), F.col("tv") == F.col("u"), "left_semi")
    return wanted.join(texts, F.col(number) == F.col("tv")).drop("tv")


def confirm(pairs: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b: numbers of rows with a text) that link by their full sets.

    A text is fetched once for each of its pairs as b, and as a once for each of at most SPREAD parts of its partners.
    """
    ship(pairs.sparkSession)
    pairs = table(packed(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).alias("part")), rows), "pairs")
    wanted = pairs.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("w")).distinct().unionByName(pairs.select("a", "part", "b", F.col("b").alias("w")))
    sent = with_texts(wanted, "w", rows).select("a", "part", "b", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, at, own = Shingler(rule.size), None, None
        for g in batches:
            out = []
            for a, part, b, text in zip(g["a"].tolist(), g["part"].tolist(), g["b"].tolist(), g["text"], strict=True):
                x = shingle(text)
                if b < 0:  # the text that those after it are compared with
                    at, own = (a, part), x
                elif at == (a, part) and linked(own, x, rule.percent):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    dealt = sent.withColumn("b", F.coalesce("b", F.lit(-1))).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    return dealt.mapInPandas(run, "a long, b long")


def block_members(rows: DataFrame, rule: Rule) -> DataFrame:
    """Of rows (key, i, j, k, v, label, n, planes), where k, the member's block, is i or j: those that may link with one of another label."""
    ship(rows.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, right = np.flatnonzero(g["k"] == g["i"]), np.flatnonzero(g["k"] == g["j"])
        size, label = g["n"].to_numpy(), g["label"].to_numpy()
        n, m = size[left][:, None], size[right][None]
        ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * rule.percent) & (label[left][:, None] != label[right][None])
        planes = np.array(g["planes"].tolist(), np.int64).view(np.uint64)
        p, q, same = planes[left], planes[right], np.full(ok.shape, WORDS * 64)
        for w in range(WORDS):
            diff = np.zeros(ok.shape, np.uint64)
            for b in range(BITS):
                diff |= p[:, None, b * WORDS + w] ^ q[None, :, b * WORDS + w]
            same -= np.bitwise_count(diff)
        c = 2.0**-BITS
        ok &= (same / (WORDS * 64) - c) / (1 - c) >= rule.least
        return g.iloc[np.union1d(left[ok.any(1)], right[ok.any(0)])][["key", "i", "j", "k", "v", "label"]]

    return rows.groupBy("key", "i", "j").applyInPandas(run, "key long, i int, j int, k int, v long, label long")


def block_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) between members of different labels for rows (key, i, j, k, v, label, text), one for any two labels of two blocks."""
    ship(rows.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        shingle = Shingler(rule.size)
        sets = [shingle(t) for t in g["text"]]
        n = np.array([len(x) for x in sets])
        who = np.repeat(np.arange(len(sets)), n)
        _, col, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = np.cumsum(cnt > 1) - 1  # what only one set has is in no intersection
        col = np.where(cnt[col] > 1, common[col], -1)
        left, right = np.flatnonzero(g["k"] == g["i"]), np.flatnonzero(g["k"] == g["j"])
        row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
        row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int((cnt > 1).sum()), 8192):  # the product in slices of the vocabulary
            part = (col >= lo) & (col < lo + 8192)
            x, y = np.zeros((len(left), 8192), np.float32), np.zeros((len(right), 8192), np.float32)
            pl, pr = part & (row_l[who] >= 0), part & (row_r[who] >= 0)
            x[row_l[who[pl]], col[pl] - lo] = 1
            y[row_r[who[pr]], col[pr] - lo] = 1
            both += x @ y.T
        union = n[left][:, None] + n[right][None] - both
        label, v = g["label"].to_numpy(), g["v"].to_numpy()
        a, b = np.nonzero((100 * both >= rule.percent * union) & (label[left][:, None] != label[right][None]))
        out = pd.DataFrame({"a": v[left[a]], "b": v[right[b]], "x": label[left[a]], "y": label[right[b]]})
        return out.drop_duplicates(["x", "y"])[["a", "b"]]

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def links_between(members: DataFrame, label: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): links between different components, in buckets with more than one component left."""
    name = lambda m: m.join(label, F.col("v") == F.col("lv"), "left").withColumn("label", F.coalesce("label", "v")).drop("lv")
    mixed = name(members.select("key", "v")).groupBy(F.col("key").alias("mkey")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("mkey")
    rest = name(members.select("key", "m", "v", "n", "planes").join(mixed, F.col("key") == F.col("mkey"), "left_semi"))
    rest = table(packed(rest, members), "bucket-rest")
    few = rest.filter(F.col("m") <= LARGE)
    l, r = (few.select(*[F.col(c).alias(f"{c}{x}") for c in few.columns]) for x in "ab")
    near = l.join(r, (F.col("keya") == F.col("keyb")) & (F.col("va") < F.col("vb")) & (F.col("labela") != F.col("labelb")) & may_link(("na", "nb"), ("planesa", "planesb"), rule))
    # large buckets by blocks: every member goes to the block pairs of its block
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    large = rest.filter(F.col("m") > LARGE).withColumn("k", F.pmod(F.xxhash64("v"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.select("key", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "v", "label", "n", "planes")
    large = table(block_members(large, rule), "block-members")
    found = confirm(near.select(F.col("va").alias("a"), F.col("vb").alias("b")).distinct(), rows, rule)
    return found.unionByName(block_links(with_texts(large, "v", rows), rule))


def cluster_numbered(rows: DataFrame, rule: Rule) -> DataFrame:
    """(v, id, n, digest, component_id, best) for rows (v, id, text): best is the number of the row that stands for the component."""
    s = table(sketches(rows, rule), "sketches")
    # classes of equal sets
    best = F.struct(F.col("id").isNull().alias("none"), "id", "v")
    reps = s.filter("n > 0").groupBy("digest").agg(F.min("v").alias("v"), F.min(best).alias("best"), F.first("n").alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    reps = table(packed(reps, s), "classes")
    exploded = reps.select("v", F.explode("bands").alias("key"))
    counts = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = table(packed(exploded.join(counts, "key"), s), "bucket-keys")
    weighed = members.groupBy(F.col("v").alias("wv")).agg(F.sum("m").alias("weight")).join(reps.select("v", "n", "planes"), F.col("wv") == F.col("v")).drop("v")
    members = table(packed(members.join(weighed, F.col("v") == F.col("wv")).drop("wv"), s), "bucket-members")
    # every member against its bucket's hub; the hub's signature goes to each salt of its bucket
    hubs = members.groupBy(F.col("key").alias("hkey")).agg(F.max(F.struct("weight", "v", "n", "planes")).alias("hub"), F.max("m").alias("hm"))
    hubs = hubs.select("hkey", F.col("hub.v").alias("a"), F.col("hub.n").alias("hn"), F.col("hub.planes").alias("hplanes"), F.explode(F.sequence(F.lit(0), F.floor((F.col("hm") - 1) / CHUNK).cast("int"))).alias("hsalt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("v"), F.floor((F.col("m") - 1) / CHUNK) + 1).cast("int"))
    star = salted.join(hubs, (F.col("key") == F.col("hkey")) & (F.col("salt") == F.col("hsalt"))).filter((F.col("v") != F.col("a")) & may_link(("n", "hn"), ("planes", "hplanes"), rule))
    links = table(packed(confirm(star.select("a", F.col("v").alias("b")).distinct(), rows, rule), rows), "links-star")
    label = components(links).select(F.col("v").alias("lv"), F.col("component").alias("label"))
    links = table(packed(links.unionByName(links_between(members, label, rows, rule)), rows), "links")
    final = components(links).select(F.col("v").alias("lv"), F.col("component").alias("root"))
    named = reps.select("digest", "v", "best").join(final, F.col("v") == F.col("lv"), "left").select(F.col("digest").alias("cd"), F.coalesce("root", "v").alias("root"), "best")
    of = named.groupBy(F.col("root").alias("r")).agg(F.min("best").alias("first"))
    named = named.join(of, F.col("root") == F.col("r")).select("cd", "first")
    return s.select("v", "id", "n", "digest").join(named, F.col("digest") == F.col("cd"), "left").select(
        "v", "id", "n", "digest", F.when(F.col("cd").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"), F.coalesce("first.v", "v").alias("best")
    )


def cluster(docs: DataFrame, id_col: str = "doc_id", rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """(v, id, n, digest, component_id, best) for every row of `docs`: v numbers the rows."""
    return cluster_numbered(numbered(docs, [F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")]), rule)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", rule: Rule = Rule(), text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each component, that with the least id."""
    v, w = unused(docs, "__v", "__w")
    rows = numbered(docs, [F.col(quoted(c)) for c in docs.columns], v)
    found = cluster_numbered(rows.select(F.col(v).alias("v"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), rule)
    gone = table(found.filter(F.col("v") != F.col("best")).select(F.col("v").alias(w)), "near-copies")
    return rows.join(small(gone, SENT), F.col(v) == F.col(w), "left_anti").drop(v)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cluster(docs, rule=Rule(3, 85)).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


QUERIES = {"op3_minhash": op3_minhash}
_W = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
ORACLE = {
    "op3_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct([w[i:i+2] FOR i IN range(1, len(w) - 1)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.v = s.doc_id"""
}
