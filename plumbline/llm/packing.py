"""Harmonic packing of token sequences.

A piece of length n lies in the reciprocal class k with capacity/(k+1) < n <= capacity/k, and k pieces of that class fill a
sequence. Workers fill the classes of their own rows with no word to each other: a class needs to keep only the pieces of
its one open sequence, so a worker's memory is bounded, and no row is moved to be packed.

A document (its ids, then the end id) first gives whole sequences. What remains is left uncut where its class wastes at most
`waste` of a sequence; otherwise the largest reciprocal part capacity/(k+1), which k+1 of its kind fill exactly, is cut off, and so
on with the rest. So padding is at most `waste` in every sequence of a class.

What a worker can't fill, under k pieces of class k, is filled among the workers of a group of GROUP, the classes dealt over PARTS tasks, then
among those groups, until one is left; then the last pieces of all classes, a number bounded by the classes alone (fewer than one
sequence each), are packed in one task, best fit, largest first. Each round reads a table in the shared folder, so a lost executor
repeats its own tasks only.

Null text is an empty one, which is the end id alone. Texts of any length are cut whole. Rows that repeat an id or a text are
documents of their own; null ids stay null. Empty input gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, ship, table
from .tokens import cuts, word_bpe

#: Workers whose leftovers are filled together in one round.
GROUP = 64
#: Parts that the classes of such a group are dealt over; a class is never split.
PARTS = 32
#: The sequence_id of a piece that has none yet.
OPEN = -1


def cut_table(capacity: int, waste: float) -> list[list[tuple[int, int]]]:
    """For each remainder up to capacity - 1: the (length, class) of its pieces."""
    out: list[list[tuple[int, int]]] = [[]]
    for r in range(1, capacity):
        k = capacity // r
        if k * r >= capacity * (1 - waste):
            out.append([(r, k)])
        else:
            part = capacity // (k + 1)
            out.append([(part, k + 1), *out[r - part]])
    return out


class Filler:
    """Open sequences by class; rows are lists [sequence_id, offset, length, class, ...]."""

    def __init__(self, base: int):
        self.open: dict[int, list[list]] = {}
        self.next = base

    def close(self, rows: list[list]) -> list[list]:
        at = 0
        for r in rows:
            r[0], r[1] = self.next, at
            at += r[2]
        self.next += 1
        return rows

    def add(self, row: list) -> list[list]:
        """The rows of the sequence that this row completes, if it does."""
        k = row[3]
        if k <= 1:
            return self.close([row])
        rows = self.open.setdefault(k, [])
        rows.append(row)
        if len(rows) < k:
            return []
        del self.open[k]
        return self.close(rows)

    def rest(self) -> list[list]:
        return [r for rows in self.open.values() for r in rows]

    def best_fit(self, capacity: int) -> list[list]:
        """The rest in as few sequences as best fit finds, largest first."""
        by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
        out = []
        for r in sorted(self.rest(), key=lambda r: -r[2]):
            room = next((x for x in range(r[2], capacity) if by_room[x]), capacity)
            rows = by_room[room].pop() if room < capacity else []
            rows.append(r)
            by_room[room - r[2]].append(rows)
        for rows in (x for room in by_room for x in room):
            out += self.close(rows)
        return out


PIECE = "sequence_id long, `offset` long, length long, class int, doc_id string, start long, doc_tokens long, worker int"


def cut_and_fill(docs: DataFrame, capacity: int, waste: float, end_id: int, id_col: str, vocabulary: str, folder: str | None) -> DataFrame:
    """Pieces with their ids (binary, unsigned little-endian 32-bit); sequence_id is OPEN where a worker's sequence stayed open."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, parts, end = word_bpe(vocabulary, folder), cut_table(capacity, waste), np.array([end_id], "<u4").tobytes()
        worker = TaskContext.get().partitionId()
        fill = Filler(worker << 33)
        names = ["sequence_id", "offset", "length", "class", "doc_id", "start", "doc_tokens", "worker", "ids"]

        for b in batches:
            for lo, hi in cuts(0 if t is None else len(t) for t in b["text"]):
                part, out = b.iloc[lo:hi], []
                for doc, ids in zip(part["id"], bpe.encode_all(["" if t is None else t for t in part["text"]]), strict=True):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for length, k in [(capacity, 1)] * (n // capacity) + parts[n % capacity]:
                        out += fill.add([OPEN, OPEN, length, k, doc, at, n, worker, ids[4 * at : 4 * (at + length)]])
                        at += length
                if out:
                    yield pd.DataFrame(out, columns=names)
        if left := fill.rest():
            yield pd.DataFrame(left, columns=names)

    # ids go as text: pandas would make numbers with a null among them inexact
    return docs.select(F.col(quoted(id_col)).cast("string").alias("id"), "text").mapInPandas(run, PIECE + ", ids binary")


def pack(
    docs: DataFrame, capacity: int = 2048, *, waste: float = 1 / 64, end_id: int = 1, id_col: str = "doc_id", vocabulary: str = "word_bpe_49k.json",
    folder: str | None = None, payload: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset and the payload, by default the ids themselves.

    `payload` names columns worked out from the binary ids where a piece is made, so that digests needn't store the ids.
    """
    spark = docs.sparkSession
    payload = {"ids": lambda ids: ids} if payload is None else payload
    first = cut_and_fill(docs, capacity, waste, end_id, id_col, vocabulary, folder)
    first = table(first.select(*[c for c in first.columns if c != "ids"], *[f(F.col("ids")).alias(n) for n, f in payload.items()]), "pieces")
    done, left = first.filter("sequence_id >= 0"), first.filter("sequence_id < 0")
    workers = (left.agg(F.max("worker")).collect()[0][0] or 0) + 1
    schema, level, names = first.schema, 0, first.columns

    def filler(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(g: pd.DataFrame) -> pd.DataFrame:
            worker = int(g["worker"].iloc[0]) // GROUP
            # ids of its own for each round, group and part; a class of a group fills fewer than GROUP sequences
            fill, out = Filler((level << 56) | (worker << 33) | (0 if last else int(g["class"].iloc[0]) % PARTS << 24)), []
            for r in g.sort_values(["worker", "start", "length", "doc_id"], kind="stable")[names].itertuples(index=False):
                out += fill.add(list(r))
            out += fill.best_fit(capacity) if last else [[OPEN, OPEN, *r[2:]] for r in fill.rest()]
            f = pd.DataFrame(out, columns=names)
            f["worker"] = worker
            return f

        return run

    while True:
        level += 1
        last = level > 1 and workers == 1
        made = left.withColumns({"__g": F.floor(F.col("worker") / GROUP), "__c": F.lit(0) if last else F.col("class") % PARTS}).groupBy("__g", "__c").applyInPandas(filler(level, last), schema)
        made = table(made, f"pieces-{level}")
        done = done.unionByName(made.filter("sequence_id >= 0"))
        if last:
            break
        left, workers = made.filter("sequence_id < 0"), -(-workers // GROUP)
    kind = dict(docs.dtypes)[id_col]
    return done.select(F.col("doc_id").cast(kind).alias("doc_id"), "start", "length", *payload, "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, payload={"ids_crc32": F.crc32}).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op2_packing": op2_packing}
