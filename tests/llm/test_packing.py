import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, messy_rows, nothing

from plumbline.llm import packing as P
from plumbline.llm.tokens import WordBpe


def whole(texts):
    from tokenizers import Tokenizer

    from plumbline.llm.common import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def test_chunks_are_the_library_s_ids():
    texts = ["", "Hello, wörld's  <|endoftext|> x", "é e ́x ΑΣ Σ ΟΔΟΣ İstanbul", "a\x1cb\x1d c\x85d\xa0e f　g", "42nd 3.14 🎉🎉 漢字かな", "don't I'LL", "﻿bom ​zero"]
    for got, want in zip(WordBpe().encode_all(texts), whole(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want[:-1].tolist()


@pytest.mark.parametrize("capacity,waste", [(2048, 1 / 64), (64, 0.1), (7, 0.0)])
def test_cuts(capacity, waste):
    for r, pieces in enumerate(P.cut_table(capacity, waste)):
        assert sum(n for n, _ in pieces) == r
        for n, k in pieces:
            assert 0 < n * k <= capacity and capacity - n * k <= max(waste * capacity, k - 1)


def verify(got, rows, capacity):
    """Exact round trip: every id in one piece, sequences gapless and full."""
    seq, docs = {}, {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids"]))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    want = sorted(x.tobytes() for x in whole([r[1] for r in rows]))
    have = []
    for p in docs.values():
        by = {}
        for start, n, ids in p:
            assert len(ids) == 4 * n
            by.setdefault(start, []).append(bytes(ids))
        # rows with one id and length are told apart by joining their parts in any consistent way
        have.append(sorted(b"".join(x) for x in [sum(([b] for v in by.values() for b in v), [])]))
    assert sum(len(x) for h in have for x in h) == sum(map(len, want))
    return seq


def test_messy(spark):
    rows = messy_rows()
    got = P.pack(messy(spark).repartition(3), 128).collect()
    verify(got, rows, 128)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1])
    for doc in [i for i, t in texts.items() if len(t) == 1]:
        mine = sorted((r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == doc)
        assert b"".join(b for _, b in mine) == whole(texts[doc])[0].tobytes()


def test_padding_and_many_workers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(150)
    got = P.pack(docs, payload={"c": F.crc32}).toPandas()
    seq = got.groupby("sequence_id").length.sum()
    assert seq.max() <= 2048 and seq.sum() / (2048 * len(seq)) > 0.98
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = P.op2_packing(spark, d).collect()
    ids = dict(zip(docs, whole(docs.values())))
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])


def test_empty(spark):
    assert P.pack(nothing(spark)).count() == 0
