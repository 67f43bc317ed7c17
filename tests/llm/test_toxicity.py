import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import messy, nothing

from plumbline.llm import toxicity as T

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scorer(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    s = T.fit(docs, spark.read.parquet(f"{D}/labels.parquet").filter(~T.held_out()))
    s.start()
    return s


def test_decoding(scorer):
    decode = scorer.model.decode
    for noisy, plain in [("1d10t", "idiot"), ("idiooot", "idiot"), ("i.d.i.o.t", "idiot"), ("cl0wn", "clown"), ("w0rthle$$", "worthless"), ("p4thetic", "pathetic"), ("m0r0n", "moron"), ("l o s e r", "loser"), ("$cum", "scum"), ("tr@sh", "trash")]:
        assert decode(noisy).replace(" ", "") == plain, noisy


def test_viterbi_is_best_of_all(scorer):
    """Against every reading of short tokens."""
    m = scorer.model
    m.start()

    def readings(token):
        out = [("", 0.0, "")]
        for ch in token:
            if ch.isalpha():
                opts = [(ch, 0.0)]
            elif ch in T.LEET:
                opts = [(x, T.COST_LEET) for x in T.LEET[ch]] + [("", T.COST_DROP)]
            else:
                opts = [("", 0.5 if ch in T.SEPARATORS else T.COST_DROP)]
            out = [(o + x, c + k, ch) for o, c, last in out for x, k in opts + ([("", T.COST_REPEAT)] if ch.isalpha() and ch == last else [])]
        return out

    def value(text, cost):
        s, a, b = -cost, 0, 0
        for c in [T.CODE.get(x, T.OTHER) for x in text] + [0]:
            s, a, b = s + m.rows[a][b][c], b, c
        return s

    for token in ["1d10t", "b@@d", "coool", "a|b1", "h3ll0", "x.y.z"]:
        best = max(value(t, c) for t, c, _ in readings(token))
        got = m.decode(token)
        assert max(value(t, c) for t, c, _ in readings(token) if t == got) == pytest.approx(best, abs=1e-4)


def test_obfuscated_scores_as_plain(scorer):
    clean = "the thing and that er the ontion of this are and from with"
    for word, noisy in [("idiot", "1d10t"), ("idiot", "i d i o t"), ("idiot", "i.d.i.o.t"), ("loser", "looooser"), ("moron", "m0r0n")]:
        assert scorer.score(f"{clean} {word} {clean}") > 0.5 and scorer.score(f"{clean} {noisy} {clean}") > 0.5
    assert scorer.score(clean) < 0.5 and scorer.score("") < 0.5


def test_obfuscations_reach_the_decoder(scorer):
    clean = "the thing and that er the ontion of this are and from with"
    spaced = " ".join("the thing and that is from with other".replace(" ", ""))
    for noisy in [
        "1 d 1 0 t", "i d ! 0 t", "i   d   i   o   t", "!diot", "1d1ooooooooooooooooooooooooooooooooooooot", "i" * 50 + "diot", "m.0.r.0.n", "1d107",
        f"{spaced} i d i o t {spaced}", f"{spaced}   i d i o t", "x-" * 40 + "1d10t",
    ]:
        assert scorer.score(f"{clean} {noisy} {clean}") > 0.5, noisy
    assert scorer.score(f"{clean}! a | b | c 1 2 3 4 5 6 + 7 {clean}!!") < 0.5
    words = scorer.restore.words
    assert "scum" in words("you $cum") and "stupid" in words("$ t u p i d") and "stupid" in words("s t u p ! d") and "stupid" in words("$$$tupid") and "fine" in words("fine!")
    scorer.score("a b " * 20_000 + "1d10t" * 20_000)  # grows with the length only


def test_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in T.op1_toxicity(spark, D).collect() if r["held_out"] and r["doc_id"] in labels]
    tp = sum(p and t for p, t in got)
    assert tp / sum(t for _, t in got) > 0.75 and tp / sum(p for p, _ in got) > 0.95


def test_messy(spark, scorer):
    got = T.score(messy(spark), scorer)
    assert got.columns == [*messy(spark).columns, "score"]
    rows = got.select("text", "score").collect()
    assert len(rows) == messy(spark).count() and all(0 <= r[1] <= 1 for r in rows)
    assert len({r[1] for r in rows if not r[0]}) == 1
    assert T.score(nothing(spark), scorer).count() == 0


def test_labels_of_no_or_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (None, None)], "doc_id long, text string")
    for labels, want in [([], 0), ([(1, 0), (2, 0)], 0), ([(1, 1), (1, 0), (2, 1), (9, None)], 1)]:
        s = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        s.start()
        assert round(s.score("a b")) == want


def test_counts_are_of_all_texts(spark):
    df = spark.createDataFrame([("ab",), ("AB ab",), (None,), ("",)], "text string").repartition(2)
    n = {r["code"]: r["n"] for r in T.count_trigrams(df).collect()}
    a, b = T.CODE["a"], T.CODE["b"]
    assert n[(0 * T.SYMBOLS + a) * T.SYMBOLS + b] == 3 and n[(a * T.SYMBOLS + b) * T.SYMBOLS] == 3


def test_noisy_or():
    s = T.Scorer(T.CharModel(np.zeros(T.SYMBOLS**3)), {"=bad": 1.0, "worse": 2.0}, 0.1)
    s.start()
    assert s.score("a fine day") == pytest.approx(0.1) and s.score("bad day") == pytest.approx(1 - 0.9 * np.exp(-1)) and s.score("bad worsening bad") == pytest.approx(1 - 0.9 * np.exp(-3))
    assert T.wilson(10, 0) > T.wilson(3, 0) > T.wilson(3, 3)


def plain_counts(texts):
    """Letter trigrams by a loop over characters, every text by itself."""
    n = {}
    for t in texts:
        if t is None:
            continue
        codes = [0]
        for ch in "".join(t.lower()):
            c = T.CODE.get(ch, T.OTHER if ch.isalpha() else 0)
            if c or codes[-1]:
                codes.append(c)
        if codes[-1]:
            codes.append(0)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            k = (a * T.SYMBOLS + b) * T.SYMBOLS + c
            n[k] = n.get(k, 0) + 1
    return n


def test_counts_by_brute_force_at_any_partitioning(spark):
    docs = messy(spark).select("text")
    got = [{r["code"]: r["n"] for r in T.count_trigrams(docs.repartition(k)).collect()} for k in (1, 3, 16)]
    assert got[0] == got[1] == got[2]
    want = plain_counts(r["text"] for r in docs.collect())
    # beyond the letters, only what lies between two texts, which is the same for each of them
    assert {k: v for k, v in got[0].items() if k // T.SYMBOLS % T.SYMBOLS} == {k: v for k, v in want.items() if k // T.SYMBOLS % T.SYMBOLS}


def test_scores_are_those_of_one_process(spark, scorer):
    texts = [r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").filter("doc_id % 97 = 0").select("text").collect()]
    got = T.score(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), scorer).collect()
    want = {}
    for t in texts:  # no memo, one text at a time
        words = T.Restorer(scorer.model).words(t or "")
        signs = sorted(f for f in T.features(words) if f in scorer.weights)
        want[t] = 1 - (1 - scorer.base) * np.exp(-sum(scorer.weights[f] for f in signs))
    assert all(r["score"] == pytest.approx(want[r["text"]], abs=1e-12) for r in got)


def test_long_tokens_are_decoded_whole(scorer, monkeypatch):
    """Putting away what all paths agree on changes nothing, wherever the stretches end."""
    r = np.random.default_rng(3)
    for _ in range(30):
        token = "".join(r.choice(list("abdeiot1034$!.-|")) for _ in range(200))
        monkeypatch.setattr(T, "STRETCH", 10**9)
        whole = scorer.model.decode(token)
        for stretch in (1, 3, 16):
            monkeypatch.setattr(T, "STRETCH", stretch)
            assert scorer.model.decode(token) == whole
    assert "idiot" in scorer.restore.words("1" + "d" * 9000 + "10t") and "idiot" in scorer.restore.words("i " * 60 + "d i o t")


def test_signs_by_chance_are_few():
    """Labels that have nothing to do with the texts give no signs, or next to none."""
    r = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(3000)]
    rows = [(float(r.random() < 0.12), [], list(r.choice(words, 40, False))) for _ in range(1500)]
    assert len(T.learn(T.CharModel(np.zeros(T.SYMBOLS**3)), rows).weights) <= 1
    told = [(k, m, [*w, "awful"] if k else w) for k, m, w in rows]
    assert "awful" in T.learn(T.CharModel(np.zeros(T.SYMBOLS**3)), told).weights
    assert T.by_chance(0, 5, 0.3) == pytest.approx(1) and T.by_chance(5, 5, 0.3) == pytest.approx(0.3**5) and T.by_chance(1, 2, 0.5) == pytest.approx(0.75)


def test_near_copies_teach_once():
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1.0, T.sketch(text + f" end{i}"), ["a"]) for i in range(20)] + [(1.0, T.sketch("another text of its own here"), ["b"]), (0.0, T.sketch(text), ["c"]), (0.0, T.sketch(""), [])]
    assert [w for _, w in T.one_of_each(rows)] == [["a"], ["b"], ["c"], []]
