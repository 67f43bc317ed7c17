"""Small inputs with everything that may go wrong in a column."""

import random

MESSY = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, key string, k int, label string, digest string, kept string, tokens string, rank int, h string, `a.b` string"


def words(r, n, letters="abcdefghij"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def messy_rows(seed=0):
    """Nulls in any column, empty and blank texts, a very long text, ties, repeated rows and ids, and clashing names."""
    r = random.Random(seed)
    base = [words(r, 80) for _ in range(6)]
    texts = [None, "", "   \n\t", "x", "One two", "42 %% !!", *base, base[0], base[0], base[1].upper(), base[2] + " end", words(r, 30_000), "naïve Éa ß 漢字 ​\x1c z", base[3].replace(" ", " ", 3)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src1", "src7", None, "odd"]), None if t is None else len(t), 1, None, "x", 2, None, "d", "no", "t", 3, "h", "p") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, base[4], None, None, None, *rows[0][5:]), (7, "another text for an id seen before " + base[5], *rows[0][2:])]


def messy(spark, seed=0):
    return spark.createDataFrame(messy_rows(seed), MESSY)


def nothing(spark):
    return spark.createDataFrame([], MESSY)
