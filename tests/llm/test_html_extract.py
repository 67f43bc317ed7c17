import html
import random
import re
import time

import pytest

from plumbline.llm import boosting
from plumbline.llm import html_extract as H

LONG = "The storm reached the coast late on Monday, and by the evening the harbour was closed. Nobody was hurt, officials said, but several boats were lost. "


@pytest.fixture(scope="module")
def extract():
    return H.train()


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,want",
    [
        (f"<nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></article><footer>&copy; site</footer>", ["Title", LONG, LONG]),
        (f'<div class="menu"><a href=/>Home</a> | <a href=/b>About</a></div><div class="content"><p>{LONG}</p><p>{LONG}</p></div><div id="footer">Copyright site</div>', [LONG, LONG]),
        (f"<article><p>{LONG}</p><ul><li>First thing to know<li>Second thing to know</ul><p>{LONG}</p></article><section class=comments><h3>Comments</h3><div class=comment><p>Great piece, thanks a lot for it.</p></div></section>", [LONG, "First thing to know", "Second thing to know", LONG]),
        (f'<article><p>A &amp; B&nbsp;&eacute; <b>bold</b>\n\n text<br>next {LONG}</p><p>{LONG}<!-- c --></p><div class="ad">Buy this now</div></article>', [f"A & B é bold text next {LONG}", LONG]),
        (f"<form><label>Name</label><input name=x><button>Go</button></form><main><p>{LONG}</p><p>{LONG}</p></main><aside><h3>Related</h3><ul><li><a href=/x>Other story</a></li></ul></aside>", [LONG, LONG]),
        (f'<header><div>Site name</div><ul><li><a href=/>Home</a></li></ul></header><article><header><h1>Title</h1><p class="byline">Ann Writer, 3 May</p></header><p>{LONG}</p><table><tr><td>one</td><td>two</td></tr></table></article><footer><p>{LONG}</p></footer>', ["Title", "Ann Writer, 3 May", LONG, "one", "two"]),
        (f'<div id=wrap><div id="cookie-notice"><p>We use cookies to do things. Accept all of them.</p></div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', ["Title", LONG, LONG, LONG]),
    ],
)
def test_layouts(extract, body, want):
    assert extract([page(body)])[0] == "\n\n".join(" ".join(w.split()) for w in want)


@pytest.mark.parametrize("text,want", [("", ""), ("just text", "just text"), ("<", "<"), ("<p>a<p>b", None), ("<div" * 50, None), ("</p></p></x>", None), ("<a href='x", None), ("<!-- open", ""), ("<script>x", ""), ("a<b>c</b>", "ac")])
def test_broken(extract, text, want):
    got = extract([text])[0]
    assert isinstance(got, str) and (want is None or got == want)


ARTICLE = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>"
WANT = "\n\n".join(["T", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize(
    "before",
    [
        "<datalist><option value=a>one<option value=b>two</datalist>", "<select><option>A<option>B", "<audio src=x>", "<video src=x>no video here", "<object data=x>", "<!-->", "<!--->", "<!-- a --!>",
        "<template><div><template>inner</template>leak</div></template>", "<svg><title>x</title><path d='a'/></svg>", "<iframe src=x></iframe>", "<title>abc", "<p title=don't>", "<noscript><p>Please enable JavaScript.</p></noscript>",
        "<textarea>unfinished", "</ 3 >", "<canvas>", "<script>if (a < b) x = '<p>'</script >",
    ],
)
def test_article_survives(extract, before):
    """Nothing that is left open, or odd, before an article costs it its text."""
    assert extract([f"<html><body>{before}{ARTICLE}</body></html>"])[0] == WANT


NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav>"


def test_short_articles_and_links(extract):
    assert extract([NAV + "<div class=story><p>Short one.</p></div>"])[0] == "Short one."
    see = "<p>See also: <a href=/x>Another story of the sea</a></p>"
    for tag in ("article", "div class=story", "div"):
        got = extract([f"<html><body>{NAV}<{tag}><h1>T</h1><p>{LONG}</p>{see}<p>{LONG}</p></{tag.split()[0]}><footer>&copy; site</footer></body></html>"])[0]
        assert got.split("\n\n") == ["T", LONG.strip(), "See also: Another story of the sea", LONG.strip()]


def test_formatting_outlives_blocks_and_cells_hold():
    blocks = lambda p: ["".join(t for _, t in b) for b in H.parse(p).blocks]
    assert blocks("<p>a <b>b</p><p>c</b> d</p>") == ["a b", "c d"]
    assert blocks("<div><table><tr><td>a</div>b<td>c</table>d</div>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<p>a<script>x</script>b <select><option>o</select>c</p>") == ["ab c"]
    assert blocks('<p title="a>b" class=x>c</p>') == ["c"] and blocks("a < b <p>c") == ["a < b ", "c"]


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "<p>{}</p>" + "</div>" * 100_000, "<b><i><div>" * 30_000 + "<p>{}</p>" + "</x></b>" * 30_000, "<iframe>" * 100_000 + "<p>{}</p>", "<a b=\"" * 50_000 + "><p>{}</p>", "<!--" * 50_000 + "--><p>{}</p>"])
def test_linear_time(extract, page):
    start = time.time()
    got = extract([page.format(LONG)])[0]
    assert got in ("", LONG.strip()) and time.time() - start < 60


def test_unseen_tokens(extract):
    """Pages whose classes all are words that no training page has."""
    r, score = random.Random(99), []
    for _ in range(80):
        p = re.sub(r'(class|id)="?[^">]*"?', lambda m: f'{m[1]}="zq{r.randint(0, 999)}"', H.synthetic_page(r))
        d, main, rest = H.labelled_page(p)
        got = extract([p.replace(H.MAIN, "").replace(H.REST, "")])[0]
        want = max(1, main[0])
        score.append(abs(len(got.replace("\n\n", "")) - want) / want < 0.15)
    assert sum(score) / len(score) > 0.75


def test_given_pages(spark):
    """The article element of the given pages, by its markup, is what comes out."""
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in H.op7_html_extract(spark, d).collect()}
    assert set(got) == set(pages)
    for i, h in pages.items():
        inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|ul|li|div|blockquote)\b[^>]*>", inner)]
        assert got[i]["text"] == "\n\n".join(b for b in blocks if b) and got[i]["n_chars"] == len(got[i]["text"])


def test_held_out_layouts(extract):
    r, score = random.Random(4242), []
    for _ in range(150):
        p = H.synthetic_page(r)
        mode, want = H.MAIN, set()
        for b in H.parse(p).blocks:
            t = ""
            for _, x in b:
                for m in (H.MAIN, H.REST):
                    mode = m if m in x else mode
                t += x if mode == H.MAIN else ""
            t = " ".join(t.replace(H.MAIN, "").replace(H.REST, "").split())
            want |= {t} if t else set()
        got = set(filter(None, extract([p.replace(H.MAIN, "").replace(H.REST, "")])[0].split("\n\n")))
        score.append(2 * len(got & want) / max(1, len(got) + len(want)))
    assert sum(score) / len(score) > 0.95


def test_no_contradiction():
    r = random.Random(1)
    d = H.parse(H.synthetic_page(r))
    import numpy as np

    x, text = H.node_features(d, {})
    for seed in range(20):
        kept = H.keep(d, np.random.default_rng(seed).normal(0, 2, len(x)), text)
        assert all(not kept[i] or kept[d.parent[i]] for i in range(1, len(kept)))


def test_keep_is_optimal():
    import itertools

    import numpy as np

    d = H.parse("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    n = len(d.tag)
    _, text = H.node_features(d, {})
    for seed in range(30):
        m = np.random.default_rng(seed).normal(0, 2, n)
        cost = lambda k: sum((np.logaddexp(0, -m[i]) if k[i] else np.logaddexp(0, m[i])) * (text[i] > 0) for i in range(1, n))
        ok = [k for k in itertools.product([False, True], repeat=n) if k[0] and all(not k[i] or k[d.parent[i]] for i in range(1, n))]
        assert cost(H.keep(d, m, text)) == pytest.approx(min(map(cost, ok)))


def test_boosting_learns():
    import numpy as np

    g = np.random.default_rng(0)
    x = g.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((boosting.Boosted().fit(x, y).margin(x) > 0) == y).mean() > 0.97


def test_columns_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, "", "old"), (2, "<p>A short, but whole sentence of it.</p>", None)], "page_id int, html string, text string")
    got = H.extract(df)
    assert got.columns == ["page_id", "html", "text"] and sorted(r["text"] for r in got.collect()) == ["", "", "A short, but whole sentence of it."]
    assert H.extract(df.limit(0)).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    p = f"<article><p>{LONG}</p></article>"
    df = spark.createDataFrame([(1, p, None, 7, "n"), (1, p, None, 7, "n"), (None, p, "u", None, None)], "page_id int, html string, url string, n_chars int, `a.b` string")
    got = H.extract(df).collect()
    assert [(r["page_id"], r["n_chars"], r["a.b"], r["text"]) for r in got] == [(1, 7, "n", LONG.strip())] * 2 + [(None, None, None, LONG.strip())]


def test_long_page(extract):
    body = "".join(f"<p>{LONG}</p>" for _ in range(3000))
    assert extract([page(f"<article>{body}</article>")])[0].count("\n\n") == 2999
