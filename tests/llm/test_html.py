"""Main text of pages: labelled pages, the cut against all labellings."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from tidewatch.llm import queries
from tidewatch.llm.html import FORMS, extract_text, fit_forms, minimum_cut, page_text

#: Every page's main text is what stands in capitals; the rest is to go.
PAGES = [
    "<html><head><title>t</title><style>p{}</style><script>var a='</p><p>x';</script></head><body><header><h1>site</h1><a href=/>home</a></header>"
    "<nav><ul><li><a href=/a>one</a></li></ul></nav><article><h1>TITLE</h1><p>FIRST <b>BOLD</b> &amp; MORE.</p><aside><p>see also this long sentence.</p></aside><p>SECOND.</p></article>"
    "<section id=comments><article><p>I liked this a lot, thanks.</p></article></section><footer>&copy; x</footer></body></html>",
    "<body><div class='cookie-notice'><p>We use cookies to make this better for you.</p></div><div class=\"page with-sidebar\"><div class='sidebar'><h2>popular</h2><p>some long teaser text here.</p></div>"
    "<main><h1>HEAD</h1><p>ONE PARAGRAPH OF TEXT.<p>ANOTHER ONE<br>AFTER A BREAK.<ul><li>ITEM A<li>ITEM B</ul><form action=x><label>mail</label><input><button>send</button></form><p>LAST&nbsp;ONE.</main></div></body>",
    "<div id=menu><a href=1>a</a> | <a href=2>b</a></div><div class='post'><header class='entry-header'><h1>HEADING</h1></header><div>TEXT IN A DIV, LONG ENOUGH TO READ.</div>"
    "<div class='ad'>buy this thing, it is very good and cheap.</div><div>MORE TEXT IN A DIV.</div><blockquote>A QUOTE.</blockquote><div class=comment-list><div>nice</div></div></div>",
    "<p>NO MARKUP AROUND THIS PARAGRAPH, WHICH IS LONG ENOUGH TO BE READ AS TEXT.</p><p>NOR AROUND THIS ONE, WHICH IS ABOUT AS LONG AS THE ONE BEFORE.</p><ul><li><a href=1>a</a></li><li><a href=2>b</a></li></ul>",
    "<form id=aspnet><div class=banner>top</div><article><h2>A</h2><table><tr><td>CELL ONE<td>CELL TWO</table><p hidden>not shown</p><!-- <p>x</p> --><p>B &lt;C&gt; &#8364;.</p></article></form>",
    "<article><p>OPEN <span>SPAN<p>NEXT</article><footer><p>all rights reserved by someone.</p></footer><p class=\"advert\">x > y</p>",
]
WANT = [
    "TITLE\nFIRST BOLD & MORE.\nSECOND.",
    "HEAD\nONE PARAGRAPH OF TEXT.\nANOTHER ONE AFTER A BREAK.\nITEM A\nITEM B\nLAST ONE.",
    "HEADING\nTEXT IN A DIV, LONG ENOUGH TO READ.\nMORE TEXT IN A DIV.\nA QUOTE.",
    "NO MARKUP AROUND THIS PARAGRAPH, WHICH IS LONG ENOUGH TO BE READ AS TEXT.\nNOR AROUND THIS ONE, WHICH IS ABOUT AS LONG AS THE ONE BEFORE.",
    "A\nCELL ONE\nCELL TWO\nB <C> €.",
    "OPEN SPAN\nNEXT",
]
SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS text", "'y' AS body", "1 AS own_id", "2 AS n_chars")
    return sorted(map(tuple, extract_text(df.repartition(3)).collect()), key=str)


def test_labelled_pages(spark):
    got = extracted(spark, [(i, f"u{i}", h) for i, h in enumerate(PAGES)])
    assert got == [(i, f"u{i}", t) for i, t in enumerate(WANT)]


def test_odd_pages(spark):
    """Nulls, empty pages, repeated rows, broken markup, references without a semicolon, an empty table."""
    rows = [(None, None, None), (1, None, ""), (2, "u", PAGES[0]), (2, "u", PAGES[0]), (3, "u", "<"), (4, "u", "<article>a < b &amp <p class='x>y"), (5, "u", "<article><!-- open <p>A"), (6, "u", "</div></p><main>A</nav>B</main>")]
    got = {str((a, c)) for a, _, c in extracted(spark, rows)}
    assert {str((None, "")), str((1, "")), str((2, WANT[0])), str((5, "")), str((6, "A\nB"))} <= got
    assert len(extracted(spark, rows)) == len(rows)
    assert any(a == 4 and c.startswith("a < b &") for a, _, c in extracted(spark, rows))
    assert extracted(spark, []) == []


def cost(odds, edges, labels):
    return sum(abs(o) for o, x in zip(odds, labels) if (o > 0) != x and o) + sum(w for a, b, w in edges if labels[a] != labels[b])


@pytest.mark.parametrize("seed", range(3))
def test_cut_against_all_labellings(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.randrange(1, 11)
        odds = [rng.choice([0.0, 0.5, -0.5, 1.0, -1.0, rng.uniform(-3, 3)]) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([0.35, 0.7, 1.5, rng.uniform(0, 2)])) for _ in range(rng.randrange(3 * n))]
        edges = [e for e in edges if e[0] != e[1]]
        got = minimum_cut(odds, edges)
        every = [(cost(odds, edges, x), x) for x in itertools.product([False, True], repeat=n)]
        least = min(c for c, _ in every)
        assert cost(odds, edges, got) == pytest.approx(least, abs=1e-4)
        assert all(g or not x for c, best in every if c < least - 1e-9 for g, x in zip(got, best))


def test_long_page():
    """Thirty thousand blocks whose elements say nothing, odds on either side."""
    page = "".join(f"<div>{'long text of a block that may be read, ' * (i % 3)}w{i}.</div>" for i in range(30_000))
    odds = fit_forms(np.zeros((FORMS, 2)))
    assert len(page_text(f"<body><main>{page}</main>", odds).split("\n")) == 30_000
    assert len(page_text(f"<body>{page}", odds).split("\n")) > 10_000


def test_forms_follow_their_counts():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (FORMS, 2)).astype(float)
    counts[: FORMS // 6, 1] *= 20  # paragraphs are content
    odds = fit_forms(counts)
    assert odds[: FORMS // 6].min() > odds[FORMS // 6 : FORMS // 3].max()
    assert np.abs(odds).max() <= 3


def test_query_equals_its_sql(spark, tmp_path):
    body = "<article><h1>T&amp</h1><p><b>A &amp;amp; &quot;b&quot;\n c.<br><p>é  日本</p></article>"
    rows = [(i, f"http://h/{i}", f"<body><nav><li><a href=/>m{i}</a></li></nav><div class=\"ad\">x y.</div>{body if i % 4 else '<article></article>'}<footer>f</footer>") for i in range(40)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    want = db.sql(queries.oracle_sql()["op13_html_text"])
    assert sorted(map(str, map(tuple, queries.op13_html_text(spark, str(tmp_path)).select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
