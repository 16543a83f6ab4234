import math
import time

import numpy as np
import pytest

from terrane.llm import html_extract
from terrane.llm.html_extract import extract_pages, main_text, ratios, smoothed

LONG = "Sentence after sentence of plain prose fills this block without any markup in it. " * 3
LONG = LONG.strip()


def plain_smoothed(values, sigma):
    """Every line as a weighted mean of the lines around it."""
    out = []
    reach = int(3 * sigma) + 1
    for i in range(len(values)):
        near = [(j, math.exp(-0.5 * ((i - j) / sigma) ** 2)) for j in range(len(values)) if abs(i - j) <= reach]
        out.append(sum(values[j] * w for j, w in near) / sum(w for _, w in near))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
@pytest.mark.parametrize("sigma", [0.5, 1.0, 2.5])
def test_smoothing(n, sigma):
    values = np.random.default_rng(n).random(n) * 50
    assert np.allclose(smoothed(values, sigma), plain_smoothed(values, sigma))


def test_ratios():
    page = html_extract._Lines()
    page.read("<p>one <b>two</b> <i>three</i></p><p>four</p>plain<nav><a>menu</a></nav>")
    # the end of a block counts for what follows it, if that is text; a left-out line has no text
    assert [(x.text, x.tags) for x in page.lines] == [("one two three", 5), ("four", 1), ("plain", 1), ("", 3)]
    assert np.allclose(ratios(page.lines), [13 / 5, 4 / 1, 5 / 1, 0])


DIVS = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div><div><a href=3>More</a></div></body>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (DIVS, f"Title\n{LONG}\nShort.\n{LONG}"),  # no article, no names
        (f"<table><tr><td><a href=1>a</a><td><p>{LONG}<p>Short.<p>{LONG}</table>", f"{LONG}\nShort.\n{LONG}"),
        (f"<body><article><h2>Teaser</h2></article><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"{LONG}\n{LONG}"),  # the text is not in the article
        (f"<body><form action=x><article><h1>T</h1><p>{LONG}</p></article><input name=q><button>Go</button></form></body>", f"T\n{LONG}"),
        (f"<body><form><div><p>{LONG}</p><p>Short.</p></div></form><form>Your mail <input></form></body>", f"{LONG}\nShort."),
        (f"<article><p>{LONG}</p><form><p>Write to us</p><input></form></article>", LONG),
        (f"<article><p>{LONG}</p><div class='related-work'>Other studies.</div><div class='related-posts'>Read on</div></article>", f"{LONG}\nOther studies."),
        (f"<article><p>{LONG}<![CDATA[ x ]]></p><![ x><![foo[<p>After</p></article>", f"{LONG}\nAfter"),
        (f"<article><p title='a > b'>{LONG}</p><p class=>x</p><p id=\"a'b\">y</p></article>", f"{LONG}\nx\ny"),
        (f"<article><p>{LONG}</p><!-- left open <p>After</p></article>", f"{LONG}\nAfter"),
        (f"<body><div><p>{LONG}</p></div><div>Copyright of somebody</div></body>", LONG),
        (f"<main><article><h1>A</h1><p>{LONG}</p></article><article><h1>B</h1><p>{LONG}</p></article></main>", f"A\n{LONG}\nB\n{LONG}"),
    ],
)
def test_page(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [DIVS, f"<article><p>{LONG}</p></article>"])
def test_ratios_decide(page, monkeypatch):
    whole = main_text(page, sigma=0.3)
    assert whole == main_text(page)
    monkeypatch.setattr(html_extract, "ratios", lambda lines: np.zeros(len(lines)))
    assert main_text(page, sigma=0.3) == ""
    monkeypatch.setattr(html_extract, "ratios", lambda lines: np.array([100.0 if x.text in ("Home News", "More") else 0.0 for x in lines]))
    assert main_text(page, sigma=0.3) != whole


N = 50_000
HOSTILE = {
    "open tags": "<a " * N, "open quotes": '<p a="' * N, "odd quotes": '<p a="' * N + ">", "all ends quoted": '<a b=">c"' * N, "other quotes": "<a b='" * N + ">x",
    "comments": "<!--" * N, "short comments": "<!-->x" * N, "sections": "<![ x" * N, "named sections": "<![foo[" * N + ">", "stray ends": "<b>" * N + "</i>" * N,
    "blocked ends": "<i><div>" + "<b>" * N + "</i>" * N, "paragraphs in bold": "<b>" * N + "<p>x" * N, "nested": "<div>" * N + "x", "articles in a form": "<form>" + "<b>" * N + "<article>x" * N,
    "scripts": "<script>" * N, "script ends": "<script>" + "</" * N, "less": "<" * N, "references": "&#" * N, "equals": "<a " + "=" * N + ">", "menus": "<nav><article>" * N,
    "ends": "</" * N + ">", "blanks": "<a " + " " * N + "b" + " " * N + '="' * N + ">", "titles": "<div><h1>" * N, "instructions": "<?" * N, "late titles": "<div>" * N + "<h1></h1>" * N,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages(name):
    main_text("<p>x</p>")
    began = time.process_time()
    main_text(HOSTILE[name])
    assert time.process_time() - began < 3  # well under one second alone; a test run shares its cores


def test_broken_pages_do_not_fail_the_job(spark):
    pages = ["<![ x", "<p>a<![foo[<p>b", "<p a=\"<p>c", None, ""]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    assert {r["page_id"]: r["text"] for r in extract_pages(df).collect()} == {0: "", 1: "ab", 2: "c", 3: "", 4: ""}
