"""Main text: held-out accuracy, the given pages, odd markup; the recurrent net's gradient."""

import html
import re
from collections import Counter

import numpy as np

from auditlens.llm import extraction, html_blocks, html_training, labeller, queries
from auditlens.llm.html_blocks import blocks_of
from tests.conftest import SF


def test_held_out_accuracy():
    assert html_training.accuracy(html_training.load(), 5_000_000, 300) > 0.99


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.QUERIES["op4_main_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", " ", article)).split()) and r.n_chars == len(r.text)


A = "The harbour was built in 1832 by a company of merchants who wanted a safe place for their ships in winter."
B = "It took eleven years, cost more than twice the sum first named, and ruined two of the five partners. The others sold their shares to the town."
C = "Today about forty fishing boats use the inner basin, and in summer there are ferries to the islands every two hours."
D = "Repairs to the north wall are to begin in spring; the council has set aside money for the first part of the work only."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/c>Contact</a></li></ul>"
FOOT = "<footer><p>Copyright 2021 The Harbour Times. All rights reserved.</p><a href=/p>Privacy</a></footer>"
REMARKS = "<div class=comments><h3>2 comments</h3><div class=comment><p>My grandfather worked there, thanks for this.</p></div><div class=comment><p>When does the ferry start again?</p></div></div>"
#: Pages written by hand, none made by the generator: (html, the article's blocks).
HELD_OUT = {
    "bare text in a box": (f"<nav>{MENU}</nav><div class=\"content\">{A}<br><br>{B}<br><br>{C}</div>{FOOT}", [A, B, C]),
    "bare text in a post": (f"<div id=menu>{MENU}</div><div class=\"post-body\">{A}<br><br>{B}<br><br>{C}<br>{D}</div>{FOOT}", [A, B, C, D]),
    "boxes only": (f"<div class=topnav>{MENU}</div><div class=main><div>{A}</div><div>{B}</div><div>{C}</div></div><div class=footer>Copyright 2021 The Harbour Times</div>", [A, B, C]),
    "layout table": (f"<table width=100%><tr><td width=150 valign=top><a href=/>Home</a><br><a href=/n>News</a><br><a href=/s>Sport</a></td><td valign=top><h1>The old harbour</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table>{FOOT}", ["The old harbour", A, B, C]),
    "byline in a header": (f"<nav>{MENU}</nav><article><header><h1>The old harbour</h1><p class=byline>By Jane Roe, 3 May 2021</p></header><p>{A}</p><p>{B}</p><p>{C}</p></article>{FOOT}", ["The old harbour", A, B, C]),
    "comments in the article": (f"<header class=masthead><a href=/>The Harbour Times</a></header><article><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p>{REMARKS}</article>{FOOT}", [A, B, C, D]),
    "article": (f"<header><a href=/>The Harbour Times</a>{MENU}</header><article><h1>The old harbour</h1><p>{A}<p>{B}<p>{C}</article><aside><h3>Related</h3><a href=/x>More about ferries</a></aside>{FOOT}", ["The old harbour", A, B, C]),
    "paragraphs without a box": (f"<div class=navbar>{MENU}</div><h1>The old harbour</h1><p>{A}</p><p>{B}</p><p>{C}</p><div class=cookie-notice><p>We use cookies. Read our policy.</p><button>Accept</button></div>", ["The old harbour", A, B, C]),
    "advert and form between": (f"<main><h1>The old harbour</h1><p>{A}</p><div class=advert><p>Cheap tickets to the islands, book now!</p></div><p>{B}</p><form><label>Your mail</label><input><button>Subscribe</button></form><p>{C}</p></main>{FOOT}", ["The old harbour", A, B, C]),
    "list and table inside": (f"<nav>{MENU}</nav><article><p>{A}</p><ul><li>Inner basin: forty boats</li><li>Outer basin: ferries</li></ul><table><tr><td>1832<td>begun<tr><td>1843<td>ended</table><p>{B}</p></article>{FOOT}", [A, "Inner basin: forty boats", "Outer basin: ferries", "1832", "begun", "1843", "ended", B]),
}


def test_held_out_layouts(spark):
    """Pages by hand: no sentence of any article is lost, and of what is kept nearly all is the article."""
    rows = [(k, name, page) for k, (name, (page, _)) in enumerate(HELD_OUT.items())]
    got = {r.url: r.text.split() for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    shared = kept = wanted = 0
    for name, (_, blocks) in HELD_OUT.items():
        want, have = Counter(" ".join(blocks).split()), Counter(got[name])
        both = sum((want & have).values())
        assert both / sum(want.values()) >= 0.9 and both / max(1, sum(have.values())) >= 0.85, (name, " ".join(got[name]))
        assert all(b in " ".join(got[name]) for b in blocks if b in (A, B, C, D)), name
        shared, kept, wanted = shared + both, kept + sum(have.values()), wanted + sum(want.values())
    assert shared / wanted >= 0.98 and shared / kept >= 0.97


def test_blocks():
    texts = lambda page: [b[0] for b in blocks_of(page)]
    assert texts("") == texts("<p></p><script>x<p>y") == texts("<!-- a -->") == []
    assert texts("<p>a<b>b</b>c<br>d<p>e &amp;&nbsp; f</div>g") == ["abc d", "e & f", "g"]
    assert texts("1 < 2 <p>x<3 a='>'>y") == ["1 < 2", "x<3 a='>'>y"]
    assert texts("<title>t</title><textarea>q</textarea><P CLASS='a>b'>z\n\t z") == ["z z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["a", "b", "c", "d"]


def test_tags_without_end():
    texts = lambda page: [b[0] for b in blocks_of(page)]
    article = "<article><p>a b.</p><p>c d.</p></article><footer>e</footer>"
    rest = ["a b.", "c d.", "e"]
    assert texts(f"<datalist><option value=a><option value=b></datalist>{article}") == rest
    assert texts(f"<select><option>x<option>y</select>{article}") == texts(f"<select><option>x</option><option>y</select>{article}") == rest
    assert texts(f"<select><option>x<option>y{article}") == rest
    for name in ("button", "select", "svg", "template", "noscript"):
        assert texts(f"<div><{name}>x</{name}></div>{article}") == rest
        assert texts(f"<div><{name}></div>{article}") == texts(f"<{name}>{article}") == rest, name
        assert texts(f"<{name}>{article}<{name}>x</{name}>") == rest, name
        assert texts(f"{article}<{name}><div>x<p>y</div></{name}>") == rest, name
    assert texts(f"<svg/><svg><path d=x /><title>q</title><g><text>z</text></svg>{article}") == rest
    assert texts("<p>a<button>x</button>b</p>") == ["a", "b"] and texts(f"{article}<option>x") == rest
    assert texts(f"<title>x{article}") == []
    page = lambda lead: blocks_of(f"<body>{lead}{article}</body>")
    for lead in ("<button>", "<select>", "<svg>", "<noscript>", "<select><option>x"):
        marked = [(t, path.tolist(), own.tolist()) for t, _, path, own in page(lead)]
        assert marked == [(t, path.tolist(), own.tolist()) for t, _, path, own in page("")]


def test_deep_and_named():
    blocks = blocks_of("<nav>" + "<div>" * 100 + "a</nav>b")
    assert [b[0] for b in blocks] == ["a", "b"] and not blocks[1][2].any()
    utility = " ".join(f"u{chr(97 + k)}" for k in range(20))
    assert "cookie" in html_blocks._names("div", f' class="{utility} cookie-notice"')


def test_odd_pages(spark):
    article = "<nav><a href=x>m</a></nav><article>" + "<p>Some words of text, here.</p>" * 3000 + "</article><footer>f</footer>"
    rows = [(1, "u", None, "k"), (2, None, "", "k"), (3, "u", article, "k"), (3, "u", article, "k"), (None, "v", "<" * 2000, "k"), (4, "u", "<div>" * 3000 + "x", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extraction.with_length(extraction.main_text(df)).collect()
    assert len(out) == 6 and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert all(r.text == " ".join(["Some words of text, here."] * 3000) for r in out if r.page_id == 3)
    assert extraction.main_text(df.limit(0)).count() == 0


def test_gradient():
    rng = np.random.default_rng(3)
    pages, labels = [rng.normal(size=(n, 5)).astype(np.float32) for n in (4, 7, 1)], [np.ones(4), np.zeros(7), np.ones(1)]
    model = labeller.fit(pages, labels, epochs=60, batch=3)
    assert all(np.all((s > 0.5) == (y > 0.5)) for s, y in zip(labeller.scores(model, pages), labels))
