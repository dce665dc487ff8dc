import math
import random
import time

from lodestone.llm import html
from lodestone.llm.html import extract, main_text, smooth

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies and a very long text that goes on and on for a while.</div>
<article><h1>Title &amp; more</h1><p><b>First  par
agraph<br>with a break &eacute;&#233;&#x20AC; and a good many words in it.<br><p>Short.</p><div class="ad">Ad</div>
<p>Last one, long enough to be content again, with <i>tags</i> and <a href="#">links</a>.</p><form><input>Mail</form>
<section class="comments"><p>A reader's comment that is as long as any paragraph of the article itself, or longer.</p></section></article>
<aside>Side</aside><footer>&copy; x &middot; y</footer></body></html>"""
WANT = "Title & more\n\nFirst par agraph with a break éé€ and a good many words in it.\n\nShort.\n\nLast one, long enough to be content again, with tags and links."


def test_article():
    assert extract(PAGE) == WANT


def test_pages_without_article():
    body = "".join(f"<p>Paragraph {i} of the text, which has quite a few words so that it counts.</p>" for i in range(4))
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(9))
    got = extract(f"<body><div><ul>{links}</ul></div><div id='x'><div>{body}<p>End.</p></div></div><div class='footer'>Foot</div></body>")
    assert got.split("\n\n") == [f"Paragraph {i} of the text, which has quite a few words so that it counts." for i in range(4)] + ["End."]


def test_lead_beside_the_body_stays():
    line = lambda x: f"{x} is a paragraph with quite a few words in it, so that it counts as text."
    lead, body = [line("Lead")], [line(f"Part {i}") for i in range(4)]
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(9))
    p = lambda x: "".join(f"<p>{t}</p>" for t in x)
    page = f"<body><div><ul>{links}</ul></div><div><div>{p(lead)}</div><div>{p(body)}</div></div></body>"
    assert extract(page).split("\n\n") == lead + body


def test_long_link_texts_are_no_region():
    p = "".join(f"<p>Part {i} is a paragraph with quite a few words in it, so that it counts.</p>" for i in range(4))
    links = "".join(f"<p><a href='/{i}'>A headline as long as any paragraph of the text below it, number {i}.</a></p>" for i in range(2))
    assert "headline" not in extract(f"<body><div>{links}</div><div>{p}</div></body>")


def test_sibling_articles():
    part = "<article><h2>Part {0}</h2><p>This is part {0} of a text in several articles, with words enough.</p></article>"
    for wrap in ("{}", "<div>{}</div>"):
        got = extract("<body><div>" + "".join(wrap.format(part.format(i)) for i in range(3)) + "</div><div class='related'><article>Other</article></div></body>")
        assert [f"Part {i}" in got for i in range(3)] == [True] * 3 and "Other" not in got


def test_edges(spark):
    for x in (None, "", " \n", "<nav>a</nav>", "<p", "<script>x</script>", "<!-- c -->"):
        assert extract(x) == "", x
    assert extract("plain text") == "plain text"
    assert extract("<p>a&nbsp;b<p>c") == "a b\n\nc"
    assert extract("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert len(smooth([1.0] * 5)) == 5 and abs(smooth([1.0] * 5)[0] - 1) < 1e-9
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = main_text(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(WANT), len(WANT)]
    assert main_text(df.limit(0)).count() == 0


def sentence(k, words=18):
    return " ".join(f"word{k}n{i}" for i in range(words)) + "."


def plain_page(article):
    """A page of div, p and a alone, without classes."""
    menu = "".join(f"<div><a href='/{i}'>Menu entry {i}</a></div>" for i in range(8))
    facts = "".join(f"<div>Fact {i}: {i}</div>" for i in range(12))
    return f"<body><div>{menu}</div><div>{facts}</div><div>{''.join(f'<p>{x}</p>' for x in article)}</div><div><p>Contact</p><p>Imprint</p><p>Terms</p></div></body>"


def test_ratios_choose_the_region(monkeypatch):
    article = ["Title of it", *(sentence(k, 20 + 7 * k) for k in range(5)), "Short.", sentence(9, 30), "End."]
    assert extract(plain_page(article)).split("\n\n") == article
    monkeypatch.setattr(html, "smooth", lambda x, sigma=1.0: [1.0] * len(x))
    assert extract(plain_page(article)).split("\n\n") != article


def test_ratios_by_brute_force():
    r = random.Random(1)
    for n in (1, 2, 3, 4, 9, 30):
        x = [r.random() * 50 for _ in range(n)]
        w = [[math.exp(-((i - k) ** 2) / 2) * (abs(i - k) <= 3) for k in range(n)] for i in range(n)]
        want = [sum(a * b for a, b in zip(row, x)) / sum(row) for row in w]
        assert all(abs(a - b) < 1e-9 for a, b in zip(smooth(x), want))


def test_two_articles_and_parts():
    a, b = f"<p>{sentence(1)}</p>", f"<p>{sentence(2)}</p>"
    for page in (f"<article>{a}</article><article>{b}</article>", f"<div>{a}</div><div>{b}</div>", f"<main><section>{a * 12}</section><section><p>x</p>{b}</section></main>"):
        assert extract(page).endswith(sentence(2)) and extract(page).startswith(sentence(1))


def test_class_names_on_the_text():
    body = "".join(f"<p>{sentence(k)}</p>" for k in range(3))
    want = "\n\n".join(sentence(k) for k in range(3))
    for name in ("post share-price", "entry notice", "story header", "navy-news", "article-modal", "search-and-rescue", "share", "header"):
        assert extract(f"<article class='{name}'>{body}</article>") == want, name
        assert extract(f"<body><div class='{name}'>{body}</div></body>") == want, name
        if name not in ("share", "header"):
            assert extract(f"<article><p>{sentence(8)}</p><div class='{name}'>{body}</div></article>") == f"{sentence(8)}\n\n{want}", name
    for name in ("ad", "site-footer", "cookie-notice", "big social-links", "comment-list", "ad-top-2"):
        assert extract(f"<article>{body}<div class='{name}'>{body}</div></article>") == want, name
    assert extract(f"<article><p>One <span class='ad'>advert</span>two.</p>{body}</article>") == f"One two.\n\n{want}"


def test_depth_and_length_take_linear_time():
    for page in ("<div>" * 60_000 + sentence(1) + "</div>" * 60_000, "<p>" + "<b>" * 20_000 + sentence(1) + "</i>" * 20_000, f"<p>{sentence(1)}</p>" * 20_000):
        start = time.process_time()
        assert extract(page).startswith(sentence(1))
        assert time.process_time() - start < 8
