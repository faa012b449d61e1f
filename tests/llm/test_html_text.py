import random
import time

from mergestone.llm import html_text as H
from mergestone.llm.html_labels import LABELLED


def kept(page):
    found = H.blocks(page)
    return [b[0] for b, k in zip(found, H.trained().predict(H.features([b[1] for b in found]))) if k]


def test_the_tree_fits_its_table():
    for page, main in LABELLED:
        got = kept(page)
        assert all(g.startswith(main) for g in got) and all(any(g.startswith(m) for g in got) for m in main), (got, main)


HELD_OUT = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><div class="skip-link"><a href="#c">Skip to content</a></div><header class="site-header"><p>The site of all sites for readers.</p></header>
<nav class="menu"><ul><li><a href="/x">X</a><li><a href="/y">Y &amp; Z</a></ul></nav>
<div id="cookie-banner">This site uses cookies. <a href="/c">Learn more</a></div><!-- ad 3 --><div class="ad">Od voet sen.</div>
<article class="post"><h1>Head &eacute; line</h1><p><b>First&nbsp;text <i>o</i>ne.<br><p>2 &lt; 3 &#38; 5&#x3e;4.</p><p>Third <a href="#">linked</a> bit.</p>
<form><p>Write to the editors and they will write back.</p></form><div class="advertisement"><p>New soap for all your linen needs, whatever they are.</p></div><p>Last.</p></article>
<aside id="sidebar"><p>Something on the side of the page that no reader wants.</p></aside>
<div id="comments"><div class="comment"><p>I was there and saw it all with my own eyes, and it was not so.</p></div></div>
<footer>&copy; h.example &middot; A long line of words that stands at the end.</footer></body></html>"""


def test_a_page_that_is_not_in_the_table():
    assert kept(HELD_OUT) == ["Head é line", "First text one.", "2 < 3 & 5>4.", "Third linked bit.", "Last."]


def test_odd_pages():
    assert H.blocks("") == [] and H.blocks("<script>never closed") == [] and H.blocks("<!-- x") == []
    assert [b[0] for b in H.blocks("a < b <br> c<p hidden>no</p>")] == ["a < b c"]
    long = "<article>" + "<p>word one two.</p>" * 20000 + "</article>"
    assert len(kept(long)) == 20000


def made(rng):
    """A page from blocks of known kinds, and the text that a reader of the whole page would keep."""
    word = lambda: "".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "!", "?"])
    main = []

    def paragraph(name):
        text = say(rng.randint(3, 40))
        main.append(text + (" & <b>" if rng.random() < 0.2 else ""))
        inner = text.replace(" ", rng.choice([" ", "\n  ", "&#32;"]), 1) + (" &amp; &lt;b&gt;" if main[-1] != text else "")
        return f"<{name}>{inner}" + (f"</{name}>" if name != "p" or rng.random() < 0.8 else "")

    away = [
        lambda: f'<nav><ul>{"".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(4))}</ul></nav>', lambda: f'<div class="advert">{say(9)}</div>', lambda: f"<aside><p>{say(12)}</p></aside>",
        lambda: f"<footer>{say(15)}</footer>", lambda: f"<form><p>{say(20)}</p><input name='q'></form>", lambda: f"<script>var a = '<p>{say(5)}</p>';</script>", lambda: f"<!-- {say(4)} -->",
        lambda: f'<section class="comments"><p>{say(30)}</p></section>', lambda: f"<style>p::after {{content: '{say(2)}'}}</style>", lambda: f'<div id="cookie-notice">{say(9)}</div>',
    ]
    before, inside, after = ([a() for a in rng.sample(away, rng.randint(0, 4))] for _ in range(3))
    parts = [paragraph("h1"), *(paragraph(rng.choice(["p", "p", "p", "h2", "blockquote"])) for _ in range(rng.randint(1, 12)))]
    for x in inside:
        at = rng.randint(1, len(parts))
        parts.insert(at, x)
    wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", '<div class="post">%s</div>'])
    return f"<html><head><title>{say(3)}</title></head><body>{''.join(before)}{wrap % ''.join(parts)}{''.join(after)}</body></html>", main


def test_pages_of_known_text():
    rng = random.Random(7)
    for _ in range(400):
        page, main = made(rng)
        assert kept(page) == main, page


def test_broken_markup_takes_time_in_proportion():
    n = 40_000
    began = time.thread_time()
    for page in ('<a x="' * n, ('<a x="' * 9 + ">") * (n // 9), "<a x=\"' " * n + ">", "<div>" * n + "</p>" * n, "<svg>" * n, "<head>" * n, "<div><td>" * n, "<span>" * n + "<div>x" * n, "<!x " * n, "<" * n):
        H.blocks(page)
    assert time.thread_time() - began < 60
    assert [b[0] for b in H.blocks('<p title="a>b">one</p><p title="two>three</p>')] == ["one", "three"]


def test_a_page_without_names():
    page = H.without_names(LABELLED[0][0])
    assert "<article" not in page and "class=" not in page and len(H.blocks(page)) == len(H.blocks(LABELLED[0][0]))


def test_elements_that_are_not_closed():
    body = "<article><p>One two three.</p><p>Four five six.</p></article>"
    head = '<head><meta charset="utf-8"><title>T</title><style>p{}</style><script>var b="<p>no</p>";</script>'
    want = ["One two three.", "Four five six."]
    for page in (f"<html>{head}</head><body>{body}</body></html>", f"<html>{head}<body>{body}", f"<html>{head}{body}", f"<html>{head}<body>{body}<p hidden></head></p>"):
        assert [b[0] for b in H.blocks(page)] == want
    for tag in ("title", "noscript", "svg", "template", "iframe", "object"):
        assert [b[0] for b in H.blocks(f"<{tag} class='x'>{body}")] == want
        assert [b[0] for b in H.blocks(f"<{tag}>no</{tag}>{body}<{tag}>")] == want
    assert [b[0] for b in H.blocks(f"{body}<style>never closed")] == want


def test_extract(spark):
    rows = [(1, "u", HELD_OUT, "x"), (1, "u", HELD_OUT, "x"), (2, None, None, "x"), (None, "v", "", "y"), (3, "w", "<nav><a>only</a></nav>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = sorted(map(tuple, H.extract_text(df).select("page_id", "url", "text").collect()), key=str)
    text = "\n\n".join(kept(HELD_OUT))
    assert got == sorted([(1, "u", text), (1, "u", text), (2, None, ""), (None, "v", ""), (3, "w", "")], key=str)
    assert H.extract_text(df.limit(0)).count() == 0


def test_menus_with_names_of_main_parts_go():
    for name in ("main-menu", "main-nav", "nav-content", "menu-text", "breadcrumb-content", "subscribe-content", "login-main", "form-text", "modal-body", "popup-content"):
        words = "The harbour was quiet when the boats came in, and nobody spoke of the storm that had kept them away. " * 4
        page = f'<html><body><div class="{name}"><a href="/">Home</a> <a href="/a">About us</a><p>Please log in</p></div><article><p>{words}</p></article></body></html>'
        assert kept(page) == [words.strip()], name


def test_open_tags_take_time_in_proportion():
    for piece in ("<a <b ", "<a x='", '<a "<b '):
        began = time.time()
        H.blocks(piece * 40_000)
        assert time.time() - began < 20, piece
