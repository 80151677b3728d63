"""The page operator against pages with a known truth and against a plain tree walk."""

import random
import time
from html.parser import HTMLParser

from strataflow.llm import html_text

DATA = "/root/testdata/sf0.01/pages.parquet"


def flat(*blocks):
    return "\n\n".join(" ".join(b.split()) for b in blocks)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeß&<é") for _ in range(rng.randint(1, 8))) for _ in range(n))


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("ß", "&szlig;")


def page_with_truth(rng):
    """A page built around its main text: (html, text)."""
    truth, body = [], []
    noise = [
        '<aside><p>{}</p></aside>', '<div class="ad-slot top">{}</div>', '<nav><ul><li><a href=x>{}</a></ul></nav>', '<form><input value=x>{}<select><option>a<option>b</select></form>',
        '<div role="dialog">{}</div>', '<script>var x = "<p>{}</p>";</script>', "<style>p{{}}</style>", '<section class="related-posts"><h3>{}</h3></section>', '<p hidden>{}</p>',
        "<!-- <p>{}</p> -->", '<div id="newsletter-signup"><p>{}</div>', '<div style="display: none">{}</div>', '<ul class="share-buttons"><li>{}</ul>',
    ]
    for _ in range(rng.randint(1, 12)):
        kind, text = rng.randrange(7), words(rng, rng.randint(1, 60))
        if kind == 0:
            body.append(rng.choice(noise).format(escaped(text)))
        elif kind == 1:
            level = rng.randint(1, 6)
            truth.append(text)
            body.append(f'<h{level}><a href="#x">{escaped(text)}</a></h{level}>')
        elif kind == 2:
            items = [words(rng, 3) for _ in range(rng.randint(1, 4))]
            truth += items
            body.append("<ul>" + "".join(f"<li>{escaped(x)}" + rng.choice(["", "</li>"]) for x in items) + "</ul>")
        elif kind == 3:
            a, b = words(rng, 2), words(rng, 2)
            truth.append(f"{a} {b}")
            body.append(f"<table><tr><td>{escaped(a)}<td>{escaped(b)}</table>")
        elif kind == 4:
            truth.append(text)
            body.append(f'<section id="related-work" class="social-history"><p>{escaped(text)}</section>')
        else:
            truth.append(text)
            half = len(text) // 2
            body.append(f"<p>{escaped(text[:half])}<b>{escaped(text[half:])}</b>" + rng.choice(["", "</p>"]))
    wrap = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div class=has-sidebar><main>{}</main></div>"])
    outer = rng.choice(noise).format(escaped(words(rng, 20)))
    comments = f"<div id=comments><article><p>{escaped(words(rng, 30))}</p></article></div>"
    page = f"<!doctype html><html><head><title>t</title></head><body><header><h1>site</h1></header>{outer}{wrap.format(''.join(body))}{comments}<footer>&copy; x</footer></body></html>"
    return page, flat(*truth)


def test_pages_with_a_known_truth():
    rng = random.Random(11)
    for _ in range(400):
        page, truth = page_with_truth(rng)
        assert html_text.main_text(page) == truth, page


class Tree(HTMLParser):
    """Blocks of the article, by a plain walk over tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], []

    def flush(self):
        line = " ".join("".join(self.now).split())
        if line:
            self.blocks.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "li", "div", "ul", "article"):
            self.flush()
            if "p" in self.stack:
                del self.stack[self.stack.index("p") :]
        if tag in ("br", "td"):
            self.now.append(" ")
        if tag not in ("br", "meta", "img"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "div", "ul", "article"):
            self.flush()
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if "article" in self.stack:
            self.now.append(data)


def test_whole_table_against_a_plain_walk(spark):
    pages = spark.read.parquet(DATA)
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        tree = Tree()
        tree.feed(r.html)
        tree.flush()
        assert got[r.page_id].text == "\n\n".join(tree.blocks) and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == pages.count()


def test_the_distribution_decides_inside_articles_and_out():
    prose = "<p>" + "some prose " * 12 + "</p>"
    menu = "<ul>" + "".join(f"<li><a href={i}>topic {i}</a>" for i in range(6)) + "</ul>"
    text = ("some prose " * 12).strip()
    assert html_text.main_text(f"<article>{prose}{menu}{prose}</article>") == flat(text, text)
    assert html_text.main_text(f"{prose}<div>{menu}</div>{prose}") == flat(text, text)
    one = f"<article>{prose}<p><a href=x>one link</a></p>{prose}<p><a href=y>last link</a></article>"
    assert html_text.main_text(one) == flat(text, "one link", text, "last link")
    assert html_text.main_text(one, window=1) == flat(text, text)
    assert html_text.main_text(f"<article>{menu}</article>") == flat(*(f"topic {i}" for i in range(6)))
    long = "<p>" + "outside text of the page " * 60 + "</p>"
    assert html_text.main_text(f"{prose}<article><p>teaser</p></article>") == flat("teaser")
    assert html_text.main_text(f"<article><p>a short teaser of it</p></article><div>{long}</div>") == flat("a short teaser of it", "outside text of the page " * 60)


def test_valid_pages_lose_nothing():
    page = '<article><section id="related-work"><p>Prior art</p></section><div class="social-history"><p>hist</p></div><p>end</p></article>'
    assert html_text.main_text(page) == flat("Prior art", "hist", "end")
    assert html_text.main_text("<form><datalist><option value=1><option value=2></datalist></form><article><p>kept</article>") == "kept"
    assert html_text.main_text("<b><article>text</b> goes on</article>") == "text goes on"
    assert html_text.main_text("<article><a name=top><p>not a link</p><p>nor this</p></article>") == flat("not a link", "nor this")
    assert html_text.main_text("<ul><li class=ad>x<li>long enough text to be kept here, with more than eighty characters in all of its line</ul>").startswith("long enough")


def test_odd_and_long_pages_cost_linear_time():
    for page in ("<article><p>x</p>" + "</div>" * 100_000, "<head>" * 100_000 + "x", "<p><b>" * 100_000, "<a href=x><div>" * 60_000 + "</a>" * 60_000, "<a '" * 100_000, "<li>" * 100_000, "<!--" * 100_000, "&#x41;" * 200_000):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 3, page[:20]
    long = "".join(f"<p>paragraph {i} of a long page</p>" for i in range(50_000))
    assert html_text.main_text(f"<article>{long}</article>").count("\n\n") == 49_999


def test_clashing_columns_nulls_and_nothing(spark):
    rows = [(1, "u", "<p>x</p>", "a", 3, "t"), (None, None, None, None, None, None), (1, "u", "<p>x</p>", "a", 3, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, weight string")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in html_text.extract_pages(df).collect())
    assert got == [("1", "u", "x", 1), ("1", "u", "x", 1), ("None", None, "", 0)] and html_text.extract_pages(df.limit(0)).count() == 0
