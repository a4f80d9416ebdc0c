"""The op9 query on its own table: blocks are two line ends apart."""

import random
from html.parser import HTMLParser

import pytest

from gridloom.llm import html_text


def test_query_joins_blocks_by_two_line_ends(spark, tmp_path):
    page = "<body><nav>Home</nav><article><h1>Head</h1><p>One<p>Two</article><footer>foot</footer></body>"
    spark.createDataFrame([(1, "u", page), (2, "v", "<article><p>alone</article>"), (3, "w", None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = html_text.op9_html_text(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [("Head\n\nOne\n\nTwo", 14), ("alone", 5), ("", 0)]


class Plain(HTMLParser):
    """An independent reading of a page whose asides are marked by elements only: text by block, outside of asides."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.away = [], [], 0

    def end(self):
        line = " ".join("".join(self.now).split())
        if line and not self.away:
            self.blocks.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "div", "li", "ul", "article", "main", "nav", "aside", "footer", "form", "body"):
            self.end()
        if tag == "br":
            self.now.append(" ")
        self.away += tag in ("nav", "aside", "footer", "form", "script", "style", "title")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "div", "li", "ul", "article", "main", "nav", "aside", "footer", "form", "body", "title"):
            self.end()
        if tag in ("script", "style"):
            self.now = []
        self.away -= tag in ("nav", "aside", "footer", "form", "script", "style", "title")

    def handle_data(self, data):
        self.now.append(data)


def plain(page):
    reader = Plain()
    reader.feed(page)
    reader.close()
    reader.end()
    return "\n\n".join(reader.blocks)


def words(rng, n):
    return " ".join(rng.choice(["stone", "r&eacute;d", "of", "a&amp;b", "rivers", "&lt;tag&gt;", "日本", "hills"]) for _ in range(n))


@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_against_an_independent_reading(holder):
    rng = random.Random(holder)
    for _ in range(60):
        body = f"<h1>{words(rng, 9)}</h1>" + "".join(f"<p>{words(rng, rng.choice([1, 2, 30, 60]))}{rng.choice(['', '<br>x', ' <a href=x>link</a> on', '<b>bold</b>'])}</p>" for _ in range(rng.randrange(3, 12)))
        body = f"<p>{words(rng, 30)}</p>{body}<p>{words(rng, 30)}</p>"
        menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>{words(rng, 4)}</a></li>" for k in range(6)) + "</ul></nav>"
        page = f"<html><head><title>{words(rng, 3)}</title><style>p{{}}</style></head><body>{menu}<script>var p='</p><p>';</script><aside>{words(rng, 40)}</aside><{holder}>{body}</{holder}><form>{words(rng, 30)}</form><footer>{words(rng, 50)}</footer></body></html>"
        assert html_text.main_text(page) == plain(page)


def test_surge_and_dive_decide_on_marked_pages():
    """An unnamed link list inside main and cards marked as articles go, links amid the text stay."""
    links = "<ul>" + "".join(f"<li><a href=/{k}>Elsewhere {k}</a></li>" for k in range(8)) + "</ul>"
    text = "<p>" + "Words of the text that go on. " * 20 + "</p>"
    page = f"<main>{links}<h1>The head of the text</h1>{text}<p><a href=x>one link alone</a></p><p>End.</p>{links}</main>"
    kept = ["The head of the text", ("Words of the text that go on. " * 20).strip(), "one link alone", "End."]
    assert html_text.main_text(page) == "\n\n".join(kept)
    cards = "".join(f"<article><a href=/{k}>Card {k}</a></article>" for k in range(5)) + "<article><p>A short teaser.</p></article>"
    gap = "<div><a href=/>a</a></div>" * 4
    assert html_text.main_text(f"{cards}{gap}<div>{text}</div><div>{text}</div>") == "\n\n".join([kept[1]] * 2)


def test_names_count_as_a_whole():
    text = "Words of the text that go on. " * 20
    page = f"<div class='cookie-banner'>Agree</div><article><p>{text}</p><p class='social-science'>Kept</p><div class='comment-list'>{text}</div><p>x = <math><mi>y</mi></math></p></article><div id='related_posts'>{text}</div>"
    assert html_text.main_text(page) == f"{text.strip()}\n\nKept\n\nx = y"
    assert html_text.main_text(f"<div class='sidebar'><p>{text}</p></div>") == text.strip()  # all the page has


def test_unclosed_elements_and_long_pages():
    text = "Words of the text that go on. " * 20
    for odd in ("<title>T<p>", "<select><option>a<p>", "<svg/>", "<textarea>b<div></div>", "<object><h2></h2>", "<nav/>"):
        assert html_text.main_text(f"{odd}<p>{text}</p>").endswith(text.strip()), odd
    assert html_text.main_text(f"<p>{text}</p><script>x<p>{text}</p>") == text.strip()
    long = "".join(f"<p>{k} {text}</p>" for k in range(5000))
    assert html_text.main_text(f"<article>{long}</article><footer>f</footer>").count("\n\n") == 4999
