import pytest

from oddsloom.llm.html_text import extract_text, main_text

BODY = "<p>First block &amp; more <b>bold</b>text, long enough to stand out.</p><p>Second   block\n of the &eacute;ssay, which goes on for quite a while too.</p>"
TEXT = "First block & more boldtext, long enough to stand out. Second block of the éssay, which goes on for quite a while too."
NOISE = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><header>Site</header>'
END = '<div class="comments"><p>A reader says a rather long thing about the text that was written.</p></div><aside>See also</aside><form><input><label>Name</label></form><footer>&copy; us</footer><script>var a = "<p>no</p>";</script>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body>{NOISE}<article>{BODY}</article>{END}</body></html>",
        f"<body>{NOISE}<div id='content'>{BODY}</div>{END}",
        f"<body>{NOISE}<main><div class=\"cookie-notice\">We use cookies</div>{BODY}</main>{END}",
        f"<body>{NOISE}<article>{BODY}",
        f"{NOISE}<div>{BODY}</div>{END}",
        f"<body><div class='page with-sidebar'><div class='site-header'>Site name</div><div class='wrap'>{BODY}</div><div class='sidebar'><p>See also this and that</p></div></div></body>",
        f"<div id='side main'><article><div class='post-header'></div>{BODY}<div class='share-buttons'><a href='#'>Share</a></div></article><div class='comments'><article><p>First of all, I have to say that I do not agree with any word of this.</p></article></div></div>",
        f"<BODY>{NOISE}<ARTICLE>{BODY.replace('</p>', '')}</ARTICLE>{END}",
        f"<body><div class='ad'>Buy</div><div><div role=\"navigation\"><p>one two</p></div>{BODY}</div><!-- <p>gone</p> --></body>",
    ],
)
def test_article_only(page):
    assert main_text(page) == TEXT


def paragraphs(first: int, n: int) -> str:
    return "".join(f"<p>Paragraph {i} of the long text goes on about rivers, bridges and the boats of town {i}, and it does not stop before line {i * 7}.</p>" for i in range(first, first + n))


TEASER = '<article><h3><a href="/x">Another story</a></h3><p>In short.</p></article>'
AD = '<div class="ad"><a href="/buy">Buy this</a></div>'


@pytest.mark.parametrize("tag", ["div", "section", "article", "main"])
def test_density_chooses_whatever_the_element(tag):
    for page in (f"<body>{NOISE}<{tag}>{paragraphs(0, 12)}</{tag}>{TEASER}{END}</body>", f"<body>{NOISE}{TEASER}<div><{tag}>{paragraphs(0, 12)}</{tag}></div>{TEASER}{END}</body>"):
        assert main_text(page) == main_text(f"<p>{paragraphs(0, 12)}")


def test_small_parts_of_a_split_text_stay():
    page = f"<body>{NOISE}<div>{paragraphs(0, 1)}</div>{AD}<div>{paragraphs(1, 20)}</div>{AD}<div>{paragraphs(21, 2)}</div>{TEASER}{END}</body>"
    assert main_text(page) == main_text(f"<p>{paragraphs(0, 23)}")


def test_a_form_around_the_page_stays():
    page = f"<body><form action='/page.aspx'>{NOISE}<div>{paragraphs(0, 6)}</div></form><form><label>Name</label><p>Write to us.</p></form></body>"
    assert main_text(page) == main_text(f"<p>{paragraphs(0, 6)}")


def test_text_after_the_body_is_read():
    assert main_text(f"<body></body><div>{paragraphs(0, 4)}</div>") == main_text(f"<p>{paragraphs(0, 4)}")


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("just text &lt;b&gt;") == "just text <b>"
    assert main_text("a<br>b<p>c") == "a b c"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert main_text("<p>x</p></div></b></p><p>1 < 2 and more</p>") == "x 1 < 2 and more"
    rows = [(1, "u", f"<article>{BODY}</article>", "t"), (1, "u", f"<article>{BODY}</article>", "t"), (None, None, None, None), (3, "v", "", "t")]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r["id"]), r["text"], r["n_chars"]) for r in found) == sorted([("1", TEXT, len(TEXT)), ("1", TEXT, len(TEXT)), ("None", "", 0), ("3", "", 0)])
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
