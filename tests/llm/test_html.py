import random
import time

import pytest

from tidemark.llm import boosting
from tidemark.llm.html import Page, _made_page, decode, extract, features, main_text, train


@pytest.fixture(scope="module")
def model():
    return train()


def test_held_out_pages(model):
    rng = random.Random(1234)
    same = 0
    for _ in range(150):
        p = Page(_made_page(rng))
        want = " ".join(s for i, s in p.runs if p.label[i])
        same += main_text(p, boosting.predict(model, features([p]))) == want
    assert same >= 135


def test_no_kept_node_has_a_dropped_ancestor(model):
    rng = random.Random(5)
    for _ in range(30):
        p = Page(_made_page(rng))
        keep = decode(p, [rng.uniform(-3, 3) for _ in p.parent])
        assert all(keep[p.parent[i]] for i in range(1, len(keep)) if keep[i])


def test_reading_of_markup():
    p = Page("<!-- <p>no --><p>a &amp; b\n <b>c</b>d<br>e<p>f &#233;<script>var x='</p>';</script><ul><li>1<li>2</ul>g<style>p{}</style><div>h</div>")
    assert [s for _, s in p.runs] == ["a & b cd e", "f é", "1", "2", "g", "h"]


def test_extract(spark, model):
    article = "<html><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>news</a></li></ul></nav><article><h1>A title of it</h1>" + "<p>Some long text, with commas.  And &lt;more&gt; of it to read.</p>" * 4 + "</article><div class='comments'><p>First!</p><p>Nice post, thanks.</p></div><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", article, 5), (2, "u", None, 5), (3, None, "", 5), (4, "u", "<p>", 5), (4, "u", "<div <<< <a href='x", 5), (None, "u", article, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extract(df, model).collect()
    want = "A title of it " + " ".join(["Some long text, with commas. And <more> of it to read."] * 4)
    assert [r["text"] for r in got if r["page_id"] in (1, None)] == [want, want]
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_text_behind_letters_that_grow_in_lower_case():
    p = Page("<p>" + "İ" * 6 + "<SCRIPT>var a;</Script >abcdefghij</p><style>p{}</STYLE\n><p>end")
    assert [s for _, s in p.runs] == ["İ" * 6 + "abcdefghij", "end"]


@pytest.mark.parametrize("name", "noscript template iframe object svg math canvas audio video select button head".split())
def test_unclosed_elements_keep_the_rest(name):
    p = Page(f"<div>x<{name} src=a><p>rest</p><{name}>of it</div>")
    assert " ".join(s for _, s in p.runs) == "x rest of it"


@pytest.mark.parametrize("name", ["script", "style", "textarea", "title"])
def test_unclosed_raw_text_lasts_to_the_end(name):
    assert [s for _, s in Page(f"<p>x</p><{name}><p>rest</p></{name}x>").runs] == ["x"]


def test_long_page_with_clashing_columns(spark, model):
    body = "<p>Some long text, with commas and stops. It goes on for a while.</p>" * 160_000  # 11 MB
    df = spark.createDataFrame([(1, "u", f"<html><body><article><h1>Title</h1>{body}</article></body></html>", "t", 0)], "page_id long, url string, html string, text string, n_chars long")
    got = extract(df, model).collect()
    assert got[0]["text"] == "Title " + " ".join(["Some long text, with commas and stops. It goes on for a while."] * 160_000)


@pytest.mark.parametrize("name", "template object svg math canvas audio video".split())
def test_nested_raw_elements_end_with_the_outer_one(name):
    assert [s for _, s in Page(f"<p>x</p><{name}><{name} a=b></{name}>in<{name}/></{name}>out").runs] == ["x", "out"]
    assert [s for _, s in Page(f"<p>x</p><{name}><{name}>in</{name}>rest of the page").runs] == ["x", "rest of the page"]


def test_quotes_and_comments_in_tags():
    assert [s for _, s in Page("""<p title="a > b" class='"'>x</p><p title="y>z</p><!-- <p> > --> w <b <i>v</b> <!-- u""").runs] == ["x", "z", "w v"]
    assert [s for _, s in Page("a < b <3 <!-- c --> d <e").runs] == ["a < b <3 d <e"]


@pytest.mark.parametrize(
    "html",
    ["<b " * 3_400_000, "<b " * 3_400_000 + ">", "<p>" + "<div>" * 200_000, "<div>" * 200_000 + "</div>" * 200_000, '<b ">"' * 500_000 + "' >", "<svg><svg></svg>" * 200_000, "<li><ul>" * 100_000, "<!-" * 1_000_000 + ">", "<svg>" * 300_000],
    ids=["open", "one end", "in a paragraph", "nested", "quotes", "half nested", "lists", "no comment", "never closed"],
)
def test_broken_markup_takes_linear_time(html):
    began = time.process_time()
    Page(html)
    assert time.process_time() - began < 20  # seconds; by the square, each would take many minutes
