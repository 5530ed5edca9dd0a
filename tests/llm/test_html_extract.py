import time

import numpy as np
import pytest

from granary.llm import html_extract as H


def test_blocks():
    page = '<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><a href="/x">A&amp;B</a></nav><article><h1>Head</h1><p><b>One\n two<br>three<p>four <i>in</i>line</article><!-- <p>no --> tail'
    paths = H.Paths()
    assert [(paths.steps[b[0]][1], b[1]) for b in H.blocks(page, paths)] == [("title", "T"), ("a", "A&B"), ("h1", "Head"), ("b", "One two three"), ("p", "four inline"), ("body", "tail")]
    said = lambda page: [b[1] for b in H.blocks(page, H.Paths())]
    assert said("") == [] and said("just text < 3 & more") == ["just text < 3 & more"]
    assert said('<p title="a>b">x</p><p class=\'c\'>y') == ["x", "y"]
    # Only scripts and styles go unread; nothing else that is left open swallows the article.
    assert said("<p>a</p><object><p>b</p>") == ["a", "b"] and said("<p>x <math><mi>y</mi></math> z</p><iframe>w</iframe>") == ["x", "y", "z", "w"]
    assert said("<noscript><p>a</p>") == ["a"] and said("<template>q</template><p>a</p>") == ["q", "a"] and said("<p>a</p><script>var x;") == ["a"]


def test_quotes_count_only_after_the_equals_sign():
    said = lambda page: [b[1] for b in H.blocks(page, H.Paths())]
    assert said("<article><h1>T</h1><p title=it's>A</p><p>B, don't go</p><p>C</p></article>") == ["T", "A", "B, don't go", "C"]
    assert said("""<p a="x'y" b = '>"' c=d"e>one<p it's>two<p "q">three<p a=>four<p a='b'c>five<p / =x>six<p a="">seven""") == ["one", "two", "three", "four", "five", "six", "seven"]
    assert said("<p class=a/>x") == ["x"] and said('<p title="never closed>x<p>y') == ["x", "y"]


def test_comments_end_where_browsers_end_them():
    said = lambda page: [b[1] for b in H.blocks(page, H.Paths())]
    assert said("<p>one<!-->two</p><p>three") == ["onetwo", "three"] and said("<p>one<!--->two") == ["onetwo"]
    assert said("<p>one<!-- c --!>two</p><p>three") == ["onetwo", "three"] and said("<p>a<!-- > -- ->b-->c") == ["ac"]
    assert said("<p>one<!-- never closed <p>two") == ["one"]


def test_noscript_and_template_are_read(model):
    page = "<article><h1>A title</h1><p>Start of it all, and it goes on.</p><noscript><p>The text of a page that loads late, word by word.</p></noscript><p>End of it, in peace.</p></article>"
    reader = H.Reader()
    found = reader.blocks(page)
    assert [b[1] for b in found] == ["A title", "Start of it all, and it goes on.", "The text of a page that loads late, word by word.", "End of it, in peace."]
    assert model.label([reader(found)])[0].all()
    assert [b[1] for b in H.blocks("<article>Start<noscript><p>text</p></noscript>End", H.Paths())] == ["Start", "text", "End"]


def test_paths_hold_every_step():
    reader = H.Reader()
    (block,) = reader.blocks('<div class="post entry"><p id=first>x')
    v = reader.path(block[0])
    want = {H.slot(t, H.TAGS) for t in ("div", "p")} | {H.TAGS + H.slot("p", H.TAGS)} | {2 * H.TAGS + H.slot(n, H.NAMED) for n in ("post", "entry", "first")}
    assert set(np.flatnonzero(v).tolist()) == want


def test_deep_pages_take_linear_time():
    for piece in ("<div>x", "<span>x", "<ul><li>x", "<b>x<option>y"):
        took = []
        for n in (10_000, 40_000):
            reader, began = H.Reader(), time.time()
            reader(reader.blocks(piece * n))
            took.append(time.time() - began)
        assert took[1] < 12 * took[0] + 1, piece


def test_hostile_pages_take_linear_time():
    for page in ("<" * 100_000, '<a "' * 30_000, "<p>" * 30_000, "&" * 100_000, "<!--" * 30_000, "<b>" * 5_000 + "x", "<a x" * 30_000, "<a x='" * 30_000, '<a ">" ' * 30_000 + '"', "<!" * 100_000, "<script>" + "</script " * 30_000, "<a b='" * 30_000 + "'>", "<a b=" * 60_000, "<a " + " " * 200_000 + "=" * 100_000, "<a " + "x " * 200_000, "<!--" + "--!" * 100_000, "<b> " * 30_000 + "x<b>" * 30_000):
        H.blocks(page, H.Paths())


@pytest.fixture(scope="module")
def model(spark):
    return H.trained(spark)


def test_labels_on_unseen_pages(model):
    writer, reader, right, all_ = H.PageWriter(91), H.Reader(), 0, 0
    for _ in range(150):
        found = reader.blocks(writer.page())
        want = np.array([b[1].startswith(writer.MARK) for b in found])
        got = model.label([reader([(p, t.replace(writer.MARK, "") or "-", c, k) for p, t, c, k in found])])[0]
        right, all_ = right + int((got == want).sum()), all_ + len(want)
    assert right / all_ >= 0.97


def test_pages(spark, model):
    page = (
        '<!DOCTYPE html><html><head><title>Home</title></head><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav>'
        "<article><h1>A day out</h1><p>We went to the sea, and it was fine &amp; warm.</p><p>Then we came home again, tired but happy with it all.</p></article>"
        '<div class="comments"><h3>Comments</h3><p>Nice one, thanks!</p></div><aside><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside><footer>&copy; 2024 Site</footer></body></html>'
    )
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>")], "page_id long, url string, html string").withColumn("n_chars", H.F.lit(1))
    rows = H.main_text(df).collect()
    want = "A day out We went to the sea, and it was fine & warm. Then we came home again, tired but happy with it all."
    assert sorted((r.text, r.n_chars) for r in rows) == sorted([("", 0), ("", 0), ("", 0), (want, len(want)), (want, len(want))])
    assert H.main_text(df.limit(0)).count() == 0
