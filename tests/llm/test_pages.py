"""Operator 7: main text of pages."""

import random

import pytest

from driftspark.llm import html_text
from driftspark.llm.html_blocks import blocks
from driftspark.llm.html_labels import PAGES


@pytest.fixture(scope="module")
def model():
    return html_text.train()


def article(rng):
    words = lambda n: " ".join(rng.choice("the on er a of boat town year".split()) for _ in range(n))
    parts = [words(rng.choice([1, 3, 10, 60])).capitalize() + "." for _ in range(rng.randint(1, 9))]
    other = words(rng.choice([3, 30]))
    page = (
        f"<html><head><title>{parts[0]}</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>{other}</a></li></ul></nav>"
        f"<div class='ad'>{other}</div><article><h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        + f"<div class='comments'><p>{other}</p></div></article><aside><p>{other}</p></aside><footer>&copy; {other}</footer></body></html>"
    )
    return page, "\n".join(parts)


def test_held_out_pages(model):
    rng = random.Random(6)
    pages = [article(rng) for _ in range(300)]
    assert sum(html_text.main_text(p, model) == t for p, t in pages) >= 295


def test_labelled_pages_left_out():
    good = total = 0
    for i, page in enumerate(PAGES):
        rest = [(html_text.rows_of(b), [x.label for x in b]) for b in map(blocks, PAGES[:i] + PAGES[i + 1 :])]
        found = blocks(page)
        labels = html_text.fit(rest).decode(html_text.rows_of(found))
        good += sum(a == b.label for a, b in zip(labels, found))
        total += len(found)
    assert good / total > 0.85


def test_viterbi_is_the_best_path(model):
    import itertools

    rows = html_text.rows_of(blocks(PAGES[2]))[:9]

    def score(labels):
        total = model.start[labels[0]]
        for i, (row, y) in enumerate(zip(rows, labels)):
            total += model.emission[row, y].sum() + (model.transition[labels[i - 1], y] if i else 0)
        return total

    assert model.decode(rows) == list(max(itertools.product((0, 1), repeat=len(rows)), key=score))


def test_blocks():
    page = "<p>a &amp; b&nbsp;c<br>d <b>e</b><p>f<!-- x --><style>p{}</style><ul><li>g<li>h</ul><td>i &am &copy &#233;</p ><textarea><p>no</textarea>j<p title='>'>k"
    assert [b.text for b in blocks(page)] == ["a & b c d e", "f", "g", "h", "i &am © é", "j", "k"]
    for odd in ("<", "<p", "a<b", "</p>x", "<!--", "<script>", "<p title='x", "<a <a>>", "&", "\x00"):
        blocks(odd)


@pytest.mark.parametrize(
    "odd", ["<svg width='1'/>", "<canvas/>", "<video src=x />", "<iframe src='x'/>", "<object data='x'>", "<svg>", "<video src=x>", "<noscript>", "<math>", "<template/>", "<select>", "<textarea/>", "<title/>", "<script/>"]
)
def test_nothing_after_an_odd_tag_is_lost(odd):
    page = f"<body><article><h1>Title</h1><p>one</p>{odd}<p>two <b>three</b></p></article><footer>end</footer></body>"
    found = blocks(page)
    assert [b.text for b in found] == ["Title", "one", "two three", "end"]
    assert "article" in found[2].tags and "hidden" not in found[2].hints


def test_embedded_content_is_walked():
    page = (
        "<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><g><path d='m'/><text>so</text></g></svg> then</p>"
        "<object><p>plan b</p></object><noscript><p>no script</p></noscript><video><p>old browser</p></video><p>last</p></article>"
    )
    found = blocks(page)
    assert [b.text for b in found] == ["let x=2 be so then", "plan b", "no script", "old browser", "last"]
    assert ["hidden" in b.hints for b in found] == [False, False, False, True, False]


def test_head_without_end():
    for rest in ("<div><p>one</p></div>", "<p>one", "one", "<b>one</b>", "<body>one", "</head>one"):
        assert [b.text for b in blocks(f"<html><head><title>t</title><meta name=a><style>p{{}}</style>{rest}")] == ["one"]


def test_no_page_is_cut_for_training(monkeypatch, spark):
    long = "<article>" + "<p>one two.</p>" * 450 + "</article>"
    pages = spark.createDataFrame([(1, long), (2, "<main><p>a b.</p></main>")], "page_id long, html string")
    sizes = lambda **more: sorted(len(p[0]) for p in html_text.train(pages, **more)[4 * len(PAGES) :])
    monkeypatch.setattr(html_text, "fit", lambda data: data)
    assert sizes() == [1] and sizes(longest=1000) == [1, 450]


def test_rows(spark, model):
    page, text = article(random.Random(8))
    data = spark.createDataFrame(
        [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (3, "u", "", "t"), (None, "u", page, "t")],
        "page_id long, url string, html string, text string",
    )
    got = html_text.extract(data, ["page_id", "url"], model=model).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in got) == sorted([("1", text), ("1", text), ("2", ""), ("3", ""), ("None", text)])
    assert html_text.extract(data.limit(0), ["page_id"], model=model).count() == 0


def test_training_on_the_table(spark):
    pages = spark.createDataFrame([(i, article(random.Random(i))[0]) for i in range(20)] + [(None, None)], "page_id long, html string")
    trained = html_text.train(pages, sample=10)
    page, text = article(random.Random(99))
    assert html_text.main_text(page, trained) == text
