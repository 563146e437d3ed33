import itertools
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from tessera.llm import html_crf as H


class Article(HTMLParser):
    """The lines of a page's article, read by the standard library's parser instead of the module's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts, self.lines, self.skip = 0, [], [], 0

    def broken(self):
        line = " ".join("".join(self.parts).split())
        self.lines += [line] * bool(line)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "textarea", "template")
        if tag == "br":
            self.parts.append(" ")
        if tag in H.BLOCKS and self.depth:
            self.broken()
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "textarea", "template")
        if tag in H.BLOCKS and self.depth:
            self.broken()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def test_held_out_layouts():
    pages = H.labelled_pages(200, seed=99)
    right = sum(H.main_text(p, H.model()) == "\n".join(" ".join(x.split()) for x in t.split("\n")) for p, t in pages)
    assert right / len(pages) > 0.93


def test_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = H.op4_html_extraction(spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        reader = Article()
        reader.feed(pages[r["page_id"]])
        reader.close()
        assert r["text"] == "\n".join(reader.lines) and r["n_chars"] == len(r["text"])


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(3)
    crf = H.Crf({str(k): k for k in range(6)}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2))
    chain = [[str(k) for k in rng.integers(0, 7, 3)] for _ in range(9)]
    s = crf.scores(chain)

    def worth(y):
        return crf.start[y[0]] + crf.end[y[-1]] + sum(s[i, v] for i, v in enumerate(y)) + sum(crf.step[a, b] for a, b in itertools.pairwise(y))

    assert tuple(crf.decode(chain)) == max(itertools.product((0, 1), repeat=9), key=worth)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two &lt;b&gt;<br>three\n\t four", ["one", "two <b> three four"]),
        ("<div>a<!-- <p>no</p> -->b<script>var t='</p>'</script>c</div>", ["abc"]),
        ('<p title="a>b">x <b>bo</b>ld</p></div></p>tail', ["x bold", "tail"]),
        ("<ul><li>1<li>2</ul><td>3</td>", ["1", "2", "3"]),
        ("<script>never closed <p>x</p>", []),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


def test_awkward(spark):
    rows = [(1, None, None, None), (None, "u", "<article><p>" + "Long text here. " * 20000 + "</p></article>", "x"), (2, None, "", "y"), (2, None, "", "y"), (3, "v", "<nav><a href=/>menu</a></nav>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert H.extract(df).columns == ["page_id", "url", "html", "text"] and len(got) == 5
    assert sorted(len(r["text"]) for r in got) == [0, 0, 0, 0, 16 * 20000 - 1]
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inside", "texts"),
    [
        ('<p>One <svg class="i"/> two.</p><p>Three.</p>', ["One two.", "Three."]),
        ("<p>One <iframe src=x/> two.</p><p>Three.</p>", ["One two.", "Three."]),
        ("<p>One <iframe src=x> two.</p><p>Three.</p>", ["One two.", "Three."]),
        ("<p>One <iframe src=x>gone</iframe> two.</p><iframe>gone</iframe><p>Three.</p>", ["One two.", "Three."]),
        ("<p>One</p><video src=x><p>Two.</p>", ["One", "Two."]),
        ("<p>Of <math><mi>x</mi></math> and <object>more</object></p><noscript><p>Plain.</p></noscript>", ["Of x and more", "Plain."]),
        ("<p>One</p><script>if (a < b) '<p>'", ["One"]),
        ("<p>One.</p><svg/><p>Two two two.</p><math/><p>Three.</p>", ["One.", "Two two two.", "Three."]),
        ("<video-player src=x></video-player><p>After.</p>", ["After."]),
        ("<object-card>x</object-card><p>y</p>", ["x", "y"]),
        ("<script-loader>x</script-loader><p>y</p>", ["x", "y"]),
        ("<p title=it's>Text here.</p><p title='a>b' data-x=\"it's\">More.</p>", ["Text here.", "More."]),
        ("<p title = 'x' it's>One</p><p a=b\"c>Two</p>", ["One", "Two"]),
        ("<p>a < b and c > d <3 </> <!-- x --!>e<!-->f<!doctype x><?php y?></p>", ["a < b and c > d <3 ef"]),
        ("<p>One</p><p title='", ["One"]),
        ("<script>a</scripty></script ><p>One</SCRIPT></p>", ["One"]),
    ],
)
def test_foreign_and_media_elements_end_nothing(inside, texts):
    assert [b.text for b in H.blocks(f"<article>{inside}")] == texts


@pytest.mark.parametrize("unit", ["<script ", "<a ", "<a x='", "<!--", "</", "<", "<p class=x>", "<div>y", "</div>x", "<iframe>", "<iframe src='x'/>", "<a href=\"x>", "&", "class = "])
def test_time_is_proportional_to_the_page(unit):
    began = time.perf_counter()
    H.main_text(unit * (1_000_000 // len(unit)), H.Crf({}, np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)))
    assert time.perf_counter() - began < 8
    began = time.perf_counter()
    H.blocks("<script " * 125_000)
    assert time.perf_counter() - began < 1


def test_a_page_of_megabytes():
    page = "<nav><a href=/>menu</a></nav><article>" + "".join(f"<p>Sentence number {i} of the page stands here.</p>" for i in range(100_000)) + "</article><footer>&copy; x</footer>"
    assert H.main_text(page, H.model()).count("\n") == 99_999
