"""Main text of pages: the reader on odd HTML, and the statistics on sites that name nothing."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliomark.llm.html_dom import Page
from foliomark.llm.site_tree import extracted

SCHEMA = "page_id long, url string, html string, text string, key long, site string"


def pages_of(spark, rows):
    """Pages with clashing names and nulls elsewhere."""
    return spark.createDataFrame([(k, u, h, None, k, None) for k, (u, h) in enumerate(rows)], SCHEMA)


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in extracted(pages_of(spark, rows), **options).collect()}


CASES = {
    "<p>a<p>b <b>c</b>\n d<br>e&nbsp;f</p>": "a\n\nb c d e f",
    "<nav>menu</nav><article><h1>T</h1><p>one &amp;amp; two &lt;b&gt;</article><footer>f</footer>": "T\n\none &amp; two <b>",
    "<main><h1>T</h1><article><p>x</p><aside>s</aside><article>a comment</article></article><p>related</p></main>": "T\n\nx",
    "<div class='has-sidebar'><article>a</article><div id=sidebar>s</div></div>": "a",
    "<div class='layout notice'><article>a</article></div>": "a",
    "<article><p>t <span class=ad>buy</span> u</p><form>f<p>g</form><section class='user-comments'><p>c</section></article>": "t u",
    "<article><header><h2>H</h2></header>x<script>if (a<b) '</p>'</script>y<style>p{}</style><!-- no --></article>": "H\n\nxy",
    "<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>": "1\n\n2\n\na b\n\nc",
    "<p>cut off <b>here</b> <a href='x": "cut off here",
    "<p>3 < 4 &copy &#65; &#x42; </x> <?php ?> <!x></p>": "3 < 4 © A B",
    "<div hidden>h</div><p aria-hidden=true>h</p><p style='display: none'>h</p><p>v</p>": "v",
    "<p>a</div></p></p>b</span>": "a\n\nb",
    "text without any markup": "text without any markup",
    "<nav>only</nav><div class=ad>template</div>": "",
    "<script>never ends <p>x": "",
    "<p>x<!-- never ends <p>y": "x",
}


@pytest.fixture(scope="module")
def cases(spark):
    return texts(spark, [(f"http://h{k}/", html) for k, html in enumerate(CASES)])


def test_cases(cases):
    assert [cases[k] for k in range(len(CASES))] == list(CASES.values())


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), ("no scheme", "<p>a"), ("http://x/", "<p>a"), ("http://x/", "<p>a"), ("x://", " \n ")]
    found = extracted(pages_of(spark, rows)).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in found) == [
        (0, None, "", 0), (1, None, "", 0), (2, "no scheme", "a", 1), (3, "http://x/", "a", 1), (4, "http://x/", "a", 1), (5, "x://", "", 0),
    ]
    assert extracted(pages_of(spark, rows).limit(0)).count() == 0


def site(rng, host, pages):
    """Pages whose template and content have classes that say nothing."""
    words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(400)]

    def said(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = []
    for k in range(pages):
        paragraphs = [said(30) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = (
            f"<div class=q1><ul><li><a href=/>Home</a><li><a href=/n>News of {host}</a></ul></div>"
            f"<div class=q2><div class=q3>{said(6)}</div><div class=q4>{body}</div><div class=q5>Read on, {rng.choice('ab')}: part {k}</div></div>"
            f"<div class=q6>Made by {host}, {2000 + k}</div>"
        )
        want = [html.split("<div class=q3>")[1].split("<")[0], *paragraphs]
        rows.append((f"https://{host}/{k}", html, "\n\n".join(want)))
    return rows


def test_statistics_find_the_template(spark):
    rng = random.Random(4)
    rows = site(rng, "one.example", 60) + site(rng, "two.example", 40)
    want = {k: text for k, (_, _, text) in enumerate(rows)}
    pages = [(u, h) for u, h, _ in rows]
    assert texts(spark, pages) == want
    assert texts(spark, pages, near=0) == want  # importances joined by node
    assert texts(spark, pages, near=8) == want  # some here, some there


def test_few_pages_are_judged_by_all_hosts(spark):
    rng = random.Random(6)
    rows = [row for k in range(40) for row in site(rng, f"h{k}.example", 2)]
    found = texts(spark, [(u, h) for u, h, _ in rows])
    assert found == {k: text for k, (_, _, text) in enumerate(rows)}


def test_copies_of_one_article_stay(spark):
    html = "<nav>n</nav><article><h1>Title</h1><p>The same on every page.</p></article>"
    found = texts(spark, [(f"http://h/{k}", html) for k in range(50)])
    assert set(found.values()) == {"Title\n\nThe same on every page."}


def test_long_and_deep_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    long = "<article>" + "<p>one & two " * 50_000 + "</article>"
    odd = "<a " + 'b="c" ' * 50_000
    found = texts(spark, [("http://h/", deep), ("http://h/", long), ("http://h/", odd), ("http://h/", "<" * 50_000)])
    assert found[0] == "deep" and found[1] == "\n\n".join(["one & two"] * 50_000) and found[2] == "" and found[3] == "<" * 50_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "</table>", "<article>", "</article>", "<a href=x>", "</a>", "a", " b ", "&amp;", "<", "<!--", "-->", "<span hidden>", "</span>", "<br>", "<script>", "</script>", "<x", '"', ">"])))
def test_any_markup_is_read(parts):
    page = Page("".join(parts))
    assert all(p < k for k, p in enumerate(page.parent)) and all(page.path[leaf] & 1 for leaf, _ in page.blocks)
