"""WARC archives and main text of pages."""

import hashlib
import io
import random

import pytest

from ticklens.llm import htmltext, warc
from ticklens.llm.common import new_folder

PAGES = [
    (1, "http://a/1", "<p>" + "x" * 200 + "</p>"),
    (2, "http://a/2", "<p>" + "x" * 200 + "</p>"),
    (7, "http://a/7", "<p>" + "x" * 200 + "</p>"),
    (3, None, "small"), (4, "http://a/4", "small"),
    (5, "http://a/5", None), (6, "http://a/6", ""),
    (8, "http://a/8", "\r\n\r\nWARC/1.1\r\n" * 40 + "é\U0001f600"),
    (9, "http://a/\r\n9", "y" * 3_000_000),
    (None, "http://a/n", "z" * 300), (None, None, "z" * 300),
    (10, "u", "w" * 100), (10, "u", "w" * 100), (11, "u", "w" * 99), (12, "u", "w" * 99),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([r + ("clash", 0.0) for r in rows],
                                 "page_id long, url string, html string, sha256 string, text double")


def expected(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == body and j is not None]
        refers = min(same) if same and len(body) >= 100 and i is not None and i != min(same) else None
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark)).collect()
    assert sorted((tuple(g[:5]) for g in got), key=str) == expected(PAGES)
    assert warc.round_trip(pages(spark, [])).collect() == []


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_any_range_size_reads_each_record_once(spark, range_bytes):
    rows = [(k, "u", random.Random(k).randbytes(k * 7 % 300).hex()) for k in range(80)]
    folder = new_folder(spark, "warc-test")
    archives = warc.write_archives(pages(spark, rows).coalesce(1), folder)
    got = warc.read_archives(archives, folder, range_bytes).collect()
    assert sorted((tuple(g[i] for i in (0, 2, 3, 4, 5)) for g in got), key=str) == expected(rows)


def test_magic_inside_a_record_is_refused():
    body = (b"\x1f\x8b\x08" + bytes(20)) * 50
    stored = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)        # stored blocks keep the magic visible
    record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    data = stored.compress(record) + stored.flush()
    archive = data + warc.record_bytes(1, "u", b"second", hashlib.sha256(b"second").hexdigest(), None)
    for cut in (0, 1, 40, 100, len(data) - 1, len(data)):
        first = list(warc.records_in(io.BytesIO(archive), 0, cut))
        rest = list(warc.records_in(io.BytesIO(archive), cut, len(archive)))
        assert len(first) + len(rest) == 2, cut


# ------------------------------------------------------------------ main text (10)

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and more</a></li></ul></nav>'
BODY = "<h1>Title &amp; more</h1><p>First  <b>bold</b>text\nhere.</p><p>Second &eacute;&nbsp;part.</p>"


def page(inner, after=""):
    return (f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
            f'<header class="top">Site name</header>{NAV}<div class="ad">Buy this now, only today.</div>{inner}{after}'
            '<footer>&copy; site words words</footer></body></html>')


def sample(spark):
    rows = [(k, f"u{k}", page(f"<article>{BODY}<p>{'word ' * (k + 1)}</p></article>")) for k in range(20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def weights(spark):
    return htmltext.learned_weights(sample(spark))


MAIN = "Title & more First boldtext here. Second é part."


@pytest.mark.parametrize("inner", [
    f"<article>{BODY}</article>",
    f"<main><article>{BODY}</article></main>",
    f'<article>{BODY}<aside>see also this</aside></article><section class="comments"><p>I disagree, said a reader</p></section>',
    f'<div class="cookie-notice"><p>We use cookies, agree?</p></div><article>{BODY}<form><label>Mail</label><input></form></article>',
    f'<article><header>{""}</header>{BODY}<div id="comments"><article><p>first comment</p></article></div></article>',
    f"<article>{BODY}<script>if (a < b) x();</script><!-- <p>hidden</p> --></article>",
    f"<ARTICLE>{BODY.upper().replace('&AMP;', '&amp;').replace('&EACUTE;', '&eacute;').replace('&NBSP;', '&nbsp;')}</ARTICLE>",
    f'<div class="sidebar-left"><p>{"link words " * 40}</p></div><article>{BODY}</article>',
])
def test_article_alone_is_taken(weights, inner):
    assert htmltext.main_text(page(inner), weights).lower() == MAIN.lower()


def test_page_without_a_named_article(weights):
    assert htmltext.main_text(page(f"<div>{BODY}</div>"), weights) == MAIN


@pytest.mark.parametrize("source", ["", "<", "<p", "<p>", "<!--", "<script>", "&", "<a href='x", "</div></p>", "<nav><p>x"])
def test_broken_pages(weights, source):
    assert isinstance(htmltext.main_text(source, weights), str)


def test_unclosed_tags(weights):
    assert htmltext.main_text("<body><article><h1>A<p><b>B c.<br><p>D</article><footer>e f", weights) == "A B c. D"


def test_extracted_rows(spark):
    table = sample(spark).unionByName(spark.createDataFrame(
        [(None, None, None), (100, "u", ""), (100, "u", page("")), (101, "v", page("<article>x</article>"))],
        "page_id long, url string, html string")).selectExpr("*", "1 as text", "2 as n_chars")
    got = htmltext.extracted(table).collect()
    assert len(got) == 24 and all(g.n_chars == len(g.text) for g in got)
    assert [g.text for g in got if g.page_id == 101] == ["x"] and {g.text for g in got if g.page_id in (None, 100)} == {""}
    assert htmltext.extracted(table.where("false")).collect() == []


@pytest.mark.parametrize("attrs", ['class="overflow-hidden"', 'style="overflow:hidden"', 'data-hidden="1"', "hidden=false",
                                   'title="display: none"', 'data-role="menu"', 'data-id="menu"', 'aria-hidden="false"'])
def test_attributes_that_hide_nothing(weights, attrs):
    article = f'<article><p>A <a href="/hidden-gems">hidden</a> gem.</p><div {attrs}><p>More words here.</p></div></article>'
    assert htmltext.main_text(page(article), weights) == "A hidden gem. More words here."


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', "class=x hidden", 'aria-hidden="true"', 'style="color:red; display : none"',
                                   'role="menu"', "id='menu'"])
def test_hidden_parts(weights, attrs):
    article = f"<article><p>A gem.</p><div {attrs}><p>Not these.</p></div><p>More words here.</p></article>"
    assert htmltext.main_text(page(article), weights) == "A gem. More words here."


@pytest.mark.parametrize("icon", ["<svg class=i />", "<svg/>", '<math alt="a > b"/>', "<svg-icon></svg-icon>", "<select-box></select-box>",
                                  '<svg aria-label="x > y"><text>no word</text></svg>', "<svg><path d='M0'/><title>T</title></svg>"])
def test_icons_do_not_cut_the_page(weights, icon):
    article = f"<article><p>First {icon} part.</p><p>Rest of the article.</p></article>"
    assert htmltext.main_text(page(article), weights) == "First part. Rest of the article."


@pytest.mark.parametrize("box", [f'<div class="newsletter"><p>{"sign up " * 50}</p></div>', f"<aside>{'<i>x</i> ' * 400}</aside>"])
def test_long_side_part_inside_an_article(weights, box):
    first, last = "lead " * 30, "end " * 20
    article = f"<article><p>{first}</p>{box}<p>{last}</p></article>"
    assert htmltext.main_text(page(article), weights) == (first + last).strip()


def test_ranges_are_read_by_many_tasks(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(3)
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", "".join(rnd.choices("abcdefgh ", k=3000))) for k in range(300)],
                                  "page_id long, url string, html string")
    folder = new_folder(spark, "warc-test")
    archives = warc.write_archives(pages.coalesce(2), folder)
    ranges = sum(-(-r["bytes"] // 4096) for r in archives.collect())
    assert ranges > 60
    read = warc.read_archives(archives, folder, range_bytes=4096).withColumn("task", F.spark_partition_id())
    assert read.count() == 300
    assert read.select("task").distinct().count() >= min(ranges, spark.sparkContext.defaultParallelism)


def test_repeats_are_found_without_shuffling_pages(spark):
    body = "same " * 100
    pages = spark.createDataFrame([(k, None, body if k % 3 else body + str(k)) for k in range(60)], "page_id long, url string, html string")
    rows = warc.with_revisits(pages)
    found = rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {r.page_id for r in found if r.refers_to is None} == {k for k in range(60) if not k % 3} | {1}
    assert {r.refers_to for r in found} == {None, 1}


@pytest.mark.parametrize("attrs", ['class="side-effects"', 'id="related-work"', 'class="meta"', 'class="form"', 'class="search-results"',
                                   'class="notice-of-intent"', 'id="header-files"', 'class="social-history"', 'class="comment-on-method"'])
def test_names_of_article_parts_keep_their_text(weights, attrs):
    article = f'<article><p>First part.</p><div {attrs}><p>Words of the <a href="/x">article</a> itself.</p></div><p>Last part.</p></article>'
    assert htmltext.main_text(page(article), weights) == "First part. Words of the article itself. Last part."


@pytest.mark.parametrize("box", ['<div class="newsletter-box"><p>Sign up now</p></div>', '<div class="sidebar left"><p>More to read</p></div>',
                                 '<ul class="related-posts"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>',
                                 '<div class="share"><a href="/s"><span>Send this</span></a></div>', '<p class="tags"><a>x</a> <a>y</a></p>',
                                 '<div id="comments"><p>I disagree</p></div>', '<div class="meta"><a>Unclosed links</a>'])
def test_boxes_inside_an_article_go(weights, box):
    article = f"<article><p>First part.</p><p>Last part.</p>{box}</article>"
    assert htmltext.main_text(page(article), weights) == "First part. Last part."


def heaviest(scores):
    """Largest sum of a contiguous run, all runs tried."""
    return max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


def test_region_is_a_maximum_scoring_run(weights):
    """Pages of random paragraphs and tags without a named article, against all contiguous runs."""
    rnd = random.Random(12)
    for _ in range(60):
        source = "".join(rnd.choice(["<p>", "</p>", "<li>", "<td>", "<a>", "</a>", "<b>"]) + rnd.choice(["", "w " * rnd.randint(1, 6)])
                         for _ in range(rnd.randint(1, 25)))
        marks = {e: rnd.uniform(-2, 1) for e in ("p", "li", "td", "a", "b", "")} | {f"<{e}>": rnd.uniform(-2, 0) for e in ("p", "li", "td", "a", "b")}
        parsed = htmltext.Page(source)
        scores = [min(-0.02, marks[f"<{e}>"]) if t is None else marks[e] * len(t.split()) for t, e in zip(parsed.text, parsed.element)]
        words = htmltext.main_text(source, marks).split()
        runs = [(i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)
                if sum(scores[i:j]) >= heaviest(scores) - 1e-9]
        found = [" ".join(t for t in parsed.text[i:j] if t).split() for i, j in runs] if heaviest(scores) > 0 else [[]]
        assert words in found
