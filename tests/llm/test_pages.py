"""Operators over pages: main text and archives."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from seamline.llm import html_template, warc_zstd

PAGES = "page_id long, url string, html string"


def page(k, body=None):
    article = body or f"Story {k} of things.\nAnother &amp; line {k}."
    ps = "".join(f"<p>{x}</p>" for x in article.split("\n"))
    return f"<html><head><title>t</title></head><body><div class='x'><span>Shop menu</span></div><article><h1>T{k}</h1>{ps}</article><div><p>All rights of the site</p></div></body></html>"


@pytest.fixture(scope="module")
def rows():
    out = [(k, f"http://a.example.com/{k}", page(k)) for k in range(30)]
    out += [(100 + k, f"http://b.example.com/{k}", page(3) * 3) for k in range(8)]
    out += [(200, None, None), (201, "no url", ""), (202, "http://c.example.com/\r\nX: y", page(202)), (None, None, page(3) * 3), (203, "http://a.example.com/z", page(0)), (0, "http://a.example.com/0", page(0))]
    out.append((204, "http://a.example.com/long", "<p>" + "word " * 100_000))
    return out


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_extraction(pages, rows):
    got = {r.page_id: r for r in html_template.extract(pages).collect()}
    for k in range(1, 30):
        assert got[k].text == f"T{k}\nStory {k} of things.\nAnother & line {k}."
        assert got[k].n_chars == len(got[k].text)
    assert got[200].text == got[201].text == "" and got[204].n_chars == 499_999
    assert len(html_template.extract(pages).collect()) == len(rows)


def test_recurring_subtrees_go(spark):
    html = lambda k: f"<body><div><b>Menu</b> of the site</div><div>Own words of page number {k}, long enough to stay</div></body>"
    df = spark.createDataFrame([(k, "http://h/", html(k)) for k in range(20)], PAGES)
    assert {r.text for r in html_template.extract(df).collect()} == {f"Own words of page number {k}, long enough to stay" for k in range(20)}


def test_copies_of_a_page_keep_their_text(spark):
    df = spark.createDataFrame([(k, "http://h/", "<body><p>The same long story</p><p>again</p></body>") for k in range(20)], PAGES)
    assert {r.text for r in html_template.extract(df).collect()} == {"The same long story\nagain"}


MENU = "<div class='top'><b>Home</b> Shop News Contact Imprint</div>"
NOTICE = "<p class='x'>You read this site in its old form until the end of June.</p>"


def story(rng, n=60):
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnr") for _ in range(n))


def test_menu_and_notice_inside_the_article_go(spark):
    """What recurs beside many stories goes from a marked article too; one page's own menu stays."""
    rng = random.Random(1)
    own = {k: (story(rng), story(rng)) for k in range(30)}
    rows = [(k, "http://h/x", f"<body><article><h1>T{k}</h1>{MENU}<p>{a}</p>{NOTICE}<p>{b}</p></article></body>") for k, (a, b) in own.items()]
    rows.append((100, "http://small/x", rows[0][2]))
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == f"T{k}\n{a}\n{b}" for k, (a, b) in own.items())
    assert "Imprint" in got[100] and "old form" in got[100]


def test_near_copies_of_a_page_keep_their_text(spark):
    """Paragraphs that many near copies share are no template, and neither are short ones of many stories."""
    rng = random.Random(2)
    base = [story(rng, 40).split() for _ in range(6)]
    rows, want = [], {}
    for k in range(60):
        ps = [list(p) for p in base]
        for p in ps:
            p[rng.randrange(40)] = f"edit{k}"
        want[k] = "\n".join(" ".join(p) for p in ps)
        rows.append((k, "http://h/", "<body><article>" + "".join(f"<p>{' '.join(p)}</p>" for p in ps) + "</article></body>"))
    for k in range(100, 120):
        want[k] = f"{story(rng)}\nAnd so on.\n{base[0][0]}"
        rows.append((k, "http://h/", "<body><article>" + "".join(f"<p>{p}</p>" for p in want[k].split("\n")) + "</article></body>"))
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_names_decide_where_they_recur_or_nothing_can(spark):
    rng = random.Random(3)
    page = lambda k, name: f"<body><div class='{name}'>{story(rng, 8)}</div><div class='text'>{own[k]}</div></body>"
    own = {k: story(rng) for k in range(60)}
    rows = [(k, "http://big/", page(k, "ad-box")) for k in range(40)] + [(k, "http://big/", page(k, f"survey-{k}")) for k in range(40, 50)]
    rows += [(50, "http://small/", page(50, "ad-box"))]
    got = {r.page_id: r.text for r in html_template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == own[k] for k in (*range(40), 50))
    assert all(got[k].endswith(own[k]) and got[k] != own[k] for k in range(40, 50))


def plain_counts(rows):
    """(subtree or slot, host) -> (pages, stories), by sets over whole pages."""
    found = defaultdict(lambda: (set(), set()))
    for _, url, html in rows:
        host = re.match("[a-z]+://([^/]*)", url or "")
        if html:
            order = html_template.measure(html_template.parse(html))
            nodes = html_template.subtrees(order)
            for h, (page, one) in zip([0, *nodes], html_template.stories(order, [None, *nodes.values()])):
                pages, stories = found[host[1] if host else "", h]
                pages.add((page, one))
                stories.add(one)
    return Counter((len(a), len(b)) for a, b in found.values())


def test_counts_per_host(pages, rows):
    got = Counter((r.pages, r.stories) for r in html_template.counts(pages.repartition(5)).collect())
    assert got == plain_counts(rows)


def test_longest_blocks():
    order = html_template.measure(html_template.parse("<body><p>a b c d e f</p><div>x <b>y</b> z<p>q</p></div><script>no no no no no no no</script></body>"))
    blocks = html_template.longest_blocks(order)
    shingles = [int(html_template.shingle_hashes(list(s))[0]) for s in ("abcde", "bcdef")]
    assert blocks[0][2:] == (min(shingles), max(shingles)) and len(blocks) == 3
    assert len(set(shingles)) == 2 and html_template.shingle_hashes(["a", "b"]) != html_template.shingle_hashes(["b", "a"])
    assert html_template.longest_blocks(html_template.measure(html_template.parse("<br>"))) == []


MARKUP = [
    ("<article class='post category-privacy'><p>on privacy</p><div class='survey-results'>half of them, and more text than before</div></article><div class='box'>other</div>", "on privacy\nhalf of them, and more text than before"),
    ("<article>one</article><article>two</article>", "one"),
    ("<div class='legal'><p>A text on law that is most of the page</p></div><div class='menu'>Home</div>", "A text on law that is most of the page"),
    ("<p>a<p>b", "a\nb"),
    ("<p><b>one<br><p>two</p>three", "one\ntwo\nthree"),
    ("<script>x='</p>'</script><p>y</p><style>z</style>", "y"),
    ("<!-- <p>no</p> --><p title='a>b'>yes&nbsp; &lt;ok&gt; &#233;</p>", "yes <ok> é"),
    ("<nav>n</nav><main><p>m</p><form>f</form><div id='comments'>c</div></main><footer>f</footer>", "m"),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x</p></article>", "Title\nx"),
    ("<div class='cookie-notice'>c</div><div class='sidebar'>s</div><p>x</p>", "x"),
    ("<body class='has-sidebar'><p>x</p></body>", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<p>x</p></div></p><p hidden>h</p>y", "x\ny"),
    ("a < b and c", "a < b and c"),
    ("<p>open <i>it", "open it"),
    ("<article class='comment'>c c c c</article><article><p>real text here</p></article>", "real text here"),
    ("<div class='page with-sidebar'><p>whole page</p></div>", "whole page"),
    ("<div class='top'>Site name</div><div class='content'><h2>Head</h2><p>Long enough text of the story</p></div><div class='box'>other</div>", "Head\nLong enough text of the story"),
    ("<p>story</p><div class='comments'><p>a much longer comment than the story itself is</p></div>", "story"),
    ("", ""),
]


@pytest.mark.parametrize("html,text", MARKUP)
def test_markup(html, text):
    assert html_template.main_text(html) == text


def test_empty_and_extra(spark, pages):
    from pyspark.sql import functions as F

    none = pages.limit(0)
    assert html_template.extract(none).collect() == [] and warc_zstd.round_trip(none).collect() == []
    odd = pages.select("*", *[F.lit("own").alias(n) for n in ("host", "subtrees", "digest", "refers_to", "text", "last_id")])
    assert Counter(map(repr, warc_zstd.round_trip(odd).collect())) == Counter(map(repr, warc_zstd.round_trip(pages).collect()))
    assert Counter(map(repr, html_template.extract(odd).collect())) == Counter(map(repr, html_template.extract(pages).collect()))


def test_archives(pages, rows):
    got = Counter(map(tuple, warc_zstd.round_trip(pages).collect()))
    last = {}
    for page_id, _, html in rows:
        if page_id is not None:
            last[html or ""] = max(last.get(html or "", page_id), page_id)
    want = Counter()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = last.get(html or "")
        revisit = len(raw) >= 1000 and to is not None and (page_id is None or page_id < to)
        want[page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None] += 1
    assert got == want


def test_records_by_offset(spark, pages, rows):
    index = warc_zstd.write_bundles(pages)
    wanted = spark.createDataFrame([(5,), (202,)], "page_id long")
    got = {r.page_id: bytes(r.payload).decode() for r in warc_zstd.fetch(index, wanted).collect()}
    assert got == {r[0]: r[2] for r in rows if r[0] in (5, 202)}


def test_a_wrong_place_is_an_error(pages):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    index = warc_zstd.write_bundles(pages)
    swapped = index.withColumn("record_id", F.when(F.col("page_id") == 5, F.lit(warc_zstd.record_id(6))).otherwise(F.col("record_id")))
    assert warc_zstd.read_bundles(index).count() == pages.count()
    with pytest.raises(PythonException, match="not the record"):
        warc_zstd.read_bundles(swapped).collect()
    one = warc_zstd.read_bundles(index.where("page_id = 7")).collect()
    assert [r.page_id for r in one] == [7]


def test_bundle_frames(tmp_path):
    from seamline.llm.scratch import write_file

    w, places, out = warc_zstd.BundleWriter(), [], []
    payloads = [bytes([k]) * 100_000 for k in range(9)]
    for k, p in enumerate(payloads):
        place, chunk = w.add(warc_zstd.record(k, "http://x/", p, hashlib.sha1(p).hexdigest(), None))
        places.append(place)
        out.append(chunk)
    write_file(f"file://{tmp_path}/a.zst", [*out, w.end()])
    b = warc_zstd.Bundle(f"file://{tmp_path}/a.zst")
    assert len(b.places) == 3 and places[-1][0] == 2
    for (frame, offset, _), p in zip(places, payloads):
        assert b.record(frame, offset)[1].endswith(p)
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader((tmp_path / "a.zst").open("rb"), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1") == 9
