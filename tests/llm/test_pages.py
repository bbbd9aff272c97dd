import gzip
import hashlib
import html
import io
import re

import pytest
from pyspark.sql import functions as F

from geotrail.llm import warc
from geotrail.llm.html_extract import best_stretch, extract_text, fit_weights, main_text, tokens
from geotrail.llm.url_filter import UrlTrie, judge_urls, split_url
from geotrail.session import scratch_path

WEIGHTS = fit_weights()


# --- HTML ------------------------------------------------------------------

def test_known_layout_of_the_given_pages(spark, sf_small):
    """The given pages hold their text in one article of h1 and p blocks."""
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        body = r.html.split("<article>", 1)[1].split("</article>", 1)[0]
        parts = re.split(r"</?(?:p|h1)>", body)
        clean = (" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in parts)
        want = "\n\n".join(x for x in clean if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


STORY = "A plain sentence of the story, as long as sentences usually are, follows here."


@pytest.mark.parametrize("around,inside", [
    ("<nav><ul><li><a href=/>Home page</a></ul></nav>{}<footer>some words &copy; here</footer>", "{}"),
    ('<div id="sidebar"><p>' + STORY + "</p></div><div>{}</div>", "{}"),
    ('{}<section class="comments"><h2>Comments</h2><div class="comment"><p>' + STORY * 3 + "</p></div></section>", "{}"),
    ('<div class="cookie-banner"><p>' + STORY + "</p></div>{}", "{}"),
    ("{}<form><label>Your name</label><p>" + STORY + "</p><textarea>words in here</textarea></form>", "{}"),
    ("<header><p>Site name and motto</p></header>{}", '{}<div class="advert">' + STORY + "</div>"),
    ("<script>var a = '<p>words</p>';</script><style>p {{ x }}</style>{}", "{}<!-- a note <p>words</p> -->"),
    ("{}", '{}<aside class="related"><h3>More</h3><p>' + STORY + "</p></aside>"),
    ('<div class="layout no-sidebar has-banner"><div role="navigation">Some links</div><main>{}</main></div>', "{}"),
    ('<div class="site-header">The site</div><article class="post">{}</article><div class="page-footer">x y</div>',
     '<header class="entry-header">{}</header>'),
    ('<ul class="menu"><li>One<li>Two</ul><table><tr><td>{}</td></tr></table>', "{}"),
    ('{}<div class="post-comments"><ol><li><p>' + STORY * 2 + "</p><li><p>" + STORY + "</p></ol></div>", "{}"),
    ("{}<ins class=adsbygoogle>" + STORY + "</ins><noscript>" + STORY + "</noscript>", "<div>{}</div>"),
])
def test_surroundings_are_left_out(around, inside):
    first = "<h1>The head</h1><p>" + STORY + " One &amp; two&nbsp;<b>bold</b>word.<br>next</p>"
    page = around.format(inside.format(first) + "<p>Last  \n block " + STORY + "</p>")
    assert main_text(f"<html><body>{page}</body></html>", WEIGHTS) == "\n\n".join(
        ["The head", STORY + " One & two boldword. next", "Last block " + STORY])


@pytest.mark.parametrize("mark", [
    '<section id="related-work">', '<section id="discussion">', '<div class="commercial-use">', '<section id="search">',
    '<div class="section" id="header-files">', '<div class="section" id="warning">', '<section id="tags" class="level2">',
    '<section id="navigation">', '<div id="social-history">', '<section class="book-reviews-of-1900">'])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "<main><div class=post>{}</div></main>"])
def test_sections_with_a_hint_in_their_name_are_kept(mark, around):
    end = "</" + re.match(r"<(\w+)", mark)[1] + ">"
    body = f"<h1>The head</h1><p>{STORY}</p>{mark}<h2 id=reviews>A part</h2><p>{STORY * 2}</p>{end}<p>{STORY} Last.</p>"
    assert main_text("<nav><a href=/>Home</a></nav>" + around.format(body), WEIGHTS) == "\n\n".join(
        ["The head", STORY, "A part", STORY * 2, STORY + " Last."])


@pytest.mark.parametrize("mark", ["class=warning", "id=discussion", "class='admonition notice'", "id=social"])
def test_ambiguous_names_inside_an_article_are_kept(mark):
    page = f"<article><p>{STORY}</p><div {mark}><p>{STORY * 2}</p></div><p>{STORY}</p></article>"
    assert main_text(page, WEIGHTS) == "\n\n".join([STORY, STORY * 2, STORY])
    outside = f"<div {mark}><p>{STORY}</p></div><div><p>{STORY * 2}</p></div>"
    assert main_text(outside, WEIGHTS) == STORY * 2


@pytest.mark.parametrize("wrapper,body", [
    ('<form id="aspnetForm">', "<article>{}</article>"), ('<div class="content-sidebar-wrap">', "<article>{}</article>"),
    ('<div class="content-sidebar-wrap">', "<main>{}</main>"), ('<div class="sidebar widget">', '<div class="post">{}</div>'),
    ('<form method="post">', "<nav><a href=/>Home</a></nav><div>{}</div>"), ('<header class="banner">', "<main>{}</main>"),
    ('<form id="aspnetForm"><div class="comments-sidebar">', "<main>{}</main>"),
    ('<div class="content-sidebar-wrap">', "<article>{}</article><article><p>" + STORY + "</p></article>"),
])
def test_main_text_in_a_wrapper_with_a_mark_is_kept(wrapper, body):
    page = wrapper + body.format(f"<h1>The head</h1><p>{STORY * 2}</p><p>{STORY}</p>")
    page += f'<aside><p>{STORY}</p></aside><div class="newsletter"><p>{STORY}</p></div>'
    page += "".join(f"</{x}>" for x in reversed(re.findall(r"<(\w+)", wrapper)))
    want = ["The head", STORY * 2, STORY] + ([STORY] if body.count("<article>") == 2 else [])
    assert main_text(f"<body>{page}</body>", WEIGHTS) == "\n\n".join(want)


@pytest.mark.parametrize("box", [
    '<aside><article><p>{}</p></article></aside>', '<section class="comments"><article><p>{}</p></article></section>',
    '<div class="sidebar"><article><p>{}</p></article></div>', '<form><h1>Sign up</h1><p>{}</p></form>'])
def test_articles_inside_boxes_stay_out(box):
    page = f"<article><p>{STORY * 3}</p>{box.format(STORY)}<p>{STORY}</p></article>" + box.format(STORY)
    assert main_text(page, WEIGHTS) == STORY * 3 + "\n\n" + STORY
    assert main_text(f"<div><p>{STORY * 3}</p></div>" + box.format(STORY), WEIGHTS) == STORY * 3


LINKS = "<li><a href=/x>Link</a></li>" * 30


@pytest.mark.parametrize("box", [
    f"<nav><ul>{LINKS}</ul></nav>", f'<div class="sidebar"><ul>{LINKS}</ul></div>', f"<aside><h3>More</h3>{LINKS}</aside>",
    f'<div class="comments">{"<div><p><b>a</b></p></div>" * 60}</div>', f'<div class="related"><ul>{LINKS}</ul></div>',
    f'<div class="advert">{"<p></p><img>" * 60}</div>', f"<form>{'<label>a<input></label>' * 60}</form>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>"])
def test_long_box_between_two_parts(box, around):
    for first, second in ((STORY, STORY * 9), (STORY * 9, STORY), ("Intro.", STORY * 9)):
        page = around.format(f"<h1>The head</h1><p>{first}</p>{box}<p>{second}</p>")
        assert main_text(page, WEIGHTS) == "\n\n".join(["The head", first, second])


def test_data_tables_and_link_lists_do_not_split_an_article():
    cells = "<tr>" + "<td>1</td><td></td><td></td>" * 3 + "</tr>"
    for around in ("<article>{}</article>", "<div>{}</div>"):
        got = main_text(around.format(f"<p>{STORY}</p><table>{cells * 40}</table><p>{STORY * 9}</p>"), WEIGHTS)
        assert got.startswith(STORY + "\n\n1\n\n") and got.endswith("1\n\n" + STORY * 9)
    got = main_text(f"<article><p>{STORY}</p><ul>{LINKS}</ul><p>{STORY * 9}</p></article>", WEIGHTS)
    assert got.startswith(STORY) and got.endswith(STORY * 9)


@pytest.mark.parametrize("element", [
    "<svg class=icon />", "<math/>", '<iframe src="/x" />', '<object data="/x" />', "<noscript>", "<object>", "<select>",
    "<template>", "<svg>", "<iframe>", '<svg><svg viewBox="0"/><svg><text>a label</text></svg><text>more words</text></svg>',
    "<object><object>inner</object> outer words</object>", "<template><template>a</template><p>words</p></template>",
    "<!-- <svg> --><svg class='a>b' />", "<noscript><!-- </noscript> -->some words</noscript>", "<SVG\nID=x/>"])
def test_skipped_elements_end_where_they_end(element):
    later = "<svg><text>a label</text></svg><iframe></iframe><object></object><math></math>"
    page = f"<article><p>{STORY}</p><div>{element}</div><p>{STORY * 2}</p></article><footer>{later}</footer>"
    kept = " ".join(re.sub("<!--.*?-->|<[^>]*>", " ", element if "template" not in element else "").replace("b' />", "").split())
    got = main_text(page, WEIGHTS)      # words of svg, object and noscript are kept in an article
    assert " ".join(got.split()) == " ".join(f"{STORY} {kept} {STORY * 2}".split())
    before = f"{element}<article><p>{STORY}</p></article>"
    assert main_text(before, WEIGHTS) == STORY


def test_many_elements_without_an_end_take_linear_time():
    page = "<article>" + f"<p>{STORY}<object><svg><iframe></p>" * 20_000 + "</article>"
    assert main_text(page, WEIGHTS).count(STORY) == 20_000


@pytest.mark.parametrize("element", [
    "<p>so <math><mi>x</mi></math> here</p>", "<object data=/x>so x here</object>", "<noscript><p>so x here</p></noscript>",
    "<svg viewBox=0><text>so x here</text><style>p</style></svg>", '<p class="byline">so x here</p>',
    '<div class="tags">so x here</div>', '<div class="entry-meta"><span>so x here</span></div>',
    '<div class="share">so x here</div>', '<div class="social"><p>so x here</p></div>', "<noscript>so x<div> here</noscript>"])
def test_other_elements_of_an_article_are_kept(element):
    page = f"<article><p>{STORY}</p>{element}<p>{STORY * 2}</p></article>"
    got = main_text(page, WEIGHTS)
    assert re.sub(r"\s+", " ", got) == f"{STORY} so x here {STORY * 2}"
    outside = re.search("<math.*</math>", element)[0] if "<math" in element else element
    assert main_text(outside + page + outside, WEIGHTS) == got


def test_hinted_boxes_with_a_second_sign_are_left_out():
    box = '<div id="related-work"><a href=/1>One title</a> <a href=/2>Other title</a></div>'
    page = f'<article><p>{STORY}</p>{box}<p>{STORY}</p></article><section id="discussion"><p>{STORY}</p></section>'
    assert main_text(page, WEIGHTS) == STORY + "\n\n" + STORY


INTRO = "Fifteen words make the first paragraph of this story, which pictures may not cut off here."


@pytest.mark.parametrize("middle", [
    "<figure><img src=a></figure>" * 20, "<hr><img>" * 40, "<p><a href=/1>one</a> <a href=/2>two</a></p>" * 30,
    "<div><div><br><br></div></div>" * 50, "<p></p>" * 200, "<table><tr><td><table></table></td></tr></table>" * 20])
@pytest.mark.parametrize("main", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>'])
def test_no_part_of_the_main_element_is_lost(main, middle):
    page = "<nav><a href=/>Home</a></nav>" + main.format(f"<h1>The head</h1><p>{INTRO}</p>{middle}<p>{STORY * 3}</p>{middle}<p>End.</p>")
    links = ["one two"] * 30 if "one" in middle else []
    want = ["The head", INTRO, *links, STORY * 3, *links, "End."]
    assert main_text(page + "<footer>foot</footer>", WEIGHTS) == "\n\n".join(want)


def test_a_title_right_before_the_article_is_kept():
    for page in ("<main><h1>The <b>head</b></h1><article><p>{}</p></article></main>",
                 "<div><h1>The <b>head</b></h1><article><p>{}</p></article></div>",
                 "<header>x</header><h1>The <b>head</b></h1>\n<article><p>{}</p></article><aside><h1>Other</h1>y</aside>"):
        assert main_text(page.format(STORY), WEIGHTS) == f"The head\n\n{STORY}"


@pytest.mark.parametrize("element", ["<p hidden>so x here</p>", '<div style="display: none"><p>so x here</p></div>',
                                     '<p aria-hidden="true">so x here</p>', "<iframe>so x here</iframe>"])
def test_hidden_parts_are_kept_inside_an_article_only(element):
    page = f"<article><p>{STORY}</p>{element}<p>{STORY}</p></article>"
    assert main_text(element + page + element, WEIGHTS) == "\n\n".join([STORY, "so x here", STORY])


@pytest.mark.parametrize("comments", [
    "<h3>12 Comments</h3><ul><li><p>{}</p></li><li>{}</li></ul>", "<h2>Comments</h2><div><p>{}</p></div><div>{}</div>",
    '<div id="responses"><p>{}</p><p>{}</p></div>', "<section><h2>3 Responses to the story</h2><ol><li>{}</li><li>{}</li></ol></section>",
    "<h3>Comments (2)</h3><p>{}</p><p>{}</p>", '<div class="right-col"><p>{}</p><p>{}</p></div>'])
@pytest.mark.parametrize("around", ["<article>{}</article>{}", "<main><article>{}</article>{}</main>"])
def test_comments_and_side_columns_without_a_clear_name_are_left_out(comments, around):
    page = around.format(f"<h1>The head</h1><p>{STORY * 2}</p>", comments.format(STORY, STORY * 2))
    assert main_text(page + "<footer>foot</footer>", WEIGHTS) == f"The head\n\n{STORY * 2}"


@pytest.mark.parametrize("heading", ["Discussion", "Comments on the law", "Replies were late", "Three comments by an expert"])
def test_headings_of_an_article_that_only_sound_like_comments(heading):
    page = f"<article><p>{STORY}</p><h2>{heading}</h2><p>{STORY * 2}</p></article>"
    assert main_text(page, WEIGHTS) == "\n\n".join([STORY, heading, STORY * 2])


@pytest.mark.parametrize("bit", [("<b>", "</i>"), ("<i><div><b>", "</i>"), ("<b>", "<div></div>"), ("<li><b>", "</ul>"),
                                 ("<p><b>", "<p>"), ("<td><span>", "</td></tr>"), ("<div>", "</span>"), ("<h2>", "</h2>")])
def test_unclosed_and_stray_tags_take_linear_time(bit):
    import time

    def seconds(n):
        page = "<article><p>" + bit[0] * n + STORY + bit[1] * n + "</article>"
        began = time.process_time()
        assert STORY.split()[0] in main_text(page, WEIGHTS)
        return time.process_time() - began
    seconds(1000)
    assert seconds(100_000) < 12        # a megabyte of tags


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("just text &lt;b&gt; here", "just text <b> here"),
    ("<nav>only a menu</nav>", ""), ("<p>cut off in the mid", "cut off in the mid"), ("<p>a < b and c &am", "a < b and c &am"),
    ("<script>never closed", ""), ("<!-- never closed", ""), ('<p title="a > b">quoted</p>', "quoted"),
    ("<div hidden><p>hidden words</p></div><p>seen words</p>", "seen words"),
    ("<P>Upper</P><p>lower", "Upper\n\nlower"), ("</p></div>words after ends", "words after ends"),
])
def test_broken_and_empty_pages(page, want):
    assert main_text(page, WEIGHTS) == want


def test_best_stretch_by_brute_force():
    import random
    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-2.0, -0.5, 0.0, 1.0, 3.0]) for _ in range(rng.randrange(0, 14))]
        a, b = best_stretch(s)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)), default=0.0)
        assert sum(s[a:b]) == pytest.approx(max(0.0, best))


def test_weights_have_the_right_sign():
    assert all(w < 0 for w in WEIGHTS.tags.values()) and WEIGHTS.other_tag < 0
    assert WEIGHTS.word(0) > 0
    menu = next(t for t in tokens("<nav><a href=/>x</a></nav>") if t[0] == "text")
    assert WEIGHTS.word(menu[2]) == 0


def test_very_long_page_and_extra_columns(spark):
    page = "<article>" + ("<p>" + STORY + "</p>") * 20_000 + "</article>"
    df = spark.createDataFrame([(1, page, "t"), (1, page, "t"), (None, None, None)],
                               "page_id long, html string, text string")
    got = extract_text(df).collect()
    assert sorted(r.n_chars for r in got) == [0, *[20_000 * (len(STORY) + 2) - 2] * 2]
    assert extract_text(df.limit(0)).collect() == []


# --- URLs ------------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "Example.net", "/en/"), ("block", "example.com", "/de"),
         ("allow", "example.com", "/de/ok"), ("allow", "a.b", ""), ("block", "a.b", "/x"), ("block", "a.b", ""),
         ("allow", "b", "/x/y")]
URLS = [None, "", "no scheme", "http://", "http://net/", "http://NET", "http://x.example.net/en/a?q#f",
        "https://example.net/en", "//example.net/en/", "ftp://notexample.net/en/", "http://example.com/deutsch",
        "http://www.example.com/de/okay/x", "http://example.com/d", "http://a.b", "http://a.b/x/y", "http://c.b/x/yz",
        "http://c.b/x/y", "http://example.com?/de/", "http://example.com#/de/", "http://é.net/ü", "http://u@net:80/",
        "x://y://net/"]


def brute_rule(host, path, default="allow"):
    fits = [(len(h.split(".")), len(p), v == "block", v, h + p) for v, h, p in RULES
            if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    if not fits:
        return default, None
    best = max(fits)
    return best[3], best[4]


def test_urls_against_a_scan_of_all_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[4], "x")],
                               "page_id long, url string, rule string")
    for r in judge_urls(df, RULES).collect():
        host, path = split_url(r.url)
        assert (r.host, r.path) == (host, path)
        assert (r.verdict, r.rule) == brute_rule(host, path)
    assert judge_urls(df.limit(0), RULES).collect() == []
    assert {r.verdict for r in judge_urls(df, [], default="block").collect()} == {"block"}


def test_split_url():
    assert split_url("HTTP://Ab.C/P/q?x#y") == ("ab.c", "/P/q")
    assert split_url("a://b?c/d") == ("b", "") and split_url("a://b/c#d?e") == ("b", "/c")


def test_trie_refuses_unknown_verdicts_and_too_many_rules(monkeypatch):
    with pytest.raises(ValueError):
        UrlTrie([("maybe", "a", "/")])
    monkeypatch.setattr("geotrail.llm.url_filter.MAX_RULES", 1)
    with pytest.raises(ValueError):
        UrlTrie(RULES)


# --- WARC ------------------------------------------------------------------

BIG = "<p>" + "x" * 1200 + "é</p>"
PAGES = [(1, "http://a/", BIG), (5, "http://b/", BIG), (3, None, BIG), (None, "http://c/", BIG), (7, "u\r\nWARC-Type: x", "s"),
         (8, "http://d/", "s"), (9, "http://e/", None), (10, "http://f/", ""), (11, "http://g/", "\r\n\r\n" + "ü" * 3000),
         (12, "http://h/", "y" * 3_000_000), (5, "http://b/", BIG)]


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, id string")
    return warc.archive_pages(df.repartition(3))


def test_archive_round_trip(spark, archive):
    rows = warc.read_warc(spark, archive).collect()
    assert len(rows) == len(PAGES)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.record_id, []).append(r)
    for i, url, page in PAGES:
        body = (page or "").encode()
        for r in by_id[f"urn:page:{'' if i is None else i}"]:
            assert r.payload_digest == hashlib.sha1(body).hexdigest() and r.payload_length == len(body)
            revisit = page == BIG and i != 5
            assert r.record_type == ("revisit" if revisit else "response")
            assert r.refers_to == ("urn:page:5" if revisit else None)
            assert r.payload == (None if revisit else body)
            assert r.target_uri == (url if url is None or "\r" not in url else "u%0D%0AWARC-Type: x")


def test_filters_reach_the_source(spark, archive):
    df = warc.read_warc(spark, archive).filter("record_type = 'revisit' and payload_length > 5")
    assert {r.record_id for r in df.collect()} == {"urn:page:1", "urn:page:3", "urn:page:"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "RuntimeFilters: []" in plan
    some = warc.read_warc(spark, archive, payload=False).filter(F.col("target_uri").startswith("http://d"))
    assert [r.record_id for r in some.collect()] == ["urn:page:8"]


def test_unwanted_payloads_are_not_inflated(spark, archive):
    fs, root = warc._file_system(archive)
    inflated = 0
    for info in fs.get_file_info(__import__("pyarrow").fs.FileSelector(root)):
        if info.path.endswith(".gz"):
            with fs.open_input_file(info.path) as f:
                m = warc.MemberReader(f)
                list(m.records(lambda r: r["record_id"] == "urn:page:12", True))
                inflated += m.inflated
    assert inflated == 1


def test_members_are_plain_gzip(archive):
    fs, root = warc._file_system(archive)
    found = b""
    for info in fs.get_file_info(__import__("pyarrow").fs.FileSelector(root)):
        if info.path.endswith(".gz"):
            with fs.open_input_file(info.path) as f:
                found += gzip.GzipFile(fileobj=io.BytesIO(f.read())).read()
    assert found.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)


def test_files_of_failed_tasks_are_not_read(spark, archive):
    fs, root = warc._file_system(archive)
    with fs.open_output_stream(f"{root}/part-left-over.warc.gz", compression=None) as s:
        s.write(b"broken")
    assert warc.read_warc(spark, archive, payload=False).count() == len(PAGES)


def test_empty_table_and_rolled_files(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.archive_pages(df)).collect() == []
    path = scratch_path(spark, "rolled")
    records = warc.archive_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    records.select(*warc.SCHEMA_NAMES).coalesce(1).write.format("warc").mode("append").option("path", path) \
        .option("file_bytes", "300").save()
    assert warc.read_warc(spark, path).count() == len(PAGES)
