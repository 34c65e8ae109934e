from datetime import date, datetime

from pyspark.sql import functions as F

from broadsheet.functions import dates as D, hashes as X, html as H, markdown as M, text as T, topics, urls as U


def test_norm_url_dedupe(value):
    cases = {
        "HTTP://Example.com:80/A/../b/?utm_source=x&b=c d#f": "http://example.com/b/?b=c+d",
        "https://x.com": "https://x.com",
        "https://x.com/?ref=1": "https://x.com",
        "https://x.com/a?b=1&c=%20": "https://x.com/a?b=1&c=%20",
        "https://x.com/a?FBCLID=1&b=%20&x": "https://x.com/a?b=+&x=",
        "not a url/ ": "not a url",
        "https://x.com/é?q=é": "https://x.com/%c3%a9?q=%c3%a9",
        "https://x.com/p?a=1&utm_source=y&b=2#z": "https://x.com/p?a=1&b=2",
        "https://x.com/p?a=1&REF=y": "https://x.com/p?a=1",
        "https://x.com/p/?gclid=1&ref_src=2": "https://x.com/p",
        "https://x.com/p?reference=1&preref=2": "https://x.com/p?reference=1&preref=2",
        "https://x.com/p?a&ref=1": "https://x.com/p?a=",
        "https://x.com?ref=1&a=b": "https://x.com/?a=b",
        "https://x.com/../p?ref=1&a=b": "https://x.com/p?a=b",
        "mailto:a#b": "mailto:a",
        "https://[::1]:80/x/": "https://[::1]:80/x",
        "": "",
    }
    for url, key in cases.items():
        assert value(U.norm_url_dedupe, url) == key


def test_norm_title_dedupe(value):
    assert value(U.norm_title_dedupe, "Héllo,  https://x.y/z 世界—42!") == "héllo 世界 42"
    assert value(U.norm_title_dedupe, None) == ""


def test_link_forms(value):
    assert value(U.clean_url, " https://x.com/a)，。") == "https://x.com/a"
    assert value(U.norm_url_link, "https://X.com/a/#b") == "https://x.com/a"
    assert value(U.is_image_url, "https://images.weserv.nl/?url=https%3A%2F%2Fa.com%2Fb.png")
    assert not value(U.is_image_url, "https://images.weserv.nl/?url=https%3A%2F%2Fa.com%2Fb")
    assert value(lambda c: U.on_host(c, "linux.do"), "https://forum.linux.do/t/1")
    assert not value(lambda c: U.on_host(c, "linux.do"), "https://notlinux.do/t/1")
    assert not value(lambda c: U.on_host(c, "linux.do"), "linux.do")


def test_entities_and_tags(value):
    assert value(H.decode_entities, "&#x1F600;&#38;lt;&amp;lt;<![CDATA[x<y]]>&#x110000;") == "😀<<x<y&#x110000;"
    assert value(lambda c: H.xml_tag(c, "summary", "content"), "<summary></summary><content>x</content>") == ""
    assert value(lambda c: H.xml_tag(c, "content", "content:encoded"), "<content:encoded>z</content:encoded>") == "z"
    assert value(lambda c: H.xml_attr(c, "link", "href"), "<link rel='a' href='b&amp;c'/>") == "b&c"
    assert value(H.image_url, '<img src="a"><media:content url="b"/>') == "b"


def test_strip_html(value):
    html = '<p>a <img src="u" alt="t"><img src="v" alt=""> <video src="w">x</video>\n b </p>'
    assert value(H.strip_html, html) == "a [图片: t u][图片: v] [视频: w] b"


def test_utf16(value):
    assert value(T.utf16_length, "a😀😀") == 5
    assert value(lambda c: T.utf16_prefix(c, 3), "a😀😀") == "a😀"
    assert value(lambda c: T.utf16_prefix(c, 4), "a😀😀") == "a😀"
    assert value(lambda c: T.shorten(c, 3), " ab  cdef ") == "ab ..."


def test_fnv_published_vectors(value):
    # Published FNV-1a vectors: "", "a", "foobar".
    for text, number in (("", 0x811C9DC5), ("a", 0xE40C292C), ("foobar", 0xBF9CF968)):
        assert int(value(X.fnv1a_base36, text), 36) == number


def test_parse_pub_date(value):
    cases = {
        "Wed, 08 Jul 2026 07:00:12 +0800": datetime(2026, 7, 7, 23, 0, 12),
        "Tue, 09 Jun 2026 00:00:00 GMT": datetime(2026, 6, 9),
        "2026-03-12T11:28:26.018Z": datetime(2026, 3, 12, 11, 28, 26, 18000),
        "2026-06-08T14:32:52+08:00": datetime(2026, 6, 8, 6, 32, 52),
        "2026-03-12": datetime(2026, 3, 12),
        "12:30": None, "junk": None, None: None,
    }
    for text, expected in cases.items():
        assert value(D.parse_pub_date, text) == expected


def test_window_pins(spark):
    ts = F.lit("2026-03-12T11:28:26.018Z").cast("timestamp")
    row = spark.range(1).select(*[
        D.in_window(ts, F.lit(d).cast("date"), n).alias(f"w{i}")
        for i, (d, n) in enumerate((("2026-03-13", 3), ("2026-03-16", 3), ("2026-03-16", 5)))]).first()
    assert list(row) == [True, False, True]


def test_window_ends_are_inclusive(spark):
    day = F.lit("2026-03-12").cast("date")
    ends = ["2026-03-12T15:59:59.999Z", "2026-03-12T16:00:00.000Z", "2026-03-11T15:59:59.999Z", "2026-03-11T15:59:59.998Z"]
    row = spark.range(1).select(*[
        D.in_window(F.lit(e).cast("timestamp"), day, 1).alias(f"e{i}") for i, e in enumerate(ends)]).first()
    assert list(row) == [True, False, True, False]


def test_dates(value, spark):
    assert value(lambda c: D.shanghai_date(c.cast("timestamp")), "2026-03-12T16:00:00Z") == date(2026, 3, 13)
    assert value(lambda c: D.shift_date(c.cast("date"), -240), "2026-03-17") == date(2025, 7, 20)
    assert value(lambda c: D.rfc822(c.cast("timestamp")), "1970-01-01T00:00:00Z") == "Thu, 01 Jan 1970 00:00:00 GMT"


def test_topics(value):
    def check(c):
        return topics.on_topic(c, F.lit(""))
    assert value(check, "A transformer trained on single-cell maps of ageing mice")
    assert value(check, "An AI model of disease")
    assert not value(check, "A maid and a disease")  # "ai" inside a word does not count
    assert value(check, "brain age of mice")


def test_top_numbering(value):
    text = "## **今日 AI 生命科学资讯**\n\n## **本周最受欢迎 TOP 3**\n\n### [一](u)\n\nx\n\n### 5. 二\n\n### 三\n---\n## **其他**\n### 四"
    out = value(M.top_numbering, text)
    assert "### 1. [一](u)" in out and "### 5. 二" in out and "### 3. 三" in out and "\n### 四" in out
    assert value(M.normalize_body, "写在前面\n\n" + text).startswith("## **今日 AI 生命科学资讯**")
    assert value(M.normalize_body, "x ## **今日") == "## **今日"


def test_drop_toc_and_images(value):
    markdown = ("\n第一段文字。\n\n## Table of contents\n\n- [一](#一)\n\n![页面](https://www.s.com/a.htm)\n\n"
                "![照片](https://pics.example/roof.jpg)\n\n![no](https://bad.com/i.png)\n")
    allowed = F.array(F.lit("https://www.s.com/a.htm"), F.lit("https://pics.example/roof.jpg"))
    out = value(lambda c: M.normalize_markdown(c, allowed, ("https://github.com",)), markdown)
    assert out == "第一段文字。\n\n[页面](https://www.s.com/a.htm)\n\n![照片](https://pics.example/roof.jpg)"
    assert value(M.drop_toc, "\n" * 5000 + "## 目录\n" + "\n" * 20000 + "x") == "x"  # no recursion on long runs


def test_markdown_links(value):
    text = '![a](https://x/i.png) [b](https://x/y) [c](ftp://z) [d](https://q/w "t")'
    assert [tuple(r) for r in value(M.md_links, text)] == [("b", "https://x/y"), ("d", "https://q/w")]
    assert [tuple(r) for r in value(M.md_images, text)] == [("a", "https://x/i.png")]


def test_description(value):
    text = "## Table of contents\n\n![图](https://e.com/i.jpg)\n\n周末把屋顶的传感器换了一遍，花的时间比想象中短，剩下的半天都在整理读数。\n"
    out = value(lambda c: M.derive_description(c, F.lit("t")), text)
    assert out.startswith("周末把屋顶") and "Table" not in out
    assert len(value(lambda c: M.derive_description(c, F.lit("t")), "w " * 80)) == 120


def test_placeholders(value):
    text = "[图片: a  b https://e/x.png] [视频: https://e/v.mp4][视频: t https://e/v][图片: foo]"
    out = value(M.placeholders_to_md, text)
    assert out.startswith("![a b](https://e/x.png) <video") and out.endswith("</video>[t](https://e/v)[图片: foo]")


def test_replies(value):
    assert value(T.unwrap_code_fence, "x ```json\n{a}\n``` y") == "{a}"
    assert value(lambda c: T.json_object_slice(c, 25000), "a {b{c} d} e") == "{b{c} d}"
    assert value(lambda c: T.json_object_slice(c, 25000), "} {") is None
    assert value(lambda c: T.json_object_slice(c, 5), "{'a':1}") is None
    assert value(T.last_three_lines, "a\n\nb \n c\r\nd") == "b\nc\nd"
    assert value(T.strip_front_matter, "---\na: b\n---\nbody") == "body"


def test_backslash_in_a_path_takes_the_long_way(value):
    from broadsheet.functions.urls import norm_url_dedupe
    assert value(norm_url_dedupe, "https://x.com/a\\b") == value(norm_url_dedupe, "https://X.com/a\\b") == "https://x.com/a/b"
