"""Tree builder (T1) on edge cases, pure Python."""

from pagesift.functions.htmltree import build_rows, strip_illegal_xml

HTML_EDGE = ("<html><head><title>T &amp;amp; x</title><script>var t='</p>';</script></head>"
             "<body><p>one<p>two<li>a<li>b<table><tr><td>1<td>2</table>"
             "<!-- c --><div style='display:none'>hidden</div>&#x1;ok&nbsp;</body></html>")


def by_path(html):
    return {r[8]: r for r in build_rows(html)}


def test_implied_end_tags_and_tbody():
    p = by_path(HTML_EDGE)
    assert "/html/body/p[1]" in p and "/html/body/p[2]" in p
    # an li start tag closes the open p (HTML5), so the items sit under body
    assert "/html/body/li[1]" in p and "/html/body/li[2]" in p
    # the open li stays open around the table; tr gets an implied tbody; td closes td;
    # </table> closes the cells (table scope), so later content follows the table
    assert "/html/body/li[2]/table/tbody/tr/td[2]" in p
    assert "/html/body/li[2]/div" in p


def test_script_raw_text_and_single_unescape():
    p = by_path(HTML_EDGE)
    assert p["/html/head/script"][13] == "var t='</p>';"
    assert p["/html/head/title"][13] == "T &amp; x"   # parser decodes once


def test_comment_is_a_node_and_illegal_chars_dropped():
    rows = build_rows(HTML_EDGE)
    assert any(r[5] == "#comment" and r[13] == " c " for r in rows)
    assert strip_illegal_xml("a&#x1;b\x02c&#65;") == "abc&#65;"


def test_formatting_reopened_in_later_paragraphs():
    p = by_path("<body><p><b>x<br><p>y</p><p>z</p></body>")
    assert p["/html/body/p[2]/b"][13] == "y"
    assert p["/html/body/p[3]/b"][13] == "z"


def test_interval_encoding_and_slots():
    rows = build_rows("<body><div>a<span>b</span>c<!--x-->d</div></body>")
    div = next(r for r in rows if r[5] == "div")
    span = next(r for r in rows if r[5] == "span")
    assert div[0] < span[0] <= div[1]
    assert [s[1] for s in div[15]] == ["a", "c", "d"]
    assert [s[0] for s in div[15]] == [1, 2, 3]


def test_void_and_self_closing():
    p = by_path("<body><div/><img src=x><span>a</span></body>")
    # a self-closed div stays open (HTML5); img is void
    assert "/html/body/div/img" in p and "/html/body/div/span" in p
