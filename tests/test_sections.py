"""Sections of pages: what is kept, in which order, and what is left out."""

import pytest

from millrace.operators import web

CASES = {
    "headings": ("<h1>A <i>b</i></h1><h3>C</h3>", [("heading", 1, "A b"), ("heading", 3, "C")]),
    "hidden": ('<p hidden>a</p><p style="color: red; display: none">b</p><div aria-hidden="true"><p>c</p></div><p style="opacity:0">d</p><dialog><p>e</p></dialog><dialog open><p>f</p></dialog><p>g</p>', [("paragraph", None, "f"), ("paragraph", None, "g")]),
    "hidden inside": ('<p>a <span style="visibility: hidden">b</span>c</p>', [("paragraph", None, "a c")]),
    "links": ('<a href="/x">go there</a><p>see <a href="/y">this</a></p><a href="/z"></a><div role="link">far</div>', [("link", None, "go there (/x)"), ("paragraph", None, "see this"), ("link", None, "far (link role)")]),
    "labels": ('<img alt="a cat"><img src="x"><hr><button>Go</button><span role="button">Buy</span><details><summary>More</summary><p>text</p></details><svg aria-label="home"><path/></svg><svg><title>cart</title></svg>', [("paragraph", None, "[Image: a cat]"), ("paragraph", None, "---"), ("paragraph", None, "[Button: Go]"), ("paragraph", None, "[Button: Buy]"), ("heading", None, "[summary: More]"), ("paragraph", None, "text"), ("paragraph", None, "[Icon: home]"), ("paragraph", None, "[Icon: cart]")]),
    "forms": ('<form><input name="q" placeholder="find"><input type="hidden" name="t"><select id="s"><option>one</option></select></form>', [("paragraph", None, "[Form Start]"), ("paragraph", None, '[Form Element: input name="q" placeholder="find"]'), ("paragraph", None, '[Form Element: select id="s"]')]),
    "frames": ('<iframe src="/f" title="map"></iframe><iframe></iframe><video src="v.mp4" aria-label="tour">no video</video><audio></audio>', [("paragraph", None, "[Iframe: map](/f)"), ("paragraph", None, "[video: tour](v.mp4)"), ("paragraph", None, "[audio: audio]")]),
    "stray text": ("<div>short</div><div>this is text outside of any paragraph</div><p>in</p>", [("paragraph", None, "this is text outside of any paragraph"), ("paragraph", None, "in")]),
    "lists": ("<dl><dt>a<dd>b</dl><ol><li>c<p>d</p></ol><table><tr><th>e<td>f</table>", [("list", None, "a b"), ("list", None, "c d"), ("table", None, "e f")]),
    "never": ("<script>x()</script><style>p{}</style><template><p>t</p></template><nav><p>menu</p></nav><p>kept", [("paragraph", None, "kept")]),
    "broken": ("</div><p>a<p>b<div><b>c is a text that goes on for long</div></p></section>", [("paragraph", None, "a"), ("paragraph", None, "b"), ("paragraph", None, "c is a text that goes on for long")]),
    "nothing": ("", []),
}


@pytest.mark.parametrize("case", CASES)
def test_sections(case):
    html, want = CASES[case]
    assert web.sections_of(html) == want


def test_menus_on_demand_and_odd_pages(spark):
    rows = spark.createDataFrame([(1, "<nav><p>menu</p></nav>"), (2, None), (3, "<div>" * 3000 + "<p>deep</p>"), (None, "<p>x</p>"), (4, "<p>&amp; &#233;")], "page_id long, html string")
    texts = lambda df: sorted((r.page_id or 0, r.text) for r in df.collect())
    assert texts(web.html_sections(rows)) == [(0, "x"), (3, "deep"), (4, "& é")]
    assert texts(web.html_sections(rows, around=True))[1] == (1, "menu")
