import pytest

from ledgerlight.llm.html import extract_html, html_text

CASES = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b<ol start=3><li>x<li value=9>y</ol></ul>c", "- a\n- b\n  3. x\n  9. y\n\nc"),
    ("<table><tr><th>Name<th>Value<tr><td>aa<td>1<tr><td>longer name<td>22</table>", "Name         Value\naa           1\nlonger name  22"),
    ("<table><tr><td colspan=2>wide<tr><td>a<td>b</table>", "wide\na     b"),
    ("a<script>var t='</p>';</script><style>x</style><!-- y --><template>z</template>b", "ab"),
    ("<div hidden>x</div><div style='display : none'>y</div><dialog>z</dialog>v", "v"),
    ("<div style='visibility:hidden'>h<span style='visibility:visible'>V</span></div>", "V"),
    ("<details><summary>S</summary>closed</details><details open><summary>T</summary>open</details>", "S\nT\nopen"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<title>no</title>x &amp; y&nbsp;z &lt;", "x & y z <"),
    ("<b>bold<i>both</b>still", "boldbothstill"),
    ("<blockquote>q</blockquote>", "> q"),
    ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("<div>" * 5000 + "x", "x"), ("<a href='x>y", "y"), ("text</p>more", "text\n\nmore"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_layout(source, want):
    assert html_text(source) == want


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", "clash"), (1, "u", "<p>x", "clash"), (None, None, None, None), (2, "u", "", "c")], "page_id long, url string, html string, text string")
    out = extract_html(pages)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect() if r.text is not None) == [(1, "x"), (1, "x"), (2, "")] and out.where("text IS NULL").count() == 1
    assert extract_html(pages.limit(0)).count() == 0


def test_truncated_pages_never_fail(spark):
    html = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").first()[0]
    for n in range(0, len(html), 97):
        html_text(html[:n])
