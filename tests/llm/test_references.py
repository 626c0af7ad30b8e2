"""Conversion records hold no character references."""

import html

import pytest

from hazegrid.llm import warc


@pytest.mark.parametrize("body", ["&copy; 2024 &middot; caf&eacute;", "&#169;&#xA9;&#x1F600;&#39;&apos;", "a&nbsp;b&#160;c&#xa0;d", "&amp;copy; &amp;lt; &notanentity; &copy &#0; &#xD800; & x", "&NotEqualTilde;&lt;p&gt;", "plain"])
def test_conversion_decodes_all_references(spark, body):
    pages = spark.createDataFrame([(1, "http://x/", f"<p>{body}</p>"), (2, None, None)], "page_id long, url string, html string")
    rows = {(r.page, r.warc_type): r for r in warc.derive(warc.responses(pages)).collect()}
    want = html.unescape(body).replace("\xa0", " ")
    assert rows[1, "conversion"].block == want and rows[2, "conversion"].block == ""
    assert rows[1, "conversion"].content_length == len(want.encode()) and f"text-bytes: {len(want.encode())}\r\n" in rows[1, "metadata"].block
