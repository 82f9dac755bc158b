"""What browsers show: text of CDATA in drawings, values of inputs; not ruby's parentheses; numbers that count down."""

from spanforge.llm import html


def lines(page):
    return html.render(page)[1]


def test_cdata_is_text_in_drawings_and_formulas_only():
    assert "hello > x" in lines("<svg><text><![CDATA[hello > x]]></text></svg>")
    assert "a<b" in lines("<math><mtext>y</mtext><ms>z</ms><mrow><![CDATA[a<b]]></mrow></math>")
    assert lines("<p>x<![CDATA[hello]]>y</p>").strip() == "xy"


def test_values_of_inputs():
    page = "<form><input value=one><input type=TEXT value='two'><input type=password value=no><input type=hidden value=no><input type=checkbox value=no><input type=submit value=three></form>"
    got = lines(page)
    assert all(x in got for x in ("one", "two", "three")) and "no" not in got


def test_ruby_and_reversed_lists():
    assert lines("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>").replace(" ", "") == "ab"
    assert [x.strip() for x in lines("<ol reversed><li>x<li>y<li value=9>z<li>w</ol>").split("\n") if x.strip()] == ["4. x", "3. y", "9. z", "8. w"]
    assert "7. x" in lines("<ol reversed start=7><li>x<li>y</ol>")
