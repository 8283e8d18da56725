"""The scan over JSON, XML and HTML: paths, losslessness, selectors, and time that grows with the text alone."""

import time

import pytest
from helpers import on_values
from pyspark.sql import functions as F

from cloakwork.functions import freetext, scanner, structured

JSON = r'{"a": "x", "b": ["y", {"c": "z\"qé"}, [true, "w"]], "n": 1, "d.e": {"a": null, "b": "\ud800"}}'
XML = '<?xml version="1.0"?><!DOCTYPE a><a k="v" l = \'w>"\'><b/>t &lt;1&gt;<!-- <no> --><c:d>u<![CDATA[<raw>&amp;]]></c:d>&unknown;</a>tail'
HTML = '<P class="a">hi <b>you &eacute;<br>too</b></p><script>var a = "<b>x";</SCRIPT ><style>b</style><!-- n --> end &amp; <i>in'


@pytest.mark.parametrize("form, text", [(f, t) for f in scanner.FORMS for t in (JSON, XML, HTML, "", "<", "a<b", '"', '{"a', "}{][,:", "</x></y>", "<a", "<a b='", "&", "<script>")])
def test_pieces_in_a_row_are_the_text(form, text):
    assert "".join(raw for _, raw, _ in scanner.FORMS[form](text)) == text


def found(form, text):
    return [(path, plain) for path, _, plain in scanner.FORMS[form](text) if plain is not None]


def test_paths_and_texts():
    assert found("json", JSON) == [("$.a", "x"), ("$.b[]", "y"), ("$.b[].c", 'z"qé'), ("$.b[][]", "w")]
    assert found("json", '"only"') == [("$", "only")] and found("json", '["a", "b"]') == [("$[]", "a"), ("$[]", "b")]
    assert found("xml", XML) == [
        ("$.a@k", "v"), ("$.a@l", 'w>"'), ("$.a", "t <1>"), ("$.a.c:d", "u"), ("$.a.c:d", "<raw>&amp;"), ("$.a", "&unknown;"), ("$", "tail"),
    ]
    assert found("html", HTML) == [("p", "hi "), ("b", "you é"), ("b", "too"), ("body", " end & "), ("i", "in")]


def test_selectors_change_only_what_they_name(spark):
    up = F.upper
    change = lambda form, *rules: lambda v: scanner.change_selected(v, form, rules)
    doc = '{"a": "x", "b": ["y", {"c": "z\\"q"}], "n": 1, "bc": "x"}'
    assert on_values(spark, [doc, None, "no json"], change("json", ("$.b[].C", up))) == [doc.replace('z\\"q', 'Z\\"Q'), None, "no json"]
    assert on_values(spark, [doc], change("json", ("$.a", up), ("$.b[]", lambda x: F.concat(x, F.lit("!"))), (None, F.reverse))) == [
        '{"a": "X", "b": ["!y", {"c": "!q\\"z"}], "n": 1, "bc": "x"}'
    ]
    xml = '<r a="v &amp; w" b="v"><x a="v">t</x>u</r>'
    assert on_values(spark, [xml], change("xml", ("$.r@a", up))) == ['<r a="V &amp; W" b="v"><x a="v">t</x>u</r>']
    assert on_values(spark, [xml], change("xml", ("x", up))) == ['<r a="v &amp; w" b="v"><x a="V">T</x>u</r>']
    assert on_values(spark, ["<p>a<b>b&amp;b</b></p>"], change("html", ("b", up))) == ["<p>a<b>B&amp;B</b></p>"]


def test_free_text_rules_with_selectors(spark, key):
    rules = [freetext.TextRule(r.name, r.kind, r.pattern, r.function, r.needs, r.lead, r.head, selector="mail" if r.kind == "EMAIL" else None)
             for r in freetext.DEFAULT_RULES]
    doc = '{"mail": "jane@corp.com and 10.1.2.3", "note": "jane@corp.com and 10.1.2.3"}'
    mail, note = on_values(spark, [doc], lambda v: freetext.mask_leaves(v, "json", key, rules))[0].split('", "note"')
    assert "jane@corp.com" not in mail and "jane@corp.com" in note and "10.1.2.3" not in mail + note
    cells = spark.createDataFrame([("jane@corp.com", "jane@corp.com", 3)], "`e.mail` string, note string, mail_count int")
    only = [r for r in rules if r.kind == "EMAIL"]
    got = freetext.mask_cells(cells, key, only).collect()[0]
    assert got[0] != "jane@corp.com" and tuple(got[1:]) == ("jane@corp.com", 3) and got.__fields__ == cells.columns


def test_all_named_entities_are_read(spark):
    texts = ["caf&eacute; &copy;&Alpha;", "&nosuch; &amp;&#x41;", "a &NotEqualTilde; b"]
    assert on_values(spark, texts, structured.decoded) == ["café ©Α", "&nosuch; &A", "a ≂̸ b"]
    assert on_values(spark, ["<p>caf&eacute; &copy;</p>"], lambda v: structured.change_html_text(v, F.upper)) == ["<p>CAFÉ ©</p>"]
    assert on_values(spark, ["<p>&Eacute;</p>"], lambda v: structured.change_html_text(v, F.upper)) == ["<p>&Eacute;</p>"]


@pytest.mark.parametrize("form, unit", [
    ("json", '{"k": ["text of some length", {"a": 1}]},\n'), ("xml", '<a k="v">text of some length<b/></a>\n'), ("html", "<p>text of some length<br></p>\n"),
    ("xml", "<a>"), ("html", "<i>"), ("json", "["),
])
def test_a_megabyte_in_linear_time(form, unit):
    def spent(size):
        text = unit * (size // len(unit))
        begin = time.process_time()
        count = sum(1 for _ in scanner.FORMS[form](text)) if len(unit) > 4 else None
        if count is None:
            text = text[: size // 100]  # nesting: the paths themselves grow with the depth
            count = sum(1 for _ in scanner.FORMS[form](text))
        return time.process_time() - begin

    spent(1 << 16)
    assert spent(1 << 20) < 12 * max(spent(1 << 18), 0.02)


def test_long_documents_on_spark(spark, key):
    unit = '<row id="7"><name>some name</name><x>10.1.2.3</x></row>'
    text = "<t>" + unit * (500_000 // len(unit)) + "</t>"
    begin = time.time()
    got = on_values(spark, [text], lambda v: structured.mask_xml(v, [structured.LeafRule("t/row/name", "LAST_NAME")], key))[0]
    assert len(got) > 100_000 and "some name" not in got and got.count("10.1.2.3") == text.count("10.1.2.3")
    assert time.time() - begin < 60
