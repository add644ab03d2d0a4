"""Text, cloze, template, comparison, time and memory functions."""

import math

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import answerdiff, cloze, memory, spans, template
from recallgrid.functions import text as tx
from recallgrid.model import Timing, timing


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).collect()[0][0]


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (tx.strip_html, "a<br>b&nbsp;c &lt;d&gt; <!-- x --><style>y</style><script>z</script>", "ab c <d> "),
        (tx.strip_html_keep_media, "<img src='foo.jpg'> <img src=bar.jpg><img src=\"a b.png\">x", " foo.jpg   bar.jpg  a b.png x"),
        (tx.to_text_line, "a<br>b<div>c</div>\nd [[type:Front]][sound:x.mp3]", "a b c d"),
        (tx.strip_clozes, "a {{c1::b::hint}} {{c12,3::c}}", "a b c"),
        (tx.strip_av_tags, "a[sound:b.mp3]c", "ac"),
        (tx.media_refs, "<img src=\"a.png\">[sound:b.mp3]<IMG class=x SRC='c d.jpg'><img src=\"http://x/y.png\">", ["a.png", "c d.jpg", "b.mp3"]),
        (tx.underscored_refs, '<style>@import "_a.css"; @import url("_b.css")</style><img src="_c.png"><img src="d.png">', ["_a.css", "_b.css", "_c.png"]),
        (tx.latex_parts, "[latex]a[/latex] [$]b[/$] [$$]c[/$$]", ["a", "b", "c"]),
        (tx.without_accents, "größte conjunção ÆŁ", "groste conjuncao AEL"),
        (tx.tag_list, " a  b　c ", ["a", "b", "c"]),
        (tx.field_checksum, "", 0xDA39A3EE),
        (tx.normalized_field, "a\x00é\tb", "aé\tb"),
        (lambda c: tx.field_at(c, 1), "a\x1fb", "b"),
        (lambda c: tx.field_at(c, 5), "a\x1fb", ""),
        (lambda c: tx.joined_tags(tx.tag_list(c)), " a b", " a b "),
    ],
)
def test_text(spark, make, text, want):
    assert one(spark, text, make) == want
    assert one(spark, None, make) in (None, "", []) or make is tx.field_checksum


def test_paths(spark):
    text = '<img src="a b#c.png"> <img src=é.jpg> <img src="http://x/a b">'
    coded = one(spark, text, tx.encode_paths)
    assert coded == '<img src="a%20b%23c.png"> <img src=%C3%A9.jpg> <img src="http://x/a b">'
    assert one(spark, coded, tx.decode_paths) == text
    assert one(spark, None, tx.encode_paths) is None


def test_globs():
    assert tx.is_glob("a*") and not tx.is_glob(r"a\*") and tx.is_glob(r"a\\*")
    assert tx.glob_to_regex(r"a*b_\*\_.") == r"a.*b.\*_\."
    assert tx.glob_to_like(r"a*%\*\\") == r"a%\%*\\"
    assert tx.unescaped(r"\*a\_") == "*a_"


def test_fnv(spark):
    rows = [(1, 2), (-5, 7), (1 << 40, 0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a bigint, b bigint").select(tx.fnv_hash("a", "b")).collect()]
    assert got == [tx.fnv1a(a, b) for a, b in rows]


def test_cloze():
    assert cloze.numbers("{{c1::a}} {{c3,2::b {{c5::c}}}} {{c0::d}}") == [1, 2, 3, 5]
    assert cloze.numbers("{{c1::never closed") == [] and cloze.numbers("}} {{c::x}}") == []
    assert cloze.reveal("a {{c1::b::h}} {{c2::c}}", 1, True) == 'a <span class="cloze" data-cloze="b" data-ordinal="1">[h]</span> <span class="cloze-inactive" data-ordinal="2">c</span>'
    assert cloze.reveal("a {{c1::b}}", 1, False) == 'a <span class="cloze" data-ordinal="1">b</span>'
    assert cloze.reveal("a {{c1::b}}", 2, True) == ""
    assert cloze.contains_cloze("a {{c2::b}}") and not cloze.contains_cloze("{{c0::b}}") and not cloze.contains_cloze("{{c1::b")
    assert cloze.reveal_only("{{c1::a}} x {{c1::b::h}}", 1, True) == "..., h"
    assert cloze.for_typing("{{c1::a}} {{c1::a}}", 1) == "a" and cloze.for_typing("{{c1::a}} {{c1::b}}", 1) == "a, b"
    assert cloze.for_typing("{{c1::x {{c2::y}} z}}", 1) == "x y z"


def test_templates():
    parse, render = template.parse, template.render
    fields = {"Front": "a", "Back": "", "Text": "{{c1::x}} y"}
    assert render(parse("{{Front}}{{#Back}}no{{/Back}}{{^Back}}yes{{/Back}}<!-- {{Gone}} -->"), fields) == "ayes<!-- {{Gone}} -->"
    assert render(parse("{{text:Front}} {{type:Front}} {{cloze:Text}}"), {**fields, "Front": "<b>a</b>"}) == 'a [[type:Front]] <span class="cloze" data-cloze="x" data-ordinal="1">[...]</span> y'
    assert render(parse("{{FrontSide}}!"), fields, front="q[sound:a.mp3]") == "q!"
    assert render(parse("{{kana:Front}}|{{kanji:Front}}"), {"Front": " 日本[にほん]"}) == "にほん|日本"
    assert render(parse("{{=<% %>=}}<%Front%>"), fields) == "a"
    for text, kind in (("{{Front", "NoClosingBrackets"), ("{{#Front}}x", "ConditionalNotClosed"), ("{{/Front}}", "ConditionalNotOpen"), ("{{#Front}}{{/Back}}", "ConditionalNotOpen")):
        with pytest.raises(template.TemplateError) as e:
            parse(text)
        assert e.value.kind == kind
    with pytest.raises(template.TemplateError):
        render(parse("{{Gone}}"), fields)
    assert template.renders(parse("x{{#Front}}{{Front}}{{/Front}}"), {"Front"}) and not template.renders(parse("x{{Back}}"), {"Front"})
    assert template.requirement(parse("{{a}}{{b}}"), ["a", "b"]) == ("any", [0, 1])
    assert template.requirement(parse("{{#a}}{{b}}{{/a}}"), ["a", "b", "c"]) == ("all", [0, 1])
    assert template.requirement(parse("x"), ["a"]) == ("none", [])
    assert template.renamed(parse("{{#a}}{{text:b}}{{/a}}{{c}}"), {"a": "A", "b": None, "c": "C"}) == "{{#A}}{{/A}}{{C}}"
    assert template.field_names(parse("{{#a}}{{text:b}}{{/a}}{{b}}")) == ["a", "b"]


def test_answer_comparison():
    assert answerdiff.compare("a<br>b", "a b") == "<code id=typeans><span class=typeGood>a b</span></code>"
    assert answerdiff.compare("<b>x</b>", "") == "<code id=typeans>x</code>"
    mine, theirs = answerdiff.tokens("foobar", "fobaz")
    assert "".join(t for _, t in mine if t != "-") and "".join(t for _, t in theirs) == "fobaz"
    assert ("typeBad", "r") in mine and ("typeMissed", "z") in theirs
    assert "typeGood" in answerdiff.compare("größe", "grosse".replace("ss", "ß"), marks=False)


def test_time_model():
    assert timing(1_000_000_000, 999_000_000, 4) == Timing(1_000_000_000, 11, 1_000_008_000 // 86_400 * 86_400 + 14_400 + (86_400 if 1_000_000_000 % 86_400 >= 14_400 else 0))
    late = timing(100 * 86_400 + 3 * 3600, 90 * 86_400, 4)
    assert (late.days_elapsed, late.next_day_at) == (9, 100 * 86_400 + 4 * 3600)
    assert timing(0, 10**9).days_elapsed == 0
    assert spans.due_spec("3") == (3, 3, False) and spans.due_spec("3-7!") == (3, 7, True) and spans.due_spec("7-3") == (3, 7, False)
    with pytest.raises(ValueError):
        spans.due_spec("x")


def test_intervals_and_spans(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 7.0, 20.0, 100.0)], "x double")
    assert [round(r[0], 4) for r in df.select(spans.spread(F.col("x"))).collect()] == [0, 0, 1.075, 1.675, 2.975, 6.975]
    lo, hi = spans.bounds(F.col("x"), 1, 36_500)
    assert [tuple(r) for r in df.select(lo, hi).collect()] == [(1, 1), (2, 2), (2, 4), (5, 9), (17, 23), (93, 107)]
    secs = spark.createDataFrame([(5.0,), (70.0,), (7200.0,), (86_400.0 * 3,), (86_400.0 * 60,), (86_400.0 * 800,)], "x double")
    assert [r[0]["unit"] for r in secs.select(spans.span(F.col("x"))).collect()] == ["seconds", "minutes", "hours", "days", "months", "years"]


def test_memory(spark):
    t = Timing(10_000_000, 100, 10_010_000)
    rows = [('{"s": 10, "d": 5.5, "dr": 0.9}', 110, 10), ('{"s": "x", "d": 5}', 110, 10), ("{broken", 110, 10), (None, 110, 10), ('{"s": 10, "d": 5, "lrt": 9136000}', 0, 0)]
    df = spark.createDataFrame(rows, "data string, due int, ivl int")
    got = [r[0] for r in df.select(memory.retrievability(F.col("data"), F.col("due"), F.col("ivl"), t)).collect()]
    assert got[0] == 1.0 and got[1:4] == [None] * 3 and math.isclose(got[4], 0.9, abs_tol=1e-9)
    assert [r[0] for r in df.select(memory.has_state(F.col("data"))).collect()] == [True, False, False, False, True]
    bins = spark.createDataFrame([(0.0,), (4.9,), (5.0,), (9.9,), (99.9,), (100.0,)], "x double").select(memory.percent_bin(F.col("x"), 5))
    assert [r[0] for r in bins.collect()] == [0, 0, 5, 5, 95, 95]
    p = spark.createDataFrame([([],), ([1.0] * 19,), ([0.0] * 20 + [0.3],)], "p array<double>")
    assert [r[0] for r in p.select(memory.decay_of(F.col("p"))).collect()] == [memory.DECAY_6, memory.DECAY_5, 0.3]
