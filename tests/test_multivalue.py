"""The grammar of packed values: round trips and defined cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from recallgrid.operators.multivalue import LIST_FIELD, TAGS, Grammar, packed_fields, split_values


def values(grammar, text):
    return [v for _, v, _, _ in grammar.parse(text)]


def test_separators_of_tags_and_lists():
    assert values(TAGS, ' a\tb  c;d,,e　f\n"week 3" g|h ') == ["a", "b", "c", "d", "e", "f", "week 3", "g", "h"]
    assert values(LIST_FIELD, "a b; c ,, d\r\ne<br>f<BR />g、h；i|j") == ["a b", "c", "d", "e", "f", "g", "h", "i", "j"]
    assert values(TAGS, "don't med::x v2.1 ch1/2 c# 50% c++ why?") == ["don't", "med::x", "v2.1", "ch1/2", "c#", "50%", "c++", "why?"]


def test_quotes():
    assert values(LIST_FIELD, '"a; b", "the ""x"" y" ;c') == ["a; b", 'the "x" y', "c"]
    assert list(LIST_FIELD.parse('"open, b')) == [(1, '"open', "bare", "quote_unclosed"), (2, "b", "bare", "")]
    assert list(LIST_FIELD.parse('"a"b, c')) == [(1, '"a"b', "bare", "quote_trailing"), (2, "c", "bare", "")]
    assert values(LIST_FIELD, '"" , " " , a') == ["a"]


def test_brackets_are_an_alternative():
    g = Grammar(blanks_separate=False, brackets="[]")
    assert list(g.parse("[a, b], c, [d")) == [(1, "a, b", "bracketed", ""), (2, "c", "bare", ""), (3, "[d", "bare", "bracket_unclosed")]


def test_empty_and_very_long():
    assert values(LIST_FIELD, "") == values(TAGS, " ,; ") == []
    assert len(values(LIST_FIELD, '"a b", ' * 50_000)) == 50_000
    assert values(LIST_FIELD, "<" * 100_000) == ["<" * 100_000]
    assert values(TAGS, " " * 100_000 + "x") == ["x"]


WORD = st.text(alphabet="abcé#%+-:'./?字", min_size=1, max_size=6)
QUOTED = st.text(alphabet='ab ,;|"', min_size=1, max_size=8).map(str.strip).filter(bool)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(WORD.map(lambda w: (w, w)), QUOTED.map(lambda q: (q, '"' + q.replace('"', '""') + '"'))), max_size=8), st.sampled_from([",", "; ", " | ", "\n", "、", " ,, ", "<br>"]))
def test_round_trip(items, sep):
    assert values(LIST_FIELD, sep.join(x for _, x in items)) == [v for v, _ in items]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab "<,;\t\n[]　', max_size=30))
def test_any_text_is_parsed_and_nothing_but_marks_is_lost(text):
    for g in (TAGS, LIST_FIELD):
        out = values(g, text)
        assert all(v == v.strip() and v for v in out)
        assert sum(c in "ab" for v in out for c in v) == sum(c in "ab" for c in text)


def test_rows(spark):
    notes = spark.createDataFrame([(1, 10, " a b ", "x\x1fp;q"), (1, 10, " a b ", "x\x1fp;q"), (2, None, None, None), (3, 99, "", "x"), (4, 10, "t", "only")], "id bigint, mid bigint, tags string, flds string")
    fields = spark.createDataFrame([(10, 1, True), (10, 0, False), (99, 5, True), (10, 1, True)], "ntid bigint, ord int, is_list boolean")
    rows = sorted(tuple(r)[:4] for r in split_values(packed_fields(notes, fields)).collect())
    assert rows == [(1, "flds", 1, "p"), (1, "flds", 2, "q"), (1, "tags", 1, "a"), (1, "tags", 2, "b"), (4, "tags", 1, "t")]
    assert split_values(packed_fields(notes.limit(0), fields)).count() == 0
