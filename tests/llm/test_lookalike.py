"""The consistent form against a brute-force version in Python, and the pairs."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallgrid.llm import lookalike as L
from recallgrid.llm.abuse import even_form


def brute(text):
    """The same rules, character by character."""
    one, more = L.compatibility()
    l_one, l_more = L.letters()
    out = text.replace("\r\n", "\n")
    out = "".join("\n" if c in "\r\x0b\x0c\x85  " else c for c in out)
    cp = {*L.WIDTHLESS, *range(0, 9), *range(0x0E, 0x1C), 0x7F, *range(0x80, 0x85), *range(0x86, 0xA0)}
    out = "".join(c for c in out if ord(c) not in cp and not (unicodedata.category(c) == "Cf" and ord(c) not in L.DRAWN_FORMAT))
    nfc = lambda s: unicodedata.normalize("NFC", s)
    out = nfc("".join(more.get(one.get(c, c), one.get(c, c)) if c in one else more.get(c, c) for c in nfc(out)))
    return nfc("".join(l_more.get(l_one.get(c, c), l_one.get(c, c)) if c in l_one else l_more.get(c, c) for c in out))


SAME = [
    ("ｃａｔ １２", "cat 12"), ("ｶﾞﾗｽ", "ガラス"), ("café", "café"), ("a​b­﻿", "ab"), ("a‍é", "aé"), ("a b c　d", "a b c d"), ("раурal", "paypal"), ("ÅK", "ÅK"), ("ΒΚΡ", "BKP"),
    ("ﬁ‑x", "fi-x"), ("ё", "ë"), ("羽羽", "羽羽"), ("a\r\nb\rc d", "a\nb\nc\nd"), ("ニ口", "二ロ"), ("q̣̇", "q̣̇"), ("ў", "y̆"), ("", ""),
]
DIFFERENT = [("A", "a"), ("é", "e"), ("²", "2"), ("O", "0"), ("l", "I"), ("a\tb", "a b"), ("a\nb", "a b"), ("a  b", "a b"), ("а б", "а  б"), ("ガ", "カ"), (" a", "a"), ("и", "u"), ("ß", "ss"), ("\x1f", "")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    x, y = even_form([a, b])
    assert x == y == brute(a) == brute(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    x, y = even_form([a, b])
    assert x != y


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("аесорхуАВΒό̈​ ﾞｶｅ ёйǅﬁⅣ")), max_size=12), max_size=8))
def test_any_text_as_brute_force_and_stable(texts):
    texts = [t.replace("\x00", "") for t in texts]
    got = even_form(texts)
    assert got == [brute(t) for t in texts]
    assert even_form(got) == got


def test_no_two_letters_of_one_script_look_alike():
    seen = {}
    for row in (L.CYRILLIC, L.GREEK, L.ARMENIAN, L.CHEROKEE, L.COPTIC, L.KANA):
        for a, b in L.pairs(row).items():
            assert seen.setdefault((unicodedata.name(a).split()[0], b), a) == a
    assert all(unicodedata.category(a)[0] == unicodedata.category(b)[0] == "L" for a, b in L.LETTERS.items())


def texts(spark, rows):
    return spark.createDataFrame(rows, "tbl string, key string, text string")


def test_pairs_are_complete_and_only_between_different_strings(spark):
    rows = [("m", "a", "cat"), ("m", "b", "сat"), ("m", "c", "ｃat"), ("m", "d", "cat"), ("m", "e", "Cat"), ("n", "a", "cat"), ("m", "a", "cat"), ("m", "x", None), ("m", None, "cat")]
    got = sorted(tuple(r) for r in L.look_alike_pairs(texts(spark, rows)).collect())
    assert got == [("m", "a", "b"), ("m", "a", "c"), ("m", "b", "c"), ("m", "b", "d"), ("m", "c", "d")]


def test_large_group_is_split_and_whole(spark):
    df = spark.range(3000).select(F.lit("m").alias("tbl"), F.format_string("%05d", "id").alias("key"), F.when(F.col("id") % 1000 == 0, "dоg").otherwise("dog").alias("text"), F.lit(1).alias("n"))
    from recallgrid.operators.skew import salted_pairs

    groups = L.look_alike_rows(df)
    assert groups.count() == 3000
    pairs = salted_pairs(groups, ["tbl", "form_hash", "form_check"], "n", "raw_hash", "key", salt_rows=100)
    assert pairs.count() == L.look_alike_pairs(df).count() == 3 * 2997


def test_empty_table_and_long_text(spark):
    assert L.look_alike_pairs(texts(spark, [])).count() == 0
    long = "кот " * 300_000
    got = L.consistent_form(texts(spark, [("m", "a", long), ("m", "b", None)])).collect()
    assert len(got[0]["form"]) == len(long) and got[1]["form"] is None


def test_classes_count_links(spark):
    rows = [("t", "a", "x y"), ("t", "b", "x\u00a0y"), ("t", "c", "x y"), ("t", "d", "z"), ("t", "d", "z"), ("t", None, "x\u2003y"), ("u", "a", "x y"), ("t", "e", None)]
    got = {r["key"]: (r["n_members"], r["n_links"]) for r in L.look_alike_classes(spark.createDataFrame(rows, "tbl string, key string, text string")).collect()}
    assert got == {"a": (3, 1), "b": (3, 2), "c": (3, 1)}
