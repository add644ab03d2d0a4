"""Parser, writer, builder and compiler of the search language."""

import pytest
from pyspark.sql import functions as F

from recallgrid.model import CLOCK, Catalog, Deck, Notetype
from recallgrid.search import writer
from recallgrid.search.ast import All, Any, Group, Not, SearchError, Term
from recallgrid.search.compile import Collection, Compiler, compile_search, find_cards, find_notes
from recallgrid.search.parser import parse

T = Term


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("", T("all")),
        ("  　 ", T("all")),
        ("hello", T("text", ("hello",))),
        ("a b", All((T("text", ("a",)), T("text", ("b",))))),
        ("a and b OR c", Any((All((T("text", ("a",)), T("text", ("b",)))), T("text", ("c",))))),
        ("-(a or b)", Not(Group(Any((T("text", ("a",)), T("text", ("b",))))))),
        ('"a b"', T("text", ("a b",))),
        ('deck:"a b"', T("deck", ("a b",))),
        ('"deck:a b"', T("deck", ("a b",))),
        (r"a\:b", T("text", ("a:b",))),
        (r"\*x", T("text", (r"\*x",))),
        ("front:x", T("field", ("front", "x", "normal"))),
        ("front:re:^x", T("field", ("front", "^x", "regex"))),
        ("front:nc:x", T("field", ("front", "x", "nc"))),
        ("added:0", T("added", (1,))),
        ("card:0", T("template", (0,))),
        ("card:3", T("template", (2,))),
        ("card:back", T("template", ("back",))),
        ("rated:3:2", T("rated", (3, 2))),
        ("resched:2", T("rated", (2, "manual"))),
        ("prop:rated>-5:1", T("prop", ("rated", ">", -5, 1))),
        ("prop:ivl>=3", T("prop", ("ivl", ">=", 3))),
        ("prop:ease!=2.5", T("prop", ("ease", "!=", 2.5))),
        ("prop:cdn:abc<2", T("prop", ("cdn:abc", "<", 2.0))),
        ("nid:1,2", T("nid", (1, 2))),
        ("tag:re:a b", All((T("tag", ("a", "regex")), T("text", ("b",))))),
        ("dupe:5,x", T("dupe", (5, "x"))),
        ("IS:due", T("is", ("due",))),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("and", "MisplacedAnd"), ("or x", "MisplacedOr"), ("x or", "MisplacedOr"), ("x and or y", "MisplacedOr"), ("(", "UnclosedGroup"), (")", "UnopenedGroup"), ("()", "EmptyGroup"), ("(a", "UnclosedGroup"),
        ('"', "UnclosedQuote"), ('""', "EmptyQuote"), ('"a', "UnclosedQuote"), (r"a\b", "UnknownEscape"), ("a\\", "UnknownEscape"), (":x", "MissingKey"), ("flag:8", "InvalidFlag"), ("flag:x", "InvalidFlag"),
        ("is:foo", "InvalidState"), ("is:New", "InvalidState"), ("added:-1", "InvalidPositiveWholeNumber"), ("rated:1:5", "InvalidAnswerButton"), ("prop:foo=1", "InvalidPropProperty"), ("prop:ivl~1", "InvalidPropOperator"),
        ("prop:due=1.5", "InvalidWholeNumber"), ("prop:rated=1", "InvalidNegativeWholeNumber"), ("prop:ease=x", "InvalidNumber"), ("nid:1,,2", "Other"), ("dupe:1", "Other"), ("mid:x", "InvalidWholeNumber"),
    ],
)
def test_errors(text, kind):
    with pytest.raises(SearchError) as e:
        parse(text)
    assert e.value.kind == kind


@pytest.mark.parametrize("text", ["a (b OR -c) deck:d", '"deck:a b"', "rated:3:1 prop:ivl>2 -is:new", 'tag:re:"x.*y"', r"front:re:a\"b", "prop:cdn:k>=1.5 has-cd:k", "(a) OR (b c)"])
def test_writing_and_reading_again_is_the_same(text):
    once = writer.normalize(text)
    assert writer.normalize(once) == once
    assert parse(once) == parse(text)


def test_writer_and_builder():
    assert writer.normalize("") == "deck:*"
    assert writer.normalize("foo AND bar") == "foo bar"
    assert writer.replace_term("deck:a is:due", "deck:b") == "deck:b is:due"
    assert writer.write(writer.any_of(parse("a b"), parse("c"))) == "(a b) OR c"
    assert writer.write(writer.all_of(parse("a OR b"), parse("c"), writer.negated(parse("d e")))) == "(a OR b) c -(d e)"
    assert writer.write(writer.flagged(None)) == "-flag:0"
    assert writer.write(writer.literal("a*b")) == r"a\*b"
    assert writer.all_of() == T("all")


@pytest.fixture(scope="module")
def col(spark):
    notes = [(1, 10, 0, "", "dog\x1fcat", "dog", 0), (2, 10, 0, " sheep goat::horse ", "goats are fun\x1fsheep", "goats are fun", 0), (3, 11, 0, " conjunção größte ", "{{c1::cat}} x\x1fé", "cat x", 0)]
    n = spark.createDataFrame(notes, "id bigint, mid bigint, mod bigint, tags string, flds string, sfld string, csum bigint")
    cards = [(100 + i, nid, did, 0, typ, q, due, 5, 2500, 1, 0, 0, odid, fl, data) for i, (nid, did, typ, q, due, odid, fl, data) in enumerate([(1, 1, 0, 0, 7, 0, 0, "{}"), (2, 2, 2, 2, 10, 0, 1, '{"s": 5.0, "d": 3.0}'), (3, 9, 2, -1, 6000, 3, 9, "{"), (3, 3, 1, 1, CLOCK.now, 0, 0, None)])]
    c = spark.createDataFrame(cards, "id bigint, nid bigint, did bigint, ord int, type int, queue int, due int, ivl int, factor int, reps int, lapses int, odue int, odid bigint, flags int, data string")
    r = spark.createDataFrame([((CLOCK.next_day_at - 86400 * k) * 1000 + 5, cid, e) for k, cid, e in [(1, 100, 2), (3, 101, 1), (50, 101, 3), (2, 102, 0)]], "id bigint, cid bigint, ease int")
    cat = Catalog([Deck(1, "Default", 1, False), Deck(2, "A", 1, False), Deck(3, "A\x1fB", 2, False), Deck(9, "F", None, True)], [Notetype(10, "Basic", False, ["Front", "Back"], templates=["Card 1"]), Notetype(11, "Cloze", True, ["Text", "Extra"], templates=["Cloze"])], {1: "Default", 2: "Hard"})
    return Collection(c, n, r, cat, CLOCK)


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("dog", [1]), ("sheep", [2]), ("CAT", [1, 3]), ("d_g", [1]), ("-cat", [2]), ("front:dog", [1]), ("front:d*", [1]), ("f*t:dog", [1]), ("back:", []), ("back:_*", [1, 2]), ("*:sheep", [2]), ("front:re:^goats", [2]), ("re:fun", [2]), ("w:are", [2]), ("w:ar", []),
        ("sc:cat", [3]), ("nc:e", [2, 3]), ("extra:nc:e", [3]), ("tag:none", [1]), ("tag:*", [1, 2, 3]), ("tag:goat", [2]), ("tag:goat::horse", [2]), ("tag:horse", []), ("tag:sh*", [2]), ("tag:nc:conjuncao", [3]), ("tag:re:^sheep$", [2]), ("note:basic", [1, 2]), ("note:c*", [3]), ("mid:11", [3]), ("nid:1,3", [1, 3]),
        ("deck:a", [2, 3]), ("deck:a::b", [3]), ("deck:filtered", [3]), ("did:2", [2]), ("preset:hard", [3]), ("flag:1", [2, 3]), ("is:new", [1]), ("is:suspended", [3]), ("is:due", [2, 3]), ("rated:1", [1]), ("rated:5:1", [2]), ("resched:5", [3]), ("-rated:5", [3]), ("introduced:5", [1]), ("prop:s>4", [2]), ("-prop:s>4", []), ("prop:d<0.3", [2]), ("card:1", [1, 2, 3]), ("card:cloze", [3]), ("prop:ease=2.5", [1, 2, 3]), ("(dog or sheep) -is:new", [2]), ("", [1, 2, 3]),
    ],
)
def test_find_notes(col, text, ids):
    assert sorted(r[0] for r in find_notes(col, text).collect()) == ids


def test_tables_are_read_only_where_needed(col):
    assert not compile_search(col, "is:due deck:a").notes
    assert not compile_search(col, "dog tag:x").cards
    assert "Join" not in find_cards(col, "is:due")._jdf.queryExecution().toString()
    assert find_cards(col, "dog").count() == 1


def test_dupe_keeps_names_of_media(spark):
    """The text of a duplicate search and the field are stripped alike: names of media stay, entities become characters."""
    import hashlib

    from recallgrid.functions import text as tx

    field = '<b>a</b>&nbsp;<img src="x y.jpg">'
    plain = tx.plain_keep_media(field)
    assert plain == "a  x y.jpg "
    row = spark.createDataFrame([(field,)], "f string").select(tx.strip_html_keep_media(F.col("f"))).collect()[0][0]
    assert row == plain
    csum = int(hashlib.sha1(plain.encode()).hexdigest()[:8], 16)
    found = Compiler(None).t_dupe(5, field)
    notes = spark.createDataFrame([(1, 5, field + "\x1fback", csum), (2, 5, "a", csum), (3, 6, field, csum)], "id int, mid int, flds string, csum bigint").alias("n")
    assert [r["id"] for r in notes.where(found).select("id").collect()] == [1]
