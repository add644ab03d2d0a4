"""The classifier: held-out accuracy, disguises, windows, and the defined cases."""

from pathlib import Path

import pytest

from recallgrid.llm import abuse, abuse_seeds

SMALL = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def model():
    return abuse.fit([], [])


@pytest.fixture(scope="module")
def score(model):
    return abuse.scorer(model.logits)


def test_held_out_accuracy():
    """Every fifth template of each label and language is left out: its sentences are unlike all of the training's."""
    made = list(abuse_seeds.filled())
    held = [(t, y) for t, y, _, number in made if number % 5 == 4]
    words = lambda rows: abuse.token_lists([t for t, _ in rows])
    rest = [(t, y) for t, y, _, number in made if number % 5 != 4] + list(abuse_seeds.names(2000))
    m = abuse.train([(abuse.features(w), abuse.one_hot(y), 1.0) for w, (_, y) in zip(words(rest), rest, strict=True)])
    found = m.judge(words(held))[:, 0] < 0.5
    cases = [y != "clean" for _, y in held]
    recall = sum(f for f, c in zip(found, cases, strict=True) if c) / sum(cases)
    wrong = sum(f for f, c in zip(found, cases, strict=True) if not c) / (len(cases) - sum(cases))
    assert recall > 0.7 and wrong < 0.25


def test_names_say_nothing(score):
    """Made-up names, none of them the training's: hardly any is a case."""
    found = [score(n)[1] >= abuse.THRESHOLD for n, _ in abuse_seeds.names(3000, seed=99)]
    assert sum(found) / len(found) < 0.01


@pytest.mark.skipif(not SMALL.exists(), reason="test tables are absent")
def test_reviewed_sentences_that_it_never_saw(model):
    """The labelled sentences, with the model of general language only."""
    import duckdb

    rows = duckdb.connect().sql(f"SELECT text, label FROM '{SMALL}/review_examples.parquet'").fetchall()
    real = abuse.reviewed(rows)
    score = abuse.scorer(model.logits)
    forms = abuse.even_form([t for t, _ in real])
    right = [(score(f)[1] >= abuse.THRESHOLD) == (y[0] == 0) for f, (_, y) in zip(forms, real, strict=True)]
    assert sum(right) / len(right) > 0.7


@pytest.mark.parametrize("text", ["You are an idiot", "y o u are an i.d.i.o.t", "YOU ARE AN 1D10T!", "you are an idiooooot", "you аre an іdiot", "You are an id​iot.", "ｙｏｕ are an idiot", "Du bist ein Arschloch", "お前は馬鹿だ", "Ты идиот"])
def test_disguises(score, text):
    assert score(abuse.even_form([text])[0])[1] > 0.5


def test_a_case_hidden_in_a_long_text(score):
    clean = "the word 'idiot' is vulgar. you are a genius, thank you. "
    assert score(clean * 50)[1] < 0.5
    n, p, label = score(clean * 50 + "shut up, you stupid idiot " + clean * 50)
    assert p > 0.5 and label == "abuse" and n > 100


def test_tokens():
    assert abuse.tokens("I.d.i.o.t Idiooot 1d10t c**t") == ["idiot", "idiot", "idiot", "c*t"]
    assert abuse.tokens("馬鹿だ ok") == ["\0馬鹿", "\0だ", "ok"]
    assert abuse.tokens(abuse.even_form(["カメラとガラスのバカ"])[0]) == ["\0カメラ", "\0と", "\0ガラス", "\0の", "\0バカ"]
    assert abuse.tokens(abuse.even_form(["Ты Кто"])[0]) == abuse.tokens(abuse.even_form(["ты кто"])[0]) == ["ты", "кто"]
    assert abuse.tokens("the word 'idiot', «l'idiot»") == ["the", "word", '"', "idiot", '"', '"', "l'idiot", '"']
    assert abuse.split_sentences("<p>A b.</p> C! d\te&amp;f") == ["A b.", "C", "d", "e&f"]


def test_reviewers_who_disagree():
    got = dict(abuse.reviewed([("a", "clean"), ("a", "hate"), ("b", "hate"), ("b", "sexual"), ("c", "clean"), ("d", "odd"), (None, "hate")]))
    assert set(got) == {"b", "c"} and got["b"].tolist() == [0, 0, 0.5, 0.5]


def test_rows_and_rates(spark, model):
    rows = [(1, "x", "You are an idiot, shut up."), (1, "x", "You are an idiot, shut up."), (2, None, None), (3, "x", ""), (None, "y", "thank you, you are great"), (4, "y", "great " * 100_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, source string, text string, score double")
    got = {r["doc_id"]: r for r in abuse.scores(df, model).collect()}
    assert len(got) == 5 and got[1]["score"] > 0.5 and got[2]["score"] == got[3]["score"] == 0 and got[2]["sentences"] == 0
    rates = {r["source"]: r for r in abuse.rates(abuse.scores(df, model)).collect()}
    assert (rates["x"]["documents"], rates["x"]["cases"], rates[None]["cases"]) == (2, 1, 0)
    assert abuse.scores(df.limit(0), model).count() == 0


def test_windows_are_those_of_the_scorer():
    words = [f"w{k}" for k in range(23)]
    found = abuse.windows(words)
    assert found[0] == words[:9] and found[-1][-1] == "w22" and all(len(w) <= abuse.WINDOW for w in found)
    assert abuse.windows(words[:9]) == []


def test_training_is_repeatable():
    a, b = (abuse.train([(abuse.features(["you", "fool"]), abuse.one_hot("abuse"), 1.0), (abuse.features(["thank", "you"]), abuse.one_hot("clean"), 1.0)], epochs=3) for _ in range(2))
    assert (a.logits == b.logits).all()


def test_one_score_as_the_model(model, score):
    for s in ("thank you for the cards", "get lost, fool", "馬鹿は消えろ"):
        words = abuse.tokens(abuse.even_form([s])[0])
        assert abs(score(abuse.even_form([s])[0])[1] - (1 - model.judge([words])[0, 0])) < 1e-4


def test_abuse_in_a_third_of_the_documents_is_not_learnt_as_clean():
    """A frequent abusive sentence stays a case, whether the model or a reviewer knows it, and joins nothing as clean."""
    often, known = "You are an idiot and your deck is trash.", "zorvex blimtar"
    background = [abuse.tokens(s) for s in (often, known, "The engine lies under the map.", "Set the limit to 30 cards.")] * 50
    score = abuse.scorer(abuse.fit([(known, "abuse")], background).logits)
    assert score(often)[1] > 0.5 and score(known)[1] > 0.5
    assert score("The engine lies under the map.")[1] < 0.5


def test_common_frames_are_counted_over_whole_texts_of_all_documents(spark, monkeypatch):
    """What is common is so wherever it stands, copies of one sentence count once, and what differs becomes a gap."""
    rows = [(i, f"{'filler ' * 1000}. deep{i} inside lantern.") for i in range(700)] + [(1000 + i, "Posted often!") for i in range(300)] + [(None, None), (5000, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(abuse, "COMMON_WORDS", 100)
    got = abuse.common_frames(df)
    assert got == abuse.common_frames(df.unionByName(df)) == [["", "inside", "lantern"]]
    assert abuse.common_frames(df.limit(0)) == []


def test_gaps_have_no_subwords():
    one = abuse.features(["a", "", "b"])
    assert one == abuse.features(["a"]) + abuse.features(["b"]) and abuse.features([""]) == []
