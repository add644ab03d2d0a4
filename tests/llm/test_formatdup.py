"""Hidden duplicates: what is the same content and what is not, against grouping by brute force."""

import random

from recallgrid.llm import formatdup


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string, hash int")


def found(spark, texts):
    return sorted(tuple(r) for r in formatdup.copies(frame(spark, [(i, t, 0) for i, t in enumerate(texts)])).collect())


def test_same_content(spark):
    same = ["The Cat!\x1fA  dog", "a dog\x1fthe cat", "ＴＨＥ ＣＡＴ\x1f(a-dog.)", "thе cat\x1fA dog\x1f", "the​ cat\x1f\x1f…\x1f«a dog»"]
    assert found(spark, same) == [(0, i) for i in range(1, 5)]
    assert found(spark, ["Straße ΟΔΟΣ", "STRASSE οδος"]) == [(0, 1)]
    assert found(spark, ["ВОДА Нет", "вода нет"]) == [(0, 1)]


def test_other_content(spark):
    other = ["the cat\x1fa dog", "the cat a dog", "cat the\x1fa dog", "the cat\x1fa dog\x1fa dog", "the cát\x1fa dog", "the cat 1\x1fa dog", "the cat+\x1fa dog", "the cat²\x1fa dog"]
    assert found(spark, other) == []


def test_nulls_repeats_empty_contents(spark):
    rows = [(5, "a", 1), (5, "a", 2), (3, "A!", 1), (None, "a", 1), (9, None, 1), (7, "", 1), (8, " ,\x1f.", 1)]
    df = frame(spark, rows)
    assert sorted(tuple(r) for r in formatdup.copies(df).collect()) == [(3, 5), (7, 8)]
    assert sorted(tuple(r) for r in formatdup.collapse(df).collect()) == [(3, 2, False), (7, 2, False)]
    assert formatdup.copies(df.limit(0)).count() == formatdup.collapse(df.limit(0)).count() == 0


def test_long_text_and_random_disguise(spark):
    rng = random.Random(2)
    words = ["alpha", "béta", "gamma", "дом", "delta"]
    rows, groups = [], {}
    for i in range(300):
        fields = [" ".join(rng.choices(words, k=2)) for _ in range(2)]
        groups.setdefault(tuple(sorted(fields)), []).append(i)
        rng.shuffle(fields)
        text = "\x1f".join("".join(rng.choice([c, c.upper()]) for c in f).replace(" ", rng.choice([" ", "  ", " - ", "\t"])) + rng.choice(["", "!", " "]) for f in fields)
        rows.append(text)
    want = sorted((g[0], i) for g in groups.values() for i in g[1:])
    assert found(spark, rows) == want
    big = "word " * 200_000
    assert found(spark, [big, big.upper()]) == [(0, 1)]


def test_heavy_group_takes_the_other_way(spark):
    from recallgrid.operators.skew import join_one_to_many

    h = formatdup.content_hashes(frame(spark, [(i, "x" if i < 50 else str(i // 2), 0) for i in range(80)]))
    g = formatdup.groups(h)
    for least in (1, 10, 10**9):
        assert join_one_to_many(h, g, formatdup.GROUP, "n_copies", min_rows=least).count() == 80
