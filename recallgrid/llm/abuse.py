"""Problem 9: abusive, hateful or sexual content, by subword-bag embeddings and a linear softmax."""

from __future__ import annotations

import html
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.abuse_seeds import LABELS, disguise, names, sentences
from recallgrid.llm.duck import connection, slices
from recallgrid.llm.lookalike import KANA, steps_sql
from recallgrid.session import cut

#: Most labelled rows used for training.
MAX_LABELLED = 20_000
#: Words are common if one in so many different sentences of all documents has them, and frames if one in so many has them;
#: both at least LEAST. So at most that many frames are common, and that many times the average length of a sentence words,
#: whatever the number of documents.
COMMON_WORDS, COMMON_FRAMES, LEAST = 500, 10_000, 5
#: Different words or frames that a task counts before it hands their counts on.
COUNTED = 500_000
#: Rows of the table of subword scores: so many that few of the training's subwords share one with another; and the length
#: of a subword vector. A subword that the training has not seen counts as UNSEEN of the prior's.
BUCKET_BITS, DIM = 21, 48
BUCKETS = 1 << BUCKET_BITS
EPOCHS, RATE, SEED = 8, 0.6, 7
#: Examples that are worked on at once in training.
BATCH = 16
#: Every sentence counts as if it also had so many subwords that speak for clean, with this score: a few unknown words say
#: little.
PRIOR, PRIOR_CLEAN, UNSEEN = 15, 4.0, 0.5
#: Weights of a reviewed sentence, a made sentence, a common frame taken as clean, and a window of a clean sentence.
W_REVIEWED, W_MADE, W_COMMON, W_WINDOW = 1.0, 1.0, 1.0, 0.5
#: Only what the model before finds this likely to be clean is taken as clean, however common it is.
COMMON_CLEAN = 0.3
#: Misspelled copies of each labelled text.
NOISED = 2
#: Models trained in turn with what the one before takes as clean, and the epochs of all but the last.
TURNS, TURN_EPOCHS = 3, 5
#: The last models differ only in their starting vectors; their scores are averaged, as the score of a subword depends on
#: these by chance.
LAST_MODELS = 5
#: Made-up names and words that join the training as clean: unknown words say nothing.
MADE_WORDS = 6_000
#: Words in a window; sentences longer than that are also judged window by window.
WINDOW, STRIDE = 9, 2
#: A document is a case if a sentence is this unlikely to be clean.
THRESHOLD = 0.3
#: Different words whose sums of vectors a task keeps, and words that are scored in one go.
CACHE_WORDS, CALL_WORDS = 200_000, 100_000

# Digits and signs written for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
_TAG = re.compile(r"<[^<>]*>")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|[。！？!?]+|[\n\r\t|]+")
_SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:([.\-_ ·])[^\W\d_](?:\1[^\W\d_])+)(?![^\W\d_])")
#: Words, and quotation marks, by which a word that is used can be told from one that is spoken of.
_WORD = re.compile(r"""[\w@$*゙゚]+(?:'\w+)*|["«»„“”‘’‚‹›「」『』]|(?<!\w)'|'(?!\w)""")
QUOTES = "\"'«»„“”‘’‚‹›「」『』"
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_STARS = re.compile(r"\*+")
_CYRILLIC = re.compile("[\u0430-\u045f]")
# Small letters whose capitals or own forms are drawn alike, Latin first.
ALIKE = "aа bв cс eе hн kк mм oо pр tт xх yу".split()
TO_CYRILLIC, TO_LATIN = str.maketrans(dict(ALIKE)), str.maketrans({b: a for a, b in ALIKE})
_EAST = re.compile(r"[぀-ヿ㐀-鿿々゙゚]+|[^぀-ヿ㐀-鿿々゙゚]+")
#: Runs of one script: Katakana, Hiragana, Han.
_RUNS = re.compile(r"[ァ-ヺーヽヾ]+|[ぁ-ゖゝゞ]+|[㐀-鿿々]+")
#: Katakana that the consistent form has turned into what they are drawn like; beside Katakana they are meant as such.
_FROM_KANA = {p[1]: p[0] for p in KANA.split()}
_MEANT = re.compile(f"[{''.join(_FROM_KANA)}](?=[ァ-ヺー゙゚])|(?<=[ァ-ヺー゙゚])[{''.join(_FROM_KANA)}]")


def even_form(texts: list[str]) -> list[str]:
    """The consistent form of problem 1, worked out by DuckDB."""
    con = connection()
    con.register("texts_", pa.table({"n": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    out = con.sql(f"SELECT form FROM ({steps_sql('texts_')}) ORDER BY n").to_arrow_table().column(0).to_pylist()
    con.unregister("texts_")
    return out


def split_sentences(text: str) -> list[str]:
    text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    return [s for s in (p.strip() for p in _SPLIT.split(text) if p) if s]


def prepare(text: str) -> str:
    """Small letters without accents, undone of spacing between the letters of a word."""
    s = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text.lower())
    return s if s.isascii() else _ACCENTS.sub("", unicodedata.normalize("NFD", s))


def one_script(word: str) -> str:
    """A word of Cyrillic and Latin letters in the script that more of its letters can only belong to.

    Look-alike letters have become Latin, but a small letter may be drawn unlike its capital: without this a word at the
    beginning of a sentence would be another word.
    """
    if not _CYRILLIC.search(word):
        return word
    only = sum(1 if "\u0430" <= c <= "\u045f" else -1 if c.isalpha() and ord(c) not in TO_CYRILLIC else 0 for c in word)
    return word.translate(TO_CYRILLIC if only >= 0 else TO_LATIN)


def word_tokens(word: str) -> list[str]:
    """The tokens of a prepared word, undone of doubling and of signs for letters; quotation marks are all the same.

    Japanese is written without blanks: each run of one script is a token.
    """
    if word in QUOTES:
        return ['"']
    out = []
    word = one_script(word)
    for w in _EAST.findall(word):
        w = _RUN.sub(r"\1", w)
        if w[0] >= "\u3040" and (w[0] <= "\u30ff" or "\u3400" <= w[0] <= "\u9fff"):
            w = unicodedata.normalize("NFC", _MEANT.sub(lambda m: _FROM_KANA[m.group()], w))
            out.extend("\0" + r for r in _RUNS.findall(w))
            continue
        if any(c.isdigit() or c in "@$" for c in w) and sum(c.isalpha() for c in w) >= 2:
            w = w.translate(LEET)
        elif w.isdigit():
            w = "0"
        out.append(_STARS.sub("*", w))
    return out


def tokens(sentence: str) -> list[str]:
    return [t for w in _WORD.findall(prepare(sentence)) for t in word_tokens(w)]


def grams(token: str) -> list[str]:
    """Subwords: the word and its n-grams of 3 to 6 characters; of Han single characters and pairs, as each is a word part."""
    if token[0] == "\0" and "\u3400" <= token[1]:
        return [token] + [f"\0{token[i : i + n]}-" for n in (1, 2) for i in range(1, len(token) - n + 1)]
    w = f"<{token}>"
    return [w] + [w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1) if n < len(w)]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) & (BUCKETS - 1)


def pairs(first, second):  # noqa: ANN001, ANN201
    """The buckets of two neighbouring words, by which 'you are' and 'I am' tell whom a word is about; from the words'
    hashes, numbers or arrays."""
    return ((first * 2_654_435_761 + second * 2_246_822_519 + 374_761_393) & 0xFFFFFFFF) >> (32 - BUCKET_BITS)


def features(words: list[str]) -> list[int]:
    """The buckets of a sentence: of its words and of the pairs of neighbours; an empty word is a gap and has none."""
    ids = [bucket(g) for w in words if w for g in grams(w)]
    hashes = [zlib.crc32(w.encode()) for w in words]
    return ids + [pairs(hashes[k], hashes[k + 1]) for k in range(len(words) - 1) if words[k] and words[k + 1]]


@dataclass
class Model:
    """Scores of each subword bucket for each label: the embedding times the softmax weights."""

    logits: np.ndarray

    def judge(self, lists: list[list[str]], weight: float = PRIOR) -> np.ndarray:
        """Probabilities of the labels for token lists, with a prior of so many subwords."""
        out = np.empty((len(lists), len(LABELS)))
        for k, words in enumerate(lists):
            ids = features(words)
            z = (self.logits[ids].sum(axis=0) + prior() * (weight / PRIOR)) / (len(ids) + weight)
            e = np.exp(z - z.max())
            out[k] = e / e.sum()
        return out


def train(examples: list[tuple[list[int], np.ndarray, float]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Embeddings and softmax weights trained together by stochastic gradient descent in small batches; examples are
    (buckets, label distribution, weight)."""
    rng = np.random.default_rng(seed)
    logits = np.tile((prior() * UNSEEN / PRIOR).astype(np.float32), (BUCKETS, 1))
    kept = [(np.array(ids), y, w) for ids, y, w in examples if ids]
    if not kept:
        return Model(logits)
    # Only buckets that occur have a vector while training.
    used, flat = np.unique(np.concatenate([ids for ids, _, _ in kept]), return_inverse=True)
    n = np.array([len(ids) for ids, _, _ in kept])
    ends = np.cumsum(n)
    ys, ws = np.array([y for _, y, _ in kept], np.float32), np.array([w for _, _, w in kept], np.float32)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (len(used), DIM)).astype(np.float32)
    out, first = np.zeros((len(LABELS), DIM), np.float32), prior().astype(np.float32)
    steps, step = max(1, epochs * len(kept)), 0
    for _ in range(epochs):
        order = rng.permutation(len(kept))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids = np.concatenate([flat[ends[k] - n[k] : ends[k]] for k in rows])
            size = n[rows]
            starts = np.cumsum(size) - size
            # The prior holds in training, too, so that short cases learn to speak against it.
            whole = (size + PRIOR).astype(np.float32)[:, None]
            h = np.add.reduceat(emb[ids], starts) / whole
            z = h @ out.T + first / whole
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = (ys[rows] - e / e.sum(axis=1, keepdims=True)) * (ws[rows] * np.float32(rate * (1 - step / steps)))[:, None]
            back = g @ out * (DIM / whole)
            out += g.T @ h
            by = np.argsort(ids, kind="stable")
            sorted_ids = ids[by]
            heads = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
            emb[sorted_ids[heads]] += np.add.reduceat(np.repeat(back, size, axis=0)[by], heads)
            step += len(rows)
    logits[used] = emb @ out.T
    return Model(logits)


def prior() -> np.ndarray:
    return np.array([PRIOR * PRIOR_CLEAN, 0, 0, 0])


def one_hot(label: str) -> np.ndarray:
    return np.array([float(label == x) for x in LABELS])


def reviewed(rows: list[tuple[str, str]]) -> list[tuple[str, np.ndarray]]:
    """Each labelled text once, with the share of its reviewers' labels.

    Texts that one reviewer finds clean and another does not are left out, as are unknown labels and null texts.
    """
    found: dict[str, np.ndarray] = {}
    for text, label in rows:
        if text and label in LABELS:
            found[text] = found.get(text, np.zeros(len(LABELS))) + one_hot(label)
    return [(t, y / y.sum()) for t, y in sorted(found.items()) if y[0] in (0, y.sum())]


def phrases(words: list[str]) -> set[tuple[str, ...]]:
    """The words, the pairs of neighbours and the whole."""
    return {(w,) for w in words} | set(zip(words, words[1:], strict=False)) | {tuple(words)}


def only_abusive(lists: list[list[str]], ys: list[np.ndarray]) -> set[tuple[str, ...]]:
    """Phrases of the sentences labelled as not clean that no clean one has."""
    bad, good = set(), set()
    for words, y in zip(lists, ys, strict=False):
        (good if y[0] else bad).update(phrases(words))
    return bad - good


def averaged(examples: list[tuple[list[int], np.ndarray, float]]) -> Model:
    return Model(np.mean([train(examples, seed=SEED + k).logits for k in range(LAST_MODELS)], axis=0, dtype=np.float32))


def token_lists(texts: list[str]) -> list[list[str]]:
    return [[w for s in split_sentences(f) for w in tokens(s)] for f in even_form(texts)]


def windows(words: list[str]) -> list[list[str]]:
    """The windows in which a long sentence is judged besides the whole."""
    if len(words) <= WINDOW:
        return []
    return [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW + 2 * STRIDE - 1, STRIDE) if i < len(words)]


def examples_of(texts: list[tuple[str, np.ndarray]], weight: float) -> list[tuple[list[str], np.ndarray, float]]:
    """Token lists of texts; a long clean text also gives its windows, as none of them is a case either."""
    out = []
    for words, (_, y) in zip(token_lists([t for t, _ in texts]), texts, strict=True):
        out.append((words, y, weight))
        if y[0] == 1:
            out.extend((w, y, weight * W_WINDOW) for w in windows(words))
    return out


def training_texts(labelled: list[tuple[str, str]]) -> list[tuple[list[str], np.ndarray, float]]:
    """Token lists with labels and weights of the reviewed texts, misspelled copies of them, and made texts."""
    real, rng = reviewed(labelled), random.Random(SEED)
    noised = [(disguise(t, rng), y) for t, y in real for _ in range(NOISED)]
    made = [(t, one_hot(label)) for t, label in [*sentences(), *names(MADE_WORDS)]]
    return examples_of(real, W_REVIEWED) + examples_of(noised, W_REVIEWED / NOISED) + examples_of(made, W_MADE)


@lru_cache(maxsize=2)
def _fit(labelled: tuple[tuple[str, str], ...], common: tuple[tuple[str, ...], ...]) -> Model:
    texts = training_texts(list(labelled))
    base = [(features(w), y, x) for w, y, x in texts]
    barred = only_abusive([w for w, _, _ in texts], [y for _, y, _ in texts])
    rest = [list(w) for w in dict.fromkeys(common) if any(w) and w not in barred]
    if not rest:
        return averaged(base)
    ids = [features(w) for w in rest]
    clean = one_hot("clean")
    examples = base
    for _ in range(TURNS):
        p = train(examples, epochs=TURN_EPOCHS).judge(rest)[:, 0]
        examples = base + [(f, clean, W_COMMON) for f, q in zip(ids, p, strict=True) if q >= COMMON_CLEAN]
    return averaged(examples)


def fit(labelled: list[tuple[str, str]], common: list[list[str]]) -> Model:
    """The model from reviewed sentences, made sentences, and the common frames of the corpus (token lists).

    Most of what is common is clean. About each frame a first model is asked; what it does not find to be a case joins the
    training as clean, and so on in turns: each model knows more of the corpus's language than the one before. Commonness
    alone makes nothing clean, as what many copies say may be abuse; frames that are sentences or phrases which only texts
    labelled as not clean have, and those that always look like a case, are not used. The same rows give the same model,
    which is kept.
    """
    return _fit(tuple(sorted(labelled, key=repr)), tuple(map(tuple, common)))


def labelled_rows(examples: DataFrame) -> list[tuple[str, str]]:
    """At most MAX_LABELLED labelled rows, the first by id."""
    return [(r[0], r[1]) for r in examples.select("text", "label", "example_id").distinct().orderBy("example_id", "text", "label").limit(MAX_LABELLED).collect()]


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different sentences of each slice, as tokens with blanks between them."""
    known: dict[str, str] = {}

    def joined(raw: str) -> str:
        out = known.get(raw)
        if out is None:
            if len(known) > 2 * CACHE_WORDS:
                known.clear()
            out = known[raw] = " ".join(word_tokens(raw))
        return out

    for batch in batches:
        for part in slices(batch):
            texts = {s for text in even_form(part.column(0).to_pylist()) for s in split_sentences(prepare(text))}
            found = {" ".join(joined(w) for w in _WORD.findall(s)) for s in texts} - {""}
            yield pa.record_batch([pa.array(sorted(found), pa.string())], names=["words"])


def _counting(parts: Callable[[list[str]], Iterable[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the different parts of each sentence; the empty part counts the sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["part", "n"])
            found.clear()
            return rows

        for batch in batches:
            for sentence in batch.column(0).to_pylist():
                found.update({"", *parts(sentence.split(" "))})
                if len(found) > COUNTED:
                    yield out()
        if found:
            yield out()

    return run


def _common(different: DataFrame, parts: Callable[[list[str]], Iterable[str]], of: int) -> list[str]:
    """The parts that at least one in `of` sentences has."""
    counts = cut(different.mapInArrow(_counting(parts), "part string, n bigint").groupBy("part").agg(F.sum("n").alias("n")))
    whole = counts.where(F.col("part") == "").agg(F.max("n")).scalar()
    often = (F.col("n") >= LEAST) & (F.col("n") * of >= whole)
    return sorted(r[0] for r in counts.where((F.col("part") != "") & often).select("part").collect())


def _framer(words) -> Callable[[list[str]], Iterable[str]]:  # noqa: ANN001
    def frame(sentence: list[str]) -> list[str]:
        known = words.value
        kept = " ".join(w if w in known else "" for w in sentence)
        return [kept] if kept.strip() else []

    return frame


def common_frames(documents: DataFrame) -> list[list[str]]:
    """What sentences have in common: their words, as token lists, with '' in place of words that are not common themselves.

    Every sentence of every document counts, from whole texts, and each different one once: a text that is posted very often
    weighs as much as one. The counts are made by distributed aggregates over all of them, first of words, then of frames;
    only the common ones, whose number is bounded, come to the driver.
    """
    texts = documents.where(F.col("text").isNotNull()).select("text")
    different = cut(texts.mapInArrow(_sentences, "words string").distinct())
    words = documents.sparkSession.sparkContext.broadcast(frozenset(_common(different, set, COMMON_WORDS)))
    return [f.split(" ") for f in _common(different, _framer(words), COMMON_FRAMES)]


SCORE = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("sentences", pa.int32()), ("score", pa.float64()), ("label", pa.string())])


class Scorer:
    """Scores of texts: (number of sentences, largest probability of not being clean, label of that sentence).

    A sentence longer than a window is judged as a whole and by windows of its words. Of each word only the sum of its
    subword scores and their number are needed, and these are kept; running sums over many sentences give every window
    at once. Texts are worked on sentence by sentence, so one of any length takes bounded memory.
    """

    def __init__(self, logits: np.ndarray) -> None:
        self.logits = logits
        self.forget()

    def forget(self) -> None:
        self.of_raw: dict[str, tuple[int, ...]] = {}
        self.of_token: dict[str, int] = {}
        self.rows, self.hashes = np.zeros((1024, len(LABELS) + 1)), np.zeros(1024, np.uint64)

    def learn(self, raw: str) -> tuple[int, ...]:
        found = []
        for t in word_tokens(raw):
            k = self.of_token.get(t)
            if k is None:
                k = self.of_token[t] = len(self.of_token)
                if k == len(self.rows):
                    self.rows, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.hashes))
                ids = [bucket(g) for g in grams(t)]
                self.rows[k, :-1], self.rows[k, -1] = self.logits[ids].sum(axis=0), len(ids)
                self.hashes[k] = zlib.crc32(t.encode())
            found.append(k)
        out = self.of_raw[raw] = tuple(found)
        return out

    def _spans(self, flat: list[int], lengths: list[int], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(document, probabilities) of each sentence and window."""
        ids, n, doc = np.array(flat, np.int64), np.array(lengths, np.int64), np.array(docs, np.int64)
        width = len(LABELS) + 1
        one = np.zeros((len(ids) + 1, width))
        np.cumsum(self.rows[ids], axis=0, out=one[1:])
        h = self.hashes[ids]
        two = np.zeros((len(ids) + 1, width))
        if len(ids) > 1:
            both = np.zeros((len(ids) - 1, width))
            both[:, :-1], both[:, -1] = self.logits[pairs(h[:-1], h[1:]).astype(np.int64)], 1
            np.cumsum(both, axis=0, out=two[1:-1])
            two[-1] = two[-2]
        start = np.cumsum(n) - n
        long = n > WINDOW
        count = np.where(long, (n - WINDOW + 2 * STRIDE - 1) // STRIDE, 0)
        of = np.repeat(np.arange(len(n)), count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        i = np.concatenate([start, start[of] + step * STRIDE])
        j = np.concatenate([start + n, np.minimum(start[of] + step * STRIDE + WINDOW, start[of] + n[of])])
        # A pair belongs to a window if both of its words do.
        v = one[j] - one[i] + two[j - 1] - two[i]
        z = (v[:, :-1] + prior()) / (v[:, -1:] + PRIOR)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return np.concatenate([doc, doc[of]]), e / e.sum(axis=1, keepdims=True)

    def __call__(self, texts: list[str]) -> list[tuple[int, float, str | None]]:
        if len(self.of_token) > CACHE_WORDS or len(self.of_raw) > 2 * CACHE_WORDS:
            self.forget()
        best, label, sentences_ = np.zeros(len(texts)), [None] * len(texts), [0] * len(texts)
        flat: list[int] = []
        lengths: list[int] = []
        docs: list[int] = []

        def flush() -> None:
            if lengths:
                doc, p = self._spans(flat, lengths, docs)
                bad = 1 - p[:, 0]
                order = np.argsort(bad, kind="stable")
                top = dict(zip(doc[order].tolist(), order.tolist(), strict=True))  # the last of a document is its largest
                for d, k in top.items():
                    if bad[k] > best[d]:
                        best[d], label[d] = bad[k], LABELS[1 + int(p[k, 1:].argmax())]
                flat.clear(), lengths.clear(), docs.clear()

        known = self.of_raw
        for d, text in enumerate(texts):
            for s in split_sentences(prepare(text)):
                sentences_[d] += 1
                before = len(flat)
                for w in _WORD.findall(s):
                    flat.extend(known.get(w) or self.learn(w))
                if len(flat) > before:
                    lengths.append(len(flat) - before)
                    docs.append(d)
                if len(flat) > CALL_WORDS:
                    flush()
        flush()
        return list(zip(sentences_, best.tolist(), label, strict=True))


def scorer(logits: np.ndarray) -> Callable[[str], tuple[int, float, str | None]]:
    """A scorer of single texts."""
    batch = Scorer(logits)
    return lambda text: batch([text])[0]


def _scoring(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        for batch in batches:
            for part in slices(batch):
                got = score(even_form([t or "" for t in part.column(2).to_pylist()]))
                cols = [pa.array([g[k] for g in got], SCORE.field(k + 2).type) for k in range(3)]
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), *cols], schema=SCORE)

    return run


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, sentences, score, label) of every row of documents (doc_id, source, text).

    score is the largest probability, over the sentences of the whole text, of not being clean; label says of which kind.
    Null and empty texts have no sentence and score 0. Rows with a null id or source are scored like the others; repeated
    rows count once.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model.logits)  # 32 MB, whatever the size of the input
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return rows.mapInArrow(_scoring(shared), "doc_id bigint, source string, sentences int, score double, label string").distinct()


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents, cases and their rate per source; a null source is one of its own."""
    kinds = [F.count_if((F.col("score") >= threshold) & (F.col("label") == k)).alias(k) for k in LABELS[1:]]
    found = F.count_if(F.col("score") >= threshold)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), found.alias("cases"), (found / F.count(F.lit(1))).alias("rate"), *kinds)
