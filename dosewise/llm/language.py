"""Language identification by a linear-chain conditional random field over words.

Method. Each word of a text gets a label. A word's emission scores are sums of learned weights of its features: the whole
word (lexicon), affixes of one to four characters, and character bigrams and trigrams with the word's ends marked; a
transition matrix is learned with them. Forward-backward gives each word's posterior over the languages, so a text may
switch between them; a text's language has the greatest sum of posteriors over its words, and the score is its share.

Training. Sequences are lines, in parts of ``LINE`` words, of a sample of labelled rows: of each language whole texts, in the
order of a hash of id and text, until they have ``LEARNED`` words or are ``SAMPLE``. Every third part is joined to one of another language, so that transitions are learned from switches too. The likelihood with a quadratic penalty is climbed with Adam for a fixed number of steps.
A step sums over parts of ``PART`` words, so that the driver holds the sample but messages and transitions of one part only.

Scale. The model is fitted on the bounded sample and sent with the tasks (``BUCKETS`` x languages weights). Texts are
labelled whole: long ones are cut into runs of ``RUN`` words, whose messages are joined exactly by the products of their
transfer matrices, so one numpy step works on all runs of a slice of texts.

Null, empty and letterless texts are ``und`` with score 0. If there is nothing to learn from, every text is ``und``. Words
are runs of letters, marks and apostrophes in lower case. Ties go to the first language in order of name. Repeated rows
come out once per row; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dosewise.llm.common import free, slices
from dosewise.llm.pool import Numbers, opened

#: Hashed features.
BUCKETS = 1 << 16
#: Labelled rows of each language used for training, words after which no further row is taken, and words of a sequence.
SAMPLE, LEARNED, LINE = 200, 50_000, 40
STEPS, RATE, PENALTY = 40, 0.1, 1e-5
#: Words of the training sequences whose messages are in memory at once.
PART = 1 << 15
#: Of the ids, those whose checksum leaves 0 on division by this are held out.
FOLDS = 5
RUN = 64
CACHED_BYTES = 40 << 20
#: Texts are labelled in slices of about this many bytes: the messages of their words take some 50 times as much.
LABELLED_BYTES = 1 << 20
UNKNOWN = "und"

#: What a byte adds to a CRC-32.
_CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
_FIND = regex.compile(r"\p{L}[\p{L}\p{M}'’]*").findall
# Texts without other characters are searched by ``re``, which needs half the time, with the letters that ``regex`` knows.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if regex.match(r"\p{L}", c))
_is_rare = re.compile("[^\x00-\u024f\u2010-\u2027]").search
_find = re.compile(f"[{_LETTERS}][{_LETTERS}'’]*").findall


def words(text: str | None) -> list[str]:
    if not text:
        return []
    lowered = text.lower()
    return _FIND(lowered) if _is_rare(lowered) else _find(lowered)


def _continued(state: np.ndarray, first: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inverted CRC-32 of strings, continued by a character each, whose bytes start at ``first``."""
    state = _CRC[(state ^ data[first]) & 255] ^ (state >> 8)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        part = state[longer]
        state[longer] = _CRC[(part ^ data[first[longer] + k]) & 255] ^ (part >> 8)
    return state


def feature_rows(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the features of many (non-empty) words in one array, and where each word starts.

    A word's features are, in this order, the word, its first and its last one to four characters, and the bigrams and
    trigrams of the word between marks. A bucket is the remainder of a CRC-32, with a letter before words and affixes;
    checksums of all words grow together, by a character a step.
    """
    if not found:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    data = np.frombuffer(f"<{'><'.join(found)}>".encode(), np.uint8)
    first = np.flatnonzero(data & 0xC0 != 0x80)
    size = np.diff(first, append=len(data))
    n = np.fromiter(map(len, found), np.int64, len(found))
    most = np.minimum(n, 4)
    at = np.cumsum(n + 2) - (n + 2)  # a word's first mark, among all characters
    starts = np.concatenate([[0], np.cumsum(2 * most + 2 * n + 2)])
    out = np.empty(int(starts[-1]), np.uint32)
    whole = zlib.crc32(b"w")
    out[starts[:-1]] = [zlib.crc32(w.encode(), whole) ^ 0xFFFFFFFF for w in found]

    def of(state: np.ndarray, chars: np.ndarray) -> np.ndarray:
        return _continued(state, first[chars], size[chars], data)

    heads = np.full(len(found), zlib.crc32(b"p") ^ 0xFFFFFFFF, np.uint32)
    for k in range(1, 5):
        has = np.flatnonzero(n >= k)
        heads[has] = of(heads[has], at[has] + k)
        tails = np.full(len(has), zlib.crc32(b"s") ^ 0xFFFFFFFF, np.uint32)
        for j in range(k):
            tails = of(tails, at[has] + n[has] + 1 - k + j)
        out[starts[has] + 2 * k - 1], out[starts[has] + 2 * k] = heads[has], tails

    place = starts[:-1] + 1 + 2 * most
    grams = _continued(np.full(len(first), 0xFFFFFFFF, np.uint32), first, size, data)
    for k in (1, 2):
        grams = _continued(grams[:-1], first[k:], size[k:], data)
        each = n + 2 - k  # grams of a word and its marks
        order = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        out[np.repeat(place, each) + order] = grams[np.repeat(at, each) + order]
        place = place + each
    return ((out ^ np.uint32(0xFFFFFFFF)) % BUCKETS).astype(np.int64), starts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # features x languages
    moves: np.ndarray  # languages x languages, scores of a label after a label

    def emissions(self, found: list[str]) -> np.ndarray:
        """Scores of words, as factors with a greatest value of 1 per word."""
        if not found:
            return np.empty((0, len(self.languages)))
        flat, starts = feature_rows(found)
        scores = np.stack([np.add.reduceat(w[flat], starts[:-1]) for w in np.ascontiguousarray(self.weights.T)], axis=1)
        return np.exp(scores - scores.max(axis=1, keepdims=True))


def _scaled(rows: np.ndarray) -> np.ndarray:
    """The messages or matrices, each divided by its greatest value."""
    # Along the longer axis numpy finds the same values some ten times faster.
    greatest = np.ascontiguousarray(rows.reshape(len(rows), -1).T).max(axis=0)
    return rows / greatest.reshape(-1, *[1] * (rows.ndim - 1))


def posteriors(emissions: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Posterior of every label at every word by forward-backward on each sequence, and its two messages.

    ``emissions`` has the factors of all words, ``starts`` the first word of each (non-empty) sequence and the end.
    Sequences are cut into runs of ``RUN`` words. The transfer matrix of a run gives the messages that enter the next
    and the previous run; within runs the recursion goes over all runs at once.
    """
    k = emissions.shape[1]
    factors = np.exp(moves - moves.max())
    sizes = np.diff(starts)
    runs_of = -(-sizes // RUN)
    first_run = np.concatenate([[0], np.cumsum(runs_of)])
    n = int(first_run[-1])
    sequence = np.repeat(np.arange(len(sizes)), runs_of)
    run_start = starts[sequence] + RUN * (np.arange(n) - first_run[sequence])
    run_size = np.minimum(RUN, starts[sequence + 1] - run_start)

    # Padding: a word beyond a run's end passes messages on unchanged.
    place = run_start[:, None] + np.arange(RUN)
    inside = np.arange(RUN) < run_size[:, None]
    padded = np.where(inside[:, :, None], emissions[np.minimum(place, len(emissions) - 1)], 1.0)

    several = runs_of.max() > 1
    if several:
        transfer = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        for t in range(RUN):
            on = inside[:, t]
            step = (transfer[on].reshape(-1, k) @ factors).reshape(-1, k, k)
            transfer[on] = _scaled(step * padded[on, t][:, None, :])

    # Messages at the borders of runs, one pass over the runs of all sequences side by side.
    entering = np.ones((n, k))  # before the first word of a run; for the first run there is no move before it
    leaving = np.ones((n, k))  # after the last word of a run
    if several:
        for r in range(1, int(runs_of.max())):
            at = first_run[:-1][runs_of > r] + r
            before = at - 1
            if r == 1:
                lead = _without_move(padded[before], inside[before], factors)
                entering[at] = lead
            else:
                entering[at] = np.einsum("ni,nij->nj", entering[before], transfer[before])
            entering[at] /= entering[at].max(axis=1, keepdims=True)
        for r in range(int(runs_of.max()) - 2, -1, -1):
            at = first_run[:-1][runs_of > r + 1] + r
            leaving[at] = np.einsum("nij,nj->ni", transfer[at + 1], leaving[at + 1])
            leaving[at] /= leaving[at].max(axis=1, keepdims=True)

    starts_sequence = np.zeros(n, bool)
    starts_sequence[first_run[:-1]] = True
    forward = np.empty((RUN, n, k))
    message = entering
    for t in range(RUN):
        moved = message @ factors
        if t == 0:
            moved = np.where(starts_sequence[:, None], 1.0, moved)
        moved = _scaled(moved * padded[:, t])
        message = np.where(inside[:, t][:, None], moved, message)
        forward[t] = message
    backward = np.empty((RUN, n, k))
    message = leaving
    for t in range(RUN - 1, -1, -1):
        backward[t] = message
        back = _scaled((message * padded[:, t]) @ factors.T)
        message = np.where(inside[:, t][:, None], back, message)
    forward, backward = forward.transpose(1, 0, 2)[inside], backward.transpose(1, 0, 2)[inside]
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward


def _without_move(padded: np.ndarray, inside: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Forward messages after first runs, whose first word follows no other word."""
    message = padded[:, 0].copy()
    for t in range(1, padded.shape[1]):
        moved = _scaled((message @ factors) * padded[:, t])
        message = np.where(inside[:, t][:, None], moved, message)
    return message


def training_lines(text: str) -> list[list[str]]:
    """Parts of a text's lines."""
    parts = []
    for line in text.split("\n"):
        found = words(line)
        parts += [found[i : i + LINE] for i in range(0, len(found), LINE)]
    return parts


def _expected(factors: np.ndarray, word: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct word is expected to have each label, and each label to follow each, in some sequences."""
    emissions = factors[word]
    post, forward, backward = posteriors(emissions, moves, starts)
    expected = np.stack([np.bincount(word, post[:, y], len(factors)) for y in range(factors.shape[1])], axis=1)
    inner = np.ones(len(word), bool)
    inner[starts[:-1]] = False
    later = np.flatnonzero(inner)
    pairs = forward[later - 1][:, :, None] * np.exp(moves - moves.max()) * (emissions * backward)[later][:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return expected, pairs.sum(axis=0)


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """The model of ``(text, language)`` rows; None without a word."""
    languages = sorted({label for _, label in rows})
    number = {label: i for i, label in enumerate(languages)}
    lines = [(f, [number[label]] * len(f)) for text, label in rows for f in training_lines(text)]
    if not lines:
        return None
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(lines))
    lines = [lines[i] for i in order]
    joined = [
        (a[0] + b[0], a[1] + b[1]) if i % 3 == 0 and a[1][0] != b[1][0] else a
        for i, (a, b) in enumerate(zip(lines, lines[1:] + lines[:1]))
    ]
    starts = np.concatenate([[0], np.cumsum([len(w) for w, _ in joined])])
    labels = np.fromiter(chain.from_iterable(y for _, y in joined), np.int64, int(starts[-1]))
    distinct: dict[str, int] = {}
    word = np.fromiter((distinct.setdefault(w, len(distinct)) for w in chain.from_iterable(w for w, _ in joined)), np.int64, len(labels))
    del lines, joined
    flat, feature_starts = feature_rows(list(distinct))
    owner = np.repeat(np.arange(len(distinct)), np.diff(feature_starts))

    k = len(languages)
    inner = np.ones(len(word), bool)
    inner[starts[:-1]] = False
    later = np.flatnonzero(inner)
    seen_moves = np.bincount(labels[later - 1] * k + labels[later], minlength=k * k).reshape(k, k)
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    gold = np.zeros((len(distinct), k))
    np.add.at(gold, (word, labels), 1.0)
    parts = [0, *(np.flatnonzero(np.diff(starts[:-1] // PART)) + 1).tolist(), len(starts) - 1]
    for step in range(1, STEPS + 1):
        scores = np.stack([np.add.reduceat(weights[:, y][flat], feature_starts[:-1]) for y in range(k)], axis=1)
        factors = np.exp(scores - scores.max(axis=1, keepdims=True))
        slope, moved = gold.copy(), np.zeros((k, k))
        for first, last in zip(parts, parts[1:]):  # sums over sequences: the arrays of one part of them at a time
            own = slice(starts[first], starts[last])
            expected, passed = _expected(factors, word[own], moves, starts[first : last + 1] - starts[first])
            slope -= expected
            moved += passed
        grad = np.stack([np.bincount(flat, slope[:, y][owner], BUCKETS) for y in range(k)], axis=1) / len(word)
        grad_moves = (seen_moves - moved) / len(word)
        for value, g, m, v in ((weights, grad, *state[:2]), (moves, grad_moves, *state[2:])):
            g = g - PENALTY * value
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(languages, weights.astype(np.float32), moves)


class Labeller:
    """A model with the emission scores of the words a worker has met, in bounded number."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()
        self.factors = np.empty((0, len(self.model.languages)))
        self.size = 0

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of all texts, and where each text starts, with the end as last entry."""
        if self.size > CACHED_BYTES:
            self._clear()
        found = [words(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        word = np.fromiter(map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(starts[-1]))
        if self.known.new:
            new, kept = self.known.taken()
            factors = self.model.emissions(new)
            self.factors = np.concatenate([self.factors, factors])
            self.size += kept + factors.nbytes
        post = np.empty((int(starts[-1]), len(self.model.languages)))
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            post[:] = posteriors(self.factors[word], self.model.moves, starts[np.append(filled, len(texts))])[0]
        return post, starts


def _labeller(model: Model) -> Labeller:
    """This worker's labeller of the model, kept between tasks."""
    digest = hashlib.sha256(model.weights.tobytes() + model.moves.tobytes()).digest()
    return opened(("language", digest), lambda: Labeller(model))


def _predict(
    batches: Iterator[pa.RecordBatch], model: Model | None, by_word: bool = False, added: tuple[str, str] = ("_lang_pred", "_score")
) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", LABELLED_BYTES):
        n = batch.num_rows
        names, scores = [UNKNOWN] * n, np.zeros(n)
        if model:
            post, starts = _labeller(model).label(batch.column("text").to_pylist())
            filled = np.flatnonzero(np.diff(starts))
            if len(filled):
                sums = np.add.reduceat(post, starts[filled], axis=0)
                best = sums.argmax(axis=1)
                most = np.add.reduceat(post.max(axis=1), starts[filled]) if by_word else sums[np.arange(len(filled)), best]
                scores[filled] = np.minimum(1.0, most / np.diff(starts)[filled])
                for i, y in zip(filled.tolist(), best.tolist()):
                    names[i] = model.languages[y]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
            names=[*batch.schema.names, *added],
        )


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def train(docs: DataFrame) -> Model | None:
    """The model learned from ``doc_id``, ``text`` and ``lang`` of the rows that are not held out."""
    rows = docs.filter((fold("doc_id", FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # A share of each language's rows, a little above SAMPLE rows, by a hash; repeated rows are one. Then as many as wanted.
    ends = [(lang, int(-(2**63) + min(1.0, 1.5 * SAMPLE / n) * (2**64 - 1))) for lang, n in counts.items()]
    shares = F.create_map(*[F.lit(x) for lang, end in ends for x in (lang, min(end, 2**63 - 1))])
    place = F.xxhash64(F.lit(7), "doc_id", "text")
    chosen = rows.select("lang", "text", place.alias("place")).filter(F.col("place") <= shares[F.col("lang")])
    found = chosen.groupBy("lang", "place").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["place"], r["text"]))
    taken: dict[str, list[tuple[str, str]]] = {lang: [] for lang in sorted(counts)}
    learned = dict.fromkeys(taken, 0)
    for r in found:
        if len(taken[r["lang"]]) < SAMPLE and learned[r["lang"]] < LEARNED:
            taken[r["lang"]].append((r["text"], r["lang"]))
            learned[r["lang"]] += len(words(r["text"]))
    return fit([row for lang in taken.values() for row in lang])


def labelled(docs: DataFrame, model: Model | None, by_word: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``_lang_pred`` and ``_score`` as the last columns, with underscores more if there are such.

    By word, the score is the mean of each word's greatest posterior.
    """
    added = (free("_lang_pred", docs.columns), free("_score", docs.columns))
    schema = T.StructType([*docs.schema, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    return docs.mapInArrow(partial(_predict, model=model, by_word=by_word, added=added), schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    # The text goes through the workers only to be read there.
    found = labelled(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op7_crf_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs))
    held_out = F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")
