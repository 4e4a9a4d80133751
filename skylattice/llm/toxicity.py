"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

Two words are alike by the three-letter subsequences they share, each weighted down by the letters it
skips, so an insult with gaps or inserted characters stays close to the plain one. A Nyström map over
landmark words turns the kernel into features of fixed size, on which a linear machine with squared
hinge loss is trained; map and machine fold into one weight for each subsequence, so scoring a word
is a sum over its subsequences. A text is judged by its two worst words, as few insults make a sentence
and its document toxic; a logistic curve over the training documents turns their values into a score.

Labels mark whole documents, so the machine finds the words itself: it starts from words that toxic
documents hold far more often than others, then takes each toxic document's worst word as its
witness and each clean document's worst word as one more clean word, and trains again. Training uses at most ``TRAINING_DOCUMENTS`` labelled rows, by hash of
their id, and hands at most ``POSITIVE_WORDS + NEGATIVE_WORDS`` words to the driver. Scoring is one
narrow pass over whole texts.

Null or wordless texts get the value -1 of a clean word. Without a toxic or a clean labelled row all
scores are the smoothed share of toxic rows. Rows of labels with nulls are ignored; a document
labelled twice is toxic if any label says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.flattext import NOT_SPACE, lower_ascii, offsets_of, pieces, ragged, span_hashes, spans
from skylattice.session import materialize, ship_package

TRAINING_DOCUMENTS = 20_000
POSITIVE_WORDS, NEGATIVE_WORDS = 3_000, 12_000
LANDMARKS = 512
ROUNDS = 5
#: Decay for each letter a subsequence spans, and the longest span.
DECAY, SPAN = 0.45, 6
#: Letters of a word that are read at once; a longer word is read in windows that overlap by half.
WINDOW = 30
REGULARIZATION = 1e-3

_EDGE, _INSERTED = 0, 31
_SYMBOL = np.full(256, _INSERTED, np.uint8)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0x80:0xC0] = 27 + (np.arange(64) & 3)
_DROPPED = np.zeros(256, bool)
_DROPPED[0xC0:] = True  # first bytes of longer characters: the later ones tell letters apart
_FEATURES = 1 << 15


def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of that many symbols and their normed weights."""
    triples = [(i, j, k) for i in range(length) for j, k in combinations(range(i + 1, min(i + SPAN, length)), 2)]
    at = np.array(triples, np.int64).reshape(-1, 3)
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / max(1e-12, float(np.sqrt((weight**2).sum())))


_TRIPLES = {n: _subsequences(n) for n in range(2, WINDOW + 3)}


def word_windows(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of words in windows: symbol matrix (padded), window lengths, and the word of each window."""
    positions, _ = ragged(np.stack([begins, ends], 1).reshape(-1), 2 * np.arange(len(begins)))
    symbols = data[positions]
    kept = ~_DROPPED[symbols]
    cuts = offsets_of(kept)[offsets_of(ends - begins)]
    flat = _SYMBOL[symbols[kept]]
    sizes = np.diff(cuts)
    half = WINDOW // 2
    n_windows = np.maximum(1, -(-(sizes - half) // half))
    word = np.repeat(np.arange(len(sizes)), n_windows)
    number = np.arange(len(word)) - np.repeat(offsets_of(n_windows)[:-1], n_windows)
    start = cuts[:-1][word] + number * half
    stop = np.minimum(start + WINDOW, cuts[1:][word])
    matrix = np.zeros((len(word), WINDOW + 2), np.uint8)
    at, lengths = ragged(np.stack([start, stop], 1).reshape(-1), 2 * np.arange(len(word)))
    row = np.repeat(np.arange(len(word)), lengths)
    column = np.arange(len(at)) - np.repeat(offsets_of(lengths)[:-1], lengths) + 1
    matrix[row, column] = flat[at]
    return matrix, lengths + 2, word  # both edges count as symbols


def _keys(matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.int32)
    return wide[:, at[:, 0]] << 10 | wide[:, at[:, 1]] << 5 | wide[:, at[:, 2]]


def window_values(weights: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of the weights of each window's subsequences."""
    out = np.zeros(len(matrix))
    for length in np.unique(lengths):
        at, decay = _TRIPLES[int(length)]
        own = np.flatnonzero(lengths == length)
        for part in np.array_split(own, max(1, len(own) * len(at) // 2_000_000)):
            out[part] = weights[_keys(matrix[part], at)] @ decay if len(at) else 0.0
    return out


def _trimmed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words less the signs at both ends; words of signs alone go. Also the kept words' indices."""
    letter = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    places = np.flatnonzero(letter)
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.searchsorted(places, begins)
    last = np.searchsorted(places, ends) - 1
    kept = np.flatnonzero(last >= first)
    return places[first[kept]], places[last[kept]] + 1, kept


@dataclass
class Words:
    """The distinct words of a piece and where they occur."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    which: np.ndarray
    row: np.ndarray
    n_rows: int

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray) -> Words:
        data = lower_ascii(data)
        begins, ends, rows = spans(data, starts, NOT_SPACE)
        row = np.repeat(np.arange(len(starts) - 1), np.diff(rows))
        begins, ends, kept = _trimmed(data, begins, ends)
        _, first, which = np.unique(span_hashes(data, begins, ends), return_index=True, return_inverse=True)
        return cls(data, begins[first], ends[first], which, row[kept], len(starts) - 1)

    def values(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Value of each distinct word: its best window."""
        out = np.full(len(self.begins), -np.inf)
        if len(out):
            matrix, lengths, word = word_windows(self.data, self.begins, self.ends)
            np.maximum.at(out, word, window_values(weights, matrix, lengths) + bias)
        return out

    def row_values(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of each row's worst and second worst word, and the worst word's index (-1 for none)."""
        values = self.values(weights, bias)[self.which]
        order = np.lexsort((values, self.row))
        last = np.flatnonzero(np.r_[self.row[order][1:] != self.row[order][:-1], True]) if len(order) else order
        best, second, word = np.full(self.n_rows, -1.0), np.full(self.n_rows, -1.0), np.full(self.n_rows, -1)
        several = last[np.r_[last[:1] > 0, np.diff(last) > 1]]
        second[self.row[order[several]]] = values[order[several - 1]]
        best[self.row[order[last]]] = values[order[last]]
        word[self.row[order[last]]] = self.which[order[last]]
        return best, second, word

    def text(self, k: int) -> str:
        return self.data[self.begins[k] : self.ends[k]].tobytes().decode(errors="replace")


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first window of each word: symbol matrix and lengths (training words are single windows)."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    matrix, lengths, word = word_windows(data, np.r_[0, ends[:-1]], ends)
    _, first = np.unique(word, return_index=True)
    return matrix[first], lengths[first], word[first]


def _explicit(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of subsequence weights, one for each word."""
    out = np.zeros((len(matrix), _FEATURES), np.float32)
    for k, length in enumerate(lengths):
        at, decay = _TRIPLES[int(length)]
        np.add.at(out[k], _keys(matrix[k : k + 1], at)[0], decay)
    return out


@dataclass
class Model:
    """Weight of each subsequence, bias, and the logistic curve over a text's two worst words and 1."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float, float]


def train_words(positives: dict[str, float], negatives: dict[str, float]) -> tuple[np.ndarray, float]:
    """The machine over words with weights: folded weights and bias. Both classes weigh the same in total."""
    half = LANDMARKS // 2
    positive, negative = list(positives), list(negatives)
    heaviest = lambda words, n: sorted(words, key=lambda w: (-words[w], w))[:n]
    chosen = heaviest(positives, half)
    landmarks = chosen + heaviest(negatives, LANDMARKS - len(chosen))
    marks = _explicit(*_features(landmarks)[:2])
    kernel = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    good = values > 1e-6 * values.max()
    projection = vectors[:, good] / np.sqrt(values[good])
    matrix, lengths, _ = _features([*positive, *negative])
    near = np.empty((len(matrix), len(landmarks)))
    by_key = np.ascontiguousarray(marks.T)  # a second copy of the landmarks, dropped after use
    for length in np.unique(lengths):
        at, decay = _TRIPLES[int(length)]
        own = np.flatnonzero(lengths == length)
        for part in np.array_split(own, max(1, len(own) * len(at) // 4_000)):
            near[part] = np.einsum("t,ntm->nm", decay.astype(np.float32), by_key[_keys(matrix[part], at)]) if len(at) else 0.0
    del by_key
    x = np.c_[near @ projection, np.ones(len(matrix))]
    del near
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.concatenate([np.fromiter(side.values(), float) / sum(side.values()) for side in (positives, negatives)])
    w = np.zeros(x.shape[1])
    ridge = REGULARIZATION * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(30):  # Newton steps for the squared hinge: least squares over the rows inside the margin
        active = y * (x @ w) < 1
        xa = x[active] * c[active, None]
        step = np.linalg.solve(xa.T @ x[active] + ridge, xa.T @ y[active])
        if np.allclose(step, w, atol=1e-9):
            break
        w = step
    folded = (projection @ w[:-1]).astype(np.float32) @ marks  # in the landmarks' own precision: no wider copy of them
    return folded.astype(np.float64), float(w[-1])


def logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Curve of P(toxic | values of the two worst words), with smoothed targets so that separable data stay finite."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[values, np.ones(len(values))]
    w = np.array([1.0, 0.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-6 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def _word_counts(train: DataFrame) -> DataFrame:
    """word, toxic, clean: training documents of each label that hold the word, summed in tasks first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            for first, end, data, starts in pieces(batch.column("text")):
                words = Words.of(data, starts)
                own = np.unique(np.stack([words.which, words.row]), axis=1) if len(words.which) else np.zeros((2, 0), np.int64)
                toxic = np.bincount(own[0], weights=labels[first:end][own[1]], minlength=len(words.begins))
                every = np.bincount(own[0], minlength=len(words.begins))
                short = np.flatnonzero(words.ends - words.begins <= WINDOW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words.text(k) for k in short], pa.string()), pa.array(toxic[short].astype(np.int64)), pa.array((every - toxic)[short].astype(np.int64))],
                    names=["word", "toxic", "clean"],
                )

    rows = train.select("text", "toxic").mapInArrow(kernel, "word string, toxic long, clean long")
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _row_values(docs: DataFrame, weights: np.ndarray, bias: float, *, with_word: bool = False) -> DataFrame:
    """``docs`` (with text) with value and second, and the worst word if asked for, instead of text."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*docs.select(*others).schema.fields, T.StructField("value", T.DoubleType()), T.StructField("second", T.DoubleType())])
    if with_word:
        schema = schema.add("word", "string")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in pieces(batch.column("text")):
                words = Words.of(data, starts)
                value, second, word = words.row_values(*shared.value)
                columns = [*(batch.column(c).slice(first, end - first) for c in others), pa.array(value), pa.array(second)]
                if with_word:
                    columns.append(pa.array([words.text(k) if k >= 0 else None for k in word], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(kernel, schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on documents (doc_id, text) with labels (doc_id, toxic); the caller leaves held-out labels away."""
    ship_package(docs.sparkSession)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    sample = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_DOCUMENTS)
    sample = materialize(sample)  # at most TRAINING_DOCUMENTS rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(texts.join(F.broadcast(sample), "doc_id"))
    count = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = count.get(1, 0), count.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    nothing = Model(np.zeros(_FEATURES), 0.0, (0.0, 0.0, prior))
    if not n1 or not n0:
        return nothing
    counts = materialize(_word_counts(rows))
    odds = (F.col("toxic") + 0.5) / n1 / ((F.col("clean") + 0.5) / n0)
    found = counts.filter((F.col("toxic") >= 2) & (odds >= 10)).orderBy(F.desc(F.col("toxic") * F.log(odds)), "word").limit(POSITIVE_WORDS).collect()
    clean = counts.filter((F.col("clean") >= 1) & (F.col("clean") * n1 > F.col("toxic") * n0)).orderBy(F.xxhash64("word"), "word").limit(NEGATIVE_WORDS)
    positives = {r.word: float(r.toxic) for r in found}
    negatives = {r.word: 1.0 for r in clean.select("word").collect() if r.word not in positives}
    if not positives or not negatives:
        return nothing
    mostly_clean = counts.filter(odds < 10).select("word")
    for number in range(ROUNDS):
        weights, bias = train_words(positives, negatives)
        if number + 1 == ROUNDS:
            break
        told = materialize(
            _row_values(rows, weights, bias, with_word=True).groupBy("toxic", "word").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
            .filter(F.length("word") <= WINDOW // 2)
        )
        # A toxic document's witness is no word that clean ones hold as often.
        witness = told.filter("toxic = 1").join(mostly_clean, "word", "left_anti").orderBy(F.desc("n"), "word").limit(POSITIVE_WORDS).collect()
        positives = {r["word"]: float(r["n"]) for r in witness} or positives
        for r in told.filter("toxic = 0 AND value > -1").orderBy(F.desc(F.col("n") * (F.col("value") + 1)), "word").limit(NEGATIVE_WORDS // ROUNDS).collect():
            negatives[r["word"]] = negatives.get(r["word"], 1.0) + 2.0 * r["n"]
        negatives = {w: n for w, n in negatives.items() if w not in positives} or negatives
    judged = _row_values(rows, weights, bias).select("value", "second", "toxic").toArrow()
    values = np.stack([judged.column(c).to_numpy() for c in ("value", "second")], 1)
    return Model(weights, bias, logistic(values, judged.column("toxic").to_numpy().astype(float)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` less text, with value and second (of its two worst words) and score (0 to 1)."""
    a, b, c = model.curve
    curve = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("value") * a + F.col("second") * b + c))
    return _row_values(docs, model.weights, model.bias).withColumn("score", 1 / (1 + F.exp(-curve)))
