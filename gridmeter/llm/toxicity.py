"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three hashed ones: of the word (ASCII folded, outer punctuation off), of
its first six bytes and of its first four. Filters of several widths slide over the whole text, the
largest response of each is kept (max pooling), and a logistic layer gives the raw score. The language
is guessed from the text by hashed word frequencies, and a threshold calibrated for it on a part of the
training rows shifts the score, so that 0.5 is the threshold of every language. Every language of the
training rows has a profile (128 KB each); rows without a language are in none.

The model is fitted in one task on at most `max_rows` labelled rows (half of them of either label, by
hash of doc_id); scoring is a map over all rows and whole texts.

Defined results: a text without words, or null, gets the score of the bias alone; held_out of a row
without doc_id is false; without labelled rows of both kinds all scores are 0. Labels other than 0 and 1
are ignored, and so are those of documents labelled both 0 and 1. Other columns are never inputs of a score.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import small_batches

FLUSH_BYTES = 1 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
MAX_ROWS, EPOCHS, BATCH, SEED = 6000, 6, 32, 7
#: Words whose responses are in memory at once.
TOGETHER = 1 << 15
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Three buckets of each word (words x 3), and the rows' ranges of words."""
    data, offsets = K.utf8(column)
    starts, ends, rows = K.word_spans(data, offsets)
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        b -= (b - a > 1) & PUNCTUATION[data[b - 1]]
        a += (b - a > 1) & PUNCTUATION[data[a]]
    out = np.empty((len(a), 3), np.uint16)  # BUCKETS fit
    for i, most in enumerate((None, 6, 4)):
        end = b if most is None else np.minimum(b, a + most)
        out[:, i] = (K.span_hashes(data, a, end, K.FOLDED) >> np.uint64(40)) % np.uint64(BUCKETS)
    return out, rows


@dataclass
class Model:
    tables: np.ndarray = field(default_factory=lambda: np.zeros((3, BUCKETS, DIM), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((DIM, sum(WIDTHS) * FILTERS), np.float32))  # for each width, for each place in it, FILTERS columns
    offset: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = 0.0
    languages: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(1, np.inf, np.float32))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as arrays:
            return cls(**{name: (float(arrays[name]) if name == "bias" else arrays[name]) for name in arrays.files})

    def embed(self, words: np.ndarray) -> np.ndarray:
        return self.tables[0][words[:, 0]] + self.tables[1][words[:, 1]] + self.tables[2][words[:, 2]]

    def responses(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of every filter at every word; beyond a text's end words count as zero."""
        z = x @ self.filters
        left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(x))  # words from here to the end
        out, at = [], 0
        for width in WIDTHS:
            total = z[:, at : at + FILTERS].copy()
            for j in range(1, width):
                total[:-j] += z[j:, at + j * FILTERS : at + (j + 1) * FILTERS] * (left[:-j, None] > j)
            at += width * FILTERS
            out.append(total)
        return np.concatenate(out, axis=1) + self.offset

    def logits(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw score and guessed language of each row; some rows at a time, and a longer text by pieces that overlap."""
        n = len(rows) - 1
        pooled, language = np.zeros((n, len(self.weight)), np.float32), np.zeros((n, self.languages.shape[1]))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(rows, rows[i] + TOGETHER, side="right")) - 1)
            for a in range(int(rows[i]), max(int(rows[j]), int(rows[i]) + 1), TOGETHER):
                b = min(int(rows[j]), a + TOGETHER + max(WIDTHS) - 1) if j == i + 1 else int(rows[j])
                part = np.clip(rows[i : j + 1], a, b) - a
                full = np.flatnonzero(np.diff(part) > 0)
                if len(full):
                    z = self.responses(self.embed(words[a:b]), part)
                    if b < rows[j]:  # what the piece's end cuts off belongs to the next
                        z = z[: 1 - max(WIDTHS)]
                    pooled[i + full] = np.maximum(pooled[i + full], np.maximum.reduceat(z, part[:-1][full], axis=0))
                    for c in range(0, language.shape[1], 16):  # some languages at a time, for memory
                        language[i + full, c : c + 16] += np.add.reduceat(self.languages[words[a:b, 0], c : c + 16], part[:-1][full], axis=0)
                if j > i + 1:
                    break
            i = j
        return pooled @ self.weight + np.float32(self.bias), language.argmax(axis=1)

    def scores(self, column: pa.ChunkedArray) -> np.ndarray:
        raw, language = self.logits(*features(column))
        z = np.clip((raw - self.thresholds[language]).astype(np.float64), -60, 60)
        return 1 / (1 + np.exp(-z))


def _slices(rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words of the chosen rows, and their new ranges."""
    n = np.diff(rows)[chosen]
    at = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(rows[:-1][chosen] - at[:-1], n) + np.arange(at[-1]), at


def _words_of(words: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the chosen rows (ascending), and their new ranges."""
    use = np.zeros(len(rows) - 1, bool)
    use[chosen] = True
    return words[np.repeat(use, np.diff(rows))], np.concatenate([[0], np.cumsum(np.diff(rows)[chosen])])


def _presence(words: np.ndarray, rows: np.ndarray, column: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of label 1 and 0 each bucket occurs."""
    one, zero = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i in range(0, len(y), 256):
        part = rows[i : i + 257]
        row = np.repeat(np.arange(i, i + len(part) - 1), np.diff(part))
        pairs = np.unique(row * BUCKETS + words[part[0] : part[-1], column])
        hit, doc = pairs % BUCKETS, pairs // BUCKETS
        one += np.bincount(hit, y[doc], BUCKETS)
        zero += np.bincount(hit, 1 - y[doc], BUCKETS)
    return one, zero


def train(words: np.ndarray, rows: np.ndarray, y: np.ndarray, lang: list[str | None], seed: int = SEED) -> Model:
    model, rng = Model(), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        return model
    check = rng.random(len(y)) < 0.25  # calibrates thresholds and takes no part in the fit
    if not 0 < y[~check].sum() < (~check).sum():
        check[:] = False
    fit = np.flatnonzero(~check)
    some, at = _words_of(words, rows, fit)
    model.tables[:] = rng.normal(0, 0.05, model.tables.shape)
    for i in range(3):  # a start at the smoothed log odds of each bucket
        one, zero = _presence(some, at, i, y[fit])
        odds = np.log((one + 0.5) / (y[fit].sum() + 1)) - np.log((zero + 0.5) / ((1 - y[fit]).sum() + 1))
        model.tables[i, :, i] = np.clip(odds, -4, 6) * (one + zero) / (one + zero + 8)
    del some
    model.filters[:] = rng.normal(0, 0.1, model.filters.shape)
    model.filters[:, 0] = 0
    model.filters[:3, 0] = 0.6
    model.weight[:] = rng.normal(0, 0.1, len(model.weight))
    model.weight[0] = 1.0
    model.offset[0] = -1.0
    model.bias = -2.0
    _descend(model, words, rows, y, fit, rng)
    _calibrate(model, words, rows, y, lang, np.flatnonzero(check) if check.sum() > 40 else np.arange(len(y)))
    return model


def _descend(model: Model, words: np.ndarray, rows: np.ndarray, y: np.ndarray, fit: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the log loss; gradients flow through each filter's best place only."""
    sums = {name: np.full(getattr(model, name).shape, 1e-2, np.float32) for name in ("filters", "offset", "weight")}
    table_sums = np.full((3, BUCKETS), 1e-2, np.float32)
    balance = np.where(y[fit] == 1, 0.5 / max(y[fit].mean(), 1e-9), 0.5 / max(1 - y[fit].mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            some = some[np.diff(rows)[fit[some]] > 0]
            if not len(some):
                continue
            index, at = _slices(rows, fit[some])
            batch = words[index]
            x = model.embed(batch)
            z = model.responses(x, at)
            best = np.stack([z[s:e].argmax(axis=0) + s for s, e in zip(at[:-1], at[1:], strict=True)])
            top = np.take_along_axis(z, best, axis=0)
            pooled = np.maximum(0, top)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.bias, -30, 30)))
            g = ((p - y[fit[some]]) * balance[some] / len(some)).astype(np.float32)
            gz = g[:, None] * model.weight * (top > 0)
            grad = {"weight": pooled.T @ g + 1e-5 * model.weight, "offset": gz.sum(axis=0), "filters": 1e-5 * model.filters}
            dx = np.zeros_like(x)
            column = 0
            ends = at[1:, None]
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    places = best[:, own] + j
                    inside = places < ends
                    places = np.where(inside, places, 0)
                    gi = gz[:, own] * inside
                    grad["filters"][:, column : column + FILTERS] += np.einsum("bf,bfd->df", gi, x[places])
                    np.add.at(dx, places, gi[:, :, None] * model.filters[:, column : column + FILTERS].T[None])
                    column += FILTERS
            for name, d in grad.items():
                sums[name] += d * d
                getattr(model, name)[...] -= 0.05 * d / np.sqrt(sums[name])
            model.bias -= 0.02 * float(g.sum())
            hit = np.flatnonzero(np.abs(dx).sum(axis=1))
            for i in range(3):
                table_sums[i] += np.bincount(batch[hit, i], (dx[hit] ** 2).mean(axis=1), BUCKETS).astype(np.float32)
                np.add.at(model.tables[i], batch[hit, i], -0.03 * dx[hit] / np.sqrt(table_sums[i][batch[hit, i]])[:, None])


def _calibrate(model: Model, words: np.ndarray, rows: np.ndarray, y: np.ndarray, lang: list[str | None], check: np.ndarray) -> None:
    """Profiles of all languages from all training rows that have one; for each language the threshold with the best F1 on the check rows."""
    names = [n for n, _ in sorted(Counter(n for n in lang if n).items(), key=lambda x: (-x[1], x[0]))] or [None]
    code = {n: i for i, n in enumerate(names)}
    row_lang = np.array([code.get(n, -1) for n in lang])
    model.languages = np.empty((BUCKETS, len(names)), np.float32)
    for i in range(len(names)):
        counts = np.bincount(_words_of(words, rows, np.flatnonzero(row_lang == i))[0][:, 0], minlength=BUCKETS) + 0.1
        model.languages[:, i] = np.log(counts / counts.sum())
    raw, guessed = model.logits(*_words_of(words, rows, check))
    common = _threshold(raw, y[check], 0.0)
    model.thresholds = np.array([_threshold(raw[guessed == i], y[check][guessed == i], common) for i in range(len(names))], np.float32)


def _threshold(raw: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    if y.sum() < 5 or (1 - y).sum() < 5:
        return otherwise
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = int(best[len(best) // 2])
    return float((raw[order[i]] + (raw[order[i + 1]] if i + 1 < len(y) else raw[order[i]] - 1)) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """text, lang, toxic of at most max_rows labelled rows of docs (doc_id, text, lang) that are not held out, in a fixed order.

    Documents labelled both ways teach nothing and are left out; equal texts of a document count once.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other")
    half = [rows.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for t in (0, 1)]
    chosen = half[0].unionByName(half[1]).select("doc_id", "toxic")  # max_rows rows bound the broadcast and what follows
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(chosen), "doc_id")
    got = got.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).groupBy("h").agg(F.min(F.struct("doc_id", "text", "lang", "toxic")).alias("x"))
    return got.select("x.*", "h").repartition(1).sortWithinPartitions("doc_id", "h").select("text", "lang", "toxic")


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows of the task. Texts become buckets (six bytes a word) as they come."""
    words, sizes, y, lang = [np.zeros((0, 3), np.uint16)], [np.zeros(1, np.int64)], [], []
    for table in K.gathered(batches, FLUSH_BYTES):
        w, rows = features(table["text"])
        words.append(w)
        sizes.append(np.diff(rows))
        y += table["toxic"].to_pylist()
        lang += table["lang"].to_pylist()
    model = train(np.concatenate(words), np.cumsum(np.concatenate(sizes)), np.array(y, np.float64), lang)
    yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of the training rows, trained in one task; only the model comes to the driver."""
    small_batches(docs.sparkSession)
    got = training_rows(docs, labels, max_rows).mapInArrow(_train, "model binary").collect()
    return Model.from_bytes(bytes(got[0].model)) if got else Model()


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.gathered(batches, FLUSH_BYTES):
            scores = pa.array(model.value.scores(table["text"]))
            for batch in table.append_column("score", scores).combine_chunks().to_batches():
                yield batch

    return run


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs and score, for every row; docs has a column text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared), docs.withColumn("score", F.lit(0.0)).schema)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    out = with_scores(docs.select("doc_id", "text"), fit(docs, labels, max_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
