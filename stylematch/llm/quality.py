"""A text quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.llm.hashing import constants, mix, text_chunks, word_hashes, words

#: The most labelled rows that a model is fitted on: those with the least hashed ids.
FIT_ROWS = 20_000
THRESHOLD = 0.3

# Character classes that are counted.
CLASSES = ("upper", "lower", "digit", "blank", "break", "stop", "shout", "sign", "pipe", "bracket", "quote", "other", "wide", "tail")
_MEMBERS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "blank": " \t\v\f",
    "break": "\n\r", "stop": ".,;:", "shout": "!?", "sign": "#$%&*@^~+=_\\/", "pipe": "|", "bracket": "()[]{}<>", "quote": "\"'`-",
}
FEATURES = [f"{c}_share" for c in CLASSES] + [
    "log_chars", "log_words", "word_chars", "word_chars_spread", "long_words", "distinct_words", "distinct_threes", "top_word", "short_words",
    "marked_words", "upper_words", "log_lines", "line_words",
]


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES.index("other"), np.int64)
    for name, members in _MEMBERS.items():
        out[list(members.encode())] = CLASSES.index(name)
    out[0xC0:] = CLASSES.index("wide")
    out[0x80:0xC0] = CLASSES.index("tail")
    return out


_CLASS = _class_of_byte()
_THREE = constants(3, 71)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text: shares and means that need no labels, language or source."""
    found = [np.zeros((0, len(FEATURES)))]
    k = len(CLASSES)
    for _, data, offsets in text_chunks(column):
        n = len(offsets) - 1
        rows = np.repeat(np.arange(n) * k, np.diff(offsets))
        counts = np.bincount(rows + _CLASS[data], minlength=n * k).reshape(n, k).astype(float)
        chars = counts.sum(axis=1) - counts[:, CLASSES.index("tail")]
        starts, ends, bounds = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        lengths = (ends - starts).astype(float)
        own = np.repeat(np.arange(n), np.diff(bounds))
        total = np.diff(bounds).astype(float)
        per_word = np.maximum(total, 1)

        def mean(values):
            return np.bincount(own, values, n) / per_word

        last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.int64)
        first = _CLASS[data[starts]] if len(starts) else np.zeros(0, np.int64)
        marked = np.isin(last, [CLASSES.index(c) for c in ("shout", "sign", "pipe")])
        average = mean(lengths)
        spread = np.sqrt(np.maximum(0, mean(lengths ** 2) - average ** 2))
        distinct, threes, top = np.ones(n), np.ones(n), np.zeros(n)
        for i in range(n):
            h = hashes[bounds[i]:bounds[i + 1]]
            if len(h):
                times = np.unique(h, return_counts=True)[1]
                distinct[i], top[i] = len(times) / len(h), times.max() / len(h)
            if len(h) > 2:
                threes[i] = len(np.unique(h[:-2] * _THREE[0] + h[1:-1] * _THREE[1] + h[2:] * _THREE[2])) / (len(h) - 2)
        lines = counts[:, CLASSES.index("break")] + 1
        found.append(np.column_stack([
            counts / np.maximum(1, counts.sum(axis=1))[:, None], np.log1p(chars), np.log1p(total), average, spread, mean(lengths > 12), distinct, threes, top,
            mean(lengths < 3), mean(marked), mean((first == 0) & (last != 1)), np.log(lines), total / lines,
        ]))
    return np.concatenate(found)


@dataclass(frozen=True)
class Forest:
    """Trees of one depth as arrays: node i of a tree has the children 2i + 1 and 2i + 2; values are at the leaves."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row: all rows go down a level of a tree at once."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_rows: int = 10) -> Forest:
    """Boosted trees for 0/1 labels: each split is the best of the cells of a histogram of gradients by bin.

    Without rows, or with rows of one label, the forest has no trees and scores the smoothed share of label 1.
    """
    inner = (1 << depth) - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    none = Forest(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    total = np.full(len(y), base)
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            head = (1 << level) - 1
            width = 1 << level
            gain_of, feature_of, bin_of = np.zeros(width), np.zeros(width, np.int64), np.full(width, -1)
            for f, edge in enumerate(edges):
                cell = (node - head) * bins + codes[:, f]
                sums = [np.bincount(cell, v, width * bins).reshape(width, bins) for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = [s.cumsum(axis=1) for s in sums], [s.sum(axis=1, keepdims=True) for s in sums]
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                gain[(nl < least_rows) | (nt - nl < least_rows)] = 0
                gain[:, len(edge):] = 0
                best = gain.argmax(axis=1)
                better = gain[np.arange(width), best] > gain_of + 1e-9
                gain_of[better], feature_of[better], bin_of[better] = gain[better, best[better]], f, best[better]
            for i in range(width):
                if bin_of[i] >= 0:
                    feature[head + i], cut[head + i] = feature_of[i], edges[feature_of[i]][bin_of[i]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        sum_g, sum_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = rate * sum_g / (sum_h + ridge)
        total += value[leaf]
        features.append(feature), cuts.append(cut), values.append(value)
    return Forest(depth, base, np.array(features), np.array(cuts), np.array(values))


def in_fold(id_column) -> F.Column:
    """Whether a row is held out: the CRC-32 of its id as text is a multiple of 5. False for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(list(statistics(batch.column(1))), pa.list_(pa.float64()))], ["key", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Fit on the documents with a 0/1 ``quality`` label that are not held out, at most ``rows`` of them.

    The sample is the labelled ids with the least hashes, so it does not depend on the partitions, and it is the only
    bound: statistics are taken of their whole texts. Null labels and ids are ignored; an id with both labels counts
    with both, one with several texts once per text, and if that makes more than ``rows`` rows, those with the least
    hashes of id and text are taken, so no more than ``rows`` reach the driver.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].cast("int").alias("y")).filter("label_id IS NOT NULL AND y IN (0, 1)")
    known = known.filter(~in_fold(F.col("label_id"))).distinct()
    sample = known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(rows)
    # at most ``rows`` rows of two numbers: small by the bound, so the texts stay where they are
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    named = joined.select(F.struct("y", "label_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).alias("key"), "text")
    # narrow rows are made distinct and cut to the bound, so an id with very many rows costs their statistics alone
    distinct = named.mapInArrow(_measured, "key struct<y:int,label_id:long,digest:string>, x array<double>").dropDuplicates(["key"])
    held = distinct.orderBy(F.xxhash64("key.label_id", "key.digest"), "key").limit(rows).select("key.y", "x").toPandas()
    if not len(held):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(held["x"].to_numpy()), held["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its whole text alone.

    Null and empty texts are scored as texts without characters. Null and repeated ids are scored like others; a null
    id is not held out. An empty table gives an empty result. Other columns are not read.
    """

    def scored(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(forest.score(statistics(batch.column(2))))], ["doc_id", "held_out", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), in_fold(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``THRESHOLD``."""
    at = docs.columns.index(text_col)

    def kept(batches):
        for batch in batches:
            texts = batch.column(at)
            for start in range(0, len(batch), 500):
                good = forest.score(statistics(texts.slice(start, 500))) >= THRESHOLD
                yield batch.slice(start, 500).filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
