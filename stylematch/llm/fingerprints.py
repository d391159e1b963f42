"""Homomorphic multiset hashes of texts: sums of wide paragraph vectors, modulo powers of two."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.llm.hashing import constants, mix, word_hashes, words

LANES = 256
_THREE = constants(3, 53)


def paragraph_sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: four 64-bit sums of its paragraphs' BLAKE2b digests, and ``LANES`` 32-bit sums of signs.

    A paragraph is what stands between line feeds. Its sign vector adds +1 or -1 to one lane for each of its words, by
    a hash of the word and the two after it in the paragraph. Both parts are sums over paragraphs modulo 2^64 and
    2^32, which no lane of a text below 4 GB reaches: the order of the paragraphs does not matter, and adding or subtracting one is adding or subtracting its sums.
    """
    exact = np.zeros((len(texts), 4), np.uint64)
    raw, rows = [], []
    for i, text in enumerate(texts):
        parts = text.encode().split(b"\n")
        digests = b"".join(hashlib.blake2b(p, digest_size=32).digest() for p in parts)
        exact[i] = np.frombuffer(digests, "<u8").reshape(-1, 4).sum(axis=0, dtype=np.uint64)
        raw += parts
        rows += [i] * len(parts)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, bounds = words(data, np.concatenate([[0], np.cumsum([len(p) for p in raw])]).astype(np.int64))
    if not len(starts):
        return exact, np.zeros((len(texts), LANES), np.int32)
    hashes = word_hashes(data, starts, ends, fold=False)
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts) - np.arange(len(hashes))
    run = hashes * _THREE[0]
    run[:-1] += np.where(left[:-1] > 1, hashes[1:], 0).astype(np.uint64) * _THREE[1]
    run[:-2] += np.where(left[:-2] > 2, hashes[2:], 0).astype(np.uint64) * _THREE[2]
    run = mix(run)
    cell = np.repeat(np.array(rows), counts) * LANES + (run % np.uint64(LANES)).astype(np.int64)
    signs = 1.0 - 2.0 * ((run >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    sums = np.bincount(cell, signs, len(texts) * LANES).astype(np.int64).astype(np.int32)
    return exact, sums.reshape(len(texts), LANES)


def encode(exact: np.ndarray, sums: np.ndarray) -> str:
    return exact.astype("<u8").tobytes().hex() + ":" + base64.b64encode(sums.astype("<i4").tobytes()).decode()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    exact, sums = fingerprint.split(":")
    return np.frombuffer(bytes.fromhex(exact), "<u8"), np.frombuffer(base64.b64decode(sums), "<i4")


def fingerprint(text: str) -> str:
    exact, sums = paragraph_sums([text])
    return encode(exact[0], sums[0])


def insert(old: str, paragraphs: str, sign: int = 1) -> str:
    """The fingerprint after the paragraphs of a text are added (sign 1) or taken away (sign -1)."""
    (a, b), (c, d) = decode(old), decode(fingerprint(paragraphs))
    return encode(a + c if sign > 0 else a - c, b + d if sign > 0 else b - d)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """1 for equal fingerprints, else the cosine of the sign sums, at least 0: about the share of common text."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / norm))) if norm else 0.0


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, copy, id descending): a row's next is the row after it in its part; copies are only nexts."""
    held = None
    for batch in batches:
        for at in range(0, len(batch), 200):
            rows = batch.slice(at, 200)
            new = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()))
            seen = ([held] if held else []) + new
            held = seen[-1]
            yield _describe(seen)


def _describe(seen: list[tuple[int, bool, int, str]]) -> pa.RecordBatch:
    """One result row for each of the rows in order that is followed by a row of its part."""
    at = [i for i in range(len(seen) - 1) if not seen[i][1] and seen[i][0] == seen[i + 1][0]]
    texts = [row[3] for row in seen]
    edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in at]
    sums = list(zip(*paragraph_sums(texts + edited)))
    own, new = sums[:len(texts)], sums[len(texts):]
    return pa.record_batch([
        pa.array([seen[i][2] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([encode(*own[i]) for i in at], pa.string()), pa.array([encode(*s) for s in new], pa.string()),
        pa.array([likeness(own[i], s) for i, s in zip(at, new)], pa.float64()),
        pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 100_000) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and the likeness to that and to the next document.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document
    by descending id; after the last comes the first. A null or empty text counts as empty. Null ids come last; rows
    that repeat an id go by text, those of an id that fills several ranges by a hash of the text first. A single row is
    its own next. An empty table gives an empty result. Other columns are not read.

    The ids are cut into ranges at quantiles, a range per ``range_rows`` rows but at least as many as there are shuffle
    partitions. An id that several cuts fall on is spread over their ranges by the hash of its texts, so only equal rows
    must stay together. Texts move once, each range to a task of its own; the first row of a range is copied to the range before
    it, so every row meets its next one while the range is read in order, and only one row is carried along.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(low)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // range_rows))
    cuts = keyed.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = np.array(sorted(int(c) for c in cuts), dtype=np.int64)
    keys, times = np.unique(cuts, return_counts=True)
    hot = [int(k) for k in keys[times > 1]]
    # texts are read for their hash only where an id needs it
    tie = F.when(F.col("key").isin(hot), F.xxhash64("text")).otherwise(F.lit(0)) if hot else F.lit(0)
    keyed = keyed.withColumn("tie", tie.cast("long"))

    @F.pandas_udf("int")
    def part(key, tie):
        k = key.to_numpy()
        left, right = np.searchsorted(cuts, k, side="left"), np.searchsorted(cuts, k, side="right")
        share = (tie.to_numpy().astype(np.float64) + 2.0 ** 63) / 2.0 ** 64
        width = np.maximum(right - left, 1)
        return pd.Series((len(cuts) - left - width + 1 + np.minimum((share * width).astype(np.int64), width - 1)).astype(np.int32))

    heads = keyed.select(part("key", "tie").alias("part"), "key", "tie").groupBy("part")
    heads = heads.agg(F.max(F.struct("key", F.bitwise_not("tie").alias("tie"))).alias("head")).orderBy("part").collect()
    before = [(h["head"]["key"], ~h["head"]["tie"], heads[i - 1]["part"]) for i, h in enumerate(heads)]

    # a row of three numbers per range
    table = spark.createDataFrame(before, "head long, head_tie long, to int")
    own = keyed.select(part("key", "tie").alias("part"), F.lit(False).alias("copy"), "doc_id", "text", "key", "tie")
    copies = keyed.join(F.broadcast(table), (F.col("key") == F.col("head")) & (F.col("tie") == F.col("head_tie")))
    copies = copies.select(F.col("to").alias("part"), F.lit(True).alias("copy"), "doc_id", "text", "key", "tie")
    dealt = own.unionByName(copies).repartitionById(n, F.col("part")).sortWithinPartitions("part", "copy", F.desc("key"), "tie", "text")
    return dealt.select("part", "copy", "doc_id", "text").mapInArrow(
        _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
