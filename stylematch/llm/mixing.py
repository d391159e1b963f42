"""Mixing sources to target weights by blocks of fixed length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.llm.hashing import constants, mix
from stylematch.llm.prefix import running_totals
from stylematch.session import stage

BLOCK = 64
SLOTS = 256
MOST_TIMES = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most_times: int = MOST_TIMES) -> list[float]:
    """Shares of the sum of the sizes by weight; what exceeds ``most_times`` the own size is shared anew by weight."""
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    cap = sizes * most_times
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while open_.any():
        left = sizes.sum() - cap[~open_].sum()
        out[open_] = left * weights[open_] / weights[open_].sum()
        over = open_ & (out > cap)
        if not over.any():
            break
        out[over] = cap[over]
        open_ &= ~over
    return out.tolist()


def permuted(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index under a pseudorandom permutation of 0..size-1 chosen by the key.

    Four Feistel rounds on the least even number of bits that holds the size; images beyond it are sent round again.
    """
    at, size, key = at.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.ones(len(at), np.uint64)
    while (small := (np.uint64(1) << (np.uint64(2) * half)) < size).any():
        half[small] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.copy(), np.arange(len(at))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for salt in constants(4, 91):
            left, right = right, left ^ (mix(right * salt + key[todo]) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _with_source(docs: DataFrame) -> DataFrame:
    """Documents with their size; the source of each gets a number that is never null: its place by code point, null last."""
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"),
    )
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")


def mix_sources(docs: DataFrame, seed: int = 0, block: int = BLOCK, slots: int = SLOTS, weights: tuple[float, ...] = (1, 2, 3)) -> tuple[DataFrame, DataFrame]:
    """The mix of the documents (doc_id, text, source): its documents and its content.

    First result, a row per document: row, doc_id, source, size (words), source_size, target (words, of its source).
    Second, a row per piece of the mix: shard, slot, row, first_word, words; in order of shard, slot and piece they are
    the packed output. Sources by code point, null last, weigh as ``weights``, repeating, and share the sum of all
    sizes; no target exceeds three times its source.

    Each source's documents, in a hashed order, are one stream of words, cut into blocks (the last may be shorter). The
    output is cut into shards of about ``slots`` slots. A shard draws how many slots each source fills: the whole part
    of its expectation, and the rest by a multinomial draw seeded by the shard, so that shards and totals stay close to
    the targets. The source's slots are numbered over all shards; number j is block P(j mod n) of its n blocks, with
    another pseudorandom permutation P in each round, and numbers from 3n on stay empty, so no word is taken more than
    three times. Slots meet blocks by (source, block). Reruns give the same mix.

    A null or empty text has size 0 and no pieces. Null and repeated ids are documents of their own; rows that are equal
    are interchangeable. Without words every target is 0 and the mix is empty. Other columns are not read. The driver
    holds one row per source and no documents; streams are numbered in two levels, so a hot source is many tasks.
    """
    spark = docs.sparkSession
    docs = _with_source(docs)
    sums = docs.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [r["n"] for r in sums]
    target = targets(size, [weights[i % len(weights)] for i in range(len(size))])
    blocks = [-(-n // block) for n in size]
    expected = np.array([t * b / n if n else 0.0 for t, b, n in zip(target, blocks, size)])
    table = spark.createDataFrame([(i, r["source"], n, t, b) for i, (r, n, t, b) in enumerate(zip(sums, size, target, blocks))], "sid int, source string, source_size long, target double, n_blocks long")
    held = docs.withColumnRenamed("source", "own").join(table, F.col("own").eqNullSafe(F.col("source"))).select("row", "doc_id", "source", "sid", "size", "source_size", "target", "n_blocks", "text_hash")
    members = held.filter("size > 0").select("row", "sid", "size", "n_blocks", F.coalesce("doc_id", F.lit(-1)).alias("id"), "text_hash")
    placed = running_totals(stage(members, "members"), "sid", ["id", "text_hash", "row"], "size", "start")
    first, last = f"start div {block}", f"(start + size - 1) div {block}"
    pieces = placed.select("sid", "row", "start", "size", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    pieces = pieces.select(
        "sid", "block", "row", F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("first_word"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)).alias("words"))

    total = float(expected.sum())
    shards = max(1, -(-int(np.ceil(total)) // slots))
    share = expected / shards
    whole = np.floor(share).astype(np.int64)
    rest = share - whole
    part = rest / rest.sum() if rest.sum() > 0 else rest

    def draw(batches):
        for batch in batches:
            out = []
            for shard in batch["id"]:
                count = whole.copy()
                k = int(np.floor((shard + 1) * rest.sum() + 1e-9)) - int(np.floor(shard * rest.sum() + 1e-9))
                if k and len(part):
                    count += np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(k, part)
                out += [(shard, i, c) for i, c in enumerate(count) if c]
            yield pd.DataFrame(out, columns=["shard", "sid", "n"])

    drawn = stage(spark.range(shards).mapInPandas(draw, "shard long, sid int, n long"), "drawn")
    numbered = running_totals(drawn, "sid", ["shard"], "n", "before").join(table.select("sid", "n_blocks"), "sid")
    each = numbered.select("shard", "sid", "n_blocks", F.explode(F.expr("sequence(before, before + n - 1)")).alias("j")).filter(F.col("j") < MOST_TIMES * F.col("n_blocks"))

    @F.pandas_udf("long")
    def image(j: pd.Series, n: pd.Series, sid: pd.Series) -> pd.Series:
        j, n, sid = (s.to_numpy().astype(np.uint64) for s in (j, n, sid))
        return pd.Series(permuted(j % n, n, mix(np.uint64(seed) + mix(sid * np.uint64(1 << 20) + j // n))))

    filled = each.select("shard", "sid", F.col("j").alias("slot"), image("j", "n_blocks", "sid").alias("block"))
    content = filled.join(pieces, ["sid", "block"]).select("shard", "sid", "slot", "row", "first_word", "words")
    return held.select("row", "doc_id", "source", "size", "source_size", "target"), content


def taken_words(docs: DataFrame, content: DataFrame) -> DataFrame:
    """The documents of a mix with ``taken``: how many words of each it takes, repeats counted."""
    sums = content.groupBy("row").agg(F.sum("words").alias("taken"))
    return docs.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
