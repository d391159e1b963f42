"""Near-duplicate groups by an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.llm.graph import components
from stylematch.llm.hashing import constants, mix, shingle_hashes, text_chunks, word_hashes, words
from stylematch.llm.rarity import by_rarity, rarity_table, sieved
from stylematch.session import stage

COORDINATES = 32
MATCHES = 12
CELLS = 1 << 18
_FACTORS, _SALTS = constants(COORDINATES, 101), constants(COORDINATES, 202)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_chunks(column):
        starts, ends, bounds = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(shingle_hashes(hashes[a:b]))


def _signature(shingles: np.ndarray) -> np.ndarray:
    """One value per coordinate, scrambled with the coordinate's number: equal values of two coordinates differ."""
    least = np.empty(COORDINATES, np.uint64)
    for i in range(COORDINATES):
        least[i] = ((shingles ^ _SALTS[i]) * _FACTORS[i]).min()
    return mix(least + _SALTS)


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two sums of each set: equal for equal sets only (128 bits)."""
    one = [s.sum(dtype=np.uint64).view(np.int64) for s in sets]
    two = [mix(s ^ np.uint64(77)).sum(dtype=np.uint64).view(np.int64) for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]


def _described(batches: Iterator[pa.RecordBatch], last: str, what) -> Iterator[pa.RecordBatch]:
    """Id, key of the set, and ``what`` of the set, a few hundred rows at a time."""
    for batch in batches:
        for start in range(0, len(batch), 500):
            sets = list(_sets(batch.column(1).slice(start, 500)))
            arrays = pa.array([what(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0).slice(start, 500), *_keys(sets), arrays], ["doc_id", "n_shingles", "h1", "h2", last])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _described(batches, "signature", _signature)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _described(batches, "shingles", lambda s: s)


def _with_class(docs: DataFrame, read, last: str) -> DataFrame:
    rows = docs.mapInArrow(read, f"doc_id long, n_shingles long, h1 long, h2 long, {last} array<long>")
    return rows.select("doc_id", "n_shingles", F.xxhash64("n_shingles", "h1", "h2").alias("cls"), last)


def _sets_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cls, shingles) of the chosen classes (cls, rep), read from the rows with the id rep."""
    held = docs.filter(sieved(chosen.select(F.col("rep").alias("doc_id")), "doc_id"))
    held = held.join(chosen.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    return _with_class(held, _full_sets, "shingles").join(chosen.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _linked(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough equal coordinates whose full sets have 100 * common >= 75 * union."""
    one = signatures.select(F.col("cls").alias("a"), F.col("signature").alias("sig_a"))
    two = signatures.select(F.col("cls").alias("b"), F.col("signature").alias("sig_b"))
    close = pairs.join(one, "a").join(two, "b").filter(F.size(F.array_intersect("sig_a", "sig_b")) >= MATCHES).select("a", "b")
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
    both = close.join(one, "a").join(two, "b").select("a", "b", F.size("set_a").alias("n"), F.size("set_b").alias("m"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return both.filter("100L * common >= 75L * (n + m - common)").select("a", "b")


def _cross_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets (cls, root, shingles) that are in different groups and may have a similarity of 0.75.

    A set of n shingles is posted under its n - ceil(3n/4) + 1 rarest, the smaller one of a pair under its first
    n - ceil(6n/7) + 1, and from their first common shingle on both must have as many left as the overlap asked for.
    Whoever only shares what a large group has in common is thus not proposed. A posting meets only with its rows outside its largest group.
    """
    ranks = rarity_table(sets.select(F.explode("shingles").alias("token")), CELLS)
    ranked = sets.withColumn("ranks", ranks).select("cls", "root", F.size("shingles").alias("n"), by_rarity(F.col("shingles"), F.col("ranks"), CELLS).alias("ranked"))
    prefix = F.slice("ranked", F.lit(1), F.expr("n - CAST(ceil(n * 3 / 4) AS INT) + 1"))
    posted = stage(ranked.select("cls", "root", "n", F.posexplode(prefix).alias("i", "token")), "posted")
    parts = posted.groupBy("token", "root").agg(F.count("*").alias("k"))
    largest = parts.groupBy("token").agg(F.max(F.struct("k", "root")).alias("top"), F.count("*").alias("groups")).filter("groups > 1")
    mixed = stage(posted.join(largest.select("token", F.col("top.root").alias("most")), "token"), "mixed")
    long = mixed.select("token", "cls", "root", "n", "i", "most")
    short = mixed.filter("i < n - CAST(ceil(n * 6 / 7) AS INT) + 1").select("token", F.col("cls").alias("c"), F.col("root").alias("r"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("most").alias("most_m"))
    fits = "root <> r AND (m < n OR m = n AND c < cls) AND 4 * m >= 3 * n AND least(n - i, m - j) >= ceil((n + m) * 3 / 7)"
    met = long.filter("root <> most").join(short, "token").filter(fits).select("c", "cls")
    met = met.unionByName(long.filter("root = most").join(short.filter("r <> most_m"), "token").filter(fits).select("c", "cls"))
    return met.select(F.least("c", "cls").alias("a"), F.greatest("c", "cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: groups of documents joined by near-duplicate links.

    A document's set holds its distinct runs of five words (fewer words: the whole sequence); A-Z count as a-z. Two
    documents are linked if 100 * common >= 75 * union of their sets; a group is what links connect, and
    ``component_id`` is its least id.

    Method. Documents with equal sets are one class. A class has a signature of 32 coordinates, the minima of 32 hash
    functions, and is posted under each (coordinate, value). Two sets with Jaccard 0.75 agree in 24 coordinates on
    average and in fewer than 12 with a probability below 1e-5, so 12 matches are asked for: a class with fewer than 12
    shared postings is done, and of k postings only the k - 11 rarest (the prefix) propose partners; the long rest is
    skipped and looked up in the partner's signature. Proposed pairs are counted on whole signatures and confirmed on
    whole sets.

    Pairs are never listed within a large group. First each posting proposes only (class, the class of the posting
    that shares most); the confirmed links merge most of every group. Then the classes of postings that still hold more
    than one group are joined across groups, by the prefixes of their whole sets (``_cross_pairs``), and counted and
    confirmed like the others; links inside a group are not needed.

    Null or empty texts have an empty set and link with nothing. Every row is a document of its own: rows that repeat
    an id are linked by their texts alone. Rows with a null id link others but get and lend no id. An empty table gives
    an empty result. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profiles = stage(_with_class(docs, _profiles, "signature"), "profiles")
    whole = profiles.filter("n_shingles > 0")
    classes = stage(whole.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    postings = classes.select("cls", F.explode("signature").alias("token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = postings.join(lists, "token").groupBy("cls").agg(F.sum("df").alias("shares"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by_rarity"))
    shared = shared.filter(F.size("by_rarity") >= MATCHES)
    prefixes = stage(shared.select("cls", "shares", F.slice("by_rarity", F.lit(1), F.size("by_rarity") - (MATCHES - 1)).alias("prefix")), "prefixes")

    signatures = stage(classes.join(prefixes.select("cls"), "cls", "left_semi").select("cls", "signature"), "signatures")
    sets = stage(_sets_of(docs, classes.join(signatures.select("cls"), "cls", "left_semi").select("cls", "rep")), "sets")

    posted = prefixes.select("cls", "shares", F.explode("prefix").alias("p")).select("cls", "shares", "p.token")
    centres = posted.groupBy("token").agg(F.max(F.struct("shares", "cls")).alias("c")).select("token", F.col("c.cls").alias("centre"))
    stars = posted.join(centres, "token").filter("cls <> centre").select(F.least("centre", "cls").alias("a"), F.greatest("centre", "cls").alias("b")).distinct()
    links = stage(_linked(stage(stars, "stars"), signatures, sets), "links")
    groups = components(links)

    labelled = stage(posted.select("cls", "token").join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "token", F.coalesce("root", "cls").alias("root")), "labelled")
    split = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
    open_ = stage(labelled.join(split, "token", "left_semi").select("cls", "root").distinct(), "open")
    pairs = _cross_pairs(open_.join(sets, "cls"))
    links = links.unionByName(stage(_linked(stage(pairs, "pairs"), signatures, sets), "links"))

    groups = classes.select("cls", "rep").join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = stage(groups.groupBy("root").agg(F.min("rep").alias("least")).join(groups.select("cls", "root"), "root").select("cls", "least"), "groups")
    return profiles.join(named, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))).alias("component_id"))
