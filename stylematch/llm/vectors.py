"""Near-duplicate embeddings: an exact cosine join by the pigeonhole principle over blocks of rotated coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylematch.llm.graph import components
from stylematch.llm.hashing import constants
from stylematch.session import stage

COSINE = 0.9
#: Blocks of coordinates, and leading coordinates of a block by which its tiles are cut.
BLOCKS, LEADS = 4, 3
#: Distinct vectors of a tile; two tiles are compared by strips of this many rows.
TILE, STRIP = 8192, 512
#: Rotated coordinates are whole multiples of 1 / SCALE, so that sums of squares are exact in any order.
SCALE = 1024
#: Tiles up to whose number their numbering is broadcast: 16 bytes each.
NUMBERED = 1 << 20
#: Copies above which a vector's rows are dealt out by salt, at least; and salts.
HOT, SALTS = 1000, 64


def _rotated(units: np.ndarray) -> np.ndarray:
    """Coordinates under a fixed rotation, rounded to multiples of 1 / SCALE.

    Random signs and a Hadamard transform, by additions in a fixed order: every machine gets the same numbers.
    """
    rows, dim = units.shape
    width = max(BLOCKS, 1 << (dim - 1).bit_length())
    out = np.zeros((rows, width))
    out[:, :dim] = units * np.where(constants(width, 909)[:dim] >> np.uint64(63), 1.0, -1.0)
    step = 1
    while step < width:
        pairs = out.reshape(rows, -1, 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return np.rint(out * (SCALE / math.sqrt(width))).astype(np.float32)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    squares = np.zeros((len(scaled), 1 << max(0, scaled.shape[1] - 1).bit_length()))
    squares[:, :scaled.shape[1]] = scaled * scaled
    while squares.shape[1] > 1:
        half = squares.shape[1] // 2
        squares = squares[:, :half] + squares[:, half:]
    return scaled / np.sqrt(squares)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _budget(width: int, cosine: float) -> int:
    """The squared distance that one of the blocks keeps to, in units of the grid and with its rounding."""
    return math.floor((SCALE * math.sqrt((2 - 2 * cosine) / BLOCKS) * (1 + 1e-9) + math.sqrt(width)) ** 2)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with the leading rotated coordinates of its blocks."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        leads = np.zeros((len(batch), BLOCKS, LEADS), np.int32)
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            turned = _rotated(_units(_matrix(batch.column("v").take(pa.array(own)), int(dim)))).reshape(len(own), BLOCKS, -1)
            some = min(LEADS, turned.shape[2])
            leads[own, :, :some] = turned[:, :, :some]
        listed = pa.ListArray.from_arrays(np.arange(0, leads.size + 1, BLOCKS * LEADS, dtype=np.int32), pa.array(leads.reshape(-1)))
        yield pa.record_batch([*batch.columns, listed], [*batch.schema.names, "leads"])


@dataclass
class _Rows:
    """Vectors of a tile or a strip: class, copies, vectors, lengths, rotated blocks and their squared lengths."""

    cls: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    blocks: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> _Rows:
        most = np.abs(vectors).max(axis=1, keepdims=True)
        odd = (most < 1e-100) | (most > 1e100)
        vectors = np.where(odd, vectors / most, vectors)
        blocks = np.ascontiguousarray(_rotated(_units(vectors)).reshape(len(ids), BLOCKS, -1).transpose(1, 0, 2))
        return cls(ids, copies, vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), blocks, (blocks * blocks).sum(axis=2))

    def part(self, start: int, stop: int) -> _Rows:
        cut = slice(start, stop)
        return _Rows(self.cls[cut], self.copies[cut], self.vectors[cut], self.lengths[cut], self.blocks[:, cut], self.squares[:, cut])


def _near_in(a: _Rows, b: _Rows, block: int, budget: int) -> np.ndarray:
    return a.squares[block][:, None] + b.squares[block] - 2 * (a.blocks[block] @ b.blocks[block].T) <= budget


def _links(a: _Rows, b: _Rows, block: int, cosine: float, budget: int, below: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the linked pairs whose first block within its budget is this one; ``below``: only those with j < i."""
    near = _near_in(a, b, block, budget)
    if below:
        near &= np.arange(len(b.cls)) < np.arange(len(a.cls))[:, None]
    if np.count_nonzero(near) > near.size // 50:
        for earlier in range(block):
            near &= ~_near_in(a, b, earlier, budget)
        near &= (a.vectors @ b.vectors.T) / (a.lengths[:, None] * b.lengths) >= cosine
        return np.nonzero(near)
    i, j = np.nonzero(near)
    for earlier in range(block):
        apart = a.blocks[earlier, i] - b.blocks[earlier, j]
        fresh = (apart * apart).sum(axis=1) > budget
        i, j = i[fresh], j[fresh]
    close = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]) / (a.lengths[i] * b.lengths[j]) >= cosine
    return i[close], j[close]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the nodes that the pairs (a, b) connect the least label among them."""
    while True:
        one, two = labels[a], labels[b]
        if np.array_equal(one, two):
            return
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(labels, labels[labels]):
            labels[:] = labels[labels]


def _copies(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(at, weights=weights, minlength=size).astype(np.int64)


def _found(cls: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(cls), pa.array(links), pa.array(other)], ["cls", "links", "other"])


def _compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per tile: its rows come first and are held, those of its partners stream by in strips.

    What goes out is a row per linked vector and strip, with its number of links there and one vector it is connected to.
    """
    key, tile, labels, counts, held = None, None, None, None, []

    def opened() -> None:
        nonlocal tile, labels, counts, held
        ids, copies, vectors = (np.concatenate([r[k] for r in held]) for k in range(3))
        tile, held = _Rows.of(ids, copies, vectors), []
        labels, counts = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        budget = _budget(tile.blocks.shape[2], cosine)
        for start in range(0, len(ids), STRIP):
            i, j = _links(tile.part(start, len(ids)), tile.part(start, start + STRIP), key[1], cosine, budget, below=True)
            i, j = i + start, j + start
            counts += _copies(i, copies[j], len(ids)) + _copies(j, copies[i], len(ids))
            _merge(labels, i, j)

    def closed() -> Iterator[pa.RecordBatch]:
        if tile is None:
            opened()
        some = np.flatnonzero(counts)
        if len(some):
            yield _found(tile.cls[some], counts[some], tile.cls[labels[some]])

    for batch in batches:
        tiles, blocks, dims, partner, ids, copies = (np.asarray(batch.column(n)) for n in ("tile", "block", "dim", "partner", "cls", "copies"))
        cuts = np.flatnonzero(np.diff(tiles) | np.diff(partner)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(ids)]):
            if start == stop:
                continue
            own = (int(tiles[start]), int(blocks[start]), int(dims[start]))
            if own != key:
                if key is not None:
                    yield from closed()
                key, tile, held = own, None, []
            rows = (ids[start:stop], copies[start:stop], _matrix(batch.column("v").slice(start, stop - start), own[2]))
            if not partner[start]:
                held.append(rows)
                continue
            if tile is None:
                opened()
            budget = _budget(tile.blocks.shape[2], cosine)
            for at in range(0, stop - start, STRIP):
                strip = _Rows.of(*(r[at:at + STRIP] for r in rows))
                i, j = _links(tile, strip, key[1], cosine, budget)
                if not len(i):
                    continue
                counts += _copies(i, strip.copies[j], len(counts))
                order = np.argsort(j, kind="stable")
                i, j = i[order], j[order]
                linked, first = np.unique(j, return_index=True)
                centre = i[first]
                _merge(labels, i, np.repeat(centre, np.diff([*first, len(j)])))
                yield _found(strip.cls[linked], _copies(j, tile.copies[i], len(strip.cls))[linked], tile.cls[centre])
    if key is not None:
        yield from closed()


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the cuts are not above the value."""
    listed = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("array()").cast("array<int>")
    return F.size(F.filter(listed, lambda c: c <= value))


def _tiles(prepared: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (cls, dim, block, tile) of every vector in every block, and the tiles that may hold a pair.

    The leading coordinates of a block are cut at their quantiles; a cell with more than TILE vectors is dealt out by
    hash. Two tiles are a pair if their boxes are within the block's budget.
    """
    count = prepared.count()
    sides = max(1, math.ceil((count / TILE) ** (1 / LEADS)))
    shares = [i / sides for i in range(1, sides)]
    cuts: list[list[int]] = [[] for _ in range(BLOCKS * LEADS)]
    if shares:
        cuts = [list(c) for c in prepared.agg(*[F.percentile_approx(F.col("leads")[k], shares).alias(f"c{k}") for k in range(BLOCKS * LEADS)]).first()]
    names = [f"x{g}" for g in range(LEADS)]
    each = [F.struct(F.lit(b).alias("block"), *[F.col("leads")[b * LEADS + g].alias(names[g]) for g in range(LEADS)],
                     *[_place(F.col("leads")[b * LEADS + g], cuts[b * LEADS + g]).alias(f"c{g}") for g in range(LEADS)]) for b in range(BLOCKS)]
    rows = prepared.select("cls", "dim", F.explode(F.array(*each)).alias("m")).select("cls", "dim", "m.*")
    cell = ["dim", "block", *[f"c{g}" for g in range(LEADS)]]
    parts = stage(rows.groupBy(*cell).agg(F.expr(f"CAST(ceil(count(*) / {TILE}) AS BIGINT)").alias("parts")), "cells")
    rows = rows.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("cls"), "parts"))
    box = [f(c).alias(f"{n}{g}") for g, c in enumerate(names) for f, n in ((F.min, "low"), (F.max, "high"))]
    tiles = stage(rows.groupBy(*cell, "part").agg(*box).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    members = rows.join(tiles.select(*cell, "part", "tile"), [*cell, "part"]).select("cls", "dim", "block", "tile")
    return members, _tile_pairs(tiles, cuts, cosine)


def _tile_pairs(tiles: DataFrame, cuts: list[list[int]], cosine: float) -> DataFrame:
    width = F.expr(f"shiftleft(1, length(bin(greatest(dim, {BLOCKS}) - 1))) div {BLOCKS}")
    budget = F.floor(F.pow(F.lit(SCALE * math.sqrt((2 - 2 * cosine) / BLOCKS) * (1 + 1e-9)) + F.sqrt(width), F.lit(2)))
    reached = tiles.withColumn("budget", budget).withColumn("reach", F.ceil(F.sqrt("budget")).cast("int"))
    for g in range(LEADS):
        first, last = F.lit(0), F.lit(0)
        for b in range(BLOCKS):
            own = cuts[b * LEADS + g]
            first = F.when(F.col("block") == b, _place(F.col(f"low{g}") - F.col("reach"), own)).otherwise(first)
            last = F.when(F.col("block") == b, _place(F.col(f"high{g}") + F.col("reach"), own)).otherwise(last)
        reached = reached.withColumn(f"n{g}", F.explode(F.sequence(first, last)))
    far = ["tile", *[f"{n}{g}" for g in range(LEADS) for n in ("low", "high")]]
    others = tiles.select("dim", "block", *[F.col(f"c{g}").alias(f"n{g}") for g in range(LEADS)], "part", *[F.col(c).alias(f"o_{c}") for c in far])
    met = reached.drop("part").join(others.drop("part"), ["dim", "block", *[f"n{g}" for g in range(LEADS)]]).filter("tile < o_tile")
    gap = sum((F.pow(F.greatest(F.lit(0), F.col(f"low{g}") - F.col(f"o_high{g}"), F.col(f"o_low{g}") - F.col(f"high{g}")), F.lit(2)) for g in range(LEADS)), F.lit(0.0))
    swapped = F.pmod(F.xxhash64("tile", "o_tile"), F.lit(2)) == 1
    near = met.filter(gap <= F.col("budget")).select("tile", "o_tile", swapped.alias("s"))
    return near.select(F.expr("IF(s, o_tile, tile)").alias("home"), F.expr("IF(s, tile, o_tile)").alias("tile"))


def link_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id_col, n_links, component_id) per row: how many other vectors have a cosine of ``cosine`` or more, and the
    smallest id that links reach.

    Method. Equal vectors are one class with a number of copies. Unit vectors are turned by a fixed rotation (random
    signs, Hadamard transform) and split into four blocks. A cosine of c means a squared distance of at most 2 - 2c, so
    in one block at least it is at most a fourth of that: each block is range-joined under this budget. The coordinates
    are rounded to whole steps and the budget raised by the rounding, so block distances are exact whole numbers. In
    every block the vectors are cut into tiles of some 8,192 by the quantiles of its leading coordinates, and tiles whose
    boxes are within the budget meet: one is held, the other streams by in strips. A candidate is verified by its cosine
    in double precision in the first block that proposes it, so it counts once. No pair leaves a task: only link counts
    and, per linked vector and strip, one connection that keeps what is connected so. Components come from these.
    All links are found; the work grows with the square of the distinct vectors in neighbouring tiles, which is
    most of them where the coordinates are spread evenly.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component; so do vectors of different lengths among each other. Every row is a vector of its own, also one that
    repeats an id. A row without an id links like others and lends no id; its component is the smallest id it reaches,
    or null. An empty table gives an empty result. Other columns are not read.
    """
    kind = embeddings.schema[vector_col].dataType
    wide = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{wide}>").alias("v"))
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(wide)).otherwise(x))
    rows = rows.withColumn("v", F.when(sound, plain)).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(11), "v")})
    classes = rows.filter("v IS NOT NULL").groupBy("v", "h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("rep"))
    classes = classes.withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("v")})
    schema = T.StructType([*classes.schema.fields, T.StructField("leads", T.ArrayType(T.IntegerType()))])
    prepared = stage(classes.mapInArrow(_prepared, schema), "vectors")

    members, pairs = _tiles(prepared, cosine)
    members = stage(members, "members")
    pairs = stage(pairs, "tile-pairs")
    sent = members.select(F.col("tile").alias("home"), "cls", "dim", "block", F.lit(0).alias("partner"))
    sent = sent.unionByName(pairs.join(members, "tile").select("home", "cls", "dim", "block", F.lit(1).alias("partner")))
    sent = sent.join(prepared.select("cls", "copies", "v"), "cls").select(F.col("home").alias("tile"), "block", "dim", "partner", "cls", "copies", "v")
    numbered = stage(members.select("tile").distinct().withColumn("no", F.row_number().over(Window.orderBy("tile")) - 1), "tile-numbers")
    sent = sent.join(F.broadcast(numbered) if numbered.count() <= NUMBERED else numbered, "tile")
    dealt = sent.repartitionById(max(1, numbered.count()), "no").sortWithinPartitions("tile", "partner", "cls").drop("no")
    found = stage(dealt.mapInArrow(lambda batches: _compared(batches, cosine), "cls long, links long, other long"), "links")

    node = prepared.select("cls", F.struct(F.col("rep").isNull().alias("no_id"), F.col("rep").alias("rep"), "cls").alias("node"))
    edges = found.filter("cls <> other").select("cls", "other").distinct().join(node.withColumnRenamed("node", "a"), "cls")
    edges = edges.join(node.select(F.col("cls").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    roots = components(edges).select(F.col("node.cls").alias("cls"), F.col("root.rep").alias("component"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    done = prepared.select("cls", "h1", "h2", "copies", "rep").join(links, "cls", "left").join(roots, "cls", "left")
    done = done.select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return _named(rows, stage(done, "classes"), id_col)


def _named(rows: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """Every row with what its class has. The rows of the at most 1,000 largest classes are dealt out by salt."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    large = classes.filter(F.col("copies") > max(HOT, total // 1000)).select("h1", "h2", F.lit(SALTS).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    sound = rows.filter("v IS NOT NULL").select("id", "h1", "h2").join(F.broadcast(large), ["h1", "h2"], "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts))
    salted = classes.join(F.broadcast(large), ["h1", "h2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))))
    linked = sound.join(salted.select("h1", "h2", "salt", "n_links", "component"), ["h1", "h2", "salt"])
    lone = rows.filter("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.select("id", "n_links", "component").unionByName(lone).select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"))
