"""K-Prototypes on a numeric vector, dense or sparse, plus one category, for one k or a sweep of k.

Centroids (k x dimension, per start) are the only state kept between rounds; each round is one pass over the rows that returns
sums per cluster. A sweep runs all its k in the same pass. The plan of a round never contains the rounds before. Dense
rows are packed to matrices once, and a round over them is one job of a single stage.
"""

from __future__ import annotations

import functools
import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.operators.joins import salted_join
from stylematch.operators.ordered import rank_in_group
from stylematch.operators.ranking import top_k
from stylematch.session import shuffle_width, stage

# the functions below run in Python workers that do not have this package installed
register_pickle_by_value(sys.modules[__name__])

@dataclass
class Prototypes:
    """Centres of one clustering."""

    k: int
    centres: np.ndarray
    categories: list[str]
    gamma: float
    cost: float = float("inf")
    costs: list[float] = field(default_factory=list)
    sizes: np.ndarray | None = None
    squares: np.ndarray | None = None
    room: float = 0.0
    wait: int = 0

    def distances(self, rows: Vectors) -> np.ndarray:
        """Rows x k: squared distance plus gamma for another category."""
        squared = rows.squares[:, None] - 2 * rows.dot(self.centres) + (self.centres**2).sum(axis=1)[None, :]
        other = rows.codes[:, None] != rows.names.get_indexer(self.categories)[None, :]
        return np.maximum(squared, 0) + self.gamma * other


@dataclass
class Vectors:
    """Rows of a batch: a dense matrix, or in sparse form, where row i has ``values`` at ``places`` from bounds[i] to
    bounds[i + 1]; row i has the category names[codes[i]]."""

    codes: np.ndarray
    names: pd.Index
    dense: np.ndarray | None = None
    bounds: np.ndarray | None = None
    places: np.ndarray | None = None
    values: np.ndarray | None = None

    @classmethod
    def of(cls, frame: pd.DataFrame) -> Vectors:
        codes, names = pd.factorize(frame["category"].to_numpy(dtype=object))
        own = codes, pd.Index(names, dtype=object)
        if "vector" in frame:
            return cls(*own, np.stack(frame["vector"].to_numpy()).astype(float))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in frame["indices"]])])
        joined = [np.concatenate([np.asarray(x, dtype=kind) for x in frame[c]]) if bounds[-1] else np.zeros(0, kind) for c, kind in (("indices", np.int64), ("values", float))]
        return cls(*own, None, bounds, *joined)

    @cached_property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.codes)), np.diff(self.bounds))

    @cached_property
    def squares(self) -> np.ndarray:
        if self.dense is not None:
            return (self.dense**2).sum(axis=1)
        return np.bincount(self.rows, weights=self.values**2, minlength=len(self.codes))

    def dot(self, centres: np.ndarray) -> np.ndarray:
        """Rows x centres; the work grows with the entries, not with the width."""
        if self.dense is not None:
            return self.dense @ centres.T
        return np.stack([np.bincount(self.rows, weights=self.values * c[self.places], minlength=len(self.codes)) for c in centres], axis=1)

    def add_sums(self, label: np.ndarray, totals: np.ndarray) -> None:
        """Add the entries of every row to the row of ``totals`` that its label names."""
        if self.dense is not None:
            order = np.argsort(label, kind="stable")
            own, first = np.unique(label[order], return_index=True)
            totals[own] += np.add.reduceat(self.dense[order], first, axis=0)
        else:
            found, inverse = np.unique(label[self.rows] * totals.shape[1] + self.places, return_inverse=True)
            totals.reshape(-1)[found] += np.bincount(inverse, weights=self.values, minlength=len(found))


def vector_rows(df: DataFrame, row_id: str, vector: str, category: str) -> DataFrame:
    """(row_id, vector array<double>, category string) as the functions below expect."""
    return df.select(
        F.col(row_id).alias("row_id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(F.col(category).cast("string"), F.lit("None")).alias("category"),
    )


def sparse_rows(weights: DataFrame, docs: DataFrame, doc_id: str, category: str) -> tuple[DataFrame, DataFrame]:
    """((row_id, indices, values, category), (term, place)): TF-IDF rows as sparse vectors, however many terms there are.

    A document without terms has no entries, which is the zero vector.
    """
    terms = weights.select("term", F.lit(0).alias("all")).distinct()
    index = stage(rank_in_group(terms, "all", "term", "place").select("term", "place"), "terms")
    cells = salted_join(weights, index, "term", doc_id).groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("cells"))
    named = docs.select(doc_id, F.coalesce(F.col(category).cast("string"), F.lit("None")).alias("category"))
    out = named.join(cells, doc_id, "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<place:int,weight:double>>")))
    return out.select(F.col(doc_id).alias("row_id"), F.col("cells.place").alias("indices"), F.col("cells.weight").alias("values"), "category"), index


def _parts(rows: DataFrame) -> list[str]:
    return ["vector"] if "vector" in rows.columns else ["indices", "values"]


def _entries(rows: DataFrame) -> DataFrame:
    """(place, x) of all entries that are not zero."""
    if "vector" in rows.columns:
        long = rows.select(F.posexplode("vector").alias("place", "x"))
    else:
        long = rows.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).select(F.col("e.indices").alias("place"), F.col("e.values").alias("x"))
    return long.filter("x <> 0")


def spreads(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, standard deviation) of every numeric attribute, entries that are not there counting as zero."""
    n = rows.count()
    width = _width(rows)
    found = _entries(rows).groupBy("place").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).toArrow()
    place, held, mean, var = (np.asarray(found.column(c)) for c in ("place", "n", "m", "v"))
    share = held / max(n, 1)
    means, deviations = np.zeros(width), np.zeros(width)
    means[place] = share * mean
    deviations[place] = np.sqrt(share * var + share * (1 - share) * mean**2)
    return means, deviations


def _width(rows: DataFrame) -> int:
    size = F.size("vector") if "vector" in rows.columns else F.coalesce(F.array_max("indices"), F.lit(-1)) + 1
    return int(rows.agg(F.max(size)).first()[0] or 0)


def mismatch_weight(rows: DataFrame) -> float:
    """Half the mean standard deviation of the numeric attributes."""
    deviations = spreads(rows)[1]
    return 0.5 * float(deviations.mean()) if len(deviations) else 0.0


def _start(rows: DataFrame, ks: Sequence[int], gamma: float, seed: int, starts: int, spread: tuple[np.ndarray, np.ndarray]) -> dict[tuple[int, int], Prototypes]:
    """Huang's start, several times for each k: draws by the frequency of the values, moved to the nearest distinct rows.

    A draw's numbers are normal with the mean and deviation of their attribute, its category comes by its share of the
    rows. All draws look for their rows in one pass, which returns the k nearest distinct rows of each; the draws of a
    start then take the nearest row that is still free, in turn. Equal distances go to the smaller row id.
    """
    need = max(ks)
    shares = rows.groupBy("category").count().orderBy("category").toArrow()
    names, counts = shares.column("category").to_pylist(), np.asarray(shares.column("count"), dtype=float)
    rng = np.random.default_rng(seed)
    draws = [Prototypes(need, spread[0] + rng.standard_normal((need, len(spread[0]))) * spread[1], [names[i] for i in rng.choice(len(names), need, p=counts / counts.sum())], gamma) for _ in range(starts)] if names else []
    parts = _parts(rows)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            keys = [tuple(np.asarray(x).tobytes() for x in r[:-1]) + r[-1:] for r in frame[[*parts, "category"]].itertuples(index=False, name=None)]
            first = frame.assign(key=keys).sort_values("row_id").drop_duplicates("key").drop(columns="key").reset_index(drop=True)
            for start, draw in enumerate(draws):
                distance = draw.distances(Vectors.of(first))
                for j in range(need):
                    at = np.argsort(distance[:, j], kind="stable")[:need]
                    yield first.iloc[at].assign(start=start, draw=j, distance=distance[at, j])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    seen = rows.mapInPandas(nearest, f"{kinds}, start int, draw int, distance double")
    seen = seen.groupBy("start", "draw", *parts, "category").agg(F.min("row_id").alias("row_id"), F.min("distance").alias("distance"))
    near = top_k(seen, ["start", "draw"], [F.col("distance"), F.col("row_id")], need).orderBy("start", "draw", "distance", "row_id").toPandas()
    out = {}
    for start in range(starts):
        taken: dict[tuple, Vectors] = {}
        for _, own in near[near["start"] == start].groupby("draw", sort=True):
            for r in own.itertuples(index=False):
                key = (*(tuple(getattr(r, p)) for p in parts), r.category)
                if key not in taken:
                    taken[key] = Vectors.of(pd.DataFrame({**{p: [getattr(r, p)] for p in parts}, "category": [r.category]}))
                    break
        if len(taken) < need:
            raise ValueError(f"only {len(taken)} distinct rows for {need} clusters")
        centres = np.zeros((need, len(spread[0])))
        for j, v in enumerate(taken.values()):
            centres[j] = v.dense[0] if v.dense is not None else np.bincount(v.places, weights=v.values, minlength=centres.shape[1])
        for k in ks:
            out[k, start] = Prototypes(k, centres[:k].copy(), [key[-1] for key in taken][:k], gamma)
    return out


#: What a sum is of, where it is not of an attribute.
_SIZE, _COST, _SQUARES, _CATEGORY, _ROOM = -1, -2, -3, -4, -5


#: Distances that are worked on at a time (4 MB), categories of a block up to which they are counted as attributes, and
#: tasks up to which the driver adds their sums.
_CELLS, _COUNTED, _ADDED = 1 << 19, 64, 64
#: Rows of one model that a task takes for its local rounds, in bytes; steps that must fit into the room to make them worth it.
_LOCAL_BYTES, _STEPS = 1 << 26, 3
#: Passes after which the room is looked for again at the latest.
_WAIT = 8
#: Rows are counted by the first bits of their room: from 2^-40 on, 256 bins, four from a power of two to the next.
_MANTISSA, _BINS = 50, 256
_LOWEST = int(np.array([2.0**-40]).view(np.int64)[0] >> _MANTISSA)


#: Rows of a batch for the rounds: category codes, their names, how many attributes there are, and a matrix of these, a
#: column of ones, the squared lengths, and where there are few categories a column for each.
_Block = tuple[np.ndarray, list, int, np.ndarray]


def _packed(rows: DataFrame) -> RDD:
    """Dense rows as blocks of a few thousand each, kept for the rounds."""

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = Vectors.of(frame)
                columns = [x.dense, np.ones((len(x.codes), 1)), x.squares[:, None]]
                if len(x.names) <= _COUNTED:
                    columns.append(x.codes[:, None] == np.arange(len(x.names))[None, :])
                yield pd.DataFrame({"block": [pickle.dumps((x.codes, list(x.names), x.dense.shape[1], np.concatenate(columns, axis=1)))]})

    found = rows.select(*_parts(rows), "category").mapInPandas(blocks, "block binary")
    return found.rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)


def _block_sums(block: _Block, models: Sequence[Prototypes], rooms: np.ndarray | None = None) -> tuple[tuple, np.ndarray | None]:
    """((per cluster of all models the sums of the attributes, the size and the sum of squares; the cost of each model; per
    category its count in each cluster; per model the rows by their room), rows left out) of a block.

    A row's room is how far all centres of a model may move before it can have another label, as long as their categories
    stay. The sums are without the rows that have less room than the model's entry in ``rooms``, which are left out for it.
    """
    codes, names, width, wide = block
    dense, squares, few = wide[:, :width], wide[:, width + 1], wide.shape[1] > width + 2
    centres = np.concatenate([m.centres for m in models])
    lengths = np.concatenate([(m.centres**2).sum(axis=1) for m in models])
    places = pd.Index(names, dtype=object).get_indexer([c for m in models for c in m.categories])
    gammas = np.repeat([m.gamma for m in models], [m.k for m in models])
    ks = np.array([m.k for m in models])
    heads = np.cumsum(ks) - ks
    mismatch = gammas[:, None] * (places[:, None] != np.arange(len(names))[None, :]) if few else None
    sums, costs, bins = np.zeros((len(centres), wide.shape[1])), np.zeros(len(models)), np.zeros(len(models) * _BINS, np.int64)
    counts = None if few else np.zeros((len(centres), len(names)))
    out = None if rooms is None else np.zeros((len(models), len(codes)), dtype=bool)
    step = max(1, _CELLS // len(centres))
    for first in range(0, len(codes), step):
        own = slice(first, first + step)
        # clusters x rows, in the order of the terms of Prototypes.distances
        distance = centres @ dense[own].T
        distance *= -2
        distance += squares[own]
        distance += lengths[:, None]
        np.maximum(distance, 0, out=distance)
        apart = None if rooms is None else np.sqrt(distance)
        distance += mismatch[:, codes[own]] if few else gammas[:, None] * (codes[own][None, :] != places[:, None])
        best = np.minimum.reduceat(distance, heads, axis=0)
        nearest = distance == np.repeat(best, ks, axis=0)
        if np.count_nonzero(nearest) != best.size:
            # equal distances go to the first cluster
            nearest[:] = False
            for head, k in zip(heads, ks):
                nearest[head + distance[head:head + k].argmin(axis=0), np.arange(nearest.shape[1])] = True
        costs += best.sum(axis=1)
        if rooms is not None:
            near = np.add.reduceat(apart * nearest, heads, axis=0)
            slack = (distance - np.repeat(best, ks, axis=0)) / (2 * (apart + np.repeat(near, ks, axis=0)) + 1e-300)
            np.minimum(slack, apart, out=slack)
            slack[nearest] = np.inf
            # less than that by what rounding may add to it
            lost = 1e-5 * (np.sqrt(squares[own]) + np.sqrt(lengths.max()))
            room = np.maximum(0.999 * np.minimum.reduceat(slack, heads, axis=0) - lost, 0)
            at = np.clip((room.view(np.int64) >> _MANTISSA) - _LOWEST, 0, _BINS - 1)
            bins += np.bincount((at + _BINS * np.arange(len(models))[:, None]).reshape(-1), minlength=len(bins))
            out[:, own] = room < rooms[:, None]
            nearest &= ~np.repeat(out[:, own], ks, axis=0)
        sums += nearest.astype(float) @ wide[own]
        if not few:
            cluster, row = np.nonzero(nearest)
            np.add.at(counts, (cluster, codes[own][row]), 1)
    if few:
        sums, counts = sums[:, :width + 2], sums[:, width + 2:]
    return (sums, costs, dict(zip(names, counts.T)), bins), out


def _added(one: tuple, two: tuple) -> tuple:
    counts = dict(one[2])
    for name, count in two[2].items():
        counts[name] = counts[name] + count if name in counts else count
    return one[0] + two[0], one[1] + two[1], counts, one[3] + two[3]


def _lean(models: Sequence[Prototypes]) -> list[Prototypes]:
    return [Prototypes(m.k, m.centres, m.categories, m.gamma) for m in models]


def _packed_sums(blocks: RDD, models: Sequence[Prototypes]) -> pd.DataFrame:
    """The rows of ``_sums``, from packed rows; the cost of a model stands at its first cluster, and beside it the room
    that all but some of the rows have, or 0 in the passes that all models wait."""
    lean, looked = _lean(models), not all(m.wait for m in models)

    def partial(own: Iterator[_Block]) -> Iterator[tuple]:
        total = None
        for block in own:
            found = _block_sums(block, lean, np.zeros(len(lean)) if looked else None)[0]
            total = found if total is None else _added(total, found)
        if total is not None:
            yield total

    parts = blocks.mapPartitions(partial)
    sums, costs, counts, bins = parts.treeReduce(_added) if parts.getNumPartitions() > _ADDED else functools.reduce(_added, parts.collect())
    ks = np.array([m.k for m in models])
    model, cluster = np.repeat(np.arange(len(ks)), ks), np.concatenate([np.arange(k) for k in ks])
    width = sums.shape[1] - 2
    # sizes are whole numbers; the attributes that are not zero, sizes and squares of the clusters with rows
    held = sums[:, width] > 0
    row, place = np.nonzero(sums[:, :width] * held[:, None])
    names = np.array(sorted(counts), dtype=object)
    table = np.stack([counts[n] for n in names], axis=1)
    most = np.flatnonzero(held)
    rooms = _room_of(bins.reshape(len(ks), _BINS), _LOCAL_BYTES // (8 * (width + 2))) if looked else np.zeros(len(ks))
    frames = [(row, place, sums[row, place]), (most, np.full(len(most), _SIZE), sums[most, width]), (most, np.full(len(most), _SQUARES), sums[most, width + 1])]
    heads = np.cumsum(ks) - ks
    frames += [(heads, np.full(len(heads), _COST), costs), (heads, np.full(len(heads), _ROOM), rooms), (most, np.full(len(most), _CATEGORY), table[most].max(axis=1))]
    row, place, value = (np.concatenate(c) for c in zip(*frames))
    category = np.full(len(row), None, dtype=object)
    # of equal counts the first name
    category[len(row) - len(most):] = names[table[most].argmax(axis=1)]
    return pd.DataFrame({"model": model[row], "cluster": cluster[row], "place": place, "category": category, "value": value})


def _room_of(bins: np.ndarray, most: int) -> np.ndarray:
    """Per model the largest bound of a bin that at most so many rows have less room than."""
    held = bins.cumsum(axis=1)
    below = (held <= most).sum(axis=1)
    bounds = ((_LOWEST + below.astype(np.int64)) << _MANTISSA).view(np.float64)
    return np.where(below == _BINS, np.inf, np.where(below == 0, 0.0, bounds))


def _moved(model: Prototypes, sums: np.ndarray, cost: float, counts: dict[str, np.ndarray]) -> Prototypes:
    """The model after a pass, from the totals of its clusters."""
    sizes = sums[:, -2]
    held = np.flatnonzero(sizes > 0)
    centres, categories = model.centres.copy(), list(model.categories)
    centres[held] = sums[held, :-2] / sizes[held, None]
    names = sorted(counts)
    table = np.stack([counts[n] for n in names], axis=1)
    for j in held:
        categories[j] = names[table[j].argmax()]
    return Prototypes(model.k, centres, categories, model.gamma, cost, [*model.costs, cost], sizes, sums[:, -1])


def _drift(before: Prototypes, after: Prototypes) -> float:
    return float(np.sqrt(((after.centres - before.centres) ** 2).sum(axis=1)).max())


def _ended(before: Prototypes, after: Prototypes) -> bool:
    return np.allclose(after.centres, before.centres) and after.categories == before.categories or after.cost >= before.cost


def _local_rounds(blocks: RDD, bases: Sequence[Prototypes], models: Sequence[Prototypes], left: Sequence[int | None]) -> list[tuple[Prototypes, bool]]:
    """(model, whether it has ended) after the rounds in which only the rows with little room can change their label.

    ``models`` are one pass after ``bases``. Every other row keeps its label while no centre is farther from its base than
    the room, and the categories stay; so a round needs the sums of these rows, made in one pass, and the few rows
    themselves, which are dealt to a task for each model. The rounds are the same as over all rows.
    """
    lean, rooms = _lean(bases), np.array([m.room for m in models])

    def split(own: Iterator[_Block]) -> Iterator[tuple[int, tuple]]:
        total = None
        heads = np.cumsum([0, *(m.k for m in lean)])
        for block in own:
            found, out = _block_sums(block, lean, rooms)
            total = found if total is None else _added(total, found)
            codes, names, width, wide = block
            for i, rows in enumerate(out):
                if rows.any():
                    yield i, (codes[rows], names, wide[rows, :width + 2])
        if total is not None:
            for i, (head, end) in enumerate(zip(heads, heads[1:])):
                yield i, (total[0][head:end], {n: c[head:end] for n, c in total[2].items()})

    def run(number: int, parts: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, Prototypes, bool]]:
        base, model, room, most = lean[number], models[number], rooms[number], left[number]
        kept, counts, held = 0.0, {}, []
        for _, part in parts:
            if len(part) == 3:
                held.append(part)
                continue
            kept = kept + part[0]
            for name, count in part[1].items():
                counts[name] = counts[name] + count if name in counts else count
        names = sorted(counts)
        block = None
        if held:
            codes = np.concatenate([pd.Index(names, dtype=object).get_indexer(own)[c] for c, own, _ in held])
            wide = np.concatenate([w for _, _, w in held])
            if len(names) <= _COUNTED:
                wide = np.concatenate([wide, codes[:, None] == np.arange(len(names))[None, :]], axis=1)
            block = codes, names, base.centres.shape[1], wide
            held.clear()
        ended, done = False, 0
        while not ended and done != most and (room == np.inf or _drift(base, model) < room and model.categories == base.categories):
            sizes = kept[:, -2]
            same = np.array([counts[c][j] if c in counts else 0.0 for j, c in enumerate(model.categories)])
            cost = float((kept[:, -1] - 2 * (kept[:, :-2] * model.centres).sum(axis=1) + sizes * (model.centres**2).sum(axis=1) + model.gamma * (sizes - same)).sum())
            sums, own = kept, counts
            if block is not None:
                found = _block_sums(block, [model])[0]
                sums, cost, own = kept + found[0], cost + float(found[1][0]), {n: c + found[2][n] for n, c in counts.items()}
            after = _moved(model, sums, cost, own)
            ended, model, done = _ended(model, after), after, done + 1
        yield number, model, ended

    found = blocks.mapPartitions(split).partitionBy(len(lean), int).mapPartitionsWithIndex(run).collect()
    return [(model, ended) for _, model, ended in sorted(found, key=lambda f: f[0])]


def _sums(rows: DataFrame | RDD, models: Sequence[Prototypes]) -> pd.DataFrame:
    """(model, cluster, place, category, value): per cluster size, cost, sum of squares, the sums of the attributes that
    are not zero, and the most frequent category."""
    if isinstance(rows, RDD):
        return _packed_sums(rows, models)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(m.centres.shape) for m in models]
        totals = [{what: np.zeros(m.k) for what in (_SIZE, _COST, _SQUARES)} for m in models]
        for frame in frames:
            if frame.empty:
                continue
            x = Vectors.of(frame)
            counted = []
            for number, model in enumerate(models):
                distance = model.distances(x)
                label = distance.argmin(axis=1)
                x.add_sums(label, sums[number])
                best = distance[np.arange(len(label)), label]
                for what, amount in ((_SIZE, None), (_COST, best), (_SQUARES, x.squares)):
                    totals[number][what] += np.bincount(label, weights=amount, minlength=model.k)
                key, count = np.unique(label * len(x.names) + x.codes, return_counts=True)
                counted.append((np.full(len(key), number), key // len(x.names), key % len(x.names), count))
            number, cluster, code, count = (np.concatenate(c) for c in zip(*counted))
            yield pd.DataFrame({"cluster": cluster, "place": _CATEGORY, "category": x.names.to_numpy()[code], "value": count.astype(float), "model": number})
        for number, model in enumerate(models):
            cluster, place = np.nonzero(sums[number])
            parts = [(cluster, place, sums[number][cluster, place])]
            held = np.flatnonzero(totals[number][_SIZE])
            parts += [(held, np.full(len(held), what), total[held]) for what, total in totals[number].items()]
            cluster, place, value = (np.concatenate(c) for c in zip(*parts))
            yield pd.DataFrame({"cluster": cluster, "place": place, "category": None, "value": value, "model": number})

    parts = rows.select(*_parts(rows), "category").mapInPandas(partial, "cluster int, place int, category string, value double, model int")
    # by key, so that no task holds all parts of a cluster
    totals = parts.groupBy("model", "cluster", "place", "category").agg(F.sum("value").alias("value"))
    best = totals.groupBy("model", "cluster", "place").agg(F.min_by("category", F.struct((-F.col("value")).alias("a"), F.col("category").alias("b"))).alias("category"), F.max("value").alias("value"))
    return best.toArrow().to_pandas()


def _updated(model: Prototypes, sums: pd.DataFrame) -> Prototypes:
    """The model after a pass, from the sums of its own clusters."""
    centres, categories = model.centres.copy(), list(model.categories)

    def total(what: int) -> np.ndarray:
        own = sums[sums["place"] == what]
        return np.bincount(own["cluster"], weights=own["value"], minlength=model.k)

    sizes, squares = total(_SIZE), total(_SQUARES)
    centres[sizes > 0] = 0
    cells = sums[sums["place"] >= 0]
    centres[cells["cluster"], cells["place"]] = cells["value"] / sizes[cells["cluster"]]
    for r in sums[sums["place"] == _CATEGORY].itertuples():
        categories[r.cluster] = r.category
    cost = float(total(_COST).sum())
    return Prototypes(model.k, centres, categories, model.gamma, cost, [*model.costs, cost], sizes, squares, float(total(_ROOM).sum()))


def fit(
    rows: DataFrame, ks: Sequence[int], seed: int = 42, rounds: int | None = None, gamma: float | None = None, starts: int = 3
) -> dict[int, Prototypes]:
    """Centres for every k, run until they no longer move or the cost no longer falls.

    The rounds that takes grow with the rows. The cost falls in every round but the last, so that there is a last one;
    with ``rounds`` it is an error if that many passes are not enough. Each k is started ``starts`` times, all in the same
    passes; the one with the least cost is returned. Between two passes over dense rows, rounds go on over the rows that can
    change their cluster at all, see ``_local_rounds``. The centres are dense, k x terms numbers per start in the driver and
    the sums as many in each task; rows and the sums that leave a task hold entries only. The rows are dealt over all
    tasks first: a small table of vectors is one file and would keep one task busy.
    """
    rows = stage(rows.repartition(shuffle_width(rows.sparkSession)), "vectors").persist()
    try:
        return _fitted(rows, ks, seed, rounds, gamma, starts)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame, ks: Sequence[int], seed: int, rounds: int | None, gamma: float | None, starts: int) -> dict[int, Prototypes]:
    spread = spreads(rows)
    if gamma is None:
        gamma = 0.5 * float(spread[1].mean()) if len(spread[1]) else 0.0
    models = _start(rows, ks, gamma, seed, starts, spread)
    packed = _packed(rows) if "vector" in rows.columns else rows
    try:
        return _rounds(packed, models, ks, rounds, starts)
    finally:
        if packed is not rows:
            packed.unpersist()


def _rounds(rows: DataFrame | RDD, models: dict[tuple[int, int], Prototypes], ks: Sequence[int], rounds: int | None, starts: int) -> dict[int, Prototypes]:
    active = set(models)
    while active:
        if rounds is not None and any(len(models[m].costs) >= rounds for m in active):
            raise RuntimeError(f"the centres for k = {sorted({k for k, _ in active})} still move after {rounds} rounds")
        order = sorted(active)
        sums = dict(iter(_sums(rows, [models[m] for m in order]).groupby("model")))
        near, wait = {}, _WAIT
        for number, m in enumerate(order):
            before, after = models[m], _updated(models[m], sums[number])
            if not np.isfinite(after.cost):
                raise ValueError(f"the cost for k = {m[0]} is {after.cost}: the vectors hold numbers that have no distances")
            if _ended(before, after):
                active.discard(m)
            else:
                steps = _STEPS * _drift(before, after)
                if steps < after.room:
                    near[m] = before
                # the room is looked for again when it may be enough
                wait = before.wait - 1 if before.wait else min(wait, int(min(steps / after.room, _WAIT)) if after.room else _WAIT)
            models[m] = after
        if near:
            left = [None if rounds is None else rounds - len(models[m].costs) for m in near]
            for m, (after, ended) in zip(near, _local_rounds(rows, list(near.values()), [models[m] for m in near], left)):
                models[m] = after
                if ended:
                    active.discard(m)
        for m in active:
            models[m].wait = wait
    return {k: min((models[k, s] for s in range(starts)), key=lambda m: m.cost) for k in ks}


def assign(rows: DataFrame, model: Prototypes) -> DataFrame:
    """Rows with their ``cluster`` and ``distance``."""

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            distance = model.distances(Vectors.of(frame))
            best = distance.argmin(axis=1)
            yield pd.DataFrame({
                "row_id": frame["row_id"], "category": frame["category"], "cluster": best.astype("int32"),
                "distance": distance[np.arange(len(best)), best],
            })

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInPandas(label, f"row_id {kind}, category string, cluster int, distance double")


def sweep(rows: DataFrame, ks: Sequence[int], seed: int = 42, rounds: int | None = None) -> list[tuple[int, float, float]]:
    """(k, cost, silhouette of the numeric part) for every k.

    The silhouette uses squared distances, which makes the mean distance to a cluster a function of the cluster's
    sums; so it is exact over all rows in one more pass and needs no row pairs.
    """
    fitted = fit(rows, ks, seed, rounds)
    final = [fitted[k] for k in ks]
    sums = dict(iter(_sums(rows, final).groupby("model")))
    stats = [_updated(m, sums[i]) for i, m in enumerate(final)]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {m.k: 0.0 for m in final}
        count = 0
        for frame in frames:
            if frame.empty:
                continue
            x = Vectors.of(frame)
            count += len(x.codes)
            for model, stat in zip(final, stats):
                own = model.distances(x).argmin(axis=1)
                totals[model.k] += float(_silhouettes(x, own, stat).sum())
        yield pd.DataFrame([(k, v, count) for k, v in totals.items()], columns=["k", "total", "n"])

    parts = rows.select(*_parts(rows), "category").mapInPandas(partial, "k int, total double, n long")
    means = {r["k"]: r["s"] for r in parts.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("s")).collect()}
    return [(m.k, s.cost, means[m.k]) for m, s in zip(final, stats)]


def _silhouettes(x: Vectors, own: np.ndarray, stat: Prototypes) -> np.ndarray:
    filled = stat.sizes > 0
    sizes = np.where(filled, stat.sizes, 1)
    mean = x.squares[:, None] + (stat.squares / sizes)[None, :] - 2 * x.dot(stat.centres)
    mean = np.where(filled[None, :], mean, np.inf)
    at = np.arange(len(own))
    n_own = stat.sizes[own]
    inside = mean[at, own] * n_own / np.maximum(n_own - 1, 1)
    mean[at, own] = np.inf
    outside = mean.min(axis=1)
    top = np.maximum(inside, outside)
    value = np.where(top > 0, (outside - inside) / np.where(top > 0, top, 1), 0.0)
    return np.where(n_own > 1, value, 0.0)
