"""Benchmark items in documents: latent semantic search, confirmed by common subsequences and answers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylematch.llm.hashing import text_chunks, word_hashes, words
from stylematch.session import stage

TILE = 32
RANK = 96
COSINE = 0.45
SHARE = 0.45
COMMON = 0.6
COMMON_WITH_ANSWER = 0.45
ITEMS = 4000
FEW = 8
COMMON_TERM = 0.02
STRIP = 64
#: Postings met per tile, as expected from the frequencies, that are counted at once.
SLAB = 64.0

#: Letters, digits and all bytes beyond ASCII make words; everything else parts them.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[c for c in range(256) if c >= 0x80 or chr(c).isalnum()]] = True


def hashed_words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), LETTERS)
    return word_hashes(data, starts, ends, letters=LETTERS)


def answer_of(text: str) -> np.ndarray:
    """The words of the last sentence that has three or more; none if no sentence has."""
    for part in reversed(re.split(r"[.!?\n]+", text)):
        found = hashed_words(part)
        if len(found) >= 3:
            return found
    return np.zeros(0, np.uint64)


def common_length(item: list[int], passage: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one integer."""
    places: dict[int, int] = {}
    for i, word in enumerate(item):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in passage:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def row_sums(values: np.ndarray, number: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row the sum of ``values[number]`` in order; ``row`` ascends.

    The j-th entries of all rows are added at once, the longest rows first: a tile has few entries, and blocks of rows
    are added several times as fast as row after row.
    """
    out = np.zeros((rows, values.shape[1]), values.dtype)
    if len(number):
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        counts = np.diff(heads, append=len(row))
        order = np.argsort(-counts, kind="stable")
        heads, counts = heads[order], counts[order]
        sums = values[number[heads]]
        for j in range(1, int(counts[0])):
            n = int(np.searchsorted(-counts, -j))
            sums[:n] += values[number[heads[:n] + j]]
        out[row[heads]] = sums
    return out


@dataclass
class Index:
    """The benchmark items of one block: their words, and after the fit the latent basis."""

    ids: list[int]
    items: list[list[int]]
    answers: list[list[int]]
    terms: np.ndarray
    near: np.ndarray
    idf: np.ndarray | None = None
    own: list[np.ndarray] | None = None
    basis: np.ndarray | None = None

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their term numbers. A bit table passes over most other words."""
        at = np.flatnonzero(self.near[(hashes & np.uint64(len(self.near) - 1)).astype(np.int64)])
        number = np.searchsorted(self.terms, hashes[at])
        number[number == len(self.terms)] = 0
        good = self.terms[number] == hashes[at] if len(self.terms) else np.zeros(0, bool)
        return at[good], number[good]

    def project(self, number: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The latent vectors of rows of terms; ``row`` ascends."""
        return row_sums(self.basis, number, row, rows)


def _tiles(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tile of every word, numbered over the rows, and the tiles' bounds by row."""
    counts = np.diff(bounds)
    per_row = -(-counts // TILE)
    first = np.concatenate([[0], np.cumsum(per_row)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)
    return np.repeat(first[:-1], counts) + place // TILE, first


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row, data, offsets in text_chunks(column):
        starts, ends, bounds = words(data, offsets, LETTERS)
        yield row, word_hashes(data, starts, ends, letters=LETTERS), bounds, *_tiles(bounds)


def _index(rows: list) -> Index:
    items = [hashed_words(r["text"] or "") for r in rows]
    answers = [answer_of(r["text"] or "") for r in rows]
    terms = np.unique(np.concatenate([*items, np.zeros(0, np.uint64)]))
    near = np.zeros(1 << max(16, int(len(terms)).bit_length() + 6), bool)
    near[(terms & np.uint64(len(near) - 1)).astype(np.int64)] = True
    return Index([r["item_id"] for r in rows], [i.tolist() for i in items], [a.tolist() for a in answers], terms, near)


def _frequencies(docs: DataFrame, index: Index) -> tuple[np.ndarray, int]:
    """In how many tiles of all documents each term is, and how many tiles there are."""
    n = len(index.terms)

    def count(batches):
        total = np.zeros(n + 1, np.int64)
        for batch in batches:
            for _, hashes, bounds, tile, first in _chunks(batch.column(0)):
                at, number = index.hits(hashes)
                total[:n] += np.bincount(np.unique(tile[at] * n + number) % n, minlength=n)[:n] if len(at) else 0
                total[n] += first[-1]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n + 1, np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:n], int(out[n])


def _selected(index: Index, df: np.ndarray, tiles: int) -> Index:
    """The index without very common terms, but with at least ``FEW`` of each item's rarest words, and with weights."""
    few = df <= COMMON_TERM * tiles
    keep, owned = few.copy(), []
    for item in index.items:
        own = np.unique(np.searchsorted(index.terms, np.array(item, np.uint64)))
        own = own[few[own]] if few[own].sum() >= FEW else own[np.argsort(df[own], kind="stable")[:FEW]]
        keep[own] = True
        owned.append(own)
    terms, place = index.terms[keep], np.cumsum(keep) - 1
    near = np.zeros(len(index.near), bool)
    near[(terms & np.uint64(len(near) - 1)).astype(np.int64)] = True
    return Index(index.ids, index.items, index.answers, terms, near, np.log((1 + tiles) / (1 + df[keep])) + 0.1, [place[own] for own in owned])


def _latent_basis(docs: DataFrame, index: Index, rank: int, seed: int = 5) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the main right singular directions of the TF-IDF matrix.

    The rows of the matrix A are all tiles of the documents, and the items. The range finder multiplies AᵀA with a
    random matrix: every task sums its share of the product, the shares are added by strips of terms, and only the sum,
    whose size the items fix, reaches the driver for the orthonormalisation. The items' own share is weighted up to the
    share of the documents, so that directions which only items use are kept.
    """
    n = len(index.terms)
    rank = min(rank, n)
    start = np.random.Generator(np.random.Philox(key=seed)).standard_normal((n, rank)).astype(np.float32)
    idf = index.idf.astype(np.float32)
    weighted = start * idf[:, None]

    def product(row, number, rows):
        """AᵀA Ω for rows of terms; ``row`` ascends."""
        y = row_sums(weighted, number, row, rows)
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        out = np.zeros((n, rank))
        out[number[order][first]] = np.add.reduceat(y[row[order]], first, axis=0)
        return out * idf[:, None]

    def share(batches):
        total = np.zeros((n, rank))
        for batch in batches:
            for _, hashes, _, tile, first in _chunks(batch.column(0)):
                at, number = index.hits(hashes)
                if len(at):
                    total += product(tile[at], number, int(first[-1]))
        used = [i for i in range(0, n, STRIP) if total[i:i + STRIP].any()]
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array([total[i:i + STRIP].tobytes() for i in used], pa.binary())], ["strip", "sums"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[strip] = held.get(strip, 0) + np.frombuffer(sums)
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([s.tobytes() for s in held.values()], pa.binary())], ["strip", "sums"])

    kind = "strip long, sums binary"
    z = np.zeros((n, rank))
    for r in docs.select("text").mapInArrow(share, kind).repartition("strip").mapInArrow(add, kind).toLocalIterator():
        z[r["strip"]:r["strip"] + STRIP] = np.frombuffer(r["sums"]).reshape(-1, rank)
    number, row = [], []
    for i, item in enumerate(index.items):
        at, own = index.hits(np.array(item, np.uint64))
        number.append(own), row.append(np.full(len(own), i))
    if len(np.concatenate(number)):
        own = product(np.concatenate(row), np.concatenate(number), len(index.items))
        z = own + z * (np.linalg.norm(own) / max(np.linalg.norm(z), 1e-9) if z.any() else 0)
    return (np.linalg.qr(z)[0] * idf[:, None]).astype(np.float32)


def _reach(words_of: list[int]) -> int:
    """Words on either side of a window that are compared with an item too."""
    return max(TILE, len(words_of) // 2)


class Slab:
    """Postings of some items' kept terms, to count the weight of an item's terms in every passage."""

    def __init__(self, index: Index, items: np.ndarray):
        self.items = items
        own = [index.own[i] for i in items]
        term = np.concatenate(own)
        order = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[order], np.arange(len(index.terms) + 1))
        self.which = np.repeat(np.arange(len(items)), [len(x) for x in own])[order]
        self.weight = index.idf[term[order]]
        self.need = np.array([SHARE * index.idf[x].sum() for x in own]) - 1e-6
        self.side = np.array([-(-_reach(index.items[i]) // TILE) for i in items])

    def candidates(self, tile: np.ndarray, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window's tile, item number) wherever the tiles of the passage may hold the share of the item's weight.

        ``tile`` and ``number`` are the distinct pairs of a tile and a term. A term in several tiles counts in each, so
        no passage that holds the share is missed.
        """
        counts = self.start[number + 1] - self.start[number]
        from_pair = np.repeat(np.arange(len(number)), counts)
        posting = np.arange(len(from_pair)) + np.repeat(self.start[number] - (np.cumsum(counts) - counts), counts)
        item, at = self.which[posting], tile[from_pair]
        # Documents stand so far apart that no passage reaches from one into the next.
        gap = 2 * int(self.side.max()) + 2
        doc = np.searchsorted(first, at, side="right") - 1
        span = int(first[-1]) + len(first) * gap
        key = item * span + at + doc * gap
        order = np.argsort(key, kind="stable")
        key, item, at, doc = key[order], item[order], at[order], doc[order]
        total = np.concatenate([[0.0], np.cumsum(self.weight[posting[order]])])
        wide = 2 * self.side[item] + 2
        good = np.flatnonzero(total[np.searchsorted(key, key + wide)] - total[np.searchsorted(key, key)] >= self.need[item])
        per = wide[good]
        item, doc = np.repeat(item[good], per), np.repeat(doc[good], per)
        head = np.repeat(at[good] - self.side[item[np.cumsum(per) - per]] - 1 if len(good) else at[good], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        inside = (head >= first[doc]) & (head <= np.maximum(first[doc], first[doc + 1] - 2))
        spots = np.unique(item[inside] * span + head[inside])
        item, head = spots // span, spots % span
        low = item * span + head + (np.searchsorted(first, head, side="right") - 1) * gap - self.side[item]
        held = total[np.searchsorted(key, low + 2 * self.side[item] + 2)] - total[np.searchsorted(key, low)]
        some = held >= self.need[item]
        return head[some], self.items[item[some]]


def _slabs(index: Index) -> list[Slab]:
    rate = np.cumsum([np.exp(0.1 - index.idf[own]).sum() for own in index.own])
    return [Slab(index, part) for part in np.split(np.arange(len(rate)), np.flatnonzero(np.diff(rate // SLAB)) + 1)]


FOUND = "doc_id long, item_id long, first_word int, n_words int, cosine double, common double, answer boolean"


def _matcher(index: Index):
    """A function from a text column to the confirmed (row, item number) pairs: every window of two tiles against every item."""
    slabs = _slabs(index)
    weights = [dict(zip(index.terms[own].tolist(), index.idf[own].tolist())) for own in index.own]
    number = [index.hits(np.array(item, np.uint64))[1] for item in index.items]
    items = index.project(np.concatenate(number), np.repeat(np.arange(len(number)), [len(x) for x in number]), len(number))
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)

    def confirm(hashes, first, last, item):
        words_of, answer = index.items[item], index.answers[item]
        passage = hashes[first:last].tolist()
        common = common_length(words_of, passage) / len(words_of)
        if common < COMMON_WITH_ANSWER:
            return None
        has = bool(answer) and any(passage[i:i + len(answer)] == answer for i in range(len(passage) - len(answer) + 1))
        return (common, has) if common >= COMMON or has else None

    def weighs(hashes, first, last, item):
        own = weights[item]
        return sum(own[w] for w in own.keys() & set(hashes[first:last].tolist())) >= SHARE * sum(own.values()) - 1e-6

    def matches(column: pa.Array) -> dict[tuple[int, int], tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for row, hashes, bounds, tile, first in _chunks(column):
            at, number = index.hits(hashes)
            if not len(at):
                continue
            tiles = int(first[-1])
            vectors = index.project(number, tile[at], tiles)
            doc_of = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
            pair = np.flatnonzero(doc_of[:-1] == doc_of[1:])
            alone = np.setdiff1d(np.arange(tiles), np.concatenate([pair, pair + 1]))
            heads = np.concatenate([pair, alone])
            windows = np.concatenate([vectors[pair] + vectors[pair + 1], vectors[alone]])
            norms = np.linalg.norm(windows, axis=1)
            some = np.flatnonzero(norms > 0)
            seen = set()

            def look(head, item, likeness, exact):
                doc = int(doc_of[head])
                low, high = int(bounds[doc]), int(bounds[doc + 1])
                place, reach = low + (head - int(first[doc])) * TILE, _reach(index.items[item])
                a, b = max(low, place - reach), min(high, place + 2 * TILE + reach)
                got = confirm(hashes, a, b, item) if not exact or weighs(hashes, a, b, item) else None
                if got:
                    key = (row + doc, item)
                    found = (got[0], got[1], likeness, a - low, b - a)
                    best[key] = max(best.get(key, found), found)

            for start in range(0, len(some), 4096):
                part = some[start:start + 4096]
                likeness = (windows[part] / norms[part, None]) @ items.T
                for w, item in zip(*np.nonzero(likeness >= COSINE)):
                    seen.add((int(heads[part[w]]), int(item)))
                    look(int(heads[part[w]]), int(item), float(likeness[w, item]), False)
            window_of = np.zeros(tiles, np.int64)
            window_of[heads] = np.arange(len(heads))
            pairs = np.unique(tile[at] * len(index.terms) + number)
            for slab in slabs:
                for head, item in zip(*(x.tolist() for x in slab.candidates(pairs // len(index.terms), pairs % len(index.terms), first))):
                    if (head, item) not in seen:
                        w = window_of[head]
                        look(head, item, float(windows[w] @ items[item] / max(norms[w], 1e-9)), True)
        return best

    return matches


def _search(docs: DataFrame, index: Index) -> DataFrame:
    matches, ids_of = _matcher(index), index.ids

    def find(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
        for batch in batches:
            ids = batch.column(0)
            rows = [(ids[r].as_py(), ids_of[i], f, n, c, common, has) for (r, i), (common, has, c, f, n) in sorted(matches(batch.column(1)).items())]
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(find, FOUND)


def _fitted(docs: DataFrame, benchmark: DataFrame, rank: int, items: int) -> Iterator[Index]:
    """The fitted index of each block of ``items`` items, one after the other."""
    asked = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    blocks = max(1, -(-asked.count() // items))
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        rows = [r for r in rows if len(hashed_words(r["text"] or ""))]
        if rows:
            index = _index(rows)
            index = _selected(index, *_frequencies(docs, index))
            index.basis = _latent_basis(docs, index, rank)
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, cosine, common, answer): the documents that hold benchmark items.

    Words are runs of letters and digits, A-Z as a-z. Documents are cut into tiles of 32 words. A distributed
    randomised SVD of the TF-IDF matrix of all tiles, over the terms of the items, gives a latent space; windows of two
    tiles whose cosine to an item is at least 0.45 there are candidates. The space is too small to tell thousands of
    items apart, so windows that hold, with the words around them, 45 % of the summed weights of an item's terms are
    candidates too, whatever their cosine; these are counted exactly. A candidate's words, with those around it, hold the
    item if their longest common subsequence has 60 % of the item's words, or 45 % and the answer (the last
    sentence of three or more words) stands in them. Of several windows of a document the best is returned. Terms in
    more than 2 % of the tiles weigh nothing, except that every item keeps its eight rarest.

    The benchmark is the query set: it is read ``items`` items at a time, each block against all documents, so what
    tasks hold does not grow with it. Three passes over the documents and no shuffle of them. Null or empty texts and
    items hold and match nothing; a null or repeated doc_id is reported as it is; items that repeat an id are separate.
    Empty tables give an empty result. Other columns are not read.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for index in _fitted(docs, benchmark, rank, items):
        out = out.unionByName(stage(_search(docs, index), "found"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, items: int = ITEMS) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item; see ``contaminated``. Null and repeated ids do not matter."""
    texts, at = docs.select(docs["text"].cast("string").alias("text")), docs.columns.index("text")
    out = docs
    for index in _fitted(texts, benchmark, rank, items):
        matches = _matcher(index)

        def kept(batches, matches=matches):
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[row for row, _ in matches(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = stage(out.mapInArrow(kept, out.schema), "clean")
    return out
