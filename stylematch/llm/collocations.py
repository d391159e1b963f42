"""Phrase collocations: candidates by Apriori, counted exactly with broadcast double-array tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylematch.llm.hashing import constants, mix, text_chunks, words
from stylematch.session import discard, stage

BLANKS, SEPARATORS = b" \t", b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, MOST, SHARE = 10, 3, 2000, 50
#: Bits of the fixed-size table that a level's surviving hashes are kept in (2^27: 16 MB).
FILTER_BITS = 27
#: Phrases per trie, which takes some 30 MB, and tries that are broadcast for one pass over the texts.
SHARD, TRIES = 1 << 19, 4
#: Phrases whose counts of a task travel as one row.
BLOCK = 1 << 14
#: Children of a wide trie node that share a base.
FAN = 4
SALTS = 64
CHUNK = 1 << 21
#: Word numbers per staged row and per step of a pass over them, about; bytes of a row group of the staged rows, which is read whole.
RUN, RUNS, GROUP = 1 << 14, 1 << 20, 1 << 24
#: Bits of the cells in a part of a filter, and hashes of a part that wait to be merged.
PART, WAITING = 19, 1 << 20

IS_LETTER = np.ones(256, dtype=bool)
IS_LETTER[list(BLANKS + SEPARATORS)] = False
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_PLACES = (63, 64)
#: What of eight bytes belongs to a word that has so many left.
_LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


@dataclass
class _Words:
    """The words of some rows: bytes and bounds, row, two hashes of (language, word), and whether the next word follows in the piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    one: np.ndarray
    two: np.ndarray
    follows: np.ndarray


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every word, A-Z as a-z, over its bytes by eight."""
    folded = np.append(LOWER[data], np.zeros(8, np.uint8))
    by_eight = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))
    lengths = ends - starts
    pieces = (lengths + 7) >> 3
    heads = np.cumsum(pieces) - pieces
    places = np.arange(int(pieces.sum())) - np.repeat(heads, pieces)
    left = np.repeat(lengths, pieces) - 8 * places
    own = by_eight[np.repeat(starts, pieces) + 8 * places] & _LEFT[np.minimum(left, 8)]
    out = []
    for seed in _PLACES:
        by_place = constants(int(pieces.max()), seed)
        out.append(mix(np.add.reduceat(mix(own ^ by_place[places]), heads) + lengths.astype(np.uint64)))
    return out[0], out[1]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, _Words]]:
    """The language column and the words of each few megabytes of text."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        sums = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in langs.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
        by_row = sums[np.asarray(langs.indices)] if len(batch) else np.zeros((0, 2), np.uint64)
        for row, data, offsets in text_chunks(batch.column(1), CHUNK):
            starts, ends, bounds = words(data, offsets, IS_LETTER)
            if not len(starts):
                continue
            rows = row + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            one, two = _hashes(data, starts, ends)
            breaks = np.append(np.int32(0), np.cumsum(IS_SEPARATOR[data], dtype=np.int32))
            follows = np.zeros(len(starts), dtype=bool)
            follows[:-1] = (rows[1:] == rows[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
            yield batch.column(0), _Words(data, starts, ends, rows, mix(one ^ by_row[rows, 0]), mix(two ^ by_row[rows, 1]), follows)


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each pair of hashes, and how many there are of it."""
    found, first, inverse, counts = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    if np.array_equal(two[first][inverse], two):
        return first, counts
    order = np.lexsort((two, one))
    head = np.ones(len(one), dtype=bool)
    head[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    at = np.flatnonzero(head)
    return order[at], np.diff([*at, len(one)])


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, w in _read(batches):
        first, counts = _distinct(w.one, w.two)
        lengths = w.ends[first] - w.starts[first]
        heads = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(heads[-1]) + np.repeat(w.starts[first] - heads[:-1], lengths)
        texts = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(heads.astype(np.int64)), pa.py_buffer(LOWER[w.data[at]])).cast(pa.string())
        yield pa.record_batch([langs.take(pa.array(w.rows[first])), texts, pa.array(w.one[first].view(np.int64)), pa.array(w.two[first].view(np.int64)), pa.array(counts)], ["lang", "word", "one", "two", "n"])


class Numbers:
    """The numbers of the frequent words: their sorted hashes, in buckets by the first bits."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.number = np.argsort(one, kind="stable").astype(np.int32)
        self.one, self.two = one[self.number], two[self.number]
        self.shift = np.uint64(63 - len(one).bit_length())
        self.first = np.searchsorted(self.one >> self.shift, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(one), -1, np.int32)
        bucket = (one >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        words_ = np.flatnonzero(at < end)
        while len(words_):
            place = at[words_]
            own = (self.one[place] == one[words_]) & (self.two[place] == two[words_])
            out[words_[own]] = self.number[place[own]]
            words_ = words_[~own]
            at[words_] += 1
            words_ = words_[at[words_] < end[words_]]
        return out


def _numbered(batches: Iterator[pa.RecordBatch], numbers: Broadcast) -> Iterator[pa.RecordBatch]:
    """The texts as runs of numbers: the frequent words that follow each other in a piece, two at least, and a -1 after each run.

    A row holds some RUN numbers of whole runs, their bytes by significance (the high ones are mostly 0 and pack well).
    """
    for _, w in _read(batches):
        own = numbers.value.of(w.one, w.two)
        own = np.insert(own, np.flatnonzero(~w.follows) + 1, -1)
        before, after = np.append(-1, own[:-1]), np.append(own[1:], -1)
        # a lone word is in no phrase, and one break is enough
        lone = (own >= 0) & (before < 0) & (after < 0)
        own = own[~lone & ((own >= 0) | (before >= 0)) & ~np.append(False, lone[:-1])]
        ends = np.flatnonzero(own < 0) + 1
        if not len(ends):
            continue
        cuts = np.unique(ends[np.minimum(np.searchsorted(ends, np.arange(RUN, len(own) + RUN, RUN)), len(ends) - 1)])
        rows = [part.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for part in np.split(own, cuts[:-1])]
        yield pa.record_batch([pa.array(rows, pa.binary())], ["runs"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The numbers of some RUNS words at a time, whole runs."""
    held, size = [], 0
    for batch in batches:
        for row in batch.column(0):
            held.append(np.ascontiguousarray(np.frombuffer(row.as_buffer(), np.uint8).reshape(4, -1).T).view("<i4")[:, 0])
            size += len(held[-1])
            if size >= RUNS:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _pairs(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The two words at each place in 64 bits."""
    return (numbers[at].astype(np.uint64) << np.uint64(32)) | numbers[at + 1].astype(np.uint64)


def _phrase_hashes(numbers: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the phrases of ``size`` words that start at the places ``at``; that of two words is one to one."""
    out = mix(_pairs(numbers, at))
    for i in range(2, size):
        out = mix(out + numbers[at + i].astype(np.uint64))
    return out


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cells = hashes >> np.uint64(65 - (len(bits) * 8).bit_length())
    return (bits[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _possible(numbers: np.ndarray, size: int, filters: list[np.ndarray]) -> np.ndarray:
    """Places where a phrase of ``size`` words starts whose shorter parts may all be frequent, by the filters of their sizes."""
    alive = numbers >= 0
    for shorter in range(1, size):
        if shorter > 1:
            places = np.flatnonzero(alive)
            alive[places] = _in_filter(filters[shorter - 2], _phrase_hashes(numbers, places, shorter))
        alive[:-1] &= alive[1:]
        alive[-1:] = False
    return np.flatnonzero(alive)


def _level_counts(batches: Iterator[pa.RecordBatch], size: int, filters: list[Broadcast], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """How often each hash of a possible phrase of this size occurs, up to ``least``, in a row per part of the filter."""
    tables = [f.value for f in filters]
    for numbers in _runs(batches):
        found, counts = np.unique(_phrase_hashes(numbers, _possible(numbers, size, tables), size), return_counts=True)
        # more than ``least`` decides no more than ``least``
        counts = np.minimum(counts, least).astype(np.min_scalar_type(least))
        parts, heads = np.unique((found >> np.uint64(64 - bits)) >> np.uint64(PART), return_index=True)
        ends = [*heads[1:], len(found)]
        columns = [parts.astype(np.int32), [found[i:j].tobytes() for i, j in zip(heads, ends)], [counts[i:j].tobytes() for i, j in zip(heads, ends)]]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["part", "hashes", "counts"])


_SYMBOLS = [f"w{i}" for i in range(LONGEST)]


def _candidates(batches: Iterator[pa.RecordBatch], filters: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    """The distinct phrases whose own hash and all of whose parts pass the filters, as the numbers of their words.

    ``spread`` is made of the first two words.
    """
    bits = [f.value for f in filters]
    for numbers in _runs(batches):
        for size in range(2, LONGEST + 1):
            at = _possible(numbers, size, bits)
            hashes = _phrase_hashes(numbers, at, size)
            alive = _in_filter(bits[size - 2], hashes)
            at, hashes = at[alive], hashes[alive]
            if size == 2:
                at = at[np.unique(hashes, return_index=True)[1]]
            else:
                at = at[_distinct_phrases(numbers, at, hashes, size)]
            columns = [pa.array(numbers[at + i]) if i < size else pa.nulls(len(at), pa.int32()) for i in range(LONGEST)]
            yield pa.record_batch([pa.array(np.full(len(at), size, np.int32)), pa.array(_spreads(numbers, at)), *columns], ["size", "spread", *_SYMBOLS])


def _distinct_phrases(numbers: np.ndarray, at: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Which of the places are the first of their phrase, by the words where hashes are equal."""
    order = np.argsort(hashes, kind="stable")
    own = np.stack([numbers[at[order] + i] for i in range(size)], axis=1)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (own[1:] != own[:-1]).any(axis=1)
    return order[fresh]


def _spreads(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """31 bits of a hash of the first two words at each place: which trie holds the phrases that start with them."""
    return (_phrase_hashes(numbers, at, 2) >> np.uint64(33)).astype(np.int32)


def _packed(batches: Iterator[pa.RecordBatch], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The cells of the hashes that occur ``least`` times in all, packed to bits: a row per part of 2^PART cells."""
    kind = np.min_scalar_type(least)
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[int, int] = {}

    def merge(part: int) -> None:
        hashes, counts = (np.concatenate(x) for x in zip(*held[part]))
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order].astype(np.int64)
        heads = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        held[part], waiting[part] = [(hashes[heads], np.minimum(np.add.reduceat(counts, heads), least).astype(kind))], 0

    for batch in batches:
        for part, hashes, counts in zip(*batch.columns):
            own = np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), kind)
            held.setdefault(part := part.as_py(), []).append(own)
            waiting[part] = waiting.get(part, 0) + len(own[0])
            if waiting[part] > max(WAITING, len(held[part][0][0])):
                merge(part)
    for part in held:
        merge(part)
        hashes, counts = held[part][0]
        cells = (hashes[counts >= least] >> np.uint64(64 - bits)).astype(np.int64) & ((1 << PART) - 1)
        own = np.zeros(1 << PART, dtype=bool)
        own[cells] = True
        yield pa.record_batch([pa.array([part]), pa.array([np.packbits(own, bitorder="little").tobytes()])], ["part", "bits"])


def _filter(counted: DataFrame, least: int, bits: int) -> Broadcast:
    """A table of fixed size with a bit for the cell of every hash that occurs ``least`` times: what has none is not frequent."""
    out = np.zeros(max(1 << (bits - 3), 1 << (PART - 3)), dtype=np.uint8)
    packed = counted.repartition("part").mapInArrow(lambda batches: _packed(batches, least, bits), "part long, bits binary")
    for row in packed.collect():
        out[row.part << (PART - 3):(row.part + 1) << (PART - 3)] = np.frombuffer(row.bits, np.uint8)
    return counted.sparkSession.sparkContext.broadcast(out[:1 << (bits - 3)])


@dataclass
class Trie:
    """A double array over word sequences, and the sorted hashes of its words.

    The child of a node by a symbol stands at ``base + symbol``, modulo the size of the array, if ``owner`` there is the
    node and ``symbol`` the symbol. A node with many children has several bases, chosen by the symbol, so that few
    children must fit at a time; symbols under different bases may lead to one slot, which is why the symbol is compared too.
    ``phrase`` is the number of the phrase that ends at a node, or -1.
    """

    one: np.ndarray
    two: np.ndarray
    repeats: int
    first_base: np.ndarray
    bases_mask: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    symbol: np.ndarray
    child: np.ndarray
    phrase: np.ndarray

    def symbols(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out = np.full(len(one), -1, np.int64)
        at = np.searchsorted(self.one, one)
        for i in range(self.repeats):
            place = np.minimum(at + i, len(self.one) - 1)
            out = np.where((self.one[place] == one) & (self.two[place] == two), place, out)
        return out

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child of each node by its symbol, or -1."""
        base = self.base[self.first_base[nodes] + (_spread(symbols) & self.bases_mask[nodes])]
        slot = (base + symbols) & (len(self.owner) - 1)
        # a free slot has no owner, so a symbol of -1 leads nowhere
        return np.where((self.owner[slot] == nodes) & (self.symbol[slot] == symbols), self.child[slot], -1)


def _spread(symbols: np.ndarray) -> np.ndarray:
    return ((symbols * 0x9E3779B1) >> 7) & 0xFFFFF


def _power(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def build_trie(phrases: np.ndarray, sizes: np.ndarray) -> Trie:
    """The trie of distinct phrases: an array of (phrase, word, two hashes) and the number of words of each."""
    used = np.arange(phrases.shape[1]) < sizes[:, None]
    pairs = phrases[used]
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (pairs[order][1:] != pairs[order][:-1]).any(axis=1)
    symbols = np.full(phrases.shape[:2], -1, np.int64)
    numbered = np.empty(len(order), np.int64)
    numbered[order] = np.cumsum(fresh) - 1
    symbols[used] = numbered
    words_ = pairs[order][fresh]
    repeats = int(np.unique(words_[:, 0], return_counts=True)[1].max())

    # nodes by level: a node is a parent and a symbol; the root is 0
    at, nodes = np.zeros(len(phrases), np.int64), 1
    parents, edges, children = [], [], []
    ends = np.zeros(len(phrases), np.int64)
    for level in range(phrases.shape[1]):
        alive = np.flatnonzero(sizes > level)
        keys, inverse = np.unique(at[alive] * len(words_) + symbols[alive, level], return_inverse=True)
        parents.append(keys // len(words_))
        edges.append(keys % len(words_))
        children.append(np.arange(nodes, nodes + len(keys)))
        at[alive] = nodes + inverse
        nodes += len(keys)
        ends[alive] = at[alive]
    parent, symbol, child = (np.concatenate(x) for x in (parents, edges, children))
    phrase = np.full(nodes, -1, np.int64)
    phrase[ends] = np.arange(len(phrases))

    fans = np.bincount(parent, minlength=nodes)
    bases = np.array([1 << b for b in range(40)])[np.searchsorted([1 << b for b in range(40)], np.maximum(1, -(-fans // FAN)))]
    first_base = np.cumsum(bases) - bases
    bucket = first_base[parent] + (_spread(symbol) & (bases[parent] - 1))
    base, owner, held = _placed(bucket, symbol, parent, int(bases.sum()), _power(max(len(words_), 3 * len(child) // 2)))
    slots, signs = np.full(len(owner), -1, np.int32), np.full(len(owner), -1, np.int32)
    slots[held], signs[held] = child, symbol
    return Trie(words_[:, 0].copy(), words_[:, 1].copy(), repeats, first_base.astype(np.int32), (bases - 1).astype(np.int32), base, owner, signs, slots, phrase.astype(np.int32))


def _placed(bucket: np.ndarray, symbol: np.ndarray, parent: np.ndarray, bases: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base per bucket, owner per slot, slot per child): buckets with most children first, all of a size at once.

    Each tries random bases until its slots are free and nobody else tried them in that round; single children take
    the free slots in turn.
    """
    rng = np.random.default_rng(7)
    order = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    fills = np.diff([*heads, len(order)])
    base, owner, slot_of = np.zeros(bases, np.int32), np.full(size, -1, np.int32), np.empty(len(bucket), np.int64)
    for fill in np.unique(fills)[::-1]:
        members = order[heads[fills == fill][:, None] + np.arange(fill)]
        if fill == 1:
            slots = np.flatnonzero(owner < 0)[:len(members)]
            base[bucket[members[:, 0]]] = (slots - symbol[members[:, 0]]) & (size - 1)
            owner[slots], slot_of[members[:, 0]] = parent[members[:, 0]], slots
            continue
        while len(members):
            tried = rng.integers(size, size=len(members))
            slots = (tried[:, None] + symbol[members]) & (size - 1)
            free = np.flatnonzero((owner[slots] < 0).all(axis=1))
            claim = np.full(size, -1, np.int32) if len(free) > size // 64 else None
            flat = slots[free].reshape(-1)
            by = np.repeat(np.arange(len(free)), fill)
            if claim is None:
                own, first = np.unique(flat, return_index=True)
                winner = by[first[np.searchsorted(own, flat)]]
            else:
                claim[flat[::-1]] = by[::-1]
                winner = claim[flat]
            won = free[(winner == by).reshape(-1, fill).all(axis=1)] if len(free) else free
            base[bucket[members[won, 0]]] = tried[won]
            owner[slots[won]] = parent[members[won]]
            slot_of[members[won]] = slots[won]
            left = np.ones(len(members), dtype=bool)
            left[won] = False
            members = members[left]
    return base, owner, slot_of


def _trie_counts(batches: Iterator[pa.RecordBatch], tries: dict[int, Broadcast], shards: int, words_: int, pairs: Broadcast) -> Iterator[pa.RecordBatch]:
    """How often each phrase of the tries occurs in these runs: all places of a trie advance together, a word at a time.

    A place is looked up in the one trie that its first two words name, if they are frequent at all.
    """
    held = {shard: t.value for shard, t in tries.items()}
    totals = {shard: np.zeros(int(t.phrase.max()) + 1, np.int64) for shard, t in held.items()}
    symbols = {}
    for shard, t in held.items():
        symbols[shard] = np.full(words_ + 1, -1, np.int32)
        symbols[shard][t.one.astype(np.int64)] = np.arange(len(t.one), dtype=np.int32)
    for numbers in _runs(batches):
        at = _possible(numbers, 2, [])
        at = at[_in_filter(pairs.value, _phrase_hashes(numbers, at, 2))]
        named = _spreads(numbers, at) % shards
        for shard, t in held.items():
            places, total = at[named == shard], totals[shard]
            nodes = np.zeros(len(places), np.int64)
            for level in range(LONGEST):
                # a break is the last entry, which no trie has as a symbol
                nodes = t.step(nodes, symbols[shard][numbers[places + level]].astype(np.int64))
                places, nodes = places[nodes >= 0], nodes[nodes >= 0]
                ended = t.phrase[nodes]
                total += np.bincount(ended[ended >= 0], minlength=len(total))
    for shard, total in totals.items():
        for start in range(0, len(total), BLOCK):
            some = np.flatnonzero(total[start:start + BLOCK])
            if len(some):
                row = [shard, start, some.astype(np.uint16).tobytes(), total[start + some].tobytes()]
                yield pa.record_batch([pa.array([x]) for x in row], ["trie", "start", "at", "n"])


def _summed(batches: Iterator[pa.RecordBatch], ids: dict[int, Broadcast]) -> Iterator[pa.RecordBatch]:
    """The counts of the tasks added up, a block at a time."""
    block, total = None, np.zeros(BLOCK, np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(total)
        if len(some):
            yield pa.record_batch([pa.array(ids[block[0]].value[block[1] + some]), pa.array(total[some])], ["id", "a"])
        total[:] = 0

    for batch in batches:
        for number, start, at, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (number, start) != block:
                yield from done()
                block = (number, start)
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
    yield from done()


def _trie_of(candidates: pa.Table) -> tuple[Trie, np.ndarray]:
    numbers = np.stack([np.asarray(candidates.column(c).combine_chunks().fill_null(0)).astype(np.uint64) for c in _SYMBOLS], axis=1)
    return build_trie(np.stack([numbers, np.zeros_like(numbers)], axis=2), np.asarray(candidates.column("size"))), np.asarray(candidates.column("id"))


def _counted(runs: DataFrame, candidates: DataFrame, words_: int, pairs: Broadcast) -> DataFrame:
    """(id, a): the count of every candidate, in passes over the runs with a few tries of about SHARD phrases each.

    The phrases that start with the same two words are in one trie, so that a place is looked up once, however many tries there are.
    """
    spark = runs.sparkSession
    shards = max(1, -(-candidates.count() // SHARD))
    dealt = candidates.withColumn("shard", F.col("spread") % shards).select("shard", "id", "size", *_SYMBOLS)
    out = spark.createDataFrame([], "id long, a long")
    for first in range(0, shards, TRIES):
        tries, ids = {}, {}
        for shard in range(first, min(first + TRIES, shards)):
            own = dealt.filter(F.col("shard") == shard).drop("shard").toArrow()
            if own.num_rows:
                trie, numbers = _trie_of(own)
                tries[shard], ids[shard] = spark.sparkContext.broadcast(trie), spark.sparkContext.broadcast(numbers)
        parts = runs.mapInArrow(lambda batches, own=tries: _trie_counts(batches, own, shards, words_, pairs), "trie long, start long, at binary, n binary")
        parts = parts.repartition("trie", "start").sortWithinPartitions("trie", "start")
        out = out.unionByName(stage(parts.mapInArrow(lambda batches, own=ids: _summed(batches, own), "id long, a long"), "phrase-counts"))
        for b in [*tries.values(), *ids.values()]:
            b.unpersist()
    return out


def _spelt(batches: Iterator[pa.RecordBatch], names: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, f) of phrases given by the numbers of their words."""
    langs, spelt = names.value.column("lang").combine_chunks(), names.value.column("word").combine_chunks()
    for batch in batches:
        each = [spelt.take(batch.column(c)) for c in _SYMBOLS]
        phrase = pc.binary_join_element_wise(*each, pa.scalar(" ", spelt.type), null_handling="skip")
        yield pa.record_batch([langs.take(batch.column(_SYMBOLS[0])), phrase, batch.column("size"), batch.column("a")], ["lang", "phrase", "size", "f"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (lang, phrase, size, f) of all words, and of the phrases of 2 to 3 words that occur ``least`` times.

    See ``collocations``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_counted_words, "lang string, word string, one long, two long, n long")
    vocabulary = stage(counted.groupBy("lang", "word", "one", "two").agg(F.sum("n").alias("f")), "words")

    # the most frequent words have the least numbers; the order is the same in both reads
    frequent = vocabulary.filter(F.col("f") >= least).orderBy(F.desc("f"), "one", "two")
    hashes = frequent.select("one", "two").toArrow()
    words_ = hashes.num_rows
    numbers = spark.sparkContext.broadcast(Numbers(*(np.asarray(hashes.column(c)).view(np.uint64) for c in ("one", "two"))))
    runs = stage(texts.mapInArrow(lambda batches: _numbered(batches, numbers), "runs binary"), "runs", GROUP)
    numbers.unpersist()

    filters = []
    for size in range(2, LONGEST + 1):
        held = list(filters)
        found = runs.mapInArrow(lambda batches, s=size, h=held: _level_counts(batches, s, h, least, filter_bits), "part int, hashes binary, counts binary")
        filters.append(_filter(found, least, filter_bits))
    schema = "size int, spread int, " + ", ".join(f"{s} int" for s in _SYMBOLS)
    found = runs.mapInArrow(lambda batches: _candidates(batches, filters), schema).dropDuplicates()
    found = stage(found.withColumn("id", F.monotonically_increasing_id()), "candidates")
    phrases = found.join(_counted(runs, found, words_, filters[0]).filter(F.col("a") >= least), "id").select(*_SYMBOLS, "size", "a")
    for f in filters:
        f.unpersist()

    names = spark.sparkContext.broadcast(frequent.select("lang", "word").toArrow())
    spelt = stage(phrases.mapInArrow(lambda batches: _spelt(batches, names), "lang string, phrase string, size int, f long"), "phrases")
    names.unpersist()
    discard(runs)
    return vocabulary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f"), spelt


def _cut(phrase: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, most: int = MOST, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of 2 to 3 words of every language.

    A-Z count as a-z; a text is split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words.
    A phrase occurs ``a`` times within pieces, overlaps included; from ``least`` on it is a candidate. A cut parts it in
    two that occur ``l`` and ``r`` times and scores floor(1000000 a² / (l r)); the lowest cut counts, of equals the
    earliest. A candidate goes if a longer one that holds its words in a row has ``share`` per cent of its count.

    Method. Words are counted with their texts; those that occur ``least`` times are numbered, and the texts are staged as runs of
    numbers, so that only two passes read texts. Then level by level (Apriori): a phrase is looked at only if its shorter
    parts are frequent by a table of 2^27 bits over their hashes; the counts of its hash decide which cells of its level's
    table are set. Whatever occurs ``least`` times has its cells set, so no candidate is lost; a crowded table only lets
    more through. The phrases that pass are listed once and counted exactly: double-array tries of some 500,000 of them
    each are broadcast, and in every task all places of the runs advance through them together, level by level; the
    counts of the tasks are added up by blocks of phrases. Phrases with the same first two words are in one trie, so a
    place is looked up once, however many tries there are. A pass over the runs takes four tries; larger sets take more.
    Words are compared by 128 bits of hash, with the language in it. Scores are exact in decimals.

    A null language is ``und``, a null text empty; texts without words, repeated rows and an empty table need no care. Other columns are not read.
    """
    singles, phrases = phrase_counts(docs, text_col, lang_col, least, filter_bits)
    totals = singles.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = singles.filter(F.col("f") >= least).unionByName(phrases).select("lang", "phrase", "f")
    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _cut(F.col("phrase"), F.lit(1), F.col("k")), "right": _cut(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = {c: f"CAST({c} AS DECIMAL(16, 0))" for c in "alr"}
    cuts = cuts.withColumn("score", F.expr(f"(1000000 * {exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")

    inner = F.sequence(F.lit(2), F.col("size") - 1)
    held = phrases.filter("size > 2").select("lang", "phrase", "size", "f", F.explode(inner).alias("m"))
    held = held.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))).select("lang", _cut(F.col("phrase"), F.col("i"), F.col("m")).alias("phrase"), "f")
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    best = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= most)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
