"""Repair of conversation structure: the cheapest edits that give alternating turns, by bidirectional Dijkstra."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch.session import shuffle_width, stage

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a piece of a conversation, and the code points of text after which a piece is closed.
PIECE_ROWS, PIECE_TEXT = 1024, 1 << 22
#: Rows per range of the sorted turns.
RANGE_ROWS = 100_000
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

# Grammar (s?(ua)+)? over role initials. 0: nothing yet, 1: after s, 2: after u, 3: after a. 0 and 3 accept.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_NEXT = (2, 2, 3, 2)  # where a rerole or an insert leads: the only one that fits
_BEFORE = ((), (), (0, 1, 3), (2,))
_KEPT_FROM = {(q2, initial): [q for (q, i), x in _STEP.items() if i == initial and x == q2] for (_, initial), q2 in _STEP.items()}
_ROLE = {2: "user", 3: "assistant"}
#: The inserts that end a conversation from each state.
_CLOSING = ("", "II", "I", "")
_INSERT, _REROLE, _DELETE = 2, 2, 3


def _row_edits(row: tuple[str, int, int]) -> tuple[str, int, bool, int]:
    """Letters and cost of a row's later copies, whether its first copy may stay, and what staying adds."""
    _, fault, copies = row
    return "D" * (copies - 1), _DELETE * (copies - 1), fault not in (BLANK, DUPLICATE), int(fault == TRUNCATED)


def cheapest(rows: list[tuple[str, int, int]], start: int = 0, goals: tuple[int, ...] = _ENDS, tail: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows``, the least audit among equals, or None.

    A row is (initial, fault, copies): the copies after the first one are duplicates. Nodes of the lattice are (rows
    consumed, grammar state); ``goals`` are the states to end in; without ``tail`` nothing is inserted after the last row.

    Forward and reverse heaps are ordered by (cost, place), so that whoever leads to a node at no cost comes before it
    and its label is final. Every edge from a node settled forward to one settled in reverse is a crossing; the search
    goes on while crossings of the best cost may still turn up. Two equally cheap audits between the same nodes are
    never prefixes of each other, so the least parts make the least whole.
    """
    end = len(rows)
    plans = [_row_edits(r) for r in rows]

    def onward(i: int, q: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
        if i < end or tail:
            yield "I", _INSERT, (i, _NEXT[q])
        if i < end:
            more, cost, stays, extra = plans[i]
            yield "D" + more, _DELETE + cost, (i + 1, q)
            if stays:
                yield "R" + more, _REROLE + cost + extra, (i + 1, _NEXT[q])
                if (kept := _STEP.get((q, rows[i][0]))) is not None:
                    yield "K" + more, cost + extra, (i + 1, kept)

    def backward(i: int, q: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
        if i < end or tail:
            for p in _BEFORE[q]:
                yield "I", _INSERT, (i, p)
        if i:
            more, cost, stays, extra = plans[i - 1]
            yield "D" + more, _DELETE + cost, (i - 1, q)
            if stays:
                for p in _BEFORE[q]:
                    yield "R" + more, _REROLE + cost + extra, (i - 1, p)
                for p in _KEPT_FROM.get((q, rows[i - 1][0]), ()):
                    yield "K" + more, cost + extra, (i - 1, p)

    # labels: node -> [cost, audit]; heaps: (cost, place, state)
    ahead, back = {(0, start): (0, "")}, {(end, g): (0, "") for g in goals}
    done_ahead, done_back = set(), set()
    heap_ahead, heap_back = [(0, 0, start)], [(0, -end, g) for g in goals]
    best: tuple[int, str] | None = None

    def crossing(cost: int, audit_parts: tuple[str, ...]) -> None:
        nonlocal best
        if best is None or cost <= best[0]:
            found = (cost, "".join(audit_parts))
            best = found if best is None else min(best, found)

    while heap_ahead or heap_back:
        low_ahead, low_back = heap_ahead[0][0] if heap_ahead else 0, heap_back[0][0] if heap_back else 0
        if best is not None and low_ahead + low_back > best[0]:
            break
        forward = bool(heap_ahead) and (not heap_back or low_ahead <= low_back)
        cost, place, q = heappop(heap_ahead if forward else heap_back)
        node = (place, q) if forward else (-place, q)
        done, other_done = (done_ahead, done_back) if forward else (done_back, done_ahead)
        if node in done:
            continue
        done.add(node)
        own, other, heap = (ahead, back, heap_ahead) if forward else (back, ahead, heap_back)
        audit = own[node][1]
        if node in other_done:
            crossing(cost + other[node][0], (audit, other[node][1]) if forward else (other[node][1], audit))
        for letters, more, to in (onward if forward else backward)(*node):
            if to in other_done:
                far, rest = other[to]
                crossing(cost + more + far, (audit, letters, rest) if forward else (rest, letters, audit))
            if to in done:
                continue
            label = (cost + more, audit + letters if forward else letters + audit)
            known = own.get(to)
            if known is None or label < known:
                own[to] = label
                if known is None or label[0] < known[0]:
                    heappush(heap, (label[0], to[0] if forward else -to[0], to[1]))
    return best


def _apply(rows: list[tuple[str, int, int]], says: list[tuple[int | None, str, str]], audit: str, q: int) -> Iterator[tuple[int | None, str, str]]:
    """The (turn, role, text) that an audit leaves, from state q on; inserted ones have no turn."""
    at = left = 0
    for letter in audit:
        if letter == "I":
            q = _NEXT[q]
            yield None, _ROLE[q], ""
            continue
        if not left:
            left = rows[at][2]
            at += 1
        left -= 1
        turn, role, text = says[at - 1]
        if letter == "K":
            q = _STEP[q, rows[at - 1][0]]
            yield turn, role, text
        elif letter == "R":
            q = _NEXT[q]
            yield turn, _ROLE[q], text


class _Digest:
    """SHA-256 of ``role:text`` lines, fed one by one."""

    def __init__(self) -> None:
        self._sum, self._any = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[int | None, str, str]]) -> None:
        for _, role, text in turns:
            self._sum.update(f"{chr(10) if self._any else ''}{role}:{text}".encode())
            self._any = True

    def hex(self) -> str:
        return self._sum.hexdigest()


_STATS = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long"
_PIECE = f"conv_id long, at long, closed boolean, {_STATS}, costs array<long>, audits array<string>, sha256 string, initials array<string>, faults array<int>, copies array<long>, turn array<long>, role array<string>, text array<string>"
_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


def _stats(rows: list[tuple[str, int, int]], says: list[tuple[int | None, str, str]]) -> dict:
    counts, illegal, last, first, turns = [0] * 4, 0, "", "", []
    for (initial, fault, copies), (turn, _, _) in zip(rows, says):
        counts[fault] += 1
        counts[BLANK if fault == BLANK else DUPLICATE] += copies - 1
        illegal += copies - 1 + (bool(first) and last + initial not in _LEGAL)
        first, last = first or initial, initial
        if turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
    return {"rows": sum(counts), "blank": counts[BLANK], "duplicate": counts[DUPLICATE], "truncated": counts[TRUNCATED], "illegal": illegal,
            "first": first, "last": last, "turns": len(turns), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}


def _gaps(stats: dict) -> int:
    return stats["high"] - stats["low"] + 1 - stats["turns"] if stats["turns"] else 0


def _joined(a: dict, b: dict) -> dict:
    """The figures of two neighbouring pieces as one."""
    if not (a["rows"] and b["rows"]):
        return b if b["rows"] else a
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in _LEGAL)
    out["turns"] = a["turns"] + b["turns"] - (bool(a["turns"] and b["turns"]) and a["high"] == b["low"])
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def _piece(conv: int | None, at: int, held: list[tuple], closed: bool, texts: bool) -> dict:
    """One piece: its figures, and the cheapest edits, whole or from each state to each state."""
    kept = [h for h in held if h[4]]
    rows, says = [(initial, fault, copies) for _, _, _, initial, copies, fault in kept], [h[:3] for h in kept]
    out = {"conv_id": conv, "at": at, "closed": closed} | _stats(rows, says)
    if closed:
        cost, audit = cheapest(rows)
        digest = _Digest()
        digest.add(_apply(rows, says, audit, 0))
        out |= {"costs": [cost], "audits": [audit], "sha256": digest.hex()}
    else:
        found = [cheapest(rows, s, (m,), tail=False) for s in range(4) for m in range(4)]
        out |= {"costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found], "sha256": None}
    if texts or not closed:
        names = ("initials", "faults", "copies")
        out |= {k: [r[i] for r in rows] for i, k in enumerate(names)} | {k: [s[i] for s in says] for i, k in enumerate(("turn", "role", "text"))}
    else:
        out |= dict.fromkeys(("initials", "faults", "copies", "turn", "role", "text"))
    return out


def _arrow(rows: list[dict], names: list[str], types: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[n] for r in rows], types.field(n).type) for n in names], schema=types)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _batched(rows: Iterator[dict], ddl: str) -> Iterator[pa.RecordBatch]:
    """Record batches of at most a thousand rows or some eight million characters."""
    types, held, size = _schema(ddl), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, str) else sum(len(x) for x in v if isinstance(x, str)) if isinstance(v, list) else 0 for v in row.values())
        if len(held) >= 1000 or size > 1 << 23:
            yield _arrow(held, types.names, types)
            held, size = [], 0
    if held:
        yield _arrow(held, types.names, types)


def _cut(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[dict]:
    """Pieces of the sorted turns of a range. What the range begins or ends with may go on in its neighbours."""
    at = TaskContext.get().partitionId() << 33
    conv, held, size, begun_here, first = None, [], 0, False, True
    for batch in batches:
        ids, *rest = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for own, row in zip(ids, zip(*rest)):
            if first:
                conv, first = own, False
            elif own != conv or len(held) >= PIECE_ROWS or size >= PIECE_TEXT:
                yield _piece(conv, at, held, begun_here and own != conv, texts)
                at += 1
                conv, held, size, begun_here = own, [], 0, own != conv
            held.append(row)
            size += len(row[2])
    if held:
        yield _piece(conv, at, held, False, texts)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with faults, by crc32(``conv_id:turn``) % 20.

    0 drops a row (it stays with no copies, so that its conversation is known), 1 empties its text, 2 removes its
    ``.!?``, 3 repeats it, 4 sets the role to user. A null counts as one space. Rows that repeat all columns stay as often.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told[2].alias("role"), told[3].alias("text"),
                                (F.crc32(F.concat_ws(":", *told[:2])) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _marked(turns: DataFrame) -> DataFrame:
    """Equal turns as one row, with the fault of its first copy."""
    flat = {"ck": F.col("conv_id").isNotNull(), "c0": F.coalesce("conv_id", F.lit(0)), "tk": F.col("turn").isNotNull(), "t0": F.coalesce("turn", F.lit(0))}
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns(flat)
    rows = stage(rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")}), "turns")
    first = rows.filter("copies > 0").groupBy("ck", "c0", "h1", "h2").agg(F.min(F.struct("tk", "t0")).alias("f"))
    first = first.select("ck", "c0", F.col("f.tk").alias("tk"), F.col("f.t0").alias("t0"), "h1", "h2", F.lit(True).alias("new"))
    rest: Column = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(rest == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.substring(rest, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    joined = rows.join(first, ["ck", "c0", "tk", "t0", "h1", "h2"], "left")
    return joined.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "copies", fault.cast("int").alias("fault"))


def _pieces(turns: DataFrame, texts: bool) -> DataFrame:
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1).cast("long"))
    marked = stage(_marked(turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))), "marked")
    ranges = max(shuffle_width(turns.sparkSession), -(-marked.count() // RANGE_ROWS))
    ordered = marked.repartitionByRange(ranges, "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(ordered.mapInArrow(lambda batches: _batched(_cut(batches, texts), _PIECE), _PIECE), "pieces")


def _rest_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pieces of each conversation from the last to the first: the cheapest rest from each state at its end."""

    def each() -> Iterator[dict]:
        begun, conv, rest = False, None, None
        for batch in batches:
            for known, own, at, costs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not begun or (known, own) != conv:
                    begun, conv, rest = True, (known, own), [_INSERT * len(c) for c in _CLOSING]
                yield {"at": at, "rest": rest}
                rest = [min(costs[4 * s + m] + rest[m] for m in range(4) if costs[4 * s + m] is not None) for s in range(4)]

    return _batched(each(), "at long, rest array<long>")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict, bool, str, Iterator]]:
    """(conversation, piece, whether it is the conversation's last, its audit, its repaired turns), in order.

    Of the exits that a cheapest whole passes, the one with the least audit is taken: audits of a piece to different
    states are never prefixes of each other, because nothing is inserted after its last row.
    """
    held, q = None, 0
    for batch in batches:
        for p in batch.to_pylist():
            if held is not None:
                last = (held["conv_id"] is None, held["conv_id"]) != (p["conv_id"] is None, p["conv_id"])
                q = yield from _one(held, q, last)
            held = p
    if held is not None:
        yield from _one(held, q, True)


def _one(p: dict, q: int, last: bool):
    ways = {m: p["costs"][4 * q + m] + p["rest"][m] for m in range(4) if p["costs"][4 * q + m] is not None}
    least = min(ways.values())
    audit, m = min((p["audits"][4 * q + m], m) for m, cost in ways.items() if cost == least)
    rows, says = list(zip(p["initials"], p["faults"], p["copies"])), list(zip(p["turn"], p["role"], p["text"]))
    if last:
        audit += _CLOSING[m]
    yield p, last, audit, _apply(rows, says, audit, q), p["costs"][4 * q + m] + (_INSERT * len(_CLOSING[m]) if last else 0)
    return 0 if last else m


def _chained_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        stats, audits, cost, digest = None, [], 0, _Digest()
        for p, last, audit, turns, own in _chained(batches):
            digest.add(turns)
            audits.append(audit)
            cost += own
            stats = p if stats is None else _joined(stats, p)
            if last:
                told = {k: stats[k] for k in ("blank", "duplicate", "truncated", "illegal")}
                yield {"conv_id": p["conv_id"], "gaps": _gaps(stats), "cost": cost, "audit": "".join(audits), "repaired_sha256": digest.hex()} | told
                stats, audits, cost, digest = None, [], 0, _Digest()

    return _batched(each(), _REPORT)


_TURN = "conv_id long, place long, turn long, role string, text string"


def _turn_rows(conv: int | None, place: int, turns: Iterator) -> Iterator[dict]:
    for place, (turn, role, text) in enumerate(turns, place):
        yield {"conv_id": conv, "place": place, "turn": turn, "role": role, "text": text}


def _closed_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        for batch in batches:
            for p in batch.to_pylist():
                rows, says = list(zip(p["initials"], p["faults"], p["copies"])), list(zip(p["turn"], p["role"], p["text"]))
                yield from _turn_rows(p["conv_id"], 0, _apply(rows, says, p["audits"][0], 0))

    return _batched(each(), _TURN)


def _chained_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        place = 0
        for p, last, _, turns, _ in _chained(batches):
            for row in _turn_rows(p["conv_id"], place, turns):
                place = row["place"] + 1
                yield row
            place = 0 if last else place

    return _batched(each(), _TURN)


def _in_order(pieces: DataFrame) -> DataFrame:
    """The open pieces, each conversation's in one place and in order, with the cheapest rest after each."""
    opened = pieces.filter("NOT closed").withColumn("known", F.col("conv_id").isNotNull())
    light = opened.select("known", "conv_id", "at", "costs").repartition("known", "conv_id").sortWithinPartitions("known", "conv_id", F.desc("at"))
    rest = light.mapInArrow(_rest_costs, "at long, rest array<long>")
    return opened.join(rest, "at").repartition("known", "conv_id").sortWithinPartitions("known", "conv_id", "at")


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``turns`` has conv_id, turn, role, text, and may have ``copies``: how often a row stands there (0: not at all, but its
    conversation is known). The rows of a conversation are taken by turn (null first), role and text. A row's first fault
    counts: blank (nothing but white space), duplicate (role and text seen earlier), truncated (no ``.!?`` at the end).
    ``illegal`` counts neighbours whose role initials are not su, ua or au; ``gaps`` the turn numbers that are missing.

    Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only edit of blank and duplicate rows), Insert of an empty
    user or assistant turn anywhere 2; a truncated row that stays adds 1. The audit has the initials of the cheapest
    edits that make the role initials match ``(s?(ua)+)?``, the ASCII-least among equals; it fixes the repaired turns, as
    only one role fits at each place. ``repaired_sha256`` is of their ``role:text`` lines.

    Method. Equal rows are one with a number of copies. The rows are cut into ranges by (conversation, turn, role, text)
    and sorted; in each, a conversation is searched by ``cheapest``. One that lies across ranges, or has more than 1,024
    rows or 4 million characters, is searched in pieces from each grammar state to each, and the pieces are chained:
    costs from the last to the first, then the least audits from the first on, streamed through one task per
    conversation with one piece in memory, because its checksum runs over its turns in order.

    A null conv_id is one conversation with a null id; a null role or text is one space; a role that is empty or starts
    with another letter fits nowhere and is reroled or deleted. Rows that repeat are duplicates. A conversation without
    rows has zeros, an empty audit and the checksum of nothing; an empty table gives an empty result. Other columns are not read.
    """
    pieces = _pieces(turns, texts=False)
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    whole = pieces.filter("closed").select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("sha256").alias("repaired_sha256"))
    return whole.unionByName(_in_order(pieces).drop("known", "sha256", "closed").mapInArrow(_chained_reports, _REPORT))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text): the repaired conversations; inserted turns have no turn number. See ``repair_report``."""
    pieces = _pieces(turns, texts=True)
    return pieces.filter("closed").mapInArrow(_closed_turns, _TURN).unionByName(_in_order(pieces).drop("known").mapInArrow(_chained_turns, _TURN))
