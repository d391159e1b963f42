"""Repair of conversations against exhaustive search and a plain single-threaded report."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from stylematch.llm import repair
from stylematch.llm.queries import QUERIES

GRAMMAR = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
BLANK, FINE = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def fault(text, seen):
    if not BLANK.search(text):
        return "blank"
    return "duplicate" if seen else None if FINE.search(text) else "truncated"


def search(rows):
    """Least (cost, audit, repaired turns) of rows (role, text, fault), by uniform-cost search over whole audits."""
    heap, least = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        if least.setdefault((at, last), (cost, audit)) < (cost, audit):
            continue
        for role in ("user", "assistant"):
            if (last, role[0]) in GRAMMAR:
                heapq.heappush(heap, (cost + 2, audit + "I", at, role[0], (*out, f"{role}:")))
        if at < len(rows):
            own, text, wrong = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, last, out))
            if wrong not in ("blank", "duplicate"):
                more = int(wrong == "truncated")
                if (last, own[:1]) in GRAMMAR:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, own[:1], (*out, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if (last, role[0]) in GRAMMAR:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, role[0], (*out, f"{role}:{text}")))


def report(rows, damaged=True):
    """What the operator must return, conversation by conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20 if damaged else 9
        held = convs.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", told[3]) if kind == 2 else told[3]
        held += [(turn, "user" if kind == 4 else told[2], text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in held:
            marked.append((role, text, fault(text, (role, text) in seen)))
            seen.add((role, text))
        turns = {t for t, _, _ in held if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, repaired = search(marked)
        counts = [sum(m[2] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def told(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, fault int")


def random_rows(rng, convs, roles=("user", "assistant", "system", "tool", None, " ")):
    texts = ["yes.", "no", "why?", "", " \n", None, "a!\t", "é.", "e"]
    return [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in convs for _ in range(rng.randrange(1, 9))]


def test_search_finds_the_least_of_the_cheapest():
    rng = random.Random(12)
    kinds = [None, "blank", "duplicate", "truncated"]
    for _ in range(1500):
        rows = [(rng.choice("suaux"), rng.randrange(4)) for _ in range(rng.randrange(8))]
        cost, audit, _ = search([(role, str(i), kinds[f]) for i, (role, f) in enumerate(rows)])
        assert repair.cheapest([(role, f, 1) for role, f in rows]) == (cost, audit)


def test_copies_count_as_duplicates():
    for copies in (2, 3):
        whole = repair.cheapest([("u", repair.FINE, copies), ("a", repair.TRUNCATED, 1)])
        assert whole == (3 * (copies - 1) + 1, "K" + "D" * (copies - 1) + "K")


def test_damaged_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op12_conversation_repair"](spark, sf)) == report(rows)


@pytest.mark.parametrize("damaged", [True, False])
def test_odd_rows(spark, damaged):
    rng = random.Random(3)
    rows = random_rows(rng, [None, *range(60)])
    rows += [(100, 5, "user", "same.")] * 40 + [(101, None, None, None)] * 3
    df = table(spark, rows)
    assert told(repair.repair_report(repair.damage(df) if damaged else df)) == report(rows, damaged)


def test_all_rows_dropped(spark):
    gone = [(c, 0, "user", "a.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone
    got = told(repair.repair_report(repair.damage(table(spark, gone))))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in gone}
    assert repair.repair_report(repair.damage(table(spark, []))).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_long_conversations_in_pieces(spark, monkeypatch, piece):
    """Chained pieces give what a search over the whole conversation gives, wherever they are cut."""
    monkeypatch.setattr(repair, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "x"]), rng.choice(["a.", "b", f"{t}!", " "])) for c in (None, 1, 2) for t in range(150) if t % 7]
    assert told(repair.repair_report(repair.damage(table(spark, rows)))) == report(rows)


def test_hot_conversation_is_spread(spark, monkeypatch):
    """Half of the rows without an id: no piece holds more than its share, and the repaired turns are whole."""
    monkeypatch.setattr(repair, "PIECE_ROWS", 500)
    rows = [(None, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(6000)] + [(c, 0, "user", "a.") for c in range(6000)]
    df = table(spark, rows)
    pieces = repair._pieces(df, texts=False)
    assert pieces.agg(F.max("rows")).first()[0] <= 500 and pieces.filter("conv_id IS NULL").select(F.shiftright("at", 33)).distinct().count() > 1
    got = told(repair.repair_report(df))
    assert got[None][5:7] == (0, "K" * 6000) and got[7][5:7] == (2, "KI")
    turns = repair.repaired_turns(df)
    lines = [f"{r.role}:{r.text}" for r in turns.filter("conv_id IS NULL").orderBy("place").collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[None][7]
    assert [(r.turn, r.role, r.text) for r in turns.filter("conv_id = 7").orderBy("place").collect()] == [(0, "user", "a."), (None, "assistant", "")]
