"""Secrets in texts: fixed patterns, and strings that zstandard cannot shorten with their surroundings as dictionary."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
#: Least length of the matched value (assign) or of the whole match (access, hex).
LEAST = {"assign": 12, "access": 18, "hex": 16}
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|pwd|auth|bearer|credential|private|signature|session|cookie|access", re.I | re.ASCII)

# Words that names and settings in code are made of.
IDENTIFIERS = (
    "access account admin address algorithm allow amount api app application args array assert async attribute auth author "
    "authorization await base64 bearer boolean bucket buffer build bytes cache callback certificate char class client code "
    "collection column command comment commit config configuration connection const constructor container content context "
    "cookie count create credential current database dataframe date debug decode default define delete description dict "
    "directory disable document domain double element email enable encode endpoint enum environment error event exception "
    "export extends false field file filter final float format function global group handler hash header hostname http https "
    "identifier implements import include index init input instance int integer interface internal iterator json key lambda "
    "length level library license limit list local localhost logger login long main manager map message metadata method model "
    "module name namespace null number object offset operator option order output override package parameter parent parse "
    "passphrase password path pattern payload permission pointer policy port prefix primary private process project property "
    "protected protocol provider proxy public query random range read record reference refresh region register release remote "
    "request require resource response result return role root route row schema scope script secret section select self "
    "sequence server service session setting setup signature size socket source static status stream string struct style "
    "system table target task template test text thread time timeout timestamp title token transaction true type uint unit "
    "update upload uri url user username uuid validate value variable vector version view void volatile warning while window "
    "worker workspace write xml yaml"
)

HEX_BYTES = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets of keys, the smallest first.
ALPHABETS = sorted((DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", LOWER + "234567", LOWER, UPPER, LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER, LOWER + UPPER + DIGITS), key=len)
LETTERS_OF_WORDS = re.compile(r"[^a-z]+")
PAIRS = Counter(zip(f" {IDENTIFIERS}", f"{IDENTIFIERS} "))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns: whole matches, leftmost and non-overlapping per kind."""
    raw = text.encode()
    lower = raw.lower()
    found = []
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def marginal_ratio(value: str, around: str, level: int = 3) -> float:
    """Bytes that the value adds to a frame primed with the identifiers and its surroundings, per byte of the value.

    About 1 for random strings, well below for words, names made of words, repeats, and copies of what stands nearby.
    """
    primer = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + around).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=level, dict_data=primer, write_checksum=False, write_content_size=False)
    raw = value.encode()
    return (len(packer.compress(raw)) - len(packer.compress(b""))) / len(raw)


@lru_cache(4096)
def random_ratio(alphabet: str, length: int) -> float:
    """The least marginal ratio of a few random strings of an alphabet: from 64 characters on, zstandard codes small alphabets."""
    made = random.Random(f"{alphabet} {length}")
    return min(marginal_ratio("".join(made.choices(alphabet, k=length)), "") for _ in range(3))


def least_ratio(value: str, least: float) -> float:
    """The ratio from which a string counts as random: ``least``, or nine tenths of what random strings like it have."""
    used = {c for c in value if c.isalnum()}
    alphabet = next((a for a in ALPHABETS if used.issubset(a)), ALPHABETS[-1])
    return least if len(value) < 64 else min(least, 0.9 * random_ratio(alphabet, len(value)))


def wordlike(value: str, around: str) -> bool:
    """Whether the letter pairs of the identifiers and the surroundings code the string better than even chances do."""
    around = LETTERS_OF_WORDS.sub(" ", around.lower())
    near = Counter(zip(around, around[1:]))
    heads = Counter()
    for pairs in (PAIRS, near):
        for (a, _), n in pairs.items():
            heads[a] += n
    text = f" {LETTERS_OF_WORDS.sub(' ', value.lower()).strip()} "
    bits = sum(math.log2((heads[a] + 13.5) / (PAIRS[a, b] + near[a, b] + 0.5)) for a, b in zip(text, text[1:]))
    return bits < math.log2(26) * (len(text) - 1)


def novel_spans(text: str, known: list[tuple[int, int, int]], reach: int = 48, around: int = 600, least: float = 0.8) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, ratio) of incompressible strings in a sensitive context.

    A candidate has 16 or more of A-Z a-z 0-9 + / _ = -, with a letter among them, no overlap with a known span, and
    a word such as key, token or auth within the ``reach`` characters before it. Its dictionary is the ``around``
    characters on both sides, without copies of the candidate, and the identifier words. Without a digit it must not
    read like words either. Strings of 64 characters or more are held against random strings of their alphabet.
    """
    found = []
    taken = sorted((start, end) for start, _, end in known)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in CANDIDATE.finditer(text):
        value, start, end = m[0], m.start(), m.end()
        if not any(c.isalpha() for c in value):
            continue
        before = bisect_left(starts, end)
        if before and ends[before - 1] > start or not SENSITIVE.search(text, max(0, start - reach), start):
            continue
        near = (text[max(0, start - around):start] + " " + text[end:end + around]).replace(value, " ")
        ratio = marginal_ratio(value, near)
        if ratio >= least_ratio(value, least) and (any(c.isdigit() for c in value) or not wordlike(value, near)):
            found.append((start, 3, end, ratio))
    return found


SPANS = "array<struct<kind:string,start:int,end:int,value:string,ratio:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("ratio", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            spans = [(*s, None) for s in base] + novel_spans(text, base)
            rows.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b], "ratio": r} for a, k, b, r in sorted(spans, key=lambda s: s[:3])])
        yield pa.record_batch([batch.column(0), pa.array(rows, _SPANS)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: the secrets of its whole text by start, then kind as listed in ``KINDS``.

    Kinds assign, access and hex are fixed patterns. Kind novel is a string in a sensitive context whose marginal
    zstandard size, with the surrounding text and an identifier list as dictionary, is close to its length, or from 64
    characters on to that of random strings of its alphabet; ``ratio`` is that size per byte. Offsets are code points, end exclusive. A null or empty text has no spans; rows with a null
    or repeated id are scanned like any other; an empty table gives an empty result. Other columns are not read. One
    pass without a shuffle; a text is held whole, one at a time.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, spans {SPANS}")
