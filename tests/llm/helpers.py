"""Plain single-threaded forms of the operators, for small tables."""

import re
from collections import Counter, defaultdict
from math import ceil  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size=5):
    words = WORD.findall(fold(text))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def near_groups(docs):
    """{row number: (set size, least id of the group)} by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(docs)]


def deduped_lines(docs):
    """{(id, text): text without lines that match an earlier line}, by comparing all lines."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = [], {}
    for d, text in order:
        kept = []
        for line in (text or "").split("\n"):
            words = frozenset(w for w in re.split(r"[ \t\x0b\x0c\r]+", line.lower()) if w)
            if not words or not any(4 * len(words & s) >= 3 * len(words | s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[d, text] = None if text is None else "\n".join(kept)
    return out


def maximal(rows):
    """Conversations that are not the first turns of another: {least id: (turns, copies)}."""
    held = defaultdict(set)
    for conv, turn, role, text in rows:
        held[conv].add((turn, role or "", text or ""))
    whole = {c: tuple((r, t) for _, r, t in sorted(v)) for c, v in held.items()}
    copies = Counter(whole.values())
    out = {}
    for conv, turns in sorted(whole.items()):
        if any(o != turns and o[:len(turns)] == turns for o in whole.values()):
            continue
        if turns not in [whole[c] for c in out]:
            out[conv] = (len(turns), copies[turns])
    return out
