"""First entries of ranked lists that each seeker allows, without pairing seekers with whole lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch.operators.filters import disliked
from stylematch.session import stage

#: Entries of a list that a first round looks at, the growth from round to round, and the most that a round looks at.
WINDOW, GROWTH, WIDEST = 64, 4, 1024


@dataclass
class Ranking:
    """A ranked list per key: ``rows(keys, last)`` gives its entries up to place ``last`` as (key, pos, tags, entry).

    ``keys`` are the distinct keys asked for, or None for all. The first ``k`` entries without an excluded tag are wanted.
    ``entry`` is the type of an entry.
    """

    key: list[str]
    rows: Callable[[DataFrame | None, int], DataFrame]
    entry: str
    k: int = 1


def _windows():
    first, size = 0, WINDOW
    while True:
        yield first, first + size
        first, size = first + size, min(size * GROWTH, WIDEST)


def first_allowed(seekers: DataFrame, rankings: dict[str, Ranking], excluded: str = "dislikes") -> DataFrame:
    """``seekers`` with an array column per ranking: its first k entries none of whose tags the seeker excludes.

    In rounds: every seeker is given a window of its lists and filters it in place; only those that did not find
    enough in a list that goes on enter the next round, with the next window. A list is ranked once for all seekers
    of its key, so what is paired is keys with entries; a seeker meets one row per list and round, whatever it excludes.
    The state between rounds is a staged table. A seeker finds fewer entries where its list ends.
    """
    columns = seekers.columns
    state = seekers.withColumns({n: F.array().cast(f"array<{r.entry}>") for n, r in rankings.items()})
    state = state.withColumns({f"_ends_{n}": F.lit(False) for n in rankings})
    finished = None
    for number, (first, last) in enumerate(_windows()):
        before = state
        for name, r in rankings.items():
            keys = None if number == 0 else before.filter(_lacks(name, r)).select(*r.key).distinct()
            ranked = r.rows(keys, last).filter(F.col("pos") > first)
            listed = ranked.groupBy(*r.key).agg(F.sort_array(F.collect_list(F.struct("pos", "tags", "entry"))).alias(f"_list_{name}"))
            allowed = F.filter(F.col(f"_list_{name}"), lambda x: ~disliked(x["tags"], F.col(excluded)))
            more = F.transform(F.slice(allowed, F.lit(1), F.greatest(F.lit(0), F.lit(r.k) - F.size(name))), lambda x: x["entry"])
            held = F.coalesce(F.size(f"_list_{name}"), F.lit(0))
            state = state.join(listed, r.key, "left").withColumns({
                name: F.when(_lacks(name, r) & F.col(f"_list_{name}").isNotNull(), F.concat(name, more)).otherwise(F.col(name)),
                f"_ends_{name}": F.col(f"_ends_{name}") | (held < last - first),
            }).drop(f"_list_{name}")
        state = stage(state, "seekers")
        open_ = F.lit(False)
        for name, r in rankings.items():
            open_ = open_ | _lacks(name, r)
        done = state.filter(~open_).select(*columns, *rankings)
        finished = done if finished is None else finished.unionByName(done)
        state = state.filter(open_)
        if state.isEmpty():
            return finished


def _lacks(name: str, r: Ranking) -> Column:
    return (F.size(name) < r.k) & ~F.col(f"_ends_{name}")
