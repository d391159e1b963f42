"""An order of hashed tokens by rarity that needs no join: a table of fixed size over hash cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch.session import stage

_LOW = (1 << 57) - 1
#: Bits of the table of ``sieved``.
SIEVE = 1 << 24


def rarity_table(tokens: DataFrame, cells: int) -> Column:
    """An array with a number per cell: 0 for an empty cell, else 1 + twice the log2 of how many rows of ``token`` fall in it.

    The numbers stand in the upper seven bits. ``cells`` is a power of two; the table has that many entries, whatever
    the input.
    """
    counts = tokens.groupBy(F.col("token").bitwiseAND(F.lit(cells - 1)).alias("cell")).agg(F.count("*").alias("n"))
    ranks = counts.select("cell", F.shiftleft(F.least(F.lit(62), F.floor(1 + 2 * F.log2("n"))).cast("long"), 57).alias("rank"))
    every = tokens.sparkSession.range(cells).join(ranks, F.col("id") == F.col("cell"), "left").select("id", F.coalesce("rank", F.lit(0).cast("long")).alias("rank"))
    listed = stage(every, "rarity").agg(F.array_sort(F.collect_list(F.struct("id", "rank"))).alias("cells"))
    return listed.select(F.transform("cells", lambda c: c["rank"])).scalar()


def by_rarity(tokens: Column, ranks: Column, cells: int) -> Column:
    """The tokens from rare to frequent, ties by hash: the rank of the cell stands in the upper bits, the hash in the lower 57."""

    def placed(t: Column) -> Column:
        # never null, as arrays that cannot hold nulls are sorted as plain numbers
        return F.coalesce(F.get(ranks, t.bitwiseAND(F.lit(cells - 1)).cast("int")), F.lit(0).cast("long")).bitwiseOR(t.bitwiseAND(F.lit(_LOW)))

    return F.sort_array(F.transform(tokens, placed))


def sieved(keys: DataFrame, column: str) -> Column:
    """A condition on rows with a column of the same name: false only for values that ``keys`` does not hold.

    For a join whose other side is wide and mostly unmatched: what goes here is not shuffled. A hashed value looks up its
    bit in a table of fixed size; with more keys more rows pass, and the join still decides.
    """
    hashed = F.pmod(F.xxhash64(column), F.lit(SIEVE))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("cell", F.lit(64)).cast("int"))
    words = keys.select(hashed.alias("cell")).groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(SIEVE // 64).join(words, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    listed = stage(every, "sieve").agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("table"))
    table = listed.select(F.transform("table", lambda w: w["bits"])).scalar()
    word = F.get(table, F.floor(hashed / 64).cast("int"))
    return F.call_function("shiftright", word, F.pmod(hashed, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
