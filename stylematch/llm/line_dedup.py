"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylematch.llm.rarity import by_rarity, rarity_table, sieved
from stylematch.session import discard, release, stage

#: Cells of the table that orders tokens by rarity: a byte each.
CELLS = 1 << 18
_ODD_BLANKS = "\t\x0b\x0c\r"


def _doc_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and a key of both: rows with equal ids and texts are one document."""
    rows = docs.withColumns({"_id": docs[id_col].cast("long"), "_text": F.coalesce(docs[text_col].cast("string"), F.lit(""))})
    return rows.withColumn("_doc", F.xxhash64("_id", "_text"))


def _plain(text: Column) -> Column:
    """The text in lower case with spaces as its only blanks; the slow translation runs only where it is needed."""
    odd = F.lit(False)
    for blank in _ODD_BLANKS:
        odd = odd | text.contains(blank)
    return F.lower(F.when(odd, F.translate(text, _ODD_BLANKS, "    ")).otherwise(text))


def _split_lines(docs: DataFrame) -> DataFrame:
    """(_id, _doc, line_no, line): the lines of each text, as ``_plain`` gives them."""
    return docs.select("_id", "_doc", F.posexplode(F.split(_plain(F.col("_text")), "\n")).alias("line_no", "line"))


def _tokens(line: Column) -> Column:
    """The distinct hashed words of a line."""
    hashed = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def _rarity(docs: DataFrame, cells: int) -> Column:
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("_text")), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    return rarity_table(words.select(F.xxhash64("word").alias("token")), cells)


def _parity(tokens: Column, half: int) -> Column:
    """Half of 128 bits that each token flips one of: two sets differ in at least as many tokens as bits."""
    def flipped(t: Column) -> Column:
        own = F.shiftright(t, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(1 - half)).cast("long")
        return F.call_function("shiftleft", own, t.bitwiseAND(F.lit(63)).cast("int"))

    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(flipped(t)))


def similar_line_sets(docs: DataFrame, cells: int = CELLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and their sets: (_id, _doc, line_no, k), and (k, doc, line, late) for the sets with copies or a match; and the
    stage table that the latter read.

    ``doc`` and ``line`` are the place of the set's first line, ``late`` is whether an earlier set is similar. ``docs``
    comes from ``_doc_key``. See ``drop_similar_lines``.
    """
    # a filter on the tokens would go below them and compute them twice
    ranked = _split_lines(docs).filter(F.trim("line") != "").withColumn("tokens", _tokens(F.col("line"))).withColumn("ranks", _rarity(docs, cells))
    ranked = ranked.select("_id", "_doc", "line_no", by_rarity(F.col("tokens"), F.col("ranks"), cells).alias("t"))
    prefix = F.transform(F.expr("slice(t, 1, size(t) - CAST(ceil(size(t) * 3 / 4) AS INT) + 1)"), lambda t: F.hash(t))
    full = stage(ranked.select(
        "_id", "_doc", "line_no", F.size("t").alias("n"), F.xxhash64("t").alias("k"), _parity(F.col("t"), 0).alias("p0"), _parity(F.col("t"), 1).alias("p1"), prefix.alias("prefix")), "full-lines")

    order = F.struct(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("id"), F.col("_doc").alias("doc"), F.col("line_no").alias("line"))
    sets = full.groupBy("k").agg(F.min(F.struct(order.alias("at"), "n", "p0", "p1", "prefix")).alias("s"), F.count("*").alias("copies"))
    # numbered in the order of their first lines: a smaller number is an earlier set
    sets = stage(sets.select("k", "s.*", "copies").orderBy("at").withColumn("set", F.monotonically_increasing_id()), "sets")
    lines = stage(full.select("_id", "_doc", "line_no", "k"), "lines")
    discard(full)
    release(docs.sparkSession)

    stars = stage(_stars(sets), "stars")
    release(docs.sparkSession)
    settled = _similar(docs, sets, stars)
    discard(stars)
    release(docs.sparkSession)
    pairs = stage(_meetings(sets, settled.select(F.col("b").alias("set")).distinct()).distinct(), "pairs")
    release(docs.sparkSession)
    similar = settled.unionByName(_similar(docs, sets, pairs))
    discard(pairs)
    release(docs.sparkSession)
    late = similar.select(F.col("b").alias("set")).distinct().withColumn("late", F.lit(True))
    marked = sets.select("set", "k", "at", "copies").join(late, "set", "left").filter("copies > 1 OR late")
    return lines, marked.select("k", F.col("at.doc").alias("doc"), F.col("at.line").alias("line"), F.coalesce("late", F.lit(False)).alias("late")), sets


_OVERLAP = "CAST(ceil((n + m) * 3 / 7) AS INT)"
_NEAR = f"4 * least(n, m) >= 3 * greatest(n, m) AND bit_count(p0 ^ q0) + bit_count(p1 ^ q1) <= n + m - 2 * {_OVERLAP}"


def _stars(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the earliest set and another one among those that share one of four tokens, if they may match.

    The tokens are the two least and the two greatest hashes of a prefix, which variants of a line have in common. In a
    large family of variants nearly every set thus meets an earlier one without the pairs of the family being listed.
    """
    ordered = F.sort_array("prefix")
    keyed = sets.select("set", "n", "p0", "p1", F.explode(F.array_distinct(F.concat(F.slice(ordered, 1, 2), F.slice(F.reverse(ordered), 1, 2)))).alias("token"))
    first = keyed.groupBy("token").agg(F.min(F.struct("set", "n", "p0", "p1")).alias("f"), F.count("*").alias("size")).filter("size > 1")
    first = first.select("token", F.col("f.set").alias("a"), F.col("f.n").alias("m"), F.col("f.p0").alias("q0"), F.col("f.p1").alias("q1"))
    met = keyed.join(first, "token").filter(f"a < set AND {_NEAR}")
    return met.select("a", F.col("set").alias("b")).distinct()


def _meetings(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs (a, b) that may match, a before b, where b is not one of the ``settled`` sets: once for every run of common tokens."""
    marked = sets.select("set", "n", "p0", "p1", "prefix").join(settled.withColumn("_named", F.lit(1)), "set", "left")
    # n, the place in the prefix and whether it is wanted share a number, as do the token and the one before it: a
    # posting is as narrow as can be
    at = F.col("n").cast("long") * (1 << 32) + F.col("i") * 2 + F.col("_named").isNull().cast("int")
    before = F.when(F.col("i") > 0, F.get("prefix", F.col("i") - 1)).otherwise(0).cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    both = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(before)
    posted = marked.select("set", "n", "p0", "p1", "prefix", "_named", F.posexplode("prefix").alias("i", "token"))
    posted = posted.select(both.alias("tokens"), "set", at.alias("at"), "p0", "p1")
    one = "shiftright({0}.at, 32)"
    place = "shiftright({0}.at & 4294967295L, 1)"
    n, m, i, j = one.format("x"), one.format("y"), place.format("x"), place.format("y")
    overlap = f"ceil(({n} + {m}) * 3 / 7)"
    # Both sides are the same rows and no condition is on one side alone, so they are shuffled once; that the smaller set
    # needs fewer tokens follows from the overlap. Where the tokens before are equal too, the pair has met under them.
    met = posted.alias("x").join(posted.alias("y"), F.expr(
        f"shiftright(x.tokens, 32) = shiftright(y.tokens, 32) AND IF(x.set < y.set, y.at & 1L, 0L) = 1 AND (x.tokens <> y.tokens OR least({i}, {j}) = 0) "
        f"AND least({n} - {i}, {m} - {j}) >= {overlap} AND 4 * least({n}, {m}) >= 3 * greatest({n}, {m}) "
        f"AND bit_count(x.p0 ^ y.p0) + bit_count(x.p1 ^ y.p1) <= {n} + {m} - 2 * {overlap}"))
    return met.select(F.col("x.set").alias("a"), F.col("y.set").alias("b"))


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose whole sets, read from the texts again, have a Jaccard similarity of 0.75 or more."""
    asked = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    where = stage(sets.select("set", "at").join(asked, "set").select("set", F.col("at.doc").alias("_doc"), F.col("at.line").alias("line_no")), "asked")
    # texts meet the list of their places: only the lines that are asked for are moved again
    wanted = where.groupBy("_doc").agg(F.collect_list(F.struct("line_no", "set")).alias("wanted"))
    texts = docs.select("_doc", "_text").filter(sieved(where, "_doc")).join(wanted, "_doc")
    full = texts.select(F.split(_plain(F.col("_text")), "\n").alias("lines"), F.explode("wanted").alias("w"))
    # rows that repeat a document give its lines again: one of each is taken
    full = full.select("w.set", F.get("lines", F.col("w.line_no")).alias("line")).groupBy("set").agg(F.first("line").alias("line"))
    full = stage(full.select("set", _tokens(F.col("line")).alias("tokens")), "full")
    one = full.select(F.col("set").alias("a"), F.col("tokens").alias("x"))
    two = full.select(F.col("set").alias("b"), F.col("tokens").alias("y"))
    common = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("common"))
    similar = stage(common.filter("4 * common >= 3 * (both - common)").select("a", "b"), "similar")
    discard(where)
    discard(full)
    return similar


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: str | None = None, cells: int = CELLS) -> DataFrame:
    """The documents without the lines that repeat an earlier line, exactly or nearly.

    A line is the set of its words, lower-cased and parted by white space. Two lines match if the Jaccard similarity of
    their sets is 0.75 or more; a line goes if any earlier line matches it, whether that one stays or not. Earlier is
    by id (null last), then by place in the text. Lines without words always stay. Rows that repeat id and text count
    as one document and get the same result; rows that share only the id are ordered by a hash. A null text stays null,
    an empty one empty; a document whose lines all go keeps an empty text. An empty table gives an empty result. All
    columns of ``docs`` are kept, whatever their names; with ``count``, a column of that name tells how many lines went.

    Method. Equal sets are one set, at the place of their first line. Tokens are ordered by rarity: by the logarithm of
    the count of their cell in a table of hashed words over all documents, then by hash. A set of n tokens is posted
    under its first n - ceil(3n/4) + 1 tokens.
    Postings meet under the length filter (4m >= 3n), the positional filter (from the first common token on both
    must have as many left as the overlap asked for) and a bound on how many tokens differ, from 128 bits that each token flips one of; the pairs
    are verified on whole sets. Before that, sets that meet an earlier one under four of their tokens (``_stars``) are
    settled if a verified pair holds them, so that a large family of variants is not paired with itself; only the others are
    searched. A pair is listed where its first common tokens meet, not under every later one of a common run. Any order of tokens gives the exact result; the table only makes the postings short. It
    has ``cells`` bytes, whatever the input, and reaches each task with the plan.
    """
    names = docs.columns
    # by place, so that no column name of the input can meet one of the work columns
    docs = docs.toDF(*(f"in{i}" for i in range(len(names))))
    text_in = f"in{names.index(text_col)}"
    keyed = _doc_key(docs, f"in{names.index(id_col)}", text_in)
    lines, sets, staged = similar_line_sets(keyed.select("_id", "_text", "_doc"), cells)
    gone = lines.join(sets, "k").filter("late OR NOT (doc <=> _doc AND line <=> line_no)")
    gone = gone.groupBy("_doc").agg(F.collect_set("line_no").alias("_gone"))
    gone = stage(gone.withColumnRenamed("_doc", "_of"), "gone")
    for done in (lines, staged):
        discard(done)
    release(docs.sparkSession)
    # a text is moved once, without its form for nulls
    joined = keyed.drop("_text").join(gone, F.col("_doc") == F.col("_of"), "left")
    parts = F.split(F.coalesce(F.col(text_in).cast("string"), F.lit("")), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone"), lambda i: F.get(parts, i))
    text = F.when(F.col("_gone").isNull(), F.col(text_in)).otherwise(F.array_join(kept, "\n"))
    joined = joined.withColumn("_kept", text)
    out = [F.col("_kept" if c == text_col else f"in{i}").alias(c) for i, c in enumerate(names)]
    if count:
        out.append(F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(count))
    return joined.select(*out)
