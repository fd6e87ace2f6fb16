"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions alone.

A document's copies are proportional to its worth and, over a source, add up to the source's target in words; worths that
would need more than the most copies stop there and the others of the source take the excess. Whole copies are certain. The
rest is an inclusion probability p, drawn without replacement: every document has a uniform number u from the hash of its
id, and those with the least ratio of odds, u/(1-u) over p/(1-p), are taken up to the words that the source still lacks. A
document that would go beyond them ends the round; in further rounds those that fit in what is missing are tried in the same
order, so that a long document at the edge leaves no large gap.

The edge is found by a histogram, so that no source, however large, is sorted in one task: only the rows of one of 65,536
buckets are. The ratio of odds is first set against the source's mean odds and mapped to (0, 1): where all odds are alike
that gives u itself, so that the buckets fill evenly however near p is to 0 or 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import HOT_ROWS, join_stats, materialise, placed

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 65_536
#: Worths are rounded to so many steps for each doubling, between 2**-LEVELS and 2**LEVELS: a source has a bounded number of levels.
STEPS, LEVELS = 32, 16
#: Inclusion probabilities nearer to 0 or 1 than this count as this.
NEAR = 1e-9


def _words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """How many runs of other characters than white space a text has; none if it is null."""
    return F.size(_words(text)).cast("long")


def diversity(text: Column) -> Column:
    """A document's worth by its vocabulary: the logarithm of its distinct words over that of all its words (1 for a text of one word or none), at least a quarter. Repetitive texts have low odds; length alone changes little."""
    found = _words(text)
    n = F.size(found)
    return F.when(n < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.25), F.log(F.size(F.array_distinct(found)).cast("double")) / F.log(n.cast("double"))))


def _level(worth: Column) -> Column:
    """The rounded logarithm of a worth; what is null, not positive or not a number counts as 1."""
    fine = worth.isNotNull() & ~F.isnan(worth) & (worth > 0)
    return F.coalesce(F.when(fine, F.greatest(F.lit(-LEVELS * STEPS), F.least(F.lit(LEVELS * STEPS), F.round(F.log2(worth) * STEPS).cast("int")))), F.lit(0))


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with place: the number, from 0, of each source by code point, null last. Sorted by ranges, so there is no limit to the number of sources."""
    parted = materialise(sizes.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    ahead = parted.groupBy("range").agg(F.count("*").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 8 rows
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return parted.withColumn("inside", inside).join(F.broadcast(ahead.select("range", "ahead")), "range").select(*sizes.columns, (F.col("ahead") + F.col("inside") - 1).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size; one row for each source) with target, the words that a source should give.

    Sources by code point, null last, have the weights in turn. Together they share total times all words; a source stops
    at most times its own, and the excess goes to the others by weight, again and again until none is above. Each turn is
    one aggregation, of whole numbers, so that its result doesn't hang on the order of rows.
    """
    place = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weighed = materialise(_numbered(sizes.select("source", "source_size")).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)), "mix-weights")
    every = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("source_size") * F.lit(float(most)) <= F.lit(level) * F.col("weight")
        row = weighed.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        if row["n"] == stopped or not row["rest"]:
            break
        stopped, level = row["n"], max(0.0, (every * total - row["held"] * most) / row["rest"])
    return weighed.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("weight")).alias("target"))


def _copies(levels: DataFrame, most: float) -> DataFrame:
    """levels (key, level, words, target) with copies: for each source min(most, c times the worth), c such that the words add up to the target. Sorted by worth, levels that stop come first, so one running sum finds where they end; a source has a bounded number of levels."""
    w = F.pow(F.lit(2.0), F.col("level") / F.lit(float(STEPS)))
    down = Window.partitionBy("key").orderBy(F.desc("level"))
    before, on = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    rated = levels.withColumn("w", w).withColumn("c", (F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("w") * F.col("words")).over(on))
    first = F.max(F.when(F.col("c") * F.col("w") <= F.lit(float(most)), F.struct("level", "c"))).over(Window.partitionBy("key"))["c"]
    return rated.withColumn("copies", F.least(F.lit(float(most)), F.coalesce(first * F.col("w"), F.lit(float(most))))).drop("w", "c")


def _round(state: DataFrame, hot_rows: int) -> DataFrame:
    """state after one round of taking documents in order while they fit in what their source lacks."""
    lack = state.groupBy("key").agg(F.count("*").alias("n"), (F.max("target") - F.sum(F.col("base") * F.col("size") + F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("lack"))
    met = join_stats(state, lack, "key", "n", "inner", hot_rows)
    able = ~F.col("drawn") & (F.col("p") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("lack"))
    ready = materialise(met.withColumn("able", able), "mix-round")
    bars = ready.filter("able").groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.max("lack").alias("lack"))
    so_far = bars.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")))
    edges = so_far.groupBy("key").agg(F.min(F.when(F.col("upto") > F.col("lack"), F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("lack"), F.col("upto"))), F.lit(0)).alias("before"))
    edges = edges.join(lack.select("key", "n"), "key")
    placed = join_stats(ready, edges, "key", "n", "left", hot_rows)
    here = F.col("able") & (F.col("bucket") == F.col("edge"))
    at_edge = placed.filter(here)
    running = F.sum("size").over(Window.partitionBy("key").orderBy("v", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0))
    at_edge = at_edge.withColumn("drawn", F.col("before") + running <= F.col("lack"))
    rest = placed.filter(~F.coalesce(here, F.lit(False))).withColumn("drawn", F.col("drawn") | (F.col("able") & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))))
    return materialise(rest.select(*state.columns).unionByName(at_edge.select(*state.columns)), "mix-state")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 17, worth: Column | None = None, rounds: int = 4, hot_rows: int = HOT_ROWS, row: Column | None = None
) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, p, copies, taken and, where it is given, row.

    Null texts have size 0, and documents without words have no copies. A null source is a source of its own. Rows that
    repeat are drawn each for itself. worth: a positive weight that a document's copies follow (null, not positive or none:
    1), rounded to a 32nd of a doubling; p is the part of its copies that is drawn. No document has more than most copies.
    The draw hangs on ids and seed, not on the order of rows.
    """
    marked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col).cast("string")).alias("size"), (worth.cast("double") if worth is not None else F.lit(1.0)).alias("worth"), (F.lit(None).cast("string") if row is None else row).alias("row")
    )
    marked = marked.withColumn("level", _level(F.col("worth"))).drop("worth").withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("cell", F.concat_ws("#", F.col("level").cast("string"), "key")).withColumn("tie", F.xxhash64("key", "size", "level"))
    marked = materialise(marked, "mix-sizes")
    held = materialise(marked.groupBy("cell", "key", "level", "source").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-levels")
    sources = held.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    goals = materialise(targets(sources.select("source", "source_size"), weights, total, most).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source"), "mix-sources")
    copies = _copies(held.filter("words > 0").join(goals, "key"), most).select("cell", "copies")
    rated = held.join(goals, "key").join(copies, "cell", "left").withColumn("copies", F.coalesce("copies", F.lit(0.0)))
    base = F.floor(F.col("copies") + 1e-12).cast("long")
    rated = rated.withColumn("base", base).withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - base))
    mean = Window.partitionBy("key")
    rated = rated.withColumn("mean", F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("n"))).over(mean) / F.sum(F.when(F.col("p") > 0, F.col("n"))).over(mean), F.lit(0.5)))
    rated = materialise(rated.select("cell", "n", "source_size", "target", "base", "p", "mean"), "mix-rated")
    joined = join_stats(marked, rated, "cell", "n", "inner", hot_rows)
    joined = joined.withColumn("base", F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0)))
    # a uniform number in (0, 1) from 52 bits of a hash; repeated rows have the same
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = lambda x: x / (1 - x)
    inside = lambda x: F.greatest(F.lit(NEAR), F.least(F.lit(1 - NEAR), x))
    # q / (1 + q) for the ratio of odds q times the mean odds: in the order of q, and u itself where p is the mean
    q = odds(u) / odds(inside(F.col("p"))) * odds(inside(F.col("mean")))
    state = joined.withColumn("v", F.when(F.col("p") == F.col("mean"), u).otherwise(q / (1 + q))).withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("v") * BUCKETS).cast("int")))
    state = materialise(state.withColumn("drawn", F.lit(False)).drop("mean", "cell"), "mix-state")
    for _ in range(rounds):
        state = _round(state, hot_rows)
    n = F.col("base") + F.when(F.col("drawn"), 1).otherwise(0)
    return state.select("doc_id", "source", "size", "source_size", "target", "p", n.cast("long").alias("copies"), (n * F.col("size")).cast("long").alias("taken"), *([] if row is None else ["row"]))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that the mix takes, each as many times as it is taken, with docs' columns.

    Rows are told apart by their file and place in it, so docs must be a table's scan; anything else is written first. Of the
    text, one shuffle moves all of it, at every size: what is taken has no bound that would let it be broadcast.
    """
    docs, file, index = placed(docs)
    mixed = mix(docs, id_col, source_col, text_col, row=F.struct(file.alias("f"), index.alias("i")), **options).filter("copies > 0").select(F.col("row.f").alias("_f"), F.col("row.i").alias("_i"), F.col("copies").alias("_copies"))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns], file.alias("_f"), index.alias("_i"))
    met = rows.join(mixed.hint("merge"), ["_f", "_i"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return met.select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def op3_pareto_mixing(docs: DataFrame) -> DataFrame:
    """The query's columns; documents are worth their diversity of words, and per source the taken words come as near to its target as its shortest document not taken allows."""
    return mix(docs, worth=diversity(F.col("text").cast("string"))).select("doc_id", "size", "source_size", "target", "taken", "copies", "p")
