"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash of its id and text. Words are summed by source and hash
bucket (12 bits a round); the bucket in which a source's budget runs out is the only
one that is looked at again in the next round, until it holds one row. The result is
one threshold per source, so choosing rows is a comparison, without a sort. Thresholds
nest: a smaller budget takes a subset of the rows of a larger one, and a target above
the source's size takes every row once (or twice) and the rows below the threshold
once more.

Defined results: a NULL text has no words; a NULL source is a source, the last one;
an empty table gives an empty result; repeated rows are mixed one by one, told apart
by their place in a written table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
ROUND_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A 60-bit number from seed, id and text, which any engine with MD5 can compute."""
    joined = F.concat(
        F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))
    )
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def place_hash() -> Column:
    """Tells repeated rows apart; any choice among them gives the same mix."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - HASH_BITS)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3
) -> DataFrame:
    """Target words of each source; ``sizes`` has one row per source with columns source, source_size.

    Sources in code point order, NULL last, take the weights in turn. A target stops at
    ``max_repeats`` times the source's size. With sources sorted by that cap per weight,
    the level is that of the first source which the remaining words do not fill.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    weighed = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * max_repeats)
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("weights_left"))
    )
    reached = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    level = F.min(F.when(reached.isNotNull(), F.struct(F.col("cap") / F.col("weight"), reached.alias("level")))).over(everything)
    target = F.least(F.col("cap").cast("double"), level["level"] * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


@dataclass(frozen=True)
class Mix:
    """Thresholds per source, and how many bits of hash and place they fix."""

    thresholds: DataFrame
    hash_shift: int
    place_shift: int | None

    def copies(self, rows: DataFrame, source: Column, size: Column, row_hash: Column, place: Column) -> DataFrame:
        """``rows`` with a struct ``_mix`` of source_size, target and copies."""
        t = self.thresholds.select(*[F.col(c).alias(f"_t_{c}") for c in self.thresholds.columns])
        head = F.shiftright(row_hash, self.hash_shift)
        bound = F.shiftright(F.col("_t_hash"), self.hash_shift)
        below, at = head < bound, head == bound
        if self.place_shift is not None:
            tail, edge = F.shiftright(place, self.place_shift), F.shiftright(F.col("_t_place"), self.place_shift)
            below, at = below | (at & (tail < edge)), at & (tail == edge)
        nearer = 2 * F.col("_t_spent") + size <= 2 * F.col("_t_budget")
        more = (F.col("_t_budget") > 0) & (below | (at & nearer))
        copies = (F.col("_t_base") + more.cast("int")).cast("int")
        mix = F.struct(F.col("_t_source_size").alias("source_size"), F.col("_t_target").alias("target"), copies.alias("copies"))
        joined = rows.join(t, source.eqNullSafe(F.col("_t_source")))
        return joined.withColumn("_mix", mix).drop(*t.columns)


def plan_mix(light: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> Mix:
    """Find the thresholds. ``light`` is a stored table with columns source, size, hash, place.

    Each round reads the light table once and shuffles at most 4096 sums per source and
    task. A round per 12 bits is needed until no boundary bucket holds two rows.
    """
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = source_targets(sizes, weights, max_repeats).withColumn("base", base.cast("int"))
    state = state.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    state = staged(
        state.withColumn("spent", F.lit(0).cast("bigint"))
        .withColumn("hash", F.lit(0).cast("bigint"))
        .withColumn("place", F.lit(0).cast("bigint")),
        "mix-targets",
    )
    hash_shift, place_shift = HASH_BITS, None
    while True:
        column, known = ("hash", hash_shift) if hash_shift else ("place", HASH_BITS if place_shift is None else place_shift)
        if known == 0:
            break
        shift = known - ROUND_BITS
        state, crowded = _refined(light, state, column, known, shift)
        hash_shift, place_shift = (shift, None) if column == "hash" else (0, shift)
        if not crowded:
            break
    return Mix(state, hash_shift, place_shift)


def _refined(light: DataFrame, state: DataFrame, column: str, known: int, shift: int) -> tuple[DataFrame, bool]:
    """One more round: the bucket of ``column`` where each source's budget runs out."""
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in state.columns])
    same = light["source"].eqNullSafe(F.col("s_source")) & (
        F.shiftright(light[column], known) == F.shiftright(F.col(f"s_{column}"), known)
    )
    if column == "place":
        same &= light["hash"] == F.col("s_hash")
    bucket = F.shiftright(light[column], shift).alias("bucket")
    sums = light.join(s, same).groupBy("source", bucket).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(running))
    sums = sums.select(F.col("source").alias("b_source"), "bucket", "words", "n", "upto")
    over = sums.join(s, F.col("b_source").eqNullSafe(F.col("s_source"))).where(F.col("s_spent") + F.col("upto") > F.col("s_budget"))
    first = over.groupBy("b_source").agg(F.min(F.struct("bucket", "words", "n", "upto")).alias("b"))
    joined = state.join(first, state["source"].eqNullSafe(F.col("b_source")), "left")
    columns = {c: F.col(c) for c in state.columns}
    # Only a source without words has no boundary; its budget is zero.
    columns[column] = F.shiftleft(F.col("b.bucket"), shift)
    if column == "place":
        columns["hash"] = F.when(F.col("b").isNotNull(), F.col("hash"))
    columns["spent"] = F.coalesce(F.col("spent") + F.col("b.upto") - F.col("b.words"), F.col("spent"))
    refined = staged(joined.select(*[v.alias(c) for c, v in columns.items()], F.coalesce("b.n", F.lit(0)).alias("n")), "mix-round")
    crowded = refined.agg(F.max("n")).first()[0]
    return refined.drop("n"), bool(crowded and crowded > 1)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_repeats: int = 3,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source) and copies, the times the mix takes it."""
    doc_id, text = F.col(id_column), F.col(text_column)
    light = staged(
        docs.select(
            doc_id.alias("doc_id"),
            F.col(source_column).alias("source"),
            word_count(text).alias("size"),
            row_hash(doc_id, text, seed).alias("hash"),
            place_hash().alias("place"),
        ),
        "mix-rows",
    )
    mix = plan_mix(light, weights, max_repeats)
    mixed = mix.copies(light, light["source"], light["size"], light["hash"], light["place"])
    return mixed.select("doc_id", "size", "_mix.source_size", "_mix.target", "_mix.copies")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """The documents that the mix takes, with all their columns, repeated as often as it takes them.

    ``docs`` is a stored table: it is read twice, and the text is not shuffled while
    the thresholds (one row per source) are small enough for Spark to broadcast.
    """
    names = docs.columns
    doc_id, text = F.col("doc_id"), F.col("text")
    # Names with clashes cannot occur: everything added is in one struct with a fresh name.
    own = "_mix_keys" + "_" * max(len(c) for c in names)
    keys = F.struct(
        F.col("source").alias("source"), word_count(text).alias("size"), row_hash(doc_id, text, seed).alias("hash"), place_hash().alias("place")
    )
    keyed = docs.select(F.struct(*names).alias("row"), keys.alias(own))
    light = staged(keyed.select(f"{own}.*"), "mix-rows")
    mix = plan_mix(light, weights, max_repeats)
    k = lambda c: F.col(own)[c]
    mixed = mix.copies(keyed, k("source"), k("size"), k("hash"), k("place"))
    taken = mixed.where(F.col("_mix.copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("_mix.copies"))).alias("copy"))
    return taken.select("row.*")
