"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_col

#: Hash bins of a source: the fractional repetition is cut at a bin first, then inside one bin.
BIN_DIGITS = 3


def source_key(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))


def water_fill(sources: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Targets of sources(source, source_size), one row for each source.

    The words to hand out are share x the sum of all sizes; a source takes its
    weight's part until it holds max_epochs x its size, and what is above goes
    to the others by weight. With sources in the order of cap / weight, those
    before some row are at their caps and the rest share one level, so the
    repeated clamping has its fixed point at the first row whose level is not
    above its own cap / weight. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    every = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        sources.withColumn("weight", w)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
        .withColumn("level", F.coalesce(F.first("fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    )
    return filled.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, whole, part, taken; keep names more columns to carry.

    A source with target t and size s takes every document floor(t / s) times
    and fills the rest with one more repetition of documents in the order of a
    seeded hash; the document at the cut is repeated in part. So a source's
    taken words are its target rounded. The cut is found from sums by
    (source, hash bin), then inside one bin, so no source is sorted whole.

    Null text has size 0, null source is a source of its own (last), an empty
    table gives no rows, repeated rows are mixed each for itself (rows of one
    id, or of none, in the order of size and text), and a source of size 0
    takes nothing. Columns of docs that clash with the names made
    here are left out unless they are in keep.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = docs.select(
        F.col(id_col).alias("_id"),
        F.col("source").alias("_source"),
        F.regexp_count(text_col(), F.lit(WORD)).cast("long").alias("_size"),
        digest.alias("_h"),
        F.substring(digest, 1, BIN_DIGITS).alias("_bin"),
        source_key().alias("_key"),
        F.xxhash64(text_col()).alias("_text"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    bins = docs.select(source_key().alias("_key"), F.col("source").alias("_source"), F.substring(digest, 1, BIN_DIGITS).alias("_bin"), F.regexp_count(text_col(), F.lit(WORD)).cast("long").alias("_size"))
    bins = bins.groupBy("_key", "_source", "_bin").agg(F.sum("_size").alias("_bin_size"))
    sources = bins.groupBy(F.col("_source").alias("source")).agg(F.sum("_bin_size").alias("source_size"))
    targets = water_fill(sources, weights, share, max_epochs).withColumn("_key", source_key())
    need = F.floor(F.col("target") + F.lit(0.5))
    whole = F.when(F.col("source_size") > 0, F.floor(need / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.select("_key", "source_size", "target", whole.alias("_whole"), (need - whole * F.col("source_size")).cast("long").alias("_rest"))
    starts = bins.join(targets, "_key").withColumn("_before", F.sum("_bin_size").over(Window.partitionBy("_key").orderBy("_bin")) - F.col("_bin_size")).drop("_bin_size", "_source")
    inside = Window.partitionBy("_key", "_bin").orderBy("_h", "_id", "_size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.join(starts, ["_key", "_bin"]).withColumn("_at", F.col("_before") + F.sum("_size").over(inside) - F.col("_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), F.col("_rest") - F.col("_at")))
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
        F.col("_whole").alias("whole"), part.alias("part"), (F.col("_whole") * F.col("_size") + part).alias("taken"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep if c != id_col],
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; the last repetition of a document at the cut holds its first words.

    A document of no words, null text among them, is neither wanted nor unwanted by the targets: it stays once. Repeated
    rows, null ids, an empty table and ties are as in mix(); all columns are kept, whatever they are called.
    """
    columns = docs.columns
    # whole rows under one name, since columns of docs may be called as those of the mix
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    m = mix(rows, **(options | {"keep": ("_row",)}))
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("whole") + (F.col("part") > 0).cast("long")).cast("int"))
    m = m.withColumn("_i", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    # pieces begin at words; a text that begins with white space has one piece more, before its first word
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    first = F.slice(F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), (F.greatest(F.col("part"), F.lit(1)) + lead).cast("int"))
    partial = (F.col("_i") > F.col("whole")) & (F.col("part") < F.col("size"))
    shown = F.when(partial, F.array_join(first, "")).otherwise(F.col("_row.text"))
    return m.select(*[shown.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in columns])
