"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, key_of, parts, stage, whole

#: Rows of a hash bucket by plan: what is ordered at most of a source, in one task.
BUCKET_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size), one row each, with weight and target.

    Sources by code point, null last, take the weights in turn. The water level (target by weight) starts at total
    by sum of weights; sources whose cap lies under it are clamped to the cap and the rest of the total is
    shared anew by weight, until none is above. Only the two sums of a step come to the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    table = stage(
        sources.withColumn("weight", F.get(listed, ((F.row_number().over(order) - 1) % len(weights)).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        above = F.col("_cap") < F.lit(level) * F.col("weight")
        capped, free = table.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - capped) / free if free else float("inf")
        if raised <= level * (1 + 1e-15):
            break
        level = raised
    return table.withColumn("target", F.least("_cap", F.lit(level) * F.col("weight")) if level != float("inf") else F.col("_cap")).drop("_cap")


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """``docs`` with columns size, source_size, target and taken (words that the mix takes, repeats counted).

    A source's epochs are target by size. Each document is taken whole as often as the whole epochs; the rest of
    the target is drawn by a seeded hash of the row: documents sum up in hash order until the rest is met,
    and the one that crosses it gives a fractional repetition of its leading words. So a source's taken words
    equal its target, rounded, and no document exceeds ``max_epochs`` times its size.

    The hash order needs no sort of a source: sizes are summed by (source, hash bucket) first, and only the bucket in
    which the rest is met is ordered, about BUCKET_ROWS rows of a source of any size. Null and empty texts have size 0 and
    are taken 0 times; the null source is a source of its own, and last; rows are kept one to one, repeated rows too (which
    of several equal rows crosses is open, what they sum up to isn't). Columns of the result's names are replaced, all
    others pass through, whatever their names.
    """
    made = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c.lower() not in made]
    buckets = docs.count() // BUCKET_ROWS + 1
    rows = docs.select(whole(docs, kept), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key_of(docs, kept, seed).alias("h"))
    rows = rows.withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = stage(rows.groupBy("source", "b").agg(F.sum("size").alias("n")))
    per_source = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(0).cast("long")
    per_source = per_source.withColumn("epochs", epochs).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")
    running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    crossing = (
        sums.withColumn("to", F.sum("n").over(running))
        .join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .where(F.col("to") > F.col("rest"))
        .groupBy("source")
        .agg(F.min_by(F.struct("b", (F.col("to") - F.col("n")).alias("before")), "b").alias("x"))
    )
    plan = stage(
        per_source.join(crossing, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "s", "source_size", "target", "epochs", "rest", F.coalesce("x.b", F.lit(buckets)).alias("at"), F.coalesce("x.before", F.lit(0)).alias("before")
        )
    )
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    apart = rows.where("b != at").withColumn("more", F.when(F.col("b") < F.col("at"), F.col("size")).otherwise(0))
    within = Window.partitionBy("s").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("b = at").withColumn("sum", F.sum("size").over(within)).withColumn("more", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before") - F.col("sum") + F.col("size")))).drop("sum")
    taken = (F.col("epochs") * F.col("size") + F.col("more")).alias("taken")
    return apart.unionByName(last).select(*parts(kept), "size", "source_size", "target", taken)


def repeat_taken(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as documents: a row for each whole repetition, and one with the leading words of a fractional one."""
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.col("taken") - times * F.col("size")
    words = F.regexp_extract_all(F.col(text), F.lit(rf"\G[\x20\x09-\x0D]*{WORDS}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), part.cast("int")), "")
    texts = F.concat(F.array_repeat(F.col(text), times), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    copies = mixed.select(whole(mixed, mixed.columns), F.explode(texts).alias("copy"))
    return copies.select(*[F.col("copy").alias(c) if c == text else p for c, p in zip(mixed.columns, parts(mixed.columns), strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
