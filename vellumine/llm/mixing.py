"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is exponential, -ln(u) / quality, with u from a digest of its id and the
seed. A source's target is met by complete passes over it, then by the documents with the
smallest keys whose sizes, summed in key order, come nearest to the rest of the budget.

The sums need no sort of a whole source: keys fall into bins by their logarithm, bin sums are
pre-aggregated and summed along each source, and only the documents of the one bin where the
budget ends are sorted. The logarithm of an exponential key has a density of 1/e at most,
whatever the quality, so a bin holds at most a 2 500th of a source or so and no bin is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_WORD, cut, free_names, small_side

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = "mix-1"
#: Bins of a unit of a key's logarithm.
BINS = 1024
#: Bounds of quality; what is null, NaN or not positive has the lower one and comes last.
LEAST_QUALITY, MOST_QUALITY = 1e-6, 1e6


def letter_share(text: Column) -> Column:
    """Quality weight of a text: 0.1 to 1, by the share of letters among its code points."""
    text = F.coalesce(text, F.lit(""))
    share = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.lit(0.1) + F.lit(0.9) * share


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """One row per source of sizes (source, size): source, source_size, target.

    Sources take the weights in turn in code point order, null last. All sizes are shared by
    weight; what exceeds most_times a source's size is shared anew until no target is above.
    That is target = least(cap, level * weight), where the level is the largest of
    (total - caps of the sources before) / weights of the others in the order of cap / weight.
    One task sorts the table of sources (not documents), a row each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_times)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cap")
    level = (F.sum("source_size").over(W.partitionBy()) - before) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    return levels.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most_times: int = MOST_TIMES,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    size counts the words `[^\\x20\\x09-\\x0D]+` (null text: 0); taken = copies * size. Every
    document is taken floor(target / source_size) times, and once more if with it the words of
    its source come nearer to the target; documents without words only with complete passes.
    Equal keys are ordered by id and size, null ids last; a rerun takes the same documents. A
    source without words has target 0 and copies 1. quality: a positive number; null, NaN and
    what isn't positive come after all others, in the order of their keys.
    An empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.col(id_col).cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = letter_share(text) if quality is None else quality.cast("double")
    weight = F.coalesce(F.when(~F.isnan(weight), weight), F.lit(0.0))
    weight = F.least(F.greatest(weight, F.lit(LEAST_QUALITY)), F.lit(MOST_QUALITY))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(ASCII_WORD)), F.lit(0)).cast("long").alias("size"),
        (-F.log(u) / weight).alias("key"),
    )
    sizes = cut(sizes.withColumn("bin", F.floor(F.log("key") * BINS)), "mix-sizes")
    targets = cut(source_targets(sizes, weights, most_times), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    plan = targets.withColumn("epochs", epochs).withColumn(
        "rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))
    )
    bins = sizes.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
    bins = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    edge = (
        bins.join(small_side(plan.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of")))
        .where("upto > rest")
        .groupBy("source")
        .agg(F.min_by("bin", "bin").alias("edge"), F.min_by("before", "bin").alias("before"))
    )
    edge = cut(edge.withColumnRenamed("source", "edge_of"), "mix-edges")
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("edge_of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "epochs", "rest",
        # no edge: the rest holds all documents
        F.coalesce("edge", F.lit((1 << 62))).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"),
    )
    rows = sizes.join(small_side(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    prior = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    at_edge = rows.where("bin = edge").withColumn("more", (prior * 2 + F.col("size") <= F.col("rest") * 2).cast("int"))
    others = rows.where("bin != edge").withColumn("more", (F.col("bin") < F.col("edge")).cast("int"))
    copies = (F.col("epochs") + F.when(F.col("size") > 0, F.col("more")).otherwise(0)).cast("long")
    out = at_edge.unionByName(others).withColumn("copies", copies)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: each row as many times as its copies say, none if 0.

    Rows are matched by id: a row whose id is null or repeated takes the largest number of
    copies found for that id. Columns stay as they are.
    """
    copies, id_, at = free_names(docs, "copies", "id", "copy")
    taken = mix(docs, id_col, text_col, source_col).groupBy(F.col("doc_id").alias(id_)).agg(F.max("copies").alias(copies))
    joined = docs.join(taken, docs[id_col].eqNullSafe(taken[id_]))
    each = joined.withColumn(at, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))))
    return each.where(F.col(copies) > 0).select(*[docs[c] for c in docs.columns])
