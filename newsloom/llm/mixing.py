"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of the wanted words, at most ``cap`` times its
own words; what is above goes to the others by weight.  Each document gets the
whole copies that are certain; the rest of a source's target is a fixed-size
sample: document i has inclusion probability p_i, draws u_i, and ranks by its
random odds over its inclusion odds, (u/(1-u)) / (p/(1-p)); the lowest ranks are
taken until the target's words are reached.

Inclusion probabilities grow with the number of binary digits of a document's
size (long documents first), so they differ within a source.  Where such a
probability would pass 1, the document gets a further whole copy with certainty.

No source is ever sorted whole: ranks fall into ``BINS`` bins with one row of
sums per source and bin, and only the bin where the target is reached is sorted.
u_i comes from md5 of the doc_id, so reruns agree.

Edge cases: a null or empty text has size 0 and is never taken; a null source is
a source of its own, last; repeated rows are separate rows; an empty table gives
an empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, word_count, written

BINS = 65536


def _targets(sizes: DataFrame, weights: tuple[int, ...], total: float, cap: float) -> DataFrame:
    """One row per source: target words.  Sources are few (a bounded dimension), documents never reach this step."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("level", F.col("most") / F.col("weight"))
    by = Window.orderBy("level", F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    s = (
        s.withColumn("all_words", F.sum("source_size").over(everyone))
        .withColumn("capped_before", F.sum("most").over(by) - F.col("most"))
        .withColumn("weight_left", F.sum("weight").over(everyone) - F.sum("weight").over(by) + F.col("weight"))
        .withColumn("fill", (F.col("all_words") * total - F.col("capped_before")) / F.col("weight_left"))
    )
    s = s.withColumn("line", F.min(F.when(F.col("level") >= F.col("fill"), F.struct("level", "fill"))).over(everyone)["fill"])
    return s.select("source", "source_size", F.least("most", F.coalesce("line", F.lit(0.0)) * F.col("weight")).alias("target"))


def uniform_draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**48)


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0, seed: str = "mix:", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs, and a struct of the columns to carry along.

    The tables of a source's plan are written first and counted, so that texts to
    carry stay where they are unless sources are too many to broadcast.
    """
    carried = F.struct(*carry) if carry else F.lit(None).cast("string")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), carried.alias("carried"))
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0).cast("int"))
    classes = rows.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    sizes = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    target = _targets(sizes, weights, total, cap)
    # Whole copies for all, then classes (at most 64 a source) whose probability reaches 1, from the largest down.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = (
        classes.join(target.withColumnRenamed("source", "s").withColumn("whole", whole), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    source = Window.partitionBy("source")
    plan = (
        plan.withColumn("above", F.sum("class_size").over(down) - F.col("class_size"))
        .withColumn("mass", F.col("class") * F.col("class_size"))
        .withColumn("mass_left", F.sum("mass").over(source) - F.sum("mass").over(down) + F.col("mass"))
        .withColumn("factor", F.when(F.col("mass_left") > 0, (F.col("rest") - F.col("above")) / F.col("mass_left")).otherwise(0.0))
    )
    plan = plan.withColumn("c", F.max(F.when(F.col("factor") * F.col("class") <= 1, F.struct("class", "factor"))).over(source)["factor"])
    plan = plan.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(1.0)) * F.col("class"))))
    plan = plan.withColumn("sure", F.when(F.col("p") >= 1, 1).otherwise(0).cast("long"))
    plan = plan.withColumn("quota", F.col("rest") - F.sum(F.col("sure") * F.col("class_size")).over(source))
    plan = plan.select(F.col("source").alias("s"), F.col("class").alias("k"), "source_size", "target", "p", "quota", (F.col("whole") + F.col("sure")).alias("sure_copies"), ((F.col("sure") == 0) & (F.col("p") > 0)).alias("drawn"))

    plan = written(plan, "mix-plan")
    plan = small_side(plan, plan.count(), 100)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k"))).drop("s", "k", "class")
    u = uniform_draw(F.col("doc_id"), seed)
    odds = F.when(F.col("drawn"), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    rows = rows.withColumn("rank", odds).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))
    # The bin in which a source's quota is reached.
    bins = rows.where("drawn").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("quota").alias("quota"))
    bins = bins.withColumn("before", F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin")) - F.col("bin_size"))
    edge = bins.where(F.col("before") <= F.col("quota")).groupBy("source").agg(F.max(F.struct("bin", "before")).alias("e"))
    edge = edge.select(F.col("source").alias("es"), F.col("e.bin").alias("edge_bin"), F.col("e.before").alias("edge_before"))
    edge = written(edge, "mix-edge")
    edge = small_side(edge, edge.count(), 50)
    rows = rows.join(edge, F.col("source").eqNullSafe(F.col("es")), "left").drop("es")
    final = lambda d, extra: d.select("doc_id", "source", "size", "source_size", "target", ((F.col("sure_copies") + extra) * F.col("size")).alias("taken"), (F.col("sure_copies") + extra).alias("copies"), "carried")
    on_edge = F.coalesce(F.col("bin") == F.col("edge_bin"), F.lit(False))
    clear = final(rows.where(~on_edge), F.when(F.coalesce(F.col("bin") < F.col("edge_bin"), F.lit(False)), 1).otherwise(0).cast("long"))
    run = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = rows.where(on_edge).withColumn("start", F.col("edge_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    cut = final(edge_rows, F.when(F.col("start") + F.col("size") / 2 <= F.col("quota"), 1).otherwise(0).cast("long"))
    mixed = clear.unionByName(cut)
    return mixed if carry else mixed.drop("carried")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    taken = pareto_mix(docs, carry=tuple(docs.columns), **how).where("copies > 0")
    return taken.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("carried.*")
