"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every document of a source gets the whole copies that are certain, floor(target / source size).
What is left of the target is drawn: documents are ranked by random odds divided by inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and the first of that order are taken until the left-over
words are used up; further passes draw from documents that fit the rest, and one closing document narrows it.

u is a hash of the document's id and text, so reruns agree. p is unequal: it grows with a
power of a document's size, scaled so that the expected words equal what is left.

The order of a source is never sorted in one task. Ranks are dealt into narrow cells, whose word
counts are summed before the shuffle; only the cell in which a source's target ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import patch_table
from .common import cut

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the rank axis for each source; the cell where a target ends holds about 1/CELLS of it.
CELLS = 4096


def word_count(text):
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target: shares of all sizes by weight, none above `most` times its source.

    `weights` repeat over the sources by code point, null last. What a capped source can't use is
    shared again by weight among the rest until none is above: sources are capped in the order of cap
    over weight, so the level of the others is read off running sums in that order. One row for each
    source passes through one task and none through the driver but sums. All capped: every target is
    its cap.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    table = cut(sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most)))
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = table.withColumn("level", (F.lit(float(whole)) - capped) / sharing).withColumn("place", F.row_number().over(order))
    level = levels.where(F.col("weight") * F.col("level") <= F.col("cap")).agg(F.min_by("level", "place")).first()[0]
    target = F.col("cap") if level is None else F.least("cap", F.col("weight") * F.lit(max(0.0, float(level))))
    return table.select("source", "source_size", target.alias("target"))


KEY = ("rank", "doc_id", "h")


def nth_by_uid(rows: DataFrame) -> DataFrame:
    """(of, upto): of rows (of, k, uid), the uid of each group's k-th row by uid.

    uid is a stored monotonically_increasing_id. Rows are counted by the task that numbered them, and
    only those of the task in which the k-th lies are put in order, so that a group of very many rows
    isn't ordered in one place.
    """
    rows = rows.select("of", "k", "uid", F.shiftright("uid", 33).alias("task"))
    counts = rows.groupBy("of", "k", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = counts.withColumn("before", before).where("before < k and k <= before + n").select(F.col("of").alias("in_"), F.col("task").alias("at"), (F.col("k") - F.col("before")).alias("need"))
    near = rows.join(where, rows.of.eqNullSafe(where.in_) & (F.col("task") == F.col("at")))
    place = F.row_number().over(Window.partitionBy("of").orderBy("uid"))
    return near.withColumn("place", place).where("place = need").select("of", F.col("uid").alias("upto"))


def _draw(d: DataFrame) -> DataFrame:
    """Takes the first of each source's order, as far as the words in `gap` go, and lowers `gap` by them.

    Only documents that fit the gap take part, so that a further pass can use what one very long
    document in the order has left. Rows alike share their rank; they are counted before they are
    ordered, and of those at the end as many are taken as fit.
    """
    takes_part = "more = 0 and size > 0 and size <= gap"
    cells = d.where(takes_part).groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    cells = cells.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    #: the cell in which the gap ends, and what the cells before it have used
    edge = cells.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("cell"))).alias("edge"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.lit(0)).alias("used")).withColumnRenamed("source", "of")
    edge = patch_table(edge)  # a row a source: short, the documents stay where they are
    d = cut(d.join(edge, d.source.eqNullSafe(edge.of), "left").drop("of").withColumn("part", F.expr(takes_part)))
    alike = d.where("part and cell = edge").groupBy("source", *KEY, "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"), F.first("used").alias("used"))
    before = F.coalesce(F.sum(F.expr("n * size")).over(Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("used")
    alike = alike.withColumn("before", before).withColumn("k", F.least("n", F.floor((F.col("gap") - F.col("before")) / F.col("size")))).where("k > 0")
    alike = cut(alike.select(F.col("source").alias("of"), F.struct(*KEY).alias("key"), "k", "n", (F.col("before") + F.col("k") * F.col("size")).alias("run")))
    last = alike.groupBy("of").agg(F.max("run").alias("l_run"), F.max(F.when(F.col("k") == F.col("n"), F.col("key"))).alias("l_key"), F.max(F.when(F.col("k") < F.col("n"), F.col("key"))).alias("b_key"))
    partial = patch_table(alike.where("k < n").select("of", "key", "k"))
    places = nth_by_uid(d.join(partial, d.source.eqNullSafe(partial.of) & (F.struct(*KEY) == partial.key)).select(partial.of, partial.k, d.uid))
    last = patch_table(last.join(places.withColumnRenamed("of", "p_of"), F.col("of").eqNullSafe(F.col("p_of")), "left").drop("p_of"))
    d = d.join(last, d.source.eqNullSafe(last.of), "left").drop("of")
    key = F.struct(*KEY)
    inside = (key <= F.col("l_key")) | ((key == F.col("b_key")) & (F.col("uid") <= F.col("upto")))
    taken = F.col("part") & (F.col("edge").isNull() | (F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & F.coalesce(inside, F.lit(False))))
    return d.withColumn("more", F.when(taken, 1).otherwise(F.col("more"))).withColumn("gap", F.col("gap") - F.coalesce("l_run", "used", F.lit(0))).drop("edge", "used", "part", "l_key", "l_run", "b_key", "upto")


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), most: float = 3.0, size_power: float = 0.5, seed: int = 6, passes: int = 3, keep: tuple = ("doc_id",)) -> DataFrame:
    """`keep` and source, size, source_size, target, copies, taken (copies x size) for every document.

    Null or empty texts have size 0 and no copies beyond the certain ones (taken 0). A null source
    is a source. Rows alike in id and text get the same rank; ties are broken by id, then by the
    text's hash. Repeated rows each count, and of rows alike as many are taken as fit: any of them, so
    that reruns agree in all that can be told apart. `passes` bounds how often the left-over words are
    drawn again from what fits them. An empty table gives an empty one. Columns of other names are ignored.
    """
    base = docs.select(*keep, "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)).alias("h"))
    base = cut(base.withColumn("uid", F.monotonically_increasing_id()))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    power = F.pow(F.col("size").cast("double"), F.lit(size_power))
    sums = base.groupBy("source").agg(F.sum(power * F.col("size")).alias("pooled"))
    per = targets.join(sums, targets.source.eqNullSafe(sums.source)).select(targets.source, "source_size", "target", "pooled")
    per = patch_table(per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    d = base.alias("d").join(per.withColumnRenamed("source", "of"), F.col("d.source").eqNullSafe(F.col("of")), "left").drop("of")
    u = ((F.shiftrightunsigned("h", 11)) + F.lit(0.5)) / F.lit(float(1 << 53))
    p = F.least(F.lit(0.999), F.greatest(F.lit(1e-9), F.col("left") * power / F.greatest(F.col("pooled"), F.lit(1e-300))))
    rank = F.log(u / (1 - u)) - F.log(p / (1 - p))
    #: the logistic map takes any rank to (0, 1), so cells are even whatever the spread
    d = cut(d.withColumn("rank", rank).withColumn("cell", F.floor(F.lit(CELLS) / (1 + F.exp(-F.col("rank")))).cast("int")).withColumn("more", F.lit(0)).withColumn("gap", F.coalesce("left", F.lit(0.0))))
    for _ in range(passes):
        d = cut(_draw(d))
    #: the document outside the sample whose size comes nearest to the gap, if that is nearer than none
    off = F.abs(F.col("size") - F.col("gap"))
    closing = d.where("more = 0 and size > 0").where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), *KEY, "uid")).alias("c")).select(F.col("source").alias("c_of"), F.col("c.uid").alias("c_uid"))
    d = d.join(patch_table(closing), d.source.eqNullSafe(F.col("c_of")), "left").drop("c_of")
    chosen = F.when((F.col("more") > 0) | F.coalesce((F.col("size") > 0) & (F.col("uid") == F.col("c_uid")), F.lit(False)), 1).otherwise(0)
    copies = (F.coalesce("whole", F.lit(0)) + chosen).cast("long")
    return d.withColumn("copies", copies).select(*keep, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
