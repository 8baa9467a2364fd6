"""Exact percentiles of large groups without gathering a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import PATCH_ROWS, cut

#: A range of values is cut at so many splitters, drawn from a sketch of the values themselves.
SPLITTERS = 512
#: Of the sketch: a splitter's rank is right to one in so many values.
ACCURACY = 10_000
#: So many values of a range are few enough to be counted one by one.
FEW = 100_000


def _counted(d: DataFrame, state: DataFrame) -> DataFrame:
    """state (patch, i, a, b, lo, hi) with below, first, inside, last and splitters s of the values inside.

    Values below the range, at its first value, inside it, and at its last. The ends are left out of
    the sketch, so that a value which repeats very often doesn't take all splitters once it is an end.
    """
    of = ["patch", "i", "a", "b", "lo", "hi"]
    cuts = [i / SPLITTERS for i in range(SPLITTERS + 1)]
    inner = F.expr("v > lo and v < hi")
    counts = {"below": F.expr("v < lo"), "first": F.expr("v = lo"), "inside": inner, "last": F.expr("v = hi and hi > lo")}
    drawn = F.percentile_approx(F.when(inner, F.col("v")), cuts, ACCURACY).alias("s")
    return d.join(state.select(*of), "patch").groupBy(*of).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], drawn)


def _narrowed(counted: DataFrame) -> DataFrame:
    """The range about the ranks a and b: the splitters next to them, one more each side for what the sketch may be off."""
    rank = F.col("a") - F.col("below") - F.col("first")
    place = F.floor(F.greatest(rank, F.lit(0)) / F.col("inside") * SPLITTERS).cast("int")
    low = F.when((rank <= 0) | (place < 1), F.col("lo")).otherwise(F.try_element_at("s", place))
    high = F.when(place + 3 > SPLITTERS, F.col("hi")).otherwise(F.try_element_at("s", place + 4))
    at_first, at_last = F.expr("b < below + first"), F.expr("a >= below + first + inside")
    ends = [F.when(at_first, F.col("lo")).when(at_last, F.col("hi")).otherwise(c).alias(n) for n, c in (("lo", low), ("hi", high))]
    return counted.select("patch", "i", "a", "b", *ends)


def percentiles(df: DataFrame, value: str, shares: dict[str, float], few: int = FEW, rounds: int = 12) -> DataFrame:
    """(patch, a column for each of `shares`): percentiles of a column by patch, between values by straight lines.

    Each wanted rank lies in a range of values, first the whole one. While a range holds more than
    `few` values, it is narrowed to the splitters next to the rank, of a mergeable sketch of the values in
    the range; splitters follow ranks, so one far value doesn't stretch them. What lies below the new
    range is counted, so the result is exact whatever the sketch says. The values left are counted by
    value and read off: a task sees `few` of them and the range's ends at most. Nulls are left out.
    """
    few = max(few, 4 * SPLITTERS)  # several values between splitters
    d = df.where(F.col(value).isNotNull()).select("patch", F.col(value).cast("double").alias("v"))
    low = lambda p: F.floor((F.col("all") - 1) * F.lit(float(p)))
    names = list(shares)
    whole = cut(d.groupBy("patch").agg(F.count("*").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    patches, largest = whole.agg(F.count("*"), F.max("all")).first()
    small = F.broadcast if patches <= PATCH_ROWS else (lambda t: t)
    asked = F.array(*[F.struct(F.lit(i).alias("i"), low(shares[n]).alias("a"), F.least(low(shares[n]) + 1, F.col("all") - 1).alias("b")) for i, n in enumerate(names)])
    state = whole.select("patch", F.explode(asked).alias("w"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("all").alias("inside"))
    state = state.select("patch", "w.*", "lo", "hi", "below", "inside")
    held = [*state.columns]
    wide = F.col("inside") > few
    for turn in range(rounds + 1 if (largest or 0) > few else 0):
        n, largest = state.where(wide).agg(F.count("*"), F.max("inside")).first()
        if not n:
            break
        if turn == rounds:
            raise RuntimeError(f"a range still holds {largest} values after {rounds} rounds")
        todo = state.where(wide)
        counted = cut(_counted(d, small(_narrowed(todo) if turn else todo)))
        if counted.where("a < below or b >= below + first + inside + last").limit(1).count():
            raise RuntimeError("a rank lies outside its range")
        state = cut(state.where(~wide).select(*held, *([] if not turn else ["first", "s"])).unionByName(counted.drop("last"), allowMissingColumns=True))
    values = d.join(small(state.select("patch", "i", "a", "b", "lo", "hi", "below")), "patch").where("v between lo and hi")
    values = values.groupBy("patch", "i", "a", "b", "below", "v").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("patch", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = lambda r, i: F.max(F.when((F.col("i") == i) & (F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("n")), F.col("v")))
    read = values.withColumn("upto", upto).groupBy("patch").agg(*[at(r, i).alias(f"{r}{i}") for i in range(len(names)) for r in "ab"])
    share = lambda n: (F.col("all") - 1) * F.lit(float(shares[n])) - low(shares[n])
    return read.join(small(whole), "patch").select("patch", *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * share(n)).alias(n) for i, n in enumerate(names)])
