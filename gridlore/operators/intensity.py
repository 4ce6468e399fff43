"""Statistics of intensities: first order, intensity histogram, intensity-volume histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def _counts(v: DataFrame, keys, x, extra=()) -> DataFrame:
    """(keys, extra, x, c): a row for each value of a region, c of its voxels. All else is over these counts."""
    return v.groupBy(*keys, *extra, x.cast("double").alias("x")).agg(F.count("*").alias("c"))


QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def _placed(counts: DataFrame, keys, order=("x",)) -> DataFrame:
    """Counts with, in each row, what the region's deviations are taken from: n, mean, quantiles, robust mean. One shuffle by region
    serves all of it, and a region's rows are streamed from a sort."""
    every, x, c = Window.partitionBy(*keys), F.col("x"), F.col("c")
    upto = F.sum("c").over(every.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(every)).withColumn("mean", F.sum(x * c).over(every) / F.col("n"))
    for name, q in QUANTILES.items():
        rank = (F.col("n") - 1) * F.lit(q)
        at = lambda r: F.min(F.when(F.col("upto") > r, x)).over(every)
        below, above = at(F.floor(rank)), at(F.ceil(rank))
        d = d.withColumn(name, below + (above - below) * (rank - F.floor(rank)))
    inside = x.between(F.col("p10"), F.col("p90"))
    return d.withColumn("inside", F.when(inside, c).otherwise(0)).withColumn("robust_mean", F.try_divide(F.sum(x * F.col("inside")).over(every), F.sum("inside").over(every)))


def _statistics():
    """Aggregates over placed counts."""
    x, c, n = F.col("x"), F.col("c"), F.first("n")
    d = x - F.col("mean")
    return [
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), *(F.first(q).alias(q) for q in QUANTILES),
        # Variance is taken as zero where all values are equal: rounding must not make it a small number.
        F.when(F.min("x") == F.max("x"), 0.0).otherwise(F.sum(c * d * d) / n).alias("var"), (F.sum(c * d * d * d) / n).alias("m3"), (F.sum(c * d * d * d * d) / n).alias("m4"),
        (F.sum(c * F.abs(d)) / n).alias("mad"), (F.sum(c * F.abs(x - F.col("p50"))) / n).alias("medad"), F.try_divide(F.sum(F.col("inside") * F.abs(x - F.col("robust_mean"))), F.sum("inside")).alias("rmad"),  # null: no value between the quantiles
    ]


def _histogram(level_count):
    """Entropy and uniformity from rows with c voxels of a level that has level_count."""
    p = F.col(level_count) / F.col("n")
    share = F.col("c") / F.col("n")
    return [(-F.sum(share * F.log2(p))).alias("Entropy"), F.sum(share * p).alias("Uniformity")]


def _shape_columns():
    """Features that first order and the intensity histogram define alike, from the statistics of _spread."""
    sd = F.sqrt("var")
    quart = F.col("p75") + F.col("p25")
    return {
        "Mean": F.col("mean"), "Variance": F.col("var"), "Skewness": F.when(F.col("var") == 0, 0.0).otherwise(F.col("m3") / (sd * sd * sd)), "Kurtosis": F.when(F.col("var") == 0, 0.0).otherwise(F.col("m4") / (F.col("var") * F.col("var")) - 3),
        "Minimum": F.col("low"), "Maximum": F.col("high"), "Range": F.col("high") - F.col("low"), "Median": F.col("p50"), "10Percentile": F.col("p10"), "90Percentile": F.col("p90"), "InterquartileRange": F.col("p75") - F.col("p25"),
        "MeanAbsoluteDeviation": F.col("mad"), "RobustMeanAbsoluteDeviation": F.coalesce("rmad", F.lit(0.0)), "MedianAbsoluteDeviation": F.col("medad"),
        "CoefficientOfVariation": F.when(F.col("var") == 0, 0.0).when(F.col("mean") == 0, float("inf")).otherwise(sd / F.col("mean")),
        "QuartileCoefficientOfDispersion": F.when(quart == 0, 1.0).otherwise((F.col("p75") - F.col("p25")) / F.when(quart == 0, 1.0).otherwise(quart)),
    }


def firstorder(v: DataFrame, keys=("roi",), shift: float = 0.0, voxel_volume: float = 1.0) -> DataFrame:
    """22 features of `val`; entropy and uniformity of the levels `g`."""
    keys = list(keys)
    d = _placed(_counts(v, keys, F.col("val"), ["g"]), keys, ("x", "g")).withColumn("of_level", F.sum("c").over(Window.partitionBy(*keys, "g")))
    x = F.col("x") + shift
    energy = F.sum(x * x * F.col("c"))
    s = d.groupBy(*keys).agg(*_statistics(), *_histogram("of_level"), energy.alias("Energy"), F.sqrt(energy / F.first("n")).alias("RootMeanSquared"))
    c = _shape_columns() | {"StandardDeviation": F.sqrt("var"), "Energy": F.col("Energy"), "TotalEnergy": F.col("Energy") * voxel_volume, "RootMeanSquared": F.col("RootMeanSquared"), "Entropy": F.col("Entropy"), "Uniformity": F.col("Uniformity")}
    return s.select(*keys, *(e.cast("double").alias(n) for n, e in c.items()))


def ih(v: DataFrame, keys=("roi",)) -> DataFrame:
    """23 features of the histogram of levels 1 to the highest, empty ones included."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("x")
    d = _placed(_counts(v, keys, F.col("g")), keys).withColumn("g", F.col("x").cast("int"))
    # A level stands for itself and the empty ones up to the next; the first also for those below it.
    begin = F.when(F.lag("g").over(order).isNull(), F.lit(1)).otherwise(F.col("g"))
    end = F.greatest(F.coalesce(F.lead("g").over(order) - 1, F.col("g")), F.col("g"))
    d = d.withColumn("begin", begin).withColumn("end", end).withColumn("at", F.explode(F.sequence("begin", "end")))
    d = d.withColumn("c", F.when(F.col("at") == F.col("g"), F.col("c")).otherwise(0)).withColumn("inside", F.when(F.col("at") == F.col("g"), F.col("inside")).otherwise(0))
    order = Window.partitionBy(*keys).orderBy("at")
    before, after = F.lag("c").over(order), F.lead("c").over(order)
    grad = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col("c")).when(after.isNull(), F.col("c") - before).otherwise((after - before) / 2.0)
    s = d.withColumn("d", grad.cast("double")).groupBy(*keys).agg(
        *_statistics(), (-F.sum(F.when(F.col("c") > 0, F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("n"))))).alias("Entropy"), F.sum(F.col("c") / F.col("n") * (F.col("c") / F.col("n"))).alias("Uniformity"),
        F.max(F.struct("d", -F.col("at"))).alias("up"), F.min(F.struct("d", "at")).alias("down"), F.max(F.struct(F.col("c"), -F.abs(F.col("at") - F.col("mean")), -F.col("at"))).alias("mode"),
    )
    c = _shape_columns() | {
        "Mode": -F.col("mode.col3"), "Entropy": F.col("Entropy"), "Uniformity": F.col("Uniformity"), "MaximumHistogramGradient": F.col("up.d"), "MaximumHistogramGradientIntensity": -F.col("up.col2"),
        "MinimumHistogramGradient": F.col("down.d"), "MinimumHistogramGradientIntensity": F.col("down.at"),
    }
    return s.select(*keys, *(e.cast("double").alias(n) for n, e in c.items()))


def ivh(v: DataFrame, keys=("roi",), method: str | None = None, bins: int = 1000, width: float = 1.0, value_range=None) -> DataFrame:
    """6 features of the cumulative histogram. method None: of the levels g, from 1 to the highest; `none`: of rounded intensities,
    unit steps; `fixed_bin_size`, `fixed_bin_number`: of intensities in bins."""
    keys = list(keys)
    x = F.col("g").cast("double") if method is None else F.col("val").cast("double")
    d = v.select(*keys, x.alias("x"))
    ends = d.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    if method is None:
        ends = ends.withColumn("lo", F.lit(1.0))
    elif value_range is not None and method != "fixed_bin_number":
        ends = ends.withColumn("lo", F.lit(float(min(value_range)))).withColumn("hi", F.lit(float(max(value_range))))
    lo, hi = F.col("lo"), F.col("hi")
    if method in (None, "none"):
        first = F.when(lo < 0, F.ceil(lo)).otherwise(F.floor(lo)).cast("long")  # towards zero
        last = F.when(hi < 0, F.ceil(hi)).otherwise(F.floor(hi)).cast("long")
        ends = ends.select(*keys, "n", lo.alias("lo"), hi.alias("hi"), first.alias("first"), (last - first + 1).alias("of"), F.lit(1.0).alias("step"), first.cast("double").alias("base"), (hi + 1.0).alias("next"))
        slot = (F.rint("x") - F.col("first") + 1).cast("long")
        clip = False
    elif method == "fixed_bin_size":
        ends = ends.select(*keys, "n", "lo", "hi", (F.ceil((hi - lo) / width) + 1).cast("long").alias("of"), F.lit(float(width)).alias("step"), (lo + 0.5 * width).alias("base"))
        slot, clip = (F.floor((F.col("x") - lo) / width) + 1).cast("long"), True
        top = F.col("base") + (F.col("of") - 1) * F.col("step")
        ends = ends.withColumn("next", top + width)
    elif method == "fixed_bin_number":
        ends = ends.select(*keys, "n", "lo", "hi", F.lit(int(bins)).cast("long").alias("of"), F.lit(1.0).alias("step"), F.lit(1.0).alias("base"), F.lit(bins + 1.0).alias("next"))
        slot, clip = (F.floor(bins * (F.col("x") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)) + 1).cast("long"), True
    else:
        raise ValueError(f"no such method: {method}")
    at = d.join(ends, keys).withColumn("slot", F.greatest(F.lit(1), F.least(slot, F.col("of"))) if clip else slot)
    counts = at.filter(F.col("slot").between(1, F.col("of"))).groupBy(*keys, "slot").agg(F.count("*").alias("c"))
    dense = ends.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("of")))).join(counts, [*keys, "slot"], "left")
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    dense = dense.withColumn("nu", 1.0 - F.coalesce(F.sum("c").over(w), F.lit(0)) / F.col("n")).withColumn("level", F.col("base") + (F.col("slot") - 1) * F.col("step"))
    if method in (None, "none"):
        gamma = F.when((F.col("of") <= 1) | (hi == lo), 0.0).otherwise((F.col("level") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))
    else:
        gamma = F.when(F.col("of") <= 1, 0.0).otherwise((F.col("slot") - 1) / F.when(F.col("of") <= 1, 1).otherwise(F.col("of") - 1))
    g = dense.withColumn("gamma", gamma).groupBy(*keys).agg(
        *(F.max(F.when(F.col("gamma") >= q / 100, F.col("nu"))).alias(f"v{q}") for q in (10, 90)), *(F.min(F.when(F.col("nu") <= q / 100, F.col("level"))).alias(f"i{q}") for q in (10, 90)), F.first("next").alias("next"))
    v10, v90 = (F.coalesce(f"v{q}", F.lit(NAN)) for q in (10, 90))
    i10, i90 = (F.coalesce(f"i{q}", "next") for q in (10, 90))
    return g.select(
        *keys, v10.alias("VolumeFractionAt10Intensity"), v90.alias("VolumeFractionAt90Intensity"), i10.alias("IntensityAt10Volume"), i90.alias("IntensityAt90Volume"),
        (v10 - v90).alias("VolumeFractionDifferenceBetween10And90Intensity"), (i10 - i90).alias("IntensityDifferenceBetween10And90Volume"),
    )
