"""Reports: confusion counts, ratios, percentiles, attempts and resource summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def confusion(rows: DataFrame, by: list[str], expected: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 from two boolean columns; denominators are 1 at least, null counts as false."""
    e, p = F.coalesce(expected, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = rows.groupBy(*by).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    ratio = lambda n, d: n / F.greatest(F.lit(1), d)
    counts = counts.withColumn("precision", ratio(c("tp"), c("tp") + c("fp"))).withColumn("recall", ratio(c("tp"), c("tp") + c("fn")))
    return counts.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(F.lit(0.0)))


def set_confusion(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """tp, fp, fn by type from arrays expected and predicted of each case."""
    side = lambda name: cases.select(key, F.explode(F.array_distinct(name)).alias("type"), F.lit(True).alias(name[:4] + "_"))
    both = side("expected").join(side("predicted"), [key, "type"], "full")
    return confusion(both, ["type"], c("expe_"), c("pred_"))


#: Percentile sketches tell ranks to within this share of a group.
SKETCH = 10_000


def _order_statistics(rows: DataFrame, by: list[str], value: Column, fractions: dict[str, float], digits: int = 6) -> DataFrame:
    """by, n and the percentiles of a value, exact and linearly interpolated. No group meets in one task: mergeable sketches, whose ranks are off by
    1/SKETCH of a group at most, bracket each percentile; values below the bracket are counted, and only the distinct values in it (about 6/SKETCH: of a
    hundred million values some 60,000) are ranked. A rank is a whole number, and interpolation reads the next one too, so that the bracket must leave two ranks beyond
    the sketch's error: it does in groups of more than SKETCH values, and smaller ones are bracketed whole. Brackets, some for each group, are broadcast: values
    stay where they are read. Null values do not count; a group of them alone has n 0 and null percentiles."""
    keys = [F.coalesce(c(k).cast("string"), F.lit("")).alias(f"k{i}_") for i, k in enumerate(by)]
    keys += [c(k).isNull().alias(f"z{i}_") for i, k in enumerate(by)]
    names = [f"{x}{i}_" for x in "kz" for i in range(len(by))]
    typed = rows.select(*by, *keys, value.cast("double").alias("v_"))
    cuts = [min(1.0, max(0.0, p + d)) for p in fractions.values() for d in (-3 / SKETCH, 3 / SKETCH)]
    groups = typed.groupBy(*by, *names).agg(F.count("v_").alias("n"), F.min("v_").alias("min_"), F.max("v_").alias("max_"), F.percentile_approx("v_", [float(x) for x in cuts], SKETCH).alias("cuts_"))
    few = c("n") <= SKETCH
    brackets = F.array(*[
        F.struct(F.lit(i).alias("p"), F.when(few, c("min_")).otherwise(F.get("cuts_", 2 * i)).alias("low"), F.when(few, c("max_")).otherwise(F.get("cuts_", 2 * i + 1)).alias("high"), (F.lit(float(p)) * (c("n") - 1)).alias("at")) for i, p in enumerate(fractions.values())
    ])
    told = groups.select(*names, F.explode(brackets).alias("b")).select(*names, "b.*") if names else groups.select(F.explode(brackets).alias("b")).select("b.*")
    values = typed.filter("v_ is not null").select(*names, "v_")
    near = (values.join(F.broadcast(told), names) if names else values.crossJoin(F.broadcast(told))).filter(c("v_") <= c("high"))
    inside = F.when(c("v_") >= c("low"), c("v_"))
    counts = near.groupBy(*names, "p", "at", inside.alias("x")).agg(F.count("*").alias("m"))  # x is null below the bracket
    upto = F.sum("m").over(Window.partitionBy(*names, "p").orderBy(F.asc_nulls_first("x")))
    ranked = counts.withColumn("upto", upto).filter("x is not null")
    low = F.min(F.when(c("upto") > F.floor("at"), c("x")))
    high = F.min(F.when(c("upto") > F.ceil("at"), c("x")))
    first = ranked.groupBy(*names, "p").agg(F.round(low + (F.first("at") - F.floor(F.first("at"))) * (high - low), digits).alias("q"))
    wide = first.groupBy(*names).agg(*[F.max(F.when(c("p") == i, c("q"))).alias(name) for i, name in enumerate(fractions)])
    out = groups.join(wide, names, "left") if names else groups.crossJoin(F.broadcast(wide))
    return out.select(*by, "n", *fractions)


def percentiles(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float], digits: int = 6) -> DataFrame:
    """by, n and percentiles with linear interpolation, rounded; exact."""
    return _order_statistics(rows, by, c(value), fractions, digits)


def attempts(rows: DataFrame, by: list[str], done: Column, ms: str) -> DataFrame:
    """attempts, completed, and median and p95 of the completed; failures stay in the denominator."""
    own = rows.select(*by, F.coalesce(done, F.lit(False)).alias("done_"), c(ms).alias("ms_"))
    counts = own.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if("done_").alias("completed"))
    told = _order_statistics(own, by, F.when(c("done_"), c("ms_")), {"median": 0.5, "p95": 0.95}).drop("n")
    same = F.lit(True)
    for k in by:
        same = same & counts[k].eqNullSafe(told[k])
    return counts.join(told, same).select(*[counts[k] for k in by], "attempts", "completed", "median", "p95")


def stage_medians(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """by, stage and the median of each stage's column."""
    return _order_statistics(rows.unpivot(by, stages, "stage", "value"), [*by, "stage"], c("value"), {"median": 0.5}).drop("n")


def resources(samples: DataFrame, by: list[str], rss: str, cpu: str) -> DataFrame:
    """Number of samples, peak of memory, mean of processor use, and the difference of the peak and the least memory."""
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), F.max(rss).alias("peak_rss"), F.round(F.avg(cpu), 6).alias("mean_cpu"), (F.max(rss) - F.min(rss)).alias("rss_spread"))


def ratio_of_sums(rows: DataFrame, by: list[str], part: str, whole: str, digits: int = 9) -> DataFrame:
    """Sum of parts over sum of wholes (1 at least), not the mean of ratios."""
    return rows.groupBy(*by).agg(F.round(F.sum(part) / F.greatest(F.lit(1), F.sum(whole)), digits).alias("ratio"))


def case_report(cases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From arrays expected and predicted, and critical, of each case: cases; tp, fp and fn over types; the share of cases without
    expected types that have a false one; recall of critical cases' types; share of expected types that are removed. Denominators are 1 at
    least; null arrays are empty."""
    none = F.array().cast("array<string>")
    e, p = F.array_distinct(F.coalesce("expected", none)), F.array_distinct(F.coalesce("predicted", none))
    n = lambda a: F.size(a).cast("long")
    rows = cases.select(*by, n(e).alias("e_"), n(F.array_intersect(e, p)).alias("tp_"), n(F.array_except(p, e)).alias("fp_"), F.coalesce("critical", F.lit(False)).alias("c_"))
    share = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 9)
    critical = lambda x: F.coalesce(F.sum(F.when(c("c_"), c(x))), F.lit(0))
    return rows.groupBy(*by).agg(
        F.count("*").alias("cases"), F.sum("tp_").alias("tp"), F.sum("fp_").alias("fp"), F.sum(c("e_") - c("tp_")).alias("fn"),
        share(F.count_if((c("e_") == 0) & (c("fp_") > 0)), F.count_if(c("e_") == 0)).alias("false_positive_case_rate"), share(critical("tp_"), critical("e_")).alias("critical_recall"), share(F.sum("tp_"), F.sum("e_")).alias("removal_recall"),
    )


def pixel_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """From pixels, sensitive, masked and covered (both) areas: recall of sensitive pixels, precision of the masks, and the share of other
    pixels left alone, each a ratio of sums."""
    share = lambda a, b: F.round(a / F.greatest(F.lit(1), b), 9)
    s, m, v, p = (F.sum(x) for x in ("sensitive", "masked", "covered", "pixels"))
    return rows.groupBy(*by).agg(share(v, s).alias("pixel_recall"), share(v, m).alias("pixel_precision"), F.round(1 - (m - v) / F.greatest(F.lit(1), p - s), 9).alias("preserved"))


def clamped_sum(value: Column) -> Column:
    """Sum of stage times, negative ones as 0."""
    return F.sum(F.greatest(F.lit(0), value))
