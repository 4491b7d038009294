"""Exact percentiles (linear interpolation) of groups of any size.

Groups of at most SMALL rows are aggregated as they are, by Spark's own exact percentile.  Which groups are larger is
counted inside the plan and comes back as BUCKETS flags, one for each hash of a group; a group that shares
the hash of a large one goes its way too.  Large groups are never held as a whole.  Their rows are
counted per distinct value, on a shuffle by group *and* value, and two rounds of ranges, which keep the
order of values, lead to the wanted ranks:

1. ranges that depend on the value alone, two to each factor of e, are counted per group; the ones that hold a rank
   are found from one row per range, and only their values go on;
2. each of these is cut evenly between its own least and greatest value, into as many parts as it takes for PART
   values in each (CUTS at most); the parts are counted, and only the one that holds the rank is ordered.

A million values within a hundredth of each other are so many thousand parts.  Before the second round the values are
dealt out by part, so no range is gathered.  All of it is one plan: nothing runs while it is built, and no
value is dropped or approximated.  Where no group is large, the second way ends at its first, empty stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import union_all
from .ordered import join_keys

PER_E = 2.0
LOWEST = 746.0  # above minus the logarithm of the least positive number
PART, CUTS = 64, 1 << 16
SMALL, BUCKETS = 1 << 14, 4096


def value_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``(by, variable, value, freq)`` with missing values left out; ``variable`` is the column's number in ``cols``."""
    pairs = F.array(*[F.struct(F.lit(i).alias("variable"), F.col(f"`{c}`").cast("double").alias("value"))
                      for i, c in enumerate(cols)])
    return (df.select(*by, F.inline(pairs)).where("value IS NOT NULL")
            .groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("freq")))


def range_of(value: Column) -> Column:
    """The range of a value; never falls as the value rises, since Java's logarithm never does.

    NaN comes last, as in Spark's order; the infinities have a range each.
    """
    size = F.when(F.abs(value) == float("inf"), 1500.0).otherwise(F.log(F.abs(value)) + LOWEST)
    code = F.when(value == 0, 0.0).when(F.isnan(value), 1600.0).otherwise(F.signum(value) * size)
    return F.coalesce(F.floor(code * PER_E).cast("int"), F.lit(0))


def part_of(value: Column, lo: Column, hi: Column, values: Column) -> Column:
    """The part of a range from ``lo`` to ``hi`` with so many different values that a value falls into."""
    cuts = F.least(F.ceil(values / F.lit(PART)), F.lit(CUTS))
    return F.coalesce(F.when(hi > lo, F.least(F.floor((value - lo) / (hi - lo) * cuts), cuts - 1)).cast("int"), F.lit(0))


def is_large(sizes: DataFrame, by: Sequence[str], n: str, small: int | None = None) -> Column:
    """Whether a row's group may have more than ``small`` rows, from a table of group sizes; BUCKETS flags whatever its size."""
    bucket = F.pmod(F.xxhash64(*(by or [F.lit(0)])), F.lit(BUCKETS)).cast("int")
    found = sizes.where(F.col(n) > (SMALL if small is None else small)).agg(F.collect_set(bucket).alias("s"))
    flags = found.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains("s", i)).alias("f"))
    return F.element_at(flags.scalar(), bucket + 1)


def small_percentile(value: Column, ps: Sequence[float]) -> Column:
    """The percentiles as an array; none without values."""
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in ps]))


def percentiles_of_counts(counts: DataFrame, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """``(by, variable, p, value)`` from a ``value_counts`` table, by two rounds of ranges."""
    keys = [*by, "variable"]
    never = ["variable", "__range", "p", "__side", "__part"]  # never missing
    d = counts.withColumn("__range", range_of(F.col("value")))
    shape = [F.sum("freq").alias("__n"), F.count(F.lit(1)).alias("__values"), F.min("value").alias("__lo"), F.max("value").alias("__hi")]
    sizes = d.groupBy(*keys, "__range").agg(*shape)
    w = Window.partitionBy(*keys)
    upto = F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.select("*", upto.alias("__upto")).select("*", F.max("__upto").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"))

    def ranks(p: float) -> list[Column]:
        """The 0-based ranks either side of p*(n-1); the upper one only where it differs."""
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        of = lambda side, rank: F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("__side"), rank.alias("__rank"), (pos - F.floor(pos)).alias("__frac"))
        return [of(0, F.floor(pos)), F.when(F.ceil(pos) > F.floor(pos), of(1, F.ceil(pos)))]
    before = F.col("__upto") - F.col("__n")
    here = F.filter(F.array(*[r for p in ps for r in ranks(p)]), lambda r: (r["__rank"] >= before) & (r["__rank"] < F.col("__upto")))
    wants = sizes.select(*keys, "__range", "__values", "__lo", "__hi", before.alias("__before"), F.inline(here))
    wants = wants.withColumn("__rank", F.col("__rank") - F.col("__before")).drop("__before")

    at = [*keys, "p", "__side"]
    rows = join_keys(d, wants, [*keys, "__range"], "inner", never)
    part = part_of(F.col("value"), F.col("__lo"), F.col("__hi"), F.col("__values")).alias("__part")
    rows = rows.select(*at, "value", "freq", "__rank", "__frac", part).repartition(*at, "__part")
    # what the counts of parts do not need is in them too, so that both uses of the rows are one shuffle
    parts = rows.groupBy(*at, "__part").agg(F.sum("freq").alias("__n"), F.max("__rank").alias("__rank"), F.max("__frac").alias("__f"), F.max("value").alias("__v"))
    upto = F.sum("__n").over(Window.partitionBy(*at).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("__upto", upto).where((F.col("__rank") < F.col("__upto")) & (F.col("__rank") >= F.col("__upto") - F.col("__n"))
                                                   & F.col("__v").isNotNull() & F.col("__f").isNotNull())
    parts = parts.select(*at, "__part", (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__at"))

    rows = join_keys(rows, parts, [*at, "__part"], "inner", never)
    upto = F.sum("freq").over(Window.partitionBy(*at, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__upto", upto).where((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("freq")) & (F.col("__at") <= F.col("__rank")))
    side = lambda i: F.max(F.when(F.col("__side") == i, F.col("value")))
    lo, hi = F.col("__lo"), F.col("__hi")
    return (rows.groupBy(*keys, "p").agg(side(0).alias("__lo"), F.coalesce(side(1), side(0)).alias("__hi"), F.max("__frac").alias("__frac"))
            .select(*keys, "p", F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.col("__frac")).alias("value")))


def exact_percentiles(df: DataFrame, cols: Sequence[str], ps: Sequence[float], by: Sequence[str] = (), small: int | None = None) -> DataFrame:
    """``(by, variable, p, value)``, ``variable`` by name."""
    large = is_large(df.groupBy(*by).agg(F.count(F.lit(1)).alias("__m")), by, "__m", small)
    some = df.where(~large).groupBy(*by).agg(*[small_percentile(F.col(f"`{c}`").cast("double"), ps).alias(f"__q{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(float(p)).alias("p"), F.col(f"__q{i}")[j].alias("value"))
                     for i, c in enumerate(cols) for j, p in enumerate(ps)])
    some = some.select(*by, F.inline(rows)).where("value IS NOT NULL")
    return union_all([some, percentiles_of_columns(df.where(large), cols, ps, by)])


def percentiles_of_columns(df: DataFrame, cols: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by, variable, p, value)`` of large groups, ``variable`` by name."""
    found = percentiles_of_counts(value_counts(df, by, cols), by, ps)
    return found.withColumn("variable", F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("variable") + 1))
