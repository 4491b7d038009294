"""Column profiles: numeric, categorical, time and whole folders of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import to_number
from ..functions.times import from_micros, parse_time
from ..session import union_all
from .ordered import join_keys
from .quantile import exact_percentiles
from .resample import chunk_ends, step_median

# Step lengths in seconds that have a name.
STEP_NAMES = {60: "minute", 3600: "hour", 86400: "day", 604800: "week"}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _sample_skew(c: Column) -> Column:
    n, sd = F.count(c), F.stddev_pop(c)
    g1 = F.when(sd > 0, F.skewness(c)).otherwise(F.lit(0.0))  # a constant has no skew
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def _sample_kurtosis(c: Column) -> Column:
    n, sd = F.count(c), F.stddev_pop(c)
    k = ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return F.when(n > 3, F.when(sd > 0, k).otherwise(F.lit(0.0)))


def profile_numeric(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per column: counts, moments (sample forms), range and exact quartiles.

    One wide aggregate gives everything but the quartiles; those come from value counts.
    """
    cols = list(cols or numeric_columns(df))
    at = [0.25, 0.5, 0.75]
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`").cast("double")
        fields = {
            "variable": F.lit(c), "count": F.count(F.lit(1)), "non_null": F.count(v),
            "missing_count": F.count(F.lit(1)) - F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v),
            "min": F.min(v), "max": F.max(v), "sum": F.coalesce(F.sum(v), F.lit(0.0)),
            "skew": _sample_skew(v), "kurtosis": _sample_kurtosis(v)}
        aggs.append(F.struct(*[e.alias(n) for n, e in fields.items()]).alias(f"__s{i}"))
    d = df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*[F.col(f"__s{i}") for i in range(len(cols))])))
    q = exact_percentiles(df, cols, at, by)
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    q = q.groupBy(*by, "variable").agg(*[pick(p).alias(f"__q{i}") for i, p in enumerate(at)])
    d = join_keys(d, q, [*by, "variable"], plain=["variable"])
    q25, q50, q75 = (F.col(f"__q{i}") for i in range(3))
    return d.select(*by, "variable", F.lit("numeric").alias("type"), "count", "non_null", "missing_count", "mean",
                    q50.alias("median"), "std", "min", q25.alias("25%"), q75.alias("75%"), "max", "sum",
                    "skew", "kurtosis")


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a value per numeric column."""
    cols = list(cols or numeric_columns(df))
    one = df.agg(*[(F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias(f"__{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"__{i}").alias("missing_count"))
                                         for i, c in enumerate(cols)])))


DIGEST = "\0md5:"
SHORT = 32  # bytes up to which a text is its own key; the mark makes every key of a digest longer


def text_key(value: Column) -> Column:
    """A short text itself, a long one's mark and digest of 128 bits."""
    return F.when(F.octet_length(value) <= SHORT, value).otherwise(F.concat(F.lit(DIGEST), F.md5(value)))


def profile_categorical(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values, the commonest one (the smallest on ties) and its frequency.

    Values are counted by :func:`text_key`, so long texts are not sent for the counts.  Only the texts whose
    digest is among the commonest keys are looked at again: the least of them, combined before it is sent.
    """
    cols = list(cols or text_columns(df))
    pairs = F.array(*[F.struct(F.lit(i).alias("variable"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(cols)])
    rows, keys = df.select(*by, F.inline(pairs)), [*by, "variable"]
    n = rows.withColumn("key", text_key(F.col("value"))).groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n"))
    known, short = F.col("key").isNotNull(), F.octet_length("key") <= SHORT
    best = lambda ok: F.min(F.when(known & ok, F.struct((-F.col("n")).alias("n"), F.col("key").alias("v"))))
    per = n.groupBy(*keys).agg(F.count("key").alias("unique_count"), best(short).alias("s"), best(~short)["n"].alias("l"))
    # digests that are as common as the commonest key
    wins = n.where(known & ~short).select(*keys, "key", (-F.col("n")).alias("l"))
    most = per.where("l IS NOT NULL AND (s IS NULL OR l <= s.n)").select(*keys, "l")
    wins = join_keys(wins, most, [*keys, "l"], "inner", plain=["variable", "l"])
    long = rows.where(F.octet_length("value") > SHORT).withColumn("key", text_key(F.col("value")))
    text = join_keys(long, wins.withColumn("hit", F.lit(1)), [*keys, "key"], "inner", plain=["variable", "key"]).groupBy(*keys).agg(F.min("value").alias("text"))
    d = join_keys(per, text, keys, plain=["variable"])
    top = F.least(F.col("text"), F.when(F.col("text").isNull() | (F.col("s.n") == F.col("l")), F.col("s.v")))
    return d.select(*by, F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("variable") + 1).alias("variable"), F.lit("categorical").alias("type"), "unique_count",
                    top.alias("top"), (-F.when(F.col("text").isNull(), F.col("s.n")).otherwise(F.col("l"))).alias("freq"))


def profile_time(df: DataFrame, ts: str, by: Sequence[str] = (), chunk_seconds: int = 21_600) -> DataFrame:
    """First and last time, a step label when all steps are equal, else the median step."""
    kind = df.schema[ts].dataType
    ends = chunk_ends(df, ts, by, chunk_seconds).groupBy(*by).agg(
        from_micros(F.min("__lo")).cast(kind).alias("start"), from_micros(F.max("__hi")).cast(kind).alias("end"))
    med = step_median(df, ts, by, chunk_seconds)
    if by:
        d = join_keys(ends, med, list(by))
    else:
        d = ends.select("*", *[med.select(c).scalar().alias(c) for c in med.columns])  # one row beside one row
    secs = F.col("least_step")
    even = (secs == F.col("greatest_step")) & (secs > 0) & (F.col("steps") >= 2)
    label = F.lit(None).cast("string")
    for s, name in STEP_NAMES.items():
        label = F.when(secs == s, F.lit(name)).otherwise(label)
    label = F.when(even, F.coalesce(label, F.concat(secs.cast("string"), F.lit("s"))))
    return d.select(*by, F.lit(ts).alias("date_column"), "start", "end", label.alias("inferred_freq"),
                    F.when(label.isNull(), F.col("median_step_seconds")).alias("median_delta_seconds"))


def profile_files(df: DataFrame, ts: str, file: str = "file", value_columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric and categorical profile per file, with the file's time profile beside each row."""
    num = [c for c in (value_columns or numeric_columns(df)) if c in df.columns]
    cat = [c for c in text_columns(df) if c not in num and c != file]
    out = profile_numeric(df, num, [file])
    if cat:
        out = union_all([out, profile_categorical(df, cat, [file])], allow_missing=True)
    return join_keys(out, profile_time(df, ts, [file]), [file])


def infer_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Text columns in which every value reads as a number (one aggregate row decides)."""
    cols = list(cols or text_columns(df))
    if not cols:
        return []
    row = df.agg(*[F.count(to_number(F.col(f"`{c}`"))) for c in cols],
                 *[F.count(F.when(F.trim(f"`{c}`") != "", 1)) for c in cols]).first()
    n = len(cols)
    return [c for i, c in enumerate(cols) if row[i] > 0 and row[i] == row[n + i]]


def profile_folder(spark, path, ts: str, value_columns: Sequence[str] | None = None,
                   recursive: bool = False) -> DataFrame:
    """Profile of every CSV below a folder, each in its own encoding and separator; one scan per distinct layout."""
    from ..sources.readers import read_folder_any
    d = read_folder_any(spark, path, clean=False, recursive=recursive, with_file=True)
    num = list(value_columns or infer_numeric(d, [c for c in d.columns if c not in (ts, "file")]))
    d = d.select(*[parse_time(F.col(c)).alias(c) if c == ts else to_number(F.col(f"`{c}`")).alias(c) if c in num
                   else F.col(f"`{c}`") for c in d.columns])
    return profile_files(d, ts, "file", num)
