"""Readers.  Files are opened by Spark; the driver sees names, headers and sampled lines only."""

from __future__ import annotations

import csv
import json
import re
import warnings
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import date_from_parts, date_from_stamp
from ..operators.clean import clean_name
from ..session import union_all

BOM = "﻿"
# A data line of the irradiance model, stamped 20050101:0010 or in ISO form.
DATA_ROW = r"^\s*(\d{8}:\d{4}|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*,"
# A number in the preamble (a month and its year there are two numbers with a comma between them).
NUMBER = r"[-+]?[0-9]*\.?[0-9]+"


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header line, a byte-order mark before it or not.

    Give a schema for anything large; without one all columns are text.
    """
    r = spark.read.options(header="true", enforceSchema="true", **options)
    df = (r.schema(schema) if schema is not None else r).csv(path)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def drop_repeated_headers(df: DataFrame, column: str = "LocalTime") -> DataFrame:
    """Without rows in which the column holds its own name."""
    return df.where(~F.trim(F.col(column)).eqNullSafe(F.lit(column)))


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def first_lines(spark: SparkSession, path, n: int, recursive: bool = False) -> DataFrame:
    """``(file, lines)``: the first ``n`` lines of each file that has any, as bytes, line ends taken off.

    A session of its own puts every file into one task, which leaves off reading a large file after one batch: only
    its first buffer is read.  Small ones are read out, since a task that leaves off costs its Python worker.
    Spark opens the files, so any store it knows will do.
    """
    own, small = spark.newSession(), 4 << 20
    for key, value in {"spark.sql.files.openCostInBytes": str(1 << 40), "spark.sql.files.maxPartitionBytes": str(1 << 40),
                       "spark.sql.execution.arrow.maxRecordsPerBatch": str(max(n, 1000))}.items():
        own.conf.set(key, value)

    def run(batches):
        import pyarrow as pa
        done = False
        for batch in batches:
            if batch.num_rows and not done:
                lines = pa.array([batch.column("value").slice(0, n).to_pylist()], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column("file").slice(0, 1), lines], ["file", "lines"])
                done = True
                if batch.column("size")[0].as_py() > small:
                    return
    d = own.read.option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").text(path)
    return d.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).mapInArrow(run, "file string, lines array<binary>")


def _file_names(spark: SparkSession, path, recursive: bool = False) -> list[str]:
    """All files, empty ones too, as Spark names them; their contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return sorted(re.sub("^file:/+", "file:/", f) for f in d.inputFiles())


def read_preamble_csv(spark: SparkSession, path, schema: T.StructType, row_regex: str = DATA_ROW, head_lines: int = 200) -> DataFrame:
    """Data lines of files with text before and after them; everything else is passed over.

    Lines are told apart by their own shape, so a file may be read in any number of splits.  A line among the first
    ``head_lines`` that begins with the schema's first name is the file's header: cells are then taken by name,
    in whatever order the file has them.  A file without one has the schema's order.  Files with one
    header are read together, and no line is sent anywhere.
    """
    first = schema.fields[0].name.lower() + ","
    texts = F.transform("lines", lambda x: F.lower(F.trim(_text(x))))
    heads = first_lines(spark, path, head_lines).select("file", F.try_element_at(F.filter(texts, lambda x: x.startswith(first)), F.lit(1)).alias("head"))
    groups: dict[str | None, list[str]] = {}
    for r in heads.collect():  # a row per file
        groups.setdefault(r["head"], []).append(r["file"])
    if not groups:
        raise FileNotFoundError(f"no readable file at {path}")
    cells = F.transform(F.split(F.trim("value"), ","), lambda c: F.trim(c))
    parts = []
    for head in sorted(groups, key=lambda h: h or ""):
        names = [c.strip() for c in head.split(",")] if head else [f.name.lower() for f in schema.fields]

        def cell(f: T.StructField, names=names) -> Column:
            at = names.index(f.name.lower()) + 1 if f.name.lower() in names else None
            text = F.nullif(F.try_element_at("cells", F.lit(at)), F.lit("")) if at else F.lit(None).cast("string")
            return text.try_cast(f.dataType).alias(f.name)
        lines = _lines(spark, [_plain_path(f) for f in sorted(groups[head])])
        data = lines.where(F.col("value").rlike(row_regex)).select("file", cells.alias("cells"))
        parts.append(data.select("file", *[cell(f) for f in schema.fields]))
    return union_all(parts)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_preamble_meta(spark: SparkSession, path) -> DataFrame:
    """One row per file: latitude, longitude and the month-to-source-year map."""
    d = _lines(spark, path).where(~F.col("value").rlike(DATA_ROW))
    low = F.lower("value")
    number = F.regexp_extract("value", f"({NUMBER})", 1).try_cast("double")
    month = F.regexp_extract("value", r"^\s*(\d{1,2})\s*,\s*(\d{4})\s*$", 1).try_cast("int")
    year = F.regexp_extract("value", r"^\s*(\d{1,2})\s*,\s*(\d{4})\s*$", 2).try_cast("int")
    return d.groupBy("file").agg(
        F.max(F.when(low.contains("latitude"), number)).alias("latitude"),
        F.max(F.when(low.contains("longitude"), number)).alias("longitude"),
        F.map_from_entries(F.array_sort(F.collect_set(
            F.when(month.between(1, 12), F.struct(month.alias("month"), year.alias("year")))))).alias("years"))


def _files(spark: SparkSession, path, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``(path, modificationTime)`` of the files; their contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "modificationTime"))


def _plain_path(url: str) -> str:
    """A file's path for a reader: as it is on disk, with the signs that globs read marked."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(url))


def _text(raw: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def _split_header(line: str, sep: str = ",") -> list[str]:
    return [c.strip() for c in next(csv.reader([line.lstrip(BOM).rstrip("\r\n")], delimiter=sep))]


def _by_name(spark: SparkSession, groups: dict[tuple, list[str]], clean: bool, with_file: bool) -> DataFrame:
    """One scan for each (header, encoding, separator) and its files, joined by column name."""
    parts = []
    for head, encoding, sep in sorted(groups):
        names = _split_header(head, sep)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        options = {"header": "true", "enforceSchema": "true", "encoding": encoding, "sep": sep, "comment": "#"}
        d = spark.read.schema(schema).options(**options).csv([_plain_path(f) for f in sorted(groups[head, encoding, sep])])
        cols = [F.col(f"`{n}`").alias(clean_name(n) if clean else n) for n in names]
        if with_file:
            cols.append(F.url_decode(F.col("_metadata.file_path")).alias("file"))
        parts.append(d.select(*cols))
    return union_all(parts, allow_missing=True)


def union_folder(spark: SparkSession, path, clean: bool = True, recursive: bool = False,
                 with_file: bool = False) -> DataFrame:
    """All CSVs of a folder (UTF-8, commas) as text columns, joined by column name.

    One scan per distinct header rather than per file; of each file only the first lines are read for it.  A
    file without a header is passed over with a warning that names it.
    """
    heads = first_lines(spark, path, 64, recursive).select(
        "file", F.try_element_at(F.filter(F.transform("lines", _text), lambda x: (F.trim(x) != "") & ~x.startswith("#")), F.lit(1)).alias("head"))
    groups: dict[tuple, list[str]] = {}
    passed = set(_file_names(spark, path, recursive))
    for r in heads.where("head IS NOT NULL").collect():  # a row per file
        groups.setdefault((r["head"], "UTF-8", ","), []).append(r["file"])
        passed.discard(r["file"])
    for file in sorted(passed):
        warnings.warn(f"passed over {unquote(file)}: no header", stacklevel=2)
    if not groups:
        raise FileNotFoundError(f"no readable file at {path}")
    return _by_name(spark, groups, clean, with_file)


SEPARATORS = (",", ";", "\t", "|")


def folder_layouts(spark: SparkSession, path, recursive: bool = False, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"),
                   seps: Sequence[str] = SEPARATORS) -> DataFrame:
    """``(file, header, encoding, sep, reason)`` of every file, from one pass over the lines.

    Each file is judged for itself.  The second encoding is taken if any of its lines is not valid UTF-8.  The header is
    the first line that is neither blank nor a ``#`` comment.  The separator is the first one that
    stands equally often, outside quotes, in all such lines; else the first one in the header that no line has more
    often.  ``reason`` is missing for a file that can be read; otherwise it says why not.
    """
    line = F.col("value")
    bare = F.regexp_replace(line, '"[^"]*"', "")
    real = ~line.startswith("#") & (F.trim("value") != "")
    often = [F.when(real, F.size(F.split(bare, re.escape(s))) - 1) for s in seps]
    d = (spark.read.option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", "true").text(path)
         .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")))
    place = F.when(real, F.struct("block", "n"))  # rows of a block come in order, and a block is read by one task
    found = d.groupBy("file").agg(
        F.min_by(line.cast("binary"), place).alias("raw"), F.coalesce(F.bool_or(~F.is_valid_utf8(line)), F.lit(False)).alias("broken"),
        F.max(F.when(line.contains("\0"), True)).alias("binary"),
        *[F.min_by(n, place).alias(f"at{i}") for i, n in enumerate(often)],
        *[F.min(n).alias(f"lo{i}") for i, n in enumerate(often)], *[F.max(n).alias(f"hi{i}") for i, n in enumerate(often)])
    every = spark.createDataFrame([(f,) for f in _file_names(spark, path, recursive)], "file string")  # a row per file
    even = F.coalesce(*[F.when((F.col(f"lo{i}") == F.col(f"hi{i}")) & (F.col(f"lo{i}") > 0), F.lit(s)) for i, s in enumerate(seps)])
    short = F.coalesce(*[F.when((F.col(f"at{i}") > 0) & (F.col(f"hi{i}") <= F.col(f"at{i}")), F.lit(s)) for i, s in enumerate(seps)])
    none = F.when(F.greatest(*[F.coalesce(F.col(f"at{i}"), F.lit(0)) for i in range(len(seps))]) == 0, F.lit(seps[0]))
    over = none.isNotNull() & (F.greatest(*[F.coalesce(F.col(f"hi{i}"), F.lit(0)) for i in range(len(seps))]) > 0)
    sep = F.coalesce(even, short, F.when(~over, none))
    reason = (F.when(F.col("raw").isNull(), "no header").when(F.col("binary"), "not a text file")
              .when(F.col("sep").isNull(), "a line has more cells than the header"))
    return (every.join(found, "file", "left").withColumn("sep", sep)
            .select("file", F.when(F.col("broken"), F.decode("raw", encodings[-1])).otherwise(F.col("raw").cast("string")).alias("header"),
                    F.when(F.col("broken"), encodings[-1]).otherwise(encodings[0]).alias("encoding"), "sep", reason.alias("reason")))


def read_folder_any(spark: SparkSession, path, clean: bool = True, recursive: bool = False, with_file: bool = False,
                    encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"), seps: Sequence[str] = SEPARATORS) -> DataFrame:
    """All CSVs of a folder as text columns, joined by column name, each file in its own encoding and with its own separator.

    Files that can't be read are passed over with a warning that names them and says why.
    """
    groups: dict[tuple, list[str]] = {}
    for r in folder_layouts(spark, path, recursive, encodings, seps).collect():  # a row per file
        if r["reason"] is None:
            groups.setdefault((r["header"], r["encoding"], r["sep"]), []).append(r["file"])
        else:
            warnings.warn(f"passed over {unquote(r['file'])}: {r['reason']}", stacklevel=2)
    if not groups:
        raise FileNotFoundError(f"no readable file at {path}")
    return _by_name(spark, groups, clean, with_file)


def read_monthly_files(spark: SparkSession, path) -> DataFrame:
    """Monthly day files: column names on line 2, year and month in the file name.

    The first two lines of each file are read ahead; files that agree in them are read together, line by line.  A
    ``yyyymmddhh`` column, where present, gives the date parts; otherwise they come from the file
    name and ``ObsTime`` (or ``Day``, or 1).
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for r in first_lines(spark, path, 2).where("size(lines) = 2").select("file", *[_text(F.col("lines")[i]).alias(f"h{i}") for i in range(2)]).collect():  # a row per file
        groups.setdefault((r["h0"], r["h1"]), []).append(r["file"])
    # a copy mark such as " (1)" after the month is passed over
    stamp = r"-(\d{4})-(\d{1,2})[^/\-]*?\.csv"
    parts = []
    for title, head in sorted(groups):
        names = _split_header(head)
        ddl = ", ".join(f"`{n}` string" for n in names)
        lines = _lines(spark, [_plain_path(f) for f in sorted(groups[title, head])])
        text = _text(F.col("value").cast("binary"))
        rows = lines.where((F.trim("value") != "") & ~text.isin(title, head)).select("file", text.alias("line"))
        d = rows.select("file", F.from_csv("line", ddl).alias("r")).select("file", "r.*")
        path_txt = F.url_decode("file")
        year, month = (F.regexp_extract(path_txt, stamp, i).try_cast("int") for i in (1, 2))
        day = F.lit(1)
        if "yyyymmddhh" in names:
            date = date_from_stamp(F.col("yyyymmddhh"))
            year, month, day = F.year(date), F.month(date), F.day(date)
        elif "Day" in names:
            day = F.col("Day").try_cast("int")
        if "ObsTime" in names:
            day = F.col("ObsTime").try_cast("double").cast("int")
            d = d.withColumn("ObsTime", F.lpad("ObsTime", 2, "0"))
        stamp_cols = {"Year": year, "Month": month, "Day": day}
        rest = [c for c in d.columns if c not in stamp_cols]
        d = d.select(*[F.col(f"`{c}`") for c in rest], *[v.cast("int").alias(k) for k, v in stamp_cols.items()])
        d = d.withColumn("Date", date_from_parts(F.col("Year"), F.col("Month"), F.col("Day")))
        parts.append(d)
    if not parts:
        raise FileNotFoundError(f"no monthly file at {path}")
    return union_all(parts, allow_missing=True)


def latest_file(spark: SparkSession, path, pattern: str = "*", recursive: bool = True) -> str | None:
    """Path of the newest file whose name matches the glob; contents are not read."""
    d = _files(spark, path, pattern, recursive)
    row = d.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0]


def sniff(spark: SparkSession, path, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"),
          seps: Sequence[str] = SEPARATORS) -> dict[str, str]:
    """Reader options for files of unknown encoding and separator, from one pass over all lines.

    The second encoding is taken if any line is not valid UTF-8; the separator is the first one that stands
    equally often, outside quotes, in every line that is neither empty nor a comment.
    """
    line = F.col("value")
    bare = F.regexp_replace(line, '"[^"]*"', "")
    counted = F.when(~line.startswith("#") & (F.trim("value") != ""), F.lit(1))
    often = [F.when(counted.isNotNull(), F.size(F.split(bare, re.escape(s))) - 1) for s in seps]
    row = spark.read.text(path).agg(F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)).alias("broken"),
                                    *[F.min(n).alias(f"lo{i}") for i, n in enumerate(often)], *[F.max(n).alias(f"hi{i}") for i, n in enumerate(often)]).first()
    best = next((s for i, s in enumerate(seps) if row[f"lo{i}"] and row[f"lo{i}"] == row[f"hi{i}"]), seps[0])
    return {"encoding": encodings[-1] if row["broken"] else encodings[0], "sep": best, "comment": "#"}


def read_csv_any(spark: SparkSession, path, schema=None, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"),
                 seps: Sequence[str] = SEPARATORS) -> DataFrame:
    """CSV of unknown encoding and separator, ``#`` lines passed over: options first, then one scan."""
    return read_csv(spark, path, schema, **sniff(spark, path, encodings, seps))


def read_hourly_json(spark: SparkSession, path, path_expr: str, row_schema: T.StructType,
                     time_col: str = "time(UTC)", with_file: bool = False, multi_line: bool = True) -> DataFrame:
    """The array at ``path_expr`` of each JSON document as rows in time order of their stamps.

    ``path_expr`` such as ``outputs.tmy_hourly`` names where the table is; only that branch of
    the document is parsed.
    """
    schema: T.DataType = T.ArrayType(row_schema)
    for part in reversed(path_expr.split(".")):
        schema = T.StructType([T.StructField(part, schema)])
    d = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)
    cols = [F.col("_metadata.file_path").alias("file")] if with_file else []
    d = d.select(*cols, F.explode(path_expr).alias("r")).select(*(["file"] if with_file else []), "r.*")
    stamp = F.col(f"`{time_col}`")
    stamp_iso = F.regexp_replace(stamp, r"^(\d{4})(\d{2})(\d{2}):(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:00")
    return d.withColumn("time_utc", stamp_iso.try_cast("timestamp_ntz")).where("time_utc IS NOT NULL")



# Measures that tell an hourly table of the irradiance model from other lists.
KNOWN_MEASURES = ("t2m", "rh", "g(h)", "gb(n)", "gd(h)", "ws10m", "wd10m", "sp")


def _tables(kind: T.DataType, known: Sequence[str], at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], list[str]]]:
    """(path, keys) of the arrays of objects that have a time key and a known measure, by path."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        keys = kind.elementType.names
        low = [k.lower() for k in keys]
        return [(at, keys)] if any("time" in k or "date" in k for k in low) and any(k in known for k in low) else []
    if isinstance(kind, T.StructType):
        return [t for f in kind.fields for t in _tables(f.dataType, known, (*at, f.name))]
    return []


def _variant_path(parts: Sequence[str]) -> str:
    return "$" + "".join(f"[{json.dumps(p, ensure_ascii=False)}]" for p in parts)


# In what ``schema_of_variant`` tells: a quoted name, or the type of a value that is neither object nor array.
PLAIN_TYPE = r"(`(?:[^`]|``)*`)|(?<=: |ARRAY<)(?:[A-Z_]+\(\d+,\d+\)|[A-Z_]+)(?=[,>])"


def _nesting(text: str) -> T.DataType:
    """The type behind such a text without its plain types, all of which are taken for strings."""
    quoted = re.split(r"(`(?:[^`]|``)*`|[^\s<>,:`]+(?=: ))", text)  # names stay as they are
    text = "".join(x if i % 2 else x.replace("OBJECT<", "STRUCT<") for i, x in enumerate(quoted))
    return T.DataType.fromDDL(re.sub(": (?=[,>])", ": STRING", text).replace("ARRAY<>", "ARRAY<STRING>"))


def read_hourly_json_any(spark: SparkSession, path, known: Sequence[str] = KNOWN_MEASURES, multi_line: bool = True) -> DataFrame:
    """``(file, time_utc, <measures>)`` of JSON documents whose nesting is not known.

    The hourly table is the first array, by path, whose objects have a key with "time" or "date" in its name and
    a known measure.  The different nestings that documents have give all such paths; each document is then
    read at the first of them that it has.  Documents and rows may name their time differently.
    """
    text = spark.read.text(path, wholetext=multi_line).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    nestings = text.select(F.regexp_replace(F.schema_of_variant("v"), PLAIN_TYPE, "$1").alias("s")).where("s LIKE 'OBJECT<_%'").distinct()
    tables: dict[tuple, dict] = {}
    for r in nestings.collect():  # a row per nesting, however many documents have it
        for at, ks in _tables(_nesting(r["s"]), [k.lower() for k in known]):
            tables.setdefault(at, {}).update(dict.fromkeys(ks))
    if not tables:
        raise ValueError(f"no array with a time and one of {', '.join(known)} in {path}")
    rows = F.coalesce(*[F.try_variant_get("v", _variant_path(at), "array<variant>") for at in sorted(tables)])
    keys = list(dict.fromkeys(k for at in sorted(tables) for k in sorted(tables[at])))
    times = [k for k in keys if "time" in k.lower() or "date" in k.lower()]
    d = text.select("file", F.explode(rows).alias("r"))
    get = lambda k, kind: F.try_variant_get("r", _variant_path([k]), kind)
    stamp = F.coalesce(*[get(k, "string") for k in times])
    stamp = F.regexp_replace(stamp, r"^(\d{4})(\d{2})(\d{2}):(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:00")
    measures = [k for k in keys if k.lower() in {x.lower() for x in known}]
    d = d.select("file", stamp.try_cast("timestamp_ntz").alias("time_utc"), *[get(k, "double").alias(k) for k in measures])
    return d.where("time_utc IS NOT NULL")
