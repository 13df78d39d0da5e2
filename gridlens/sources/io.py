"""Typed scans, sinks, compaction and size reports.

CSV scans always use an explicit schema (no inference pass over the data);
timestamps are parsed as TIMESTAMP_NTZ like the reference's naive times.
Nothing malformed becomes NULL: ``scan_csv`` returns the rejected rows beside the
others, ``read_readings``, ``read_daily`` and ``compact`` fail on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

D, I, L, S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()

READING_SCHEMA = T.StructType([
    T.StructField("meter_id", S), T.StructField("event_id", L), T.StructField("phase_type", S),
    T.StructField("timestamp", T.TimestampNTZType()),
    *[T.StructField(c, D) for c in ("v1", "v2", "v3", "i1", "i2", "i3", "v_agg", "i_agg", "power_factor",
                                    "energy_consumed_kwh", "expected_energy_kwh", "signal_strength_dbm")],
    T.StructField("data_transmitted", I), T.StructField("tamper_flag", I),
    T.StructField("tamper_duration_hours", I), T.StructField("fault_flag", I), T.StructField("fault_type", S),
    T.StructField("fault_duration_hours", I), T.StructField("meter_status", S),
    T.StructField("reading_gap_minutes", I), T.StructField("location_id", S), T.StructField("feeder_id", S),
    T.StructField("transformer_id", S), T.StructField("band", S), T.StructField("tariff_per_kwh", D),
    T.StructField("total_vended_amount", D), T.StructField("expected_energy_from_vend", D),
])

TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


CORRUPT = "__corrupt"
#: what stands for a missing number or time, as pandas reads it
MISSING = ["", "nan", "-nan", "na", "n/a", "#n/a", "<na>", "null", "none", "nat"]


def _parsed(name: str, kind: T.DataType) -> Column:
    """A text value in its type; NULL if it is missing or can't be read."""
    text = F.trim(F.col(name))
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, T.DateType):
        # ISO, or day first as the reference reads it; a time of day only if it is midnight
        iso = F.regexp_replace(text, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)", "$3-$2-$1")
        day = F.regexp_extract(iso, r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T]00:00(?::00(?:\.0+)?)?)?$", 1)
        return day.try_cast("date")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        fits = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)?$")
        return F.when(fits, text).try_cast(kind)
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("double")  # pandas writes integers beside missing values as 1.0
        return F.coalesce(text.try_cast(kind), F.when((number == F.floor(number)) & (F.abs(number) < 2.0 ** 53), number).try_cast(kind))
    return text.try_cast(kind)


def _number(c: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(the rows in their types, the rejected rows as text with a ``reason``) of a CSV with header.

    Rejected: a record with too few or too many fields, or any value that is neither
    missing nor readable in its column's type.  NaN is missing."""
    text = T.StructType([*[T.StructField(f.name, S) for f in schema], T.StructField(CORRUPT, S)])
    # without column pruning, or a count would not see the fields that tell a broken record
    raw = (spark.read.schema(text).option("header", True).option("columnPruning", False)
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    faults = [F.when(~F.lower(F.trim(F.col(f.name))).isin(MISSING) & _parsed(f.name, f.dataType).isNull(), f.name)
              for f in schema if not isinstance(f.dataType, T.StringType)]
    reason = F.when(F.col(CORRUPT).isNotNull(), F.concat(F.lit("fields: "), CORRUPT)).otherwise(
        F.when(F.coalesce(*faults, F.lit(None)).isNotNull(), F.concat(F.lit("unreadable: "), F.concat_ws(", ", *faults))))
    judged = raw.withColumn("reason", reason)
    rows = judged.where(F.col("reason").isNull()).select(
        *[_number(_parsed(f.name, f.dataType), f.dataType).alias(f.name) for f in schema])
    return rows, judged.where(F.col("reason").isNotNull()).drop(CORRUPT)


def _strict(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """All rows in their types, NaN as NULL; a record that can't be read fails the job."""
    if fmt == "parquet":
        df = spark.read.parquet(path)  # narrowed files are widened again
        return df.select(*[_number(F.col(f.name).cast(f.dataType), f.dataType).alias(f.name) for f in schema])
    rows, rejected = scan_csv(spark, path, schema)
    told = rejected.limit(3).collect()  # asked once, when the scan is made
    if told:
        raise ValueError(f"{path} has rows that can't be read (scan_csv gives them all): {[r['reason'] for r in told]}")
    return rows


def read_readings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A1: raw readings with the fixed schema (CSV with header, or Parquet)."""
    return _strict(spark, path, READING_SCHEMA, fmt)


def read_daily(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """A2: daily summary with its schema (``date_`` as DATE, ISO or day first)."""
    return _strict(spark, path, schema, fmt)


def read_typed(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A3: read a CSV as text and ``try_cast`` the columns named in ``types``
    (unparseable values become NULL instead of failing the job)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in raw.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, compression: str | None = None) -> None:
    """Overwrite or append a table (CSV gets a header row)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("timestampNTZFormat", TS_FORMAT)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def narrow_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type of each number that loses nothing: integers by their range, doubles as
    float where every value survives it.  One aggregate row; strings keep their type
    (Parquet stores repeated ones by dictionary)."""
    whole = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    real = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    lossy = lambda c: F.col(c).cast("float").cast("double") != F.col(c)
    found = df.agg(*[e for c in whole for e in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))],
                   *[F.count_if(lossy(c)).alias(f"lossy_{c}") for c in real], F.count("*").alias("rows")).first()
    plan = {}
    for f in df.schema:
        c = f.name
        if c in whole and found[f"min_{c}"] is not None:
            span = max(found[f"max_{c}"], -found[f"min_{c}"] - 1)
            kind = next(k for k, top in (("tinyint", 2 ** 7), ("smallint", 2 ** 15), ("int", 2 ** 31), ("bigint", 2 ** 63)) if span < top)
            if kind != f.dataType.simpleString():
                plan[c] = kind
        elif c in real and found["rows"] and not found[f"lossy_{c}"]:
            plan[c] = "float"
    return plan


def narrowed(df: DataFrame) -> DataFrame:
    plan = narrow_types(df)
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])


def compact(spark: SparkSession, src: str, dst: str, fmt: str = "gzip", schema: T.StructType = READING_SCHEMA) -> DataFrame:
    """Rewrite a CSV table as gzip CSV or Parquet, in its narrowest types (A9): one pass
    decides them, one writes."""
    df = narrowed(_strict(spark, src, schema, "csv"))
    if fmt == "gzip":
        write_table(df, dst, "csv", compression="gzip")
    elif fmt == "parquet":
        write_table(df, dst, "parquet", compression="zstd")
    else:
        raise ValueError(f"unsupported format {fmt}")
    return size_report(spark, src, dst)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Total bytes under a path from file-system metadata (no data scan)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def size_report(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Sizes in MB before/after and the reduction in percent."""
    a, b = path_bytes(spark, before), path_bytes(spark, after)
    mb = 1024 * 1024
    return spark.createDataFrame(
        [(before, after, a / mb, b / mb, (a - b) / a * 100 if a else None)],
        "source string, target string, original_mb double, compressed_mb double, reduction_pct double")
