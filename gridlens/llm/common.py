"""Helpers shared by the operators: Arrow batches, shared scratch tables,
distributed connected components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from gridlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session.

    Functions are pickled by reference, so that what a module keeps per worker
    (vocabularies, caches) outlives a task."""
    sc = spark.sparkContext
    if getattr(sc, "_gridlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "gridlens.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._gridlens_shipped = True


_kept: dict = {}


def kept(key, make: Callable):
    """What a Python worker keeps between tasks (a vocabulary, a cache).  Only
    the latest one stays, so that the stages of a pipeline don't add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def _give_back() -> None:
    """Return freed memory to the system: idle workers of earlier stages stay alive."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_owner: list[str] = [""]


def map_batches(df: DataFrame, fn: Callable, schema: pa.Schema | StructType, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with the package at hand.

    What a worker kept for the steps of another module goes before ``fn`` starts, and
    each task gives its freed memory back."""
    ship(df.sparkSession)
    owner = owner or fn.__module__

    def run(it):
        if _owner[0] != owner:
            _kept.clear()
            _owner[0] = owner
        try:
            yield from fn(it)
        finally:
            _give_back()

    return df.mapInArrow(run, from_arrow_schema(schema) if isinstance(schema, pa.Schema) else schema)


def batches(schema: pa.Schema, rows: Iterable[tuple], max_rows: int = 4096,
            max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into record batches of bounded size, whatever the row
    length; a task never holds more than one output batch."""
    buf: list[tuple] = []
    used = 0
    for r in rows:
        buf.append(r)
        for v in r:
            if isinstance(v, (bytes, str, list)):
                used += len(v)
        if len(buf) >= max_rows or used >= max_bytes:
            yield _pack(schema, buf)
            buf, used = [], 0
    if buf:
        yield _pack(schema, buf)


def _pack(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` over plain row tuples; ``fn`` sees one iterator per task."""
    def run(it):
        def rows():
            for b in it:
                yield from zip(*(c.to_pylist() for c in b.columns))
        yield from batches(schema, fn(rows()))

    return map_batches(df, run, schema, fn.__module__)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/gridlens-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the
    loss of any executor, and gives later reads one fixed content."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


NO_ID = -(1 << 63)


def own_rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(the rows whose id is theirs alone, all others with a number of their own in ``__row``).

    Null ids and ids of several rows do not tell rows apart.  Such rows, None if there
    are none, are written once, numbered densely from 0 by (id, text hash)."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    many = store(df.groupBy(key.alias("__many")).agg(F.count("*").alias("n")).where(
        (F.col("n") > 1) | (F.col("__many") == NO_ID)).select("__many"), "shared-ids")
    if not many.limit(1).count():
        return df, None
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.join(many, key == F.col("__many"), "left_semi").withColumns({"__id": key, "__hash": F.md5(text_col)})
    # rows that agree in both may lie in several ranges
    rows = rows.withColumn("__any", F.monotonically_increasing_id()).repartitionByRange(n, "__id", "__hash", "__any")
    rows = rows.sortWithinPartitions("__id", "__hash").drop("__id", "__hash", "__any")
    rows = store(rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "shared-id-rows")
    before, offsets = 0, []
    for r in sorted(rows.groupBy("__part").count().collect()):  # one row per partition
        offsets.append((r["__part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    # the lower 33 bits of __at count the rows of a partition
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.join(F.broadcast(offsets), "__part").select(*df.columns, number.alias("__row"))
    return df.join(many, key == F.col("__many"), "left_anti"), rows


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of long vertices.

    ``edges`` (a, b).  Returns (v, label): label is the least vertex of the
    component.  Each round gives a vertex the least label among itself and its
    neighbours, then jumps to that label's own label; both are shuffles
    on vertex keys, so nothing is gathered in one place.  Stops when a round
    changes nothing: labels only ever fall.  Labels are stored between rounds.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
                 .where("a <> b").distinct(), "cc-edges")
    labels = store(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc")
    while True:
        near = (both.join(labels, both.b == labels.v).groupBy(both.a.alias("v"))
                .agg(F.min("label").alias("m")))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("up"))
        new = (new.join(up, F.col("label") == F.col("u"), "left")
               .select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        new = store(new, "cc")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels
