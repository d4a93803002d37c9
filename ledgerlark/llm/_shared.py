"""What several operators share: the shared folder, stored tables, running totals."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one bucket of a running total holds on average.
BUCKET_ROWS = 20_000

#: Spark's spelling of the contracts' white space.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        base = f"file://{tempfile.gettempdir()}" if local else spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{base}/checkpoints"
    return f"{folder.rstrip('/')}/ledgerlark-{spark.sparkContext.applicationId}"


#: Lists that stored() notes its tables in; the innermost one counts.
_noted: list[list[str]] = []


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Note in `paths` what stored() writes meanwhile, for drop()."""
    _noted.append(paths)
    try:
        yield
    finally:
        _noted.pop()


def stored(df: DataFrame, *sorted_by: str, options: dict | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and any executor can reread it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if _noted:
        _noted[-1].append(path)
    if sorted_by:
        df = df.sortWithinPartitions(*sorted_by)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that stored() wrote and nothing reads any more, and forget them."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that stored() wrote in this application."""
    drop(spark, [shared_folder(spark)])


def bounded_text_batches(spark: SparkSession) -> None:
    """Arrow batches for Python operators end at 8 MB, so long texts do not add up to a large batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(docs: DataFrame, name: str) -> str:
    """name, with underscores added until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> DataFrame:
    """docs as _row, a number of the row's own, and _doc, all its columns, stored: repeated or null identifiers stay apart, and no name clashes."""
    return stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")))


def id_and_text(rows: DataFrame) -> DataFrame:
    """_row, doc_id and text of keyed rows."""
    return rows.select("_row", "_doc.doc_id", "_doc.text")


#: Rows of one bitmap, and bitmaps (of 4 KB) that are broadcast at most: 64 MB.
BITMAP, MOST_BITMAPS = 32_768, 16_384


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    """Whether a bit of a bitmap_construct_agg bitmap is set; null for no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1


def picked(rows: DataFrame, marks: DataFrame, keep: bool = True) -> DataFrame:
    """The keyed rows that marks (_row) names, or with keep=False the others.

    The marks are made bitmaps. As long as there are MOST_BITMAPS of them or fewer they
    are broadcast and the rows stay where they are; beyond that the rows are joined.
    """
    marks = stored(marks.select("_row"))
    block, bit = F.floor(F.col("_row") / BITMAP), F.pmod("_row", F.lit(BITMAP))
    blocks = marks.select(block.alias("block")).distinct().count()
    if blocks > MOST_BITMAPS:
        return rows.join(marks, "_row", "left_semi" if keep else "left_anti")
    bitmaps = marks.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    found = rows.withColumn("block", block).join(F.broadcast(bitmaps), "block", "left")
    return found.where(F.coalesce(bit_is_set(F.col("bitmap"), bit), F.lit(False)) == F.lit(keep)).select(*rows.columns)


def hex_digits(rows: int) -> int:
    """Leading hex digits of a digest that split `rows` rows into buckets of about BUCKET_ROWS."""
    return max(2, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 2


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str, beside: DataFrame | None = None) -> DataFrame:
    """df plus `out`, the total of `value` over the rows of the same keys that come before in `order`.

    `bucket` must rise with `order` and spread each key's rows: rows are summed within
    (keys, bucket), and only one subtotal a bucket is summed across a key, so no task
    holds all rows of a hot key. The keys must not be null. `beside` has a row a key, whose
    columns the key's rows get by way of the subtotals, likewise spread.
    """
    df = df.withColumn("_bucket", bucket)
    by = [*keys, "_bucket"]
    parts = df.groupBy(*by).agg(F.sum(value).alias("_part"))
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, F.coalesce(F.sum("_part").over(upto), F.lit(0)).alias("_offset"))
    if beside is not None:
        parts = parts.join(beside, keys)
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(parts, by)
        .withColumn(out, (F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long"))
        .drop("_bucket", "_offset")
    )
