"""Tables that a stream rewrites by buckets, and small files that are switched in one step.

A bucketed table is data of many versions and a manifest that says which version of each
bucket holds. A batch reads and writes the buckets that its keys fall in, then puts a new
manifest in place of the old one by a rename, so what is written grows with the batch. The
manifest also remembers the last batch of each stream: one that runs again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(spark: SparkSession, path: str):
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return to, to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    to, fs = _path(spark, path)
    return fs.exists(to)


def delete(spark: SparkSession, path: str) -> None:
    to, fs = _path(spark, path)
    fs.delete(to, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file in place of what has its name: written beside it, then renamed over it. Readers see the old one or the new one, whole."""
    to, fs = _path(spark, path)
    fs.mkdirs(to.getParent())
    new, _ = _path(spark, f"{to.getParent()}/.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(new), context.makeQualified(to), over)


def get(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


class BucketedTable:
    """A table in hash buckets of its keys under a folder; see create()."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        found = self._manifest()
        self.keys, self.buckets, self.schema = found["keys"], found["number"], T.StructType.fromJson(found["schema"])

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> BucketedTable:
        """A new table of rows. A bucket is what a batch rewrites at least: a table of n bytes wants about n / 128 MB of them."""
        manifest = {"keys": list(keys), "number": buckets, "schema": rows.schema.jsonValue(), "at": {}, "applied": {}}
        put(rows.sparkSession, f"{folder.rstrip('/')}/manifest.json", json.dumps(manifest))
        table = cls(rows.sparkSession, folder)
        table._commit(rows, range(buckets))
        return table

    def _manifest(self) -> dict:
        return json.loads(get(self.spark, f"{self.folder}/manifest.json"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as it is now, or some buckets of it."""
        at = self._manifest()["at"]
        wanted = at if buckets is None else {str(b): at[str(b)] for b in buckets if str(b) in at}
        paths = [f"{self.folder}/{version}/bucket={b}" for b, version in wanted.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _commit(self, rows: DataFrame, touched: Iterable[int], batch: tuple[str, int] | None = None) -> None:
        version = uuid.uuid4().hex
        placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self._bucket().alias("bucket"))
        # A large bucket is written by several tasks, as files of its own; small ones are put together by adaptive execution.
        pieces = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        placed.repartition("bucket", F.pmod(F.hash(*self.keys), F.lit(pieces))).write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        manifest = self._manifest()
        for b in touched:  # of a bounded number
            if exists(self.spark, f"{self.folder}/{version}/bucket={b}"):
                manifest["at"][str(b)] = version
            else:
                manifest["at"].pop(str(b), None)
        if batch:
            manifest["applied"][batch[0]] = batch[1]
        put(self.spark, f"{self.folder}/manifest.json", json.dumps(manifest))

    def applied(self, batch: tuple[str, int]) -> bool:
        """Whether a stream's batch is in the table already."""
        return self._manifest()["applied"].get(batch[0], -1) >= batch[1]

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that rows of these keys fall in."""
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Put change(rows) in place of the rows in the buckets of `keys`; change must keep rows in their buckets. A batch that was applied is left alone."""
        if batch and self.applied(batch):
            return
        buckets = self.touched(keys)
        self._commit(change(self.read(buckets)), buckets, batch)

    def vacuum(self) -> None:
        """Delete versions that no bucket uses; run it when nothing reads older manifests any more."""
        used = set(self._manifest()["at"].values())
        to, fs = _path(self.spark, self.folder)
        for status in fs.listStatus(to):
            if status.isDirectory() and status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
