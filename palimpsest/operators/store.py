"""Tables kept on storage by key bucket: a change rewrites the buckets that it touches and no other file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.lineage import cut
from .catalog import upsert

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketStore:
    """Rows under `path` as Parquet by `bucket`, a hash of `key` (a document's id) into `buckets` folders.

    All rows of a key are in one bucket, so a change reads and rewrites the buckets of its keys alone, by Spark's
    dynamic partition overwrite. A bucket whose rows stay the same is not written, so a change that is applied again
    leaves all files as they are. Each bucket is replaced as a whole; a change that ends between two buckets is finished by
    applying it again. One writer at a time. The number of buckets is fixed when the store is made: some 128 MB each.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str = "document_id"
    buckets: int = 64

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _folder(self, bucket: int | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path if bucket is None else f"{self.path}/{BUCKET}={bucket}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self) -> DataFrame:
        files, path = self._folder()
        kind = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        if not files.exists(path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", self.path).parquet(self.path)

    def read(self, keys: list | None = None) -> DataFrame:
        """All rows, or those of some keys, for which only their buckets' files are read."""
        rows = self._read()
        if keys is not None:
            at = [r[0] for r in self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]])).select(self.bucket_of(F.col(self.key))).distinct().collect()]
            rows = rows.filter(F.col(BUCKET).isin(at) & F.col(self.key).isin(keys))
        return rows.select(*self.schema.names)

    def change(self, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put `merge` of the rows of the touched keys' buckets in their place; the buckets that were written or removed.

        `touched` has the keys; what comes to the driver is numbers of buckets and a checksum of each.
        """
        at = sorted(r[0] for r in touched.select(self.bucket_of(F.col(self.key)).alias(BUCKET)).distinct().collect())
        if not at:
            return []
        names = self.schema.names
        old = self._read().filter(F.col(BUCKET).isin(at))
        new = cut(merge(old.select(*names)).select(*names).withColumn(BUCKET, self.bucket_of(F.col(self.key))))
        plain = [F.to_json(F.struct(F.col(f.name))) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in self.schema.fields]
        sums = lambda rows: {r[0]: r[1:] for r in rows.groupBy(BUCKET).agg(F.count("*"), F.bit_xor(F.xxhash64(*plain)), F.sum(F.shiftright(F.xxhash64(F.lit(1), *plain), 24))).collect()}
        before, after = sums(old), sums(new)
        changed = [b for b in at if before.get(b) != after.get(b)]
        kept = [b for b in changed if b in after]
        if kept:
            rows = new.filter(F.col(BUCKET).isin(kept)).repartition(len(kept), BUCKET).sortWithinPartitions(BUCKET, self.key)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for bucket in changed:
            if bucket not in after:
                files, path = self._folder(bucket)
                files.delete(path, True)
        return changed

    def upsert(self, changes: DataFrame, keys: list[str], version: str) -> list[int]:
        """Rows that are new or later by `version` put in, one row for each of `keys`."""
        return self.change(changes, lambda rows: upsert(rows, changes.select(*self.schema.names), keys, version))

    def replace(self, fresh: DataFrame, documents: DataFrame | None = None) -> list[int]:
        """All rows of the fresh rows' documents replaced; `documents` (key) names those that have no fresh row too."""
        named = fresh.select(self.key) if documents is None else fresh.select(self.key).unionByName(documents.select(self.key))
        named = named.distinct()
        return self.change(named, lambda rows: rows.join(named, self.key, "left_anti").unionByName(fresh.select(*self.schema.names)))

    def delete(self, gone: DataFrame) -> list[int]:
        """The documents' rows removed."""
        return self.change(gone, lambda rows: rows.join(gone.select(self.key).distinct(), self.key, "left_anti"))


def delete_from_stores(stores: list[BucketStore], gone: DataFrame, key: str = "document_id") -> dict[str, list[int]]:
    """Documents removed from every store; the buckets that changed, by path. A run that was stopped is finished by running it again."""
    return {s.path: s.delete(gone.select(F.col(key).alias(s.key))) for s in stores}
