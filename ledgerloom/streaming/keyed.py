"""State by key that batches are merged into: compact, readable at any time, and safe to repeat.

Rows live in buckets by the hash of their key.  A batch rewrites the buckets it touches, as a new generation next to the
old one, and then writes a pointer that says which generation each bucket has.  Readers follow the newest pointer, so
they see all of a batch or nothing.  A batch that was killed leaves files that no pointer names; repeating it writes them
again.  A batch that is merged already is left out.  What is kept grows with the keys and not with the batches: besides
the newest pointer's generations only those of the one before it stay, for readers that are still at it.

How two rows of a key become one is given by an aggregate for each column.  These must be associative, as a batch is
combined in itself first; so any split of the same rows into batches gives the same state.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col


def latest(columns: list[str], key: list[str], order: str) -> dict[str, Column]:
    """The aggregates of "the row with the highest order wins"."""
    return {x: F.max(order) if x == order else F.max_by(x, order) for x in columns if x not in key}


class KeyedState:
    """Rows of ``schema``, one for each key, in ``folder``.

    ``merge`` has an aggregate over the rows of a key for every other column; ``removed`` is a condition on a row that
    stands for a deleted key: such rows are kept, so that an older row that comes late does not bring the key back, but
    not shown.  Null keys are a key like others.  ``changes`` holds for every batch what it inserted, updated and deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: list[str], merge: dict[str, Column], removed: str = "false", buckets: int = 32):
        if {*key, *merge} != set(schema.names):
            raise ValueError("a key or an aggregate is needed for every column")
        self.spark, self.folder, self.key, self.merge_by, self.buckets = spark, folder.rstrip("/"), key, merge, buckets
        self.is_removed = F.coalesce(F.expr(removed), F.lit(False))
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.values = [x for x in schema.names if x not in key]

    # files ----------------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, *parts: str) -> None:
        path, files = self._path(*parts)
        files.delete(path, True)

    def pointers(self) -> list[int]:
        """The batches that have a pointer, oldest first."""
        path, files = self._path("pointers")
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def pointer(self, batch: int) -> dict[int, int]:
        """From buckets to their generation."""
        text = self.spark.read.text(f"{self.folder}/pointers/{batch}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def _point(self, batch: int, generations: dict[int, int]) -> None:
        """Written beside its place and renamed, so there is no half of a pointer."""
        draft, files = self._path("pointers", f"_{batch}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(generations).encode()))
        out.close()
        if not files.rename(draft, self._path("pointers", str(batch))[0]):
            raise OSError(f"batch {batch} has got its pointer from another writer")

    def _read(self, generations: dict[int, int], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/rows/{g}/_bucket={b}" for b, g in generations.items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # rows -----------------------------------------------------------------------------------------------------------

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Merge a batch of rows; ``number`` rises from batch to batch.  Returns the buckets that were read and written."""
        done = self.pointers()
        if done and done[-1] >= number:
            return []
        generations = self.pointer(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        # combined before it meets the state, so that many rows of a key are one
        batch.groupBy(*self.key).agg(*[a.alias(x) for x, a in self.merge_by.items()]).withColumn("_bucket", bucket).write.mode("overwrite").parquet(f"{self.folder}/arrived")
        arrived = self.spark.read.parquet(f"{self.folder}/arrived")
        touched = sorted(r[0] for r in arrived.select("_bucket").distinct().collect())  # at most as many as there are buckets
        if touched:
            rows = self._read(generations, touched).withColumn("_bucket", bucket).withColumn("_stored", F.lit(True)).unionByName(arrived.withColumn("_stored", F.lit(False)))
            before = F.max(F.when(c("_stored"), F.struct((~self.is_removed).alias("live"), *self.values))).alias("_before")
            merged = rows.repartition(len(touched), "_bucket").groupBy("_bucket", *self.key).agg(*[a.alias(x) for x, a in self.merge_by.items()], before)
            was, same = F.coalesce(c("_before.live"), F.lit(False)), F.struct(*self.values).eqNullSafe(F.struct(*[c(f"_before.{x}") for x in self.values]))
            change = F.when(~was & ~self.is_removed, "inserted").when(was & self.is_removed, "deleted").when(was & ~same, "updated")
            merged.select("_bucket", *self.schema.names, change.alias("change")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/rows/{number}")
            written = self.spark.read.schema(T.StructType([*self.schema, T.StructField("change", T.StringType())])).parquet(f"{self.folder}/rows/{number}")
            written.where("change is not null").write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")
        self._point(number, {**generations, **dict.fromkeys(touched, number)})
        if len(done) > 1:  # nothing names these any more
            oldest = self.pointer(done[-2])
            for b, g in oldest.items():
                if generations.get(b) != g:
                    self._delete("rows", str(g), f"_bucket={b}")
            self._delete("pointers", str(done[-2]))
        return touched

    def rows(self) -> DataFrame:
        """The rows of all keys that are not deleted, after the newest batch."""
        done = self.pointers()
        return self._read(self.pointer(done[-1]) if done else {}).where(~self.is_removed)

    def changes(self, batch: int | None = None) -> DataFrame:
        """What batches changed, or one of them: the new row (of a deleted key the one that deleted it), the change and the batch."""
        schema = T.StructType([*self.schema, T.StructField("change", T.StringType()), T.StructField("batch", T.LongType())])
        path, files = self._path("changes")
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.folder}/changes").parquet(f"{self.folder}/changes/batch=*")
        return found if batch is None else found.where(c("batch") == batch)
