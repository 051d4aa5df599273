"""Annotation of only what is new: in batches, as variant files arrive, and merged into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import vcf


def only_new(variants: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Variants whose key is not among those already annotated."""
    return variants.join(done.select(*key).distinct(), key, "left_anti")


def annotate_arriving(spark: SparkSession, folder: str, annotate: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Annotate the record lines of files that arrive in ``folder``; each line counts once.

    ``annotate`` takes a frame of VCF lines (column value); batches are independent, so no
    state is kept. A batch owns the folder ``batch=<number>`` of ``output`` and replaces it: a batch that
    ran but was not committed runs again with the same files, and adds nothing. Files may be plain, .gz
    (both split by Spark's text reader where they can be), or .bgz and .bgzf (one task a file). The query ends
    when what has arrived is done.
    """
    plain = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*{.vcf,.gz,.txt}").text(folder)
    blocked = vcf.decoded(spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*{.bgz,.bgzf}").load(folder))
    lines = plain.union(blocked).where("not startswith(value, '#')")

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_BINARY = "path string, modificationTime timestamp, length long, content binary"


class AnnotationStore:
    """Annotated variants by key, of which a merge rewrites only the parts that it touches.

    Rows lie in ``parts`` folders by a hash of their key and are sorted by it; Parquet keeps bloom filters of
    the key's digest, so looking up a few variants skips the other row groups. A merge writes
    the parts with new rows anew, under the version after the last, and then a manifest that names each
    part's version; readers follow the manifest, so they see all of a merge or nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], parts: int = 64):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, parts

    def _versions(self) -> dict[int, int]:
        """The version of each part by the last manifest."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return {}
        numbers = [int(f.getPath().getName()) for f in system.listStatus(root) if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        if not numbers:
            return {}
        return {r["part"]: r["version"] for r in self.spark.read.schema("part int, version long").parquet(f"{self.folder}/manifest/{max(numbers)}").collect()}

    def _digest(self) -> F.Column:
        return F.xxhash64(*[F.col(k).cast("string") for k in self.key])

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("digest", self._digest()).withColumn("part", F.pmod("digest", F.lit(self.parts)).cast("int"))

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The stored rows, of some parts only if they are named; None before the first merge."""
        versions = self._versions()
        paths = [f"{self.folder}/data/version={v}/part={p}" for p, v in versions.items() if parts is None or p in parts]
        if not paths:
            return None
        return self.spark.read.parquet(*paths)

    def missing(self, variants: DataFrame) -> DataFrame:
        """Variants that the store does not hold."""
        held = self.read()
        return variants if held is None else only_new(variants, held, self.key)

    def merge(self, rows: DataFrame) -> list[int]:
        """Insert ``rows`` and replace those with an equal key; returns the parts that were rewritten.

        Keys repeated in ``rows`` count once.
        """
        new = self._placed(rows.dropDuplicates(self.key))
        versions = self._versions()
        touched = sorted(r["part"] for r in new.select("part").distinct().collect())  # at most ``parts``
        if not touched:
            return []
        old = self.read(touched)
        if old is not None:
            kept = old.join(new.select(*self.key), self.key, "left_anti")
            new = self._placed(kept.drop("digest")).unionByName(new, allowMissingColumns=True)
        number = 1 + max(versions.values(), default=0)
        dealt = new.repartition(len(touched), "part").sortWithinPartitions("part", *self.key)
        out = dealt.write.mode("overwrite").option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "1000000")
        out.partitionBy("part").parquet(f"{self.folder}/data/version={number}")
        manifest = versions | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(manifest.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number}")
        return touched

    def lookup(self, **key) -> DataFrame | None:
        """The stored row of one key: reads one part, and there the row groups that may hold its digest."""
        values = [F.lit(key[k]).cast("string") for k in self.key]
        digest = self.spark.range(1).select(F.xxhash64(*values).alias("d")).first()["d"]
        rows = self.read([digest % self.parts])
        if rows is None:
            return None
        for k in self.key:
            rows = rows.where(F.col(k) == F.lit(key[k]))
        return rows.where(F.col("digest") == F.lit(digest)).drop("digest")
