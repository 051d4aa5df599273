"""Variant call files: reading lines of any compression and writing annotated files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alleles import chrom_norm, split_alts
from ..options import compression_of
from . import bgzf

_FIXED = ("chrom", "start", "id", "ref", "alt", "qual", "filter", "info")


#: Compressed bytes of a block gzip file for each task.
RANGE = 16 << 20


def read_lines(spark: SparkSession, path: str, task: int = RANGE) -> DataFrame:
    """Lines (value) of a plain, .gz, .bgz or .bgzf file.

    Spark's text reader splits plain files. Block gzip is read by ranges of ``task`` bytes,
    under whatever of the three suffixes; plain gzip under .gz in one task, as it cannot be split.
    """
    if not path.endswith((".gz", ".bgz", ".bgzf")):
        return spark.read.text(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    size = system.getFileStatus(place).getLen()
    with _open(path) as (file, _):
        blocked = size == 0 or bgzf.member_size(file.read_at(min(size, 64), 0), 0) > 0
    if not blocked:
        return spark.read.text(path) if path.endswith(".gz") else decoded(spark.read.format("binaryFile").load(path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(path) as (file, n):
            for b in batches:
                for begin in b.column(0).to_pylist():
                    lines = bgzf.lines_of_range(file, n, begin, min(begin + task, n))
                    for k in range(0, len(lines), 10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lines[k : k + 10_000]], pa.string())], names=["value"])

    # in the order of the file, a range for each task
    return spark.range(0, max(size, 1), task, -(-max(size, 1) // task)).mapInArrow(read, "value string")


@contextmanager
def _open(path: str) -> Iterator[tuple]:
    """A file of any file system that Arrow knows, for reads at places, and its size."""
    system, place = _system(path)
    with system.open_input_file(place) as file:
        yield file, file.size()


def decoded(files: DataFrame) -> DataFrame:
    """Lines (value) of compressed files that were read whole (content), a file to a task."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                lines = bgzf.decompress(raw).decode().splitlines()
                for k in range(0, len(lines), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[k : k + 10_000], pa.string())], names=["value"])

    return files.select("content").mapInArrow(decode, "value string")


def header(spark: SparkSession, path: str, first: int = 10_000) -> list[str]:
    """The lines that start with #, which come before all records."""
    lines = [r[0] for r in read_lines(spark, path).limit(first).collect()]
    found = [x for x in lines if x.startswith("#")]
    if len(found) < first:
        return found
    return [r[0] for r in read_lines(spark, path).where("startswith(value, '#')").collect()]


def parse(lines: DataFrame) -> DataFrame:
    """Records of lines: fixed columns, the rest of the line in ``samples``; . becomes null."""
    part = F.split("value", "\t", 9)
    text = lambda k: F.nullif(F.get(part, F.lit(k)), F.lit("."))
    kinds = {"start": "long", "qual": "double"}
    columns = [(text(k).try_cast(kinds[n]) if n in kinds else text(k)).alias(n) for k, n in enumerate(_FIXED)]
    return lines.where("value <> '' and not startswith(value, '#')").select(F.monotonically_increasing_id().alias("row_idx"), *columns, F.get(part, F.lit(8)).alias("samples"))


def read_vcf(spark: SparkSession, path: str, info: list[str] | None = None) -> DataFrame:
    """One row for each alternative allele, with chrom_norm; chosen INFO keys as text columns.

    row_idx is the record's order in its file.
    """
    rows = split_alts(parse(read_lines(spark, path))).withColumn("chrom_norm", chrom_norm(F.col("chrom")))
    from ..functions.csq import info_value

    return rows.select("*", *[info_value(F.col("info"), k).alias(k) for k in info or []])


def csq_header(fields: list[str]) -> str:
    return '##INFO=<ID=CSQ,Number=.,Type=String,Description="Consequence annotations. Format: ' + "|".join(fields) + '">'


def to_lines(rows: DataFrame) -> DataFrame:
    """(row_idx, alt_no, value) record lines; CSQ, where not null, is appended to INFO."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    packed = F.when(F.col("CSQ").isNotNull(), F.concat(F.lit("CSQ="), "CSQ"))
    info = F.coalesce(F.nullif(F.concat_ws(";", "info", packed), F.lit("")), F.lit("."))
    qual = F.coalesce(F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("long").cast("string")).otherwise(F.col("qual").cast("string")), F.lit("."))
    return rows.select("row_idx", "alt_no", F.concat_ws("\t", "chrom", F.col("start").cast("string"), dot("id"), dot("ref"), dot("alt"), qual, dot("filter"), info, "samples").alias("value"))


def write_vcf(rows: DataFrame, head: list[str], path: str, compression: str | None = None, on_written=None, total: int = 0) -> int:
    """One file with the header and the records in their order; returns the number of records.

    Records are sorted, and each task writes its range, as compressed members, to a file of
    its own attempt beside the target. Tasks return only names and sizes; the commit lets one more task
    append the files of the attempts that won, piece by piece, and then renames the result. So no byte
    of a record passes the driver, a lost or repeated task leaves nothing behind, and any file
    system that Arrow knows will do. ``on_written`` is called with the records of finished
    tasks, those written so far, and ``total``.
    """
    how = compression_of(path, compression)
    packed = {"bgzf": bgzf.compress, "gzip": _gzip}.get(how, bytes)
    system, place = _system(path)
    folder = f"{place}.parts-{uuid.uuid4().hex}"
    spark = rows.sparkSession
    done = spark.sparkContext.accumulator(0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n, size = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        with _system(path)[0].open_output_stream(name) as out:
            for b in batches:
                if b.num_rows:
                    size += out.write(packed(("\n".join(b.column(0).to_pylist()) + "\n").encode()))
                    n += b.num_rows
        done.add(n)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([name]), pa.array([n]), pa.array([size])], names=["part", "name", "n", "size"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = _system(path)[0]
        for _ in batches:
            with target.open_output_stream(f"{folder}/whole-{TaskContext.get().taskAttemptId()}") as out:
                size = out.write(packed(("\n".join(head) + "\n").encode())) if head else 0
                for name in names:
                    with target.open_input_stream(name) as part:
                        while piece := part.read(PIECE):
                            size += out.write(piece)
                size += out.write(bgzf.EOF) if how == "bgzf" else 0
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/whole-{TaskContext.get().taskAttemptId()}"]), pa.array([size])], names=["name", "size"])

    system.create_dir(folder)
    try:
        lines = to_lines(rows).orderBy("row_idx", "alt_no").select("value").mapInArrow(write, "part long, name string, n long, size long")
        parts = sorted(_watched(lines.collect, done, on_written, total))
        names = [r["name"] for r in parts if r["n"]]
        whole = spark.range(0, 1, 1, 1).mapInArrow(join, "name string, size long").first()
        system.move(whole["name"], place)
    finally:
        system.delete_dir(folder)
    return sum(r["n"] for r in parts)


#: Bytes of a file that the commit copies at once.
PIECE = 8 << 20


def _watched(work: Callable[[], list], done: Accumulator, on_written, total: int) -> list:
    """The result of ``work``; meanwhile the records of finished tasks go to ``on_written``."""
    if on_written is None:
        return work()
    told = 0
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(work)
        while not wait([running], 0.2).done:
            if done.value > told:  # a repeated task counts twice until the end
                on_written(done.value - told, done.value, total)
                told = done.value
        out = running.result()
    n = sum(r["n"] for r in out)
    if n != told:
        on_written(n - told, n, total)
    return out


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _gzip(data: bytes) -> bytes:
    import gzip

    return gzip.compress(data, mtime=0)


__all__ = ["csq_header", "header", "parse", "read_lines", "read_vcf", "to_lines", "write_vcf"]
