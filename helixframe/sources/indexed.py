"""A Spark data source for block-gzipped variant files with a .tbi or .csi index.

    read_indexed(spark, "calls.vcf.gz").where("chrom = 'chr7' and start < 2000000").select("ref", "info.AF")

Filters on chrom (=, in) and start (=, <, <=, >, >=) are pushed into the index: only blocks that
can hold such records are read, in tasks of about ``task`` compressed bytes. Spark applies
the filters again, so the index need only be right about what it leaves out. The source
hands on lines; INFO and the samples are parsed from them by expressions, typed by the header.

Chromosomes that the index does not name have no records. A file without an index raises an error.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from . import bgzf
from .vcf import _open, _system

#: Compressed bytes of a task.
TASK = 16 << 20
#: Lines of an Arrow batch.
BATCH = 10_000
_TYPES = {"Integer": "long", "Float": "double", "Flag": "boolean"}


@dataclass
class Index:
    """Bins of each reference: bin -> [(from, to)] in virtual offsets (block << 16 | place in it)."""

    names: list[str]
    bins: list[dict[int, list[tuple[int, int]]]]
    least: list[dict[int, int]]  # CSI: the least offset of a bin; TBI: by windows of 16 kb
    shift: int
    depth: int
    linear: bool

    def ranges(self, name: str, first: int | None = None, last: int | None = None) -> list[tuple[int, int]]:
        """Ranges of virtual offsets, ascending, that hold all records of a reference between two bases (1-based)."""
        if name not in self.names:
            return []
        own, least = self.bins[k := self.names.index(name)], self.least[k]
        begin = max(0, (first or 1) - 1)
        end = min(last if last is not None else 1 << 60, 1 << (self.shift + 3 * self.depth))
        if end <= begin:
            return []
        found = sorted(r for b, rs in own.items() if self._meets(b, begin, end) for r in rs)
        low = self._least(least, own, begin)
        return [(max(a, low), z) for a, z in found if z > low]

    def _meets(self, b: int, begin: int, end: int) -> bool:
        """Whether a bin's bases meet begin .. end - 1."""
        level, first = 0, 0
        while level < self.depth and b >= first + (1 << 3 * level):
            first += 1 << 3 * level
            level += 1
        size = 1 << (self.shift + 3 * (self.depth - level))
        return (b - first) < 1 << 3 * level and (b - first) * size < end and (b - first + 1) * size > begin

    def _least(self, least: dict[int, int], own: dict, begin: int) -> int:
        """No record that reaches ``begin`` starts before this offset."""
        if self.linear:
            return least.get(min(begin >> 14, max(least, default=0)), 0)
        leaf = ((1 << 3 * self.depth) - 1) // 7 + (begin >> self.shift)
        while leaf:
            if leaf in least:
                return least[leaf]
            leaf = (leaf - 1) >> 3
        return least.get(0, 0)


def _bin_rows(raw: bytes, at: int, csi: bool) -> tuple[dict, dict, int]:
    bins, least = {}, {}
    (n,) = struct.unpack_from("<i", raw, at)
    at += 4
    for _ in range(n):
        if csi:
            number, offset, chunks = struct.unpack_from("<IQi", raw, at)
            at += 16
            least[number] = offset
        else:
            number, chunks = struct.unpack_from("<Ii", raw, at)
            at += 8
        flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at)
        at += 16 * chunks
        bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
    return bins, least, at


def parse_index(raw: bytes) -> Index:
    """A .tbi or .csi file, as it lies on disk."""
    raw = bgzf.decompress(raw)
    csi = raw[:4] == b"CSI\x01"
    if not csi and raw[:4] != b"TBI\x01":
        raise ValueError("neither a .tbi nor a .csi index")
    if csi:
        shift, depth, extra = struct.unpack_from("<3i", raw, 4)
        head, at = 16, 16 + extra
        (size,) = struct.unpack_from("<i", raw, head + 24)
        names = raw[head + 28 : head + 28 + size]
        (refs,) = struct.unpack_from("<i", raw, at)
        at += 4
    else:
        shift, depth = 14, 5
        (refs,) = struct.unpack_from("<i", raw, 4)
        (size,) = struct.unpack_from("<i", raw, 32)
        names, at = raw[36 : 36 + size], 36 + size
    index = Index([x.decode() for x in names.split(b"\0")[:-1]], [], [], shift, depth, not csi)
    pseudo = ((1 << 3 * (depth + 1)) - 1) // 7 + 1  # holds counts, not records
    for _ in range(refs):
        bins, least, at = _bin_rows(raw, at, csi)
        bins.pop(pseudo, None)
        least.pop(pseudo, None)
        if not csi:
            (n,) = struct.unpack_from("<i", raw, at)
            least = dict(enumerate(struct.unpack_from(f"<{n}Q", raw, at + 4)))
            at += 4 + 8 * n
        index.bins.append(bins)
        index.least.append(least)
    return index


def read_index(path: str) -> Index:
    for suffix in (".tbi", ".csi"):
        system, place = _system(path + suffix)
        if system.get_file_info(place).is_file:
            with system.open_input_stream(place) as f:
                return parse_index(f.read())
    raise FileNotFoundError(f"{path} has no .tbi or .csi index")


def lines_between(file, size: int, first: int, last: int) -> Iterator[str]:
    """The lines between two virtual offsets of a block gzip file."""
    place, skip, rest = first >> 16, first & 0xFFFF, b""
    while place < size and (place << 16) < last:
        head = file.read_at(min(0x10000, size - place), place)
        n = bgzf.member_size(head, 0)
        if not n:
            raise ValueError(f"no block at byte {place}")
        text = zlib.decompress(head[:n], 31)
        text = text[skip : last & 0xFFFF] if place == last >> 16 else text[skip:]
        *whole, rest = (rest + text).split(b"\n")
        for line in whole:
            yield line.decode()
        place, skip = place + n, 0
    if rest:
        yield rest.decode()


def header_lines(path: str) -> list[str]:
    """The lines that start with #, from as many blocks as hold them."""
    out: list[str] = []
    with _open(path) as (file, size):
        for line in lines_between(file, size, 0, size << 16):
            if not line.startswith("#"):
                break
            out.append(line)
    return out


def _kinds(lines: list[str], section: str, chosen: list[str] | None) -> dict[str, tuple[str, bool]]:
    """Type and whether it is an array (Number other than 1), by the header, of the chosen keys of INFO or FORMAT."""
    out: dict[str, tuple[str, bool]] = {}
    for line in lines:
        m = re.match(rf"##{section}=<ID=([^,>]+),Number=([^,>]+),Type=([^,>]+)", line)
        if m and (chosen is None or m[1] in chosen):
            out.setdefault(m[1], (_TYPES.get(m[3], "string"), m[2] not in ("0", "1")))
    return out


def _cast(text: Column, kind: str, many: bool) -> Column:
    one = lambda x: F.nullif(x, F.lit(".")).try_cast(kind)
    return F.when(text != ".", F.transform(F.split(text, ","), one)) if many else one(text)


def typed(rows: DataFrame, header: list[str], info: list[str] | None = None, form: list[str] | None = None) -> DataFrame:
    """Records of lines (chrom, start, value): fixed columns, ``info`` as a struct and ``genotypes`` as an array of structs.

    All of it are expressions over the line, so keys that a query does not use cost nothing. A value that is not of
    the header's type is null, a key that the record lacks too; a flag is true or false.
    """
    part = F.split("value", "\t", -1)
    text = lambda k: F.nullif(F.get(part, F.lit(k)), F.lit("."))
    raw = F.coalesce(F.get(part, F.lit(7)), F.lit("."))
    fields = []
    for name, (kind, many) in _kinds(header, "INFO", info).items():
        value = raw.rlike(f"(^|;){re.escape(name)}(;|$)") if kind == "boolean" else _cast(F.nullif(F.regexp_extract(raw, f"(?:^|;){re.escape(name)}=([^;]*)", 1), F.lit("")), kind, many)
        fields.append(value.alias(name))
    samples = header[-1].split("\t")[9:] if header and header[-1].startswith("#CHROM") else []
    keys = F.split(F.get(part, F.lit(8)), ":")
    own = lambda cell: [_cast(F.try_element_at(F.split(cell, ":"), F.nullif(F.array_position(keys, n).cast("int"), F.lit(0))), kind, many).alias(n) for n, (kind, many) in _kinds(header, "FORMAT", form).items()]
    cells = F.arrays_zip(F.array(*map(F.lit, samples)).cast("array<string>").alias("n"), F.slice(part, 10, len(samples)).alias("c")) if samples else None
    genotypes = F.transform(cells, lambda x: F.struct(x["n"].alias("sample"), *own(x["c"]))) if samples else F.array().cast("array<struct<sample:string>>")
    fixed = [text(k).alias(n) for k, n in ((2, "id"), (3, "ref"), (4, "alt"))]
    return rows.select("chrom", "start", *fixed, text(5).try_cast("double").alias("qual"), text(6).alias("filter"), (F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("none"))).alias("info"), genotypes.alias("genotypes"))


@dataclass
class Blocks(InputPartition):
    """Ranges of virtual offsets that one task reads, each with its reference."""

    ranges: list[tuple[str, int, int]]


class IndexedVcf(DataSource):
    """Format ``indexed_vcf``: chrom, start and value (the record's line)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_vcf"

    def schema(self) -> str:
        return "chrom string, start long, value string"

    def reader(self, schema: StructType) -> IndexedVcfReader:
        return IndexedVcfReader(self.options["path"], int(self.options.get("task", TASK)))


class IndexedVcfReader(DataSourceReader):
    def __init__(self, path: str, task: int):
        self.path, self.task = path, task
        self.chroms: set[str] | None = None
        self.first, self.last = 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what is read; all filters go back to Spark, which applies them to the records."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column == "chrom" and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = names if self.chroms is None else self.chroms & names
            elif column == "start" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.last = top if self.last is None else min(self.last, top)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        index = read_index(self.path)
        tasks: list[Blocks] = []
        size = self.task
        for name in index.names if self.chroms is None else sorted(self.chroms & set(index.names)):
            for a, z in _joined(index.ranges(name, self.first, self.last)):
                # a long range is cut where the index knows a record to start
                for low, high in _cut(a, z, index, name, self.task):
                    if size >= self.task:
                        tasks.append(Blocks([]))
                        size = 0
                    tasks[-1].ranges.append((name, low, high))
                    size += (high >> 16) - (low >> 16) + 0x4000
        return tasks

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as (file, size):
            for name, first, last in partition.ranges:
                lines = (x for x in lines_between(file, size, first, last) if x.startswith(f"{name}\t"))
                while batch := list(islice(lines, BATCH)):
                    start = [int(x.split("\t", 2)[1]) for x in batch]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch)), pa.array(start, pa.int64()), pa.array(batch)], names=["chrom", "start", "value"])


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending ranges without overlaps; those that meet become one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def _cut(first: int, last: int, index: Index, name: str, task: int) -> Iterator[tuple[int, int]]:
    k = index.names.index(name)
    starts = sorted({a for rs in index.bins[k].values() for a, _ in rs} | set(index.least[k].values()))
    for at in starts:
        if first < at < last and (at >> 16) - (first >> 16) >= task:
            yield first, at
            first = at
    yield first, last


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexedVcf)


def read_indexed(spark: SparkSession, path: str, info: list[str] | None = None, form: list[str] | None = None, task: int = TASK) -> DataFrame:
    """Typed records of an indexed file; filters on chrom and start reach its index."""
    register(spark)
    return typed(spark.read.format("indexed_vcf").option("task", task).load(path), header_lines(path), info, form)
