"""The feature cache: metadata, building and reading of one Parquet table for each entity.

Layout: <cache_dir>/parquet/<release>_<assembly>_<type>/<entity>/chrom=<name>/part-*.parquet,
sorted by start within a chromosome, so that chromosome filters prune folders and range
filters prune row groups.
"""

from __future__ import annotations

import os
import re
import shutil
import tarfile
import time
import urllib.error
import urllib.request
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features

ENTITIES = ("variation", "transcript", "exon", "translation_core", "translation_sift", "regulatory", "motif")
CACHE_TYPES = ("vep", "merged", "refseq")
#: Where the public archive keeps a release.
_URLS = (
    "https://ftp.ensembl.org/pub/release-{release}/variation/indexed_vep_cache/{species}{kind}_vep_{release}_{assembly}.tar.gz",
    "https://ftp.ensembl.org/pub/release-{release}/variation/vep/{species}{kind}_vep_{release}_{assembly}.tar.gz",
)


def read_info(folder: str) -> dict[str, str]:
    """Keys and values of info.txt."""
    out = {}
    with open(os.path.join(folder, "info.txt"), encoding="utf-8") as f:
        for line in f:
            key, _, value = line.rstrip("\n").partition("\t")
            if key and not key.startswith("#"):
                out[key] = value
    return out


def read_variation(spark: SparkSession, folder: str) -> DataFrame:
    """Known variants of a legacy cache's tab-separated files, typed by info.txt's column list.

    Their indexes (.csi, .tbi) lie beside them and are no data.
    """
    names = read_info(folder)["variation_cols"].split(",")
    raw = spark.read.option("sep", "\t").option("recursiveFileLookup", "true").option("pathGlobFilter", "all_vars*.gz").csv(folder)
    rows = raw.toDF(*names[: len(raw.columns)])
    value = lambda c: F.nullif(F.nullif(F.col(c), F.lit(".")), F.lit(""))
    whole = {"start": "long", "end": "long", "failed": "int", "somatic": "int", "strand": "int"}
    out = rows.select(*[(value(c).try_cast(whole[c]) if c in whole else value(c)).alias("chrom" if c == "chr" else c) for c in rows.columns])
    have = lambda c: F.col(c) if c in out.columns else F.lit(None)
    return out.withColumns({"failed": F.coalesce(have("failed"), F.lit(0)), "end": F.coalesce(have("end"), "start")})


def entity_source(spark: SparkSession, folder: str, entity: str) -> DataFrame | None:
    """An entity of an unpacked cache: Parquet or JSON lines named after it, or the legacy variation files.

    Features of legacy caches come from their region files (features.py).
    """
    for suffix, kind in ((".parquet", "parquet"), (".json", "json"), (".jsonl", "json")):
        path = os.path.join(folder, entity + suffix)
        if os.path.exists(path):
            return spark.read.format(kind).load(path)
    if entity == "variation" and "variation_cols" in read_info(folder):
        return read_variation(spark, folder)
    return None


def write_entity(rows: DataFrame, path: str, level: int = 3) -> None:
    """Partitioned by chromosome and sorted by start; large chromosomes are split by range."""
    keys = [c for c in ("chrom", "start") if c in rows.columns]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
    out = dealt.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
    (out.partitionBy("chrom") if "chrom" in rows.columns else out).parquet(path)


def download(url: str, to: str, retries: int = 10, wait: float = 5.0, opener: Callable = urllib.request.urlopen) -> str:
    """Fetch a file, going on from the last byte after a failure; waits double up to 120 s.

    A file shorter than announced counts as a failure; HTTP 404 is raised at once.
    """
    for attempt in range(retries + 1):
        have = os.path.getsize(to) if os.path.exists(to) else 0
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        try:
            with opener(request, timeout=60) as r:
                again = have and getattr(r, "status", 200) != 206
                total = int(r.headers.get("Content-Length") or 0) + (0 if again else have)
                with open(to, "wb" if again or not have else "ab") as f:
                    while part := r.read(1 << 20):
                        f.write(part)
            if total and os.path.getsize(to) < total:
                raise OSError(f"{os.path.getsize(to)} of {total} bytes")
            return to
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise
            if e.code == 416:  # all of it is there
                return to
            error: Exception = e
        except OSError as e:
            error = e
        if attempt < retries:
            time.sleep(min(wait * 2**attempt, 120))
    raise OSError(f"{url}: {error}")


def fetch_release(cache_dir: str, release: int, species: str, assembly: str, cache_type: str, retries: int, opener: Callable = urllib.request.urlopen) -> str:
    """The unpacked folder of a release, downloaded unless it is there; the archive is deleted."""
    kind = "" if cache_type == "vep" else f"_{cache_type}"
    folder = os.path.join(cache_dir, f"{species}{kind}", f"{release}_{assembly}")
    if os.path.isdir(folder):
        return folder
    os.makedirs(cache_dir, exist_ok=True)
    archive = os.path.join(cache_dir, f"{species}{kind}_{release}_{assembly}.tar.gz")
    for pattern in _URLS:
        try:
            download(pattern.format(release=release, species=species, kind=kind, assembly=assembly), archive, retries, opener=opener)
            break
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
    else:
        raise FileNotFoundError(f"no cache of release {release} for {species} {assembly} ({cache_type})")
    with tarfile.open(archive) as t:
        t.extractall(cache_dir, filter="data")
    os.remove(archive)
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    return folder


#: Region files of features that Perl serialised.
_PERL = re.compile(r"^[0-9]+-[0-9]+(_reg)?\.gz$")


def build_cache(
    release: int,
    cache_dir: str,
    *,
    species: str = "homo_sapiens",
    assembly: str = "GRCh38",
    cache_type: str = "vep",
    partitions: int = 1,
    build_fjall: bool = True,
    fjall_zstd_level: int = 3,
    fjall_dict_size_kb: int = 112,
    local_cache: str | None = None,
    download_retries: int = 10,
    show_progress: bool = True,
    on_progress: Callable[[str, str, int, int, int], None] | None = None,
    spark: SparkSession | None = None,
) -> list[tuple[str, int]]:
    """Build the Parquet cache of a release; returns (file, rows) for each file written.

    Lookups are equi-joins on sorted Parquet, so there is no key-value store to build:
    ``build_fjall`` and ``fjall_dict_size_kb`` are accepted and checked, the zstd level is
    used for Parquet. ``partitions`` is the least number of shuffle partitions.
    """
    if cache_type not in CACHE_TYPES:
        raise ValueError(f"cache_type must be one of {', '.join(CACHE_TYPES)}, not {cache_type!r}")
    if not 1 <= fjall_zstd_level <= 22:
        raise ValueError(f"fjall_zstd_level must be from 1 to 22, not {fjall_zstd_level}")
    if fjall_dict_size_kb < 0:
        raise ValueError(f"fjall_dict_size_kb must not be negative, but is {fjall_dict_size_kb}")
    if local_cache is not None and not os.path.isdir(local_cache):
        raise FileNotFoundError(local_cache)
    if partitions > 1 and on_progress is not None:
        warnings.warn("on_progress is not called when partitions > 1", UserWarning, stacklevel=2)
        on_progress = None
    source = local_cache or fetch_release(cache_dir, release, species, assembly, cache_type, download_retries)
    spark = spark or SparkSession.builder.getOrCreate()
    root = os.path.join(cache_dir, "parquet", f"{release}_{assembly}_{cache_type}")
    out: list[tuple[str, int]] = []
    found = {e: entity_source(spark, source, e) for e in ENTITIES}
    decoded = None
    if found["transcript"] is None and any(_PERL.match(f) for _, _, files in os.walk(source) for f in files):
        # region files are decoded once, to a table that the entities are read from
        decoded = f"{root}/_decoded-{uuid.uuid4().hex}"
        both = {"transcript": features.read_transcripts(spark, source), "regulatory": features.read_regulatory(spark, source)}
        for name, rows in both.items():
            rows.write.parquet(f"{decoded}/{name}")
        own = features.entities(*(spark.read.parquet(f"{decoded}/{name}") for name in both))
        found |= {e: own[e] for e in own if found[e] is None}
    for entity, rows in found.items():
        if rows is None:
            continue
        path = os.path.join(root, entity)
        write_entity(rows, path, fjall_zstd_level)
        files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count().orderBy("f").collect()
        total = sum(r["count"] for r in files)
        done = 0
        for r in files:
            done += r["count"]
            out.append((r["f"].removeprefix("file://"), r["count"]))
            if on_progress:
                on_progress(entity, "parquet", r["count"], done, total)
    if decoded:
        shutil.rmtree(decoded, ignore_errors=True)
    return out


def store_stats(variation: DataFrame) -> dict[str, int]:
    """Known variants and distinct positions."""
    row = variation.agg(F.count("*").alias("variants"), F.countDistinct("chrom", "start").alias("positions")).first()
    return row.asDict()


class CacheCatalog:
    """The entity tables found in a cache folder; missing ones are None."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.entities = [e for e in ENTITIES if self._holds(e)]

    def _holds(self, entity: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/{entity}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.exists(path) and system.getFileStatus(path).isDirectory()

    def table(self, entity: str) -> DataFrame | None:
        if entity not in self.entities:
            return None
        rows = self.spark.read.parquet(os.path.join(self.folder, entity))
        return rows.withColumn("chrom", F.col("chrom").cast("string")) if "chrom" in rows.columns else rows
