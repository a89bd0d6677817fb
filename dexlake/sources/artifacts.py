"""Artifacts as tables: one pass over the files writes a catalog partitioned by table, everything else reads that.

The pass is a ``mapInArrow`` over whole files, one file in memory at a time.  It yields wide rows whose generic columns the
catalog names again, so one pass fills all tables; reading a table prunes to its partition and columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dexlake.formats import dex, zip
from dexlake.formats.binary import FormatError

NUMBERS, TEXTS = 10, 4
SAMPLE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20  # of an Arrow batch, as everywhere in the library: a session has one such setting; a longer file is a batch of its own
LONGEST_DEX = 64 << 20  # fixed value of the policy: longer ones are skipped with an issue

TABLES = {
    **dex.TABLES,
    "artifact": "path:s input_kind:s size:i entry_count:i",
    "zip_entry": "entry_idx:i name:s method:i compressed_size:i uncompressed_size:i crc32:i local_header_offset:i first_of_name:i",
    "entry_sample": "entry_idx:i name:s kind:s entropy_milli:i sample_bytes:i sample_complete:i head:b",
}

SCHEMA = "kind string, aid string, dx int, " + ", ".join([f"i{k} long" for k in range(1, NUMBERS + 1)] + [f"s{k} string" for k in range(1, TEXTS + 1)]) + ", b1 binary, a1 array<string>"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _places(spec: str) -> dict[str, str]:
    """Which generic column holds which column of a table."""
    used: Counter = Counter()
    found = {}
    for item in spec.split():
        name, kind = item.split(":")
        used[kind] += 1
        found[name] = f"{kind}{used[kind]}"
    return found


PLACES = {t: _places(spec) for t, spec in TABLES.items()}


def entropy_milli(raw: bytes) -> int | None:
    """Shannon entropy of bytes in thousandths of a bit."""
    if not raw:
        return None
    n = len(raw)
    return round(-sum(c / n * math.log2(c / n) for c in Counter(raw).values()) * 1000)


def kind_of(head: bytes) -> str | None:
    # Leading bytes of the formats.
    for magic, kind in ((b"dex\n", "dex"), (b"PK\x03\x04", "zip"), (b"\x7fELF", "elf"), (b"\x03\0\x08\0", "axml"), (b"\x02\0\x0c\0", "arsc"), (bytes.fromhex("c61fbc03c103191f"), "hermes"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg")):
        if head.startswith(magic):
            return kind
    return None


def records(path: str, data: bytes | None) -> Iterator[tuple[str, int | None, dict]]:
    """(table, DEX ordinal, columns) of everything in one artifact; content that wasn't read (None) is an issue."""
    if data is None:
        yield "artifact", None, {"path": path, "input_kind": "unknown"}
        yield "issue", None, {"stage": "read", "message": f"{path}: not read, too long", "failed": 1}
        return
    if data[:4] == b"dex\n":
        yield "artifact", None, {"path": path, "input_kind": "dex", "size": len(data), "entry_count": 0}
        for k, table, columns in dex.rows(data, path.rsplit("/", 1)[-1]):
            yield table, k, columns
        return
    try:
        found = zip.entries(data)
    except FormatError as e:
        yield "artifact", None, {"path": path, "input_kind": "unknown", "size": len(data)}
        yield "issue", None, {"stage": "zip", "message": str(e), "failed": 1}
        return
    yield "artifact", None, {"path": path, "input_kind": "xapk" if any(e.name.endswith(".apk") for e in found) else "apk", "size": len(data), "entry_count": len(found)}
    names: set[str] = set()
    for e in found:
        yield "zip_entry", None, {"entry_idx": e.entry_idx, "name": e.name, "method": e.method, "compressed_size": e.compressed_size, "uncompressed_size": e.uncompressed_size, "crc32": e.crc32, "local_header_offset": e.local_header_offset, "first_of_name": int(e.name not in names)}
        names.add(e.name)
        try:
            sample, whole = zip.prefix(data, e, SAMPLE_BYTES)
            yield "entry_sample", None, {"entry_idx": e.entry_idx, "name": e.name, "kind": kind_of(sample), "entropy_milli": entropy_milli(sample), "sample_bytes": len(sample), "sample_complete": int(whole), "head": sample[:64]}
        except FormatError as x:
            yield "issue", None, {"stage": "sample", "message": str(x), "failed": 1}
    at = 0
    for e in zip.dex_entries(found):
        try:
            if e.uncompressed_size > LONGEST_DEX:
                yield "dex", at, {"dex_name": e.name, "entry_name": e.name, "status": "skipped"}
                yield "issue", at, {"stage": "entry", "message": f"{e.name}: over {LONGEST_DEX >> 20} MiB", "failed": 1}
                at += 1
                continue
            content = zip.read(data, e, most=LONGEST_DEX)
            most = at
            for k, table, columns in dex.rows(content, e.name):
                most = max(most, at + k)
                yield table, at + k, columns
            at = most + 1
        except FormatError as x:
            yield "dex", at, {"dex_name": e.name, "entry_name": e.name, "status": "failed"}
            yield "issue", at, {"stage": "entry", "message": str(x), "failed": 1}
            at += 1


LONGEST = (1 << 31) - 1024  # bytes of a file that one row can hold


def contents(files: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(aid, path, content) of rows of a binary file source.  The content of a longer file isn't read: it is null, and the id is a digest of the path."""
    read = files.where(F.col("length") <= longest).select(F.sha2("content", 256).alias("aid"), "path", "content")
    return read.unionByName(files.where(F.col("length") > longest).select(F.sha2(F.col("path").cast("binary"), 256).alias("aid"), "path", F.lit(None).cast("binary").alias("content")))


def read_artifacts(spark: SparkSession, path: str, glob: str | None = None, longest: int = LONGEST) -> DataFrame:
    """(aid, path, content) of the files in a folder; the id is a digest of the content.  Of files with equal content the first by path is kept."""
    from pyspark.sql import Window

    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = contents(reader.load(path), longest)
    # only ids and paths are compared; the driver has listed all paths, and those of copies are fewer
    copies = files.select("aid", "path").withColumn("n", F.row_number().over(Window.partitionBy("aid").orderBy("path"))).where("n > 1").select("path")
    return files.join(F.broadcast(copies), "path", "left_anti").select("aid", "path", "content")


def wide_records(artifacts: DataFrame) -> DataFrame:
    """The catalog's rows of (aid, path, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                aid, path, content = (batch.column(c)[i].as_py() for c in range(3))
                for table, dx, columns in records(path, content):
                    row = dict.fromkeys(_NAMES) | {"kind": table, "aid": aid, "dx": dx}
                    for name, value in columns.items():
                        row[PLACES[table][name]] = value
                    rows.append(row)
                    size += len(row["b1"] or b"") + 256
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    artifacts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return artifacts.select("aid", "path", "content").mapInArrow(run, SCHEMA)


class Catalog:
    """Named tables over a written catalog, or over wide records directly."""

    def __init__(self, wide: DataFrame):
        self.wide = wide

    @classmethod
    def write(cls, artifacts: DataFrame, path: str, mode: str = "errorifexists") -> Catalog:
        """Ingest artifacts into a folder; rows of a table are sorted by artifact, so row groups can be skipped."""
        wide_records(artifacts).sortWithinPartitions("kind", "aid", "dx").write.mode(mode).partitionBy("kind").parquet(path)
        return cls.open(artifacts.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(spark.read.schema(SCHEMA).parquet(path))

    def table(self, name: str) -> DataFrame:
        columns = [F.col(place).alias(column) for column, place in PLACES[name].items()]
        return self.wide.where(F.col("kind") == name).select("aid", "dx", *columns)
