"""Media columns: archives of payloads as rows, through a Spark data source.

`spark.read.format("media_archive").load(folder)` lists the ZIP archives of a folder that all executors see (any file system that
pyarrow knows) and plans partitions as byte ranges of them; the driver reads sizes only. A partition reads the archive's
directory and takes the members whose header begins in its range, so that every member has one owner however ranges
are cut. Payloads are streamed in Arrow batches of bounded size. Each member is read by its own offset, and retried by itself
with the file opened anew; one that fails for good becomes a row with a null payload and the error, the others are unaffected.

Defined results: an empty folder or archive gives no rows; empty members have an empty payload; equal names are
separate rows, told apart by their offset; a member whose checksum doesn't hold is an error; a file that isn't an archive is one
row with an error, at offset 0.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.session import scratch, ship

SCHEMA = "archive string, member string, offset long, size long, crc long, payload binary, attempts int, error string"
RANGE_BYTES, BATCH_BYTES, ATTEMPTS = 64 << 20, 16 << 20, 3


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def directory(source: pa.NativeFile) -> list[tuple[str, int, int, int, int, int]]:
    """(name, header offset, compressed size, size, method, crc) of the members, from an archive's central directory (also ZIP64)."""
    total = source.size()
    tail = min(total, 22 + 65535)
    source.seek(total - tail)
    end = source.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no central directory")
    count, length, begin = struct.unpack_from("<HII", end, at + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or begin == 0xFFFFFFFF:
        locator = end.rfind(b"PK\x06\x07", 0, at)
        (where,) = struct.unpack_from("<Q", end, locator + 8)
        source.seek(where)
        count, length, begin = struct.unpack_from("<QQQ", source.read(56), 32)
    source.seek(begin)
    data = source.read(length)
    out, at = [], 0
    for _ in range(count):
        flags, method, _, _, crc, packed, size, n, extra, comment, _, _, _, header = struct.unpack_from("<HHHHIIIHHHHHII", data, at + 8)
        name = data[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        more, stop = at + 46 + n, at + 46 + n + extra
        while more + 4 <= stop:
            kind, long = struct.unpack_from("<HH", data, more)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{long // 8}Q", data, more + 4))
                size = next(wide) if size == 0xFFFFFFFF else size
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            more += 4 + long
        at = stop + comment
        out.append((name, header, packed, size, method, crc))
    return out


def payload(source: pa.NativeFile, header: int, packed: int, size: int, method: int, crc: int) -> bytes:
    source.seek(header)
    local = source.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at offset {header}")
    name, extra = struct.unpack_from("<HH", local, 26)
    source.seek(header + 30 + name + extra)
    data = source.read(packed)
    if method == 8:
        data = zlib.decompress(data, -15)
    elif method:
        raise ValueError(f"compression method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("checksum or size doesn't hold")
    return data


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.wait = float(options.get("waitSeconds", 0.1))

    def partitions(self) -> list[InputPartition]:
        system, path = open_fs(self.uri)
        files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".zip"))
        return [Range(p, a, min(a + self.range_bytes, n)) for p, n in files for a in range(0, max(n, 1), self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = open_fs(self.uri)
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("payload", pa.binary()), ("attempts", pa.int32()), ("error", pa.string())])
        archive = partition.path.rsplit("/", 1)[-1]
        members, tries, error = self.retried(lambda: self.listed(system, partition.path))
        if members is None:
            if not partition.start:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (archive, "", 0, 0, 0, None, tries, error), strict=True))], schema=schema)
            return
        rows, held = [], 0
        for name, header, packed, size, method, crc in members:
            if partition.start <= header < partition.end:
                data, tries, error = self.retried(lambda h=header, p=packed, s=size, m=method, c=crc: self.one(system, partition.path, h, p, s, m, c))
                rows.append(dict(zip(schema.names, (archive, name, header, size, crc, data, tries, error), strict=True)))
                held += size
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        self.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    _open: pa.NativeFile | None = None

    def close(self) -> None:
        if self._open is not None:
            self._open.close()
        self._open = None

    def source(self, system: fs.FileSystem, path: str) -> pa.NativeFile:
        if self._open is None:
            self._open = system.open_input_file(path)
        return self._open

    def listed(self, system: fs.FileSystem, path: str) -> list[tuple[str, int, int, int, int, int]]:
        return directory(self.source(system, path))

    def one(self, system: fs.FileSystem, path: str, *where: int) -> bytes:
        return payload(self.source(system, path), *where)

    def retried(self, what):
        """(result, attempts, error). Any fault of storage or data is retried, then told in the row."""
        for n in range(1, self.attempts + 1):
            try:
                return what(), n, None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                self.close()
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.wait * (n - 1))
        return None, self.attempts, error


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def write_archives(rows: DataFrame, folder: str) -> int:
    """Write (member string, payload binary) to ZIP archives in a shared folder, one a task; the number of members.

    A null payload is an empty member. An archive appears under its name when it is whole, so that a repeated task does no harm.
    """
    ship(rows.sparkSession)
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        from pyspark import TaskContext

        task = TaskContext.get()
        system, path = open_fs(folder)
        final = f"{path}/part-{task.partitionId():06d}.zip"
        part = f"{final}.{task.taskAttemptId()}.tmp"
        n = 0
        with system.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            for batch in batches:
                for name, data in zip(batch.column("member").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    archive.writestr(zipfile.ZipInfo(name or ""), data or b"", zipfile.ZIP_DEFLATED, 1)
                    n += 1
        system.move(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return rows.select("member", "payload").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """The pages' HTML written to archives and read back: (page_id, size, sha256, error). Null HTML is an empty payload."""
    spark = pages.sparkSession
    folder = scratch(spark, "media")
    write_archives(pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("member"), F.encode("html", "utf-8").alias("payload")), folder)
    got = read_archives(spark, folder)
    return got.select(F.expr("try_cast(member AS bigint)").alias("page_id"), "size", F.sha2("payload", 256).alias("sha256"), "error")
