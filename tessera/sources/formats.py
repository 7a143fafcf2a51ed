"""Data sources and a sink by name: archives, workbooks, listings, and payloads that spill (SC5-SC7, SC9, SC10, SC12, SC13).

``register(spark)`` makes them usable as ``spark.read.format("tessera_zip").load(folder)``. A
folder is read where all executors reach it, by Arrow's file systems (a local path, or a URI
such as ``hdfs://``). The driver looks at directories only: file names and sizes, the tables of contents
of workbooks and of archives too large for one partition; every partition opens its own files and reads its own members.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tessera.operators.intake import EXTRACTED, MAX_BYTES, MAX_ENTRIES
from tessera.sources import xlsx

#: Bytes of whole archives, or uncompressed bytes of members of a larger archive, that one partition reads, unless the option ``bytes`` says otherwise; a larger member has a partition of its own.
PARTITION_BYTES = 128 << 20
INLINE_BYTES = 512 * 1024
#: A partition opens so many objects at once, and puts out rows, as it writes them, when their payloads have so many bytes.
OPEN_AT_ONCE, BODY_BYTES = 8, 4 << 20


def _system(path: str) -> tuple[object, str]:
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return fs.LocalFileSystem(), path


def _files(folder: str, suffix: str) -> tuple[object, list[str]]:
    from pyarrow import fs

    system, path = _system(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return system, sorted(f.path for f in found if f.is_file and f.path.lower().endswith(suffix))


@contextmanager
def _zip(system: object, file: str) -> Iterator[zipfile.ZipFile]:
    from pyarrow import ArrowInvalid

    with system.open_input_file(file) as f:
        try:
            z = zipfile.ZipFile(f)
        except ArrowInvalid as e:  # shorter than any archive
            raise zipfile.BadZipFile(str(e)) from e
        with z:
            yield z


def is_safe(name: str) -> bool:
    """F12 for one name: relative, and never above its folder."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts and "\0" not in name


@dataclass
class Members(InputPartition):
    """Some members of one archive or workbook; or what is wrong with it."""

    file: str
    names: tuple[str, ...] = ()
    error: str | None = None


class _Reader(DataSourceReader):
    suffix = ""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.folder, self.options = options["path"], options

    def plan(self, system: object, file: str) -> list[Members]:
        return [Members(file)]

    def partitions(self) -> list[Members]:
        system, files = _files(self.folder, self.suffix)
        with ThreadPoolExecutor(16) as pool:  # tables of contents only
            return [p for found in pool.map(lambda f: self.plan(system, f), files) for p in found]


@dataclass
class Archives(InputPartition):
    """Whole archives; or, of one archive, the entries from ``first`` to before ``end``; or what is wrong with it."""

    files: tuple[str, ...]
    first: int = 0
    end: int | None = None
    error: str | None = None


class ZipReader(_Reader):
    suffix = ".zip"

    def entries(self, z: zipfile.ZipFile) -> list[zipfile.ZipInfo] | None:
        """The files of an archive that may be read, by place; None if there are more, or larger ones, than allowed."""
        entries = [i for i in z.infolist() if not i.is_dir()]
        if len(entries) > int(self.options.get("maxentries", MAX_ENTRIES)) or sum(i.file_size for i in entries) > int(self.options.get("maxbytes", MAX_BYTES)):
            return None
        return [i for i in entries if i.filename.lower().endswith(EXTRACTED) and is_safe(i.filename)]

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        system, path = _system(self.folder)
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.lower().endswith(self.suffix))
        most = int(self.options.get("bytes", PARTITION_BYTES))
        groups, size = [], 0
        for file, n in found:
            if n > most:
                continue
            if not groups or size + n > most:
                groups.append([])
                size = 0
            groups[-1].append(file)
            size += n
        with ThreadPoolExecutor(16) as pool:  # tables of contents only, of large archives only
            parts = [p for x in pool.map(lambda f: self.plan(system, f), [f for f, n in found if n > most]) for p in x]
        return parts + [Archives(tuple(g)) for g in groups]

    def plan(self, system: object, file: str) -> list[Archives]:
        try:
            with _zip(system, file) as z:
                entries = self.entries(z)
        except (zipfile.BadZipFile, NotImplementedError, OSError) as e:
            return [Archives((file,), error=type(e).__name__)]
        if entries is None:
            return [Archives((file,), error="archive_limits")]
        most, starts, size = int(self.options.get("bytes", PARTITION_BYTES)), [], 0
        for k, i in enumerate(entries):
            if not starts or size + i.file_size > most:
                starts.append(k)
                size = 0
            size += i.file_size
        return [Archives((file,), a, b) for a, b in zip(starts, [*starts[1:], len(entries)])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        system, _ = _system(self.folder)
        for file in partition.files:
            if partition.error:
                yield file, None, None, None, None, partition.error
                continue
            try:
                with _zip(system, file) as z:
                    entries = self.entries(z)
                    if entries is None:
                        yield file, None, None, None, None, "archive_limits"
                        continue
                    for i in entries[partition.first : partition.end]:
                        try:
                            data = z.read(i)  # by its place: names may repeat
                        except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:  # a broken or locked member
                            yield file, i.filename, None, None, None, type(e).__name__
                            continue
                        yield file, i.filename, len(data), hashlib.sha256(data).hexdigest(), data, None
            except (zipfile.BadZipFile, NotImplementedError, OSError) as e:
                if partition.end is not None:
                    raise  # its table of contents was read before
                yield file, None, None, None, None, type(e).__name__


class WorkbookReader(_Reader):
    suffix = ".xlsx"
    errors = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, OSError)

    def plan(self, system: object, file: str) -> list[Members]:
        try:
            with _zip(system, file) as z:
                return [Members(file, (name, target)) for name, target in xlsx.sheets(z)]
        except self.errors as e:
            return [Members(file, error=type(e).__name__)]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.error:
            yield partition.file, None, "error", None, None, partition.error, None, None, None, None
            return
        system, _ = _system(self.folder)
        name, target = partition.names
        try:
            with _zip(system, partition.file) as z:
                for row in xlsx.read_sheet(z, name, target):
                    yield partition.file, *row
        except self.errors as e:
            yield partition.file, name, "error", None, None, type(e).__name__, None, None, None, None


class ListingReader(_Reader):
    suffix = ".lst"

    def read(self, partition: Members) -> Iterator[tuple]:
        system, _ = _system(self.folder)
        with system.open_input_stream(partition.file) as f:
            entry, body, rest = {}, False, b""
            while True:
                block = f.read(1 << 20)
                lines = (rest + block).split(b"\n")
                rest = lines.pop() if block else b""
                for raw in [*lines, *([] if block else [b""])]:
                    line = raw.decode("cp866", "replace").rstrip("\r")
                    if not body:
                        body = line == "-" * 10
                    elif not line.strip():
                        if entry.get("Path"):
                            size = entry.get("Size", "")
                            yield partition.file, entry["Path"], int(size) if size.isdigit() else None, entry.get("Folder") == "+"
                        entry = {}
                    elif " = " in line:
                        key, value = line.split(" = ", 1)
                        entry[key] = value
                if not block:
                    return


def _source(label: str, columns: str, reader: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return columns

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader({k.lower(): v for k, v in self.options.items()})

    return Source


# -- payloads ------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class PayloadWriter(DataSourceWriter):
    """SC12/SC13: rows (id, payload); large payloads become objects named by their hash, small ones stay in the row.

    A job writes below a folder of its own. It counts once its name and files stand in a new
    manifest, which commit writes last; abort takes the job's folder away, objects included,
    and nothing that readers see has changed. Overwriting starts a manifest anew, so the old
    rows are there until the new ones are.
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite, self.limit = options["path"], overwrite, int(options.get("inline", INLINE_BYTES))
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, root = _system(self.folder)
        home, file = f"{root}/jobs/{self.job}", f"part-{uuid.uuid4().hex}.parquet"
        system.create_dir(f"{home}/payloads", recursive=True)
        schema, n, batch = pa.schema([("id", pa.int64()), ("storage", pa.string()), ("payload", pa.string()), ("ref", pa.string())]), 0, []
        held = 0
        with system.open_output_stream(f"{home}/{file}") as out, pq.ParquetWriter(out, schema) as table:

            def flush() -> None:
                if batch:
                    table.write_table(pa.Table.from_pylist(batch, schema))
                    batch.clear()

            for row in rows:
                body = None if row["payload"] is None else row["payload"].encode()
                ref = None
                if body is not None and len(body) > self.limit:
                    ref = f"jobs/{self.job}/payloads/{hashlib.sha256(body).hexdigest()}"
                    with system.open_output_stream(f"{root}/{ref}") as f:
                        f.write(body)
                batch.append({"id": row["id"], "storage": "payload_ref" if ref else "inline", "payload": None if ref else row["payload"], "ref": ref})
                n += 1
                held += 0 if ref else len(body or b"")
                if len(batch) >= 1000 or held >= BODY_BYTES:
                    flush()
                    held = 0
            flush()
        return Written(f"jobs/{self.job}/{file}", n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.folder)
        last, files = manifest(self.folder)
        files = ([] if self.overwrite else files) + [m.file for m in messages if m and m.rows]
        system.create_dir(f"{root}/manifests", recursive=True)
        name = f"{root}/manifests/{last + 1:012d}.json"
        with system.open_output_stream(f"{name}.{self.job}.tmp") as f:
            f.write(json.dumps(files).encode())
        system.move(f"{name}.{self.job}.tmp", name)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.folder)
        home = f"{root}/jobs/{self.job}"
        if system.get_file_info(home).type != fs.FileType.NotFound:
            system.delete_dir(home)


def manifest(folder: str) -> tuple[int, list[str]]:
    """Number of the newest manifest and the files it names; 0 and none before the first."""
    from pyarrow import fs

    system, root = _system(folder)
    found = system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
    if not names:
        return 0, []
    with system.open_input_stream(f"{root}/manifests/{names[-1]}") as f:
        return int(names[-1].removesuffix(".json")), json.loads(f.read())


def vacuum(folder: str, older_than: float = 86_400.0) -> list[str]:
    """Takes away the folders of jobs that no manifest names and that are older than so many seconds: what tasks wrote after their job had been given up."""
    import time

    from pyarrow import fs

    system, root = _system(folder)
    named = set()
    for f in system.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as body:
                named |= {x.split("/")[1] for x in json.loads(body.read())}
    gone = [f for f in system.get_file_info(fs.FileSelector(f"{root}/jobs", allow_not_found=True)) if f.base_name not in named and (f.mtime is None or f.mtime.timestamp() <= time.time() - older_than)]
    for f in gone:
        system.delete_dir(f.path)
    return [f.base_name for f in gone]


class PayloadReader(DataSourceReader):
    """Rows as written. With the option ``bodies``, a large payload too stands in its row: each partition opens the objects that its own rows name, so none is listed and no payload is moved. An object that is gone is an error."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.bodies = options["path"], options.get("bodies", "false").lower() == "true"

    def partitions(self) -> list[Members]:
        return [Members(f) for f in manifest(self.folder)[1]]

    def read(self, partition: Members) -> Iterator[object]:
        import pyarrow.parquet as pq

        system, root = _system(self.folder)
        with system.open_input_file(f"{root}/{partition.file}") as f:
            if not self.bodies:
                yield from pq.ParquetFile(f).iter_batches(10_000)
            else:
                with ThreadPoolExecutor(OPEN_AT_ONCE) as pool:
                    for batch in pq.ParquetFile(f).iter_batches(10_000):
                        yield from self.filled(system, root, batch, pool)

    def filled(self, system: object, root: str, batch: object, pool: ThreadPoolExecutor) -> Iterator[object]:
        """Stretches of a batch with the payloads of its objects, each of BODY_BYTES and one window of objects more at most."""
        import pyarrow as pa

        def body(ref: str | None) -> bytes | None:
            if ref is None:
                return None
            with system.open_input_stream(f"{root}/{ref}") as f:
                return f.read()

        refs, own, at = batch["ref"].to_pylist(), batch["payload"].to_pylist(), 0
        place = batch.schema.get_field_index("payload")
        while at < len(refs):
            texts, size = [], 0
            while at + len(texts) < len(refs) and size < BODY_BYTES:
                low = at + len(texts)
                for text, found in zip(own[low : low + OPEN_AT_ONCE], pool.map(body, refs[low : low + OPEN_AT_ONCE])):
                    texts.append(text if found is None else found.decode())
                    size += len(found or b"")
            yield batch.slice(at, len(texts)).set_column(place, "payload", pa.array(texts, pa.string()))
            at += len(texts)


class Payloads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_payloads"

    def schema(self) -> str:
        return "id long, storage string, payload string, ref string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PayloadReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PayloadWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    """All formats of this module for a session: tessera_zip, tessera_xlsx, tessera_listing, tessera_payloads."""
    spark.dataSource.register(_source("tessera_zip", "archive string, path string, size_bytes long, checksum string, content binary, error string", ZipReader))
    spark.dataSource.register(_source("tessera_xlsx", xlsx.SCHEMA, WorkbookReader))
    spark.dataSource.register(_source("tessera_listing", "archive string, path string, size_bytes long, folder boolean", ListingReader))
    spark.dataSource.register(Payloads)
