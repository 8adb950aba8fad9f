"""A data source for zip, tar and compressed files, of any size: members are streamed, and those of zip and plain tar files side by side.

``spark.dataSource.register(ArchiveSource)``, then ``spark.read.format("archive").load(path)``, or ``lines(spark, path)``.
Paths are files or folders of any file system that Arrow knows (``file``, ``hdfs``, ``s3``, ``gs``).

A row is a piece of a member: whole lines of ``pieceBytes`` together at most, or part of a longer line.  The driver reads the
directories of zip files and the headers of plain tar files alone, and deals members into partitions of ``partitionBytes``;
a compressed tar or gzip file can only be read from its start and is a partition.  No archive and no member is ever held whole.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE_BYTES, PARTITION_BYTES = 4 << 20, 64 << 20
_SCHEMA = "path string, member string, piece int, content binary, problem string"
_BROKEN = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, NotImplementedError, RuntimeError)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class _File(io.RawIOBase):
    """A seekable view of an Arrow file for the standard library."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self.file.seek(to, whence)
        except ValueError as outside:  # the library looks before the start of files that are too short
            raise OSError(str(outside)) from outside

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def _open(system, path: str) -> io.BufferedReader:
    return io.BufferedReader(_File(system.open_input_file(path)), 1 << 20)


def climbs(member: str) -> bool:
    return member.startswith("/") or ".." in member.split("/")


class Members(InputPartition):
    """Some members of one archive: names in a zip file, offsets and sizes in a tar file, or all of a compressed stream."""

    def __init__(self, path: str, kind: str, members: list[tuple] | None = None, problem: str | None = None):
        self.path, self.kind, self.members, self.problem = path, kind, members, problem


def _kind(path: str) -> str | None:
    name = path.lower()
    if name.endswith((".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")):
        return "stream"
    return {"zip": "zip", "jar": "zip", "tar": "tar", "gz": "gzip"}.get(name.rsplit(".", 1)[-1]) if "." in name else None


def _dealt(path: str, kind: str, members: list[tuple], most: int) -> Iterator[Members]:
    """Members, each with its size last, in partitions of so many bytes."""
    part, size = [], 0
    for m in members:
        if part and size + m[-1] > most:
            yield Members(path, kind, part)
            part, size = [], 0
        part.append(m)
        size += m[-1]
    if part:
        yield Members(path, kind, part)


def _pieces(stream, most: int) -> Iterator[bytes]:
    """Whole lines up to so many bytes; a longer line is cut."""
    rest = b""
    while block := stream.read(most - len(rest)):
        data = rest + block
        cut = data.rfind(b"\n") + 1
        if not cut and len(data) < most:
            rest = data
            continue
        cut = cut or len(data)
        yield data[:cut]
        rest = data[cut:]
    if rest:
        yield rest


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.piece = int(options.get("piecebytes", PIECE_BYTES))
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Members]:
        from pyarrow import fs

        system, root = _filesystem(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Members] = []
        for path in sorted(f.path for f in files if f.type == fs.FileType.File and _kind(f.path)):
            kind = _kind(path)
            if kind in ("stream", "gzip"):
                out.append(Members(path, kind))
                continue
            try:
                with _open(system, path) as file:
                    if kind == "zip":
                        members = [(m.filename, m.file_size) for m in zipfile.ZipFile(file).infolist() if not m.is_dir()]
                    else:
                        members = [(m.name, m.offset_data, m.size) for m in tarfile.open(fileobj=file, mode="r:") if m.isfile()]
                out.extend(_dealt(path, kind, members, self.most))
            except _BROKEN as broken:
                out.append(Members(path, kind, problem=f"cannot be read: {type(broken).__name__}"))
        return out or [Members(self.path, "none")]

    def _streams(self, part: Members) -> Iterator[tuple[str, object]]:
        """Name and stream of each member, one after another; no stream where the name climbs out of the archive."""
        system, _ = _filesystem(self.path)
        with _open(system, part.path) as file:
            if part.kind == "zip":
                with zipfile.ZipFile(file) as z:
                    for name, _ in part.members:
                        if climbs(name):
                            yield name, None
                        else:
                            with z.open(name) as stream:
                                yield name, stream
            elif part.kind == "tar":
                for name, at, size in part.members:
                    file.seek(at)
                    yield name, None if climbs(name) else _Bounded(file, size)
            elif part.kind == "gzip":
                with gzip.open(file) as stream:
                    yield part.path.rsplit("/", 1)[-1].removesuffix(".gz"), stream
            else:
                with tarfile.open(fileobj=file, mode="r|*") as t:
                    for m in t:
                        if m.isfile():
                            yield m.name, None if climbs(m.name) else t.extractfile(m)

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.kind == "none":
            return
        if partition.problem:
            yield partition.path, None, None, None, partition.problem
            return
        name = None
        try:
            for name, stream in self._streams(partition):
                if stream is None:
                    yield partition.path, name, None, None, "climbs out of the archive"
                    continue
                k = -1
                for k, piece in enumerate(_pieces(stream, self.piece)):
                    yield partition.path, name, k, piece, None
                if k < 0:
                    yield partition.path, name, 0, b"", None
        except _BROKEN as broken:
            yield partition.path, name, None, None, f"cannot be read: {type(broken).__name__}"


class _Bounded:
    """So many bytes of a file from where it stands."""

    def __init__(self, file, size: int):
        self.file, self.left = file, size

    def read(self, n: int) -> bytes:
        data = self.file.read(min(n, self.left))
        self.left -= len(data)
        return data


class ArchiveSource(DataSource):
    """Options: ``path``, ``pieceBytes``, ``partitionBytes``.

    Columns: ``path`` of the archive, ``member``, ``piece`` (from 0), ``content`` and ``problem``.  Members whose names climb out of a
    folder, and archives or members that can't be read, have a row without content that says so; pieces that came before stay.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def pieces(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The rows of the source; ``options`` as there."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**{k: str(v) for k, v in options.items()}).load(path)


def lines(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """``path``, ``member``, ``piece``, ``at`` (from 0 in each piece) and ``line`` of all members; lines longer than a piece are cut."""
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\r?\n\z", "")
    return pieces(spark, path, **options).where("content is not null").select("path", "member", "piece", F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
