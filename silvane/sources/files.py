"""Listings: directories, ZIP packages, and the routing of inputs by kind."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import exprs as X
from ..operators import profiles

LISTING = "path string, rel_path string, ext string, length long, is_dir boolean"
ZIPPED = "package string, name string, length long, packed_length long, is_dir boolean"
# Limits.
MOST_ARCHIVES, MOST_SCANNED, MOST_OVERLAID = 2048, 1024, 250_000
ZIP_ENTRIES, ZIP_ENTRY_BYTES, ZIP_BYTES = 20_000, 2 << 30, 8 << 30


def input_kind(path: str) -> str:
    """Directory, Archive or Package, by what the path is; other inputs are errors."""
    if os.path.isdir(path):
        return "Directory"
    ext = os.path.splitext(path)[1].lower()
    if os.path.isfile(path) and ext in (".xp3", ".zip"):
        return "Archive" if ext == ".xp3" else "Package"
    raise ValueError(f"not a directory, .xp3 or .zip file: {path}")


class _Part(InputPartition):
    def __init__(self, root: str, path: str, deep: bool) -> None:
        super().__init__(path)
        self.root, self.path, self.deep = root, path, deep


class _Listing(DataSourceReader):
    """One partition for the files of the root, one for each directory in it. Links are skipped unless ``links`` is true."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.links = options.get("links", "false") == "true"

    def partitions(self) -> list[_Part]:
        inner = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=self.links))
        return [_Part(self.root, self.root, False), *(_Part(self.root, p, True) for p in inner)]

    def read(self, part: _Part) -> Iterator[tuple]:
        todo = [part.path]
        if part.deep:
            yield self._row(part, part.path, True, 0)
        while todo:
            try:
                inner = sorted(os.scandir(todo.pop()), key=lambda e: e.name)
            except PermissionError:
                continue
            for e in inner:
                if e.is_symlink() and not self.links:
                    continue
                if e.is_dir():
                    if part.deep:
                        todo.append(e.path)
                        yield self._row(part, e.path, True, 0)
                else:
                    yield self._row(part, e.path, False, e.stat().st_size)

    def _row(self, part: _Part, path: str, is_dir: bool, length: int) -> tuple:
        return path, os.path.relpath(path, part.root).replace(os.sep, "/"), os.path.splitext(path)[1].lower(), length, is_dir


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(root)``: all files and directories below a local root, empty and hidden ones too."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> _Listing:
        return _Listing(self.options)


class _Zips(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(os.pathsep) if p]

    def partitions(self) -> list[_Part]:
        return [_Part(p, p, False) for p in self.paths]

    def read(self, part: _Part) -> Iterator[tuple]:
        with zipfile.ZipFile(part.path) as z:
            for i in z.infolist():
                yield part.path, i.orig_filename, i.file_size, i.compress_size, i.is_dir()


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").load(path)``: the central directory of packages."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ZIPPED

    def reader(self, schema) -> _Zips:
        return _Zips(self.options)


def register(spark: SparkSession) -> None:
    for source in (FileListing, ZipEntries):
        spark.dataSource.register(source)


def listing(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("file_listing").load(root)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Files of a game directory with their role (archive, executable, plugin), ordered ignoring case."""
    role = F.when(F.col("ext") == ".xp3", "archive").when(F.col("ext") == ".exe", "executable").when(F.col("ext").isin(".dll", ".tpm"), "plugin")
    found = listing(spark, root).where(~F.col("is_dir")).withColumn("role", role).where("role is not null")
    if (n := found.where("role = 'archive'").count()) > MOST_ARCHIVES:
        raise ValueError(f"{n} archives, at most {MOST_ARCHIVES} are taken")
    return found.orderBy(F.upper("rel_path"), "rel_path")


def package_problems(entries: DataFrame, most_entries: int = ZIP_ENTRIES, most_entry: int = ZIP_ENTRY_BYTES, most_total: int = ZIP_BYTES) -> DataFrame:
    """Entries of ZIP packages that break a rule: PathUnsafe, Duplicate, or the limit (items, item, total)."""
    files = entries.where(~F.col("is_dir"))
    unsafe = files.where(~X.safe_relative_path(F.col("name"))).select("package", "name", F.lit("PathUnsafe").alias("problem"))
    twice = files.groupBy("package", F.upper("name").alias("k")).agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n > 1").select("package", "name", F.lit("Duplicate").alias("problem"))
    over = profiles.budget(files, ["package"], ["name"], "length", most_entries, most_entry, most_total).where("broken is not null").select("package", "name", F.col("broken").alias("problem"))
    return unsafe.unionByName(twice).unionByName(over)


def stage_member(package: str, name: str) -> bytes:
    """Bytes of one member, whose length must be what the directory says."""
    with zipfile.ZipFile(package) as z:
        data = z.read(name)
        if len(data) != z.getinfo(name).file_size:
            raise ValueError("member has another length than declared")
        return data
