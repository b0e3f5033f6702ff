"""Collections of page files as a data source: many tasks read ranges of images, many tasks write books, and a write is all or nothing.

spark.read.format("leafmill_pages").load(folder) has a row for each image of the TIFF and
PNG files under a folder. Small files share a task; of a large file, each task reads the
tags and a range of the images, by ranges of bytes.

write.format("leafmill_books") takes prepared pages (see documents), sorted by book and position in
each partition, and writes one file a book as they come. Tasks write to a staging folder
beside the target, each attempt to one of its own; the commit gathers the files of the attempts
that count and renames the folder to the target, in one step. A failed job leaves nothing.

Paths are those of pyarrow's file systems: local or mounted folders, hdfs://, s3:// and so on.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from leafmill.sources import tiff

PAGES, BOOKS = "leafmill_pages", "leafmill_books"
#: A file from this size on is dealt over tasks, and so many images go to each; files below it share a task up to it.
SPLIT_BYTES, IMAGES = 64 << 20, 16


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)
    spark.dataSource.register(BookFiles)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)


@dataclass
class Images(InputPartition):
    """Images first to before stop (None: all) of each file."""

    files: list[tuple[str, int, int | None]]

    def __init__(self, files):
        super().__init__(files)
        self.files = files


class PageFiles(DataSource):
    """Options: path, glob (*), least (0; see tiff.reduced), split_bytes, images (of a large file, a task)."""

    @classmethod
    def name(cls) -> str:
        return PAGES

    def schema(self) -> str:
        return tiff.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.least = options["path"], options.get("glob", "*"), int(options.get("least", 0))
        self.split, self.images = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("images", IMAGES))

    def partitions(self) -> list[Images]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(root, recursive=True))
        tasks: list[list[tuple[str, int, int | None]]] = []
        shared, size = [], 0
        for f in sorted((f for f in found if f.type == pafs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob)), key=lambda f: f.path):
            if f.size >= self.split and (n := self._count(files, f.path)) > self.images:
                tasks += [[(f.path, at, at + self.images)] for at in range(0, n, self.images)]
                continue
            if shared and size + f.size > self.split:
                tasks.append(shared)
                shared, size = [], 0
            shared.append((f.path, 0, None))
            size += f.size
        return [Images(t) for t in [*tasks, *([shared] if shared else [])]] or [Images([])]

    @staticmethod
    def _count(files: pafs.FileSystem, path: str) -> int:
        try:
            with files.open_input_file(path) as f:
                return tiff.count(lambda at, size: f.read_at(size, at))
        except tiff.DAMAGED:
            return 0

    def read(self, partition: Images) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        for path, first, stop in partition.files:
            number = first
            try:
                with files.open_input_file(path) as f:
                    read = lambda at, size: f.read_at(size, at)  # noqa: B023, E731
                    pages = tiff.decode_png(read(0, f.size())) if read(0, 4) == b"\x89PNG" else tiff.each(read, first, stop)
                    for page in tiff.reduced(pages, self.least):
                        yield tiff.row_of(path, number, page)
                        number += 1
            except tiff.DAMAGED as e:  # what came before the damage has been read
                yield tiff.error_of(path, number if number > first else None, e)


@dataclass
class _Done(WriterCommitMessage):
    """Files an attempt has written: (book's file name, where it is staged)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class BookFiles(DataSource):
    """Options: path, kind (txt, hocr, pdf, tif). With mode overwrite a target is replaced; otherwise it must not be there."""

    @classmethod
    def name(cls) -> str:
        return BOOKS

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Text:
    def __init__(self, write):
        self.write, self.pages = write, 0

    def add(self, row: dict) -> None:
        if self.pages:
            self.write(b"\f")
        self.write(row["data"])
        self.pages += 1

    def finish(self) -> None:
        pass


class _Tiff:
    def __init__(self, write):
        self.file = tiff.File(write)
        self.finish = self.file.finish

    def add(self, row: dict) -> None:
        self.file.add(row["width"], row["height"], row["channels"], (row["dpi_x"], row["dpi_y"]), row["data"], row["compression"], row["bits"], row["photometric"], row["predictor"])


class _Pdf:
    def __init__(self, write):
        from leafmill.sources.documents import Pdf

        self.file = Pdf(write)
        self.finish = self.file.finish

    def add(self, row: dict) -> None:
        self.file.add(row["width"], row["height"], row["data"], row["coding"], row["text"])


KINDS = {"txt": _Text, "hocr": _Text, "pdf": _Pdf, "tif": _Tiff}


def file_name(book: str | None, kind: str) -> str:
    """A book's file name: what could part folders is escaped, and a null book has a name that no other has."""
    return f"{'%null' if book is None else quote(book, safe=' ') or '%empty'}.{kind}"


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"].rstrip("/"), options["kind"], overwrite
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        self.job = uuid.uuid4().hex

    def _staging(self) -> str:
        return f"{opened(self.path)[1]}.staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        files, _ = opened(self.path)
        own, done, seen = f"{self._staging()}/{uuid.uuid4().hex}", _Done(), set()
        files.create_dir(own, recursive=True)
        book = out = file = None
        last = None
        for batch in iterator:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if file is None or row["book"] != book:
                    if file is not None:
                        file.finish()
                        out.close()
                    book, last = row["book"], None
                    name = file_name(book, self.kind)
                    if name in seen:
                        raise ValueError(f"pages are not sorted by book: {book} comes again")
                    seen.add(name)
                    out = files.open_output_stream(f"{own}/{name}")
                    file = KINDS[self.kind](out.write)
                    done.files.append((name, f"{own}/{name}"))
                if last is not None and row["position"] is not None and row["position"] < last:
                    raise ValueError(f"pages of {book} are not sorted")
                last = row["position"] if row["position"] is not None else last
                file.add(row)
        if file is not None:
            file.finish()
            out.close()
        return done

    def commit(self, messages: list[_Done | None]) -> None:
        files, target = opened(self.path)
        made, names = f"{self._staging()}/made", set()
        files.create_dir(made, recursive=True)
        for name, place in (f for m in messages if m is not None for f in m.files):
            if name in names:
                self.abort(messages)
                raise ValueError(f"two tasks have written {name}: deal pages to tasks by book")
            names.add(name)
            files.move(place, f"{made}/{name}")
        there = files.get_file_info(target).type != pafs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        old = f"{target}.old-{self.job}"
        if there:
            files.move(target, old)
        files.move(made, target)
        files.delete_dir(self._staging())
        if there:
            files.delete_dir(old)

    def abort(self, messages: list[_Done | None]) -> None:
        files, _ = opened(self.path)
        if files.get_file_info(self._staging()).type != pafs.FileType.NotFound:
            files.delete_dir(self._staging())
