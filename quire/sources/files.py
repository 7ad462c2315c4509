"""A sink of single files: a file a row, as a data source of Spark with commit and abort.

    spark.dataSource.register(FileSink)
    rows.select("name", "content").write.format("quire_files").option("path", uri).mode("append").save()

Tasks write through the file system that the URI names (local and mounted folders, and the stores that pyarrow has: HDFS, S3, GCS), each
attempt into a folder of its own below `_attempts`. When all have ended the driver moves what the committed attempts wrote into place and drops the rest, so that
a reader sees no part of a file, of a failed attempt, or of a failed job.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

ATTEMPTS = "_attempts"
MOVERS = 16


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it). A scheme that no file system here serves is an error, and not a folder of that name."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", uri):
        return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":", "://", 1))
    return fs.LocalFileSystem(), uri


@dataclass
class Written(WriterCommitMessage):
    """What a task's attempt wrote."""

    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri
        self.job = uuid.uuid4().hex
        place_of(uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = place_of(self.uri)
        folder, names = f"{path}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", []
        made = False
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name = name.as_py()
                if not name or "/" in name or name in (".", "..", ATTEMPTS) or not content.is_valid:
                    raise ValueError(f"no file can be made of the row named {name!r}")
                if not made:
                    store.create_dir(folder, recursive=True)
                    made = True
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_buffer())
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = place_of(self.uri)
        store.create_dir(path, recursive=True)
        moves = [(f"{m.folder}/{name}", f"{path}/{name}") for m in messages if m for name in m.names]
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda pair: store.move(*pair), moves))
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place_of(self.uri))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        """Drops this job's attempts, and their folder if no other job has any."""
        for folder in (f"{path}/{ATTEMPTS}/{self.job}", f"{path}/{ATTEMPTS}"):
            if store.get_file_info(folder).type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class FileSink(DataSource):
    """Option path: the folder's URI. Rows: name string, content binary. A name with a slash or none, or a row without content, fails the job."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])
