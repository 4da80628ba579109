"""A sink of whole files: each row (name, content) or (name, source) becomes a file of a shared folder.

Spark's built-in writers choose their own file names; this one is a Python data source, so
executors write, a task that runs again writes the same files anew, and each file appears
whole (it is written beside its place and moved there).
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "whole_files"
#: What becomes of a row's source: a link to it, or a copy of it.
MODES = ("link", "copy")


def located(folder: str):
    """(file system, path) of a folder by its URI; a plain path is a local or mounted one."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, mode: str):
        self.folder, self.mode = folder, mode

    def write(self, rows: Iterator[Row]) -> Written:
        from pyarrow import fs

        system, root = located(self.folder)
        n, made = 0, set()
        for row in rows:
            path = f"{root}/{row['name']}"
            above = path.rpartition("/")[0]
            if above not in made:
                system.create_dir(above, recursive=True)
                made.add(above)
            found = system.get_file_info(path).type != fs.FileType.NotFound
            if row["content"] is None and found:  # a target that is there counts as done
                n += 1
                continue
            beside = f"{above}/.{uuid.uuid4().hex}"
            if row["content"] is not None:
                with system.open_output_stream(beside) as out:
                    out.write(bytes(row["content"]))
            else:
                self._take(system, row["source"], beside)
            system.move(beside, path)
            n += 1
        return Written(n)

    def _take(self, system, source: str, path: str) -> None:
        import os

        there, at = located(source)
        if self.mode == "link" and type(system).__name__ == type(there).__name__ == "LocalFileSystem":
            try:
                os.symlink(os.path.abspath(at), path)
                return
            except OSError:  # a file system without links gets a copy
                pass
        with there.open_input_stream(at) as read, system.open_output_stream(path) as out:
            shutil.copyfileobj(read, out)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = located(self.folder)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["folder"], self.options.get("mode_of_sources", "link"))


def write_files(rows: DataFrame, folder: str, mode: str = "link") -> None:
    """Writes rows (name, content or null, source or null) below folder; names may hold folders, equal names are one file."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    from pyspark.sql import functions as F

    there = {"content": "binary", "source": "string"}
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in there.items()]
    rows.sparkSession.dataSource.register(FileSource)
    rows.select("name", *cols).write.format(NAME).option("folder", folder).option("mode_of_sources", mode).mode("append").save()
