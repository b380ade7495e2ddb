"""A sink of label files through Spark's Python data source API: one text file an image below labels/{split}, and a class table as YAML.

A task writes into a folder of its own and deletes that if it fails; only when all tasks are done does the commit move the files to their places.  An abort deletes the
folders of all the writer's tasks, so neither a failed or killed task nor one that runs twice leaves anything behind.  A file that is already there stays, unless ``existing`` is ``replace``.  Paths are those of any file
system that Arrow opens (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """Where a task left its files, and how many."""

    folder: str
    files: int


class LabelWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.replace = options["path"], options.get("existing", "skip") == "replace"
        self.classes = json.loads(options.get("classes", "[]"))
        self.job = uuid.uuid4().hex  # travels with the writer to its tasks and to its commit or abort

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def begin(self) -> None:
        """Makes the folder that all tasks write below."""
        system, root = self._open()
        system.create_dir(f"{root}/{STAGING}/{self.job}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        system, root = self._open()
        folder, splits, files = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", set(), 0
        try:
            system.create_dir(folder, recursive=False)  # fails where an abort has removed the writer's folder, so a late task leaves nothing
            for split, name, lines in rows:
                if split not in splits:
                    system.create_dir(f"{folder}/{split}", recursive=False)
                    splits.add(split)
                with system.open_output_stream(f"{folder}/{split}/{name}.txt") as out:
                    out.write("".join(f"{line}\n" for line in lines or []).encode())
                files += 1
        except BaseException:
            _remove(system, folder)
            raise
        return Written(folder, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        made = set()

        def move(begin: str, file: fs.FileInfo) -> None:
            target = f"{root}/labels/{file.path[len(begin) + 1 :]}"
            if self.replace or system.get_file_info(target).type == fs.FileType.NotFound:
                system.move(file.path, target)

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in messages:
                if message and message.files:
                    found = system.get_file_info(fs.FileSelector(message.folder, recursive=True))
                    for split in {f.base_name for f in found if f.type == fs.FileType.Directory} - made:
                        system.create_dir(f"{root}/labels/{split}", recursive=True)
                        made.add(split)
                    list(pool.map(lambda f, begin=message.folder: move(begin, f), [f for f in found if f.type == fs.FileType.File]))
        system.create_dir(root, recursive=True)
        names = "".join(f"  {n}: {name}\n" for n, name in enumerate(self.classes))
        with system.open_output_stream(f"{root}/data.yaml") as out:
            out.write(f"path: {root}\ntrain: images/train\nval: images/val\nnames:\n{names}".encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Deletes what this writer's tasks have left, those that were killed included, and the folder above once it is empty; other writers' stay."""
        system, root = self._open()
        _remove(system, f"{root}/{STAGING}/{self.job}")
        top = f"{root}/{STAGING}"
        if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)


def _remove(system: fs.FileSystem, folder: str, tries: int = 20) -> None:
    """Deletes a folder, again where a task that is just being killed still puts a file into it."""
    for last in range(tries):
        if system.get_file_info(folder).type != fs.FileType.Directory:
            return
        try:
            system.delete_dir(folder)
        except OSError:
            if last == tries - 1:
                raise
            time.sleep(0.1)


class LabelFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return "split string, name string, lines array<string>"

    def writer(self, schema, overwrite: bool) -> LabelWriter:
        writer = LabelWriter(dict(self.options))
        writer.begin()
        return writer


def write_label_files(labels: DataFrame, classes: list[str], path: str, existing: str = "skip") -> None:
    """``labels`` (split, name, lines) as files, with the ordered class names; names must be unique in a split (``boxes.output_names``)."""
    labels.sparkSession.dataSource.register(LabelFiles)
    rows = labels.select("split", "name", "lines")
    rows.write.format("label_files").mode("append").option("classes", json.dumps(classes, ensure_ascii=False)).option("existing", existing).save(path)
