"""A walk over folders as a data source, with nested ignore files.

    spark.dataSource.register(FolderWalk)
    spark.read.format("folder_walk").option("path", root).load()

Rows: path (below the root), bytes, modified (microseconds).  Partitions are folders: the driver opens the topmost folders until there are
`partitions` of them, tasks walk what lies below theirs.  Each folder's ignore file (option `ignore_file`) is read when the folder is
opened and goes before those above it; folders that are left out, hidden ones and those of `exclude` are never listed.  The root is a
path or URI of any file system that pyarrow knows and that all executors reach."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from marlstone.functions.text import exact_rule

# Folders of builds and dependencies.
EXCLUDED = ("node_modules", "target", "dist", "build", "vendor", "__pycache__", "venv")

Rules = tuple[tuple[str, bool, bool], ...]


@dataclass
class Folder(InputPartition):
    """A folder, the rules of the ignore files above it, and whether only its own files are meant."""

    path: str
    rules: Rules
    own_files: bool


def left_out(path: str, is_folder: bool, rules: Rules) -> bool:
    """What the last rule that names the path says."""
    for pattern, back, only_folders in reversed(rules):
        if (is_folder or not only_folders) and re.match(pattern, path):
            return not back
    return False


class Walker:
    def __init__(self, root: str, ignore_file: str, exclude: tuple[str, ...]):
        self.root, self.ignore_file, self.exclude = root, ignore_file, frozenset(exclude)
        self.listed: list[str] = []

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.rstrip("/"))

    def open(self, folder: str, rules: Rules) -> tuple[Rules, list, list[str]]:
        """(rules in this folder, its files as (path, bytes, modified), its folders that are to be walked)."""
        from pyarrow import fs

        store, top = self._store()
        self.listed.append(folder)
        found = sorted(store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), recursive=False)), key=lambda i: i.base_name)
        if any(i.base_name == self.ignore_file and i.type == fs.FileType.File for i in found):
            with store.open_input_stream(f"{top}/{folder}/{self.ignore_file}".replace("//", "/") if "://" not in top else f"{top}/{folder}/{self.ignore_file}") as f:
                lines = f.read().decode("utf-8", "replace").splitlines()
            rules = rules + tuple(r for line in lines if (r := exact_rule(line, folder)) is not None)
        files, folders = [], []
        for i in found:
            path = f"{folder}/{i.base_name}".lstrip("/")
            if i.base_name.startswith(".") or left_out(path, i.type == fs.FileType.Directory, rules):
                continue
            if i.type == fs.FileType.Directory:
                if i.base_name not in self.exclude:
                    folders.append(path)
            elif i.type == fs.FileType.File:
                files.append((path, i.size, i.mtime_ns // 1000))
        return rules, files, folders

    def walk(self, folder: str, rules: Rules, own_files: bool = False) -> Iterator[tuple[str, int, int]]:
        waiting = [(folder, rules)]
        while waiting:
            folder, rules = waiting.pop()
            rules, files, folders = self.open(folder, rules)
            yield from files
            if own_files:
                return
            waiting += [(f, rules) for f in reversed(folders)]


class FolderWalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.walker = Walker(options["path"], options.get("ignore_file", ".gitignore"), tuple(filter(None, options.get("exclude", ",".join(EXCLUDED)).split(","))))
        self.most = int(options.get("partitions", "64"))

    def partitions(self) -> list[Folder]:
        """The topmost folders, level by level, until there are enough; what is opened here stays a partition of its own files."""
        opened, level = [], [Folder("", (), False)]
        while level and len(opened) + len(level) < self.most:
            below = []
            for f in level:
                rules, _, folders = self.walker.open(f.path, f.rules)
                opened.append(Folder(f.path, f.rules, True))
                below += [Folder(x, rules, False) for x in folders]
            level = below
        return opened + level

    def read(self, partition: Folder) -> Iterator[tuple[str, int, int]]:
        yield from self.walker.walk(partition.path, partition.rules, partition.own_files)


class FolderWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_walk"

    def schema(self) -> str:
        return "path string, bytes long, modified long"

    def reader(self, schema) -> FolderWalkReader:
        return FolderWalkReader(dict(self.options))
