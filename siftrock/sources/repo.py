"""A source tree as a Spark data source: ``spark.read.format("repo").option("path", root).load()``.

Unlike ``binaryFile`` it sees dot-files and empty files. Options: ``skipDirs`` (comma-separated folder names to
prune), ``maxBytes`` (only so many bytes of a file are decoded; all by default), ``errors`` (``ignore`` or ``replace``), ``suffixes``
(comma-separated; others aren't read), ``filesPerTask`` and ``maxFiles`` (only the first so many files, in the order of the walk).

The driver lists the folders at the top only: each is a task that walks it. Equal names, suffixes and paths, and beginnings of paths, are pushed down to
the walk with ``pushFilters`` (Spark asks for ``spark.sql.python.filterPushdown.enabled`` too): files that fail are not opened, and tops that can't hold any
become no task. With ``maxFiles`` the driver lists that many names at most. ``file_ordinal`` is in the order of the walk, with gaps between tasks.
"""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith

SCHEMA = "path string, name string, suffix string, size long, file_ordinal long, content string"
SKIPPED = ".git,.hg,.svn,node_modules,__pycache__,.venv,venv,dist,build,target"


class Files(InputPartition):
    """Files by ordinal, or the folder (empty: the root's own files) that a task walks."""

    def __init__(self, number: int, files: list[tuple[int, str]] | None, top: str | None = None):
        super().__init__((number, files, top))


class RepoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        listed = lambda key, default: {x for x in options.get(key, default).split(",") if x}
        self.skip, self.suffixes = listed("skipdirs", SKIPPED), listed("suffixes", "")
        self.most, self.errors = int(options.get("maxbytes", -1)), options.get("errors", "ignore")
        self.share, self.files = int(options.get("filespertask", 256)), int(options.get("maxfiles", -1))
        self.equal, self.begins = {}, []

    def wanted(self, path: str) -> bool:
        name = PurePosixPath(path)
        has = {"path": path, "name": name.name, "suffix": name.suffix.lower()}
        return (not self.suffixes or has["suffix"] in self.suffixes) and all(has[c] in some for c, some in self.equal.items()) and all(path.startswith(b) for b in self.begins)

    def may_hold(self, folder: str) -> bool:
        """Whether any wanted path can lie below a folder."""
        below = folder + "/"
        return all(b.startswith(below) or below.startswith(b) for b in self.begins) and ("path" not in self.equal or any(p.startswith(below) for p in self.equal["path"]))

    def walk(self, folder: str = "", deep: bool = True):
        """Wanted paths from a folder on: its own files, then those of the folders below it, by name."""
        for top, folders, names in os.walk(os.path.join(self.root, folder) if folder else self.root):
            here = os.path.relpath(top, self.root).replace(os.sep, "/")
            within = (lambda n: n) if here == "." else (lambda n, at=here: f"{at}/{n}")
            folders[:] = sorted(f for f in folders if f not in self.skip and self.may_hold(within(f))) if deep else []
            yield from (within(n) for n in sorted(names) if self.wanted(within(n)))

    def partitions(self):
        if self.files >= 0:  # the first of all need one walk, which ends there
            found = []
            for path in self.walk():
                if len(found) >= self.files:
                    break
                found.append(path)
            found = list(enumerate(found))
            return [Files(0, found[i : i + self.share]) for i in range(0, len(found), self.share)] or [Files(0, [])]
        with os.scandir(self.root) as entries:
            tops = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.skip)
        return [Files(0, None, "")] + [Files(i, None, t) for i, t in enumerate(tops, 1) if self.may_hold(t)]

    def read(self, partition):
        number, files, top = partition.value
        listed = files if files is not None else ((number << 32 | i, p) for i, p in enumerate(self.walk(top, deep=bool(top))))
        for ordinal, path in listed:
            full = os.path.join(self.root, path)
            try:
                size = os.path.getsize(full)
                with open(full, "rb") as f:
                    content = f.read(self.most).decode("utf-8", self.errors)
            except OSError:  # unreadable: an empty text, as a file that vanished meanwhile
                size, content = 0, ""
            name = PurePosixPath(path)
            yield path, name.name, name.suffix.lower(), size, ordinal, content


class FilteringReader(RepoReader):
    def pushFilters(self, filters):
        """Keeps what the walk can decide by names; Spark decides the rest."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in ("path", "name", "suffix"):
                self._only(column, {f.value})
            elif isinstance(f, In) and column in ("path", "name", "suffix"):
                self._only(column, set(f.value))
            elif isinstance(f, StringStartsWith) and column == "path":
                self.begins.append(f.value)
            else:
                yield f

    def _only(self, column: str, values: set) -> None:
        self.equal[column] = self.equal.get(column, values) & values


class RepoSource(DataSource):
    @classmethod
    def name(cls):
        return "repo"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (FilteringReader if self.options.get("pushfilters", "false").lower() == "true" else RepoReader)(self.options)


def register(spark) -> None:
    spark.dataSource.register(RepoSource)
