"""Which of many checks files meet, by their paths and by texts within: a bounded registry of checks against any number of files.

A path is looked up by its name and its suffix, so only the few globs that are more than that are tried on it. The texts of the checks that are left are
found by one automaton, all at once and in one reading of the file, which ends when every check has been met.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siftrock.functions.text import glob_regex


class Paths:
    """The numbers of the globs that a path meets."""

    def __init__(self, globs: Sequence[str]):
        self.names, self.suffixes, self.others = {}, {}, []
        for k, glob in enumerate(globs):
            last = glob.removeprefix("**/")
            if glob.startswith("**/") and not re.search(r"[*?/]", last):
                self.names.setdefault(last, []).append(k)
            elif glob.startswith("**/*.") and not re.search(r"[*?/.]", last[2:]):
                self.suffixes.setdefault(last[2:], []).append(k)
            else:
                self.others.append((k, re.compile(glob_regex(glob))))

    def of(self, path: str) -> list[int]:
        name = path.rpartition("/")[2]
        stem, dot, suffix = name.rpartition(".")
        found = self.names.get(name, []) + (self.suffixes.get(suffix, []) if dot else [])
        return sorted(found + [k for k, p in self.others if p.match(path)])


class Texts:
    """Sets of alternative texts; a text that begins with ``re:`` is a pattern."""

    def __init__(self, alternatives: Sequence[Sequence[str]]):
        self.alternatives = alternatives
        self.patterns = [re.compile("|".join(f"(?:{t[3:]})" for t in some if t.startswith("re:"))) if any(t.startswith("re:") for t in some) else None for some in alternatives]
        self.automaton = lru_cache(maxsize=1024)(self._automaton)

    def _automaton(self, wanted: tuple[int, ...]):
        """An automaton over the plain texts of these sets; files of equal names and suffixes share one."""
        import ahocorasick

        of = {}
        for k in wanted:
            for t in self.alternatives[k]:
                if not t.startswith("re:"):
                    of.setdefault(t, []).append(k)
        out = ahocorasick.Automaton()
        for t, sets in of.items():
            out.add_word(t, sets)
        out.make_automaton()
        return out if of else None

    def of(self, wanted: Sequence[int], text: str) -> list[int]:
        """Those of the ``wanted`` sets of which ``text`` holds a member."""
        left = set(wanted)
        automaton = self.automaton(tuple(wanted)) if text else None
        for _, sets in automaton.iter(text) if automaton is not None else ():
            left.difference_update(sets)
            if not left:
                break
        return [k for k in wanted if k not in left or self.patterns[k] is not None and self.patterns[k].search(text)]


def matches(files: DataFrame, checks: Sequence[tuple[str, Sequence[str]]], *, by: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """``by``, path, check (its number): each file with each (glob, texts) that it meets: its path the glob, and its content one of the texts, if
    there are any. ``most``: characters of a content that are looked at; all by default. Null contents hold nothing."""
    content = F.coalesce("content", F.lit(""))
    head = content if most is None else F.substring(content, 1, most)
    rows = files.select(*by, F.col("path").cast("string").alias("path"), head.alias("content")).where("path IS NOT NULL")

    def run(batches):
        paths, texts = Paths([g for g, _ in checks]), Texts([t for _, t in checks])
        for batch in batches:
            at, numbers = [], []
            for i, (path, text) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                fits = paths.of(path)
                asked = [k for k in fits if checks[k][1]]
                met = [k for k in fits if not checks[k][1]] + (texts.of(asked, text) if asked else [])
                at += [i] * len(met)
                numbers += met
            kept = batch.select([*by, "path"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(numbers, pa.int32())], [*by, "path", "check"])

    return rows.mapInArrow(run, StructType([*rows.select(*by).schema.fields, StructField("path", StringType()), StructField("check", IntegerType())]))
