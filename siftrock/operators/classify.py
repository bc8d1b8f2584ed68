"""Languages and domains of a set of files, from names, manifests and contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftrock.functions.text import first_match

#: Suffixes and manifests by language.
LANGUAGES = {
    "python": ((".py", ".pyi"), ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "poetry.lock")),
    "javascript": ((".js", ".mjs", ".cjs", ".jsx"), ("package.json",)),
    "typescript": ((".ts", ".tsx", ".mts", ".cts"), ("tsconfig.json", "package.json")),
    "go": ((".go",), ("go.mod",)),
    "rust": ((".rs",), ("Cargo.toml",)),
    "swift": ((".swift",), ("Package.swift",)),
    "elixir": ((".ex", ".exs"), ("mix.exs",)),
    "solidity": ((".sol",), ("foundry.toml", "hardhat.config.js", "hardhat.config.ts", "truffle-config.js")),
}
#: The manifests that prove a language, where they aren't all of its own.
PROOFS = {"typescript": ("tsconfig.json",)}


def suffix_of(path: Column) -> Column:
    """The last suffix of a path's name in lower case, with its dot; empty if there is none. A name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """The language of a file by its suffix, or null."""
    known = F.create_map(*[F.lit(x) for lang, (ext, _) in LANGUAGES.items() for e in ext for x in (e, lang)])
    return F.element_at(known, suffix_of(path))


def languages(files: DataFrame, *, least: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """lang, files, manifests, detected, evidence of the languages that any file hints at, of each set of files (``by``).

    A manifest or ``least`` files prove a language; of the two that share a manifest, one needs a file as well and the other its own manifest and a file.
    """
    name = F.substring_index("path", "/", -1)
    of_name = F.create_map(*[x for m in sorted({m for _, man in LANGUAGES.values() for m in man}) for x in (F.lit(m), F.array(*[F.lit(lang) for lang, (_, man) in LANGUAGES.items() if m in man]))])
    own = F.array_compact(F.array(language_of(F.col("path"))))
    marks = F.concat(F.transform(own, lambda x: F.struct(x.alias("lang"), F.lit(False).alias("manifest"))), F.transform(F.coalesce(F.element_at(of_name, name), F.array().cast("array<string>")), lambda x: F.struct(x.alias("lang"), F.lit(True).alias("manifest"))))
    each = files.select(*by, F.explode(marks).alias("m"), name.alias("name"), suffix_of(F.col("path")).alias("suffix")).select(*by, "m.*", F.when(F.col("m.manifest"), F.col("name")).otherwise(F.col("suffix")).alias("said"))
    each = each.groupBy(*by, "lang", "manifest", "said").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are suffixes and manifests
    text = F.when(F.col("manifest"), F.concat(F.lit("manifest: "), "said")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" "), "said", F.when(F.col("n") == 1, " file").otherwise(" files")))
    proof = F.lit(True)
    for lang, names in PROOFS.items():
        proof = F.when(F.col("lang") == lang, F.col("said").isin(*names)).otherwise(proof)
    out = each.groupBy(*by, "lang").agg(
        F.coalesce(F.sum(F.when(~F.col("manifest"), F.col("n"))), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.when(F.col("manifest"), F.col("n"))), F.lit(0)).alias("manifests"),
        F.coalesce(F.sum(F.when(F.col("manifest") & proof, F.col("n"))), F.lit(0)).alias("proofs"),
        F.transform(F.array_sort(F.collect_list(F.struct("manifest", "said", text.alias("text")))), lambda x: x["text"]).alias("evidence"),
    )
    proven = (F.col("proofs") > 0) & (~F.col("lang").isin("javascript", "typescript") | (F.col("files") > 0))
    return out.select(*by, "lang", "files", "manifests", (proven | (F.col("files") >= least)).alias("detected"), "evidence")


def first_files(files: DataFrame, key: str | Sequence[str], order: str | Column, most: int = 200) -> DataFrame:
    """The first ``most`` files of each key: the sample in which contents are looked at. Each task hands on no more than these."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def evidence(files: DataFrame, patterns: dict[str, str], *, least: dict[str, int] | None = None) -> DataFrame:
    """domain, n, first: the files whose content matches a domain's pattern, at least one or as many as ``least`` says."""
    marks = F.array_compact(F.array(*[F.when(first_match(F.col("content"), p).isNotNull(), d) for d, p in patterns.items()]))
    found = files.select("path", F.explode(marks).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"))
    need = F.lit(1)
    for domain, n in (least or {}).items():
        need = F.when(F.col("domain") == domain, n).otherwise(need)
    return found.where(F.col("n") >= need)


def breakdown(files: DataFrame, key: str, part: str) -> DataFrame:
    """``key`` with its parts and their counts as one text, largest first."""
    sizes = files.groupBy(key, part).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(part).alias("p"))))
    text = F.transform(listed, lambda x: F.format_string("%s: %d file%s", x.p, -x.o, F.when(x.o == -1, "").otherwise("s")))
    return sizes.groupBy(key).agg(F.array_join(text, ", ").alias("parts"))
