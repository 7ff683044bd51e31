"""Source files that are no valid text of the language their extension names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.syntax.common import Lines, Problem
from tracelake.llm.syntax.javascript import js_problems
from tracelake.llm.syntax.json_toml import json_problems, toml_problems
from tracelake.llm.syntax.python import problems as python_problems
from tracelake.llm.syntax.yaml import yaml_problems

#: Extension to language.
LANGUAGES = {"py": "python", "pyi": "python", "pyw": "python", "json": "json", "toml": "toml", "yaml": "yaml", "js": "javascript"}
PARSERS = {"python": python_problems, "json": json_problems, "toml": toml_problems, "yaml": yaml_problems, "javascript": js_problems}


def find_problems(text: str, language: str) -> list[Problem]:
    """All syntax errors of ``text``; a leading byte order mark is no error."""
    return PARSERS[language](text.removeprefix("\ufeff"))


def language_of(path: Column) -> Column:
    """By the extension of the last path part, lower case; null for any other file."""
    ext = F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1)
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return names[F.when(ext != "", ext)]


PARSED = "file_id bigint, repo string, rel_path string, language string, n_errors int, first_line int, first_error string, errors array<struct<line:int,message:string>>"


def one_per_file(files: DataFrame) -> DataFrame:
    """Of several deliveries of a file the one with the latest ``loaded_at`` (the greatest content on a tie).

    A partial aggregate leaves one delivery of a file in each input partition before anything moves, so a file that is
    delivered over and over does not pile up in one task. The result is hashed by ``file_id``.
    """
    best = F.max(F.struct("loaded_at", "repo", "rel_path", "content")).alias("b")
    return files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(best).select("file_id", "b.repo", "b.rel_path", "b.content")


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file in a known language, with all its errors and the first one as the cause.

    Deliveries of a file that are the same are parsed once. A null content or path gives no row, an empty text is
    valid where the language says so (Python, TOML, YAML, JavaScript, not JSON). Whole texts are parsed, nested
    however deep. Empty in, empty out.
    """
    known = one_per_file(files).withColumn("language", language_of(F.col("rel_path")))
    known = known.where(F.col("language").isNotNull() & F.col("content").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, language in zip(b["content"], b["language"], strict=True):
                found = find_problems(text, language)
                lines = Lines(text) if found else None
                errors = [{"line": lines.of(p.pos), "message": p.message} for p in found]
                out.append((len(errors), errors[0]["line"] if errors else None, errors[0]["message"] if errors else None, errors))
            head = b[["file_id", "repo", "rel_path", "language"]].reset_index(drop=True)
            yield pd.concat([head, pd.DataFrame(out, columns=["n_errors", "first_line", "first_error", "errors"])], axis=1).astype({"first_line": "Int32"})

    return known.select("file_id", "repo", "rel_path", "language", "content").mapInPandas(run, PARSED)


def invalid_files(files: DataFrame) -> DataFrame:
    """``(file_id)`` of each file with an error."""
    return parse_files(files).where("n_errors > 0").select("file_id")


def acceptance(files: DataFrame) -> DataFrame:
    """Files, invalid files and the rate of invalid ones per repository and language."""
    return (
        parse_files(files)
        .groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.count_if(F.col("n_errors") > 0).alias("n_invalid"))
        .withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
