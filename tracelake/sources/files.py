"""Files, settings and saved reports as DataFrames."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.core import ship
from tracelake.functions import scalar as S
from tracelake.sources.reports import SKIPPED, skipped

PYTHON = "*.[pP][yY]{,w,W,i,I}"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``(rel_path, content, content_hash, lines)`` of the Python files below ``root``, without skipped folders.

    A binary scan with a glob filter: listing and reading are distributed, bytes that are no UTF-8 are replaced.
    """
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PYTHON).load(root)
    local = F.regexp_replace("path", "^file:/*", "/")
    raw = raw.select(local.alias("path"), F.decode("content", "UTF-8").alias("content"))
    # A file scan passes over empty files; the scan's own listing has them.
    listed = spark.createDataFrame([(f,) for f in raw.inputFiles()], "path string").select(local.alias("path"))
    empty = listed.join(raw.select("path"), "path", "left_anti").withColumn("content", F.lit(""))
    files = raw.unionByName(empty).unionByName(_hidden(spark, root)).select(S.relative_path("path", root).alias("rel_path"), "content").where(~skipped("rel_path"))
    return inventory(files)


def _hidden(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of Python files that a file scan passes over, as they or a folder of theirs begin with ``_`` or ``.``;
    ``__init__.py`` is one. Their names are listed on the driver, as those of a scan are; executors read them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(sc._jsc.hadoopConfiguration())
    top = system.makeQualified(at).toString().rstrip("/") + "/"
    found = []
    if system.exists(at):
        listing = system.listFiles(at, True)
        while listing.hasNext():
            path = listing.next().getPath().toString()
            parts = path.removeprefix(top).split("/")
            if parts[-1].lower().endswith((".py", ".pyw", ".pyi")) and any(x.startswith(("_", ".")) for x in parts) and not set(parts[:-1]) & set(SKIPPED):
                found.append((path,))

    def run(batches):
        for b in batches:
            rows = []
            for path in b["path"]:
                store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with store.open_input_stream(name) as f:
                    rows.append((path, f.read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["path", "content"])

    texts = spark.createDataFrame(found, "path string").mapInPandas(run, "path string, content string")
    return texts.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")


def inventory(files: DataFrame) -> DataFrame:
    """``files(rel_path, content, ...)`` with its hash and number of lines (0 if empty)."""
    lines = F.when(F.length("content") > 0, F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    return files.withColumn("content_hash", S.content_hash("content")).withColumn("lines", lines.cast("int"))


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """A saved report; one without findings is none."""
    df = spark.read.json(path, multiLine=True)
    if "findings" not in df.columns:
        raise ValueError("not a report: it has no findings")
    return df


def load_truth(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """``[repo]`` and ``[[truth]]`` of a TOML file: the settings, and ``(case_id, file, function, cwes, cls)``."""
    spec = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    repo = spec.get("repo", {})
    if not (repo.get("local") or (repo.get("url") and repo.get("sha"))):
        raise ValueError("a repository needs a local folder, or a url and a sha")
    rows = [(t.get("id"), t.get("file"), t.get("function", ""), list(t.get("cwes", [])), t.get("class", "")) for t in spec.get("truth", [])]
    return repo, spark.createDataFrame(rows, "case_id string, file string, function string, cwes array<string>, cls string")


def load_call_graph(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of JSON maps from caller to callees."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(m).alias("src", "to")).select("src", F.explode("to").alias("dst"))


def load_graph_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(expect, src, dst)`` of a TOML file with ``edge``, ``no_edge`` and ``unknown`` tables."""
    spec = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    rows = [(kind, c.get("src"), c.get("dst")) for kind in ("edge", "no_edge", "unknown") for c in spec.get(kind, [])]
    return spark.createDataFrame(rows, "expect string, src string, dst string")


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table, empty if there is none that can be read."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).collect()
        return df
    except Exception:  # noqa: BLE001 - whatever is wrong with it, the cache only saves work
        return spark.createDataFrame([], schema)


def distributions(spark: SparkSession, site_packages: str) -> DataFrame:
    """``(dist, version, file, body)``: the metadata files of installed distributions."""
    glob = f"{site_packages}/*.dist-info/"
    raw = spark.read.text([glob + f for f in ("METADATA", "top_level.txt", "RECORD") if list(Path(site_packages).glob(f"*.dist-info/{f}"))], wholetext=True)
    path = F.col("_metadata.file_path")
    name = r"/([^/]+?)-([^/-]+)\.dist-info/([^/]+)$"
    return raw.select(
        S.canonical_name(F.regexp_extract(path, name, 1)).alias("dist"), F.regexp_extract(path, name, 2).alias("version"), F.regexp_extract(path, name, 3).alias("file"), F.col("value").alias("body")
    )


def site_paths(venv: str) -> list[str]:
    """Folders of installed packages in an environment, with those its path files add; import lines are never run."""
    out = []
    for site in sorted(Path(venv).glob("lib/python*/site-packages")):
        out.append(str(site))
        for pth in sorted(site.glob("*.pth")):
            for line in pth.read_text(encoding="utf-8", errors="replace").splitlines():
                line = line.strip()
                if line and not line.startswith(("#", "import ", "import\t")) and (site / line).is_dir():
                    out.append(str(site / line))
    return out


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, in parallel files."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_json_rows(path: str) -> list:
    return [json.loads(x) for f in sorted(Path(path).glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
