"""Sources: files, logs, tables and corpora as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx

# Places of well-known file names in a composite document.
FIRST_NAMES = ("SKILL.md", "DESCRIPTION.md", "README.md")
# JSON of a type checker and of a linter.
MYPY = "file string, line int, column int, severity string, message string, code string"
PYLINT = "path string, line int, column int, type string, message string, symbol string"


def text_files(spark: SparkSession, root: str, pattern: str = "*.md", drop: str | None = "disabled") -> DataFrame:
    """``(path, content)`` of all files below ``root`` that fit, without paths that contain ``drop``."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return df if drop is None else df.where(~F.contains("path", F.lit(drop)))


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, length, hash, kind)``; folders that start with a dot are skipped."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return df.where(~F.col("path").rlike(r"/\.[^/]+/")).select("path", "length", F.md5("content").alias("hash"), tx.file_kind(F.col("path")).alias("kind"))





def ordered_key(path: str = "path", root: str = ""):
    """Sort key of a file: in the folder itself before deeper ones, then known names, then the lower path."""
    rel = F.regexp_replace(path, f"^.*?{root}/?", "") if root else F.col(path)
    name = F.element_at(F.split(path, "/"), -1)
    rank = F.coalesce(*[F.when(name == n, F.lit(i)) for i, n in enumerate(FIRST_NAMES)], F.lit(len(FIRST_NAMES)))
    depth = (F.size(F.split(rel, "/")) > 2).cast("int")
    return F.struct(depth.alias("deep"), rank.alias("rank"), F.lower(rel).alias("low"))


def composite(files: DataFrame, group: str, path: str = "path", content: str = "content", place: str = "place") -> DataFrame:
    """One document per group: its files in order under ``=== FILE: … ===`` headers; blank ones are skipped."""
    kept = files.where(F.trim(content) != "")
    one = F.struct(F.col(place).alias("k"), F.col(path).alias("p"), F.trim(content).alias("c"))
    g = kept.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("f"))
    text = F.array_join(F.transform("f", lambda x: F.concat(F.lit("=== FILE: "), x.p, F.lit(" ===\n"), x.c)), "\n\n")
    return g.select(group, text.alias("text"), F.transform("f", lambda x: x.p).alias("files"))


def paragraphs(docs: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """``(key, pos, tokens)`` of paragraphs with at least ``least`` alphabetic tokens."""
    p = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "par"))
    return p.select(key, "pos", tx.alpha_tokens(F.col("par")).alias("tokens")).where(F.size("tokens") >= least)


def sentence_chunks(docs: DataFrame, key: str, text: str, over: int = 30) -> DataFrame:
    """``(key, chunk, n_tokens, text)``: sentences gathered until over ``over`` tokens; the remainder is dropped."""
    import re

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                held, n, c = [], 0, 0
                for s in re.split(r"(?<=[.!?])\s+", t or ""):
                    held.append(s)
                    n += len(s.split())
                    if n > over:
                        rows.append((k, c, n, " ".join(held)))
                        held, n, c = [], 0, c + 1
            yield pd.DataFrame(rows, columns=[key, "chunk", "n_tokens", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kinds[key]}, chunk int, n_tokens int, text string")


def diagnostics(raw: DataFrame, column: str, kind: str = "pylint") -> DataFrame:
    """Typed rows of a JSON array of diagnostics; malformed text gives no rows."""
    spec = MYPY if kind == "mypy" else PYLINT
    rows = raw.select(F.explode(F.from_json(column, f"array<struct<{spec.replace(' ', ':').replace(',:', ',')}>>")).alias("d"))
    return rows.select("d.*")


def event_log(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """NDJSON lines as typed rows (batch or stream); malformed lines are dropped."""
    return lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("e")).where("e IS NOT NULL").select("e.*")


def csv_index(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV lookup under two spellings of its id (dots, underscores)."""
    df = spark.read.csv(path, header=True)
    return df.withColumn("lookup_id", F.explode(F.array_distinct(F.array(F.col(key), tx.dotless(F.col(key))))))


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or no rows if it isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def salvage_json(raw: DataFrame, column: str, key: str) -> DataFrame:
    """Complete JSON objects of noisy or truncated arrays, one row each ``(key, pos, object)``."""
    import json

    kinds = {f.name: f.dataType.simpleString() for f in raw.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = json.JSONDecoder().raw_decode
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[column], strict=True):
                at, n, t = 0, 0, t or ""
                while (at := t.find("{", at)) >= 0:
                    try:
                        got, at = decode(t, at)
                        rows.append((k, n, json.dumps(got, sort_keys=True)))
                        n += 1
                    except ValueError:
                        at += 1
            yield pd.DataFrame(rows, columns=[key, "pos", "object"])

    return raw.select(key, column).mapInPandas(run, f"{key} {kinds[key]}, pos int, object string")


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes and imports of Python sources ``(path, content)``, by their syntax tree."""
    import ast

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, c in zip(frame["path"], frame["content"], strict=True):
                try:
                    tree = ast.parse(c or "")
                except SyntaxError:
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        rows.append((p, "function", node.name, node.lineno))
                    elif isinstance(node, ast.ClassDef):
                        rows.append((p, "class", node.name, node.lineno))
                    elif isinstance(node, ast.Import):
                        rows += [(p, "import", a.name, node.lineno) for a in node.names]
                    elif isinstance(node, ast.ImportFrom):
                        rows.append((p, "import", node.module or ".", node.lineno))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, line int")


def lua_symbols(files: DataFrame) -> DataFrame:
    """Top-level functions and required modules of Lua sources, sorted: one row per path."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("l"))
    f = F.regexp_extract("l", r"^(?:local\s+)?function\s+([A-Za-z_][\w.:]*)", 1)
    r = F.regexp_extract("l", r"require\s*\(?\s*[\"']([^\"']+)[\"']", 1)
    pick = lambda c: F.array_sort(F.collect_set(F.when(c != "", c)))
    return lines.groupBy("path").agg(pick(f).alias("functions"), pick(r).alias("requires"))
