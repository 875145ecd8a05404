"""Texts from files, captures and caches; what can't be read becomes a row, never a silence."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

CORPUS_ROW = "id string, source string, text string, language string, technique string, context string, difficulty string, injected_span array<bigint>, split string, carrier_id string, payload_id string, position string"
FIXTURE = "id string, text string, category string, context string, subcategory string, expected string, difficulty string, notes string, expected_classes array<string>"
CAPTURE = "id string, input_path string, input_sha256 string, source string, control_role string, label string, label_reason string"


def read_paths(spark: SparkSession, root: str, most_bytes: int, glob: str | None = None) -> DataFrame:
    """(path, bytes, text, problem) of all files below a folder, or of one.

    problem is oversized (text null), not_text (a NUL or no UTF-8) or null. Folders behind links aren't followed.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    # The length is known before the content, so large files are told apart without being read.
    rows = reader.load(root)
    sizes = rows.select("path", F.col("length").alias("bytes"))
    content = rows.where(F.col("length") <= most_bytes).select("path", "content")
    return _named(sizes.join(content, "path", "left"), most_bytes)


def told_apart(rows: DataFrame, most_bytes: int) -> DataFrame:
    """(path, bytes, text, problem) of (path, content)."""
    return _named(rows.withColumn("bytes", F.octet_length("content").cast("long")), most_bytes)


def _named(rows: DataFrame, most_bytes: int) -> DataFrame:
    """Which contents are texts; an oversized one isn't looked at."""
    text = F.col("content").cast("string")
    bad = ~F.is_valid_utf8(text) | F.contains(text, F.lit("\0"))
    problem = F.when(F.col("bytes") > most_bytes, "oversized").when(bad, "not_text")
    return rows.select("path", "bytes", F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def plan(targets: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(readable targets, (path, problem) of what a walk of local ones meets but can't follow or open).

    A target that isn't there is unreadable; a linked folder below a target is reported, not followed. Paths with
    a scheme are left to Spark.
    """
    found, problems = [], []
    for target in targets:
        if "://" in target:
            found.append(target)
        elif not os.path.exists(target) or not os.access(target, os.R_OK):
            problems.append((target, "unreadable_target"))
        else:
            found.append(target)
            problems += [(p, "link_not_followed") for p in not_traversed(target)]
            problems += [(p, "unreadable_target") for p in _closed(target)]
    return found, problems


def not_traversed(root: str) -> list[str]:
    """Linked folders below a local root, which a walk reports rather than follows."""
    found = []
    for folder, names, _ in os.walk(root):
        found += [p for n in names if os.path.islink(p := os.path.join(folder, n))]
    return sorted(found)


def _closed(root: str) -> list[str]:
    """Files and folders below a local root that may not be read."""
    return sorted(p for folder, names, files in os.walk(root) for n in (*names, *files) if not os.access(p := os.path.join(folder, n), os.R_OK) and not os.path.islink(p))


def unread(planned: DataFrame, read: DataFrame) -> DataFrame:
    """(path, problem) of planned paths that gave no row."""
    return planned.join(read.select("path"), "path", "left_anti").select("path", F.lit("unreadable_target").alias("problem"))


def from_buffer(spark: SparkSession, content: bytes, name: str = "stdin") -> DataFrame:
    """(path, content) of one text that a caller holds."""
    return spark.createDataFrame([(name, content)], "path string, content binary")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file by a fixed schema; a broken line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_counted(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and one row with the number of broken ones; blank lines are neither."""
    kind = T._parse_datatype_string(schema).add("_broken", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    return rows.where("_broken IS NULL").drop("_broken"), rows.agg(F.count("_broken").alias("n_broken"))


def read_fixtures(spark: SparkSession, folder: str, expected: str | None = None) -> DataFrame:
    """Labelled cases with their file's stem as source."""
    rows = spark.read.schema(FIXTURE).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(folder)
    rows = rows.withColumn("source", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))
    return rows.where(F.col("expected") == expected) if expected else rows


def read_generated(spark: SparkSession, path: str, positive: bool | None = None) -> DataFrame:
    """Generated corpus rows; those with an injected span are positive, and only these, or only the others, if asked for."""
    rows = read_jsonl(spark, path, CORPUS_ROW)
    return rows if positive is None else rows.where(F.col("injected_span").isNotNull() == F.lit(positive))


def read_prose(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of Markdown files that aren't empty; broken UTF-8 is replaced."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where("trim(text) <> ''")


def json_records(text: str) -> list[dict]:
    """Objects of a loose JSON stream: line breaks within strings are kept, lines that begin with # are comments."""
    text = "\n".join(line for line in text.split("\n") if not line.lstrip().startswith("#"))
    decoder, found, at = json.JSONDecoder(strict=False), [], 0
    while at < len(text):
        if text[at] in " \t\r\n,[]":
            at += 1
            continue
        value, at = decoder.raw_decode(text, at)
        found.append(value)
    return found


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of loose JSON files; a file is one row, parsed in Python."""
    ship(spark)
    names = T._parse_datatype_string(schema).fieldNames()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{n: r.get(n) for n in names} for t in batch["value"] for r in json_records(t)], columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(parse, schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(model, revision, file, bytes, sha256) of a model manifest in JSON; a revision that is no full commit id, or a broken row, raises."""
    kind = "model string, revision string, files array<struct<file:string,bytes:bigint,sha256:string>>"
    rows = spark.read.schema(kind).option("mode", "FAILFAST").option("multiLine", True).json(path)
    sound = F.col("revision").rlike(r"\A[0-9a-f]{40}\z") & F.col("f.sha256").rlike(r"\A[0-9a-f]{64}\z") & (F.col("f.bytes") >= 0)
    rows = rows.select("model", "revision", F.explode("files").alias("f"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("revision")).otherwise(F.raise_error(F.lit("a manifest needs full revisions, sizes and SHA-256 digests")))
    return rows.select("model", checked.alias("revision"), "f.*")


@dataclass(frozen=True)
class ClassifierConfig:
    """How a classifier is run: which model, from which score on it counts, how its windows lie."""

    model: str
    revision: str
    threshold: int = 700
    max_tokens: int = 512
    overlap: int = 63
    max_windows: int = 16

    def __post_init__(self) -> None:
        if not re.fullmatch("[0-9a-f]{40}", self.revision) or not 0 <= self.threshold <= 1000 or not 0 <= self.overlap < self.max_tokens or self.max_windows < 1:
            raise ValueError(f"unusable classifier configuration: {self}")


def read_classifier(path: str) -> ClassifierConfig:
    """A classifier's JSON configuration; unknown fields are errors."""
    with open(path, encoding="utf-8") as file:
        raw = json.load(file)
    if unknown := set(raw) - {f.name for f in fields(ClassifierConfig)}:
        raise ValueError(f"unknown {sorted(unknown)}")
    return ClassifierConfig(**raw)


def verify_assets(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(file, problem) of model files whose size or SHA-256 isn't the manifest's (file, bytes, sha256)."""
    rows = spark.read.format("binaryFile").load(folder)
    have = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("have_bytes"), F.sha2("content", 256).alias("have_sha256"))
    both = manifest.join(have, "file", "left")
    problem = F.when(F.col("have_bytes").isNull(), "missing").when(F.col("have_bytes") != F.col("bytes"), "size").when(F.col("have_sha256") != F.col("sha256"), "hash")
    return both.select("file", problem.alias("problem")).where(F.col("problem").isNotNull())
