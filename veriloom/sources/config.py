"""Configuration files as leaf tables (path, key, value): TOML, INI, JSON, YAML and plain values. (SRC-01 to SRC-04, SRC-12)"""

from __future__ import annotations

import configparser
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.session import ready, spread
from veriloom.sources import yaml_text

SCHEMA = "path string, key string, value string, error string"


def flatten(value: object, prefix: str = "") -> Iterator[tuple[str, str]]:
    """Dotted keys with JSON values; lists are leaves, empty maps give nothing."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{prefix}.{k}" if prefix else str(k))
    else:
        yield prefix, json.dumps(value, default=str, ensure_ascii=False)


def parse(path: str, text: str) -> dict:
    """A mapping by the path's ending; a plain file gives its trimmed text under 'value'."""
    if path.endswith(".toml"):
        return tomllib.loads(text)
    if path.endswith(".json"):
        return json.loads(text or "{}")
    if path.endswith((".ini", ".cfg")):
        ini = configparser.ConfigParser(interpolation=None)
        ini.read_string(text)
        return {s: dict(ini[s]) for s in ini.sections()}
    if path.endswith((".yaml", ".yml")):
        return yaml_text.load(text)
    return {"value": text.strip()}


def config_leaves(files: DataFrame) -> DataFrame:
    """Leaves of files (path, text); a file that doesn't parse, or whose root is no mapping, gives one row with error."""
    ready(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    root = parse(path, text or "")
                    if not isinstance(root, dict):
                        raise TypeError("root is no mapping")
                    rows += [(path, k, v, None) for k, v in flatten(root)]
                except Exception as e:  # the row says what failed
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "key", "value", "error"], dtype=object)

    return spread(files.select("path", "text")).mapInPandas(run, SCHEMA)


def config_json(files: DataFrame) -> DataFrame:
    """(path, config, error): files (path, text) as JSON objects, which settings are read from; an empty YAML file is an
    empty one, and a root that is no mapping an error. (SRC-01 to SRC-03)"""
    ready(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                try:
                    root = parse(path, text or "")
                    if not isinstance(root, dict):
                        raise TypeError("expected a mapping at the document root")
                    rows.append((path, json.dumps(root, default=str, ensure_ascii=False), None))
                except Exception as e:  # the row says what failed
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "config", "error"], dtype=object)

    return spread(files.select("path", "text")).mapInPandas(run, "path string, config string, error string")


def syntax_errors(files: DataFrame) -> DataFrame:
    """(path, error) of YAML (also of several documents), TOML and JSON files that don't parse; others pass. (CHK-14)"""
    ready(files.sparkSession)
    readers = {".yaml": yaml_text.documents, ".yml": yaml_text.documents, ".toml": tomllib.loads, ".json": json.loads}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"], strict=True):
                read = readers.get("." + path.rpartition(".")[2].lower())
                try:
                    if read:
                        read(text or "")
                except Exception as e:  # the row says what failed
                    rows.append((path, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "error"], dtype=object)

    return spread(files.select("path", "text")).mapInPandas(run, "path string, error string")


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text, size) of files below a path; text is null for binary ones (a NUL or invalid UTF-8). (SRC-04, SRC-09)"""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    ok = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content"), F.lit(b"\0"))
    return raw.select("path", F.when(ok, F.col("content").cast("string")).alias("text"), F.col("length").alias("size"))
