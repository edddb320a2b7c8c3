"""Imports and comments of Python sources as rows, imports of internal modules, banned modules, and findings by category."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.checks import SUPPRESSIONS, first_pattern
from veriloom.operators.modules import base, folder
from veriloom.operators.review import banned_module
from veriloom.session import ready

IMPORTS = "path string, line int, kind string, module string, relative boolean, names array<struct<name:string,alias:string>>"


def imports(source: str | None) -> list[tuple]:
    """(line, kind, module, relative, names) of the import statements of a source; none if it doesn't parse. (AST-01)"""
    try:
        tree = ast.parse((source or "").removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out.append((n.lineno, "import", "", False, [(a.name, a.asname or "") for a in n.names]))
        elif isinstance(n, ast.ImportFrom):
            out.append((n.lineno, "from", n.module or "", n.level > 0, [(a.name, a.asname or "") for a in n.names]))
    return sorted(out, key=lambda x: x[0])


def import_rows(files: DataFrame) -> DataFrame:
    """The import statements of files (path, text). (AST-01)"""
    ready(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *x[:4], [{"name": a, "alias": b} for a, b in x[4]]) for path, text in zip(frame["path"], frame["text"], strict=True) for x in imports(text)]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "module", "relative", "names"])

    return files.select("path", "text").mapInPandas(run, IMPORTS)


def shown_names(names: Column) -> Column:
    """'a as b, c'. (FN-20)"""
    return F.array_join(F.transform(names, lambda n: F.when(n["alias"] != "", F.concat(n["name"], F.lit(" as "), n["alias"])).otherwise(n["name"])), ", ")


def packages(files: DataFrame) -> DataFrame:
    """(path, package) of Python files: the dotted names of the unbroken chain of folders with __init__.py in which a file
    lies, empty if its folder has none. (FN-21)

    A file meets the list of such folders by each of its folders, in an equi-join.
    """
    inits = files.where(base(F.col("path")) == "__init__.py").select(folder(F.col("path")).alias("_dir")).distinct()
    parts = F.split("path", "/")
    rows = files.where(F.endswith("path", F.lit(".py")) & F.contains("path", F.lit("/"))).select("path", parts.alias("_parts"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("_n"))
    at = rows.withColumn("_at", F.array_join(F.slice("_parts", 1, F.col("_n")), "/")).join(inits, F.col("_at") == F.col("_dir"), "left")
    depth = at.groupBy("path").agg(F.max(F.size("_parts") - 1).alias("_depth"), F.max(F.when(F.col("_dir").isNull(), F.col("_n"))).alias("_broken"), F.first("_parts").alias("_parts"))
    length = F.col("_depth") - F.coalesce("_broken", F.lit(0))
    inner = depth.select("path", F.when(length > 0, F.array_join(F.slice("_parts", F.coalesce("_broken", F.lit(0)) + 1, F.greatest(length, F.lit(1))), ".")).otherwise("").alias("package"))
    outer = files.where(F.endswith("path", F.lit(".py")) & ~F.contains("path", F.lit("/"))).select("path", F.lit("").alias("package"))
    return inner.unionByName(outer)


def module_kinds(modules: DataFrame, files: DataFrame, roots: tuple[str, ...] = (".",)) -> DataFrame:
    """(module, kind) of dotted modules (module): module or package, whichever the first root that has it says, a file
    before a folder; modules that no root has are left out. (JOIN-13)"""
    place = F.replace("module", F.lit("."), F.lit("/"))
    options = []
    for k, root in enumerate(roots):
        below = place if root in ("", ".") else F.concat(F.lit(root.strip("/") + "/"), place)
        options += [F.struct(F.lit(2 * k).alias("rank"), F.concat(below, F.lit(".py")).alias("at"), F.lit("module").alias("kind")), F.struct(F.lit(2 * k + 1).alias("rank"), F.concat(below, F.lit("/__init__.py")).alias("at"), F.lit("package").alias("kind"))]
    wanted = modules.select("module").distinct().withColumn("o", F.explode(F.array(*options)))
    hit = wanted.join(files.select(F.col("path").alias("_p")).distinct(), F.col("o.at") == F.col("_p"), "left_semi")
    return hit.groupBy("module").agg(F.min_by("o.kind", "o.rank").alias("kind"))


def direct_imports(statements: DataFrame, files: DataFrame, governed: tuple[str, ...], roots: tuple[str, ...] = (".",), exempt: tuple[str, ...] = ()) -> DataFrame:
    """(path, line, statement, suggestion) of imports of an internal module of a governed package from outside it; the
    suggestion is its parent. statements are import_rows(). (AST-02, FLT-11)"""
    for mark in exempt:
        if mark.strip(" ./"):
            statements = statements.where(~F.contains("path", F.lit(mark.strip())))
    top = lambda m: F.substring_index(m, ".", 1)
    whole = statements.where((F.col("kind") == "from") & ~F.col("relative") & (F.col("module") != "")).select("path", "line", "kind", "module", shown_names(F.col("names")).alias("names"), F.lit("").alias("alias"))
    each = statements.where("kind = 'import'").select("path", "line", "kind", F.explode("names").alias("n")).select("path", "line", "kind", F.col("n.name").alias("module"), F.lit("").alias("names"), F.col("n.alias").alias("alias"))
    rows = whole.unionByName(each).where(top(F.col("module")).isin(*governed) & F.contains("module", F.lit(".")))
    own = packages(files)
    placed = rows.join(own, "path", "left").withColumn("package", F.coalesce("package", F.lit("")))
    same = F.when(F.col("kind") == "from", (F.col("package") != "") & (F.startswith("module", F.col("package")) | F.startswith("package", F.col("module")))).otherwise((F.col("package") != "") & (top(F.col("package")) == top(F.col("module"))))
    kinds = module_kinds(rows, files, roots).where("kind = 'module'").select("module")
    bad = placed.where(~same).join(kinds, "module", "left_semi")
    parent = F.regexp_replace("module", r"\.[^.]*$", "")
    said = F.when(F.col("kind") == "from", F.concat(F.lit("from "), "module", F.lit(" import "), "names")).otherwise(F.concat(F.lit("import "), "module", F.when(F.col("alias") != "", F.concat(F.lit(" as "), "alias")).otherwise("")))
    better = F.when(F.col("kind") == "from", F.concat(F.lit("from "), parent, F.lit(" import "), "names")).otherwise(F.concat(F.lit("import "), parent))
    return bad.select("path", "line", said.alias("statement"), better.alias("suggestion"))


def banned_imports(statements: DataFrame, banned: list[tuple[str, str]]) -> DataFrame:
    """(path, line, statement, alternative) of imports that a rule (module, alternative) bans: a module, or else a name
    taken from one. (JOIN-12)"""
    alias = F.when(F.col("n.alias") != "", F.concat(F.lit(" as "), "n.alias")).otherwise("")
    plain = statements.where("kind = 'import'").select("path", "line", F.explode("names").alias("n")).select("path", "line", F.concat(F.lit("import "), "n.name", alias).alias("statement"), banned_module(F.col("n.name"), banned).alias("alternative"))
    taken = statements.where((F.col("kind") == "from") & ~F.col("relative") & (F.col("module") != "")).withColumn("alternative", banned_module(F.col("module"), banned))
    whole = taken.where("alternative is not null").select("path", "line", F.concat(F.lit("from "), "module", F.lit(" import "), shown_names(F.col("names"))).alias("statement"), "alternative")
    single = taken.where("alternative is null").select("path", "line", "module", F.explode("names").alias("n")).select("path", "line", F.concat(F.lit("from "), "module", F.lit(" import "), "n.name", alias).alias("statement"), banned_module(F.concat("module", F.lit("."), "n.name"), banned).alias("alternative"))
    return plain.unionByName(whole).unionByName(single).where("alternative is not null")


#: Strings, which hide what is in them, and comments. Quoted strings end with their line, tripled ones know no escapes.
_TOKEN = re.compile(r"""'''.*?(?:'''|\Z)|\"{3}.*?(?:\"{3}|\Z)|'(?:\\.|[^'\\\n])*(?:['\n]|\\?\Z)|"(?:\\.|[^"\\\n])*(?:["\n]|\\?\Z)|\#[^\n]*""", re.S)


def comments(source: str | None) -> list[tuple[int, str]]:
    """(line, comment) of the comments of a source that needn't parse. (STM-04)"""
    source, out, line, at = source or "", [], 1, 0
    for m in _TOKEN.finditer(source):
        if m[0][0] == "#":
            line += source.count("\n", at, m.start())
            at = m.start()
            out.append((line, m[0].strip()))
    return out


def comment_rows(files: DataFrame) -> DataFrame:
    """(path, line, comment) of files (path, text). (STM-04)"""
    ready(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(path, *x) for path, text in zip(frame["path"], frame["text"], strict=True) for x in comments(text)], columns=["path", "line", "comment"])

    return files.select("path", "text").mapInPandas(run, "path string, line int, comment string")


def suppressed(files: DataFrame) -> DataFrame:
    """(path, line, comment, label) of comments that switch a tool off, by the first pattern. (CHK-09)"""
    return comment_rows(files).withColumn("label", first_pattern(F.col("comment"), SUPPRESSIONS)).where("label is not null")


# Categories of security findings in their order. (AGG-09)
CATEGORIES = ("DEFAULT_SECRET", "SQL_INJECTION", "TEST_ENV_BYPASS")


def by_category(findings: DataFrame) -> DataFrame:
    """findings (category, ...) of known categories with `rank`, the place of their category; sort by it. (AGG-09)"""
    return findings.where(F.col("category").isin(*CATEGORIES)).withColumn("rank", F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")))


def is_test_path(path: Column, marks: tuple[str, ...] = ("tests", "conftest", "test_", "_test.py")) -> Column:
    """Whether a path is a test's: a mark that ends in .py must be in the name, another anywhere. (FLT-10)"""
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(base(path) if m.endswith(".py") else path, F.lit(m))
    return out
