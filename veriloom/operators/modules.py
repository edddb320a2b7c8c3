"""Documentation of Python modules, ignore lists of pyproject files, and manifests, as rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as T
from veriloom.operators.settings import texts, value_at

# Fixed values of the reference's settings. (CHK-13, CHK-15)
MODULE_FILES = ("__init__.py", "conftest.py")
EXCLUDED = (".venv", ".lint-cache", ".mypy_cache", ".ruff_cache", "__pycache__", "node_modules", ".git")
BANNED_DOCS = ("README.md", "readme.md")

_LEAD = r"(?s)\A\x{FEFF}?(?:[ \t\r\n]++|#[^\n]*+)*+[rRuU]*+"
_TRIPLE = [rf"{_LEAD}{q * 3}((?:[^\\{q}]++|\\.|{q}(?!{q * 2}))*+){q * 3}" for q in "\"'"]
_SINGLE = [rf"{_LEAD}{q}(?!{q * 2})((?:[^\\{q}\n]++|\\.)*+){q}" for q in "\"'"]
_OPENS = rf"{_LEAD}[\"']"


def docstring(text: Column) -> Column:
    """A module's docstring as it is written (escapes stay): the first literal behind blanks and comments, with no prefix but
    r and u; empty if there is none, null if the literal doesn't end. (FN-11)"""
    out = F.when(F.regexp_like(text, F.lit(_OPENS)), F.lit(None).cast("string")).otherwise("")
    for pattern in (*_SINGLE, *_TRIPLE):
        out = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(out)
    return F.when(text.isNull(), "").otherwise(out)


def folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_files(files: DataFrame, names: tuple[str, ...] = MODULE_FILES, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Files of the governed names outside the excluded folders. (SRC-09)"""
    return files.where(base(F.col("path")).isin(*names) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))


def module_docs(files: DataFrame, index: str = "", banned: tuple[str, ...] = BANNED_DOCS, **options) -> DataFrame:
    """(kind, path, detail) of violations of module documentation among files (path, text): modules without a docstring or
    without Markdown beside them, Markdown that the docstring doesn't name or the index doesn't list, references with a
    folder or to files that aren't there, and banned file names. (CHK-13, AGG-10, JOIN-09 to JOIN-11, SRC-10)

    Files meet in equi-joins on their folder, or on folder and name.
    """
    modules = module_files(files, **options).select("path", folder(F.col("path")).alias("dir"), F.coalesce(docstring(F.col("text")), F.lit("")).alias("doc"))
    markdown = files.where(F.regexp_like("path", F.lit(r"(?i)\.md$"))).select(F.col("path").alias("md"), folder(F.col("path")).alias("_dir"), base(F.col("path")).alias("name")).distinct()
    beside = modules.join(markdown, F.col("dir") == F.col("_dir"), "left")
    row = lambda df, kind, path, detail="": df.select(F.lit(kind).alias("kind"), F.col(path).alias("path"), (F.col(detail) if detail else F.lit("")).alias("detail"))
    found = beside.where(F.col("md").isNotNull())
    listed = found.select("md", "name").distinct()
    place = F.regexp_replace(F.concat(folder(F.col("md")), F.lit("/")), r"^\./", "")
    in_index = F.contains(F.lit(index), place) & F.contains(F.lit(index), F.col("name")) if index.strip() else F.lit(False)
    references = modules.select("path", "dir", F.explode(T.see_also(F.col("doc"))).alias("ref"))
    there = files.select(folder(F.col("path")).alias("_dir"), base(F.col("path")).alias("_name")).distinct()
    parts = [
        row(modules.where(F.trim(F.regexp_replace("doc", r"\s", " ")) == ""), "missing docstring", "path"),
        row(beside.where(F.col("md").isNull()), "missing markdown", "path"),
        row(found.where(~F.array_contains(T.see_also(F.col("doc")), F.col("name"))), "not referenced", "path", "md"),
        row(listed.where(~in_index), "not in index", "md"),
        row(modules.select("path", F.explode(T.see_also(F.col("doc"), T.SEE_PATH)).alias("ref")), "reference with folder", "path", "ref"),
        row(references.join(there, (F.col("dir") == F.col("_dir")) & (F.col("ref") == F.col("_name")), "left_anti"), "reference to nothing", "path", "ref"),
        row(listed.where(F.col("name").isin(*banned)), "banned name", "md"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def docstring_errors(files: DataFrame, least: int = 3, exempt: tuple[str, ...] = MODULE_FILES) -> DataFrame:
    """(path, error) of Python files without a docstring, or with fewer sentences than asked for. (CHK-15, FN-10)"""
    doc = docstring(F.col("text"))
    rows = files.where(F.endswith("path", F.lit(".py")) & ~base(F.col("path")).isin(*exempt)).select("path", doc.alias("doc"))
    n = T.sentences(F.col("doc"))
    error = F.when(F.trim(F.regexp_replace(F.coalesce("doc", F.lit("")), r"\s", " ")) == "", "missing docstring").when(n < least, F.concat(F.lit("docstring has "), n.cast("string"), F.lit(f" of {least} sentences")))
    return rows.withColumn("error", error).where("error is not null").select("path", "error")


FINDING = "struct<tool:string,setting:string,target:string,detail:string>"
# Keys under which tools keep ignore lists. (AGG-12)
RUFF_KEYS = ("per-file-ignores", "extend-per-file-ignores", "per_file_ignores", "extend_per_file_ignores")
RUFF_EXCLUDES = ("exclude", "extend-exclude", "extend_exclude")
MYPY_KEYS = ("ignore_errors", "ignore_missing_imports", "disable_error_code", "disable_error_codes")
PYLINT_KEYS = ("ignore", "ignore-patterns", "ignore-paths", "ignore-modules", "ignored-modules")
ALLOWED_IGNORES = ("tests/**", "tests/*", "**/tests/**", "**/tests/*", "test_*.py", "*_test.py", "stubs/**", "stubs/*", "**/stubs/**", "**/stubs/*")
ALLOWED_EXCLUDES = (".git", ".venv", ".mypy_cache", ".ruff_cache", "__pycache__", "*.egg-info", ".eggs", "build", "dist", "node_modules")


def _finding(tool: str, setting: str, target: Column, detail: Column | str = "") -> Column:
    return F.struct(F.lit(tool).alias("tool"), F.lit(setting).alias("setting"), target.alias("target"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _patterns(tool: str, setting: str, value: Column) -> Column:
    return F.transform(texts(value), lambda x: _finding(tool, setting, x))


def _per_file(tool: str, setting: str, value: Column) -> Column:
    """A map of patterns gives each code, or all; anything else is a list of patterns."""
    codes = lambda v: F.when(F.size(texts(v)) == 0, F.array(F.lit("<all>"))).otherwise(texts(v))
    mapped = F.flatten(F.transform(F.map_entries(F.from_json(value, "map<string,string>")), lambda e: F.transform(codes(e["value"]), lambda c: _finding(tool, setting, e["key"], c))))
    return F.when(F.startswith(F.ltrim(value), F.lit("{")), mapped).otherwise(_patterns(tool, setting, value))


def _overrides(value: Column) -> Column:
    """Findings of a list of overrides: error codes, flags that are true, and other values, for each module."""

    def of(raw: Column) -> Column:
        return F.get(F.transform(F.array(F.from_json(raw, "map<string,string>")), of_map), 0)

    def of_map(entries: Column) -> Column:
        entry = lambda k: F.element_at(entries, k)
        named = texts(F.coalesce(entry("module"), entry("modules")))
        modules = F.when(F.size(named) == 0, F.array(F.lit("<unknown>"))).otherwise(named)
        found = []
        for key in MYPY_KEYS:
            v = entry(key)
            codes = F.filter(texts(v), lambda c: F.trim(c) != "")
            if key.startswith("disable"):
                per = F.flatten(F.transform(codes, lambda c: F.transform(modules, lambda m: _finding("mypy", f"override.{key}", m, c))))
            else:
                flat = F.when(v == "true", "").otherwise(v)
                per = F.when(v == "false", F.array().cast(f"array<{FINDING}>")).otherwise(F.transform(modules, lambda m: _finding("mypy", f"override.{key}", m, flat)))
            found.append(F.when(v.isNotNull(), per).otherwise(F.array().cast(f"array<{FINDING}>")))
        return F.concat(*found)

    return F.when(F.startswith(F.ltrim(value), F.lit("[")), F.flatten(F.transform(F.from_json(value, "array<string>"), of))).otherwise(F.array().cast(f"array<{FINDING}>"))


def pyproject_findings(configs: DataFrame) -> DataFrame:
    """(path, tool, setting, target, detail), distinct: files and codes that tools are told to pass over, of configurations
    (path, config: JSON). (AGG-12, PRJ-11)"""
    table = lambda text: F.from_json(text, "map<string,string>")
    # each table is parsed once, in a projection of its own
    rows = configs.select("path", table(value_at(F.col("config"), "tool")).alias("tool"))
    rows = rows.select("path", *[table(F.element_at("tool", t)).alias(t) for t in ("ruff", "mypy", "pyright", "pylint")])
    rows = rows.select("*", table(F.element_at("ruff", "lint")).alias("lint"), table(F.element_at("pylint", "main")).alias("main"))
    wanted = [(_per_file, "ruff", at, key) for key in RUFF_KEYS for at in ("lint", "ruff")] + [(_patterns, "ruff", "ruff", key) for key in RUFF_EXCLUDES]
    wanted += [(_per_file, "mypy", "mypy", key) for key in ("per-file-ignores", "per_file_ignores")] + [(_patterns, "mypy", "mypy", "exclude")]
    wanted += [(_patterns, "pyright", "pyright", key) for key in ("exclude", "ignore")] + [(_patterns, "pylint", at, key) for at in ("pylint", "main") for key in PYLINT_KEYS]
    none = F.array().cast(f"array<{FINDING}>")
    found = [F.when(F.element_at(at, key).isNotNull(), read(tool, key, F.element_at(at, key))).otherwise(none) for read, tool, at, key in wanted]
    found.append(F.when(F.element_at("mypy", "overrides").isNotNull(), _overrides(F.element_at("mypy", "overrides"))).otherwise(none))
    return rows.select("path", F.explode(F.concat(*found)).alias("f")).select("path", "f.*").distinct()


def is_exclude(setting: Column) -> Column:
    """Whether a setting excludes whole files. (FLT-16)"""
    return setting.isin(*RUFF_EXCLUDES)


def forbidden_ignores(findings: DataFrame, ignores: tuple[str, ...] = ALLOWED_IGNORES, excludes: tuple[str, ...] = ALLOWED_EXCLUDES, missing_imports: tuple[str, ...] = ()) -> DataFrame:
    """Findings that no list allows, with `text`, as they are reported. (JOIN-17, CHK-12)"""
    target = F.col("target")
    allowed = target.isin(*ignores) | (is_exclude(F.col("setting")) & target.isin(*excludes))
    if missing_imports:
        allowed = allowed | ((F.col("tool") == "mypy") & (F.col("setting") == "override.ignore_missing_imports") & target.isin(*missing_imports))
    shown = F.concat("tool", F.lit(" "), "setting", F.lit(": "), "target", F.when(F.col("detail") != "", F.concat(F.lit(" -> "), "detail")).otherwise(""))
    return findings.where(~allowed).withColumn("text", shown)


# Fixed values of the reference's settings. (CHK-10)
MANIFEST_FIELDS = ("version",)
MANIFEST_SECTIONS = {"symlinks": (True, ("source", "target"), ()), "repositories": (False, ("name", "url"), ("branch",))}


def manifest_errors(config: Column, fields: tuple[str, ...] = MANIFEST_FIELDS, sections: dict[str, tuple[bool, tuple, tuple]] | None = None) -> Column:
    """Messages about a manifest (a JSON object): missing or mistyped fields, and lists whose entries lack fields or hold
    other values than texts. (CHK-10)"""
    sections = MANIFEST_SECTIONS if sections is None else sections
    v = F.try_parse_json(config)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    at = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    has = lambda x, name: F.array_contains(F.json_object_keys(x), name)
    none = F.array().cast("array<string>")
    lists = []
    for name in fields:
        lists.append(F.array_compact(F.array(F.when(~has(config, name), f"Missing required '{name}' field").when(kind(at(v, name)) != "STRING", f"'{name}' must be a string"))))
    for name, (required, needed, optional) in sections.items():
        part = at(v, name)
        empty = ~has(config, name) | part.isNull() | F.is_variant_null(part)

        def entry(e: Column, i: Column) -> Column:
            text = F.to_json(e)
            label = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
            wrong = lambda f: F.when(kind(at(e, f)) != "STRING", F.concat(label, F.lit(f".{f}: Expected string")))
            each = [F.when(~has(text, f), F.concat(label, F.lit(f": Missing '{f}' field"))).otherwise(wrong(f)) for f in needed]
            each += [F.when(has(text, f), wrong(f)) for f in optional]
            return F.when(F.startswith(kind(e), F.lit("OBJECT")), F.array_compact(F.array(*each))).otherwise(F.array(F.concat(label, F.lit(": Expected dict, got "), F.lower(kind(e)))))

        missing = F.array(F.lit(f"Missing required '{name}' section")) if required else none
        entries = F.try_variant_get(v, f"$.{name}", "array<variant>")
        lists.append(F.when(empty, missing).when(~F.startswith(kind(part), F.lit("ARRAY")), F.array(F.lit(f"'{name}' must be a list"))).otherwise(F.flatten(F.transform(entries, entry))))
    return F.concat(*lists)


def complex_functions(reports: DataFrame, limit: int = 15) -> DataFrame:
    """(path, name, line, complexity) over the limit, of an analyzer's JSON reports (report): a map of files to their
    functions. (AGG-13, SRC-14)"""
    parsed = F.from_json("report", "map<string,array<struct<name:string,lineno:int,complexity:int>>>")
    rows = reports.select(F.explode(parsed).alias("path", "functions")).select("path", F.explode("functions").alias("f"))
    return rows.where(F.col("f.complexity") > limit).select("path", "f.name", F.col("f.lineno").alias("line"), "f.complexity")


def hard_to_maintain(reports: DataFrame, limit: float = 50) -> DataFrame:
    """(path, mi) of files with a maintainability index below the limit; advisory only. (AGG-14, SRC-14)"""
    rows = reports.select(F.explode(F.from_json("report", "map<string,struct<mi:double>>")).alias("path", "r"))
    return rows.where(F.col("r.mi") < limit).select("path", F.col("r.mi").alias("mi"))
