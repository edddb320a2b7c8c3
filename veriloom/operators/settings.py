"""Settings: look-ups in JSON configurations, defaults, overrides by check, and replies of a reviewer.

A configuration is a JSON text; values are read by dotted paths and stay JSON texts until a type is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions import text as T

# Fixed values of the reference's settings.
TIERS = ("standard", "flex", "priority")
RETRYABLE = (408, 429)
DEFAULTS = {"max_retries": 3, "timeout_seconds": 300, "initial_backoff_seconds": 1, "max_concurrent_api_calls": 1, "cache_ttl_seconds": 604800, "cache_api_ttl_seconds": 3600}


def value_at(config: Column, path: str) -> Column:
    """The value at a dotted path of a JSON object, as text (composites as JSON); null if a segment is empty or missing, or
    lies below something that is no object. (PRJ-12)"""
    parts = path.split(".")
    if not all(p.strip() for p in parts):
        return F.lit(None).cast("string")
    at = config
    for p in parts:
        at = F.element_at(F.when(F.startswith(F.ltrim(at), F.lit("{")), F.from_json(at, "map<string,string>")), p)
    return at


def value_or(config: Column, path: str, default: str = "") -> Column:
    """The value at a path, empty for null, a default if there is none. (PRJ-13, PRJ-14)"""
    *above, last = path.split(".")
    parent = value_at(config, ".".join(above)) if above else config
    there = F.coalesce(F.array_contains(F.json_object_keys(F.when(F.startswith(F.ltrim(parent), F.lit("{")), parent)), last), F.lit(False)) if last.strip() else F.lit(False)
    return F.coalesce(value_at(config, path), F.when(there, "").otherwise(default))


def texts(value: Column) -> Column:
    """A JSON value as a list of texts: null none, a list without its nulls, anything else by itself. (PRJ-11)"""
    none = F.array().cast("array<string>")
    listed = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull())
    return F.when(value.isNull() | (value == "null"), none).when(F.startswith(F.ltrim(value), F.lit("[")), listed).otherwise(F.array(value))


def listed_or(config: Column, path: str, fallback: Column) -> Column:
    """Trimmed texts at a path, or the fallback if there are none. (PRJ-14)"""
    found = T.normalized_list(texts(value_at(config, path)))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def plain_key(key: Column) -> Column:
    """A key in the form in which keys are compared: lower case, without blanks at the ends, '_', '-' and '.'. (PRJ-15)"""
    return F.regexp_replace(F.lower(F.trim(key)), "[_.-]", "")


def decoded(config: Column, fields: dict[str, str]) -> Column:
    """A struct of fields (name to type) from a JSON object; keys match whatever their case and separators, and values are
    cast, null where they can't be. (PRJ-15)"""
    entries = F.map_entries(F.from_json(config, "map<string,string>"))
    find = lambda name: F.get(F.filter(entries, lambda e: plain_key(e["key"]) == plain_key(F.lit(name))), 0)["value"]
    return F.struct(*[(find(n).try_cast(kind) if kind in ("int", "long", "double", "boolean", "string") else F.from_json(find(n), kind)).alias(n) for n, kind in fields.items()])


def tier(value: Column) -> Column:
    """A service tier, standard if none is named, null if it isn't known. (PRJ-17)"""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("", "unspecified"), "standard").when(low.isin(*TIERS), low)


def retryable(status: Column) -> Column:
    """Whether a call that ended with an HTTP status may be made again. (FLT-16)"""
    return status.isin(*RETRYABLE) | (status >= 500)


def with_defaults(settings: DataFrame) -> DataFrame:
    """settings with its tier checked and zero or missing numbers replaced by defaults. (PRJ-18)"""
    positive = {"max_concurrent_api_calls", "cache_ttl_seconds", "cache_api_ttl_seconds"}
    rule = lambda c, d: F.when((F.col(c) > 0) if c in positive else (F.col(c) != 0), F.col(c)).otherwise(F.lit(d).cast(dict(settings.dtypes)[c]))
    checked = F.coalesce(tier(F.col("service_tier")), F.raise_error(F.concat(F.lit("unknown service tier: "), "service_tier")).cast("string"))
    return settings.withColumns({c: rule(c, d) for c, d in DEFAULTS.items() if c in settings.columns} | {"service_tier": checked})


def resolved(checks: DataFrame, settings: DataFrame, overrides: DataFrame, model: str = "default-model") -> DataFrame:
    """(check, model, service_tier, thinking_budget) of checks: the override (check, model, service_tier, thinking_budget)
    of a check, else the one row of settings, else a default. (PRJ-17)"""
    o = overrides.select(F.col("check").alias("_c"), F.col("model").alias("_m"), F.col("service_tier").alias("_t"), F.col("thinking_budget").alias("_b"))
    named = lambda x: F.when(F.trim(x) != "", F.trim(x))
    shared = settings.select("model", "service_tier", "thinking_budget").first()  # a single row
    model_, tier_, budget = (F.lit(x) for x in (shared or (None, None, None)))
    j = checks.select("check").join(o, F.col("check") == F.col("_c"), "left")
    return j.select("check", F.coalesce(named(F.col("_m")), named(model_.cast("string")), F.lit(model)).alias("model"), F.coalesce(tier(F.coalesce(F.col("_t"), tier_.cast("string"))), F.lit("standard")).alias("service_tier"), F.coalesce(F.col("_b"), budget.cast("int")).alias("thinking_budget"))


def request_key(check: Column, model: Column, service_tier: Column, thinking_budget: Column, filters_off: Column, dependency: Column, prompt: Column) -> Column:
    """The key of a reply in the cache: a hash of eight parts. (FN-07)"""
    return T.cache_key(F.lit("v1"), check, model, service_tier, F.coalesce(thinking_budget.cast("string"), F.lit("unset")), filters_off.cast("string"), dependency, prompt)


def model_path(model: Column, default: str = "default-model") -> Column:
    """A model's name below models/. (PRJ-17)"""
    name = F.when(F.trim(F.coalesce(model, F.lit(""))) == "", default).otherwise(F.trim(model))
    return F.when(F.startswith(name, F.lit("models/")), name).otherwise(F.concat(F.lit("models/"), name))


def content_key(model: Column, content: Column, default: str = "default-model") -> Column:
    """The key of a content that a model keeps. (FN-08)"""
    return T.cache_key(model_path(model, default), content)


CACHED = "The source corpus to review is provided as cached content attached to this request. Analyze that cached file corpus directly; do not ask for it again."


def inline_prompt(template: Column, content: Column, mark: str = "{code_content}") -> Column:
    """content at the first mark of a template, else behind it unless it is blank. (FN-18)"""
    at = F.locate(mark, template)
    put = F.concat(template.substr(F.lit(1), at - 1), content, template.substr(at + len(mark), F.lit(2**31 - 1)))
    return F.when(at > 0, put).when(F.trim(content) == "", template).otherwise(F.concat(F.trim(template), F.lit("\n\n"), content))


def cached_prompt(template: Column) -> Column:
    """A template that says where its content is kept. (FN-18)"""
    return inline_prompt(template, F.lit(CACHED))


def request_inputs(batches: DataFrame, bindings: DataFrame) -> DataFrame:
    """batches (key, prompt, cached_prompt, ...) with the prompt to send, the dependency and the cache's name: the cached
    form where bindings (key, name) has the key. (JOIN-24)"""
    b = bindings.select(F.col("key").alias("_k"), F.col("name").alias("cached_content"))
    j = batches.join(b, F.col("key") == F.col("_k"), "left")
    bound = F.col("_k").isNotNull()
    return j.withColumns({"prompt": F.when(bound, F.col("cached_prompt")).otherwise(F.col("prompt")), "dependency": F.when(bound, F.col("key")).otherwise(""), "cached_content": F.coalesce("cached_content", F.lit(""))}).drop("_k", "cached_prompt")


VIOLATION = "struct<severity:string,file:string,message:string,ethos_section:string,line:int>"


def reply(text: Column) -> Column:
    """(verdict, violations) of a reviewer's JSON, which may stand in a code fence; null if it doesn't parse. Missing
    verdicts are PASS; severities are upper-case, INFO if blank; lines below 0 are 0. (PRJ-16)"""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*(?:```(?:json)?)?\s*|\s+\z", ""), r"\s*```\z", "")
    trim = lambda x: F.trim(F.coalesce(x, F.lit("")))

    def one(v: Column) -> Column:
        severity = F.upper(trim(v["severity"]))
        return F.struct(F.when(severity == "", "INFO").otherwise(severity).alias("severity"), T.normal_path(F.coalesce(v["file"], F.lit(""))).alias("file"), trim(v["message"]).alias("message"), trim(v["ethos_section"]).alias("ethos_section"), F.greatest(F.coalesce(v["line"], F.lit(0)), F.lit(0)).alias("line"))

    def of(r: Column) -> Column:
        verdict = F.when(F.coalesce(r["verdict"], F.lit("")) == "", "PASS").otherwise(r["verdict"])
        return F.struct(verdict.alias("verdict"), F.transform(F.coalesce(r["violations"], F.array().cast(f"array<{VIOLATION}>")), one).alias("violations"))

    parsed = F.from_json(F.when(F.try_parse_json(bare).isNotNull() & F.startswith(bare, F.lit("{")), bare), f"verdict string, violations array<{VIOLATION}>")
    return F.when(parsed.isNotNull(), F.get(F.transform(F.array(parsed), of), 0))


def checks_named(checks: DataFrame, name: str | None = None) -> DataFrame:
    """Names of checks in order, or the one asked for; raises if it isn't known. (SRT-06)"""
    if name is None or name == "all":
        return checks.select("check").distinct().orderBy("check")
    one = checks.where(F.col("check") == name).select("check").distinct()
    if one.isEmpty():
        raise ValueError(f"unknown check: {name}")
    return one


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path) of the first of each name's candidates (name, rank, path) that is among files (path). (SRC-11, SRC-16,
    SRC-19 to SRC-22)"""
    there = candidates.where(F.trim("path") != "").join(files.select(F.col("path").alias("_p")).distinct(), F.trim("path") == F.col("_p"), "left_semi")
    return there.groupBy("name").agg(F.min_by(F.trim("path"), F.col("rank")).alias("path"))


def existing(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ord) of trimmed paths (path, ord) that are among files, each at its first place. (SRC-05)"""
    named = paths.select(F.trim("path").alias("path"), "ord").where("path <> ''").groupBy("path").agg(F.min("ord").alias("ord"))
    return named.join(files.select(F.col("path").alias("_p")).distinct(), F.col("path") == F.col("_p"), "left_semi")


def changes(rows: DataFrame, scope: str, statuses: str = "") -> DataFrame:
    """(path) of a change set's rows (path, status, scope): staged or branch; statuses keeps letters such as ACMR. (SRC-06 to
    SRC-08)"""
    out = rows.where(F.col("scope") == scope)
    if statuses:
        out = out.where(F.substring("status", 1, 1).isin(*statuses))
    return out.select(T.normal_path(F.col("path")).alias("path")).distinct()


def project_name(repo: Column, root: Column, configured: Column) -> Column:
    """The overlay's name, the root folder's, the configured one, or 'repository'. (PRJ-10)"""
    named = lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.trim(x))
    return F.coalesce(named(repo), named(root), named(configured), F.lit("repository"))


def ruff_version(python: Column) -> Column:
    """3.13 as py313. (PRJ-19)"""
    return F.concat(F.lit("py"), F.replace(python, F.lit("."), F.lit("")))


def source_paths(config: Column) -> Column:
    """The configured source paths, else the packages whose imports are governed. (PRJ-19)"""
    packages = T.normalized_list(texts(value_at(config, "python.direct_imports.packages")))
    return listed_or(config, "python.source_paths", packages)


# Where each tool keeps the version, and how it is written. (SRC-12, JOIN-20)
VERSION_FIELDS = ((".python-version", "version"), ("pyproject.toml", "project.requires-python"), ("mypy.ini", "mypy.python_version"), ("pyrightconfig.json", "pythonVersion"), ("ruff.toml", "target-version"))


def version_found(leaves: DataFrame) -> DataFrame:
    """(root, path, found): what each of the five files of a root states, empty if it states nothing, from leaves (root,
    path, key, value: JSON). (SRC-12)"""
    names = F.from_json(F.lit(str(dict(VERSION_FIELDS)).replace("'", '"')), "map<string,string>")
    key = F.when(F.col("path") == ".python-version", "value").otherwise(F.element_at(names, F.col("path")))
    text = F.trim(F.regexp_replace("value", '^"|"$', ""))
    return leaves.where(F.col("path").isin(*[p for p, _ in VERSION_FIELDS])).groupBy("root", "path").agg(F.coalesce(F.max(F.when(F.col("key") == key, text)), F.lit("")).alias("found"))


def version_issues(found: DataFrame, expected: Column) -> DataFrame:
    """(root, path, field, expect, found) where a file (root, path, found) states another version. (JOIN-20, CHK-16)"""
    names = F.from_json(F.lit(str(dict(VERSION_FIELDS)).replace("'", '"')), "map<string,string>")
    is_project = F.col("path") == "pyproject.toml"
    want = F.when(F.col("path") == "ruff.toml", ruff_version(expected)).otherwise(expected)
    compared = F.when(is_project, T.version_requirement(F.col("found"))).otherwise(F.col("found"))
    shown = F.when(is_project, F.concat(F.lit(">="), expected)).otherwise(want)
    return found.where(compared != want).select("root", "path", F.element_at(names, F.col("path")).alias("field"), shown.alias("expect"), F.when(F.trim("found") == "", "<missing>").otherwise(F.col("found")).alias("found"))
