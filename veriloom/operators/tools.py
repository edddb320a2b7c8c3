"""Files for other tools from merged settings, wrapped texts, and the prompt pack.

Settings are rows (root, config: JSON). What a file says is a table: each of its entries names, in order, the places in a
configuration that may hold its value, and what it is where none does. The entries become expressions over the parsed
configuration (a variant), so all files of a row are made together, without Python; rows are dealt over all tasks before. Python
only writes trees whose keys keep the order of the configuration (YAML) or are indented (the pack).
"""

from __future__ import annotations

import json
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.wrap import wrapped
from veriloom.operators.render import bundled
from veriloom.session import ready, spread
from veriloom.sources import yaml_text

BLANK = " \t\n\x0b\x0c\r"


class Entry(NamedTuple):
    """A value of a file: the first of its places that gives anything, the last as it is; fallback where that one is missing
    (whole: or empty, too)."""

    file: str
    key: str
    form: str
    places: tuple[str, ...]
    fallback: tuple[str, ...] = ()
    whole: bool = False


# Keys of the files, the settings that they are taken from, and their defaults. (SNK-11, PRJ-14, PRJ-19)
_SOURCES = ("python.source_paths", "python.direct_imports.packages")
ENTRIES = [
    Entry("pyright", "typeCheckingMode", "text", ("tooling.pyright.type_checking_mode",), ("strict",), True),
    Entry("pyright", "include", "list", ("tooling.pyright.include", *_SOURCES)),
    Entry("pyright", "exclude", "list", ("tooling.pyright.exclude",), ("**/tests/**", "**/*_test.py", "**/test_*.py", "**/.venv/**")),
    Entry("pyright", "extraPaths", "list", ("tooling.pyright.extra_paths", "python.extra_paths"), (".",)),
    Entry("pyright", "venvPath", "text", ("tooling.pyright.venv_path", "python.venv_path"), (".",)),
    Entry("pyright", "venv", "text", ("tooling.pyright.venv", "python.venv"), (".venv",)),
    Entry("pyright", "pythonVersion", "text", ("style.python_version",), ("3.13",), True),
    Entry("pyright", "stubPath", "optional", ("tooling.pyright.stub_path", "python.stub_paths")),
    Entry("mypy", "strict", "flag", ("tooling.mypy.strict",)),
    Entry("mypy", "warn_unused_configs", "flag", ("tooling.mypy.warn_unused_configs",)),
    Entry("mypy", "python_version", ", ", ("style.python_version",), ("3.13",), True),
    Entry("mypy", "files", ", ", ("tooling.mypy.files", *_SOURCES)),
    Entry("mypy", "plugins", ", ", ("tooling.mypy.plugins",), ("pydantic.mypy",)),
    Entry("mypy", "mypy_path", ",", ("tooling.mypy.mypy_path", "python.stub_paths")),
    Entry("mypy", "exclude", "|", ("tooling.mypy.exclude_patterns",), (r"(^|/)tests/", r"(^|/).*_test\.py$", r"(^|/)test_.*\.py$", r"(^|/)\.venv/")),
    Entry("ruff", "exclude", "list", ("tooling.ruff.exclude",), (".git", ".venv", ".mypy_cache", ".ruff_cache", "__pycache__", "*.egg-info", ".eggs", "build", "dist", "node_modules")),
    Entry("lint", "select", "list", ("tooling.ruff.select",), ("ALL",)),
    Entry("lint", "ignore", "list", ("tooling.ruff.ignore",)),
]
PLUGIN = ("pydantic.mypy", "\n[pydantic-mypy]\ninit_forbid_extra = True\ninit_typed = True\nwarn_required_dynamic_aliases = True\n")
# Whose codes are ignored where, later rows in place of earlier ones: places of paths, their default, place of
# codes, their default, the switch that must be on. (SET-05)
IGNORES = [
    ("python.stub_paths", (), "tooling.ruff.stub_per_file_ignores", (), None, r"\*\.pyi?$"),
    ("python.test_paths", ("tests",), "tooling.ruff.test_per_file_ignores", (), None, r"\*\.pyi?$"),
    ("python.sql_centralization.central_paths", (), "tooling.ruff.sql_per_file_ignores", ("S608",), "python.sql_centralization.enabled", r"\.[^/]*$"),
]
# Sentences on what the settings enforce: the switch that must be on, the sentence, what stands between its
# parts, and each part with the place of its values and what joins them. (RND-14)
NOTES = [
    (None, "Shared line length is {} characters.", "", [("{}", "style.line_length", ", ")]),
    (None, "Target Python version is {}.", "", [("{}", "style.python_version", ", ")]),
    (None, "Primary source paths: {}.", "", [("{}", "python.source_paths", ", ")]),
    (None, "Primary test paths: {}.", "", [("{}", "python.test_paths", ", ")]),
    (None, "Stub paths: {}.", "", [("{}", "python.stub_paths", ", ")]),
    ("python.direct_imports.enabled", "Direct internal imports are restricted for packages: {}.", "", [("{}", "python.direct_imports.packages", ", ")]),
    ("python.util_centralization.enabled", "Utility centralization is enabled; banned direct imports: {}.", "", [("{}", "python.util_centralization.banned_modules", "; ")]),
    ("python.sql_centralization.enabled", "SQL centralization is enabled; keep raw query strings in {}.", " and ", [("module {}", "python.sql_centralization.module_name", ", "), ("paths {}", "python.sql_centralization.central_paths", ", ")]),
    ("python.plan_completion.enabled", "Plan workflow enforcement is enabled; {}.", ", ", [("plan roots {}", "python.plan_completion.root_markers", ", "), ("metadata file {}", "python.plan_completion.metadata_filename", ", ")]),
    ("python.pytest_gate.enabled", "Pytest gate command: {}.", "", [("{}", "python.pytest_gate.test_command", " ")]),
    (None, "Gemini modal-path allowlist: {}.", "", [("{}", "gemini.modal_allowlist_files", ", ")]),
]

#: All places of the tables, those beside them, and those whose values only count as lists.
LISTS, NAMES = ("python.util_centralization.banned_modules",), ("project.name", "project.review_context")
PLACES = list(dict.fromkeys([*(x for e in ENTRIES for x in e.places), *(x for row in IGNORES for x in (row[0], row[2], row[4]) if x), *(x for note in NOTES for x in (note[0], *(place for _, place, _ in note[3])) if x), "tooling.ruff.target_version", "tooling.ruff.extra_per_file_ignores", "tooling.ruff.banned_api", *NAMES]))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def at(path: str) -> Column:
    """The value of a settled configuration at a dotted path, as a variant; null where there is none. (PRJ-14)"""
    return F.try_variant_get("tree", f"$.{path}", "variant")


def _scalar(value: Column) -> Column:
    """A variant's text; a mapping with a module is that and its alternative."""
    part = lambda k: F.coalesce(F.btrim(F.try_variant_get(value, f"$.{k}", "string"), F.lit(BLANK)), F.lit(""))
    kind, text = F.schema_of_variant(value), value.cast("string")
    ban = F.when(part("module") == "", "").when(part("alternative") == "", part("module")).otherwise(F.concat(part("module"), F.lit(" -> "), part("alternative")))
    return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind.startswith("OBJECT"), ban).otherwise(text)


def settled(configs: DataFrame) -> DataFrame:
    """(root, config, tree, set) of configurations (root, config); null is an empty one. set maps each place that a table
    above names and that is there to its trimmed texts (of a list, or of a single value as a list of one, without empty
    ones), and whether it is on (neither false, zero, null nor empty): one expression over the places, not one for each."""
    tree = configs.select("root", "config", F.parse_json(F.coalesce("config", F.lit("{}"))).alias("tree"))
    found = F.transform(F.array(*map(F.lit, PLACES)), lambda p: F.struct(p.alias("place"), F.try_variant_get("tree", F.concat(F.lit("$."), p), "variant").alias("value")))

    def setting(x: Column) -> Column:
        kind, text = F.schema_of_variant(x["value"]), x["value"].cast("string")
        number = kind.rlike("^(DECIMAL|DOUBLE)")  # as written: a variant forgets the end of 4.0
        one = F.when(number, F.call_function("get_json_object", F.col("config"), F.concat(F.lit("$."), x["place"]))).when(~x["place"].isin(*LISTS), _scalar(x["value"]))
        off = F.is_variant_null(x["value"]) | text.isin("", "[]", "{}") | ((kind != "STRING") & text.isin("false", "0", "0.0"))
        return F.struct(x["place"], F.struct(_listed(x["value"], one).alias("texts"), (~F.coalesce(off, F.lit(False))).alias("on")))

    return tree.withColumn("set", F.map_from_entries(F.transform(F.filter(found, lambda x: x["value"].isNotNull()), setting)))


def values(path: str) -> Column:
    """The texts of a setting, of a settled configuration."""
    return F.coalesce(F.col("set")[path]["texts"], _texts(()))


def truth(path: str, missing: bool) -> Column:
    """Whether a setting is on."""
    return F.coalesce(F.col("set")[path]["on"], F.lit(missing))


def _listed(found: Column, one: Column) -> Column:
    many = F.coalesce(F.transform(F.try_variant_get(found, "$", "array<variant>"), _scalar), F.array(one))
    return F.filter(F.transform(many, lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def resolved(entry: Entry) -> Column:
    """The values of an entry."""
    last = entry.places[-1]
    end = F.coalesce(F.col("set")[last]["texts"], _texts(entry.fallback))
    if entry.whole:
        end = F.when(F.size(end) == 0, _texts(entry.fallback)).otherwise(end)
    return reduce(lambda below, place: F.when(F.size(values(place)) > 0, values(place)).otherwise(below), reversed(entry.places[:-1]), end)


def quoted(text: Column) -> Column:
    """A text as JSON in ASCII."""
    odd = lambda c: F.lower(F.regexp_extract(F.to_json(F.array(c), {"writeNonAsciiCharacterAsCodePoint": "true"}), r'(?s)^\["(.*)"\]$', 1))
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"^[ !#-\[\]-~]$"), c).when(c == "\x7f", F.lit("\\u007f")).otherwise(odd(c)))
    return F.concat(F.lit('"'), F.when(text.rlike(r"^[ !#-\[\]-~]*$") & ~text.contains("\n"), text).otherwise(F.array_join(chars, "")), F.lit('"'))


def toml_list(items: Column) -> Column:
    """(FN-26)"""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def _rows(file: str, pair) -> Column:
    """The rows of a file's entries that have one, in order."""
    made = [pair(e.key, e.form, resolved(e)) for e in ENTRIES if e.file == file]
    return F.array_compact(F.array(*made))


def pyright() -> Column:
    """pyrightconfig.json. (SNK-11)"""

    def pair(key: str, form: str, found: Column) -> Column:
        block = F.when(F.size(found) == 0, "[]").otherwise(F.concat(F.lit("[\n        "), F.array_join(F.transform(found, quoted), ",\n        "), F.lit("\n    ]")))
        value = block if form == "list" else quoted(F.coalesce(F.get(found, 0), F.lit("")))
        row = F.concat(F.lit(f'    "{key}": '), value)
        return F.when(F.size(found) > 0, row) if form == "optional" else row

    return F.concat(F.lit("{\n"), F.array_join(_rows("pyright", pair), ",\n"), F.lit("\n}\n"))


def mypy() -> Column:
    """mypy.ini. (SNK-11)"""
    flags = {e.key: F.initcap(truth(e.places[0], True).cast("string")) for e in ENTRIES if e.form == "flag"}

    def pair(key: str, form: str, found: Column) -> Column:
        value = flags[key] if form == "flag" else F.array_join(found, form)
        return F.when(value != "", F.concat(F.lit(f"{key} = "), value, F.lit("\n")))

    (plugins,) = (resolved(e) for e in ENTRIES if (e.file, e.key) == ("mypy", "plugins"))
    return F.concat(F.lit("[mypy]\n"), F.array_join(_rows("mypy", pair), ""), F.when(F.array_contains(plugins, PLUGIN[0]), PLUGIN[1]).otherwise(""))


def mapping(path: str) -> Column:
    """(key, value: variant) of a mapping, by key; nothing where it is missing or empty, an error where it is something else."""
    found = F.try_variant_get(at(path), "$", "map<string,variant>")
    wrong = F.when(truth(path, False) & found.isNull(), F.raise_error(F.lit(f"{path} must be a mapping.")).cast("array<struct<key:string,value:variant>>"))
    return F.coalesce(wrong, F.map_entries(found), F.array().cast("array<struct<key:string,value:variant>>"))


def ignores() -> Column:
    """(pattern, codes) of IGNORES, then the configured ones."""
    listed = []
    for place, default, codes, usual, switch, single in IGNORES:
        where, what = resolved(Entry("", "", "", (place,), default)), resolved(Entry("", "", "", (codes,), usual))
        bare = F.filter(F.transform(where, lambda p: F.btrim(p, F.lit("/"))), lambda p: p != "")
        rows = F.transform(bare, lambda p: F.struct(F.when(p.rlike(single), p).otherwise(F.concat(p, F.lit("/**"))).alias("pattern"), what.alias("codes")))  # noqa: B023
        listed.append(rows if switch is None else F.when(truth(switch, False) & (F.size(what) > 0), rows).otherwise(F.filter(rows, lambda _: F.lit(False))))
    kind = "array<struct<pattern:string,codes:array<string>>>"
    listed.append(F.transform(mapping("tooling.ruff.extra_per_file_ignores"), lambda e: F.struct(e["key"].alias("pattern"), _listed(e["value"], _scalar(e["value"])).alias("codes"))))
    return F.concat(*[x.cast(kind) for x in listed])


def per_file_ignores(every: Column) -> Column:
    """(pattern, codes) in order of the patterns, each later one in place of an earlier; patterns without codes go. (SET-05)"""
    patterns = F.array_sort(F.array_distinct(F.transform(every, lambda r: r["pattern"])))
    last = F.transform(patterns, lambda p: F.element_at(F.filter(every, lambda r: r["pattern"] == p), -1))
    return F.filter(last, lambda r: F.size(r["codes"]) > 0)


def _number(path: str, missing: int) -> Column:
    return F.when(at(path).isNull(), F.lit(missing)).otherwise(F.try_variant_get(at(path), "$", "double").cast("long")).cast("string")


def ruff() -> Column:
    """ruff.toml, of a settled configuration with its ignores as `ignored`. (SNK-11)"""
    (version,) = (resolved(e)[0] for e in ENTRIES if e.key == "pythonVersion")
    target = F.coalesce(F.get(values("tooling.ruff.target_version"), 0), F.concat(F.lit("py"), F.replace(version, F.lit("."), F.lit(""))))
    pair = lambda key, form, found: F.concat(F.lit(f"{key} = "), toml_list(found), F.lit("\n"))
    (exclude,) = (F.when(F.size(resolved(e)) > 0, pair(e.key, e.form, resolved(e))).otherwise("") for e in ENTRIES if e.file == "ruff")
    section = lambda name, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n[lint.{name}]\n"), F.array_join(rows, ""))).otherwise("")
    codes = F.transform(per_file_ignores(F.col("ignored")), lambda r: F.concat(quoted(r["pattern"]), F.lit(" = "), toml_list(r["codes"]), F.lit("\n")))
    said = F.filter(F.transform(mapping("tooling.ruff.banned_api"), lambda e: F.struct(e["key"].alias("name"), F.btrim(_scalar(e["value"]), F.lit(BLANK)).alias("msg"))), lambda e: e["msg"] != "")
    bans = F.transform(F.array_sort(said), lambda e: F.concat(quoted(e["name"]), F.lit(" = { msg = "), quoted(e["msg"]), F.lit(" }\n")))
    named = F.when(F.size(mapping("tooling.ruff.banned_api")) > 0, F.concat(F.lit("\n[lint.flake8-tidy-imports.banned-api]\n"), F.array_join(bans, ""))).otherwise("")
    top = F.concat(F.lit('target-version = "'), target, F.lit('"\nline-length = '), _number("style.line_length", 88), F.lit("\n"), exclude)
    return F.concat(top, F.lit("\n[lint]\n"), F.array_join(_rows("lint", pair), ""), F.lit("\n[lint.pylint]\nmax-args = "), _number("tooling.ruff.max_args", 6), F.lit("\n"), section("per-file-ignores", codes), named)


# The part of a configuration that a YAML file holds, where the file has it, and the settings put into it: place,
# value, default; the value as text or as a number. (SNK-11)
TREES = {
    ".yamllint.yml": [("extends", "tooling.yamllint.extends", "default", str), ("rules", "tooling.yamllint.rules", {}, dict), ("rules.line-length.max", "style.line_length", 88, int)],
    ".golangci.yml": [("", "tooling.golangci_lint", {}, dict), ("linters.settings.lll.line-length", "style.line_length", 88, int), ("version", "tooling.golangci_lint.version", "2", str)],
}


def put(tree: dict, place: str, value: object) -> dict:
    """tree with a value at a dotted place; what lies on the way must be mappings, and is made where it is missing."""
    if not place:
        return dict(value)
    key, _, rest = place.partition(".")
    if rest and not isinstance(tree.get(key, {}), dict):
        raise TypeError(f"{key} must be a mapping.")
    return {**tree, key: put(tree.get(key, {}), rest, value) if rest else value}


def _trees(files: pd.Series, configs: pd.Series) -> pd.Series:
    out = []
    for file, config in zip(files, configs, strict=True):
        settings, tree = json.loads(config or "{}"), {}
        for place, source, missing, form in TREES[file]:
            found = reduce(lambda x, key: x.get(key) if isinstance(x, dict) else None, source.split("."), settings)
            if form is dict and found is not None and not isinstance(found, dict):
                raise TypeError(f"{source} must be a mapping.")
            tree = put(tree, place, missing if found is None or form is str and not str(found).strip() else form(found))
        out.append(yaml_text.dump(tree))
    return pd.Series(out, dtype=object)


def tool_files(configs: DataFrame, head: str = "") -> DataFrame:
    """(root, path, content) of the tools' files for each configuration (root, config); head: comment lines above those that
    allow comments. A configuration of a wrong form fails; null is an empty one. (SNK-03, SNK-11)"""
    ready(configs.sparkSession)
    configs = spread(configs.select("root", "config"))
    made = {"pyrightconfig.json": pyright(), "mypy.ini": F.concat(F.lit(head), mypy()), "ruff.toml": F.concat(F.lit(head), ruff())}
    rows = settled(configs).withColumn("ignored", ignores())
    plain = rows.select("root", F.explode(F.array(*[F.struct(F.lit(path).alias("path"), text.alias("content")) for path, text in made.items()])).alias("f")).select("root", "f.*")
    trees = configs.select("root", F.explode(F.array(*map(F.lit, TREES))).alias("path"), "config")
    return plain.unionByName(trees.select("root", "path", F.concat(F.lit(head), F.pandas_udf(_trees, "string")("path", "config")).alias("content")))


def notes() -> Column:
    """The sentences of NOTES that have something to say of a settled configuration. (RND-14)"""
    said = []
    for switch, sentence, between, parts in NOTES:
        found = [F.when(F.size(values(place)) > 0, F.concat(F.lit(text.partition("{}")[0]), F.array_join(values(place), joint))) for text, place, joint in parts]
        text = F.concat_ws(between, *found)
        on = (text != "") & (truth(switch, False) if switch else truth(parts[0][1], False))
        before, _, after = sentence.partition("{}")
        said.append(F.when(on, F.concat(F.lit(before), text, F.lit(after))))
    return F.array_compact(F.array(*said))


def enforcement_notes(configs: DataFrame) -> DataFrame:
    """(root, notes) of each configuration (root, config). (RND-14)"""
    return settled(spread(configs.select("root", "config"))).select("root", notes().alias("notes"))


_SHELL = {"includeExtensions": [".sh", ".bash"], "excludeSubstrings": [], "excludePrefixes": [], "allowExtensionlessInScripts": True, "shebangMarkers": ["bash", "sh"]}
# Scope, files of a batch, KB of a file, and which files a check reads. (PRJ-21)
CHECKS = {
    "code_ethos": {
        "fileScope": "code",
        "batchSize": 3,
        "maxFileSizeKb": 50,
        "selector": {
            "includeExtensions": [".py", ".pyi", ".sh", ".bash", ".go", ".rs", ".ts", ".js"],
            "excludeSubstrings": ["test_", "_test.", ".test.", "/tests/", "/test/", "/__pycache__/", "/node_modules/", "/vendor/", "/.venv/", "/venv/", "/migrations/"],
            "excludePrefixes": [".venv/", "venv/", "__pycache__/", "node_modules/"],
            "allowExtensionlessInScripts": False,
            "shebangMarkers": ["python", "bash", "sh"],
        },
    },
    "shell_review": {"fileScope": "shell", "batchSize": 5, "maxFileSizeKb": 50, "selector": _SHELL},
    "shell_ethos": {"fileScope": "shell", "batchSize": 5, "maxFileSizeKb": 30, "selector": _SHELL},
    "shell_documentation": {"fileScope": "shell", "batchSize": 5, "maxFileSizeKb": 50, "selector": _SHELL},
    "shellcheck_suppression": {"fileScope": "shell", "batchSize": 8, "maxFileSizeKb": 50, "selector": _SHELL},
    "shell_placeholder": {"fileScope": "shell", "batchSize": 10, "maxFileSizeKb": 50, "selector": _SHELL},
}


def payload(p: Column) -> Column:
    """A principle as the pack has it: three short references, and one agent's hint. (PRJ-09)"""
    hint = F.trim(F.coalesce(F.element_at(p["agent_hints"], "gemini"), F.lit("")))
    return F.struct(hint.alias("agent_hint"), p["directive"].alias("directive"), p["id"].alias("id"), p["ord"].alias("order"), F.slice(p["quick_ref"], 1, 3).alias("quick_ref"), p["summary"].alias("summary"), p["title"].alias("title"))


def prompt_pack(bundles: DataFrame, principles: DataFrame, configs: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """(bundle, path, content): the prompt pack of each bundle (see render) as JSON with sorted keys; configs (root, config)
    by the bundle's root_name, prompts by check. (RND-13, PRJ-09, PRJ-10, PRJ-21, SRT-07)"""
    whole = bundled(bundles, principles)
    said = settled(configs).select("root", notes().alias("notes"), *[F.get(values(x), 0).alias(x.replace(".", "__")) for x in NAMES])
    j = whole.join(said, F.col("root_name") == F.col("root"), "left")
    repo = F.col("repo")
    entries = lambda m: F.map_entries(m)
    own = F.coalesce(F.element_at("profile_notes", "gemini"), F.array().cast("array<string>"))
    more = F.coalesce(F.element_at(repo["agent_notes"], "gemini"), F.array().cast("array<string>"))
    both = F.array_distinct(F.filter(F.transform(F.concat(own, more), lambda x: F.trim(x)), lambda x: x != ""))
    parts = F.struct(
        F.transform("principles", payload).alias("principles"),
        F.transform(F.filter(entries(repo["commands"]), lambda e: F.size(e["value"]) > 0), lambda e: F.struct(e["value"].alias("examples"), e["key"].alias("name"))).alias("repo_commands"),
        F.transform(F.filter(entries(repo["paths"]), lambda e: F.trim(e["value"]) != ""), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("path"))).alias("repo_paths"),
        repo["notes"].alias("repo_notes"),
        both.alias("gemini_notes"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("enforcement_notes"),
    )
    named = lambda own, place, usual: F.coalesce(F.nullif(own, F.lit("")), place, F.lit(usual))
    project = F.struct(
        named(F.coalesce(F.nullif(repo["name"], F.lit("")), "root_name"), F.col("project__name"), "repository").alias("name"),
        named(repo["overview"], F.col("project__review_context"), "shared repository automation and engineering tooling").alias("context"),
        repo["overview"].alias("repo_overview"),
    )
    pack = F.concat(F.lit('{"version": 1, "project": '), F.to_json(project, {"ignoreNullFields": "false"}), F.lit(', "grounding": '), F.to_json(parts), F.lit(', "checks": ' + json.dumps(CHECKS) + ', "prompts": ' + json.dumps(prompts) + "}"))
    ready(j.sparkSession)

    @F.pandas_udf("string")
    def indented(packs: pd.Series) -> pd.Series:
        return packs.map(lambda x: json.dumps(json.loads(x), indent=2, sort_keys=True) + "\n")

    return j.select("bundle", F.lit("prompt-pack.json").alias("path"), indented(pack).alias("content"))


def wrapped_texts(rows: DataFrame, col: str = "text") -> DataFrame:
    """rows with a column of texts wrapped; texts of one line stay. (FN-19)"""
    ready(rows.sparkSession)

    @F.pandas_udf("string")
    def wrap(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: x if x is None or "\n" not in x else wrapped(x))

    return rows.withColumn(col, wrap(F.col(col)))
