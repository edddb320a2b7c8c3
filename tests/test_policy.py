"""The principle model, its documents, settings, module, import and manifest checks on small inputs, by hand."""

import json

import pytest
from pyspark.sql import functions as F

from veriloom.functions.wrap import wrapped
from veriloom.operators import imports, modules, principles, render, settings, tools


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


ITEMS = [
    {"id": "a", "order": 2, "title": "Solid_is-law", "body": "First line\nmore\n", "tags": ["x", " ", "y"], "related": ["b"]},
    {"id": "b", "order": "1", "title": "B", "summary": "Sum.", "directive": "Do.", "quick_ref": "one", "merge_topics": ["t1", "", " t2 "], "agent_hints": {"codex": " h "}, "sections": [{"id": "s1", "title": "S", "body": "Bd\nx"}, {"id": "s2", "title": "T", "body": "Z", "kind": "rule", "summary": "zz"}]},
    {"id": "", "title": "", "sections": [{"id": "q", "title": "", "body": "", "kind": "odd"}, {"id": "q", "title": "t", "body": "b"}], "quick_ref": [], "agent_hints": {"bard": "x"}},
]
HINTS = {"codex": "c", "claude": "d", "gemini": "e"}


def model(spark, items=ITEMS):
    rows = frame(spark, [(f"i{k}", json.dumps(x)) for k, x in enumerate(items)], "source string, payload string")
    return principles.principles(rows, topics={"x": "topic x"}, default_hints=HINTS, tag_hints={"y": {"claude": "Y"}})


def test_principles(spark):
    a, b, bad = (r.asDict(recursive=True) for r in model(spark).orderBy("source").collect())
    assert (a["summary"], a["directive"], a["body"], a["quick_ref"], a["merge_topics"], a["tags"]) == ("First line", "First line", "First line\nmore", ["First line"], ["solid is law", "topic x", "y"], ["x", "y"])
    assert a["sections"] == [{"id": "overview", "title": "Overview", "summary": "First line", "body": "First line\nmore", "kind": "overview"}] and a["agent_hints"] == HINTS | {"claude": "Y"} and not a["errors"]
    assert (b["ord"], b["quick_ref"], b["merge_topics"], b["agent_hints"], b["body"]) == (1, ["one"], ["t1", "t2"], {"codex": "h"}, "Bd\nx\n\nZ") and [s["kind"] for s in b["sections"]] == ["guidance", "rule"]
    assert [e.split("`")[0].strip() for e in bad["errors"]][:4] == ["each principle must define a non-empty", "principle", "principle", "duplicate section id"] and bad["errors"][-1] == "agent_hints contains unsupported agents: bard"
    assert [r.id for r in principles.ordered(principles.checked(model(spark, ITEMS[:2]))).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="non-empty `id`"):
        principles.checked(model(spark))
    twin = [*ITEMS[:2], ITEMS[1] | {"order": 2, "related": ["zz", "a"]}]
    assert sorted(map(tuple, principles.collection_errors(model(spark, twin)).collect())) == [("duplicate id", "b", ""), ("duplicate order", "2", ""), ("unknown related", "b", "zz")]
    with pytest.raises(ValueError, match="duplicate id `b`"):
        principles.checked(model(spark, twin))


def test_overlay(spark):
    over = frame(spark, [("a", json.dumps({"summary": "New", "prepend": "Pre\nx", "tags": ["z"], "directive": None})), ("b", json.dumps({"quick_ref": ["q1"], "append": " App ", "agent_hints": {"gemini": "G"}}))], "id string, payload string")
    a, b = (r.asDict(recursive=True) for r in principles.overlaid(principles.checked(model(spark, ITEMS[:2])), over, default_hints=HINTS).orderBy("id").collect())
    assert (a["directive"], a["quick_ref"], a["merge_topics"], a["agent_hints"]) == ("", ["Pre", "First line", "New"], ["solid is law", "z"], HINTS) and a["sections"][0]["id"] == "repo-preface" and a["body"] == "Pre\nx\n\nFirst line\nmore"
    assert (b["quick_ref"], b["merge_topics"], b["agent_hints"], b["sections"][-1]["summary"]) == (["q1"], ["t1", "t2"], HINTS | {"gemini": "G"}, "App")
    assert principles.overlaid(principles.checked(model(spark, ITEMS[:2])), over.limit(0)).count() == 2


MARKDOWN = "# **My Title**\n\nIntro text.\n\n---\n\n## Table of Contents\nx\n\n## **1. First One**\n\nSome *body*. More.\n\n### **Why it is**\nBecause. Yes.\n### Steps\n- do\n\n---\n\n## **2. Table of Contents**\nno\n\n## **12. Second**\n### Rule\nSee [x](#3-other-thing) and (#1-first-one).\n"


def test_seed(spark):
    rows = principles.seed(frame(spark, [("m.md", MARKDOWN), ("n.md", "nothing"), ("e.md", "")], "path string, text string"), presets={"first-one": {"directive": "Dir.", "tags": ["x"], "related": ["second"]}}).orderBy("ord").collect()
    first, second = (r.asDict(recursive=True) for r in rows)
    assert (first["doc_title"], first["overview"], first["id"], first["ord"], first["summary"], first["directive"], first["related"]) == ("My Title", "Intro text.\n", "first-one", 1, "Some body.", "Dir.", ["second"])
    assert [(s["id"], s["kind"], s["summary"]) for s in first["sections"]] == [("overview", "overview", "Some body."), ("why-it-is", "rationale", "Because."), ("steps", "workflow", "do")] and first["quick_ref"] == ["Dir.", "Some body.", "Because."]
    assert (second["id"], second["ord"], second["summary"], second["related"]) == ("second", 12, "No summary available.", ["first-one", "other-thing"])


def bundle(spark):
    repo = {"repo": {"name": "n", "overview": "ov", "commands": {"t": ["x", "y"], "u": []}, "paths": {"p": "q"}, "notes": ["n1"]}, "agent_notes": {"codex": "k", "claude": ["cn"]}}
    raw = frame(spark, [("b1", "root", "ETHOS.md: T", "Over\nview", json.dumps(repo))], "bundle string, root_name string, title string, overview string, payload string")
    return raw.withColumn("repo", principles.repo_context(F.col("payload"))).withColumn("profile_notes", F.from_json(F.lit('{"codex": ["pc"]}'), "map<string,array<string>>"))


def test_documents(spark):
    rows = principles.checked(model(spark, ITEMS[:2])).withColumn("bundle", F.lit("b1"))
    got = {r.path: r.content for r in render.documents(bundle(spark), rows, render.Layout(head=("<!-- h -->",), notice="<!-- g -->")).collect()}
    assert len(got) == 11 and all(x.startswith("<!-- h -->\n\n") and x.endswith("\n") and not x.endswith("\n\n") for x in got.values())
    assert got[".agents/ethos/README.md"] == "<!-- h -->\n\n<!-- g -->\n# n ethos reference\n\n## Principles\n- [01. B](b.md) - Do.\n- [02. Solid_is-law](a.md) - First line\n"
    assert got["AGENTS.md"].split("<!-- g -->\n")[1] == (
        "# AGENTS.md\n\n## Purpose\n- Repo: `n`\n- Overview: ov\n\n## Commands\n- `t`: `x; y`\n\n## Key Paths\n- `p`: `q`\n\n## Repo Notes\n- n1\n\n## Non-Negotiable Ethos\n- `01. B`: Do.\n  Quick ref: one\n"
        "- `02. Solid_is-law`: First line [tags: x, y]\n  Quick ref: First line\n\n## Detail Docs\n- Deep reference notes live in `.agents/ethos/README.md` and the linked per-principle docs.\n\n## Codex Notes\n- pc\n- k\n"
    )
    assert got["CLAUDE.md"].split("\n")[6:8] == ["# Claude Code", ""] and got["CLAUDE.md"].endswith("delegation behavior.\n- cn\n") and "# GEMINI.md for n\n" in got["GEMINI.md"]
    assert "\n# T\n\nOver\nview\n\n## Repo Context\n- Repo: `n`\n- Overview: ov\n- n1\n\n## Principles\n\n## 01. B\n\nSum.\n\n### Directive\nDo.\n\n### Quick Ref\n- one\n\n### S\nBd\nx\n\n### T\nZ\n\n\n## 02." in got["ETHOS.md"]
    assert "\n## Related\n- [b](b.md)\n\n## Agent Hints\n- `claude`: Y\n- `codex`: c\n- `gemini`: e\n\n## Repo Context\n" in got[".agents/ethos/a.md"]
    assert got[".agent-context/prompt-addons/codex.md"].endswith("Core principles:\n- B: Do.\n- Solid_is-law: First line\n- B quick ref: one\n- Solid_is-law quick ref: First line\n")
    whole = render.bundled(bundle(spark), rows)
    added = whole.select(*[render.addendum(a).alias(a) for a in principles.AGENTS], render.topics_for("AGENTS.md", F.col("principles"), 5).alias("topics")).first()
    assert added.codex.endswith("### Codex Notes\n- pc\n- k\n") and "### Claude Notes\n- cn\n\n### High-Priority Principles\n- `01. B`: Do.\n" in added.claude and "Gemini Notes" not in added.gemini
    assert added.topics == ["repo commands", "key paths", "repo operating notes", "t1", "t2"]
    pack = json.loads(tools.prompt_pack(bundle(spark), rows, frame(spark, [("root", json.dumps({"style": {"line_length": 88}}))], "root string, config string"), {"c": "p"}).first().content)
    assert pack["project"] == {"name": "n", "context": "ov", "repo_overview": "ov"} and pack["grounding"]["repo_commands"] == [{"name": "t", "examples": ["x", "y"]}] and pack["grounding"]["enforcement_notes"] == ["Shared line length is 88 characters."]
    assert [p["id"] for p in pack["grounding"]["principles"]] == ["b", "a"] and pack["grounding"]["principles"][1]["agent_hint"] == "e" and len(pack["checks"]) == 6


def test_profiles_and_notes(spark):
    got = {r.agent: (r.root_file, r.notes) for r in principles.profiles(frame(spark, [("claude", json.dumps({"root_file": " C.md ", "notes": "n"}))], "agent string, payload string"), {"codex": {"root_file": "A.md", "notes": ["a", "b"]}, "claude": {"notes": ["lost"]}}).collect()}
    assert got == {"codex": ("A.md", ["a", "b"]), "claude": ("C.md", ["n"]), "gemini": ("", [])}
    notes = frame(spark, [('{"codex": "x", "bard": ["y"]}',), ("{}",)], "j string").select(F.from_json("j", "map<string,string>").alias("m"))
    assert [(r.a, r.u) for r in notes.select(principles.agent_notes(F.col("m")).alias("a"), principles.unknown_agents(F.col("m")).alias("u")).collect()] == [({"codex": ["x"], "claude": [], "gemini": []}, ["bard"]), ({}, [])]


def test_settings(spark):
    config = F.lit(json.dumps({"a": {"b": {"c": 1, "l": [1, None, "x"]}, "t": True, "n": None}, "python": {"direct_imports": {"packages": ["p"]}}}))
    assert [one(spark, settings.value_or(config, p, "d")) for p in ("a.b.c", "a.t", "a.n", "a..b", "a.b.c.d", "z", "a.b.l.0")] == ["1", "true", "", "d", "d", "d", "d"]
    assert one(spark, settings.texts(settings.value_at(config, "a.b.l"))) == ["1", "x"] and one(spark, settings.source_paths(config)) == ["p"]
    got = one(spark, settings.decoded(F.lit('{"Max-Retries": "4", "timeout_seconds": 9, "cache.dir": "q", "odd": "x"}'), {"max_retries": "int", "timeoutSeconds": "int", "cache_dir": "string", "odd": "int", "none": "int"}))
    assert tuple(got) == (4, 9, "q", None, None)
    reply = one(spark, settings.reply(F.lit('```json\n{"violations":[{"severity":" critical ","file":"./a.py","line":-3,"message":" m "},{}]}\n```')))
    assert reply.verdict == "PASS" and [tuple(v) for v in reply.violations] == [("CRITICAL", "a.py", "m", "", 0), ("INFO", "", "", "", 0)] and one(spark, settings.reply(F.lit("no"))) is None
    assert [one(spark, settings.tier(F.lit(x))) for x in ("", " FLEX ", "odd", None)] == ["standard", "flex", None, "standard"] and [one(spark, settings.retryable(F.lit(x))) for x in (408, 429, 500, 404)] == [True, True, True, False]
    base = frame(spark, [("m", "flex", 5, 0, -1)], "model string, service_tier string, thinking_budget int, max_retries int, cache_ttl_seconds int")
    assert tuple(settings.with_defaults(base).first()) == ("m", "flex", 5, 3, 604800)
    over = frame(spark, [("x", " o ", None, 0), ("y", " ", "priority", None)], "check string, model string, service_tier string, thinking_budget int")
    checks = frame(spark, [("x",), ("y",), ("z",)], "check string")
    assert sorted(map(tuple, settings.resolved(checks, base, over).collect())) == [("x", "o", "flex", 0), ("y", "m", "priority", 5), ("z", "m", "flex", 5)]
    assert [r.check for r in settings.checks_named(checks).collect()] == ["x", "y", "z"] and settings.checks_named(checks, "y").count() == 1
    with pytest.raises(ValueError):
        settings.checks_named(checks, "q")
    assert one(spark, settings.inline_prompt(F.lit("a {code_content} b {code_content}"), F.lit("X"))) == "a X b {code_content}" and one(spark, settings.inline_prompt(F.lit(" a "), F.lit("X"))) == "a\n\nX" and one(spark, settings.inline_prompt(F.lit(" a "), F.lit(" "))) == " a "
    sent = settings.request_inputs(frame(spark, [("k1", "p1", "c1"), ("k2", "p2", "c2")], "key string, prompt string, cached_prompt string"), frame(spark, [("k2", "cache/2")], "key string, name string"))
    assert sorted(map(tuple, sent.select("key", "prompt", "dependency", "cached_content").collect())) == [("k1", "p1", "", ""), ("k2", "c2", "k2", "cache/2")]
    files = frame(spark, [("b",), ("c",), ("d e",)], "path string")
    assert [tuple(r) for r in settings.first_existing(frame(spark, [("n", 1, "a"), ("n", 3, "c"), ("n", 2, " b "), ("m", 1, "")], "name string, rank int, path string"), files).collect()] == [("n", "b")]
    assert sorted(map(tuple, settings.existing(frame(spark, [(" c ", 1), ("b", 2), ("c", 3), ("x", 4), ("", 5)], "path string, ord int"), files).collect())) == [("b", 2), ("c", 1)]
    change = frame(spark, [("./a", "M", "staged"), ("b", "D", "staged"), ("c", "R100", "staged"), ("d", "M", "branch")], "path string, status string, scope string")
    assert sorted(r.path for r in settings.changes(change, "staged", "ACMR").collect()) == ["a", "c"] and settings.changes(change, "staged").count() == 3 and settings.changes(change, "branch").first().path == "d"


def test_versions(spark):
    leaves = [("r", ".python-version", "value", '"3.12"'), ("r", "pyproject.toml", "project.requires-python", '">=3.13,<4"'), ("r", "mypy.ini", "mypy.x", '"1"'), ("r", "ruff.toml", "target-version", '"py312"'), ("r", "pyrightconfig.json", "pythonVersion", '"3.13"'), ("s", "ruff.toml", "target-version", '"py313"'), ("s", "pyproject.toml", "project.requires-python", '"~=3.11"')]
    found = settings.version_found(frame(spark, leaves, "root string, path string, key string, value string"))
    assert sorted(map(tuple, settings.version_issues(found, F.lit("3.13")).collect())) == [
        ("r", ".python-version", "version", "3.13", "3.12"), ("r", "mypy.ini", "mypy.python_version", "3.13", "<missing>"), ("r", "ruff.toml", "target-version", "py313", "py312"), ("s", "pyproject.toml", "project.requires-python", ">=3.13", "~=3.11"),
    ]


DOCSTRINGS = {'"""a\\"""b"""x': 'a\\"""b', "# c\n\n r'x\\'y' z": "x\\'y", 'b"no"': "", '"""open': None, '"one\n"': None, "": "", "import x": "", "﻿'''q\"'z'''": "q\"'z", "''": "", '""""four"""': '"four', 'u"""é"""': "é"}


def test_module_docs(spark):
    rows = frame(spark, [(k,) for k in DOCSTRINGS], "t string").select("t", modules.docstring(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == DOCSTRINGS
    files = [("pkg/__init__.py", '"""Doc.\n\nSee Also:\n    a.md: x\n    gone.md: y\n    sub/q.md: z\n"""'), ("pkg/a.md", ""), ("pkg/b.MD", ""), ("pkg/sub/conftest.py", "x=1"), (".venv/__init__.py", ""), ("top/__init__.py", "'''d'''"), ("top/README.md", "")]
    assert sorted(map(tuple, modules.module_docs(frame(spark, files, "path string, text string"), index="pkg/ a.md").collect())) == [
        ("banned name", "top/README.md", ""), ("missing docstring", "pkg/sub/conftest.py", ""), ("missing markdown", "pkg/sub/conftest.py", ""), ("not in index", "pkg/b.MD", ""), ("not in index", "top/README.md", ""),
        ("not referenced", "pkg/__init__.py", "pkg/b.MD"), ("not referenced", "top/__init__.py", "top/README.md"), ("reference to nothing", "pkg/__init__.py", "gone.md"), ("reference with folder", "pkg/__init__.py", "sub/q.md"),
    ]
    short = modules.docstring_errors(frame(spark, [("a.py", '"""A. B."""'), ("b.py", "x"), ("c.py", '"""A. B! C?"""'), ("conftest.py", ""), ("d.md", "")], "path string, text string"))
    assert sorted(map(tuple, short.collect())) == [("a.py", "docstring has 2 of 3 sentences"), ("b.py", "missing docstring")]


def test_pyproject(spark):
    config = {"tool": {"ruff": {"lint": {"per-file-ignores": {"a.py": ["E1", "E2"], "b.py": [], "tests/**": ["S"]}}, "exclude": ["build", "gen"], "extend-exclude": "one"}, "mypy": {"exclude": ["x"], "overrides": [{"module": "m", "ignore_errors": True, "disable_error_code": ["c", " "]}, {"ignore_missing_imports": False}, {"modules": ["p", "q"], "ignore_missing_imports": True}, {"ignore_errors": True}]}, "pyright": {"ignore": ["z", "z"]}, "pylint": {"ignore": "i", "main": {"ignore-paths": ["j"]}}}}
    found = modules.pyproject_findings(frame(spark, [("pyproject.toml", json.dumps(config)), ("n.toml", "{}")], "path string, config string"))
    assert [r.text for r in modules.forbidden_ignores(found, missing_imports=("p",)).orderBy("text").collect()] == [
        "mypy exclude: x", "mypy override.disable_error_code: m -> c", "mypy override.ignore_errors: <unknown>", "mypy override.ignore_errors: m", "mypy override.ignore_missing_imports: q", "pylint ignore-paths: j", "pylint ignore: i", "pyright ignore: z",
        "ruff exclude: gen", "ruff extend-exclude: one", "ruff per-file-ignores: a.py -> E1", "ruff per-file-ignores: a.py -> E2", "ruff per-file-ignores: b.py -> <all>",
    ]


def test_manifests_and_reports(spark):
    manifests = [{"version": "1", "symlinks": [{"source": "a", "target": "b"}]}, {"version": 1, "symlinks": [{"source": 1}, "x"], "repositories": {}}, {}, {"version": "2", "symlinks": [], "repositories": [{"name": "n", "url": "u", "branch": 3}]}, {"version": None, "symlinks": None}]
    got = [r.e for r in frame(spark, [(k, json.dumps(x)) for k, x in enumerate(manifests)], "k int, c string").orderBy("k").select(modules.manifest_errors(F.col("c")).alias("e")).collect()]
    assert got == [
        [], ["'version' must be a string", "symlinks[0].source: Expected string", "symlinks[0]: Missing 'target' field", "symlinks[1]: Expected dict, got string", "'repositories' must be a list"],
        ["Missing required 'version' field", "Missing required 'symlinks' section"], ["repositories[0].branch: Expected string"], ["'version' must be a string", "Missing required 'symlinks' section"],
    ]
    report = frame(spark, [('{"a.py":[{"name":"f","lineno":3,"complexity":16},{"name":"g","lineno":9,"complexity":15}]}',)], "report string")
    assert [tuple(r) for r in modules.complex_functions(report).collect()] == [("a.py", "f", 3, 16)]
    assert [tuple(r) for r in modules.hard_to_maintain(frame(spark, [('{"a.py":{"mi":49.9},"b.py":{"mi":50}}',)], "report string")).collect()] == [("a.py", 49.9)]


def test_imports(spark):
    files = frame(spark, [("app/__init__.py", ""), ("app/core/__init__.py", ""), ("app/core/x.py", "from app.core.y import q\nimport app.util.z as zz\nimport os"), ("app/core/y.py", ""), ("app/util/z.py", "import json, yaml as y\nfrom .a import b\nfrom os import path as p, sep\n"), ("main.py", "from app.core.y import a as b, c\nimport app.core.y, app.core\nfrom app.core import x\nfrom app.util.z import k\nimport lib.deep.n as n\n"), ("src/lib/deep/n.py", ""), ("bad.py", "def (")], "path string, text string")
    assert {r.path: r.package for r in imports.packages(files).collect()} == {"app/__init__.py": "app", "app/core/__init__.py": "app.core", "app/core/x.py": "app.core", "app/core/y.py": "app.core", "app/util/z.py": "", "main.py": "", "src/lib/deep/n.py": "", "bad.py": ""}
    rows = imports.import_rows(files)
    assert [tuple(r) for r in imports.direct_imports(rows, files, ("app", "lib"), (".", "src")).orderBy("line").collect()] == [
        ("main.py", 1, "from app.core.y import a as b, c", "from app.core import a as b, c"), ("main.py", 2, "import app.core.y", "import app.core"), ("main.py", 4, "from app.util.z import k", "from app.util import k"), ("main.py", 5, "import lib.deep.n as n", "import lib.deep"),
    ]
    assert imports.direct_imports(rows, files, ("app",), exempt=("main",)).count() == 0
    assert sorted(map(tuple, imports.banned_imports(rows, [("yaml", "safe"), ("os.path", "paths"), ("json", "fastjson")]).collect())) == [("app/util/z.py", 1, "import json", "fastjson"), ("app/util/z.py", 1, "import yaml as y", "safe"), ("app/util/z.py", 3, "from os import path as p", "paths")]
    assert imports.comments("a # one\n'#no' # two\n'''\n# no\n\\''' # three\nx = \"a\\\n# no\" # four\n'open # no\n# five\n\"\"\"never # no") == [(1, "# one"), (2, "# two"), (5, "# three"), (7, "# four"), (9, "# five")]
    marked = frame(spark, [("a.py", "x = 1  # noqa: E1\ny = '# noqa'\ndef (  # type: ignore\n")], "path string, text string")
    assert [(r.line, r.label) for r in imports.suppressed(marked).orderBy("line").collect()] == [(1, "noqa"), (3, "type: ignore")]
    found = frame(spark, [("SQL_INJECTION", 1), ("ODD", 2), ("DEFAULT_SECRET", 3)], "category string, line int")
    assert [(r.category, r.line) for r in imports.by_category(found).orderBy("rank").collect()] == [("DEFAULT_SECRET", 3), ("SQL_INJECTION", 1)]
    assert [one(spark, imports.is_test_path(F.lit(p))) for p in ("a/tests/x.py", "a/b_test.py", "_test.py/b.py", "a/b.py")] == [True, True, False, False]


def test_tool_files(spark):
    config = {"style": {"python_version": "3.12", "line_length": 100}, "python": {"source_paths": ["src"], "stub_paths": ["stubs/"], "test_paths": ["tests", "x/*.py"], "sql_centralization": {"enabled": True, "central_paths": ["db/q.py", "db/sql"], "module_name": "db"}, "util_centralization": {"enabled": True, "banned_modules": [{"module": "json", "alternative": "fast"}, "yaml"]}, "pytest_gate": {"enabled": True, "test_command": ["uv", "run"]}}, "tooling": {"ruff": {"test_per_file_ignores": ["S101"], "extra_per_file_ignores": {"a.py": "E1", "tests/**": ["X"], "n.py": []}, "banned_api": {"b": "no", "a": ""}}, "mypy": {"plugins": [], "strict": False}}}
    got = {r.path: r.content for r in tools.tool_files(frame(spark, [("r", json.dumps(config))], "root string, config string"), head="# h\n\n").collect()}
    assert got["mypy.ini"] == "# h\n\n[mypy]\nstrict = False\nwarn_unused_configs = True\npython_version = 3.12\nfiles = src\nmypy_path = stubs/\nexclude = (^|/)tests/|(^|/).*_test\\.py$|(^|/)test_.*\\.py$|(^|/)\\.venv/\n"
    assert got["ruff.toml"].startswith('# h\n\ntarget-version = "py312"\nline-length = 100\nexclude = [".git", ') and got["ruff.toml"].endswith(
        '\n[lint]\nselect = ["ALL"]\nignore = []\n\n[lint.pylint]\nmax-args = 6\n\n[lint.per-file-ignores]\n"a.py" = ["E1"]\n"db/q.py" = ["S608"]\n"db/sql/**" = ["S608"]\n"tests/**" = ["X"]\n"x/*.py" = ["S101"]\n\n[lint.flake8-tidy-imports.banned-api]\n"b" = { msg = "no" }\n'
    )
    assert got[".yamllint.yml"] == "# h\n\nextends: default\nrules:\n  line-length:\n    max: 100\n" and got[".golangci.yml"] == "# h\n\nlinters:\n  settings:\n    lll:\n      line-length: 100\nversion: '2'\n"
    right = json.loads(got["pyrightconfig.json"])
    assert (right["include"], right["extraPaths"], right["venv"], right["stubPath"], right["typeCheckingMode"]) == (["src"], ["."], ".venv", "stubs/", "strict")
    notes = tools.enforcement_notes(frame(spark, [("r", json.dumps(config))], "root string, config string")).first().notes
    assert notes[1] == "Target Python version is 3.12." and notes[-3:] == ["Utility centralization is enabled; banned direct imports: json -> fast; yaml.", "SQL centralization is enabled; keep raw query strings in module db and paths db/q.py, db/sql.", "Pytest gate command: uv run."]
    text = "# heading " + "h" * 80 + "\n- " + "word " * 20 + "\n    kept " + "k " * 50 + "\n```\n" + "f " * 60 + "\n```\n  in " + "w " * 50
    lines = wrapped(text).split("\n")
    assert lines[0].startswith("# heading") and lines[1].startswith("- word") and lines[2].startswith("  word") and len(lines[1]) <= 70 and any(x.startswith("    kept") and len(x) > 70 for x in lines) and lines[-1].startswith("  w")
    assert [r.text for r in tools.wrapped_texts(frame(spark, [("one " * 40,), ("a\n\nb",), (None,)], "text string")).collect()] == ["one " * 40, "a\n\nb", None]


YAML = """# head
version: 2
metadata:
  title: "A: \\"b\\"\\n"   # why
  overview: |
    One
      two

    three
  folded: >-
    a b
    c

    d
agents: {codex: {root_file: A.md, notes: [x, 'y''s', "z, w"]}, "k 2": null}
principles:
- id: a
  order: 1
  tags: [p, q-r]
  sections:
    - id: s
      body: |-
        text: not a key
        # not a comment

    - {id: t}
-
  id: b
  url: http://x.y/z#frag
  plain: it goes
    on here
  empty:
  flag: yes
  n: -3
  f: 1.5
  - "bad"
"""


def test_yaml():
    from veriloom.sources import yaml_text

    with pytest.raises(ValueError):
        yaml_text.load(YAML)
    got = yaml_text.load(YAML.replace('  - "bad"\n', ""))
    assert got["metadata"] == {"title": 'A: "b"\n', "overview": "One\n  two\n\nthree\n", "folded": "a b c\nd"} and got["version"] == 2
    assert got["agents"] == {"codex": {"root_file": "A.md", "notes": ["x", "y's", "z, w"]}, "k 2": None}
    assert got["principles"] == [
        {"id": "a", "order": 1, "tags": ["p", "q-r"], "sections": [{"id": "s", "body": "text: not a key\n# not a comment"}, {"id": "t"}]},
        {"id": "b", "url": "http://x.y/z#frag", "plain": "it goes on here", "empty": None, "flag": True, "n": -3, "f": 1.5},
    ]
    assert yaml_text.load("") == {} == yaml_text.load("# only\n") and yaml_text.documents("a: 1\n---\n- b\n...\n")[:2] == [{"a": 1}, ["b"]] and yaml_text.load("- - 1\n  - 2\n- x") == [[1, 2], "x"]
    for bad in ("a: [1", "a: 'x", "a: b: c", "\ta: 1", "a: %x 1", "a: 1\n  b: 2", "a: 1\nb"):
        with pytest.raises(ValueError):
            yaml_text.load(bad)
    value = {"t": "two\nlines\n", "u": "x\ny", "long": "word " * 30 + "end", "l": [1, "a: b", ["x", {"k": None}], {}], "m": {"yes": "no", "e": "", "q": "it's", "n": "12", "s": " x", "d": "2024-01-01"}, "b": True}
    assert yaml_text.load(yaml_text.dump(value)) == value


def test_yaml_files(spark):
    from veriloom.sources.config import config_json, config_leaves, syntax_errors

    files = frame(spark, [("a.yml", "x:\n  y: [1, 2]\n"), ("b.yaml", ""), ("c.yml", "- 1"), ("d.toml", "a = 1"), ("e.yml", "a: 1\n---\nb: 2"), ("f.json", "{"), ("g.md", "{")], "path string, text string")
    assert {r.path: r.config or r.error.split(":")[0] for r in config_json(files.where("path not in ('g.md')")).collect()} == {"a.yml": '{"x": {"y": [1, 2]}}', "b.yaml": "{}", "c.yml": "TypeError", "d.toml": '{"a": 1}', "e.yml": "ValueError", "f.json": "JSONDecodeError"}
    assert [r.path for r in syntax_errors(files).collect()] == ["f.json"]
    assert [tuple(r) for r in config_leaves(files.where("path = 'a.yml'")).collect()] == [("a.yml", "x.y", "[1, 2]", None)]


def test_calls(spark, tmp_path):
    import datetime

    from veriloom.operators import calls

    pauses, tries = [], []

    def call(prompt: str) -> str:
        tries.append(prompt)
        if len(tries) < 3:
            raise calls.Refused(503)
        return prompt.upper()

    assert calls.with_retries(call, "a", 3, 0.5, pauses.append) == ("A", None, 3) and pauses == [0.5, 1.0]
    refuse = lambda status: lambda prompt: (_ for _ in ()).throw(calls.Refused(status))
    assert calls.with_retries(refuse(404), "a", 3, 0, pauses.append) == (None, "status 404", 1) and calls.with_retries(refuse(429), "a", 2, 0, pauses.append) == (None, "status 429", 3)

    def answer(prompt: str) -> str:
        if prompt == "bad":
            raise calls_refused(400)
        return prompt[::-1]

    def calls_refused(status):
        from veriloom.operators.calls import Refused

        return Refused(status)

    requests = frame(spark, [("c", 0, "k0", "abc"), ("c", 1, "k1", "bad"), ("d", 0, "k2", "xyz")], "check string, batch int, key string, prompt string")
    cache = frame(spark, [("k2", "kept"), ("k2", "kept")], "key string, text string")
    got = calls.called(requests, answer, cache, at_once=2, retries=1, backoff=0.0)
    assert sorted((r.check, r.batch, r.reply, r.error, r.attempts, r.cached) for r in got.collect()) == [("c", 0, "cba", None, 1, False), ("c", 1, None, "status 400", 1, False), ("d", 0, "kept", None, 0, True)]
    calls.cache_replies(got, f"{tmp_path}/cache")
    calls.cache_replies(got.limit(0), f"{tmp_path}/cache")
    stored = spark.read.parquet(f"{tmp_path}/cache")
    assert [tuple(r) for r in calls.valid_replies(stored, F.current_timestamp()).collect()] == [("k0", "cba")] and calls.valid_replies(stored, F.current_timestamp() + F.expr("interval 8 days")).count() == 0
    day = lambda n: datetime.datetime(2024, 1, n)
    calls.cache_handles(frame(spark, [("k", "old", day(2)), ("k", "new", day(5)), ("q", "gone", day(1))], "key string, name string, expires_at timestamp"), f"{tmp_path}/handles")
    assert [tuple(r) for r in calls.valid_handles(spark.read.parquet(f"{tmp_path}/handles"), F.lit(day(2))).collect()] == [("k", "new")]
    assert one(spark, calls.command(["t", "-p=x"], F.array(F.lit("f")), config=F.lit("c"), flags=("-p",))) == ["t", "-p=x", "f"]
    empty = calls.coverage(frame(spark, [("documented", "_x")], "kind string, detail string")).first()
    assert (empty.total, empty.percent, empty.enough) == (0, 100.0, True)


def test_commands(spark):
    import sys

    from veriloom.operators import calls, checks

    rows = frame(spark, [("good", [sys.executable, "-c", "print('= 3 passed, 1 skipped in 1s')"]), ("bad", [sys.executable, "-c", "import sys; sys.stderr.write('é'); sys.exit(3)"]), ("slow", [sys.executable, "-c", "import time; time.sleep(60)"]), ("none", ["/no/such/program"])], "name string, words array<string>")
    got = {r.name: r for r in calls.run_commands(rows, timeout=4, at_once=2).withColumn("counts", checks.pytest_counts(F.col("output"))).collect()}
    assert got["good"].exit_code == 0 and tuple(got["good"].counts) == (3, 1, 0, 0, 0) and (got["bad"].exit_code, got["bad"].output) == (3, "é")
    assert got["slow"].exit_code is None and got["slow"].error == "not ended after 4 s" and 3900 < got["slow"].millis < 20_000 and "No such file" in got["none"].error
    done = frame(spark, [("b", 1, "", None, 5), ("a", 0, "", None, 7), ("c", None, "", "x", 1)], calls.RESULT)
    assert tuple(calls.outcome(done).first()) == (1, 2, 13, "PASS a (7ms)\nFAIL b (5ms)\nFAIL c (1ms)")


def test_files_on_disk(spark, tmp_path):
    from veriloom.sources.config import text_files

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, data in (("a.txt", "é\n".encode()), ("sub/b.txt", b"x\0y"), ("sub/c.txt", b"\xff")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.size) for r in text_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": ("é\n", 3), "b.txt": (None, 3), "c.txt": (None, 1)}
    rows = frame(spark, [("x.md", "one"), ("y/z.md", "two\n")], "path string, content string")
    for _ in range(2):
        render.write_documents(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("path", "content").collect())) == [("x.md", "one"), ("y/z.md", "two\n")]
    assert [one(spark, render.merges_existing(F.lit(p))) for p in ("AGENTS.md", "x/AGENTS.md")] == [True, False]


def test_yaml_anchors():
    from veriloom.sources.yaml_text import load

    text = "a: &a\n  n: 1\n  l: &l [x, &y y, *y]\nb:\n  <<: [{n: 2, m: 3}, *a]\n  all: *l\nc:\n- &i\n  k: 1\n- <<: *i\n  j: 2\nd: {<<: *i, k: 5}\ns: !!str 010\nf: !!float 3\nt: &t plain\n  text\nu: *t\nv: &v |\n  x\nw: *v\nq:\n  '<<': 1\n"
    assert load(text) == {
        "a": {"n": 1, "l": ["x", "y", "y"]}, "b": {"n": 2, "l": ["x", "y", "y"], "m": 3, "all": ["x", "y", "y"]}, "c": [{"k": 1}, {"k": 1, "j": 2}], "d": {"k": 5},
        "s": "010", "f": 3.0, "t": "plain text", "u": "plain text", "v": "x\n", "w": "x\n", "q": {"<<": 1},
    }
    laughs = "a0: &a0 [x,x,x,x,x,x,x,x,x,x]\n" + "".join(f"a{i}: &a{i} [{','.join([f'*a{i - 1}'] * 10)}]\n" for i in range(1, 9))
    for bad in ("a: *b", "a: &a [*a]", "a: !own 1", "a: !!int x", "<<: 1", laughs):
        with pytest.raises(ValueError):
            load(bad)
