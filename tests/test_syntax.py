"""The node table and the detectors, each over sources of its own."""

import ast

import pytest

from veriloom.operators import python_facts, syntax
from veriloom.plans.snippets import SNIPPETS

ODD = ["", None, "x = '\ud800'".encode("utf-8", "surrogatepass").decode("utf-8", "replace"), "x = '\\ud800 SELECT a FROM b'", "\ufeffx = 1", "match x:\n    case 1:\n        'a'\n        pass", "f'{a:{b}}'", "def (", "x = 1\x00", "(" * 300]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"tests/{k}.py", text.replace("{w}", "name")) for k, (text, _) in enumerate(SNIPPETS)] + [(f"odd/{k}", text) for k, text in enumerate(ODD)] + [("tests/0.py", SNIPPETS[0][0])]
    return syntax.nodes(spark.createDataFrame(rows, "path string, text string"))


def test_intervals(table):
    trees: dict[int, list] = {}
    for r in table.where("node is not null").collect():
        trees.setdefault(r.file, []).append(r)
    assert len(trees) == len(SNIPPETS) + len(ODD) + 1 - 3  # three don't parse
    for rows in trees.values():
        at = {r.node: r for r in rows}
        assert sorted(at) == list(range(len(rows))) and at[0].kind == "Module" and at[0].last == len(rows) - 1
        for r in rows[:]:
            up = at.get(r.parent)
            if up:
                assert up.node < r.node <= r.last <= up.last and r.depth == up.depth + 1
                assert (r.p_kind, r.p_name, r.p_field, r.p_idx, r.p_prev, r.p_parent, r.p_line) == (up.kind, up.name, up.field, up.idx, up.prev, up.parent, up.line)
                assert r.pp_kind == (at[up.parent].kind if up.parent is not None else None)


def test_nodes_are_those_of_the_parser(table):
    for k, (text, _) in enumerate(SNIPPETS[1:], 1):
        want = sorted(type(n).__name__ for n in ast.walk(ast.parse(text.replace("{w}", "name"))) if n._fields or isinstance(n, (ast.Pass, ast.Continue, ast.Break)))
        assert sorted(r.kind for r in table.where(f"path = 'tests/{k}.py' and node is not null").select("kind").collect()) == want


def test_each_detector(table):
    of_checks = [d for d in python_facts.DETECTORS if d not in (python_facts.import_statements, python_facts.strings, python_facts.documented, python_facts.errors)]
    got: dict[str, list] = {}
    for d in of_checks:
        for r in d(table).collect():
            got.setdefault(r.path, []).append((r.line, r.kind, r.detail))
    for k, (_, found) in enumerate(SNIPPETS[1:], 1):
        assert sorted(got.get(f"tests/{k}.py", [])) == sorted((line, kind, detail.replace("{w}", "name")) for line, kind, detail in found), k
    assert got["tests/0.py"] == [(1, "type_checking", "__future__")] * 2  # two files of one path
    assert [x for k in range(len(ODD)) for x in got.get(f"odd/{k}", [])] == [(1, "sql", "SELECT FROM")]
    assert sorted(r.path for r in python_facts.errors(table).collect()) == ["odd/7", "odd/8", "odd/9"]


def test_facts_with_their_lines(spark):
    source = "import a as b, c\n\n\ndef f():\n    '''doc'''\n    return 'text'\n"
    got = [tuple(r) for r in python_facts.python_facts(spark.createDataFrame([("p", source), ("p", None)], "path string, text string")).collect()]
    assert sorted(got) == [("p", 1, "import", "a as b, c", "import a as b, c"), ("p", 4, "documented", "f", "def f():"), ("p", 6, "string", "text", "return 'text'")]
    assert python_facts.python_facts(spark.createDataFrame([], "path string, text string")).count() == 0
