"""Python sources as a table of syntax nodes. (SRC-15)

Parsing is all that runs in Python. A tree is interval-encoded: nodes are numbered in pre-order, and `last` is the last
number below a node, so that a node lies below another if its number lies in the other's interval. What is asked of the
syntax is then a plan over this table: filters, joins and sums by a parent's number, and joins on intervals.

| column | what |
| --- | --- |
| file, path | a number for each row of the input, and its path |
| node, last, parent, depth | pre-order number, last one below, the parent's number, levels below the module |
| field, idx, prev | the parent's field that holds the node, its place in it if that is a list, and the kind of the element before |
| kind | the class of the node; also Comment (value: its text), Line (a line that a node or comment begins on), Error |
| name, base | identifier, attribute, argument, module with its dots, operator; for an attribute the name that it is taken from |
| dotted | for names, attributes and calls: the dotted chain, as far as it has names |
| vtype | type of a literal (str, fstr, bytes, none, ellipsis, other), or of the one that an expression or return consists of |
| value | a literal's text, a space for each interpolation; an alias |
| text | the source of decorators, called functions and targets; for a handler that of its type, null for a bare one |
| line | of the node |
| p_..., pp_kind | of the parent, and the kind of its parent |
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import ready, spread, staged

NODES = "file long, path string, node int, last int, parent int, depth int, field string, idx int, prev string, kind string, name string, base string, dotted string, vtype string, value string, text string, line int, p_parent int, p_kind string, p_name string, p_field string, p_idx int, p_prev string, p_line int, pp_kind string"
#: Rows of a page of the table.
PAGE = 1000
_SHOWN = ("decorator_list", "func", "target", "targets")


def _plain(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def _dotted(n: ast.AST) -> str | None:
    names: list[str] = []
    while isinstance(n, (ast.Call, ast.Attribute)):
        if isinstance(n, ast.Attribute):
            names.append(n.attr)
        n = n.func if isinstance(n, ast.Call) else n.value
    if isinstance(n, ast.Name):
        names.append(n.id)
    return ".".join(reversed(names)) or None


def _literal(n: ast.AST) -> tuple[str | None, str | None]:
    if isinstance(n, ast.JoinedStr):
        return "fstr", "".join(str(x.value) if isinstance(x, ast.Constant) else " " for x in n.values)
    if not isinstance(n, ast.Constant):
        return None, None
    v = n.value
    if isinstance(v, str):
        return "str", v
    return ("bytes", v.decode("latin-1")) if isinstance(v, bytes) else ("none" if v is None else "ellipsis" if v is Ellipsis else "other", str(v))


def _name(n: ast.AST) -> str | None:
    if isinstance(n, ast.ImportFrom):
        return "." * n.level + (n.module or "")
    if isinstance(n, (ast.BinOp, ast.UnaryOp, ast.BoolOp)):
        return type(n.op).__name__
    return next((x for x in (getattr(n, a, None) for a in _named(type(n))) if isinstance(x, str)), None)


@cache
def _named(kind: type) -> list[str]:
    return [a for a in ("id", "attr", "name", "arg") if a in kind._fields]


def _extra(kind: str, line: int, value: str | None = None, name: str | None = None) -> tuple:
    """A row that is no node of the tree."""
    return (*[None] * 7, kind, name, None, None, None, value, None, line, *[None] * 8)


@cache
def _real(kind: type) -> bool:
    """Contexts and operators are no nodes of their own."""
    return issubclass(kind, ast.AST) and (bool(kind._fields) or issubclass(kind, (ast.Pass, ast.Continue, ast.Break)))


def _source(n: ast.AST) -> str:
    """The source of a node; ast.unparse is slow, and most of those shown are dotted names."""
    names, at = [], n
    while type(at) is ast.Attribute:
        names.append(at.attr)
        at = at.value
    return ".".join([at.id, *reversed(names)]) if type(at) is ast.Name else ast.unparse(n)


def _comments(source: str, lines: list[str], quoted: bool) -> list[tuple]:
    """Comments of a source. quoted: a literal of it holds a #; where none does, each line's first # begins a comment."""
    if not quoted and "\r" not in source:
        return [_extra("Comment", k, _plain(line[line.index("#") :])) for k, line in enumerate(lines, 1) if "#" in line]
    try:
        return [_extra("Comment", t.start[0], _plain(t.string)) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (tokenize.TokenError, IndentationError):
        return []


def tree_rows(source: str) -> list[tuple]:
    """NODES of one source, but file and path."""
    source = source.removeprefix("\ufeff")
    lines = source.split("\n")
    try:
        out: list[list] = []
        stack: list[tuple] = [(ast.parse(source), None, 0, None, None, None)]
        while stack:  # pre-order, without recursion
            n, parent, depth, field, idx, prev = stack.pop()
            if n is None:  # all below node `parent` is numbered
                out[parent][1] = len(out) - 1
                continue
            at, up = len(out), out[parent] if parent is not None else None
            kind, text, base, dotted = type(n).__name__, None, None, None
            vtype, value = _literal(n)
            if kind == "Attribute":
                base = n.value.id if isinstance(n.value, ast.Name) else n.value.attr if isinstance(n.value, ast.Attribute) else ""
            elif kind in ("Expr", "Return"):
                vtype = _literal(n.value)[0] if n.value else "none"
            elif kind == "alias":
                value = n.asname
            elif kind == "ExceptHandler":
                text = _source(n.type) if n.type else None
            if kind in ("Name", "Attribute", "Call"):
                dotted = _dotted(n)
            if field in _SHOWN:
                text = _source(n)
            about = (up[2], up[7], up[8], up[4], up[5], up[6], up[14], up[16]) if up else (None,) * 8
            out.append([at, at, parent, depth, field, idx, prev, kind, _name(n), base, dotted, vtype, value, text, getattr(n, "lineno", up[14] if up else 0), *about])
            below = []
            for name in n._fields:
                child = getattr(n, name, None)
                if isinstance(child, list):
                    some, last = [c for c in child if _real(type(c))], None
                    for k, c in enumerate(some):
                        below.append((c, at, depth + 1, name, k, last))
                        last = type(c).__name__
                elif _real(type(child)):
                    below.append((child, at, depth + 1, name, None, None))
            if below:
                stack.append((None, at, 0, None, None, None))
                stack += reversed(below)
    except (SyntaxError, ValueError, RecursionError) as e:
        at = getattr(e, "lineno", None) or 0
        return [_extra("Error", at, None, type(e).__name__), _extra("Line", at, _plain(lines[at - 1].strip() if 0 < at <= len(lines) else "<unknown>"))]
    if not source.isascii() or "\\" in source:  # else no literal can hold a lone surrogate
        out = [[_plain(x) if isinstance(x, str) else x for x in r] for r in out]
    rows = [tuple(r) for r in out]
    if "#" in source:
        rows += _comments(source, lines, any(r[12] and "#" in r[12] for r in rows if r[7] in ("Constant", "JoinedStr")))
    return rows + [_extra("Line", at, _plain(lines[at - 1].strip() if 0 < at <= len(lines) else "<unknown>")) for at in sorted({r[14] for r in rows})]


def nodes(files: DataFrame) -> DataFrame:
    """NODES of files (path, text), as a table in the shared folder.

    A source that doesn't parse has an Error (name: the exception) and its Line; a null text is an empty source. Files of one
    path are files of their own. Lone surrogates of literals become question marks.
    """
    ready(files.sparkSession)
    fields = [c.split() for c in NODES.split(", ")]
    schema = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for name, kind in fields])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[9], r[18] or "", r[6] or ""))  # nodes of a kind share pages, so that others are skipped
        columns = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(file, path, *r) for r in tree_rows(text or "")]
                file += 1
                if len(rows) > 20_000:
                    yield packed(rows)
                    rows = []
            yield packed(rows)

    return staged(spread(files.select("path", "text")).mapInArrow(run, NODES), "nodes", **{"parquet.page.row.count.limit": PAGE})[0]


def within(rows: DataFrame, outer: DataFrame, *columns: str) -> DataFrame:
    """rows that lie in an interval of outer, with columns of it, once for each such interval: a join on the file and the
    interval, which meets only nodes of one file."""
    o = outer.select(F.col("file").alias("_file"), F.col("node").alias("_from"), F.col("last").alias("_to"), *[F.col(c).alias(f"outer_{c}") for c in columns])
    return rows.join(o, (F.col("file") == F.col("_file")) & F.col("node").between(F.col("_from"), F.col("_to"))).drop("_file", "_from", "_to")
