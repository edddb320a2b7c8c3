"""Facts of Python sources, as plans over the table of syntax nodes. Rows are (path, line, kind, detail, snippet).

Each detector is a function of the node table to (file, path, line, kind, detail): filters, joins with parents and children,
joins on intervals. Sources that don't parse give one row of kind parse_error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.operators.checks import SQL_PATTERNS, first_pattern
from veriloom.operators.imports import is_test_path
from veriloom.operators.syntax import nodes, within

# Fixed values of the reference's settings. (AST-03, AST-04, AST-10)
BANNED_MARKERS = ("skip", "skipif")
MIGRATIONS = ("alembic", "migrations")
ERROR_KEYWORDS = ("suggestion", "reason", "message", "match", "extra")
LEAST = 15
SECRETS = ("sk-", "pk-", "api_", "key_", "token_", "secret_", "password", "passwd", "credential")
SQL_KEYWORDS = "^(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|TRUNCATE|EXECUTE|EXEC)(?![0-9A-Za-z])"
# Fixed values of the reference's settings. (AST-05, AST-06, AST-09)
LOG_METHODS = ("debug", "info", "warning", "error", "critical")
LOGGERS = ("logger", "_logger", "log", "_log")
LOG_KEYWORDS = ("exc_info", "stack_info", "stacklevel")
IMPORT_ERRORS = ("ImportError", "ModuleNotFoundError")
FLAG = "HAS_"
EXEMPT_METHODS = ("__exit__", "__aexit__")

FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
DEFINITIONS = (*FUNCTIONS, "ClassDef")
BLOCKS = ("body", "orelse", "finalbody")


def _found(rows: DataFrame, kind: Column | str, detail: Column, line: Column | str = "line") -> DataFrame:
    return rows.select("file", "path", (F.col(line) if isinstance(line, str) else line).alias("line"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), detail.alias("detail"))


def _of(t: DataFrame, *kinds: str) -> DataFrame:
    return t.where(F.col("kind").isin(*kinds))


def _at(rows: DataFrame, node: str, other: DataFrame, how: str = "inner") -> DataFrame:
    """rows whose (file, node) is the (_f, _n) of other."""
    return rows.join(other, (F.col("file") == F.col("_f")) & (F.col(node) == F.col("_n")), how).drop("_f", "_n")


def _keyed(rows: DataFrame, node: str, **columns: str) -> DataFrame:
    return rows.select(F.col("file").alias("_f"), F.col(node).alias("_n"), *[F.col(c).alias(a) for a, c in columns.items()])


def import_statements(t: DataFrame) -> DataFrame:
    """(AST-01)"""
    by = ["file", "path", F.col("parent"), F.col("p_kind"), F.col("p_name"), F.col("p_line").alias("at")]
    rows = _of(t, "alias").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "name", "value"))).alias("names"))
    names = F.array_join(F.transform("names", lambda k: F.concat(k["name"], F.coalesce(F.concat(F.lit(" as "), k["value"]), F.lit("")))), ", ")
    plain = F.col("p_kind") == "Import"
    return _found(rows, F.when(plain, "import").otherwise("import_from"), F.when(plain, names).otherwise(F.concat("p_name", F.lit(": "), names)), "at")


def type_checking(t: DataFrame) -> DataFrame:
    """Annotations from the future, TYPE_CHECKING and conditions on it. (AST-07)"""
    of = _of(t, "alias").where("p_kind = 'ImportFrom' and ((p_name = '__future__' and name = 'annotations') or (p_name = 'typing' and name = 'TYPE_CHECKING'))")
    tests = t.where("field = 'test' and p_kind = 'If' and ((kind = 'Name' and name = 'TYPE_CHECKING') or (kind = 'Attribute' and dotted = 'typing.TYPE_CHECKING'))")
    return _found(of, "type_checking", F.col("p_name"), "p_line").unionByName(_found(tests, "type_checking", F.lit("if"), "p_line"))


def conditional_imports(t: DataFrame) -> DataFrame:
    """Modules imported in a try whose handlers catch a failed import, and flags that they set. (AST-06)"""
    handlers = _of(t, "ExceptHandler").where("p_kind = 'Try'")
    caught = t.where(F.col("name").isin(*IMPORT_ERRORS) & (F.col("kind") == "Name")).where("(field = 'type' and p_kind = 'ExceptHandler') or (field = 'elts' and p_kind = 'Tuple' and p_field = 'type')")
    named = _keyed(caught.withColumn("handler", F.when(F.col("field") == "type", F.col("parent")).otherwise(F.col("p_parent"))), "handler")
    catching = _keyed(handlers.where("text is null").unionByName(_at(handlers, "node", named)), "parent", at="p_line").distinct()
    plain = _at(_of(t, "alias").where("p_kind = 'Import' and p_field = 'body'"), "p_parent", catching)
    taken = _at(_of(t, "ImportFrom").where("field = 'body' and p_kind = 'Try'"), "parent", catching)
    stores = t.where((F.col("kind") == "Name") & F.col("name").startswith(FLAG)).where("p_field = 'body' and ((field = 'targets' and idx = 0 and p_kind = 'Assign') or (field = 'target' and p_kind = 'AnnAssign'))")
    flags = _at(_at(stores, "p_parent", _keyed(handlers, "node", tried="parent")), "tried", catching)
    return reduce(DataFrame.unionByName, [_found(rows, "conditional_import", F.col("name"), "at") for rows in (plain, taken, flags)])


def silent_handlers(t: DataFrame) -> DataFrame:
    """Handlers whose one statement, but for strings, does nothing. (AST-08)"""
    body = t.where("field = 'body' and p_kind = 'ExceptHandler'")
    other = ~((F.col("kind") == "Expr") & F.col("vtype").eqNullSafe("str"))
    nothing = F.coalesce(F.expr("kind in ('Pass', 'Continue') or (kind = 'Expr' and vtype = 'ellipsis') or (kind = 'Return' and vtype = 'none')"), F.lit(False))
    rest = body.groupBy(F.col("file").alias("_f"), F.col("parent").alias("_n")).agg(F.count_if(other).alias("rest"), F.count_if(nothing).alias("nothing"))
    rows = _at(_of(t, "ExceptHandler").where("p_kind = 'Try'"), "node", rest.where("rest = 1 and nothing = 1"))
    return _found(rows, "silent_handler", F.coalesce("text", F.lit("bare")))


def optional_annotations(t: DataFrame) -> DataFrame:
    """Annotations with a union with None anywhere in them: an interval join of such sides with annotations. (AST-09)"""
    sides = t.where("kind = 'Constant' and vtype = 'none' and field in ('left', 'right') and p_kind = 'BinOp' and p_name = 'BitOr'").select("file", "node")
    annotations = t.where("field in ('annotation', 'returns')")
    hit = _keyed(within(sides, annotations, "node").select("file", "outer_node").distinct(), "outer_node")
    rows = _at(annotations, "node", hit)
    exempt = F.col("p_name").isin(*EXEMPT_METHODS)
    targets = _keyed(t.where("field = 'target' and p_kind = 'AnnAssign'"), "parent", target="text")
    values = _found(_at(rows.where("p_kind = 'AnnAssign' and field = 'annotation'"), "parent", targets), "optional", F.col("target"), "p_line")
    returns = _found(rows.where(F.col("p_kind").isin(*FUNCTIONS) & ~exempt), "optional", F.lit("return"))
    lists = _keyed(_of(t, "arguments").where(F.col("p_kind").isin(*FUNCTIONS) & ~exempt), "node")
    mark = F.when(F.col("p_field") == "vararg", "*").when(F.col("p_field") == "kwarg", "**").otherwise("")
    args = _found(_at(rows.where("p_kind = 'arg'"), "p_parent", lists), "optional", F.concat(mark, F.col("p_name")))
    return values.unionByName(returns).unionByName(args)


def log_calls(t: DataFrame) -> DataFrame:
    """Calls that log without a keyword of their own, or with more than a message. (AST-05)"""
    called = t.where("field = 'func' and p_kind = 'Call' and kind = 'Attribute'").where(F.col("name").isin(*LOG_METHODS) & F.col("base").isin(*LOGGERS))
    given = t.where("p_kind = 'Call' and (field = 'args' or kind = 'keyword')").groupBy(F.col("file").alias("_f"), F.col("parent").alias("_n"))
    own = (F.col("kind") == "keyword") & F.col("name").isNotNull() & ~F.col("name").isin(*LOG_KEYWORDS)
    counts = given.agg(F.count_if(own).alias("own"), F.count_if((F.col("field") == "args") | F.col("name").isNull()).alias("plain"))
    rows = _at(called, "parent", counts, "left").where("coalesce(own, 0) = 0 or plain > 1")
    return _found(rows, "unstructured_log", F.col("name"), "p_line")


def strings(t: DataFrame) -> DataFrame:
    """String literals but for docstrings."""
    doc = (F.col("p_kind") == "Expr") & (F.col("p_field") == "body") & (F.col("p_idx") == 0) & F.col("pp_kind").isin("Module", *DEFINITIONS)
    return _found(t.where("kind = 'Constant' and vtype = 'str'").where(~F.coalesce(doc, F.lit(False))), "string", F.col("value"))


def sql_literals(t: DataFrame) -> DataFrame:
    """Whole string literals that hold SQL, but for parts of f-strings, standalone strings at a block's start or behind an
    assignment, values of error keywords, and migrations. (AST-04)"""
    flat = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    rows = _of(t, "Constant", "JoinedStr").where(F.col("vtype").isin("str", "fstr", "bytes") & (F.col("field") != "format_spec"))
    for m in MIGRATIONS:
        rows = rows.where(~F.contains(F.coalesce("path", F.lit("")), F.lit(m)))
    loose = (F.col("p_kind") == "Expr") & F.col("p_field").isin(*BLOCKS) & F.col("p_idx").isNotNull() & (F.col("p_prev").isNull() | F.col("p_prev").isin("Assign", "AnnAssign"))
    exempt = (F.col("p_kind") == "JoinedStr") | ((F.col("p_kind") == "keyword") & F.col("p_name").isin(*ERROR_KEYWORDS)) | loose
    rows = rows.where(~F.coalesce(exempt, F.lit(False)) & (F.octet_length(flat) >= LEAST))
    return _found(rows.withColumn("pattern", first_pattern(flat, SQL_PATTERNS)).where("pattern is not null"), "sql", F.col("pattern"))


def default_secrets(t: DataFrame) -> DataFrame:
    """Secrets as defaults of environment variables. (AST-10)"""
    secret = reduce(lambda a, b: a | b, [F.contains(F.lower("value"), F.lit(s)) for s in SECRETS])
    rows = _of(t, "Constant", "JoinedStr").where(F.col("vtype").isin("str", "fstr") & secret)
    reads = t.where("field = 'func' and p_kind = 'Call' and kind = 'Attribute' and (dotted = 'os.getenv' or (name = 'get' and base = 'environ'))")
    reads = _keyed(reads, "parent", read="text")
    named = _at(rows.where("p_kind = 'keyword' and p_name = 'default' and field = 'value'"), "p_parent", reads)
    second = _at(rows.where("p_kind = 'Call' and field = 'args' and idx = 1"), "parent", reads)
    second = _at(second, "parent", _keyed(_of(t, "keyword").where("name = 'default' and p_kind = 'Call'"), "parent"), "left_anti")
    return _found(named, "DEFAULT_SECRET", F.col("read")).unionByName(_found(second, "DEFAULT_SECRET", F.col("read")))


def sql_in_f_strings(t: DataFrame) -> DataFrame:
    """Assigned f-strings with values that begin with SQL. (AST-10)"""
    word = F.regexp_extract(F.trim(F.upper(F.regexp_replace("value", r"(?U)^\s+", ""))), SQL_KEYWORDS, 1)
    rows = t.where("kind = 'JoinedStr' and field = 'value' and p_kind in ('Assign', 'AnnAssign')").where(word != "")
    return _found(_at(rows, "node", _keyed(_of(t, "FormattedValue").where("p_kind = 'JoinedStr'"), "parent"), "left_semi"), "SQL_INJECTION", word)


def changed_environments(t: DataFrame) -> DataFrame:
    """Assignments to os.environ in test files. (AST-10)"""
    rows = t.where("kind = 'Attribute' and field = 'value' and dotted = 'os.environ' and p_kind = 'Subscript' and p_field in ('target', 'targets') and pp_kind in ('Assign', 'AnnAssign')")
    return _found(rows.where(is_test_path(F.coalesce("path", F.lit("")))), "TEST_ENV_BYPASS", F.lit("os.environ"), "p_line")


def decorators(t: DataFrame) -> DataFrame:
    """Decorators, and those of banned markers. (AST-03)"""
    rows = t.where("field = 'decorator_list'")
    mark = F.regexp_extract("dotted", rf"(?:^|\.)mark\.({'|'.join(BANNED_MARKERS)})$", 1)
    return _found(rows, "decorator", F.col("text")).unionByName(_found(rows.where(mark != ""), "banned_marker", F.concat(F.lit("pytest.mark."), mark)))


def documented(t: DataFrame) -> DataFrame:
    """Functions and classes with and without a docstring."""
    docs = t.where("kind = 'Constant' and vtype = 'str' and p_kind = 'Expr' and p_field = 'body' and p_idx = 0").where(F.trim(F.regexp_replace("value", r"(?U)\s+", " ")) != "")
    rows = _at(_of(t, *DEFINITIONS), "node", _keyed(docs.withColumn("has", F.lit(True)), "p_parent", has="has"), "left")
    return _found(rows, F.when(F.col("has"), "documented").otherwise("undocumented"), F.col("name"))


def comments(t: DataFrame) -> DataFrame:
    """(STM-04)"""
    return _found(_of(t, "Comment"), "comment", F.col("value"))


def errors(t: DataFrame) -> DataFrame:
    return _found(_of(t, "Error"), "parse_error", F.col("name"))


DETECTORS = (import_statements, type_checking, conditional_imports, silent_handlers, optional_annotations, log_calls, strings, sql_literals, default_secrets, sql_in_f_strings, changed_environments, decorators, documented, comments, errors)


def python_facts(files: DataFrame, detectors: tuple = DETECTORS) -> DataFrame:
    """(path, line, kind, detail, snippet) of files (path, text) by the detectors given; snippet is the line, trimmed. Null
    texts have no facts. (AST-01, AST-03 to AST-10, STM-04)"""
    t = nodes(files)
    found = reduce(DataFrame.unionByName, [d(t) for d in detectors])
    lines = _of(t, "Line").select(F.col("file").alias("_f"), F.col("line").alias("_l"), F.col("value").alias("snippet"))
    return found.join(lines, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l"))).select("path", "line", "kind", "detail", "snippet")
