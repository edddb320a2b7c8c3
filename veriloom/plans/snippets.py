"""Python snippets with the facts that stand in them, by hand: (text, ((line, kind, detail), ...)). {w} is an identifier.

Sources are put together from them, so each is whole statements and begins and ends at the left margin.
"""

SNIPPETS = (
    ("from __future__ import annotations", ((1, "type_checking", "__future__"),)),
    ("from typing import TYPE_CHECKING as T, Any\nif T:\n    import {w}", ((1, "type_checking", "typing"),)),
    ("import typing\nif typing.TYPE_CHECKING:\n    import {w}\nelse:\n    {w} = 1", ((2, "type_checking", "if"),)),
    ("if not TYPE_CHECKING:\n    x = 1\nelif TYPE_CHECKING:\n    y = 1", ((3, "type_checking", "if"),)),
    ("try:\n    import {w}\nexcept ImportError:\n    HAS_{w} = False", ((1, "conditional_import", "{w}"), (1, "conditional_import", "HAS_{w}"))),
    ("try:\n    from ..{w} import a, b\n    import c.d as e, f\nexcept (ValueError, ModuleNotFoundError) as e:\n    HAS_X: bool = False\n    HAS_Y, z = 1, 2", ((1, "conditional_import", "..{w}"), (1, "conditional_import", "c.d"), (1, "conditional_import", "f"), (1, "conditional_import", "HAS_X"))),
    ("try:\n    import {w}\nexcept ValueError:\n    HAS_{w} = False", ()),
    ("try:\n    if x:\n        import {w}\nexcept:\n    HAS_A = HAS_B = 0", ((1, "conditional_import", "HAS_A"),)),
    ("def {w}():\n    try:\n        pass\n    except ImportError:\n        raise\n    except OSError:\n        HAS_{w} = None", ((2, "conditional_import", "HAS_{w}"),)),
    ("try:\n    run({w})\nexcept ValueError:\n    \"doc\"\n    pass", ((3, "silent_handler", "ValueError"),)),
    ("for {w} in y:\n    try:\n        run()\n    except (A, b.C):\n        continue\n    except D:\n        return_ = 1\n    except:\n        ...", ((4, "silent_handler", "(A, b.C)"), (8, "silent_handler", "bare"))),
    ("def {w}():\n    try:\n        run()\n    except A:\n        return None\n    except B:\n        return\n    except C:\n        return 0\n    except E:\n        'a'\n        'b'", ((4, "silent_handler", "A"), (6, "silent_handler", "B"))),
    ("try:\n    run()\nexcept A:\n    pass\n    {w}()\nfinally:\n    pass", ()),
    ("{w}: int | None = 1", ((1, "optional", "{w}"),)),
    ("class C_{w}:\n    value: dict[str, list[None | int]]\n    other: Optional[int]\n    self.x: int | str = {w}", ((2, "optional", "value"),)),
    ("async def {w}(a: bytes | None, /, b: int, *c: str | None, d: (None | A) = 1, **e: 'x') -> str | None:\n    return a | None", ((1, "optional", "a"), (1, "optional", "*c"), (1, "optional", "d"), (1, "optional", "return"))),
    ("def __exit__(a: A | None) -> None:\n    return None", ()),
    ("def {w}(\n    a: int,\n    b: B[C | D | None] = None,\n) -> None:\n    f = lambda x: x | None", ((3, "optional", "b"),)),
    ("logger.info('{w}')\nlogger.info('x', request_id=1)\nlogger.info('x %s', y)\nlogger.exception('x')", ((1, "unstructured_log", "info"), (3, "unstructured_log", "info"))),
    ("self._log.error('{w}', key=1, *z)\nself.log.debug('x', key=1, **more)\na.b.warning('x')", ((1, "unstructured_log", "error"), (2, "unstructured_log", "debug"))),
    ("log.critical('x', exc_info=True)\nlog.warning(\n    'x',\n    extra={w},\n)\nlog.error()", ((1, "unstructured_log", "critical"), (6, "unstructured_log", "error"))),
    ("q_{w} = 'SELECT id FROM users WHERE id = $1'", ((1, "sql", "SELECT FROM"),)),
    ("raise ValueError(reason='SELECT * FROM docs', other=\"delete  from {w}\")", ((1, "sql", "DELETE FROM"),)),
    ("run('select a', b'CREATE TABLE {w} (a)', f'update {w} set a = {b} where c')", ((1, "sql", "CREATE TABLE"), (1, "sql", "UPDATE SET"))),
    ("def {w}():\n    'SELECT a FROM b in a docstring'\n    x = 1\n    'SELECT a FROM b behind an assignment'\n    y()\n    'SELECT a FROM b standing alone'", ((6, "sql", "SELECT FROM"),)),
    ("sql_{w} = f'  insert into t values ({v})'\nsql: str = f'selected {w}'\nplain = f'drop table some_table'", ((1, "SQL_INJECTION", "INSERT"), (1, "sql", "INSERT INTO"), (3, "sql", "DROP TABLE"))),
    ("a = os.getenv('K', 'sk-{w}')\nb = os.environ.get('K', default='my PASSWORD')\nc = os.environ.get('K', 'x', default='plain')\nd = getenv('K', 'sk-1')", ((1, "DEFAULT_SECRET", "os.getenv"), (2, "DEFAULT_SECRET", "os.environ.get"))),
    ("a = x.environ.get('K', f'token_{w}')\nb = os.getenv('K', b'secret_1')\nc = os.getenv('K', 'secret_1', default='none')", ((1, "DEFAULT_SECRET", "x.environ.get"),)),
    ("os.environ['{w}'] = '1'\nx.os.environ['A'] = '1'\nb = os.environ['C'] = 2\nprint(os.environ['D'])", ((1, "TEST_ENV_BYPASS", "os.environ"), (3, "TEST_ENV_BYPASS", "os.environ"))),
    ("@pytest.mark.skipif({w})\n@pytest.mark.slow\n@a.mark.skip\ndef f():\n    return 1", ((1, "decorator", "pytest.mark.skipif({w})"), (1, "banned_marker", "pytest.mark.skipif"), (2, "decorator", "pytest.mark.slow"), (3, "decorator", "a.mark.skip"), (3, "banned_marker", "pytest.mark.skip"))),
    ("x = 1  # noqa {w}\ny = '# none'\n# last", ((1, "comment", "# noqa {w}"), (3, "comment", "# last"))),
    ("@skip\nclass {w}(B):\n    @staticmethod\n    async def g():  # c\n        yield", ((1, "decorator", "skip"), (3, "decorator", "staticmethod"), (4, "comment", "# c"))),
)
