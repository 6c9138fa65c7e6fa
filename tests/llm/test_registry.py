import re

import __spark_entry__ as entry

from tidemark.llm import registry


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_operators_use_no_python():
    import ast
    import inspect

    from tidemark.llm import graph, quality_rules, scratch, url_filters

    for module in (graph, quality_rules, scratch, url_filters):
        for node in ast.walk(ast.parse(inspect.getsource(module))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.split(".")[0] in ("pandas", "pyarrow", "numpy") for n in names)
            if isinstance(node, ast.Attribute):
                assert node.attr not in ("udf", "pandas_udf", "rdd", "mapInPandas", "applyInPandas", "collect", "toPandas", "crossJoin", "localCheckpoint")
