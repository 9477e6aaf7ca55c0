"""Reading Python source by its grammar: the one place that needs Python workers.

Submitted code is parsed, never run. Whole Arrow batches go to the worker.
"""

from __future__ import annotations

import ast
import sys
import warnings

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# Ship these functions inside the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARSED_SPEC = T.StructType([
    T.StructField("valid", T.BooleanType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("docstring", T.StringType()),
])


def _parse(source: str | None) -> ast.AST | None:
    if source is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.BooleanType())
def syntax_valid(code: pd.Series) -> pd.Series:
    """True when the text is valid Python; null text is not."""
    return code.map(lambda c: _parse(c) is not None).astype(bool)


@F.pandas_udf(PARSED_SPEC)
def parsed_spec(spec: pd.Series) -> pd.DataFrame:
    """Validity, first function and first non-empty docstring, breadth first as the grammar tree is walked."""

    def read(source: str | None) -> tuple[bool, str | None, str]:
        tree = _parse(source)
        if tree is None:
            return False, None, ""
        functions = [node for node in ast.walk(tree) if isinstance(node, ast.FunctionDef)]
        docs = (ast.get_docstring(node) for node in functions)
        return True, functions[0].name if functions else None, next((d for d in docs if d), "")

    rows = [read(source) for source in spec]
    return pd.DataFrame(rows, columns=["valid", "function_name", "docstring"])
