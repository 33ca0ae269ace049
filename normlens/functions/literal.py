"""Arrow-batched parser for Python-literal rule lists.

Rule cells hold text such as ``[{'short_name': 'be nice',
'violation_reason': None}]``.  JSON readers reject ``None`` and single
quotes, so this is the one place a vectorised Python UDF is used.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("short_name", T.StringType()),
    T.StructField("violation_reason", T.StringType()),
]))
# error: NULL, "missing" (no cell text), "not_a_literal" or "not_a_list"; bad: places of elements that are no dict
PARSED_SCHEMA = T.StructType([
    T.StructField("rules", RULE_SCHEMA),
    T.StructField("error", T.StringType()),
    T.StructField("bad", T.ArrayType(T.IntegerType())),
])


def _text(value):
    return None if value is None else str(value)


def _one(text):
    if text is None or not text.strip():
        return [], "missing", []
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return [], "not_a_literal", []
    if isinstance(value, dict):
        value = [value]
    if not isinstance(value, (list, tuple)):
        return [], "not_a_list", []
    rules = [{"short_name": _text(x.get("short_name")), "violation_reason": _text(x.get("violation_reason"))}
             for x in value if isinstance(x, dict)]
    return rules, None, [i for i, x in enumerate(value) if not isinstance(x, dict)]


@F.pandas_udf(PARSED_SCHEMA)
def parse_rule_literal(texts: pd.Series) -> pd.DataFrame:
    """text -> struct<rules, error, bad>: the rules that can be read and what cannot."""
    rows = [_one(t) for t in texts]
    return pd.DataFrame(rows, columns=["rules", "error", "bad"])
