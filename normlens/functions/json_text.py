"""Recovering JSON items from free-text model replies, as expressions.

Rules (in order):
  1. empty / blank / NULL text -> no items
  2. candidate = first ``[`` .. last ``]``; else first ``{`` .. last ``}``;
     else no candidate (no items)
  3. strict parse: the candidate must be exactly one JSON value (no
     trailing text, no single quotes, no raw control characters); a single
     object counts as a one-element list
  4. accepted only when the element count equals the batch size and every
     element is an object
  5. otherwise salvage: every non-greedy ``{...}`` fragment parsed alone,
     fragments that are not strict JSON skipped; count not truncated

Every element is typed alone, from a VARIANT, so a broken one does not touch its
neighbours.  An id is a JSON number of integral value (``4``, ``4.0``, ``4e0``) or
``true``/``false`` (1 and 0, which is what a Python lookup by number accepts);
strings, fractions and missing ids give a NULL id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("evidence", T.StringType()),
])
ITEMS_SCHEMA = T.ArrayType(ITEM_SCHEMA)
_STRICT = {"allowSingleQuotes": "false"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(content) -> Column:
    """Text without leading/trailing (Unicode) whitespace."""
    return F.regexp_replace(_c(content), r"(?U)^\s+|\s+$", "")


def is_blank(content) -> Column:
    """NULL, empty or whitespace-only text."""
    return F.coalesce(_c(content).rlike(r"(?U)^\s*$"), F.lit(True))


def json_candidate(content) -> Column:
    """Most plausible JSON block, or NULL when the text holds none."""
    text = stripped(content)
    arr = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    obj = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(arr != "", arr).when(obj != "", obj)


# Sentinel element appended inside the wrapper (written with JSON escapes).
_SENTINEL_JSON = '"\\u0000end\\u0000"'
_SENTINEL = "\x00end\x00"


def is_strict_json(text) -> Column:
    """True when ``text`` is exactly one strict JSON value.

    The parser stops after the first complete root value and ignores what
    follows, so the text is wrapped as ``[<text>, <sentinel>]``: trailing
    values become extra elements, trailing junk is a syntax error, and a
    stray closing bracket that ends the wrapper early leaves the sentinel
    out.  Single quotes and raw control characters are rejected.
    """
    wrapped = F.concat(F.lit("["), _c(text), F.lit("," + _SENTINEL_JSON + "]"))
    arr = F.from_json(wrapped, T.ArrayType(T.StringType()), _STRICT)
    return F.coalesce((F.size(arr) == 2) & (F.element_at(arr, 2) == F.lit(_SENTINEL)), F.lit(False))


def parsed_count(cand) -> Column:
    """Element count of a strictly valid candidate (object counts as 1)."""
    cand = _c(cand)
    return F.when(is_strict_json(cand),
                  F.when(cand.startswith("["), F.json_array_length(cand)).otherwise(F.lit(1)))


_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"
# text form of an element that VARIANT refuses (repeated keys): the last value of a key counts
_TEXT_ITEM = T.StructType([T.StructField(f.name, T.StringType()) for f in ITEM_SCHEMA])


def variant_id(value: Column) -> Column:
    """The id held in ``$.comment_id`` of a VARIANT, or NULL."""
    whole = F.try_variant_get(value, "$.comment_id", "bigint")
    exact = F.try_variant_get(value, "$.comment_id", "decimal(38,9)")
    kind = F.schema_of_variant(F.try_variant_get(value, "$.comment_id", "variant"))
    return F.when(kind.rlike(_NUMBER) & (exact == whole), whole)


def _variant_item(value: Column) -> Column:
    return F.struct(variant_id(value).alias("comment_id"),
                    F.try_variant_get(value, "$.label", "string").alias("label"),
                    F.try_variant_get(value, "$.evidence", "string").alias("evidence"))


def _text_item(text: Column) -> Column:
    item = F.from_json(text, _TEXT_ITEM, _STRICT)
    number = F.regexp_extract(item["comment_id"], r"^(-?\d+)(\.0*)?$", 1)
    return F.struct(number.try_cast("bigint").alias("comment_id"), item["label"].alias("label"),
                    item["evidence"].alias("evidence"))


def _items_of_texts(texts: Column) -> Column:
    """Items of strict JSON texts, each parsed once."""
    both = F.transform(texts, lambda x: F.struct(x.alias("t"), F.try_parse_json(x).alias("v")))
    return F.transform(both, lambda b: F.when(b["v"].isNotNull(), _variant_item(b["v"])).otherwise(_text_item(b["t"])))


def _elements(cand: Column) -> tuple[Column, Column]:
    """(array of VARIANT, array of JSON texts) of a candidate's elements; the first is NULL where VARIANT refuses it."""
    array = cand.startswith("[")
    values = F.try_variant_get(F.when(array, F.try_parse_json(cand)), "$", "array<variant>")
    texts = F.when(array, F.from_json(cand, T.ArrayType(T.StringType()), _STRICT)).otherwise(F.array(cand))
    return values, texts


def all_objects(cand) -> Column:
    """Whether every element of a strictly valid candidate is a JSON object."""
    values, texts = _elements(_c(cand))
    return F.coalesce(F.forall(values, lambda v: F.schema_of_variant(v).startswith("OBJECT")),
                      F.forall(texts, lambda t: F.coalesce(t.startswith("{"), F.lit(False))), F.lit(False))


def parse_items(cand) -> Column:
    """Items of a strictly valid candidate, one per element: array<struct<comment_id,label,evidence>>."""
    values, texts = _elements(_c(cand))
    return F.coalesce(F.transform(values, _variant_item), _items_of_texts(texts))


def salvage_items(cand) -> Column:
    """Every non-greedy ``{...}`` fragment that parses on its own."""
    frags = F.regexp_extract_all(F.coalesce(_c(cand), F.lit("")), F.lit(r"(?s)\{.*?\}"), 0)
    return _items_of_texts(F.filter(frags, lambda x: is_strict_json(x)))
