"""Recovering predictions from raw model replies (one row per batch).

Everything is native expressions (regex, ``from_json``), evaluated per row
inside whole-stage code generation; no Python UDF.  Outcomes:

* ``empty``        blank reply: no items, nothing logged
* ``no_json``      no ``[...]`` or ``{...}`` block: no items, nothing logged
* ``success``      strict JSON with exactly ``batch_size`` elements, all with an id
* ``lost_ids``     the same, but some element has no usable id: all elements
                   are kept, those without id as rows with a NULL id
* ``wrong_size``   strict JSON with another element count, or with elements
                   that are no objects -> salvage
* ``decode_error`` not strict JSON -> salvage
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlens.constants import (AUDIT_DECODE_ERROR, AUDIT_LINE_PATTERN, AUDIT_REPAIRS, AUDIT_SUCCESS,
                                AUDIT_WRONG_SIZE, BATCH_SIZE)
from normlens.operators.requests import fill_template
from normlens.functions.json_text import (ITEMS_SCHEMA, all_objects, is_blank, json_candidate, parse_items,
                                          parsed_count, salvage_items)


LOGGED = ("success", "lost_ids", "wrong_size", "decode_error")


def parse_outputs(df: DataFrame, content_col: str = "content",
                  batch_size: int = BATCH_SIZE) -> DataFrame:
    """Add ``candidate, n_parsed, items, n_items, n_null_id, outcome, n_expected`` to each reply row."""
    blank = is_blank(F.col(content_col))
    out = df.withColumn("candidate", F.when(~blank, json_candidate(F.col(content_col))))
    cand = F.col("candidate")
    # NULL where the candidate is not strict JSON
    out = out.withColumn("n_parsed", F.when(cand.isNotNull(), parsed_count(cand)).cast("bigint"))
    fits = F.when(F.col("n_parsed") == batch_size, all_objects(cand)).otherwise(F.lit(False))
    out = out.withColumn("_fits", fits)
    fits = F.col("_fits")
    out = out.withColumn("items", F.when(cand.isNull(), F.array().cast(ITEMS_SCHEMA))
                         .when(fits, parse_items(cand)).otherwise(salvage_items(cand)))
    out = out.withColumn("n_items", F.size("items")).withColumn(
        "n_null_id", F.size(F.filter("items", lambda i: i["comment_id"].isNull())))
    outcome = (F.when(blank, F.lit("empty"))
               .when(cand.isNull(), F.lit("no_json"))
               .when(F.col("n_parsed").isNull(), F.lit("decode_error"))
               .when(~fits, F.lit("wrong_size"))
               .when(F.col("n_null_id") > 0, F.lit("lost_ids"))
               .otherwise(F.lit("success")))
    return out.withColumn("outcome", outcome).withColumn("n_expected", F.lit(batch_size)).drop("_fits")


def fragment_count(cand_col: str = "candidate"):
    """Number of non-greedy ``{...}`` fragments in the candidate."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(cand_col), F.lit("")),
                                       F.lit(r"(?s)\{.*?\}"), 0))


def predictions(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per recovered item: ``keys..., item_no, comment_id, label, evidence``."""
    # the outer form keeps Spark from pushing size(items) > 0 below the parser and running it twice
    ex = parsed.select(*keys, F.posexplode_outer("items").alias("item_no", "_it")).where("item_no IS NOT NULL")
    return ex.select(*keys, "item_no", F.col("_it.comment_id").alias("comment_id"),
                     F.col("_it.label").alias("pred_label"), F.col("_it.evidence").alias("evidence"))


def audit(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parse-audit rows: outcome, parsed size, expected size, recovered items and those without id."""
    return parsed.select(*keys, "outcome", "n_parsed", "n_expected", "n_items", "n_null_id",
                         F.col("outcome").isin(*LOGGED).alias("logged"))


def audit_text(parsed: DataFrame) -> F.Column:
    """The log lines one batch adds (empty for unlogged outcomes); sizes decide, so lost ids log as success."""
    n, b = F.col("n_parsed").cast("string"), F.col("n_expected").cast("string")
    o = F.col("outcome")
    wrong = F.concat(*[fill_template(AUDIT_WRONG_SIZE, {"attempt": F.lit(str(i)), "parsed": n, "expected": b,
                                                       "repairs": F.lit(AUDIT_REPAIRS[i])}) for i in (0, 1)])
    decode = F.concat(*[fill_template(AUDIT_DECODE_ERROR, {"attempt": F.lit(str(i)),
                                                        "message": F.lit("not a single JSON value")}) for i in (0, 1)])
    return (F.when(o.isin("success", "lost_ids"), F.lit(AUDIT_SUCCESS))
            .when(o == "wrong_size", wrong)
            .when(o == "decode_error", decode)
            .otherwise(F.lit("")))


def audit_logs(parsed: DataFrame, run_cols: Sequence[str], order_col: str = "batch_no") -> DataFrame:
    """One log text per run, batches in order (a run holds few batches)."""
    per = parsed.select(*run_cols, order_col, audit_text(parsed).alias("_t"))
    g = per.groupBy(*run_cols).agg(F.array_sort(F.collect_list(F.struct(order_col, "_t"))).alias("_l"))
    return g.select(*run_cols, F.array_join(F.transform("_l", lambda s: s["_t"]), "").alias("log"))


_ENTRY = AUDIT_LINE_PATTERN


def scan_audit_text(logs: DataFrame, text_col: str = "value",
                    keys: Sequence[str] = ("path",)) -> DataFrame:
    """Parse audit-log text into one row per attempt line.

    Works whether or not entries are separated by newlines.  Output:
    ``keys..., line_no, attempt, outcome, n_parsed, n_expected``.
    """
    lines = logs.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(_ENTRY), 0))
                        .alias("line_no", "_l"))
    kind = F.regexp_extract("_l", _ENTRY, 2)
    outcome = (F.when(kind == "SUCCESS", F.lit("success"))
               .when(kind.startswith("parsed"), F.lit("wrong_size"))
               .when(kind == "JSON decode error", F.lit("decode_error"))
               .otherwise(F.lit("unexpected_error")))
    num = lambda i: F.when(kind.startswith("parsed"),
                           F.regexp_extract("_l", _ENTRY, i).cast("bigint"))
    return lines.select(*keys, F.col("line_no").cast("bigint").alias("line_no"),
                        F.regexp_extract("_l", _ENTRY, 1).cast("bigint").alias("attempt"),
                        outcome.alias("outcome"), num(3).alias("n_parsed"), num(4).alias("n_expected"))


def audit_summary(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: logged batches (attempt-0 lines), accepted, wrong size, decode errors, accept rate."""
    first = lines.filter(F.col("attempt") == 0)
    g = first.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_logged"),
        F.count_if(F.col("outcome") == "success").alias("n_accepted"),
        F.count_if(F.col("outcome") == "wrong_size").alias("n_wrong_size"),
        F.count_if(F.col("outcome") == "decode_error").alias("n_decode_error"))
    return g.withColumn("accept_rate", F.col("n_accepted") / F.col("n_logged"))
