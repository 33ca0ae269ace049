"""Request building: fixed-size batches, JSON payloads, context and messages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlens.constants import BATCH_SIZE
from normlens.operators.matrix import paired

# Default message templates.  Placeholders in braces are filled per row.
DEFAULT_SYSTEM_TEMPLATE = (
    "You review comments posted in {display_name}.\n"
    "About the community:\n{description}\n\n"
    "Community rules:\n{rules}\n\n"
    "Labelled examples (JSON):\n{shots}\n\n"
    "For every comment decide whether it violates the norm given with it. "
    "Answer with one JSON array of objects with the keys comment_id, label "
    "(violation or non_violation) and evidence (a short quote, empty for non_violation)."
)
DEFAULT_USER_TEMPLATE = "Comments to judge (JSON):\n{payload}"

# Default chain: the steps are user turns after one system message.
DEFAULT_CHAIN = (
    ("system", DEFAULT_SYSTEM_TEMPLATE),
    ("user", "Say in one sentence what each norm asks for.\n{payload}"),
    ("user", "For every comment, quote the words that touch its norm, or none.\n{payload}"),
    ("user", "Now answer with the JSON array only, one object per comment.\n{payload}"),
)

_JSON_OPTS = {"ignoreNullFields": "false"}


def batches(tests: DataFrame, run_cols: Sequence[str], id_col: str = "comment_id",
            body_col: str = "body", norm_col: str = "norm",
            batch_size: int = BATCH_SIZE, num_tests: int | None = None) -> DataFrame:
    """Split each run's tests (ids 0..n-1) into batches of ``batch_size``.

    All rows are sent, or only ids below ``num_tests`` where the caller sets it.
    Output ``run_cols, batch_no, items array<struct<comment_id, norm, comment>>``
    ordered by id; a group holds at most ``batch_size`` rows.
    """
    t = tests if num_tests is None else tests.filter(F.col(id_col) < num_tests)
    t = t.withColumn("batch_no", F.floor(F.col(id_col) / batch_size).cast("int"))
    item = F.struct(F.col(id_col).cast("bigint").alias("comment_id"),
                    F.col(norm_col).alias("norm"), F.col(body_col).alias("comment"))
    g = t.groupBy(*run_cols, "batch_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return g.withColumn("n_items", F.size("items"))


def payload(items: str | Column = "items") -> Column:
    """Batch as JSON text; NULL norms are kept as ``null`` and non-ASCII as is."""
    c = F.col(items) if isinstance(items, str) else items
    return F.to_json(c, _JSON_OPTS)


def request_context(meta: DataFrame, rules: DataFrame, shots: DataFrame,
                    community_col: str = "subreddit_id", name_col: str = "name") -> DataFrame:
    """Per community: display name, description, rule lines and few-shot examples.

    Rules and shots are aggregated per community (bounded by the rule count
    and the shot draw) and joined on the community key.
    """
    r = (rules.groupBy(community_col)
         .agg(F.array_sort(F.collect_list(F.struct("rule_no", "rule_text"))).alias("_r"))
         .select(community_col, F.transform("_r", lambda s: s["rule_text"]).alias("rules")))
    sh = (shots.groupBy(community_col)
          .agg(F.array_sort(F.collect_list(F.struct(
              F.col("comment_id").cast("bigint").alias("comment_id"), "body", "norm",
              "true_label"))).alias("shots")))
    m = meta.select(F.col(name_col).alias(community_col), "display_name_prefixed", "public_description")
    return (m.join(r, community_col, "left").join(sh, community_col, "left")
            .withColumn("rules", F.coalesce("rules", F.array().cast("array<string>"))))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``template`` with ``{name}`` placeholders replaced by column values."""
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(values[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def template_values() -> dict[str, Column]:
    """What templates may name: the prompt context and the batch."""
    return {"display_name": F.col("display_name_prefixed"), "description": F.col("public_description"),
            "rules": F.array_join(F.col("rules"), "\n"), "shots": F.to_json(F.col("shots"), _JSON_OPTS),
            "payload": payload("items")}


def message_chain(requests: DataFrame, templates: Sequence[tuple[str, str]],
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """Add ``messages array<struct<role, content>>`` made of (role, template) pairs in order.

    Templates name any of :func:`template_values` and ``extra`` in braces, so a
    chain (a system message and several user steps) repeats the batch where it
    likes.
    """
    values = {**template_values(), **(extra or {})}
    parts = [F.struct(F.lit(role).alias("role"), fill_template(text, values).alias("content")) for role, text in templates]
    return requests.withColumn("messages", F.array(*parts))


def request_messages(requests: DataFrame, system_template: str = DEFAULT_SYSTEM_TEMPLATE,
                     user_template: str = DEFAULT_USER_TEMPLATE) -> DataFrame:
    """Add ``messages`` (system + one user turn) to request rows.

    Expects context columns (display name, description, rules, shots) and
    ``items`` on each row.
    """
    return message_chain(requests, [("system", system_template), ("user", user_template)])


def cell_requests(batches_df: DataFrame, context: DataFrame,
                  prompt_communities: DataFrame | None = None,
                  eval_col: str = "eval_community", community_col: str = "subreddit_id") -> DataFrame:
    """Requests for every (prompt community, eval batch) cell.

    Each request needs one eval batch and one prompt context.  The context (a
    few shots and the rules per community) is the smaller side and is copied
    once per block; batches are dealt over blocks by number and community, so a
    hot community spreads over all tasks.  ``prompt_communities`` (a frame with
    ``community_col``) limits the prompt axis.
    """
    ctx = context
    if prompt_communities is not None:
        ctx = ctx.join(prompt_communities.select(community_col).distinct(), community_col, "left_semi")
    ctx = ctx.withColumnRenamed(community_col, "prompt_community")
    b = batches_df.withColumnRenamed(community_col, eval_col)
    b = b.withColumn("_cell", F.struct(eval_col, "batch_no"))
    return paired(ctx, b, "_cell").drop("_cell")
