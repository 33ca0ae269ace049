"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm import (byte_bpe, chunk_dedup, decontaminate, embedding_dedup, html_extract, line_dedup,
                           minhash_dedup, periodic_runs, prefix_trie, quality, suffix_dedup, token_files, warc)
from normlens.llm.common import materialize, read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op4_warc", sql="""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files, committed by manifest, and read back."""
    folder = scratch_path(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), folder, "page_id", "url", "html")
    recs = materialize(warc.read_warc(spark, folder, with_payload=False), "warc-records")
    return warc.resolve_revisits(recs).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by nearest-URL differencing."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by merge replay, then decoded; digests of both."""
    out = byte_bpe.round_trip_digests(
        read_table(spark, sf_dir, "documents"), "doc_id", "text",
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents covered by repeated 200-byte strings, removed."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text").drop("kept")


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: 4-word shingles, Jaccard of 0.8 or more."""
    docs = read_table(spark, sf_dir, "documents")
    return minhash_dedup.near_duplicates(docs, "doc_id", "text", words=4).withColumnRenamed("id", "doc_id")


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of documents, found by content-defined chunks; later occurrences removed."""
    return chunk_dedup.remove_repeated_chunks(read_table(spark, sf_dir, "documents"), "doc_id", "text").drop("kept")


@query("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of cosine 0.9 or more to each other: link counts and components."""
    rows = read_table(spark, sf_dir, "embeddings")
    return embedding_dedup.near_vectors(rows, "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines (exact, from 20 characters also fuzzy): counts and digest of what is kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.cleaned(docs, "doc_id", "text", least_chars=1)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("__removed").alias("n_removed"), F.length(kept).cast("long").alias("n_chars"),
                      F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: its own evidence with its source's and language's."""
    return quality.quality_scores(
        read_table(spark, sf_dir, "documents"), "doc_id", "text", "source", "lang",
        read_table(spark, sf_dir, "labels"), "doc_id", "quality").withColumnRenamed("id", "doc_id")


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it covers by 0.6 or more."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark")
    hits = decontaminate.contaminated(decontaminate.matches(docs, "doc_id", "text", bench, "item_id", "text"))
    return docs.select("doc_id").join(hits, "doc_id", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "items",
        F.coalesce("max_coverage", F.lit(0.0)).alias("max_coverage"), F.col("n_items").isNotNull().alias("contaminated"))


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids written as packed files in id order, and read back from them."""
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), folder, "doc_id", "text",
                                  public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of every tenth document, by its id's checksum, made periodic from some word on.

    h = crc32(decimal doc_id), g = h // 10: where h % 10 = 0, word i >= a becomes
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    w = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    w = w.withColumn("n", F.when(F.size("w") > 0, F.size("w")))
    w = w.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    made = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), F.flatten(F.array_repeat(cycle, times))),
                   F.lit(1), F.col("n"))
    return w.select("doc_id", F.coalesce(F.array_join(made, " "), "text").alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document (some made periodic first), the greatest run, and digests."""
    docs = planted_periods(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"),
                                                              (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = periodic_runs.periodic_runs(docs, "doc_id", "text").select("*", best.alias("b"))
    length, period = F.col("b.l"), -F.col("b.p")
    return out.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.expr("1000 * b.l div -b.p").cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conv_ids): conversation c gets the first h turns of conversation c - c % 100 for its own first h.

    h = crc32(decimal c) % 6; a shorter first conversation gives all it has, an
    absent one nothing.  Turns are (conv_id, depth, sym, chars).
    """
    ranked = materialize(prefix_trie.ranked_turns(conversations, "conv_id", "turn", "role", "text"), "turns")
    h, base = F.crc32(F.col("conv_id").cast("string")) % 6, F.col("conv_id") - F.col("conv_id") % 100
    convs = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
    convs = materialize(convs.select("conv_id", h.alias("h"), base.alias("base")), "convs")
    heads = ranked.where("conv_id % 100 = 0 AND pos <= 5").withColumnRenamed("conv_id", "base")
    taken = convs.where("h > 0").join(heads, "base").where("pos <= h")
    borrowed = taken.select("conv_id", F.col("pos").alias("depth"), "sym", "chars")
    lens = heads.groupBy("base").agg(F.max("pos").alias("len"))
    kept = convs.join(lens, "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("len", F.lit(0))).alias("n_borrowed"))
    own = ranked.join(kept, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_borrowed")).alias("depth"), "sym", "chars")
    return borrowed.unionByName(own), convs.select("conv_id")


@query("op11_prefix_trie")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt with shared openings: one row per node."""
    turns, conv_ids = rebuilt_turns(read_table(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie.prefix_trie(turns, conv_ids)
    return prefix_trie.with_end_digests(nodes, ends).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", "ends_sha256")
