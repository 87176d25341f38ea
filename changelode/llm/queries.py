"""The queries of the text problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelode.llm import bpe, leak, packing, pii, sentences
from changelode.plans.durable import durable
from changelode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Places of personal data in discussions and edit histories."""
    discussion, edits = table(spark, d, "discussion"), table(spark, d, "body_edits")
    body = discussion.select(F.lit("discussion.body").alias("field"), F.col("discussion_id").alias("record_id"), F.col("body").alias("text"))
    author = discussion.select(F.lit("discussion.author").alias("field"), F.col("discussion_id").alias("record_id"), F.col("author").alias("text"))
    editor = edits.select(F.lit("body_edits.editor").alias("field"), F.col("edit_id").alias("record_id"), F.col("editor").alias("text"))
    texts = body.unionByName(author).unionByName(editor).where("record_id is not null and text is not null and text != ''")
    return pii.find_places(texts, pii.lexicon(table(spark, d, "contributors"))).select("field", "record_id", "kind", "start_pos")


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Discussions with typed placeholders in copies of body and author."""
    lex = pii.lexicon(table(spark, d, "contributors"))
    out = pii.mask_column(table(spark, d, "discussion").select("discussion_id", "author", "body"), "body", lex, "body_masked")
    return pii.mask_column(out, "author", lex, "author_masked").select("discussion_id", "author_masked", "body_masked").distinct()


def p1_masked_editors(spark: SparkSession, d: str) -> DataFrame:
    """Edits with typed placeholders in a copy of the editor."""
    out = pii.mask_column(table(spark, d, "body_edits").select("edit_id", "editor"), "editor", pii.lexicon(table(spark, d, "contributors")), "editor_masked")
    return out.select("edit_id", "editor_masked").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the held-out items they disclose."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_keys")).select("doc_id", "item_id")


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """The report by item: how many documents disclose it, and how much at most."""
    found = leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_keys"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


def p5_passages(spark: SparkSession, d: str) -> DataFrame:
    """Where each disclosed passage stands: characters of the document, first word of the item, words matched."""
    found = leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_keys"))
    return found.select("doc_id", "item_id", "start_pos", "end_pos", "item_word", "matched_words")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are left when all that disclose an item are removed."""
    documents = table(spark, d, "documents")
    found = durable(leak.leaks(documents, table(spark, d, "eval_keys")))
    return leak.without_leaks(documents, found).select("doc_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, d, "documents"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece, in every window."""
    return packing.pack(durable(bpe.count_tokens(table(spark, d, "documents"))), table(spark, d, "pack_windows"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and filled share by window."""
    return packing.fill_report(p7_packing(spark, d), table(spark, d, "pack_windows"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings of the sentence units of every document."""
    return sentences.sentence_starts(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_masked, p1_masked_editors, p5_found, p5_items, p5_passages, p5_clean, p6_ids, p7_packing, p7_fill, p8_found)}


def oracle_sql() -> dict[str, str]:
    """None of these is plain SQL; their tests compare with brute force, round trips and a public library."""
    return {}
