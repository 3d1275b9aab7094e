"""The queries that this subpackage registers, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.llm import (
    chat_format, collocations, decontamination, html_text, lm_scoring, mixing, ngram_join, period_runs, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter,
)
from hornbeam.llm.common import stash, table


def _remainder(doc_id, by: int):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def op1_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(_remainder(F.col("doc_id"), 3) != 1)
    model = quality_classifier.train(docs.select("doc_id", "text"), learn)
    scored = quality_classifier.classify(docs, model)
    held = F.coalesce(_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.shuffled(mixed).withColumn("mix_rate", F.round("mix_rate", 9))


def op4_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # only what the dimensions read; texts stay where they are
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    narrow = docs.select("doc_id", "source", "lang", sharding.text_size().alias("size"), crc.alias("text_crc32"), sharding.text_key().alias("text_key"))
    sharded = sharding.kd_shards(narrow, n_shards=40, size=F.col("size"), group=F.col("text_key"))
    slots = sharding.with_slots(stash(sharded))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.default_labelled(spark))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.score(docs, _remainder(F.col("doc_id"), 5) != 1)
    held = F.coalesce(_remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    turns = chat_format.canonical_turns(chat_format.as_records(rows.unionByName(extra)), "conv_id", "record")
    back = chat_format.read_back(chat_format.format_chats(turns))
    told_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told_turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_tree_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.default_model(), keep=["page_id", "url"])


def op12_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _folded(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)``: of one text in ten, told by its id, all words from a place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"), (h % 10 == 0).alias("chosen"))
    docs = docs.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.pmod("g", F.when(F.col("n") > 0, F.col("n"))).cast("int"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    cycles = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    folded = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), cycles), F.lit(1), F.col("n")), " ")
    return docs.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), folded).otherwise(F.col("text")).alias("text"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs.periodic_runs(_folded(table(spark, sf_dir, "documents")), keep=["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best_run")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP10_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(text) + 14 + length(regexp_replace(role || text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g')))::bigint as formatted_chars
from t group by conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_poisson_mixing": mixing.oracle(), "op10_chat_format": OP10_SQL, "op12_pivot_collocations": collocations.SQL}
