"""The registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import ann_forest, decontam, language_id, lexical_search, line_dedup, mixing, ngram_lm, periodic, quality_gbt, secret_scan, simhash_trie, token_counts, toxicity
from lodestrata.llm.words import batches_of_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_gbt.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_trie.hex_print(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_decisions(_table(spark, sf_dir, "documents")).withColumn("lines", F.split("text", "\n", -1))
    text, lines, gone = F.col("text"), F.col("lines"), F.col("gone")
    return found.select(
        "doc_id", F.greatest(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(line_dedup.text_without(text, lines, gone), F.lit("")), 256).alias("kept_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int):
        # the lambda has one parameter: filter gives the position in the array to a second one
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{secret_scan.KINDS[kind]}")

    return found.select(
        "doc_id", *(count(k) for k in range(3)), F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_lm(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def _periodic_text(text: str, h: int) -> str:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at ASCII white space only
    n, g = len(words), h // 10
    if n == 0:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    whole, rest = divmod(n - a, p)
    return b" ".join(words[:a] + unit * whole + unit[:rest]).decode("utf-8", "surrogatepass")


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts whose id's checksum h is divisible by ten repeat some of their words from one place on, as op13's contract states."""

    def change(batches):
        for batch in batches_of_text(batches):
            marks = batch.column("h").to_pylist()
            texts = batch.column("text").to_pylist()
            for k, h in enumerate(marks):
                if h is not None and h % 10 == 0 and texts[k]:
                    texts[k] = _periodic_text(texts[k], h)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    h = F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")
    return docs.select("doc_id", "text", h).mapInArrow(change, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(made_periodic(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "peak.start", "peak.length", "peak.period",
        F.expr("(1000 * peak.length) div peak.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_neighbours, op2_quality, op3_simhash, op4_line_dedup, op5_toxicity, op6_secrets,
        op7_lm_scoring, op8_token_counts, op9_mixing, op10_decontamination,
        op11_lexical_search, op12_language_id, op13_periodic_runs,
    )
}
ORACLE_SQL = {"op9_mixing": mixing.MIX_SQL, "op10_decontamination": decontam.DECONTAM_SQL, "op11_lexical_search": lexical_search.SEARCH_SQL}
