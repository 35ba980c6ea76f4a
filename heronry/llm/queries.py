"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronry.llm import op1_secret_scan, op2_language, op3_bpe, op4_media, op5_lm_score, op6_exact_dedup, op7_token_files, op8_near_dedup, op9_license, op10_mix, op11_html, op12_divergence, op13_resample
from heronry.llm.common import table


def op1_secret_scan_documents(spark, sf_dir):
    found = op1_secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "entropy")],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def op2_language_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    held = op2_language.held_out("doc_id", 4, 2)
    models = op2_language.fit(d.filter(~held))
    found = op2_language.identify(d, models)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits", "accepted")


def op8_near_dedup_documents(spark, sf_dir):
    return op8_near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_lm_score_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = op5_lm_score.lm_score(d, op5_lm_score.in_training("doc_id"))
    held = op2_language.held_out("doc_id", 7, 2)
    return s.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_license_documents(spark, sf_dir):
    """Documents as files: a folder for each source, in it one for each 1000 ids."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    s = op9_license.license_scan(d.withColumn("path", path))
    return s.select("doc_id", "path", F.array_join("own", "+").alias("own"), "cosine", F.size("found").cast("long").alias("n_lines"), F.array_join("inherited", "+").alias("inherited"), F.array_join("licenses", "+").alias("licenses"))


def op10_mix_documents(spark, sf_dir):
    return op10_mix.mix(table(spark, sf_dir, "documents"))


def op3_bpe_documents(spark, sf_dir):
    e = op3_bpe.bpe_encode(table(spark, sf_dir, "documents"))
    return e.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_files_documents(spark, sf_dir):
    return op7_token_files.token_files(table(spark, sf_dir, "documents"))


def op4_media_documents(spark, sf_dir):
    m = op4_media.media_columns(table(spark, sf_dir, "documents"))
    return m.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "fingerprint",
    )


def op6_exact_dedup_documents(spark, sf_dir):
    return op6_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry=[]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_html_extract(spark, sf_dir):
    return op11_html.extract(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark, sf_dir):
    return op12_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_importance_resample(spark, sf_dir):
    return op13_resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    """Name to query."""
    return {
        "op1_secret_scan": op1_secret_scan_documents,
        "op2_language_id": op2_language_documents,
        "op3_byte_bpe": op3_bpe_documents,
        "op4_media_columns": op4_media_documents,
        "op5_lm_score": op5_lm_score_documents,
        "op6_exact_dedup": op6_exact_dedup_documents,
        "op7_token_files": op7_token_files_documents,
        "op8_near_dedup": op8_near_dedup_documents,
        "op9_license_scan": op9_license_documents,
        "op10_mix_sources": op10_mix_documents,
        "op11_html_extract": op11_html_extract,
        "op12_source_divergence": op12_source_divergence,
        "op13_importance_resample": op13_importance_resample,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the operator."""
    return {"op6_exact_dedup": op6_exact_dedup.ORACLE, "op10_mix_sources": op10_mix.ORACLE, "op12_source_divergence": op12_divergence.ORACLE, "op13_importance_resample": op13_resample.ORACLE}
