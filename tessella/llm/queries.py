"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from tessella.llm import chat_windows, decontaminate, fingerprint, line_dedup, mixing, periodic_runs, secrets, simhash, substring_dedup, toxicity, url_filter, warc, whitening
from tessella.llm.common import table

QUERIES = {
    "op1_url_filters": lambda spark, d: url_filter.url_digest(table(spark, d, "pages")),
    "op2_warc": lambda spark, d: warc.warc_digest(table(spark, d, "pages")),
    "op3_toxicity": lambda spark, d: toxicity.toxicity_digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_substring_dedup": lambda spark, d: substring_dedup.substring_dedup_digest(table(spark, d, "documents")),
    "op5_secret_scans": lambda spark, d: secrets.secrets_digest(table(spark, d, "documents")),
    "op6_simhash": lambda spark, d: simhash.simhash_digest(table(spark, d, "documents")),
    "op7_fingerprint": lambda spark, d: fingerprint.fingerprint_digest(table(spark, d, "documents")),
    "op8_benchmark_decontamination": lambda spark, d: decontaminate.decontamination_digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_line_dedup": lambda spark, d: line_dedup.line_dedup_digest(table(spark, d, "documents")),
    "op10_mixing": lambda spark, d: mixing.mixing_digest(table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: periodic_runs.runs_digest(table(spark, d, "documents")),
    "op12_whitening": lambda spark, d: whitening.whitening_digest(table(spark, d, "embeddings")),
    "op13_chat_formatting": lambda spark, d: chat_windows.chat_digest(table(spark, d, "conversations")),
}

ORACLE_SQL = {
    "op1_url_filters": url_filter.SQL,
    "op2_warc": warc.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
