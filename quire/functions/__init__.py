"""Functions on texts, pages, answers and speech."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_sql(spark: SparkSession, prefix: str = "quire_") -> list[str]:
    """Registers the Arrow-batched functions for SQL under names with this prefix; returns the names."""
    from quire.functions import answers, speech, text
    from quire.operators.narration import split_long

    found = {
        "unescape_html": text.unescape_html,
        "normalize_spoken": speech.normalize_spoken,
        "similarity": speech.similarity,
        "parse_answer": answers.parse_answer,
        "tag_signature": answers.tag_signature,
        "json_value": answers.json_value,
        "yaml_text": answers.yaml_text,
        "split_long": split_long,
    }
    for name, function in found.items():
        spark.udf.register(prefix + name, function)
    return [prefix + name for name in found]
