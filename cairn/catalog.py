"""SQL functions: the column functions of this package under names for spark.sql, as one-expression SQL UDFs where they need no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.functions import passages

#: Names and their Python functions, registered as Arrow-batched scalar functions.
SCALARS = {
    "cairn_sentences": (passages.sentences, "array<string>"),
    "cairn_word_count": (lambda t: None if t is None else passages.word_count(t), "int"),
    "cairn_repair_mojibake": (passages.mojibake_repaired, "string"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with a session and returns their names."""
    for name, (function, kind) in SCALARS.items():
        spark.udf.register(name, F.udf(function, kind, useArrow=True))
    return sorted(SCALARS)
