"""Text outputs of the workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_counts_text(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``(word,count)`` lines."""
    word, n = counts.columns
    counts.select(F.format_string("(%s,%s)", word, F.col(n).cast("string")).alias("value")).write.mode(mode).text(path)


def write_counts_csv(counts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``word,count`` lines, quoted where needed."""
    counts.write.mode(mode).option("escape", '"').option("emptyValue", "").csv(path)


def write_words(words: DataFrame, path: str, column: str = "word") -> None:
    """One generated word per line, replacing an earlier output; one file per generating task."""
    words.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
