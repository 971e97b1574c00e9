"""Prompt rows and input/completion text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section heads of the prompt.
PROMPT_FORMAT = """### Task
Generate a BigQuery SQL query to answer [QUESTION]{question}[/QUESTION]

### Schema
{schema}

### Hints
{hints}

### Answer
"""


def build_prompts(df: DataFrame, schema_text: str, question: str = "question", hints: str = "hints") -> DataFrame:
    """The prompt of every row; hints are joined by ``', '``, none give ``None``."""
    joined = F.array_join(F.col(hints), ", ")
    shown = F.when(F.coalesce(F.size(hints), F.lit(0)) > 0, joined).otherwise("None")
    return df.withColumn("prompt", _fill(PROMPT_FORMAT, question=F.col(question), schema=F.lit(schema_text), hints=shown))


def _fill(template: str, **parts: Column) -> Column:
    pieces, rest = [], template
    for name, value in parts.items():
        head, rest = rest.split("{" + name + "}", 1)
        pieces += [F.lit(head), value]
    return F.concat(*pieces, F.lit(rest))


def prompt_corpus(df: DataFrame, key: Column, end_token: str, test_percent: int = 10) -> DataFrame:
    """input + completion + end token, with a fixed train/test part per row.

    The part depends on the row's own key only, so it survives reruns and
    needs no shuffle.
    """
    two = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")
    return df.select(
        key.alias("row_key"),
        F.concat("input", "completion", F.lit(end_token)).alias("text"),
        F.when(two % 100 < test_percent, "test").otherwise("train").alias("part"),
    )
