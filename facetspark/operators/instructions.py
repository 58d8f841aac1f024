"""Instruction records and instruction prompts for a tuned generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import to_json_text

# Our own wording.
INSTRUCTION = ("Read the product record and return its attribute values and labels "
               "as one JSON object.")
PROMPT_PREFIX = ("You predict labels for e-commerce products. Answer with JSON only, "
                 "nothing else. input: ")


def instruction_records(df: DataFrame, input_col: str, output_col: str, instruction: str = INSTRUCTION,
                        keep_newline: bool = False) -> DataFrame:
    """``(instruction, input, output)`` records (plus any other columns kept by the caller)."""
    inp, out = F.col(input_col), F.col(output_col)
    if keep_newline:  # the reference's readlines() kept the line end
        inp, out = F.concat(inp, F.lit("\n")), F.concat(out, F.lit("\n"))
    others = [c for c in df.columns if c not in (input_col, output_col)]
    return df.select(*others, F.lit(instruction).alias("instruction"), inp.alias("input"), out.alias("output"))


def instruction_prompts(df: DataFrame, *record_cols: str, prefix: str = PROMPT_PREFIX) -> DataFrame:
    """Fixed prefix + the record as JSON text -> ``prompt``."""
    return df.withColumn("prompt", F.concat(F.lit(prefix), to_json_text(*record_cols)))
