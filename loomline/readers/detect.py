"""Readers for runs whose command tells none: by marks in the output. The first reader with a mark reads the run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.readers.registry import READERS, Reader

#: A line that only this tool's output has.
MARKS = {
    "go-test": r"^(?:\s*--- (?:FAIL|PASS|SKIP): \S+ \([\d.]+s\)|(?:ok  |FAIL)\t\S+\t)",
    "pytest": r"^=+ (?:test session starts|.* in [\d.]+s(?: \([\d:]+\))?) =+$",
    "cargo": r"^test result: (?:ok|FAILED)\. \d+ passed",
    "tsc": r"^\S+\(\d+,\d+\): (?:error|warning) TS\d+: ",
    "eslint": r"^✖ \d+ problems? \(",
    "jest": r"^Test Suites: .*\d+ total$",
    "vitest": r"^ *Test Files {2,}\d+ (?:passed|failed)",
    "mocha": r"^ {2}\d+ passing \(",
    "monorepo": r"^[@\w/.-]+:(?:build|test|lint|typecheck|dev): ",
}


def detect(runs: DataFrame, text: str = "text", readers: Sequence[Reader] = READERS) -> DataFrame:
    """``reader`` and ``kind`` where they are null and the text has a mark; else as they are. A null text has none."""
    kinds = {r.name: r.kind for r in readers}
    name = F.lit(None).cast("string")
    for reader, mark in reversed(MARKS.items()):
        if reader in kinds:
            name = F.when(F.col(text).rlike(f"(?dm){mark}"), reader).otherwise(name)
    kind = F.lit(None).cast("string")
    for reader in MARKS:
        if reader in kinds:
            kind = F.when(F.col("__found") == reader, kinds[reader]).otherwise(kind)
    found = runs.withColumn("__found", F.when(F.col("reader").isNull(), name))
    return found.withColumn("kind", F.coalesce("kind", kind)).withColumn("reader", F.coalesce("reader", "__found")).drop("__found")
