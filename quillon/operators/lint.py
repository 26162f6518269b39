"""A scan of source lines for forbidden imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forbidden_imports(lines: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``lines`` (folder, path, line_no, line) that match the pattern of their folder. A folder that is not there
    has no lines and adds nothing."""
    hit = F.lit(False)
    for folder, pattern in rules.items():
        hit = hit | ((F.col("folder") == folder) & F.rlike("line", F.lit(pattern)))
    return lines.where(hit)


def lint_failed(found: DataFrame) -> DataFrame:
    """(failed): whether any line was found, also of none."""
    return found.agg((F.count("*") > 0).alias("failed"))
