"""What captured job output says about a scoring run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packhouse.functions.scalars import WEB_SPACE

# The three report forms, tried in this order, and the preview rule.
SCORED_PATTERNS = [
    rf"(?i)orders[_\-{WEB_SPACE}]?scored[{WEB_SPACE}]*[:=][{WEB_SPACE}]*([0-9]+)",
    rf"(?i)RESULT[{WEB_SPACE}]+orders_scored=([0-9]+)",
    rf"(?i)scored[{WEB_SPACE}]+([0-9]+)[{WEB_SPACE}]+orders",
]
FLAGGED_PATTERN = r"RESULT fraud_flagged_ids=([0-9,]*)"
PREVIEW_LENGTH = 4000
PREVIEW_MARK = "\n… (truncated)"


def _preview(text: Column) -> Column:
    return F.when(
        F.length(text) > PREVIEW_LENGTH,
        F.concat(F.substring(text, 1, PREVIEW_LENGTH), F.lit(PREVIEW_MARK))).otherwise(text)


def run_log_summary(logs: DataFrame) -> DataFrame:
    """Per run: success, orders scored, flagged ids and output previews. The whole text is searched."""
    stdout, stderr = F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))
    text = F.concat(stdout, F.lit("\n"), stderr)
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("bigint") for p in SCORED_PATTERNS]
    ids = F.filter(F.split(F.regexp_extract(stdout, FLAGGED_PATTERN, 1), ","), lambda i: i != "")
    ok = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    return logs.select(
        "run_id", ok.alias("ok"),
        F.coalesce(*found).alias("orders_scored"),
        F.transform(ids, lambda i: i.try_cast("bigint")).alias("flagged_ids"),
        _preview(stdout).alias("stdout_preview"), _preview(stderr).alias("stderr_preview"),
        F.when(~ok, F.concat(F.lit("Python process exited with code "),
                             F.coalesce(F.col("exit_code").cast("string"), F.lit("null")))).alias("error_message"))
