"""Writers for results, findings and audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.redact import project_findings
from veilspark.plans.audit import AUDIT_FILE, AUDIT_TEXT


def refuse_partial(df: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Rows whose scan lost a layer are not clean; they fail the write unless
    partial results are allowed."""
    if allow_partial:
        return df
    lost = F.coalesce(F.size("layer_errors"), F.lit(0)) > 0
    message = F.lit("a scan layer failed for some rows; pass allow_partial=True to write them")
    checked = F.when(lost, F.raise_error(message).cast("string")).otherwise(F.col("sanitized"))
    return df.withColumn("sanitized", checked)


def write_results(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "append", allow_partial: bool = False
) -> None:
    """Redacted texts with counts, partitioned by depth; findings are left out."""
    refuse_partial(df, allow_partial).drop("findings").write.format(format).mode(mode).partitionBy("depth").save(path)


def findings_table(df: DataFrame, id: str = "doc_id", debug: bool = False, offsets: bool = False) -> DataFrame:
    """Reported findings as rows. The matched text is only there when `debug`.

    The outer form keeps Spark from testing the findings once before and once
    during the explode, which would run the whole scan twice.
    """
    rows = df.select(id, F.posexplode_outer(project_findings(F.col("findings"), debug, offsets)).alias("pos", "f"))
    return rows.filter(F.col("pos").isNotNull()).select(id, F.col("pos").alias("ord"), "f.*")


def write_findings(
    df: DataFrame, path: str, id: str = "doc_id", debug: bool = False, format: str = "parquet", mode: str = "append"
) -> None:
    findings_table(df, id, debug).write.format(format).mode(mode).save(path)


def write_audit(audit: DataFrame, path: str, format: str = "parquet", mode: str = "append") -> None:
    """Append audit rows; only metadata columns are ever written."""
    allowed = [c for c in dict.fromkeys((*AUDIT_TEXT, *AUDIT_FILE)) if c in audit.columns]
    audit.select(*allowed).write.format(format).mode(mode).save(path)
