"""Quality control of mixed tables, sample sheets and assay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts that mean a missing value, compared trimmed and as they are written (fixed values).
MISSING = [
    "NA", "N/A", "na", "n/a", "Na", "N/a",
    "None", "none", "NONE",
    "NULL", "null", "Null",
    "NaN", "nan", "NAN",
    "", " ", "  ", ".", "-", "--", "---",
    "missing", "Missing", "MISSING",
    "not available", "Not Available", "NOT AVAILABLE",
    "unknown", "Unknown", "UNKNOWN", "unk", "UNK",
    "#N/A", "#NA", "#VALUE!", "#REF!", "#DIV/0!", "#NAME?",
    "n.a.", "N.A.", "n.a", "N.A",
    "nil", "NIL", "Nil",
    "undefined", "UNDEFINED",
]
NUMERIC = {"int", "bigint", "double", "float", "smallint", "tinyint"}


def normalise_missing(df: DataFrame) -> DataFrame:
    """String columns trimmed, texts that mean missing to NULL."""
    t = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING), F.trim(F.col(f"`{c}`"))) for c, k in df.dtypes if k == "string"}
    return df.withColumns(t) if t else df


def profile_columns(df: DataFrame, key: str) -> DataFrame:
    """Per column: kind, n, missing share, distinct values, share of the commonest value, and whether it is constant.

    All columns are melted in one scan to (column, text) and counted together.
    """
    cols = [c for c in df.columns if c != key]
    kinds = dict(df.dtypes)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("numeric" if kinds[c] in NUMERIC else "text").alias("kind"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("r")
    g = df.select(rows).select("r.*").groupBy("column", "kind", "v").agg(F.count(F.lit(1)).alias("n"))
    s = g.groupBy("column", "kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("m"), F.count("v").alias("n_distinct"), F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"))
    return s.select("column", "kind", "n", (F.col("m") / F.col("n")).alias("missing"), "n_distinct", F.try_divide(F.col("top"), F.col("n") - F.col("m")).alias("top_share"), (F.col("n_distinct") <= 1).alias("constant"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())


def validate_sheet(sheet: DataFrame, required: list[str], formats: list[str] = ("peaks", "bed", "counts", "seacr")) -> DataFrame:
    """All violations at once: (row_key, rule, detail). The derived id is omics_group_biotech_b<batch>[_t<timepoint>]."""
    if absent := [c for c in required if c not in sheet.columns]:
        raise ValueError(f"sample sheet lacks columns: {absent}")
    s = sheet.withColumn("row_key", derived_id(sheet))
    rules = [(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), "empty", F.lit(c)) for c in required]
    rules.append((~F.col("format").isin(*formats), "format", F.col("format")))
    w = Window.partitionBy("row_key")
    s = s.withColumn("__n", F.count(F.lit(1)).over(w))
    rules.append((F.col("__n") > 1, "duplicate_id", F.col("row_key")))
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), d.cast("string").alias("detail"))) for c, r, d in rules]))).alias("v")
    return s.select("row_key", found).select("row_key", "v.rule", "v.detail")


def derived_id(sheet: DataFrame):
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    base = F.concat(part("omics"), F.lit("_"), part("group"), F.lit("_"), part("bio_rep"), part("tech_rep"), F.lit("_b"), part("batch"))
    return F.concat(base, F.when(F.col("timepoint").isNotNull(), F.concat(F.lit("_t"), F.col("timepoint").cast("string"))).otherwise("")) if "timepoint" in sheet.columns else base


def npx_filter(npx: DataFrame, most_warned: float = 0.25) -> DataFrame:
    """Assay rows of samples (no controls, id present, SampleQC not FAIL where there is one), in assays whose share of warned rows is
    at most the bound."""
    x = npx.where((F.col("AssayType") == "assay") & (F.col("SampleType") == "SAMPLE") & (F.trim("SampleID") != ""))
    if "SampleQC" in npx.columns:
        x = x.where(F.coalesce(F.col("SampleQC") != "FAIL", F.lit(True)))
    warned = x.groupBy("OlinkID").agg(F.avg(F.when(F.col("AssayQC").isin("WARN", "FAIL"), 1.0).otherwise(0.0)).alias("w"))
    return x.join(warned.where(F.col("w") <= most_warned).select("OlinkID"), "OlinkID", "left_semi")


def pool_cv(values: DataFrame) -> DataFrame:
    """Coefficient of variation per feature over pool samples (value on the linear scale)."""
    return values.where(F.startswith(F.lower("sample_id"), F.lit("pool"))).groupBy("feature_id").agg(F.try_divide(F.stddev_samp("value"), F.avg("value")).alias("cv"), F.count("value").alias("n"))


def collinear(corr: DataFrame, above: float = 0.9) -> DataFrame:
    return corr.where(F.abs("r") > above)
