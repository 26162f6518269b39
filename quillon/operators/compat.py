"""Support levels, negotiation, warnings and load reports: small tables and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels in ascending order, and the level of each format.
LEVELS = ("Unsupported", "Detected", "Partial", "Full")
SUPPORT = {"Png": "Full", "Jpeg": "Full", "Webp": "Full", "Unknown": "Unsupported"}
#: Warning codes with their names and advice.
WARNINGS = (
    ("W001", "ImageSmallerThanOutput", "Upscaling with quality loss", "Use an image at least as large as the output"),
    ("W002", "ImageExifBroken", "Orientation may be wrong", "Rewrite the metadata of the image"),
    ("W023", "FractionalScaleUnavailable", "Fractional display scaling may show artifacts", "Update your compositor"),
    ("W024", "ViewporterUnavailable", "Fractional scaling degrades to integer scaling", "Update your compositor"),
    ("W025", "ContentTypeUnavailable", "No content hints for the compositor", "Update your compositor"),
    ("W040", "ForeignToplevelUnavailable", "No detection of fullscreen clients", "Update your compositor"),
    ("W050", "ForeignConfigDetected", "The settings of another program are not read", "Convert them to a profile"),
)
DEVICE_NOTE = "DeviceEncoded requires device target support"
#: Licences that dependencies may have.
ALLOWED_LICENSES = ("MIT", "Apache-2.0", "Apache-2.0 WITH LLVM-exception", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unicode-DFS-2016", "Unicode-3.0", "Zlib")


def level_ord(level: Column) -> Column:
    """Levels compare by this number; null for what is no level."""
    return F.nullif(F.array_position(F.lit(list(LEVELS)), level), F.lit(0)).cast("int") - 1


def support_matrix(spark: SparkSession) -> DataFrame:
    rows = [(k, f, level, LEVELS.index(level)) for k, (f, level) in enumerate(SUPPORT.items())]
    return spark.createDataFrame(rows, "format_ord int, format string, level string, level_ord int")


def with_support(assets: DataFrame, matrix: DataFrame) -> DataFrame:
    """``assets`` (format) with ``level``: formats that the matrix lacks are unsupported. The matrix has a row
    per format, a handful by definition."""
    out = assets.join(F.broadcast(matrix.select("format", "level", "level_ord")), "format", "left")
    return out.withColumns({"level": F.coalesce("level", F.lit(LEVELS[0])), "level_ord": F.coalesce("level_ord", F.lit(0))})


def negotiate(source_kind: Column) -> Column:
    """Struct of tag and notes. Surface formats do not matter, and nothing is ever incompatible."""
    device = source_kind == "DeviceEncoded"
    return F.struct(
        F.when(device, "CompatibleWithLimitations").when(source_kind.isin("CpuRgba", "Static"), "Compatible").alias("tag"),
        F.when(device, F.array(F.lit(DEVICE_NOTE))).otherwise(F.array().cast("array<string>")).alias("notes"),
    )


def mock_negotiate() -> Column:
    """What the mock renderer says to everything."""
    return F.lit("Compatible")


def warning_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WARNINGS), "code string, name string, impact string, fix string")


def warning_text(code: Column, name: Column, context: Column, impact: Column, fix: Column) -> Column:
    head = F.concat(F.lit("["), code, F.lit("] "), name)
    line = lambda title, x: F.when(x.isNotNull(), F.concat(F.lit(f"  {title:<9}"), x))
    return F.concat_ws("\n", head, line("Context:", context), line("Impact:", impact), line("Fix:", fix))


def load_reports(assets: DataFrame) -> DataFrame:
    """``assets`` (asset_id, format, level, bytes, small, exif_broken) -> (asset_id, report)."""
    small, exif = F.coalesce("small", F.lit(False)), F.coalesce("exif_broken", F.lit(False))
    failed = F.col("level") == "Unsupported"
    warnings = F.array_compact(F.array(F.when(small & ~failed, F.lit("W001")), F.when(exif & ~failed, F.lit("W002"))))
    ignored = F.array_compact(F.array(F.when(exif & ~failed, F.lit("exif"))))
    status = F.when(failed, "Failed").when(F.size(warnings) > 0, "Partial").otherwise("Ok")
    stats = F.struct(F.when(failed, F.lit(0)).otherwise(F.col("bytes")).cast("long").alias("total_bytes"), F.when(failed, 0).otherwise(1).alias("image_count"))
    report = F.struct(status.alias("status"), F.when(status == "Partial", "Cosmetic").alias("severity"), warnings.alias("warnings"), ignored.alias("ignored"), stats.alias("stats"))
    return assets.select("asset_id", report.alias("report"))


def coverage(reports: DataFrame) -> DataFrame:
    """(status, reports): counted from reports, never from the matrix."""
    return reports.groupBy(F.col("report.status").alias("status")).agg(F.count("*").alias("reports"))


def not_allowed(licenses: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows of ``licenses`` (license) that are not on the list; a null licence is not."""
    allowed = spark.createDataFrame([(x,) for x in ALLOWED_LICENSES], "license string")
    return licenses.join(F.broadcast(allowed), "license", "left_anti")
