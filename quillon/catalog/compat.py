"""Queries over capability tables and described policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import error_text
from quillon.operators import compat, lint, policy
from quillon.sources.tables import table

FORMATS = {"en": "Png", "fr": "Jpeg", "de": "Webp"}
KINDS = {"click": "CpuRgba", "view": "Static", "purchase": "DeviceEncoded", "signup": "Static", "error": "DeviceEncoded"}
LICENSES = (("Apache License, Version 2.0", "Apache-2.0"), ("MIT License", "MIT"), ("GNU General Public License, version 3", "GPL-3.0"), ("CC BY-NC 4.0", "CC-BY-NC-4.0"))
#: Protocols by the number that an event names.
PROTOCOLS = (*policy.REQUIRED, *policy.OPTIONAL)


def _chosen(column: str, names: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("asset_id"), _chosen("lang", FORMATS, "Unknown").alias("format"), F.col("n_chars").alias("bytes"),
        (F.col("n_chars") < 500).alias("small"), ((F.col("lang") == "de") & (F.col("n_chars") % 3 == 0)).alias("exif_broken"),
    )
    return compat.with_support(docs, compat.support_matrix(spark))


def support_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assets(spark, sf_dir).groupBy("format", "level", F.col("level_ord").cast("long").alias("level_ord")).agg(F.count("*").alias("assets"))


def negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").select("event_id", _chosen("event_type", KINDS).alias("source_kind"))
    out = kinds.withColumn("n", compat.negotiate(F.col("source_kind")))
    return out.select("event_id", "source_kind", F.col("n.tag").alias("tag"), F.array_join("n.notes", ",").alias("notes"))


def load_report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compat.coverage(compat.load_reports(_assets(spark, sf_dir)))


def load_report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = compat.load_reports(_assets(spark, sf_dir))
    return r.select("asset_id", F.col("report.status").alias("status"), F.col("report.severity").alias("severity"), F.array_join("report.warnings", ",").alias("warnings"), F.array_join("report.ignored", ",").alias("ignored"), F.col("report.stats.total_bytes").alias("total_bytes"))


def fallback_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("level") == "Unsupported", "format_unsupported").when(F.col("small"), "image_small").when(F.col("exif_broken"), "exif_broken")
    of = _assets(spark, sf_dir).withColumn("category", category).where("category is not null")
    # a table of a handful of rows by definition
    return of.join(F.broadcast(policy.fallback_table(spark)), "category").groupBy("category", "action", "warning", "severity").agg(F.count("*").alias("assets"))


def error_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = _chosen("event_type", {"click": "SurfaceLost", "view": "DeviceLost", "error": "InvalidState", "purchase": "LoadError", "signup": "Transient"})
    out = table(spark, sf_dir, "events").select("event_id", error.alias("error"))
    return out.select("event_id", "error", policy.recovery_of(F.col("error")).alias("action"), error_text(F.col("error"), F.lit("x")).alias("text"))


def warning_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every asset's warnings say, by the catalog of codes."""
    told = compat.load_reports(_assets(spark, sf_dir)).select("asset_id", F.explode("report.warnings").alias("code"))
    # a row per code, a handful by definition
    c = told.join(F.broadcast(compat.warning_catalog(spark)), "code")
    return c.select("asset_id", "code", compat.warning_text(F.col("code"), F.col("name"), F.lit(None).cast("string"), F.col("impact"), F.col("fix")).alias("text"))


def profile_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as profiles of their nations; every event activates one."""
    fit = F.get(F.lit(list(policy.FITS)), (F.col("n_nationkey") % len(policy.FITS)).cast("int"))
    entry = F.struct("n_name", F.struct(F.concat(F.lit("/"), F.lower("n_name"), F.lit(".png")).alias("path"), F.lit("image").alias("backend"), fit.alias("fit")))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    profiles = nations.groupBy(F.col("r_name").alias("name")).agg(F.map_from_entries(F.collect_list(entry)).alias("outputs"))
    k = (F.get_json_object("props", "$.k").cast("long") % 5).alias("r_regionkey")
    activations = table(spark, sf_dir, "events").select(k, F.struct("ts", "event_id").alias("seq")).join(table(spark, sf_dir, "region"), "r_regionkey")
    return policy.assign(profiles, activations.select(F.col("r_name").alias("name"), "seq"))


def protocol_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as compositors, whose events name the protocols that they have."""
    named = F.get(F.lit(list(PROTOCOLS)), (F.get_json_object("props", "$.k").cast("long") % 13).cast("int"))  # seven of thirteen name none
    return policy.degradation(table(spark, sf_dir, "events").select("user_id", named.alias("protocol")), "user_id")


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_quantity").alias("quantity"))
    return policy.regressions(monthly, "l_returnflag", "month", "quantity").select("l_returnflag", "month", "quantity", "previous", F.round("change", 6).alias("change"), "blocked")


def license_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.lit(None).cast("string")
    for phrase, name in reversed(LICENSES):
        found = F.when(F.contains(F.col("text"), F.lit(phrase)), name).otherwise(found)
    named = table(spark, sf_dir, "documents").select("doc_id", found.alias("license")).where("license is not null")
    return compat.not_allowed(named, spark).select("doc_id", "license")


def import_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lint.forbidden_imports(lines, {"src1": "^The [a-z]", "src2": "^De [a-z]", "missing": "."})
    return found.select("folder", "path", F.col("line_no").cast("long").alias("line_no"))


QUERIES = {f.__name__: f for f in (support_lookup, negotiation, load_report_coverage, load_report_warnings, fallback_policy, error_recovery, warning_catalog, profile_assignment, protocol_degradation, regression_gate, license_allowlist, import_lint)}


def _case(column: str, names: dict[str, str], otherwise: str | None = None) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + (f" ELSE '{otherwise}'" if otherwise else "") + " END"


_A = f"a AS (SELECT doc_id AS asset_id, {_case('lang', FORMATS, 'Unknown')} AS format, n_chars, n_chars < 500 AS small, lang = 'de' AND n_chars % 3 = 0 AS exif FROM documents)"
_BAD = "format = 'Unknown'"
_STATUS = f"CASE WHEN {_BAD} THEN 'Failed' WHEN small OR exif THEN 'Partial' ELSE 'Ok' END"
ORACLES = {
    "support_lookup": f"WITH {_A} SELECT format, CASE WHEN {_BAD} THEN 'Unsupported' ELSE 'Full' END AS level, CAST(CASE WHEN {_BAD} THEN 0 ELSE 3 END AS BIGINT) AS level_ord, count(*) AS assets FROM a GROUP BY format",
    "negotiation": f"SELECT event_id, {_case('event_type', KINDS)} AS source_kind, CASE WHEN event_type IN ('purchase', 'error') THEN 'CompatibleWithLimitations' ELSE 'Compatible' END AS tag, CASE WHEN event_type IN ('purchase', 'error') THEN '{compat.DEVICE_NOTE}' ELSE '' END AS notes FROM events",
    "load_report_coverage": f"WITH {_A} SELECT {_STATUS} AS status, count(*) AS reports FROM a GROUP BY 1",
    "load_report_warnings": f"WITH {_A} SELECT asset_id, {_STATUS} AS status, CASE WHEN {_STATUS} = 'Partial' THEN 'Cosmetic' END AS severity, CASE WHEN {_BAD} THEN '' ELSE concat_ws(',', CASE WHEN small THEN 'W001' END, CASE WHEN exif THEN 'W002' END) END AS warnings, CASE WHEN exif AND NOT {_BAD} THEN 'exif' ELSE '' END AS ignored, CASE WHEN {_BAD} THEN 0 ELSE n_chars END AS total_bytes FROM a",
    "fallback_policy": f"""WITH {_A}, b AS (SELECT CASE WHEN {_BAD} THEN 'format_unsupported' WHEN small THEN 'image_small' WHEN exif THEN 'exif_broken' END AS category FROM a)
      SELECT category, CASE category WHEN 'format_unsupported' THEN 'error' WHEN 'image_small' THEN 'upscale' ELSE 'ignore_exif' END AS action, CASE category WHEN 'image_small' THEN 'W001' WHEN 'exif_broken' THEN 'W002' END AS warning,
      CASE WHEN category <> 'format_unsupported' THEN 'Cosmetic' END AS severity, count(*) AS assets FROM b WHERE category IS NOT NULL GROUP BY category""",
    "error_recovery": """SELECT event_id, CASE event_type WHEN 'click' THEN 'SurfaceLost' WHEN 'view' THEN 'DeviceLost' WHEN 'error' THEN 'InvalidState' WHEN 'purchase' THEN 'LoadError' ELSE 'Transient' END AS error,
      CASE event_type WHEN 'click' THEN 'recreate_surface_once' WHEN 'view' THEN 'recreate_runtime' WHEN 'error' THEN 'backend_failed' WHEN 'purchase' THEN 'solid_colour' END AS action,
      CASE event_type WHEN 'click' THEN 'surface lost' WHEN 'view' THEN 'device lost' WHEN 'error' THEN 'invalid state (bug): x' WHEN 'signup' THEN 'transient error' END AS text FROM events""",
    "warning_catalog": f"""WITH {_A}, w AS (SELECT asset_id, 'W001' AS code FROM a WHERE small AND NOT {_BAD} UNION ALL SELECT asset_id, 'W002' FROM a WHERE exif AND NOT {_BAD})
      SELECT asset_id, code, CASE code WHEN 'W001' THEN '[W001] ImageSmallerThanOutput' || chr(10) || '  Impact:  Upscaling with quality loss' || chr(10) || '  Fix:     Use an image at least as large as the output'
        ELSE '[W002] ImageExifBroken' || chr(10) || '  Impact:  Orientation may be wrong' || chr(10) || '  Fix:     Rewrite the metadata of the image' END AS text FROM w""",
    "profile_assignment": """WITH k AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS r FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 1)
      SELECT r_name AS profile, n_name AS output, '/' || lower(n_name) || '.png' AS path, 'image' AS backend, CASE n_nationkey % 5 WHEN 0 THEN 'cover' WHEN 1 THEN 'contain' WHEN 2 THEN 'stretch' WHEN 3 THEN 'tile' ELSE 'center' END AS fit
      FROM nation JOIN region ON n_regionkey = r_regionkey JOIN k ON r_regionkey = r""",
    "protocol_degradation": """WITH p AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 13 AS k FROM events),
      h AS (SELECT user_id, coalesce(bool_or(k = 0), false) AS layer, coalesce(bool_or(k = 1), false) AS xdg, coalesce(bool_or(k = 2), false) AS fractional, coalesce(bool_or(k = 3), false) AS viewporter,
        coalesce(bool_or(k = 4), false) AS content, coalesce(bool_or(k = 5), false) AS toplevel FROM p GROUP BY user_id)
      SELECT user_id, layer AND xdg AS usable, CASE WHEN fractional AND viewporter THEN 'fractional' ELSE 'integer' END AS scaling, CASE WHEN content THEN 'photo' END AS content_hint, toplevel AS fullscreen_detection,
        concat_ws(',', CASE WHEN NOT fractional THEN 'W023' END, CASE WHEN fractional AND NOT viewporter THEN 'W024' END, CASE WHEN NOT toplevel THEN 'W040' END) AS warnings FROM h""",
    "regression_gate": """WITH m AS (SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
      p AS (SELECT *, lag(quantity) OVER (PARTITION BY l_returnflag ORDER BY month) AS previous FROM m)
      SELECT *, round((quantity - previous) / previous, 6) AS change, coalesce((quantity - previous) / previous > 0.1, false) AS blocked FROM p""",
    "license_allowlist": """SELECT * FROM (SELECT doc_id, CASE WHEN contains(text, 'Apache License, Version 2.0') THEN 'Apache-2.0' WHEN contains(text, 'MIT License') THEN 'MIT' WHEN contains(text, 'GNU General Public License, version 3') THEN 'GPL-3.0'
      WHEN contains(text, 'CC BY-NC 4.0') THEN 'CC-BY-NC-4.0' END AS license FROM documents) WHERE license IN ('GPL-3.0', 'CC-BY-NC-4.0')""",
    "import_lint": """WITH l AS (SELECT source AS folder, doc_id AS path, string_split(text, chr(10)) AS x FROM documents), y AS (SELECT folder, path, generate_subscripts(x, 1) - 1 AS line_no, unnest(x) AS line FROM l)
      SELECT folder, path, line_no FROM y WHERE (folder = 'src1' AND regexp_matches(line, '^The [a-z]')) OR (folder = 'src2' AND regexp_matches(line, '^De [a-z]'))""",
}
