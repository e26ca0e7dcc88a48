"""Scans, uploads and files coming in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import fixed


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table from parquet with its known schema, so nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def scan_templates(templates: DataFrame, archived: bool | None = None) -> DataFrame:
    """All, only archived or only active templates."""
    return templates if archived is None else templates.where(F.col("is_archived") == archived)


def scan_accounts(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Users, profiles, settings and revoked tokens below a folder."""
    parts = {"users": schemas.USER, "profiles": schemas.PROFILE, "settings": schemas.SETTINGS, "tokens": schemas.REVOKED_TOKEN}
    return {name: read_table(spark, f"{base}/{name}", schema) for name, schema in parts.items()}


def account_sizes(tables: dict[str, DataFrame], keys: dict[str, str], shown: dict[str, str]) -> DataFrame:
    """Rows and distinct keys of each account table, and the last value of a column of it."""
    parts = [t.agg(F.count("*").alias("n"), F.countDistinct(keys[name]).alias("n_keys"), F.max(shown[name]).cast("string").alias("last")).withColumn(
        "table_name", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_json_receipts(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Receipts that arrive as JSON: parsed as given, with a correspondence of 2.0;
    texts that are no JSON are flagged."""
    parsed = F.from_json(column, f"{schema}, broken string", {"columnNameOfCorruptRecord": "broken"})
    out = rows.withColumn("data", parsed).withColumn("is_corrupt", F.col("data").isNull() | F.col("data.broken").isNotNull())
    return out.withColumn("template_correspondence", F.when(~F.col("is_corrupt"), 2.0))


def load_json_receipts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of receipts; unreadable records keep their text in ``broken``."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path).withColumn(
        "template_correspondence", F.when(F.col("broken").isNull(), 2.0))


def load_landing_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a landing folder; the job is the folder a file lies in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", "length", F.col("modificationTime").alias("modified_at"),
                        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("job_id"))


def mime_type(path: Column) -> Column:
    """Type by extension, without regard to case; NULL for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, mime in fixed.EXTENSION_TYPES.items():
        out = F.when(ext == name, F.lit(mime)).otherwise(out)
    return out


def route_files(files: DataFrame) -> DataFrame:
    """Handler by type: image, pdf or json; anything else goes to quarantine with its reason."""
    kind = F.coalesce(mime_type(F.col("path")), F.lit("application/octet-stream"))
    handler = F.when(F.contains(kind, F.lit("image")), "image").when(F.contains(kind, F.lit("pdf")), "pdf").when(
        F.contains(kind, F.lit("json")), "json").otherwise("quarantine")
    out = files.withColumn("file_type", kind).withColumn("handler", handler)
    return out.withColumn("error", F.when(F.col("handler") == "quarantine", F.concat(F.lit("Unsupported file type: "), "file_type")))


def admit_uploads(files: DataFrame) -> DataFrame:
    """Adds ``reasons`` for refusing an upload: extension, size, type."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(mime_type(F.col("path")), F.lit(""))
    reasons = F.array_compact(F.array(
        F.when(~ext.isin(*fixed.FILE_EXTENSIONS), "extension"),
        F.when(F.col("length") > fixed.MAX_UPLOAD_BYTES, "size"),
        F.when(~kind.isin(*fixed.FILE_TYPES), "type")))
    return files.withColumn("reasons", reasons).withColumn("admitted", F.size("reasons") == 0)


def encode_payload(files: DataFrame) -> DataFrame:
    """File contents as base64 without line breaks."""
    content = F.col("content")
    if dict(files.dtypes)["content"] == "string":
        content = F.encode(content, "UTF-8")
    return files.withColumn("file", F.translate(F.base64(content), "\r\n", ""))


def generic_template(spark: SparkSession) -> DataFrame:
    """The fallback template as one row."""
    extractors = [(f, (e, patterns, line, offset, False)) for f, e, patterns, line, offset in fixed.GENERIC_EXTRACTORS]
    row = (f"G-{fixed.GENERIC_MERCHANT}", fixed.GENERIC_MERCHANT, 0, fixed.GENERIC_SUCCESS_RATE, 0.0, 0.0, False,
           ("GBP", "£"), dict(extractors), True, fixed.DEFAULT_START_LINE,
           [(p, g) for p, g in fixed.GENERIC_ITEM_PATTERNS], fixed.GENERIC_ACCURACY)
    return spark.createDataFrame([row], f"""template_id string, merchant_name string, usage_count long, success_rate double,
        override_rate double, avg_edit_distance double, is_archived boolean, currency_info {schemas.CURRENCY},
        field_extractors map<string,{schemas.CONFIG_EXTRACTOR}>, has_line_items boolean, line_items_start_line int,
        item_patterns array<{schemas.CONFIG_ITEM_PATTERN}>, field_accuracy map<string,double>""")


def seed_generic_template(templates: DataFrame) -> DataFrame:
    """Templates with the fallback template added, unless one of its name exists."""
    seed = generic_template(templates.sparkSession).join(templates.select("merchant_name"), "merchant_name", "left_anti")
    return templates.unionByName(seed, allowMissingColumns=True)
