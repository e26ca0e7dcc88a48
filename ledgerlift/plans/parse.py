"""Documents to extracted data, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_lines, document_head, preprocess_text
from ..operators.extraction import fill_fuzzy, with_lines
from ..operators.matching import best_template, identify_merchant
from ..sources.scratch import written


def parse_receipts(documents: DataFrame, templates: DataFrame, hint: str | None = None, misreads: str = "full",
                   text: str = "ocr_text", **options) -> DataFrame:
    """Clean, identify the merchant, choose candidates, extract, keep the best.

    Documents without a template or without data get an ``error`` and a
    correspondence of 0. Multi-line extractors are read like the others. Cleaned
    documents are written to the shared folder: matching reads them three times.
    """
    cleaned = documents.withColumn("clean_text", preprocess_text(F.col(text), misreads))
    lined = written(with_lines(cleaned, "clean_text"), "lines")
    hinted = identify_merchant(lined, templates, hint).withColumn("head", document_head(F.col("lines"), 3))
    best = best_template(hinted, templates, fill=fill_fuzzy, **options)
    failed = F.col("template_id").isNull()
    return best.withColumn("error", F.when(failed, "Failed to parse receipt")).withColumn(
        "correspondence", F.when(failed, 0.0).otherwise(F.col("correspondence"))).drop("lines", "head")


def parse_or_fallback(parsed: DataFrame, now: Column) -> DataFrame:
    """Failed documents get the fallback fields; job correspondence is 0 to 1."""
    fallback = F.create_map(
        F.lit("merchant_name"), F.lit("Error extracting data"),
        F.lit("transaction_time"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit("total_amount"), F.lit(""), F.lit("currency"), F.lit(""),
        F.lit("error"), F.concat(F.lit("Failed to parse receipt: "), F.col("error")))
    whole = F.map_concat(F.col("fields"), F.create_map(
        F.lit("currency"), F.col("currency.code"), F.lit("currency_symbol"), F.col("currency.symbol")))
    return parsed.withColumn("extracted_data", F.when(F.col("error").isNotNull(), fallback).otherwise(whole)).withColumn(
        "template_correspondence", F.coalesce(F.col("correspondence"), F.lit(0.0)) / 100)


def assemble_extraction(best: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Fields, items and currency of a document as one map and one array."""
    whole = F.map_concat(F.col("fields"), F.create_map(
        F.lit("currency"), F.col("currency.code"), F.lit("currency_symbol"), F.col("currency.symbol")))
    return best.select(key, whole.alias("extracted_data"), "cost_items")


def attach_text_metadata(jobs: DataFrame, text: str = "ocr_text", misreads: str = "full") -> DataFrame:
    """Raw and cleaned text kept with the job for later learning."""
    entries = F.create_map(F.lit("ocr_text"), F.col(text), F.lit("ocr_text_preprocessed"), preprocess_text(F.col(text), misreads))
    base = F.map_filter("metadata", lambda k, _: ~k.isin("ocr_text", "ocr_text_preprocessed"))
    return jobs.withColumn("metadata", F.map_concat(base, entries))


def receipt_totals(documents: DataFrame, owners: DataFrame, pattern: str, key: str = "receipt_id") -> DataFrame:
    """Total per owner and month, read from the documents' text."""
    lines = F.filter(clean_lines(F.col("ocr_text"), "units"), lambda line: line.rlike(pattern))
    amount = F.regexp_extract(F.get(lines, F.lit(0)), pattern, 1).try_cast("decimal(12,2)")
    read = documents.select(key, amount.alias("amount"))
    return read.join(owners, key).groupBy("owner", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n_receipts"), F.sum("amount").alias("total"))
