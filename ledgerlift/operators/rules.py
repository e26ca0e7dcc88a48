"""Validation rules. Each adds an array of violations; an empty array means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.expr import truthy
from .extraction import pattern_faults


def violations(**rules: Column) -> Column:
    """Names of the rules whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))


def check_currency_info(info: Column) -> Column:
    return violations(
        iso_code_missing=info["iso_code"].isNull(),
        symbol_missing=info["symbol"].isNull(),
        iso_code_format=~info["iso_code"].rlike(r"^[A-Z]{3}$"),
        symbol_too_long=F.length(info["symbol"]) > 3)


def _with_pattern_faults(templates: DataFrame, found: Column, column: str) -> DataFrame:
    """Adds ``violations``: those ``found``, then what the engine says of the patterns in a column. ``pattern_invalid``
    is no regular expression, ``pattern_unsupported`` one that has no equal on the JVM and would be set aside."""
    reasons = pattern_faults(templates, column).select("template_id", F.transform(
        F.array_distinct(F.transform("faults", lambda f: f["reason"])), lambda r: F.concat(F.lit("pattern_"), r)).alias("reasons_"))
    named = templates.withColumn("violations", found).join(reasons, "template_id", "left")
    every = F.concat("violations", F.coalesce(F.array_sort("reasons_"), F.array().cast("array<string>")))
    return named.select(*templates.columns, every.alias("violations"))


def check_extractors(templates: DataFrame) -> DataFrame:
    """Adds ``violations`` of the field extractors: flag, patterns, position."""
    entries = F.map_entries("field_extractors")
    rows = F.flatten(F.transform(entries, lambda e: F.transform(violations(
        expected_present_missing=e["value"]["expected_present"].isNull(),
        pattern_missing=e["value"]["patterns"].isNull(),
        position_missing=e["value"]["line"].isNull() & e["value"]["offset_from_last_item"].isNull(),
    ), lambda name: F.concat(e["key"], F.lit(":"), name))))
    return _with_pattern_faults(templates, rows, "field_extractors")


def check_item_patterns(templates: DataFrame) -> DataFrame:
    """Adds ``violations`` of the item patterns: pattern, groups, group numbers from 1."""
    rows = F.flatten(F.transform("item_patterns", lambda p: violations(
        pattern_missing=p["pattern"].isNull(),
        groups_missing=p["groups"].isNull(),
        group_index=F.exists(F.map_values(p["groups"]), lambda i: i.isNull() | (i < 1)))))
    return _with_pattern_faults(templates, rows, "item_patterns")


def _offenders(values: Column, bad) -> Column:
    return F.array_sort(F.transform(F.filter(F.map_entries(values), lambda e: bad(e["value"])), lambda e: e["key"]))


def check_field_accuracy(values: Column) -> Column:
    """Fields whose accuracy is not between 0 and 100."""
    return _offenders(values, lambda v: v.isNull() | (v < 0) | (v > 100))


def check_edit_distances(values: Column) -> Column:
    """Fields whose edit distance is negative."""
    return _offenders(values, lambda v: v.isNull() | (v < 0))


def check_recent_usage(usage: Column) -> Column:
    return violations(
        usage_percentage=(usage["usage_percentage"] < 0) | (usage["usage_percentage"] > 100),
        last_30_days=usage["last_30_days"] < 0, total_merchant_uses=usage["total_merchant_uses"] < 0)


def check_receipt(changes: DataFrame, existing: DataFrame | None = None, key: str = "receipt_id") -> DataFrame:
    """Adds ``violations``. A new receipt needs its file columns and a known file type;
    an update may not change them."""
    types = ~F.lower("file_ext").isin(*fixed.FILE_EXTENSIONS) & truthy(F.col("file_ext"))
    created = violations(
        file_ref_missing=~truthy(F.col("file_ref")), file_ext_missing=~truthy(F.col("file_ext")),
        upload_date_missing=F.col("upload_date").isNull(), file_type=types)
    if existing is None:
        return changes.withColumn("violations", created)
    names = ("file_ref", "file_ext", "upload_date")
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in names], F.lit(True).alias("exists"))
    joined = changes.join(old, key, "left")
    updated = violations(**{f"{c}_changed": F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names})
    return joined.withColumn("violations", F.when(F.col("exists"), updated).otherwise(created)).drop(
        "exists", *[f"old_{c}" for c in names])


def check_cost_item(item: Column) -> Column:
    """An item needs its total, or unit price and quantity; the quantity has a default of 1."""
    return violations(
        item_name_missing=~truthy(item["item_name"]),
        price_missing=item["total_price"].isNull() & item["unit_price"].isNull())


# Longest text per field of a correction.
TEXT_LIMITS = {"merchant_name": 255, "merchant_address": 500, "reference_number": 100, "category": 100,
               "description": 500, "currency": 3}


def check_corrections(values: Column) -> Column:
    """Rules of a correction given as a map of texts: lengths and decimals of (10,2)."""
    def bad_number(name: str) -> Column:
        text = values[name]
        fits = text.rlike(r"^\s*[+-]?(\d{1,8}(\.\d{0,2})?|\.\d{1,2})\s*$")
        return text.isNotNull() & ~fits

    rules = {name: F.length(values[name]) > limit for name, limit in TEXT_LIMITS.items()}
    rules |= {name: bad_number(name) for name in fixed.MONEY_FIELDS}
    return violations(**rules)
