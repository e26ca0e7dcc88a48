"""Corrections to statistics and new templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..operators.extraction import with_lines
from ..operators.learning import (build_template_rows, correction_counts, derive_field_extractors, ewma_fields,
                                  ewma_rates, field_corrected, items_corrected, map_mean, needs_new_template,
                                  template_from_correction)


#: Parts that the corrections of one template id are dealt to, and those without an id.
_PARTS, _NULL_PARTS = 16, 1024


def compare_corrections(corrections: DataFrame, templates: DataFrame) -> DataFrame:
    """One compared row per correction and field of its template; a field that the correction
    leaves out counts as the empty text, that is as correct."""
    known = templates.select("template_id", F.map_keys("field_extractors").alias("fields"), "usage_count")
    rows = corrections.join(known, "template_id").select(
        "correction_id", "template_id", "ts", "usage_count", "extracted", "corrected", F.explode("fields").alias("field"))
    return field_corrected(rows.select(
        "correction_id", "template_id", "ts", "usage_count", "field",
        F.col("extracted")[F.col("field")].alias("extracted"), F.coalesce(F.col("corrected")[F.col("field")], F.lit("")).alias("corrected")))


def check_corrections(corrections: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ``known``, true where the template exists, and ``error``, null where the correction can be applied."""
    # Ids that no template has, or null, can be those of many corrections, so each id is dealt to several parts.
    dealt = F.pmod(F.xxhash64("correction_id"), F.when(F.col("template_id").isNull(), F.lit(_NULL_PARTS)).otherwise(F.lit(_PARTS)))
    known = templates.select("template_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))).alias("dealt_"), F.lit(True).alias("known"))
    bare = F.coalesce(F.size("corrected"), F.lit(0)) + F.coalesce(F.size("cost_items"), F.lit(0)) == 0
    return corrections.withColumns({"dealt_": dealt, "bare_": bare}).join(known, ["template_id", "dealt_"], "left").withColumn(
        "error", F.when(F.col("bare_"), "Corrected data is required")
        .when(F.coalesce(F.length("template_id"), F.lit(0)) == 0, "Original template ID is required")
        .when(F.col("known").isNull(), F.concat(F.lit("Original template "), "template_id", F.lit(" not found")))).drop("dealt_", "bare_")


def apply_corrections(corrections: DataFrame, templates: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Outcomes, updated statistics and new templates of a batch of corrections.

    ``corrections``: correction_id, template_id, ts, ocr_text, extracted and
    corrected (maps of field to text), extracted_items, cost_items. Rows without
    corrected data, without a template id or with an unknown one become errors.
    """
    # items are compared where they are, so that no join takes them along for it
    corrections = corrections.withColumn("items_differ", items_corrected(F.col("extracted_items"), F.col("cost_items")))
    checked = check_corrections(corrections, templates)
    valid = checked.where("known and error is null").drop("known", "error")
    compared = compare_corrections(valid, templates)
    counts = correction_counts(compared)
    judged = checked.join(counts.select("correction_id", "total", "n_corrected"), "correction_id", "left").withColumn(
        "is_new", F.col("error").isNull() & needs_new_template(F.col("items_differ"), F.coalesce("n_corrected", F.lit(0))))
    outcomes = judged.select(
        "correction_id", "template_id", F.col("error").isNull().alias("success"), "error",
        F.when(F.col("error").isNull(), F.when(F.col("is_new"), "created").otherwise("updated")).alias("template_action"))
    fresh = judged.where("is_new")
    documents = with_lines(fresh.select("correction_id", "ocr_text", "cost_items", *[
        F.coalesce(F.col("corrected")[f], F.lit("")).alias(f) for f in fixed.FIELDS]))
    rows = build_template_rows(derive_field_extractors(documents), "correction_id")
    new_templates = template_from_correction(rows, "correction_id", templates, fresh.select("correction_id", "template_id"), now)
    fields = ewma_fields(compared, templates)
    return {
        "outcomes": outcomes, "new_templates": new_templates, "rates": ewma_rates(counts, templates), "fields": fields,
        "accuracy": fields.select("template_id", "field", "n", "accuracy"), "edit_distances": fields.select("template_id", "field", "n", "edit_distance")}


def _merged(old: Column, new: Column) -> Column:
    """A map with the entries of another one put over its own."""
    return F.when(new.isNull(), old).otherwise(F.map_concat(
        F.coalesce(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), F.create_map().cast("map<string,double>")), new))


def updated_templates(templates: DataFrame, applied: dict[str, DataFrame]) -> DataFrame:
    """The template table after ``apply_corrections``: rates, accuracy and edit distance of each field, and the mean of
    the distances. Templates without corrections, and fields that none of them touched, stay as they are."""
    per_field = applied["fields"].groupBy("template_id").agg(*[
        F.map_from_entries(F.collect_list(F.struct("field", value))).alias(f"new_{value}") for value in ("accuracy", "edit_distance")])
    rates = applied["rates"].select("template_id", F.col("success_rate").alias("new_success"), F.col("override_rate").alias("new_override"))
    joined = templates.join(rates, "template_id", "left").join(per_field, "template_id", "left")
    distances = _merged(F.col("field_edit_distances"), F.col("new_edit_distance"))
    changed = {"success_rate": F.coalesce("new_success", "success_rate"), "override_rate": F.coalesce("new_override", "override_rate"),
               "field_accuracy": _merged(F.col("field_accuracy"), F.col("new_accuracy")), "field_edit_distances": distances,
               "avg_edit_distance": F.when(F.col("new_edit_distance").isNotNull(), map_mean(distances)).otherwise(F.col("avg_edit_distance"))}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in templates.columns])
