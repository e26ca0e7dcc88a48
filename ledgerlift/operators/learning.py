"""Learning from corrections: comparison, statistics, flags and new templates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType)

from ..functions import fixed, fuzzy
from ..functions.expr import instant, regex_escape, truthy
from ..functions.text import guess_merchant, library_value
from ..schemas import CONFIG_EXTRACTOR
from .extraction import derive_item_pattern, item_section

# --- ordered folds ------------------------------------------------------------


#: Sizes of time that ordered folds go through.
BUCKETS = ("minute", "day")


def affine_folds(events: DataFrame, keys: list[str], folds: dict[str, tuple[Column, dict[str, Column]]], ts: str, order: str,
                 bucket: str | tuple[str, ...] = BUCKETS) -> DataFrame:
    """Fold ``r -> factor * r + term`` over each key's events in time order, for each of some named factors with its terms.

    Returns one row per key with the named factors and terms and ``n``: the fold of a start value r is
    ``factor * r + term``. Steps compose, so each bucket of time is folded on its own, then the buckets
    within the next larger one, and the largest last. A key with a third of all events is spread over its smallest
    buckets; only one row per bucket meets at the next. All folds go through the same shuffles.
    """
    rows = events.select(*keys, F.col(ts).alias("_at"), F.col(order).alias("_no"), F.lit(1).cast("long").alias("n"),
                         *[c.alias(name) for scale, (factor, terms) in folds.items() for name, c in ((scale, factor), *terms.items())])
    for level in (*((bucket,) if isinstance(bucket, str) else bucket), None):
        group = keys if level is None else [*keys, "_bucket"]
        if level is not None:
            rows = rows.withColumn("_bucket", F.date_trunc(level, "_at"))
        within = Window.partitionBy(*group).orderBy(F.desc("_at"), F.desc("_no")).rowsBetween(Window.unboundedPreceding, -1)
        weighed = rows.select("*", *[F.coalesce(F.product(scale).over(within), F.lit(1.0)).alias(f"_later_{scale}") for scale in folds])
        rows = weighed.groupBy(*group).agg(F.sum("n").alias("n"), *[part for scale, (_, terms) in folds.items() for part in (
            F.product(scale).alias(scale), *[F.sum(F.col(name) * F.col(f"_later_{scale}")).alias(name) for name in terms])])
        if level is not None:
            rows = rows.withColumnRenamed("_bucket", "_at").withColumn("_no", F.lit(0))
    return rows


def affine_fold(events: DataFrame, keys: list[str], factor: Column, term: Column | dict[str, Column], ts: str, order: str,
                bucket: str | tuple[str, ...] = BUCKETS) -> DataFrame:
    """One of ``affine_folds``: ``scale``, ``shift`` (or one column per named term) and ``n`` of each key."""
    return affine_folds(events, keys, {"scale": (factor, term if isinstance(term, dict) else {"shift": term})}, ts, order, bucket)


def ewma(events: DataFrame, keys: list[str], value: Column | dict[str, Column], ts: str, order: str,
         bucket: str | tuple[str, ...] = BUCKETS) -> DataFrame:
    """Moving average that keeps 70 % and takes 30 % of each new value."""
    term = {name: v * fixed.NEW for name, v in value.items()} if isinstance(value, dict) else value * fixed.NEW
    return affine_fold(events, keys, F.lit(fixed.KEEP), term, ts, order, bucket)


def ewma_rates(counts: DataFrame, templates: DataFrame) -> DataFrame:
    """Success and override rate of each template after its corrections (``correction_counts``)."""
    usable = counts.where(F.col("total") > 0)
    folded = ewma(usable, ["template_id"], {"success_shift": F.col("pct_correct"), "override_shift": F.col("pct_overridden")}, "ts", "correction_id")
    return templates.join(folded, "template_id").select(
        "template_id", "n",
        (F.col("success_rate") * F.col("scale") + F.col("success_shift")).alias("success_rate"),
        (F.col("override_rate") * F.col("scale") + F.col("override_shift")).alias("override_rate"))


def _hit() -> Column:
    return F.when(F.col("is_correct"), 100.0).otherwise(0.0)


def _distance_kept() -> Column:
    c = F.col("usage_count").cast("double")
    return F.when(F.col("usage_count") <= 1, 0.0).otherwise((c - 1) / c)


def _distance_new() -> Column:
    d = F.col("distance").cast("double")
    return F.when(F.col("usage_count") <= 1, d).otherwise(d / F.col("usage_count").cast("double"))


def ewma_field_accuracy(compared: DataFrame, starts: DataFrame | None = None, default: float = 50.0) -> DataFrame:
    """Accuracy per template and field after its corrections; an unseen field starts at 50."""
    folded = ewma(compared, ["template_id", "field"], _hit(), "ts", "correction_id")
    if starts is not None:
        folded = folded.join(starts, ["template_id", "field"], "left")
    start = F.coalesce(F.col("start"), F.lit(default)) if starts is not None else F.lit(default)
    return folded.select("template_id", "field", "n", (start * F.col("scale") + F.col("shift")).alias("accuracy"))


def ewma_fields(compared: DataFrame, templates: DataFrame) -> DataFrame:
    """(template_id, field, n, accuracy, edit_distance): ``ewma_field_accuracy`` and ``running_edit_distance`` after the values
    that templates store in ``field_accuracy`` and ``field_edit_distances``, in one fold."""
    rows = affine_folds(compared, ["template_id", "field"], {
        "scale": (F.lit(fixed.KEEP), {"shift": _hit() * fixed.NEW}), "distance_scale": (_distance_kept(), {"distance_shift": _distance_new()})}, "ts", "correction_id")
    for name, column in (("field_accuracy", "start"), ("field_edit_distances", "distance_start")):
        rows = rows.join(templates.select("template_id", F.explode(name).alias("field", column)), ["template_id", "field"], "left")
    return rows.select("template_id", "field", "n", (F.coalesce("start", F.lit(50.0)) * F.col("scale") + F.col("shift")).alias("accuracy"),
                       (F.col("distance_scale") * F.coalesce("distance_start", F.lit(0.0)) + F.col("distance_shift")).alias("edit_distance"))


def confirm_success_rate(templates: DataFrame, confirms: DataFrame) -> DataFrame:
    """Success rate after n confirmations without change: 0 jumps to 100, else 0.7 r + 30.

    Only the first step can see 0, and every step is the same, so a count suffices.
    """
    counts = confirms.groupBy("template_id").agg(F.count("*").alias("n"))
    first = F.when(F.col("success_rate") == 0, 100.0).otherwise(F.col("success_rate") * fixed.KEEP + 30.0)
    rate = 100.0 - (100.0 - first) * F.pow(F.lit(fixed.KEEP), F.col("n") - 1)
    return templates.join(counts, "template_id").select("template_id", "n", rate.alias("success_rate"))


def running_edit_distance(compared: DataFrame, bucket: str | tuple[str, ...] = BUCKETS, starts: DataFrame | None = None) -> DataFrame:
    """Running edit distance per template and field. ``usage_count`` at the time of a
    correction weighs it: up to 1 it replaces the average, else avg (c-1)/c + d/c.
    ``starts`` (template_id, field, start) gives stored averages; others start at 0."""
    folded = affine_fold(compared, ["template_id", "field"], _distance_kept(), _distance_new(), "ts", "correction_id", bucket)
    stored = folded.withColumn("start", F.lit(0.0)) if starts is None else folded.join(starts, ["template_id", "field"], "left")
    return stored.select("template_id", "field", "n", (F.col("scale") * F.coalesce("start", F.lit(0.0)) + F.col("shift")).alias("edit_distance"))


# --- comparing extracted with corrected values ----------------------------------

def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def field_corrected(values: DataFrame) -> DataFrame:
    """Adds ``is_correct`` and ``distance`` to rows of ``extracted`` and ``corrected``.

    A field counts as corrected when a value was given and its similarity to the
    extracted one, without regard to case, is below 85. Fields without a
    corrected value (NULL) are left out.
    """
    present = values.where("corrected is not null").withColumn("extracted", F.coalesce("extracted", F.lit("")))
    score = fuzzy.fuzz_ratio(F.lower("extracted"), F.lower("corrected"))
    return present.withColumn("similarity", score).withColumn(
        "is_correct", ~((F.col("similarity") < fixed.SAME_FIELD_SCORE) & (F.length("corrected") > 0))).withColumn(
        "distance", edit_distance(F.col("extracted"), F.col("corrected")))


def correction_counts(compared: DataFrame) -> DataFrame:
    """Per correction: fields compared, fields correct, shares and number corrected."""
    return compared.groupBy("correction_id", "template_id").agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.max("ts").alias("ts")).withColumns({
            "pct_correct": F.col("correct") / F.col("total") * 100,
            "pct_overridden": (F.col("total") - F.col("correct")) / F.col("total") * 100,
            "n_corrected": F.col("total") - F.col("correct")})


@F.pandas_udf(BooleanType())
def _names_differ(extracted: pd.Series, corrected: pd.Series) -> pd.Series:
    """Whether any pair of names scores below 85."""
    pairs = [(i, (a or "").lower(), (b or "").lower()) for i, (x, y) in enumerate(zip(extracted, corrected))
             if x is not None and y is not None for a, b in zip(x, y)]
    differ = fuzzy.ratios([a for _, a, _ in pairs], [b for _, _, b in pairs]) < fixed.SAME_FIELD_SCORE
    rows = {i for (i, _, _), d in zip(pairs, differ) if d}
    return pd.Series([i in rows for i in range(len(extracted))], dtype="bool")


def zip_items(extracted: Column, corrected: Column) -> Column:
    """Pairs of extracted and corrected items by position, up to the shorter list."""
    n = F.least(F.size(extracted), F.size(corrected))
    return F.zip_with(F.slice(extracted, F.lit(1), n), F.slice(corrected, F.lit(1), n),
                      lambda a, b: F.struct(a.alias("extracted"), b.alias("corrected")))


def items_corrected(extracted: Column, corrected: Column) -> Column:
    """Whether corrected items differ from the extracted ones: another count, a name
    below 85, a quantity off by more than 0.001, a price off by more than 2 %, or
    a number that cannot be read. Never without corrected items."""
    def number(value: Column, default: str) -> Column:
        return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, F.lit(default)).otherwise(value).try_cast("double")

    def numbers_differ(pair: Column) -> Column:
        a, b = pair["extracted"], pair["corrected"]
        quantity = F.abs(number(a["quantity"], "1") - number(b["quantity"], "1")) > 0.001
        x, y = number(a["total_price"], "0"), number(b["total_price"], "0")
        price = F.abs(x - y) / F.greatest(x, y, F.lit(0.01)) * 100 > 2.0
        return F.coalesce(quantity, F.lit(True)) | F.coalesce(price, F.lit(True)) | x.isNull() | y.isNull()

    some = F.coalesce(F.size(corrected) > 0, F.lit(False))
    same_count = F.coalesce(F.size(extracted), F.lit(0)) == F.size(corrected)
    names = _names_differ(F.transform(extracted, lambda i: i["item_name"]), F.transform(corrected, lambda i: i["item_name"]))
    return some & (~same_count | names | F.exists(zip_items(extracted, corrected), numbers_differ))


def needs_new_template(items_differ: Column, n_corrected: Column) -> Column:
    return items_differ | (n_corrected > 1)


def corrections_diff(pairs: DataFrame, fields: list[str], items: tuple[str, str] | None = None) -> DataFrame:
    """Names of the fields a user changed; a missing value counts as ''."""
    def changed(name: str) -> Column:
        before, after = (F.coalesce(F.col(side)[name], F.lit("")) for side in ("extracted", "edited"))
        return F.when(~before.eqNullSafe(after), F.lit(name))

    names = [changed(f) for f in fields]
    if items:
        names.append(F.when(~F.col(items[0]).eqNullSafe(F.col(items[1])), F.lit("cost_items")))
    return pairs.withColumn("changed", F.array_compact(F.array(*names)))


# --- deriving a template from a corrected document ---------------------------------

_LOCATED = ArrayType(StructType([
    StructField("field", StringType()), StructField("value", StringType()), StructField("line", IntegerType()),
    StructField("offset", IntegerType()), StructField("target", IntegerType()), StructField("score", DoubleType()),
    StructField("fuzzy", BooleanType())]))


def _line_scores(pairs: set[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Best of four scores of each value and line; a line that holds the value scores 100."""
    out = {p: 100.0 for p in pairs if p[0] and p[0] in p[1]}
    rest = sorted(pairs - out.keys())
    values, lines = [v for v, _ in rest], [line for _, line in rest]
    scores = [f(values, lines) for f in (fuzzy.ratios, fuzzy.partial_ratios, fuzzy.token_sort_ratios, fuzzy.token_set_ratios)]
    return out | dict(zip(rest, np.maximum.reduce(scores).tolist())) if rest else out


def _searched(field: str, lines, start: int, end: int) -> list[int]:
    """Lines where a field may stand."""
    return list(range(min(end, len(lines), 3))) if field == "merchant_name" else [*range(0, start), *range(end + 1, len(lines))]


def _surely(value: str, line: str) -> bool:
    """Whether the best of the four scores is 100, which needs no common subsequence to tell."""
    if value in line or (line and line in value):
        return True
    left, right = value.split(), line.split()
    a, b = set(left), set(right)
    return sorted(left) == sorted(right) or bool(a and b and (a <= b or b <= a))


def _to_score(field: str, value: str, doc, spots: list[int]) -> list[int]:
    """The lines whose scores decide: just the first that surely has 100, if any, as nothing beats it. An address may take
    a line for its likeness as a whole before, so all of its lines count."""
    sure = None if field == "merchant_address" else next((i for i in spots if _surely(value.lower(), doc[i].lower())), None)
    return spots if sure is None else [sure]


#: Documents whose lines are scored together.
_TOGETHER = 256


@F.pandas_udf(_LOCATED)
def locate_fields(lines: pd.Series, values: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Line of each corrected value of a document: the first best of four scores, above 70. All pairs of some hundred
    documents are scored at once."""
    out = []
    for at in range(0, len(lines), _TOGETHER):
        docs = [(doc, [(f, v, _to_score(f, v, doc, _searched(f, doc, first, last))) for f, v in zip(fixed.FIELDS, given) if v], last)
                for doc, given, first, last in zip(*(x[at:at + _TOGETHER] for x in (lines, values, start, end)))]
        pairs = {(v.lower(), doc[i].lower()) for doc, wanted, _ in docs for _, v, spots in wanted for i in spots}
        scores = _line_scores(pairs)
        whole = sorted({(v.lower(), doc[i].lower()) for doc, wanted, _ in docs for f, v, spots in wanted if f == "merchant_address" for i in spots})
        wholes = dict(zip(whole, fuzzy.ratios([line for _, line in whole], [v for v, _ in whole]).tolist()))
        for doc, wanted, last in docs:
            found = []
            for field, value, spots in wanted:
                best, line_no, offset, is_fuzzy = 0.0, None, None, False
                for i in spots:
                    pair = (value.lower(), doc[i].lower())
                    if scores[pair] > max(best, 70):
                        best = scores[pair]
                        line_no, offset = (-1, i - last) if i > last else (i, None)
                    if field == "merchant_address" and wholes[pair] > max(best, 80):
                        best, line_no, offset, is_fuzzy = wholes[pair], i, None, True
                if line_no is not None:
                    found.append({"field": field, "value": value, "line": line_no, "offset": offset,
                                  "target": line_no if offset is None else last + offset, "score": best, "fuzzy": is_fuzzy})
            out.append(found)
    return pd.Series(out)


@F.pandas_udf(ArrayType(IntegerType()))
def _best_options(values: pd.Series, options: pd.Series) -> pd.Series:
    sizes = [len(v) for v in values]
    picks = iter(fuzzy.best_options([v for vs in values for v in vs], [c for lists in options for c in lists]))
    return pd.Series([[next(picks) for _ in range(n)] for n in sizes])


def _library_values(field: Column, line: Column) -> Column:
    """What each library pattern of a field reads from a line, in library order."""
    return F.coalesce(*[F.when(field == f, F.array(*[library_value(line, p) for p in patterns]))
                        for f, patterns in fixed.FIELD_PATTERNS.items()])


def derive_field_extractors(documents: DataFrame) -> DataFrame:
    """Adds ``section`` and ``derived``, the extractors for a document's corrected values.

    Needs ``lines``, ``cost_items`` and one text column per field. A field is
    placed by line, or by its distance from the last item when it stands below.
    Its pattern is the library pattern that reads the value best, else the
    value itself. All of it happens within the document's row.
    """
    placed = documents.withColumn("section", item_section(F.col("lines"), F.col("cost_items")))
    placed = placed.withColumn("located", locate_fields(
        "lines", F.array(*[F.col(f) for f in fixed.FIELDS]), F.col("section.start"), F.col("section.end")))
    options = F.transform("located", lambda x: _library_values(x["field"], F.get(F.col("lines"), x["target"])))
    picks = placed.withColumn("picks", _best_options(F.transform("located", lambda x: x["value"]), options))
    library = F.create_map(*[part for f, patterns in fixed.FIELD_PATTERNS.items()
                             for part in (F.lit(f), F.array(*[F.lit(p) for p in patterns]))])

    def build(x: Column, pick: Column) -> Column:
        literal = F.concat(F.lit(".*("), regex_escape(x["value"]), F.lit(").*"))
        return F.struct(
            x["field"].alias("field"), F.when(pick >= 0, F.get(library[x["field"]], pick)).otherwise(literal).alias("pattern"),
            x["line"].alias("line"), F.coalesce(x["offset"], F.lit(0)).alias("offset_from_last_item"),
            x["score"].alias("score"), x["fuzzy"].alias("is_fuzzy_haystack"))

    return picks.withColumn("derived", F.zip_with("located", "picks", build)).drop("located", "picks")


def build_template_rows(derived: DataFrame, key: str, carry_item_start: bool = False) -> DataFrame:
    """Template rows of derived extractors: accuracies 80, distances 0, currency GBP.

    The item start line found is dropped in favour of the default of 5 unless
    ``carry_item_start``.
    """
    item_pattern = derive_item_pattern(F.col("section.items"))
    extractors = F.map_from_entries(F.transform("derived", lambda e: F.struct(e["field"], F.struct(
        F.lit(True).alias("expected_present"), F.array(e["pattern"]).alias("patterns"), e["line"].alias("line"),
        e["offset_from_last_item"].alias("offset_from_last_item"),
        e["is_fuzzy_haystack"].alias("is_fuzzy_haystack")).cast(CONFIG_EXTRACTOR))))

    def per_field(value: float) -> Column:
        return F.map_from_entries(F.transform("derived", lambda e: F.struct(e["field"], F.lit(value))))

    first_line = F.get(F.col("section.items"), F.lit(0))["line"].cast("int")
    start = F.coalesce(first_line, F.lit(fixed.DEFAULT_START_LINE)) if carry_item_start else F.lit(fixed.DEFAULT_START_LINE)
    has_items = F.size("section.items") > 0 if carry_item_start else F.lit(True)
    return derived.select(
        key, F.when(truthy(F.col("merchant_name")), F.col("merchant_name")).otherwise(guess_merchant(F.col("lines"))).alias("merchant_name"),
        extractors.alias("field_extractors"),
        F.when(F.size("section.items") > 0, F.array(item_pattern)).otherwise(F.array()).alias("item_patterns"),
        has_items.alias("has_line_items"), start.alias("line_items_start_line"),
        F.struct(F.lit("GBP").alias("iso_code"), F.lit("").alias("symbol")).alias("currency_info"),
        per_field(80.0).alias("field_accuracy"), per_field(0.0).alias("field_edit_distances"),
        F.lit(0).alias("usage_count"), F.lit(80.0).alias("success_rate"), F.lit(0.0).alias("override_rate"),
        F.lit(False).alias("is_archived"))


def template_from_correction(rows: DataFrame, key: str, templates: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """New templates with their lineage: ``sources`` maps the key to a source template id."""
    found = templates.select(F.col("template_id").alias("source_id"), F.col("merchant_name").alias("source_merchant"),
                             F.col("success_rate").alias("source_success"))
    joined = rows.join(sources.select(key, F.col("template_id").alias("source_id")), key, "left").join(found, "source_id", "left")
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    lineage = F.when(F.col("source_id").isNull(), F.create_map().cast("map<string,string>")).when(
        F.col("source_merchant").isNull(), F.create_map(
            F.lit("derived_from_template_id"), F.col("source_id"), F.lit("correction_timestamp"), stamp,
            F.lit("source_template_found"), F.lit("false"))).otherwise(F.create_map(
                F.lit("derived_from_template_id"), F.col("source_id"), F.lit("correction_timestamp"), stamp,
                F.lit("source_template_merchant"), F.col("source_merchant"),
                F.lit("source_template_success_rate"), F.col("source_success").cast("string")))
    new_id = F.concat(F.lit("N"), F.left(F.sha2(F.concat_ws("|", F.col(key), F.col("source_id")), 256), F.lit(16)))
    return joined.withColumn("template_id", new_id).withColumn("metadata", lineage).drop(
        "source_id", "source_merchant", "source_success")


# --- usage, flags and archiving -----------------------------------------------------

def merchant_usage_total(templates: DataFrame) -> DataFrame:
    """Sum of uses per merchant, 0 counted as 1."""
    totals = templates.groupBy("merchant_name").agg(F.sum("usage_count").alias("total"))
    return totals.withColumn("total", F.coalesce(F.nullif("total", F.lit(0)), F.lit(1)))


def recent_usage(templates: DataFrame) -> DataFrame:
    """Usage block of each template; the 30-day count is the total, a known simplification."""
    share = F.when(F.col("total") > 0, F.col("usage_count") / F.col("total") * 100).otherwise(0.0)
    return templates.join(merchant_usage_total(templates), "merchant_name").withColumn("recent_usage", F.struct(
        F.col("usage_count").alias("last_30_days"), F.col("total").alias("total_merchant_uses"),
        share.alias("usage_percentage"))).drop("total")


def map_mean(values: Column) -> Column:
    """Mean of a map's values, 0 when it is empty."""
    numbers = F.map_values(values)
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.coalesce(F.size(numbers), F.lit(0)) > 0, total / F.size(numbers)).otherwise(0.0)


def template_flags(templates: DataFrame, now: Column) -> DataFrame:
    """Five warning flags and their number."""
    idle_days = F.floor((F.unix_seconds(now) - F.unix_seconds(instant("last_used_at"))) / 86400)
    usage = (F.coalesce(F.col("recent_usage.last_30_days"), F.lit(0)) < 3) | (
        F.coalesce(F.col("recent_usage.usage_percentage"), F.lit(0.0)) < 10)
    flagged = templates.withColumns({
        "age_flag": idle_days > 30, "usage_flag": usage, "override_flag": F.col("override_rate") > 40,
        "extraction_flag": map_mean(F.col("field_accuracy")) < 70, "accuracy_flag": F.col("avg_edit_distance") > 5.0})
    return flagged.withColumn("flag_count", flag_count())


def flag_count() -> Column:
    total = F.lit(0)
    for name in fixed.TEMPLATE_FLAGS:
        total = total + F.col(name).cast("int")
    return total


def archive_decision(flagged: DataFrame) -> DataFrame:
    """Whether an active template should be archived, and why."""
    age, usage, override, extraction = (F.col(n) for n in fixed.TEMPLATE_FLAGS[:4])
    decision = (F.col("flag_count") >= 3) | (age & (usage | override | extraction)) | (override & extraction)
    reasons = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in fixed.TEMPLATE_FLAGS]))
    return flagged.where(~F.col("is_archived")).withColumn("should_archive", decision).withColumn("reasons", reasons)


def set_archived(templates: DataFrame, when: Column, archived: bool, now: Column) -> DataFrame:
    """Archive or restore the templates for which ``when`` holds; others keep their state."""
    act = when & (F.col("is_archived") != archived)
    return templates.withColumn("archived_at", F.when(act, now if archived else F.lit(None)).otherwise(F.col("archived_at"))
                                ).withColumn("is_archived", F.when(act, F.lit(archived)).otherwise(F.col("is_archived")))


def resurrect_templates(templates: DataFrame) -> DataFrame:
    """Archived templates with a success rate above 80 become active again."""
    return set_archived(templates, F.col("success_rate") > 80, False, F.lit(None))


def archive_templates(templates: DataFrame, now: Column) -> DataFrame:
    """Flags and decision applied to the whole table."""
    decided = archive_decision(template_flags(templates, now)).select("template_id", "should_archive", "reasons")
    joined = templates.join(decided, "template_id", "left")
    return set_archived(joined, F.coalesce("should_archive", F.lit(False)), True, now).drop("should_archive")


def record_usage(templates: DataFrame, tries: DataFrame) -> DataFrame:
    """Count a use for every candidate tried, not only for the winner."""
    used = tries.groupBy("template_id").agg(F.count("*").alias("uses"), F.max("ts").alias("used_at"))
    return templates.join(used, "template_id", "left").withColumn(
        "usage_count", F.col("usage_count") + F.coalesce("uses", F.lit(0))).withColumn(
        "last_used_at", F.coalesce("used_at", "last_used_at")).drop("uses", "used_at")
