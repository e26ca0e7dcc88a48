"""Statistics, learning, rules, sweeps and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, fuzzy
from ..operators import accounts, extraction as ex, learning, lifecycle, rules
from ..plans import confirm, correct, parse
from ..session import shared_dir
from ..sources.derived import DERIVED, SparkWords, quote
from ..streaming import jobs as streams
from .basics import D_REQUESTS, job_requests
from .registry import Tables, add, d_second, listed, now, second

# --- similarity in DuckDB SQL -------------------------------------------------------------


def d_lcs(a, b):
    """Bit-parallel count of the longest common subsequence; ``a`` up to 120 characters."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    mask = (f"coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, CAST(i AS INT), 1) = c "
            f"THEN 1::HUGEINT << CAST(i - 1 AS INT) ELSE 0::HUGEINT END)), 0)::HUGEINT")
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    fold = f"list_reduce(list_prepend({full}, {masks}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    return f"(length({a}) - bit_count({fold}))"


def d_ratio(a, b):
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0::DOUBLE * {d_lcs(a, b)} / (length({a}) + length({b})) END"


def d_sorted(s):
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: w <> '')), ' ')"


D_PAIRS = "pairs AS (SELECT correction_id, field, ts, lower(coalesce(extracted, '')) AS a, lower(corrected) AS b FROM corrections)"


def pairs(t):
    return t.corrections.select("correction_id", "field", F.lower(F.coalesce("extracted", F.lit(""))).alias("a"), F.lower("corrected").alias("b"))


def score_query(udf):
    return lambda t: pairs(t).select("correction_id", "field", F.round(udf("a", "b"), 6).alias("score"))


add("f5_fuzz_ratio", score_query(fuzzy.fuzz_ratio), ("corrections",), f", {D_PAIRS} SELECT correction_id, field, round({d_ratio('a', 'b')}, 6) AS score FROM pairs")
add("f6_fuzz_partial_ratio", score_query(fuzzy.fuzz_partial_ratio), ("corrections",), f""", {D_PAIRS},
    ordered AS (SELECT correction_id, field, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM pairs),
    windows AS (SELECT correction_id, field, s AS needle, substr(l, CAST(greatest(i, 0) + 1 AS INT), CAST(least(i + length(s), length(l)) - greatest(i, 0) AS INT)) AS w
      FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS i FROM ordered WHERE length(s) > 0)
      UNION ALL SELECT correction_id, field, l, substr(s, CAST(greatest(i, 0) + 1 AS INT), CAST(least(i + length(s), length(l)) - greatest(i, 0) AS INT))
      FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS i FROM ordered WHERE length(s) > 0 AND length(s) = length(l))),
    best AS (SELECT correction_id, field, max({d_ratio('needle', 'w')}) AS score FROM windows GROUP BY 1, 2)
    SELECT o.correction_id, o.field, CASE WHEN length(l) = 0 THEN 100.0::DOUBLE WHEN length(s) = 0 THEN 0.0::DOUBLE ELSE round(score, 6) END AS score
    FROM ordered o LEFT JOIN best b ON b.correction_id = o.correction_id AND b.field = o.field""")
add("f7_fuzz_token_sort_ratio", score_query(fuzzy.fuzz_token_sort_ratio), ("corrections",), f""", {D_PAIRS},
    words AS (SELECT correction_id, field, {d_sorted('a')} AS a, {d_sorted('b')} AS b FROM pairs)
    SELECT correction_id, field, round({d_ratio('a', 'b')}, 6) AS score FROM words""")
TOKENS = "list_distinct(list_filter(regexp_split_to_array({s}, '\\s+'), lambda w: w <> ''))"
add("f8_fuzz_token_set_ratio", score_query(fuzzy.fuzz_token_set_ratio), ("corrections",), f""", {D_PAIRS},
    sets AS (SELECT correction_id, field, {TOKENS.format(s='a')} AS ta, {TOKENS.format(s='b')} AS tb FROM pairs),
    split AS (SELECT *, array_to_string(list_sort(list_filter(ta, lambda w: NOT list_contains(tb, w))), ' ') AS da,
      array_to_string(list_sort(list_filter(tb, lambda w: NOT list_contains(ta, w))), ' ') AS db,
      length(array_to_string(list_intersect(ta, tb), ' ')) AS base FROM sets),
    sized AS (SELECT *, CASE WHEN base > 0 THEN 1 ELSE 0 END AS gap FROM split),
    full_ AS (SELECT *, base + gap + length(da) AS la, base + gap + length(db) AS lb, length(da) + length(db) - 2 * {d_lcs('da', 'db')} AS apart FROM sized)
    SELECT correction_id, field, round(CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 WHEN base > 0 AND (da = '' OR db = '') THEN 100
      ELSE greatest(100 - 100.0::DOUBLE * apart / (la + lb), CASE WHEN base > 0 THEN 100 - 100.0::DOUBLE * (gap + length(da)) / (base + la) ELSE 0 END,
        CASE WHEN base > 0 THEN 100 - 100.0::DOUBLE * (gap + length(db)) / (base + lb) ELSE 0 END) END, 6) AS score FROM full_""")
add("f9_edit_distance", lambda t: t.corrections.select("correction_id", "field", learning.edit_distance(F.col("extracted"), F.col("corrected")).alias("distance")),
    ("corrections",), """SELECT correction_id, field, CAST(levenshtein(coalesce(extracted, ''), coalesce(corrected, '')) AS INT) AS distance FROM corrections""")

# --- comparing and folding -------------------------------------------------------------------


def compared(t):
    """Compared fields; every correction of a template belongs to it as a whole."""
    return learning.field_corrected(t.corrections)


D_COMPARED = f"""lowered AS (SELECT *, lower(coalesce(extracted, '')) AS a, lower(corrected) AS b FROM corrections WHERE corrected IS NOT NULL),
  compared AS (SELECT *, NOT ({d_ratio('a', 'b')} < 85 AND length(corrected) > 0) AS is_correct,
    levenshtein(coalesce(extracted, ''), corrected) AS distance FROM lowered),
  counts AS (SELECT correction_id, template_id, count(*) AS total, count(*) FILTER (is_correct) AS correct, max(ts) AS ts FROM compared GROUP BY 1, 2)"""


def seeded(t):
    """Start values for the templates that the corrections name."""
    return t.corrections.select("template_id").distinct().select(
        "template_id", (F.col("template_id") * 5 % 101).cast("double").alias("success_rate"), F.lit(10.0).alias("override_rate"))


add("l5_field_corrected", lambda t: compared(t).select("correction_id", "field", "is_correct"), ("corrections",),
    f", {D_COMPARED} SELECT correction_id, field, is_correct FROM compared")
add("a5_correction_counts", lambda t: learning.correction_counts(compared(t)).select(
        "correction_id", "total", "correct", F.round("pct_correct", 6).alias("pct_correct"), F.round("pct_overridden", 6).alias("pct_overridden"), "n_corrected"),
    ("corrections",), f""", {D_COMPARED} SELECT correction_id, total, correct, round(100.0::DOUBLE * correct / total, 6) AS pct_correct,
    round(100.0::DOUBLE * (total - correct) / total, 6) AS pct_overridden, total - correct AS n_corrected FROM counts""")
add("w1_ewma_rates", lambda t: learning.ewma_rates(learning.correction_counts(compared(t)), seeded(t)).select(
        "template_id", "n", F.round("success_rate", 6).alias("success_rate"), F.round("override_rate", 6).alias("override_rate")), ("corrections",), f""", {D_COMPARED},
    o AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts DESC, correction_id DESC) - 1 AS back FROM counts)
    SELECT template_id, count(*) AS n,
      round((template_id * 5 % 101) * pow(0.7::DOUBLE, count(*)) + sum(0.3::DOUBLE * 100 * correct / total * pow(0.7::DOUBLE, back)), 6) AS success_rate,
      round(10 * pow(0.7::DOUBLE, count(*)) + sum(0.3::DOUBLE * 100 * (total - correct) / total * pow(0.7::DOUBLE, back)), 6) AS override_rate
    FROM o GROUP BY template_id""")
add("w2_ewma_field_accuracy", lambda t: learning.ewma_field_accuracy(compared(t)).select("template_id", "field", "n", F.round("accuracy", 6).alias("accuracy")),
    ("corrections",), f""", {D_COMPARED}, o AS (SELECT *, row_number() OVER (PARTITION BY template_id, field ORDER BY ts DESC, correction_id DESC) - 1 AS back FROM compared)
    SELECT template_id, field, count(*) AS n, round(50 * pow(0.7::DOUBLE, count(*)) + sum(CASE WHEN is_correct THEN 30.0::DOUBLE ELSE 0 END * pow(0.7::DOUBLE, back)), 6) AS accuracy
    FROM o GROUP BY 1, 2""")
add("w3_confirm_success_rate", lambda t: learning.confirm_success_rate(
        t.templates.select("template_id", F.when(F.col("success_rate") < 60, 0.0).otherwise(F.col("success_rate")).alias("success_rate")),
        t.jobs.where("status = 'confirmed'").select(F.col("template_used").alias("template_id"))).select("template_id", "n", F.round("success_rate", 6).alias("success_rate")),
    ("templates", "jobs"), """, steps AS (SELECT template_id, list_prepend(CASE WHEN success_rate < 60 THEN 0.0::DOUBLE ELSE success_rate END, list(0.0::DOUBLE)) AS l
      FROM templates JOIN jobs ON template_used = template_id AND status = 'confirmed' GROUP BY template_id, success_rate)
    SELECT template_id, CAST(len(l) - 1 AS BIGINT) AS n, round(list_reduce(l, lambda r, x: CASE WHEN r = 0 THEN 100 ELSE r * 0.7::DOUBLE + 30 END), 6) AS success_rate FROM steps""")
add("w4_running_edit_distance", lambda t: learning.running_edit_distance(compared(t)).select("template_id", "field", "n", F.round("edit_distance", 6).alias("edit_distance")),
    ("corrections",), f""", {D_COMPARED}, l AS (SELECT template_id, field, list_prepend({{'c': 1::DOUBLE, 'v': 0::DOUBLE}},
      list({{'c': usage_count::DOUBLE, 'v': distance::DOUBLE}} ORDER BY ts, correction_id)) AS l FROM compared GROUP BY 1, 2)
    SELECT template_id, field, CAST(len(l) - 1 AS BIGINT) AS n, round(list_reduce(l, lambda s, x: {{'c': x.c, 'v': CASE WHEN x.c <= 1 THEN x.v ELSE s.v * (x.c - 1) / x.c + x.v / x.c END}}).v, 6) AS edit_distance FROM l""")
add("w10_job_duration", lambda t: lifecycle.job_duration(t.jobs).select("job_id", F.round("duration_seconds", 6).alias("duration_seconds")), ("jobs",), """
    SELECT job_id, round(CASE WHEN processing_started IS NOT NULL AND processing_completed IS NOT NULL THEN epoch_us(processing_completed) - epoch_us(processing_started)
      WHEN status IN ('completed', 'confirmed', 'failed') AND processing_completed IS NULL THEN epoch_us(updated_at) - epoch_us(created_at) END / 1000000.0::DOUBLE, 6) AS duration_seconds FROM jobs""")
add("w11_latest_job_state", lambda t: lifecycle.latest_job_state(t.job_events).select("job_id", "status", second("updated_at").alias("updated_at"),
        second("processing_started").alias("started"), second("processing_completed").alias("completed")), ("job_events",), f"""
    SELECT job_id, arg_max(status, (ts, event_id)) AS status, {d_second('max(ts)')} AS updated_at,
      {d_second("min(ts) FILTER (status = 'processing')")} AS started, {d_second("max(ts) FILTER (status IN ('completed', 'failed'))")} AS completed
    FROM job_events GROUP BY job_id""")
add("w12_last_login", lambda t: accounts.last_login(t.users, t.events.where("event_type = 'signup'")).select("user_id", second("last_login").alias("last_login")),
    ("users",), f"""SELECT u.user_id, {d_second('max(ts)')} AS last_login FROM users u LEFT JOIN events e ON e.user_id = u.user_id AND event_type = 'signup' GROUP BY 1""")

# --- template statistics ------------------------------------------------------------------------

add("a1_merchant_usage_total", lambda t: learning.merchant_usage_total(t.templates), ("templates",), """
    SELECT merchant_name, CAST(CASE WHEN sum(usage_count) = 0 THEN 1 ELSE sum(usage_count) END AS BIGINT) AS total FROM templates GROUP BY 1""")
add("a2_recent_usage", lambda t: learning.recent_usage(t.templates).select("template_id", "recent_usage.last_30_days", "recent_usage.total_merchant_uses",
        F.round("recent_usage.usage_percentage", 6).alias("usage_percentage")), ("templates",), """
    SELECT template_id, usage_count AS last_30_days, CAST(total AS BIGINT) AS total_merchant_uses, round(100.0::DOUBLE * usage_count / total, 6) AS usage_percentage
    FROM (SELECT *, coalesce(nullif(sum(usage_count) OVER (PARTITION BY merchant_name), 0), 1) AS total FROM templates)""")
MEAN = "CASE WHEN cardinality({m}) > 0 THEN list_avg(map_values({m})) ELSE 0 END"
add("a3_avg_field_accuracy", lambda t: t.templates.select("template_id", F.round(learning.map_mean(F.col("field_accuracy")), 6).alias("accuracy")), ("templates",),
    f"SELECT template_id, round({MEAN.format(m='field_accuracy')}, 6) AS accuracy FROM templates")
add("a4_avg_edit_distance", lambda t: t.templates.select("template_id", F.round(learning.map_mean(F.col("field_edit_distances")), 6).alias("distance")), ("templates",),
    f"SELECT template_id, round({MEAN.format(m='field_edit_distances')}, 6) AS distance FROM templates")
NOW_T = "2001-09-01 00:00:00"
D_FLAGS = f"""flagged AS (SELECT *, date_diff('second', last_used_at, TIMESTAMP '{NOW_T}') // 86400 > 30 AS age_flag,
    recent_usage.last_30_days < 3 OR recent_usage.usage_percentage < 10 AS usage_flag, override_rate > 40 AS override_flag,
    {MEAN.format(m='field_accuracy')} < 70 AS extraction_flag, avg_edit_distance > 5 AS accuracy_flag FROM templates),
  decided AS (SELECT *, age_flag::INT + usage_flag::INT + override_flag::INT + extraction_flag::INT + accuracy_flag::INT AS flag_count FROM flagged)"""
D_ARCHIVE = "(flag_count >= 3 OR (age_flag AND (usage_flag OR override_flag OR extraction_flag)) OR (override_flag AND extraction_flag))"
D_REASONS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {f} THEN '{f}' END" for f in fixed.TEMPLATE_FLAGS) + "], lambda x: x IS NOT NULL), ',')"
add("l10_template_flags", lambda t: learning.template_flags(t.templates, now(NOW_T)).select("template_id", *fixed.TEMPLATE_FLAGS), ("templates",),
    f", {D_FLAGS} SELECT template_id, {', '.join(fixed.TEMPLATE_FLAGS)} FROM decided")
add("a13_flag_count", lambda t: learning.template_flags(t.templates, now(NOW_T)).select("template_id", "flag_count"), ("templates",),
    f", {D_FLAGS} SELECT template_id, flag_count FROM decided")
add("l11_archive_decision", lambda t: learning.archive_decision(learning.template_flags(t.templates, now(NOW_T))).select(
        "template_id", "should_archive", listed("reasons").alias("reasons")), ("templates",),
    f", {D_FLAGS} SELECT template_id, {D_ARCHIVE} AS should_archive, {D_REASONS} AS reasons FROM decided WHERE NOT is_archived")
add("l12_resurrect_templates", lambda t: learning.resurrect_templates(t.templates).select("template_id", "is_archived", second("archived_at").alias("archived_at")),
    ("templates",), f"""SELECT template_id, is_archived AND NOT success_rate > 80 AS is_archived,
    CASE WHEN NOT (is_archived AND success_rate > 80) THEN {d_second('archived_at')} END AS archived_at FROM templates""")
add("l13_record_usage", lambda t: learning.record_usage(t.templates, t.jobs.select(F.col("template_used").alias("template_id"), F.col("created_at").alias("ts"))).select(
        "template_id", "usage_count", second("last_used_at").alias("last_used_at")), ("templates", "jobs"), f"""
    SELECT template_id, t.usage_count + count(job_id) AS usage_count, {d_second('coalesce(max(j.created_at), any_value(t.last_used_at))')} AS last_used_at
    FROM templates t LEFT JOIN jobs j ON template_used = template_id GROUP BY template_id, t.usage_count""")
add("l14_set_archived", lambda t: learning.set_archived(t.templates, F.col("usage_count") % 2 == 0, True, now(NOW_T)).select(
        "template_id", "is_archived", second("archived_at").alias("archived_at")), ("templates",), f"""
    SELECT template_id, is_archived OR usage_count % 2 = 0 AS is_archived,
      CASE WHEN is_archived THEN {d_second('archived_at')} WHEN usage_count % 2 = 0 THEN '{NOW_T}' END AS archived_at FROM templates""")
add("x5_archive_templates", lambda t: learning.archive_templates(t.templates, now(NOW_T)).select("template_id", "is_archived", second("archived_at").alias("archived_at")),
    ("templates",), f""", {D_FLAGS} SELECT template_id, is_archived OR {D_ARCHIVE} AS is_archived,
    CASE WHEN is_archived THEN {d_second('archived_at')} WHEN {D_ARCHIVE} THEN '{NOW_T}' END AS archived_at FROM decided""")

# --- corrected items and new templates -------------------------------------------------------------


def item_pairs(t):
    return t.merge_inputs.select("job_id", F.transform("cost_items", lambda i: F.map_concat(
        F.map_filter(i, lambda k, _: k != "item_name"), F.create_map(F.lit("item_name"), F.upper(i["item_name"])))).alias("extracted_items"),
        F.col("corrected_items").alias("cost_items"))


add("j15_zip_items", lambda t: item_pairs(t).select("job_id", F.posexplode(learning.zip_items(F.col("extracted_items"), F.col("cost_items"))).alias("pos", "p")).select(
        "job_id", "pos", F.col("p.extracted")["item_name"].alias("extracted_name"), F.col("p.corrected")["item_name"].alias("corrected_name")), ("merge_inputs",), """
    SELECT job_id, CAST(k - 1 AS INT) AS pos, upper(cost_items[k]['item_name']) AS extracted_name, corrected_items[k]['item_name'] AS corrected_name
    FROM (SELECT *, unnest(range(1, least(len(cost_items), len(corrected_items)) + 1)) AS k FROM merge_inputs)""")
# The names of a pair differ only in case here, so the SQL needs the counts and numbers alone.
D_ITEMS_DIFFER = "(len(corrected_items) > 0 AND len(cost_items) <> len(corrected_items))"
add("l6_items_corrected", lambda t: item_pairs(t).select("job_id", learning.items_corrected(F.col("extracted_items"), F.col("cost_items")).alias("corrected")),
    ("merge_inputs",), f"SELECT job_id, {D_ITEMS_DIFFER} AS corrected FROM merge_inputs")


def need_new(t):
    """Every job with corrected items; one without corrections has no corrected field."""
    counts = learning.correction_counts(compared(t)).select(F.concat(F.lit("J"), F.lpad(F.col("correction_id").cast("string"), 10, "0")).alias("job_id"), "n_corrected")
    differ = item_pairs(t).select("job_id", learning.items_corrected(F.col("extracted_items"), F.col("cost_items")).alias("differ"))
    n_corrected = F.coalesce("n_corrected", F.lit(0))
    return differ.join(counts, "job_id", "left").select("job_id", learning.needs_new_template(F.col("differ"), n_corrected).alias("is_new"))


add("l7_needs_new_template", need_new, ("corrections", "merge_inputs"), f""", {D_COMPARED}
    SELECT job_id, {D_ITEMS_DIFFER} OR coalesce(total - correct, 0) > 1 AS is_new FROM merge_inputs LEFT JOIN counts ON job_id = 'J' || lpad(CAST(correction_id AS VARCHAR), 10, '0')""")
DIFF_FIELDS = ["merchant_name", "transaction_time", "total_amount", "tax_amount", "currency"]
add("l9_corrections_diff", lambda t: learning.corrections_diff(t.merge_inputs.withColumn("edited", F.col("corrections")), DIFF_FIELDS).select(
        "job_id", listed("changed").alias("changed")), ("merge_inputs",), "SELECT job_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN coalesce(extracted['{f}'], '') <> coalesce(corrections['{f}'], '') THEN '{f}' END" for f in DIFF_FIELDS) + "], lambda x: x IS NOT NULL), ',') AS changed FROM merge_inputs")


def derived_docs(t):
    return learning.derive_field_extractors(ex.with_lines(t.corrected_receipts))


def located(t):
    docs = ex.with_lines(t.corrected_receipts).withColumn("section", ex.item_section(F.col("lines"), F.col("cost_items")))
    spots = learning.locate_fields("lines", F.array(*[F.col(f) for f in fixed.FIELDS]), F.col("section.start"), F.col("section.end"))
    return ex.unnest(docs, ["receipt_id"], spots, ("n", "x")).select("receipt_id", "x.field", "x.target", F.round("x.score", 6).alias("score"))


add("j18_corrected_value_lines", located)
add("l1_derive_field_extractors", lambda t: ex.unnest(derived_docs(t), ["receipt_id"], F.col("derived"), ("n", "e")).select(
        "receipt_id", "e.field", "e.pattern", "e.line", "e.offset_from_last_item"))
add("l3_build_template_rows", lambda t: learning.build_template_rows(derived_docs(t), "receipt_id").select(
        "receipt_id", "merchant_name", F.size("field_extractors").alias("n_extractors"), F.size("item_patterns").alias("n_patterns"), "line_items_start_line", "success_rate"))


def lineage(t):
    rows = learning.build_template_rows(derived_docs(t), "receipt_id")
    sources = t.receipts.select("receipt_id", F.col("template_used").alias("template_id")).where("template_id is not null")
    made = learning.template_from_correction(rows, "receipt_id", t.templates, sources, now("2024-03-01 08:30:00"))
    return made.select("receipt_id", "template_id", F.col("metadata")["source_template_merchant"].alias("source_merchant"), "usage_count")


add("l4_template_from_correction", lineage)


def correction_batch(t):
    """Corrected receipts with the values a template read; every third amount was read wrong."""
    wrong = F.when(F.col("receipt_id") % 3 == 0, F.lit("0.00")).otherwise(F.col("total_amount"))
    other = F.when(F.col("receipt_id") % 6 == 0, F.lit("")).otherwise(F.col("transaction_time"))
    template = t.receipts.select("receipt_id", F.when(F.col("receipt_id") % 10 == 9, "unknown").otherwise(F.col("template_used")).alias("template_id"))
    return t.corrected_receipts.join(template, "receipt_id").select(
        F.col("receipt_id").alias("correction_id"), "template_id", F.timestamp_seconds(F.col("receipt_id") * 60).alias("ts"), "ocr_text",
        F.create_map(F.lit("merchant_name"), "merchant_name", F.lit("transaction_time"), other, F.lit("total_amount"), wrong).alias("extracted"),
        F.create_map(F.lit("merchant_name"), "merchant_name", F.lit("transaction_time"), "transaction_time", F.lit("total_amount"), "total_amount").alias("corrected"),
        F.col("cost_items").alias("extracted_items"), "cost_items")


def applied(t):
    return correct.apply_corrections(correction_batch(t), t.templates, now("2024-03-01 08:30:00"))


D_BATCH = f"""batch AS (SELECT c.*, CASE WHEN c.receipt_id % 10 = 9 THEN 'unknown' ELSE r.template_used END AS template_id FROM corrected_receipts c JOIN receipts r USING (receipt_id)),
  fields AS (SELECT b.*, t.usage_count, unnest(map_keys(t.field_extractors)) AS field FROM batch b JOIN templates t USING (template_id)),
  given AS (SELECT receipt_id, template_id, usage_count, field,
    coalesce(CASE field WHEN 'merchant_name' THEN merchant_name WHEN 'transaction_time' THEN CASE WHEN receipt_id % 6 = 0 THEN '' ELSE transaction_time END
      WHEN 'total_amount' THEN CASE WHEN receipt_id % 3 = 0 THEN '0.00' ELSE total_amount END END, '') AS was,
    coalesce(CASE field WHEN 'merchant_name' THEN merchant_name WHEN 'transaction_time' THEN transaction_time WHEN 'total_amount' THEN total_amount END, '') AS is_ FROM fields),
  lowered AS (SELECT *, lower(was) AS a, lower(is_) AS b FROM given),
  compared AS (SELECT *, NOT (CASE WHEN a = b THEN 100.0 ELSE {d_ratio('a', 'b')} END < 85 AND length(is_) > 0) AS is_correct, levenshtein(was, is_) AS distance FROM lowered),
  counts AS (SELECT receipt_id, template_id, count(*) AS total, count(*) FILTER (is_correct) AS correct FROM compared GROUP BY 1, 2)"""
add("l8_apply_correction", lambda t: applied(t)["outcomes"], ("corrected_receipts", "receipts", "templates"), f""", {D_BATCH}
    SELECT b.receipt_id AS correction_id, b.template_id, t.template_id IS NOT NULL AS success,
      CASE WHEN b.template_id IS NULL THEN 'Original template ID is required' WHEN t.template_id IS NULL THEN 'Original template ' || b.template_id || ' not found' END AS error,
      CASE WHEN t.template_id IS NOT NULL THEN CASE WHEN coalesce(total - correct, 0) > 1 THEN 'created' ELSE 'updated' END END AS template_action
    FROM batch b LEFT JOIN templates t ON t.template_id = b.template_id LEFT JOIN counts c ON c.receipt_id = b.receipt_id""")
# The hair added keeps values that end in 5 from being rounded up by one engine and down by the other.
MAPPED = "array_to_string(list_sort(list_transform(map_entries({m}), lambda e: e.key || '=' || printf('%.4f', e.value + 1e-7))), ',')"
mapped = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"] + F.lit(1e-7))))), ",")
add("l8_updated_templates", lambda t: correct.updated_templates(t.templates, applied(t)).select(
        "template_id", F.round("success_rate", 6).alias("success_rate"), F.round("override_rate", 6).alias("override_rate"),
        mapped("field_accuracy").alias("accuracy"), mapped("field_edit_distances").alias("distances"), F.round("avg_edit_distance", 4).alias("avg_edit_distance")),
    ("corrected_receipts", "receipts", "templates"), f""", {D_BATCH},
    placed AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY receipt_id DESC) - 1 AS back FROM counts),
    rates AS (SELECT template_id, pow(0.7::DOUBLE, count(*)) AS keep, sum(30.0::DOUBLE * correct / total * pow(0.7::DOUBLE, back)) AS up,
      sum(30.0::DOUBLE * (total - correct) / total * pow(0.7::DOUBLE, back)) AS down FROM placed GROUP BY 1),
    folded AS (SELECT c.template_id, field, list_reduce(list_prepend(coalesce(any_value(t.field_accuracy)[field], 50.0::DOUBLE), list(CASE WHEN is_correct THEN 100.0::DOUBLE ELSE 0.0 END ORDER BY receipt_id)),
        lambda r, x: r * 0.7::DOUBLE + x * 0.3::DOUBLE) AS accuracy,
      any_value(c.usage_count) AS uses, list_prepend(coalesce(any_value(t.field_edit_distances)[field], 0.0::DOUBLE), list(distance::DOUBLE ORDER BY receipt_id)) AS ds
      FROM compared c JOIN templates t ON t.template_id = c.template_id GROUP BY c.template_id, field),
    averaged AS (SELECT *, CASE WHEN uses <= 1 THEN ds[len(ds)] ELSE list_reduce(list_transform(ds, lambda d: {{'c': uses::DOUBLE, 'd': d}}),
        lambda r, x: {{'c': x.c, 'd': r.d * (x.c - 1) / x.c + x.d / x.c}}).d END AS distance FROM folded),
    mapped AS (SELECT template_id, map_from_entries(list({{'k': field, 'v': accuracy}})) AS acc, map_from_entries(list({{'k': field, 'v': distance}})) AS dis FROM averaged GROUP BY 1),
    merged AS (SELECT t.template_id, t.avg_edit_distance AS old_avg, m.dis IS NOT NULL AS touched,
      coalesce(success_rate * keep + up, success_rate) AS success_rate, coalesce(override_rate * keep + down, override_rate) AS override_rate,
      CASE WHEN m.acc IS NULL THEN t.field_accuracy ELSE map_concat(t.field_accuracy, m.acc) END AS acc,
      CASE WHEN m.dis IS NULL THEN t.field_edit_distances ELSE map_concat(t.field_edit_distances, m.dis) END AS dis
      FROM templates t LEFT JOIN rates r ON r.template_id = t.template_id LEFT JOIN mapped m ON m.template_id = t.template_id)
    SELECT template_id, round(success_rate, 6) AS success_rate, round(override_rate, 6) AS override_rate, {MAPPED.format(m='acc')} AS accuracy, {MAPPED.format(m='dis')} AS distances,
      round(CASE WHEN touched THEN list_avg(map_values(dis)) ELSE old_avg END, 4) AS avg_edit_distance FROM merged""")
add("l8_new_templates", lambda t: applied(t)["new_templates"].select(
        "correction_id", "template_id", "merchant_name", F.size("field_extractors").alias("n_extractors")))

# --- rules --------------------------------------------------------------------------------------------

DROP = "lambda x: x IS NOT NULL), ',')"
add("v1_check_currency_info", lambda t: t.templates.select("template_id", listed(rules.check_currency_info(F.col("currency_info"))).alias("violations")), ("templates",), f"""
    SELECT template_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(currency_info.iso_code, '^[A-Z]{{3}}$') THEN 'iso_code_format' END,
      CASE WHEN length(currency_info.symbol) > 3 THEN 'symbol_too_long' END], {DROP} AS violations FROM templates""")


def broken_templates(t):
    """Templates with some faults: no position, a pattern that does not compile, a group 0."""
    bad = F.transform_values("field_extractors", lambda k, e: F.struct(
        e["expected_present"].alias("expected_present"),
        F.when((F.col("usage_count") % 5 == 0) & (k == "tax_amount"), F.array(F.lit("(open"))).otherwise(e["patterns"]).alias("patterns"),
        F.when((F.col("usage_count") % 3 == 0) & (k == "merchant_name"), F.lit(None)).otherwise(e["line"]).alias("line"),
        F.when((F.col("usage_count") % 3 == 0) & (k == "merchant_name"), F.lit(None)).otherwise(e["offset_from_last_item"]).alias("offset_from_last_item"),
        e["is_fuzzy_haystack"].alias("is_fuzzy_haystack")))
    items = F.transform("item_patterns", lambda p: F.struct(
        F.when(F.col("usage_count") % 7 == 0, F.lit("[a-")).otherwise(p["pattern"]).alias("pattern"),
        F.when(F.col("usage_count") % 2 == 0, F.transform_values(p["groups"], lambda k, v: v - 1)).otherwise(p["groups"]).alias("groups")))
    return t.templates.withColumn("field_extractors", bad).withColumn("item_patterns", items)


add("v2_check_extractors", lambda t: rules.check_extractors(broken_templates(t)).select("template_id", listed("violations").alias("violations")), ("templates",), f"""
    SELECT template_id, array_to_string(list_filter([CASE WHEN usage_count % 3 = 0 THEN 'merchant_name:position_missing' END,
      CASE WHEN usage_count % 5 = 0 AND map_contains(field_extractors, 'tax_amount') THEN 'pattern_invalid' END], {DROP} AS violations FROM templates""")
add("v3_check_item_patterns", lambda t: rules.check_item_patterns(broken_templates(t)).select("template_id", listed("violations").alias("violations")), ("templates",), f"""
    SELECT template_id, array_to_string(list_filter([CASE WHEN usage_count % 2 = 0 THEN 'group_index' END,
      CASE WHEN usage_count % 7 = 0 THEN 'pattern_invalid' END], {DROP} AS violations FROM templates""")
OFFEND = "array_to_string(list_sort(list_transform(list_filter(map_entries({m}), lambda e: {bad}), lambda e: e.key)), ',')"
add("v4_check_field_accuracy", lambda t: t.templates.select("template_id", listed(rules.check_field_accuracy(F.col("field_accuracy"))).alias("violations")), ("templates",),
    f"SELECT template_id, {OFFEND.format(m='field_accuracy', bad='e.value < 0 OR e.value > 100')} AS violations FROM templates")
add("v5_check_edit_distances", lambda t: t.templates.select("template_id", listed(rules.check_edit_distances(F.col("field_edit_distances"))).alias("violations")), ("templates",),
    f"SELECT template_id, {OFFEND.format(m='field_edit_distances', bad='e.value < 0')} AS violations FROM templates")
add("v6_check_recent_usage", lambda t: t.templates.select("template_id", listed(rules.check_recent_usage(F.col("recent_usage"))).alias("violations")), ("templates",), """
    SELECT template_id, CASE WHEN recent_usage.usage_percentage NOT BETWEEN 0 AND 100 THEN 'usage_percentage' ELSE '' END AS violations FROM templates""")


def receipt_edits(t):
    """Two of three receipts exist already; some edits change the file or its type."""
    rows = t.receipts.select("receipt_id", F.when(F.col("receipt_id") % 5 != 0, F.concat(F.lit("f"), "reference_number")).alias("file_ref"),
                             F.when(F.col("receipt_id") % 7 == 0, "exe").otherwise("pdf").alias("file_ext"), F.col("upload_date"))
    old = t.receipts.where("receipt_id % 3 <> 0").select("receipt_id", F.concat(F.lit("f"), "reference_number").alias("file_ref"), F.lit("pdf").alias("file_ext"), "upload_date")
    return rules.check_receipt(rows, old)


add("v7_check_receipt", lambda t: receipt_edits(t).select("receipt_id", listed("violations").alias("violations")), ("receipts",), f"""
    SELECT receipt_id, CASE WHEN receipt_id % 3 <> 0 THEN CASE WHEN receipt_id % 7 = 0 THEN 'file_ext_changed' ELSE '' END
      ELSE array_to_string(list_filter([CASE WHEN receipt_id % 5 = 0 THEN 'file_ref_missing' END, CASE WHEN receipt_id % 7 = 0 THEN 'file_type' END], {DROP} END AS violations FROM receipts""")
add("v8_check_cost_item", lambda t: t.merge_inputs.select("job_id", F.posexplode("cost_items").alias("pos", "i")).select(
        "job_id", "pos", listed(rules.check_cost_item(F.struct(F.col("i")["item_name"].alias("item_name"), F.col("i")["total_price"].alias("total_price"),
                                                             F.col("i")["unit_price"].alias("unit_price")))).alias("violations")), ("merge_inputs",), """
    SELECT job_id, CAST(pos - 1 AS INT) AS pos, CASE WHEN i['total_price'] IS NULL AND i['unit_price'] IS NULL THEN 'price_missing' ELSE '' END AS violations
    FROM (SELECT job_id, unnest(cost_items) AS i, generate_subscripts(cost_items, 1) AS pos FROM merge_inputs)""")
NUMBER = "^\\s*[+-]?(\\d{1,8}(\\.\\d{0,2})?|\\.\\d{1,2})\\s*$"
add("v9_check_corrections", lambda t: t.merge_inputs.select("job_id", listed(rules.check_corrections(F.map_concat(
        F.map_filter("corrections", lambda k, _: k != "currency"), F.create_map(F.lit("currency"), F.concat("user_id", F.lit("EU")))))).alias("violations")), ("merge_inputs",), f"""
    SELECT job_id, array_to_string(list_filter([CASE WHEN length(user_id || 'EU') > 3 THEN 'currency' END,
      CASE WHEN corrections['total_amount'] IS NOT NULL AND NOT regexp_matches(corrections['total_amount'], {quote(NUMBER)}) THEN 'total_amount' END,
      CASE WHEN corrections['tax_amount'] IS NOT NULL AND NOT regexp_matches(corrections['tax_amount'], {quote(NUMBER)}) THEN 'tax_amount' END], {DROP} AS violations FROM merge_inputs""")

# --- sweeps ----------------------------------------------------------------------------------------------

SWEEP = "2024-01-18 12:00:00"
D_SWEEP = f"""swept AS (SELECT f.job_id, path, CASE WHEN j.job_id IS NULL THEN 'orphaned' WHEN CASE WHEN stamp IS NOT NULL THEN TIMESTAMP '{SWEEP}' > stamp
      ELSE modified_at < TIMESTAMP '{SWEEP}' - INTERVAL 7 DAYS END THEN 'expired' ELSE 'active' END AS planned, length % 11 = 0 AS stuck,
      CASE WHEN planned <> 'active' AND stuck THEN 'error' ELSE planned END AS action, status, stamp
    FROM landing_files f LEFT JOIN (SELECT *, try_strptime(metadata['temp_expiration'], '%Y-%m-%dT%H:%M:%S') AS stamp FROM jobs WHERE status NOT IN ('confirmed', 'discarded')) j
      ON j.job_id = f.job_id)"""


def swept(t):
    """Files whose length is a multiple of eleven can't be removed."""
    return lifecycle.sweep_temp_files(t.jobs, t.landing_files, now(SWEEP), stuck=t.landing_files.where("length % 11 = 0").select("path"))


add("x1_sweep_temp_files", swept, ("jobs", "landing_files"), f""", {D_SWEEP}
    SELECT job_id, path, action, CASE WHEN action = 'expired' AND status <> 'failed' THEN 'abandoned' ELSE status END AS new_status,
      CASE WHEN action = 'expired' AND status <> 'failed' THEN '{SWEEP.replace(' ', 'T')}' END AS abandoned_at,
      CASE WHEN action = 'expired' THEN CASE WHEN stamp IS NOT NULL THEN 'Temporary file expired' ELSE 'Temporary file expired (7-day fallback)' END END AS error_message FROM swept""")
add("a6_sweep_report", lambda t: lifecycle.sweep_report(swept(t), ["expired", "active", "orphaned", "error"]),
    ("jobs", "landing_files"), f""", {D_SWEEP} SELECT count(*) FILTER (action = 'expired') AS expired_count, count(*) FILTER (action = 'active') AS active_count,
    count(*) FILTER (action = 'orphaned') AS orphaned_count, count(*) FILTER (action = 'error') AS error_count FROM swept""")
add("x2_stamp_expiry", lambda t: t.jobs.select("job_id", lifecycle.stamp_expiry(F.col("metadata"), F.col("created_at")).alias("m")).select(
        "job_id", F.size("m").alias("n_keys"), F.col("m")["temp_expiration"].alias("expires")), ("jobs",), """
    SELECT job_id, CAST(CASE WHEN map_contains(metadata, 'temp_expiration') THEN cardinality(metadata) ELSE cardinality(metadata) + 1 END AS INT) AS n_keys,
      strftime(created_at + INTERVAL 4 HOURS, '%Y-%m-%dT%H:%M:%S') AS expires FROM jobs""")
LATER = "2024-04-15 00:00:00"
add("x3_purge_old_jobs", lambda t: lifecycle.purge_old_jobs(t.jobs, now(LATER)).select("job_id", "status", "action"), ("jobs",), f"""
    SELECT job_id, status, CASE WHEN status IN ('completed', 'confirmed', 'failed', 'discarded') AND created_at < TIMESTAMP '{LATER}' - INTERVAL 90 DAYS
      THEN 'deleted' ELSE 'kept' END AS action FROM jobs""")
add("x4_purge_archived_templates", lambda t: lifecycle.purge_archived_templates(t.templates, now("2001-12-01 00:00:00")).select("template_id", "action"), ("templates",), """
    SELECT template_id, CASE WHEN is_archived AND updated_at < TIMESTAMP '2001-12-01 00:00:00' - INTERVAL 60 DAYS THEN 'deleted' ELSE 'kept' END AS action FROM templates""")
add("x6_purge_expired_tokens", lambda t: lifecycle.purge_expired_tokens(t.tokens, now(SWEEP)).select("token_jti", "action"), ("tokens",), f"""
    SELECT token_jti, CASE WHEN expires_at < TIMESTAMP '{SWEEP}' THEN 'deleted' ELSE 'kept' END AS action FROM tokens""")
add("a14_count_where", lambda t: lifecycle.count_where(t.tokens, F.col("expires_at") < now(SWEEP)), ("tokens",),
    f"SELECT count(*) AS n FROM tokens WHERE expires_at < TIMESTAMP '{SWEEP}'")


add("x8_confirm_jobs", lambda t: lifecycle.confirm_jobs(job_requests(t), t.jobs, now(SWEEP)).select(
        "job_id", "requester", "outcome", "new_status", F.col("metadata")["confirmed_at"].alias("confirmed_at")), ("jobs",), f""", {D_REQUESTS}
    SELECT r.job_id, requester, CASE WHEN j.job_id IS NULL THEN 'not_found' WHEN status <> 'completed' THEN 'not_completed' WHEN user_id <> requester THEN 'forbidden' ELSE 'confirmed' END AS outcome,
      CASE WHEN status = 'completed' AND user_id = requester THEN 'confirmed' ELSE status END AS new_status,
      CASE WHEN status = 'completed' AND user_id = requester THEN '2024-01-18T12:00:00' END AS confirmed_at
    FROM requests r LEFT JOIN jobs j ON j.job_id = r.job_id""")
add("x9_discard_jobs", lambda t: lifecycle.discard_jobs(job_requests(t), t.jobs, now(SWEEP)).select(
        "job_id", "requester", "outcome", "new_status", F.coalesce("drop_file", F.lit(False)).alias("drop_file")), ("jobs",), f""", {D_REQUESTS}
    SELECT r.job_id, requester, CASE WHEN j.job_id IS NULL THEN 'not_found' WHEN user_id <> requester THEN 'forbidden' ELSE 'discarded' END AS outcome,
      CASE WHEN user_id = requester THEN 'discarded' ELSE status END AS new_status, coalesce(user_id = requester AND status <> 'confirmed', false) AS drop_file
    FROM requests r LEFT JOIN jobs j ON j.job_id = r.job_id""")
def d_once(table, number):
    """(job_id, s): seconds of the requests that count, by walking each job's seconds in order; f is the first request of a second."""
    return f"""firsts AS (SELECT job_id, epoch_us(ts) // 1000000 AS s, min((ts, {number})) AS f FROM {table} GROUP BY 1, 2),
    walks AS (SELECT job_id, list_prepend([]::BIGINT[], list([s] ORDER BY s)) AS w FROM firsts GROUP BY 1),
    starts AS (SELECT job_id, unnest(list_reduce(w, lambda acc, x: CASE WHEN len(acc) = 0 OR x[1] - acc[-1] >= 3600 THEN list_concat(acc, x) ELSE acc END)) AS s FROM walks)"""


add("x10_once_per_job", lambda t: lifecycle.once_per_job(t.job_events).select("job_id", "event_id", second("ts").alias("ts")), ("job_events",), f""", {d_once('job_events', 'event_id')}
    SELECT job_id, f[2] AS event_id, {d_second('f[1]')} AS ts FROM starts JOIN firsts USING (job_id, s)""")



def confirmations(t):
    """Two requests for every job of the first users, half an hour apart, some by a stranger, some with corrections."""
    times = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("created_at").cast("timestamp") + F.expr(f"INTERVAL {60 + 1800 * k} SECONDS")).alias("ts")) for k in range(2)])
    rows = t.jobs.select("job_id", "user_id", F.substring("job_id", 2, 10).cast("long").alias("n"), F.explode(times).alias("r"))
    return rows.select(
        (F.col("n") * 2 + F.col("r.k")).alias("request_id"), "job_id",
        F.when((F.col("n") % 7 == 0) & (F.col("r.k") == 0), "nobody").otherwise(F.col("user_id")).alias("requester"), F.col("r.ts").alias("ts"),
        F.when(F.col("n") % 2 == 0, F.create_map(F.lit("category"), F.lit("food"))).alias("corrections"))


def confirmed(t):
    """Outcome, state and what else a confirmation leaves, one row per request."""
    inputs = t.merge_inputs.withColumn("items", F.col("corrected_items"))
    files = t.jobs.where("substring(job_id, 11, 1) <> '3'").select(
        "job_id", F.concat(F.lit("jobs/"), "job_id").alias("path"), F.lit(b"x").alias("content"), F.lit(1).alias("length"), F.col("created_at").alias("modified_at"))
    done = confirm.confirm(confirmations(t), t.jobs, files, t.templates, inputs, now(LATER))
    receipt = done["receipts"].select("job_id", "merchant_name", F.lit(True).alias("has_receipt"))
    out = done["outcomes"].join(done["jobs"].select("job_id", "status", F.col("metadata")["confirmed_at"].alias("confirmed_at")), "job_id")
    out = out.join(receipt, "job_id", "left").join(done["learn"].select("request_id", F.lit(True).alias("learns")), "request_id", "left")
    return out.select("request_id", "job_id", "outcome", "status", "confirmed_at", "merchant_name", F.coalesce("learns", F.lit(False)).alias("learns"))


D_CONFIRM = """, asked AS (SELECT job_id, user_id, status, template_used, n, k, n * 2 + k AS request_id, CASE WHEN n % 7 = 0 AND k = 0 THEN 'nobody' ELSE user_id END AS requester
      FROM (SELECT *, CAST(substr(job_id, 2, 10) AS BIGINT) AS n FROM jobs), (SELECT unnest([0, 1]) AS k)),
    judged AS (SELECT *, CASE WHEN status <> 'completed' THEN 'not_completed' WHEN requester <> user_id THEN 'forbidden' ELSE 'able' END AS verdict,
      substr(job_id, 11, 1) <> '3' AS has_file FROM asked)"""
add("x8_confirm_plan", confirmed, ("jobs", "merge_inputs"), f"""{D_CONFIRM},
    firsts AS (SELECT job_id, min(request_id) AS first FROM judged WHERE verdict = 'able' GROUP BY 1),
    merged AS (SELECT job_id, map_concat(extracted, descriptions, corrections)['merchant_name'] AS m FROM merge_inputs)
    SELECT request_id, j.job_id, CASE WHEN verdict <> 'able' THEN verdict WHEN NOT has_file THEN 'file_missing' WHEN request_id = first THEN 'confirmed' ELSE 'not_completed' END AS outcome,
      CASE WHEN first IS NOT NULL AND has_file THEN 'confirmed' ELSE status END AS status, CASE WHEN first IS NOT NULL AND has_file THEN '{LATER.replace(' ', 'T')}' END AS confirmed_at,
      CASE WHEN first IS NOT NULL AND has_file THEN coalesce(m, 'Unknown Merchant') END AS merchant_name, verdict = 'able' AND n % 2 = 0 AND request_id = first AS learns
    FROM judged j LEFT JOIN firsts f ON f.job_id = j.job_id LEFT JOIN merged g ON g.job_id = j.job_id""")
add("x8_confirm_rates", lambda t: confirm.confirm(
        confirmations(t), t.jobs, t.jobs.select("job_id", F.lit("p").alias("path"), F.lit(b"x").alias("content"), F.lit(1).alias("length"), F.col("created_at").alias("modified_at")), t.templates,
        t.merge_inputs.withColumn("items", F.col("corrected_items")), now(LATER))["rates"].select("template_id", "n", F.round("success_rate", 6).alias("success_rate")),
    ("jobs", "templates"), f"""{D_CONFIRM},
    used AS (SELECT template_used AS template_id, count(DISTINCT job_id) AS n FROM judged WHERE verdict = 'able' AND n % 2 <> 0 GROUP BY 1)
    SELECT t.template_id, u.n, round(100 - (100 - (CASE WHEN success_rate = 0 THEN 100 ELSE success_rate * 0.7::DOUBLE + 30 END)) * pow(0.7::DOUBLE, u.n - 1), 6) AS success_rate
    FROM templates t JOIN used u ON u.template_id = t.template_id""")

# --- streams ---------------------------------------------------------------------------------------------


class _StreamWords(SparkWords):
    """Derived tables over a stream of events."""

    def table(self, name):
        return "ledgerlift_events_stream" if name == "events" else super().table(name)


def event_stream(t: Tables, name: str):
    events = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    events.createOrReplaceTempView("ledgerlift_events_stream")
    return t.spark.sql(DERIVED[name][1](_StreamWords(t.sf_dir)))


def streamed_receipts(t):
    """Receipts written to a landing folder and parsed from there as a stream."""
    path = shared_dir(t.spark, "landing")
    t.noisy_receipts.write.parquet(path)
    source = t.spark.readStream.schema("receipt_id long, ocr_text string").parquet(path)
    templates = t.templates

    def work(batch):
        return parse.parse_receipts(batch, templates, misreads="units").select(
            "receipt_id", "template_id", F.round("correspondence", 6).alias("correspondence"), F.col("fields")["total_amount"].alias("total_amount"))

    return streams.stream_receipts(source, work).drop("batch")


add("r1_stream_receipts", streamed_receipts)
add("r2_stream_dedup_corrections", lambda t: streams.run_to_table(
        streams.dedup_corrections(event_stream(t, "corrections"), order="correction_id"), "dedup", rocksdb=True).select(
        "job_id", "correction_id", second("ts").alias("ts")), ("corrections",), f""", {d_once('corrections', 'correction_id')}
    SELECT job_id, f[2] AS correction_id, {d_second('f[1]')} AS ts FROM starts JOIN firsts USING (job_id, s)
    WHERE (s + 1) * 1000 <= (SELECT max(epoch_ms(ts)) FROM corrections) - 3600000""")
add("r3_stream_job_expiry", lambda t: streams.run_to_table(streams.stream_job_expiry(event_stream(t, "job_events")), "expiry").select(
        "job_id", "status", second("expired_at").alias("expired_at")), ("job_events",), f"""
    , firsts AS (SELECT job_id, min(epoch_ms(ts)) AS first FROM job_events GROUP BY 1),
    closed AS (SELECT DISTINCT job_id FROM job_events JOIN firsts USING (job_id) WHERE status IN ('confirmed', 'discarded') AND epoch_ms(ts) <= first + 14400000)
    SELECT job_id, 'abandoned' AS status, {d_second('make_timestamp((first + 14400000) * 1000)')} AS expired_at FROM firsts
    WHERE job_id NOT IN (SELECT job_id FROM closed) AND first + 14400000 < (SELECT max(epoch_ms(ts)) FROM job_events) - 3600000""")


def streamed_stats(t):
    steps = streams.stream_template_stats(event_stream(t, "corrections"), learning.field_corrected)
    return seeded(t).join(steps, "template_id").select(
        "template_id", "n", F.round(F.col("success_rate") * F.col("scale") + F.col("success_shift"), 6).alias("success_rate"),
        F.round(F.col("override_rate") * F.col("scale") + F.col("override_shift"), 6).alias("override_rate"))


add("r4_stream_template_stats", streamed_stats, ("corrections",), f""", {D_COMPARED},
    o AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts DESC, correction_id DESC) - 1 AS back FROM counts)
    SELECT template_id, count(*) AS n, round((template_id * 5 % 101) * pow(0.7::DOUBLE, count(*)) + sum(0.3::DOUBLE * 100 * correct / total * pow(0.7::DOUBLE, back)), 6) AS success_rate,
      round(10 * pow(0.7::DOUBLE, count(*)) + sum(0.3::DOUBLE * 100 * (total - correct) / total * pow(0.7::DOUBLE, back)), 6) AS override_rate
    FROM o GROUP BY template_id""")
