"""Cleaning, extraction, matching of documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import expr, fixed, text as tx
from ..operators import extraction as ex, matching, receipts
from ..plans import parse
from ..sources.derived import TEMPLATE_EXTRACTORS, TEMPLATE_ITEM_PATTERN, quote
from .registry import add, now

# --- DuckDB text pieces ---------------------------------------------------------------

NL = "chr(10)"


def d_strip(s):
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def d_fix(s, unit_only=False):
    out = d_strip(s)
    rules = [("(\\d+)m1", "\\1ml")] + ([] if unit_only else [("(\\d+)1", "\\1l")]) + [("\\s{2,}", " "), ("^\\s+", ""), ("\\s+$", "")]
    for pat, rep in rules:
        out = f"regexp_replace({out}, '{pat}', '{rep}', 'g')"
    return out


REPEATED = "^(?:" + "|".join(("\\" + c if c in "^$*()+?.|\\" else c) + "{4,}" for c in "-_.,:;!@#$%^&*()+=~`<>?/\\|") + ")$"
NOISE = [fixed.NOISE_SPACED, REPEATED, *fixed.NOISE_SHAPES]


def d_noise(s):
    shapes = " OR ".join(f"regexp_matches({s}, {quote(p)})" for p in NOISE)
    return (f"(length({s}) < 2 OR {shapes} OR length(regexp_replace({s}, '[a-zA-Z0-9\\s£$€]', '', 'g')) > length({s}) * CAST(0.4 AS DOUBLE)"
            f" OR (length(regexp_replace({s}, '[^a-zA-Z0-9]', '', 'g')) < 2 AND length({s}) > 3))")


def d_trim(s):
    return f"regexp_replace({s}, {quote(fixed.EDGE_TRIM)}, '\\1')"


def d_continues(s):
    shapes = " OR ".join(f"regexp_matches({d_strip(s)}, {quote('(?i)' + p)})" for p in fixed.NOT_CONTINUATION)
    return f"(length({d_strip(s)}) > 2 AND NOT ({shapes}))"


def d_clean(source, key):
    """Fixed, kept and trimmed lines of a text table."""
    return f"""fixed AS (SELECT {key}, pos, {d_fix('line')} AS line FROM (
        SELECT {key}, unnest(string_split({source[1]}, {NL})) AS line, generate_subscripts(string_split({source[1]}, {NL}), 1) AS pos FROM {source[0]})),
      kept AS (SELECT {key}, pos, {d_trim('line')} AS line FROM fixed WHERE NOT {d_noise('line')})"""


def d_lines(table, name="lines"):
    return f"""{name} AS (SELECT receipt_id, CAST(pos - 1 AS INT) AS pos, line FROM (SELECT receipt_id,
        unnest(string_split({d_strip('ocr_text')}, {NL})) AS line,
        generate_subscripts(string_split({d_strip('ocr_text')}, {NL}), 1) AS pos FROM {table}))"""


# --- cleaning ----------------------------------------------------------------------------

add("s9_ocr_lines", lambda t: ex.ocr_lines(t.noisy_receipts, "receipt_id"), ("noisy_receipts",),
    f", {d_lines('noisy_receipts')} SELECT receipt_id, pos, line FROM lines")
add("f1_fix_misreads", lambda t: t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select(
        "doc_id", "pos", tx.fix_misreads(F.col("raw")).alias("line")),
    (), f"""SELECT doc_id, CAST(pos - 1 AS INT) AS pos, {d_fix('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS line,
        generate_subscripts(string_split(text, {NL}), 1) AS pos FROM documents)""")
add("f2_is_noise_line", lambda t: t.noisy_receipts.select("receipt_id", F.posexplode(F.split("ocr_text", "\n")).alias("pos", "raw")).withColumn(
        "line", tx.fix_misreads(F.col("raw"))).select("receipt_id", "pos", "line", tx.is_noise_line(F.col("line")).alias("is_noise")),
    ("noisy_receipts",), f""", {d_clean(('noisy_receipts', 'ocr_text'), 'receipt_id')}
    SELECT receipt_id, CAST(pos - 1 AS INT) AS pos, line, {d_noise('line')} AS is_noise FROM fixed""")
add("f3_trim_line_edges", lambda t: t.pages.select("page_id", F.posexplode(F.split("html", ">")).alias("pos", "raw")).select(
        "page_id", "pos", tx.trim_line_edges(F.col("raw")).alias("line")),
    (), f"""SELECT page_id, CAST(pos - 1 AS INT) AS pos, {d_trim('line')} AS line FROM (SELECT page_id, unnest(string_split(html, '>')) AS line,
        generate_subscripts(string_split(html, '>'), 1) AS pos FROM pages)""")
add("f4_preprocess_text", lambda t: t.documents.select("doc_id", tx.preprocess_text(F.col("text")).alias("clean_text")),
    (), f"""WITH {d_clean(('documents', 'text'), 'doc_id')} SELECT d.doc_id, coalesce(string_agg(line, {NL} ORDER BY pos), '') AS clean_text
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id""")
D_CURRENCY = f"""signs AS (SELECT doc_id, s, count(*) AS n, min(pos) AS first FROM (
    SELECT doc_id, unnest(list_x) AS s, generate_subscripts(list_x, 1) AS pos FROM (
      SELECT doc_id, regexp_extract_all(replace(text, {NL}, ''), '\\p{{Sc}}') AS list_x FROM documents)) GROUP BY ALL),
  top AS (SELECT doc_id, s FROM signs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)"""
add("a8_detect_currency", lambda t: t.documents.select("doc_id", tx.detect_currency(tx.lines_of(F.col("text"))).alias("c")).select(
        "doc_id", "c.code", "c.symbol"), (), f"""WITH {D_CURRENCY} SELECT d.doc_id, CASE WHEN s IS NULL THEN 'GBP' ELSE 'N/A' END AS code,
    coalesce(s, '') AS symbol FROM documents d LEFT JOIN top ON top.doc_id = d.doc_id""")
add("e2_currency_to_iso", lambda t: t.documents.select("doc_id", tx.detect_currency(tx.lines_of(F.col("text"))).alias("c")).select(
        "doc_id", receipts.currency_to_iso(F.col("c.symbol")).alias("iso")), (), f"""WITH {D_CURRENCY}
    SELECT d.doc_id, CASE s WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' END AS iso FROM documents d LEFT JOIN top ON top.doc_id = d.doc_id""")
HEADS = f"list_transform(string_split({d_strip('text')}, {NL})[1:3], lambda x: {d_strip('x')})"
add("f10_guess_merchant", lambda t: t.documents.select("doc_id", tx.guess_merchant(tx.lines_of(F.col("text"))).alias("merchant")),
    (), f"""SELECT doc_id, coalesce(list_filter({HEADS}, lambda x: length(x) > 0 AND length(x) < 50)[1], 'Unknown Merchant') AS merchant FROM documents""")
add("f19_is_continuation", lambda t: ex.ocr_lines(t.noisy_receipts, "receipt_id").select(
        "receipt_id", "pos", tx.is_continuation(F.col("line")).alias("continues")),
    ("noisy_receipts",), f", {d_lines('noisy_receipts')} SELECT receipt_id, pos, {d_continues('line')} AS continues FROM lines")

# --- pattern libraries ----------------------------------------------------------------------

LIBRARY = [(f, i, p) for f, patterns in fixed.FIELD_PATTERNS.items() for i, p in enumerate(patterns)]


def library_hits(t):
    """What every library pattern of every field reads from every line, summed up per pattern."""
    # a number in front of the value stands for the pattern until all are summed up
    reads = F.array_compact(F.array(*[F.concat(F.lit(f"{n:03d}"), tx.library_value(F.col("line"), p)) for n, (_, _, p) in enumerate(LIBRARY)]))
    rows = ex.ocr_lines(t.ocr_receipts, "receipt_id").select(F.explode(reads).alias("r"))
    value = F.substring("r", 4, 2**31 - 1)
    sums = rows.groupBy(F.substring("r", 1, 3).cast("int").alias("at")).agg(
        F.count("*").alias("n"), F.sum(F.length(value)).alias("chars"), F.min(value).alias("first_value"), F.max(value).alias("last_value"))
    named = F.get(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("ord")) for f, i, _ in LIBRARY]), F.col("at"))
    return sums.select(named["field"].alias("field"), named["ord"].alias("ord"), "n", "chars", "first_value", "last_value")


D_LIBRARY = " UNION ALL ".join(
    f"SELECT {quote(f)} AS field, {i} AS ord, regexp_extract(line, {quote(p.replace('(?=' + chr(92) + 'n|$)', '$'))}, 1) AS value FROM lines "
    f"WHERE regexp_matches(line, {quote(p.replace('(?=' + chr(92) + 'n|$)', '$'))})" for f, i, p in LIBRARY)
add("f12_field_pattern_library", library_hits, ("ocr_receipts",), f""", {d_lines('ocr_receipts')}, hits AS ({D_LIBRARY})
    SELECT field, CAST(ord AS INT) AS ord, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars, min(value) AS first_value, max(value) AS last_value
    FROM hits GROUP BY 1, 2""")
AMOUNT, WIDE = r"(\d+\.\d{2})", r"(?:£)?\s*(\d+\.\d{2})"
add("f13_currency_aware_pattern", lambda t: t.templates.select("template_id", F.explode("field_extractors").alias("field", "e")).select(
        "template_id", "field", F.posexplode(tx.currency_aware(F.col("e.patterns"), F.lit("£"))).alias("ord", "pattern")).where(
        F.col("field").isin(*fixed.MONEY_FIELDS)), ("templates",), f"""
    , e AS (SELECT template_id, unnest(map_entries(field_extractors)) AS e FROM templates),
    p AS (SELECT template_id, e.key AS field, list_concat(
        list_transform(list_filter(e.value.patterns, lambda p: contains(p, {quote(AMOUNT[1:-1])})), lambda p: replace(p, {quote(AMOUNT)}, {quote(WIDE)})),
        e.value.patterns) AS ps FROM e WHERE e.key IN ('total_amount', 'tax_amount', 'subtotal_amount'))
    SELECT template_id, field, CAST(ord - 1 AS INT) AS ord, pattern FROM (SELECT template_id, field, unnest(ps) AS pattern, generate_subscripts(ps, 1) AS ord FROM p)""")

# --- extraction with one template -----------------------------------------------------------


def template_column(start: int | None = 3) -> Column:
    """The derived template as a constant."""
    entries = []
    for field, patterns, line, offset in TEMPLATE_EXTRACTORS:
        entries += [F.lit(field), F.struct(
            F.lit(True).alias("expected_present"), F.array(*[F.lit(p) for p in patterns]).alias("patterns"), F.lit(line).alias("line"),
            F.lit(offset).alias("offset_from_last_item"), F.lit(False).alias("is_fuzzy_haystack"))]
    groups = F.create_map(F.lit("quantity"), F.lit(1), F.lit("item_name"), F.lit(2), F.lit("total_price"), F.lit(3))
    return F.struct(F.create_map(*entries).alias("field_extractors"), F.lit(True).alias("has_line_items"),
                    F.lit(start).cast("int").alias("line_items_start_line"),
                    F.array(F.struct(F.lit(TEMPLATE_ITEM_PATTERN).alias("pattern"), groups.alias("groups"))).alias("item_patterns"))


def extracted(t, start: int | None = 3):
    return ex.apply_templates(ex.with_lines(t.noisy_receipts).withColumn("template", template_column(start)))


P0 = TEMPLATE_ITEM_PATTERN
P1 = P0.replace(AMOUNT, WIDE)
D_ITEMS = f"""{d_lines('noisy_receipts')},
  marked AS (SELECT *, regexp_matches(line, {quote(P1)}) OR regexp_matches(line, {quote(P0)}) AS is_m, {d_continues('line')} AS is_c
    FROM lines WHERE pos >= 3),
  grouped AS (SELECT *, CAST(sum(CASE WHEN is_m THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id ORDER BY pos) AS INT) AS item FROM marked),
  runs AS (SELECT *, max(CASE WHEN NOT is_m AND NOT is_c THEN 1 ELSE 0 END) OVER (PARTITION BY receipt_id, item ORDER BY pos) = 0 AS taken
    FROM grouped WHERE item > 0),
  ends AS (SELECT receipt_id, item, min(pos) AS start_pos, max(CASE WHEN taken THEN pos END) AS end_pos FROM runs GROUP BY 1, 2),
  gaps AS (SELECT *, lag(end_pos) OVER (PARTITION BY receipt_id ORDER BY item) AS before FROM ends),
  live AS (SELECT receipt_id, item FROM (SELECT *, sum(CASE WHEN start_pos > before + 4 THEN 1 ELSE 0 END)
    OVER (PARTITION BY receipt_id ORDER BY item) AS cuts FROM gaps) WHERE cuts = 0),
  islands AS (SELECT receipt_id, pos, item, CASE WHEN is_m THEN 'item' ELSE 'more' END AS kind, line
    FROM runs JOIN live USING (receipt_id, item) WHERE taken)"""
PART = "CASE WHEN regexp_matches(line, {p1}) THEN regexp_extract(line, {p1}, {g}) ELSE regexp_extract(line, {p0}, {g}) END"


def d_part(g):
    return PART.format(p1=quote(P1), p0=quote(P0), g=g)


D_BUILT = f"""built AS (SELECT receipt_id, item, max(CASE WHEN kind = 'item' THEN {d_part(1)} END) AS quantity,
    max(CASE WHEN kind = 'item' THEN {d_part(3)} END) AS total_price,
    string_agg(CASE WHEN kind = 'item' THEN {d_part(2)} ELSE {d_strip('line')} END, ' ' ORDER BY pos) AS item_name
  FROM islands GROUP BY 1, 2)"""
UNIT = "((2 * CAST(replace(total_price, '.', '') AS BIGINT) + CAST(quantity AS BIGINT)) // (2 * CAST(quantity AS BIGINT)))"


def d_first(line, patterns):
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({line}, {quote(p)}) THEN regexp_extract({line}, {quote(p)}, 1) END" for p in patterns) + ")"


def d_patterns(field, patterns):
    wide = [p.replace(AMOUNT, WIDE) for p in patterns if AMOUNT[1:-1] in p] if field in fixed.MONEY_FIELDS else []
    return wide + patterns


D_ABSOLUTE = "absolute AS (" + " UNION ALL ".join(
    f"SELECT receipt_id, '{f}' AS field, {d_first('line', d_patterns(f, ps))} AS value FROM lines WHERE pos = {line}"
    for f, ps, line, _ in TEMPLATE_EXTRACTORS if line >= 0) + ")"
D_RELATIVE = """last_item AS (SELECT receipt_id, max(pos) AS last FROM islands GROUP BY 1), relative AS (""" + " UNION ALL ".join(
    f"SELECT l.receipt_id, '{f}' AS field, {d_first('line', d_patterns(f, ps))} AS value FROM lines l JOIN last_item USING (receipt_id) WHERE pos = last + {offset}"
    for f, ps, _, offset in TEMPLATE_EXTRACTORS) + ")"
D_FIELDS = f"""{D_ITEMS}, {D_ABSOLUTE}, {D_RELATIVE}, fields AS (
    SELECT receipt_id, field, value FROM absolute WHERE value IS NOT NULL
    UNION ALL SELECT r.receipt_id, r.field, r.value FROM relative r LEFT JOIN (SELECT * FROM absolute WHERE value IS NOT NULL) a
      ON a.receipt_id = r.receipt_id AND a.field = r.field WHERE r.value IS NOT NULL AND a.field IS NULL)"""


def pass_rows(t, which):
    docs = ex.with_lines(t.noisy_receipts).withColumn("template", template_column())
    extractors = ex.extractor_list(F.col("template.field_extractors"))
    if which == "absolute":
        values = ex.absolute_fields(F.col("lines"), extractors, F.col("currency.symbol"))
    else:
        docs = docs.withColumn("last", extracted_last(F.col("lines"), F.col("template"), F.col("currency.symbol")))
        values = ex.relative_fields(F.col("lines"), extractors, F.col("currency.symbol"), F.col("last"))
    return ex.unnest(docs, ["receipt_id"], values, ("n", "v")).select("receipt_id", "v.field", "v.value").where("value is not null")


def islands(lines: Column, template: Column, symbol: Column) -> Column:
    matches = ex.item_matches(lines, ex.compiled_items(template["item_patterns"], symbol), template["line_items_start_line"])
    return ex.bind(matches, lambda m: ex.item_islands(lines, m, template["line_items_start_line"]))


def extracted_last(lines, template, symbol):
    return ex.last_item_line(islands(lines, template, symbol))


add("f14_extract_absolute_fields", lambda t: pass_rows(t, "absolute"), ("noisy_receipts",),
    f", {d_lines('noisy_receipts')}, {D_ABSOLUTE} SELECT receipt_id, field, value FROM absolute WHERE value IS NOT NULL")
add("f15_extract_relative_fields", lambda t: pass_rows(t, "relative"), ("noisy_receipts",),
    f", {D_ITEMS}, {D_RELATIVE} SELECT receipt_id, field, value FROM relative WHERE value IS NOT NULL")
add("w9_line_item_islands", lambda t: ex.unnest(
        ex.with_lines(t.noisy_receipts).withColumn("template", template_column()), ["receipt_id"],
        islands(F.col("lines"), F.col("template"), F.col("currency.symbol")), ("n", "r")).select("receipt_id", "r.*"),
    ("noisy_receipts",), f", {D_ITEMS} SELECT receipt_id, pos, item, kind FROM islands")
add("f17_extract_line_items", lambda t: ex.unnest(extracted(t), ["receipt_id"], F.col("extracted.cost_items"), ("pos", "i")).select(
        "receipt_id", "pos", "i.*"), ("noisy_receipts",), f""", {D_ITEMS}, {D_BUILT}
    SELECT receipt_id, CAST(item - 1 AS INT) AS pos, item_name, quantity, total_price,
      CASE WHEN CAST(quantity AS BIGINT) > 0 THEN CAST({UNIT} // 100 AS VARCHAR) || '.' || lpad(CAST({UNIT} % 100 AS VARCHAR), 2, '0') END AS unit_price FROM built""")
add("f18_item_start_line", lambda t: ex.with_lines(t.noisy_receipts).withColumn("template", template_column(None)).withColumn(
        "m", ex.item_matches(F.col("lines"), ex.compiled_items(F.slice("template.item_patterns", 1, 1), F.col("currency.symbol")))).select(
        "receipt_id", ex.item_start_line(F.col("template.line_items_start_line"), ex.extractor_list(F.col("template.field_extractors")), F.col("m")).alias("start")),
    ("noisy_receipts",), f""", {d_lines('noisy_receipts')} SELECT receipt_id, min(pos) AS start FROM lines
    WHERE regexp_matches(line, {quote(P1)}) OR regexp_matches(line, {quote(P0)}) GROUP BY 1""")


def assembled(t):
    docs = extracted(t).select("receipt_id", F.col("extracted.fields").alias("fields"), F.col("extracted.cost_items").alias("cost_items"), "currency")
    whole = parse.assemble_extraction(docs)
    return whole.select("receipt_id", F.explode_outer("extracted_data").alias("field", "value")).where("field is not null")


add("f20_assemble_extraction", assembled, ("noisy_receipts",), f""", {D_FIELDS} SELECT receipt_id, field, value FROM fields
    UNION ALL SELECT receipt_id, 'currency', 'N/A' FROM noisy_receipts UNION ALL SELECT receipt_id, 'currency_symbol', '£' FROM noisy_receipts""")
D_SCORE = f"""{D_FIELDS}, scored AS (SELECT n.receipt_id, coalesce(f.n, 0) AS n_fields, i.receipt_id IS NOT NULL AS has_items
    FROM noisy_receipts n LEFT JOIN (SELECT receipt_id, count(*) AS n FROM fields WHERE value <> '' GROUP BY 1) f ON f.receipt_id = n.receipt_id
    LEFT JOIN last_item i ON i.receipt_id = n.receipt_id)"""
add("a9_extraction_score", lambda t: extracted(t).select("receipt_id", "score"), ("noisy_receipts",), f""", {D_SCORE}
    SELECT receipt_id, CAST(n_fields + CASE WHEN has_items THEN 1 ELSE 0 END + 2 AS INT) AS score FROM scored""")
add("a10_correspondence", lambda t: extracted(t).select("receipt_id", F.round(ex.correspondence(
        F.col("extracted.fields"), F.col("extracted.n_extractors")), 6).alias("correspondence")), ("noisy_receipts",), f""", {D_SCORE}
    SELECT receipt_id, round(CAST(n_fields AS DOUBLE) / {len(TEMPLATE_EXTRACTORS)} * 100, 6) AS correspondence FROM scored""")


def haystacks(t):
    """The merchant line searched as a multi-line text from the first line on."""
    extractor = F.struct(F.lit(True).alias("expected_present"), F.array(F.concat(F.lit(".*("), "wanted", F.lit(").*"))).alias("patterns"),
                         F.lit(0).alias("line"), F.lit(0).alias("offset_from_last_item"), F.lit(True).alias("is_fuzzy_haystack"))
    template = F.struct(F.create_map(F.lit("merchant_address"), extractor).alias("field_extractors"), F.lit(True).alias("has_line_items"),
                        F.lit(3).alias("line_items_start_line"), template_column()["item_patterns"].alias("item_patterns"))
    docs = ex.with_lines(t.noisy_receipts).withColumn("wanted", F.array_join(F.slice("lines", 1, 2), " ")).withColumn("template", template)
    return ex.fuzzy_haystack(docs, F.col("template")).select("receipt_id", F.col("values")["merchant_address"].alias("address"))


add("f16_fuzzy_haystack", haystacks)

# --- corrected receipts ------------------------------------------------------------------------


def sections(t):
    """Corrected receipts with their item section, which is an element of an array: so a filter on it doesn't compute it once more."""
    docs = ex.with_lines(t.corrected_receipts)
    return docs.withColumn("section", F.explode_outer(F.array(ex.item_section(F.col("lines"), F.col("cost_items")))))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({s}), '\\s+'), lambda w: w <> ''))"
OVERLAP = f"len(list_intersect({WORDS.format(s='item_name')}, {WORDS.format(s='line')}))"
NEEDED = f"greatest(1.0, len({WORDS.format(s='item_name')}) * CAST(0.6 AS DOUBLE))"
D_SECTION = f"""{d_lines('corrected_receipts')},
  wanted AS (SELECT receipt_id, k, i.item_name AS item_name, i.quantity AS quantity, i.total_price AS total_price FROM (
    SELECT receipt_id, unnest(cost_items) AS i, generate_subscripts(cost_items, 1) AS k FROM corrected_receipts)),
  seen AS (SELECT w.*, pos, line, contains(line, item_name) AS exact, {OVERLAP} >= {NEEDED} AS loose FROM wanted w JOIN lines l USING (receipt_id)),
  starts AS (SELECT receipt_id, min(pos) AS start FROM seen WHERE exact GROUP BY 1),
  placed AS (SELECT s.receipt_id, k, item_name, quantity, total_price, coalesce(min(CASE WHEN exact THEN pos END), min(CASE WHEN loose THEN pos END)) AS line_no, start
    FROM seen s JOIN starts USING (receipt_id) WHERE pos >= start GROUP BY ALL),
  located AS (SELECT p.*, l.line AS content, row_number() OVER (PARTITION BY p.receipt_id ORDER BY line_no, k) AS n
    FROM placed p JOIN lines l ON l.receipt_id = p.receipt_id AND l.pos = line_no)"""
add("w8_item_section_bounds", lambda t: sections(t).select("receipt_id", "section.start", "section.end", F.size("section.items").alias("n_items")),
    ("corrected_receipts",), f""", {D_SECTION} SELECT c.receipt_id, CAST(coalesce(min(start), -1) AS INT) AS start,
    CAST(coalesce(max(line_no), -1) AS INT) AS end, CAST(count(line_no) AS INT) AS n_items
    FROM corrected_receipts c LEFT JOIN located l ON l.receipt_id = c.receipt_id GROUP BY 1""")
add("o3_order_items", lambda t: ex.unnest(sections(t), ["receipt_id"], F.col("section.items"), ("n", "i")).select(
        "receipt_id", "n", F.col("i.line").alias("line_no"), "i.item.item_name"), ("corrected_receipts",), f""", {D_SECTION}
    SELECT receipt_id, CAST(n - 1 AS INT) AS n, line_no, item_name FROM located""")
add("u1_word_overlap", lambda t: t.noisy_receipts.select("receipt_id", F.explode(tx.lines_of(F.col("ocr_text"))).alias("line")).withColumn(
        "item_name", F.lit("small red ring express")).select("receipt_id", "line", tx.word_overlap(F.col("item_name"), F.col("line")).alias("shared"),
        (tx.word_overlap(F.col("item_name"), F.col("line")) >= tx.words_needed(F.col("item_name"))).alias("enough")),
    ("noisy_receipts",), f""", {d_lines('noisy_receipts')}, pairs AS (SELECT receipt_id, line, 'small red ring express' AS item_name FROM lines)
    SELECT receipt_id, line, CAST({OVERLAP} AS INT) AS shared, {OVERLAP} >= {NEEDED} AS enough FROM pairs""")
add("u2_has_keys", lambda t: t.templates.select("template_id", F.explode("item_patterns").alias("p")).select("template_id", (F.size(F.array_except(
        F.array(F.lit("total_price"), F.lit("quantity")), F.map_keys("p.groups"))) == 0).alias("has_keys")), ("templates",), """
    SELECT template_id, list_has_all(map_keys(p.groups), ['total_price', 'quantity']) AS has_keys FROM (SELECT template_id, unnest(item_patterns) AS p FROM templates)""")
add("u3_lines_outside_items", lambda t: ex.unnest(sections(t), ["receipt_id"], ex.lines_outside_items(F.col("lines"), F.col("section")), ("n", "x")).select(
        "receipt_id", "x.pos", "x.line"), ("corrected_receipts",), f""", {D_SECTION},
    bounds AS (SELECT c.receipt_id, coalesce(min(start), -1) AS s, coalesce(max(line_no), -1) AS e FROM corrected_receipts c LEFT JOIN located l ON l.receipt_id = c.receipt_id GROUP BY 1)
    SELECT receipt_id, pos, line FROM lines JOIN bounds USING (receipt_id) WHERE pos < s OR pos > e""")


def d_reads(p, groups):
    def g(name):
        return f"regexp_extract(content, {quote(p)}, {groups[name]})"

    name = g("item_name")
    return (f"CASE WHEN regexp_matches(content, {quote(p)}) AND (contains({name}, item_name) OR contains(item_name, {name})) "
            f"AND {g('total_price')} = total_price AND {g('quantity')} = quantity THEN 1 ELSE 0 END")


D_COVERAGE = D_SECTION + ", scores AS (" + " UNION ALL ".join(
    f"SELECT receipt_id, {i} AS ord, CAST(sum({d_reads(p, g)}) AS INT) AS score, count(*) AS n FROM located GROUP BY receipt_id"
    for i, (p, g) in enumerate(fixed.ITEM_PATTERNS)) + ")"
add("j17_item_lines_by_pattern", lambda t: ex.unnest(sections(t).where(F.size("section.items") > 0), ["receipt_id"],
        ex.library_item_scores(F.col("section.items")), ("ord", "score")), ("corrected_receipts",), f""", {D_COVERAGE} SELECT receipt_id, ord, score FROM scores""")
add("a12_pattern_coverage", lambda t: sections(t).withColumn("scores", ex.library_item_scores(F.col("section.items"))).where(
        F.size("section.items") > 0).select("receipt_id", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("best"),
        F.round(F.array_max("scores") / F.size("section.items"), 6).alias("coverage"),
        (F.array_max("scores") >= F.size("section.items") * 0.5).alias("accepted")), ("corrected_receipts",), f""", {D_COVERAGE}
    SELECT receipt_id, ord AS best, round(CAST(score AS DOUBLE) / n, 6) AS coverage, score >= n * 0.5 AS accepted FROM scores
    QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, ord) = 1""")
add("o4_pattern_order", lambda t: sections(t).where(F.size("section.items") > 0).select("receipt_id", F.array_join(F.transform(F.array_sort(F.transform(
        ex.library_item_scores(F.col("section.items")), lambda s, i: F.struct((-s).alias("s"), i.alias("ord")))),
        lambda x: x["ord"].cast("string")), ",").alias("ranking")),
    ("corrected_receipts",), f""", {D_COVERAGE} SELECT receipt_id, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY score DESC, ord) AS ranking FROM scores GROUP BY 1""")
LITERAL = "'.*(' || {q} || ').*(' || {n} || ').*(' || {p} || ').*'".format(**{k: f"regexp_replace({c}, '([-.+*?^$|()\\[\\]{{}}\\\\&~# ])', '\\\\\\1', 'g')" for k, c in (
    ("q", "quantity"), ("n", "item_name"), ("p", "total_price"))})
add("l2_derive_item_pattern", lambda t: sections(t).where(F.size("section.items") > 0).withColumn(
        "p", ex.derive_item_pattern(F.col("section.items"))).select("receipt_id", "p.pattern"), ("corrected_receipts",), f""", {D_COVERAGE},
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY receipt_id ORDER BY score DESC, ord) = 1)
    SELECT receipt_id, CASE WHEN score >= b.n * 0.5 THEN CASE ord {' '.join(f'WHEN {i} THEN {quote(p)}' for i, (p, _) in enumerate(fixed.ITEM_PATTERNS))} END
      WHEN len(regexp_extract_all(content, '\\d+(?:\\.\\d+)?')) >= 2 AND len(regexp_extract_all(content, '[A-Za-z]{{2,}}(?:\\s+[A-Za-z]+)*')) > 0 THEN
        CASE WHEN quantity = '1' AND NOT regexp_matches(content, '\\b1\\b') THEN {quote(fixed.CUSTOM_ITEM_PRICE)} ELSE {quote(fixed.CUSTOM_QTY_ITEM_PRICE)} END
      ELSE {LITERAL} END AS pattern FROM best b JOIN located l USING (receipt_id) WHERE l.n = 1""")

# --- matching --------------------------------------------------------------------------------------


def requests(t):
    docs = ex.with_lines(t.noisy_receipts)
    return docs.withColumn("hint", F.get("lines", F.lit(0))).withColumn("head", tx.document_head(F.col("lines"), 3))


add("a7_distinct_merchants", lambda t: matching.distinct_merchants(t.templates).withColumn("state", F.lit("all")).unionByName(
        matching.distinct_merchants(t.templates, False).withColumn("state", F.lit("active"))).unionByName(
        matching.distinct_merchants(t.templates, True).withColumn("state", F.lit("archived"))), ("templates",), """
    SELECT DISTINCT merchant_name, 'all' AS state FROM templates UNION ALL SELECT DISTINCT merchant_name, 'active' FROM templates WHERE NOT is_archived
    UNION ALL SELECT DISTINCT merchant_name, 'archived' FROM templates WHERE is_archived""")
add("w5_top_templates", lambda t: matching.top_templates(t.templates).select("merchant_name", "cand_ord", "template_id", "usage_count"), ("templates",), """
    SELECT merchant_name, CAST(row_number() OVER (PARTITION BY merchant_name ORDER BY usage_count DESC, template_id) AS INT) AS cand_ord, template_id, usage_count
    FROM templates QUALIFY cand_ord <= 5""")
add("j11_fuzzy_merchant_match", lambda t: matching.fuzzy_merchant_match(
        requests(t).select(tx.document_head(F.col("lines"), 4).alias("head")), matching.distinct_merchants(t.templates)).select(
        "head", "merchant", F.round("score", 6).alias("score")))
add("f11_identify_merchant", lambda t: matching.identify_merchant(ex.with_lines(t.noisy_receipts), t.templates).select("receipt_id", "hint"))
add("w6_template_candidates", lambda t: matching.template_candidates(requests(t), t.templates))
HELD = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY usage_count DESC, template_id) <= 5"
D_TIERS = f"""req AS (SELECT receipt_id, split_part(ocr_text, {NL}, 1) AS hint FROM noisy_receipts),
  words AS (SELECT DISTINCT hint, lower(regexp_extract(trim(hint), '^\\S*')) AS word FROM req),
  tiers AS (
    SELECT hint, 1 AS tier, template_id, usage_count FROM words JOIN templates ON lower(merchant_name) = lower(hint) AND NOT is_archived
    UNION ALL SELECT hint, 3, template_id, usage_count FROM words JOIN templates ON contains(lower(merchant_name), word) AND NOT is_archived
    UNION ALL SELECT hint, 4, template_id, usage_count FROM words JOIN templates ON lower(merchant_name) = lower(hint) AND is_archived
    UNION ALL SELECT hint, 6, template_id, usage_count FROM words JOIN templates ON contains(lower(merchant_name), word) AND is_archived
    UNION ALL SELECT hint, 7, template_id, usage_count FROM words JOIN templates ON merchant_name = 'Generic'),
  firsts AS (SELECT hint, min(tier) AS tier FROM tiers GROUP BY 1)"""
add("w6_template_candidates_by_name", lambda t: matching.template_candidates(requests(t), t.templates, use_text=False), ("noisy_receipts", "templates"), f""", {D_TIERS},
    ranked AS (SELECT hint, tier, CAST(row_number() OVER (PARTITION BY hint ORDER BY usage_count DESC, template_id) AS INT) AS cand_ord, template_id
      FROM tiers JOIN firsts USING (hint, tier) QUALIFY cand_ord <= 5)
    SELECT receipt_id, CAST(tier AS INT) AS tier, cand_ord, template_id FROM req JOIN ranked USING (hint)""")
add("w7_best_template", lambda t: matching.best_template(requests(t), t.templates).select(
        "receipt_id", "template_id", "tier", "cand_ord", "score", F.round("correspondence", 6).alias("correspondence")))


def parsed(t, **options):
    return parse.parse_receipts(t.noisy_receipts, t.templates, misreads="units", **options)


add("f21_parse_receipts", lambda t: parsed(t).select("receipt_id", "template_id", F.round("correspondence", 6).alias("correspondence"),
    F.col("fields")["total_amount"].alias("total_amount"), F.size("cost_items").alias("n_items"), "error"))


def fallbacks(t):
    """Documents against a table without templates: every parse falls back."""
    outcome = extracted(t).select("receipt_id", F.col("extracted.fields").alias("fields"), "currency", ex.correspondence(
        F.col("extracted.fields"), F.col("extracted.n_extractors")).alias("correspondence")).withColumn(
        "error", F.when(~F.map_contains_key("fields", "total_amount"), "Failed to parse receipt"))
    done = parse.parse_or_fallback(outcome, now("2024-03-01 08:30:00"))
    return done.select("receipt_id", F.col("extracted_data")["merchant_name"].alias("merchant_name"), F.col("extracted_data")["error"].alias("error"))


add("f22_parse_or_fallback", fallbacks, ("noisy_receipts",), f""", {D_FIELDS}
    SELECT n.receipt_id, CASE WHEN t.value IS NULL THEN 'Error extracting data' ELSE m.value END AS merchant_name,
      CASE WHEN t.value IS NULL THEN 'Failed to parse receipt: Failed to parse receipt' END AS error
    FROM noisy_receipts n LEFT JOIN fields t ON t.receipt_id = n.receipt_id AND t.field = 'total_amount'
    LEFT JOIN fields m ON m.receipt_id = n.receipt_id AND m.field = 'merchant_name'""")


def attached(t):
    """Every job with its text, those without one included."""
    docs = t.noisy_receipts.select(F.concat(F.lit("J"), F.lpad(F.col("receipt_id").cast("string"), 10, "0")).alias("job_id"), "ocr_text")
    jobs = parse.attach_text_metadata(t.jobs.select("job_id", "metadata").join(docs, "job_id", "left"))
    return jobs.select("job_id", F.size("metadata").alias("n_keys"), F.col("metadata")["ocr_text"].alias("raw"),
                       F.col("metadata")["ocr_text_preprocessed"].alias("clean"))


add("f23_attach_text_metadata", attached, ("noisy_receipts", "jobs"), f""", {d_clean(('noisy_receipts', 'ocr_text'), 'receipt_id')},
    cleaned AS (SELECT receipt_id, string_agg(line, {NL} ORDER BY pos) AS clean FROM kept GROUP BY 1)
    SELECT job_id, CAST(cardinality(metadata) + 2 AS INT) AS n_keys, ocr_text AS raw, CASE WHEN ocr_text IS NOT NULL THEN coalesce(clean, '') END AS clean FROM jobs
    LEFT JOIN noisy_receipts n ON job_id = 'J' || lpad(CAST(n.receipt_id AS VARCHAR), 10, '0') LEFT JOIN cleaned c ON c.receipt_id = n.receipt_id""")

# --- the flagship: totals read from text --------------------------------------------------------------


def text_totals(t):
    owners = t.orders.select(F.col("o_orderkey").alias("receipt_id"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("day"))
    return parse.receipt_totals(t.ocr_receipts, owners, r"^TOTAL £(\d+\.\d{2})$").withColumn("total", F.col("total").cast("string"))


add("text_totals_by_owner", text_totals, ("ocr_receipts",), """
    SELECT o_custkey AS owner, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n_receipts,
      CAST(CAST(sum(CAST(regexp_extract(ocr_text, 'TOTAL £(\\d+\\.\\d{2})\\n[^\\n]*$', 1) AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS VARCHAR) AS total
    FROM ocr_receipts JOIN orders ON o_orderkey = receipt_id GROUP BY 1, 2""")
