"""Field and item extraction.

A document is one row; its lines are an array in that row. Every step maps the
row's arrays, so extraction needs no shuffle whatever the number of documents
and no document's lines ever meet another's.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from ..functions import fixed, fuzzy
from ..functions.expr import MARK, bind, group_count, regex_escape, truthy, whole_line
from ..functions.patterns import read_patterns
from ..functions.text import (currency_aware, detect_currency, holds, is_continuation, lines_of, strip,
                              word_overlap, words_needed)
from ..schemas import ITEM


def unnest(rows: DataFrame, keep: list, array: Column, names: tuple[str, str]) -> DataFrame:
    """One row per element with its position. The outer form stops the optimizer from
    computing the array once more for a filter on its size."""
    out = rows.select(*keep, F.posexplode_outer(array).alias(*names))
    return out.where(F.col(names[0]).isNotNull())


ITEM_PARTS = ("item_name", "quantity", "total_price", "unit_price")
MATCHED = ITEM.removesuffix(">") + ",origin:int>"


def ocr_lines(documents: DataFrame, key: str, text: str = "ocr_text") -> DataFrame:
    """One row per line, positions from 0."""
    return unnest(documents, [key], lines_of(F.col(text)), ("pos", "line"))


# --- fields -----------------------------------------------------------------

def first_value(line: Column, patterns: Column) -> Column:
    """Group 1 of the first pattern that has a group and fits the line."""
    def attempt(raw: Column) -> Column:
        usable = (F.length(raw) > 0) & (group_count(raw) > 0)
        return F.when(usable, bind(
            F.regexp_replace(line, whole_line(raw), F.lit(MARK + "$1")),
            lambda read: F.when(F.startswith(read, F.lit(MARK)), F.substr(read, F.lit(2)))))

    # patterns after the one that fits are not tried
    return F.aggregate(patterns, F.lit(None).cast("string"), lambda done, raw: F.coalesce(done, attempt(raw)))


def extractor_list(field_extractors: Column) -> Column:
    """Map of extractors as an array of structs that carry the field name."""
    return F.transform(F.map_entries(field_extractors), lambda e: F.struct(
        e["key"].alias("field"),
        F.coalesce(e["value"]["expected_present"], F.lit(True)).alias("expected_present"),
        e["value"]["patterns"].alias("patterns"), e["value"]["line"].alias("line"),
        e["value"]["offset_from_last_item"].alias("offset"),
        F.coalesce(e["value"]["is_fuzzy_haystack"], F.lit(False)).alias("fuzzy")))


def _values_at(lines: Column, extractors: Column, symbol: Column, *positions) -> Column:
    """Field and value of each regex extractor at the first of its positions that gives one; value NULL when nothing fits."""
    def value(e: Column) -> Column:
        money = e["field"].isin(*fixed.MONEY_FIELDS)
        patterns = F.when(money, currency_aware(e["patterns"], symbol)).otherwise(e["patterns"])

        def read(at: Column) -> Column:
            inside = e["expected_present"] & ~e["fuzzy"] & (at >= 0) & (at < F.size(lines))
            return F.when(inside, first_value(F.get(lines, at), patterns))

        return F.struct(e["field"].alias("field"), F.coalesce(*[read(position(e)) for position in positions]).alias("value"))

    return F.transform(extractors, value)


def absolute_fields(lines: Column, extractors: Column, symbol: Column) -> Column:
    """First pass: extractors with a line of their own."""
    return _values_at(lines, extractors, symbol, lambda e: e["line"])


def relative_fields(lines: Column, extractors: Column, symbol: Column, last_item: Column) -> Column:
    """Second pass: extractors placed relative to the last item line."""
    return _values_at(lines, extractors, symbol, lambda e: last_item + e["offset"])


def both_passes(lines: Column, extractors: Column, symbol: Column, last_item: Column) -> Column:
    """Map of the fields found, first pass before second, which only reads what the first didn't."""
    values = _values_at(lines, extractors, symbol, lambda e: e["line"], lambda e: last_item + e["offset"])
    return F.map_from_entries(F.filter(values, lambda f: f["value"].isNotNull()))


# --- items ------------------------------------------------------------------

def compiled_items(item_patterns: Column, symbol: Column) -> Column:
    """Item patterns with their currency variants, group counts and order; ``origin`` numbers the pattern they stem from."""
    def compiled(groups: Column, origin: Column):
        def build(raw: Column) -> Column:
            n = group_count(raw)

            def part(name: str) -> Column:
                return F.when(groups[name] <= n, F.concat(F.lit("$"), groups[name])).otherwise(F.lit(""))

            return F.struct(
                whole_line(raw).alias("line_pattern"), groups.alias("groups"), n.alias("n"), origin.alias("origin"),
                F.concat(*[x for name in ITEM_PARTS for x in (F.lit(MARK), part(name))]).alias("reading"))

        return build

    return F.flatten(F.transform(item_patterns, lambda p, i: F.transform(
        currency_aware(F.array(p["pattern"]), symbol), compiled(p["groups"], i))))


def unit_price(total: Column, quantity: Column) -> Column:
    """Total by quantity, two decimals half up; NULL for quantity 0 or text."""
    share = F.try_divide(total.try_cast("decimal(20,6)"), quantity.try_cast("decimal(20,6)"))
    return share.try_cast("decimal(20,2)").cast("string")


def match_item(line: Column, p: Column) -> Column:
    """Item read from a line by one pattern, or NULL."""
    def build(parts: Column) -> Column:
        def part(name: str) -> Column:
            return F.when(p["groups"][name] <= p["n"], parts[ITEM_PARTS.index(name) + 1])

        has_quantity = F.map_contains_key(p["groups"], "quantity")
        quantity = F.when(has_quantity & p["groups"]["quantity"].isNull(), F.lit("1")).otherwise(part("quantity"))
        both = F.map_contains_key(p["groups"], "total_price") & has_quantity
        return F.when(F.size(parts) > 1, F.struct(
            part("item_name").alias("item_name"), quantity.alias("quantity"), part("total_price").alias("total_price"),
            F.when(both, unit_price(part("total_price"), quantity)).otherwise(part("unit_price")).alias("unit_price"),
            p["origin"].alias("origin")))

    return bind(F.regexp_replace(line, p["line_pattern"], p["reading"]), lambda read: F.when(
        F.startswith(read, F.lit(MARK)), bind(F.split(read, MARK), build)))


def item_matches(lines: Column, compiled: Column, start: Column | None = None) -> Column:
    """Per line the item read by the first pattern that fits. Patterns form the
    outer loop, so each is compiled once for all lines of the document. Lines
    before ``start``, unless it is NULL, are not read."""
    read = lines if start is None else F.transform(lines, lambda line, i: F.when(F.coalesce(i >= start, F.lit(True)), line))
    none = F.transform(lines, lambda _: F.lit(None).cast(MATCHED))
    return F.aggregate(compiled, none, lambda acc, p: F.zip_with(
        acc, read, lambda done, line: F.when(line.isNotNull(), F.coalesce(done, match_item(line, p)))))


def item_start_line(stored: Column, extractors: Column, matches: Column) -> Column:
    """Stored start, else the start extractor's line, else the first line that ``matches``, those of
    the template's first item pattern and its currency form."""
    marked = F.filter(extractors, lambda e: (e["field"] == "line_items_start") & e["line"].isNotNull())
    positions = F.filter(F.transform(matches, lambda m, i: F.when(m.isNotNull(), i)), lambda i: i.isNotNull())
    return F.coalesce(stored, F.get(F.transform(marked, lambda e: e["line"]), F.lit(0)),
                      F.get(positions, F.lit(0)))


def item_islands(lines: Column, matches: Column, start: Column) -> Column:
    """Lines that belong to items, in order, as structs of position, item number and kind.

    One pass: a fitting line opens an item, a following text line continues
    it, and more than three lines without either end the item section.
    """
    row_type = "array<struct<pos:int,item:int,kind:string>>"

    def row(pos, item, kind):
        return F.array(F.struct(pos.cast("int").alias("pos"), item.alias("item"), F.lit(kind).alias("kind")))

    def state(end, items, named, stop, rows):
        return F.struct(end.cast("int").alias("end"), items.alias("items"), named.alias("named"),
                        stop.alias("stop"), rows.alias("rows"))

    def step(acc: Column, i: Column) -> Column:
        item = F.get(matches, i)
        continues = (acc["items"] > 0) & (i == acc["end"] + 1) & acc["named"] & is_continuation(F.get(lines, i))
        too_far = (acc["items"] > 0) & (i > acc["end"] + fixed.ITEM_GAP)
        opened = acc["items"] + 1
        return (
            F.when(acc["stop"], acc)
            .when(item.isNotNull(), state(i, opened, item["item_name"].isNotNull(), F.lit(False),
                                          F.concat(acc["rows"], row(i, opened, "item"))))
            .when(continues, state(i, acc["items"], acc["named"], F.lit(False),
                                   F.concat(acc["rows"], row(i, acc["items"], "more"))))
            .when(too_far, state(acc["end"], acc["items"], acc["named"], F.lit(True), acc["rows"]))
            .otherwise(acc)
        )

    none = state(start, F.lit(0), F.lit(False), F.lit(False), F.array().cast(row_type))
    walk = F.when((start < F.size(lines)), F.sequence(start, F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.aggregate(walk, none, step)["rows"], F.array().cast(row_type))


def assemble_items(lines: Column, matches: Column, rows: Column) -> Column:
    """Items with the text of their continuation lines joined to the name."""
    def build(heads: Column) -> Column:
        def item(h: Column, k: Column) -> Column:
            until = F.coalesce(F.get(heads, k + 1)["at"], F.size(rows))
            extra = F.transform(F.slice(lines, h["pos"] + 2, until - h["at"] - 1), strip)
            m = F.get(matches, h["pos"])
            name = F.when(m["item_name"].isNotNull(),
                          F.array_join(F.concat(F.array(m["item_name"]), extra), " "))
            return F.struct(name.alias("item_name"), m["quantity"].alias("quantity"),
                            m["total_price"].alias("total_price"), m["unit_price"].alias("unit_price"))

        return F.transform(heads, item)

    heads = F.filter(F.transform(rows, lambda r, i: F.struct(
        r["pos"].alias("pos"), r["kind"].alias("kind"), i.alias("at"))), lambda r: r["kind"] == "item")
    return bind(heads, build)


def last_item_line(rows: Column) -> Column:
    return F.array_max(F.transform(rows, lambda r: r["pos"]))


# --- templates ready for extraction -------------------------------------------

def with_pattern_lists(templates: DataFrame) -> DataFrame:
    """Templates whose old extractors, with one ``regex`` text instead of a list of patterns, have a list."""
    value = templates.schema["field_extractors"].dataType.valueType
    if "regex" not in value.fieldNames():
        return templates
    none = F.array().cast("array<string>")
    turned = lambda k, e: e.withField("patterns", F.when(
        F.coalesce(F.size(e["patterns"]), F.lit(0)) > 0, e["patterns"]).when(e["regex"].isNotNull(), F.array(e["regex"])).otherwise(none)).dropFields("regex")
    return templates.withColumn("field_extractors", F.transform_values("field_extractors", turned))


def template_patterns(templates: DataFrame, *columns: str) -> DataFrame:
    """(template_id, pattern) of all patterns in the named columns."""
    lists = {"field_extractors": F.flatten(F.transform(F.map_values("field_extractors"), lambda e: F.coalesce(e["patterns"], F.array().cast("array<string>")))),
             "item_patterns": F.transform("item_patterns", lambda p: p["pattern"])}
    every = F.concat(*[F.coalesce(lists[c], F.array().cast("array<string>")) for c in columns])
    return templates.select("template_id", F.explode(every).alias("pattern")).where("pattern is not null").distinct()


def pattern_faults(templates: DataFrame, *columns: str) -> DataFrame:
    """(template_id, readings, faults): each template's patterns as the JVM reads them, and those it can't, with the reason.
    Every distinct pattern is looked at once, whatever the number of templates that have it."""
    used = template_patterns(templates, *columns)
    read = used.join(read_patterns(used), "pattern")
    fault = F.when(F.col("reason").isNotNull(), F.struct("pattern", "reason"))
    return read.groupBy("template_id").agg(F.map_from_entries(F.collect_list(F.struct("pattern", "java"))).alias("readings"),
                                           F.array_sort(F.collect_list(fault)).alias("faults"))


def prepare_templates(templates: DataFrame) -> DataFrame:
    """Templates with patterns that the engine can run, and ``faults``: those set aside, each with its reason.

    Extraction takes templates prepared like this; a pattern that the engine rejects would end the whole job. Patterns
    of multi-line extractors aren't run, only read, and stay. Old extractors get their list of patterns.
    """
    templates = with_pattern_lists(templates)
    ready = templates.join(pattern_faults(templates, "field_extractors", "item_patterns"), "template_id", "left")
    reading = lambda p: F.try_element_at("readings", p)
    fields = F.transform_values("field_extractors", lambda k, e: e.withField("patterns", F.when(
        F.coalesce(e["is_fuzzy_haystack"], F.lit(False)), e["patterns"]).otherwise(F.transform(e["patterns"], reading))))
    items = F.filter(F.transform("item_patterns", lambda p: p.withField("pattern", reading(p["pattern"]))), lambda p: p["pattern"].isNotNull())
    none = F.array().cast("array<struct<pattern:string,reason:string>>")
    return ready.select(*[c for c in templates.columns if c not in ("field_extractors", "item_patterns", "faults")],
                        fields.alias("field_extractors"), items.alias("item_patterns"), F.coalesce("faults", none).alias("faults"))


# --- one template on one document -------------------------------------------

def extract(lines: Column, template: Column, currency: Column) -> Column:
    """Apply a template to a document: fields, items and the last item line.

    ``template`` needs field_extractors, has_line_items, line_items_start_line
    and item_patterns, prepared by ``prepare_templates`` if they come from users.
    """
    def with_patterns(extractors: Column) -> Column:
        def with_matches(matches: Column) -> Column:
            has_items = F.coalesce(template["has_line_items"], F.lit(True)) & (F.size(template["item_patterns"]) > 0)
            # forms of the first pattern are tried before all others, so a line that fits one is marked by it
            first = F.transform(matches, lambda m: F.when(m["origin"] == 0, m))
            start = F.when(has_items, item_start_line(template["line_items_start_line"], extractors, first))

            def with_rows(rows: Column) -> Column:
                last = last_item_line(rows)
                fields = both_passes(lines, extractors, currency["symbol"], last)
                return F.struct(fields.alias("fields"), assemble_items(lines, matches, rows).alias("cost_items"),
                                last.alias("last_item_line"), F.size(extractors).alias("n_extractors"))

            return bind(item_islands(lines, matches, start), with_rows)

        # a stored start is where the items begin, so no line before it is asked for
        return bind(item_matches(lines, compiled_items(template["item_patterns"], currency["symbol"]), template["line_items_start_line"]), with_matches)

    return bind(extractor_list(template["field_extractors"]), with_patterns)


def extraction_score(fields: Column, cost_items: Column, currency: Column) -> Column:
    """Number of outputs that are not empty, items and currency included."""
    filled = F.size(F.filter(F.map_values(fields), truthy))
    return (filled + (F.size(cost_items) > 0).cast("int") + truthy(currency["code"]).cast("int")
            + truthy(currency["symbol"]).cast("int"))


def correspondence(fields: Column, n_extractors: Column) -> Column:
    """Share of extractors that gave a value, in percent; no extractor counts as one."""
    filled = F.size(F.filter(F.map_values(fields), truthy))
    return filled / F.greatest(n_extractors, F.lit(1)) * 100


# --- multi-line fields ------------------------------------------------------

def _wanted(pattern_text: str) -> str:
    """The value that a multi-line extractor looks for, from its pattern."""
    wanted = pattern_text.removeprefix(".*(")
    return (wanted[:-3] if wanted.endswith(").*") else wanted).replace("\\", "").lower()


_HAYSTACK_SCORE = 70.0


class _Search:
    """One multi-line field of a document: the spots to try in order, and how far the current one has come.

    Of a spot, the lines from there on, at most five, are taken that each score better than those before. The first spot
    with such lines ends the search; a spot ends early at 100, which no line can better.
    """

    def __init__(self, lines, spots: list[tuple[int, str]]):
        self.lines, self.spots, self.found = lines, spots, None
        self._enter()

    def _enter(self):
        self.best, self.parts = _HAYSTACK_SCORE, []
        if self.spots:
            at, pattern_text = self.spots.pop(0)
            self.wanted, self.rest = _wanted(pattern_text), list(self.lines[at:at + 5])
        else:
            self.rest = None

    def pair(self) -> tuple[str, str] | None:
        """The texts to compare next, None at the end of the search."""
        return None if self.rest is None else (self.rest[0].lower(), self.wanted)

    def take(self, score: float) -> None:
        line = self.rest.pop(0)
        if score > self.best:
            self.best = score
            self.parts.append(line)
        if self.best >= 100.0 or not self.rest:
            if any(self.parts):
                self.found, self.spots = " ".join(self.parts), []
            self._enter()


def _spots(lines, extractors, last, known) -> list[tuple[str, int, str]]:
    """(field, line, pattern) in the order in which a document's multi-line extractors try them."""
    out = []
    for e in extractors if extractors is not None else []:
        if e["expected_present"] and e["fuzzy"] and not (known is not None and e["field"] in known):
            after_items = last + e["offset"] if pd.notna(last) and pd.notna(e["offset"]) else None
            out += [(e["field"], int(spot), p) for spot in (e["line"], after_items) if pd.notna(spot) and 0 <= spot < len(lines)
                    for p in e["patterns"] or [] if p]
    return out


@F.pandas_udf(ArrayType(MapType(StringType(), StringType())))
def _filled(lines: pd.Series, extractors: pd.Series, last: pd.Series, fields: pd.Series) -> pd.Series:
    tried, searches = [], []
    for doc, configs, ends, known in zip(lines, extractors, last, fields):
        candidates = None if configs is None else []
        for c, l, f in zip(json.loads(configs), ends, known) if configs is not None else []:
            spots, values = {}, dict(f) if f is not None else {}
            for field, at, p in _spots(doc, c, l, f):
                spots.setdefault(field, []).append((at, p))
            wanted = {field: _Search(doc, places) for field, places in spots.items()}
            candidates.append((values, wanted))
            searches += wanted.values()
        tried.append(candidates)
    # all searches step together, so their pairs are scored at once and none is that doesn't matter
    while searches := [s for s in searches if s.pair() is not None]:
        pairs = sorted({s.pair() for s in searches})
        scores = dict(zip(pairs, fuzzy.partial_ratios_above([x for x, _ in pairs], [w for _, w in pairs], _HAYSTACK_SCORE).tolist()))
        for s in searches:
            s.take(scores[s.pair()])
    for candidates in tried:
        for values, wanted in candidates or []:
            values.update({field: s.found for field, s in wanted.items() if s.found is not None})
    return pd.Series([None if candidates is None else [values for values, _ in candidates] for candidates in tried])


def fill_fuzzy(lines, extractors, last, fields) -> Column:
    """Fields of each candidate with the values of its multi-line extractors added. The extractors of all candidates,
    lists of different lengths, travel as JSON."""
    return _filled(lines, F.to_json(extractors, {"ignoreNullFields": "false"}), last, fields)


def fuzzy_haystack(documents: DataFrame, template: Column) -> DataFrame:
    """Adds ``values``: the template's fields, multi-line ones included."""
    done = extract(F.col("lines"), template, F.col("currency"))
    out = documents.withColumn("extracted", done)
    filled = fill_fuzzy("lines", F.array(extractor_list(template["field_extractors"])),
                        F.array("extracted.last_item_line"), F.array("extracted.fields"))
    return out.withColumn("values", F.get(filled, F.lit(0)))


# --- whole-table operators ---------------------------------------------------

def with_lines(documents: DataFrame, text: str = "ocr_text") -> DataFrame:
    """Documents with their lines and their currency."""
    lined = documents.withColumn("lines", lines_of(F.col(text)))
    return lined.withColumn("currency", detect_currency(F.col("lines")))


def apply_templates(pairs: DataFrame) -> DataFrame:
    """Extract from documents that carry ``lines``, ``currency`` and ``template``."""
    out = pairs.withColumn("extracted", extract(F.col("lines"), F.col("template"), F.col("currency")))
    return out.withColumn("score", extraction_score(
        F.col("extracted.fields"), F.col("extracted.cost_items"), F.col("currency")))


# --- item section of a corrected receipt --------------------------------------

def item_section(lines: Column, items: Column) -> Column:
    """Where corrected items lie: start, end and the located items in line order.

    Start is the earliest line that holds any item's name. From there each item
    takes the first line that holds its name, else the first line that shares
    enough of its words. Without a start, start and end are -1.
    """
    nowhere = F.lit(-1)

    def positions(test) -> Column:
        return F.filter(F.transform(lines, lambda line, i: F.when(test(line), i)), lambda i: i.isNotNull())

    firsts = F.transform(items, lambda it: F.get(positions(lambda line: F.contains(line, it["item_name"])), F.lit(0)))

    def locate(start: Column) -> Column:
        def place(it: Column) -> Column:
            exact = F.filter(positions(lambda line: F.contains(line, it["item_name"])), lambda i: i >= start)
            loose = F.filter(positions(lambda line: word_overlap(it["item_name"], line) >= words_needed(it["item_name"])),
                             lambda i: i >= start)
            return F.coalesce(F.get(exact, F.lit(0)), F.get(loose, F.lit(0)))

        placed = F.transform(items, lambda it, k: F.struct(place(it).alias("line"), k.alias("k"), it.alias("item")))
        kept = F.sort_array(F.filter(placed, lambda x: x["line"].isNotNull() & start.isNotNull()))
        return bind(kept, lambda rows: F.struct(
            F.when(F.size(rows) > 0, start).otherwise(nowhere).cast("int").alias("start"),
            F.coalesce(F.array_max(F.transform(rows, lambda x: x["line"])), nowhere).cast("int").alias("end"),
            F.transform(rows, lambda x: F.struct(
                x["line"].alias("line"), F.get(lines, x["line"]).alias("content"), x["item"].alias("item"))).alias("items")))

    return bind(F.array_min(firsts), locate)


def lines_outside_items(lines: Column, section: Column) -> Column:
    """Lines before and after the item section with their positions."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), line.alias("line")))
    return F.filter(numbered, lambda x: (x["pos"] < section["start"]) | (x["pos"] > section["end"]))


# --- pattern libraries ----------------------------------------------------------

def library_item_scores(items: Column) -> Column:
    """For each library item pattern, in library order, the number of located
    items whose corrected values it reads back."""
    def reads_back(pat: str, groups: dict[str, int]):
        names = ("item_name", "total_price", "quantity")
        whole, reading = whole_line(F.lit(pat)), F.lit("".join(f"{MARK}${groups[name]}" for name in names))

        def same(parts: Column, wanted: Column) -> Column:
            name, total, quantity = (F.get(parts, F.lit(i + 1)) for i in range(3))
            good = (F.size(parts) > 1) & (F.contains(name, wanted["item_name"]) | F.contains(wanted["item_name"], name))
            return good & (total == wanted["total_price"]) & (wanted["quantity"].isNull() | (quantity == wanted["quantity"]))

        def test(it: Column) -> Column:
            line = it["content"]
            read = F.split(F.regexp_replace(line, whole, reading), MARK)
            return holds(line, pat) & bind(read, lambda parts: same(parts, it["item"]))

        return test

    return F.array(*[F.size(F.filter(items, reads_back(p, g))) for p, g in fixed.ITEM_PATTERNS])


def _group_map(groups: dict[str, int | None]) -> Column:
    pairs = [x for name, index in groups.items() for x in (F.lit(name), F.lit(index).cast("int"))]
    return F.create_map(*pairs)


def derive_item_pattern(items: Column) -> Column:
    """Pattern for the items of a corrected receipt: the library pattern that reads
    most of them, if at least half; else one shaped after the first item's line."""
    library = F.array(*[F.struct(F.lit(p).alias("pattern"), _group_map(g).alias("groups")) for p, g in fixed.ITEM_PATTERNS])

    def choose(scores: Column) -> Column:
        best = F.array_max(scores)
        winner = F.get(library, (F.array_position(scores, best) - 1).cast("int"))
        first = F.get(items, F.lit(0))
        line, item = first["content"], first["item"]
        blocks = F.regexp_count(line, F.lit(r"[A-Za-z]{2,}(?:\s+[A-Za-z]+)*"))
        numbers = F.regexp_count(line, F.lit(r"(?U)\d+(?:\.\d+)?"))
        quantity = F.coalesce(item["quantity"], F.lit("1"))
        implicit = (quantity == "1") & ~line.rlike(r"(?U)\b1\b")
        literal = F.concat(F.lit(".*("), regex_escape(quantity), F.lit(").*("),
                           regex_escape(item["item_name"]), F.lit(").*("), regex_escape(item["total_price"]), F.lit(").*"))
        three = _group_map({"quantity": 1, "item_name": 2, "total_price": 3})
        shaped = (
            F.when((numbers >= 2) & (blocks > 0) & implicit, F.struct(
                F.lit(fixed.CUSTOM_ITEM_PRICE).alias("pattern"),
                _group_map({"item_name": 1, "total_price": 2, "quantity": None}).alias("groups")))
            .when((numbers >= 2) & (blocks > 0), F.struct(
                F.lit(fixed.CUSTOM_QTY_ITEM_PRICE).alias("pattern"), three.alias("groups")))
            .otherwise(F.struct(literal.alias("pattern"), three.alias("groups"))))
        return F.when(F.size(items) > 0, F.when(best >= F.size(items) * F.lit(fixed.ITEM_COVERAGE), winner).otherwise(shaped))

    return bind(library_item_scores(items), choose)
