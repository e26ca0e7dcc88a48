"""Ledger tables derived from the test data.

Each table is one SELECT, written once with a few words that differ between
Spark SQL and DuckDB SQL, so both engines read the same input. Nothing here is
needed to use the operators on tables of one's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class DuckWords:
    """Words of DuckDB SQL."""

    name = "duckdb"
    empty_map = "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))"
    empty_numbers = "CAST(MAP {} AS MAP(VARCHAR, DOUBLE))"
    newline = "chr(10)"
    pound = "'£'"

    def text(self, value: str) -> str:
        return quote(value)

    def table(self, name: str) -> str:
        return name

    def div(self, a, b):
        return f"({a} // {b})"

    def date(self, ts, style):
        return f"strftime({ts}, {quote(style)})"

    def add_seconds(self, ts, n):
        return f"({ts} + to_seconds({n}))"

    def joined(self, expr, order):
        return f"string_agg({expr}, chr(10) ORDER BY {order})"

    def listed(self, fields, order):
        return f"list({self.struct(fields)} ORDER BY {order})"

    def struct(self, fields):
        return "{" + ", ".join(f"{quote(k)}: {v}" for k, v in fields) + "}"

    def map(self, entries):
        return "MAP {" + ", ".join(f"{quote(k)}: {v}" for k, v in entries) + "}"

    def array(self, values):
        return "[" + ", ".join(values) + "]"

    def base64(self, text):
        return f"base64(encode({text}))"

    def order_joins(self):
        return f"""JOIN {self.table('orders')} ON o_orderkey = l_orderkey
    JOIN {self.table('supplier')} ON s_suppkey = suppkey
    JOIN {self.table('customer')} ON c_custkey = o_custkey"""

    def size_bytes(self, text):
        return f"strlen({text})"


class SparkWords(DuckWords):
    """Words of Spark SQL."""

    name = "spark"
    empty_map = "CAST(map() AS map<string,string>)"
    empty_numbers = "CAST(map() AS map<string,double>)"
    newline = "'\\n'"

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def text(self, value):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def table(self, name):
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def div(self, a, b):
        return f"({a} div {b})"

    def date(self, ts, style):
        words = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%-m": "M", "%-d": "d",
                 "T": "\\'T\\'"}
        for duck, spark in sorted(words.items(), key=lambda kv: -len(kv[0])):
            style = style.replace(duck, spark)
        return f"date_format({ts}, '{style}')"

    def add_seconds(self, ts, n):
        return f"({ts} + make_dt_interval(0, 0, 0, {n}))"

    def _sorted(self, fields, order):
        keys = [k.strip() for k in order.split(",")]
        parts = [f"'k{i}', {k}" for i, k in enumerate(keys)] + [f"'{k}', {v}" for k, v in fields]
        return f"sort_array(collect_list(named_struct({', '.join(parts)})))"

    def joined(self, expr, order):
        return f"array_join({self._sorted([('line', expr)], order)}.line, '\\n')"

    def listed(self, fields, order):
        inner = ", ".join(f"'{k}', x.{k}" for k, _ in fields)
        return f"transform({self._sorted(fields, order)}, x -> named_struct({inner}))"

    def struct(self, fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"

    def map(self, entries):
        return "map(" + ", ".join(f"'{k}', {v}" for k, v in entries) + ")"

    def array(self, values):
        return "array(" + ", ".join(values) + ")"

    def base64(self, text):
        return f"base64(encode({text}, 'UTF-8'))"

    def order_joins(self):
        """Orders meet their customers before the documents, so texts and items stay where their order is."""
        return f"""JOIN ({self.table('orders')} JOIN {self.table('customer')} ON c_custkey = o_custkey) ON o_orderkey = l_orderkey
    JOIN {self.table('supplier')} ON s_suppkey = suppkey"""

    def size_bytes(self, text):
        return f"octet_length({text})"


def money(w, cents: str) -> str:
    """Whole cents as text with two decimals."""
    return f"(CAST({w.div(cents, 100)} AS STRING) || '.' || lpad(CAST({cents} % 100 AS STRING), 2, '0'))"


ORDER = "l_linenumber, l_partkey, l_quantity, l_extendedprice"


def _quantity(number):
    return f"CAST(CAST({number} AS INT) AS STRING)"


def _cents(price):
    return f"CAST(round({price} * 100) AS BIGINT)"


def _item_lines(w):
    return f"""
    SELECT l_orderkey, l_suppkey, {ORDER},
           {_quantity("l_quantity")} AS quantity, upper(p_name) AS item_name,
           {money(w, _cents("l_extendedprice"))} AS total_price,
           {_cents("l_extendedprice")} AS item_cents
    FROM {w.table('lineitem')} JOIN {w.table('part')} ON l_partkey = p_partkey"""


def _documents_base(w):
    line = f"quantity || ' ' || item_name || ' ' || {w.pound} || total_price"
    noise = ["''", f"{w.newline} || '-----'", f"{w.newline} || 'EXTRA LARGE PACK'", f"'  ' || {w.newline} || '  '",
             f"{w.newline} || '. . . .'", f"{w.newline} || '*' || {w.newline} || '~~'",
             f"{w.newline} || 'Savings: -0.50'"]
    cases = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(noise))
    noisy = f"{line} || CASE (l_orderkey + l_linenumber * 3) % 7 {cases} END"
    fields = [("quantity", "quantity"), ("item_name", "item_name"), ("total_price", "total_price")]
    if isinstance(w, SparkWords):
        return _documents_once(w, line, noisy, fields)
    return f"""
    SELECT l_orderkey, min(l_suppkey) AS suppkey, count(*) AS n_items, sum(item_cents) AS items_cents,
           {w.joined(line, ORDER)} AS item_text, {w.joined(noisy, ORDER)} AS noisy_text,
           {w.listed(fields, ORDER)} AS items
    FROM item_lines GROUP BY l_orderkey"""


def _documents_once(w, line, noisy, fields):
    """The same rows, with one narrow list of items per document: texts and items are made of it where it has been gathered."""
    keys = [k.strip() for k in ORDER.split(",")]
    read = {"quantity": _quantity("x.l_quantity"), "item_name": "x.item_name", "total_price": money(w, _cents("x.l_extendedprice")),
            "l_linenumber": "x.l_linenumber"}

    def made(expr):
        return re.sub(r"\b(quantity|item_name|total_price|l_linenumber)\b", lambda m: read[m.group()], expr)

    def ordered(values):
        parts = [f"'k{i}', x.{k}" for i, k in enumerate(keys)] + [f"'{name}', {made(expr)}" for name, expr in values]
        return f"sort_array(transform(raw, x -> named_struct({', '.join(parts)})))"

    kept = ", ".join(f"'{k}', y.{k}" for k, _ in fields)
    return f"""
    SELECT l_orderkey, suppkey, n_items, items_cents, array_join({ordered([('line', line)])}.line, '\\n') AS item_text,
           array_join({ordered([('line', noisy)])}.line, '\\n') AS noisy_text, transform({ordered(fields)}, y -> named_struct({kept})) AS items
    FROM (SELECT l_orderkey, min(l_suppkey) AS suppkey, count(*) AS n_items, sum(item_cents) AS items_cents,
            collect_list(named_struct({', '.join(f"'{k}', {k}" for k in [*keys, 'item_name'])})) AS raw
          FROM item_lines GROUP BY l_orderkey)"""


def _receipt_base(w):
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return f"""
    SELECT o_orderkey AS receipt_id, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, suppkey, n_items,
           items_cents, item_text, noisy_text, items, s_name, c_mktsegment, c_nationkey,
           {cents} AS total_cents, {w.div(cents, 6)} AS tax_cents,
           CASE o_orderpriority WHEN '1-URGENT' THEN upper(replace(s_name, '#', ' '))
                WHEN '2-HIGH' THEN upper(replace(s_name, '#', ' ')) || ' EXPRESS'
                WHEN '3-MEDIUM' THEN 'SUPLIER ' || substr(s_name, 10)
                WHEN '4-NOT SPECIFIED' THEN replace(s_name, '#', ' ')
                ELSE 'MR ' || replace(s_name, '#', ' ') END AS merchant_line
    FROM documents_base
    {w.order_joins()}"""


def _text(w, items, junk=""):
    n = w.newline
    pay = "CASE o_orderstatus WHEN 'F' THEN 'VISA DEBIT CARD' WHEN 'O' THEN 'CASH TENDERED' ELSE 'PAYPAL' END"
    return (f"merchant_line || {n} || 'Date: ' || {w.date('o_orderdate', '%d/%m/%Y')} || {n} || "
            f"'Order: ' || CAST(receipt_id AS STRING) || {n} || {junk}{items} || {n} || "
            f"'SUBTOTAL ' || {w.pound} || {money(w, '(total_cents - tax_cents)')} || {n} || "
            f"'VAT: ' || {money(w, 'tax_cents')} || {n} || "
            f"'TOTAL ' || {w.pound} || {money(w, 'total_cents')} || {n} || {pay}")


def _ocr_receipts(w):
    return f"SELECT receipt_id, {_text(w, 'item_text')} AS ocr_text FROM receipt_base"


def _noisy_receipts(w):
    junk = f"'=====' || {w.newline} || '' || {w.newline} || "
    return f"SELECT receipt_id, {_text(w, 'noisy_text', junk)} AS ocr_text FROM receipt_base"


def _corrected_receipts(w):
    """Receipts with the values a user would have entered for them."""
    return f"""
    SELECT receipt_id, {_text(w, 'item_text')} AS ocr_text, merchant_line AS merchant_name,
           {w.date('o_orderdate', '%d/%m/%Y')} AS transaction_time, '' AS merchant_address,
           CAST(receipt_id AS STRING) AS reference_number, {money(w, 'total_cents')} AS total_amount,
           {money(w, '(total_cents - tax_cents)')} AS subtotal_amount, {money(w, 'tax_cents')} AS tax_amount,
           items AS cost_items
    FROM receipt_base"""


def _receipts(w):
    m = lambda cents: f"CAST({money(w, cents)} AS DECIMAL(10,2))"
    return f"""
    SELECT receipt_id, o_custkey AS employee, replace(s_name, '#', ' ') AS merchant_name,
           CASE WHEN receipt_id % 29 <> 0 THEN o_orderdate END AS transaction_time,
           c_mktsegment AS category,
           CASE WHEN receipt_id % 7 = 3 THEN NULL WHEN receipt_id % 11 = 5 THEN 'said "' || o_orderpriority || '"'
                ELSE o_orderpriority END AS description,
           CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
           CASE WHEN o_custkey % 5 <> 0 THEN {w.div('o_custkey', 10)} END AS approver,
           CASE c_nationkey % 3 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
           {m('total_cents')} AS total_amount, {m('(total_cents - tax_cents)')} AS subtotal_amount,
           CASE WHEN receipt_id % 13 = 0 THEN NULL WHEN receipt_id % 17 = 0 THEN CAST('0.00' AS DECIMAL(10,2))
                ELSE {m('tax_cents')} END AS tax_amount,
           CASE WHEN receipt_id % 4 <> 0 THEN 'T' || lpad(CAST(suppkey AS STRING), 6, '0') END AS template_used,
           CAST(receipt_id AS STRING) AS reference_number, o_orderdate AS upload_date,
           {w.add_seconds('o_orderdate', '3600')} AS created_at, items AS cost_items
    FROM receipt_base"""


# Extractors of the derived templates: field, patterns, line, offset.
TEMPLATE_EXTRACTORS = [
    ("merchant_name", [r"^([A-Z][A-Za-z0-9\s&.']+)$", r"^(.{5,50})$"], 0, 0),
    ("transaction_time", [r"Time:\s*(\d{1,2}:\d{2})", r"Date:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"], 1, 0),
    ("reference_number", [r"Order:\s*([A-Za-z0-9-]+)"], 2, 0),
    ("subtotal_amount", [r"SUBTOTAL\s*(\d+\.\d{2})"], -1, 1),
    ("tax_amount", [r"VAT:\s*(\d+\.\d{2})"], -1, 2),
    ("total_amount", [r"TOTAL\s*(\d+\.\d{2})"], -1, 3),
]
TEMPLATE_ITEM_PATTERN = r"(\d+(?:\.\d+)?)\s+([A-Za-z0-9\s&'.,\-]+?)\s+(\d+\.\d{2})"


def _templates(w):
    def extractor(patterns, line, offset):
        return w.struct([("expected_present", "true"), ("patterns", w.array([w.text(p) for p in patterns])),
                         ("line", str(line)), ("offset_from_last_item", str(offset)),
                         ("is_fuzzy_haystack", "false")])

    fields = [(f, extractor(p, l, o)) for f, p, l, o in TEMPLATE_EXTRACTORS]
    groups = w.map([("quantity", "1"), ("item_name", "2"), ("total_price", "3")])
    patterns = w.array([w.struct([("pattern", w.text(TEMPLATE_ITEM_PATTERN)), ("groups", groups)])])
    accuracy = w.map([("merchant_name", "CAST(60 + (k * 7) % 41 AS DOUBLE)"),
                      ("transaction_time", "CAST(40 + (k * 11) % 61 AS DOUBLE)"),
                      ("total_amount", "CAST(50 + (k * 3) % 60 AS DOUBLE)")])
    distances = w.map([("merchant_name", "CAST(k % 12 AS DOUBLE) * 0.75"),
                       ("total_amount", "CAST(k % 9 AS DOUBLE) - 1")])
    return f"""
    SELECT template_id, merchant_name, usage_count, CAST(40 + (k * 13) % 61 AS DOUBLE) AS success_rate,
           CAST((k * 7) % 60 AS DOUBLE) AS override_rate, CAST(k % 12 AS DOUBLE) * 0.75 AS avg_edit_distance,
           is_archived, CASE WHEN is_archived THEN last_used_at END AS archived_at, created_at,
           CASE WHEN k % 2 = 0 THEN last_used_at END AS updated_at, last_used_at,
           {w.struct([('iso_code', "CASE k % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'US' ELSE 'GBP' END"),
                      ('symbol', "CASE k % 7 WHEN 3 THEN 'GBP£' WHEN 4 THEN '' ELSE '£' END")])} AS currency_info,
           CASE WHEN k % 3 = 0 THEN {w.map(fields[:4])} ELSE {w.map(fields)} END AS field_extractors,
           true AS has_line_items, 3 AS line_items_start_line, {patterns} AS item_patterns,
           CASE WHEN k % 10 = 7 THEN {w.empty_numbers}
                ELSE {accuracy} END AS field_accuracy,
           {distances} AS field_edit_distances,
           {w.struct([('last_30_days', 'usage_count'), ('total_merchant_uses', 'usage_count * 2'),
                      ('usage_percentage', 'CAST(k % 120 AS DOUBLE) - 5')])} AS recent_usage
    FROM (
      SELECT 'T' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS template_id, s_suppkey AS k,
             replace(s_name, '#', ' ') AS merchant_name, uses AS usage_count, s_suppkey % 4 = 1 AS is_archived,
             first_used AS created_at, last_used AS last_used_at
      FROM {w.table('supplier')} JOIN supplier_use ON s_suppkey = l_suppkey
      UNION ALL
      SELECT 'V' || lpad(CAST(s_suppkey AS STRING), 6, '0'), s_suppkey + 1,
             upper(replace(s_name, '#', ' ')),
             {w.div('uses', 3)}, s_suppkey % 4 = 3, first_used, last_used
      FROM {w.table('supplier')} JOIN supplier_use ON s_suppkey = l_suppkey WHERE s_acctbal > 2000) AS rows_"""


def _supplier_use(w):
    return f"""SELECT l_suppkey, CAST(count(*) AS INT) AS uses, min(l_shipdate) AS first_used,
               max(l_shipdate) AS last_used FROM {w.table('lineitem')} GROUP BY l_suppkey"""


def _jobs(w):
    ext = "CASE event_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' ELSE '' END"
    expires = w.date(w.add_seconds("ts", "14400"), "%Y-%m-%dT%H:%M:%S")
    return f"""
    SELECT 'J' || lpad(CAST(event_id AS STRING), 10, '0') AS job_id, CAST(user_id AS STRING) AS user_id, status,
           'scan_' || CAST(event_id AS STRING) || {ext} AS original_filename,
           CASE event_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf'
                ELSE 'application/json' END AS file_type,
           CASE event_id % 6 WHEN 0 THEN {w.empty_map} WHEN 1 THEN {w.map([('temp_expiration', "'soon'")])}
                ELSE {w.map([('temp_expiration', expires), ('source', 'event_type')])} END AS metadata,
           CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'gone'
                ELSE 'T' || lpad(CAST(user_id % 10 AS STRING), 6, '0') END AS template_used,
           CAST(event_id % 101 AS DOUBLE) / 100 AS template_correspondence,
           props AS extracted_data, CASE WHEN event_id % 3 = 0 THEN '{{"total_amount":"1.00"}}' END AS user_corrections,
           CASE WHEN status = 'failed' AND event_id % 2 = 0 THEN 'unreadable' END AS error_message,
           ts AS created_at, {w.add_seconds('ts', 'event_id % 600')} AS updated_at,
           CASE WHEN status <> 'pending' THEN {w.add_seconds('ts', '1')} END AS processing_started,
           CASE WHEN status IN ('completed', 'confirmed', 'failed') AND event_id % 3 <> 0
                THEN {w.add_seconds('ts', '1 + event_id % 300')} END AS processing_completed
    FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'discarded' WHEN event_id % 13 = 0 THEN 'abandoned'
                 WHEN event_id % 17 = 0 THEN 'queued' WHEN event_type = 'signup' THEN 'pending'
                 WHEN event_type = 'view' THEN 'processing' WHEN event_type = 'click' THEN 'completed'
                 WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'failed' END AS status
          FROM {w.table('events')}) AS e"""


def _job_events(w):
    return f"""
    SELECT CAST(user_id AS STRING) || '-' || {w.date('ts', '%Y%m%d')} AS job_id, event_id, ts,
           CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed'
                WHEN 'purchase' THEN 'confirmed' ELSE 'failed' END AS status
    FROM {w.table('events')}"""


def _corrections(w):
    """One row per corrected field; five fields share a correction."""
    return f"""
    SELECT {w.div('event_id', 5)} AS correction_id, {w.div('event_id', 5)} % 20 AS template_id,
           'J' || CAST({w.div('event_id', 15)} AS STRING) AS job_id, ts,
           CASE event_id % 5 WHEN 0 THEN 'merchant_name' WHEN 1 THEN 'transaction_time' WHEN 2 THEN 'total_amount'
                WHEN 3 THEN 'tax_amount' ELSE 'reference_number' END AS field,
           CASE WHEN event_id % 8 = 6 THEN NULL ELSE text END AS extracted,
           CASE event_id % 4 WHEN 0 THEN text WHEN 1 THEN upper(text) WHEN 2 THEN replace(text, 'e', 'xyz') || ' ltd'
                ELSE CASE WHEN event_id % 8 = 7 THEN '' ELSE 'unknown' END END AS corrected,
           CAST(1 + event_id % 7 AS INT) AS usage_count
    FROM (SELECT *, event_type || ' ' || CAST(CAST(value AS DECIMAL(12,2)) AS STRING) AS text
          FROM {w.table('events')}) AS e"""


def _merge_inputs(w):
    amount = "CAST(CAST(value AS DECIMAL(12,2)) AS STRING)"
    day = w.date("ts", "%d/%m/%Y")
    extracted = w.map([("merchant_name", "'Shop ' || CAST(user_id AS STRING)"), ("total_amount", amount),
                       ("transaction_time", day), ("reference_number", "CAST(event_id AS STRING)")])
    bare = w.map([("transaction_time", "''"), ("subtotal_amount", amount)])
    empty_total = w.map([("total_amount", "''"), ("tax_amount", "'1.25'")])
    renamed = w.map([("merchant_name", "upper(event_type)"), ("currency", "'EUR'"),
                     ("transaction_time", w.date("ts", "%Y-%m-%dT%H:%M:%S"))])
    described = w.map([("category", "event_type"), ("description", "props")])
    item = w.map([("item_name", "event_type"), ("unit_price", amount), ("quantity", "'2'"), ("total_price", amount)])
    other = w.map([("item_name", "'second ' || event_type"), ("total", amount)])
    return f"""
    SELECT 'J' || lpad(CAST(event_id AS STRING), 10, '0') AS job_id, CAST(user_id AS STRING) AS user_id, ts, props,
           CASE WHEN event_id % 9 = 4 THEN {bare} ELSE {extracted} END AS extracted,
           CASE WHEN event_id % 2 = 0 THEN {described} ELSE {w.empty_map} END AS descriptions,
           CASE event_id % 3 WHEN 0 THEN {w.empty_map} WHEN 1 THEN {empty_total} ELSE {renamed} END AS corrections,
           {w.array([item, other])} AS cost_items,
           CASE WHEN event_id % 3 = 1 THEN {w.array([item])} ELSE {w.array([item, other])} END AS corrected_items
    FROM {w.table('events')}"""


def _date_strings(w):
    styles = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S"]
    cases = " ".join(f"WHEN {i} THEN {w.date('o_orderdate', s)}" for i, s in enumerate(styles))
    return f"""SELECT o_orderkey AS id, CASE o_orderkey % 8 {cases} WHEN 5 THEN '' WHEN 6 THEN '99 May'
               ELSE NULL END AS s FROM {w.table('orders')}"""


def _users(w):
    return f"""SELECT c_custkey AS user_id, c_name || '@Example.com' AS email, c_acctbal > 0 AS is_active,
               c_custkey % 50 = 0 AS is_staff FROM {w.table('customer')}"""


def _profiles(w):
    """Some users have two profiles, some none; some managers do not exist."""
    def rows(offset, where):
        return f"""SELECT c_custkey + {offset} AS profile_id, c_custkey AS user_id,
          'E' || lpad(CAST(c_custkey % 1000 + {offset} AS STRING), 8, '0') AS employee_id,
          c_name AS first_name, n_name AS last_name, c_mktsegment AS department,
          CASE c_custkey % 3 WHEN 0 THEN 'Clerk' WHEN 1 THEN 'Buyer' ELSE 'Lead' END AS position,
          CASE WHEN c_custkey % 13 = 0 OR {w.div('c_custkey', 10)} = 0 THEN NULL
               WHEN c_custkey % 17 = 0 THEN -1 ELSE {w.div('c_custkey', 10)} END AS manager
          FROM {w.table('customer')} JOIN {w.table('nation')} ON c_nationkey = n_nationkey WHERE {where}"""

    return rows(0, "c_acctbal > -500") + " UNION ALL " + rows(10000000, "c_acctbal > 9000")


def _settings(w):
    return f"""SELECT c_custkey AS user_id,
        CASE c_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' END AS default_currency,
        CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN -5
             ELSE {w.div('c_custkey', 10)} END AS expense_approver,
        CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS STRING) AS monthly_expense_limit
        FROM {w.table('customer')} WHERE c_mktsegment <> 'BUILDING'"""


def _tokens(w):
    return f"""SELECT 'jti-' || CAST(event_id AS STRING) AS token_jti, CAST(user_id AS STRING) AS user_id,
        ts AS blacklisted_at, {w.add_seconds('ts', '86400')} AS expires_at
        FROM {w.table('events')} WHERE event_type = 'signup'"""


def _landing_files(w):
    ext = ["'.jpg'", "'.png'", "'.pdf'", "'.tiff'", "'.json'", "'.exe'", "''"]
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(ext))
    return f"""SELECT 'jobs/J' || lpad(CAST(page_id AS STRING), 10, '0') || '/scan_' || CAST(page_id AS STRING) ||
        CASE page_id % 7 {cases} END AS path, 'J' || lpad(CAST(page_id AS STRING), 10, '0') AS job_id,
        html AS content, {w.size_bytes('html')} * (1 + page_id % 5 * 600) AS length,
        {w.add_seconds("TIMESTAMP '2024-01-01 00:00:00'", 'page_id * 7000')} AS modified_at
        FROM {w.table('pages')}"""


DERIVED: dict[str, tuple[tuple[str, ...], Callable]] = {
    "item_lines": ((), _item_lines),
    "documents_base": (("item_lines",), _documents_base),
    "receipt_base": (("documents_base",), _receipt_base),
    "ocr_receipts": (("receipt_base",), _ocr_receipts),
    "noisy_receipts": (("receipt_base",), _noisy_receipts),
    "corrected_receipts": (("receipt_base",), _corrected_receipts),
    "receipts": (("receipt_base",), _receipts),
    "supplier_use": ((), _supplier_use),
    "templates": (("supplier_use",), _templates),
    "jobs": ((), _jobs),
    "job_events": ((), _job_events),
    "corrections": ((), _corrections),
    "merge_inputs": ((), _merge_inputs),
    "date_strings": ((), _date_strings),
    "users": ((), _users),
    "profiles": ((), _profiles),
    "settings": ((), _settings),
    "tokens": ((), _tokens),
    "landing_files": ((), _landing_files),
}


def with_tables(words, names, body: str) -> str:
    """``WITH`` clause of the named derived tables and all they need, then the body."""
    done: dict[str, str] = {}

    def visit(name):
        if name in done:
            return
        needs, build = DERIVED[name]
        for other in needs:
            visit(other)
        done[name] = f"{name} AS ({build(words)})"

    for name in names:
        visit(name)
    return ("WITH " + ", ".join(done.values()) + " " if done else "") + body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived one as a lazy Spark plan."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(with_tables(SparkWords(sf_dir), [name], f"SELECT * FROM {name}"))


def duck_sql(names, body: str) -> str:
    """Body over derived tables as one DuckDB statement."""
    return with_tables(DuckWords(), names, body)
