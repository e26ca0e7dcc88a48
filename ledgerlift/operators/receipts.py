"""Receipts: building, filtering, listing, merging, exporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.ledger import (MONEY, format_minute, item_total, normalise_items, parse_transaction_time, to_money)

# --- filters and order ------------------------------------------------------------


def scan_receipts(receipts: DataFrame, owner) -> DataFrame:
    return receipts.where(F.col("employee") == F.lit(owner))


def filter_receipts(receipts: DataFrame, start_date: str | None = None, end_date: str | None = None,
                    category: str | None = None, status: str | None = None) -> DataFrame:
    """Filters that are absent do nothing. A date without time is its midnight, so an
    ``end_date`` leaves out that day's later receipts."""
    if start_date:
        receipts = receipts.where(F.col("transaction_time") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        receipts = receipts.where(F.col("transaction_time") <= F.lit(end_date).cast("timestamp"))
    if category:
        receipts = receipts.where(F.col("category") == category)
    if status:
        receipts = receipts.where(F.col("status") == status)
    return receipts


def default_order(rows: DataFrame, time_column: str, tiebreak: str) -> DataFrame:
    """Newest first."""
    return rows.orderBy(F.col(time_column).desc_nulls_last(), tiebreak)


def limit_n(ordered: DataFrame, limit: str | None) -> DataFrame:
    """First n rows; a limit that is not all digits is ignored."""
    return ordered.limit(int(limit)) if limit and limit.isdigit() else ordered


def owned_by(requests: DataFrame, rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Adds ``allowed``: the row exists and belongs to the requesting user."""
    owners = rows.select(key, F.col(owner).alias("owner"))
    joined = requests.join(owners, key, "left")
    return joined.withColumn("allowed", F.coalesce(F.col("owner") == F.col("requester"), F.lit(False))).drop("owner")


def state_filter(rows: DataFrame, states: list[str], keep: bool = True) -> DataFrame:
    """Rows in the states, or outside of them. A missing state is outside."""
    inside = F.coalesce(F.col("status").isin(*states), F.lit(False))
    return rows.where(inside if keep else ~inside)


def older_than(rows: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(column) < now - F.expr(f"INTERVAL {int(days)} DAYS"))


# --- names of the two data formats ----------------------------------------------------

API_NAMES = {"merchant_name": "merchant_name", "transaction_time": "date", "total_amount": "total_amount",
             "merchant_address": "address", "reference_number": "reference", "tax_amount": "tax",
             "subtotal_amount": "subtotal_amount"}


def to_api_format(values: Column, items: Column) -> Column:
    """Fields under their outside names, '' when missing, with the item list."""
    fields = [F.coalesce(values[inner], F.lit("")).alias(outer) for inner, outer in API_NAMES.items()]
    listed = F.transform(F.coalesce(items, F.array().cast("array<map<string,string>>")), lambda i: F.struct(
        F.coalesce(i["item_name"], F.lit("")).alias("item"), F.coalesce(i["quantity"], F.lit("1")).alias("quantity"),
        F.coalesce(i["total_price"], F.lit("")).alias("total")))
    return F.struct(*fields, listed.alias("cost_list"))


def from_api_format(values: Column, items: Column) -> Column:
    """The inverse; currency defaults to USD and a quantity to 1. NULL input gives all defaults."""
    fields = [F.coalesce(values[outer], F.lit("")).alias(inner) for inner, outer in API_NAMES.items()]
    listed = F.transform(items, lambda i: F.struct(
        F.coalesce(i["item"], F.lit("")).alias("item_name"), F.coalesce(i["quantity"], F.lit("1")).alias("quantity"),
        F.coalesce(i["total"], F.lit("")).alias("total_price"), F.coalesce(i["unit_price"], F.lit("")).alias("unit_price")))
    return F.struct(*fields, F.coalesce(values["currency"], F.lit("USD")).alias("currency"), listed.alias("line_items"))


# --- building receipts -----------------------------------------------------------------

def merge_with_precedence(*maps: Column) -> Column:
    """Later maps win by key; a key that is present wins even with an empty value."""
    out = maps[0]
    for later in maps[1:]:
        out = F.map_concat(_without(out, later), later)
    return out


def _without(values: Column, other: Column) -> Column:
    return F.map_filter(values, lambda k, _: ~F.array_contains(F.map_keys(other), k))


def build_receipts(inputs: DataFrame, now: Column) -> DataFrame:
    """Receipts of confirmed jobs: extracted values, then descriptions, then corrections.

    Needs maps ``extracted``, ``descriptions``, ``corrections`` and the final ``items``
    (array of maps). The job's ``file_ref``, ``file_ext``, ``template_used`` and
    ``template_correspondence`` are taken over where the inputs have them; without one,
    the correspondence is 0. Amounts that are no number end up NULL and in ``quarantine``.
    """
    merged = inputs.withColumn("final", merge_with_precedence(F.col("extracted"), F.col("descriptions"), F.col("corrections")))

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col("final")[name], F.lit(default)).alias(name)

    def carried(name: str, kind: str = "string") -> Column:
        return (F.col(name) if name in inputs.columns else F.lit(None)).cast(kind)

    money = ("total_amount", "tax_amount", "subtotal_amount")
    return merged.select(
        "job_id", text("merchant_name", "Unknown Merchant"),
        parse_transaction_time(F.col("final")["transaction_time"], now).alias("transaction_time"),
        text("merchant_address", ""), text("reference_number", ""), text("category", "Uncategorized"),
        text("description", ""), text("currency", "GBP"), F.lit("pending").alias("status"),
        F.col("user_id").alias("employee"),
        *[to_money(F.col("final")[m]).alias(m) for m in money],
        normalise_items(F.col("items")).alias("cost_items"), carried("template_used").alias("template_used"),
        F.coalesce(carried("template_correspondence", "double"), F.lit(0.0)).alias("template_correspondence"),
        carried("file_ref").alias("file_ref"), carried("file_ext").alias("file_ext"),
        now.cast("timestamp").alias("upload_date"), now.cast("timestamp").alias("updated_at"),
        F.exists(F.array(*[to_money(F.col("final")[m]).isNull() for m in money]), lambda x: x).alias("quarantine"))


def explode_items(receipts: DataFrame) -> DataFrame:
    """One row per cost item; a receipt without items keeps one row."""
    return receipts.select("receipt_id", F.posexplode_outer("cost_items").alias("pos", "item"))


def fill_item_totals(items: DataFrame) -> DataFrame:
    return items.withColumn("total_price", item_total(F.col("unit_price"), F.col("quantity"), F.col("total_price")))


def new_receipts(candidates: DataFrame, existing: DataFrame, key: str = "job_id") -> DataFrame:
    """Receipts not yet in the ledger, so writing the same jobs again adds nothing."""
    return candidates.join(existing.select(key), key, "left_anti")


def replay_changes(changes: DataFrame, key: str, owner: str, columns: list[str], order: str | None = None) -> DataFrame:
    """One row per key and asking user: what their changes amount to, in ``order``, whatever stood there before.

    ``born`` is the place of the first create, ``reset`` place and operation of the last create or delete, and each
    column has its last value that isn't null (``last_*``), NULL if that was before the reset. All of it is maxima
    and minima, so changes may come in any order and are summed up before the shuffle; of changes with equal
    ``order`` (all, without one) a hash of the values decides.
    """
    place = F.struct(F.col(order) if order else F.lit(0), "op", F.xxhash64(key, owner, *columns).alias("tie"))
    placed = changes.withColumn("place_", place)
    sums = placed.groupBy(key, owner).agg(
        F.min(F.when(F.col("op") == "create", F.col("place_"))).alias("born"),
        F.max(F.when(F.col("op").isin("create", "delete"), F.struct("place_", "op"))).alias("reset"),
        *[F.max(F.when(F.col(c).isNotNull() & F.col("op").isin("create", "update"), F.col("place_"))).alias(f"at_{c}") for c in columns],
        *[F.max_by(c, F.when(F.col(c).isNotNull() & F.col("op").isin("create", "update"), F.col("place_"))).alias(f"new_{c}") for c in columns])
    since = lambda c: F.coalesce(F.col(f"at_{c}") >= F.col("reset.place_"), F.lit(True))
    return sums.select(key, owner, "born", "reset", *[F.when(since(c), F.col(f"new_{c}")).alias(f"last_{c}") for c in columns])


def upsert_receipts(old: DataFrame, changes: DataFrame, key: str, owner: str, order: str | None = None) -> DataFrame:
    """Table after a log of creates, partial updates and deletes (``op``), each by the user in ``owner``.

    Changes of a key compose by ``order``: an update leaves columns it does not give, a create starts a row anew, a
    delete ends it until the next create, and updates of a row that isn't there do nothing. A row belongs to the owner
    it has in the table, or else to who creates it first; what others do to it counts for nothing, so it can't
    hide a change of the owner's either.
    """
    columns = [c for c in old.columns if c not in (key, owner)]
    done = replay_changes(changes, key, owner, columns, order)
    op = F.coalesce(F.col("reset.op"), F.lit(""))
    changed = old.join(done, [key, owner], "left").where(op != "delete").select(
        key, owner, *[F.when(op == "create", F.col(f"last_{c}")).otherwise(F.coalesce(f"last_{c}", c)).alias(c) for c in columns])
    born = done.where("born is not null").join(old.select(key), key, "left_anti")
    first = born.groupBy(key).agg(F.min_by(F.struct(owner, "reset", *[f"last_{c}" for c in columns]), F.struct("born", owner)).alias("r")).select(key, "r.*")
    created = first.where(op == "create").select(key, owner, *[F.col(f"last_{c}").alias(c) for c in columns])
    return changed.unionByName(created)


# --- listings and exports -----------------------------------------------------------------

def receipt_listing(receipts: DataFrame, users: DataFrame, templates: DataFrame) -> DataFrame:
    """Receipts with the names behind their references; unknown references stay empty."""
    people = users.select(F.col("user_id"), F.col("email"))
    out = join_user(receipts, people, "employee", "employee_email")
    out = join_user(out, people, "approver", "approver_email")
    out = join_template(out, templates)
    return out.select(
        "receipt_id", F.col("merchant_name").alias("merchant"),
        F.coalesce(format_minute(F.col("transaction_time")), F.lit("N/A")).alias("date"),
        F.concat(F.col("total_amount").cast("string"), F.lit(" "), F.col("currency")).alias("amount"),
        "status", "employee_email", "approver_email", "template_merchant")


def join_user(rows: DataFrame, users: DataFrame, key: str, alias: str) -> DataFrame:
    return rows.join(users.select(F.col("user_id").alias(key), F.col("email").alias(alias)), key, "left")


def join_template(rows: DataFrame, templates: DataFrame, key: str = "template_used") -> DataFrame:
    names = templates.select(F.col("template_id").alias(key), F.col("merchant_name").alias("template_merchant"))
    return rows.join(names, key, "left")


def export_csv(receipts: DataFrame) -> DataFrame:
    """Nine columns of the export; a tax of zero or none is an empty cell."""
    tax = F.when(F.coalesce(F.col("tax_amount") != 0, F.lit(False)), F.col("tax_amount").cast("string")).otherwise("")
    return receipts.select(
        F.col("receipt_id").cast("string").alias("ID"), F.col("merchant_name").alias("Merchant"),
        format_minute(F.col("transaction_time")).alias("Date"), F.col("category").alias("Category"),
        F.col("description").alias("Description"), F.col("total_amount").cast("string").alias("Total Amount"),
        F.col("currency").alias("Currency"), tax.alias("Tax Amount"), F.col("status").alias("Status"))


JSON_TEXTS = ("merchant_address", "reference_number", "tax_amount", "category", "description", "total_amount", "subtotal_amount", "currency",
              "employee", "status", "approver")
JSON_NUMBERS = ("latitude", "longitude")


def export_json(receipts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Receipts as JSON texts with all columns of the ledger; ids and decimals are strings, items nested, [] without any.

    ``files`` (file_ref, content) adds the receipt's file in base64. Columns that the table lacks are null.
    """
    def have(name: str) -> Column:
        return F.col(name) if name in receipts.columns else F.lit(None)

    def text(name: str) -> Column:
        return have(name).cast("string").alias(name)

    def stamp(name: str) -> Column:
        return F.date_format(have(name).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(name)

    content = F.lit(None).cast("string")
    if files is not None:
        receipts = receipts.join(files.select("file_ref", F.base64("content").alias("file_")), "file_ref", "left")
        content = F.col("file_")
    item = lambda i: F.struct(i["item_name"].alias("item_name"), *[
        i[c].cast("string").alias(c) for c in ("unit_price", "quantity", "total_price")])
    items = F.transform("cost_items", item)
    body = F.struct(
        F.col("receipt_id").cast("string").alias("id"), text("template_used"), text("merchant_name"), stamp("transaction_time"),
        *[text(c) for c in JSON_TEXTS], stamp("upload_date"), content.alias("file"), text("file_ext"),
        *[have(c).cast("double").alias(c) for c in JSON_NUMBERS], text("location_name"),
        have("template_correspondence").cast("double").alias("template_correspondence"), stamp("created_at"), stamp("updated_at"),
        F.coalesce(items, F.array().cast("array<struct<item_name:string,unit_price:string,quantity:string,total_price:string>>")).alias("cost_items"))
    return receipts.select("receipt_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


CLIENT_COLUMNS = (("Title", "receipt_id"), ("Merchant", "merchant_name"), ("Time", "transaction_time"),
                  ("Address", "merchant_address"), ("Reference", "reference_number"), ("Cost", "total_amount"),
                  ("Description", "description"), ("Tax", "tax_amount"), ("Category", "category"))


def export_client_csv(receipts: DataFrame) -> DataFrame:
    """Nine display columns as text; a missing column or cell is empty."""
    def cell(column: str) -> Column:
        if column not in receipts.columns:
            return F.lit("")
        value = F.col(column)
        return F.coalesce(format_minute(value) if column == "transaction_time" else value.cast("string"), F.lit(""))

    return receipts.select(*[cell(column).alias(title) for title, column in CLIENT_COLUMNS])


def quoted_line(rows: DataFrame) -> DataFrame:
    """Each row as one line with every cell quoted and quotes doubled."""
    cells = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns]
    return rows.select(F.concat_ws(",", *cells).alias("line"))


# --- checks by table rules ------------------------------------------------------------------

def reconcile_total(receipts: DataFrame, tolerance: str = "0.01") -> DataFrame:
    """Receipt total against the sum of its items, within the receipt's own row."""
    items = F.aggregate("cost_items", F.lit(0).cast("decimal(20,2)"),
                        lambda acc, i: (acc + i["total_price"].cast("decimal(20,2)")).cast("decimal(20,2)"))
    with_sum = receipts.withColumn("items_total", items)
    gap = F.abs(F.col("total_amount") - F.col("items_total"))
    return with_sum.withColumn("reconciled", gap <= F.lit(tolerance).cast(MONEY))


def currency_to_iso(symbol: Column) -> Column:
    """Three-letter code of an unambiguous symbol, else NULL."""
    out = F.lit(None).cast("string")
    for sign, code in fixed.CURRENCY_CODES.items():
        out = F.when(symbol == sign, F.lit(code)).otherwise(out)
    return out


def categorise(text: Column) -> Column:
    """First category with a keyword in the text, else OTHER."""
    lower = F.lower(text)
    hits = [F.when(lower.rlike("|".join(words)), F.lit(name)) for name, words in fixed.CATEGORY_KEYWORDS]
    return F.coalesce(*hits, F.lit("OTHER"))


def payment_methods(text: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(text.rlike(rf"(?i)\b(?:{words})\b"), F.lit(name)) for name, words in fixed.PAYMENT_NAMES]))


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(window)).where("rn = 1").drop("rn")
