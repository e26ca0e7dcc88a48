"""Money, date, name and item expressions of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(10,2)"


def parse_transaction_time(value: Column, now: Column) -> Column:
    """First of five formats that reads the text; empty means ``now``, unreadable NULL."""
    formats = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s"]
    parsed = F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in formats])
    return F.when(F.coalesce(F.length(value), F.lit(0)) == 0, now).otherwise(parsed)


def to_money(value: Column) -> Column:
    """Text to decimal(10,2); empty or missing is 0.00, junk NULL."""
    blank = F.coalesce(F.length(value), F.lit(0)) == 0
    return F.when(blank, F.lit("0.00").cast(MONEY)).otherwise(value.try_cast(MONEY))


def is_bad_money(value: Column) -> Column:
    """Text that is neither empty nor a number: it belongs into quarantine."""
    return (F.coalesce(F.length(value), F.lit(0)) > 0) & value.try_cast(MONEY).isNull()


def item_total(unit_price: Column, quantity: Column, total: Column) -> Column:
    """The given total, else unit price times quantity."""
    return F.coalesce(total, (unit_price * quantity).try_cast(MONEY))


def normalise_items(items: Column) -> Column:
    """Items of both naming styles as name, unit price, quantity and total.

    ``items`` is an array of maps from key to text; a key that is present wins
    even when it is empty, as in a merge by key presence.
    """
    def pick(item: Column, key: str, default: str) -> Column:
        return F.coalesce(item[key], F.lit(default))

    def build(item: Column) -> Column:
        quantity = pick(item, "quantity", "1")
        return F.struct(
            pick(item, "item_name", "Unknown Item").alias("item_name"),
            to_money(pick(item, "unit_price", "0.00")).alias("unit_price"),
            F.when(F.length(quantity) == 0, F.lit("1").cast(MONEY))
            .otherwise(quantity.try_cast(MONEY)).alias("quantity"),
            to_money(F.coalesce(item["total_price"], item["total"], F.lit("0.00"))).alias("total_price"),
        )

    return F.transform(items, build)


def file_extension(name: Column) -> Column:
    """Suffix with its dot; a name's leading dots start no suffix."""
    return F.regexp_extract(name, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)


def normalise_email(email: Column) -> Column:
    return F.lower(email)


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def format_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
