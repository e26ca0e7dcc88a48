"""Users, profiles, settings and revoked tokens: joins and integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ledger import full_name, normalise_email
from .receipts import first_per_key


def user_profile(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each user with the first of their profiles, if any."""
    first = first_per_key(profiles, "user_id", "profile_id").select("user_id", "profile_id", "employee_id", "department")
    return users.join(first, "user_id", "left")


def profile_manager(profiles: DataFrame) -> DataFrame:
    managers = profiles.select(F.col("profile_id").alias("manager"), F.col("employee_id").alias("manager_employee_id"),
                               full_name(F.col("first_name"), F.col("last_name")).alias("manager_name"))
    return profiles.join(managers, "manager", "left")


def user_settings(users: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of every user; users without get the default currency and no approver."""
    approvers = users.select(F.col("user_id").alias("expense_approver"), F.col("email").alias("approver_email"))
    joined = users.select("user_id", "email").join(settings, "user_id", "left").join(approvers, "expense_approver", "left")
    return joined.withColumn("default_currency", F.coalesce("default_currency", F.lit("GBP")))


def account_listing(users: DataFrame, profiles: DataFrame, settings: DataFrame) -> DataFrame:
    """One row per profile with its user, manager and expense settings."""
    managed = profile_manager(profiles)
    people = user_settings(users, settings).select("user_id", "email", "default_currency", "monthly_expense_limit", "approver_email")
    return managed.join(people, "user_id", "left").select(
        "profile_id", "employee_id", full_name(F.col("first_name"), F.col("last_name")).alias("name"), "department",
        "position", "email", "manager_name", "default_currency", "monthly_expense_limit", "approver_email")


def last_login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Newest login per user; NULL for users who never logged in."""
    newest = logins.groupBy("user_id").agg(F.max("ts").alias("last_login"))
    return users.join(newest, "user_id", "left")


def cascade_delete(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def nullify_missing(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """References to parents that are gone become NULL."""
    known = parents.select(F.col(parent_key).alias(key), F.lit(True).alias("known")).distinct()
    return children.join(known, key, "left").withColumn(key, F.when(F.col("known"), F.col(key))).drop("known")


def drop_revoked(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Requests whose token is not on the revocation list."""
    return requests.join(tokens.select("token_jti"), "token_jti", "left_anti")


def revoked_only(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    return requests.join(tokens.select("token_jti"), "token_jti", "left_semi")


def unique_insert(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a batch with ``accepted``: the key is new, and the row the batch's first with
    it by ``order``, which is unique. First rows are found by a partial minimum, not by
    sorting all rows of a key."""
    known = existing.select(key).distinct().withColumn("known", F.lit(True))
    firsts = batch.groupBy(key).agg(F.min(order).alias(order)).withColumn("first", F.lit(True))
    accepted = F.col("first").isNotNull() & F.col("known").isNull()
    return batch.join(firsts, [key, order], "left").join(known, key, "left").withColumn("accepted", accepted).drop("known", "first")


def fk_valid(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Adds ``is_valid``: a given reference exists. A blank one is NULL and valid."""
    known = parents.select(F.col(parent_key).alias(key), F.lit(True).alias("known")).distinct()
    joined = rows.join(known, key, "left")
    return joined.withColumn("is_valid", F.col(key).isNull() | F.col("known").isNotNull()).drop("known")


def revoked_token_browse(tokens: DataFrame, unit: str = "day", search: str | None = None,
                         blacklisted_from: str | None = None, expires_to: str | None = None) -> DataFrame:
    """Number of revoked tokens per period after the filters given."""
    if search:
        tokens = tokens.where(F.contains("token_jti", F.lit(search)) | F.contains("user_id", F.lit(search)))
    if blacklisted_from:
        tokens = tokens.where(F.col("blacklisted_at") >= F.lit(blacklisted_from).cast("timestamp"))
    if expires_to:
        tokens = tokens.where(F.col("expires_at") <= F.lit(expires_to).cast("timestamp"))
    return tokens.groupBy(F.date_trunc(unit, "blacklisted_at").alias("period")).agg(F.count("*").alias("n"))


def with_clean_email(users: DataFrame) -> DataFrame:
    return users.withColumn("email", normalise_email(F.col("email")))
