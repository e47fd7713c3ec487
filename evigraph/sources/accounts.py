"""Accounts of a service as a keyed table: who may ask, who decided, who wants news.

Sign-in, cookies and mail are not Spark's business; what is asked of the table is here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph import schemas as S
from evigraph.functions.text import ColumnLike, col
from evigraph.sources.stores import KeyedTable

# The states of an account, and who decided on one that a setting approves.
STATUSES = ("pending", "approved", "rejected", "disabled")
BY_SETTING = "ADMIN_EMAILS"
# End of fixed values.


def accounts(spark: SparkSession, path: str) -> KeyedTable:
    """The table of accounts, by lower-cased address."""
    return KeyedTable(spark, path, S.ACCOUNTS, ["email"])


def listed(*settings: ColumnLike) -> Column:
    """The distinct addresses of some comma-separated settings, in order."""
    each = F.flatten(F.array(*[F.split(F.lower(F.coalesce(col(s), F.lit(""))), ",") for s in settings]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(each, lambda e: F.trim(e)), lambda e: e != "")))


def by_status(table: DataFrame, status: str | None = None) -> DataFrame:
    """Accounts of a state, or all, the newest first."""
    some = table if status is None else table.where(F.col("status") == status)
    return some.orderBy(F.desc("created_at"), "email")


def subscribers(table: DataFrame) -> DataFrame:
    """(email, name) of approved accounts that want news."""
    return table.where("status = 'approved' AND updates_opt_in").select("email", "name")


def decided(table: DataFrame, emails: DataFrame, status: str, by: str, at: Column) -> DataFrame:
    """The accounts among ``emails`` as a decision leaves them, to be put into the table."""
    if status not in STATUSES:
        raise ValueError(f"an account is {', '.join(STATUSES)}")
    hit = table.join(emails.select(F.lower("email").alias("email")).distinct(), "email", "left_semi")
    return hit.withColumns({"status": F.lit(status), "decided_at": at, "decided_by": F.lit(by)})


def promoted(table: DataFrame, admins: DataFrame, at: Column) -> DataFrame:
    """The accounts among ``admins`` that were no approved administrators, as such; an earlier decision stays noted."""
    hit = table.join(admins.select(F.lower("email").alias("email")).distinct(), "email", "left_semi")
    changed = hit.where("role <> 'admin' OR status <> 'approved'")
    noted = {"decided_at": F.coalesce("decided_at", at), "decided_by": F.coalesce("decided_by", F.lit(BY_SETTING))}
    return changed.withColumns(noted | {"role": F.lit("admin"), "status": F.lit("approved")})
