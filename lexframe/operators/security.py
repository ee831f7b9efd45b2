"""Row-level security: a principal sees what its role's policies allow, and nothing else. `session` gives a session in
which every table is a secured view, so any SQL text there is bound by them; writes are judged on the rows as they were
and as they would be."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import surface

STAFF = ("attorney", "paralegal", "admin")


@dataclass(frozen=True)
class Principal:
    role: str
    client_id: int | None = None
    staff_id: int | None = None
    uid: str | None = None


def principals(logins: DataFrame, roles: DataFrame) -> DataFrame:
    """logins (uid) with role, client_id and staff_id of the user's row of roles; null where there is none."""
    return logins.join(roles.select("uid", "role", "client_id", "staff_id").filter("uid is not null"), "uid", "left")


def principal(uid: str, roles: DataFrame) -> Principal:
    """Who the login is; a login without a role is nobody."""
    row = roles.filter(F.col("uid") == uid).select("role", "client_id", "staff_id").first()
    return Principal(row.role, row.client_id, row.staff_id, uid) if row else Principal("none", uid=uid)


def require(principal: Principal, roles: tuple[str, ...]) -> None:
    if principal.role not in roles:
        raise PermissionError(f"role {principal.role} is not one of {', '.join(roles)}")


#: Tables that staff read as a whole, by role.
READERS = {
    **dict.fromkeys(("clients", "matters", "billing_splits", "opposing_parties", "billing_cycles", "billing_entries", "fee_agreements", "matter_events", "discovery_requests", "discovery_request_items", "discovery_responses"), STAFF),
    "offices": STAFF,
    "staff": STAFF,
    "matter_staff": STAFF,
    "matter_rate_overrides": STAFF,
    "trust_ledger": STAFF,
    "user_roles": ("admin",),
    "audit_log": ("admin",),
}
WRITERS = {"offices": ("admin",), "staff": ("admin",), "user_roles": ("admin",), "audit_log": (), "matter_staff": ("attorney", "admin"), "matter_rate_overrides": ("admin",), "trust_ledger": ("attorney", "admin")}
#: Tables of which clients see the rows of their own matters, and what else these rows must be.
OF_OWN_MATTERS = {"billing_cycles": "status = 'closed'", "billing_entries": "billed and billable", "fee_agreements": "true", "matter_events": "true", "discovery_requests": "true", "discovery_request_items": "true"}


def may_write(principal: Principal, table: str) -> bool:
    """Whether the role writes any row of the table: who reads it as a whole does, if nothing narrower is said."""
    return principal.role in WRITERS.get(table, READERS.get(table, ()))


def secure(df: DataFrame, table: str, principal: Principal, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a table that the principal may read; `tables` holds matters (and items) for the semi-joins."""
    if principal.role in READERS.get(table, ()):
        return df
    nothing = df.filter(F.lit(False))
    if table == "user_roles":
        return df.filter(F.col("uid") == principal.uid) if principal.uid else nothing
    if principal.role != "client" or principal.client_id is None:
        return nothing
    if table == "clients":
        return df.filter(F.col("id") == principal.client_id)
    if table == "matters":
        return df.filter(F.col("client_id") == principal.client_id)
    if table in OF_OWN_MATTERS:
        return df.filter(OF_OWN_MATTERS[table]).join(_own(principal, tables), "matter_id", "left_semi")
    if table == "discovery_responses":
        requests = _needed(tables, "discovery_requests").join(_own(principal, tables), "matter_id", "left_semi").select(F.col("id").alias("request_id"))
        return df.join(requests, "request_id", "left_semi")
    return nothing


def _needed(tables: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ValueError(f"what a client may read follows from {name}, which is not given")
    return tables[name]


def _own(principal: Principal, tables: dict[str, DataFrame]) -> DataFrame:
    return _needed(tables, "matters").filter(F.col("client_id") == principal.client_id).select(F.col("id").alias("matter_id"))


def writable_responses(df: DataFrame, principal: Principal, tables: dict[str, DataFrame]) -> DataFrame:
    """Responses that a client may still change: not final."""
    return secure(df, "discovery_responses", principal, tables).filter(~F.col("is_final"))


#: Tables that a session shows.
SECURED = tuple(READERS)


def session(spark: SparkSession, load: Callable[[SparkSession, str], DataFrame], who: Principal, tables: tuple[str, ...] = SECURED, **options: object) -> SparkSession:
    """A session in which SQL sees the rows that the principal may read, by the names of the tables; the functions and
    views of the practice are there too, over the same rows. load gives a table by session and name."""
    new = surface.own_session(spark)
    whole = {name: load(new, name) for name in ("matters", "discovery_requests")}

    def secured(name: str) -> DataFrame:
        rows = whole[name] if name in whole else load(new, name)
        return secure(rows, name, who, whole) if name in READERS else rows.filter(F.lit(False))

    surface.register(new, secured, tables=tables, **options)
    return new


def writable(df: DataFrame, table: str, principal: Principal, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of a table that the principal may write, as they are or as they would be."""
    if may_write(principal, table):
        return df
    if table == "discovery_responses" and principal.role == "client":
        return writable_responses(df, principal, tables)
    return df.filter(F.lit(False))


def refused_updates(table: str, before: DataFrame, patch: DataFrame, principal: Principal, tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(key, reason) of the rows of a patch that the principal may not write: "hidden", the row as it is, or "changed", the
    row as it would be. Rows that the table does not have are hidden too. A patch touches its own rows only."""
    return judged(table, before, patch, principal, tables, key).filter("reason <> 'written'")


def judged(table: str, before: DataFrame, patch: DataFrame, principal: Principal, tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(key, reason) of every row of a patch: hidden, changed, or written. The table meets the patch in one join, which
    carries the new values along; the policies narrow what it gives, twice, and the patch is told by what is left."""
    fields = [c for c in patch.columns if c != key]
    if not fields:
        raise ValueError("the patch has no field")
    asked = patch.select(key, F.struct(*(F.col(c).alias(c) for c in fields)).alias("_new"))
    shown = writable(before.join(asked, key), table, principal, tables)
    new = shown.withColumns({c: F.coalesce(F.col("_new")[c], F.col(c)) for c in fields if c in before.columns}).drop("_new")
    kept = writable(new, table, principal, tables).select(key, F.lit(2).alias("_stage"))
    stages = shown.select(key, F.lit(1).alias("_stage")).unionByName(kept).groupBy(key).agg(F.max("_stage").alias("_stage"))
    reason = F.when(F.col("_stage") == 2, "written").when(F.col("_stage") == 1, "changed").otherwise("hidden")
    return patch.select(key).join(stages, key, "left").select(key, reason.alias("reason"))


def update(table: str, before: DataFrame, patch: DataFrame, principal: Principal, tables: dict[str, DataFrame], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(table after the patch, refused rows): what the principal may not write is left as it is."""
    from .writes import update as patched

    refused = refused_updates(table, before, patch, principal, tables, key)
    return patched(before, patch.join(refused.select(key), key, "left_anti"), key), refused
