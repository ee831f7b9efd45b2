"""Changes to billing entries and roles: what is billed is locked, and every change leaves a trail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import writes


def split_locked(entries: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(ids that may be changed, ids that are refused because the entry is billed)."""
    locked = entries.filter("billed").select(key)
    return ids.join(locked, key, "left_anti"), ids.join(locked, key, "left_semi")


def update(entries: DataFrame, patch: DataFrame, uid: str, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, refused, audit) after a patch."""
    allowed, refused = split_locked(entries, patch, key)
    after = writes.update(entries, allowed, key)
    touched = allowed.select(key)
    trail = writes.audit("billing_entry.update", "billing_entry", entries.join(touched, key, "left_semi"), after.join(touched, key, "left_semi"), uid, key)
    return after, refused, trail


def delete(entries: DataFrame, ids: DataFrame, uid: str, key: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, refused, audit) after rows are taken away."""
    allowed, refused = split_locked(entries, ids.select(key), key)
    gone = entries.join(allowed, key, "left_semi")
    trail = writes.audit("billing_entry.delete", "billing_entry", gone, gone.filter(F.lit(False)), uid, key)
    return entries.join(allowed, key, "left_anti"), refused, trail


def administer_roles(roles: DataFrame, assign: DataFrame, change: DataFrame, revoke: DataFrame, key: str = "auth_email") -> tuple[DataFrame, DataFrame]:
    """(roles, audit): assign those that have none yet, change, then revoke."""
    new = assign.join(roles, key, "left_anti").select(roles.columns)
    kept = writes.update(roles.unionByName(new), change, key).join(revoke.select(key), key, "left_anti")
    trail = (
        new.select(F.lit("role.assign").alias("action"), key)
        .unionByName(change.join(roles, key, "left_semi").select(F.lit("role.change").alias("action"), key))
        .unionByName(revoke.join(roles, key, "left_semi").select(F.lit("role.revoke").alias("action"), key))
    )
    return kept, trail
