"""The audit trail read as states: what changed in each entry, field by field, and what an entity was at a moment.

An entry carries the entity before and after as JSON objects, so a change needs no other row, and no window over an
entity's history: entries of an entity that changed a million times are spread like any others. A state is the newest
entry up to the moment, an aggregate with partial results in every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fields(json: Column) -> Column:
    """A JSON object as a map of its fields' texts; null for null and for what is no object."""
    return F.from_json(json, "map<string,string>")


def changes(log: DataFrame, *keep: str) -> DataFrame:
    """keep, field, old, new for each field that an entry (before_json, after_json) changed. A field that one side does not
    have is null there: all of a new entity's, and all of one that is gone."""
    none = F.create_map().cast("map<string,string>")
    read = log.select(*keep, F.coalesce(fields(F.col("before_json")), none).alias("_b"), F.coalesce(fields(F.col("after_json")), none).alias("_a"))
    names = F.array_union(F.map_keys("_b"), F.map_keys("_a"))
    each = read.select(*keep, "_b", "_a", F.explode(names).alias("field"))
    old, new = F.try_element_at("_b", F.col("field")), F.try_element_at("_a", F.col("field"))
    return each.select(*keep, "field", old.alias("old"), new.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))


def states(log: DataFrame, moments: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """(entity_type, entity_id, at, after_json) for the moments asked for (entity_type, entity_id, at): the entity after its
    newest entry up to the end of that day; null if that entry took it away. A moment before the first entry has no row."""
    asked = moments.select("entity_type", "entity_id", "at").distinct()
    up_to = log.join(asked, ["entity_type", "entity_id"]).filter(F.col(order[0]) <= F.col("at"))
    newest = F.max_by(F.struct("after_json"), F.struct(*order))  # a struct, so a null after it counts too
    return up_to.groupBy("entity_type", "entity_id", "at").agg(newest.alias("_n")).select("entity_type", "entity_id", "at", F.col("_n.after_json").alias("after_json"))
