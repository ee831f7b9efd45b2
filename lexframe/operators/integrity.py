"""What a table's rows must be, as data: keys, references, values and totals. A batch is judged against the rows of the
tables that it touches, and a delete follows the references.

A table is never rescanned for what it holds already: it meets the batch's own keys (broadcast when they are few) in a
semi-join, and only the rows that are left are counted or summed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import narrow, written
from . import quality

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Reference:
    """child.column holds the id of a row of parent; on_delete: what happens to the child when that row goes."""

    child: str
    column: str
    parent: str
    on_delete: str


def _references(text: str) -> tuple[Reference, ...]:
    lines = (x.replace(".", " ").split() for x in text.strip().splitlines())
    return tuple(Reference(child, column, parent, " ".join(action)) for child, column, parent, *action in lines)


#: Child.column, parent and what a delete of the parent does.
REFERENCES = _references("""
staff.office_id offices restrict
matters.client_id clients restrict
matter_staff.matter_id matters cascade
matter_staff.staff_id staff restrict
billing_splits.matter_id matters cascade
billing_splits.client_id clients restrict
opposing_parties.matter_id matters cascade
matter_rate_overrides.matter_id matters cascade
matter_rate_overrides.staff_id staff restrict
billing_cycles.matter_id matters restrict
billing_cycles.closed_by_staff_id staff restrict
billing_entries.matter_id matters restrict
billing_entries.staff_id staff restrict
billing_entries.billing_cycle_id billing_cycles restrict
trust_ledger.matter_id matters restrict
trust_ledger.posted_by_staff_id staff restrict
fee_agreements.matter_id matters restrict
matter_events.matter_id matters cascade
matter_events.created_by_staff_id staff restrict
discovery_requests.matter_id matters cascade
discovery_requests.ingested_by_staff_id staff restrict
discovery_request_items.matter_id matters cascade
discovery_request_items.discovery_request_id discovery_requests cascade
discovery_responses.request_id discovery_requests cascade
user_roles.staff_id staff restrict
user_roles.client_id clients restrict
matter_children.matter_id matters cascade
matter_opposing_counsel.matter_id matters cascade
matter_opposing_counsel.counsel_id opposing_counsel cascade
matter_opposing_counsel.opposing_party_id opposing_parties set null
matter_pleadings.matter_id matters cascade
matter_pleadings.opposing_party_id opposing_parties set null
matter_pleadings.amends_pleading_id matter_pleadings set null
matter_claims.pleading_id matter_pleadings cascade
matter_claims.matter_id matters cascade
matter_claims.opposing_party_id opposing_parties set null
""")
#: Columns that are unique together; the first of a table is its key.
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "offices": (("id",),),
    "staff": (("id",), ("uid",), ("slug",)),
    "clients": (("id",), ("email",)),
    "matters": (("id",),),
    "matter_staff": (("matter_id", "staff_id", "role"),),
    "billing_splits": (("matter_id", "client_id"),),
    "opposing_parties": (("id",),),
    "matter_rate_overrides": (("matter_id", "staff_id"),),
    "billing_cycles": (("id",),),
    "trust_ledger": (("id",),),
    "fee_agreements": (("id",),),
    "matter_events": (("id",),),
    "discovery_requests": (("id",),),
    "discovery_request_items": (("discovery_request_id", "request_number"),),
    "discovery_responses": (("id",), ("request_id",)),
    "user_roles": (("auth_email",), ("uid",)),
    "matter_children": (("id",),),
    "opposing_counsel": (("id",), ("bar_state", "bar_number")),
    "matter_opposing_counsel": (("matter_id", "counsel_id", "opposing_party_id"),),
    "matter_pleadings": (("id",),),
}
#: Columns that are never null.
REQUIRED: dict[str, tuple[str, ...]] = {
    "staff": ("office_id", "role", "slug"), "clients": ("email", "status"), "matters": ("client_id", "matter_type", "status"), "matter_staff": ("matter_id", "staff_id", "role"),
    "billing_splits": ("matter_id", "client_id", "split_pct"), "opposing_parties": ("matter_id", "full_name"), "matter_rate_overrides": ("matter_id", "staff_id", "rate"),
    "billing_cycles": ("matter_id", "period_start", "period_end", "status"), "billing_entries": ("matter_id", "staff_id", "entry_type"), "trust_ledger": ("matter_id", "transaction_type", "amount"),
    "fee_agreements": ("matter_id", "status"), "matter_events": ("matter_id", "event_type"), "discovery_requests": ("matter_id", "request_type"), "discovery_request_items": ("matter_id", "request_number", "status"),
    "discovery_responses": ("request_id",), "user_roles": ("role",), "matter_children": ("matter_id", "sex"), "matter_opposing_counsel": ("matter_id", "counsel_id", "role"),
    "matter_pleadings": ("matter_id",), "matter_claims": ("pleading_id", "matter_id", "kind"),
}
_at_least = lambda c, n=0: ((c,), lambda: F.col(c) >= n)
_share = lambda c: ((c,), lambda: F.col(c).between(0, 1))
_of = lambda columns, rules: {name: (columns, lambda name=name: rules()[name]) for name in rules()}
Rule = tuple[tuple[str, ...], Callable[[], Column]]


def value_rules(name: str) -> dict[str, Rule]:
    """Rules on the values of one row of a table: the columns that each looks at, and the rule. Null holds."""
    money = ("hours", "rate", "amount")
    return {
        "matters": {"retainer_not_negative": _at_least("retainer_amount"), "trigger_is_a_share": _share("refresh_trigger_pct")},
        "matter_staff": {"split_is_a_percentage": (("split_pct",), lambda: F.col("split_pct").between(0, 100))},
        "billing_splits": {"split_is_a_percentage": (("split_pct",), lambda: (F.col("split_pct") > 0) & (F.col("split_pct") <= 100))},
        "matter_rate_overrides": {"rate_not_negative": _at_least("rate")},
        "billing_cycles": _of(("period_start", "period_end"), quality.period_rules),
        "billing_entries": {**_of(money, quality.range_rules), **_of(("entry_type", *money), quality.entry_type_rules)},
        "trust_ledger": {"amount_positive": (("amount",), lambda: F.col("amount") > 0)},
        "user_roles": _of(("role", "staff_id", "client_id"), quality.role_rules),
        "discovery_request_items": {"number_from_one": _at_least("request_number", 1)},
    }.get(name, {})


@dataclass(frozen=True)
class Total:
    """The sum of a column over the rows of a group that `which` picks is at most `most`."""

    rule: str
    group: str
    column: str
    most: int
    which: str = "true"


TOTALS = {"billing_splits": Total("splits_within_100", "matter_id", "split_pct", 100), "matter_staff": Total("originating_within_100", "matter_id", "split_pct", 100, "role = 'originating'")}


def key_of(name: str, columns: list[str]) -> list[str]:
    return [c for c in UNIQUE.get(name, (("id",),))[0] if c in columns] or columns[:1]


def shown_key(key: list[str]) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in key)).alias("key")


def needs(name: str, columns: list[str]) -> list[str]:
    """The tables that rows of this table are judged against, beside itself."""
    return sorted({r.parent for r in REFERENCES if r.child == name and r.column in columns and r.parent != name})


def violations(name: str, rows: DataFrame, held: DataFrame | None, parents: Tables, key: list[str] | None = None) -> DataFrame:
    """(rule, key) for each rule that a row of a batch breaks, with the table's rows (None: it has none yet) and the
    tables that it refers to. A batch must fit the rules as a whole: two rows of one key break it as one of each does."""
    if missing := [p for p in needs(name, rows.columns) if p not in parents]:
        raise ValueError(f"rows of {name} are judged against {', '.join(missing)}, which is not given")
    key = key or key_of(name, rows.columns)
    held = held if held is not None else rows.limit(0)
    tell = lambda bad, rule: bad.select(F.lit(rule).alias("rule"), shown_key(key))

    domains = {f"{name}.{c}": F.col(c).isin(*values) for (t, c), values in quality.DOMAINS.items() if t == name and c in rows.columns}
    required = {f"{c}_required": F.col(c).isNotNull() for c in REQUIRED.get(name, ()) if c in rows.columns}
    values = {rule: test() for rule, (columns, test) in value_rules(name).items() if set(columns) <= set(rows.columns)}
    found = []
    if rules := {**required, **domains, **values}:
        found.append(quality.failing(rows, rules, key).select("rule", shown_key(key)))

    for columns in (list(u) for u in UNIQUE.get(name, ()) if set(u) <= set(rows.columns)):
        own = rows.select(columns).dropna()
        there = held.select(columns).join(narrow(own.distinct()), columns, "left_semi")
        several = quality.repeated(own.unionByName(there), columns)
        found.append(tell(rows.join(several.select(columns), columns, "left_semi"), f"unique_{'_'.join(columns)}"))

    for r in REFERENCES:
        if r.child == name and r.column in rows.columns:
            wanted = rows.select(F.col(r.column).alias("id")).dropna().distinct()
            there = parents[r.parent].select("id") if r.parent != name else held.select("id").unionByName(rows.select("id"))
            known = there.join(narrow(wanted), "id", "left_semi").select(F.col("id").alias(r.column))
            found.append(tell(rows.filter(F.col(r.column).isNotNull()).join(known, r.column, "left_anti"), f"{r.column}_refers_to_{r.parent}"))

    total = TOTALS.get(name)
    if total and {total.group, total.column} <= set(rows.columns):
        pick = [total.group, total.column]
        own = rows.filter(total.which).select(pick)
        there = held.filter(total.which).select(pick).join(narrow(own.select(total.group).distinct()), total.group, "left_semi")
        over = own.unionByName(there).groupBy(total.group).agg(F.sum(total.column).alias("_sum")).filter(F.col("_sum") > total.most)
        found.append(tell(rows.filter(total.which).join(over.select(total.group), total.group, "left_semi"), total.rule))
    return reduce(DataFrame.unionByName, found) if found else rows.limit(0).select(F.lit("").alias("rule"), shown_key(key))


# deletes


@dataclass(frozen=True)
class Deletion:
    """tables: as they are afterwards. effects: (name, key, effect), a row for each row that goes ("deleted") or loses a
    reference ("set null"), and for each delete that was asked for and refused ("refused"). refused: their ids."""

    tables: Tables
    effects: DataFrame
    refused: DataFrame


def _edges(tables: Tables, action: str) -> list[Reference]:
    return [r for r in REFERENCES if r.on_delete == action and r.child in tables and r.parent in tables and r.column in tables[r.child].columns]


def _walk(tables: Tables, name: str) -> list[str]:
    """The tables that deletes from one can reach, parents first."""
    reach, todo, edges = {name}, [name], _edges(tables, "cascade")
    while todo:
        here = todo.pop()
        for r in edges:
            if r.parent == here and r.child not in reach:
                reach.add(r.child)
                todo.append(r.child)
    graph = {t: {r.parent for r in edges if r.child == t and r.parent in reach and r.parent != t} for t in reach}
    return list(TopologicalSorter(graph).static_order())


def delete(tables: Tables, name: str, ids: DataFrame) -> Deletion:
    """Rows of a table by id, and what follows from it along the references. Each id is a delete of its own, judged on the
    tables as they are: it is refused if a row that does not go with it still refers to what goes.

    Parents that go are (id, root): the row, and the delete that takes it. They are written once for each table that is
    itself referred to, so a deep graph does not repeat its joins."""
    order, cascades, restricts, nulls = _walk(tables, name), _edges(tables, "cascade"), _edges(tables, "restrict"), _edges(tables, "set null")
    referred = {r.parent for r in (*cascades, *restricts, *nulls)}
    asked = tables[name].select("id").join(narrow(ids.select("id").distinct()), "id", "left_semi")
    gone: Tables = {name: narrow(written(asked.select("id", F.col("id").alias("root")), "gone"))}

    def under(child: str, columns: list[Column]) -> DataFrame | None:
        """Rows of a child that go with some parent, with the delete that takes them."""
        found = [tables[child].select(*columns, F.col(r.column).alias("_to")).join(gone[r.parent].withColumnRenamed("id", "_to"), "_to").drop("_to") for r in cascades if r.child == child and r.parent in gone]
        return reduce(DataFrame.unionByName, found) if found else None

    for child in order:
        if child != name and child in referred and (rows := under(child, [F.col("id")])) is not None:
            gone[child] = written(rows.distinct(), "gone")
        if own := [r.column for r in cascades if r.child == r.parent == child]:
            gone[child] = _closed(tables[child], gone[child], own)
        if child in gone:
            gone[child] = narrow(gone[child])

    blocked = []
    for r in restricts:
        if r.parent in gone:
            goes_too = [c for c in cascades if c.child == r.child and c.parent in gone]
            rows = tables[r.child].filter(F.col(r.column).isNotNull()).select(F.col(r.column).alias("_to"), *(F.col(c.column).alias(f"_c{k}") for k, c in enumerate(goes_too)))
            rows = rows.join(gone[r.parent].withColumnRenamed("id", "_to"), "_to")
            for k, c in enumerate(goes_too):
                rows = rows.join(gone[c.parent].withColumnRenamed("id", f"_c{k}"), [f"_c{k}", "root"], "left_anti")
            blocked.append(rows.select("root"))
    refused = narrow(written((reduce(DataFrame.unionByName, blocked) if blocked else gone[name].limit(0).select("root")).distinct(), "refused"))
    dead = {t: narrow(written(rows.join(refused, "root", "left_anti").select("id").distinct(), "dead")) for t, rows in gone.items()}

    out, effects = dict(tables), [refused.select(F.lit(name).alias("name"), F.col("root").cast("string").alias("key"), F.lit("refused").alias("effect"))]
    for child, rows in tables.items():
        hit = [r for r in cascades if r.child == child and r.parent in dead] if child in order else []
        marked, key = rows, shown_key(key_of(child, rows.columns))
        tests = []
        for k, (column, parent) in enumerate([*((r.column, r.parent) for r in hit), *([("id", child)] if child in dead else [])]):
            marked = marked.join(dead[parent].select(F.col("id").alias(column), F.lit(True).alias(f"_gone{k}")), column, "left")
            tests.append(F.coalesce(f"_gone{k}", F.lit(False)))
        cut_off = [r for r in nulls if r.child == child and r.parent in dead]
        for k, r in enumerate(cut_off):
            marked = marked.join(dead[r.parent].select(F.col("id").alias(r.column), F.lit(True).alias(f"_null{k}")), r.column, "left")
        if not tests and not cut_off:
            continue
        goes = reduce(lambda a, b: a | b, tests, F.lit(False))
        lost = {r.column: F.coalesce(f"_null{k}", F.lit(False)) for k, r in enumerate(cut_off)}
        loses = reduce(lambda a, b: a | b, lost.values(), F.lit(False))
        effect = F.when(goes, "deleted").when(loses, "set null")
        effects.append(marked.select(F.lit(child).alias("name"), key, effect.alias("effect")).filter("effect is not null"))
        left = marked.filter(~goes).withColumns({c: F.when(~x, F.col(c)) for c, x in lost.items()})
        out[child] = left.select(rows.columns)
    return Deletion(out, reduce(DataFrame.unionByName, effects), refused.withColumnRenamed("root", "id"))


def _closed(table: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """gone with the rows of its own table that hang on it, to any depth: only what is new goes another round."""
    new = gone
    while new.limit(1).count():
        further = [table.select("id", F.col(c).alias("_to")).join(new.withColumnRenamed("id", "_to"), "_to").select("id", "root") for c in columns]
        new = written(reduce(DataFrame.unionByName, further).distinct().join(gone, ["id", "root"], "left_anti"), "gone")
        gone = written(gone.unionByName(new), "gone")
    return gone
