"""Scalar functions as Column expressions: all of them stay inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CLOSED = ("closed", "archived")


def name_to_text(first: Column, last: Column) -> Column:
    return F.lower(F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))))


def name_struct_to_text(name: Column) -> Column:
    """Null in, null out."""
    return F.when(name.isNotNull(), name_to_text(name["first_name"], name["last_name"]))


def full_name(*parts: Column) -> Column:
    """All parts that are not blank, one space between them."""
    return F.array_join(F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda x: x != ""), " ")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a lower-cased text, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def ratio32(shared: Column, either: Column) -> Column:
    """A share as a 32-bit value, in a double; 0 of 0 is 0."""
    return F.when(either == 0, F.lit(0.0)).otherwise((shared / either).cast("float").cast("double"))


def similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    shared = F.size(F.array_intersect(x, y))
    return ratio32(shared, F.size(x) + F.size(y) - shared)


def substring_match(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def compute_amount(amount: Column, hours: Column, rate: Column) -> Column:
    return F.coalesce(amount, hours * rate)


def round2(x: Column) -> Column:
    """Half away from zero, on decimals."""
    return F.round(x, 2)


def balance_status(balance: Column, retainer: Column, pct: Column) -> Column:
    return F.when(balance < 0, "red").when(balance < retainer * pct, "yellow").otherwise("green")


def resolve_rate(is_pro_bono: Column, override: Column, role: Column, card_attorney: Column, card_paralegal: Column, default: Column) -> Column:
    card = F.when(role == "attorney", card_attorney).when(role == "paralegal", card_paralegal)
    return F.when(is_pro_bono, F.lit(0).cast("decimal(10,2)")).otherwise(F.coalesce(override, card, default))


def due_date(service: Column, days: Column) -> Column:
    """Service date and days (30 if missing or not positive); a weekend moves to Monday."""
    day = F.date_add(service, F.when(days > 0, days).otherwise(30).cast("int"))
    return F.date_add(day, F.when(F.weekday(day) == 5, 2).when(F.weekday(day) == 6, 1).otherwise(0))


def parse_date(text: Column) -> Column:
    """ISO date or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_sex(text: Column) -> Column:
    return F.when(F.lower(text).isin("male", "female", "other"), F.lower(text))


def strip_fences(text: Column) -> Column:
    """Text without a code fence around it."""
    opened = F.regexp_replace(F.trim(text), r"^```(json)?\s*\n?", "")
    return F.trim(F.regexp_replace(opened, r"\n?```\s*$", ""))


def slug_to_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def underscores(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def first_underscore(text: Column) -> Column:
    """Only the first one becomes a blank."""
    at = F.instr(text, "_")
    return F.when(at > 0, F.overlay(text, F.lit(" "), at, F.lit(1))).otherwise(text)


def display_name(short: Column, name: Column) -> Column:
    return F.coalesce(short, name)


def display_name_or(short: Column, name: Column) -> Column:
    """An empty short name counts as none."""
    return F.coalesce(F.nullif(short, F.lit("")), name)


def staff_display(staff_id: Column, first: Column, last: Column) -> Column:
    return F.coalesce(F.concat(first, F.lit(" "), last), F.concat(F.lit("Staff #"), staff_id.cast("string")))


def preview(text: Column, n: int = 120) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def head_tail(text: Column, head: int = 10_000, tail: int = 4_000, marker: str = "\n[...]\n") -> Column:
    """What an extractor is shown: the first characters and, of longer texts, the last ones."""
    return F.when(F.length(text) > head, F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(tail)))).otherwise(text)


def short_name(last: Column, matter_type: Column, year: int) -> Column:
    return F.concat(F.upper(last), F.lit(" - "), underscores(matter_type), F.lit(f" - {year}"))


def export_filename(matter: Column, request_type: Column) -> Column:
    return F.replace(F.concat(matter, F.lit(" - "), request_type, F.lit(".docx")), F.lit(" "), F.lit("_"))


def stored_path(matter_id: Column, kind: str, item_id: Column) -> Column:
    return F.concat(F.lit("matters/"), matter_id.cast("string"), F.lit(f"/{kind}/"), item_id.cast("string"), F.lit(".pdf"))


def md_block(line: Column) -> Column:
    return F.when(F.trim(line) == "", "blank").when(line.rlike(r"^\s*\d+\.\s+"), "numbered").when(line.rlike(r"^\s*[-*]\s+"), "bullet").otherwise("paragraph")


def md_plain(text: Column) -> Column:
    """Emphasis marks taken away, longest first."""
    for n in (3, 2, 1):
        text = F.regexp_replace(text, r"\*" * n + r"(.+?)" + r"\*" * n, "$1")
    return text


def effective_status(status: Column, needed: Column, response: Column, n_parts: Column) -> Column:
    """pending_attorney if nobody waits for the client and nothing is written yet."""
    empty = (F.trim(F.coalesce(response, F.lit(""))) == "") & (n_parts == 0)
    return F.when(~needed & (status == "pending_client") & empty, "pending_attorney").otherwise(status)


def confidence(hours: Column, description: Column) -> Column:
    return F.when((hours != 0) & (description != ""), "high").otherwise("low")


def is_closed(status: Column) -> Column:
    return status.isin(*CLOSED)


def coerce_request_type(value: Column) -> Column:
    return F.when(value.isin("interrogatories", "production", "disclosures", "admissions"), value).otherwise("interrogatories")


def on_increment(hours: Column, step: float) -> Column:
    return F.pmod(F.round(hours * 1000).cast("long"), F.lit(int(step * 1000))) == 0


def page_text(pages: Column, least: int = 20) -> Column:
    """Pages with text enough, joined by a blank line; the others need character recognition."""
    return F.array_join(F.filter(pages, lambda p: F.length(F.trim(p)) >= least), "\n\n")


def split_names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def field_diff(pairs: dict[str, tuple[Column, Column]], needs_current: bool) -> Column:
    """Map of field to (current, proposed) for the fields that change. Matters propose only where there is a
    current value; counsel also where there is none."""
    entries = F.array(*(F.struct(F.lit(k).alias("field"), a.cast("string").alias("current"), b.cast("string").alias("proposed")) for k, (a, b) in pairs.items()))
    truthy = lambda c: F.coalesce(c != "", F.lit(False))
    changed = F.filter(entries, lambda e: truthy(e["proposed"]) & (truthy(e["current"]) if needs_current else F.lit(True)) & ~e["current"].eqNullSafe(e["proposed"]))
    return F.map_from_entries(F.transform(changed, lambda e: F.struct(e["field"], F.struct(e["current"].alias("current"), e["proposed"].alias("proposed")))))
