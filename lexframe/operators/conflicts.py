"""Conflict-of-interest search: by substring and by trigram similarity.

No search compares all names with all, but where a few names are compared with every subject in one scan. Many meet
their subjects on what is rare in them: the trigram search on the rarest trigrams that a similar name cannot all lack,
with bounds on length, verified by intersection; the substring search on the needle's rarest piece. What all names
begin with is never met on, unless a name has nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar

#: This many names are broadcast and compared with every subject; more are joined on pieces.
FEW = 100
#: Tasks for each core when every subject is compared.
SPREAD = 3


def subjects(clients: DataFrame, parties: DataFrame) -> DataFrame:
    """source, entity_id, name of everyone a new client may conflict with."""
    a = clients.select(F.lit("client").alias("source"), F.col("id").alias("entity_id"), scalar.name_to_text(F.col("first_name"), F.col("last_name")).alias("name"))
    b = parties.select(F.lit("opposing_party").alias("source"), F.col("id").alias("entity_id"), F.lower("full_name").alias("name"))
    return a.unionByName(b)


def rarest_first(searched: DataFrame, held: DataFrame) -> DataFrame:
    """searched (search, _q: its grams) with the grams in the order of how many of the held names have them."""
    grams = searched.select(F.explode("_q").alias("gram")).distinct()
    often = held.select(F.explode("_t").alias("gram")).join(grams, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    counted = searched.select("search", F.explode("_q").alias("gram")).join(often, "gram", "left")
    return counted.groupBy("search").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), lambda x: x["gram"]).alias("_q"))


def candidates(names: DataFrame, subjects: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may be similar, each once: search, _q and the subject's columns with _t. A subject over the threshold
    lacks at most a share of 1 - threshold of the search's grams, so it has one of the rarest that are left when so many
    are put aside; it is met on the first of these that it has. Lengths that differ too much are never met."""
    searched = names.select("search").distinct().withColumn("_q", scalar.trigrams(F.lower("search"))).filter(F.size("_q") > 0)
    held = subjects.withColumn("_t", scalar.trigrams(F.col("name")))
    n = F.size("_q")
    prefix = F.slice("_q", F.lit(1), (n - F.ceil(threshold * n - 1e-6) + 1).cast("int"))
    q = rarest_first(searched, held).withColumn("_prefix", prefix).select("*", F.explode("_prefix").alias("gram"))
    met = q.join(held.select("*", F.explode("_t").alias("gram")), "gram")
    lengths = (F.size("_t") >= threshold * n - 1e-6) & (threshold * F.size("_t") - 1e-6 <= n)
    return met.filter(lengths & (F.element_at(F.array_intersect("_prefix", "_t"), 1) == F.col("gram"))).drop("gram", "_prefix")


def scanned(searched: DataFrame, subjects: DataFrame, threshold: float) -> DataFrame:
    """The same pairs and columns for a few searches: they are broadcast, and every subject is read once and split once. Names
    are few bytes and much work, and a file may hold very many: they are dealt to all tasks first."""
    spread = subjects.repartition(SPREAD * subjects.sparkSession.sparkContext.defaultParallelism, "source", "entity_id")
    held = spread.withColumn("_t", scalar.trigrams(F.col("name")))
    n = F.size("_q")
    return held.join(F.broadcast(searched), (F.size("_t") >= threshold * n - 1e-6) & (threshold * F.size("_t") - 1e-6 <= n))


def search_trigram(names: DataFrame, subjects: DataFrame, threshold: float = 0.3, few: int = FEW) -> DataFrame:
    """names (column search) against subjects: search, source, entity_id, matched_name, sim over the threshold. A few are
    compared in one scan, more meet their subjects on rare trigrams."""
    sim = scalar.ratio32(F.col("_k"), F.size("_q") + F.size("_t") - F.col("_k"))
    searched = names.select("search").distinct()
    if searched.limit(few + 1).count() <= few:
        grams = searched.withColumn("_q", scalar.trigrams(F.lower("search"))).filter(F.size("_q") > 0)
        met = scanned(grams, subjects, threshold)
    else:
        met = candidates(names, subjects, threshold)
    shared = F.explode(F.array(F.size(F.array_intersect("_q", "_t"))))  # a generator: the filter below does not work it out again
    found = met.select("*", shared.alias("_k")).withColumn("sim", sim)
    return found.filter(F.col("sim") > threshold).select("search", "source", "entity_id", F.col("name").alias("matched_name"), "sim")


def best_of_many(hits: DataFrame) -> DataFrame:
    """One row for each subject: the best score and the search that gave it."""
    best = F.max_by("search", F.struct("sim", "search"))
    return hits.groupBy("source", "entity_id", "matched_name").agg(F.max("sim").alias("sim"), best.alias("search"))


def search_substring(names: DataFrame, subjects: DataFrame, few: int = FEW) -> DataFrame:
    """names within subjects or the other way round; hits of names that are repeated are repeated. A few names are
    broadcast and compared with every subject in one scan. More meet their subjects on their rarest piece."""
    asked = names.filter(F.trim("search") != "").withColumn("search", F.lower("search"))
    if asked.limit(few + 1).count() <= few:
        return subjects.join(F.broadcast(asked), scalar.substring_match(F.col("name"), F.col("search"))).select("search", "source", "entity_id", "name")
    inside = contained(asked, "search", subjects, "name")
    around = contained(subjects, "name", asked, "search").filter(~F.contains("name", F.col("search")))
    columns = ("search", "source", "entity_id", "name")
    return inside.select(*columns).unionByName(around.select(*columns))


def contained(needles: DataFrame, needle: str, stacks: DataFrame, stack: str) -> DataFrame:
    """Rows of both where the needle's text lies in the stack's. They meet on one piece of the needle: that which the
    fewest stacks have. A needle with a piece that no stack has is in none."""
    of = needles.select(needle).distinct().select(needle, F.explode(own_pieces(F.col(needle))).alias("_piece"))
    held = stacks.select("*", F.explode(pieces(F.col(stack))).alias("_piece")).join(of.select("_piece").distinct(), "_piece", "left_semi")
    often = held.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = of.join(often, "_piece", "left").groupBy(needle).agg(F.min_by("_piece", F.struct(F.coalesce("_n", F.lit(0)), "_piece")).alias("_piece"))
    return needles.join(rarest, needle).join(held, "_piece").filter(F.contains(stack, F.col(needle)))


def own_pieces(text: Column) -> Column:
    """The substrings of three characters, or the text itself if it has no more."""
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(text) > 3, long).otherwise(F.array(text)))


def pieces(text: Column) -> Column:
    """All substrings of up to three characters, the empty one too."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))


def searched_names(full_name: str, others: str) -> list[str]:
    """The name and the comma-separated other ones, blank ones left out."""
    return [x for x in [full_name, *(y.strip() for y in others.split(","))] if x.strip()]


def names_to_search(full_name: Column, others: Column) -> Column:
    """The same, of columns: an array of the names to search for."""
    parts = F.transform(F.split(F.coalesce(others, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(F.concat(F.array(full_name), parts), lambda x: F.trim(x) != "")


def redacted(hits: DataFrame) -> DataFrame:
    return hits.select("source", "entity_id", F.lit("name").alias("matched_field"))
