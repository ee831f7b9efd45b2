"""Claims for drafting: for each discovery item, the claims of its matter that its words speak of most.

An index of the claims' terms with BM25 weights. Items meet claims on the words that they share, within their matter; claims
that a matter's items cannot tell apart are met as one. A word's rarity is that among all claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import narrow, written

#: Fixed values of the weighting: how fast repeated words saturate, how much length counts.
SATURATION, LENGTH = 1.2, 0.75


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def index(claims: DataFrame) -> DataFrame:
    """matter_id, claim_id, length, terms (each with its tf) from claims (matter_id, claim_id, text), as a table; a claim_id
    names one claim of its matter."""
    split = claims.select("matter_id", "claim_id", terms(F.col("text")).alias("w")).filter(F.size("w") > 0)
    often = F.transform(F.array_sort(F.array_distinct("w")), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))
    return written(split.select("matter_id", "claim_id", F.size("w").alias("length"), often.alias("terms")), "claims")


def weights(indexed: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (length, term, tf and others) with the weight of the term, whose rarity is that among all claims of the index."""
    whole = indexed.agg(F.count("*").alias("claims"), F.avg("length").alias("mean"))  # one row
    often = indexed.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.log(1 + (F.col("claims") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") * (SATURATION + 1) / (F.col("tf") + SATURATION * (1 - LENGTH + LENGTH * F.col("length") / F.col("mean")))
    return rows.join(narrow(often), "term").join(F.broadcast(whole)).withColumn("weight", rarity * damped)


def forms(words: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """matter_id, form, claim_ids: claims that no item (matter_id, term) of their matter can tell apart, since they have the
    same of its terms as often and are equally long, are one form; of its claims the k smallest, in order, stand for all."""
    asked = words.groupBy("matter_id").agg(F.collect_set("term").alias("_asked"))
    kept = F.filter("terms", lambda x: F.array_contains("_asked", x["term"]))
    met = indexed.join(asked, "matter_id").select("matter_id", "claim_id", F.struct("length", kept.alias("terms")).alias("form")).filter(F.size("form.terms") > 0)
    first = F.row_number().over(Window.partitionBy("matter_id", "form").orderBy("claim_id"))
    few = met.withColumn("_at", first).filter(F.col("_at") <= k)  # k of each are kept before they are shuffled
    return few.groupBy("matter_id", "form").agg(F.array_sort(F.collect_list("claim_id")).alias("claim_ids"))


def best_claims(items: DataFrame, indexed: DataFrame, k: int = 3) -> DataFrame:
    """item_id, claim_id, score, place of the k best claims of each item (matter_id, item_id, text); ties go to the
    smaller claim. Items that share no word with a claim have none. Items are held against the forms of the claims, which
    are far fewer: all claims of a form score the same, so the k smallest of each are enough."""
    words = items.select("matter_id", "item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    of = written(forms(words.select("matter_id", "term").distinct(), indexed, k), "forms")
    each = weights(indexed, of.select("matter_id", "form", F.col("form.length").alias("length"), F.explode("form.terms").alias("x")).select("matter_id", "form", "length", "x.*"))
    scores = words.join(each, ["matter_id", "term"]).groupBy("matter_id", "item_id", "form").agg(F.sum("weight").alias("score"))
    claims = scores.join(of, ["matter_id", "form"]).select("item_id", F.explode("claim_ids").alias("claim_id"), "score")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 9)), "claim_id"))
    return claims.withColumn("place", place).filter(F.col("place") <= k)
