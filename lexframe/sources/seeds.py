"""Reference rows that a fresh installation has, by slug."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Privileges and their texts.
PRIVILEGES = (
    ("attorney-client", "The responding party objects to this request to the extent it calls for information protected by the attorney-client privilege."),
    ("work-product", "The responding party objects to this request to the extent it seeks materials protected by the attorney work product doctrine."),
    ("spousal-privilege", "The responding party objects to this request to the extent it calls for confidential communications between spouses."),
    ("fifth-amendment", "The responding party objects to this request on the grounds that a response may tend to incriminate the responding party, and therefore invokes the protections of the Fifth Amendment to the United States Constitution and Article I, Section 10 of the Texas Constitution."),
    ("trade-secret", "The responding party objects to this request to the extent it calls for information constituting a trade secret or other confidential commercial information protected under Texas Rule of Civil Procedure 76a."),
)
#: Objections, the request types they apply to and their texts.
OBJECTIONS = (
    ("relevance", ["*"], "The responding party objects to this request on the grounds that it is not relevant to any party's claims or defenses and is not proportional to the needs of this case."),
    ("overbroad", ["*"], "The responding party objects to this request as overbroad, unduly burdensome, and not proportional to the needs of this case."),
    ("vague", ["*"], "The responding party objects to this request as vague, ambiguous, and incapable of reasonably certain interpretation."),
    ("unduly-burdensome", ["*"], "The responding party objects to this request as unduly burdensome. The burden and expense of the proposed discovery outweighs its likely benefit, considering the needs of the case, the amount in controversy, the parties' resources, the importance of the issues at stake, and the importance of the proposed discovery in resolving the issues."),
    ("not-in-possession", ["interrogatories", "production", "admissions"], "The responding party objects to this request to the extent it seeks information or documents not within the possession, custody, or control of the responding party."),
    ("privacy", ["interrogatories", "production"], "The responding party objects to this request to the extent it calls for private, confidential, or sensitive personal information whose disclosure is not warranted under the circumstances of this case."),
    ("compound", ["interrogatories", "admissions"], "The responding party objects to this request on the grounds that it is compound in nature and contains multiple discrete subparts, in violation of the Texas Rules of Civil Procedure."),
    ("assumes-facts", ["interrogatories", "admissions"], "The responding party objects to this request on the grounds that it assumes facts not in evidence and is therefore misleading."),
    ("calls-for-legal", ["interrogatories"], "The responding party objects to this request to the extent it calls for a pure legal conclusion."),
    ("equal-access", ["production"], "The responding party objects to this request on the grounds that the documents sought are equally available to the requesting party through public records or other means."),
)
REQUEST_TYPES = ("interrogatories", "production", "disclosures", "admissions")
#: What a client may know of the installation; an installation puts its own in their place.
PUBLIC_CONFIG = {"stripe_publishable_key": "", "firm_name": "Your Law Firm - Override in .env", "time_increment_options": (0.1, 0.25, 0.5, 1.0), "version": "2026.04.05"}
#: How a client came to the firm; share of the retainer below which it is refreshed; days to respond.
REFERRAL_TYPES = ("attorney", "former client", "search", "ai", "other")
REFRESH_TRIGGER_PCT, RESPONSE_DAYS = 0.4, 30


def public_config(spark: SparkSession, **own: object) -> DataFrame:
    """(name, value as JSON) of the public configuration, with an installation's own values."""
    values = {k: own.get(k, v) for k, v in PUBLIC_CONFIG.items()}
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "name string, value string")


def public_config_of(own: DataFrame, key: str) -> DataFrame:
    """(key, name, value as JSON) for each installation: a row of own has its key, and its values under their names."""
    values = [F.struct(F.lit(k).alias("name"), (F.to_json(F.array(own[k])).substr(F.lit(2), F.length(F.to_json(F.array(own[k]))) - 2) if k in own.columns else F.lit(json.dumps(v))).alias("value")) for k, v in PUBLIC_CONFIG.items()]
    return own.select(key, F.explode(F.array(*values)).alias("x")).select(key, "x.*")


def privileges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRIVILEGES), "slug string, text string")


def objections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OBJECTIONS), "slug string, applies_to array<string>, text string")


def add_missing(existing: DataFrame, seeds: DataFrame, key: str = "slug") -> DataFrame:
    """The table with seed rows that it lacks; a second load adds nothing."""
    return existing.unionByName(seeds.join(existing, key, "left_anti"))
