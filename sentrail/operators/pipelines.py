"""Composed scoring and grading: events against their user's profile, documents by context and votes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrail.functions.scalars import hash_choice, sigmoid


@dataclass(frozen=True)
class Scoring:
    """Weights of the three parts of a score, the deviation that counts in full, and two thresholds."""

    consistency: float = 1 / 3
    deviation: float = 1 / 3
    environment: float = 1 / 3
    full_deviation: float = 5.0
    alert: float = 0.5
    block: float = 0.7


def profile_vector(fused: Column, parts: list[Column], size: int) -> Column:
    """The fused vector if there is one, else the parts one after another, else zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.coalesce(fused, F.concat(*parts), zeros)


def score_events(events: DataFrame, key: str, kind: str, value: str, environment: Column, scoring: Scoring) -> DataFrame:
    """Adds consistency, deviation, confidence, score and decision of each event against its key's profile.

    The profile of a key is the mean and variance of its values and the shares of its kinds, from two partial
    aggregations, so a hot key costs no window. consistency is exp(-KL/2) of the event's kind against the
    shares; deviation is 0 where there is no spread to measure it by. environment is a number from 0 to 1.
    Null keys have no profile: consistency 1, deviation 0.
    """
    base = events.groupBy(key).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count(F.lit(1)).alias("_all"))
    kinds = events.groupBy(key, kind).agg(F.count(F.lit(1)).alias("_n"))
    known = kinds.join(base, key).select(F.col(key).alias("_key"), F.col(kind).alias("_kind"), "_m", "_v", (F.col("_n") / F.col("_all")).alias("_share"))
    j = events.join(known, (F.col(key) == F.col("_key")) & F.col(kind).eqNullSafe(F.col("_kind")), "left")
    j = j.withColumns({
        "consistency": F.coalesce(F.exp(0.5 * F.ln("_share")), F.lit(1.0)),
        "deviation": F.coalesce(F.when(F.col("_v") > 0, F.abs(F.col(value) - F.col("_m")) / F.sqrt(F.col("_v") + 1e-6)), F.lit(0.0)),
        "confidence": sigmoid(3 * environment - 1),
    })
    s = scoring
    j = j.withColumn("score", s.consistency * (1 - F.col("consistency")) + s.deviation * F.least(F.col("deviation") / s.full_deviation, F.lit(1.0)) + s.environment * (1 - F.col("confidence")))
    decision = F.when(F.col("score") < s.alert, "pass").when(F.col("score") < s.block, "alert").otherwise("block")
    return j.withColumn("decision", decision).drop("_key", "_kind", "_m", "_v", "_share")


def grade_by_votes(documents: DataFrame, doc_id: str, text: str, group: str, level: Column, profile: Column, cases: int = 3, votes: int = 5, levels: int = 4, accept: float = 0.5) -> DataFrame:
    """doc_id, level, share, accepted: retrieve cases, write the prompt, let seeded voters grade, count the votes.

    The cases of a document are the first `cases` graded documents of its group by id, itself left out; a
    voter is a function of prompt and seed (here a hash, in place of a model). cases=0, a null profile and
    votes=1 are the ablations. Ties go to the first seed. Null texts are graded as empty.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(group).alias("g"), F.coalesce(F.col(text), F.lit("")).alias("t"), level.alias("own"), profile.cast("string").alias("who"))
    # One case more than needed is kept, so that a document can leave itself out.
    first = rows.filter("own IS NOT NULL AND g IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("id"))).filter(F.col("r") <= cases + 1)
    held = first.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("id", "own"))).alias("held"))
    near = F.slice(F.filter(F.coalesce("held", F.array().cast(held.schema["held"].dataType)), lambda c: c["id"] != F.col("id")), 1, cases) if cases else F.array().cast(held.schema["held"].dataType)
    prompt = F.concat_ws("|", F.coalesce("who", F.lit("")), F.array_join(F.transform(near, lambda c: c["own"]), ","), "t")
    asked = rows.join(held, "g", "left").select("id", prompt.alias("prompt")).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(votes - 1)), lambda s: hash_choice(F.concat("prompt", F.lit("|"), s.cast("string")), levels))).alias("seed", "level"))
    n = asked.groupBy("id", "level").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("seed"))
    best = n.groupBy("id").agg(F.min_by(F.struct("level", "n"), F.struct(-F.col("n"), F.col("seed"))).alias("b"))
    share = F.col("b.n") / votes
    return best.select(F.col("id").alias(doc_id), "b.level", share.alias("share"), (share > accept).alias("accepted"))


def to_regrade(catalog: DataFrame, versions: DataFrame, user: str, version: str, priority: Column) -> DataFrame:
    """Catalog entries graded under an older profile of their user, most urgent first; old entries stay as they are."""
    new = versions.select(F.col(user).alias("_user"), F.col(version).alias("_new"))
    return catalog.join(new, F.col(user) == F.col("_user")).filter(F.coalesce(F.col(version), F.lit(-1)) < F.col("_new")).withColumn("priority", priority).drop("_user").withColumnRenamed("_new", "new_version")
