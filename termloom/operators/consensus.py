"""Pooling of several models by vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom import schemas
from termloom.functions.ordering import first_by, running_totals
from termloom.functions.text import pair_id
from termloom.operators.mappings import POOLED

# Fixed values of the evaluation files.
HUMAN_MODEL = "human descriptions"
POOLED_MODEL = "pooled-K1-vec-vote"
MAPPABLE, UNMAPPABLE = "Mappable", "Unmappable"

# A subject has one row per model at most, and nobody pools more models than this.
MODELS = 10_000

# Fixed values: (participants, options, votes) that count as a tie besides "all disagree".
TIE_PATTERNS = [(5, 3, 2), (4, 2, 2)]


def top1_per_subject(mappings: DataFrame) -> DataFrame:
    """Best mapping of each model and subject: highest similarity, then smallest object id."""
    best = F.struct(-F.col("similarity_score"), F.col("object_id"))
    return first_by(mappings, ["model", "subject_id"], best)


def votes(mappings: DataFrame) -> DataFrame:
    """Votes and mean similarity of each mapped pair; each model has one vote per subject."""
    ballots = top1_per_subject(mappings).repartition("subject_id")
    return ballots.groupBy(
        "subject_id", "object_id", "subject_label", "object_label", "predicate_id"
    ).agg(
        F.avg("similarity_score").alias("mean_similarity"),
        F.count(F.lit(1)).alias("votes"),
        F.max(F.when(F.col("model") == HUMAN_MODEL, 1).otherwise(0)).alias("human_desc_vec_sim"),
    )


def consensus(mappings: DataFrame, rule: str = "pattern") -> DataFrame:
    """Vote table with participants, options, share, human vote flag and ties.

    A subject has at most one row per model here, so its windows are short; they reuse the
    partitioning by subject that the votes were counted in.
    """
    subject = Window.partitionBy("subject_id")
    counted = votes(mappings).withColumns(
        {
            "participants": F.sum("votes").over(subject),
            "opts": F.count(F.lit(1)).over(subject),
            "_most": F.max("votes").over(subject),
        }
    )
    leaders = F.sum(F.when(F.col("votes") == F.col("_most"), 1).otherwise(0)).over(subject)
    counted = counted.withColumns(
        {
            "share": F.col("votes") / F.col("participants"),
            "ties": tie_flag(rule, leaders),
        }
    )
    return counted.select(
        "subject_id", "object_id", "subject_label", "object_label", "predicate_id",
        "mean_similarity", "participants", "votes", "opts", "share", "human_desc_vec_sim", "ties",
    )


def tie_flag(rule: str, leaders: Column) -> Column:
    """``pattern``: listed vote patterns; ``general``: several options share the most votes."""
    if rule == "general":
        tied = (leaders > 1) & (F.col("votes") == F.col("_most"))
    elif rule == "pattern":
        tied = F.col("participants") == F.col("opts")
        for participants, options, most in TIE_PATTERNS:
            tied = tied | (
                (F.col("participants") == participants)
                & (F.col("opts") == options)
                & (F.col("votes") == most)
            )
    else:
        raise ValueError(f"unknown tie rule {rule!r}")
    return F.when(tied, 1).otherwise(0)


def flag_mappability(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``mappability``: subjects listed as unmappable, and all others."""
    listed = (
        truth.filter(F.col("mappability") == UNMAPPABLE)
        .select("subject_id", F.lit(UNMAPPABLE).alias("mappability"))
        .distinct()
    )
    return df.join(listed, "subject_id", "left").withColumn(
        "mappability", F.coalesce("mappability", F.lit(MAPPABLE))
    )


def evaluate_consensus(pooled: DataFrame, truth: DataFrame) -> DataFrame:
    """Judge the vote table against the ground truth; all rows, mappable or not."""
    judged = truth.filter(F.col("mappability") == MAPPABLE).select("pair_id", "accurate_mapping")
    subjects = truth.select("subject_id", "mesh_concept_group", "mapping_count").distinct()
    known = truth.select("subject_id", F.lit(True).alias("model_analyzed")).distinct()
    rows = pooled.withColumn("pair_id", pair_id(F.col("subject_id"), F.col("object_id")))
    rows = flag_mappability(rows, truth).join(judged, "pair_id", "left")
    accurate = F.when(F.col("mappability") == UNMAPPABLE, 0).otherwise(
        F.coalesce("accurate_mapping", F.lit(0))
    )
    rows = running_totals(
        rows.withColumn("accurate_mapping", accurate),
        ["subject_id"],
        [F.desc("votes"), F.desc("mean_similarity"), F.asc("object_id")],
        {"concept_pair_rank": F.lit(1), "_results": F.col("accurate_mapping")},
        group_rows=MODELS,
    )
    is_accurate = F.col("accurate_mapping") == 1
    subject = Window.partitionBy("subject_id")
    hit = F.max("accurate_mapping").over(subject) == 1
    top = is_accurate & (F.col("concept_pair_rank") == 1) & (F.col("ties") == 0)
    return (
        rows.withColumns(
            {
                "mapping_result_number": F.when(is_accurate, F.col("_results")).otherwise(0),
                "hit_miss_mapping": F.when(is_accurate, "Hit").otherwise("Miss"),
                "hit_miss_concept": F.when(hit, "Hit").otherwise("Miss"),
                "top_vote_correct": F.when(top, 1),
                "mapping_justification": F.lit(POOLED),
                "model": F.lit(POOLED_MODEL),
            }
        )
        .join(subjects, "subject_id", "left")
        .join(known, "subject_id", "left")
        .withColumn("model_analyzed", F.coalesce("model_analyzed", F.lit(False)))
        .withColumnRenamed("mean_similarity", "similarity_score")
        .drop("_results")
    )


def review_sheet(evaluated: DataFrame) -> DataFrame:
    """All pooled mappings with empty columns for a reviewer."""
    return evaluated.select(
        "model", "mapping_justification", "subject_id", "predicate_id", "object_id", "pair_id",
        "subject_label", "object_label", "mappability", "mesh_concept_group",
        "similarity_score", "participants", "opts", "votes", "share", "human_desc_vec_sim",
        "ties", "model_analyzed",
        *[F.lit("").alias(c) for c in ("accurate_mapping_r_1", "confidence_r_1", "reviewer_r_1")],
    )


def pooled_prepared(evaluated: DataFrame) -> DataFrame:
    """Mappable rows in the layout of the prepared evaluation rows."""
    return evaluated.filter(F.col("mappability") == MAPPABLE).select(*schemas.PREPARED_COLUMNS)
