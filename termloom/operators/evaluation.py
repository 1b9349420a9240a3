"""Preparation of mapping sets for evaluation, and the quality measures per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom import schemas
from termloom.functions.numeric import share
from termloom.functions.ordering import row_number_by, running_totals
from termloom.functions.text import pair_id
from termloom.operators.consensus import MAPPABLE, UNMAPPABLE

# The two concept groups of the report.
ANATOMICAL, CELL = "Anatomical structure", "Cell type"
_GROUPS = {"as": ANATOMICAL, "ct": CELL}
BETA = 2.0

def _best() -> list[Column]:
    return [F.desc("similarity_score"), F.asc("object_id")]


def with_pair_id(mappings: DataFrame) -> DataFrame:
    return mappings.withColumn("pair_id", pair_id(F.col("subject_id"), F.col("object_id")))


def mappable(truth: DataFrame) -> DataFrame:
    return truth.filter(F.col("mappability") == MAPPABLE)


def keep_mappable(mappings: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows whose subject label is a mappable one."""
    labels = mappable(truth).select("subject_label")
    return mappings.join(labels, "subject_label", "left_semi").select(*mappings.columns)


def truth_join(mappings: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``accurate_mapping`` by pair id; null for pairs nobody judged."""
    judged = truth.filter(F.col("pair_id").isNotNull()).select("pair_id", "accurate_mapping")
    return mappings.join(judged, "pair_id", "left")


def concept_pair_rank(mappings: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Number the mappings of each model and subject, best first.

    Similarity and object id stand in for the row order of a file.
    """
    return row_number_by(
        mappings, ["model", "subject_id"], _best(), "concept_pair_rank", group_rows
    )


def mapping_result_number(mappings: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Running number of the accurate rows of each model and subject, 0 for the others."""
    totals = running_totals(
        mappings,
        ["model", "subject_id"],
        _best(),
        {"mapping_result_number": F.col("accurate_mapping")},
        group_rows,
    )
    return totals.withColumn("mapping_result_number", _only_accurate("mapping_result_number"))


def _only_accurate(column: str) -> Column:
    return F.when(F.col("accurate_mapping") == 1, F.col(column)).otherwise(0)


def concept_accuracy(judged: DataFrame) -> DataFrame:
    """Best accuracy of each model, subject and label."""
    return judged.groupBy("model", "subject_id", "subject_label").agg(
        F.max("accurate_mapping").alias("accurate_mapping")
    )


def concept_frame(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Every mappable concept for every model, with the flags of the concept.

    The list of model names is a scalar subquery that each concept row unfolds.
    """
    models = judged.agg(F.array_sort(F.collect_set("model"))).scalar()
    concepts = (
        mappable(truth)
        .select("subject_id", "subject_label", "mesh_concept_group", "mapping_count")
        .distinct()
        .withColumn("model", F.explode(models))
    )
    reached = concept_accuracy(judged).withColumn("_analyzed", F.lit(True))
    best = F.col("accurate_mapping")
    return concepts.join(reached, ["model", "subject_id", "subject_label"], "left").select(
        *concepts.columns,
        F.coalesce("_analyzed", F.lit(False)).alias("model_analyzed"),
        F.when(best == 1, "Hit").otherwise("Miss").alias("hit_miss_concept"),
    )


def prepare(
    mappings: DataFrame, truth: DataFrame, group_rows: int | None = None
) -> DataFrame:
    """Prepared evaluation rows of mapping sets with a ``model`` column.

    Concepts that a model skipped appear once, without a mapping. ``group_rows`` is the K of the
    mapping sets, if it is known.
    """
    judged = truth_join(with_pair_id(keep_mappable(mappings, truth)), truth).withColumn(
        "accurate_mapping", F.coalesce("accurate_mapping", F.lit(0))
    )
    ranked = running_totals(
        judged,
        ["model", "subject_id"],
        _best(),
        {"concept_pair_rank": F.lit(1), "mapping_result_number": F.col("accurate_mapping")},
        group_rows,
    ).withColumn("mapping_result_number", _only_accurate("mapping_result_number"))
    concepts = concept_frame(judged, truth)
    # An inner join, because Spark can split a hot subject on either side of it.
    key = ["model", "subject_id", "subject_label"]
    mapped = ranked.join(concepts.filter("model_analyzed"), key).withColumn(
        "hit_miss_mapping",
        F.when(F.col("accurate_mapping") == 1, F.col("hit_miss_concept")).otherwise("Miss"),
    )
    skipped = concepts.filter(~F.col("model_analyzed")).withColumns(
        {
            "accurate_mapping": F.lit(0),
            "mapping_result_number": F.lit(0),
            "hit_miss_mapping": F.lit("Miss"),
        }
    )
    return mapped.unionByName(skipped, allowMissingColumns=True).select(
        *schemas.PREPARED_COLUMNS
    )


# Per-subject facts and the report ------------------------------------------------------------


def per_subject(prepared: DataFrame) -> DataFrame:
    """One row per model and subject with all that the measures need; one aggregation."""
    accurate_rank = F.when(
        F.col("mapping_result_number") == 1, F.col("concept_pair_rank")
    )
    facts = prepared.groupBy("model", "subject_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("model_analyzed").alias("analyzed"),
        # Flags instead of the group's name: a maximum of strings could not be hashed.
        *[F.max(F.col("mesh_concept_group") == g).alias(f"is_{s}") for s, g in _GROUPS.items()],
        F.max(F.col("hit_miss_concept") == "Hit").alias("is_hit"),
        F.max("accurate_mapping").alias("best"),
        F.coalesce(F.max("concept_pair_rank"), F.lit(0)).alias("precision_k"),
        F.sum("accurate_mapping").alias("score_at_k"),
        F.max("mapping_count").alias("recall_k"),
        F.min(accurate_rank).alias("first_rank"),
    )
    missed = ~F.col("is_hit") & (F.col("precision_k") > 0)
    return facts.withColumns(
        {
            "precision": F.coalesce(F.try_divide("best", "precision_k"), F.lit(0.0)),
            "recall": F.try_divide("score_at_k", "recall_k"),
            "reciprocal_rank": F.when(
                F.col("first_rank").isNotNull(), F.try_divide(F.lit(1), "first_rank")
            ).when(missed, F.lit(0.0)),
        }
    )


def _concepts(truth: DataFrame) -> Column:
    """Numbers of mappable concepts: ``all`` of them and those of the two groups."""
    rows = mappable(truth).select("subject_id", "mesh_concept_group").distinct()
    subjects = rows.groupBy("subject_id").agg(
        *[
            F.max(F.col("mesh_concept_group") == group).alias(short)
            for short, group in _GROUPS.items()
        ]
    )
    counts = [F.count_if(short).alias(short) for short in _GROUPS]
    return subjects.agg(F.struct(F.count(F.lit(1)).alias("all"), *counts)).scalar()


def coverage(prepared: DataFrame, truth: DataFrame) -> DataFrame:
    """Mapping rows, and mapped and skipped concepts, of each model."""
    counted = per_subject(prepared).groupBy("model").agg(*_coverage_counts())
    return _coverage_columns(counted, truth)


def _coverage_counts() -> list[Column]:
    return [
        F.sum("rows").alias("mapping_results"),
        F.count_if("analyzed").alias("mapped_concepts"),
    ]


def _coverage_columns(counted: DataFrame, truth: DataFrame) -> DataFrame:
    out = counted.withColumn("mappable_concepts", _concepts(truth)["all"])
    mapped, all_of = F.col("mapped_concepts"), F.col("mappable_concepts")
    return out.select(
        "*",
        (all_of - mapped).alias("skipped_concepts"),
        share(mapped, all_of, 3).alias("mapped_concepts_percent"),
    )


_BY_ALL = ["hit", "miss"]
_BY_GROUP = ["hit_as", "miss_as", "hit_ct", "miss_ct"]


def _hit_miss_counts(names: Sequence[str]) -> list[Column]:
    counts = []
    for name in names:
        flag, _, group = name.partition("_")
        test = F.col("is_hit") if flag == "hit" else ~F.col("is_hit")
        if group:
            test = test & F.col(f"is_{group}")
        counts.append(F.count_if(test).alias(name))
    return counts


def _hit_miss_shares(counted: DataFrame, truth: DataFrame, names: Sequence[str]) -> DataFrame:
    shares, concepts = {}, _concepts(truth)
    for name in names:
        _, _, group = name.partition("_")
        shares[f"{name}_percent"] = share(F.col(name), concepts[group or "all"], 2)
    return counted.withColumns(shares)


def hit_miss(prepared: DataFrame, truth: DataFrame) -> DataFrame:
    """Hit and missed concepts of each model."""
    counted = per_subject(prepared).groupBy("model").agg(*_hit_miss_counts(_BY_ALL))
    return _hit_miss_shares(counted, truth, _BY_ALL)


def hit_miss_by_group(prepared: DataFrame, truth: DataFrame) -> DataFrame:
    """The same within the two concept groups."""
    counted = per_subject(prepared).groupBy("model").agg(*_hit_miss_counts(_BY_GROUP))
    return _hit_miss_shares(counted, truth, _BY_GROUP)


def precision_recall(prepared: DataFrame) -> DataFrame:
    """Precision and recall at list length, per model and subject.

    Precision divides the best accuracy by the last rank, recall the accurate rows by the number
    of known mappings; a skipped concept has precision 0.
    """
    return per_subject(prepared).select(
        "model", "subject_id", "precision_k", "precision", "score_at_k", "recall_k", "recall"
    )


def _means() -> list[Column]:
    return [
        F.avg("precision_k").alias("mean_k"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
    ]


def _f_score(beta: float) -> Column:
    p, r = F.col("mean_precision"), F.col("mean_recall")
    return F.try_divide((1 + beta**2) * p * r, beta**2 * p + r)


def f_beta(measures: DataFrame, beta: float = BETA) -> DataFrame:
    """Means of ``precision_recall`` rows per model, and their F score."""
    return measures.groupBy("model").agg(*_means()).withColumns(
        {"f_score": _f_score(beta), "beta": F.lit(beta)}
    )


def reciprocal_rank(prepared: DataFrame) -> DataFrame:
    """1/rank of the first accurate mapping; 0 for a missed concept; skipped ones are left out."""
    return per_subject(prepared).filter(F.col("reciprocal_rank").isNotNull()).select(
        "model", "subject_id", "reciprocal_rank"
    )


def _mrr() -> list[Column]:
    return [
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.stddev_samp("reciprocal_rank").alias("mean_reciprocal_rank_sd"),
    ]


def mrr(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("model").agg(*_mrr())


REPORT_COLUMNS = [
    "model", "mapping_results", "mappable_concepts", "mapped_concepts", "skipped_concepts",
    "mapped_concepts_percent", "hit", "hit_as", "hit_ct", "miss", "miss_as", "miss_ct",
    "hit_percent", "hit_as_percent", "hit_ct_percent", "miss_percent", "miss_as_percent",
    "miss_ct_percent", "mean_k", "mean_precision", "mean_recall", "f_score", "beta",
    "mean_reciprocal_rank", "mean_reciprocal_rank_sd",
]


def evaluate(prepared: DataFrame, truth: DataFrame, beta: float = BETA) -> DataFrame:
    """The whole report, one row per model, by two aggregations and no join."""
    names = _BY_ALL + _BY_GROUP
    counted = per_subject(prepared).groupBy("model").agg(
        *_coverage_counts(), *_hit_miss_counts(names), *_means(), *_mrr()
    )
    out = _hit_miss_shares(_coverage_columns(counted, truth), truth, names)
    return out.withColumns({"f_score": _f_score(beta), "beta": F.lit(beta)}).select(
        *REPORT_COLUMNS
    )


# Ground-truth statistics ---------------------------------------------------------------------


def concept_counts(
    truth: DataFrame, source: DataFrame, target: DataFrame, namespaces: dict[str, str]
) -> DataFrame:
    """Counts of concepts by side, group and target namespace, as one row."""
    is_as = F.col("mesh_concept_group") == ANATOMICAL
    is_ct = F.col("mesh_concept_group") == CELL
    ok = F.col("mappability") == MAPPABLE

    def distinct(column: str, test: Column) -> Column:
        return F.countDistinct(F.when(test, F.col(column)))

    counts = truth.agg(
        distinct("subject_label", is_as).alias("subject_concepts_as"),
        distinct("subject_label", is_ct).alias("subject_concepts_ct"),
        F.count_if(ok).alias("mapping_recalls"),
        distinct("subject_id", ok).alias("mappable_concepts"),
        distinct("subject_id", ok & is_as).alias("mappable_concepts_as"),
        distinct("subject_id", ok & is_ct).alias("mappable_concepts_ct"),
    )
    scalars = {
        "subject_concepts": source.agg(F.count(F.lit(1))).scalar(),
        "target_concepts": target.agg(F.count(F.lit(1))).scalar(),
    }
    for name, prefix in namespaces.items():
        scalars[f"target_concepts_{name}"] = target.agg(
            F.count_if(F.startswith("iri", F.lit(prefix)))
        ).scalar()
    return counts.withColumns(scalars)


def unmappable_stats(truth: DataFrame, source: DataFrame) -> DataFrame:
    """Unmappable rows by concept group and exclusion reason, with their shares."""
    rows = truth.filter(F.col("mappability") == UNMAPPABLE)
    subjects = source.agg(F.count(F.lit(1))).scalar()
    by_reason = rows.groupBy("mesh_concept_group", "exclusion_reason").agg(
        F.count("subject_id").alias("concept_reason")
    )
    by_group = by_reason.groupBy("mesh_concept_group").agg(
        F.sum("concept_reason").alias("concept_group")
    )
    return (
        by_group.withColumn(
            "percent_subject_concept", share(F.col("concept_group"), subjects, 3)
        )
        .join(by_reason, "mesh_concept_group")
        .withColumn(
            "percent_subject_concept_reasons",
            share(F.col("concept_reason"), F.col("concept_group"), 2),
        )
        .orderBy("mesh_concept_group", F.desc("concept_group"), F.desc("concept_reason"))
    )

