"""Mapping sets in the SSSOM format: compilation and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.numeric import cast_rank
from termloom.functions.text import code_to_id

# Fixed values of the format.
RELATED_MATCH = "skos:relatedMatch"
EXACT_MATCH = "skos:exactMatch"
BY_SIMILARITY = "semapv:SemanticSimilarityThresholdMatching"
BY_REASONING = "semapv:LogicalReasoning"
POOLED = "semapv:SemanticSimilarity"
PREDICATES = [
    "skos:exactMatch",
    "skos:closeMatch",
    "skos:broadMatch",
    "skos:narrowMatch",
    "skos:relatedMatch",
]
JUSTIFICATIONS = [
    "semapv:LexicalMatching",
    "semapv:LogicalReasoning",
    "semapv:ManualMappingCuration",
    "semapv:SemanticSimilarity",
    "semapv:SemanticSimilarityThresholdMatching",
]
IRI_OR_CURIE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"]+|[A-Za-z_][A-Za-z0-9_.-]*:[^\s/][^\s]*)$"


def _labelled(links: DataFrame, source: DataFrame, target: DataFrame, target_id: str = "id"):
    """Join ids to both term tables; sizes known to Spark decide how."""
    subjects = source.select(
        F.col("id").alias("source"),
        F.col("iri").alias("subject_id"),
        F.col("name").alias("subject_label"),
    )
    objects = target.select(
        F.col(target_id).alias("target"),
        F.col("iri").alias("object_id"),
        F.col("name").alias("object_label"),
    )
    return links.join(subjects, "source").join(objects, "target")


def _mapping(
    rows: DataFrame, predicate: str, justification: str, score: Column | None = None
) -> DataFrame:
    return rows.select(
        "subject_id",
        "subject_label",
        F.lit(predicate).alias("predicate_id"),
        "object_id",
        "object_label",
        *([] if score is None else [score]),
        F.lit("").alias("comment"),
        F.lit(justification).alias("mapping_justification"),
    )


def sssom_scored(source: DataFrame, target: DataFrame, scores: DataFrame) -> DataFrame:
    """Mapping set of a score table."""
    rows = _labelled(scores, source, target)
    score = F.col("score").alias("similarity_score")
    return _mapping(rows, RELATED_MATCH, BY_SIMILARITY, score)


def sssom_ranked(source: DataFrame, target: DataFrame, ranked: DataFrame) -> DataFrame:
    """Mapping set of a ranked score table; the rank is its score."""
    rows = _labelled(ranked, source, target)
    return _mapping(rows, RELATED_MATCH, BY_SIMILARITY, cast_rank(F.col("rank")).alias("score"))


def sssom_logical(left: DataFrame, descriptors: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Exact matches of a crosswalk: one row per descriptor row of the right side."""
    links = crosswalk.select(
        F.col("left_id").alias("source"), F.col("right_id").alias("target")
    )
    rows = _labelled(links, left, descriptors, target_id="descriptor_id")
    return _mapping(rows, EXACT_MATCH, BY_REASONING)


def order_mappings(mappings: DataFrame) -> DataFrame:
    """Sink order: subject, then best first, then object."""
    if "similarity_score" in mappings.columns:
        return mappings.orderBy("subject_id", F.desc("similarity_score"), "object_id")
    if "score" in mappings.columns:
        return mappings.orderBy("subject_id", "score", "object_id")
    return mappings.orderBy("subject_id", "object_id")


def crosswalk(
    codes: DataFrame,
    concept_code: DataFrame,
    code_term: DataFrame,
    left: str,
    right: str,
    left_drop: str | None = None,
    right_drop: str | None = None,
) -> DataFrame:
    """Codes of two vocabularies that share a concept, with their labels.

    Labels depend on the code alone, so they are collected per code and not per pair, and join
    the pairs last. ``*_drop`` removes a code prefix; otherwise ``:`` becomes ``_``.
    """
    pairs, names = None, {}
    for vocabulary, side in ((left, "left"), (right, "right")):
        own = codes.filter(F.col("sab") == vocabulary).select("code_id")
        names[side] = _code_labels(code_term.join(own, "code_id", "left_semi"), side)
        # The vocabulary cuts the links down first; repeated ones go with the pairs.
        linked = concept_code.join(own, "code_id", "left_semi").select(
            "concept", F.col("code_id").alias(side)
        )
        pairs = linked if pairs is None else pairs.join(linked, "concept")
    pairs = pairs.select("left", "right").distinct()
    return pairs.join(names["left"], "left").join(names["right"], "right").select(
        code_to_id(F.col("left"), left_drop).alias("left_id"),
        code_to_id(F.col("right"), right_drop).alias("right_id"),
        "left_labels",
        "right_labels",
    )


def _code_labels(code_term: DataFrame, side: str) -> DataFrame:
    """Distinct lower-case labels of each code; a label keeps the place of its first spelling."""
    return (
        code_term.groupBy("code_id", F.lower("name").alias("label"))
        .agg(F.min("name").alias("name"))
        .groupBy(F.col("code_id").alias(side))
        .agg(F.array_sort(F.collect_list(F.struct("name", "label"))).alias("names"))
        .select(
            side,
            F.array_join(F.transform("names", lambda n: n["label"]), "; ").alias(f"{side}_labels"),
        )
    )


def validate_mappings(mappings: DataFrame) -> DataFrame:
    """``rule, subject_id, predicate_id, object_id``: one row per broken rule.

    The row rules are checked in one pass; duplicates take one aggregation on the key.
    """
    key = ["subject_id", "predicate_id", "object_id"]

    def empty(name: str) -> Column:
        return F.coalesce(F.trim(name), F.lit("")) == ""

    rules = {f"{name} is empty": empty(name) for name in [*key, "mapping_justification"]}
    for name in ("subject_id", "object_id"):
        rules[f"{name} is no IRI or CURIE"] = ~empty(name) & ~F.col(name).rlike(IRI_OR_CURIE)
    rules["predicate_id is unknown"] = ~empty("predicate_id") & ~F.col("predicate_id").isin(
        PREDICATES
    )
    rules["mapping_justification is unknown"] = ~empty("mapping_justification") & ~F.col(
        "mapping_justification"
    ).isin(JUSTIFICATIONS)
    if "similarity_score" in mappings.columns:
        score = F.col("similarity_score")
        rules["similarity_score is outside 0 to 1"] = F.isnan(score) | ~score.between(0, 1)
    if "score" in mappings.columns:
        rank = F.col("score")
        rules["score is no rank"] = rank.isNull() | (rank < 1)
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    row_violations = mappings.select(F.explode(broken).alias("rule"), *key)
    repeated = (
        mappings.groupBy(*key)
        .count()
        .filter("count > 1")
        .select(F.lit("mapping is repeated").alias("rule"), *key)
    )
    return row_violations.unionByName(repeated)


def append_sets(sets: dict[str, DataFrame]) -> DataFrame:
    """One frame of several mapping sets, told apart by ``model``."""
    frames = [frame.withColumn("model", F.lit(model)) for model, frame in sets.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out

