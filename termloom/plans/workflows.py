"""Whole runs: from term tables to mapping sets, and from mapping sets to reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from termloom.operators import consensus, evaluation, statistics
from termloom.operators.mappings import (
    append_sets,
    sssom_logical,
    sssom_ranked,
    sssom_scored,
    validate_mappings,
)
from termloom.operators.mappings import crosswalk as shared_crosswalk
from termloom.operators.plugins import TextClient, VectorClient, embed_content, expand_content
from termloom.operators.reranking import (
    CANDIDATES,
    assemble_candidates,
    rank_from_reply,
    rank_with_model,
    render_rank_prompt,
)
from termloom.operators.similarity import topk_similar
from termloom.operators.terms import compose_content, content_lookup, unknown_content
from termloom.session import materialize
from termloom.sources.sinks import RunConfig, publish
from termloom.sources.tables import read_terms

TOP_K = 10


@dataclass(frozen=True)
class Preset:
    """Models of one workflow; the clients for them are supplied by the caller."""

    embedding_model: str
    text_model: str | None = None
    options: str = ""


# Workflow names with their models.
PRESETS = {
    "desc-vec": Preset("sentence-transformers/all-mpnet-base-v2"),
    "gpt4o": Preset("3-large", "gpt-4o"),
    "llama3.2-1b": Preset("sentence-transformers/all-mpnet-base-v2", "llama3.2:1b", "-o num_predict 384"),
    "llama3.2-3b": Preset("sentence-transformers/all-mpnet-base-v2", "llama3.2:3b", "-o num_predict 384"),
    "llama318b": Preset("sentence-transformers/all-mpnet-base-v2", "llama3.1:8b", "-o num_predict 384"),
    "phi4-14b": Preset("sentence-transformers/all-mpnet-base-v2", "phi4:14b", "-o num_predict 384"),
}


@dataclass(frozen=True)
class Clients:
    """Batch clients of one workflow; without an embedder hashed word vectors are used."""

    embedder: VectorClient | None = None
    text: TextClient | None = None


@dataclass(frozen=True)
class MappingRun:
    scores: DataFrame
    mappings: DataFrame
    violations: DataFrame
    unknown: DataFrame | None = None


def _map_by_content(source, target, source_content, target_content, embedder, k) -> MappingRun:
    # Model calls and the similarity join are dear, and their results are read several times.
    source_vectors = materialize(embed_content(source_content, embedder), "source-vectors")
    target_vectors = materialize(embed_content(target_content, embedder), "target-vectors")
    scores = materialize(topk_similar(source_vectors, target_vectors, k), "scores")
    mappings = sssom_scored(source, target, scores)
    return MappingRun(scores, mappings, validate_mappings(mappings))


def map_by_description(
    source: DataFrame, target: DataFrame, embedder: VectorClient | None = None, k: int = TOP_K
) -> MappingRun:
    """Map by the texts of the term tables themselves."""
    return _map_by_content(
        source, target, compose_content(source), compose_content(target), embedder, k
    )


def map_by_expansion(
    source: DataFrame,
    target: DataFrame,
    writer: TextClient,
    embedder: VectorClient | None = None,
    k: int = TOP_K,
) -> MappingRun:
    """Map by texts that a model wrote from the term tables."""
    return _map_by_content(
        source, target, expand_content(source, writer), expand_content(target, writer),
        embedder, k,
    )


def map_by_ranking(
    source: DataFrame,
    target: DataFrame,
    source_content: DataFrame,
    target_content: DataFrame,
    scores: DataFrame,
    ranker: TextClient,
    n: int = CANDIDATES,
) -> MappingRun:
    """Re-rank the best candidates of each source by a model.

    ``unknown`` of the result has the content rows whose id no term has.
    """
    candidates = assemble_candidates(scores, target_content, n)
    prompts = render_rank_prompt(candidates, content_lookup(source, source_content))
    replies = materialize(rank_with_model(prompts, ranker), "replies")
    ranked = rank_from_reply(replies)
    mappings = sssom_ranked(source, target, ranked)
    unknown = unknown_content(source, source_content).unionByName(
        unknown_content(target, target_content), allowMissingColumns=True
    )
    return MappingRun(ranked, mappings, validate_mappings(mappings), unknown)


def map_by_shared_concepts(
    left: DataFrame,
    descriptors: DataFrame,
    codes: DataFrame,
    concept_code: DataFrame,
    code_term: DataFrame,
    vocabularies: tuple[str, str],
    right_drop: str | None = None,
) -> MappingRun:
    """Exact matches through codes of one concept."""
    links = shared_crosswalk(
        codes, concept_code, code_term, *vocabularies, right_drop=right_drop
    )
    mappings = sssom_logical(left, descriptors, links)
    return MappingRun(links, mappings, validate_mappings(mappings))


@dataclass(frozen=True)
class Validation:
    prepared: DataFrame
    pooled: DataFrame
    report: DataFrame
    by_model: DataFrame
    by_accuracy: DataFrame


def validate_models(
    mappings: DataFrame, truth: DataFrame, group_rows: int | None = None
) -> Validation:
    """Prepare, pool, evaluate and describe the mapping sets of several models."""
    own = evaluation.prepare(mappings, truth, group_rows)
    judged = consensus.evaluate_consensus(consensus.consensus(mappings), truth)
    pooled = consensus.pooled_prepared(judged)
    prepared = materialize(own.unionByName(pooled), "prepared")
    single = statistics.analyzed(
        prepared.filter(prepared["model"] != consensus.POOLED_MODEL)
    )
    return Validation(
        prepared,
        judged,
        evaluation.evaluate(prepared, truth),
        statistics.describe_scores(single, ["model"]),
        statistics.describe_scores_by_accuracy(single),
    )


def run_workflows(
    spark: SparkSession,
    config: RunConfig,
    workflows: Iterable[str],
    clients: Mapping[str, Clients] | None = None,
    read: Callable[[SparkSession, str], DataFrame] = read_terms,
    strict: bool = True,
) -> DataFrame:
    """Run the chosen workflows on one dataset version, validate and publish their mapping sets.

    What breaks a rule is written beside the mappings, and with ``strict`` nothing is published
    then.
    """
    source, target = read(spark, config.source_terms), read(spark, config.target_terms)
    sets = {}
    for name in workflows:
        preset, own = PRESETS[name], (clients or {}).get(name, Clients())
        if preset.text_model is None:
            sets[name] = map_by_description(source, target, own.embedder).mappings
        elif own.text is None:
            raise ValueError(f"workflow {name} needs a text client for {preset.text_model}")
        else:
            sets[f"{name}.llm"] = map_by_expansion(
                source, target, own.text, own.embedder
            ).mappings
    mappings = materialize(append_sets(sets), "mappings")
    violations = append_sets(
        {name: validate_mappings(mappings.filter(mappings["model"] == name)) for name in sets}
    )
    path = f"{config.output}/{config.dataset}/{config.version}/violations"
    violations.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    count = spark.read.option("header", True).schema(violations.schema).csv(path).count()
    if count and strict:
        raise ValueError(f"{count} violations, see {path}")
    return publish(mappings, config)
