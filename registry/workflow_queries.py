"""Whole workflows."""

from pyspark.sql import functions as F

from registry.core import query
from registry.evaluation_queries import MODEL_EVALUATION, rounded
from registry.mapping_queries import (
    _CANDIDATES,
    _LOGICAL,
    _reversing_model,
    letter_counts,
    letters_sql,
)
from termloom.plans import workflows
from termloom.session import scratch_path
from termloom.sources.sinks import RunConfig
from termloom.sources.tables import read_terms


def _writer(prompts):
    """Stands in for a text model: repeats the known text."""
    return [prompt.split("Known so far:\n", 1)[-1] for prompt in prompts]


def _mapped_sql(source, target, extra=""):
    """Top 10 passages of each document by the cosine of their letter counts."""
    return f"""SELECT subject_id, subject_label, 'skos:relatedMatch' AS predicate_id, object_id,
      object_label, round(score, 6) AS similarity_score, '' AS comment,
      'semapv:SemanticSimilarityThresholdMatching' AS mapping_justification{extra}
    FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, target) AS place
      FROM (SELECT s.iri AS subject_id, s.name AS subject_label, t.iri AS object_id,
        t.name AS object_label, t.id AS target,
        round(list_cosine_similarity(s.v::DOUBLE[], t.v::DOUBLE[]), 9) AS score
        FROM (SELECT iri, name, {letters_sql(source)} AS v FROM {{terms}}) s,
          (SELECT iri, name, id, {letters_sql(target)} AS v FROM {{passages}}) t)
      WHERE NOT isnan(score)) WHERE place <= 10"""


_TEXT = "(name || CASE WHEN aka <> '' THEN ' also known as ' || aka ELSE '' END || ' ' || description)"


@query("workflow_desc_vec", _mapped_sql(_TEXT, _TEXT))
def workflow_desc_vec(t):
    run = workflows.map_by_description(t.derived("terms"), t.derived("passages"), letter_counts)
    return rounded(run.mappings)


@query("workflow_llm_vec", _mapped_sql("description", "description"))
def workflow_llm_vec(t):
    run = workflows.map_by_expansion(
        t.derived("terms"), t.derived("passages"), _writer, letter_counts
    )
    return rounded(run.mappings)


@query(
    "workflow_llm_rank",
    f"""SELECT l.iri AS subject_id, l.name AS subject_label, 'skos:relatedMatch' AS predicate_id,
    r.iri AS object_id, r.name AS object_label, (row_number() OVER (PARTITION BY c.source
      ORDER BY position(c.target IN reply), place))::INT AS score, '' AS comment,
    'semapv:SemanticSimilarityThresholdMatching' AS mapping_justification
    FROM ({_CANDIDATES}) c JOIN (SELECT source, string_agg('[' || target || ']', ' > '
      ORDER BY place DESC) AS reply FROM ({_CANDIDATES}) GROUP BY source) a ON a.source = c.source
    JOIN {{left_terms}} l ON c.source = l.id JOIN {{right_terms}} r ON c.target = r.id""",
)
def workflow_llm_rank(t):
    left, right = t.derived("left_terms"), t.derived("right_terms")
    content = [side.select("id", F.col("description").alias("content")) for side in (left, right)]
    return workflows.map_by_ranking(left, right, *content, t.scores(), _reversing_model).mappings


@query("workflow_logical", _LOGICAL)
def workflow_logical(t):
    return workflows.map_by_shared_concepts(
        t.derived("part_terms"), t.derived("supplier_descriptors"), t.derived("codes"),
        t.derived("concept_code"), t.derived("code_term"), ("PART", "MSH"), "MSH:",
    ).mappings


@query(
    "workflow_validation",
    MODEL_EVALUATION.replace("{prepared}", "{all_prepared}"),
)
def workflow_validation(t):
    return rounded(workflows.validate_models(t.mappings, t.truth, group_rows=10).report)


_BOTH = f"""{_mapped_sql(_TEXT, _TEXT, ", 'desc-vec' AS model")}
  UNION ALL {_mapped_sql("description", "description", ", 'gpt4o.llm' AS model")}"""


@query(
    "run_workflows",
    f"""SELECT *, 'documents-passages' AS dataset, 'v0.0.1' AS version, 0 AS violations
    FROM ({_BOTH})""",
)
def run_workflows(t):
    folder = scratch_path(t.spark, "inputs")
    for name, table in (("source", "terms"), ("target", "passages")):
        rows = t.derived(table).write.option("header", True).option("escape", '"')
        rows.csv(f"{folder}/{name}")
    config = RunConfig("documents-passages", "v0.0.1", f"{folder}/source", f"{folder}/target",
                       scratch_path(t.spark, "published"))
    clients = {
        "desc-vec": workflows.Clients(letter_counts),
        "gpt4o": workflows.Clients(letter_counts, _writer),
    }
    done = workflows.run_workflows(t.spark, config, list(clients), clients, read_terms)
    path = f"{config.output}/{config.dataset}/{config.version}/violations"
    broken = t.spark.read.schema("rule string").option("header", True).csv(path).count()
    return rounded(done.drop("created").withColumn("violations", F.lit(broken)))
