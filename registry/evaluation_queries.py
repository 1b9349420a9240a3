"""Consensus, evaluation and statistics."""

from functools import reduce

from pyspark.sql import functions as F

from registry.core import placed, query
from registry.inputs import MODELS
from termloom.functions import normal, ordering
from termloom.functions.numeric import zscore
from termloom.operators import consensus, evaluation, linear_models, statistics


def rounded(df, digits=6, **own):
    """Round doubles, so that the last bits of sums do not matter."""
    return df.select(
        *[
            F.round(f.name, own.get(f.name, digits)).alias(f.name)
            if f.dataType.typeName() == "double" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


# Preparation -----------------------------------------------------------------------------------


@query(
    "truth_join",
    """SELECT m.model, m.subject_id, m.object_id, t.accurate_mapping FROM {mappings} m
    LEFT JOIN (SELECT * FROM {truth} WHERE pair_id IS NOT NULL) t
      ON t.pair_id = m.subject_id || '|' || m.object_id""",
)
def truth_join(t):
    rows = evaluation.truth_join(evaluation.with_pair_id(t.mappings), t.truth)
    return rows.select("model", "subject_id", "object_id", "accurate_mapping")


@query(
    "keep_mappable",
    """SELECT * FROM {mappings} WHERE subject_label IN (SELECT subject_label FROM {mappable})""",
)
def keep_mappable(t):
    return evaluation.keep_mappable(t.mappings, t.truth)


@query(
    "flag_unmappable",
    """SELECT m.subject_id, m.object_id, m.model, coalesce(u.mappability, 'Mappable') AS mappability
    FROM {mappings} m LEFT JOIN (SELECT DISTINCT subject_id, 'Unmappable' AS mappability FROM {subjects}
      WHERE unmappable) u ON u.subject_id = m.subject_id""",
)
def flag_unmappable(t):
    return consensus.flag_mappability(t.mappings, t.truth).select(
        "subject_id", "object_id", "model", "mappability"
    )


@query(
    "concept_pair_rank",
    """SELECT model, subject_id, object_id, row_number() OVER (PARTITION BY model, subject_id
    ORDER BY similarity_score DESC, object_id) AS concept_pair_rank FROM {mappings}""",
)
def concept_pair_rank(t):
    return evaluation.concept_pair_rank(t.mappings).select(
        "model", "subject_id", "object_id", "concept_pair_rank"
    )


@query(
    "mapping_result_number",
    """SELECT model, subject_id, object_id, CASE WHEN accurate_mapping = 1 THEN
      (sum(accurate_mapping) OVER (PARTITION BY model, subject_id ORDER BY concept_pair_rank))::BIGINT
      ELSE 0 END AS mapping_result_number FROM {judged}""",
)
def mapping_result_number(t):
    return evaluation.mapping_result_number(_judged(t)).select(
        "model", "subject_id", "object_id", "mapping_result_number"
    )


def _judged(t):
    rows = evaluation.with_pair_id(evaluation.keep_mappable(t.mappings, t.truth))
    return evaluation.truth_join(rows, t.truth).withColumn(
        "accurate_mapping", F.coalesce("accurate_mapping", F.lit(0))
    )


@query(
    "concept_accuracy",
    """SELECT model, subject_id, subject_label, max(accurate_mapping) AS accurate_mapping
    FROM {judged} GROUP BY ALL""",
)
def concept_accuracy(t):
    return evaluation.concept_accuracy(_judged(t))


@query(
    "add_skipped_concepts",
    """SELECT c.subject_id, c.subject_label, c.mesh_concept_group, c.mapping_count, m.model,
      j.subject_id IS NOT NULL AS model_analyzed,
      CASE WHEN j.best = 1 THEN 'Hit' ELSE 'Miss' END AS hit_miss_concept
    FROM {concepts} c CROSS JOIN (SELECT DISTINCT model FROM {judged}) m
    LEFT JOIN (SELECT model, subject_id, max(accurate_mapping) AS best FROM {judged} GROUP BY ALL) j
      ON j.model = m.model AND j.subject_id = c.subject_id""",
)
def add_skipped_concepts(t):
    return evaluation.concept_frame(_judged(t), t.truth)


@query("hit_miss_flags", "SELECT model, subject_id, pair_id, hit_miss_concept, hit_miss_mapping FROM {prepared}")
def hit_miss_flags(t):
    return evaluation.prepare(t.mappings, t.truth, 10).select(
        "model", "subject_id", "pair_id", "hit_miss_concept", "hit_miss_mapping"
    )


@query("fill_missing", "SELECT * FROM {prepared}")
def fill_missing(t):
    return evaluation.prepare(t.mappings, t.truth)


@query(
    "fill_down",
    """SELECT c_custkey, last_value(segment IGNORE NULLS) OVER (
      PARTITION BY c_nationkey ORDER BY c_custkey) AS segment
    FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM {customer})""",
)
def fill_down(t):
    segment = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    rows = t.base("customer").withColumn("segment", segment)
    return ordering.fill_down(rows, "segment", ["c_nationkey"], [F.asc("c_custkey")]).select(
        "c_custkey", "segment"
    )


# Consensus -------------------------------------------------------------------------------------


def _pooled(t, rule="pattern"):
    return consensus.consensus(t.mappings, rule)


@query("top1_per_subject", "SELECT * EXCLUDE (rn) FROM {ballots}")
def top1(t):
    return consensus.top1_per_subject(t.mappings)


@query(
    "consensus_votes",
    """SELECT subject_id, object_id, subject_label, object_label, predicate_id,
    round(mean_similarity, 6) AS mean_similarity, votes, human_desc_vec_sim FROM {vote_table}""",
)
def consensus_votes(t):
    return rounded(consensus.votes(t.mappings))


for _name, _column in [
    ("consensus_participants", "participants"),
    ("consensus_options", "opts"),
    ("vote_share", "round(share, 6) AS share"),
    ("human_vote_flag", "human_desc_vec_sim"),
    ("consensus_ties", "ties"),
]:

    @query(_name, f"SELECT subject_id, object_id, {_column} FROM {{pooled}}")
    def _vote_column(t, column=_column.split(" AS ")[-1]):
        return rounded(_pooled(t).select("subject_id", "object_id", column))


@query(
    "consensus_ties_general",
    """SELECT subject_id, object_id, CASE WHEN votes = max(votes) OVER w
      AND (SELECT count(*) FROM {vote_table} o WHERE o.subject_id = v.subject_id
        AND o.votes = v.votes) > 1 THEN 1 ELSE 0 END AS ties
    FROM {vote_table} v WINDOW w AS (PARTITION BY subject_id)""",
)
def consensus_ties_general(t):
    return _pooled(t, "general").select("subject_id", "object_id", "ties")


def _evaluated(t):
    return consensus.evaluate_consensus(_pooled(t), t.truth)


@query(
    "vote_rank",
    "SELECT subject_id, object_id, concept_pair_rank FROM {evaluated}",
)
def vote_rank(t):
    return _evaluated(t).select("subject_id", "object_id", "concept_pair_rank")


@query(
    "consensus_evaluated",
    """SELECT model, mapping_justification, subject_id, predicate_id, object_id, pair_id, subject_label,
    object_label, mesh_concept_group, round(mean_similarity, 6) AS similarity_score, accurate_mapping,
    concept_pair_rank, mapping_count, mapping_result_number, hit_miss_concept, hit_miss_mapping,
    model_analyzed FROM {evaluated} WHERE mappability = 'Mappable'""",
)
def consensus_evaluated(t):
    return rounded(consensus.pooled_prepared(_evaluated(t)))


@query(
    "consensus_review",
    """SELECT model, mapping_justification, subject_id, predicate_id, object_id, pair_id, subject_label,
    object_label, mappability, mesh_concept_group, round(mean_similarity, 6) AS similarity_score,
    participants, opts, votes, round(share, 6) AS share, human_desc_vec_sim, ties, model_analyzed,
    '' AS accurate_mapping_r_1, '' AS confidence_r_1, '' AS reviewer_r_1 FROM {evaluated}""",
)
def consensus_review(t):
    return rounded(consensus.review_sheet(_evaluated(t)))


@query(
    "consensus_top_vote",
    "SELECT subject_id, object_id, top_vote_correct FROM {evaluated}",
)
def consensus_top_vote(t):
    return _evaluated(t).select("subject_id", "object_id", "top_vote_correct")


# Evaluation ------------------------------------------------------------------------------------

_COUNTS = """(SELECT count(DISTINCT subject_id) AS n,
  count(DISTINCT subject_id) FILTER (WHERE mesh_concept_group = 'Anatomical structure') AS n_as,
  count(DISTINCT subject_id) FILTER (WHERE mesh_concept_group = 'Cell type') AS n_ct FROM {mappable})"""
_COVERAGE = f"""SELECT model, mapping_results, mapped_concepts, n AS mappable_concepts,
  n - mapped_concepts AS skipped_concepts,
  round_even(mapped_concepts::DOUBLE / n, 3) AS mapped_concepts_percent
  FROM (SELECT model, count(*) AS mapping_results,
    count(DISTINCT subject_id) FILTER (WHERE model_analyzed) AS mapped_concepts
    FROM {{prepared}} GROUP BY model), {_COUNTS}"""
_FLAGS = "(SELECT DISTINCT model, subject_id, mesh_concept_group, hit_miss_concept FROM {prepared})"
_HITS = f"""SELECT model, hit, miss, round_even(hit::DOUBLE / n, 2) AS hit_percent,
  round_even(miss::DOUBLE / n, 2) AS miss_percent FROM (SELECT model,
    count(*) FILTER (WHERE hit_miss_concept = 'Hit') AS hit,
    count(*) FILTER (WHERE hit_miss_concept = 'Miss') AS miss FROM {_FLAGS} GROUP BY model), {_COUNTS}"""


def _group_counts():
    parts = []
    for group, short in (("Anatomical structure", "as"), ("Cell type", "ct")):
        for flag in ("Hit", "Miss"):
            parts.append(
                f"count(*) FILTER (WHERE hit_miss_concept = '{flag}' AND "
                f"mesh_concept_group = '{group}') AS {flag.lower()}_{short}"
            )
    return ", ".join(parts)


_GROUPS = f"""SELECT model, hit_as, miss_as, hit_ct, miss_ct,
  round_even(hit_as::DOUBLE / n_as, 2) AS hit_as_percent,
  round_even(miss_as::DOUBLE / n_as, 2) AS miss_as_percent,
  round_even(hit_ct::DOUBLE / n_ct, 2) AS hit_ct_percent,
  round_even(miss_ct::DOUBLE / n_ct, 2) AS miss_ct_percent
  FROM (SELECT model, {_group_counts()} FROM {_FLAGS} GROUP BY model), {_COUNTS}"""
_PR = """SELECT model, subject_id, coalesce(max(concept_pair_rank), 0) AS precision_k,
  coalesce(max(accurate_mapping)::DOUBLE / max(concept_pair_rank), 0) AS precision,
  sum(accurate_mapping)::BIGINT AS score_at_k, max(mapping_count) AS recall_k,
  sum(accurate_mapping)::DOUBLE / max(mapping_count) AS recall FROM {prepared} GROUP BY ALL"""
_F = f"""SELECT model, mean_k, mean_precision, mean_recall,
  5 * mean_precision * mean_recall / (4 * mean_precision + mean_recall) AS f_score, 2.0::DOUBLE AS beta
  FROM (SELECT model, avg(precision_k) AS mean_k, avg(precision) AS mean_precision,
    avg(recall) AS mean_recall FROM ({_PR}) GROUP BY model)"""
_RR = """SELECT model, subject_id, 1.0::DOUBLE / concept_pair_rank AS reciprocal_rank FROM {prepared}
  WHERE mapping_result_number = 1
  UNION SELECT model, subject_id, 0.0::DOUBLE FROM {prepared}
  WHERE hit_miss_concept = 'Miss' AND concept_pair_rank IS NOT NULL"""
_MRR = f"""SELECT model, avg(reciprocal_rank) AS mean_reciprocal_rank,
  stddev_samp(reciprocal_rank) AS mean_reciprocal_rank_sd FROM ({_RR}) GROUP BY model"""


def _select_rounded(sql, rounds, others):
    columns = ", ".join([*others, *[f"round({c}, 6) AS {c}" for c in rounds]])
    return f"SELECT {columns} FROM ({sql})"


@query("coverage", _COVERAGE)
def coverage(t):
    return evaluation.coverage(t.prepared, t.truth)


@query("hit_miss", _HITS)
def hit_miss(t):
    return evaluation.hit_miss(t.prepared, t.truth)


@query("hit_miss_by_group", _GROUPS)
def hit_miss_by_group(t):
    return evaluation.hit_miss_by_group(t.prepared, t.truth)


@query("precision_at_l", _select_rounded(_PR, ["precision"], ["model", "subject_id", "precision_k"]))
def precision_at_l(t):
    rows = evaluation.precision_recall(t.prepared)
    return rounded(rows.select("model", "subject_id", "precision_k", "precision"))


@query(
    "recall_at_l",
    _select_rounded(_PR, ["recall"], ["model", "subject_id", "score_at_k", "recall_k"]),
)
def recall_at_l(t):
    rows = evaluation.precision_recall(t.prepared)
    return rounded(rows.select("model", "subject_id", "score_at_k", "recall_k", "recall"))


_F_COLUMNS = ["mean_k", "mean_precision", "mean_recall", "f_score"]


@query("f_beta", _select_rounded(_F, _F_COLUMNS, ["model", "beta"]))
def f_beta(t):
    return rounded(evaluation.f_beta(evaluation.precision_recall(t.prepared)))


@query("reciprocal_rank", _select_rounded(_RR, ["reciprocal_rank"], ["model", "subject_id"]))
def reciprocal_rank(t):
    return rounded(evaluation.reciprocal_rank(t.prepared))


@query(
    "union_distinct",
    f"""SELECT DISTINCT subject_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM ({_RR})""",
)
def union_distinct(t):
    frames = [
        rounded(evaluation.reciprocal_rank(t.prepared.filter(F.col("model") == model))).drop("model")
        for model, *_ in MODELS
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


_MRR_COLUMNS = ["mean_reciprocal_rank", "mean_reciprocal_rank_sd"]


@query("mrr", _select_rounded(_MRR, _MRR_COLUMNS, ["model"]))
def mrr(t):
    return rounded(evaluation.mrr(evaluation.reciprocal_rank(t.prepared)))


MODEL_EVALUATION = f"""SELECT c.*, h.* EXCLUDE (model), g.* EXCLUDE (model), f.beta,
      {", ".join(f"round(f.{c}, 6) AS {c}" for c in _F_COLUMNS)},
      {", ".join(f"round(r.{c}, 6) AS {c}" for c in _MRR_COLUMNS)}
    FROM ({_COVERAGE}) c JOIN ({_HITS}) h ON h.model = c.model JOIN ({_GROUPS}) g ON g.model = c.model
    JOIN ({_F}) f ON f.model = c.model JOIN ({_MRR}) r ON r.model = c.model"""


@query("model_evaluation", MODEL_EVALUATION)
def model_evaluation(t):
    return rounded(evaluation.evaluate(t.prepared, t.truth))


@query(
    "concept_counts",
    """SELECT * FROM (SELECT
      count(DISTINCT CASE WHEN mesh_concept_group = 'Anatomical structure' THEN subject_label END)
        AS subject_concepts_as,
      count(DISTINCT CASE WHEN mesh_concept_group = 'Cell type' THEN subject_label END)
        AS subject_concepts_ct,
      count(*) FILTER (WHERE mappability = 'Mappable') AS mapping_recalls,
      count(DISTINCT subject_id) FILTER (WHERE mappability = 'Mappable') AS mappable_concepts,
      count(DISTINCT subject_id) FILTER (WHERE mappability = 'Mappable'
        AND mesh_concept_group = 'Anatomical structure') AS mappable_concepts_as,
      count(DISTINCT subject_id) FILTER (WHERE mappability = 'Mappable'
        AND mesh_concept_group = 'Cell type') AS mappable_concepts_ct FROM {truth}),
    (SELECT count(*) AS subject_concepts FROM {left_terms}),
    (SELECT count(*) AS target_concepts, count(*) FILTER (WHERE label < 5) AS target_concepts_as,
      count(*) FILTER (WHERE label >= 5) AS target_concepts_ct FROM {right_terms})""",
)
def concept_counts(t):
    namespaces = {"as": "http://example.org/right/AS_", "ct": "http://example.org/right/CT_"}
    return evaluation.concept_counts(
        t.truth, t.derived("left_terms"), t.derived("right_terms"), namespaces
    )


_UNMAPPABLE = """SELECT g.mesh_concept_group, g.concept_group,
  round_even(g.concept_group::DOUBLE / (SELECT count(*) FROM {left_terms}), 3) AS percent_subject_concept,
  r.exclusion_reason, r.concept_reason,
  round_even(r.concept_reason::DOUBLE / g.concept_group, 2) AS percent_subject_concept_reasons
  FROM (SELECT mesh_concept_group, count(*) AS concept_group FROM {truth}
    WHERE mappability = 'Unmappable' GROUP BY 1) g
  JOIN (SELECT mesh_concept_group, exclusion_reason, count(*) AS concept_reason FROM {truth}
    WHERE mappability = 'Unmappable' GROUP BY 1, 2) r ON r.mesh_concept_group = g.mesh_concept_group"""


@query("unmappable_stats", _UNMAPPABLE)
def unmappable_stats(t):
    return evaluation.unmappable_stats(t.truth, t.derived("left_terms"))


@query(
    "order_report",
    f"""SELECT *, row_number() OVER (ORDER BY mesh_concept_group, concept_group DESC,
      concept_reason DESC) AS position FROM ({_UNMAPPABLE})""",
)
def order_report(t):
    return placed(evaluation.unmappable_stats(t.truth, t.derived("left_terms")))


# Statistics ------------------------------------------------------------------------------------

_DESCRIBED = """count(*) AS mappings, median(similarity_score) AS median, avg(similarity_score) AS mean,
  stddev_samp(similarity_score) AS sd, stddev_samp(similarity_score) / sqrt(count(*)) AS std_err,
  var_samp(similarity_score) AS var, min(similarity_score) AS min, max(similarity_score) AS max,
  max(similarity_score) - min(similarity_score) AS range"""
_MEASURES = ["median", "mean", "sd", "std_err", "var", "min", "max", "range"]


def _rows(t):
    return statistics.analyzed(t.prepared)


@query(
    "describe_scores",
    _select_rounded(
        f"SELECT model, {_DESCRIBED} FROM {{analyzed}} GROUP BY model", _MEASURES, ["model", "mappings"]
    ),
)
def describe_scores(t):
    return rounded(statistics.describe_scores(_rows(t), ["model"]))


@query(
    "describe_scores_by_accuracy",
    _select_rounded(
        f"""SELECT *, (sum(mappings) OVER (PARTITION BY model))::BIGINT AS mappings_overall,
          round_even(mappings * 100.0::DOUBLE / sum(mappings) OVER (PARTITION BY model), 2)
            AS percent_mappings
        FROM (SELECT model, hit_miss_mapping, {_DESCRIBED} FROM {{analyzed}} GROUP BY ALL)""",
        _MEASURES, ["model", "hit_miss_mapping", "mappings", "mappings_overall", "percent_mappings"],
    ),
)
def describe_scores_by_accuracy(t):
    return rounded(statistics.describe_scores_by_accuracy(_rows(t)))


@query(
    "contingency",
    """SELECT model, count(*) FILTER (WHERE accurate_mapping = 1) AS "1",
    count(*) FILTER (WHERE accurate_mapping = 0) AS "0" FROM {analyzed} GROUP BY model""",
)
def contingency(t):
    return statistics.contingency(_rows(t), "model", "accurate_mapping", [1, 0])


_PAIRS = [
    ("model", "accurate_mapping"),
    ("model", "mesh_concept_group"),
    ("mesh_concept_group", "accurate_mapping"),
]


def _chi_sql(a, b):
    return f"""SELECT '{a} x {b}' AS test, round(sum((o - e) * (o - e) / e), 6) AS statistic,
      (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof, sum(o)::BIGINT AS n
    FROM (SELECT x.a, y.b, coalesce(c.o, 0) AS o, x.r * y.r / z.n AS e
      FROM (SELECT {a} AS a, count(*)::DOUBLE AS r FROM {{analyzed}} GROUP BY 1) x,
        (SELECT {b} AS b, count(*)::DOUBLE AS r FROM {{analyzed}} GROUP BY 1) y,
        (SELECT count(*)::DOUBLE AS n FROM {{analyzed}}) z
      LEFT JOIN (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {{analyzed}} GROUP BY 1, 2) c
        ON c.a = x.a AND c.b = y.b)"""


@query("chi_square", " UNION ALL ".join(_chi_sql(a, b) for a, b in _PAIRS))
def chi_square(t):
    out = None
    for a, b in _PAIRS:
        one = statistics.chi_square(_rows(t), a, b).select(
            F.lit(f"{a} x {b}").alias("test"), F.round("statistic", 6).alias("statistic"), "dof", "n"
        )
        out = one if out is None else out.unionByName(one)
    return out


def _anova_sql(source, y, groups):
    return f"""SELECT k - 1 AS df_between, n - k AS df_within, round(between_ss, 6) AS ss_between,
      round(within_ss, 6) AS ss_within,
      round((between_ss / (k - 1)) / (within_ss / (n - k)), 4) AS f_value
    FROM (SELECT count(DISTINCT g) AS k, count(*) AS n, sum((m - grand) * (m - grand)) AS between_ss,
        sum((y - m) * (y - m)) AS within_ss
      FROM (SELECT y, g, avg(y) OVER (PARTITION BY g) AS m, avg(y) OVER () AS grand
        FROM (SELECT {y} AS y, {groups} AS g FROM {source})))"""


def _anova(df):
    return rounded(df.drop("p_value"), f_value=4)


@query("anova_oneway", _anova_sql("{analyzed}", "similarity_score", "model"))
def anova_oneway(t):
    return _anova(statistics.anova_oneway(_rows(t), "similarity_score", "model"))


@query(
    "levene",
    _anova_sql(
        "(SELECT model, abs(similarity_score - median(similarity_score) OVER (PARTITION BY model)) AS d "
        "FROM {analyzed})", "d", "model",
    ),
)
def levene(t):
    return _anova(statistics.levene(_rows(t), "similarity_score", "model"))


@query(
    "levene_crossed",
    _anova_sql(
        """(SELECT model || mesh_concept_group || accurate_mapping AS cell, abs(similarity_score
          - median(similarity_score) OVER (PARTITION BY model, mesh_concept_group, accurate_mapping)) AS d
        FROM {analyzed})""", "d", "cell",
    ),
)
def levene_crossed(t):
    return _anova(
        statistics.levene(
            _rows(t), "similarity_score", ["model", "mesh_concept_group", "accurate_mapping"]
        )
    )


_FACTORS = ["model", "mesh_concept_group", "accurate_mapping"]
_MODELS = {
    "t1.1": ["model"],
    "t1.2": ["mesh_concept_group"],
    "t1.3": ["accurate_mapping"],
    "t2.1": ["model", "accurate_mapping"],
    "t2.2": _FACTORS,
    "t3.1": ["model", "accurate_mapping"],
    "t3.2": _FACTORS,
}
_SUMS = {"accurate_mapping": "sum", "mesh_concept_group": "sum"}


def _normed(t):
    """Scores centred and scaled over all analysed rows."""
    return zscore(_rows(t), "similarity_score", "similarity_score")


_CELLS = """(SELECT model, accurate_mapping AS a, count(*)::DOUBLE AS n, avg(similarity_score) AS m
  FROM {normed} GROUP BY 1, 2)"""
_MSE = f"""(SELECT sum(d * d) / (count(*) - (SELECT count(*) FROM {_CELLS})) AS mse FROM (
  SELECT similarity_score - avg(similarity_score) OVER (PARTITION BY model, accurate_mapping) AS d
  FROM {{normed}}))"""


@query(
    "glm_fit",
    f"""SELECT term, round(b, 6) AS estimate, round(sqrt(v * mse), 6) AS std_error,
      round(b / sqrt(v * mse), 3) AS t_value
    FROM (
      SELECT '(Intercept)' AS term, m AS b, 1 / n AS v FROM {_CELLS} WHERE model = 'back' AND a = 0
      UNION ALL SELECT 'model' || x.model, x.m - o.m, 1 / x.n + 1 / o.n FROM {_CELLS} x
        JOIN {_CELLS} o ON o.model = 'back' AND o.a = 0 WHERE x.a = 0 AND x.model <> 'back'
      UNION ALL SELECT 'accurate_mapping1', x.m - o.m, 1 / x.n + 1 / o.n FROM {_CELLS} x
        JOIN {_CELLS} o ON o.model = 'back' AND o.a = 0 WHERE x.a = 1 AND x.model = 'back'
      UNION ALL SELECT 'model' || x.model || ':accurate_mapping1', x.m - y.m - z.m + o.m,
        1 / x.n + 1 / y.n + 1 / z.n + 1 / o.n FROM {_CELLS} x
        JOIN {_CELLS} y ON y.model = x.model AND y.a = 0 JOIN {_CELLS} z ON z.model = 'back' AND z.a = 1
        JOIN {_CELLS} o ON o.model = 'back' AND o.a = 0 WHERE x.a = 1 AND x.model <> 'back'), {_MSE}""",
)
def glm_fit(t):
    fit = linear_models.glm_fit(_normed(t), "similarity_score", ["model", "accurate_mapping"])
    return rounded(fit.drop("p_value"), t_value=3)


@query(
    "glm_fit_one_factor",
    """SELECT CASE WHEN model = 'back' THEN '(Intercept)' ELSE 'model' || model END AS term,
      round(CASE WHEN model = 'back' THEN m ELSE m - (
        SELECT avg(similarity_score) FROM {normed} WHERE model = 'back') END, 6) AS estimate
    FROM (SELECT model, avg(similarity_score) AS m FROM {normed} GROUP BY model)""",
)
def glm_fit_one_factor(t):
    fit = linear_models.glm_fit(_normed(t), "similarity_score", ["model"])
    return rounded(fit.select("term", "estimate"))


def _fits_sql():
    """A full factorial model fits each cell by its mean."""
    parts = []
    for name, factors in _MODELS.items():
        columns = ", ".join(factors)
        parts.append(
            f"""SELECT '{name}' AS model, count(*)::DOUBLE AS n, sum(d * d) AS rss,
            count(DISTINCT ({columns})) + 1 AS parameters FROM (SELECT {columns}, similarity_score
              - avg(similarity_score) OVER (PARTITION BY {columns}) AS d FROM {{normed}})"""
        )
    return " UNION ALL ".join(parts)


@query(
    "model_selection",
    f"""SELECT model, parameters::INT AS parameters, round(aic, 4) AS aic, round(aicc, 4) AS aicc,
      round(aicc - min(aicc) OVER (), 4) AS delta,
      round(exp((min(aicc) OVER () - aicc) / 2) / sum(exp((low - aicc) / 2)) OVER (), 4) AS weight,
      round(l, 4) AS log_likelihood
    FROM (SELECT *, min(aicc) OVER () AS low FROM (
      SELECT *, aic + 2.0 * parameters * (parameters + 1) / (n - parameters - 1) AS aicc
      FROM (SELECT *, 2 * parameters - 2 * l AS aic FROM (
        SELECT *, -n / 2 * (ln(2 * pi() * rss / n) + 1) AS l FROM ({_fits_sql()})))))""",
)
def model_selection(t):
    contrasts = {"t3.1": {"accurate_mapping": "sum"}, "t3.2": _SUMS}
    return rounded(linear_models.model_selection(_normed(t), "similarity_score", _MODELS, contrasts), 4)


@query("anova_factorial")
def anova_factorial(t):
    rows = _normed(t)
    second = linear_models.anova_factorial(rows, "similarity_score", _FACTORS)
    third = linear_models.anova_factorial(rows, "similarity_score", _FACTORS, 3, _SUMS)
    return second.withColumn("type", F.lit(2)).unionByName(third.withColumn("type", F.lit(3)))


@query(
    "anova_two_way",
    """WITH c AS (SELECT model AS g, accurate_mapping AS a, count(*)::DOUBLE AS n, avg(similarity_score) AS m,
        var_pop(similarity_score) * count(*) AS ss FROM {normed} GROUP BY 1, 2),
      f AS (SELECT sum(ss) AS rss, sum(n) - count(*) AS dof, count(*) AS cells FROM c),
      g AS (SELECT g, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1),
      a AS (SELECT a, sum(n) AS n, sum(n * m) / sum(n) AS m FROM c GROUP BY 1),
      within_g AS (SELECT sum(c.ss + c.n * pow(c.m - g.m, 2)) AS rss FROM c JOIN g ON c.g = g.g),
      within_a AS (SELECT sum(c.ss + c.n * pow(c.m - a.m, 2)) AS rss FROM c JOIN a ON c.a = a.a),
      slope AS (SELECT pow(sum(w * (y.m - x.m)), 2) / sum(w) AS ss FROM (SELECT x.g, x.n * y.n / (x.n + y.n) AS w
        FROM c x JOIN c y ON x.g = y.g AND x.a = 0 AND y.a = 1) p
        JOIN c x ON x.g = p.g AND x.a = 0 JOIN c y ON y.g = p.g AND y.a = 1),
      t AS (
        SELECT 'model' AS term, within_a.rss - (within_g.rss - slope.ss) AS ss, (SELECT count(*) - 1 FROM g) AS dof
          FROM within_a, within_g, slope
        UNION ALL SELECT 'accurate_mapping', ss, 1 FROM slope
        UNION ALL SELECT 'model:accurate_mapping', within_g.rss - slope.ss - f.rss, (SELECT cells - count(*) - 1 FROM f, g GROUP BY cells)
          FROM within_g, slope, f)
    SELECT term, round(ss, 6) AS sum_sq, t.dof::INT AS dof, round((ss / t.dof) / (rss / f.dof), 4) AS f_value FROM t, f
    UNION ALL SELECT 'Residuals', round(rss, 6), dof::INT, NULL FROM f""",
)
def anova_two_way(t):
    """The same analysis for two factors, one of them with two levels: there SQL has a closed form."""
    found = linear_models.anova_factorial(_normed(t), "similarity_score", ["model", "accurate_mapping"])
    return rounded(found.drop("p_value"), f_value=4)


_ORDER = ["model", "subject_id", "concept_pair_rank"]
_RESIDUALS = """(SELECT *, similarity_score - avg(similarity_score) OVER (PARTITION BY model) AS e
  FROM {analyzed})"""


def _residuals(t):
    return statistics.residuals(_rows(t), "similarity_score", ["model"], "e")


@query(
    "lag_residual",
    f"""SELECT model, pair_id, round(e - lag(e) OVER (ORDER BY model, subject_id, concept_pair_rank), 9)
    AS lag_difference FROM {_RESIDUALS}""",
)
def lag_residual(t):
    own = _residuals(t).select("pair_id", "e", *_ORDER)  # all that is sorted is also written
    rows = statistics.lag_residual(own, "e", _ORDER)
    return rounded(rows.select("model", "pair_id", "lag_difference"), 9)


@query(
    "durbin_watson",
    f"""SELECT round(sum(d * d) / sum(e * e), 6) AS statistic FROM (SELECT e,
      e - lag(e) OVER (ORDER BY model, subject_id, concept_pair_rank) AS d FROM {_RESIDUALS})""",
)
def durbin_watson(t):
    return rounded(statistics.durbin_watson(_residuals(t), "e", _ORDER))


@query(
    "pairwise_contrasts",
    """SELECT a.model AS group_a, b.model AS group_b, round(b.m - a.m, 6) AS difference,
      round(sqrt(mse * (1 / a.n + 1 / b.n)), 6) AS std_error,
      round((b.m - a.m) / sqrt(mse * (1 / a.n + 1 / b.n)), 4) AS t_value,
      round(abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 4) AS studentised
    FROM (SELECT model, count(*)::DOUBLE AS n, avg(similarity_score) AS m FROM {analyzed} GROUP BY 1) a
    JOIN (SELECT model, count(*)::DOUBLE AS n, avg(similarity_score) AS m FROM {analyzed} GROUP BY 1) b
      ON a.model < b.model,
    (SELECT sum(d * d) / (count(*) - count(DISTINCT model)) AS mse FROM (SELECT model,
      similarity_score - avg(similarity_score) OVER (PARTITION BY model) AS d FROM {analyzed}))""",
)
def pairwise_contrasts(t):
    return rounded(
        statistics.pairwise_contrasts(_rows(t), "similarity_score", "model"), t_value=4, studentised=4
    )


@query(
    "contrasts_treatment",
    f"""SELECT x.model AS group_a, y.model AS group_b, round(y.m - x.m, 6) AS difference,
      round(sqrt(mse * (1 / x.n + 1 / y.n)), 6) AS std_error,
      round((y.m - x.m) / sqrt(mse * (1 / x.n + 1 / y.n)), 4) AS t_value
    FROM {_CELLS} x JOIN {_CELLS} y ON x.model < y.model AND x.a = 0 AND y.a = 0, {_MSE}""",
)
def contrasts_treatment(t):
    """Models compared at inaccurate mappings, the first level of the other factor."""
    found = linear_models.model_contrasts(
        _normed(t), "similarity_score", ["model", "accurate_mapping"], "model"
    )
    return rounded(found.drop("p_value", "p_adjusted"), t_value=4)


@query(
    "contrasts_sum",
    f"""SELECT group_a, group_b, round(d, 6) AS difference, round(sqrt(mse * v), 6) AS std_error,
      round(d / sqrt(mse * v), 4) AS t_value
    FROM (SELECT x.model AS group_a, y.model AS group_b, avg(y.m - x.m) AS d, sum(1 / x.n + 1 / y.n) / 4 AS v
      FROM {_CELLS} x JOIN {_CELLS} y ON x.model < y.model AND x.a = y.a GROUP BY 1, 2), {_MSE}""",
)
def contrasts_sum(t):
    """Models compared over the mean of accurate and inaccurate mappings."""
    found = linear_models.model_contrasts(
        _normed(t), "similarity_score", ["model", "accurate_mapping"], "model",
        contrasts={"accurate_mapping": "sum"},
    )
    return rounded(found.drop("p_value", "p_adjusted"), t_value=4)


@query(
    "durbin_watson_test",
    f"""SELECT round(sum(d * d) / sum(e * e), 6) AS statistic, round(sum(e * b) / sum(e * e), 6) AS autocorrelation,
      1000::INT AS replicates FROM (SELECT e, b, e - b AS d FROM (SELECT e,
      lag(e) OVER (ORDER BY model, subject_id, concept_pair_rank) AS b FROM {_RESIDUALS}))""",
)
def durbin_watson_test(t):
    """The resampled p-value has no SQL; a test compares it with plain resampling."""
    found = statistics.durbin_watson_test(_rows(t), "similarity_score", ["model"], _ORDER)
    return rounded(found.drop("p_value"))


_SORTED = f"""(SELECT e, row_number() OVER (ORDER BY e) AS i, count(*) OVER ()::DOUBLE AS n FROM {_RESIDUALS})"""


def _scores_sql(p):
    """The normal quantile written out."""

    def ratio(table, r):
        above, below = (reduce(lambda acc, c: f"({acc} * {r} + {c!r}::DOUBLE)", reversed(own), "0::DOUBLE") for own in table)
        return f"({above} / {below})"

    q, r = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    middle, tail = ratio(normal.CENTRE, f"(0.180625::DOUBLE - {q} * {q})"), ratio(normal.TAIL, f"({r} - 1.6::DOUBLE)")
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {middle} WHEN {r} <= 5 THEN sign({q}) * {tail} "
        f"ELSE sign({q}) * {ratio(normal.FAR_TAIL, f'({r} - 5)')} END"
    )


@query(
    "normality",
    f"""SELECT count(*) AS n, round(pow(sum((e - c) * m), 2) / (sum((e - c) * (e - c)) * sum(m * m)), 6) AS statistic
    FROM (SELECT e, avg(e) OVER () AS c, {_scores_sql("((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))")} AS m FROM {_SORTED})""",
)
def normality(t):
    return rounded(statistics.normality(_residuals(t), "e").drop("p_value"))


@query(
    "quantile_points",
    f"""SELECT k AS point, round({_scores_sql("((k - 0.5::DOUBLE) / 100)")}, 6) AS theoretical, round(e, 6) AS sample
    FROM (SELECT unnest(range(1, 101)) AS k) JOIN {_SORTED} ON i = ceil((k - 0.5::DOUBLE) / 100 * n)""",
)
def quantile_points(t):
    return rounded(statistics.quantile_points(_residuals(t), "e"))


@query(
    "density",
    """WITH g AS (SELECT model, hit_miss_mapping AS h, count(*)::DOUBLE AS n, coalesce(stddev_samp(similarity_score), 0) AS sd,
        (quantile_cont(similarity_score, 0.75) - quantile_cont(similarity_score, 0.25)) / 1.34 AS iq,
        abs(min(similarity_score)) AS least FROM {analyzed} GROUP BY 1, 2),
      w AS (SELECT model, h, n, 0.9 * pow(n, -0.2) * coalesce(nullif(least(sd, iq), 0), nullif(sd, 0), nullif(least, 0), 1) AS bw
        FROM g),
      v AS (SELECT model, hit_miss_mapping AS h, similarity_score * 127 AS t FROM {analyzed}),
      b AS (SELECT model, h, floor(t) AS k, 1 - (t - floor(t)) AS m FROM v
        UNION ALL SELECT model, h, floor(t) + 1, t - floor(t) FROM v)
    SELECT w.model, w.h AS hit_miss_mapping, round(x / 127, 6) AS x, round(sum(
      CASE WHEN abs(x - k) / 127 <= 9 * bw + 0.02 THEN m * exp(-pow((x - k) / 127 / bw, 2) / 2) / (n * bw * sqrt(2 * pi())) ELSE 0 END), 6) AS density
    FROM w JOIN b ON b.model = w.model AND b.h = w.h, (SELECT unnest(range(0, 128))::DOUBLE AS x)
    GROUP BY w.model, w.h, x""",
)
def density(t):
    return rounded(statistics.density(_rows(t), ["model", "hit_miss_mapping"], low=0.0, high=1.0, points=128))


@query(
    "boxplot_stats",
    """SELECT model, hit_miss_mapping, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(similarity_score) FILTER (WHERE inside) AS lower_whisker,
      max(similarity_score) FILTER (WHERE inside) AS upper_whisker,
      count(*) FILTER (WHERE NOT inside) AS outliers
    FROM (SELECT a.*, q1, median, q3, similarity_score BETWEEN q1 - 1.5 * (q3 - q1)
        AND q3 + 1.5 * (q3 - q1) AS inside
      FROM {analyzed} a JOIN (SELECT model, hit_miss_mapping, quantile_cont(similarity_score, 0.25) AS q1,
        median(similarity_score) AS median, quantile_cont(similarity_score, 0.75) AS q3
        FROM {analyzed} GROUP BY 1, 2) q
      ON q.model = a.model AND q.hit_miss_mapping = a.hit_miss_mapping)
    GROUP BY model, hit_miss_mapping, 3, 4, 5""",
)
def boxplot_stats(t):
    return rounded(statistics.boxplot_stats(_rows(t), ["model", "hit_miss_mapping"]), 6,
                   lower_whisker=9, upper_whisker=9)


@query(
    "boxplot_lineitem",
    """SELECT l_returnflag, l_linestatus, round(q1, 4) AS q1, round(median, 4) AS median,
      round(q3, 4) AS q3, min(l_extendedprice) FILTER (WHERE inside) AS lower_whisker,
      max(l_extendedprice) FILTER (WHERE inside) AS upper_whisker,
      count(*) FILTER (WHERE NOT inside) AS outliers
    FROM (SELECT a.*, q1, median, q3, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1)
        AND q3 + 1.5 * (q3 - q1) AS inside
      FROM {lineitem} a JOIN (SELECT l_returnflag, l_linestatus,
        quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median,
        quantile_cont(l_extendedprice, 0.75) AS q3 FROM {lineitem} GROUP BY 1, 2) q
      ON q.l_returnflag = a.l_returnflag AND q.l_linestatus = a.l_linestatus)
    GROUP BY l_returnflag, l_linestatus, 3, 4, 5""",
)
def boxplot_lineitem(t):
    rows = statistics.boxplot_stats(
        t.base("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"
    )
    return rounded(rows, 4)


@query(
    "density_bins",
    """SELECT model, hit_miss_mapping, CASE WHEN similarity_score < 0 THEN 0
      WHEN similarity_score >= 1 THEN 51 ELSE floor(similarity_score * 50)::INT + 1 END AS bin,
      count(*) AS mappings FROM {analyzed} GROUP BY ALL""",
)
def density_bins(t):
    return statistics.density_bins(_rows(t), ["model", "hit_miss_mapping"])


@query(
    "hit_rank_histogram",
    """SELECT model, rank, accurate, round(log10(accurate), 6) AS log_accurate FROM (
      SELECT model, CASE WHEN model_analyzed THEN concept_pair_rank ELSE 0 END AS rank,
        count(*) AS accurate FROM {prepared} WHERE hit_miss_mapping = 'Hit' GROUP BY ALL)""",
)
def hit_rank_histogram(t):
    return rounded(statistics.hit_rank_histogram(t.prepared))


@query(
    "residual_summary",
    f"""SELECT bin, residuals, round(mean, 6) AS mean, round(sqrt(m2 / (n - 1)), 6) AS sd,
      round(sqrt(n) * m3 / pow(m2, 1.5), 6) AS skewness, round(n * m4 / (m2 * m2) - 3, 6) AS kurtosis
    FROM (SELECT least(floor((e - low) / (high - low) * 20)::INT + 1, 20) AS bin, count(*) AS residuals
      FROM (SELECT e, min(e) OVER () AS low, max(e) OVER () AS high FROM {_RESIDUALS}) GROUP BY 1),
    (SELECT count(*)::DOUBLE AS n, avg(e) AS mean, sum(pow(e - c, 2)) AS m2, sum(pow(e - c, 3)) AS m3,
      sum(pow(e - c, 4)) AS m4 FROM (SELECT e, avg(e) OVER () AS c FROM {_RESIDUALS}))""",
)
def residual_summary(t):
    return rounded(statistics.residual_summary(_residuals(t), "e"))
