"""Sources, text and scalar operators."""

from pyspark.sql import functions as F

from registry.core import query
from registry.inputs import (
    ANATOMY, CELLS, COLLECTION, HUMAN, MODELS, OBO, OIO, RDFS_LABEL,
)
from termloom.functions import numeric, text, vectors
from termloom.operators import graph, similarity, terms
from termloom.operators.extraction import describe
from termloom.operators.plugins import expand_content, render_expand_prompt
from termloom.session import scratch_path
from termloom.sources import sinks, tables

CLEAN = r"trim(regexp_replace({0}, '[\t\n\x0B\f\r \x{{00A0}}\x{{3000}}]+', ' ', 'g'))"


def clean(column: str) -> str:
    return CLEAN.replace("{0}", column)


def _csv(t, df, name, **options):
    path = scratch_path(t.spark, name)
    writer = df.write.option("header", True).option("quote", '"').option("escape", '"')
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.csv(path)
    return path


# Sources and sinks -----------------------------------------------------------------------------


@query("read_terms", "SELECT iri, id, name, nullif(aka, '') AS aka, description FROM {terms}")
def read_terms(t):
    rows = t.derived("terms")
    path = _csv(t, rows.select(*reversed(rows.columns)), "terms", ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False, quoteAll=True, emptyValue="")
    read = tables.read_terms(t.spark, path)
    return read.withColumn("aka", F.nullif("aka", F.lit("")))


@query("read_scores_lenient", """SELECT source, target || ', "q"' AS target, score FROM {scores}""")
def read_scores(t):
    # Some ids hold commas and quotes.
    # Written first, as two writes read them.
    scores = t.written(t.scores(), "scores").withColumn("target", F.concat("target", F.lit(', "q"')))
    path = _csv(t, scores, "scores", quoteAll=True)
    # Malformed lines in a file of their own; its first one is taken for the header.
    broken = F.concat(F.lit("no score for "), F.col("source"))
    scores.select(broken).write.mode("append").text(path)
    return tables.read_scores(t.spark, path)


@query(
    "repair_ranked",
    """SELECT split_part(line, ',', 1) AS source, split_part(line, ',', 2) AS target,
    CASE WHEN len(string_split(line, ',')) = 5 THEN split_part(line, ',', 4)
      ELSE split_part(line, ',', 3) END::INT AS rank,
    CASE WHEN len(string_split(line, ',')) = 5 THEN split_part(line, ',', 3)
      ELSE split_part(line, ',', 4) END::DOUBLE AS score FROM {ranked_lines}""",
)
def repair_ranked(t):
    return tables.repair_ranked(t.derived("ranked_lines"))


def _mapping_folder(t):
    """One CSV per model, named as mapping files are."""
    rows = t.mappings
    folder = scratch_path(t.spark, "mapping-sets")
    for model, file in [("human descriptions", "desc-vec"), ("first half", "first.llm-vec"),
                        ("second half", "second.llm-vec"), ("front", "pooled-front-vec"),
                        ("back", "back")]:
        own = rows.filter(F.col("model") == model).drop("model")
        sinks.write_mappings(own, f"{folder}/demo-mapping.{file}.sssom.csv")
    return folder


_SETS = """SELECT subject_id, subject_label, predicate_id, object_id, object_label,
  similarity_score, comment, mapping_justification,
  CASE model WHEN 'first half' THEN 'first.llm' WHEN 'second half' THEN 'second.llm'
    WHEN 'front' THEN 'pooled-front' ELSE model END AS model FROM {mappings}"""


@query("read_mapping_sets", _SETS)
def read_mapping_sets(t):
    return tables.read_mapping_sets(t.spark, _mapping_folder(t), "demo")


@query("exclude_pooled", f"SELECT * FROM ({_SETS}) WHERE model NOT LIKE '%pooled%'")
def exclude_pooled(t):
    return tables.read_mapping_sets(t.spark, _mapping_folder(t), "demo", pooled=False)


@query("read_prepared", "SELECT * FROM {prepared}")
def read_prepared(t):
    folder = scratch_path(t.spark, "prepared-files")
    for model, *_ in MODELS:
        own = t.prepared.filter(F.col("model") == model)
        own.write.option("header", True).csv(f"{folder}/demo-mapping.{model}-prepared.csv")
    return tables.read_prepared(t.spark, folder, "demo")


@query("read_truth", "SELECT * FROM {truth}")
def read_truth(t):
    # The file is wider and its columns stand in another order.
    wide = t.truth.select(F.lit(1).alias("row"), *reversed(t.truth.columns), F.lit("").alias("note"))
    return tables.read_truth(t.spark, _csv(t, wide, "truth"))


@query(
    "decode_embeddings",
    """SELECT id, unnest(range(1, 65)) - 1 AS pos, round(unnest(embedding)::DOUBLE, 6) AS value
    FROM {left_vectors}""",
)
def decode_embeddings(t):
    blobs = vectors.encode_embeddings(t.vectors("left"))
    rows = vectors.decode_embeddings(blobs).select("id", F.posexplode("embedding"))
    return rows.select("id", F.col("pos").cast("long"), F.round(F.col("col").cast("double"), 6).alias("value"))


@query(
    "merge_graphs",
    f"SELECT DISTINCT s, p, o FROM {{triples}} WHERE g IN ('{ANATOMY}', '{COLLECTION}', '{CELLS}')",
)
def merge_graphs(t):
    return graph.merge_graphs(t.triples, [ANATOMY, COLLECTION, CELLS])


@query(
    "read_seeds",
    f"SELECT DISTINCT s, o FROM {{triples}} t JOIN {{part_seeds}} r ON r.iri = t.s "
    f"WHERE p = '{RDFS_LABEL}'",
)
def read_seeds(t):
    seeds = tables.read_seeds(t.spark, _csv(t, t.derived("part_seeds"), "seeds"))
    labels = graph.match(t.triples, RDFS_LABEL, "s", "o")
    return labels.join(seeds, labels["s"] == seeds["iri"], "left_semi").distinct()


@query(
    "paged_extract",
    """SELECT iri, id, name, (row_number() OVER (ORDER BY id) - 1) // 1000 AS page FROM {part_terms}""",
)
def paged_extract(t):
    return terms.pages(t.derived("part_terms").select("iri", "id", "name"), "id", 1000)


@query(
    "offset_page",
    "SELECT iri, id, name FROM {part_terms} ORDER BY id LIMIT 100 OFFSET 100",
)
def offset_page(t):
    return terms.page(t.derived("part_terms").select("iri", "id", "name"), "id", 100, 1)


@query(
    "write_mappings",
    "SELECT * FROM {mappings}",
)
def write_mappings(t):
    folder = scratch_path(t.spark, "sssom")
    for model, *_ in MODELS:
        own = t.mappings.filter(F.col("model") == model).drop("model")
        # Other columns and another order of columns do not matter to the reader.
        own = own.select(F.lit("x").alias("extra"), *reversed(own.columns))
        sinks.write_mappings(own, f"{folder}/demo-mapping.{model}.sssom.csv")
    return tables.read_mapping_sets(t.spark, folder, "demo")


@query(
    "publish",
    """SELECT *, 'left-right' AS dataset, 'v0.0.1' AS version, true AS stamped FROM {mappings}""",
)
def publish(t):
    config = sinks.RunConfig("left-right", "v0.0.1", "", "", scratch_path(t.spark, "output"))
    # The second run replaces one model and leaves the others alone.
    sinks.publish(t.mappings, config)
    done = sinks.publish(t.mappings.filter("model = 'front'"), config)
    return done.withColumn("stamped", F.col("created").isNotNull()).drop("created")


# Text ------------------------------------------------------------------------------------------

_COMPOSED = clean(
    "name || CASE WHEN length(aka) > 0 THEN ' also known as ' || aka ELSE '' END || ' ' || description"
)


@query("compose_content", f"SELECT id, {_COMPOSED} AS content FROM {{terms}}")
def compose_content(t):
    return terms.compose_content(t.derived("terms"))


@query(
    "normalize_ws",
    f"SELECT conv_id, turn, {clean('text')} AS text FROM {{conversations}}",
)
def normalize_ws(t):
    rows = t.base("conversations")
    return rows.select("conv_id", "turn", text.normalize_ws(F.col("text")).alias("text"))


_SHORT = "Expand $name ($aka): $input"


@query(
    "render_expand_prompt",
    "SELECT id, 'Expand ' || name || ' (' || aka || '): ' || description AS prompt FROM {terms}",
)
def render_prompt(t):
    return render_expand_prompt(t.derived("terms"), _SHORT)


def _echo(prompts):
    return [f"  {p}\n  (expanded) " for p in prompts]


@query(
    "expand_content",
    "SELECT id, " + clean("'Expand ' || name || ' (' || aka || '): ' || description || ' (expanded)'")
    + " AS content FROM {terms}",
)
def expand(t):
    return expand_content(t.derived("terms"), _echo, _SHORT)


@query(
    "content_lookup",
    f"""SELECT t.id, t.name, c.content FROM {{terms}} t LEFT JOIN
    (SELECT id, {_COMPOSED} AS content FROM {{terms}} WHERE aka <> '') c ON c.id = t.id""",
)
def content_lookup(t):
    all_terms = t.derived("terms")
    content = terms.compose_content(all_terms.filter("aka <> ''"))
    return terms.content_lookup(all_terms, content).select("id", "name", "content")


_PART_LABELS = f"(SELECT s, o AS name FROM {{triples}} WHERE p = '{RDFS_LABEL}' AND g = '{ANATOMY}')"


def _labels(t):
    rows = t.triples.filter(F.col("g") == ANATOMY)
    return rows, graph.match(rows, RDFS_LABEL, "iri", "name")


@query(
    "desc_fallback",
    f"""SELECT l.s AS iri, coalesce(a.o, b.o, l.name) AS description FROM {_PART_LABELS} l
    LEFT JOIN (SELECT s, o FROM {{triples}} WHERE p = '{OBO}IAO_0000115' AND g = '{ANATOMY}') a
      ON a.s = l.s
    LEFT JOIN (SELECT s, o FROM {{triples}} WHERE p = '{OBO}UBPROP_0000010' AND g = '{ANATOMY}') b
      ON b.s = l.s""",
)
def desc_fallback(t):
    rows, labels = _labels(t)
    out = graph.optional(labels, graph.match(rows, f"{OBO}IAO_0000115", "iri", "d1"))
    out = graph.optional(out, graph.match(rows, f"{OBO}UBPROP_0000010", "iri", "d2"))
    return out.select("iri", describe("name", "d1", "d2").alias("description"))


@query(
    "iri_to_id",
    f"""SELECT s, replace(replace(s, '{OBO}', ''), 'http://identifiers.org/hgnc/', 'HGNC_') AS id
    FROM {{triples}} WHERE p = '{RDFS_LABEL}'""",
)
def iri_to_id(t):
    labels = graph.match(t.triples, RDFS_LABEL).select("s")
    rules = {OBO: "", "http://identifiers.org/hgnc/": "HGNC_"}
    return labels.withColumn("id", text.iri_to_id(F.col("s"), rules))


@query(
    "filter_namespace",
    f"SELECT s AS iri, o AS name FROM {{triples}} WHERE p = '{RDFS_LABEL}' AND s LIKE '{OBO}CL\\_%' ESCAPE '\\'",
)
def filter_namespace(t):
    return terms.filter_namespace(graph.match(t.triples, RDFS_LABEL, "iri", "name"), f"{OBO}CL_")


@query(
    "filter_subset",
    f"""SELECT DISTINCT l.s AS iri, replace(l.s, '{OBO}', '') AS id FROM {{triples}} l
    LEFT JOIN {{triples}} u ON u.s = l.s AND u.p = '{OIO}inSubset'
    WHERE l.p = '{RDFS_LABEL}' AND (u.o = '{HUMAN}' OR starts_with(replace(l.s, '{OBO}', ''), 'CL_'))""",
)
def filter_subset(t):
    labels = graph.match(t.triples, RDFS_LABEL, "iri", "name").select("iri")
    rows = graph.optional(labels, graph.match(t.triples, f"{OIO}inSubset", "iri", "subset"))
    rows = rows.withColumn("id", text.iri_to_id(F.col("iri"), {OBO: ""}))
    return terms.filter_subset(rows, HUMAN, ["CL_"]).select("iri", "id").distinct()


@query("filter_obsolete", "SELECT id, name FROM {terms} WHERE NOT contains(name, 'obsolete ')")
def filter_obsolete(t):
    return terms.filter_obsolete(t.derived("terms")).select("id", "name")


# Scalars ---------------------------------------------------------------------------------------


@query(
    "parse_similar_json",
    """SELECT source, target, score FROM (
      SELECT 'PART_' || p_partkey AS source, 'S_' || p_size AS target,
        ('0.' || (p_size + 10))::DOUBLE AS score FROM {part}
      UNION ALL SELECT 'PART_' || p_partkey, 'S_half', 0.5::DOUBLE FROM {part}
      UNION ALL SELECT 'PART_' || p_partkey, 'S_top', ('0.9' || (p_size % 10))::DOUBLE FROM {part})
    WHERE score > 0.5""",
)
def parse_similar_json(t):
    return similarity.parse_similar_json(t.derived("search_replies"))


@query("score_threshold", "SELECT * FROM {scores} WHERE score > 0.3")
def score_threshold(t):
    return similarity.score_threshold(t.scores(), 0.3)


@query("pair_id", "SELECT subject_id, object_id, subject_id || '|' || object_id AS pair_id FROM {mappings}")
def pair_id(t):
    return t.mappings.select(
        "subject_id", "object_id", text.pair_id(F.col("subject_id"), F.col("object_id")).alias("pair_id")
    )


@query(
    "cast_rank",
    "SELECT l_orderkey, l_linenumber, l_quantity / 2 AS half, round_even(l_quantity / 2, 0)::INT AS rank FROM {lineitem}",
)
def cast_rank(t):
    half = F.col("l_quantity") / 2
    return t.base("lineitem").select(
        "l_orderkey", "l_linenumber", half.alias("half"), numeric.cast_rank(half).alias("rank")
    )


@query(
    "id_cleanup",
    "SELECT code_id, replace(code_id, ':', '_') AS underscored, replace(code_id, 'MSH:', '') AS bare FROM {codes}",
)
def id_cleanup(t):
    code = F.col("code_id")
    return t.derived("codes").select(
        "code_id", text.code_to_id(code).alias("underscored"), text.code_to_id(code, "MSH:").alias("bare")
    )


@query(
    "r_round",
    """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2)::DOUBLE AS percent,
    round_even(l_quantity / 16, 3)::DOUBLE AS fine FROM {lineitem}""",
)
def r_round(t):
    q = F.col("l_quantity")
    return t.base("lineitem").select(
        "l_orderkey", "l_linenumber",
        numeric.r_round(q / 8, 2).alias("percent"), numeric.r_round(q / 16, 3).alias("fine"),
    )


@query(
    "zscore",
    """SELECT model, pair_id, round((similarity_score - (SELECT avg(similarity_score) FROM {analyzed}))
    / (SELECT stddev_samp(similarity_score) FROM {analyzed}), 6) AS z FROM {analyzed}""",
)
def zscore(t):
    rows = t.prepared.filter("model_analyzed")
    return numeric.zscore(rows, "similarity_score", "z").select("model", "pair_id", F.round("z", 6).alias("z"))


@query(
    "cosine",
    """SELECT 'V_' || a.vec_id AS source, 'W_' || b.vec_id AS target,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""",
)
def cosine(t):
    rows = t.base("embeddings")
    a = rows.select("vec_id", F.col("embedding").alias("a"))
    b = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        F.concat(F.lit("V_"), "vec_id").alias("source"),
        F.concat(F.lit("W_"), F.col("vec_id") + 1).alias("target"),
        F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("score"),
    )
