"""Fixed schemas of the data model; nothing is inferred."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


TERMS = T.StructType(_strings("iri", "id", "name", "aka", "description"))
DESCRIPTORS = T.StructType(_strings("descriptor", "descriptor_id") + TERMS.fields)
CONTENT = T.StructType(_strings("id", "content"))
SEEDS = T.StructType(_strings("iri"))
TRIPLES = T.StructType(_strings("s", "p", "o", "g"))
EMBEDDINGS = T.StructType(
    _strings("id") + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
SCORES = T.StructType(_strings("source", "target") + [T.StructField("score", T.DoubleType())])
RANKED = T.StructType(
    _strings("source", "target")
    + [T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())]
)

_SUBJECT = _strings("subject_id", "subject_label", "predicate_id", "object_id", "object_label")
_TAIL = _strings("comment", "mapping_justification")
MAPPINGS = T.StructType(
    _SUBJECT + [T.StructField("similarity_score", T.DoubleType())] + _TAIL
)
RANKED_MAPPINGS = T.StructType(_SUBJECT + [T.StructField("score", T.IntegerType())] + _TAIL)
LOGICAL_MAPPINGS = T.StructType(_SUBJECT + _TAIL)
CROSSWALK = T.StructType(_strings("left_id", "right_id", "left_labels", "right_labels"))

TRUTH = T.StructType(
    _strings("pair_id", "subject_id", "subject_label", "mesh_concept_group")
    + [T.StructField("mapping_count", T.IntegerType())]
    + _strings("mappability", "exclusion_reason")
    + [T.StructField("accurate_mapping", T.IntegerType())]
)

_INTEGERS = ("accurate_mapping", "concept_pair_rank", "mapping_count", "mapping_result_number")
_PREPARED_TYPES = {
    **dict.fromkeys(_INTEGERS, T.LongType()),
    "similarity_score": T.DoubleType(),
    "model_analyzed": T.BooleanType(),
}
PREPARED_COLUMNS = [
    "model",
    "mapping_justification",
    "subject_id",
    "predicate_id",
    "object_id",
    "pair_id",
    "subject_label",
    "object_label",
    "mesh_concept_group",
    "similarity_score",
    "accurate_mapping",
    "concept_pair_rank",
    "mapping_count",
    "mapping_result_number",
    "hit_miss_concept",
    "hit_miss_mapping",
    "model_analyzed",
]

PREPARED = T.StructType(
    [T.StructField(c, _PREPARED_TYPES.get(c, T.StringType())) for c in PREPARED_COLUMNS]
)
