"""Plug-in points for language and embedding models.

A model client is a function from a batch of texts to a batch of results. It runs inside
``mapInPandas``, so it sees Arrow-sized batches and may open its connection once per worker.
Retries belong into the client; a null result stands for a failure. Texts are passed as values,
never through a shell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import fill_template, normalize_ws
from termloom.session import materialize

TextClient = Callable[[Sequence[str]], Sequence[str | None]]
VectorClient = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]

# Placeholders: $name, $aka and $input (the description to expand).
EXPAND_TEMPLATE = """\
Write one paragraph in exact scientific language that defines the concept '$name' \
(other names: $aka) for expert readers, in plain text of at most 384 words.
Use the concept's names in the paragraph and start with the definition itself.
Known so far:
$input
"""

# Placeholders: $name, $aka, $content (text of the concept) and $input (the passages).
RANK_TEMPLATE = """\
Concept '$name' (other names: $aka):
$content

Order the passages below from the closest to the least close description of this concept.
$input

Answer with the ids in square brackets, best first, one per line and nothing else.
"""


def render_expand_prompt(terms: DataFrame, template: str = EXPAND_TEMPLATE) -> DataFrame:
    """``id, prompt`` with one expansion request per term."""
    prompt = fill_template(
        template,
        {"name": F.col("name"), "aka": F.col("aka"), "input": F.col("description")},
    )
    return terms.select("id", prompt.alias("prompt"))


def call_client(df: DataFrame, column: str, out: str, client: Callable, kind: str) -> DataFrame:
    """Replace ``column`` by the client's results, batch by batch."""
    kept = [c for c in df.columns if c != column]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = batch[kept].copy()
            result[out] = pd.Series(
                list(client(batch[column].tolist())), index=batch.index, dtype=object
            )
            yield result

    return df.mapInPandas(run, ", ".join([*fields, f"`{out}` {kind}"]))


@dataclass(frozen=True)
class ResultStore:
    """A folder of results that later runs go on with: ``key, result`` in Parquet.

    The key is the SHA-256 of the model's name and the whole text that the client sees, so another
    model, template or text asks anew. ``slices`` is the number of appends of one call: each is a
    job of its own, so a run that is lost keeps the slices before.
    """

    path: str
    model: str
    slices: int = 8

    def key(self, text: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}:"), text), 256)

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        """Results so far; of a key stored twice, by two runs at a time, the least one."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        schema = f"key string, result {kind}"
        found = spark.read.schema(schema).parquet(self.path) if there else spark.createDataFrame([], schema)
        return found.groupBy("key").agg(F.min("result").alias("result"))


def call_client_once(
    df: DataFrame, column: str, out: str, client: Callable, kind: str, store: ResultStore
) -> DataFrame:
    """As ``call_client``, but each distinct text is asked once over all runs with ``store``.

    Texts whose results are there are left out before the client is called; equal texts are one
    call. A null text is not asked and has no result. A null result is a failure: it is not stored,
    and the next run asks again.
    """
    spark = df.sparkSession
    keyed = materialize(df.withColumn("_key", store.key(F.col(column))), "keyed")
    texts = keyed.filter(F.col(column).isNotNull()).groupBy("_key").agg(F.first(column).alias("text"))
    known = store.read(spark, kind).select(F.col("key").alias("_key"))
    asked = materialize(texts.join(known, "_key", "left_anti"), "asked")
    for number in range(store.slices):
        own = asked.filter(F.pmod(F.xxhash64("_key"), F.lit(store.slices)) == number)
        if own.isEmpty():
            continue
        answered = call_client(own.select(F.col("_key").alias("key"), "text"), "text", "result", client, kind)
        answered.filter("result IS NOT NULL").write.mode("append").parquet(store.path)
    results = store.read(spark, kind).select(F.col("key").alias("_of"), F.col("result").alias(out))
    kept = [c for c in df.columns if c != column]
    return keyed.join(results, F.col("_key") == F.col("_of"), "left").select(*kept, out)


def expand_content(
    terms: DataFrame, client: TextClient, template: str = EXPAND_TEMPLATE, store: ResultStore | None = None
) -> DataFrame:
    """``id, content`` written by a text model, white space normalised.

    With a ``store`` only descriptions that were not expanded before are sent.
    """
    prompts = render_expand_prompt(terms, template)
    if store is None:
        written = call_client(prompts, "prompt", "content", client, "string")
    else:
        written = call_client_once(prompts, "prompt", "content", client, "string", store)
    return written.withColumn("content", normalize_ws(F.col("content")))


def embed_content(
    content: DataFrame, embedder: VectorClient | None = None, dim: int = 256, store: ResultStore | None = None
) -> DataFrame:
    """``id, embedding`` of each content row; with a ``store`` only new texts go to the client.

    Without a client the texts become normalised vectors of hashed word counts, which stay in
    the JVM and need no fitted state, so source and target share one vector space.
    """
    if embedder is not None:
        own = content.select("id", "content")
        if store is not None:
            return call_client_once(own, "content", "embedding", embedder, "array<float>", store)
        return call_client(own, "content", "embedding", embedder, "array<float>")
    return hashed_embeddings(content, dim)


def hashed_embeddings(content: DataFrame, dim: int = 256) -> DataFrame:
    words = RegexTokenizer(
        inputCol="content", outputCol="words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1
    )
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=dim)
    unit = Normalizer(inputCol="counts", outputCol="unit")
    filled = content.select("id", F.coalesce("content", F.lit("")).alias("content"))
    vectors = unit.transform(counts.transform(words.transform(filled)))
    return vectors.select("id", vector_to_array("unit", "float32").alias("embedding"))


def rank_prompt(
    name: Column, aka: Column, content: Column, passages: Column, template: str = RANK_TEMPLATE
) -> Column:
    return fill_template(
        template, {"name": name, "aka": aka, "content": content, "input": passages}
    )
