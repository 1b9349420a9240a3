"""Registry, input tables, and the CTE builder shared by both sides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import inputs
from termloom.functions.ordering import number_rows, top_by
from termloom.operators.evaluation import prepare
from termloom.operators.mappings import append_sets, sssom_scored
from termloom.operators.similarity import topk_similar
from termloom.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BASE = set(
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations".split()
)
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _needed(sql: str, definitions: dict[str, str]) -> list[str]:
    """CTE names the statement depends on, in order of definition."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{([a-z]\w*)\}", text):
            if name not in _BASE and name not in found:
                visit(definitions[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def _filled(text: str, place: Callable[[str], str]) -> str:
    """Put table names in place; doubled braces are literal ones."""
    named = re.sub(r"(?<!\{)\{([a-z]\w*)\}", lambda m: place(m.group(1)), text)
    return named.replace("{{", "{").replace("}}", "}")


def oracle(sql: str) -> str:
    """DuckDB statement with all CTEs it needs."""
    definitions = {**inputs.SHARED, **inputs.CHECK_ONLY}
    names = _needed(sql, definitions)
    parts = []
    for name in names:
        kind = "MATERIALIZED " if name in inputs.KEEP else ""
        parts.append(f"{name} AS {kind}({definitions[name].strip()})")
    main = sql.strip()
    if main.startswith("WITH "):  # its own CTEs come last
        main, separator = main[5:], ","
    else:
        separator = ""
    body, main = (_filled(text, str) for text in (",\n".join(parts), main))
    return f"WITH RECURSIVE {body}{separator}\n{main}" if parts else main


class Tables:
    """The given tables and what is derived from them, for one session and folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        """A shared definition, as one Spark SQL statement over the Parquet files."""
        return self.sql(inputs.SHARED[name])

    def sql(self, text: str) -> DataFrame:
        written = [n for n in ("mappings",) if f"{{{n}}}" in self._closure(text)]
        paths = {n: self._path(n) for n in written}
        names = [n for n in _needed(text, {**inputs.SHARED, **dict.fromkeys(paths, "")})
                 if n not in paths]

        def place(name: str) -> str:
            if name in _BASE:
                return f"parquet.`{self.folder}/{name}.parquet`"
            return f"parquet.`{paths[name]}`" if name in paths else name

        parts = [f"{n} AS ({inputs.SHARED[n].strip()})" for n in names]
        head = f"WITH {', '.join(parts)}\n" if parts else ""
        return self.spark.sql(_filled(head + text, place))

    def _closure(self, text: str) -> str:
        definitions = {**inputs.SHARED, "mappings": ""}
        return text + " ".join(definitions[n] for n in _needed(text, definitions))

    def _path(self, name: str) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            path = scratch_path(self.spark, name)
            getattr(self, f"_build_{name}")().write.parquet(path)
            _WRITTEN[key] = path
        return _WRITTEN[key]

    # Vectors and mapping sets ---------------------------------------------------------------

    def vectors(self, side: str, low: int = 1, high: int = 64) -> DataFrame:
        part = F.slice("embedding", low, high - low + 1).alias("embedding")
        return self.derived(f"{side}_vectors").select("id", part)

    def scores(self) -> DataFrame:
        return topk_similar(self.vectors("left"), self.vectors("right"))

    def _build_mappings(self) -> DataFrame:
        """One mapping set per slice of the vectors; a vector is no match for itself."""
        left, right = self.derived("left_terms"), self.derived("right_terms")
        sets = {}
        for model, low, high, minimum in inputs.MODELS:
            found = topk_similar(
                self.vectors("left", low, high), self.vectors("right", low, high), 11, minimum
            ).filter(F.substring("source", 3, 20) != F.substring("target", 3, 20))
            best = top_by(found, ["source"], [F.desc("score"), F.asc("target")], 10)
            sets[model] = sssom_scored(left, right, best)
        return append_sets(sets)

    @property
    def mappings(self) -> DataFrame:
        return self.spark.read.parquet(self._path("mappings"))

    def _build_truth(self) -> DataFrame:
        return self.derived("truth")

    @property
    def truth(self) -> DataFrame:
        return self.spark.read.parquet(self._path("truth"))

    def _build_prepared(self) -> DataFrame:
        return prepare(self.mappings, self.truth, group_rows=10)

    @property
    def prepared(self) -> DataFrame:
        return self.spark.read.parquet(self._path("prepared"))

    # Triples --------------------------------------------------------------------------------

    @property
    def triples(self) -> DataFrame:
        """Written partitioned by predicate, as a triple table should be."""
        key = (self.spark.sparkContext.applicationId, self.folder, "triples")
        if key not in _WRITTEN:
            path = scratch_path(self.spark, "triples")
            bucket = F.pmod(F.xxhash64("s"), F.lit(8))  # a frequent predicate is several tasks
            self.derived("triples").repartition("p", bucket).write.partitionBy("p").parquet(path)
            _WRITTEN[key] = path
        return (
            self.spark.read.schema("s string, o string, g string, p string")
            .parquet(_WRITTEN[key])
            .select("s", "p", "o", "g")
        )

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name)


def placed(df: DataFrame) -> DataFrame:
    """Add the ``position`` of each row of a sorted frame, from 1."""
    rows = df.withColumn("_place", F.monotonically_increasing_id())
    return number_rows(rows, [F.col("_place")], "position").drop("_place")


def query(name: str, sql: str | None = None):
    """Register a job under ``name``; without SQL only its rows are checked."""

    def register(job: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: job(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return job

    return register
