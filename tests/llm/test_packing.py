from collections import Counter

import pytest
from pyspark.sql import functions as F

from termloom.llm import packing as P
from tests.llm.helpers import corpus, nothing, odd_corpus, plain_words


def naive(lengths, clusters, sources, capacity, per_source):
    """Best fit by looking at all bins."""
    bins, out = [], []
    for size, cluster, source in zip(lengths, clusters, sources, strict=True):
        best = None
        for i, b in enumerate(bins):
            bad = (cluster and cluster in b["c"]) or (source and b["s"][source] >= per_source)
            if b["room"] >= size and not bad and (best is None or b["room"] < bins[best]["room"]):
                best = i
        if best is None:
            best = len(bins)
            bins.append({"room": capacity, "c": set(), "s": Counter()})
        b = bins[best]
        b["room"] -= size
        b["c"].add(cluster)
        b["s"][source] += 1
        out.append(best)
    return out


@pytest.mark.parametrize("ordered", [False, True])
@pytest.mark.parametrize("seed", range(5))
def test_places_are_those_of_naive_best_fit(seed, ordered):
    import random

    draw = random.Random(seed)
    n = 300
    lengths = sorted((draw.randint(1, 60) for _ in range(n)), reverse=True)
    clusters = [1 << draw.randrange(8) if draw.random() < 0.3 else 0 for _ in range(n)]
    sources = [1 << min(draw.randrange(6), draw.randrange(6)) if draw.random() < 0.9 else 0 for _ in range(n)]
    bins = P.Bins(100, 2, *((set(clusters) - {0}, set(sources) - {0}) if ordered else ()))
    got = [bins.place(*x)[0] for x in zip(lengths, clusters, sources, strict=True)]
    assert got == naive(lengths, clusters, sources, 100, 2)


@pytest.mark.parametrize("part_documents", [10, 1000])
def test_plans_hold_everything_and_no_conflict(spark, part_documents):
    docs = corpus(spark)
    found = P.pack(docs, capacity=200, per_source=2, part_documents=part_documents).collect()
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    length, filled, sources, clusters = Counter(), Counter(), Counter(), Counter()
    places = {}
    for r in found:
        length[r.doc_id] += r.length
        filled[r.bin] += r.length
        sources[r.bin, text[r.doc_id][1]] += 1
        words = tuple(w.lower() for w in plain_words(text[r.doc_id][0]))
        clusters[r.bin, words] += 1
        places.setdefault(r.bin, []).append((r.position, r.offset, r.length))
    assert length == {i: len(plain_words(t)) + 1 for i, (t, _) in text.items()}
    assert max(filled.values()) <= 200
    assert all(filled[r.bin] + r.residual == 200 for r in found)
    assert all(n <= 2 for (_, s), n in sources.items() if s is not None)
    assert all(n == 1 for (_, words), n in clusters.items() if words)
    for own in places.values():
        at = 0
        for i, (position, offset, size) in enumerate(sorted(own)):
            assert (position, offset) == (i, at)
            at += size


def test_odd_rows_no_rows_and_repeatability(spark):
    odd = odd_corpus(spark)
    found = P.pack(odd)
    assert found.select("doc_id", "piece").count() >= odd.count()
    assert found.filter("doc_id IS NULL").count() == 1
    assert P.pack(nothing(spark)).collect() == []
    again = P.pack(odd.repartition(7))
    assert found.exceptAll(again).count() == 0
    assert found.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= P.CAPACITY


def test_copies_of_one_row_are_spread_and_packed_apart(spark):
    docs = spark.range(50_000).select(
        F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same text").alias("text"), F.lit("s").alias("source")
    ).union(spark.createDataFrame([(None, "", None)] * 3_000, "doc_id long, text string, source string"))
    found = P.pack(docs)
    assert found.count() == 53_000
    parts = found.groupBy(F.split("bin", "-")[0]).count().agg(F.max("count"), F.count("*")).first()
    assert parts[1] == 11 and parts[0] < 6_000
    assert found.filter("doc_id = 7").groupBy("bin").count().agg(F.max("count")).first()[0] == 1
    assert found.filter("doc_id IS NULL").count() == 3_000


def test_a_given_cluster_keeps_near_copies_apart(spark):
    rows = [(i, f"nearly the same words {i}", None, i // 4 if i % 9 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, component long")
    found = P.pack(docs, cluster="component").join(docs.select("doc_id", "component"), "doc_id")
    assert found.filter("component IS NOT NULL").groupBy("bin", "component").count().agg(F.max("count")).first()[0] == 1
    assert P.pack(docs).select("bin").distinct().count() < found.select("bin").distinct().count()
