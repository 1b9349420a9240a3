import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import language_id as L
from tests.llm.helpers import corpus, nothing, odd_corpus, sentence


def plain_model(texts, order, alphabet):
    """Interpolated Kneser-Ney by recursion over dictionaries."""
    table = L.letter_table()
    pads = " " * (order - 1)
    streams = []
    for text in texts:
        out = pads
        for c in text:
            point = ord(c)
            low = chr(table[point]) if point < 1 << 16 and table[point] else (c if point >= 1 << 16 else " ")
            if low != " " or out[-1] != " ":
                out += low
        streams.append(out)
    counts = defaultdict(int)
    for s in streams:
        for i in range(order - 1, len(s)):
            counts[s[i - order + 1 : i + 1]] += 1
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in counts:
            left[g[-k:]].add(g[-k - 1 :])
        levels[k] = {g: len(v) for g, v in left.items()}

    def probability(context, c):
        if not context and c is None:
            return 1 / (alphabet + 1)
        k = len(context) + 1
        own = levels[k]
        n = list(own.values())
        once, twice = n.count(1), n.count(2)
        d = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(v for g, v in own.items() if g[:-1] == context)
        lower = probability(context[1:], c) if context else 1 / (alphabet + 1)
        if not total:
            return lower
        kinds = sum(1 for g in own if g[:-1] == context)
        return max(own.get(context + c, 0) - d, 0) / total + d * kinds / total * lower

    return streams, probability


def test_entropies_are_those_of_the_plain_recursion():
    texts = {"a": ["abba abab ba", "a b ab abba"], "b": ["cabc cacb", "bcab abc ÇA"]}
    order = 3
    counts, alphabet = {}, set()
    for lang, own in texts.items():
        batch = pa.record_batch({"lang": [lang] * len(own), "text": own})
        grams = defaultdict(int)
        for out in L._grams(order)([batch]):
            for g, n in zip(out.column("gram").to_pylist(), out.column("n").to_pylist(), strict=True):
                grams[g] += n
                alphabet.add(g[-1])
        rows = np.array([[ord(c) for c in g] for g in grams], np.uint32)
        counts[lang] = rows, np.array(list(grams.values()))
    model = L.estimate(counts, order)
    probe = pa.array(["abba cab", "zz a", None, "b"])
    entropy, sizes = model.entropies(probe, L.letter_table())
    for j, lang in enumerate(model.langs):
        _, probability = plain_model(texts[lang], order, len(alphabet))
        for i, text in enumerate(probe.to_pylist()):
            stream = "  " + (text or "")
            logs = [math.log2(probability(stream[k - 2 : k], stream[k])) for k in range(2, len(stream))]
            assert sizes[i] == len(logs)
            assert entropy[i, j] == pytest.approx(-sum(logs) / max(1, len(logs)), abs=1e-4)


def test_lookup_in_sorted_hashes():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    found = L.SortedHashes(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    assert (found.find(keys + np.uint64(1)) == -1).all()
    assert (L.SortedHashes(keys[:0]).find(keys) == -1).all()


def test_odd_rows(spark):
    odd = odd_corpus(spark)
    model = L.fit(odd.filter(L.fold("doc_id", 4) != 2))
    found = L.identify(odd, model)
    rows = found.select("row.*", "lang_pred", F.col("score").alias("s"), "rejected").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.s <= 1 and r.lang_pred in ("en", "fr", "und")
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert r.lang_pred == "und" and r.rejected and r.s == 0
    kept = L.keep_known_languages(odd)
    assert kept.columns == odd.columns and kept.count() < odd.count()


def test_held_out_texts(spark):
    docs = corpus(spark, n=200).filter("doc_id < 200 AND doc_id % 7 <> 0")
    held = L.fold("doc_id", 4) == 2
    found = L.identify(docs.filter(held), L.fit(docs.filter(~held)))
    assert found.count() > 30
    assert found.filter((F.col("row.lang") != F.col("lang_pred")) | F.col("rejected")).count() == 0


def test_strange_texts_are_rejected(spark):
    docs = corpus(spark, n=150)
    model = L.fit(docs)
    probe = spark.createDataFrame([(1, "Съешь ещё этих мягких французских булок да выпей чаю " * 5)], "doc_id long, text string")
    assert L.identify(probe, model).first().rejected


def test_without_training_rows(spark):
    assert L.fit(nothing(spark)) is None
    found = L.identify(corpus(spark), None)
    assert found.filter("lang_pred <> 'und' OR NOT rejected").count() == 0
    assert L.identify(nothing(spark), L.fit(corpus(spark))).collect() == []


def test_every_language_with_a_text_has_a_model(spark):
    """One short text among many, one very long one, and one without letters."""
    import random

    draw = random.Random(4)
    rows = [(i, sentence(draw, 30), "en") for i in range(200)]
    rows += [(300 + i, sentence(draw, 30, "fr"), "fr") for i in range(1)]
    rows += [(400, "żółć gęś " * 60_000, "pl"), (500, "1234 5678 !", "none"), (501, "99", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for shift in range(4):  # other hashes, other samples
        moved = docs.withColumn("doc_id", F.col("doc_id") + 1000 * shift)
        model = L.fit(moved, sample_bytes=20_000)
        assert sorted(model.langs) == ["en", "fr", "pl"]
    probe = spark.createDataFrame([(1, "gęś żółć gęś żółć gęś"), (2, sentence(draw, 40))], "doc_id long, text string")
    assert {r.row.doc_id: r.lang_pred for r in L.identify(probe, model).collect()} == {1: "pl", 2: "en"}
