import hashlib
import random

import numpy as np
import pytest

from termloom.llm import substring_dedup as S
from termloom.llm.fm_index import FMIndex, WaveletMatrix
from tests.llm.helpers import corpus, nothing, odd_corpus, plain_words, sentence


def brute(texts, window=13):
    words = {i: plain_words(t) for i, t in texts.items()}
    least = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][j : j + window]), i)
    out = []
    for i, own in words.items():
        gone = set()
        for j in range(len(own) - window + 1):
            if least[tuple(own[j : j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def shared(seed):
    draw = random.Random(seed)
    pool = [sentence(draw, draw.randint(8, 60)).split() for _ in range(12)]
    texts = {}
    for i in range(60):
        own = []
        for _ in range(draw.randint(0, 5)):
            part = draw.choice(pool)
            a = draw.randrange(len(part))
            own += part[a : a + draw.randint(5, 60)] + sentence(draw, draw.randint(0, 6)).split()
        texts[i] = " ".join(own)
    texts[60] = "the " * 400
    texts[61] = "a " + "the " * 300 + "b"
    texts[62] = " ".join(pool[0] * 3)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_looking_at_all_windows(spark, seed):
    texts = shared(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == brute(texts)


def test_many_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "_STRETCHES", 20)
    texts = shared(3)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == brute(texts)


def test_hot_anchors_are_spread_and_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "_STRETCHES", 20)
    monkeypatch.setattr(S, "_HOT", 30)
    draw = random.Random(7)
    phrase = sentence(draw, 12)
    texts = {i: f"{sentence(draw, 9)} {phrase} {sentence(draw, 9)}" for i in range(400)}
    texts |= {400 + i: t for i, t in shared(4).items()} | {500: texts[7], 501: texts[8] + " end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    seen, placed = [], S._in_shards

    def in_shards(*given):
        seen.append(placed(*given))
        return seen[-1]

    monkeypatch.setattr(S, "_in_shards", in_shards)
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == brute(texts)
    sizes = [r["count"] for r in seen[0].groupBy("shard").count().collect()]
    assert sum(sizes) > 1000 and max(sizes) < 100


def test_a_phrase_that_two_long_texts_repeat_is_spread_too(spark, monkeypatch):
    monkeypatch.setattr(S, "_STRETCHES", 100)
    monkeypatch.setattr(S, "_HOT", 200)
    draw = random.Random(9)
    phrase = sentence(draw, 12)
    texts = {i: " ".join(f"{phrase} {sentence(draw, 9)}" for _ in range(1500)) for i in (1, 2)}
    texts[3] = " ".join(texts[1].split()[100:160])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    seen, placed = [], S._in_shards

    def in_shards(*given):
        seen.append(placed(*given))
        return seen[-1]

    monkeypatch.setattr(S, "_in_shards", in_shards)
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == brute(texts)
    sizes = [r["count"] for r in seen[0].groupBy("shard").count().collect()]
    assert sum(sizes) > 10_000 and max(sizes) < 600


def test_odd_texts_and_rows(spark):
    docs = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(map(tuple, S.remove_repeats(docs).collect())) == brute(texts)
    odd = odd_corpus(spark)
    found = S.remove_repeats(odd)
    assert found.count() == odd.count()
    assert found.filter("doc_id IS NULL").first().n_removed == 0
    assert found.filter("doc_id = 2").distinct().count() == 1
    assert S.remove_repeats(nothing(spark)).collect() == []


def test_rank_in_a_wavelet_matrix():
    draw = np.random.default_rng(4)
    symbols = draw.integers(0, 37, 500)
    matrix = WaveletMatrix(symbols, 37)
    at = draw.integers(0, 501, 300)
    asked = draw.integers(0, 37, 300)
    low, high = matrix.interval(asked, np.zeros(300, np.int64), at)
    assert (low == 0).all()
    assert high.tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(asked, at, strict=True)]


def test_backward_search_counts_occurrences():
    draw = np.random.default_rng(5)
    runs = [draw.integers(1, 4, n).tolist() for n in (30, 13, 40, 5, 13)]
    text = np.array([x for r in runs for x in [0, *r]] + [0], np.int64)
    depth = 5
    index = FMIndex(text, 4, depth)
    other = [draw.integers(1, 4, 25).tolist(), runs[0]]
    probe = np.array([x for r in other for x in [0, *r]] + [0], np.int64)
    starts, sizes = np.array([1, 27]), np.array([25, 30])
    low, high = index.matches(probe, starts, sizes, depth)
    for s, n in zip(starts, sizes, strict=True):
        for i in range(s, s + n - depth + 1):
            pattern = probe[i : i + depth].tolist()
            places = [p for p in range(len(text) - depth + 1) if text[p : p + depth].tolist() == pattern]
            assert sorted(index.places[low[i] : high[i]].tolist()) == places
