import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import near_duplicates as N
from termloom.llm.components import smallest_reachable
from tests.llm.helpers import corpus, lowered, nothing, odd_corpus, plain_words, sentence


def brute(texts, least=85):
    sets = {}
    for i, text in texts.items():
        own = plain_words(lowered(text))
        sets[i] = {tuple(own[j : j + 5]) for j in range(max(1, len(own) - 4))} if own else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for x, i in enumerate(order):
        for j in order[:x]:
            shared, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * shared >= least * all_:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def near_copies(seed, bases=6, copies=12):
    draw = random.Random(seed)
    out = {}
    for _ in range(bases):
        words = sentence(draw, 150).split()
        for _ in range(copies):
            own = list(words)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = f"new{draw.random()}"
            out[len(out)] = " ".join(own)
            if draw.random() < 0.3:  # chains of copies
                words = own
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == brute(texts)


def test_odd_texts(spark):
    docs = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == brute(texts)


def test_rounds_beyond_the_first_pivot(spark, monkeypatch):
    """Members that the smallest of a bucket does not link, but that link to each other."""
    draw = random.Random(5)
    base = sentence(draw, 300).split()
    far = base[:40] + sentence(draw, 20).split() + base[60:]
    texts = {0: " ".join(base)}
    for i in range(1, 90):
        own = list(far)
        own[70 + 2 * i] = f"edit{i}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == brute(texts)


def test_odd_rows(spark):
    odd = odd_corpus(spark)
    found = N.near_duplicates(odd)
    assert found.count() == odd.count()
    assert found.filter("doc_id IS NULL").first().kept is True
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IS NULL").count() == 1
    assert N.near_duplicates(nothing(spark)).collect() == []


def test_every_coordinate_is_filled_and_estimates_hold():
    draw = np.random.default_rng(3)
    pool = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [pool[:1], pool[:7], pool[:1000], pool[100:1100], pool[:0], pool[:4000]]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = N.sketches(np.concatenate(sets), first, 512)
    full = np.iinfo(np.uint64).max
    assert (found[[0, 1, 2, 3, 5]] != full).all() and (found[4] == full).all()
    assert abs((found[2] == found[3]).mean() - 900 / 1100) < 0.08
    alone = N.sketches(sets[2], np.array([0, 1000]), 512)
    assert (alone[0] == found[2]).all()


def test_sets_of_short_texts():
    values, first = N.shingle_sets(pa.array(["a b", "A  B", "b a", "a b c d e", None, "a b c d e a b c d e"]))
    sizes = np.diff(first).tolist()
    assert sizes == [1, 1, 1, 1, 0, 5]
    assert values[0] == values[1] != values[2]


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    links += [(200, 201), (201, 202), (202, 200), (200, 201)]
    frame = spark.createDataFrame(links, "a long, b long")
    roots = {r.node: r.root for r in smallest_reachable(frame).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[100 + i] for i in range(30)} == {100}
    assert {roots[i] for i in (200, 201, 202)} == {200} and len(roots) == 41 + 30 + 3
    assert smallest_reachable(frame.limit(0)).count() == 0


@pytest.mark.parametrize("common", [2, 5, 1000])
def test_intersections_of_blocks(monkeypatch, common):
    monkeypatch.setattr(N, "_COMMON", common)
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 60, draw.integers(0, 40)).astype(np.uint64)) for _ in range(25)]
    left, right = np.arange(0, 12), np.arange(10, 25)
    found = N.Elements(sets).intersections(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if a != b:
                assert found[i, j] == len(np.intersect1d(sets[a], sets[b]))


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4_000)
    monkeypatch.setattr(N, "_ROWS", 7)
    draw = random.Random(8)
    base = sentence(draw, 200).split()
    texts = {}
    for i in range(90):
        own = list(base)
        for _ in range(draw.choice([1, 2, 3, 4, 5])):
            own[draw.randrange(len(own))] = f"w{draw.randrange(60)}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == brute(texts)


def test_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    ends = spark.createDataFrame([(3,), (70,), (900,)], "doc_id long")
    sets = N._of(docs, ends).mapInArrow(N._sets, N._SET)
    # Each Python step of a task has a worker of its own, and all of them are alive at once.
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r.rep for r in sets.collect()} == {3, 70}


def test_small_sets_fill_a_block_too(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4_000)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = {i: " ".join([*base, f"w{i % 3}", f"v{i}"]) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members = spark.createDataFrame([(1, i, 24, 24, 60, 0.0) for i in texts], "key long, rep long, n long, c long, members long, place double")
    most, forest = spark.sparkContext.accumulator(0), N._forest

    def counted(least):
        run = forest(least)

        def watched(table):
            most.add(int(table.num_rows > 35))
            return run(table)

        return watched

    monkeypatch.setattr(N, "_forest", counted)
    assert N._in_blocks(members, docs, 85).count() >= 0 and most.value == 0
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == brute(texts)
