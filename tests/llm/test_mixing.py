import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from termloom.llm import mixing as M
from tests.llm.helpers import corpus, nothing, odd_corpus, plain_words

SCHEMA = "doc_id long, text string, source string"


def naive_targets(sizes, weights=(1, 2, 3), largest=3):
    """Share, stop what is above, share the rest, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    left = float(sum(sizes.values()))
    while free:
        all_weight = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / all_weight > largest * sizes[s] + 1e-9]
        if not above:
            return target | {s: left * weight[s] / all_weight for s in free}
        for s in above:
            target[s] = float(largest * sizes[s])
            free.remove(s)
        left -= sum(target[s] for s in above)
    return target


def documents(seed=3, n=2000, sources=9):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        s = 0 if i % 3 == 0 else draw.randrange(sources)
        out.append((i, "w " * draw.choice([0, 1, 5, 20, 100, 400]), None if s == 5 else f"s{s}"))
    return out


def held(rows, found):
    """What every mix has to hold."""
    want = Counter((i, len(plain_words(t))) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size) for r in found) == want
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain_words(t))
    targets = naive_targets(sizes)
    by_source = {i: s for i, _, s in rows}
    taken, largest = Counter(), defaultdict(int)
    for r in found:
        s = by_source[r.doc_id]
        ratio = targets[s] / sizes[s] if sizes[s] else 0
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        if r.size:
            assert r.taken % r.size == 0 and ratio - 1 - 1e-6 < r.taken // r.size < ratio + 1 + 1e-6
            assert r.taken <= 3 * r.size
        else:
            assert r.taken == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-3, s


def test_sources_reach_their_targets(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = M.mix(docs).collect()
    held(rows, found)
    again = M.mix(docs.repartition(5, "text")).collect()
    assert sorted(found) == sorted(again)
    assert sorted(M.mix(docs, seed=99).collect()) != sorted(found)


def test_a_document_is_taken_as_often_as_its_share_says(spark):
    """Over many sources of one make-up the mean number of copies is target / size."""
    sizes, sources = [1, 3, 3, 10, 10, 30, 30, 100], 240
    rows = [(s * 10 + i, "w " * n, f"s{s:03d}") for s in range(sources) for i, n in enumerate(sizes)]
    total, ratio = Counter(), {}
    for r in M.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        s, i = divmod(r.doc_id, 10)
        total[s % 3, i] += r.taken / r.size
        ratio[s % 3] = r.target / r.source_size
    # The largest is often the last residual, which goes to the nearer side.
    spread = {k: n / (sources / 3) - ratio[k[0]] for k, n in total.items() if k[1] < len(sizes) - 1}
    assert len(spread) == 21 and max(map(abs, spread.values())) < 0.25  # 0.056 is the deviation of one
    assert abs(sum(spread.values()) / len(spread)) < 0.08


def test_copies_of_one_row_are_spread_and_whole(spark):
    """A third of all rows is one row; copies differ by one at most."""
    rows = [(7, "same words here", "s0")] * 5000 + documents(4, 1000)[8:]
    found = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    own = [r for r in found if r.doc_id == 7]
    assert len(own) == 5000 and len({r.taken for r in own}) <= 2
    rest = [r for r in rows if r[0] != 7]
    assert len(found) == 5000 + len(rest)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain_words(t))
    taken = sum(r.taken for r in found if r.source_size == sizes["s0"])
    assert abs(taken - naive_targets(sizes)["s0"]) <= 200.001


def test_targets_are_those_of_resharing(spark):
    draw = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = {None if i == 3 else f"s{i:02d}": draw.choice([0, 1, 10, 1000, 100_000]) for i in range(n)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.source_targets(frame).collect()}
        assert got == pytest.approx(naive_targets(sizes))
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_the_plan_is_native(spark):
    frame = M.mix(corpus(spark))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows_and_none(spark):
    odd = odd_corpus(spark)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    found = M.mix(odd).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, len(plain_words(t))) for i, t, _ in rows)
    assert M.mix(nothing(spark)).collect() == []
    empty = spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)
    assert [(r.size, r.target, r.taken) for r in M.mix(empty).collect()] == [(0, 0.0, 0)] * 2
    assert M.mix(odd).agg(F.sum("taken")).first()[0] > 0
