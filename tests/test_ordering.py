import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from termloom.functions import ordering, quantiles
from termloom.functions.ordering import fill_down, first_by, lag_in_order, number_rows, row_number_by, running_totals, top_by


def hot_rows():
    """A third of the rows belong to one group, and a third of that group ties."""
    rng = random.Random(1)
    rows = [("hot", 0.5 if i % 3 == 0 else rng.random(), f"o{i:04d}") for i in range(600)]
    return rows + [(f"g{i % 200}", rng.random(), f"o{i:04d}") for i in range(1200)]


@pytest.mark.parametrize("limit", [10, 10**9])
def test_positions_are_the_same_when_hot_groups_are_cut(frame, monkeypatch, limit):
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", limit)
    rows = hot_rows()
    df = frame(rows, "g string, x double, o string").repartition(5)
    flag = F.when(F.col("o").endswith("1"), 1).otherwise(0)
    out = running_totals(df, ["g"], [F.desc("x"), F.asc("o")], {"n": F.lit(1), "ones": flag})
    expected, seen = {}, {}
    for g, x, o in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        n, ones = seen.get(g, (0, 0))
        seen[g] = expected[(g, x, o)] = (n + 1, ones + o.endswith("1"))
    assert {(r.g, r.x, r.o): (r.n, r.ones) for r in out.collect()} == expected


def test_known_bound_skips_the_size_check(frame):
    df = frame([("a", 2.0), ("a", 1.0)], "g string, x double")
    out = row_number_by(df, ["g"], [F.asc("x")], group_rows=10).collect()
    assert {r.x: r["rank"] for r in out} == {1.0: 1, 2.0: 2}


def test_number_rows(spark):
    out = number_rows(spark.range(1000).repartition(7), [F.desc("id")]).collect()
    assert {r.id: r.row for r in out} == {i: 1000 - i for i in range(1000)}


def test_top_and_first(frame):
    df = frame(hot_rows(), "g string, x double, o string")
    best = {r.g: (r.x, r.o) for r in top_by(df, ["g"], [F.desc("x"), F.asc("o")], 1).collect()}
    first = {r.g: (r.x, r.o) for r in first_by(df, ["g"], F.struct(-F.col("x"), "o")).collect()}
    assert best == first and len(best) == 201


def test_lag_over_chunks(frame):
    rng = random.Random(2)
    rows = [(i // 10, i % 10, rng.random()) for i in range(500)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = frame(shuffled, "a int, b int, e double").repartition(6)
    out = {(r.a, r.b): r.previous for r in lag_in_order(df, "e", ["a", "b"]).collect()}
    assert out[(0, 0)] is None
    assert all(out[rows[i][:2]] == rows[i - 1][2] for i in range(1, 500))


@pytest.mark.parametrize("limit", [5, 10**6])
def test_quantiles_are_exact(frame, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "SORT_ROWS", limit)
    rng = random.Random(4)
    groups = {
        "even": [rng.random() for _ in range(100)],
        "copies": [0.25] * 70 + [rng.random() for _ in range(31)],
        "outlier": [1e9] + [rng.random() * 1e-6 for _ in range(60)],
        "one": [3.0],
        "two": [1.0, 2.0],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("one", float("nan"))]
    out = quantiles.quantiles(frame(rows, "g string, x double"), ["g"], "x",
                              {"q1": 0.25, "median": 0.5, "q3": 0.75})
    for r in out.collect():
        xs = groups[r.g]
        assert r["median"] == pytest.approx(st.median(xs), abs=0, rel=1e-12)
        if len(xs) > 1:
            q = st.quantiles(xs, n=4, method="inclusive")
            assert (r.q1, r.q3) == (pytest.approx(q[0], rel=1e-12), pytest.approx(q[2], rel=1e-12))
    assert out.count() == 5
    whole = quantiles.quantiles(frame(rows, "g string, x double"), [], "x", {"m": 0.5}).first().m
    assert whole == pytest.approx(st.median([x for xs in groups.values() for x in xs]), rel=1e-12)


@pytest.mark.parametrize("limit", [5, 10**6])
def test_quantiles_of_extreme_values(frame, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "SORT_ROWS", limit)
    inf = float("inf")
    groups = {
        "infinite": [inf] + [float(i) for i in range(60)],
        "both": [inf, -inf, *range(-20, 21)],
        "wide": [1e308, -1e308] * 20 + [0.0, -0.0, 5e-324],
        "all": [inf] * 20,
        "signs": [-0.5 * i for i in range(30)],
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    out = quantiles.quantiles(frame(rows, "g string, x double"), ["g"], "x", {"m": 0.5, "q": 0.25}).collect()
    for r in out:
        xs = sorted(map(float, groups[r.g]))
        assert r.m == st.median(xs)
        at = (len(xs) - 1) * 0.25
        low, high = xs[int(at)], xs[min(int(at) + 1, len(xs) - 1)]
        w = at - int(at)
        assert r.q == pytest.approx(low if low == high or not w else low * (1 - w) + high * w, rel=1e-12)


@pytest.mark.parametrize("limit", [3, 10**9])
def test_fill_down(frame, monkeypatch, limit):
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", limit)
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, "v%d" % i if rng.random() < 0.2 else None) for i in range(300)]
    out = fill_down(frame(rows, "g string, i int, v string").repartition(4), "v", ["g"], [F.asc("i")])
    last, expected = {}, {}
    for g, i, v in rows:
        last[g] = expected[i] = v or last.get(g)
    assert {r.i: r.v for r in out.collect()} == expected


def test_a_hot_group_without_a_key_is_cut_like_others(frame, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", 20)
    rows = [(None if i % 2 else "a", i) for i in range(100)]
    out = ordering.running_totals(frame(rows, "g string, i int"), ["g"], [F.asc("i")], {"n": F.lit(1)})
    assert sorted((r.i, r.n) for r in out.collect()) == [(i, i // 2 + 1) for i in range(100)]


def test_scratch_tables_have_an_end(spark, frame, tmp_path):
    from termloom import session

    before, session._WRITTEN[:] = list(session._WRITTEN), []
    written = session.materialize(frame([(1,)], "a int"), "short-lived")
    assert written.count() == 1 and session.drop_scratch(spark) == 1 and not session._WRITTEN
    session._WRITTEN[:] = before
