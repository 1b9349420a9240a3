import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

from termloom.functions.vectors import cosine, decode_embeddings, encode_embeddings
from termloom.operators import similarity
from termloom.operators.similarity import _best, parse_similar_json, topk_similar

VECTORS = "id string, embedding array<float>"


def brute(sources, targets, k, minimum=None, digits=9):
    out = {}
    for s, a in sources:
        scored = []
        for t, b in targets:
            if a is None or b is None:
                continue
            a_, b_ = np.array(a, float), np.array(b, float)
            norm = np.linalg.norm(a_) * np.linalg.norm(b_)
            if not norm or math.isnan(norm):
                continue
            score = round(float(a_ @ b_ / norm), digits)
            if minimum is None or score > minimum:
                scored.append((-score, t))
        for score, t in sorted(scored)[:k]:
            out[(s, t)] = -score
    return out


def got(df):
    return {(r.source, r.target): r.score for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[key] - b[key]) < 1e-8 for key in a)


@pytest.fixture(scope="module")
def sides(frame):
    random = np.random.default_rng(5)
    sources = [(f"s{i}", [float(x) for x in random.normal(size=6)]) for i in range(40)]
    targets = [(f"t{i}", [float(x) for x in random.normal(size=6)]) for i in range(90)]
    targets += [(f"copy{i}", targets[3][1]) for i in range(30)]  # a third are copies
    targets += [("zero", [0.0] * 6), ("nan", [float("nan")] * 6), ("none", None)]
    sources += [("zero", [0.0] * 6), ("same", targets[3][1])]
    f32 = lambda rows: [(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in rows]
    sources, targets = f32(sources), f32(targets)
    return sources, targets, frame(sources, VECTORS), frame(targets, VECTORS)


@pytest.mark.parametrize("lanes", [None, (1, 1), (3, 1), (1, 4), (5, 7)])
@pytest.mark.parametrize("k", [1, 10, 500])
def test_any_cutting_gives_the_brute_force_result(sides, lanes, k):
    sources, targets, s, t = sides
    close(got(topk_similar(s, t, k, lanes=lanes)), brute(sources, targets, k))


def test_threshold_is_strict_and_drops_sources(sides, frame):
    sources, targets, s, t = sides
    close(got(topk_similar(s, t, 10, 0.8)), brute(sources, targets, 10, 0.8))
    one = frame([("a", [1.0, 0.0])], VECTORS)
    half = frame([("b", [1.0, float(np.float32(math.sqrt(3)))]), ("c", [1.0, 0.0])], VECTORS)
    assert got(topk_similar(one, half, 10, 0.5, digits=6)).keys() == {("a", "c")}


def test_empty_sides(sides, frame):
    _, _, s, t = sides
    empty = frame([], VECTORS)
    assert topk_similar(empty, t).count() == 0
    assert topk_similar(s, empty).count() == 0
    nothing = frame([("a", None)], VECTORS)
    assert topk_similar(nothing, nothing).count() == 0
    assert topk_similar(s, nothing).count() == 0


def test_different_lengths_are_an_error(frame):
    a, b = frame([("a", [1.0, 2.0])], VECTORS), frame([("b", [1.0]), ("c", [1.0, 2.0])], VECTORS)
    with pytest.raises(Exception, match="different lengths"):
        topk_similar(a, b).collect()


@pytest.mark.parametrize("lanes", [(1, 1), (3, 4)])
def test_a_table_against_itself(sides, lanes):
    sources, _, s, _ = sides
    close(got(topk_similar(s, s, 3, lanes=lanes)), brute(sources, sources, 3))


def test_bad_k(sides):
    with pytest.raises(ValueError):
        topk_similar(sides[2], sides[3], 0)


def test_lane_plan_follows_the_work(spark, monkeypatch):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), F.array_repeat(F.lit(1.0), 8).alias("embedding")
    )
    assert similarity.plan_lanes(df, df) == (1, 1)
    monkeypatch.setattr(similarity, "LANE_BYTES", 100 * 8 * 8)
    assert similarity.plan_lanes(df, df) == (10, 10)
    monkeypatch.setattr(similarity, "LANE_BYTES", 1 << 30)
    monkeypatch.setattr(similarity, "CELL_FLOPS", 1e6)
    assert similarity.plan_lanes(df, df)[0] > 1


def test_a_grid_is_cut_on_both_sides(spark, monkeypatch):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("id"), F.array_repeat(F.lit(1.0), 8).alias("embedding")
    )
    monkeypatch.setattr(similarity, "CELL_FLOPS", 1e3)
    cells = 4 * spark.sparkContext.defaultParallelism
    s, t = similarity.plan_lanes(df, df)
    # A row is copied once per lane of the other side, so one row of each side is s + t rows.
    assert s * t >= cells and s + t < cells


def test_groups_that_would_copy_more_than_the_grid_are_given_up(frame, monkeypatch):
    random = np.random.default_rng(4)
    rows = lambda name, n: [(f"{name}{i}", [float(np.float32(x)) for x in random.normal(size=8)]) for i in range(n)]
    sources, targets = rows("s", 60), rows("t", 90)
    s, t = frame(sources, VECTORS), frame(targets, VECTORS)
    monkeypatch.setattr(similarity, "LANE_BYTES", 40 * 8 * 8)
    monkeypatch.setattr(similarity, "PRUNE_GAIN", 0)
    seen, compare = [], similarity._compare_cells
    monkeypatch.setattr(similarity, "_compare_cells", lambda *a: seen.append(1) or compare(*a))
    close(got(topk_similar(s, t, 3)), brute(sources, targets, 3))
    assert len(seen) == 1  # only what gives the floors
    monkeypatch.setattr(similarity, "CELL_ROWS", 0)
    near = similarity._copied
    monkeypatch.setattr(similarity, "_copied", lambda *a: near(*a) * 0)
    close(got(topk_similar(s, t, 3)), brute(sources, targets, 3))
    assert len(seen) == 3


def test_a_probe_gives_groups_up_before_anything_is_grouped(frame, monkeypatch):
    random = np.random.default_rng(6)
    rows = lambda name, vs: [(f"{name}{i}", [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)]
    grouped, pruned = [], similarity._pruned
    monkeypatch.setattr(similarity, "_pruned", lambda *a, **b: grouped.append(1) or pruned(*a, **b))
    monkeypatch.setattr(similarity, "LANE_BYTES", 100 * 8 * 16)
    monkeypatch.setattr(similarity, "PRUNE_GAIN", 0)
    monkeypatch.setattr(similarity, "PROBE_ROWS", 400)
    sources, targets = rows("s", random.normal(size=(300, 16))), rows("t", random.normal(size=(900, 16)))
    close(got(topk_similar(frame(sources, VECTORS), frame(targets, VECTORS), 3)), brute(sources, targets, 3))
    assert not grouped
    centres = random.normal(size=(12, 16)) * 10
    near = lambda n: centres[np.arange(n) % 12] + random.normal(size=(n, 16)) * 0.01
    sources, targets = rows("s", near(300)), rows("t", near(900))
    monkeypatch.setattr(similarity, "CELL_ROWS", 0)
    close(got(topk_similar(frame(sources, VECTORS), frame(targets, VECTORS), 3, digits=4)),
          brute(sources, targets, 3, digits=4))
    assert grouped


def test_a_cell_has_a_task_of_its_own(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0)).alias("embedding"))
    here = lambda rows: pa.table({"cell": rows[2][:1], "task": [TaskContext.get().partitionId()]})
    for side, own, other in (("s", 5, 7), ("t", 7, 5)):
        found = similarity._lanes(df, side, own, other, 35).applyInArrow(here, "cell int, task long").collect()
        assert len(found) == len({row["task"] for row in found}) == 35


@pytest.mark.parametrize("share", [0, 0.001, 0.05, 0.5, 1])
@pytest.mark.parametrize("size", [0, 5, 64, 4099])
def test_marks_are_found(size, share):
    marks = np.random.default_rng(size).random(size + 3)[:size] < share
    assert (similarity._marked(marks) == np.flatnonzero(marks)).all()


@pytest.mark.parametrize("lanes", [(1, 1), (1, 3), (2, 1), (4, 5)])
def test_rows_of_one_id_are_one_thing(frame, lanes):
    random = np.random.default_rng(8)
    row = lambda name: (name, [float(np.float32(x)) for x in random.normal(size=4)])
    sources = [row(f"s{i % 5}") for i in range(12)]
    targets = [row(f"t{i % 9}") for i in range(30)]
    best = {}
    for s, a in sources:
        for t, b in targets:
            score = round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
            best[s, t] = max(best.get((s, t), -2), score)
    expect = {}
    for s in {s for s, _ in best}:
        own = sorted((-v, t) for (x, t), v in best.items() if x == s)[:5]
        expect |= {(s, t): -v for v, t in own}
    found = topk_similar(frame(sources, VECTORS), frame(targets, VECTORS), 5, lanes=lanes)
    assert found.count() == 25
    close(got(found), expect)


@pytest.mark.parametrize("minimum", [None, 0.9])
def test_groups_that_cannot_matter_are_skipped(frame, minimum):
    random = np.random.default_rng(9)
    centres = random.normal(size=(6, 5)) * 10
    rows = lambda name, n: [
        (f"{name}{i}", [float(np.float32(x)) for x in centres[i % 6] + random.normal(size=5) * 0.3]) for i in range(n)
    ]
    sources, targets = rows("s", 60), rows("t", 240)
    s, t = frame(sources, VECTORS), frame(targets, VECTORS)
    found, cells = similarity._pruned(s, t, 5, minimum, 9, fan=3)
    close(got(found), brute(sources, targets, 5, minimum))
    leaves = cells.select("s_leaf").distinct().count(), cells.select("t_leaf").distinct().count()
    assert 0 < cells.count() < leaves[0] * leaves[1]
    close(got(topk_similar(s, t, 5, minimum, lanes=(3, 8), prune=False)), brute(sources, targets, 5, minimum))


def test_thousands_of_lanes_leave_the_driver_with_pivots_only(frame, monkeypatch):
    random = np.random.default_rng(3)
    at = lambda n: random.normal(size=(n, 3))
    rows = lambda name, vs: [(f"{name}{i}", [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)]
    sources, targets = rows("s", at(25)), rows("t", at(20_000))
    monkeypatch.setattr(similarity, "LANE_BYTES", 4 * 8 * 3)  # four vectors
    held = []
    tree = similarity._pivot_tree
    monkeypatch.setattr(similarity, "_pivot_tree", lambda *a: held.append(tree(*a)) or held[-1])
    s, t = frame(sources, VECTORS), frame(targets, VECTORS)
    assert similarity.plan_lanes(s, t) == (7, 5000)
    found, cells = similarity._pruned(s, t, 3, None, 9, fan=8)
    close(got(found), brute(sources, targets, 3))
    assert sum(a.nbytes for a in (held[0].tops, held[0].leaves, held[0].first)) < (64 + 8) * 3 * 8 + 100
    assert cells.agg(F.sum("t_parts")).first()[0] < 25 * 5000


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(
    st.integers(1, 6), st.integers(1, 40), st.integers(1, 8),
    st.integers(0, 10_000), st.sampled_from([None, 0.0, 0.5]),
)
def test_kernel_keeps_the_best_with_ties(rows, columns, k, seed, minimum):
    random = np.random.default_rng(seed)
    block = random.integers(-2, 3, (rows, 2)).astype(float)
    targets = random.integers(-2, 3, (columns, 2)).astype(float)
    old = similarity.BLOCK_TARGETS
    similarity.BLOCK_TARGETS = 7
    try:
        r, c, s = _best(block, targets, targets.astype(np.float32), k, minimum, 6)
    finally:
        similarity.BLOCK_TARGETS = old
    product = np.round(block @ targets.T, 6)
    for i in range(rows):
        order = sorted((-product[i, j], j) for j in range(columns) if minimum is None or product[i, j] > minimum)
        assert [(-s[n], c[n]) for n in range(len(r)) if r[n] == i] == [(a, b) for a, b in order[:k]]


def test_cosine_expression(frame):
    df = frame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0])],
               "a array<double>, b array<double>")
    values = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(values[0] - math.sqrt(0.5)) < 1e-12 and values[1:] == [None, None]


def test_blob_round_trip(frame):
    df = frame([("a", [1.5, -2.25]), ("b", None)], VECTORS)
    assert decode_embeddings(encode_embeddings(df)).collect() == df.collect()


def test_search_replies(frame):
    reply = '{"id": "a", "score": 0.7}\nError: x\n{"id": "b", \n{"id": "c", "score": 0.5}\n{"id": "d", "score": 0.51}'
    rows = parse_similar_json(frame([("s", reply), ("t", "")], "source string, reply string")).collect()
    assert [(r.target, r.score) for r in rows] == [("a", 0.7), ("d", 0.51)]


def test_workers_need_no_package(tmp_path):
    """Functions travel by value, so a driver may run anywhere."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from termloom.session import build_session\n"
        "from termloom.operators.similarity import topk_similar\n"
        "spark = build_session('elsewhere', 2)\n"
        f"df = spark.createDataFrame([('a', [1.0, 0.0]), ('b', [1.0, 1.0])], {VECTORS!r})\n"
        "print('rows', topk_similar(df, df, 1).count())\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True,
        text=True, timeout=120,
    )
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def _peak(job):
    tracemalloc.start()
    try:
        return job(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_kernel_holds_one_product(monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_TARGETS", 2000)
    draw = np.random.default_rng(3)
    targets = draw.normal(size=(9000, 16))
    targets /= np.linalg.norm(targets, axis=1)[:, None]
    block, narrow = targets[:300].copy(), targets.astype(np.float32)
    (rows, cols, scores), peak = _peak(lambda: _best(block, targets, narrow, 5, None, 9))
    assert peak < 1.8 * 300 * 2000 * 5  # four bytes of a product and one of a mark
    exact = np.round(block @ targets.T, 9)
    assert (rows == np.repeat(np.arange(300), 5)).all()
    assert np.allclose(scores.reshape(300, 5), -np.sort(-exact, axis=1)[:, :5])


@pytest.mark.parametrize("minimum", [None, 0.3])
def test_kernel_scores_few_pairs_twice(monkeypatch, minimum):
    """Double precision is for pairs that single precision leaves among the best of all targets."""
    draw = np.random.default_rng(5)
    targets = draw.normal(size=(20_000, 32))
    targets /= np.linalg.norm(targets, axis=1)[:, None]
    block, narrow, plain, pairs = targets[:600].copy(), targets.astype(np.float32), similarity._scores, []
    monkeypatch.setattr(similarity, "_scores", lambda b, t, r, c: pairs.append(len(r)) or plain(b, t, r, c))
    rows, cols, _ = _best(block, targets, narrow, 10, minimum, 9)
    exact = np.round(block @ targets.T, 9)
    assert (cols.reshape(600, 10) == np.argsort(-exact, axis=1, kind="stable")[:, :10]).all()
    assert (rows == np.repeat(np.arange(600), 10)).all()
    assert sum(pairs) < 1.2 * 600 * 10


@pytest.mark.parametrize("copies", [60, 4000])
def test_kernel_holds_no_more_ties_than_places(monkeypatch, copies):
    """Equal targets cannot be thinned out by their products, but only so many are held."""
    monkeypatch.setattr(similarity, "BLOCK_TARGETS", 500)
    draw = np.random.default_rng(6)
    targets = np.repeat(draw.normal(size=(24_000 // copies, 16)), copies, axis=0)
    targets = targets[draw.permutation(len(targets))]
    targets /= np.linalg.norm(targets, axis=1)[:, None]
    block, narrow = targets[:200].copy(), targets.astype(np.float32)
    (rows, cols, _), peak = _peak(lambda: _best(block, targets, narrow, 5, None, 9))
    exact = np.round(block @ targets.T, 9)
    assert (cols.reshape(200, 5) == np.argsort(-exact, axis=1, kind="stable")[:, :5]).all()
    assert (rows == np.repeat(np.arange(200), 5)).all()
    assert peak < 12 * 200 * 500 * 4


def test_unit_rows_hold_one_copy():
    flat = np.random.default_rng(4).normal(size=4000 * 32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(4001, dtype=np.int32) * 32), pa.array(flat))
    ids = pa.array([f"{i:05}" for i in range(4000)])
    (own, vectors), peak = _peak(lambda: similarity._unit_rows(ids, lists))
    assert peak < 1.7 * flat.nbytes
    assert own.equals(ids) and np.allclose((vectors * vectors).sum(axis=1), 1)
