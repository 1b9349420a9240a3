import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import vector_codes as V
from tests.llm.helpers import CLASHES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds):
    """Codes and errors by the definition, one part after the other."""
    whole = [[int(np.floor(256 * float(x))) for x in v] for _, v, _ in rows]
    width = -(-max(len(v) for v in whole) // parts) * parts
    cut = [v + [0] * (width - len(v)) for v in whole]
    size = width // parts
    cut = [[v[i * size : (i + 1) * size] for i in range(parts)] for v in cut]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[cut[i][j] for i in order[:entries]] for j in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(v[j], c, strict=True)), k) for k, c in enumerate(books[j]))
             for j in range(parts)]
            for v in cut
        ]

    for _ in range(rounds):
        found = assign()
        for j in range(parts):
            for k in range(len(books[j])):
                own = [cut[i][j] for i in range(len(cut)) if found[i][j][1] == k]
                if own:
                    books[j][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], books


def vectors(seed=1, n=300, dim=12):
    draw = random.Random(seed)
    centres = [[draw.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        c = draw.choice(centres)
        v = [float(np.float32(x + draw.gauss(0, 0.2))) for x in c]
        out.append((i * 3 + 1, v, None if i % 7 == 0 else i % 4))
    same = [0.25] * dim
    out += [(10_000 + i, same, 1) for i in range(n // 2)]  # a third are copies
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("owner_members, rounds", [(10_000, 2), (50, 2), (50, 4), (10_000, 0)])
def test_codes_are_those_of_the_definition(spark, owner_members, rounds):
    rows = vectors()
    code, error, books = brute(rows, 4, 8, rounds)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.vec_id: r for r in V.compress(
        frame, parts=4, entries=8, rounds=rounds, owner_members=owner_members).collect()}
    assert {r[0]: (c, e) for r, c, e in zip(rows, code, error, strict=True)} == {
        i: (r.code, r.error) for i, r in got.items()
    }
    labels = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        labels[label] = labels.get(label, 0) + e
    assert all(got[i].label_error == labels[label] for i, _, label in rows)
    flat = ",".join(str(x) for own in books for entry in own for x in entry)
    import hashlib

    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(flat.encode()).hexdigest()}


def test_owners_sum_without_an_exchange_and_only_movers_are_shuffled(spark):
    kept = V.usable(spark.createDataFrame(vectors(), SCHEMA))
    start = V.integers(__import__("pyarrow").array([r.embedding for r in kept.limit(8).collect()]), 12, 256)
    books = V.Codebooks(start.reshape(8, 4, 3).transpose(1, 0, 2).copy())
    residents = V._Residents(spark, 6)
    try:
        members = residents.settle(kept.select("embedding").mapInArrow(V._first_homes(books, 2), V._MEMBERS))
        assert members.agg(F.sum("weight")).first()[0] == 4 * kept.count()
        assert members.count() < 4 * kept.count()  # copies travel once
        moved = V._updated(books, [members])
        table = residents.write(
            members.mapInArrow(V._next_homes(moved), f"{V._MEMBERS}, entry int, moved boolean"), ["moved"]
        )
        stay = table.filter("NOT moved").select("position", "home", "salt", "weight", "part")
        go = table.filter("moved").select("position", F.col("entry").alias("home"), "salt", "weight", "part")
        assert 0 < go.count() < members.count()
        both = [stay, residents.settle(go)]
        plan = V.sums_of_owners(both, 3)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert both[0].unionByName(both[1]).agg(F.sum("weight")).first()[0] == 4 * kept.count()
    finally:
        residents.drop()


def test_odd_rows(spark):
    rows = vectors(2, 60)
    nan, inf = float("nan"), float("inf")
    odd = [(5, None, 1), (6, [1.0, None] + [0.0] * 10, 1), (7, [nan] * 12, 1), (8, [inf] + [0.0] * 11, 2)]
    kept = [(None, [0.5] * 12, None), rows[0], (9, [], 3), (11, [1.0, 2.0], 3), (12, [3e38] * 12, 9), (12, [-3e38] * 12, 9)]
    docs = spark.createDataFrame(rows + odd + kept, SCHEMA).select("*", *[F.lit("extra").alias(c) for c in CLASHES])
    found = V.compress(docs, parts=4, entries=8).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in found) == sorted(
        (i is None, i or 0) for i, _, _ in rows + kept
    )
    again = V.compress(docs.repartition(7), parts=4, entries=8).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    twice = [r for r in found if r.vec_id == rows[0][0]]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(1, [0.1, 0.2], None), (2, [0.3, 0.4], None)], SCHEMA)
    found = V.compress(few).collect()
    assert len(found) == 2 and all(len(r.code) == 32 and r.error == 0 for r in found)
    assert V.compress(few.filter("vec_id < 0")).collect() == []
    assert V.compress(spark.createDataFrame([(1, [], 1)], SCHEMA)).count() == 1


def test_large_components_are_exact():
    draw = np.random.default_rng(1)
    rows = draw.integers(-V.LARGEST, V.LARGEST, (50, 6))
    entries = draw.integers(-V.LARGEST, V.LARGEST, (9, 6))
    best, far = V.nearest(rows, entries)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in entries] for x in rows]
    assert far.tolist() == [min(x) for x in exact] and best.tolist() == [x.index(min(x)) for x in exact]
