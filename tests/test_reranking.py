import random

import pytest

from termloom.operators.plugins import ResultStore, embed_content, expand_content
from termloom.operators.reranking import (
    assemble_candidates, assemble_windows, covering_windows, rank_from_reply, rank_from_windows, rank_with_model,
)

CANDIDATES = "source string, candidates array<struct<target:string,score:double>>, reply string"


def ranks(frame, reply, targets=("A1", "B2", "C3")):
    rows = [("s", [(t, 0.9 - i / 10) for i, t in enumerate(targets)], reply)]
    out = rank_from_reply(frame(rows, CANDIDATES)).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, len(targets) + 1))
    return [r.target for r in out]


def test_full_order(frame):
    assert ranks(frame, "C3, A1, B2") == ["C3", "A1", "B2"]


def test_missing_ids_come_last_in_similarity_order(frame):
    assert ranks(frame, "[C3]") == ["C3", "A1", "B2"]


def test_empty_and_null_replies_keep_the_order(frame):
    assert ranks(frame, "  ") == ["A1", "B2", "C3"]
    assert ranks(frame, None) == ["A1", "B2", "C3"]


def test_an_id_matches_inside_a_longer_one(frame):
    assert ranks(frame, "[M12] [M3] [M1]", ("M3", "M1", "M12")) == ["M1", "M12", "M3"]


def test_single_candidate(frame):
    assert ranks(frame, "nonsense", ("A1",)) == ["A1"]


def test_candidates_are_the_three_best(frame):
    scores = frame([("s", t, x) for t, x in [("a", 0.1), ("b", 0.4), ("c", 0.4), ("d", 0.3)]],
                   "source string, target string, score double")
    content = frame([("a", "ta"), ("b", "tb"), ("c", "tc")], "id string, content string")
    row = assemble_candidates(scores, content).first()
    assert row["passages"] == "[b] tb\n\n[c] tc\n\n[d] \n"
    assert [c["target"] for c in row["candidates"]] == ["b", "c", "d"]


def test_model_sees_batches(frame):
    prompts = frame([("s", "p1"), ("t", "p2")], "source string, prompt string")
    out = rank_with_model(prompts, lambda batch: [p + "!" for p in batch]).collect()
    assert {r.source: r.reply for r in out} == {"s": "p1!", "t": "p2!"}


@pytest.mark.parametrize("k, n", [(1, 3), (3, 3), (4, 3), (10, 3), (10, 4), (25, 5), (6, 2)])
def test_windows_cover_each_pair(k, n):
    windows = covering_windows(k, n)
    assert all(len(w) <= max(n, 1) for w in windows)
    assert {(a, b) for w in windows for a in w for b in w if a < b} == {(a, b) for a in range(k) for b in range(a + 1, k)}
    assert len(windows) <= 2 * k * (k - 1) / max(1, n * (n - 1)) + 1


@pytest.mark.parametrize("k, n", [(10, 3), (10, 4), (3, 3)])
def test_a_model_that_knows_the_order_sorts_all_candidates(frame, k, n):
    draw = random.Random(k * n)
    scores = [(s, f"t{i:02d}", 1 - i / 20) for s, size in (("s", 14), ("few", 5), ("one", 1)) for i in range(size)]
    truth = [f"t{i:02d}" for i in range(14)]
    draw.shuffle(truth)
    windows = assemble_windows(
        frame(scores, "source string, target string, score double"), frame([], "id string, content string"), k, n
    )

    def client(prompts):
        ids = [[line[1:4] for line in p.split("\n") if line.startswith("[")] for p in prompts]
        return [", ".join(sorted(own, key=truth.index)) for own in ids]

    prompts = windows.withColumnRenamed("passages", "prompt")
    found = {}
    for r in rank_from_windows(rank_with_model(prompts, client)).orderBy("source", "rank").collect():
        found.setdefault(r.source, []).append(r.target)
    for s, size in (("s", 14), ("few", 5), ("one", 1)):
        assert found[s] == sorted([f"t{i:02d}" for i in range(min(size, k))], key=truth.index)
    if k == n:
        whole = assemble_candidates(
            frame(scores, "source string, target string, score double"), frame([], "id string, content string"), n
        )
        plain = rank_from_reply(rank_with_model(whole.withColumnRenamed("passages", "prompt"), client))
        assert {(r.source, r.target, r["rank"]) for r in plain.collect()} == {
            (s, t, i + 1) for s, own in found.items() for i, t in enumerate(own)
        }


def test_useless_replies_keep_the_order_of_similarity(frame):
    scores = frame([("s", f"t{i}", 1 - i / 20) for i in range(7)], "source string, target string, score double")
    prompts = assemble_windows(scores, frame([], "id string, content string"), 7, 3).withColumnRenamed("passages", "prompt")
    found = rank_from_windows(rank_with_model(prompts, lambda batch: [None] * len(batch))).orderBy("rank").collect()
    assert [r.target for r in found] == [f"t{i}" for i in range(7)]


def test_results_are_asked_once_over_two_runs(frame, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def client(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return [None if t == "fails" else [float(len(t)), 1.0] for t in texts]

    def asked():
        out = sorted(t for f in log.iterdir() for t in f.read_text().split("\n"))
        for f in log.iterdir():
            f.unlink()
        return out

    store = ResultStore(str(tmp_path / "store"), "model-1", slices=3)
    rows = [("a", "one"), ("b", "two"), ("c", "one"), ("d", None), ("e", "fails")]
    first = embed_content(frame(rows, "id string, content string"), client, store=store).collect()
    assert asked() == ["fails", "one", "two"]
    assert {r.id: r.embedding for r in first} == {"a": [3, 1], "b": [3, 1], "c": [3, 1], "d": None, "e": None}
    more = frame([*rows, ("f", "three")], "id string, content string")
    second = embed_content(more, client, store=store).collect()
    assert asked() == ["fails", "three"] and len(second) == 6
    embed_content(more, client, store=ResultStore(store.path, "model-2")).collect()
    assert asked() == ["fails", "one", "three", "two"]


def test_expansion_goes_on_with_its_store(frame, tmp_path):
    terms = frame([("a", "n", "k", "d"), ("b", "n", "k", "d"), ("c", "m", "k", "d")],
                  "id string, name string, aka string, description string")
    store = ResultStore(str(tmp_path / "store"), "m")
    client = lambda texts: ["x  " + t for t in texts]
    first = expand_content(terms, client, "$name", store).collect()
    assert {r.id: r.content for r in first} == {"a": "x n", "b": "x n", "c": "x m"}

    def never(texts):
        raise AssertionError(texts)

    assert sorted(expand_content(terms, never, "$name", store).collect()) == sorted(first)
