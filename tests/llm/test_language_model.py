import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import language_model as M
from termloom.llm.elias_fano import EliasFano
from tests.llm.helpers import corpus, lowered, nothing, odd_corpus, plain_words

NUMBERS = st.lists(st.integers(0, 1 << 57), max_size=200)


@settings(max_examples=150, deadline=None)
@given(NUMBERS, st.lists(st.integers(0, 1 << 58), max_size=50))
def test_elias_fano_reads_and_searches(values, probes):
    values = np.sort(np.array(values, np.uint64))
    coded = EliasFano(values)
    n = len(values)
    if n:
        assert (coded.get(np.arange(n)) == values).all()
    probes = np.concatenate([np.array(probes, np.uint64), values])
    place, same = coded.successor(probes, 0, n)
    assert (place == np.searchsorted(values, probes)).all()
    assert (same == np.isin(probes, values)).all()


def test_trie_finds_exactly_its_grams():
    draw = np.random.default_rng(2)
    pairs = np.unique(draw.integers(0, 60, (400, 2)).astype(np.uint64), axis=0)
    codes = np.arange(1, len(pairs) + 1).astype(np.uint16)
    contexts = np.unique(pairs[:, 0])
    built = M.Level(pairs[:, 0], pairs[:, 1], codes, contexts, contexts + 1)
    every = np.array([(a, b) for a in range(62) for b in range(62)], np.uint64)
    known = {tuple(p): c for p, c in zip(pairs.tolist(), codes.tolist(), strict=True)}
    for level in (built, M.Level.load(np.frombuffer(built.dump(), np.uint8))):
        found, marks = level.find(every[:, 0], every[:, 1])
        assert found.tolist() == [known.get(tuple(p), 0) for p in every.tolist()]
        assert marks.tolist() == [a + 1 if a in contexts else 0 for a, _ in every.tolist()]


@pytest.mark.parametrize("kind", [np.uint16, np.uint64])
def test_empty_level(kind):
    none = np.zeros(0, np.uint64)
    level = M.Level.load(np.frombuffer(M.Level(none, none, none.astype(kind), none, none).dump(), np.uint8))
    assert [x.tolist() for x in level.find(np.arange(3, dtype=np.uint64), np.arange(3, dtype=np.uint64))] == [[0] * 3] * 2


def plain_scores(rows, order):
    texts = [[*plain_words(lowered(t)), "\0end"] for _, t, _ in rows]
    counts = [Counter() for _ in range(order + 1)]
    for tokens, (_, _, held) in zip(texts, rows, strict=True):
        if not held:
            for k in range(1, order + 1):
                counts[k].update(tuple(tokens[i - k + 1 : i + 1]) for i in range(k - 1, len(tokens)))
    total, types = sum(counts[1].values()), len(counts[1])
    use = {}
    for tokens, (_, _, held) in zip(texts, rows, strict=True):
        for k in range(2, order + 1):
            for i in range(k - 1, len(tokens)) if not held else ():
                gram = tuple(tokens[i - k + 1 : i + 1])
                n = use.setdefault((k, counts[k - 1][gram[:-1]].bit_length()), [0, 0])
                n[0] += 1
                n[1] += counts[k][gram] == 1
    out = []
    for tokens in texts:
        score = 0.0
        for i, token in enumerate(tokens):
            p = (counts[1][(token,)] + 1) / (total + types + 1)
            for k in range(2, min(order, i + 1) + 1):
                gram = tuple(tokens[i - k + 1 : i + 1])
                context = counts[k - 1][gram[:-1]]
                if context:
                    n = use.get((k, context.bit_length()))
                    share = (n[1] + 1) / (n[0] + 2)
                    # Steps of 1/64 bit
                    ratio = 2 ** (-round(-math.log2(counts[k][gram] / context) * 64) / 64) if counts[k][gram] else 0
                    p = (1 - share) * ratio + share * p
            score += math.log10(p)
        known = sum(counts[1][(t,)] > 0 for t in tokens)
        base = sum(math.log10((counts[1][(t,)] + 1) / (total + types + 1)) for t in tokens)
        out.append((len(tokens), known, total, base, score))
    return out


def check(spark, docs, order, **settings):
    rows = sorted((tuple(r) for r in docs.collect()), key=lambda r: r[0])
    found = M.score_documents(docs, order, **settings).orderBy("doc_id").collect()
    for r, (id, _, held), e in zip(found, rows, plain_scores(rows, order), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (id, held, *e[:3])
        assert r.base_score == pytest.approx(e[3]) and r.score == pytest.approx(e[4], rel=1e-6)


@pytest.mark.parametrize("order, mapped", [(2, True), (3, True), (3, False)])
def test_scores_are_those_of_plain_counts(spark, order, mapped):
    docs = corpus(spark).select("doc_id", "text", (F.col("doc_id") % 5 == 2).alias("held_out"))
    check(spark, docs, order, shard_entries=2_000, map_files=mapped)


def test_shard_of_a_frequent_context_is_cut(spark, monkeypatch):
    """A word before thousands of others: its shard has parts, which know its total."""
    made = []

    class Seen(M.Spread):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self.cuts)

    monkeypatch.setattr(M, "Spread", Seen)
    texts = [" ".join(f"the w{i * 37 % 4001} x{(i * j) % 7}" for i in range(60 * j, 60 * j + 300)) for j in range(40)]
    rows = [(i, t, i % 5 == 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(8)
    check(spark, docs, 3, shard_entries=400)
    assert len(made[0]) and made[0].max() >= 3


def test_contexts_without_an_n_gram_keep_their_marks():
    grams = (np.array([3, 3, 9], np.uint64), np.array([2, 5, 1], np.uint64), np.array([7, 8, 9], np.uint16))
    every, marks = np.array([1, 3, 6, 9, 12], np.uint64), np.arange(1, 6)
    level = M.Level.load(np.frombuffer(M.Level(*grams, every, marks).dump(), np.uint8))
    asked = [(c, w) for c in range(14) for w in range(7)]
    found, seen = level.find(*(np.array(x, np.uint64) for x in zip(*asked)))
    known = dict(zip(zip(*(x.tolist() for x in grams[:2])), grams[2].tolist()))
    assert found.tolist() == [known.get(a, 0) for a in asked]
    assert seen.tolist() == [dict(zip(every.tolist(), marks.tolist())).get(c, 0) for c, _ in asked]


def test_answers_come_from_the_mapped_levels(spark, tmp_path):
    none = [b""] * 4
    keys = np.array([(1 << 32) + 2, (1 << 32) + 5, (4 << 32) + 1], np.uint64)
    counts = M._squeeze(np.array([3, 1, 2], np.uint32))
    sent = M._frame([M._rising(keys), counts, b"", b"", M._rising(keys), counts, b"", b""])
    row = M._build(2, str(tmp_path))(pa.table({"shard": pa.array([0], pa.int64()), "payload": [sent]}))
    asked = pa.table({"shard": pa.array([0], pa.int64()), "block": pa.array([8], pa.int64()),
                      "payload": [M._frame([M._rising(keys)] * 2)]})

    def answers():
        parts = M._parts(M._answer(2)(asked, row).column("payload")[0].as_py(), 4)
        return [M._expand(x, k).tolist() for x, k in zip(parts, (np.uint64, np.uint8, np.uint16, np.uint8), strict=True)]

    assert answers() == [[3, 1, 2], [0] * 3, M.codes_of(np.array([0.75, 0.25, 1])).tolist(), [3, 3, 2]]
    # Other levels in the file, other answers
    (path,) = row.column("path").to_pylist()
    other = M._frame([M._rising(keys[:1]), M._squeeze(np.array([9], np.uint32)), b"", b"", *none])
    new = M._build(2, None)(pa.table({"shard": pa.array([0], pa.int64()), "payload": [other]}))
    with open(path, "wb") as out:
        out.write(new.column("data")[0].as_py())
    assert answers() == [[9, 0, 0], [0] * 3, [0] * 3, [0] * 3]
    with open(path, "wb"):
        pass
    with pytest.raises(ValueError):
        answers()


def test_odd_rows_and_empty_tables(spark):
    odd = odd_corpus(spark).withColumn("held_out", F.col("doc_id") % 3 == 0)
    found = M.score_documents(odd)
    assert found.count() == odd.count() and found.filter("doc_id IS NULL").count() == 1
    twice = found.filter("doc_id = 2").collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    none = nothing(spark).withColumn("held_out", F.lit(False))
    assert M.score_documents(none).collect() == []
    untaught = M.score_documents(corpus(spark).withColumn("held_out", F.lit(True)))
    assert untaught.filter("n_known > 0 OR train_tokens > 0 OR base_score <> 0").count() == 0


def test_same_rows_in_two_blocks(spark):
    docs = corpus(spark).coalesce(1).withColumn("held_out", F.lit(False)).select("doc_id", "text", "held_out")
    found = M.score_documents(docs.union(docs))
    assert found.count() == 2 * docs.count()
    assert found.distinct().count() == docs.count()
