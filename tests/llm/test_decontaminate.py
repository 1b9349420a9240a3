import hashlib
import re

import pytest

from termloom.llm import decontaminate as D
from tests.llm.helpers import collected, corpus, lowered, nothing, odd_corpus

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(texts, items, window=10):
    out = []
    for text in texts:
        own, hit, names = WORD.findall(lowered(text)), set(), set()
        for name, body in items:
            item = WORD.findall(lowered(body))
            size = min(window, len(item))
            for low in range(len(item) - size + 1) if item else ():
                for at in range(len(own) - size + 1):
                    if own[at : at + size] == item[low : low + size]:
                        hit.update(range(at, at + size))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((len(own), len(hit), len(names), digest, bool(hit)))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    docs = {r.doc_id: r.text for r in corpus(spark).collect()}
    cut = docs[0].split()
    items = [
        (1, " ".join(cut[3:20])), (2, " ".join(cut[4:15]).upper()), (3, " ".join(cut[1:6])),
        (10, "a"), (4, None), (5, ""), (6, "!!!"), (7, "word " * 25), (1, " ".join(cut[10:24])),
        (8, "none of this is anywhere in the texts above at all today"), (9, docs[7]),
    ]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_equal_to_comparing_all_windows(spark, benchmark, block_words):
    frame, items = benchmark
    own = corpus(spark).select("doc_id", "text").collect()
    expect = sorted((r.doc_id, *e) for r, e in zip(own, brute([r.text for r in own], items), strict=True))
    found = D.contamination(corpus(spark), frame, block_words=block_words)
    assert sorted(map(tuple, found.collect())) == expect
    assert any(e[-1] for e in expect) and not all(e[-1] for e in expect)


def test_odd_rows_keep_their_columns(spark, benchmark):
    frame, _ = benchmark
    odd = odd_corpus(spark)
    kept = D.drop_contaminated(odd, frame)
    assert kept.columns == odd.columns
    flags = D.contamination(odd, frame)
    assert flags.count() == odd.count()
    assert kept.count() == flags.filter("NOT contaminated").count()
    assert collected(kept.exceptAll(odd)) == []


def test_empty_sides(spark, benchmark):
    frame, _ = benchmark
    assert D.contamination(nothing(spark), frame).collect() == []
    found = D.contamination(corpus(spark), frame.limit(0))
    assert found.filter("contaminated OR n_items > 0").count() == 0 and found.count() == corpus(spark).count()


def test_windows_may_not_cross_documents(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame(
        [(1, "one two three four five"), (2, "six seven eight nine ten")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert D.contamination(docs.coalesce(1), items).filter("contaminated").count() == 0


@pytest.mark.parametrize("kind, ids", [("string", ["a", "b", None, None]), ("long", [1, 2, None, None])])
def test_items_without_an_id_are_one_item_without_a_name(spark, kind, ids):
    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "wxyz"]
    docs = spark.createDataFrame([(1, texts[0] + " and " + texts[2]), (2, texts[3]), (3, "clean")], "doc_id long, text string")
    items = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"item_id {kind}, text string")
    found = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in D.contamination(docs, items).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == {1: (24, 2, digest(str(ids[0]))), 2: (12, 1, digest("")), 3: (0, 0, digest(""))}
    assert [r.doc_id for r in D.drop_contaminated(docs, items).collect()] == [3]
