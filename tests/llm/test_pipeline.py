import pytest

import __spark_entry__ as contract
import corpus_pipeline as C
from termloom.llm import decontaminate, language_id, near_duplicates, packing
from tests.llm.helpers import corpus, nothing, odd_corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs = corpus(spark)
    docs.write.parquet(f"{top}/documents.parquet")
    text = docs.filter("doc_id = 9").first().text
    spark.createDataFrame([(1, text[:200])], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_are_in_order_and_registered():
    assert [name for name, _ in C.STAGES] == [
        "language_id", "near_duplicates", "decontaminate", "personal_data", "packing",
    ]
    names = contract.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_each_stage_does_what_its_operator_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    after = [docs]
    for _, stage in C.STAGES[:-1]:
        after.append(stage(spark, after[-1], folder).cache())
        assert after[-1].columns == docs.columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in after]
    model = language_id.fit(docs.filter(language_id.fold("doc_id", 4) != 2))
    kept = language_id.identify(docs, model).filter("NOT rejected").select("row.doc_id")
    assert ids[1] == {r.doc_id for r in kept.collect()}
    alone = near_duplicates.near_duplicates(after[1]).filter("kept")
    assert ids[2] == {r.doc_id for r in alone.collect()} and len(ids[2]) < len(ids[1])
    clean = decontaminate.contamination(after[2], items).filter("NOT contaminated")
    assert ids[3] == {r.doc_id for r in clean.collect()} and 9 not in ids[3]
    assert ids[4] == ids[3]
    assert C.STAGES[-1][1](spark, after[4], folder).exceptAll(packing.pack(after[4])).count() == 0


def test_copies_from_similarity_0_8_on_go(spark, folder):
    own = [f"word{i}" for i in range(104)]  # 100 shingles
    changed = [own[: 104 - n] + [f"new{n}x{i}" for i in range(n)] for n in (10, 12)]
    texts = [own, changed[0], [f"other{i}" for i in range(104)]]
    texts.append([w.replace("word", "other") for w in changed[1]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]  # 90 of 110 and 88 of 112 in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in C.one_of_each(spark, docs, folder).collect()) == [0, 2, 3]


def test_run_gives_the_last_stage(spark, folder):
    found = C.run(spark, folder)
    assert found.columns[:2] == ["doc_id", "piece"] and found.count() > 0


def test_odd_and_empty_documents_pass_every_stage(spark, folder):
    for docs in (odd_corpus(spark), nothing(spark)):
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert set(docs.columns) >= {"doc_id", "text"}
        C.STAGES[-1][1](spark, docs, folder).collect()

