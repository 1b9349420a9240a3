import math

import pytest

from termloom import schemas
from termloom.functions import ordering
from termloom.operators import evaluation as ev
from tests.test_consensus import MAPPINGS, TRUTH

GROUP = {"hit1": "Cell type"}


def mapping(model, subject, *targets):
    return [(model, subject, f"label {subject}", "skos:relatedMatch", t, t, 1.0 - i / 10, "", "j")
            for i, t in enumerate(targets)]


@pytest.fixture(scope="module")
def truth(frame):
    def row(subject, target, count, accurate=1, group="Anatomical structure"):
        return (f"{subject}|{target}", subject, f"label {subject}", group, count, "Mappable", None, accurate)

    return frame(
        [row("hit1", "t1", 1, group="Cell type"), row("hit3", "t3", 2),
         row("two", "t1", 2), row("two", "t2", 2), row("miss", "t9", 1), row("miss", "t1", 1, 0),
         row("skipped", "t1", 1),
         (None, "never", "label never", "Cell type", 0, "Unmappable", "reason", None)],
        TRUTH,
    )


@pytest.fixture(scope="module")
def mappings(frame):
    rows = mapping("a", "hit1", "t1", "t2") + mapping("a", "hit3", "t1", "t2", "t3")
    rows += mapping("a", "two", "t1", "t2") + mapping("a", "miss", "t1", "t2") + mapping("a", "never", "t1")
    rows += mapping("b", "skipped", "t1")
    return frame(rows, MAPPINGS)


@pytest.fixture(scope="module")
def prepared(mappings, truth):
    return ev.prepare(mappings, truth).cache()


def test_layout_and_skipped_concepts(prepared):
    assert prepared.columns == schemas.PREPARED_COLUMNS
    rows = prepared.collect()
    assert not [r for r in rows if r.subject_id == "never"]
    by = {(r.model, r.subject_id, r.object_id): r for r in rows}
    assert len(rows) == 9 + 1 + 1 + 4
    lost = by[("a", "skipped", None)]
    assert (lost.model_analyzed, lost.accurate_mapping, lost.mapping_result_number) == (False, 0, 0)
    assert (lost.hit_miss_concept, lost.hit_miss_mapping, lost.concept_pair_rank) == ("Miss", "Miss", None)
    assert [by[("a", "two", t)].mapping_result_number for t in ("t1", "t2")] == [1, 2]
    assert by[("a", "hit3", "t1")].hit_miss_concept == "Hit"
    assert by[("a", "hit3", "t1")].hit_miss_mapping == "Miss"


def test_hot_groups_do_not_change_the_rows(prepared, mappings, truth, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_GROUP_ROWS", 1)
    assert sorted(map(str, ev.prepare(mappings, truth).collect())) == sorted(map(str, prepared.collect()))


def test_measures(prepared):
    rows = {r.subject_id: r for r in ev.precision_recall(prepared).filter("model = 'a'").collect()}
    assert rows["hit1"].precision == 1 / 2 and rows["hit1"].recall == 1
    assert rows["hit3"].precision == 1 / 3 and rows["hit3"].recall == 1 / 2
    assert rows["two"].precision == 1 / 2 and rows["two"].recall == 1
    assert rows["miss"].precision == 0 and rows["skipped"].precision == 0
    assert rows["skipped"].precision_k == 0
    ranks = {r.subject_id: r.reciprocal_rank
             for r in ev.reciprocal_rank(prepared).filter("model = 'a'").collect()}
    assert ranks == {"hit1": 1, "hit3": 1 / 3, "two": 1, "miss": 0}


def test_report_agrees_with_its_parts(prepared, truth):
    report = {r.model: r.asDict() for r in ev.evaluate(prepared, truth).collect()}
    a = report["a"]
    assert list(a) == ev.REPORT_COLUMNS
    assert (a["mapping_results"], a["mapped_concepts"], a["skipped_concepts"]) == (10, 4, 1)
    assert (a["hit"], a["miss"], a["hit_ct"], a["miss_as"]) == (3, 2, 1, 2)
    assert a["hit_percent"] == 0.6 and a["mapped_concepts_percent"] == 0.8
    p, r = a["mean_precision"], a["mean_recall"]
    assert a["f_score"] == pytest.approx(5 * p * r / (4 * p + r))
    assert a["mean_reciprocal_rank"] == pytest.approx((1 + 1 / 3 + 1 + 0) / 4)
    parts = [ev.coverage(prepared, truth), ev.hit_miss(prepared, truth), ev.hit_miss_by_group(prepared, truth),
             ev.f_beta(ev.precision_recall(prepared)), ev.mrr(ev.reciprocal_rank(prepared))]
    for part in parts:
        for row in part.collect():
            for name, value in row.asDict().items():
                whole = report[row.model][name]
                assert whole == value or math.isclose(whole, value)


def test_unmappable(truth, frame):
    source = frame([(str(i),) for i in range(20)], "iri string")
    row = ev.unmappable_stats(truth, source).first()
    assert (row.concept_group, row.percent_subject_concept, row.percent_subject_concept_reasons) == (1, 0.05, 1.0)
