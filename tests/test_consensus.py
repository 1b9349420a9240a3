import pytest

from termloom.operators.consensus import consensus, evaluate_consensus, pooled_prepared, review_sheet

MAPPINGS = (
    "model string, subject_id string, subject_label string, predicate_id string, object_id string, "
    "object_label string, similarity_score double, comment string, mapping_justification string"
)
TRUTH = (
    "pair_id string, subject_id string, subject_label string, mesh_concept_group string, "
    "mapping_count int, mappability string, exclusion_reason string, accurate_mapping int"
)
NAMES = ["human descriptions", "m2", "m3", "m4", "m5", "m6"]


def ballots(subject, pattern):
    """One vote per model; ``pattern`` lists the votes of each option."""
    rows, models = [], iter(NAMES)
    for option, count in enumerate(pattern):
        for _ in range(count):
            model = next(models)
            for place, target in enumerate([f"o{option}", "worse"]):
                rows.append((model, subject, f"label {subject}", "skos:relatedMatch", target, target,
                             0.9 - place / 2, "", "j"))
    return rows


PATTERNS = {
    "s221": (2, 2, 1), "s311": (3, 1, 1), "s22": (2, 2), "s111": (1, 1, 1), "s1": (1,), "s33": (3, 3),
    "s5": (5,),
}


@pytest.fixture(scope="module")
def mappings(frame):
    return frame([row for s, p in PATTERNS.items() for row in ballots(s, p)], MAPPINGS)


def test_counts(mappings):
    rows = {(r.subject_id, r.object_id): r for r in consensus(mappings).collect()}
    assert len(rows) == sum(len(p) for p in PATTERNS.values())
    for s, pattern in PATTERNS.items():
        for option, count in enumerate(pattern):
            r = rows[(s, f"o{option}")]
            assert (r.votes, r.participants, r.opts) == (count, sum(pattern), len(pattern))
            assert r.share == count / sum(pattern)
            assert r.human_desc_vec_sim == int(option == 0)


@pytest.mark.parametrize(
    "rule, tied",
    [
        ("pattern", {("s221", "o0"), ("s221", "o1"), ("s22", "o0"), ("s22", "o1"),
                     ("s111", "o0"), ("s111", "o1"), ("s111", "o2"), ("s1", "o0")}),
        ("general", {("s221", "o0"), ("s221", "o1"), ("s22", "o0"), ("s22", "o1"), ("s111", "o0"),
                     ("s111", "o1"), ("s111", "o2"), ("s33", "o0"), ("s33", "o1")}),
    ],
)
def test_ties(mappings, rule, tied):
    rows = consensus(mappings, rule).filter("ties = 1").collect()
    assert {(r.subject_id, r.object_id) for r in rows} == tied


def test_unknown_rule(mappings):
    with pytest.raises(ValueError):
        consensus(mappings, "none")


def test_evaluated(mappings, frame):
    truth = frame(
        [("s221|o1", "s221", "l", "Cell type", 2, "Mappable", None, 1),
         ("s311|o0", "s311", "l", "Cell type", 1, "Mappable", None, 1),
         ("s311|o2", "s311", "l", "Cell type", 1, "Mappable", None, 1),
         (None, "s22", "l", "Cell type", 0, "Unmappable", "why", None)],
        TRUTH,
    )
    evaluated = evaluate_consensus(consensus(mappings), truth).cache()
    rows = {(r.subject_id, r.object_id): r for r in evaluated.collect()}
    assert rows[("s22", "o0")].mappability == "Unmappable"
    assert rows[("s311", "o0")].top_vote_correct == 1
    assert rows[("s221", "o1")].top_vote_correct is None
    assert [rows[("s311", o)].mapping_result_number for o in ("o0", "o1", "o2")] == [1, 0, 2]
    assert [rows[("s311", o)].concept_pair_rank for o in ("o0", "o1", "o2")] == [1, 2, 3]
    assert rows[("s311", "o1")].hit_miss_concept == "Hit"
    assert rows[("s311", "o1")].hit_miss_mapping == "Miss"
    assert rows[("s5", "o0")].model_analyzed is False
    assert pooled_prepared(evaluated).filter("subject_id = 's22'").count() == 0
    assert review_sheet(evaluated).count() == len(rows)
