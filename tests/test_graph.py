import random

import pytest

from termloom.operators import extraction, graph
from termloom.operators.mappings import crosswalk

EDGES = "child string, parent string"
QUADS = "s string, p string, o string, g string"


def nodes(df):
    return sorted(r.node for r in df.collect())


def test_closure_chain_diamond_cycle_and_lone_seed(frame):
    edges = frame(
        [("b", "a"), ("c", "b"), ("d", "a"), ("e", "d"), ("e", "c"),  # chain and diamond
         ("x", "y"), ("y", "x"), ("z", "y"), ("b", "a"), ("q", "p")],
        EDGES,
    )
    seeds = frame([("a",), ("x",), ("alone",), ("a",)], "iri string")
    assert nodes(graph.descendants(edges, seeds)) == ["a", "alone", "b", "c", "d", "e", "x", "y", "z"]
    assert nodes(graph.descendants(edges, seeds, include_self=False)) == ["b", "c", "d", "e", "x", "y", "z"]


def test_closure_on_a_random_graph_with_a_hot_parent(frame, monkeypatch):
    monkeypatch.setattr(graph, "COMPACT_EVERY", 2)
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(250)]
    pairs += [(f"n{i}", "n7") for i in range(100, 220)]
    pairs += [(f"c{i + 1}", f"c{i}") for i in range(9)] + [("c0", "n7")]
    reached = {"n7", "n1"}
    while True:
        more = {c for c, p in pairs if p in reached} - reached
        if not more:
            break
        reached |= more
    out = graph.descendants(frame(pairs, EDGES), frame([("n7",), ("n1",)], "iri string"))
    assert nodes(out) == sorted(reached)


def test_patterns(frame):
    triples = frame(
        [("a", "p", "x", "g1"), ("a", "p", "x", "g2"), ("a", "q", "y", "g1"), ("b", "p", "z", "g2"),
         ("a", "r", "w", "g1"), ("a", "q", "y2", "g1")], QUADS,
    )
    assert graph.merge_graphs(triples, ["g1", "g2"]).count() == 5
    one = graph.match(graph.merge_graphs(triples, ["g1", "g2"]), "p", "t", "v")
    two = graph.match(triples, ["q", "r"], "t", "u")
    assert graph.bgp(one, two).count() == 3
    assert graph.optional(one, two).count() == 4
    assert [r.t for r in graph.exists_in_graph(one, triples, "g2", "p", "t").orderBy("t").collect()] == ["a", "b"]
    assert graph.joined_values(triples, ["q", "r"]).first()["aka"] == "w; y; y2"
    with pytest.raises(ValueError):
        graph.bgp(one, graph.match(triples, "q", "other", "thing"))


def test_extract_terms_descriptions_and_synonyms(frame):
    uberon = extraction.UBERON
    rows = [
        (uberon + "1", extraction.LABEL, "heart", "g"),
        (uberon + "1", extraction.LABEL, "heart", "h"),
        (uberon + "1", extraction.EXACT_SYNONYM, "cor", "g"),
        (uberon + "1", extraction.EXACT_SYNONYM, "a heart", "g"),
        (uberon + "1", extraction.EXTERNAL_DEFINITION, "external", "g"),
        (uberon + "2", extraction.LABEL, "valve", "g"),
        (uberon + "2", extraction.DEFINITION, "own", "g"),
        (uberon + "2", extraction.EXTERNAL_DEFINITION, "external", "g"),
        (uberon + "2", extraction.PART_OF, uberon + "1", "g"),
        (uberon + "3", extraction.LABEL, "elsewhere", "g"),
        ("http://other/4", extraction.LABEL, "other", "g"),
        ("http://other/4", extraction.PART_OF, uberon + "1", "g"),
    ]
    triples = frame(rows, QUADS)
    common = dict(namespace=uberon, id_rules={uberon: "UBERON_"})
    out = {r.id: (r.name, r.aka, r.description) for r in extraction.extract_terms(
        triples, ["g"], part_of=frame([(uberon + "1",)], "iri string"), **common).collect()}
    assert out == {
        "UBERON_1": ("heart", "a heart; cor", "external"), "UBERON_2": ("valve", None, "own"),
    }
    there = extraction.extract_terms(triples, ["g"], present_in="h", **common).collect()
    assert [r.id for r in there] == ["UBERON_1"]


def test_crosswalk_labels(frame):
    codes = frame([("A:1", "A"), ("MSH:D1", "MSH"), ("MSH:D2", "MSH")], "code_id string, sab string")
    links = frame([("c", "A:1"), ("c", "MSH:D1"), ("c2", "A:1"), ("c2", "MSH:D1"), ("c2", "MSH:D2")],
                  "concept string, code_id string")
    terms = frame([("A:1", "Zeta"), ("A:1", "alpha"), ("A:1", "ALPHA"), ("MSH:D1", "x"), ("MSH:D2", "y")],
                  "code_id string, name string")
    out = {(r.left_id, r.right_id, r.left_labels, r.right_labels)
           for r in crosswalk(codes, links, terms, "A", "MSH", right_drop="MSH:").collect()}
    assert out == {("A_1", "D1", "alpha; zeta", "x"), ("A_1", "D2", "alpha; zeta", "y")}


def test_a_long_chain_takes_few_rounds(frame, monkeypatch):
    from termloom.operators import graph

    rounds = []
    written = graph.materialize_counted
    monkeypatch.setattr(graph, "materialize_counted", lambda df, name: rounds.append(name) or written(df, name))
    edges = frame([(i + 1, i) for i in range(3000)] + [(7, 7), (5, 2999), (9000, 8999)], "child int, parent int")
    found = graph.descendants(edges, frame([(0,)], "node int"))
    assert found.distinct().count() == found.count() == 3001
    assert rounds.count("frontier") <= 14


@pytest.mark.parametrize("ways", [4, 0])
@pytest.mark.parametrize("itself", [True, False])
def test_descendants_of_random_graphs(frame, monkeypatch, ways, itself):
    import random

    from termloom.operators import graph

    monkeypatch.setattr(graph, "WAYS", ways)
    draw = random.Random(ways + itself)
    pairs = {(draw.randrange(200), draw.randrange(200)) for _ in range(230)} | {(i + 301, i + 300) for i in range(40)}
    seeds = {3, 77, 300}
    reached, newest = set(seeds) if itself else set(), set(seeds)
    while newest:
        newest = {c for c, p in pairs if p in newest} - reached
        reached |= newest
    edges = frame([*pairs, (None, 3), (5, None)], "child int, parent int")
    found = graph.descendants(edges, frame([(s,) for s in seeds], "node int"), itself).collect()
    assert sorted(r.node for r in found) == sorted(reached)
