from pyspark.sql import functions as F

from termloom.functions.text import fill_template, iri_to_id, normalize_ws
from termloom.operators.plugins import EXPAND_TEMPLATE, RANK_TEMPLATE, embed_content, expand_content
from termloom.operators.terms import (
    compose_content, content_lookup, filter_obsolete, filter_subset, page, pages, unknown_content,
)

TERMS = "iri string, id string, name string, aka string, description string"


def contents(df):
    return {r["id"]: r["content"] for r in df.collect()}


def test_compose_content_edges(frame):
    terms = frame(
        [
            ("i1", "A", "heart", "cor; organ", "pumps  blood"),
            ("i2", "B", "liver", "", "a gland\n"),
            ("i3", "C", "lung", None, None),
            ("i4", "D", None, "x", "　 wide﻿"),
        ],
        TERMS,
    )
    assert contents(compose_content(terms)) == {
        "A": "heart also known as cor; organ pumps blood",
        "B": "liver a gland",
        "C": "lung",
        "D": "also known as x wide",
    }
    assert contents(compose_content(terms, legacy=True))["A"].startswith("heartalso known as cor")


def test_normalize_ws_covers_unicode(frame):
    text = " a b c\t\r\n d  "
    df = frame([(text,)], "t string")
    assert df.select(normalize_ws(F.col("t"))).first()[0] == "a b c d"


def test_templates_fill_once(frame):
    df = frame([("$aka", "b")], "name string, aka string")
    out = df.select(
        fill_template("$name/$aka!", {"name": F.col("name"), "aka": F.col("aka")})
    ).first()[0]
    assert out == "$aka/b!"
    for template in (EXPAND_TEMPLATE, RANK_TEMPLATE):
        assert "$name" in template and "$input" in template


def test_iri_rules_apply_in_order(frame):
    df = frame([("http://a/b/1",), ("http://c/2",)], "iri string")
    out = df.select(iri_to_id(F.col("iri"), {"http://a/b/": "", "http://c/": "C_"})).collect()
    assert [r[0] for r in out] == ["1", "C_2"]


def test_filters(frame):
    df = frame(
        [("CL_1", "x", None), ("U_2", "obsolete y", "s"), ("U_3", "notobsolete z", "t"), ("U_4", "Obsolete w", "s")],
        "id string, name string, subset string",
    )
    assert {r.id for r in filter_obsolete(df).collect()} == {"CL_1", "U_4"}
    assert {r.id for r in filter_subset(df, "s", ["CL_"]).collect()} == {"CL_1", "U_2", "U_4"}


def test_content_lookup(frame):
    terms = frame([("A", "a"), ("B", "b")], "id string, name string")
    content = frame([("A", "text"), ("Z", "lost")], "id string, content string")
    assert {r.id: r.content for r in content_lookup(terms, content).collect()} == {"A": "text", "B": None}
    assert [r.id for r in unknown_content(terms, content).collect()] == ["Z"]


def test_pages_cover_the_table(spark):
    df = spark.range(103).select(F.format_string("%03d", "id").alias("id"))
    rows = pages(df, "id", 10).collect()
    assert len(rows) == 103 and {r.page for r in rows} == set(range(11))
    assert [r.id for r in page(df, "id", 10, 10).orderBy("id").collect()] == ["100", "101", "102"]


def test_clients(frame):
    terms = frame([("i", "A", "heart", "cor", "pumps")], TERMS)
    seen = expand_content(terms, lambda prompts: [p.upper() + "  \n" for p in prompts], "$name: $input")
    assert contents(seen) == {"A": "HEART: PUMPS"}
    failed = expand_content(terms, lambda prompts: [None for _ in prompts])
    assert contents(failed) == {"A": None}
    own = embed_content(seen, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert own.first()["embedding"] == [12.0, 1.0]


def test_hashed_embeddings_have_unit_length(frame):
    content = frame([("A", "one two two"), ("B", ""), ("C", None)], "id string, content string")
    vectors = {r["id"]: r["embedding"] for r in embed_content(content, dim=32).collect()}
    assert abs(sum(x * x for x in vectors["A"]) - 1) < 1e-6
    assert not any(vectors["B"]) and not any(vectors["C"])
