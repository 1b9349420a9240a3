import datetime

import pytest

from termloom.operators.consensus import HUMAN_MODEL
from termloom.operators.mappings import append_sets, sssom_logical, sssom_ranked, validate_mappings
from termloom.plans import workflows
from termloom.session import scratch_path
from termloom.sources import sinks, tables
from tests.test_consensus import MAPPINGS


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_terms_with_quotes_line_breaks_and_short_rows(spark, tmp_path):
    path = write(tmp_path, "terms.csv",
                 'iri,id,name,aka,description\r\ni1,A,"a, ""b""",x; y,"two\nlines"\r\n\r\ni2,B,b\r\ni3,C,c,,d\r\n')
    rows = {r.id: r for r in tables.read_terms(spark, path).collect()}
    assert set(rows) == {"A", "B", "C"}
    assert rows["A"].name == 'a, "b"' and rows["A"].description == "two\nlines"
    assert rows["B"].aka is None and rows["B"].description is None
    assert not rows["C"].aka and rows["C"].description == "d"


@pytest.mark.parametrize("bytes_, end", [(1 << 20, "\n"), (300, "\n"), (40, "\r\n"), (9, "\n")])
def test_records_across_ranges(spark, tmp_path, bytes_, end):
    """Values with line breaks, quotes and commas, cut into many byte ranges."""
    import csv
    import io
    import random

    draw = random.Random(bytes_)
    long = "line one\n" * 30 + '"quoted", and more\n' * 3
    rows = [[f"i{i}", f"{i}", draw.choice(["plain", 'a "b"', "two\nlines", "\n\n", long, "a,b"]), "x", str(i)] for i in range(60)]
    for name, own in (("one.csv", rows[:45]), ("two.csv", rows[45:])):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerows([["iri", "id", "na" + "me", "aka", "description"], *own])
        write(tmp_path, name, out.getvalue() + (end if name == "one.csv" else ""))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        frame = tables.read_terms(spark, str(tmp_path))
        if bytes_ == 300:
            parts = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
            assert parts >= 8
        found = sorted(tuple(r) for r in frame.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == sorted(tuple(r) for r in rows)


def test_scores_with_mixed_line_ends_and_broken_lines(spark, tmp_path):
    path = write(tmp_path, "s.csv",
                 "source,target,score\na,x,0.9\r\na,y,0.8\nb,x,0.7\r\nb,y,none\nb\n\nc,x,0.6,extra\n")
    rows = sorted((r.source, r.target, r.score) for r in tables.read_scores(spark, path).collect())
    assert rows == [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.7), ("c", "x", 0.6)]


def test_ranked_scores_are_repaired(spark, tmp_path):
    path = write(tmp_path, "r.csv", "source,target,rank,score\na,x,1,0.9\na,y,2,0.8\nb,z,0.8145,1,\nc,x,3,0.7\n")
    rows = sorted(tuple(r) for r in tables.read_scores(spark, path, ranked=True).collect())
    assert rows == [("a", "x", 1, 0.9), ("a", "y", 2, 0.8), ("b", "z", 1, 0.8145), ("c", "x", 3, 0.7)]


def test_mapping_sets_by_file_name(spark, tmp_path):
    head = ",".join(tables.schemas.MAPPINGS.names) + "\n"
    line = "http://a/1,one,skos:relatedMatch,http://b/1,uno,0.5,,semapv:SemanticSimilarity\n"
    for name in ("p-mapping.desc-vec.sssom.csv", "p-mapping.m1.llm-vec.sssom.csv", "p-mapping.pooled-x.sssom.csv"):
        write(tmp_path, name, head + line)
    write(tmp_path, "other.txt", "no")
    rows = tables.read_mapping_sets(spark, str(tmp_path), "p").collect()
    assert {r.model for r in rows} == {HUMAN_MODEL, "m1.llm", "pooled-x"}
    kept = tables.read_mapping_sets(spark, str(tmp_path), "p", pooled=False).collect()
    assert {r.model for r in kept} == {HUMAN_MODEL, "m1.llm"}


def test_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path, "terms.csv", "description,extra,name,iri,aka,id\nd,x,n,i,a,1\n")
    assert tuple(tables.read_terms(spark, path).first()) == ("i", "1", "n", "a", "d")
    with pytest.raises(ValueError, match="no column aka"):
        tables.read_terms(spark, write(tmp_path, "short.csv", "iri,id,name,description\ni,1,n,d\n"))


def test_quoted_scores_stay_whole(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'source,target,score\n"A,B",T1,0.9\nC,"T,2",0.8\nD,T,0.7,more\n"E,F",T,0.6,x\n')
    rows = sorted((r.source, r.target, r.score) for r in tables.read_scores(spark, path).collect())
    assert rows == [("A,B", "T1", 0.9), ("C", "T,2", 0.8), ("D", "T", 0.7), ("E,F", "T", 0.6)]
    path = write(tmp_path, "qr.csv", 'source,target,rank,score\n"A,B",x,1,0.9\n"b,c","z,y",0.8145,1,\nb,"z",0.5,1,\n')
    rows = sorted(tuple(r) for r in tables.read_scores(spark, path, ranked=True).collect())
    assert rows == [("A,B", "x", 1, 0.9), ("b", "z", 1, 0.5), ("b,c", "z,y", 1, 0.8145)]


def test_sets_are_read_by_their_form(spark, tmp_path):
    tail = ",,semapv:SemanticSimilarity\n"
    for name, schema, score in (("a", "scored", "0.5,"), ("b", "ranked", "2,"), ("c", "logical", "")):
        head = ",".join(tables.SET_FORMS[schema].names) + "\n"
        line = f"http://a/1,one,skos:relatedMatch,http://b/1,uno,{score}{tail[1:]}"
        write(tmp_path, f"p-mapping.{name}.sssom.csv", head + line)
    for name, form in (("a", "scored"), ("b", "ranked"), ("c", "logical")):
        rows = tables.read_mapping_sets(spark, str(tmp_path), "p", form=form).collect()
        assert [r.model for r in rows] == [name] and rows[0].comment == ""
    assert tables.read_mapping_sets(spark, str(tmp_path), "p", form="ranked").first().score == 2


def rows_of(frame, *tuples):
    return frame(list(tuples), MAPPINGS)


GOOD = ("m", "http://a/1", "one", "skos:relatedMatch", "B:2", "two, \"2\"", 0.5, "",
        "semapv:SemanticSimilarityThresholdMatching")


def test_publish_keeps_other_versions(spark, frame, tmp_path):
    config = sinks.RunConfig("d", "v1", "", "", str(tmp_path))
    newer = sinks.RunConfig("d", "v2", "", "", str(tmp_path))
    sinks.publish(rows_of(frame, GOOD), config)
    sinks.publish(rows_of(frame, GOOD, ("n", *GOOD[1:])), newer)
    out = sinks.publish(rows_of(frame, GOOD, GOOD), newer).collect()
    assert sorted((r.version, r.model, r.object_label) for r in out) == [
        ("v2", "m", 'two, "2"'), ("v2", "m", 'two, "2"'), ("v2", "n", 'two, "2"')]
    assert {r.comment for r in out} == {""}
    assert isinstance(out[0].created, datetime.datetime)
    old = sinks.read_published(spark, config, rows_of(frame, GOOD))
    assert old.count() == 1


def test_written_mappings_are_sorted(spark, frame, tmp_path):
    lower, other = (*GOOD[:6], 0.1, *GOOD[7:]), (GOOD[0], "http://a/0", *GOOD[2:])
    path = str(tmp_path / "out")
    sinks.write_mappings(rows_of(frame, lower, GOOD, other).drop("model"), path)
    back = tables._csv(spark, path, tables.schemas.MAPPINGS).collect()
    assert [(r.subject_id, r.similarity_score) for r in back] == [
        ("http://a/0", 0.5), ("http://a/1", 0.5), ("http://a/1", 0.1)]


def test_validation_rules(frame):
    bad = [
        ("m", "", "one", "skos:relatedMatch", "B:3", "x", 0.5, "", GOOD[8]),
        ("m", "http://a/3", "one", "skos:same", "B:4", "x", 1.5, "", GOOD[8]),
        ("m", "http://a/4", "one", "skos:exactMatch", "no id", "x", float("nan"), "", "because"),
        ("m", "http://a/5", "one", None, "B:5", "x", None, "", None),
    ]
    found = validate_mappings(rows_of(frame, GOOD, GOOD, *bad)).collect()
    assert sorted((r.rule, r.object_id) for r in found) == sorted([
        ("mapping is repeated", "B:2"),
        ("subject_id is empty", "B:3"),
        ("predicate_id is unknown", "B:4"),
        ("similarity_score is outside 0 to 1", "B:4"),
        ("object_id is no IRI or CURIE", "no id"),
        ("similarity_score is outside 0 to 1", "no id"),
        ("mapping_justification is unknown", "no id"),
        ("predicate_id is empty", "B:5"),
        ("mapping_justification is empty", "B:5"),
    ])


def test_ranked_and_logical_sets(frame):
    terms = frame([("http://a/1", "A", "one"), ("http://a/2", "B", "two")], "iri string, id string, name string")
    ranked = frame([("A", "B", 0.8145, 1.0), ("A", "A", 2.5, 1.0), ("A", "zzz", 1.0, 1.0)],
                   "source string, target string, rank double, score double")
    assert sorted(r.score for r in sssom_ranked(terms, terms, ranked).collect()) == [1, 2]
    descriptors = frame([("D1", "http://d/1", "n1"), ("D1", "http://d/2", "n2")],
                        "descriptor_id string, iri string, name string")
    links = frame([("A", "D1", "", "")], "left_id string, right_id string, left_labels string, right_labels string")
    assert sssom_logical(terms, descriptors, links).count() == 2


def test_sets_are_appended(frame):
    one = rows_of(frame, GOOD).drop("model")
    assert {r.model for r in append_sets({"x": one, "y": one}).collect()} == {"x", "y"}


def test_workflows_run_end_to_end(spark, tmp_path):
    terms = "iri,id,name,aka,description\nhttp://a/1,A,heart muscle,cor,pumps blood\nhttp://a/2,B,liver,,makes bile\n"
    other = "iri,id,name,aka,description\nhttp://b/1,X,bile maker,,the liver makes bile\nhttp://b/2,Y,pump,,heart pumps blood\n"
    config = sinks.RunConfig("demo", "v1", write(tmp_path, "a.csv", terms), write(tmp_path, "b.csv", other),
                             str(tmp_path / "out"))
    writer = workflows.Clients(text=lambda prompts: prompts)
    rows = workflows.run_workflows(spark, config, ["desc-vec", "phi4-14b"], {"phi4-14b": writer}).collect()
    assert {r.model for r in rows} == {"desc-vec", "phi4-14b.llm"} and len(rows) == 8
    broken = terms.replace("http://a/2", "no iri")
    worse = sinks.RunConfig("demo", "v2", write(tmp_path, "c.csv", broken), config.target_terms, config.output)
    with pytest.raises(ValueError, match="violations"):
        workflows.run_workflows(spark, worse, ["desc-vec"])
    assert workflows.run_workflows(spark, worse, ["desc-vec"], strict=False).count() == 4
    best = {r.subject_label: r.object_label for r in sorted(rows, key=lambda r: r.similarity_score)
            if r.model == "desc-vec"}
    assert best == {"heart muscle": "pump", "liver": "bile maker"}
    with pytest.raises(ValueError, match="text client"):
        workflows.run_workflows(spark, config, ["gpt4o"])


def test_ranking_workflow(frame):
    terms = frame([("http://a/1", "A", "one", "", "d"), ("http://a/2", "B", "two", "", "e")],
                  "iri string, id string, name string, aka string, description string")
    content = frame([("A", "first"), ("B", "second")], "id string, content string")
    scores = frame([("A", "A", 0.9), ("A", "B", 0.8)], "source string, target string, score double")
    run = workflows.map_by_ranking(terms, terms, content, content, scores, lambda p: ["B, A"] * len(p))
    assert {r.object_id: r.score for r in run.mappings.collect()} == {"http://a/2": 1, "http://a/1": 2}
    assert run.violations.count() == 0


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
