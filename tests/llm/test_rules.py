from collections import Counter

from termloom.llm import rules
from tests.llm.helpers import corpus, nothing, odd_corpus, plain_words


def expected(text):
    own = plain_words(text)
    text = text or ""
    found = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
    covered = {j for i in range(len(own) - 4) if found[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if plain_words(x)]
    symbols = sum(c in rules.SYMBOLS for c in text)
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_are_those_of_a_plain_loop(spark):
    docs = corpus(spark)
    extra = ["a b c d e a b c d e", "x\nx\n \n\nx y", "a a a a a a a", "# $%&* |<> 1\n😀 é"]
    docs = docs.unionByName(
        spark.createDataFrame([(1000 + i, t, None, None, 0) for i, t in enumerate(extra)], docs.schema)
    )
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rules.apply_rules(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == expected(text[r.doc_id]), r.doc_id
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_odd_rows_and_no_rows(spark):
    odd = odd_corpus(spark)
    found = rules.apply_rules(odd)
    assert found.count() == odd.count() and found.filter("doc_id = 2").distinct().count() == 1
    assert found.filter("doc_id IS NULL").count() == 1
    assert rules.apply_rules(nothing(spark)).collect() == []


def test_each_threshold_can_fail_alone(spark):
    cases = {
        "length": "one two",
        "word_length": " ".join(f"{'w' * 30}{i}" for i in range(12)),
        "symbols": " ".join(f"{i}$$$" for i in range(12)),
        "lines": "\n".join(f"line {i % 3}" for i in range(12)),
        "stop_words": " ".join(f"zq{i}" for i in range(120)),
    }
    docs = spark.createDataFrame([(n, t) for n, t in cases.items()], "doc_id string, text string")
    failed = {r.doc_id: r.failed_rules.split(",") for r in rules.apply_rules(docs).collect()}
    assert all(name in failed[name] for name in cases)


def test_one_projection_without_python_or_shuffle(spark):
    plan = rules.apply_rules(corpus(spark))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
