import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import quality_classifier as Q
from termloom.llm import toxicity as X
from termloom.llm.learners import dual_coordinate_descent, logistic
from tests.llm.helpers import corpus, nothing, odd_corpus, sentence


def labelled(spark, n=300):
    import random

    draw = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 1, i % 5 == 2
        text = sentence(draw, draw.randint(20, 60))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            words = text.split()
            words[3], words[9] = "grumbol", "Grumbolix"
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled(spark)
    return docs.cache(), labels.cache()


@pytest.mark.parametrize("operator, label, limit", [(Q, "quality", 0.7), (X, "toxic", 0.5)])
def test_held_out_rows_are_told_apart(tables, operator, label, limit):
    docs, labels = tables
    held = F.col("doc_id") % 3 == 0
    model = operator.fit(docs.filter(~held), labels.filter(~held), label)
    found = operator.score(docs.filter(held), model).join(labels, "doc_id").collect()
    assert len(found) == 100 and all(0 <= r.score <= 1 for r in found)
    right = sum((r.score >= limit) == bool(r[label]) for r in found)
    assert right >= 97


@pytest.mark.parametrize("operator, label", [(Q, "quality"), (X, "toxic")])
def test_odd_rows_and_missing_labels(spark, tables, operator, label):
    docs, labels = tables
    model = operator.fit(docs, labels, label)
    odd = odd_corpus(spark)
    found = operator.score(odd, model)
    assert found.count() == odd.count() and found.filter("score IS NULL OR isnan(score)").count() == 0
    assert found.filter("doc_id = 2").distinct().count() == 1
    assert operator.score(nothing(spark), model).collect() == []
    assert operator.fit(docs, labels.limit(0), label) == 0.5
    one = operator.fit(docs, labels.filter(F.col(label) == 1), label)
    assert operator.score(corpus(spark), one).select("score").distinct().collect()[0][0] == 1.0
    odd_labels = labels.unionByName(
        spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 7, 7), (3, 1, 1)], labels.schema)
    )
    assert not isinstance(operator.fit(docs, odd_labels, label), float)


@pytest.mark.parametrize(
    "text, hit",
    [
        ("you are an idiot", True), ("you 1d10t!", True), ("an ІDІОТ (Cyrillic letters)", True),
        ("put it in the trash can now", False), ("the trash canal", True), ("an ídiot", True),
        ("idiotic", False), ("xidiot", False), ("idiot$$$ is here", True), ("", False), ("42 0 1", False),
    ],
)
def test_folding_borders_and_exceptions(text, hit):
    blank = X.Folding()
    model = X.Model({f"{w.translate(blank)} ": v for w, v in X.SEEDS.items()}, np.zeros(4))
    assert (X.measure(text, model.automata())[0] > 0) == hit


def test_stems_match_longer_words_and_the_heaviest_counts():
    model = X.Model({"grumbol": 3.0, "grumbolix ": 5.0}, np.zeros(4))
    total, most, _ = X.measure("a grumbolix grumbolesk agrumbol", model.automata())
    assert total == 8.0 and most == 5.0


def test_dual_coordinate_descent_reaches_the_optimum():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(80, 3))
    y = np.sign(x @ [1.0, -2.0, 0.5] + 0.3 * draw.normal(size=80))
    cost = np.full(80, 0.7)
    rows = [(np.arange(3), r) for r in x]
    w = dual_coordinate_descent(rows, y, 3, cost, rounds=500, tolerance=1e-6)

    def primal(w):
        return w @ w / 2 + cost @ np.maximum(0, 1 - y * (x @ w[:3] + w[3]))

    best = primal(w)
    for _ in range(300):
        assert primal(w + draw.normal(scale=0.01, size=4)) >= best - 1e-4


def test_logistic_fits_the_shares():
    x = np.array([[0.0]] * 100 + [[1.0]] * 100)
    y = np.array([1] * 20 + [0] * 80 + [1] * 70 + [0] * 30)
    beta = logistic(x, y, np.ones(200), ridge=1e-9)
    assert 1 / (1 + np.exp(-beta[1])) == pytest.approx(0.2, abs=1e-6)
    assert 1 / (1 + np.exp(-beta.sum())) == pytest.approx(0.7, abs=1e-6)


def naive_measure(text, lexicon):
    """Every pattern at every position of both readings."""
    hits, safe = {}, []
    readings = [(lexicon, X.Folding())]
    if not text.isascii():
        bare = X.Folding(plain=True)
        readings.append(({f"{w.translate(bare)} ": v for w, v in X.SEEDS.items()}, bare))
    for patterns, table in readings:
        folded = text.translate(table)
        for begin in range(len(text)):
            if begin and text[begin - 1].isalnum():
                continue

            def ends(word, begin=begin):
                return begin + len(word) == len(text) or not text[begin + len(word)].isalnum()

            for pattern, weight in patterns.items():
                word = pattern.rstrip()
                if folded.startswith(word, begin) and (not pattern.endswith(" ") or ends(word)):
                    if (weight, len(word)) > hits.get(begin, (0.0, 0, 0))[:2]:
                        hits[begin] = (weight, len(word), begin + len(word) - 1)
            for phrase in X.EXCEPTIONS:
                word = phrase.translate(table)
                if folded.startswith(word, begin) and ends(word):
                    safe.append((begin, begin + len(word)))
    inside = {i for a, b in safe for i in range(a, b)}
    kept = [(w, begin) for begin, (w, _, last) in hits.items() if not (begin in inside and last in inside)]
    return sum(w for w, _ in kept), max((w for w, _ in kept), default=0.0), text.count(" ") + text.count("\n") + 1


def test_matches_are_those_of_a_scan_of_all_patterns():
    import random

    draw = random.Random(8)
    blank = X.Folding()
    lexicon = {f"{w.translate(blank)} ": v for w, v in X.SEEDS.items()} | {"grumb": 2.6, "grumbol ": 3.3, "zé ": 2.7}
    automata = X.Model(lexicon, np.zeros(4)).automata()
    words = ["idiot", "1d10t", "ídiot", "idіot", "trash", "can", "clown", "fish", "grumbol", "grumbolix", "Zé", "zé", "pathetic",
             "fallacy", "kill", "yourself", "k1ll", "not", "stupid", "st*pid", "word", "shut", "up", "fucking", "😀", "x"]
    for _ in range(400):
        text = draw.choice([" ", "\n", "-", ""]).join(draw.choices(words, k=draw.randint(0, 9))) + draw.choice(["", "!", " "])
        assert X.measure(text, automata) == pytest.approx(naive_measure(text, lexicon)), text


def test_margins_are_those_of_plain_dictionaries():
    import math
    import random
    from collections import Counter

    draw = random.Random(3)
    sets, y = [], []
    for i in range(120):
        own = {draw.randrange(40) for _ in range(8)} | ({50 + draw.randrange(5)} if i % 2 else {60 + draw.randrange(5)})
        sets.append(np.array(sorted(own), np.int32))
        y.append(i % 2)
    kept = np.zeros(len(y), bool)
    model = Q.train(sets, np.array(y), np.ones(len(y)), kept)
    counts = [Counter(int(f) for s, own in zip(sets, y, strict=True) if own == c for f in s) for c in (0, 1)]
    totals = [sum(c.values()) + Q.ALPHA * (1 << Q.BITS) for c in counts]
    ratio = {
        f: math.log((counts[1][f] + Q.ALPHA) / totals[1]) - math.log((counts[0][f] + Q.ALPHA) / totals[0])
        for f in set(counts[0]) | set(counts[1])
    }
    rows = []
    for s in sets:
        length = math.sqrt(sum(ratio[int(f)] ** 2 for f in s))
        rows.append((s, np.array([ratio[int(f)] / length for f in s])))
    sign = np.where(np.array(y) == 1, 1.0, -1.0)
    weights = dual_coordinate_descent(rows, sign, 1 << Q.BITS, Q.COST / np.ones(len(y)))
    for (s, value), _ in zip(rows, y, strict=True):
        plain = sum(float(weights[f]) * v for f, v in zip(s.tolist(), value.tolist(), strict=True)) + float(weights[-1])
        assert model.margin(s) == pytest.approx(plain, abs=1e-3)
    assert np.mean([(model.margin(s) > 0) == bool(c) for s, c in zip(sets, y, strict=True)]) > 0.95
