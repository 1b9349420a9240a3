"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length.

Folding is one character for one: lower case, Latin letters for Greek and Cyrillic look-alikes, and
letters for the digits and signs that stand for them. Accents can be part of what makes a word
toxic, so texts beyond ASCII are read twice, with and without them; the second reading counts for
the seeds only. A match has to begin at a
word's start and, but for stems, end at its end. Exception phrases are patterns of the same
automaton; a match inside one does not count.

The lexicon is a list of seeds and what labelled texts teach: words, and stems of words, that toxic
texts have and others do not, with the logarithm of their odds as weight.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.learners import class_share, labelled_sample, logistic, sigmoid
from termloom.llm.sharing import share, shared
from termloom.llm.text_arrays import pieces

SAMPLE_ROWS = 6_000  # of each class
LEXICON = 20_000  # learned patterns at most, the heaviest
STEMS = (3, 8)  # lengths of stems
LEAST_TEXTS, LEAST_WEIGHT = 5, 2.5
_BATCH = 4 << 20

#: Insults and threats of general use, with their weights.
SEEDS = {
    "idiot": 3.0, "idiots": 3.0, "moron": 3.0, "morons": 3.0, "stupid": 2.5, "scum": 3.0,
    "loser": 2.5, "losers": 2.5, "pathetic": 2.5, "worthless": 2.5, "disgusting": 2.5,
    "trash": 2.5, "clown": 2.5, "imbecile": 3.0, "retard": 3.5, "bastard": 3.0, "asshole": 3.5,
    "bitch": 3.0, "shit": 2.5, "fuck": 3.0, "fucking": 3.0, "kill yourself": 4.0,
    "shut up": 2.0, "hate you": 3.0, "dumbass": 3.0, "vermin": 2.5, "subhuman": 3.5,
}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = [
    "trash can", "trash bin", "trash bag", "clown fish", "clownfish", "circus clown",
    "pathetic fallacy", "bad loser", "pond scum", "shit take", "not stupid",
]
#: Look-alikes of Latin letters, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухкмнтівјѕԁɡαεορτυικνηωβ", "aeopcyxkmhtibjsdgaeoptuikvnwb", strict=True))
SIGNS = dict(zip("0134578@$", "oieastbas", strict=True))

_WORD = re.compile(r"[^\W_][\w]*")


class Folding(dict):
    """Table for ``str.translate``; a character is folded when it is first met."""

    def __init__(self, plain: bool = False):
        self.plain = plain

    def __missing__(self, point: int) -> str:
        c = chr(point)
        low = c.lower() if len(c.lower()) == 1 else c
        low = LOOKALIKES.get(low, SIGNS.get(low, low))
        if self.plain and not low.isascii() and low.isalpha():
            bare = unicodedata.normalize("NFKD", low)
            low = bare[0] if all(unicodedata.combining(x) for x in bare[1:]) else low
        self[point] = low
        return low


def _patterns(batches):
    """Distinct folded words and stems of each text, with its label."""
    table = Folding()
    for batch in batches:
        names, marks = [], []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            folded = (text or "").translate(table)
            found = set(_WORD.findall(folded))
            own = {w + " " for w in found}
            for size in range(STEMS[0], STEMS[1] + 1):
                own.update(w[:size] for w in found if len(w) > size)
            names.extend(own)
            marks.extend([y] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.int32())], ["pattern", "y"])


@dataclass
class Model:
    """Patterns (a word ends in a blank, a stem does not) with weights, and the curve."""

    lexicon: dict[str, float]
    curve: np.ndarray

    def automata(self):
        """Automaton and folding of the first reading, and of the second."""
        blank, bare = Folding(), Folding(plain=True)
        seeds = {f"{w.translate(bare)} ": v for w, v in SEEDS.items()}
        return (_automaton(self.lexicon, blank), blank), (_automaton(seeds, bare), bare)


def _automaton(lexicon: dict[str, float], table: Folding):
    found = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for pattern, weight in lexicon.items():
        entry = entries.setdefault(pattern.rstrip(), [0.0, 0.0, False])
        entry[0 if pattern.endswith(" ") else 1] = weight
    for phrase in EXCEPTIONS:
        entries.setdefault(phrase.translate(table), [0.0, 0.0, False])[2] = True
    for word, (whole, stem, harmless) in entries.items():
        found.add_word(word, (len(word), whole, stem, harmless))
    found.make_automaton()
    return found


def measure(text: str, automata) -> tuple[float, float, int]:
    """Sum of the weights of the matches in a text, the heaviest, and the number of words.

    Of the patterns that begin at one word the heaviest counts; a match inside an exception phrase
    does not.
    """
    n = text.count(" ") + text.count("\n") + 1
    hits: dict[int, tuple[float, int]] = {}
    safe = []
    size = len(text)
    for automaton, table in automata[: 1 if text.isascii() else 2]:
        for last, (length, whole, stem, harmless) in automaton.iter(text.translate(table)):
            begin = last - length + 1
            if begin and text[begin - 1].isalnum():
                continue
            ends = last + 1 == size or not text[last + 1].isalnum()
            if harmless and ends:
                safe.append((begin, last))
            weight = max(whole if ends else 0.0, stem)
            if weight > hits.get(begin, (0.0, 0))[0]:
                hits[begin] = weight, last
    if safe:
        inside = set().union(*(range(p, q + 1) for p, q in safe))
        hits = {a: (w, b) for a, (w, b) in hits.items() if not (a in inside and b in inside)}
    weights = [w for w, _ in hits.values()]
    return sum(weights), max(weights, default=0.0), n


def _measure(lexicon: Model, schema_names: list[str]):
    def run(batches):
        automata = lexicon.automata()
        for batch in batches:
            for part in pieces(batch, _BATCH):
                found = [measure(t or "", automata) for t in part.column("text").to_pylist()]
                total, most, words = zip(*found, strict=True) if found else ((), (), ())
                columns = [part.column(c) for c in schema_names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(total, pa.float64()), pa.array(most, pa.float64()), pa.array(words, pa.int64())],
                    [*schema_names, "total", "most", "words"],
                )

    return run


def _inputs(total, most, words) -> np.ndarray:
    """What the curve sees: weight for each hundred words, the heaviest match, and the sum."""
    density = 100 * total / (words + 50.0)
    return np.column_stack([np.log1p(density), most / 4.0, np.log1p(total)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS):
    """Lexicon and curve, or the share of ones where the labels have one class only.

    Learned from about ``rows`` whole labelled texts of each class.
    """
    sample = labelled_sample(docs, labels, label, rows, "toxic")
    counts = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(counts) < 2:
        return class_share(labels, label)
    # Copies of a text count once, or one text could make its words toxic.
    once = sample.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    found = once.select("text", "y").mapInArrow(_patterns, "pattern string, y int")
    totals = {r.y: r["count"] for r in once.groupBy("y").count().collect()}
    a, b = totals.get(1, 0) + 1, totals.get(0, 0) + 1
    table = (
        found.groupBy("pattern").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
        .filter(F.col("p") >= LEAST_TEXTS)
        .withColumn("w", F.log((F.col("p") + 0.5) / a) - F.log((F.col("q") + 0.5) / b))
        .filter(F.col("w") >= LEAST_WEIGHT + F.log1p(F.col("q")))
        .orderBy(F.desc("w"), "pattern").limit(LEXICON)
    )
    blank = Folding()
    lexicon = {f"{w.translate(blank)} ": v for w, v in SEEDS.items()}
    for r in table.collect():
        lexicon[r.pattern] = max(r.w, lexicon.get(r.pattern, 0.0))
    model = Model(lexicon, np.zeros(4))
    kept = sample.select("text", "y", "weight").mapInArrow(
        _measure(model, ["y", "weight"]), "y int, weight double, total double, most double, words long"
    ).toPandas()
    x = _inputs(kept["total"].to_numpy(), kept["most"].to_numpy(), kept["words"].to_numpy())
    weight = kept["weight"].to_numpy(float)
    model.curve = logistic(x, kept["y"].to_numpy(float), weight / weight.mean(), ridge=0.1)
    return model


def _score(data):
    def run(batches):
        model = shared(data)
        for batch in _measure(model, ["doc_id"])(batches):
            total, most, words = (batch.column(c).to_numpy() for c in ("total", "most", "words"))
            score = sigmoid(_inputs(total, most, words) @ model.curve[:-1] + model.curve[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of each document, whole texts, in one pass without a shuffle.

    A null or empty text has no match and gets the least score the curve gives. Where there is no
    model every score is the share of ones.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    if not isinstance(model, Model):
        return rows.select("doc_id", F.lit(float(model)).alias("score"))
    data = share(docs.sparkSession, model)
    return rows.mapInArrow(_score(data), "doc_id long, score double")
