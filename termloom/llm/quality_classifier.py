"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes ratios.

Features are which n-grams a text has: runs of one to three bytes, words, and runs of one to three
word shapes (case, ending, symbols, length, and whether the word repeats one of the two before).
Each indicator is scaled by the logarithm of the ratio of its smoothed shares in the two classes,
texts are brought to unit length, and the dual of the hinge loss is solved coordinate by
coordinate. A logistic curve, fitted on rows kept from training, turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.learners import (
    class_share,
    dual_coordinate_descent,
    labelled_sample,
    logistic,
    sigmoid,
)
from termloom.llm.sharing import share, shared
from termloom.llm.text_arrays import PLAIN, mix, pieces, text_buffer, windows, words

SAMPLE_ROWS = 2_500  # of each class
KEPT = 0.25  # share of the sample for the curve
BITS = 18
ALPHA, COST = 1.0, 0.5
_BATCH = 2 << 20
_NGRAMS = 3


def _features(column):
    """Feature numbers of each text, with repeats."""
    data, offsets = text_buffer(column)
    found = words(data, offsets, PLAIN, lower=False)
    digest = found.hashes()
    shapes = _shapes(found, digest)
    flat = data.astype(np.uint64)
    groups = [(mix(digest, 9), found.first)]
    for k in range(1, _NGRAMS + 1):
        groups.append((windows(flat, k), offsets))
        groups.append((mix(windows(shapes, k), 3), found.first))
    kinds = [(values >> np.uint64(64 - BITS)).astype(np.int32) for values, _ in groups]
    reach = [0] + [k for k in range(1, _NGRAMS + 1) for _ in range(2)]
    for i in range(len(offsets) - 1):
        own = []
        for values, (_, first), k in zip(kinds, groups, reach, strict=True):
            own.append(values[first[i] : max(first[i], first[i + 1] - max(k, 1) + 1)])
        yield own


def _shapes(found, digest: np.ndarray) -> np.ndarray:
    """A small number for the looks of each word."""
    data, a, b = found.data, found.starts, found.ends
    if not len(a):
        return np.zeros(0, np.uint64)

    def count(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[b] - total[a]

    upper = (data >= 0x41) & (data <= 0x5A)
    letter = upper | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    symbols = np.isin(data, np.frombuffer(b"#$%&*|<>{}[]=_~^\\/", np.uint8))
    digits = (data >= 0x30) & (data <= 0x39)
    n_upper, n_letter = count(upper), count(letter)
    case = np.where(n_upper == 0, 0, np.where(n_upper >= np.maximum(n_letter, 2) * 0.6, 3, np.where(upper[a], 1, 2)))
    last = data[b - 1]
    ending = np.select([last == 0x21, last == 0x2E, last == 0x2C, ~letter[b - 1]], [1, 2, 3, 4], 0)
    size = np.searchsorted([4, 9, 15, 30], b - a)
    again = np.zeros(len(a), np.int64)
    again[1:] = digest[1:] == digest[:-1]
    again[2:] |= 2 * (digest[2:] == digest[:-2])
    code = case + 4 * ending + 20 * size + 100 * again + 400 * (count(symbols) > 0) + 800 * (count(digits) > 0)
    return code.astype(np.uint64) + np.uint64(1 << 32)


def _present(own: list[np.ndarray], flags: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of one text."""
    for values in own:
        flags[values] = True
    at = np.flatnonzero(flags)
    flags[at] = False
    return at


def _sets(batches):
    flags = np.zeros(1 << BITS, bool)
    for batch in batches:
        for part in pieces(batch, _BATCH):
            sets = [_present(own, flags).astype(np.int32).tobytes() for own in _features(part.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets, pa.binary()), part.column("y"), part.column("weight")], ["x", "y", "weight"]
            )


@dataclass
class Model:
    """Per feature the weight times its ratio, and the squared ratio for the length of a text."""

    gain: np.ndarray
    square: np.ndarray
    bias: float
    curve: np.ndarray

    def margin(self, at: np.ndarray) -> float:
        length = float(self.square[at].sum())
        return float(self.gain[at].sum()) / np.sqrt(length) + self.bias if length else self.bias


def train(sets: list[np.ndarray], y: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> Model:
    """Fit on the rows that are not ``kept`` and the curve on those that are."""
    size = 1 << BITS
    learn = np.flatnonzero(~kept)
    totals = np.full((2, size), ALPHA)
    for i in learn:
        totals[y[i], sets[i]] += 1
    ratio = np.log(totals[1] / totals[1].sum()) - np.log(totals[0] / totals[0].sum())
    ratio[(totals == ALPHA).all(axis=0)] = 0
    rows = []
    for i in learn:
        value = ratio[sets[i]]
        rows.append((sets[i], value / max(np.sqrt(value @ value), 1e-12)))
    sign = np.where(y[learn] == 1, 1.0, -1.0)
    share = (y[learn] == 1).mean()
    cost = COST / np.where(sign > 0, 2 * share, 2 * (1 - share))
    weights = dual_coordinate_descent(rows, sign, size, cost)
    model = Model(weights[:-1] * ratio, ratio * ratio, float(weights[-1]), np.array([2.0, 0.0]))
    rest = np.flatnonzero(kept)
    if len(set(y[rest])) == 2:
        margins = np.array([model.margin(sets[i]) for i in rest])
        model.curve = logistic(margins[:, None], y[rest], weight[rest] / weight[rest].mean(), ridge=0.1)
        model.curve[0] = max(model.curve[0], 0.1)  # a better margin is never a worse score
    model.gain, model.square = model.gain.astype(np.float32), model.square.astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS):
    """Model of the label, or its share of ones where the labels have one class only.

    The sample is about ``rows`` whole labelled texts of each class; an empty text has no features.
    """
    sample = labelled_sample(docs, labels, label, rows, "quality")
    found = sample.select("text", "y", "weight").mapInArrow(
        _sets, "x binary, y int, weight double"
    ).toPandas()
    y = found["y"].to_numpy(int)
    if len(set(y)) < 2:
        return class_share(labels, label)
    sets = [np.frombuffer(x, np.int32) for x in found["x"]]
    # Copies of a text share its part, or the curve would be fitted on texts it has seen.
    draw = np.array([(int(x[::7].sum()) * 2654435761 % (1 << 32)) / (1 << 32) for x in sets])
    kept = draw < KEPT
    if len(set(y[~kept])) < 2:
        kept[:] = False
    return train(sets, y, found["weight"].to_numpy(float), kept)


def _score(data):
    def run(batches):
        model = shared(data)
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            for part in pieces(batch, _BATCH):
                margins = [model.margin(_present(own, flags)) for own in _features(part.column("text"))]
                score = sigmoid(model.curve[0] * np.array(margins) + model.curve[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of each document, whole texts, in one pass without a shuffle.

    A null text scores as the empty one. Where there is no model every score is the share.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    if not isinstance(model, Model):
        return rows.select("doc_id", F.lit(float(model)).alias("score"))
    data = share(docs.sparkSession, model)
    return rows.mapInArrow(_score(data), "doc_id long, score double")
