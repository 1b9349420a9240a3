"""Language identification with interpolated Kneser-Ney character models.

Texts become streams of lower-cased letters with one blank for everything between them. Each
language gets a model of order ``ORDER`` with absolute discounts: the highest order uses counts,
lower orders count distinct left extensions. The n-grams of all languages lie in one sorted array
of 64-bit hashes per order, with a row of interpolated log probabilities, one per language; a
second array holds the contexts with their back-off weights. A text gets the language with the
lowest cross-entropy per letter, and is rejected if that is far above what calibration texts show.

The models are fitted on a bounded sample: about ``SAMPLE_BYTES`` of text for each language, whole
texts, drawn by a hash of the document. All documents are scored, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.sharing import share, shared
from termloom.llm.text_arrays import mix, pieces, ranges, text_buffer, text_of, windows
from termloom.session import materialize

ORDER = 4
SAMPLE_BYTES = 3_000_000  # for each language
CALIBRATION = 0.15  # share of the sample that is kept from counting
_BATCH = 1 << 20
_BLANK = 0x20
_GRAMS = "lang string, gram string, n long"
_SCORES = "doc_id long, best int, score double, cross_entropy double, rejected boolean"


def letter_table() -> np.ndarray:
    """Lower-cased letter of each code point of the basic plane; 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            table[i] = i
    return table


def streams(column, table: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks of each text behind ``order - 1`` blanks, and where texts begin."""
    data, offsets = text_buffer(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = heads[offsets]
    low = np.where(points < 1 << 16, table[points & 0xFFFF], points)
    gap = low == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    starts = first[:-1][first[1:] > first[:-1]]
    keep[starts] = ~gap[starts]  # the padding already is a blank
    kept = np.concatenate([[0], np.cumsum(keep)])
    sizes = kept[first[1:]] - kept[first[:-1]]
    begin = np.concatenate([[0], np.cumsum(sizes + order - 1)])
    out = np.full(begin[-1], _BLANK, np.uint32)
    body = np.where(gap, _BLANK, low)[keep]
    out[ranges(begin[:-1] + order - 1, sizes)] = body
    return out, begin


def _grams(order: int):
    """Counts of n-grams in each language's texts."""

    def run(batches):
        table = letter_table()
        for batch in batches:
            for part in pieces(batch, _BATCH):
                stream, begin = streams(part.column("text"), table, order)
                langs = part.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    own = np.flatnonzero(np.array([x == lang for x in langs]))
                    sizes = np.diff(begin)[own] - order + 1
                    at = ranges(begin[own], sizes)
                    rows = np.stack([stream[at + j] for j in range(order)], 1)
                    rows, n = np.unique(rows, axis=0, return_counts=True)
                    text = np.ascontiguousarray(rows.astype("<u4")).view(f"<U{order}").reshape(-1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(text.tolist(), pa.string()), pa.array(n)],
                        ["lang", "gram", "n"],
                    )

    return run


class SortedHashes:
    """A sorted array of hashes; a directory of their first bits makes a lookup a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, min(22, int(len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        edges = np.arange((1 << bits) + 1, dtype=np.uint64)
        self.first = np.searchsorted(keys >> self.shift, edges).astype(np.int32)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        if not len(self.keys):
            return np.full(len(values), -1, np.int64)
        bucket = (values >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        out = np.full(len(values), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], values[open_]
        while len(open_):
            same = self.keys[at] == wanted
            out[open_[same]] = at[same]
            at = at + 1
            left = ~same & (at < end)
            open_, at, end, wanted = open_[left], at[left], end[left], wanted[left]
        return out


@dataclass
class Model:
    """Languages, and for each order the n-grams and contexts with a column per language."""

    langs: list[str]
    order: int
    grams: list  # of order k: SortedHashes
    values: list  # log2 probabilities
    contexts: list  # of order k: SortedHashes of k - 1 letters
    weights: list  # log2 back-off weights
    floor: np.ndarray  # log2 probability of an unseen letter
    centre: np.ndarray = None  # mean cross-entropy of calibration texts
    spread: np.ndarray = None  # its variance between texts, and for one letter
    limit: float = math.inf
    sharpness: float = 1.0

    def entropies(self, column, table) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per letter of each text under each language, and letters."""
        stream, begin = streams(column, table, self.order)
        sizes = np.diff(begin) - self.order + 1
        at = ranges(begin[:-1] + self.order - 1, sizes)  # the letters to predict
        total = np.zeros((len(at), len(self.langs)), np.float32)
        open_ = np.arange(len(at))
        for k in range(self.order, 0, -1):
            if not len(open_):
                break
            keys = windows(stream, k)[at[open_] - k + 1]
            index = self.grams[k - 1].find(keys)
            hit = index >= 0
            total[open_[hit]] += self.values[k - 1][index[hit]]
            open_ = open_[~hit]
            if k > 1 and len(open_):
                index = self.contexts[k - 1].find(windows(stream, k - 1)[at[open_] - k + 1])
                seen = index >= 0
                total[open_[seen]] += self.weights[k - 1][index[seen]]
        total[open_] += self.floor
        edges = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.zeros((len(sizes), len(self.langs)))
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(total, edges[full], axis=0, dtype=np.float64)
        return -sums / np.maximum(sizes, 1)[:, None], sizes

    def judge(self, entropy: np.ndarray, sizes: np.ndarray):
        """Best language, confidence in 0..1 and rejection of each text."""
        best = entropy.argmin(axis=1)
        rows = np.arange(len(best))
        least = entropy[rows, best]
        lead = (entropy - least[:, None]) * np.maximum(sizes, 1)[:, None] * self.sharpness
        chance = 1 / np.exp2(-np.minimum(lead, 60)).sum(axis=1)
        strange = self.strangeness(least, sizes, best)
        return best, chance * np.minimum(1, np.exp2(1 - strange / max(self.limit, 1e-9))), strange > self.limit

    def strangeness(self, least, sizes, best):
        """By how many deviations the cross-entropy is above the calibration texts'."""
        between, within = self.spread[best].T
        return (least - self.centre[best]) / np.sqrt(between + within / np.maximum(sizes, 1))


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney models from the n-grams (rows of code points) of each language."""
    langs = sorted(counts)
    alphabet = np.unique(np.concatenate([rows[:, -1] for rows, _ in counts.values()]))
    grams, values, contexts, weights = [], [], [], []
    floor, lower = None, None
    for k in range(1, order + 1):
        tables = []
        for lang in langs:
            rows, n = counts[lang]
            if k < order:  # distinct left extensions
                longer = np.unique(rows[:, -k - 1 :], axis=0)
                own, n = np.unique(longer[:, 1:], axis=0, return_counts=True)
            else:
                own = rows
            tables.append((own, n))
        union = np.unique(np.concatenate([t[0] for t in tables]), axis=0)
        keys = _row_hashes(union)
        order_of = np.argsort(keys)
        union, keys = union[order_of], keys[order_of]
        heads = np.unique(union[:, :-1], axis=0)
        head_keys = _row_hashes(heads) if k > 1 else np.zeros(1, np.uint64)
        head_order = np.argsort(head_keys)
        head_keys = head_keys[head_order]
        index, head_index = SortedHashes(keys), SortedHashes(head_keys)
        if k == 1:
            base = np.full((len(union), len(langs)), -math.log2(len(alphabet) + 1))
        else:
            base = lower[0][lower[1].find(_row_hashes(union[:, 1:]))]
        out, back = np.empty(base.shape), np.zeros((len(head_keys), len(langs)))
        of_head = head_index.find(_row_hashes(union[:, :-1])) if k > 1 else np.zeros(len(union), np.int64)
        for j, (own, n) in enumerate(tables):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            seen = np.zeros(len(union))
            seen[index.find(_row_hashes(own))] = n
            total = np.bincount(of_head, seen, len(head_keys))
            kinds = np.bincount(of_head, seen > 0, len(head_keys))
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            part = np.where(total[of_head] > 0, np.maximum(seen - discount, 0) / np.maximum(total[of_head], 1), 0)
            out[:, j] = np.log2(part + rest[of_head] * np.exp2(base[:, j]))
            back[:, j] = np.log2(rest)
        if k == 1:
            floor = (back[0] - math.log2(len(alphabet) + 1)).astype(np.float32)
        lower = out, index
        grams.append(index)
        values.append(out.astype(np.float32))
        contexts.append(head_index)
        weights.append(back.astype(np.float32))
    return Model(langs, order, grams, values, contexts, weights, floor)


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """As ``windows``, for rows of letters."""
    total = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        total *= np.uint64(0xD1342543DE82EF95)
        total += rows[:, j]
    return mix(total, rows.shape[1])


def _calibrate(model: Model):
    def run(batches):
        table = letter_table()
        place = {lang: i for i, lang in enumerate(model.langs)}
        for batch in batches:
            for part in pieces(batch, _BATCH):
                # A language whose texts have no letters has no model and no calibration.
                part = part.filter(pc.is_in(part.column("lang"), pa.array(model.langs, pa.string())))
                if not part.num_rows:
                    continue
                entropy, sizes = model.entropies(part.column("text"), table)
                own = np.array([place[x] for x in part.column("lang").to_pylist()], int)
                other = entropy.copy()
                rows = np.arange(len(own))
                other[rows, own] = np.inf
                lead = other.min(axis=1) if len(model.langs) > 1 else np.full(len(own), 1e9)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(entropy[rows, own]), pa.array(lead), pa.array(sizes)],
                    ["own", "h", "other", "n"],
                )

    return run


def fit(
    docs: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES,
    text: str = "text", lang: str = "lang", id: str = "doc_id",
) -> Model | None:
    """Models of all languages in ``lang``; None if no text has one.

    Rows without text or language teach nothing. The sample of a language is about
    ``sample_bytes`` of whole texts, a share of them kept aside to calibrate; a language of which
    that would count no text is learned from its first one by hash, however long.
    """
    rows = docs.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
        (F.pmod(F.xxhash64(F.lit("language"), F.col(id)), F.lit(1 << 30)) / (1 << 30)).alias("u"),
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.min("u").alias("least"))
    rates = sizes.select(
        "lang", "least", F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest("b", F.lit(1))).alias("rate")
    )
    edge = (1 - CALIBRATION) * F.col("rate")
    only = (F.col("u") == F.col("least")) & (F.col("least") >= edge)
    sample = materialize(
        rows.join(F.broadcast(rates), "lang").filter((F.col("u") < F.col("rate")) | only).select(
            "lang", "text", ((F.col("u") >= edge) & ~only).alias("held")
        ),
        "sample",
    )
    counted = sample.filter("NOT held").select("lang", "text").mapInArrow(_grams(order), _GRAMS)
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for name, own in found.groupby("lang", sort=True):
        text_rows = np.array(own["gram"].tolist(), f"<U{order}")
        rows_of = text_rows.view("<u4").reshape(-1, order)
        counts[name] = (rows_of, own["n"].to_numpy(np.int64))
    if not counts:
        return None
    model = estimate(counts, order)
    kept = sample.filter("held").select("lang", "text").mapInArrow(
        _calibrate(model), "own long, h double, other double, n long"
    ).filter("n > 0").toPandas()
    size = len(model.langs)
    model.centre, model.spread = np.full(size, 4.0), np.tile([0.04, 8.0], (size, 1))
    for j in range(size):
        own = kept[(kept["own"] == j) & (kept["n"] >= 50)]
        if len(own) >= 20:
            # Copies of one text would hide the spread, so it keeps a floor.
            model.centre[j] = np.median(own["h"])
            model.spread[j, 0] = max(float(np.median(np.abs(own["h"] - model.centre[j]))) ** 2 * 2.2, 0.01)
    if len(kept):
        own = kept["own"].to_numpy()
        strange = model.strangeness(kept["h"].to_numpy(), kept["n"].to_numpy(), own)
        # Twice what all but one in 500 calibration texts reach, and not under twelve deviations.
        model.limit = max(12.0, 2 * float(np.quantile(strange, 0.998)))
        lead = ((kept["other"] - kept["h"]) * kept["n"]).to_numpy()
        model.sharpness = _sharpness(lead)
    else:
        model.limit = 12.0
    return model


def _sharpness(lead: np.ndarray) -> float:
    """Factor of the log odds under which they fit the share of right answers best."""
    best, least = 1.0, math.inf
    for factor in (1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05):
        loss = float(np.logaddexp2(0, -np.clip(lead * factor, -200, 200)).mean())
        if loss < least - 1e-12:
            best, least = factor, loss
    return best


def _identify(data, text):
    def run(batches):
        model, table = shared(data), letter_table()
        for batch in batches:
            for part in pieces(batch, _BATCH, text):
                entropy, sizes = model.entropies(text_of(part, text), table)
                best, score, rejected = model.judge(entropy, sizes)
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                yield pa.RecordBatch.from_pydict(
                    columns | {
                        "best": pa.array(best, pa.int32()),
                        "score": pa.array(np.where(sizes > 0, score, 0.0)),
                        "cross_entropy": pa.array(entropy.min(axis=1)),
                        "rejected": pa.array(rejected | (sizes == 0)),
                    }
                )

    return run


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``row`` (the document's own columns), ``lang_pred``, ``score``, ``cross_entropy``, ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if
    there is no model. Ties go to the language whose name is first. Any length is scored whole.
    """
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # A text travels once, within its row.
    rows = docs.select(F.struct("*").alias("row"), letters.alias("letters"))
    if model is None:
        return rows.select(
            "row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"),
        )
    data = share(docs.sparkSession, model)
    schema = T.StructType([*rows.schema.fields]).add("best", "integer").add("score", "double")
    schema = schema.add("cross_entropy", "double").add("rejected", "boolean")
    found = rows.mapInArrow(_identify(data, f"row.{text}"), schema)
    name = F.array(*[F.lit(x) for x in model.langs])[F.col("best")]
    return found.select(
        "row",
        F.when(F.col("letters"), name).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        "cross_entropy",
        (F.col("rejected") | ~F.col("letters")).alias("rejected"),
    )


def fold(id: str | Column, folds: int) -> Column:
    """crc32 of the number as text, modulo ``folds``; a null id is in fold 0."""
    number = F.col(id) if isinstance(id, str) else id
    return F.coalesce(F.crc32(number.cast("string")) % folds, F.lit(0))


def keep_known_languages(docs: DataFrame, **options) -> DataFrame:
    """Documents whose language is recognised; models are learned from three quarters of them."""
    model = fit(docs.filter(fold("doc_id", 4) != 2), **options)
    return identify(docs, model).filter("NOT rejected").select("row.*")
