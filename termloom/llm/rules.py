"""Quality rules: one table of thresholds, compiled into one projection without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD_BYTE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in that is for it as with be was on by this are or "
    "der die das und in zu den mit von ist ein eine auf für im des "
    "le la les de des du et en un une que qui dans pour sur "
    "el los las y se del por con para una su al es"
).split()

#: name, measure, least and greatest value, and the number of words from which the rule holds.
THRESHOLDS: list[tuple[str, str, float | None, float | None, int]] = [
    ("length", "n_words", 10, None, 0),
    ("repeats", "repeat_share", None, 0.2, 0),
    ("word_length", "mean_word", 2, 15, 0),
    ("symbols", "symbol_share", None, 0.25, 0),
    ("lines", "dup_line_share", None, 0.5, 0),
    ("stop_words", "stop_share", 0.02, None, 100),
]


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not once for each element of a lambda."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Number of words inside a window of five words that the text has twice or more.

    A text whose windows all differ has none. Else windows are sorted by fingerprint, so equal
    ones are neighbours; the starts of those are put back in order, and each adds as many words
    as it does not share with the one before.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
            ),
            lambda acc: acc["n"],
        )

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        found = _bind(
            F.sort_array(pairs),
            lambda s: _bind(F.struct(s["h"].alias("h"), s["i"].alias("i"), F.size(s).alias("n")), places),
        )
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0))

    def places(s: Column) -> Column:
        def same(k: Column) -> Column:
            here = F.get(s["h"], k)
            return F.coalesce(here == F.get(s["h"], k - 1), F.lit(False)) | F.coalesce(
                here == F.get(s["h"], k + 1), F.lit(False)
            )

        hit = F.filter(F.sequence(F.lit(0), s["n"] - 1), same)
        return _bind(F.sort_array(F.transform(hit, lambda k: F.get(s["i"], k))), covered)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )
    return F.when(F.size(words) > WINDOW, _bind(hashes, count)).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the counts that the rules use; a null text counts as empty."""
    known = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]

    def of(text: Column) -> Column:
        words = F.array_remove(F.split(text, SPACE), "")
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_BYTE))

        def counted(words: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: w.isin(known))).cast("long").alias("n_stop"),
            )

        def by_line(lines: Column) -> Column:
            return F.struct(
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            )

        symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
        return F.struct(
            _bind(words, counted).alias("w"),
            _bind(lines, by_line).alias("l"),
            F.when(text.rlike(f"[{SYMBOLS}]"), symbols).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
        )

    return _bind(F.coalesce(text, F.lit("")), of)


def apply_rules(
    docs: DataFrame, thresholds=THRESHOLDS, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``kept`` and ``failed_rules``.

    Words are runs of bytes other than ASCII white space. A null or empty text has no words and
    fails. Repeated documents are judged alike, each row on its own; other columns are not read.
    The table of thresholds becomes one projection: there is no shuffle and no user function.
    """
    m = docs.select(F.col(id).alias("doc_id"), measures(F.col(text)).alias("m"))
    n, chars = F.col("m.w.n_words"), F.col("m.w.word_chars")
    value = {
        "n_words": n,
        "repeat_share": F.col("m.w.n_repeat_words") / F.greatest(n, F.lit(1)),
        "mean_word": chars / F.greatest(n, F.lit(1)),
        "symbol_share": F.col("m.n_symbols") / F.greatest(chars, F.lit(1)),
        "dup_line_share": F.col("m.l.n_dup_lines") / F.greatest(F.col("m.l.n_lines"), F.lit(1)),
        "stop_share": F.col("m.w.n_stop") / F.greatest(n, F.lit(1)),
    }
    rules = []
    for name, measure, least, most, words in thresholds:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (value[measure] < least)
        if most is not None:
            bad = bad | (value[measure] > most)
        rules.append(F.when(bad & (n >= words), F.lit(name)))
    failed = F.filter(F.array(*rules), lambda r: r.isNotNull())
    base = (n < 10) | (100 * F.col("m.w.n_repeat_words") > 20 * n)
    return m.select(
        "doc_id",
        n.alias("n_words"),
        chars.alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )
