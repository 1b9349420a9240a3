"""Re-ranking of the first candidates by a text model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.ordering import top_by
from termloom.operators.plugins import RANK_TEMPLATE, TextClient, call_client, rank_prompt
from termloom.operators.terms import last_content

CANDIDATES = 3


def _entries(scores: DataFrame, target_content: DataFrame, n: int) -> DataFrame:
    """``source, entries``: the ``n`` best targets in order, each with score and passage."""
    once = scores.groupBy("source", "target").agg(F.max("score").alias("score"))
    first = top_by(once, ["source"], [F.desc("score"), F.asc("target")], n)
    texts = last_content(target_content).withColumnRenamed("id", "target")
    text = F.coalesce("content", F.lit(""))
    passage = F.concat(F.lit("["), F.col("target"), F.lit("] "), text, F.lit("\n"))
    entry = F.struct(
        (-F.col("score")).alias("key"), F.col("target"), F.col("score"), passage.alias("passage")
    )
    return first.join(texts, "target", "left").groupBy("source").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )


def _passages(entries: str) -> Column:
    return F.array_join(F.transform(entries, lambda e: e["passage"]), "\n").alias("passages")


def assemble_candidates(
    scores: DataFrame, target_content: DataFrame, n: int = CANDIDATES
) -> DataFrame:
    """``source, passages, candidates``: the ``n`` best targets of each source with their texts.

    A passage is ``[id] content``; passages are separated by a blank line. Rows beyond ``n`` are
    dropped before the join, so the lists stay short. A pair with several scores counts with the
    best, and a target with several contents has the greatest.
    """
    return _entries(scores, target_content, n).select(
        "source",
        _passages("entries"),
        F.transform(
            "entries", lambda e: F.struct(e["target"].alias("target"), e["score"].alias("score"))
        ).alias("candidates"),
    )


def covering_windows(k: int, n: int) -> list[list[int]]:
    """Few windows of at most ``n`` of ``k`` places, so that each two places share one.

    A window starts with the first pair that has none yet and takes the places that add most pairs.
    """
    if k <= max(n, 1):
        return [list(range(k))] if k else []
    if n < 2:
        raise ValueError("a window needs two places")
    missing = {(a, b) for a in range(k) for b in range(a + 1, k)}
    windows = []
    while missing:
        window = list(min(missing))
        while len(window) < n:
            rest = [c for c in range(k) if c not in window]
            window.append(max(rest, key=lambda c: (sum((min(c, w), max(c, w)) in missing for w in window), -c)))
        window.sort()
        missing -= {(a, b) for i, a in enumerate(window) for b in window[i + 1 :]}
        windows.append(window)
    return windows


def assemble_windows(
    scores: DataFrame, target_content: DataFrame, k: int = 10, n: int = CANDIDATES
) -> DataFrame:
    """``source, window, passages, candidates``: all ``k`` best targets in overlapping windows.

    A model that orders ``n`` passages at a time thus compares each two of the ``k`` at least once,
    all windows at the same time. ``candidates`` also holds each target's ``place`` by similarity.
    A source with fewer targets has the windows of as many; a single one is a window of its own.
    """
    plans = F.array(*[F.array(*[F.array(*[F.lit(i) for i in w]) for w in covering_windows(m, n)]) for m in range(1, k + 1)])
    entries = _entries(scores, target_content, k)
    windows = entries.select("source", "entries", F.posexplode(F.element_at(plans, F.size("entries"))).alias("window", "own"))
    picked = windows.select(
        "source", "window", F.transform("own", lambda i: F.col("entries")[i]).alias("picked"), "own"
    )
    candidate = lambda e, i: F.struct(
        e["target"].alias("target"), e["score"].alias("score"), F.col("own")[i].alias("place")
    )
    return picked.select("source", "window", _passages("picked"), F.transform("picked", candidate).alias("candidates"))


def render_rank_prompt(
    candidates: DataFrame, sources: DataFrame, template: str = RANK_TEMPLATE
) -> DataFrame:
    """Add ``prompt``; ``sources`` is the source term table with its ``content``."""
    terms = sources.select(F.col("id").alias("source"), "name", "aka", "content")
    prompt = rank_prompt(
        F.col("name"), F.col("aka"), F.col("content"), F.col("passages"), template
    )
    return candidates.join(terms, "source").select(
        *candidates.columns, prompt.alias("prompt")
    )


def rank_with_model(prompts: DataFrame, client: TextClient) -> DataFrame:
    """Replace ``prompt`` by the model's ``reply``."""
    return call_client(prompts, "prompt", "reply", client, "string")


def rank_from_reply(replies: DataFrame) -> DataFrame:
    """``source, target, rank, score`` from ``source, candidates, reply``.

    Candidates follow the first position of their id in the trimmed reply. An id that is not
    there comes after the whole reply; equal positions keep the order of similarity.
    """
    order = Window.partitionBy("source").orderBy("position", "place")
    return _positions(replies, "source").select(
        "source", "target", F.row_number().over(order).alias("rank"), "score"
    )


def _positions(replies: DataFrame, *kept: str) -> DataFrame:
    """Each candidate with the first position of its id in the reply, or one beyond the reply."""
    rows = replies.select(*kept, F.trim("reply").alias("reply"), F.posexplode("candidates").alias("place", "c"))
    reply = F.coalesce("reply", F.lit(""))
    found = F.position(F.col("c.target"), reply)
    return rows.select(
        *kept, "place", "c", "c.target", "c.score",
        F.when(found == 0, F.length(reply) + 1).otherwise(found).alias("position"),
    )


def rank_from_windows(replies: DataFrame) -> DataFrame:
    """``source, target, rank, score`` from the replies to ``assemble_windows``.

    Within a window candidates stand as in ``rank_from_reply``. The windows are a tournament: of
    two candidates that one wins which stands before the other in more of their windows, both get
    half a point if none does, and ties of points go to similarity. With one window that is its own
    order, and a model that keeps one order is followed in full. Pairs are formed within windows,
    so there are as many rows per source as two of ``k`` places, whatever the number of targets.
    """
    entry = F.struct("position", "place", "target", "score")
    ordered = _positions(replies, "source", "window").withColumn("place", F.col("c.place")).groupBy("source", "window").agg(
        F.array_sort(F.collect_list(entry)).alias("o")
    )
    pairs = F.flatten(F.transform("o", lambda x, i: F.transform(
        F.slice("o", i + 2, F.size("o")), lambda y: F.struct(
            F.least(x["place"], y["place"]).alias("a"), F.greatest(x["place"], y["place"]).alias("b"),
            F.when(x["place"] < y["place"], 1).otherwise(-1).alias("vote"),
        )
    )))
    met = ordered.select("source", F.explode(pairs).alias("p")).groupBy("source", "p.a", "p.b").agg(
        F.signum(F.sum("p.vote")).alias("vote")
    )
    points = F.explode(F.array(
        F.struct(F.col("a").alias("place"), (1 + F.col("vote")).alias("points")),
        F.struct(F.col("b").alias("place"), (1 - F.col("vote")).alias("points")),
    ))
    won = met.select("source", points.alias("x")).select("source", "x.place", "x.points")
    # Each candidate once, with no points of its own, so that a single one is there, too.
    each = ordered.select("source", F.explode("o").alias("x")).select("source", "x.place", "x.target", "x.score")
    none = F.lit(None)
    totals = (
        each.withColumn("points", F.lit(0.0))
        .unionByName(won.select("*", none.cast("string").alias("target"), none.cast("double").alias("score")))
        .groupBy("source", "place").agg(F.max("target").alias("target"), F.max("score").alias("score"), F.sum("points").alias("points"))
    )
    order = Window.partitionBy("source").orderBy(F.desc("points"), "place")
    return totals.select("source", "target", F.row_number().over(order).alias("rank"), "score")
