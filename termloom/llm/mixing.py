"""Mixing of sources to target weights by pivotal rounding of copies, in DataFrame functions only.

A source's target says how often each of its documents is to be taken on average: some whole copies
and a fraction of one more. Pivotal rounding makes fractions whole and keeps the words taken: two
documents move mass between them, at random in one of two directions, until one of them has no or a
full copy more; the other goes on with what is left. A group of about ``FAN`` documents leaves one
such residual, ``FAN`` neighbouring groups leave one again, and so on up a tree of written levels
until one is left per source. Groups are cut by hash, so a source with a third of all rows is as
many small groups, and nothing depends on how the input is partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.ordering import number_rows, running_totals
from termloom.session import materialize

WEIGHTS = (1, 2, 3)
LARGEST = 3  # copies
FAN_BITS = 4
SEED = 12
COPY_ROWS = 1_000  # rows that one record unfolds to in a task
WORD = r"[^\x20\x09-\x0D]+"
_KEEP = ["doc_id", "size", "source_size", "target", "rows", "whole", "ones"]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def source_targets(sources: DataFrame, weights=WEIGHTS, largest: int = LARGEST) -> DataFrame:
    """Add ``target`` to ``source, source_size``.

    Sources in the order of code points, null last, weigh ``weights`` in turn and share the sum of
    all sizes. A target stops at ``largest`` times the size and the excess is shared anew: in the
    order of size per weight, the first sources stop, and all others have one level of words per
    weight, which is the largest that any prefix of stopped sources leaves.
    """
    ranked = number_rows(sources, [F.asc_nulls_last("source")], "rank")
    choice = F.array(*[F.lit(w) for w in weights])
    weighed = materialize(
        ranked.select(
            *sources.columns, choice[((F.col("rank") - 1) % len(weights)).cast("int")].cast("long").alias("weight"),
            (F.col("source_size") * largest).alias("most"),
        ).withColumn("level", F.col("most") / F.col("weight")),
        "weighed",
    )
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    order = [F.asc("level"), F.asc_nulls_last("source")]
    sums = running_totals(weighed, [], order, {"upto_most": F.col("most"), "upto_weight": F.col("weight")})
    left = F.lit(whole.words or 0) - F.col("upto_most") + F.col("most")
    heavy = F.lit(whole.weight or 0) - F.col("upto_weight") + F.col("weight")
    level = sums.agg(F.max(left / heavy)).first()[0] or 0.0
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select(*sources.columns, target.alias("target"))


def _pair(a: Column, b: Column) -> Column:
    """One pivotal step: ``done`` is whole now, ``rest`` goes on."""

    def stepped(v: Column) -> Column:
        room_a, room_b = (1 - a["p"]) * a["size"], (1 - b["p"]) * b["size"]
        mass_a, mass_b = a["p"] * a["size"], b["p"] * b["size"]

        def moved(m: Column) -> Column:
            share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
            out = lambda done, bit, rest, p: F.struct(
                done.withField("p", F.lit(float(bit))).alias("done"), rest.withField("p", share(p)).alias("rest")
            )
            up, down = m["up"], m["down"]
            rises = v < F.when(up + down > 0, down / (up + down)).otherwise(F.lit(0.0))
            return (
                F.when(rises & (room_a <= mass_b), out(a, 1, b, b["p"] - up / b["size"]))
                .when(rises, out(b, 0, a, a["p"] + up / a["size"]))
                .when(mass_a <= room_b, out(a, 0, b, b["p"] + down / b["size"]))
                .otherwise(out(b, 1, a, a["p"] - down / a["size"]))
            )

        return _let(F.struct(F.least(room_a, mass_b).alias("up"), F.least(mass_a, room_b).alias("down")), moved)

    # A number in [0, 1) that depends on the two documents only.
    chance = F.shiftrightunsigned(F.xxhash64(a["h"], b["h"]), 11) / F.lit(float(1 << 53))
    return _let(chance, stepped)


def _folded(units: Column, kind: str) -> Column:
    """Pivotal steps from left to right: ``done`` units are whole, ``rest`` is the last one."""
    nothing = F.array().cast(f"array<{kind}>")
    return F.aggregate(
        F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))),
        F.struct(nothing.alias("done"), units[0].cast(kind).alias("rest")),
        lambda acc, x: _let(
            _pair(acc["rest"], x),
            lambda s: F.struct(
                F.concat(acc["done"], F.array(s["done"].cast(kind))).alias("done"), s["rest"].cast(kind).alias("rest")
            ),
        ),
    )


def _round_level(units: DataFrame, kind: str, name: str) -> DataFrame:
    """``source, group, done, rest`` of each group of ``source, group, unit``; groups are short."""
    folded = units.groupBy("source", "group").agg(F.sort_array(F.collect_list("unit")).alias("units")).select(
        "source", "group", _folded(F.col("units"), kind).alias("f")
    )
    return materialize(folded.select("source", "group", "f.done", "f.rest"), name)


def mix(
    docs: DataFrame, weights=WEIGHTS, largest: int = LARGEST, seed: int = SEED,
    text: str = "text", id: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: one row per document, words it gives to the mix.

    ``size`` counts words at ASCII white space; a null or empty text has none and is taken with 0
    words. ``taken`` is a whole number of copies times the size: the average number rounded down or
    up, so never above ``largest``. A source's words come out at its target but for the last
    residual, which goes to the nearer side: half a document at most. Null sources are one source,
    the last. Repeated rows and null ids are rows like others. The same rows and ``seed`` give the
    same mix. No rows give no rows.
    """
    words = F.regexp_count(F.col(text), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(words, F.lit(0).cast("long")).alias("size"),
    )
    # Equal rows are one unit: of so many copies a whole number is settled at once.
    units = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "units")
    depth = F.greatest(F.lit(0), F.ceil(F.log2("n") / FAN_BITS).cast("int") - 1)
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"), F.max("rows").alias("most_rows")
    ).select("source", "source_size", "most_rows", depth.alias("depth"))
    targets = materialize(source_targets(sources, weights, largest), "targets")
    bounds = targets.agg(F.max("depth").alias("depth"), F.max("most_rows").alias("rows")).first()

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = F.col("rows") * (F.col("ratio") - F.floor("ratio"))
    settled = (
        units.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("ratio", ratio)
        .select(
            "source", *_KEEP[:5], F.floor("ratio").alias("whole"), F.floor(extra).alias("ones"),
            (extra - F.floor(extra)).alias("p"), "depth",
            F.xxhash64("doc_id", "source", "size", F.lit(seed)).alias("h"),
        )
    )
    fraction = (F.col("size") > 0) & (F.col("p") > 0)
    # The hash comes first: it is the order within a group.
    unit = F.struct("h", "p", *_KEEP)
    slots = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth") * FAN_BITS)
    level = settled.filter(fraction).select(
        "source", F.pmod(F.xxhash64("h", F.lit(seed)), slots).alias("group"), unit.alias("unit")
    )
    kind = level.schema["unit"].dataType.simpleString()
    decided = [settled.filter(~fraction).select(*_KEEP, F.lit(0.0).alias("p"))]
    for number in range((bounds.depth or 0) + 1):
        done = _round_level(level, kind, f"level-{number}")
        decided.append(done.select(F.explode("done").alias("unit")).select(*[f"unit.{c}" for c in [*_KEEP, "p"]]))
        level = done.select("source", F.shiftright("group", FAN_BITS).alias("group"), F.col("rest").alias("unit"))
    # One is left per source; it goes to the nearer side.
    decided.append(level.select(*[f"unit.{c}" for c in _KEEP], F.round("unit.p").alias("p")))
    every = reduce(DataFrame.unionByName, decided)
    if (bounds.rows or 0) > COPY_ROWS:
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPY_ROWS)))
        every = every.select("*", parts.alias("part")).repartition("doc_id", "size", "part")
    else:
        every = every.withColumn("part", F.lit(0).cast("long"))
    last = F.least(F.col("rows"), (F.col("part") + 1) * COPY_ROWS)
    each = every.select("*", F.explode(F.sequence(F.col("part") * COPY_ROWS + 1, last)).alias("copy"))
    copies = F.col("whole") + (F.col("copy") <= F.col("ones") + F.col("p")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))
