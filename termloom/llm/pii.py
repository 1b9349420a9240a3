"""Personal data: wide generators propose spans, boosted trees choose, in Spark expressions only.

Strict patterns give the base spans of four kinds. Wider generators add candidates that a strict
pattern misses (spelled-out or spaced addresses, other separators, numbers without a plus). Each
candidate gets features of its format and of the text around it; boosted trees score it, and it is
taken if the score reaches its kind's threshold. The trees learn, from all documents, to tell
candidates that pass their kind's check (digit sum, octets, ending, form of the number), however
they are written, from those that do not, and a threshold is the least score with hardly any
failing candidate above it on rows kept aside. What fails its check but overlaps a base span is
part of something good, so it is no example.

Trees ask only on which side of some cuts a feature is, so all candidates of one cell between the
cuts are one example with a weight: Spark counts the cells, and they are all that the driver sees.

Everything on rows is built-in functions inside one projection: no shuffle, no user function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.boosting import BINS, Boosted, boost
from termloom.llm.rules import _bind
from termloom.session import materialize, materialize_counted

KINDS = ("email", "ip", "card", "phone")
CELLS = 500_000  # of all kinds, that the driver takes; where there are more, bins are made wider
TREES, DEPTH = 16, 3
PRECISION, LEAST_SCORE = 0.995, 0.9

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The contract's patterns. A run of local characters can only match from its start or from where
#: the match before ended, and possessive loops do not go back, so long texts take linear time.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators.
_AT, _DOT = r"(?:\x20?@\x20?|\x20?[\[({]\x20?at\x20?[\])}]\x20?)", r"(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?)"
WIDE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:{_DOT}|,)[0-9]{{1,3}}+){{3}}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}+(?:[\x20._/-]{1,2}+[0-9]{3,6}+){2,4}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\(0?[0-9]{2,4}\)|00[0-9]{2}|[0-9]{3})[\x20./-]{1,2}+[0-9]{3}[\x20./-]?+[0-9]{4}(?![0-9A-Za-z])",
}
#: What a text needs before a kind's patterns are tried.
GUARD = {
    "email": r"@|[\[({]\x20?at\x20?[\])}]",
    "ip": r"[0-9](?:[.,]|\x20?[\[({])",
    "card": r"[0-9](?:[\x20._/-]{0,2}[0-9]){12}",
    "phone": r"\+[0-9]|[0-9][\x20()./-]{0,2}[0-9]{3}",
}
#: Numbers of ten digits without a country: neither area nor exchange begins with 0 or 1.
_NATIONAL = r"^\(?[2-9][0-9]{2}\)?[\x20./-]{1,2}[2-9][0-9]{2}[\x20./-]?[0-9]{4}$"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Words that announce personal data.
CUES = r"(?:mail|contact|write|reach|call|phone|tel|fax|mobile|ip|host|server|address|card|visa|pay|account)[\x20:.#=]*$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", ".").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _passes(kind: str, m: Column) -> Column:
    """The check a base match has to pass."""
    size = F.length(_digits(m))
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return size.between(14, 19) & F.when(size.between(14, 19), F.call_function("luhn_check", _digits(m))).otherwise(False)
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def _ending(m: Column) -> Column:
    """Whether a folded address has a sound name and a last label of letters."""
    folded = F.regexp_replace(F.regexp_replace(m, _AT, "@"), _DOT, ".")
    return folded.rlike(rf"^{_LOCAL}+@(?:{_LABEL}+\.)+[A-Za-z]{{2,}}$")


def _sound(c: Column) -> Column:
    """The check of a candidate, which does not ask how it is written."""
    m = c["m"]
    size = F.length(_digits(m))
    phone = m.startswith("+") | m.startswith("00") | m.startswith("(") | m.rlike(_NATIONAL)
    checks = {
        "email": _ending(m),
        # Four small numbers between commas are a list unless something announces an address.
        "ip": _octets(m) & (~m.contains(",") | c["before"].rlike(CUES)),
        "card": _passes("card", m),
        "phone": size.between(10, 15) & phone,
    }
    good = F.lit(False)
    for i, kind in enumerate(KINDS):
        good = F.when(c["k"] == i, checks[kind]).otherwise(good)
    return good


_SPAN = "struct<s:int,e:int,k:int,m:string,before:string,after:string>"
_RUN, _PIECE = 256, 256  # elements that are appended one by one, code points that a cut counts through


def _scanned(count: Column, start: Column, kinds: tuple[str, str], step) -> Column:
    """The elements that ``step(state, i)`` gives for i from 0 on, each with the state before.

    ``step`` returns a struct of the next ``state`` and the ``element``; ``kinds`` are their types.
    Appending copies an array, so elements are appended to short runs, and runs to each other.
    """
    state, element = kinds
    nothing = F.array().cast(f"array<{element}>")

    def run(before: Column, j: Column) -> Column:
        low = (j * _RUN).cast("int")
        return F.aggregate(
            F.sequence(low, F.least(low + _RUN, count) - 1),
            F.struct(before.cast(state).alias("state"), nothing.alias("out")),
            lambda acc, i: _bind(step(acc["state"], i), lambda x: F.struct(
                x["state"].cast(state).alias("state"),
                F.concat(acc["out"], F.array(x["element"].cast(element))).alias("out"),
            )),
        )

    whole = F.aggregate(
        F.sequence(F.lit(0), F.floor((count - 1) / _RUN).cast("int")),
        F.struct(start.cast(state).alias("state"), F.array().cast(f"array<array<{element}>>").alias("out")),
        lambda acc, j: _bind(run(acc["state"], j), lambda x: F.struct(
            x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out"),
        )),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(count > 0, whole).otherwise(nothing)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Matches with their places in code points and the text around them.

    What lies between matches gives their places: the lengths of all parts before add up.
    """

    def places(z: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            part, m = F.get(z["parts"], i), F.get(z["found"], i)
            begin = at + F.length(part)
            end = begin + F.length(m)
            span = F.struct(
                begin.cast("int").alias("s"), end.cast("int").alias("e"),
                F.lit(KINDS.index(kind)).alias("k"), m.alias("m"),
                F.lower(F.right(part, F.lit(24))).alias("before"),
                F.left(F.get(z["parts"], i + 1), F.lit(4)).alias("after"),
            )
            return F.struct(end.alias("state"), span.alias("element"))

        return _scanned(F.size(z["found"]), F.lit(0), ("int", _SPAN), step)

    both = F.struct(
        F.split(text, pattern, -1).alias("parts"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    )
    return F.when(text.rlike(GUARD[kind]), _bind(both, places)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _base(text: Column) -> Column:
    def checked(kind: str) -> Column:
        return F.filter(_matches(text, kind, BASE[kind]), lambda c: _passes(kind, c["m"]))

    return F.concat(*[checked(kind) for kind in KINDS])


def _with_overlap(base: Column, spans: Column) -> Column:
    """For each span whether a base span overlaps it, in the order of the spans.

    Both are sorted by start once. On the way up the greatest end of a base span so far tells
    those that begin before, on the way down the next start tells those that begin within.
    """
    item = lambda c, i: F.struct(c["s"].alias("s"), (i >= 0).alias("w"), c["e"].alias("e"), i.alias("i"))
    both = F.sort_array(F.concat(
        F.transform(base, lambda c: item(c, F.lit(-1))), F.transform(spans, lambda c, i: item(c, i))
    ))

    def sweep(own: Column, start: Column, state, hit) -> Column:
        def step(before: Column, i: Column) -> Column:
            return _bind(F.get(own, i), lambda c: F.struct(
                F.when(c["w"], before).otherwise(state(before, c)).alias("state"),
                F.struct(c["i"].alias("i"), (c["w"] & hit(before, c)).alias("hit")).alias("element"),
            ))

        found = _scanned(F.size(own), start, ("int", "struct<i:int,hit:boolean>"), step)
        return F.sort_array(F.filter(found, lambda x: x["i"] >= 0))

    def marked(own: Column) -> Column:
        up = sweep(own, F.lit(-1), lambda end, c: F.greatest(end, c["e"]), lambda end, c: end > c["s"])
        # Bound, or it would be turned round anew for each element.
        down = _bind(F.reverse(own), lambda back: sweep(
            back, F.lit((1 << 31) - 1), lambda _, c: c["s"], lambda next_, c: next_ < c["e"]
        ))
        return F.zip_with(up, down, lambda a, b: a["hit"] | b["hit"])

    few = (F.size(base) == 0) | (F.size(spans) == 0)
    return F.when(few, F.transform(spans, lambda c: F.lit(False))).otherwise(_bind(both, marked))


def _examples(text: Column) -> Column:
    """Candidates of the strict patterns and of the generators, without failing parts of base spans."""
    proposed = F.concat(*[_matches(text, kind, p[kind]) for p in (BASE, WIDE) for kind in KINDS])
    both = F.struct(_base(text).alias("base"), proposed.alias("proposed"))
    hits = lambda z: F.struct(z["proposed"].alias("c"), _with_overlap(z["base"], z["proposed"]).alias("hit"))
    return _bind(
        _bind(both, hits), lambda z: F.filter(z["c"], lambda c, i: _sound(c) | ~F.get(z["hit"], i))
    )


#: What the checks ask comes first: of equally good cuts the trees take the first.
FEATURES = (
    "email", "ip", "card", "phone", "luhn", "octets", "ending", "national", "digits", "comma", "cue",
    "plus", "paren", "at", "dots", "length", "letters", "others", "groups", "longest", "left", "right",
    "distinct",
)


def _features(c: Column) -> Column:
    """Format and context of a candidate, as numbers."""
    m = c["m"]
    digits = _digits(m)
    letters = F.regexp_replace(m, "[^A-Za-z]", "")
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    edge = "[A-Za-z0-9+@]"
    values = {
        **{kind: (c["k"] == i) for i, kind in enumerate(KINDS)},
        "digits": F.length(digits),
        "length": F.length(m),
        "letters": F.length(letters),
        "others": F.length(m) - F.length(digits) - F.length(letters),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "plus": m.startswith("+") | c["before"].rlike(r"\+\x20?$"),
        "paren": m.contains("("),
        "luhn": F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False),
        "octets": (F.size(groups) == 4) & _octets(m),
        "at": m.rlike(r"@|[\[({]\x20?at"),
        "dots": F.length(m) - F.length(F.translate(m, ".", "")),
        "left": c["before"].rlike(f"{edge}$"),
        "right": c["after"].rlike(f"^{edge}"),
        "cue": c["before"].rlike(CUES),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "ending": _ending(m),
        "national": m.rlike(_NATIONAL),
        "comma": m.contains(","),
    }
    return F.struct(*[values[name].cast("double").alias(name) for name in FEATURES])


def _variants(c: Column) -> Column:
    """The candidate, its text in a form that only the generators know, and that with a fault."""
    m = c["m"]
    digits = _digits(m)
    spelled = F.regexp_replace(F.regexp_replace(m, r"\.", " [dot] "), "@", " [at] ")
    national = F.regexp_replace(F.right(digits, F.lit(10)), "^(...)(...)", "$1-$2-")
    forms = {
        "email": (spelled, lambda x: F.concat(x, F.lit("7"))),
        "ip": (F.regexp_replace(m, r"\.", "[.]"), lambda x: F.concat(F.lit("9"), x)),
        "card": (
            F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1."),
            lambda x: F.concat(F.left(x, F.length(x) - 1), F.translate(F.right(x, F.lit(1)), "0123456789", "1234567890")),
        ),
        "phone": (
            F.when(F.length(digits) >= 10, national).otherwise(m),
            lambda x: F.concat(F.lit("1"), F.substring(x, 2, 1 << 30)),
        ),
    }
    form, fault = m, m
    for i, kind in enumerate(KINDS):
        own, spoilt = forms[kind]
        form = F.when(c["k"] == i, own).otherwise(form)
        fault = F.when(c["k"] == i, spoilt(own)).otherwise(fault)
    return F.array_distinct(F.array(c, c.withField("m", form), c.withField("m", fault)))


def _examples_of(docs: DataFrame) -> DataFrame:
    """The features, ``y``, ``k`` and ``kept`` of all candidates, with ``w``, how many are alike.

    Each candidate is also there in another form and with a fault, so that every kind shows what its
    check refuses.
    """
    spans = docs.select(F.explode(_bind(F.col("text"), _examples)).alias("c"))
    kept = F.pmod(F.xxhash64("c.m", "c.before", "c.after"), F.lit(4)) == 3
    all_ = spans.select(F.explode(_variants(F.col("c"))).alias("c"), kept.alias("kept"))
    good = _sound(F.col("c")).cast("int")
    found = all_.select(_features(F.col("c")).alias("f"), good.alias("y"), F.col("c.k").alias("k"), "kept")
    return found.select("f.*", "y", "k", "kept").groupBy(*FEATURES, "y", "k", "kept").agg(
        F.count(F.lit(1)).alias("w")
    )


def _cuts(examples: DataFrame, bins: int) -> list[list[np.ndarray]]:
    """Of each kind and feature the distinct quantiles of the examples that are not kept aside."""
    values = F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.col(name).alias("v")) for j, name in enumerate(FEATURES)
    ])).alias("x")
    counted = examples.filter("NOT kept").select("k", "w", values).groupBy("k", "x.j", "x.v").agg(F.sum("w").alias("w"))
    own = Window.partitionBy("k", "j")
    upto = own.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.select("k", "j", "v", F.sum("w").over(upto).alias("upto"), F.sum("w").over(own).alias("n"))
    # Position floor(p * (n - 1)), from 0.
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * (i / bins)), F.col("v"))) for i in range(1, bins)]
    cuts = [[np.zeros(0) for _ in FEATURES] for _ in KINDS]
    for r in placed.groupBy("k", "j").agg(F.array(*at).alias("cuts")).collect():  # kinds times features
        cuts[r.k][r.j] = np.unique(np.array(r.cuts, float))
    return cuts


def _cells(examples: DataFrame, cuts: list[list[np.ndarray]]) -> DataFrame:
    """``k, kept, bins, n, good``: the number of examples and of good ones of each cell."""

    def bins(own: list[np.ndarray]) -> str:
        edges = ["array(" + ", ".join(f"{float(c)!r}D" for c in x) + ")" if len(x) else "array(0D)" for x in own]
        return "array(" + ", ".join(f"size(filter({e}, c -> c < {name}))" for e, name in zip(edges, FEATURES, strict=True)) + ")"

    # As one text: column by column it would take thousands of calls.
    place = F.expr("CASE k " + " ".join(f"WHEN {k} THEN {bins(own)}" for k, own in enumerate(cuts)) + " END")
    return examples.groupBy("k", "kept", place.alias("bins")).agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("good")
    )


def fit(docs: DataFrame) -> tuple[list[Boosted], list[float]]:
    """Trees and the threshold of each kind, from all candidates of all documents."""
    examples = materialize(_examples_of(docs), "examples")
    bins = BINS
    while True:
        cuts = _cuts(examples, bins)
        cells, count = materialize_counted(_cells(examples, cuts), "cells")
        if count <= CELLS or bins == 2:
            break
        bins //= 2
    rows = cells.orderBy("k", "kept", "bins").collect()
    place = np.array([r.bins for r in rows], int).reshape(-1, len(FEATURES))
    k, kept = np.array([r.k for r in rows], int), np.array([r.kept for r in rows], bool)
    n, good = np.array([r.n for r in rows], float), np.array([r.good for r in rows], float)
    models, limits = [], []
    for i in range(len(KINDS)):
        # A number of each bin: its upper cut, or one beyond all.
        numbers = [np.append(c, c[-1] + 1) if len(c) else np.zeros(1) for c in cuts[i]]
        own = k == i
        x = np.stack([numbers[j][np.minimum(place[own, j], len(numbers[j]) - 1)] for j in range(len(FEATURES))], axis=1)
        a, b, aside = n[own], good[own], kept[own]
        # A cell is its good examples and the others.
        learn = np.concatenate([x[~aside], x[~aside]])
        weight = np.concatenate([b[~aside], (a - b)[~aside]])
        y = np.repeat([1, 0], int((~aside).sum()))
        model = boost(learn[weight > 0], y[weight > 0], TREES, DEPTH, weight=weight[weight > 0], cuts=cuts[i])
        chance = 1 / (1 + np.exp(-model.odds(x[aside])))
        order = np.argsort(-chance, kind="stable")
        right = np.cumsum(b[aside][order]) / np.cumsum(a[aside][order])
        scores = np.append(chance[order], 0.0)
        fine = np.flatnonzero((right >= PRECISION) & (scores[:-1] > scores[1:]))
        limit = float(scores[fine[-1]] + scores[fine[-1] + 1]) / 2 if len(fine) else 1.1
        models.append(model)
        limits.append(max(LEAST_SCORE, limit))
    return models, limits


def _chosen(text: Column, models: list[Boosted], limits: list[float], base: Column) -> Column:
    """Generated candidates that the trees take and no base span overlaps."""
    wide = F.concat(*[_matches(text, kind, WIDE[kind]) for kind in KINDS])
    free = lambda w: _bind(_with_overlap(base, w), lambda hit: F.filter(w, lambda c, i: ~F.get(hit, i)))
    wide = _bind(wide, free)
    scored = F.transform(wide, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), _features(c).alias("f")))

    def taken(c: Column) -> Column:
        good = F.lit(False)
        for i, (model, limit) in enumerate(zip(models, limits, strict=True)):
            score = model.column([c["f"][name] for name in FEATURES])
            good = F.when(c["k"] == i, score >= F.lit(limit)).otherwise(good)
        return good

    return F.transform(F.filter(scored, taken), _place)


def _place(c: Column) -> Column:
    return F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(
        F.transform(F.sort_array(spans), lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"], c["e"])), ","
    )


def _found(docs: DataFrame, models: list[Boosted], limits: list[float]) -> DataFrame:
    """Adds ``_text`` and ``_pii`` (base spans and all spans, in order)."""

    def of(text: Column) -> Column:
        return _bind(
            _base(text),
            lambda base: F.struct(
                F.transform(base, _place).alias("base"),
                F.concat(F.transform(base, _place), _chosen(text, models, limits, base)).alias("spans"),
            ),
        )

    return docs.select("row", _bind(F.coalesce("text", F.lit("")), of).alias("pii"), "text")


def find(docs: DataFrame, models: list[Boosted], limits: list[float], text: str = "text", id: str = "doc_id") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each document.

    Counts and digest are those of the base spans, ``spans`` has the added ones too. Places are
    code points, ends exclusive. A null text counts as empty; repeated rows are treated alike.
    """
    rows = docs.select(F.col(id).alias("row"), F.col(text).alias("text"))
    found = _found(rows, models, limits)

    def count(i: int) -> Column:
        return F.size(F.filter("pii.base", lambda c: c["k"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select(
        F.col("row").alias("doc_id"), *counts,
        F.sha2(_joined(F.col("pii.base")), 256).alias("base_sha256"),
        _joined(F.col("pii.spans")).alias("spans"),
    )


def _cut(pieces: Column, low: Column, high: Column) -> Column:
    """Code points ``low`` to ``high`` of a text in pieces: only the pieces in between are looked at."""
    part = lambda j: F.substring(
        F.get(pieces, j), F.greatest(low - j * _PIECE, F.lit(0)) + 1,
        F.least(high, (j + 1) * _PIECE) - F.greatest(low, j * _PIECE),
    )
    places = F.sequence(F.floor(low / _PIECE).cast("int"), F.floor((high - 1) / _PIECE).cast("int"))
    return F.when(low < high, F.array_join(F.transform(places, part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, models: list[Boosted], limits: list[float], text: str = "text") -> DataFrame:
    """The documents with ``[EMAIL]`` and the like in place of spans; other columns stay.

    Overlapping spans are replaced as one, named by the first. A null text stays null.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])

    def replaced(z: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            return _bind(F.get(z["spans"], i), lambda c: F.struct(
                F.greatest(at, c["e"]).alias("state"),
                F.struct(at.alias("a"), c["s"].alias("s"), c["k"].alias("k")).alias("element"),
            ))

        seen = _scanned(F.size(z["spans"]), F.lit(0), ("int", "struct<a:int,s:int,k:int>"), step)
        first = F.filter(seen, lambda c: c["s"] >= c["a"])
        parts = F.transform(first, lambda c: F.concat(_cut(z["pieces"], c["a"], c["s"]), F.get(names, c["k"])))
        last = F.array_max(F.transform(z["spans"], lambda c: c["e"]))
        return F.concat(F.array_join(parts, ""), _cut(z["pieces"], last, F.length(z["text"])))

    found = _found(rows, models, limits)
    whole = F.struct(
        F.col("text").alias("text"), F.sort_array("pii.spans").alias("spans"),
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"),
    )
    clean = F.when(F.size("pii.spans") > 0, _bind(whole, replaced)).otherwise(F.col("text"))
    others = [clean.alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*others)
