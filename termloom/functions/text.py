"""Text expressions: whitespace, content, prompts, identifiers."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of ECMAScript (a Unicode set, unlike Java's plain \s),
# besides the blank itself.
WHITE_SPACE = (
    "\t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def normalize_ws(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at either end."""
    blanks = F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.trim(F.regexp_replace(blanks, "  +", " "))


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def term_content(name: Column, aka: Column, description: Column, legacy: bool = False) -> Column:
    """Name, synonyms if there are any, and description as one normalised text.

    ``legacy`` leaves out the space in front of the synonyms, as older content files do.
    """
    lead = "also known as " if legacy else " also known as "
    synonyms = F.when(F.length(aka) > 0, F.concat(F.lit(lead), aka)).otherwise(F.lit(""))
    return normalize_ws(
        F.concat(_or_empty(name), synonyms, F.lit(" "), _or_empty(description))
    )


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Replace every ``$name`` of the template at once, so values are never filled again."""
    pieces = []
    for i, piece in enumerate(re.split(r"\$(\w+)", template)):
        if i % 2:
            pieces.append(_or_empty(values[piece]))
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def iri_to_id(iri: Column, rules: Mapping[str, str]) -> Column:
    """Replace namespaces by short prefixes, literally and in the given order."""
    for namespace, prefix in rules.items():
        iri = F.replace(iri, F.lit(namespace), F.lit(prefix))
    return iri


def pair_id(subject_id: Column, object_id: Column) -> Column:
    return F.concat(subject_id, F.lit("|"), object_id)


def code_to_id(code: Column, drop_prefix: str | None = None) -> Column:
    """``A:1`` becomes ``A_1``; with ``drop_prefix='A:'`` it becomes ``1``."""
    if drop_prefix is not None:
        return F.replace(code, F.lit(drop_prefix), F.lit(""))
    return F.replace(code, F.lit(":"), F.lit("_"))
