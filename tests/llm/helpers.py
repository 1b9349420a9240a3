"""Small corpora with the cases that every operator has to stand."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ["row", "score", "n_words", "items", "cover", "part", "cluster", "spans", "y", "weight",
           "best", "letters", "key", "rep", "at", "block", "held"]
SYLLABLES = {
    "en": ["the", "tion", "ing", "er", "and", "st", "wh", "ou"],
    "fr": ["eau", "é", "ment", "qu", "le", "oi", "ç", "en"],
}


def word(draw, lang="en"):
    return "".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4)))


def sentence(draw, n, lang="en"):
    return " ".join(word(draw, lang) for _ in range(n))


def texts(seed=1, n=40):
    """Plain texts, exact and near copies, shared passages, and odd ones."""
    draw = random.Random(seed)
    out = []
    passage = sentence(draw, 30)
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        body = sentence(draw, draw.randint(20, 120), lang)
        if i % 7 == 0:
            body += "\n" + passage + "\n" + sentence(draw, 5)
        out.append(body)
    out += [out[3], out[3].upper(), out[5] + " more", out[5] + " and more"]
    out += [None, "", " \n\t ", "...", "a", "A b", "a b c d", "word " * 300, "x" * 5000, "é" * 300]
    out += [(sentence(draw, 4000) + " ") * 2]
    return out


def rows(seed=1, n=40):
    return [
        (i, t, "fr" if i % 3 == 0 else "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t))
        for i, t in enumerate(texts(seed, n))
    ]


def corpus(spark, seed=1, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def odd_corpus(spark):
    """The corpus with a row twice, a row without a number, and extra columns."""
    from pyspark.sql import functions as F

    own = rows()
    own += [own[2], (None, own[4][1], None, None, None)]
    docs = spark.createDataFrame(own, SCHEMA)
    return docs.select("*", *[F.lit("extra").alias(c) for c in CLASHES])


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
