"""Small tables for the tests of these operators, with the cases every operator must take."""

import random

from pyspark.sql import types as T

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def words(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n)]


DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("n", T.StringType()), ("s", T.StringType()), ("rep", T.StringType()), ("score", T.StringType()), ("token", T.StringType()))])


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]); further columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None, "n", "s", "rep", "score", "token") for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    """Null and empty texts, a long one, repeats, and a row without an id."""
    long = " ".join(words(random.Random(7), 30_000))
    return [(900, None), (901, ""), (902, "   \n\t"), (903, "one"), (904, long), (905, long + " end"), (906, "same words here again today"), (906, "same words here again today"), (None, "no id for this row of words"), (907, "Éa\u00a0b 漢字 😀 \x00 z")]
