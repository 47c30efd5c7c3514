"""Small tables with everything that may go wrong: nulls, empty and long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

#: Names that operators use inside; tables with columns of these names must make no difference.
CLASHING = ("length", "n", "sig", "found", "part", "hash", "next", "chunk", "units", "pos", "id", "root", "first", "uid", "shard", "digest", "host", "decision", "lang_pred", "score", "dropped", "count")
WORDS = "the of and to in that it was for on are as with they be at one have this from".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiourstnldm") for _ in range(r.randint(2, 9))) if r.random() < 0.6 else r.choice(WORDS) for _ in range(n))


def texts() -> list:
    base = prose(1, 80)
    words = base.split()
    return [
        (1, base), (2, base), (3, " ".join(words[:-3] + ["x", "y", "z"])), (4, " ".join(words[:40])), (5, None), (6, ""), (7, " \t\n "), (8, "one two"), (9, "one two"), (10, "ONE Two"),
        (11, prose(2, 30_000)), (12, "Don't stop. 3.5 kg, ÀÉß ﬁ é İ Σας <|endoftext|> x  y\n\n z\t"), (12, "Don't stop. 3.5 kg, ÀÉß ﬁ é İ Σας <|endoftext|> x  y\n\n z\t"), (None, "a row without id here"), (None, None), (13, base + " " + prose(3, 20)),
    ]


def table(spark, rows, columns="doc_id bigint, text string"):
    """Rows as a table with clashing columns, all null."""
    return spark.createDataFrame(rows, columns).select("*", *(F.lit(None).cast("string").alias(c) for c in CLASHING if c not in columns.replace(",", "").split()))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
