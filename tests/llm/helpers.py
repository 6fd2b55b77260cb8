"""Small documents with every awkward case, and how rows are read back."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the caller's table.
CLASHING = ("row", "key", "n", "m", "head", "tie", "range", "guest", "own", "next", "label", "x", "length", "rank", "slice", "letters", "held_out", "score", "token", "grp", "hot", "a", "b", "_row", "_gone")


def documents(spark, rows) -> DataFrame:
    """(doc_id, text[, lang]) rows as a table of documents with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(i).alias(name) for i, name in enumerate(CLASHING)))


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward() -> list[tuple]:
    long = " ".join(words(1, 30_000, 5_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog. It ran away!"), (2, ""), (3, None), (4, "   \n\t "), (5, "one"), (6, "a b c d e"), (7, "A B C D E"), (8, long),
        (9, "The quick brown fox jumps over the lazy dog. It ran away!"), (10, "Éa ñu   ß İ Σας 🙂 x́"), (None, "no id at all here"), (None, None), (11, "12 34 !!"), (12, "x" * 5_000), (1, "The quick brown fox jumps over the lazy dog. It ran away!"),
    ]


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
