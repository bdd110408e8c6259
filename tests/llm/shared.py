"""Documents with every awkward case, shared by the tests of the training-data operators."""

import random

EXTRA = ["n", "w", "p", "key", "line", "kept", "score", "digest", "spans", "rid", "bucket", "_c0"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and"] + ["".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(3 + i % 6)) for i in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward() -> list[tuple]:
    """``(doc_id, text)``: nulls, empty and blank texts, ties, repeated rows, copies, near copies, one very long text."""
    base, passage = prose(1, 300), prose(2, 80)
    edited = base.split()
    edited[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, " \t\n \r\n "), (7, "one"), (8, "two words"),
        (9, prose(3, 60) + " " + passage + " " + prose(4, 60)), (10, prose(5, 60) + " " + passage + " " + prose(6, 60)),
        (11, "\n".join([prose(7, 14)] * 3 + [prose(8, 14), "", "short", "short"])), (12, prose(9, 20_000)),
        (13, "é" * 900 + " ñandú   \x1c x"), (14, "a" * 1200), (None, prose(10, 50)), (None, None), (15, base.upper()),
    ]
    return rows + [rows[0], rows[8]]


def frame(spark, rows, schema="doc_id long, text string"):
    """The rows with extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])
