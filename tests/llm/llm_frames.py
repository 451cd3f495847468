"""Small frames for the training-data operators."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside.
CLASHES = ("fp", "row", "k", "k1", "k2", "base", "weak", "words", "score", "ids", "size", "queue", "node", "value", "all")

PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in the green garden near a calm river "


def documents(spark, rows, clashes=True):
    """(doc_id, text, source) rows as a frame, with columns of clashing names."""
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    if clashes:
        from pyspark.sql import functions as F

        frame = frame.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHES])
    return frame


def edge_rows():
    """Null and empty values, ties, repeated rows and a long text."""
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (4, PROSE * 3, "b"),
        (5, PROSE * 3, "b"),
        (5, PROSE * 3, "b"),
        (None, PROSE + "and a word more", "b"),
        (6, "été 𝄞 naïve ▁ x\x00y", "c"),
        (7, (PROSE + "\n") * 400, None),
        (8, "one", "a"),
    ]


def components(n, close):
    """Smallest member reachable, by brute force."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if close(i, j):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return [top(i) for i in range(n)]
