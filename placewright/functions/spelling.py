"""Edit distance and the keys that bring similar words together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the largest edit distance of a suggestion.
MAX_DISTANCE = 2

# Fixed value: how much of a word its keys are made of.
PREFIX = 7


def within_distance(left: Column, right: Column) -> Column:
    """Optimal string alignment distance where it is at most ``MAX_DISTANCE``, else ``MAX_DISTANCE`` + 1.

    Insertions, deletions, substitutions and swaps of neighbours cost 1 each. Spark's Levenshtein has no swaps, hence
    an Arrow batch function: one dynamic-programming table, a few cells wide, filled for all pairs of a batch at once.
    """
    import pandas as pd

    def distance(left, right):
        import numpy as np
        import pandas as pd

        far = MAX_DISTANCE + 1
        out = np.full(len(left), far, dtype=np.int32)
        a_all, b_all = left.fillna("").astype(str).to_numpy(), right.fillna("").astype(str).to_numpy()
        len_a, len_b = np.array([len(x) for x in a_all]), np.array([len(x) for x in b_all])
        # One batch step per length class keeps short pairs from paying for long ones.
        for size in np.unique(len_a):
            rows = np.nonzero((len_a == size) & (np.abs(len_a - len_b) <= MAX_DISTANCE))[0]
            if not len(rows):
                continue
            width = size + MAX_DISTANCE
            a = np.zeros((len(rows), size), dtype=np.int32)
            b = np.zeros((len(rows), width), dtype=np.int32)
            for i, r in enumerate(rows):
                a[i] = np.frombuffer(a_all[r].encode("utf-32-le"), dtype=np.int32)
                b[i, : len_b[r]] = np.frombuffer(b_all[r].encode("utf-32-le"), dtype=np.int32)
            before = None
            current = np.full((len(rows), width + 1), far, dtype=np.int32)
            current[:, : far] = np.minimum(np.arange(width + 1), far)[:far]
            for i in range(1, size + 1):
                above, current = current, np.full((len(rows), width + 1), far, dtype=np.int32)
                if i <= MAX_DISTANCE:
                    current[:, 0] = i
                for j in range(max(1, i - MAX_DISTANCE), min(width, i + MAX_DISTANCE) + 1):
                    cell = np.minimum(above[:, j - 1] + (a[:, i - 1] != b[:, j - 1]), np.minimum(above[:, j], current[:, j - 1]) + 1)
                    if before is not None and j > 1:
                        swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                        cell = np.where(swapped, np.minimum(cell, before[:, j - 2] + 1), cell)
                    current[:, j] = np.minimum(cell, far)
                before = above
            out[rows] = current[np.arange(len(rows)), len_b[rows]]
        return pd.Series(out)

    distance.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.Series}
    return F.pandas_udf(distance, "int")(left, right)


def _one_deleted(word: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
        lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))),
    )


def deletion_keys(word: Column) -> Column:
    """The word's first ``PREFIX`` characters, less up to two of them: 29 keys at most, however long the word is.

    Two words within the distance share one. They can be made equal by leaving out at most two characters of each, and so can their
    beginnings: where fewer lie in the one, it gives up its last characters instead.
    """
    start = F.substring(word, F.lit(1), F.lit(PREFIX))
    once = _one_deleted(start)
    return F.array_distinct(F.concat(F.array(start), once, F.flatten(F.transform(once, _one_deleted))))
