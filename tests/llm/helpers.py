"""Small tables with every awkward row: nulls, empty and long texts, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, node string, key string, list int"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_docs(spark, seed=3, n=30):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rng, rng.randrange(20, 90))
        if i % 4 == 0:
            text = text.replace(" ", "\n", 3)
        rows.append((i, text))
    rows.append((n, rows[2][1]))  # an exact copy
    near = rows[3][1].split(" ")
    near[-1] = "changed"
    rows.append((n + 1, " ".join(near)))
    rows += [(n + 2, ""), (n + 3, None), (n + 4, "   \n\n "), (None, "a text of a row without an id"), (None, None)]
    rows += [(n + 5, words(rng, 3000)), (7, rows[7][1]), (n + 6, "é ß ıİ Σ 漢字 " * 9), (n + 7, "a" * 700)]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", "z", 1) for i, t in rows], DOCS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
