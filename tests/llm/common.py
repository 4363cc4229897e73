import random

SCHEMA = "doc_id long, text string, lang string, extra string"


def docs(spark, rows, parts=3):
    """rows: (doc_id, text); two more columns, one with nulls."""
    return spark.createDataFrame([(i, t, None if (k % 2) else "en", "x") for k, (i, t) in enumerate(rows)], SCHEMA).repartition(parts)


def prose(n, seed=0, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def corpus(seed=0):
    """A little of everything: nulls, empty, ties, copies, near copies, repeats, very long."""
    base = [prose(120, s + seed) for s in range(8)]
    shared = prose(60, 99)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "ONE two THREE")]
    rows += [(10 + k, t) for k, t in enumerate(base)]
    rows += [(30, base[0]), (31, base[0]), (32, base[1] + " tail"), (33, "head " + base[1]), (34, base[2].replace(" ", "\n", 3))]
    rows += [(40 + k, prose(30, 200 + k) + " " + shared + " " + prose(20, 300 + k)) for k in range(5)]
    rows += [(50, "a b " * 200), (51, prose(4000, 7, 3000) + " " + shared), (52, "x" * 3000), (53, "x" * 900), (54, "日本語 テキスト 🙂 " * 30)]
    rows += [(60, base[3]), (60, base[3]), (None, base[4]), (None, None)]
    return rows
