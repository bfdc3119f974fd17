"""Small tables with nulls, empty and long texts, ties and repeated rows, and columns whose names clash."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, id string, component string, _salt int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y", 1) for i, t in rows], DOCS)


def odd_rows():
    long = prose(30_000, 1)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, long), (8, prose(40, 2))]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
