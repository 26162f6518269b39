"""Small tables and plain-Python counterparts."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def docs_of(spark, texts, first=0):
    """Documents of these texts; a (doc_id, text, source) triple is taken as it is."""
    rows = [t if isinstance(t, tuple) else (k, t, "s") for k, t in enumerate(texts, first)]
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randint(1, size)}" for _ in range(n))


def rng(seed=1):
    return random.Random(seed)


def roots(nodes, links):
    """Smallest node that each reaches."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
