import zlib
from hashlib import sha256

import numpy as np
import pytest

from quillon.llm import merkle as m
from quillon.llm.queries import ORACLES
from tests.llm.helpers import DOCS, SMALL, docs_of
from tests.oracle import assert_same, connection


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def up(nodes):
    """Levels of a tree, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, k):
    out = []
    for level in levels[:-1]:
        run = k // 16 * 16
        out.append(("".join(level[run:k]), "".join(level[k + 1 : run + 16])))
        k //= 16
    return out


def plain(rows, shown=lambda doc_id, text: text):
    """(doc_id, leaf, subroot, root, proof, folded root) of every row."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {s: up([d for d, _ in by[s]]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for k, (own, r) in enumerate(by[s]):
            path = beside(trees[s], k) + beside(top, place)
            now = leaf([*r[:4], shown(r[0], r[4])])
            for left, right in path:
                now = h(left, now, right)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*[a + b for a, b in path]), now))
    return out


def key(rows):
    return sorted(rows, key=repr)


def got(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect()]


def test_query_agrees_with_sql(spark):
    assert_same(m.op11_merkle_manifest(spark, SMALL), connection(SMALL), ORACLES["op11_merkle_manifest"])


def test_query_agrees_with_a_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select(*m.FIELDS).collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = lambda i, t: t.translate(low) if zlib.crc32(str(i).encode()) % 5 == 0 else t
    assert key(got(m.op11_merkle_manifest(spark, SMALL))) == key(plain(rows, shown))


@pytest.mark.parametrize("sizes", [(1,), (2,), (16,), (17,), (1, 16, 17, 256, 257), (4097, 1), tuple([1] * 20)])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(n * 10_000 + k, f"s{n:03}", "en", None, f"Text {k}") for n, size in enumerate(sizes) for k in range(size)]
    df = spark.createDataFrame([(i, t, lang, s, c) for i, s, lang, c, t in rows], DOCS)
    assert key(got(m.manifest(df))) == key(plain(rows))


def test_many_rows_of_one_source(spark):
    """Three rounds: blocks of blocks."""
    n = 16**3 * 17 + 5
    nodes = spark.range(n).selectExpr("'=s' AS grp", f"{n}L AS n", "id AS pos", "sha2(cast(id AS string), 256) AS digest")
    tables = m._rounds(nodes)
    assert len(tables) == 3 and tables[-1].first()["digest"] == up([h(str(k)) for k in range(n)])[-1][0]


def test_block_levels_and_paths_against_plain_ones():
    for n in (1, 2, 15, 16, 17, 31, 255, 256, 257, 300):
        nodes = [h(str(k)) for k in range(n)]
        levels = m.block_levels(m.hex_rows(nodes), n)
        want = up(nodes)
        assert [[x.tobytes().decode() for x in level] for level in levels] == want
        assert m.paths_of(levels) == [beside(want, k) for k in range(n)]


def test_an_altered_row_fails_alone(spark):
    docs = docs_of(spark, [f"Text {k}" for k in range(50)])
    from pyspark.sql import functions as F

    out = m.manifest(docs, F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text")))
    assert [r.doc_id for r in out.where("NOT verified").collect()] == [17]


def test_edge_cases(spark):
    rows = [(1, None, "s"), (2, "", "s"), (2, "", "s"), (None, "x", "s"), (None, "y", None), (5, "Ä A " * 100_000, None), (7, "x", ""), (7, "x", "-")]
    docs = docs_of(spark, rows)
    plain_rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    out = m.manifest(docs.selectExpr("*", "1 AS Leaf", "2 AS row", "3 AS `a.b`"))
    assert out.columns == ["doc_id", "a.b", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert key(got(out)) == key(plain(plain_rows)) and all(r.verified for r in out.collect())
    assert m.manifest(spark.createDataFrame([], DOCS)).collect() == []
    lone = m.manifest(docs_of(spark, [(None, None, None)])).collect()
    assert [(r.leaf == r.subroot == r.root, r.proof_sha256) for r in lone] == [(True, sha256(b"").hexdigest())]


def test_sibling_bytes():
    low, own, high = m.sibling_bytes(20, np.array([0, 15, 16, 19]))
    assert low == [0, 0, 1024, 1024] and own == [0, 960, 1024, 1216] and high == [1024, 1024, 1280, 1280]
