import re

import numpy as np
import pytest
import xxhash

from quillon.llm import simhash as s
from quillon.llm.components import connected_components
from tests.llm.helpers import DOCS, SMALL, docs_of, rng, roots


def slow_print(text, k=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b C", "one two three four", "é É x\u00a0y z \x1c w", "a b c d " * 50, "Tab\tand\nline\rfeed\x0b\x0c end"])
def test_fingerprint(text):
    assert s.fingerprint(text) % (1 << 64) == slow_print(text)


def test_long_text_is_read_whole():
    text = " ".join(f"w{k}" for k in range(70_000))
    assert s.fingerprint(text) != s.fingerprint(text[: len(text) // 2]) and s.fingerprint(text) % (1 << 64) == slow_print(text)


def expected(prints):
    """Component of each (doc_id, fingerprint)."""
    fps = np.array([f for _, f in prints], dtype=np.uint64)
    close = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    up = roots(range(len(prints)), close.tolist())
    least = {}
    for k, (doc, _) in enumerate(prints):
        least[up[k]] = min(x for x in (least.get(up[k]), doc) if x is not None) if (least.get(up[k]), doc) != (None, None) else None
    return [least[up[k]] for k in range(len(prints))]


@pytest.mark.parametrize("how", [{"tile": 3, "run": 4, "task": 20}, {"tile": 64}, {}])
def test_components_against_all_pairs(spark, how):
    rows = s.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet"), **how).collect()
    assert [r.component_id for r in rows] == expected([(r.doc_id, int(r.fingerprint, 16)) for r in rows])


def test_query_columns(spark):
    rows = s.op6_simhash(spark, SMALL)
    assert rows.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")] and rows.count() == 200
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows.collect())


@pytest.mark.parametrize(("radius", "n"), [(4, 300), (10, 200)])
def test_links_lose_nothing(spark, radius, n):
    r = rng(5)
    fps = [r.getrandbits(64) for _ in range(n)]
    for k in range(n // 2):
        fps.append(fps[k] ^ sum(1 << b for b in r.sample(range(64), r.randint(1, radius + 2))))
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = roots(signed, [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= radius])
    prints = spark.createDataFrame([(x, x) for x in signed], "node long, fp long")
    for tile, run, task in ((3, 8, 30), (7, 50, s.TASK), (s.TILE, s.RUN, 40), (s.TILE, s.RUN, s.TASK)):
        links = s.near_links(s.block_keys(prints, radius, run), radius, tile, task).collect()
        assert roots(signed, [(x.a, x.b) for x in links]) == want


def test_tiles_skip_by_population_count_and_compare_the_rest():
    r, fps = rng(6), []
    for _ in range(900):
        fps.append(sum(1 << b for b in r.sample(range(64), r.randint(8, 56))))
        fps.append(fps[-1] ^ 1 << r.randrange(64))
    fps, seen = np.array(list(dict.fromkeys(fps)), dtype=np.uint64)[:, None], []
    got = s.tile_roots(fps, 4, 64, seen)
    close = np.argwhere(np.triu(s._apart(fps[:, None], fps[None, :]) <= 4, 1))
    assert got.tolist() == list(roots(range(len(fps)), close.tolist()).values())
    assert seen.count("skipped") > seen.count("compared") > len(fps) / 64


def test_tiles_of_a_dense_key_are_not_compared_once_linked():
    fps, seen = np.array([[1 << a | 1 << b] for a in range(64) for b in range(a)], dtype=np.uint64), []
    assert not s.tile_roots(fps, 4, 32, seen).any() and set(seen) == {"linked"}
    assert len(s._forest(np.arange(len(fps)), fps, 4, 32)) == len(fps) - 1


def test_query_skips_and_compares_tiles(spark):
    """At 1,000 documents already, keys hold several tiles, of which population counts rule out some."""
    rows = s.with_fingerprints(spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("text")).distinct()
    fps = np.array([[r.fp] for r in rows.collect()]).view(np.uint64)
    assert s.masks_for(len(fps), s.RADIUS) == [0]
    s.tile_roots(fps, s.RADIUS, 128, seen := [])
    assert {"skipped", "compared"} <= set(seen)


def test_masks_cover_every_choice():
    for m in (5, 6, 8):
        masks = s.block_masks(m, 4)
        r = rng(m)
        for _ in range(300):
            flip = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not flip & mask for mask in masks)
    for n in (5_000, 10**6, 10**8):
        r = rng(n)
        for _ in range(100):
            flip = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not flip & mask for mask in s.masks_for(n, 4))
    assert len(s.masks_for(10**6, 4)) == 5 < len(s.masks_for(10**9, 4)) <= s.MAX_MASKS


def test_edge_cases(spark):
    texts = [(5, None, "a"), (3, "", "a"), (9, "x", "a"), (None, "x", "a"), (None, "only", "a"), (7, "y" * 200_000, "a"), (7, "y" * 200_000, "a")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in s.near_duplicates(docs_of(spark, texts).selectExpr("*", "1 AS fp", "2 AS component_id")).collect()}
    f = lambda t: f"{s.fingerprint(t) % (1 << 64):016x}"
    assert got == {(5, "0" * 16, 3), (3, "0" * 16, 3), (9, f("x"), 9), (None, f("x"), 9), (None, f("only"), None), (7, f("y" * 200_000), 7)}
    assert s.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_connected_components(spark):
    r = rng(3)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 470)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for link in real for x in link}
    assert {(x.node, x.root) for x in connected_components(df).collect()} == set(roots(nodes, real).items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
