import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from quillon.llm import periodic_runs as p
from tests.llm.helpers import DOCS, SMALL, docs_of


def plain(words):
    """Runs by comparing every word with those later by each period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, m, q) for (a, m), q in out.items())


def result(words):
    runs = sorted(plain(words), key=lambda r: (r[0], r[2]))
    gone = {k for a, m, q in runs for k in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def changed(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    q = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % q] for i, w in enumerate(words)]


def rows_of(df):
    return {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()}


def periodic(r, kinds, n):
    words = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        unit, at, m = [r.randrange(kinds) for _ in range(r.randint(1, 20))], r.randint(0, len(words)), r.randint(1, 100)
        words[at:at] = (unit * (m // len(unit) + 1))[:m]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_against_all_periods_and_places(seed):
    r = random.Random(seed)
    for _ in range(5):
        texts = [periodic(r, r.choice([1, 2, 3, 30]), r.choice([0, 5, 24, 30, 100, 250])) for _ in range(r.randint(1, 8))]
        got = p.find_runs([np.array(t, dtype=np.int32) for t in texts])
        for k, t in enumerate(texts):
            assert [(int(a), int(m), int(q)) for of, a, m, q in zip(*got) if of == k] == sorted(plain(t), key=lambda x: (x[0], x[2]))


def test_grids_in_small_pieces(monkeypatch):
    r = random.Random(5)
    texts = [np.array(periodic(r, 2, 300), dtype=np.int32) for _ in range(5)]
    want = p.find_runs(texts)
    monkeypatch.setattr(p, "PLACES", 7)
    assert all((a == b).all() for a, b in zip(want, p.find_runs(texts)))


def test_greatest_exponent_is_exact():
    # 10^7 + 1 words of period 3 * 10^6 + 1 against nearly the same share
    a = (np.array([0, 50]), np.array([10_000_001, 10_000_004]), np.array([3_000_001, 3_000_002]))
    want = 0 if Fraction(10_000_001, 3_000_001) >= Fraction(10_000_004, 3_000_002) else 1
    assert p.strongest(*a) == want
    assert p.strongest(np.array([3, 9]), np.array([30, 60]), np.array([5, 10])) == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = rows_of(p.op12_periodic_runs(spark, SMALL))
    short = {i: t.encode().split() for i, t in docs.items() if len(t.split()) < 700}
    assert set(got) == set(docs) and len(short) > 100
    for i, words in short.items():
        assert got[i] == result(changed([w.decode() for w in words], i)), i
    assert sum(x[0] > 0 for x in got.values()) > 5


def test_long_text_in_one_run_and_named_alone(spark, monkeypatch):
    r = random.Random(3)
    head = [str(r.randrange(50)) for _ in range(1_000)]
    unit = [str(r.randrange(10**6)) for _ in range(7_000)]
    words = head + unit * 20
    got = rows_of(p.with_runs(docs_of(spark, [" ".join(words), "a " * 30, "x y " * 40])))
    assert got[0][:4] == (1, 1_000, 140_000, 7_000) and got[1][:5] == (1, 0, 30, 1, 30_000) and got[2][:4] == (1, 0, 80, 2)
    assert got[0][6] == sha256(" ".join(head + unit).encode()).hexdigest()


def test_words_and_edge_cases(spark):
    none = sha256(b"").hexdigest()
    run = " ".join(["Wort wort x  "] * 12)
    texts = [None, "", " \t\n", run, run, ("a\x0bb\x0cc\r\n" * 8).strip(), (None, "b " * 24, None), "b " * 23]
    out = p.with_runs(docs_of(spark, texts).selectExpr("*", "1 AS N_Runs", "'k' AS `a.b`"))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "a.b", *p.RESULT.names]
    got = rows_of(out)
    for k in (0, 1, 2):
        assert got[k] == (0, None, None, None, None, none, none)
    assert got[3] == got[4] == result(run.split(" ")) and got[5][:4] == (1, 0, 24, 3)
    assert got[None][:4] == (1, 0, 24, 1) and got[7][0] == 0
    assert p.with_runs(spark.createDataFrame([], DOCS)).collect() == []
