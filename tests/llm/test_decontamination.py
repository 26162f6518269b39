import math
import random
from collections import Counter

import pytest

from quillon.llm import decontamination as d
from tests.llm.helpers import DOCS, SMALL, docs_of, rng, words

ITEMS = "item_id long, text string"


def items(n, seed=2):
    r = rng(seed)
    return [(k, f"{words(r, r.randint(6, 50), 3000)}. {words(r, r.randint(3, 20), 3000)}.") for k in range(n)]


def trigrams(words_):
    return set(zip(words_, words_[1:], words_[2:]))


def counts_of(bench):
    """Number, mean length and document frequencies of each length class, counted plainly."""
    of = {}
    for _, text in bench:
        if w := d.tokens(text):
            of.setdefault(d.width_of(w), []).append(w)
    return {k: (len(v), sum(map(len, v)) / len(v)) for k, v in of.items()}, {k: Counter(w for x in v for w in set(x)) for k, v in of.items()}


def indexes_of(bench):
    return d.build_indexes(bench, *counts_of(bench))


def slow_hits(text, bench):
    """Verified items and scores of a text: BM25 of every passage and every item, without an index."""
    (classes, df), words_, best = counts_of(bench), d.tokens(text), {}
    size = lambda w: min(3 if len(w) >= 8 else 2, len(w))
    grams = lambda w: {tuple(w[k : k + size(w)]) for k in range(len(w) - size(w) + 1)} if w else set()
    for item, of in bench:
        if not (own := Counter(d.tokens(of))):
            continue
        w = d.width_of(list(own.elements()))
        n, mean = classes[w]
        norm = 1.2 * (0.25 + 0.75 * sum(own.values()) / mean)
        impact = {t: math.log(1 + (n - df[w][t] + 0.5) / (df[w][t] + 0.5)) * c * 2.2 / (c + norm) for t, c in own.items()}
        q, a = map(grams, d.question_and_answer(of))
        for s in range(0, max(1, len(words_) - w // 2), w // 2):
            score = sum(impact.get(t, 0) for t in set(words_[s : s + w])) / sum(impact.values())
            if score < 0.4:
                continue
            around = words_[max(0, s - w) : s + 2 * w]
            held = set().union(*({tuple(around[k : k + g]) for k in range(len(around) - g + 1)} for g in (1, 2, 3)))
            share = lambda x: len(x & held) / len(x) if x else 1.0  # noqa: B023, E731
            if share(q) >= 0.5 and share(a) >= 0.5:
                best[item] = max(best.get(item, (0, 0, 0)), (round(score, 9), share(q), share(a)))
    return best


def test_scores_and_verified_hits_against_all_passages_and_items(spark):
    r, bench = rng(4), items(90, 5) + [(500, "one two three four."), (501, "ab cd ef gh ij kl mn. op qr.")]
    texts = ["", "one two three four", "zz ab cd ef gh ij kl mn op qr zz"]
    for k in range(60):
        one, two = r.choice(bench)[1].split(), r.choice(bench)[1].split()
        for _ in range(k % 9):
            one[r.randrange(len(one))] = "other"
        texts.append(" ".join([words(r, r.randint(0, 60), 3000), *one[: r.randint(3, 60)], words(r, r.randint(0, 30), 3000), *two]))
    for index_bytes in (d.INDEX_BYTES, 2_000):
        got = d.with_hits(docs_of(spark, texts), spark.createDataFrame(bench, ITEMS), index_bytes).collect()
        assert {x.doc_id: {h.item_id: (round(h.score, 9), h.question, h.answer) for h in x.hits} for x in got} == {k: slow_hits(t, bench) for k, t in enumerate(texts)}


def test_query_against_brute_force(spark):
    bench = [(r.item_id, d.tokens(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = set()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        there = trigrams(d.tokens(r.text))
        want |= {(r.doc_id, i) for i, w in bench if len(trigrams(w) & there) >= 0.9 * len(trigrams(w))}
    assert {(r.doc_id, r.item_id) for r in d.op5_decontamination(spark, SMALL).collect()} == want


@pytest.mark.parametrize("n", [3, 40, 700])
def test_wand_retrieves_all_above_the_threshold(n):
    r = random.Random(n)
    for index in indexes_of(items(n)):
        for _ in range(60):
            terms = r.sample(range(len(index.docs)), min(40, len(index.docs)))
            least = r.choice([0.01, 0.05, 0.1, 0.3])
            scores = {}
            for t in terms:
                for doc, x in zip(index.docs[t], index.impacts[t]):
                    scores[doc] = scores.get(doc, 0) + x
            assert {k for k, _ in index.search(terms, least)} == {k for k, x in scores.items() if x >= least}


def test_every_item_is_found_wherever_it_stands():
    bench, r = items(60), rng(9)
    indexes = indexes_of(bench)
    for item, text in bench:
        for before in (0, 1, 13, 31, 50, 333):
            doc = f"{words(r, before, 9000)} {text.upper()} {words(r, 40, 9000)}"
            assert [h["item_id"] for h in d.hits_of(doc, indexes)] == [item]


def test_question_without_answer_is_no_hit_whatever_its_share():
    q, a = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    indexes = indexes_of([(1, f"{q}. {a}.")])
    assert d.hits_of(f"x y {q} z", indexes) == [] and d.hits_of(f"x {a} y", indexes) == []
    assert [h["item_id"] for h in d.hits_of(f"x {q} so {a} y", indexes)] == [1]
    long = " ".join(f"q{k}" for k in range(30))
    indexes = indexes_of([(1, f"{long}. yes it is."), (2, f"{long} and no answer")])
    assert [h["item_id"] for h in d.hits_of(f"x {long} y", indexes)] == [2]
    assert [h["item_id"] for h in d.hits_of(f"x {long}. Yes, it is! y", indexes)] == [1, 2]
    assert d.question_and_answer("a b\nc d") == (["a", "b"], ["c", "d"]) and d.question_and_answer("a b c") == (["a", "b", "c"], [])


@pytest.mark.parametrize(("one_in", "share"), [(10**9, 1.0), (25, 0.95), (12, 0.85)])
def test_recall_of_planted_items(one_in, share):
    """Items as they are, and with one word in so many replaced, in texts of other words."""
    bench, r, found, wrong = items(300, 11), rng(12), 0, 0
    indexes = indexes_of(bench)
    for item, text in bench:
        changed = " ".join("other" if r.random() < 1 / one_in else w for w in text.split(" "))
        hits = {h["item_id"] for h in d.hits_of(f"{words(r, r.randint(0, 200), 3000)} {changed} {words(r, 50, 3000)}", indexes)}
        found, wrong = found + (item in hits), wrong + len(hits - {item})
    assert found >= share * len(bench) and wrong == 0


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, "red green blue black white. answer is grey."), (2, "red green blue black white. answer is grey."), (3, None), (4, ""), (None, "odd item here now. yes it is."), (5, "word")], ITEMS)
    hit = "Red, green; blue black WHITE - answer is grey"
    texts = [None, "", hit, hit, "clean text", "filler " * 50_000 + hit, "odd item here now. Yes it is", (None, hit, None)]
    out = d.with_hits(docs_of(spark, texts).selectExpr("*", "1 AS Hits"), bench)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "hits"]
    got = {r.doc_id: [h.item_id for h in r.hits] for r in out.collect()}
    assert got == {0: [], 1: [], 2: [1, 2], 3: [1, 2], 4: [], 5: [1, 2], 6: [None], None: [1, 2]}
    docs = docs_of(spark, texts)
    assert {r.doc_id for r in d.drop_contaminated(docs, bench).collect()} == {0, 1, 4}
    clash = d.drop_contaminated(docs.selectExpr("*", "doc_id + 7 AS hits", "'u' AS `a.b`"), bench)
    assert clash.columns == [*docs.columns, "hits", "a.b"] and {(r.doc_id, r.hits) for r in clash.collect()} == {(0, 7), (1, 8), (4, 11)}
    none = spark.createDataFrame([], ITEMS)
    assert d.drop_contaminated(docs, none).count() == 8 and d.drop_contaminated(spark.createDataFrame([], DOCS), bench).count() == 0
    split = d.with_hits(docs, bench, index_bytes=50)
    assert {r.doc_id: sorted(h.item_id or 0 for h in r.hits) for r in split.collect()} == {k: [x or 0 for x in v] for k, v in got.items()}
