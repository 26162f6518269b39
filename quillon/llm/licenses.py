"""Licence scan by a positional rare-token index.

Each licence template (a paragraph, a header, a name or an identifier of a licence) is a word sequence with a mandatory
key phrase. Over all documents, the document frequency of every template word is counted; the rarest words of each
template (its anchors), at all positions where they stand in it, form the index word -> postings (template, position). A file looks up all anchor words it has,
subtracts posting positions from its own and intersects the results: anchors that agree on one relative
position place the template. There, the key phrase must stand word for word, and the share of template
words in place is the score. All of it happens within a row: no shuffle, whatever the texts hold.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import quoted, table, without
from quillon.llm.licence_texts import TEMPLATES

#: Words of a text after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base labels.
BASE = (("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"), ("under the mit license", "mit"))
#: The word of each base phrase that is looked for first.
BASE_KEYS = {"apache-2": "apache", "cc-by-nc": "nc", "mit": "mit"}
#: A template has so many anchors, and one more for every ``WORDS_PER_ANCHOR`` of its words.
ANCHORS_PER_TEMPLATE, WORDS_PER_ANCHOR = 3, 12
#: Anchors that have to agree on the relative position, and the share of template words in place.
MIN_AGREEING = 2
MIN_SCORE = 0.75
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def licence_words(text: Column) -> Column:
    # U+212A alone among other letters would lower to an ASCII one; U+00E5 is a word character like it
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("å"))
    return F.filter(F.split(F.lower(plain), NOT_WORD), lambda w: w != "")


def template_idf(docs: DataFrame) -> dict[str, float]:
    """IDF, over all documents, of each word of the templates that occurs in one at all."""
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    words = docs.select(licence_words(F.col("text")).alias("w"))
    found = words.select(F.explode(F.array_intersect("w", F.lit(vocabulary))).alias("word"))
    # one row per template word; the count of documents comes from the same scan's files
    df = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    n = docs.count()
    return {w: math.log((n + 1) / (k + 0.5)) for w, k in df.items()}


def rare_index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Postings (template number, position) of the highest-IDF words of each template, of those that occur.

    Templates that no text can hold are left out: a word of a key phrase occurs nowhere, or fewer words than the
    score takes occur at all."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(TEMPLATES):
        of = template.words
        if not all(of[k] in idf for k in template.key) or sum(w in idf for w in of) < MIN_SCORE * len(of):
            continue
        for w in sorted(idf.keys() & set(of), key=lambda w: (-idf[w], w))[: ANCHORS_PER_TEMPLATE + len(of) // WORDS_PER_ANCHOR]:
            index.setdefault(w, []).extend((t, i) for i, x in enumerate(of) if x == w)
    return index


def _literal(value: object, kind: str) -> Column:
    """A table as one literal: the optimiser reads its text form once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_licences(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with word count, base places, base labels, all labels and score (1 where a base phrase stands,
    else the best share of template words in place, else 0).

    A null text is empty: no words, no labels (empty strings), null positions. Ties in IDF go by the word.
    Equal rows get equal results, texts are read whole, an empty table stays empty, input columns of the
    added names are replaced."""
    docs = without(docs, *ADDED, "__w", "__hits", "__base", "__places", "__found")
    index = rare_index(idf if idf is not None else template_idf(docs))
    order = sorted(index)
    w = F.col("__w")
    out = docs.withColumn("__w", licence_words(F.col("text")))

    def at(i: Column, phrase: list[str]) -> Column:
        hit = F.get(w, i) == phrase[0]
        for k, x in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(w, i + k) == x, F.lit(False))
        return hit

    def places_of(phrase: list[str], label: str) -> Column:
        """Starts of a phrase, only looked for where its key word occurs."""
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: at(i, phrase))
        found = F.transform(starts, lambda i: F.struct(i.cast("long").alias("i"), F.lit(label).alias("label")))
        return F.when((F.size(w) >= len(phrase)) & F.array_contains(w, BASE_KEYS[label]), found)

    starts = [places_of(phrase.split(), label) for phrase, label in BASE]
    none = F.array().cast("array<struct<i:bigint,label:string>>")
    out = out.withColumn("__base", F.concat(*[F.coalesce(s, none) for s in starts]))

    # where the file's anchors stand
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda h: h["w"].isin(order))
    anchors = F.lit(order) if order else F.array().cast("array<string>")
    out = out.withColumn("__hits", F.when(F.arrays_overlap(w, anchors), hits))
    postings = _literal({word: [{"t": t, "i": i} for t, i in index[word]] for word in order}, "map<string,array<struct<t:int,i:int>>>")
    places = F.flatten(F.transform("__hits", lambda h: F.transform(F.try_element_at(postings, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("at")))))
    # sorted, equal (template, relative position) stand side by side: MIN_AGREEING of them make a candidate
    out = out.withColumn("__places", F.array_sort(places))
    s = F.col("__places")
    agreed = F.array_distinct(F.filter(s, lambda x, k: (k >= MIN_AGREEING - 1) & (F.get(s, k - (MIN_AGREEING - 1)) == x)))
    templates = _literal([{"label": t.label, "words": t.words, "key": t.key} for t in TEMPLATES], "array<struct<label:string,words:array<string>,key:array<int>>>")

    def verdict(c: Column) -> Column:
        def judged(x: Column) -> Column:
            same = F.transform(x["t"]["words"], lambda word, k: F.coalesce(F.get(w, x["at"] + k) == word, F.lit(False)))
            return _let(F.struct(x["t"].alias("t"), same.alias("same")), scored)

        return _let(F.struct(F.get(templates, c["t"]).alias("t"), c["at"].alias("at")), judged)

    def scored(x: Column) -> Column:
        score = F.size(F.filter(x["same"], lambda s: s)) / F.size(x["same"]).cast("double")
        whole = F.forall(x["t"]["key"], lambda k: F.get(x["same"], k))
        return F.when(whole & (score >= MIN_SCORE), F.struct(x["t"]["label"].alias("label"), score.alias("score")))

    out = out.withColumn("__agreed", agreed).withColumn("__found", F.array_compact(F.transform("__agreed", verdict)))
    base, found = F.col("__base"), F.coalesce("__found", F.array().cast("array<struct<label:string,score:double>>"))
    at_ = F.transform(base, lambda b: b["i"])
    base_labels, own_labels = F.transform(base, lambda b: b["label"]), F.transform(found, lambda f: f["label"])
    return out.select(
        *[quoted(c) for c in docs.columns],
        F.size(w).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(at_).alias("first_word"),
        F.array_max(at_).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, own_labels))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda f: f["score"])), F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licences(docs, template_idf(docs)).select("doc_id", *ADDED)
