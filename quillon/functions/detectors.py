"""Detectors of typed claims: each a column expression over a chunk's text and kind that is a claim or null.

A text is cut once, for all detectors, into pieces (words, runs of white space, single marks) that add up to it again.
A detector looks for a piece of its own, reads on from there piece by piece, and takes the first place where what
it reads is whole. Where sentences and lists can end is noted when the text is cut, so that reading on from a place never
takes more than its own sentence or list. A plain search for a word that has to occur comes first: texts without any
are not cut at all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import starts_blank, to_int, trimmed

CLAIM = "struct<value:int,source_type:string,scope_operator:string,evidence:string,items:array<string>>"
# The words of the grammars.
VERBS = ("implemented", "implements", "defines", "provides")
SCOPES = ("in addition to", "excluding", "not counting", "besides")
METHODS = ("method", "methods")
COLLECTIONS = ("list made of", "deck of", "set of")
THINGS = ("card", "element", "item")


class Detector(NamedTuple):
    """``claim`` gets a chunk's text, kind and pieces; pieces are there if the text has the ``hint`` of one of the detectors
    that are applied together."""

    name: str
    claim: Callable[[Column, Column, Pieces], Column]
    hint: str | None = None


def _claim(value: Column, source_type: str, evidence: Column, scope: Column | None = None, items: Column | None = None) -> Column:
    none = F.lit(None)
    made = F.struct(
        value.cast("int").alias("value"), F.lit(source_type).alias("source_type"), (none if scope is None else scope).cast("string").alias("scope_operator"),
        evidence.alias("evidence"), (none if items is None else items).cast("array<string>").alias("items"),
    )
    return F.when(value.isNotNull(), made)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Pieces:
    """A cut text, as expressions over the array of its pieces; places count from 0."""

    def __init__(self, cut_: Column) -> None:
        self.array, self.stops, self.breaks = (cut_[c] for c in ("array", "stops", "breaks"))

    def __getitem__(self, at: Column) -> Column:
        return F.get(self.array, at)

    def lower(self, at: Column) -> Column:
        return F.lower(self[at])

    def blank(self, at: Column) -> Column:
        return F.coalesce(starts_blank(self[at]), F.lit(False))

    def text(self, first: Column, n: Column) -> Column:
        return F.array_join(F.slice(self.array, first + 1, F.greatest(n, F.lit(0))), "")

    def sentence(self, at: Column) -> Column:
        """The text from a place up to the next piece that ends a sentence, or all that is left."""
        last = F.coalesce(F.get(F.filter(self.stops, lambda i: i >= at), F.lit(0)), F.size(self.array))
        return self.text(at, last + 1 - at)

    def listed(self, at: Column) -> Column:
        """The pieces from a place up to the next one that no list has."""
        last = F.coalesce(F.get(F.filter(self.breaks, lambda i: i >= at), F.lit(0)), F.size(self.array))
        return F.slice(self.array, at + 1, F.greatest(last - at, F.lit(0)))

    def places(self, test: Callable[[Column], Column]) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(self.array) - 1), lambda i: F.coalesce(test(i), F.lit(False)))

    def spell(self, at: Column, words: Sequence[str | Sequence[str]]) -> Column:
        """Whether these words, or one of several at a place, stand from a place on, with white space between."""
        out = F.lit(True)
        for k, w in enumerate(words):
            out = out & self.lower(at + 2 * k).isin(*([w] if isinstance(w, str) else w))
            if k:
                out = out & self.blank(at + 2 * k - 1)
        return out


def cut(text: Column) -> Column:
    """The pieces of a text, and the places of those that end a sentence and of those that no list of names has."""

    def noted(array: Column) -> Column:
        places = lambda test: F.filter(F.sequence(F.lit(0), F.size(array) - 1), lambda i: test(F.get(array, i)))
        ends = places(lambda x: (x == ".") | F.contains(x, F.lit("\n")))
        breaks = places(lambda x: ~(x.isin(",", "__") | F.startswith(x, F.lit("__")) | starts_blank(x) | (F.lower(x) == "and")))
        # each is noted for the detector that asks for it
        ends, breaks = F.when(_may_state(text), ends), F.when(_may_list(text), breaks)
        return F.when(F.size(array) > 0, F.struct(array.alias("array"), ends.alias("stops"), breaks.alias("breaks")))

    return _let(F.regexp_extract_all(text, F.lit(r"(?U)\w+|\s+|[^\w\s]"), F.lit(0)), noted)


def _has(text: Column, *words: str) -> Column:
    """Whether a text has one of some lower-cased words at least."""
    return reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in words])


def _may_state(text: Column) -> Column:
    return _has(text, "special") & _has(text, *VERBS)


def _may_list(text: Column) -> Column:
    return _has(text, "special") & F.contains(text, F.lit("__"))


def claims(detectors: Sequence[Detector], text: Column, kind: Column) -> Column:
    """The claims of all detectors, in their order, null where one has none. The text is cut once at most."""
    hints = sorted({d.hint for d in detectors if d.hint})
    each = lambda c: F.array(*[F.struct(F.lit(k).alias("pos"), d.claim(text, kind, Pieces(c)).cast(CLAIM).alias("claim")) for k, d in enumerate(detectors)])
    if not hints:
        return F.array(*[F.struct(F.lit(k).alias("pos"), d.claim(text, kind, None).cast(CLAIM).alias("claim")) for k, d in enumerate(detectors)])
    lowered = F.lower(text)
    return _let(F.when(reduce(or_, [F.contains(lowered, F.lit(h)) for h in hints]), cut(text)), each)


def _first(may: Column, p: Pieces, starts: Callable[[Column], Column], read: Callable[[Column], Column]) -> Column:
    """What ``read`` gives at the first place of ``starts`` where it gives anything; null for texts that can't have it."""
    found = F.get(F.array_compact(F.transform(p.places(starts), read)), F.lit(0))
    return F.when(may, found)


def _sentence_rest(tail: Column) -> Column:
    """What stands before the first full stop or line end of a text that has one, else null."""
    parts = F.split(tail, "[.\n]", 2)
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)))


def _stated(text: Column, _: Column, p: Pieces) -> Column:
    """[we] VERB NUMBER special method(s) [SCOPE ...] up to a full stop or line end."""

    def read(i: Column) -> Column:
        end = i + 7  # after: verb, number, special, method, with white space between
        begin = F.when((p.lower(i - 2) == "we") & p.blank(i - 1), i - 2).otherwise(i)
        said = p.text(begin, end - begin)
        number = p.lower(i + 2)
        plain = _sentence_rest(p.sentence(end)) == ""
        out = F.when(plain, F.struct(number.alias("number"), F.lit(None).cast("string").alias("scope"), said.alias("said"), F.substring(p[end], 1, 1).alias("stop")))
        for scope in SCOPES:
            words = scope.split()
            start = end + 2 * len(words) + 1  # where its text starts: white space, and its words each with white space after it
            rest = _sentence_rest(p.sentence(start))
            there = p.blank(end) & p.spell(end + 1, words) & p.blank(start - 1) & (F.length(rest) > 0)
            operator = F.lower(p.text(end + 1, F.lit(2 * len(words) - 1)))
            whole = F.struct(
                number.alias("number"), F.concat(operator, F.lit(" "), trimmed(rest)).alias("scope"), F.concat(p.text(begin, start - begin), rest).alias("said"),
                F.substring(p.sentence(start), F.length(rest) + 1, F.lit(1)).alias("stop"),
            )
            out = F.when(there, whole).otherwise(out)
        return F.when(F.rlike(p[i + 2], F.lit(r"(?U)^\w")), out)

    starts = lambda i: p.lower(i).isin(*VERBS) & p.blank(i + 1) & p.blank(i + 3) & p.spell(i + 4, ["special", METHODS])
    found = _first(_may_state(text), p, starts, read)
    return _let(found, lambda f: _claim(to_int(f["number"]), "author_anchor", trimmed(F.concat(f["said"], f["stop"])), f["scope"]))


def _is_name(piece: Column) -> Column:
    """A name with two underscores at either end and something between them."""
    return F.startswith(piece, F.lit("__")) & F.endswith(piece, F.lit("__")) & (F.length(piece) > 4)


def _listed(text: Column, _: Column, p: Pieces) -> Column:
    """the special method(s) NAME, NAME[,] [and] NAME: two names or more."""

    def read(i: Column) -> Column:
        # state: what may come next, the names, and how many pieces up to the last of them
        begin = F.struct(F.lit("name").alias("next"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("read"), F.lit(0).alias("at"))

        def step(s: Column, x: Column) -> Column:
            took = _is_name(x) & s["next"].isin("name", "name or and", "last name")
            then = (
                F.when((s["next"] == "end") | starts_blank(x), s["next"])
                .when(took, F.when(s["next"] == "last name", "end").otherwise("comma"))
                .when((s["next"] == "comma") & (x == ","), "name or and")
                .when((s["next"] == "name or and") & (F.lower(x) == "and"), "last name")
                .otherwise("end")
            )
            return F.struct(then.alias("next"), F.when(took, F.array_append(s["names"], x)).otherwise(s["names"]).alias("names"), (s["read"] + 1).alias("read"), F.when(took, s["read"] + 1).otherwise(s["at"]).alias("at"))

        listed = F.aggregate(p.listed(i + 6), begin, step)
        said = lambda s: F.concat(F.right(p[i], F.lit(3)), p.text(i + 1, s["at"] + 5))
        return _let(listed, lambda s: F.when(F.size(s["names"]) > 1, F.struct(s["names"].alias("names"), said(s).alias("said"))))

    starts = lambda i: F.endswith(p.lower(i), F.lit("the")) & p.blank(i + 1) & p.spell(i + 2, ["special", METHODS]) & p.blank(i + 5)
    found = _first(_may_list(text), p, starts, read)
    return _let(found, lambda f: _claim(F.when(f.isNotNull(), F.size(f["names"])), "forward_reference", trimmed(f["said"]), items=f["names"]))


def _defined(text: Column, kind: Column, p: Pieces) -> Column:
    """def NAME( in code, each of them."""

    opens = lambda i: (p[i] == "(") | p.blank(i) & (p[i + 1] == "(")
    at = p.places(lambda i: F.endswith(p[i], F.lit("def")) & p.blank(i + 1) & _is_name(p[i + 2]) & opens(i + 3))
    found = F.transform(at, lambda i: p[i + 2])
    found = F.when((kind == "code") & F.contains(text, F.lit("def")), found)
    n = lambda f: F.when(F.size(f) > 0, F.size(f))
    return _let(found, lambda f: _claim(F.when(f.isNotNull(), n(f)), "code_literal", F.concat(n(f).cast("string"), F.lit(" dunder def(s) in code body")), items=f))


def _printed(text: Column, _: Column, __: Pieces) -> Column:
    """A prompt that asks for a length, and the number on the next line that is not blank."""

    def read(part: Column) -> Column:
        closing = F.instr(part, ")")
        called = F.substring(part, F.lit(1), closing)
        rest = F.substring(part, closing + 1, F.length(part))
        gap = F.regexp_extract(rest, r"(?U)^\s*", 0)
        digits = F.regexp_extract(F.substring(rest, F.length(gap) + 1, F.length(rest)), r"(?U)^\w+", 0)
        asks = (closing > 0) & F.startswith(F.regexp_replace(called, r"(?U)^\s+", ""), F.lit("len(")) & F.contains(gap, F.lit("\n"))
        return F.when(asks & F.rlike(digits, F.lit(r"(?U)^\d+$")), F.struct(digits.alias("number"), F.concat(F.lit(">>>"), called, gap, digits).alias("said")))

    parts = F.split(text, ">>>")
    found = F.get(F.array_compact(F.transform(F.slice(parts, F.lit(2), F.size(parts)), read)), F.lit(0))
    return _let(F.when(F.contains(text, F.lit(">>>")), found), lambda f: _claim(f["number"].try_cast("int"), "code_literal", trimmed(f["said"])))


def _counted(text: Column, _: Column, p: Pieces) -> Column:
    """COLLECTION NUMBER THING(s)."""

    def read(i: Column) -> Column:
        # i: the collection's last word, of; before it, in reverse, its other words, the first of which may end a longer one
        before = F.lit(None).cast("string")
        for of in COLLECTIONS:
            first, *more = of.split()
            at = i - 2 * len(more)
            there = F.endswith(p.lower(at), F.lit(first)) & p.blank(at + 1) & p.spell(at + 2, more)
            before = F.when(there, F.concat(F.right(p[at], F.lit(len(first))), p.text(at + 1, i - at))).otherwise(before)
        thing = F.lit(None).cast("string")
        for name in THINGS:
            plural = F.startswith(p.lower(i + 4), F.lit(name + "s"))
            thing = F.when(F.startswith(p.lower(i + 4), F.lit(name)), F.left(p[i + 4], F.when(plural, len(name) + 1).otherwise(len(name)))).otherwise(thing)
        said = F.concat(before, p.text(i + 1, F.lit(3)), thing)
        is_word = F.rlike(p[i + 2], F.lit(r"(?U)^\w"))
        return F.when(said.isNotNull() & is_word & p.blank(i + 1) & p.blank(i + 3), F.struct(p[i + 2].alias("number"), said.alias("said")))

    found = _first(_has(text, "of"), p, lambda i: p.lower(i) == "of", read)
    return _let(found, lambda f: _claim(to_int(f["number"]), "author_anchor", trimmed(f["said"])))


def number_after(name: str, source_type: str, pattern: str) -> Detector:
    """A detector of the number in the pattern's first group."""
    return Detector(name, lambda text, _, __: _claim(F.regexp_extract(text, pattern, 1).try_cast("int"), source_type, F.regexp_extract(text, pattern, 0)))


STATED_COUNT, LISTED_NAMES = Detector("stated_count", _stated, "special"), Detector("listed_names", _listed, "special")
DEFINED_NAMES, COUNTED_THINGS = Detector("defined_names", _defined, "def"), Detector("counted_things", _counted, "of")
PRINTED_LENGTH = Detector("printed_length", _printed)
#: Detector sets by name; their order is the order of a chunk's claims.
SETS = {
    "base": (STATED_COUNT, LISTED_NAMES, DEFINED_NAMES),
    "extended": (STATED_COUNT, COUNTED_THINGS, LISTED_NAMES, DEFINED_NAMES, PRINTED_LENGTH),
    "no_author_phrase": (STATED_COUNT, LISTED_NAMES, DEFINED_NAMES, PRINTED_LENGTH),
    "license_versions": (
        number_after("apache_version", "author_anchor", "Apache License, Version ([0-9]+)"),
        number_after("gnu_version", "forward_reference", "GNU General Public License, version ([0-9]+)"),
        number_after("cc_version", "code_literal", "CC BY-NC ([0-9]+)"),
    ),
}
