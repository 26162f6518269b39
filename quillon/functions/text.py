"""Scalar functions over queries, counts and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of small numbers.
NUMERALS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: White space as Unicode has it.
BLANKS = r"(?U)\s+"
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def query_words(query: Column) -> Column:
    """Distinct lower-cased words of more than two characters; punctuation stays, length counts before lowering."""
    long_ones = F.filter(F.split(query, BLANKS), lambda w: F.char_length(w) > 2)
    return F.array_distinct(F.transform(long_ones, lambda w: F.lower(w)))


def overlap(words: Column, lowered_text: Column) -> Column:
    """How many of the words occur in the text, as substrings."""
    return F.size(F.filter(words, lambda w: F.contains(lowered_text, w))).cast("int")


def to_int(word: Column) -> Column:
    """A numeral word or digits as int, else null. Digits other than 0-9, and numbers beyond int, are null."""
    named = F.create_map(*[x for k, w in enumerate(NUMERALS) for x in (F.lit(w), F.lit(k))])
    return F.coalesce(F.when(F.rlike(word, F.lit("^[0-9]+$")), word.try_cast("int")), F.try_element_at(named, F.lower(word)))


def trimmed(text: Column) -> Column:
    """Without white space, as Unicode has it, at either end."""
    return F.btrim(text, F.lit(WHITE))


def starts_blank(text: Column) -> Column:
    """Whether a text that is not empty starts with white space."""
    return F.contains(F.lit(WHITE), F.substring(text, 1, 1))


def claim_key(chunk_id: Column, source_type: Column) -> Column:
    return F.concat(chunk_id, F.lit(":"), source_type)


def claim_label(value: Column, source_type: Column) -> Column:
    return F.concat(F.lit("count="), value.cast("string"), F.lit("/"), source_type)


def error_text(code: Column, message: Column) -> Column:
    """What an error says: backend errors by code and message, presentation errors by code."""
    return (
        F.when(code == "Decoder", F.concat(F.lit("decoder error: "), message))
        .when(code == "ResourceExhausted", F.lit("resource exhausted"))
        .when(code == "InvalidState", F.concat(F.lit("invalid state (bug): "), message))
        .when(code == "SurfaceLost", F.lit("surface lost"))
        .when(code == "DeviceLost", F.lit("device lost"))
        .when(code == "Transient", F.lit("transient error"))
    )
