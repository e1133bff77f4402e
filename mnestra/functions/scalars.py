"""Scalar expressions: clamps, lenient parsers and the line protocols of language-model answers."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnestra.schema import DEFAULT_IMPORTANCE, IMPORTANCE_RANGE, MEMORY_TYPES

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strip(text: Column) -> Column:
    """Without outer white space of any sort."""
    return F.regexp_replace(text, r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$", "")


def clamp(x: Column, low: float = IMPORTANCE_RANGE[0], high: float = IMPORTANCE_RANGE[1]) -> Column:
    """``x`` within bounds; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def parse_score(text: Column) -> Column:
    """The number a whole text states, clamped; 5.0 if it states none or is null."""
    s = strip(text)
    return clamp(F.coalesce(F.when(s.rlike(_NUMBER), s.try_cast("double")), F.lit(DEFAULT_IMPORTANCE)))


def parse_memory_type(text: Column) -> Column:
    """One of the four types regardless of case; anything else, null too, is a fact."""
    low = F.lower(text)
    return F.when(low.isin(*MEMORY_TYPES), low).otherwise("fact")


def split_list(text: Column) -> Column:
    """Comma-separated parts without outer blanks; an empty text is one empty part."""
    return F.transform(F.split(text, ",", -1), lambda part: F.trim(part))


def tags_from_json(text: Column) -> Column:
    """A JSON list of strings; bad JSON and null give an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clean_entity(text: Column) -> Column:
    """A resolved entity's name: outer white space, then outer double quotes removed."""
    return F.regexp_replace(strip(text), '^"+|"+$', "")


def basic_tokens(text: Column) -> Column:
    """Runs without ASCII white space and punctuation, and single punctuation signs; ASCII letters lower, others as they are; null gives null."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(r"(\p{Punct}|[^\s\p{Punct}]+)"), F.lit(0))


def any_tag(tags: Column, wanted: Sequence[str]) -> Column:
    """Exact membership of at least one; no wanted tag passes all."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)


def all_tags(tags: Column, wanted: Sequence[str], compat_like: bool = False) -> Column:
    """Every wanted tag; with ``compat_like`` by LIKE over the JSON text, without regard to case, with wildcards."""
    if not wanted:
        return F.lit(True)
    if compat_like:
        out = F.lit(True)
        for t in wanted:
            out = out & F.lower(F.to_json(tags)).like(f'%"{t.lower()}"%')
        return F.coalesce(out, F.lit(False))
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0, F.lit(False))


def response_lines(responses: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, line)``: the stripped lines of each answer, numbered from 0; null answers have none."""
    return responses.select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "raw")).select(key, "pos", strip(F.col("raw")).alias("line"))


def parse_facts(responses: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """``(key, pos, memory_type, importance, tags, content, subject, predicate, object)`` of FACT lines.

    A line has at least five parts; the content may hold bars. A well-formed TRIPLE line belongs to
    the next fact of its answer, the last before it wins, one behind all facts is dropped.
    """
    lines = response_lines(responses, key, text)
    fact, triple = F.split("line", r"\|", 5), F.split("line", r"\|", 4)
    lines = lines.withColumn("is_fact", F.col("line").startswith("FACT |") & (F.size(fact) == 5)).withColumn("is_triple", F.col("line").startswith("TRIPLE |") & (F.size(triple) == 4))
    lines = lines.where("is_fact OR is_triple")
    order = W.partitionBy(key).orderBy("pos")
    before = F.coalesce(F.sum(F.col("is_fact").cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.when(F.col("is_triple"), F.struct(strip(triple[1]).alias("subject"), strip(triple[2]).alias("predicate"), strip(triple[3]).alias("object")))
    grouped = lines.withColumn("fact_no", before).withColumn("triple", F.last(parts, ignorenulls=True).over(W.partitionBy(key, "fact_no").orderBy("pos")))
    tags = F.filter(F.transform(F.split(fact[3], ","), strip), lambda t: t != "")
    return grouped.where("is_fact").select(key, "pos", parse_memory_type(strip(fact[1])).alias("memory_type"), parse_score(fact[2]).alias("importance"), tags.alias("tags"), strip(fact[4]).alias("content"), "triple.subject", "triple.predicate", "triple.object")


def parse_triples(responses: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """``(key, pos, subject, predicate, object)`` of triples that belong to a fact."""
    return parse_facts(responses, key, text).where("subject IS NOT NULL").select(key, "pos", "subject", "predicate", "object")


def parse_selected(responses: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """``(key, pos, ordinal, reasoning)`` of SELECTED lines; the part before the first bar holds one number."""
    hit = r"^SELECTED[^0-9|]*([0-9]+)[^0-9|]*\|(.*)$"
    lines = response_lines(responses, key, text).where(F.col("line").rlike(hit))
    return lines.select(key, "pos", F.regexp_extract("line", hit, 1).try_cast("long").alias("ordinal"), strip(F.regexp_extract("line", hit, 2)).alias("reasoning"))


def parse_contradictions(responses: DataFrame, key: str = "response_id", text: str = "response") -> DataFrame:
    """``(key, pos, ordinal, explanation)`` of CONTRADICTION lines; a bare number is accepted too."""
    hit = r"^CONTRADICTION \|\s*(?:\[CANDIDATE-)*\+?([0-9]+)\]*\s*\|(.*)$"
    lines = response_lines(responses, key, text).where(F.col("line").rlike(hit))
    return lines.select(key, "pos", F.regexp_extract("line", hit, 1).try_cast("long").alias("ordinal"), strip(F.regexp_extract("line", hit, 2)).alias("explanation"))
