"""Full-text search: tokenizer, BM25, and the query language, over the texts themselves or over a stored index.

``search`` looks at each document; ``textindex.TextIndex`` keeps postings and reads those of a query's
words only. Both rank by ``best``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@cache
def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters they are folded to."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(c), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower case, without marks; null gives none."""
    marked, plain = _folding()
    clean = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain), r"\p{Mn}", "")
    return F.filter(F.split(clean, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def indexed(memories: DataFrame) -> DataFrame:
    """``(id, content_terms, tag_terms, archived, insert_seq)``; archived rows are indexed too."""
    return memories.select("id", terms(F.col("content")).alias("content_terms"), terms(F.concat_ws(" ", "tags")).alias("tag_terms"), "archived", "insert_seq")


def postings(memories: DataFrame) -> DataFrame:
    """``(term, id, tf, length)`` over content and tags; a term's postings can be bucketed by term when written.

    Rows that are partitioned by id already, as current ones are, aren't shuffled again.
    """
    docs = indexed(memories).select("id", F.concat("content_terms", "tag_terms").alias("all"))
    return docs.select("id", F.size("all").alias("length"), F.explode("all").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def term_statistics(memories: DataFrame) -> DataFrame:
    """``(term, n_docs, n_occurrences)``: counts of a document, then of all, combined before the shuffle on the term."""
    return postings(memories).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_occurrences"))


# -- query language -------------------------------------------------------------------------
class QuerySyntaxError(ValueError):
    pass


@dataclass
class Phrase:
    """Terms in a row, the last a prefix if ``prefix``; in one column if ``column``; from the start if ``initial``."""

    words: list[str]
    prefix: bool = False
    column: str | None = None
    initial: bool = False

    def hits(self, terms: Column) -> Column:
        """At which places of a term list the phrase stands, as a count."""
        n = len(self.words)
        if n == 0:
            return F.lit(0)
        if n == 1 and not self.initial:
            word = self.words[0]
            return F.size(F.filter(terms, (lambda t: t.startswith(word)) if self.prefix else (lambda t: t == word)))
        places = F.sequence(F.lit(1), F.lit(1) if self.initial else F.greatest(F.size(terms) - n + 1, F.lit(1)))
        words, prefix = self.words, self.prefix

        def stands(at: Column) -> Column:
            out = F.lit(True)
            for i, word in enumerate(words):
                there = F.coalesce(F.get(terms, at - 1 + i), F.lit(""))
                out = out & (there.startswith(word) if prefix and i == n - 1 else there == word)
            return out

        return F.size(F.filter(places, lambda at: stands(at)))

    def count(self) -> Column:
        content, tags = self.hits(F.col("content_terms")), self.hits(F.col("tag_terms"))
        return content if self.column == "content" else tags if self.column == "tags" else content + tags


def phrase_places(terms: list[str], words: list[str], prefix: bool) -> list[int]:
    """Where a phrase stands in a list of terms."""
    fits = lambda at: all(terms[at + k].startswith(w) if prefix and k == len(words) - 1 else terms[at + k] == w for k, w in enumerate(words))
    return [at for at in range(len(terms) - len(words) + 1) if fits(at)]


def near_counts(places: list[list[int]], lengths: list[int], distance: int) -> list[int]:
    """How often each phrase stands in a clump of all: at most ``distance`` terms from the end of its first to the start of its last.

    ``places`` has each phrase's places in order. Clumps are met from left to right; each counts the phrases' places in it, a place once.
    """
    kept: list[set[int]] = [set() for _ in places]
    now = [0] * len(places)
    while all(k < len(p) for k, p in zip(now, places)):
        at = [p[k] for k, p in zip(now, places)]
        behind = [i for i, x in enumerate(at) if x + lengths[i] + distance < max(at)]
        if behind:
            now[behind[0]] += 1
            continue
        for i, x in enumerate(at):
            kept[i].add(x)
        now[at.index(min(at))] += 1
    return [len(x) for x in kept]


@dataclass
class Near:
    """Phrases that only count where they stand near each other, in one column."""

    phrases: list[Phrase]
    distance: int = 10
    column: str | None = None

    def counts(self) -> Column:
        """An array with each phrase's count."""
        words, prefixes, distance = [p.words for p in self.phrases], [p.prefix for p in self.phrases], self.distance

        @F.arrow_udf("array<int>")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in columns:
                yield pa.array([near_counts([phrase_places(terms or [], *p) for p in zip(words, prefixes)], list(map(len, words)), distance) for terms in batch.to_pylist()], pa.list_(pa.int32()))

        return self._both(run(F.col("content_terms")), run(F.col("tag_terms")))

    def _both(self, content: Column, tags: Column) -> Column:
        return content if self.column == "content" else tags if self.column == "tags" else F.zip_with(content, tags, lambda a, b: a + b)

    def placed(self, content: list[Column], tags: list[Column]) -> Column:
        """The same from the phrases' places."""
        lengths, distance = [len(p.words) for p in self.phrases], self.distance

        @F.arrow_udf("array<int>")
        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in columns:
                yield pa.array([near_counts([x or [] for x in row or []], lengths, distance) for row in batch.to_pylist()], pa.list_(pa.int32()))

        return self._both(run(F.array(*content)), run(F.array(*tags)))


@dataclass
class Query:
    """A tree over phrases: ``shape`` holds phrase numbers and ("and"|"or"|"not", left, right).

    ``near`` has the groups by the number of their first phrase.
    """

    shape: object
    phrases: list[Phrase] = field(default_factory=list)
    near: dict[int, Near] = field(default_factory=dict)

    def standing(self) -> dict[str, Column]:
        """``any<number>``: at how many places each phrase stands."""
        return {f"any{i}": p.count() for i, p in enumerate(self.phrases)}

    def counting(self) -> dict[str, Column]:
        """``tf<number>``: how many of these places count; of a group all phrases count or none."""
        out = {f"tf{i}": F.col(f"any{i}") for i in range(len(self.phrases))}
        for first, group in self.near.items():
            both = group.counts()
            out |= {f"tf{first + k}": both[k] for k in range(len(group.phrases))}
        return out


_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<sign>[()+*:^,{}-])|(?P<word>[^\s"()+*:^,{}\-!#$%&\'./;<=>?@\[\\\]`|~]+)|(?P<bad>\S))')


def parse_query(text: str) -> Query:
    """The tree of a query: bare words (AND), OR, NOT, "phrases", prefix*, column:, ^initial, a + b.

    Anything else is a syntax error, as are signs in bare words and an empty query.
    """
    lex: list[tuple[str, str]] = []
    for m in _LEX.finditer(text.rstrip()):
        kind = m.lastgroup
        if kind == "bad":
            raise QuerySyntaxError(m.group())
        lex.append((kind, m[kind]))
    at = 0
    phrases: list[Phrase] = []
    groups: dict[int, Near] = {}

    def peek(*values: str) -> bool:
        return at < len(lex) and lex[at][0] != "string" and lex[at][1] in values

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(lex):
            raise QuerySyntaxError("end")
        at += 1
        return lex[at - 1]

    def string() -> list[str]:
        kind, value = take()
        if kind == "sign" or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise QuerySyntaxError(value)
        raw = value[1:-1].replace('""', '"') if kind == "string" else value
        return [w for w in re.split(r"[\W_]+", fold(raw)) if w]

    def phrase(column: str | None) -> object:
        nonlocal at
        initial = False
        if peek("^"):
            at += 1
            initial = True
        p = Phrase(string(), column=column, initial=initial)
        while peek("+"):
            at += 1
            p.words += string()
        if peek("*"):
            at += 1
            p.prefix = True
        if not p.words:
            return None  # a phrase without terms matches as if it weren't there
        phrases.append(p)
        return len(phrases) - 1

    def near(column: str | None) -> object:
        """Behind NEAR( : phrases, perhaps a comma and a distance, and the closing sign."""
        nonlocal at
        first, shape, distance = len(phrases), None, 10
        while not peek(")", ","):
            shape = join("and", shape, phrase(column))
        if peek(","):
            at += 1
            kind, value = take()
            if not value.isdigit():
                raise QuerySyntaxError(value)
            distance = int(value)
        if take()[1] != ")":
            raise QuerySyntaxError(")")
        if len(phrases) - first > 1:
            groups[first] = Near(phrases[first:], distance, column)
        return shape

    def primary(column: str | None) -> object:
        nonlocal at
        if lex[at : at + 2] == [("word", "NEAR"), ("sign", "(")]:
            at += 2
            return near(column)
        if peek("("):
            at += 1
            inner = either(column)
            if take()[1] != ")":
                raise QuerySyntaxError(")")
            return inner
        if at + 1 < len(lex) and lex[at][0] in ("word", "string") and lex[at + 1] == ("sign", ":"):
            name = lex[at][1].strip('"').lower()
            if name not in ("content", "tags"):
                raise QuerySyntaxError(f"no column {name}")
            at += 2
            return primary(name)
        return phrase(column)

    def implicit(column: str | None) -> object:
        first, left, grouped = at, None, peek("(")
        while at < len(lex) and not peek(")", "AND", "OR", "NOT"):
            if left is not None and (grouped or peek("(")):  # phrases stand side by side, groups need an operator
                raise QuerySyntaxError(lex[at][1])
            left = join("and", left, primary(column))
        if at == first:
            raise QuerySyntaxError(lex[at][1] if at < len(lex) else "end")
        return left

    def join(kind: str, left: object, right: object) -> object:
        if left is None or right is None:
            return left if right is None else None if kind == "not" else right
        return (kind, left, right)

    def level(kind: str, word: str, inner):
        def run(column: str | None) -> object:
            nonlocal at
            left = inner(column)
            while peek(word):
                at += 1
                left = join(kind, left, inner(column))
            return left

        return run

    either = level("or", "OR", level("and", "AND", level("not", "NOT", implicit)))
    shape = either(None)
    if at < len(lex) or not lex:
        raise QuerySyntaxError("unread" if lex else "empty")
    return Query(shape, phrases, groups)


def _holds(shape: object) -> Column:
    if shape is None:
        return F.lit(False)
    if isinstance(shape, int):
        return F.col(f"tf{shape}") > 0
    kind, left, right = shape
    a, b = _holds(left), _holds(right)
    return a & b if kind == "and" else a | b if kind == "or" else a & ~b


def placed(query: Query, named: dict[tuple[str, bool], int]) -> dict[str, Column]:
    """``any<number>`` and ``tf<number>`` as ``standing`` and ``counting`` give them, from the places of each word.

    ``named`` says in which columns ``c<k>`` and ``t<k>`` a word's places in content and tags are, counted from 1; a prefix is a word of its own.
    """

    def stands(p: Phrase, side: str) -> Column:
        at = [F.col(f"{side}{named[w, p.prefix and i == len(p.words) - 1]}") for i, w in enumerate(p.words)]
        first = F.coalesce(at[0], F.array().cast("array<int>"))
        if p.initial:
            first = F.filter(first, lambda x: x == 1)
        for i, c in enumerate(at[1:], 1):
            first = F.array_intersect(first, back(c, i))
        return first

    def back(places: Column, by: int) -> Column:
        return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda x: x - by)

    sides = {side: [stands(p, side) for p in query.phrases] for side in "ct"}
    hits = [F.size(sides["c"][i]) if p.column == "content" else F.size(sides["t"][i]) if p.column == "tags" else F.size(sides["c"][i]) + F.size(sides["t"][i]) for i, p in enumerate(query.phrases)]
    out = {f"any{i}": h for i, h in enumerate(hits)} | {f"tf{i}": h for i, h in enumerate(hits)}
    for first, group in query.near.items():
        numbers = range(first, first + len(group.phrases))
        both = group.placed([sides["c"][i] for i in numbers], [sides["t"][i] for i in numbers])
        out |= {f"tf{i}": both[i - first] for i in numbers}
    return out


def best(docs: DataFrame, parsed: Query, n: Column, mean: Column, limit: int | None, digits: int = 6) -> DataFrame:
    """``(rank, id, score)`` of counted documents ``(id, length, archived, insert_seq, any<number>, tf<number>)``; all without a rank if there is no limit.

    How many documents a phrase is in comes from the same rows; ``n`` documents of ``mean`` length are in the collection.
    """
    numbers = range(len(parsed.phrases))
    df = docs.agg(F.struct(*[F.count_if(F.col(f"any{i}") > 0).alias(f"df{i}") for i in numbers]).alias("t")).scalar()
    rows = docs.where(~F.col("archived") & _holds(parsed.shape)).withColumn("t", df)
    score = F.lit(0.0)
    for i in numbers:
        idf = F.log((n - F.col(f"t.df{i}") + 0.5) / (F.col(f"t.df{i}") + 0.5))
        tf = F.col(f"tf{i}").cast("double")
        score = score - F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    order = [F.asc("score"), F.asc("insert_seq")]
    scored = rows.select("id", F.round(score, digits).alias("score"), "insert_seq")
    if limit is None:
        return scored.select("id", "score")
    return scored.orderBy(*order).limit(limit).select(F.row_number().over(W.orderBy(*order)).cast("int").alias("rank"), "id", "score")


def search(memories: DataFrame, query: str, limit: int | None = 20, digits: int = 6) -> DataFrame:
    """``(rank, id, score)`` of visible rows that match, best (lowest) score first, ties by insert_seq.

    Score is minus the BM25 sum over the query's phrases; archived rows count in the statistics. A
    query with a syntax error matches nothing.
    """
    try:
        parsed = parse_query(query)
    except QuerySyntaxError:
        return memories.sparkSession.createDataFrame([], "rank int, id string, score double")
    length = {"length": F.size("content_terms") + F.size("tag_terms")}
    docs = indexed(memories).withColumns(parsed.standing() | length).withColumns(parsed.counting()).drop("content_terms", "tag_terms")
    totals = docs.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean")).alias("t")).scalar()
    return best(docs.withColumn("all", totals), parsed, F.col("all.n"), F.col("all.mean"), limit, digits)
