"""Problem 8: text statistics of each document, and from them prose, list, table or junk.

All characters of a slice of documents lie in one code point array. Tables over code points give
each character its class; runs of characters are tokens, words and lines; sums over runs give the
statistics of all documents at once, without a loop over documents or characters.

Published rules with their fixed thresholds say what is wrong with a text, each failure with its
reason. They part good text from bad and know no list or table, so what a failing text is, or
whether it is prose all the same, is read from its layout.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnestra.llm.tokenize import slices
from mnestra.sources.tables import table

#: Bytes of text worked on at a time; some 40 bytes for each are held.
SLICE_BYTES = 1_000_000

#: Characters from which a text is worked on in parts, cut at line breaks only, so that no statistic changes.
LONG = 1_000_000

#: The list of common words is shared with every task; more than this many is refused.
MOST_COMMON_WORDS = 100_000

SPACE, BREAK, LETTER, DIGIT, PUNCT, SYMBOL = range(6)
# Signs that plain writing uses, and signs of line ends, sentence ends, bullets and cells.
_PLAIN = set(".,;:!?()[]'\"%/-&+=°§–—‐‑’‘“”„«»‚…·|•½¼¾±×⁻")
_BREAKS = set("\n\r\x0b\x0c\x85\u2028\u2029")
_LINE_END = re.compile("[" + "".join(sorted(_BREAKS)) + "]")
_STOPS = ".!?…。"
_LINE_STOPS = _STOPS + ":\"”»"
_BULLETS = "-–—*•·‣▪o"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case, and whether a vowel or a hexadecimal digit, by code point.

    Format and control signs (soft hyphens, zero-width blanks) count as letters of a word's run
    nowhere: they are plain signs, so that they damage no statistic.
    """
    size = 0x110000
    kind, lower = np.full(size, SYMBOL, "u1"), np.arange(size, dtype="u4")
    vowel, hexa = np.zeros(size, bool), np.zeros(size, bool)
    for c in range(0x30000):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if ch in _BREAKS:
            kind[c] = BREAK
        elif cat[0] == "Z" or ch in "\t\x1c\x1d\x1e\x1f":
            kind[c] = SPACE
        elif cat[0] in "LM":
            kind[c] = LETTER
            low = ch.lower()
            if len(low) == 1:
                lower[c] = ord(low)
            vowel[c] = unicodedata.normalize("NFD", low)[0] in "aeiouyæœø"
        elif cat[0] == "N":
            kind[c] = DIGIT
        elif ch in _PLAIN or cat in ("Cf", "Cc"):
            kind[c] = PUNCT
    hexa[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
    return kind, lower, vowel, hexa


def _one_of(codes: np.ndarray, signs: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in signs], codes.dtype))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run ``values[start:end]``."""
    size = 1 << max(10, int(len(values)).bit_length())
    total = np.empty(len(values) + 1, "u8")
    total[0] = 0
    np.cumsum((values.astype("u8") + np.uint64(1)) * _powers(_BASE, size)[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers(pow(_BASE, -1, 1 << 64), size)[starts]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype("u8")


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of lower-case words, as ``text_statistics`` takes them."""
    return np.unique(np.concatenate([np.zeros(0, "u8"), *[_hashes(np.array([ord(c) for c in w]), np.array([0]), np.array([len(w)])) for w in words if w]]))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the first and last are never inside."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, "i4")
    np.cumsum(mask, out=out[1:])
    return out


def _parts(text: str) -> Iterator[str]:
    """Pieces of a long text, each up to the first line break behind ``LONG`` characters; a longer line stays whole."""
    start = 0
    while start < len(text):
        m = _LINE_END.search(text, start + LONG - 1)
        cut = m.end() if m else len(text)
        yield text[start:cut]
        start = cut


def long_statistics(text: str, common: np.ndarray) -> dict[str, np.ndarray]:
    """``text_statistics`` of one long text, part by part: sums of the parts' counts, distinct tokens and pairs over all parts.

    Lines, and with them tokens and words, lie in one part each, so the result is that of the whole text.
    """
    out: dict[str, np.ndarray] = {}
    seen, pairs, held = np.zeros(0, "u8"), np.zeros(0, "u8"), np.zeros(0, "i8")
    for part in _parts(text):
        tokens: list[np.ndarray] = []
        for name, n in _statistics([part], common, tokens).items():
            out[name] = out.get(name, 0) + n
        seen = np.union1d(seen, tokens[0])
        pairs, at = np.unique(np.concatenate([pairs, tokens[1]]), return_inverse=True)
        held = np.bincount(at, np.concatenate([held, tokens[2]]), len(pairs))
    out["distinct"] = np.array([len(seen)], "f8")
    out["top_pair"] = np.array([held.max(initial=0)], "f8")
    return out


def text_statistics(texts: list[str | None], common: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text; zeros for null, empty and blank ones."""
    long = {i for i, t in enumerate(texts) if t and len(t) > LONG}
    out = _statistics([None if i in long else t for i, t in enumerate(texts)], common)
    for i in long:
        for name, n in long_statistics(texts[i], common).items():
            out[name][i] = n[0]
    return out


def _statistics(texts: list[str | None], common: np.ndarray, tokens: list[np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Counts of texts taken whole; of one text ``tokens`` gets the hashes of all tokens, and of all pairs with the characters they hold."""
    kind_of, lower_of, vowel_of, hex_of = _tables()
    n = len(texts)
    # A line break before and after each text keeps runs apart; it belongs to no run.
    code = np.frombuffer(("\n" + "".join(f"{t}\n" if t else "\n" for t in texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.cumsum([1, *[len(t or "") + 1 for t in texts]])
    first, ends_of = first[:n], first[1:] - 1
    kind, lower = kind_of[code], lower_of[code]
    out: dict[str, np.ndarray] = {}

    def per_doc(starts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Of runs that start there, by text: their number or the sum of their weights."""
        total = _sums(np.ones(len(starts), "i1") if weights is None else weights)
        at = np.searchsorted(starts, np.append(first, len(code)))
        return (total[at[1:]] - total[at[:-1]]).astype("f8")

    is_letter, is_digit = kind == LETTER, kind == DIGIT
    letters, digits, dark = _sums(is_letter), _sums(is_digit), _sums(kind >= LETTER)
    for name, total in (("letters", letters), ("digits", digits), ("dark", dark), ("symbols", _sums(kind == SYMBOL)), ("vowels", _sums(vowel_of[code])), ("replaced", _sums(code == 0xFFFD)), ("semicolons", _sums(code == ord(";")))):
        out[name] = (total[ends_of] - total[first]).astype("f8")

    # tokens: runs without white space
    ts, te = _runs(kind >= LETTER)
    token_len, token_letters, token_digits = te - ts, letters[te] - letters[ts], digits[te] - digits[ts]
    token_hash = _hashes(lower, ts, te)
    last = code[te - 1]
    token_doc = np.searchsorted(first, ts, "right").astype("u8")
    keyed = np.sort((token_doc << np.uint64(40)) | (token_hash >> np.uint64(24)))  # a slice has far fewer than 2**24 texts
    fresh = np.ones(len(keyed), bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    out["distinct"] = np.bincount((keyed[fresh] >> np.uint64(40)).astype("i8"), minlength=n + 1)[1 : n + 1].astype("f8")
    out["tokens"] = per_doc(ts)
    # pairs of tokens side by side on a line: how many characters the most frequent pair of a text holds
    breaks = _sums(kind == BREAK)
    side = np.flatnonzero(breaks[ts[1:]] == breaks[ts[:-1]])
    pair = (token_hash[side] * np.uint64(0xD6E8FEB86659FD93)) ^ token_hash[side + 1]
    pair = (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | token_doc[side] << np.uint64(40)
    order = np.argsort(pair, kind="stable")
    pair, held = pair[order], (token_len[side] + token_len[side + 1])[order]
    fresh = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, "i8")
    pair, held = pair[fresh], np.add.reduceat(held, fresh) if len(fresh) else held
    out["top_pair"] = np.zeros(n + 1)
    np.maximum.at(out["top_pair"], (pair >> np.uint64(40)).astype("i8"), held)
    out["top_pair"] = out["top_pair"][1:]
    if tokens is not None:
        tokens += [np.unique(token_hash >> np.uint64(24)), pair & np.uint64((1 << 40) - 1), held]
    sentence = _one_of(last, _STOPS) & (token_len >= 4) & ((token_letters >= 3) | (token_digits >= 1))  # not n.d. or Ex.
    hexa = _sums(hex_of[code])
    out["hex_tokens"] = per_doc(ts, (hexa[te] - hexa[ts] == token_len) & ((token_len == 2) | (token_len == 8)))
    out["letter_tokens"] = per_doc(ts, token_letters > 0)
    dot = code == ord(".")
    third = np.zeros(len(code), bool)  # the third full stop in a row, not the fourth
    third[3:] = dot[3:] & dot[2:-1] & dot[1:-2] & ~dot[:-3]
    marks = _sums((code == ord("…")) | (code == ord("#")) | third)
    out["marks"] = (marks[ends_of] - marks[first]).astype("f8")
    out["single_letters"] = per_doc(ts, (token_len == 1) & (token_letters == 1))

    # words: runs of letters
    ws, we = _runs(is_letter)
    out["words"], out["word_letters"] = per_doc(ws), per_doc(ws, we - ws)
    is_common = np.zeros(len(ws), bool)
    if len(common):
        h = _hashes(lower, ws, we)
        is_common = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    out["common_words"] = per_doc(ws, is_common)

    # lines with something on them
    ls, le = _runs(kind != BREAK)
    some = dark[le] > dark[ls]
    ls, le = ls[some], le[some]
    begin, end = np.searchsorted(ts, ls), np.searchsorted(ts, le)
    line_tokens = end - begin
    number_first = _one_of(last[begin], ").") & (token_digits[begin] > 0) & (token_digits[begin] == token_len[begin] - 1)  # 101. is no sentence
    sentence[begin[number_first]] = False
    out["sentences"] = per_doc(ts, sentence)
    sentence_sum, common_sum = _sums(sentence), _sums(is_common)
    line_sentences = sentence_sum[end] - sentence_sum[begin]
    line_common = common_sum[np.searchsorted(ws, le)] - common_sum[np.searchsorted(ws, ls)]
    stops = _one_of(last[end - 1], _LINE_STOPS)
    out["lines"], out["stopped_lines"] = per_doc(ls), per_doc(ls, stops)
    final = te[end - 1] - 1
    out["ellipsis_lines"] = per_doc(ls, (code[final] == ord("…")) | dot[final] & dot[final - 1] & dot[np.maximum(final - 2, 0)])
    out["short_lines"] = per_doc(ls, final + 1 - ts[begin] <= SHORT_LINE)
    head_len, head_digits, head_letters, head_last = token_len[begin], token_digits[begin], token_letters[begin], last[begin]
    counter = (head_len <= 5) & _one_of(head_last, ").") | (head_len <= 4) & (head_digits == head_len)
    out["symbols"] -= per_doc(ls, (head_len == 1) & _one_of(head_last, _BULLETS) & (kind[ts[begin]] == SYMBOL))  # a bullet is no damage
    out["bullet_lines"] = per_doc(ls, counter | (head_len == 1) & _one_of(head_last, _BULLETS))
    # rows: cells set apart by signs with no blank behind them or by wide gaps
    tight = np.zeros(len(code), bool)
    tight[:-1] = kind[1:] >= LETTER
    blank = kind == SPACE
    wide = np.zeros(len(code), bool)  # the third blank in a row, not the fourth
    wide[3:] = blank[3:] & blank[2:-1] & blank[1:-2] & ~blank[:-3]
    cells = np.zeros(len(ls), "i4")
    for mask in (code == ord("\t"), code == ord("|"), (code == ord(",")) & tight, (code == ord(";")) & tight, wide):
        total = _sums(mask)
        cells = np.maximum(cells, total[le] - total[ls])
    delimited = (cells >= 2) & (line_sentences <= 1)
    # rows set with single blanks: a label with a number, then cells
    label = (head_len <= 6) & (head_digits > 0) & (head_digits + 2 >= head_letters) | np.isin(token_hash[begin], word_hashes(["ex.", "no.", "nr."]))
    numbered = _one_of(head_last, ").") & (head_len <= 4) & (head_letters == 0) | number_first
    spaced = label & ~numbered & (line_tokens >= 4) & (line_sentences == 0) & ~_one_of(last[end - 1], ".;,:") & (line_common <= 0.34 * line_tokens)
    row = delimited | spaced
    entry = ~row & (line_sentences == 0) & (line_tokens <= 16) & ~stops
    out["row_tokens"], out["entry_tokens"] = per_doc(ls, np.where(row, line_tokens, 0)), per_doc(ls, np.where(entry, line_tokens, 0))
    return out


# Published rules for text of the web, with their thresholds as published.
# Gopher: Rae et al. 2021, "Scaling Language Models", table A1. FineWeb: Penedo et al. 2024, "The FineWeb Datasets", section 3.6.
SHORT_LINE = 30
PUBLISHED: list[tuple[str, str, Callable[[SimpleNamespace], np.ndarray]]] = [
    ("Gopher", "fewer than 50 words", lambda x: x.tokens < 50),
    ("Gopher", "more than 100,000 words", lambda x: x.tokens > 100_000),
    ("Gopher", "mean word length under 3", lambda x: x.dark < 3 * x.tokens),
    ("Gopher", "mean word length over 10", lambda x: x.dark > 10 * x.tokens),
    ("Gopher", "more than 0.1 symbols a word", lambda x: x.symbols + x.marks > 0.1 * x.tokens),
    ("Gopher", "more than 0.9 of lines begin with a bullet", lambda x: x.bullet_lines > 0.9 * x.lines),
    ("Gopher", "more than 0.3 of lines end in an ellipsis", lambda x: x.ellipsis_lines > 0.3 * x.lines),
    ("Gopher", "under 0.8 of words have a letter", lambda x: x.letter_tokens < 0.8 * x.tokens),
    ("Gopher", "fewer than 2 stop words", lambda x: x.common_words < 2),
    ("Gopher", "the most frequent pair of words holds more than 0.2 of the characters", lambda x: x.top_pair > 0.2 * x.dark),
    ("FineWeb", "at most 0.12 of lines end in punctuation", lambda x: x.stopped_lines <= 0.12 * x.lines),
    ("FineWeb", "0.67 or more of lines have at most 30 characters", lambda x: x.short_lines >= 0.67 * x.lines),
    ("FineWeb", "more than 0.3 line breaks a word", lambda x: x.lines - 1 > 0.3 * x.tokens),
]

#: What a text is by its layout, in the order in which these decide: kind, reason, and the test. These thresholds are this engine's own.
LAYOUT: list[tuple[str, str, Callable[[SimpleNamespace], np.ndarray]]] = [
    ("junk", "repeats a few tokens", lambda x: (x.distinct <= 8) & (x.tokens >= 6 * x.distinct) & ((x.tokens >= 40) | (x.distinct <= 4))),
    ("junk", "repeats a few tokens in one line", lambda x: (x.distinct <= 12) & (x.lines == 1) & (x.tokens >= 10 * x.distinct)),
    ("junk", "replacement signs", lambda x: x.replaced > 0.02 * x.dark),
    ("junk", "letters set apart", lambda x: (x.single_letters > 0.6 * x.tokens) & (x.tokens >= 15)),
    ("junk", "hexadecimal dump", lambda x: (x.hex_tokens > 0.8 * x.tokens) & (x.tokens >= 8)),
    ("junk", "words without vowels", lambda x: (x.vowels < 0.2 * x.letters) & (x.letters > 60) & (x.letters > 0.8 * x.dark) & (x.dark < 25 * x.tokens)),
    ("junk", "mostly signs", lambda x: x.letters + x.digits < 0.35 * x.dark),
    ("junk", "symbol ratio", lambda x: x.symbols > 0.06 * x.dark),
    ("junk", "mean word length", lambda x: x.word_letters > 10.5 * x.words),
    ("table", "rows of cells", lambda x: x.row_tokens >= 0.5 * x.tokens),
    ("junk", "mean token length", lambda x: x.dark > 16 * x.tokens),
    ("prose", "sentences", lambda x: x.sentences >= 0.012 * x.tokens),
    ("list", "entries set apart by semicolons", lambda x: x.semicolons >= 0.1 * x.tokens),
    ("list", "short lines without sentence ends", lambda x: x.entry_tokens >= 0.5 * x.tokens),
    ("junk", "no sentence, entry or common word", lambda x: (x.common_words < 0.1 * x.words) & (x.tokens > 14 * x.lines)),
    ("prose", "nothing against it", lambda x: x.tokens > 0),
]


def failures(counts: dict[str, np.ndarray]) -> list[list[str]]:
    """The published rules each text fails, as ``source: reason``; none for blank texts."""
    x = SimpleNamespace(**counts)
    out: list[list[str]] = [[] for _ in x.tokens]
    for source, why, test in PUBLISHED:
        for i in np.flatnonzero(test(x) & (x.tokens > 0)):
            out[i].append(f"{source}: {why}")
    return out


def judge(counts: dict[str, np.ndarray], failed: list[list[str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The kind of each text, None if blank, and the reason: the test that decided.

    A text is junk or a list only if it fails a published rule; a table may keep them all. A failing
    text that its layout shows to be prose stays prose.
    """
    x = SimpleNamespace(**counts)
    suspect = np.array([bool(f) for f in (failures(counts) if failed is None else failed)], bool)
    kind, reason = np.full(len(x.tokens), None, object), np.full(len(x.tokens), None, object)
    for name, why, test in LAYOUT:
        hit = test(x) & (x.tokens > 0) & (kind == None)  # noqa: E711
        if name in ("junk", "list"):
            hit &= suspect
        kind[hit], reason[hit] = name, why
    return kind, reason


def _common(words: DataFrame) -> np.ndarray:
    """The lower-case words of all languages together: a document's own language may be null or wrong."""
    rows = words.select(F.lower(F.trim("word")).alias("w")).where("w <> ''").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    return word_hashes(sorted(r[0] for r in rows))


_RATIOS = {
    "mean_word_length": ("dark", "tokens"), "symbol_ratio": ("symbols", "dark"), "share_lines_stopped": ("stopped_lines", "lines"), "share_bullet_lines": ("bullet_lines", "lines"),
    "share_common_words": ("common_words", "words"), "share_row_tokens": ("row_tokens", "tokens"), "share_entry_tokens": ("entry_tokens", "tokens"),
    "share_ellipsis_lines": ("ellipsis_lines", "lines"), "share_short_lines": ("short_lines", "lines"), "share_letter_words": ("letter_tokens", "tokens"), "share_top_pair": ("top_pair", "dark"),
}


def quality_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its statistics, the published rules it fails, its kind, and the layout test that decided.

    A word of ``word_count`` and ``mean_word_length`` is a run without white space; of
    ``share_common_words`` a run of letters. Shares of nothing are 0. Null, empty and blank texts
    have counts of 0 and a null kind. Whole texts are read, whatever their length, long ones in parts cut at line breaks, so a
    task holds some 40 bytes for each character of a slice or of its longest line; equal rows stay
    as many as they are. No shuffle.
    """
    common = _common(common_words)
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1), SLICE_BYTES):
                counts = text_statistics(batch.column(1).slice(start, n).to_pylist(), common)
                failed = failures(counts)
                kind, reason = judge(counts, failed)
                ratios = [np.round(counts[a] / np.maximum(counts[b], 1), 6) for a, b in _RATIOS.values()]
                columns = [pa.array(counts["tokens"].astype("i8")), pa.array(counts["lines"].astype("i8")), pa.array(counts["dark"].astype("i8")), *map(pa.array, ratios), pa.array(counts["sentences"].astype("i8")), pa.array(counts["distinct"].astype("i8")), pa.array(kind, pa.string()), pa.array(reason, pa.string()), pa.array(failed, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), *columns], names=[id_col, "word_count", "line_count", "word_chars", *_RATIOS, "sentence_count", "distinct_words", "kind", "reason", "failed"])

    shape = ", ".join(f"{c} double" for c in _RATIOS)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_of_id}, word_count long, line_count long, word_chars long, {shape}, sentence_count long, distinct_words long, kind string, reason string, failed array<string>")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not prose."""
    return p8_statistics(spark, sf_dir).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, lines and characters of words of each document: what SQL can count as well."""
    return p8_statistics(spark, sf_dir).select("doc_id", "word_count", "line_count", "word_chars")


_WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_COUNTS_SQL = rf"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^{_WHITE}]+')) AS word_count,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x0a-\x0d\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WHITE}]'))) AS line_count,
  length(regexp_replace(coalesce(text, ''), '[{_WHITE}]', '', 'g')) AS word_chars FROM documents"""

SQL = {"p8_counts": _COUNTS_SQL}
