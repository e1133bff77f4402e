"""Byte-level BPE by prefix dynamic programming.

For a fixed merge table every byte prefix of a pre-token has exactly one valid last token: the
one that ends the prefix's own encoding. The table of these last tokens is built left to right;
a token is the last one of prefix ``i`` if it ends there and stands stably beside the last
token of the prefix it leaves over. Following the table back from the end gives the encoding.
A longer text keeps the table of its prefix, so text can be appended, and an edit redoes only
the pre-tokens it touches.
"""

from __future__ import annotations

import base64
import re
from array import array
from dataclasses import dataclass, field

import regex

# The published pre-token pattern of the 50k byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Unicode White_Space, written out because Python's ``\s`` also has U+001C..U+001F.
_SPACE = "\t-\r \x85\xa0  -     　"

#: A chunk is a run without white space and the blank before it, or white space as the
#: pre-token pattern takes it. Pre-tokens never cross a chunk, so chunks can be cached.
CHUNK = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Characters from which a text is encoded chunk by chunk instead of from a list of all its chunks.
LONG = 1_000_000

#: Entries of the chunk cache of a worker; beyond it the cache starts anew. Results don't depend on it.
CACHE_ENTRIES = 400_000


#: Pairs of tokens a worker remembers to stand stably; beyond it they are judged anew.
PAIR_ENTRIES = 2_000_000


class BytePairEncoder:
    """Encoder over a rank file (``base64(token) rank`` a line)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        ending: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 1:
                ending.setdefault(token[-2:], set()).add(len(token))
        #: Of the last two bytes of a prefix, how long its last token may be.
        self.lengths = {k: (*sorted(v, reverse=True), 1) for k, v in ending.items()}
        self.pattern = regex.compile(PRE_TOKEN)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}

    # -- the merge order ----------------------------------------------------------------
    def _merged(self, piece: bytes, below: int) -> list[bytes]:
        """``piece`` merged pair by pair, lowest rank first, with ranks under ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1], below)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte or a token no merge reaches."""
        if token not in self._halves:
            piece = self.bytes_of[token]
            parts = self._merged(piece, token) if len(piece) > 1 else ()
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def stable(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are encoded together.

        The two tokens are taken apart, latest merge first, along the edge at which they meet. At
        each state the edge has one pair; had its merge come before the merge that was taken
        apart last, it would have crossed the edge.
        """
        known = self._stable.get((left, right))
        if known is not None:
            return known
        a, b, before, answer = left, right, 1 << 62, True
        while True:
            crossing = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if crossing is not None and crossing < before:
                answer = False
                break
            split_a, split_b = self.halves(a), self.halves(b)
            if split_a is None and split_b is None:
                break
            # Of equal pairs the left one merges first, so a tie at the right half counts as later.
            if split_b is None or (split_a is not None and a > b):
                before, a = a, split_a[1]
            else:
                before, b = b + 1, split_b[0]
        if len(self._stable) >= PAIR_ENTRIES:
            self._stable.clear()
        self._stable[left, right] = answer
        return answer

    # -- prefix tables ------------------------------------------------------------------
    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """The last token of each prefix of ``piece``; ``last`` has those known so far (index 0 is the first byte)."""
        ranks, lengths = self.ranks, self.lengths
        for end in range(len(last) + 1, len(piece) + 1):
            for n in lengths.get(piece[max(0, end - 2) : end], (1,)):
                start = end - n
                token = ranks.get(piece[start:end]) if start >= 0 else None
                if token is None:
                    continue
                if self.reachable(token) if start == 0 else self.stable(last[start - 1], token) and self.reachable(token):
                    last.append(token)
                    break
            else:  # pragma: no cover - every byte is a token, so a last token exists
                raise ValueError("vocabulary lacks a byte")
        return last

    def _back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None and self.reachable(whole) else self._back(self.extend(piece, []))

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        ids = self._chunks.get(chunk)
        if ids is None:
            ids = tuple(i for piece in self.pattern.findall(chunk) for i in self.encode_piece(piece.encode()))
            if len(chunk) <= 64:
                if len(self._chunks) >= CACHE_ENTRIES:
                    self._chunks.clear()
                self._chunks[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int] | array:
        """Ids of ``text`` as it stands; an empty list for null and empty texts."""
        if not text:
            return []
        known = self._chunks.get
        if len(text) > LONG:
            long_ids = array("i")
            for m in CHUNK.finditer(text):
                long_ids.extend(known(m.group()) or self.chunk_ids(m.group()))
            return long_ids
        ids: list[int] = []
        for chunk in CHUNK.findall(text):
            ids += known(chunk) or self.chunk_ids(chunk)
        return ids

    def count(self, text: str | None) -> int:
        """How many ids ``encode`` gives."""
        if not text:
            return 0
        known = self._chunks.get
        if len(text) > LONG:
            return sum(len(known(m.group()) or self.chunk_ids(m.group())) for m in CHUNK.finditer(text))
        return sum([len(known(chunk) or self.chunk_ids(chunk)) for chunk in CHUNK.findall(text)])


@dataclass
class EncodedText:
    """A text with the prefix table of each pre-token: appends and edits redo only what they touch."""

    encoder: BytePairEncoder
    text: str = ""
    starts: list[int] = field(default_factory=list)
    tables: list[list[int]] = field(default_factory=list)
    redone: int = 0  # bytes put through the dynamic programme by the last call

    def __post_init__(self) -> None:
        text, self.text = self.text, ""
        if text:
            self.append(text)

    @property
    def ids(self) -> list[int]:
        return [i for table in self.tables for i in self.encoder._back(table)]

    def append(self, more: str) -> EncodedText:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> EncodedText:
        """Put ``new`` in place of ``text[start:end]``.

        Pre-tokens are cut anew from the one before the edit (its look-ahead may see the edit) until
        a cut falls on an old one behind it; from there the old tables hold.
        """
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        keep = max(0, next((i for i, s in enumerate(self.starts) if s >= start), len(self.starts)) - 2)
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end and s > start}
        starts, tables, self.redone = self.starts[:keep], self.tables[:keep], 0
        at = self.starts[keep] if keep < len(self.starts) else 0
        for m in self.encoder.pattern.finditer(text, at):
            if m.start() >= start + len(new) and (i := old.get(m.start())) is not None and m.start() > at:
                starts += [s + shift for s in self.starts[i:]]
                tables += self.tables[i:]
                break
            piece = m.group().encode()
            table: list[int] = []
            j = len(starts)
            if j < len(self.starts) and self.starts[j] == m.start():  # the same start: keep the common prefix's table
                before = self.text[self.starts[j] : self.starts[j + 1] if j + 1 < len(self.starts) else len(self.text)].encode()
                same = next((k for k, (x, y) in enumerate(zip(before, piece)) if x != y), min(len(before), len(piece)))
                table = self.tables[j][:same]
            self.redone += len(piece) - len(table)
            starts.append(m.start())
            tables.append(self.encoder.extend(piece, table))
        self.text, self.starts, self.tables = text, starts, tables
        return self


_ENCODERS: dict[int, BytePairEncoder] = {}


def encoder_of(rank_file: bytes) -> BytePairEncoder:
    """One encoder for each vocabulary and worker process."""
    key = hash(rank_file)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(rank_file)
    return _ENCODERS[key]
