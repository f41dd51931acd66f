"""Token counts by prefix dynamic programming over a sentencepiece BPE model.

The encoding of a prefix is unique, and a sequence of tokens is an encoding
if and only if each neighbouring pair encodes to itself. So the last token of
each prefix is the one piece that ends there and stands well beside the last
token of the prefix before it, and

    count[i] = count[i - length(last[i])] + 1.

One left-to-right pass thus stores the exact count at every prefix. Then "how
many tokens has this text", "how many have its first k characters" and "what
is the longest prefix within a budget" are look-ups; nothing is encoded again.

A word's marker opens a piece and never stands inside one after other
characters, and a line end is in no piece (both checked when the model is
read), so a text's counts are those of its segments, added up; segments are memoised, and long ones cost
time in proportion to their length.

A null text counts as empty: 0 bytes, 0 tokens. Empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, utf8

_SPACE = "▁"
_SEGMENTS = re.compile(r" *[^ \n]+| +|\n+")
#: Memoised segments and pairs in a worker; beyond that the tables start afresh.
MEMO_ROWS = 400_000
#: Longer segments aren't memoised.
MEMO_CHARS = 64


class PrefixCounter:
    """Counts at every prefix; made from the model's bytes, so tasks need no file."""

    def __init__(self, as_bytes: bytes):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=as_bytes)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        for i in range(n):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.ids[model.id_to_piece(i)] = i
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("pieces span words: prefix counts need a model whose pieces start at word marks")
        if any("\n" in p for p in self.ids):
            raise ValueError("pieces hold line ends: prefix counts need a model that spells them as bytes")
        if model.encode("ﬁ", out_type=str)[-1] != "ﬁ" and "ﬁ" in self.ids:
            raise ValueError("the model rewrites characters: prefix counts need one that leaves texts as they are")
        self.ends: dict = {}
        for piece, i in self.ids.items():
            at = self.ends
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = i
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(n)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.segments: dict[str, np.ndarray] = {}
        self.states: dict = {}
        self.nodes = 0
        self.lengths = list(map(len, self.pieces))
        self._probe = len(model.encode("\n"))  # what precedes a probed pair

    def stands(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b``, side by side, encode to themselves."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MEMO_ROWS:
                self.pairs.clear()
            both = (self.pieces[a] + self.pieces[b]).replace(_SPACE, " ")
            known = self.pairs[key] = self.model.encode("\n" + both)[self._probe :] == [a, b]
        return known

    def _of(self, segment: str) -> np.ndarray:
        """Counts at each prefix of a segment whose spaces are marks; at least one character.

        ``states`` is a trie of prefixes seen: each node has the prefix's count
        and last token, which depend on nothing after it. From the first new
        character on, tokens that end at it are found by walking ``ends``, a
        trie of the pieces read backwards.
        """
        count, last = [0], [-1]  # -1: the start, or byte pieces; nothing merges with them
        keep = len(segment) <= MEMO_CHARS
        if self.nodes > MEMO_ROWS:
            self.states, self.nodes = {}, 0
        node = self.states
        pairs, lengths, ends = self.pairs, self.lengths, self.ends
        for i, c in enumerate(segment):
            below = node.get(c) if keep else None
            if below is None:
                fits, at, j = [], ends, i
                while j >= 0 and (at := at.get(segment[j])) is not None:
                    if (b := at.get("")) is not None:
                        fits.append(b)
                    j -= 1
                for b in reversed(fits):
                    a = last[i + 1 - lengths[b]]
                    if a == -1 or (pairs[a, b] if (a, b) in pairs else self.stands(a, b)):
                        state = (count[i + 1 - lengths[b]] + 1, b)
                        break
                else:
                    if fits:
                        raise AssertionError(f"no token ends {segment[: i + 1]!r}")
                    state = (count[i] + len(utf8(c)), -1)
                if keep:
                    below = node[c] = {"": state}
                    self.nodes += 1
            else:
                state = below[""]
            if keep:
                node = below
            count.append(state[0])
            last.append(state[1])
        return np.array(count[1:], np.int32)

    def segment(self, segment: str) -> np.ndarray:
        """Counts at each prefix of a space-led segment."""
        known = self.segments.get(segment)
        if known is None:
            known = self._of(segment.replace(" ", _SPACE))
            if len(segment) <= MEMO_CHARS:
                if len(self.segments) > MEMO_ROWS:
                    self.segments.clear()
                self.segments[segment] = known
        return known

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Exact token counts of the first 0, 1, ... len(text) characters."""
        if not text:
            return np.zeros(1, np.int32)
        marked = (_SPACE + text.replace(" ", _SPACE)).replace(_SPACE, " ")
        known, of = self.segments.get, self.segment
        parts = []
        for s in _SEGMENTS.findall(marked):
            counts = known(s)
            parts.append(of(s) if counts is None else counts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.concatenate(parts)
        totals = out[np.cumsum(lengths) - 1]
        out = out + np.repeat(np.cumsum(totals) - totals, lengths)  # at each prefix of the marked text, one mark longer
        out[0] = 0  # the empty text has no tokens, not even the mark
        return out


@lru_cache(2)
def _counter(as_bytes: bytes) -> PrefixCounter:
    return PrefixCounter(as_bytes)


def read_model(path: str) -> bytes:
    """The model's bytes (some 500 kB), read once at the driver."""
    with open(path, "rb") as f:
        return f.read()


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The most leading characters that any prefix of at most ``budget`` tokens has."""
    return int(np.flatnonzero(counts <= budget)[-1])


def token_counts(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens, fits_chars) of each whole text.

    ``fits_chars``: characters of the longest prefix of at most ``limit``
    tokens, from the same table.
    """

    as_bytes = read_model(path)

    def make():
        counter = _counter(as_bytes)

        def of(texts):
            out = []
            for t in texts:
                counts = counter.prefix_counts(t)
                out.append((len(utf8(t)) if t else 0, int(counts[-1]), longest_within(counts, limit)))
            return out

        return of

    return map_texts(docs, "n_bytes long, n_tokens long, fits_chars long", make, id_col, text_col, memo=True)


def with_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
