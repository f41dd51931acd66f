"""Byte-level BPE: encoding and decoding of whole texts by the tokenizers library over Arrow batches.

A rank file lists byte strings in the order of their merges. Here it becomes a
tokenizers model: each byte is written as a printable character (the usual
byte-to-character table), a token's merge is the pair that its own bytes end
in when only lower ranks may merge, and a piece that is a token itself is
taken whole. Ids equal what merging by rank gives, as a lower-ranked merge
inside a token's bytes is never pre-empted from outside them.

Decoding reverses the byte table and joins bytes before it reads characters,
so a character that is split over tokens comes back whole. Offsets are byte
ends: token k covers bytes ``ends[k-1]`` to ``ends[k]`` of the text's UTF-8.

A null text counts as empty: no ids, no bytes. Ids are never special tokens:
their strings in a text are ordinary text. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_texts, utf8


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(extra)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def own_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that ``token`` is merged from by lower ranks; None where more parts remain."""
    parts = [bytes([b]) for b in token]
    while len(parts) > 2:
        best = min(
            ((r, k) for k in range(len(parts) - 1) if (r := ranks.get(parts[k] + parts[k + 1], rank)) < rank),
            default=None,
        )
        if best is None:
            return None
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


@lru_cache(2)
def tokenizer_json(path: str, pattern: str) -> str:
    """The rank file as a tokenizers model; a few MB, made once at the driver."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    chars = byte_characters()
    written = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := own_merge(token, rank, ranks)):
            merges.append(tuple(written[p] for p in pair))
    model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tokenizer.to_str()


#: Segments memoised in a worker, and the longest that is.
MEMO_ROWS, MEMO_CHARS = 200_000, 48
#: A single space between characters that aren't white space: no piece of the pattern spans the place before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Codec:
    """A tokenizer with its byte table; made from JSON alone, so tasks need no file."""

    def __init__(self, as_json: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(as_json)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(as_json)["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for written, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in written)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

        self.memo: dict[str, tuple[int, ...]] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. Segments between words recur, so a batch encodes only segments it hasn't seen."""
        cut = [_CUT.split("" if t is None else utf8(t).decode()) for t in texts]
        memo = self.memo
        if len(memo) > MEMO_ROWS:
            memo.clear()
        new = list({s for row in cut for s in row[1:]}.difference(memo))
        long = [s for s in new if len(s) > MEMO_CHARS]
        memo.update(zip(new, self._spaced(new), strict=True))
        heads = self._encode([row[0] for row in cut])
        known = memo.__getitem__
        out = [[*head, *chain.from_iterable(map(known, row[1:]))] for head, row in zip(heads, cut, strict=True)]
        for s in long:
            del memo[s]
        return out

    def _spaced(self, segments: list[str]) -> list[tuple[int, ...]]:
        """Ids of each segment led by a space: one text is encoded and cut where segments end."""
        out = []
        for a in range(0, len(segments), 2000):
            part = segments[a : a + 2000]
            ids = self._encode([" " + " ".join(part)])[0]
            stops = np.searchsorted(self.ends(ids), np.cumsum([len(s.encode()) + 1 for s in part]), side="left") + 1
            start = 0
            for stop in stops.tolist():
                out.append(tuple(ids[start:stop]))
                start = stop
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def ends(self, ids: list[int]) -> np.ndarray:
        """Where each token ends, in bytes of the text's UTF-8."""
        return np.cumsum(self.lengths[ids])


@lru_cache(2)
def _codec(as_json: str) -> Codec:
    return Codec(as_json)


def encode(
    docs: DataFrame, path: str, pattern: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>, decoded binary): ids of each whole text, and the bytes they decode to.

    With ``offsets``, also ends array<long>.
    """
    as_json = tokenizer_json(path, pattern)

    def make():
        codec = _codec(as_json)

        def of(texts):
            rows = [(ids, codec.decode(ids)) for ids in codec.encode(texts)]
            return [(*r, codec.ends(r[0]).tolist()) for r in rows] if offsets else rows

        return of

    schema = "ids array<int>, decoded binary" + ", ends array<long>" * offsets
    return map_texts(docs, schema, make, id_col, text_col, memo=True)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts of ids arrays; a null array gives null, bytes that are no UTF-8 become marks."""
    import pyarrow as pa

    as_json = tokenizer_json(path, pattern)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(as_json)
        for batch in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, F.col(ids_col).cast("array<int>")).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` returns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
