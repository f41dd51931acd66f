"""Secret scans: known shapes of credentials, and random strings that a token vocabulary can't abbreviate.

Known shapes (``base`` spans, by fixed patterns): ``assign``, a value put to a
name such as password or token; ``access``, access key ids; ``hex``, long
hexadecimal runs. Each kind is matched leftmost and without overlaps, on whole
texts, ASCII letters only where case doesn't matter.

Random strings (``random`` spans): a maximal run of ``RUN_CHARS`` or more
characters of base64 and its URL form is a candidate. Words of any language
that a byte-pair vocabulary has met are written with few tokens, random
characters with many: a candidate is a secret if it has fewer than ``RATIO``
characters to a token. Left out before that test are *digests* (hexadecimal
runs as long as a common digest, and subresource integrity values) and
*identifiers* (numbers and dates, UUIDs, account numbers, plain words, and
names that are words joined by case or by marks). A candidate inside a base
span is no span of its own, as the base span has it. A random string of
letters of one case is taken for a word: that is the price of leaving
compound words alone.

A span is ``kind:start:end``: code points of the whole match, end exclusive.
A null or empty text has no spans; a text of any length is searched whole;
equal texts have equal spans, and repeated rows each keep their row. Bytes
that are no UTF-8 count as replacement marks. Only the id and the text are
read, so further columns of any name do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from plumbline.llm.common import map_texts

#: Fixed patterns and least lengths of the base kinds, in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
VALUE_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
#: Names of secrets, as they are looked for before the pattern is tried.
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A random string has this many characters at least, and fewer characters to a token than this. By the
#: vocabulary of 50k tokens, 98 of 100 strings of random letters and digits have fewer; of words, 1 of 100.
RUN_CHARS, RATIO = 20, 1.9
#: A longer run is encoded in pieces of this many characters, so that its cost grows with its length.
PIECE_CHARS = 4096
#: Hexadecimal digits of the common digests.
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)


def _classes(chars: bytes) -> bytes:
    """A table that turns the given bytes to ``x`` and all else to blanks."""
    return bytes(120 if b in chars else 32 for b in range(256))


_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_HEX_CLASS = _classes(b"0123456789abcdef")
_RUN_CLASS = _classes(b"0123456789+/_=-" + _LETTERS)
_RUN = re.compile(b"x{%d,}" % RUN_CHARS)

_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_INTEGRITY = re.compile(r"sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)")
_NUMBER = re.compile(r"[0-9+/_=-]*")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{13,32}")
_PART = re.compile(r"[A-Z]*[a-z]+|[A-Z]+|[0-9]+")


def is_digest(run: str) -> bool:
    """A hexadecimal run of one case with a digest's length, or an integrity value."""
    return (len(run) in DIGEST_CHARS and _DIGEST.fullmatch(run) is not None) or _INTEGRITY.fullmatch(run) is not None


def is_identifier(run: str) -> bool:
    """A number, a date, a UUID, an account number, or words (and numbers) joined by case or by marks."""
    if _NUMBER.fullmatch(run) or _UUID.fullmatch(run) or _ACCOUNT.fullmatch(run):
        return True
    parts = _PART.findall(run)
    words = [p for p in parts if not p.isdigit()]
    return sum(map(len, words)) >= 4 * len(words) and sum(map(len, parts)) >= 4 * (len(parts) - 1)


@lru_cache(2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def characters_per_token(encoding, run: str) -> float:
    """Characters of ``run`` to a token, whole, in pieces of ``PIECE_CHARS``."""
    pieces = [run[k : k + PIECE_CHARS] for k in range(0, len(run), PIECE_CHARS)]
    return len(run) / sum(len(encoding.encode_ordinary(p)) for p in pieces)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in bytes, in the order of starts and then kinds."""
    found = []
    lower = text.lower()  # bytes: A-Z only
    starts = []
    for name in NAMES:
        at = lower.find(name)
        while at >= 0:
            starts.append(at)
            at = lower.find(name, at + 1)
    upto = 0
    for at in sorted(starts):  # where a match can begin; each is tried unless an earlier match covers it
        if at >= upto and (m := ASSIGN.match(text, at)):
            upto = m.end()
            if m.end(2) - m.start(2) >= VALUE_CHARS:
                found.append((at, upto, 0))
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if b"x" * HEX_CHARS in text.translate(_HEX_CLASS):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def random_spans(text: bytes, base: list[tuple[int, int, int]], encoding) -> list[tuple[int, int, int]]:
    """Runs that the vocabulary finds random and no base span covers."""
    shape = text.translate(_RUN_CLASS)
    if b"x" * RUN_CHARS not in shape:
        return []
    out = []
    for m in _RUN.finditer(shape):
        a, b = m.span()
        run = text[a:b].decode("ascii")
        if is_digest(run) or is_identifier(run) or any(s <= a and b <= e for s, e, _ in base):
            continue
        if characters_per_token(encoding, run) < RATIO:
            out.append((a, b, 3))
    return out


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points; the text is read once, however many there are."""
    if not spans or text.isascii():
        return spans
    place, at, count = {}, 0, 0
    for end in sorted({p for s in spans for p in s[:2]}):
        count += len(text[at:end].decode("utf-8"))
        place[end], at = count, end
    return [(place[a], place[b], k) for a, b, k in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_text(text: bytes | None, encoding) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text's UTF-8 bytes, in code points, by start and then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = random_spans(text, base, encoding)
    every = in_code_points(text, sorted(base + more, key=lambda s: (s[0], s[2])))
    return [s for s in every if s[2] < 3], every


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (some 800 kB), read once at the driver."""
    with open(path, "rb") as f:
        return f.read()


def scan(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each whole text, in one narrow pass."""

    def make():
        encoding = _encoding(ranks, pattern)

        def of(texts):
            out = []
            for t in texts:
                base, every = scan_text(t, encoding)
                counts = [0, 0, 0, 0]
                for s in every:
                    counts[s[2]] += 1
                out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            return out

        return of

    schema = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return map_texts(docs, schema, make, id_col, text_col, as_bytes=True)
