"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule reads one ratio of a whole text's counts. Inside its good range it
votes "good", beyond its bad limits it votes "bad", in between it abstains.
Every rule can vote both ways, and each kind of defect is seen by several
rules (symbols, say, by symbols, letters, word shapes and word ends), so that
rules can be weighed by how they agree.

What a text's rules say together is its pattern; only the number of texts with
each pattern matters for the fit. Spark counts the patterns of all texts;
expectation-maximisation then estimates, for each rule, how often its votes
are right on good texts and how often on bad ones, and the share of good
texts. What is believed beforehand weighs a fixed number of votes, so on a
large corpus the corpus decides. A text is kept if its posterior probability
of being good is at least ``KEEP``: no rule alone can reject it, unlike
all-must-pass filters.

A null or empty text has no words; all counts are zero, and the votes on them
decide. Texts are read whole however long they are. Ties and repeated rows:
equal texts have equal verdicts, and each row counts in the fit. Further
columns of any name are ignored, or passed on by ``keep_good``. Empty tables
give no rows. Rules on words abstain on scripts that are written without
spaces.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, map_texts, utf8
from plumbline.session import cut

#: Least posterior probability of a kept text.
KEEP = 0.5
#: Believed beforehand: the share of good texts, and how often a vote is right on a good and on a bad text (which
#: shows only some of the defects that rules look for). Each belief weighs as much as ``STRENGTH`` votes.
SHARE, RIGHT_ON_GOOD, RIGHT_ON_BAD, STRENGTH = 0.8, 0.95, 0.4, 200.0
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [
    *BASE, "n_upper", "n_letters", "n_wide", "n_lines", "n_marks", "n_distinct", "n_twins", "n_short", "n_ends", "n_shaped",
]

_MARKS = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])
_LETTER[0x2FFF] = True  # all scripts beyond count as letters
_UPPER = np.array([chr(c).isupper() for c in range(0x3000)])
#: Code points from here on are of scripts without spaces, mostly.
_WIDE = 0x2E80
_SPACE = rb"[\x20\x09-\x0D]"
#: A word that ends a sentence; a word of letters, perhaps quoted, with one mark at its end at most.
_END = re.compile(rb"[.!?](?=" + _SPACE + rb"|\Z)")
_SHAPED = re.compile(
    rb"(?:\A|(?<=" + _SPACE + rb"))[\"'(]?[A-Za-z\x80-\xff][A-Za-z\x80-\xff'\-]*+[\"')]?[.,;:?!]?(?=" + _SPACE + rb"|\Z)"
)


def word_repeats(words: list[bytes]) -> tuple[int, int, int]:
    """(distinct words, words equal to the one before, words in a three-word window that the text has twice or more)."""
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return n, 0, 0
    twins = int((ids[1:] == ids[:-1]).sum())
    if n < 4:
        return len(number), twins, 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) < 1_000_000:
        windows = pairs[:-1] * len(number) + ids[2:]
    else:  # beyond 63 bits: number the pairs first
        windows = np.unique(pairs[:-1], return_inverse=True)[1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return len(number), twins, int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = utf8(text)
    words = raw.split()
    chars = sum(map(len, words)) if len(raw) == len(text) else len(text) - sum(map(text.count, " \t\n\v\f\r"))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    symbols = sum(raw.count(bytes([s])) for s in SYMBOLS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = int((codes >= _WIDE).sum())
    codes = np.minimum(codes, 0x2FFF)
    upper, letters = int(_UPPER[codes].sum()), int(_LETTER[codes].sum())
    distinct, twins, repeated = word_repeats(words)
    short = int((np.fromiter(map(len, words), np.int64, len(words)) <= 3).sum())
    ends, shaped = len(_END.findall(raw)), len(_SHAPED.findall(raw))
    marks = sum(w in _MARKS for w in words)
    return len(words), chars, symbols, dup, repeated, upper, letters, wide, lines, marks, distinct, twins, short, ends, shaped


def counts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS...) of each whole text, in one narrow pass."""
    return map_texts(docs, ", ".join(f"{c} long" for c in COUNTS), lambda: lambda texts: list(map(text_counts, texts)), id_col, text_col)


@dataclass(frozen=True)
class Rule:
    """Votes good from ``good[0]`` to ``good[1]`` and bad below ``bad[0]`` or above ``bad[1]``, of one ratio of counts."""

    name: str
    good: tuple[float, float]
    bad: tuple[float, float]
    of: tuple[str, str]
    words: bool = True  # reads words as spaces part them
    logs: bool = False  # the ratio of logarithms

    def vote(self, c: dict[str, Column]) -> Column:
        """0 for bad, 2 for good, 1 for no opinion."""
        above, below = (c[n] for n in self.of)
        value = F.log1p(above) / F.log1p(F.greatest(below, F.lit(1))) if self.logs else above / F.greatest(below, F.lit(1))
        vote = F.when((value < self.good[0]) | (value > self.good[1]), 1).otherwise(2)
        vote = F.when((value < self.bad[0]) | (value > self.bad[1]), 0).otherwise(vote)
        return F.when(2 * c["n_wide"] > c["n_letters"], 1).otherwise(vote) if self.words else vote


_MOST = float("inf")
RULES = [
    Rule("letters", (0.93, _MOST), (0.9, _MOST), ("n_letters", "word_chars"), words=False),
    Rule("symbols", (0, 0.01), (0, 0.1), ("n_symbols", "n_words")),
    Rule("lone marks", (0, 0.01), (0, 0.1), ("n_marks", "n_words")),
    Rule("word shapes", (0.9, _MOST), (0.7, _MOST), ("n_shaped", "n_words")),
    Rule("capitals", (0, 0.1), (0, 0.4), ("n_upper", "n_letters"), words=False),
    Rule("sentence ends", (0.03, 0.2), (0, 0.4), ("n_ends", "n_words")),
    Rule("short words", (0.15, 0.45), (0.05, 0.7), ("n_short", "n_words")),
    Rule("repeated windows", (0, 0.1), (0, 0.3), ("n_repeat_words", "n_words")),
    Rule("twin words", (0, 0.03), (0, 0.1), ("n_twins", "n_words")),
    Rule("distinct words", (0.85, _MOST), (0.75, _MOST), ("n_distinct", "n_words"), logs=True),
    Rule("repeated lines", (0, 0.05), (0, 0.3), ("n_dup_lines", "n_lines"), words=False),
]


def pattern(c: dict[str, Column] | None = None) -> Column:
    """All rules' votes as one number in base three."""
    c = c or {n: F.col(n) for n in COUNTS}
    out = F.lit(0)
    for rule in RULES:
        out = out * 3 + rule.vote(c)
    return out.cast("int")


@dataclass
class Weights:
    """What EM estimates: the share of good texts, and how often each rule's votes are right on good and on bad texts."""

    share: float
    on_good: np.ndarray
    on_bad: np.ndarray


def believed(rules: int) -> Weights:
    """The starting values, and what the fit gives without texts."""
    return Weights(SHARE, np.full(rules, RIGHT_ON_GOOD), np.full(rules, RIGHT_ON_BAD))


def posterior(digits: np.ndarray, w: Weights) -> np.ndarray:
    """Probability that a text with these votes is good; abstaining says nothing."""
    good = np.log(w.on_good) - np.log(1 - w.on_bad)
    bad = np.log(1 - w.on_good) - np.log(w.on_bad)
    odds = np.log(w.share / (1 - w.share)) + ((digits == 2) * good + (digits == 0) * bad).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(digits: np.ndarray, counts: np.ndarray, rounds: int = 500) -> Weights:
    """Expectation-maximisation over pattern counts; beliefs are Beta priors of ``STRENGTH`` votes."""
    w = start = believed(digits.shape[1])
    up, down = digits == 2, digits == 0
    for _ in range(rounds):
        p = posterior(digits, w)
        good, bad = (counts * p)[:, None], (counts * (1 - p))[:, None]
        right = (good * up).sum(axis=0) + STRENGTH * start.on_good
        on_good = right / ((good * (up + down)).sum(axis=0) + STRENGTH)
        right = (bad * down).sum(axis=0) + STRENGTH * start.on_bad
        on_bad = right / ((bad * (up + down)).sum(axis=0) + STRENGTH)
        share = (float((counts * p).sum()) + STRENGTH * start.share) / (float(counts.sum()) + STRENGTH)
        new = Weights(share, np.clip(on_good, 1e-4, 1 - 1e-4), np.clip(on_bad, 1e-4, 1 - 1e-4))
        moved = abs(new.share - w.share) + np.abs(new.on_good - w.on_good).max() + np.abs(new.on_bad - w.on_bad).max()
        w = new
        if moved < 1e-10:
            break
    return w


def digits_of(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(RULES) - 1, -1, -1)) % 3


def learn(counted: DataFrame) -> dict[int, float]:
    """Posterior of each pattern that occurs; the counts of all texts decide.

    At most 3**11 = 177,147 patterns come to the driver, whatever the corpus;
    votes go together, so a corpus shows some hundreds.
    """
    rows = counted.groupBy(pattern().alias("pattern")).count().collect()
    if not rows:
        return {}
    patterns, counts = (np.array(x) for x in zip(*((r[0], r[1]) for r in sorted(rows)), strict=True))
    digits = digits_of(patterns)
    return dict(zip(patterns.tolist(), posterior(digits, fit(digits, counts.astype(float))).tolist(), strict=True))


def base_failed(c: dict[str, Column] | None = None) -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    n, repeated = (c or {n: F.col(n) for n in COUNTS})["n_words"], (c or {n: F.col(n) for n in COUNTS})["n_repeat_words"]
    return (n < 50) | (100 * repeated > 50 * n)


def judge(counted: DataFrame, learnt: dict[int, float]) -> DataFrame:
    """Adds posterior and base_failed and kept: not base_failed, and good with probability ``KEEP`` or more."""
    spark = counted.sparkSession
    table = spark.createDataFrame(list(learnt.items()) or [(-1, 0.0)], "pattern int, posterior double")
    judged = counted.withColumn("pattern", pattern()).join(F.broadcast(table), "pattern").drop("pattern")
    judged = judged.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, posterior, base_failed, kept) of each text."""
    counted = cut(counts_of(docs, id_col, text_col))
    return judge(counted, learn(counted)).select(id_col, *BASE, "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose posterior says good, with their own columns.

    The votes alone decide: a text of few words is judged like any other, not
    turned away by a limit that it must pass. The fit and the filter each read
    the texts once; no text is shuffled.
    """
    bound_batches(docs.sparkSession)
    read = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

    @F.pandas_udf(read)
    def counts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS)

    held = docs.withColumn("__pl_counts", counts(F.col(text_col).cast("string")))
    c = {n: F.col("__pl_counts").getField(n) for n in COUNTS}
    learnt = learn(held.select(*[v.alias(n) for n, v in c.items()]))
    good = [k for k, p in learnt.items() if p >= KEEP]
    return held.where(pattern(c).isin(good)).drop("__pl_counts")
