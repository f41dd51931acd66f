"""Source divergence audit: term counts by source, recounted through minimal perfect hashes.

First pass, exact: in how many documents of a language each term occurs; terms
of ``LEAST_DOCS`` documents or more are kept. Kept terms are dealt into shards
of ``SHARD_KEYS`` or so by a hash, and a task builds a minimal perfect hash of
each shard: level by level, keys that alone hit a bit of a bit array set it, and
the rest go on to the next level; a key's slot is the number of bits set before
its own. A shard stores its keys by slot, so that a term that isn't kept, whose
bits mean nothing, is told by comparing it with the key stored there.

Second pass: shards are sent to every task, ``BROADCAST_BYTES`` at most; if all
don't fit, the pass is made again for the next ones, so nothing that is sent
grows with the corpus. Texts are read whole; counts of one group's equal terms
are added up in the task (a bounded number of them at a time), looked up, and
sent as (shard, slot, count). They are added up first for each share of the
tasks, so that a group with any share of the rows is no one task's, and then a
fold increments the dense slots of one group and shard at a time.

Probabilities are p = 1 + floor(10**9 * (count + 1) / (N + V)) and divergences
f = floor((p - q)**2 / q), in whole numbers. Groups of one language and shard
meet in blocks of ``SOURCE_BLOCK`` sources; a pair of blocks is a task, which
returns one sum for each pair of sources and its shard's first terms of each
source. Terms that neither block has count as one term times their number.

Null language, source or text counts as the empty one. A term's case counts
for A-Z only as none. An empty text makes its (language, source) group occur,
without terms. Repeated rows are documents of their own. A language without
kept terms gives pairs of value 0 and no terms; a source that is its language's
only one has no pair. Equal values are ranked by UTF-8 bytes. Bytes that are no
UTF-8 count as replacement marks. Only text, lang and source are read, so
further columns of any name do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import bound_batches, map_sorted_groups
from plumbline.session import cut

#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCS = 3
#: Keys in a shard, about; sources in a block, about.
SHARD_KEYS, SOURCE_BLOCK = 16_384, 32
#: Bytes of shards that are sent to every task at a time.
BROADCAST_BYTES = 64 << 20
#: Different terms that a task counts at a time (some 50 MB).
HELD_TERMS = 200_000
#: What probabilities are multiples of one part of.
UNIT = 1_000_000_000
TOP_TERMS = 200

_TERM_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters and non-ASCII characters, A-Z lower-cased, of UTF-8 bytes."""
    return text.translate(_TERM_BYTES).split()


def key_hash(lang_hash: int, term: bytes) -> int:
    """XXH64 of a term, seeded by its language's: what Spark's ``xxhash64(lang, term)`` gives, unsigned."""
    return xxhash.xxh64_intdigest(term, lang_hash)


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    x = (hashes ^ (hashes >> np.uint64(32))) * _ODD + np.uint64((level * 0xD6E8FEB86659FD93 + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes: levels of bit words, each with the bits set before it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, n = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.n = n

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            words = max(1, math.ceil(2 * len(left) / 64))
            at = (_mixed(left, len(levels)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash that was given, some slot or -1 of any other."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            if not len(left):
                break
            at = _mixed(hashes[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            under = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = before[word[hit]] + np.bitwise_count(under)
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with its keys: (language, term) by slot."""

    def __init__(self, levels: list[bytes], langs: list[str], lang_of: bytes, keys: bytes):
        self.hash = PerfectHash([np.frombuffer(x, np.uint64) for x in levels])
        self.keys = keys.split(b"\n")  # no term holds a line end
        self.lang_of = [langs[k] for k in np.frombuffer(lang_of, np.int32).tolist()]
        # keys that share all 64 bits of their hash with another stand behind the hashed ones and are looked up by name
        self.rest = {(self.lang_of[k], self.keys[k]): k for k in range(self.hash.n, len(self.keys))}

    @staticmethod
    def parts(langs: np.ndarray, terms: np.ndarray, hashes: np.ndarray) -> dict:
        """Level words, languages, each slot's language and keys of a shard's kept terms."""
        _, first = np.unique(hashes, return_index=True)
        hashed = PerfectHash.of(hashes[first])
        order = np.empty(len(first), np.int64)
        order[hashed.slots(hashes[first])] = first
        order = np.concatenate((order, np.setdiff1d(np.arange(len(hashes)), first)))
        names, lang_of = np.unique(langs[order].astype(object), return_inverse=True)
        return {
            "levels": [x.tobytes() for x in hashed.levels],
            "langs": names.tolist(),
            "lang_of": lang_of.astype(np.int32).tobytes(),
            "keys": b"\n".join(terms[order].tolist()),
        }

    def find(self, langs: list[str], terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Each term's slot, -1 where it isn't kept: the key stored at its slot is another."""
        slots = self.hash.slots(hashes)
        keys, lang_of = self.keys, self.lang_of
        same = [s >= 0 and keys[s] == t and lang_of[s] == x for s, t, x in zip(slots.tolist(), terms, langs, strict=True)]
        slots[~np.array(same, bool)] = -1
        if self.rest:
            for k in np.flatnonzero(slots < 0).tolist():
                slots[k] = self.rest.get((langs[k], terms[k]), -1)
        return slots


#: The shards of one broadcast, unpacked once in a worker.
_UNPACKED: dict[str, dict[int, Shard]] = {}


def unpacked(name: str, rows: Callable[[], list[tuple]]) -> dict[int, Shard]:
    if name not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[name] = {r[0]: Shard(*r[1:]) for r in rows()}
    return _UNPACKED[name]


def texts_of(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, text as UTF-8), nulls as empty."""
    plain = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))


def kept_terms(texts: DataFrame, least: int, most: int = HELD_TERMS) -> DataFrame:
    """(lang, term) of the terms that at least ``least`` documents of the language have, in the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        held = 0

        def out():
            for lang, counter in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())],
                    ["lang", "term", "n"],
                )
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counter = seen.setdefault(lang, Counter())
                before = len(counter)
                counter.update(set(terms_of(text)))
                held += len(counter) - before
                if held > most:
                    yield from out()
                    held = 0
        yield from out()

    partly = texts.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    counted = partly.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return cut(counted.select("lang", F.col("term").cast("string").alias("term")))


def build_shards(kept: DataFrame, n_shards: int) -> DataFrame:
    """(shard, levels, langs, lang_of, keys, bytes): a perfect hash with stored keys for each shard."""
    h = F.xxhash64("lang", "term")
    dealt = kept.select("lang", F.col("term").cast("binary").alias("term"), h.alias("h"), F.pmod(h, F.lit(n_shards)).cast("int").alias("shard"))

    def build(g):
        parts = Shard.parts(g["lang"], g["term"], g["h"].astype(np.int64).view(np.uint64))
        size = sum(map(len, parts["levels"])) + len(parts["lang_of"]) + len(parts["keys"])
        return {"shard": g["shard"][:1], "bytes": np.array([size])} | {k: [v] for k, v in parts.items()}

    schema = "shard int, levels array<binary>, langs array<string>, lang_of binary, keys binary, bytes long"
    return cut(map_sorted_groups(dealt, ["shard"], schema, build))


def recount(texts: DataFrame, shards: DataFrame, numbers: list[int], n_shards: int, fan: int, most: int = HELD_TERMS) -> DataFrame:
    """(lang, source, salt, codes, counts): occurrences of the given shards' keys, a row for each group that a task has at a time.

    A code is a shard's number and a slot.
    """
    context = texts.sparkSession.sparkContext
    rows = shards.where(F.col("shard").isin(numbers)).select("shard", "levels", "langs", "lang_of", "keys").collect()
    sent, name = context.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex  # BROADCAST_BYTES at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % fan
        known = unpacked(name, lambda: sent.value)
        seen: dict[tuple[str, str], Counter] = {}
        held = 0

        def out():
            names = list(seen)
            group = np.repeat(np.arange(len(names)), [len(seen[x]) for x in names])
            terms = [t for x in names for t in seen[x]]
            counts = np.fromiter((n for x in names for n in seen[x].values()), np.int64, len(terms))
            seeds = [xxhash.xxh64_intdigest(lang.encode(), 42) for lang, _ in names]
            hashes = np.fromiter((key_hash(seeds[k], t) for k, t in zip(group.tolist(), terms, strict=True)), np.uint64, len(terms))
            seen.clear()
            own = hashes.view(np.int64) % n_shards
            order = np.argsort(own, kind="stable")
            codes = np.full(len(terms), -1, np.int64)  # shard and slot
            for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(terms) else ():
                number = int(own[at[0]])
                if number in known:  # else another pass's
                    slots = known[number].find([names[k][0] for k in group[at].tolist()], [terms[k] for k in at.tolist()], hashes[at])
                    codes[at] = np.where(slots >= 0, (number << 32) | slots, -1)
            found = []
            edges = np.searchsorted(group, np.arange(len(names) + 1))
            for (lang, source), a, b in zip(names, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                kept = codes[a:b] >= 0
                if kept.any():
                    found.append((lang, source, salt, codes[a:b][kept].tobytes(), counts[a:b][kept].tobytes()))
            if found:
                yield _rows(found, _PARTIAL)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                counter = seen.setdefault((lang, source), Counter())
                before = len(counter)
                counter.update(terms_of(text))
                held += len(counter) - before
                if held > most:
                    yield from out()
                    held = 0
        yield from out()

    return texts.mapInArrow(run, "lang string, source string, salt int, codes binary, counts binary")


_PARTIAL = {"lang": pa.string(), "source": pa.string(), "salt": pa.int32(), "codes": pa.binary(), "counts": pa.binary()}
_FOLDED = {"lang": pa.string(), "source": pa.string(), "shard": pa.int32(), "slots": pa.binary(), "counts": pa.binary()}


def _rows(found: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.values(), strict=True)], list(kinds))


def by_shard(partial: DataFrame, most: int = HELD_TERMS) -> DataFrame:
    """(lang, source, shard, slots, counts) from what a share of the tasks found of a group: added up, a bounded number of codes at a time."""
    keys = ["lang", "source", "salt"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, last = [], [], None

        def added():
            every, place = np.unique(np.concatenate(codes), return_inverse=True)
            sums = np.zeros(len(every), np.int64)
            np.add.at(sums, place, np.concatenate(counts))
            return every, sums

        def out():
            every, sums = added()
            shards = every >> 32
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(every)]
            slots = (every & 0xFFFFFFFF).astype(np.int32)
            return _rows([(*last[:2], int(shards[a]), slots[a:b].tobytes(), sums[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)], _FOLDED)

        held = 0
        for batch in batches:
            for *key, one, two in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != last and codes:
                    yield out()
                    codes, counts, held = [], [], 0
                last = key
                codes.append(np.frombuffer(one, np.int64))
                counts.append(np.frombuffer(two, np.int64))
                held += len(codes[-1])
                if held > 4 * most:
                    every, sums = added()
                    codes, counts, held = [every], [sums], len(every)
                    if held > 2 * most:  # a vocabulary beyond the bound is handed on in parts
                        yield out()
                        codes, counts, held = [], [], 0
        if codes:
            yield out()

    schema = "lang string, source string, shard int, slots binary, counts binary"
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def fold(partial: DataFrame) -> DataFrame:
    """Increments the dense slots of one (lang, source, shard) at a time."""
    keys = ["lang", "source", "shard"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, last = np.zeros(0, np.int64), None

        def close():
            slots = np.flatnonzero(dense)
            return _rows([(*last, slots.astype(np.int32).tobytes(), dense[slots].tobytes())], _FOLDED)

        for batch in batches:
            for *key, slots, counts in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if key != last:
                    if last is not None:
                        yield close()
                    dense, last = np.zeros(0, np.int64), key
                at = np.frombuffer(slots, np.int32)
                if len(at) and at.max() >= len(dense):
                    dense = np.concatenate((dense, np.zeros(int(at.max()) + 1 - len(dense), np.int64)))
                dense[at] += np.frombuffer(counts, np.int64)  # a row has a slot once
        if last is not None:
            yield close()

    schema = "lang string, source string, shard int, slots binary, counts binary"
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), in steps of a thousand so that no product leaves 63 bits."""
    rest, out = np.asarray(count, np.int64) + 1, np.zeros(np.shape(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q); neither exceeds 10**9 + 1, so the square is a long."""
    return (p - q) ** 2 // q


def shard_results(g: dict[str, np.ndarray], top: int) -> dict | None:
    """Of one language, shard and pair of blocks: sums for pairs of sources, and each source's first terms."""
    lo, hi = int(g["lo"][0]), int(g["hi"][0])
    own = np.flatnonzero(g["block"] >= 0)
    own = own[np.argsort(g["source"][own], kind="stable")]
    terms_total, slots_here = int(g["v"][0]), int(g["here"][0])
    slots = [np.frombuffer(g["slots"][k], np.int32) for k in own]
    counts = [np.frombuffer(g["counts"][k], np.int64) for k in own]
    totals = [int(g["n"][k]) + terms_total for k in own]
    names, blocks = g["source"][own], g["block"][own]
    some = np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int32)
    absent = slots_here - len(some)
    p = np.zeros((len(own), len(some) + 1), np.int64)  # the last column is a term that none of them has
    for k in range(len(own)):
        dense = np.zeros(len(some) + 1, np.int64)
        dense[np.searchsorted(some, slots[k])] = counts[k]
        p[k] = share(dense, totals[k])
    out: list[tuple[str, str, str, int]] = []
    for k in range(len(own)):
        others = np.flatnonzero(blocks != blocks[k]) if lo != hi else np.flatnonzero(np.arange(len(own)) != k)
        if len(others):
            f = divergence(p[k][None, :], p[others])
            sums = f[:, :-1].sum(axis=1) + absent * f[:, -1]
            out += [("pair", names[k], names[j], int(s)) for j, s in zip(others.tolist(), sums.tolist(), strict=True)]
    whole = np.flatnonzero(g["block"] < 0)  # the language's own row, where lo is hi
    if len(whole):
        w = int(whole[0])
        at, q = np.frombuffer(g["slots"][w], np.int32), share(np.frombuffer(g["counts"][w], np.int64), int(g["n"][w]) + terms_total)
        place = {s: t for s, t in zip(np.frombuffer(g["term_slots"][w], np.int32).tolist(), g["terms"][w].split(b"\n"), strict=True)}
        for k in range(len(own)):
            mine, theirs = p[k][np.searchsorted(some, slots[k])], q[np.searchsorted(at, slots[k])]
            more = np.flatnonzero(mine > theirs)
            f = divergence(mine[more], theirs[more])
            if len(f) > top:
                first = f >= np.partition(f, len(f) - top)[len(f) - top]
                more, f = more[first], f[first]
            ordered = sorted((-int(x), place[int(s)]) for x, s in zip(f, slots[k][more], strict=True))[:top]
            out += [("term", names[k], t.decode(), -x) for x, t in ordered]
    if not out:
        return None
    part, source, item, value = zip(*out, strict=True)
    return {"lang": [g["lang"][0]] * len(out), "part": part, "source": source, "item": item, "value": np.array(value, np.int64)}


def audit(
    docs: DataFrame,
    least: int = LEAST_DOCS,
    top: int = TOP_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    shard_keys: int = SHARD_KEYS,
    source_block: int = SOURCE_BLOCK,
    sent_bytes: int = BROADCAST_BYTES,
    held_terms: int = HELD_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source of the language, and the terms that make it.

    The last four parameters bound memory and change no result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = texts_of(docs, text_col, lang_col, source_col)
    groups = cut(texts.select("lang", "source").distinct())
    kept = kept_terms(texts, least, held_terms)
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n_kept = kept.count()
    n_shards = max(1, math.ceil(n_kept / shard_keys))
    shards = build_shards(kept, n_shards)
    sizes = [tuple(r) for r in shards.select("shard", "bytes").orderBy("shard").collect()]  # a row for each SHARD_KEYS terms
    passes, room = [], 0
    for number, size in sizes:
        if not passes or room + size > sent_bytes:
            passes.append([])
            room = 0
        passes[-1].append(number)
        room += size

    fan = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    counts = spark.createDataFrame([], "lang string, source string, shard int, slots binary, counts binary")
    for numbers in passes:
        counts = counts.unionByName(by_shard(recount(texts, shards, numbers, n_shards, fan, held_terms), held_terms))
    counts = cut(fold(counts))
    whole = cut(fold(counts.withColumn("source", F.lit("")))).drop("source")  # of each language
    found = _shard_rows(groups, vocabulary, shards, counts, whole, source_block)
    return _ranked(groups, cut(map_sorted_groups(found, ["lang", "shard", "lo", "hi"], _RESULT, lambda g: shard_results(g, top))), top)


_RESULT = "lang string, source string, part string, item string, value long"


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all counts by key."""

    def run(batches):
        for batch in batches:
            sums = [int(np.frombuffer(c, np.int64).sum()) for c in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sums, pa.int64())], [*keys, "n"])

    schema = ", ".join(f"{k} string" for k in keys) + ", n long"
    return counts.select(*keys, "counts").mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _languages_of(shards: DataFrame) -> DataFrame:
    """(lang, shard, here, term_slots, terms): each language's own keys of a shard."""

    def run(batches):
        for batch in batches:
            for shard, langs, lang_of, keys in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                numbers, terms = np.frombuffer(lang_of, np.int32), keys.split(b"\n")
                for k, lang in enumerate(langs):
                    slots = np.flatnonzero(numbers == k)
                    one = [[lang], [shard], [len(slots)], [slots.astype(np.int32).tobytes()], [b"\n".join(terms[s] for s in slots)]]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], ["lang", "shard", "here", "term_slots", "terms"])

    return shards.select("shard", "langs", "lang_of", "keys").mapInArrow(run, "lang string, shard int, here long, term_slots binary, terms binary")


def _shard_rows(groups: DataFrame, vocabulary: DataFrame, shards: DataFrame, counts: DataFrame, whole: DataFrame, source_block: int) -> DataFrame:
    """Each group's row of each of its language's shards, once for each block that its block meets, and the language's own rows."""
    blocks = F.ceil(F.count(F.lit(1)) / source_block).cast("int").alias("blocks")
    langs = groups.groupBy("lang").agg(blocks).join(vocabulary, "lang")  # those with kept terms
    keys = _languages_of(shards)
    every = lambda upto: F.explode(F.sequence(F.lit(0), F.col(upto) - 1))
    nothing = F.lit(b"")

    members = groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64(F.lit(19), "source"), F.col("blocks")).cast("int"))
    members = members.join(_totals(counts, ["lang", "source"]), ["lang", "source"], "left").join(keys.select("lang", "shard", "here"), "lang")
    members = members.join(counts, ["lang", "source", "shard"], "left").withColumn("other", every("blocks"))
    members = members.select(
        "lang", "shard", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "source",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), "v", "here",
        F.coalesce("slots", nothing).alias("slots"), F.coalesce("counts", nothing).alias("counts"),
        nothing.alias("term_slots"), nothing.alias("terms"),
    )
    own = whole.join(keys, ["lang", "shard"]).join(langs, "lang").join(_totals(whole, ["lang"]), "lang").withColumn("lo", every("blocks"))
    own = own.select(
        "lang", "shard", "lo", F.col("lo").alias("hi"), F.lit(-1).alias("block"), F.lit("").alias("source"), "n", "v", "here",
        "slots", "counts", "term_slots", "terms",
    )
    return members.unionByName(own)


def _ranked(groups: DataFrame, found: DataFrame, top: int) -> DataFrame:
    """Pairs, summed over shards, and the first terms, with ranks."""
    names = ["lang", "source", "item"]
    sums = found.where("part = 'pair'").groupBy(*names).agg(F.sum("value").alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").join(sums, names, "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
