"""Source divergence, hard negatives and secret scans against plain versions, on odd tables too."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import divergence, hard_negatives, oracle, secret_scan
from plumbline.llm.stages import split_pattern, vocabulary

# ---- source divergence


def plain_audit(rows, least=3, top=200):
    """(lang, source, part, item, value, rank) by dictionaries and whole numbers."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for text, lang, source in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang, source, [w.translate(low) for w in words]) for lang, source, words in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w, n in seen.items() if n >= least), key=str.encode)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2]) for s in {d[1] for d in own}}
        everything = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(everything)
        for s in counts:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in counts if o != s]
            terms = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_audit_equals_plain(spark, odd, few):
    for table in (odd, few.limit(150)):
        want = plain_audit([(r.text, r.lang, r.source) for r in table.select("text", "lang", "source").collect()])
        assert rows_of(divergence.audit(table)) == want
        assert any(r[2] == "term" for r in want)


def test_audit_in_small_pieces(spark, few):
    """Shards of a few keys in several passes, blocks of two sources, and counters that are handed on all the time."""
    table = few.limit(120)
    want = rows_of(divergence.audit(table))
    got = divergence.audit(table.repartition(7), shard_keys=64, source_block=2, sent_bytes=2_000, held_terms=50)
    assert rows_of(got) == want


def test_audit_of_nothing(spark, none):
    assert divergence.audit(none).count() == 0
    one = spark.createDataFrame([("a b c", None, "s"), (None, None, "t"), ("a b", None, "t")], "text string, lang string, source string")
    got = rows_of(divergence.audit(one))  # no term has three documents
    assert got == [("", "s", "pair", "t", 0, 1), ("", "t", "pair", "s", 0, 1)]


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    made = divergence.PerfectHash.of(hashes)
    assert sorted(made.slots(hashes).tolist()) == list(range(len(hashes)))
    terms = np.array([b"t%d" % k for k in range(500)], object)
    langs = np.array(["en", "de"] * 250, object)
    same = np.arange(500, dtype=np.uint64) // np.uint64(2)  # two keys for each hash: half of them are looked up by name
    parts = divergence.Shard.parts(langs, terms, same)
    shard = divergence.Shard(parts["levels"], parts["langs"], parts["lang_of"], parts["keys"])
    assert sorted(shard.find(langs.tolist(), terms.tolist(), same).tolist()) == list(range(500))
    assert (shard.find(langs[::-1].tolist(), terms.tolist(), same) == -1).all()
    assert (shard.find(langs.tolist(), [b"x"] * 500, same) == -1).all()


def test_key_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("dé", "wörter")], "a string, b string").select(F.xxhash64("a", "b").alias("h")).first()
    import xxhash

    assert divergence.key_hash(xxhash.xxh64_intdigest("dé".encode(), 42), "wörter".encode()) == row.h % (1 << 64)


@given(st.integers(0, 10**12), st.integers(1, 10**13))
def test_share_is_exact(count, more):
    assert divergence.share(np.array([count]), count + more)[0] == 1 + 10**9 * (count + 1) // (count + more)


# ---- hard negatives


def by_sql(frame, **how):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label BIGINT, embedding DOUBLE[])")
    for r in frame:
        con.execute("INSERT INTO embeddings VALUES (?, ?, ?)", r)
    got = con.execute(oracle.op12_sql(**how)).df()
    return sorted(map(tuple, got.astype(object).values))


COLUMNS = "vec_id long, label long, embedding array<double>"


def mined(spark, rows, **how):
    df = hard_negatives.hard_negatives(spark.createDataFrame(rows, COLUMNS).repartition(3), **how)
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_hard_negatives_with_ties_copies_and_gaps(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(rng.integers(0, 3)), [round(float(x), 1) for x in rng.normal(size=4)]) for k in range(160)]
    rows += [(500 + k, 1, [0.5, 0.5, 0.5, 0.5]) for k in range(40)]  # copies: ties by id
    rows += rows[:30]  # rows that repeat are one
    rows += [(9, 2, [0.1, 0.2, 0.3, 0.4]), (10, 0, [1.0, 1.0, 1.0, 1.0])]  # rows that share an id only
    rows += [(300, 1, [1.0, 2.0]), (301, 1, [1.0, 2.0]), (302, 2, [0.5, 1.0]), (303, 2, None), (304, None, [1.0]), (None, 1, [1.0] * 4)]
    rows += [(310, 1, [float("nan")] * 4), (320, 1, [float("inf"), 0.0, 0.0, 0.0]), (330, 1, [None, 1.0, 1.0, 1.0]), (340, 1, [0.0] * 4)]
    for how in ({"every": 10}, {"every": 10, "positives": 2, "negatives": 3}):
        want = by_sql(rows, **how)
        assert len(want) > 100
        assert mined(spark, rows, **how) == want
        assert mined(spark, rows, row_block=16, anchor_block=4, **how) == want


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, 1, [3e5, 1e9, 0.0]), (1, 2, [2e5, 1e8, 1.0]), (2, 1, [4e5, 1e9, 2.0]), (3, 2, [1e5, 9e8, 5.0]), (4, 1, [1e308, 1e308, 1.0])]
    whole = {r[0]: [int(np.floor(256 * x)) if abs(256 * x) < 2**53 else int(x) * 256 for x in r[2]] for r in rows}
    scores = {k: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(whole[0], v, strict=True)))) for k, v in whole.items()}
    # ids divisible by 7 move on to the next label: the anchor's is 2
    got = mined(spark, rows, every=100)
    assert {(r[1], r[4]) for r in got} <= {(1, scores[1]), (3, scores[3])}
    assert all(r[5] == scores[r[3]] and 30 * r[4] <= 100 * r[5] <= 90 * r[4] for r in got)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, None)]) == []


def test_keys_sort_as_numbers():
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in rng.integers(-3, 4, 6)) for _ in range(300)] + [(-(2**63), 0, 2**63 - 1, 1, 2**63 - 1, 0), (5, 0, -(2**63 - 1), 0, 0, 0)]
    rows = [(a, abs(b), s, n % 2, r, abs(t)) for a, b, s, n, r, t in rows]
    keys = sorted(hard_negatives.pack(*r) for r in rows)
    assert [hard_negatives.unpack(k) for k in keys] == sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4], r[5]))


def test_windows_stream():
    """Open windows of one anchor are all that the iterator holds, whatever lies between."""
    keys = [hard_negatives.pack(1, 0, 100, 0, 7, 0), *(hard_negatives.pack(1, 0, 95, 1, k, 0) for k in range(50))]
    keys += [hard_negatives.pack(1, 0, 90, 1, 60, 0), hard_negatives.pack(1, 0, 30, 1, 61, 0), hard_negatives.pack(1, 0, 29, 1, 62, 0)]
    got = list(hard_negatives.open_windows(iter(sorted(keys)), 10, 30, 90))
    assert [(r[3], r[2]) for r in got] == [(60, 1), (61, 2)]


# ---- secret scans

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, k) for a, k, b in sorted(spans)]


@pytest.fixture(scope="module")
def encoding():
    return secret_scan._encoding(secret_scan.read_ranks(vocabulary("byte_bpe_50k.tiktoken")), split_pattern())


PIECES = st.sampled_from(["password", "PassWD", "Secret", "token", "api_key", "APIkey", "=", ":", " ", '"', "'", "é", "ſ", "K", "AKIA", "a1b2c3", "0123456789abcdef", "XYZ", "_", "-", "tok", "\n", "ABCDEFGH12345678"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_base_spans_are_the_patterns(encoding, text):
    base, every = secret_scan.scan_text(text.encode(), encoding)
    assert base == plain_base(text)
    assert set(base) <= set(every)


def test_random_strings_and_what_is_left_alone(encoding):
    rng = np.random.default_rng(4)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    hits = 0
    for _ in range(300):
        key = "".join(rng.choice(letters, 32))
        spans = secret_scan.scan_text(f"siehe é {key} und mehr".encode(), encoding)[1]
        hits += spans == [(8, 40, 3)]
    assert hits >= 294
    for alone in (
        hashlib.md5(b"x").hexdigest().upper(), "550e8400-e29b-41d4-a716-446655440000", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
        "github_user_settings_controller", "getElementsByClassNameOfUser", "Donaudampfschifffahrtsgesellschaft", "2024-01-15/10-22-33/000001",
        "DE89370400440532013000", "=" * 5000, "x" * 200_000, "11112222333344445555",
    ):
        assert not [s for s in secret_scan.scan_text(f"a {alone} b".encode(), encoding)[1] if s[2] == 3], alone


def test_scan_of_odd_rows(spark, odd, none):
    ranks = secret_scan.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    got = secret_scan.scan(odd, ranks, split_pattern()).toPandas()
    assert len(got) == odd.count()
    assert secret_scan.scan(none, ranks, split_pattern()).count() == 0
    odd_bytes = spark.sql("SELECT 1 AS doc_id, CAST(X'746f6b656e3d616263646566FF' AS STRING) AS text")
    assert secret_scan.scan(odd_bytes, ranks, split_pattern()).first().spans == "assign:0:12"


def test_scan_equals_plain_on_documents(spark):
    few = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ranks = secret_scan.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in few.collect()}
    seen = 0
    for r in secret_scan.scan(few, ranks, split_pattern()).collect():
        base = plain_base(texts[r.doc_id] or "")
        written = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, _, k in base) for i in range(3)]
        assert not base or set(written.split(",")) <= set(r.spans.split(","))
        seen += len(base)
    assert seen
