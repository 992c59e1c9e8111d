"""The conversation prefix trie against a plain version on nested dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from creditframe.llm import prefix_trie


def plain(turns):
    """{(path): row} of the trie of {conversation: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
        ends[tuple(turns[c])].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
        own = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        saved[path] = own + sum(saved[p] for p in below[path])
    return sorted((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(below[p]), leaves[p],
                   saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members)


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    return out


def in_order(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    says = [("user", "hé"), ("assistant", ""), ("user", "ok fine"), (None, "x"), ("user", None), ("", "\U0001f600 y")]
    out = []
    for c in [*range(0, 40), *range(100, 110), *range(205, 260), 1000]:
        n = rng.choice([1, 2, 3, 4, 8])
        out += [(c, None if t == 0 and c % 7 == 0 else t, *rng.choice(says[:2] if t < 2 else says)) for t in range(n)]
    out += [(100, 1, "user", "tie b"), (100, 1, "user", "tie a"), (100, 1, "user", "tie a"), (None, 1, "user", "lost")]
    out += [(c, t, "user", f"turn {t}") for c in (300, 301, 302, 303) for t in range(23 if c < 302 else 9)]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_rebuilt_conversations(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", conv int").repartition(5)
    turns = prefix_trie.encode(df)
    found = prefix_trie.nodes(*prefix_trie.with_shared_heads(turns))
    assert got(found) == sorted(plain(rebuilt(in_order(rows))), key=lambda r: r[:2])


@pytest.mark.parametrize("segment,shards", [(256, 7), (5, 3)])
def test_segments_and_shards_do_not_matter(spark, rows, segment, shards):
    turns = prefix_trie.encode(spark.createDataFrame(rows, SCHEMA))
    convs = turns.select("conv").distinct()
    found = prefix_trie.nodes(turns, convs, segment=segment, shards=shards)
    assert got(found) == sorted(plain(in_order(rows)), key=lambda r: r[:2])


def test_many_copies_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = [(c, t, "user", f"t{t}") for c in range(60) for t in range(3)] + [(60, 0, "user", "t0"), (61, 0, "user", "other")]
    turns = prefix_trie.encode(spark.createDataFrame(rows, SCHEMA))
    found = prefix_trie.nodes(turns, turns.select("conv").distinct(), shards=5)
    assert got(found) == sorted(plain(in_order(rows)), key=lambda r: r[:2])


def test_long_conversation_and_repeats(spark):
    rows = [(1, t // 2, "user", f"w{t % 7}") for t in range(3000)] + [(2, 0, "user", "w0")] * 900
    turns = prefix_trie.encode(spark.createDataFrame(rows, SCHEMA).repartition(6))
    found = prefix_trie.nodes(turns, turns.select("conv").distinct(), segment=64)
    assert got(found) == sorted(plain(in_order(rows)), key=lambda r: r[:2])


def test_turnless_and_empty(spark):
    turns = prefix_trie.encode(spark.createDataFrame([(5, 1, "u", "a")], SCHEMA))
    convs = spark.createDataFrame([(5,), (7,)], "conv long")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got(prefix_trie.nodes(turns, convs)) == [(5, 0, None, 2, 1, 1, 0, sha("7")), (5, 1, 5, 1, 0, 1, 0, sha("5"))]
    none = prefix_trie.encode(spark.createDataFrame([], SCHEMA))
    assert got(prefix_trie.nodes(*prefix_trie.with_shared_heads(none))) == []


def test_medians_visit_all_once():
    for n in (0, 1, 2, 7, 100):
        assert sorted(prefix_trie.medians(n)) == list(range(n))
        assert n == 0 or next(iter(prefix_trie.medians(n))) == n // 2
