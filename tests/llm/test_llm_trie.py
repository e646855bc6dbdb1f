"""The trie of conversation prefixes against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loadpulse.llm import trie

RANDOM = random.Random(8)
SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, depth int, shard int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


def brute(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[c] for c in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1,
                        sum(b[1] for b in below) + (len(members[node]) - 1) * words)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), *totals[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs,
                   r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def conversations():
    rows = []
    for c in [*range(0, 130), *range(1000, 1100, 7), *range(2000, 2040)]:
        hot = c % 3 == 0
        for turn in range(RANDOM.randint(1, 6)):
            text = f"same opening {turn}" if hot and turn < 4 else RANDOM.choice(["ja", "no  way", "a b c", "", None])
            rows.append((c, turn, ["user", "assistant", None][turn % 3], text))
    rows += [(3000, t, "user", "long path " + str(t % 2)) for t in range(150)]
    rows += [(3001, t, "user", "long path " + str(t % 2)) for t in range(140)]
    rows += [(5, None, "system", "first of all"), (5, None, None, None), (None, 0, "user", "no conversation"),
             (7, 1, "user", "same turn"), (7, 1, "assistant", "same turn"), (7, 1, "user", "same turn")]
    RANDOM.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard_rows", "entries"), [(trie.LEAST_SHARD_ROWS, trie.QUEUE_ENTRIES), (1, 2), (40, 3)])
def test_nodes_are_those_of_brute_force(spark, conversations, monkeypatch, shard_rows, entries):
    monkeypatch.setattr(trie, "SPILL_BLOCK", 2)
    monkeypatch.setattr(trie, "STRETCH_IDS", 3)
    got = rows_of(trie.trie(make(spark, conversations), shard_rows, entries))
    assert got == brute(conversations)


def test_no_conversations_and_one_without_turns(spark):
    assert trie.trie(make(spark, []).where("false")).count() == 0
    assert trie.trie(make(spark, [(None, 0, "user", "x")])).count() == 0
    # A conversation whose few turns are all replaced by those of an absent one.
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(turnless, 0, "user", "gone")]
    assert rows_of(trie.trie(make(spark, rows))) == brute(rows)


def test_a_very_long_text(spark):
    rows = [(c, 0, "user", "word " * 200_000) for c in (0, 20, 40)]
    assert rows_of(trie.trie(make(spark, rows))) == brute(rows)


def test_the_queue_gives_the_smallest_entry_whatever_it_has_spilled(monkeypatch):
    monkeypatch.setattr(trie, "SPILL_BLOCK", 3)
    queue, held = trie.SpillingQueue(5), []
    for i in range(2000):
        if held and RANDOM.random() < 0.4:
            assert queue.first() == min(held)
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            entry = (RANDOM.randrange(50), i)
            queue.push(entry)
            held.append(entry)
    assert queue.spilled > 50
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.first() is None
