from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from skylattice.llm import prefixtrie


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(role, text), role, text))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rest = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(turns.get(rest, [])[:h] + turns[c][h:])
    return out


def brute(sequences):
    """(conv_id, depth, parent, n, children, leaves, saved, ends) of every node."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    rows = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        children = [v for v in below if len(v) == len(node) + 1]
        leaves = [v for v in below if not any(len(w) > len(v) and w[: len(v)] == v for w in below)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        text = ",".join(map(str, sorted(ends[node])))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(rows, key=repr)


def conversations(seed, n=120):
    pick = random.Random(seed)
    openings = [("user", "hi"), ("user", "hé"), ("system", "be kind"), ("user", None), (None, "x")]
    rows = []
    for c in range(-7, n):
        for turn in range(pick.randrange(1, 7)):
            role, text = pick.choice(openings[: 2 + turn % 4])
            rows.append((c, turn if pick.random() < 0.97 else None, role, text))
    rows += [(500 + c, turn, "user", "same") for c in range(30) for turn in range(12)]
    rows += [(None, 1, "user", "lost"), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (900, 0, "a", "b:c"), (901, 0, "a", "b:c"), (902, 0, "ab", ":c")]
    return [*rows, *((10_000, turn, "user", str(turn)) for turn in range(300))]


@pytest.mark.parametrize("seed, shard", [(1, 200_000), (2, 30), (3, 3)])
def test_nodes_equal_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", shard)
    rows = conversations(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, id string, size int")
    found = prefixtrie.conversation_trie(df)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rebuilt(rows))


def test_one_shard_for_each_sequence_and_turnless_members(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", 1)
    # 6 takes all its turns from 5, which does not exist; its own lie within its first h.
    rows = [(6, 0, "user", "a"), (11, 0, "user", "b"), (11, 1, "user", "c"), (10, 0, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefixtrie.conversation_trie(df).collect()), key=repr) == brute(rebuilt(rows))
    assert prefixtrie.conversation_trie(df.limit(0)).collect() == []


def test_medians_first_balances_the_tree():
    n = 1000
    assert sorted(prefixtrie.medians_first(n)) == list(range(n))
    tree = prefixtrie.TernaryTree()
    for k in prefixtrie.medians_first(n):
        tree.insert([k, k])

    def depth(node):
        return 1 + max(depth(tree.low[node]), depth(tree.high[node])) if node else 0

    assert depth(tree.equal[0]) == 10
    assert len(tree.number) == 1 + 2 * n
    assert tree.insert([5, 5]) == [0, *tree.insert([5, 5])[1:]] and len(tree.number) == 1 + 2 * n
