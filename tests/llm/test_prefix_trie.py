"""Prefix trie: rebuilding and all numbers of all nodes against a plain trie, with blocks of any size."""

import hashlib
import random
import zlib

import cases
import pytest
from shelfspark.llm import prefix_trie as pt
from shelfspark.llm.common import read
from shelfspark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, digests string, sizes int, name string"


def _digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain(rows: list[tuple]):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of all nodes, by definition."""
    own: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), _digest(role, text), (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole = tuple(turns.get(head, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children: dict[tuple, int] = {}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()), key=str)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _random_rows(rng: random.Random, n: int):
    """Conversations that share turns, copies, extensions, repeated and null turn numbers, null roles, texts and ids."""
    rows = []
    for c in [*range(n), -1, -5, -7, 10**12, 10**12 + 3]:
        kind = rng.random()
        length = rng.choice([1, 1, 2, 3, 5, 9, 14]) if kind < 0.9 else 40
        for t in range(length):
            same = kind < 0.6
            text = rng.choice(["ab", "é", "", None]) if same else f"{c}-{t}"
            rows.append((c, None if rng.random() < 0.05 else t if rng.random() < 0.95 else 0, rng.choice(["u", "u", None]) if same else "u", text, "clash", 1, "x"))
    rows += [(None, 0, "u", "no id", "", 0, "")] * 3 + rows[:4]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [1, 7, 100, pt.BLOCK_TURNS])
def test_random_conversations(spark, block_turns):
    rows = _random_rows(random.Random(13), 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert _found(pt.prefix_trie(df, block_turns)) == plain(rows)


def test_group_of_copies_and_long_conversation(spark):
    """A third of all conversations are alike, one goes on for long, some end where others go on."""
    rows = [(5 * c, t, "user", x, "", 0, "") for c in range(300) for t, x in enumerate(["hi", "there", "again"][:1 + c % 3])]
    rows += [(5 * c, t, "user", f"{t}", "", 0, "") for c in range(300, 450) for t in range(3)]
    rows += [(10_000, t, "user", "hi" if t == 0 else str(t % 7), "", 0, "") for t in range(700)]
    for block_turns in (50, pt.BLOCK_TURNS):
        assert _found(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), block_turns)) == plain(rows)


def test_turnless_and_empty(spark):
    # every conversation is its head's first turns and nothing of its own: c % 5 > 0, the head is absent, h is at least its length
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:12]
    rows = [(c, 0, "u", "x", "", 0, "") for c in ids]
    expected = plain(rows)
    assert [r[1:6] for r in expected] == [(0, None, 12, 0, 1)]
    for block_turns in (3, 100):
        assert _found(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), block_turns)) == expected
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", "", 0, "")], SCHEMA)).count() == 0


def test_given_conversations(spark):
    rows = [tuple(r) for r in read(spark, cases.SF_MORE, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op13_prefix_trie"](spark, cases.SF_MORE)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert _found(found) == plain(rows)
