"""Conversation trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from seqlake.llm import queries, turntrie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def expected(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children.get(n, 0), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n, m in members.items())


def result(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                              "ends_sha256").collect())


def trie(conversations):
    turns = turntrie.sequences(conversations)
    return turntrie.trie_nodes(queries.rebuilt_conversations(turns))


def random_rows(rng, convs, alphabet, longest):
    rows = []
    for c in range(convs):
        for turn in range(rng.randrange(0, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(alphabet)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [1, 7, 100, 10 ** 6])
def test_against_prefix_dictionary(spark, monkeypatch, chunk):
    monkeypatch.setattr(turntrie, "CHUNK_TURNS", chunk)
    rng = random.Random(chunk)
    rows = random_rows(rng, 350, ["a", "b", "été", "", None], 7)
    rows += [(c, t, "user", "same") for c in range(400, 460) for t in range(3)]  # one hot conversation
    rows += [(c, 0, "user", "hot") for c in range(460, 640)] + [(c, 1, "user", f"{c}") for c in range(460, 640)]  # one hot first turn
    rows += [(700, t, "user", f"long {t % 9}") for t in range(300)] + [(701, t, "user", f"long {t % 9}") for t in range(250)]
    assert result(trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == expected(rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "", ""), (1, 0, "u", "b"), (1, 0, "u", "b"), (2, 5, "u", "b" * 100_000),
            (-1, 1, "u", "neg"), (-101, 1, "u", "neg"), (100, 0, None, "b"), (101, 0, "", "b"), (101, 0, None, "b"), (102, -4, "u", "é😀")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", depth string, Keys string")
    assert result(trie(frame)) == expected(rebuilt(rows))
    assert trie(frame.limit(0)).count() == 0
    assert result(trie(frame.where("conv_id is null"))) == []


def test_all_conversations_turnless(spark):
    rows = [(c, 0, "u", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6]  # base 0 is absent
    assert result(trie(spark.createDataFrame(rows, SCHEMA))) == expected(rebuilt(rows))
    assert all(r.depth == 0 for r in trie(spark.createDataFrame(rows, SCHEMA)).collect())


def test_double_array_holds_exactly_its_sequences():
    rng = random.Random(2)
    words = sorted({tuple(rng.choices(range(1, 30), k=rng.randrange(0, 6))) for _ in range(800)} | {(i,) for i in range(1, 200)})
    flat = np.array([x for w in words for x in w], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    array = turntrie.DoubleArray(flat, bounds)
    nodes = {w[:d] for w in words for d in range(len(w) + 1)}
    slots = {}
    for node in sorted(nodes, key=len):
        at = np.zeros(1, dtype=np.int64)
        for label in node:
            at = array.step(at, np.array([label]))
        assert at[0] >= 0
        slots[node] = int(at[0])
    assert len(set(slots.values())) == len(nodes) == (array.check >= 0).sum() + 1
    for node in rng.sample(sorted(nodes), 200):
        for label in range(1, 210):
            got = int(array.step(np.array([slots[node]]), np.array([label]))[0])
            assert got == slots.get((*node, label), -1)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_conversation_trie(spark, sf)) == expected(rebuilt(rows))
