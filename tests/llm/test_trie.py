import hashlib
import random
import re
import zlib

import pytest

from cohortframe.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, k1 string, block long, pos long"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "x", 1, 1) for r in rows], SCHEMA).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        n = zlib.crc32(("" if c is None else str(c)).encode()) % 4
        whole[c] = (own.get(c - c % 20, [])[:n] if c is not None else []) + turns[n:]
    nodes = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    first = {k: min((c for c in m if c is not None), default=None) for k, m in nodes.items()}
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        ends = sorted((c for c in members if len(whole[c]) == len(key)), key=lambda c: (c is not None, c))
        saved = sum((len(nodes[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        leaves = sum(not any(len(j) == len(k) + 1 and j[:len(k)] == k for j in nodes) for k in below)
        out[(first[key], len(key))] = (first[key], len(key), first[key[:-1]] if key else None, len(members), len(kids), leaves, saved,
                                       hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest())
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c == 40:
            continue                       # a family without its first
        for t in range(rng.choice([0, 1, 2, 2, 3, 5, 8]) + (c % 20 == 0) * (c != 60)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hi there ", "no", "one\ttwo three"])))
    return rows


ODD = [(None, 1, "user", "hi"), (None, None, None, None), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (3, None, "user", ""), (200, 5, "user", None), (201, 1, None, "hi"),
       (202, 1, "", "hi"), (203, 1, "u", "ser"), (204, 1, "us", "er"), (300, 1, "user", "w " * 50_000)]


@pytest.mark.parametrize("block", [4096, 2])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = conversations(1, 90) + ODD + [(400, t, "user", f"turn {t % 3}") for t in range(40)] + [(401, t, "user", f"turn {t % 3}") for t in range(25)]
    got = {(r.conv_id, r.depth): tuple(r[c] for c in COLUMNS) for r in trie.trie(table_of(spark, rows)).collect()}
    assert got == brute(rows)


def test_hot_parents_meet_by_broadcast(spark, monkeypatch):
    from cohortframe.llm import common
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    monkeypatch.setattr(common, "HOT_LEAST", 2)
    rows = conversations(2, 70) + ODD
    got = {(r.conv_id, r.depth): tuple(r[c] for c in COLUMNS) for r in trie.trie(table_of(spark, rows)).collect()}
    assert got == brute(rows)


def test_long_end_lists_are_hashed_as_a_stream(spark):
    rows = [(i, i % 3) for i in range(-5, 60)] + [(None, 1)]
    members = spark.createDataFrame(rows, "conv_id long, g long").repartition(4)
    for chunk in (1, 4, 100):
        got = {r.g: r.ends_sha256 for r in trie.end_lists(members, ["g"], chunk).collect()}
        want = {g: ",".join([""] * (g == 1) + [str(i) for i, k in rows if k == g and i is not None]) for g in range(3)}
        assert got == {g: hashlib.sha256(w.encode()).hexdigest() for g, w in want.items()}


def test_texts_of_nodes_and_empty_table(spark):
    convs = table_of(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi")])
    said = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.with_texts(trie.trie(convs, family=1), convs).collect()}      # of one conversation each: none takes anything over
    assert said == {(1, 0): (None, None), (1, 1): ("user", "hi"), (1, 2): ("assistant", "yes")}
    assert trie.trie(convs.where("conv_id = 9")).collect() == []
