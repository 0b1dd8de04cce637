import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortframe.llm import graph, jaccard

from .conftest import text_of


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n) and sets[j] and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return Counter(out), group


def near(text, seed, edits):
    rng, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def family():
    base = text_of(5, 200)
    rows = [(1000 + i, near(base, i, 1 + i % 6)) for i in range(40)]
    licence = text_of(6, 60)
    rows += [(2000 + i, licence + " " + text_of(200 + i, 10 + i)) for i in range(30)]
    words = text_of(7, 120).split()
    rows += [(3000 + i, " ".join(words[i * 4:i * 4 + 60])) for i in range(15)]           # a chain
    rows += [(4000 + i, "a b c d e") for i in range(5)] + [(4100, "A b\tc D e"), (4200, "a b c d"), (4201, "a  b c d")]
    return rows


def test_components_equal_brute_force(docs_of, odd_rows):
    rows = odd_rows + family()
    got = jaccard.jaccard_components(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)[0]


def test_small_blocks_and_lists(docs_of, monkeypatch):
    rows = family()
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    monkeypatch.setattr(jaccard, "LISTS", 7)
    monkeypatch.setattr(jaccard, "FLUSH", 500)
    got = jaccard.jaccard_components(docs_of(rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)[0]


def test_one_of_each(docs_of, odd_rows):
    rows = odd_rows + family()
    docs = docs_of(rows)
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    _, group = brute(rows)
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    for g in set(group):
        own = [rows[i] for i in range(len(rows)) if group[i] == g]
        if not shingles(own[0][1]):
            assert all(kept[r] == own.count(r) for r in own)
            continue
        stay = {r for r in own if kept[r]}
        assert len(stay) == 1                                          # one document ...
        ids = [d for d, _ in own if d is not None]
        assert next(iter(stay))[0] == (min(ids) if ids else None)      # ... the one with the smallest id


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("doc_id = 2")
    assert jaccard.jaccard_components(empty).collect() == [] and jaccard.one_of_each(empty).collect() == []


def test_prefix_size_loses_no_partner():
    """Two sets of n and m shingles that share the needed overlap must meet in their prefixes, whatever the order."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(200, n, replace=False).tolist())
        b = {x for x in a if rng.random() > 0.12} | set(rng.choice(np.arange(200, 220), int(rng.integers(0, 4)), replace=False).tolist())
        if b and 100 * len(a & b) >= 75 * len(a | b):
            p, q = (sorted(s)[:int(jaccard.prefix_size(np.array([len(s)]))[0])] for s in (a, b))
            assert set(p) & set(q)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(5, 9), (9, 2), (7, 8), (8, 7), (20, 2)]])
def test_graph_components(spark, edges):
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: label[x] for x in linked}
