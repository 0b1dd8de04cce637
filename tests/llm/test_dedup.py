import hashlib
import re
from collections import Counter, defaultdict

from cohortframe.llm import dedup


def brute(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    out = []
    for d, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_equals_brute_force(docs_of, odd_rows):
    got = dedup.exact_dedup(docs_of(odd_rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute(odd_rows)


def test_a_group_of_copies_over_many_tasks_and_salts(spark, docs_of):
    rows = [(i, "same  text") for i in range(500, 0, -1)] + [(i, f"own {i}") for i in range(1000, 1100)]
    docs = docs_of(rows).repartition(20)
    for salts in (1, 3, 64):
        assert {tuple(r) for r in dedup.exact_dedup(docs, salts).collect()} == set(brute(rows))


def test_keep_first_keeps_one_row_of_each_text(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = dedup.keep_first(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in kept.collect())
    assert all(n == 1 for n in got.values())
    assert set(got) == {(k, t) for (d, t), (_, k, _, kept, _) in
                        zip([(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in odd_rows], _in_order(odd_rows)) if kept}


def _in_order(rows):
    whole = brute(rows)
    by = {(r[0], r[4]): r for r in whole}
    return [by[(d, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest())] for d, t in rows]


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("doc_id = 2")
    assert dedup.exact_dedup(empty).collect() == [] and dedup.keep_first(empty).collect() == []
