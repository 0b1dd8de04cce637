import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortframe.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at & 1, level[at ^ 1] if (at ^ 1) < len(level) else ""))
        at >>= 1
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    leaf = [h("".join(map(said, r))) for r in rows]
    parts = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf[i])):
        parts.setdefault(rows[i][2], []).append(i)
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: levels_of([leaf[i] for i in parts[p]]) for p in names}
    top = levels_of([trees[p][-1][0] for p in names])
    out = []
    for k, p in enumerate(names):
        for at, i in enumerate(parts[p]):
            path = siblings(trees[p], at) + siblings(top, k)
            doc_id, source, lang, n, text = rows[i]
            hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            now = h("".join(map(said, (doc_id, source, lang, n + 1, text)))) if hit else leaf[i]
            for right, sibling in path:
                now = h(sibling + now if right else now + sibling)
            out.append((doc_id, leaf[i], trees[p][-1][0], top[-1][0], h("".join(s for _, s in path)), now, now == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def table_of(spark, rows):
    wide = [(*r, "x", 1, [1], 3) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos long, path array<int>, n long").repartition(3)


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_manifest_equals_brute_force(spark, stride):
    rows = [(i, "s" if i % 3 else None, ["en", "de", "fr", None, "é"][i % 5 if i % 2 else 0], i if i % 4 else None, "é\n" * (i % 9)) for i in range(150)]
    rows += [(None, None, None, None, None), (None, "", "", 3, ""), (7, "a", "en", 1, "x"), (7, "a", "en", 1, "x"), (7, "a", "en", 1, "y"), (-5, "s", "zz", 0, "t" * 200_000)]
    got = [tuple(r[c] for c in COLUMNS) for r in merkle.verified(table_of(spark, rows), stride).collect()]
    assert Counter(got) == Counter(brute(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 64, 65])
def test_sizes_about_a_block(spark, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in merkle.verified(table_of(spark, rows)).collect()) == Counter(brute(rows))


def test_only_every_few_levels_are_stored(spark):
    leaves = spark.range(300).select(F.lit("=en").alias("part"), F.col("id").alias("pos"), F.lit(300).cast("long").alias("n"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("node"), F.struct("id").alias("row"))
    tree = merkle.build(leaves, 4)
    assert [level.count() for level in tree.levels] == [19, 2, 1] and tree.tops.count() == 1
    assert tree.tops.first()["top"] == levels_of([h(str(i)) for i in range(300)])[-1][0]


def test_empty_table(spark):
    assert merkle.verified(table_of(spark, [(1, "s", "en", 1, "t")]).where("doc_id = 2")).collect() == []
