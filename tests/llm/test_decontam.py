import re
from collections import Counter

from cohortframe.llm import decontam

from .conftest import text_of


def shingles(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def own(text):
    n = len([x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x])
    return max(1, min(n, 5))


def brute(rows, items, threshold=0.75):
    out = {}
    for i, t in items:
        s = shingles(t, own(t))
        for d, text in rows:
            n = len(s & shingles(text, own(t)))
            if s and n >= threshold * len(s) and n * out.get((d, i), (1, 0))[0] >= out.get((d, i), (1, 0))[1] * len(s):
                out[(d, i)] = (len(s), n)
    return out


def cases():
    items = [(1, text_of(50, 12)), (2, text_of(51, 40)), (3, "too short here"), (4, None), (5, ""), (6, text_of(52, 5)), (7, text_of(53, 300)), (1, text_of(54, 20)), (None, text_of(55, 30))]
    words = [t.split() if t else [] for _, t in items]
    filler = text_of(60, 3000)
    docs = [(1, filler[:900] + " " + items[1][1].upper() + " " + filler[900:]), (2, " ".join(words[1][:32])), (3, " ".join(words[1][:29])), (4, items[0][1]), (5, None), (6, ""),
            (7, items[6][1] + "\n" + items[5][1]), (7, items[7][1]), (None, items[8][1]), (8, "\t".join(words[6][80:])), (9, " ".join(words[6][20:240]) + " " + filler), (10, filler),
            (11, " ".join(words[1][:20] + ["x"] + words[1][21:])), (12, items[2][1])]
    return docs, items


def test_leaks_equal_brute_force(spark, docs_of):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h", "2 AS s", "'x' AS part")
    got = decontam.leaks(docs_of(docs), table).collect()
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in got} == brute(docs, items)
    assert len(got) == len(brute(docs, items)) == 9


def test_without_leaks(spark, docs_of):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.without_leaks(docs_of(docs), table)
    leaky = {d for d, _ in brute(docs, items)}
    assert got.columns == docs_of(docs).columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(d for d, _ in docs if d not in leaky)


def test_many_items_are_found_at_every_size(spark, docs_of):
    items = [(i, text_of(100 + i, 5 + i)) for i in range(60)]
    docs = [(i, text_of(900 + i, 50) + " " + t + " " + text_of(950 + i, 200)) for i, t in items]
    got = decontam.leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, i) for i, _ in items}
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in got} == brute(docs, items)


def test_items_of_one_to_four_words(spark, docs_of):
    items = [(1, "Paris"), (2, "of the\n sea"), (3, "to be or not"), (4, " \t"), (5, "a b"), (5, "the sea"), (6, text_of(7, 9)), (None, "or")]
    docs = [(1, "capital: paris is"), (2, "PARIS"), (3, "the land of the sea"), (4, "of  the\tsea"), (5, "to be"), (6, "x to be or not y"), (7, None), (8, ""),
            (9, text_of(7, 9) + " paris"), (9, "a b"), (None, "of the seas or"), (10, "parisian a  b")]
    got = decontam.leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in got} == brute(docs, items)
    assert len(got) == len(brute(docs, items)) > 12


def test_empty_tables(spark, docs_of):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.leaks(docs_of(docs).where("doc_id = 99"), table).collect() == []
    assert decontam.leaks(docs_of(docs), table.where("item_id = 99")).collect() == []
    assert decontam.without_leaks(docs_of(docs), table.where("item_id = 99")).count() == len(docs)
