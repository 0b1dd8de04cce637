import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from cohortframe.llm import common, sharding
from tests.llm.conftest import text_of


def checked(rows, got, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted(
        (d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_equal_texts_stay_together_and_sizes_are_even(docs_of):
    rows = [(i, text_of(i, 5 + i % 40)) for i in range(600)] + [(1000 + i, text_of(10_000 + i // 3, 30)) for i in range(90)]
    got = sharding.shard_documents(docs_of(rows)).collect()
    checked(rows, got, 8)
    by_text, loads = defaultdict(set), defaultdict(int)
    for r in got:
        by_text[r.text_crc32].add(r.shard)
        loads[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert max(loads.values()) - min(loads.values()) < 100


def test_a_group_larger_than_a_shard_is_split_and_sizes_stay_even(docs_of, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 20)
    rows = [(i, text_of(7, 20)) for i in range(400)] + [(1000 + i, text_of(i, 20)) for i in range(600)] + [(3000 + i, text_of(9000 + i // 2, 20)) for i in range(200)]
    got = sharding.shard_documents(docs_of(rows)).collect()
    checked(rows, got, 8)
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r["size"]
    mean = sum(loads.values()) / 8
    assert all(abs(n - mean) < 0.05 * mean for n in loads.values())
    pairs = defaultdict(set)
    for r in got:
        if r.doc_id >= 3000:
            pairs[r.text_crc32].add(r.shard)
    assert sum(len(s) == 1 for s in pairs.values()) >= 90


def test_rows_with_several_hubs_move_to_their_neighbours(spark):
    # four cliques of overlapping hubs
    links = [(i, f"{i // 50}:{(i + k) % 7}") for i in range(200) for k in range(3)]
    rows = spark.range(200).select(F.col("id").alias("row"), F.lit(10).cast("long").alias("size"))
    hubs = spark.createDataFrame(links, "row long, hub string")
    got = {r.row: r.shard for r in sharding.propagate(rows, hubs, 1_000, 4).collect()}
    assert len(got) == 200
    cut = sum(got[a] != got[b] for a in got for b in got if a < b and a // 50 == b // 50) / (4 * 50 * 49 / 2)
    assert cut < 0.2                    # 0.75 at the beginning
    loads = [sum(s == k for s in got.values()) * 10 for k in range(4)]
    assert max(loads) <= 1_100


def test_odd_rows_and_empty_table(docs_of, odd_rows):
    got = sharding.shard_documents(docs_of(odd_rows), 3).collect()
    checked(odd_rows, got, 3)
    assert sharding.shard_documents(docs_of(odd_rows).where("doc_id = 77")).collect() == []


def test_shards_are_written(spark, docs_of, tmp_path):
    docs = docs_of([(i, text_of(i, 9)) for i in range(40)])
    sharding.write_shards(docs, sharding.shard_documents(docs, 4), f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 40 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
