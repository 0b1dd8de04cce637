import uuid
from collections import namedtuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortframe.operators import latent, planes, popgen, tiles


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(60, 24)).astype(float)
    x[:, 1] = np.where(rng.random(60) < 0.9, x[:, 0], x[:, 1])      # linked pair
    return x


def long_of(spark, x, prefix="s"):
    rows = [(f"{prefix}{i:03d}", f"v{j:02d}", None if np.isnan(x[i, j]) else float(x[i, j]))
            for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "sample_id string, var_id string, dosage double")


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles far smaller than the data, so that every code path has several."""
    for module, name, n in ((tiles, "ROWS", 5), (tiles, "COLS", 7), (tiles, "QUERIES", 9), (tiles, "BASES", 6), (planes, "ROWS", 9), (planes, "COLS", 7)):
        monkeypatch.setattr(module, name, n)


def test_ld_matches_numpy(spark, matrix, small_tiles):
    got = {(r.var1, r.var2): r.r for r in popgen.pairwise_r2(long_of(spark, matrix)).collect()}
    want = np.corrcoef(matrix, rowvar=False)
    assert len(got) == 24 * 23 // 2
    for (a, b), r in got.items():
        assert abs(r - want[int(a[1:]), int(b[1:])]) < 1e-9


def test_windowed_ld_loses_no_pair(spark, matrix, small_tiles):
    g = long_of(spark, matrix)
    variants = spark.createDataFrame([(f"v{j:02d}", "a" if j < 15 else "b", j * 10) for j in range(24)], "var_id string, chr string, pos long")
    got = {(r.var1, r.var2) for r in popgen.windowed_r2(g, variants, 40).collect()}
    want = {(f"v{i:02d}", f"v{j:02d}") for i in range(24) for j in range(i + 1, 24)
            if (i < 15) == (j < 15) and (j - i) * 10 <= 40}
    assert got == want


def test_relationship_matrix(spark, matrix, small_tiles):
    p = matrix.mean(0) / 2
    z = matrix - 2 * p
    want = z @ z.T / (2 * (p * (1 - p)).sum())
    rows = popgen.relationship_matrix(long_of(spark, matrix)).collect()
    assert len(rows) == 60 * 61 // 2
    assert all(abs(r.g - want[int(r.sample1[1:]), int(r.sample2[1:])]) < 1e-9 for r in rows)


def test_few_rows_with_many_columns_are_shared_by_several_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tiles, "COLS", 10)
    folder, kernel = str(tmp_path), tiles._pair_kernel

    def told(*args):
        def run(batches):
            from pyspark import TaskContext
            for pdf in kernel(*args)(batches):
                open(f"{folder}/{TaskContext.get().partitionId()}", "w").close()
                yield pdf
        return run
    monkeypatch.setattr(tiles, "_pair_kernel", told)
    x = np.random.default_rng(8).normal(size=(3, 400))
    cells = spark.createDataFrame([(f"v{i}", f"s{j}", float(x[i, j])) for i in range(3) for j in range(400)], "row string, col string, val double")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"      # a table as small as this one would go to one task
    spark.conf.set(coalesce, "false")
    try:
        got = {(r["row1"], r["row2"]): r["dot"] for r in tiles.pair_dots(cells, 3, 400, self_pairs=True).collect()}
    finally:
        spark.conf.unset(coalesce)
    assert len(got) == 6 and all(abs(d - x[int(a[1])] @ x[int(b[1])]) < 1e-9 for (a, b), d in got.items())
    assert len(list(tmp_path.iterdir())) > 1


def test_all_pairs_travel_in_groups(spark, matrix, small_tiles, monkeypatch):
    """A tile goes to about as many tasks as there are groups, not as there are row blocks, and dosages take two bits each."""
    monkeypatch.setattr(tiles, "SIDES", 3)
    sent, group = [], tiles._group_kernel
    monkeypatch.setattr(tiles, "_group_kernel", lambda *a: sent.append(a) or group(*a))
    x = matrix.copy()
    x[np.random.default_rng(6).random(x.shape) < 0.2] = np.nan
    z = np.nan_to_num(x - np.nanmean(x, 0))
    p = np.nanmean(x, 0) / 2
    rows = popgen.relationship_matrix(long_of(spark, x)).collect()
    assert len(rows) == len({(r.sample1, r.sample2) for r in rows}) == 60 * 61 // 2 and sent == [(True,)]
    want = z @ z.T / (2 * (p * (1 - p)).sum())
    assert all(r.sample1 <= r.sample2 and abs(r.g - want[int(r.sample1[1:]), int(r.sample2[1:])]) < 1e-9 for r in rows)
    monkeypatch.setattr(tiles, "HELD", 1)               # rows too wide for groups
    assert sorted(popgen.relationship_matrix(long_of(spark, x)).select("sample1", "sample2").collect()) == sorted((r.sample1, r.sample2) for r in rows)


@pytest.mark.parametrize("shape", [(256, 200), (5, 3), (1, 7), (60, 1)])
def test_a_tile_of_dosages_is_small_and_comes_back(shape):
    rng = np.random.default_rng(1)
    x = rng.choice([0.0, 1.0, 2.0], size=shape) - rng.random(shape[1])
    x[rng.random(shape) < 0.1] = 0.0
    for block in (x, rng.normal(size=shape), np.zeros(shape)):
        data = tiles._shrunk(block)
        assert np.array_equal(tiles._block(range(shape[0]), range(shape[1]), data), block)
    assert len(tiles._shrunk(x)) <= x.nbytes and (shape[0] < 256 or len(tiles._shrunk(x)) < x.nbytes // 16)


def test_constant_variant_has_zero_r(spark):
    x = np.array([[1.0, 0], [1, 1], [1, 2]])
    assert popgen.pairwise_r2(long_of(spark, x)).first().r == 0.0


@pytest.mark.parametrize("skewed", [False, True])
def test_nearest_is_exact(spark, skewed, small_tiles):
    rng = np.random.default_rng(5)
    base, query = rng.normal(size=(300, 4)), rng.normal(size=(80, 4)) * 2
    if skewed:                                   # a third of the base is the same cloud
        base[:100] = base[0] + rng.normal(size=(100, 4)) * 1e-3
    b = spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(base)], "id string, vec array<double>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(query)], "id string, vec array<double>")
    got = {r.id: r.distance for r in tiles.nearest_distance(q, b, n_pivots=7).collect()}
    d = np.sqrt(((query[:, None] - base[None]) ** 2).sum(2)).min(1)
    assert len(got) == 80 and all(abs(got[f"q{i}"] - d[i]) < 1e-7 for i in range(80))
    cos = {r.id: r.cosine for r in latent.nearest_real(q, b).collect()}
    c = (query @ base.T / np.outer(np.linalg.norm(query, axis=1), np.linalg.norm(base, axis=1))).max(1)
    assert all(abs(cos[f"q{i}"] - c[i]) < 1e-7 for i in range(80))


@pytest.mark.parametrize("single", [False, True])
def test_a_query_goes_once_to_each_group(spark, small_tiles, monkeypatch, tmp_path, single):
    """Not once for each cell that may hold its nearest row, nor a base row to every tile of queries; also with groups that fill up."""
    folder, kernel = str(tmp_path), tiles._nearest_kernel

    def told(*args):
        def run(batches):
            def seen():
                for pdf in batches:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                        out.write(f"{(pdf['side'] == 0).sum()} {(pdf['side'] == 1).sum()}")
                    yield pdf
            yield from kernel(*args)(seen())
        return run
    monkeypatch.setattr(tiles, "_nearest_kernel", told)
    monkeypatch.setattr(tiles, "GROUPS", 3)
    rng = np.random.default_rng(7)
    base, query = rng.normal(size=(200, 12)), rng.normal(size=(90, 12))
    if single:
        base, query = base.astype(np.float32).astype(float), query.astype(np.float32).astype(float)
    base[0] = query[0] = 0.0
    b = spark.createDataFrame([(f"b{i}", v.tolist()) for i, v in enumerate(base)], "id string, vec array<double>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(query)], "id string, vec array<double>")
    d = np.sqrt(((query[:, None] - base[None]) ** 2).sum(2)).min(1)
    with np.errstate(invalid="ignore"):
        c = np.nan_to_num(query @ base.T / np.outer(np.linalg.norm(query, axis=1), np.linalg.norm(base, axis=1)), nan=-9.0).max(1)
    c[0] = 0.0
    got = {r.id: r.distance for r in tiles.nearest_distance(q, b).collect()}
    assert len(got) == 90 and all(abs(got[f"q{i}"] - d[i]) < 1e-7 for i in range(90))
    sent = np.array([[int(n) for n in p.read_text().split()] for p in tmp_path.iterdir()]).sum(0)
    assert sent[0] == 3 * 200 and sent[1] <= 3 * 90
    monkeypatch.setattr(tiles, "HELD", 3000)
    rows = latent.nearest_real(q, b).collect()
    assert len(rows) == 90 and all(abs(r.cosine - c[int(r.id[1:])]) < 1e-7 and abs(r.distance - d[int(r.id[1:])]) < 1e-7 for r in rows)
    none = tiles.nearest_distance(q, b.where("id = 'x'")).collect()
    assert len(none) == 90 and all(r.distance is None for r in none) and not tiles.nearest_distance(q.where("id = 'x'"), b).collect()


def test_hamming_with_missing_calls(spark, matrix, small_tiles):
    """Missing equals missing; a query without a call has no distance; names may be the same on both sides."""
    x = matrix.copy()
    x[np.random.default_rng(6).random(x.shape) < 0.2] = np.nan
    x[4] = np.nan
    got = {r.sample_id: r.distance for r in latent.nearest_hamming(long_of(spark, x[:20]), long_of(spark, x[20:])).collect()}
    y = np.nan_to_num(x, nan=-1.0)
    want = (y[:20][:, None] != y[20:][None]).mean(2).min(1)
    assert len(got) == 19 and all(abs(got[f"s{i:03d}"] - want[i]) < 1e-12 for i in range(20) if i != 4)


def test_hamming(spark, matrix, small_tiles):
    got = {r.sample_id: r.distance for r in latent.nearest_hamming(long_of(spark, matrix[:20], "q"), long_of(spark, matrix[20:], "s")).collect()}
    want = (matrix[:20][:, None] != matrix[20:][None]).mean(2).min(1)
    assert all(abs(got[f"q{i:03d}"] - want[i]) < 1e-12 for i in range(20))


def brute_knn(x, k):
    out, p = x.copy(), x.shape[1]
    for i, j in zip(*np.where(np.isnan(x))):
        cand = []
        for t in range(len(x)):
            if t == i or np.isnan(x[t, j]):
                continue
            both = ~np.isnan(x[i]) & ~np.isnan(x[t])
            if both.any():
                cand.append((round(float(np.sqrt(((x[i] - x[t])[both] ** 2).sum() * p / both.sum())), 9), f"s{t:03d}", x[t, j]))
        near = sorted(cand)[:k]
        if not near:
            out[i, j] = np.nan_to_num(np.nanmean(x[:, j]))
        elif near[0][0] == 0:
            out[i, j] = np.mean([v for d, _, v in near if d == 0])
        else:
            w = np.array([1 / d for d, _, _ in near])
            out[i, j] = (w * [v for _, _, v in near]).sum() / w.sum()
    return out


@pytest.mark.parametrize("kind", ["calls", "fractions", "holes"])
def test_knn_imputation(spark, matrix, small_tiles, kind):
    x = matrix.copy()
    x[np.random.default_rng(1).random(x.shape) < 0.1] = np.nan
    if kind == "fractions":
        x[::3] += 0.25
    if kind == "holes":                          # nobody, two donors only, a sample with one call, equal samples
        x[:, 3], x[2:, 5], x[7, 1:], x[20:30] = np.nan, np.nan, np.nan, x[20]
    want = brute_knn(x, 5)
    rows = latent.impute_knn(long_of(spark, x)).collect()
    assert len(rows) == x.size
    assert all(abs(r.dosage - want[int(r.sample_id[1:]), int(r.var_id[1:])]) < 1e-6 for r in rows)


def test_hopeless_pairs_are_stopped(spark, monkeypatch):
    """Clustered samples: the donors are exact, and far fewer pairs than half of all are summed to the end."""
    monkeypatch.setattr(planes, "ROWS", 16)
    monkeypatch.setattr(planes, "COLS", 12)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 3, size=(8, 96))[np.repeat(np.arange(8), 20)].astype(float)
    x = np.where(rng.random(x.shape) < 0.05, (x + 1) % 3, x)
    x[rng.random(x.shape) < 0.03] = np.nan
    rows = [(f"s{i:03d}", j, x[i, j]) for i, j in zip(*np.where(~np.isnan(x)))]
    cells = spark.createDataFrame([(s, int(j), float(v)) for s, j, v in rows], "sample_id string, idx int, val double")
    donors, work = planes.knn_search(cells, 96, 5)
    got = {}
    for r in donors.collect():
        got.setdefault((r.sample_id, r.idx), []).append((round(r.distance, 9), r.donor, r.value))
    there = ~np.isnan(x)
    both = there.astype(float) @ there.T
    sq = ((np.nan_to_num(x)[:, None] - np.nan_to_num(x)[None]) ** 2 * there[:, None] * there[None]).sum(2)
    d = np.sqrt(sq * 96 / both)
    assert set(got) == {(f"s{i:03d}", j) for i, j in zip(*np.where(~there))}
    for (s, j), near in got.items():
        i = int(s[1:])
        assert sorted(near) == sorted((round(d[i, t], 9), f"s{t:03d}", x[t, j]) for t in range(160) if t != i and there[t, j])[:5]
    done = work.first()
    assert done.completed < 0.6 * 160 * 159 / 2 and done.completed < 0.5 * done.pairs


@pytest.mark.parametrize("kind", ["calls", "fractions"])
def test_row_blocks_travel_in_groups(spark, matrix, small_tiles, monkeypatch, kind):
    """The same results, and a tile is sent to as many tasks as there are groups, not row blocks."""
    monkeypatch.setattr(planes, "ROWS", 3)
    monkeypatch.setattr(planes, "SIDES", 4)
    sent = []
    whole = planes._Laid._sent_groups

    def seen(self, pairs, heads, tiles):
        out = whole(self, pairs, heads, tiles)
        sent.append((out.where("step = 1").count(), tiles.count(), self.n_rb))
        return out

    monkeypatch.setattr(planes._Laid, "_sent_groups", seen)
    x = matrix.copy()
    x[np.random.default_rng(3).random(x.shape) < 0.15] = np.nan
    if kind == "fractions":
        x[::3] += 0.25
    got = {r.sample_id: r.distance for r in latent.nearest_hamming(long_of(spark, x[:20]), long_of(spark, x[20:])).collect()}
    y = np.nan_to_num(x, nan=-1.0)
    want = (y[:20][:, None] != y[20:][None]).mean(2).min(1)
    assert len(got) == 20 and all(abs(got[f"s{i:03d}"] - want[i]) < 1e-12 for i in range(20))
    want = brute_knn(x, 5)
    rows = latent.impute_knn(long_of(spark, x)).collect()
    assert len(rows) == x.size
    assert all(abs(r.dosage - want[int(r.sample_id[1:]), int(r.var_id[1:])]) < 1e-6 for r in rows)
    assert sent and all(n <= 4 * tiles and 4 < n_rb - 1 for n, tiles, n_rb in sent)


def test_a_tile_is_made_from_arrow_columns():
    """Of cells in chunks, and without a string object per cell."""
    part = {"chr": ["c"] * 2, "w": [0] * 2, "rb": [1] * 2, "cb": [2] * 2, "pos": [7, 9], "row": ["b", "a"], "col": ["y", "x"], "val": [2.0, 3.0]}
    tile = tiles._densify(pa.concat_tables([pa.table(part), pa.table(part | {"col": ["x", "x"]})])).to_pylist()[0]
    assert (tile["ids"], tile["pos"], tile["cols"], tile["rb"]) == (["a", "b"], [9, 7], ["x", "y"], 1)
    assert np.frombuffer(tile["data"]).tolist() == [6.0, 0.0, 2.0, 2.0]


def test_a_query_leaves_its_worker_as_one_row():
    x = np.random.default_rng(4).normal(size=(50, 3))
    queries = pd.DataFrame({"id": [str(i) for i in range(50)], "vec": list(x)})
    out = pd.concat(tiles._candidates(x[:4], np.zeros(4), np.full(4, 100.0), 0.0)([queries]))
    assert len(out) == 50 and all(list(cells) == [0, 1, 2, 3] for cells in out["cells"])


def test_a_tile_of_few_numbers_is_a_byte_each():
    x = np.random.default_rng(2).choice([0.0, 1.0, 1.4, 3.0, np.nan], size=(64, 64))
    got, there = planes.unpack(planes.pack(x), 64, 64)
    assert np.array_equal(there, ~np.isnan(x)) and np.array_equal(got, np.nan_to_num(x)) and len(planes.pack(x)) < 4200
    many = np.random.default_rng(2).random((64, 64))
    assert np.array_equal(planes.unpack(planes.pack(many), 64, 64)[0], many)


@pytest.mark.parametrize("values", [[0, 1, 2], [0.5, 1, 2]])
def test_tiles_come_back(values):
    x = np.random.default_rng(2).choice([*values, np.nan], size=(11, 13))
    got, there = planes.unpack(planes.pack(x), 11, 13)
    assert np.array_equal(there, ~np.isnan(x)) and np.array_equal(got, np.nan_to_num(x))
    assert (len(planes.pack(x)) < 60) == (values[0] == 0)


@pytest.mark.parametrize("max_local", [1000, 5])
def test_components_match_numpy(spark, matrix, max_local):
    """The covariance path and the distributed iteration give the same components."""
    z = (matrix - matrix.mean(0)) / matrix.std(0)
    vals, vecs = np.linalg.eigh(z.T @ z)
    vals, vecs = vals[::-1], vecs[:, ::-1]
    out = latent.pca(latent.standard_cells(long_of(spark, matrix)), 3, rounds=60, tol=1e-10, max_local=max_local)
    assert np.allclose(out.eigenvalues, vals[:3], rtol=1e-5)
    assert abs(out.total - z.size) < 1e-6
    scores = {r.sample_id: r.pc for r in out.scores.collect()}
    s = np.array([scores[f"s{i:03d}"] for i in range(60)])
    load = {r.var_id: r.loading for r in out.loadings.collect()}
    v = np.array([load[f"v{j:02d}"] for j in range(24)])
    gram = s.T @ s
    assert np.allclose(gram - np.diag(np.diag(gram)), 0, atol=1e-2 * gram[0, 0])
    assert np.allclose(z @ v, s, atol=1e-3)
    for j in range(3):
        assert v[np.abs(v[:, j]).argmax(), j] > 0
        assert abs(abs(np.dot(v[:, j], vecs[:, j])) - 1) < 1e-3
    again = latent.project(long_of(spark, matrix), long_of(spark, matrix), out).collect()
    assert all(np.allclose(r.pc, scores[r.sample_id], atol=1e-3) for r in again)


def test_components_of_a_chain(spark):
    nodes = spark.range(60).select(F.format_string("n%03d", "id").alias("node"))
    edges = spark.range(49).select(F.format_string("n%03d", "id").alias("a"), F.format_string("n%03d", F.col("id") + 1).alias("b"))
    labels = {r.node: r.label for r in popgen.connected_components(nodes, edges).collect()}
    assert {labels[f"n{i:03d}"] for i in range(50)} == {"n000"} and labels["n055"] == "n055"


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force_whatever_the_layout(spark, seed):
    rng = np.random.default_rng(seed)
    near = [(i, i + int(rng.integers(1, 4))) for i in range(300) if rng.random() < 0.6]
    links = near + [(int(a), int(b)) for a, b in rng.integers(0, 300, (12, 2))] + [(7, 7)]
    label = {i: i for i in range(305)}
    for _ in range(305):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    size = {i: sum(x == label[i] for x in label.values()) for i in label}
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(305)], "node string")
    edges = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", "c", a) for a, b in links], "a string, b string, chr string, pos int")
    for order in ([], ["chr", "pos"]):
        got = {r.node: (r.label, r["size"]) for r in popgen.connected_components(nodes, edges, order).collect()}
        assert got == {f"n{i:03d}": (f"n{label[i]:03d}", size[i]) for i in range(305)}


def test_no_task_holds_a_chromosome_long_component(spark):
    n = 4_000
    edges = spark.range(n - 1).select(F.format_string("n%05d", "id").alias("a"), F.format_string("n%05d", F.col("id") + 1).alias("b"), F.col("id").alias("pos"))
    parts = edges.repartitionByRange(8, "pos").select("a", "b").mapInPandas(popgen._joined_up, "node string, root string")
    assert parts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n / 4
    got = popgen.connected_components(spark.range(n).select(F.format_string("n%05d", "id").alias("node")), edges, ["pos"])
    assert [tuple(r) for r in got.select("label", "size").distinct().collect()] == [("n00000", n)]


def test_small_block_falls_apart(spark):
    v = spark.createDataFrame([(f"v{i}",) for i in range(9)], "var_id string")
    four = [("v0", "v1"), ("v1", "v2"), ("v2", "v3")]
    five = [("v4", "v5"), ("v5", "v6"), ("v6", "v7"), ("v7", "v8")]
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in four + five], "var1 string, var2 string, r2 double")
    out = {r.var_id: (r.block_id, r.block_size) for r in popgen.ld_blocks(pairs, v, 0.2, 5).collect()}
    assert out["v3"] == ("v3", 1) and out["v8"] == ("v4", 5)


def test_correlation_p_values():
    # t(10) = 2.228139 is the two-sided 5 % point; t(1) = 1 gives one half
    p = popgen.t_two_sided(np.array([2.228139, 1.0, 0.0, 30.0]), np.array([10.0, 1.0, 5.0, 100.0]))
    assert np.allclose(p[:3], [0.05, 0.5, 1.0], atol=1e-6) and p[3] < 1e-40


@pytest.mark.parametrize("odd", ["none", "queries", "base", "both", "many"])
def test_hamming_in_one_column_block_is_a_product(spark, matrix, monkeypatch, odd):
    """No pair of row blocks has sums of its own there, whatever other values than calls one side or both have."""
    monkeypatch.setattr(planes, "ROWS", 7)
    monkeypatch.setattr(planes, "SIDES", 3)
    monkeypatch.setattr(planes, "TOGETHER", 2)

    def never(*args):
        raise AssertionError("row blocks met one by one")
    monkeypatch.setattr(planes, "_met_all", never)
    monkeypatch.setattr(planes, "_meet", never)
    rng = np.random.default_rng(4)
    x, y = matrix[:25].copy(), matrix[25:].copy()
    for side, own in ((x, "queries"), (y, "base")):
        if odd in (own, "both"):
            side[rng.random(side.shape) < 0.2] = 1.4 if own == "queries" else 3.0
            side[rng.random(side.shape) < 0.1] = 0.25
        if odd == "many":
            side[:] = rng.integers(0, 300, side.shape) / 7
        side[rng.random(side.shape) < 0.15] = np.nan
    got = {r.sample_id: r.distance for r in latent.nearest_hamming(long_of(spark, x), long_of(spark, y)).collect()}
    want = (np.nan_to_num(x, nan=-1.0)[:, None] != np.nan_to_num(y, nan=-1.0)[None]).mean(2).min(1)
    assert len(got) == 25 and all(abs(got[f"s{i:03d}"] - want[i]) < 1e-12 for i in range(25))


def test_a_task_keeps_the_nearest_donors_only(monkeypatch):
    """However many meetings there are; rows with all gaps answered get a bound, which stops what comes later."""
    monkeypatch.setattr(planes, "GATHERED", 40)
    rng = np.random.default_rng(2)
    n, p, k = 6, 5, 2
    x = rng.integers(0, 3, size=(4, n, p)).astype(float)
    x[rng.random(x.shape) < 0.3] = np.nan
    record = namedtuple("record", "step side rb cb ids present wants gives bound data")
    heads = {b: record(0, 0, b, 0, [f"s{(7 * (b * n + i)) % 24:02d}" for i in range(n)], list((~np.isnan(x[b])).sum(1)), list(np.isnan(x[b]).any(1)), [True] * n, None, None) for b in range(4)}
    tiles = {b: [record(1, 0, b, 0, None, None, None, None, None, planes.pack(x[b]))] for b in range(4)}
    most, settle, limits = [], planes._Gathered.settle, []

    def settled(self):
        most.append(self.n)
        settle(self)
        assert self.n <= k * self.gaps.sum()
        limits.append(self.limit.copy())
    monkeypatch.setattr(planes._Gathered, "settle", settled)
    wanted = [(i, j) for i in range(4) for j in range(i, 4)]
    out = pd.concat(planes._met_all("euclid", p, 1, k, [1, 2], False, True)(wanted, heads, tiles))
    assert len(most) > 2 and max(most) < 3 * k * np.isnan(x).sum() + 40
    assert all((b <= a).all() for a, b in zip(limits, limits[1:])) and np.isfinite(limits[-1]).any()
    flat, names = x.reshape(-1, p), [name for b in range(4) for name in heads[b].ids]
    got = {g: sorted(zip(d["distance"].round(9), d["donor"])) for g, d in out[out["idx"] >= 0].groupby(["row", "idx"])}
    for i, j in zip(*np.where(np.isnan(flat))):
        both = ~np.isnan(flat[i]) & ~np.isnan(flat)
        near = sorted((round(float(np.sqrt(((flat[i] - flat[t])[both[t]] ** 2).sum() * p / both[t].sum())), 9), names[t])
                      for t in range(len(flat)) if t != i and both[t].any() and not np.isnan(flat[t, j]))[:k]
        assert got.get((names[i], j), []) == near
