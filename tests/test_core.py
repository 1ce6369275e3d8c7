"""The matrix engine on small fixtures, against brute force and round trips."""

import itertools
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrid import queries
from loomgrid.functions import codecs
from loomgrid.operators import edits, graph, matrix, metrics, neighbours, order
from loomgrid.plans import payload, tile
from loomgrid.sources import tables

COO = "row_id long, col_id long, value long"
SF = "/root/testdata/sf0.001"


def random_matrix(rows, cols, density, seed=7):
    r = random.Random(seed)
    return [(i, j, r.choice([1, 2, 3, 65535])) for i in range(rows) for j in range(cols) if r.random() < density]


def test_oracles(spark):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    for name in ("coo_build", "pair_jaccard", "window_cheapest_parent", "tile_assign", "decode_roundtrip", "quantize_apply", "delta_vs_full_mode", "adaptive_template_k", "bh_summary", "knn_l0", "neighbor_preview", "permutation_pvalues", "column_ref_mode", "hvg_zscore", "mst_weight", "forest_parents", "row_template_mode", "encoding_weights", "decode_adaptive", "rank_sum_u", "mode_metrics"):
        ours = sorted(tuple(map(str, r)) for r in queries.QUERIES[name](spark, SF).select(*sorted(queries.QUERIES[name](spark, SF).columns)).collect())
        rel = con.sql(queries.ORACLES[name])
        theirs = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(sorted(rel.columns))} FROM ({queries.ORACLES[name]})").fetchall())
        assert ours == theirs, name


@pytest.mark.parametrize("rows", [random_matrix(24, 12, 0.4), [(0, 0, 5)], [(i, 0, 1) for i in range(9)], [(0, j, 65535) for j in range(9)]])
@pytest.mark.parametrize("codec", ["arithmetic", "stream-vbyte"])
def test_payload_roundtrip(spark, tmp_path, rows, codec):
    coo = spark.createDataFrame(rows, COO)
    cfg = payload.EncodeConfig(cell_blocks=3, gene_blocks=20, max_cluster=5, index_codec=codec)
    tiled = payload.tiles(coo, cfg)
    assert tiled.groupBy("cluster_id").agg(F.countDistinct("row_id").alias("n")).agg(F.max("n")).first()[0] <= 5
    tables.save_payload({"tiles": payload.encode(tiled, cfg), "maps": payload.encode_maps(tiled)}, str(tmp_path))
    held = tables.load_payload(spark, str(tmp_path), ["tiles", "maps"])
    back = payload.decode(held["tiles"], held["maps"], cfg)
    assert payload.same(back, coo) and payload.same(payload.fingerprints(back), payload.fingerprints(coo))


def test_metrics_against_sets(spark):
    rows = random_matrix(10, 8, 0.5)
    coo = spark.createDataFrame(rows, COO)
    m = {i: {c: v for r, c, v in rows if r == i} for i in range(10)}
    placed = spark.createDataFrame([(0, i, i) for i in range(10)], "cluster_id long, row_id long, pos long")
    pairs = graph.window_pairs(placed, 9)
    found = {(r.a, r.b): r for r in metrics.pair_metrics(pairs, coo.withColumn("cluster_id", F.lit(0).cast("long")), ["row_id"], ["cluster_id"]).collect()}
    assert len(found) == 45
    for a, b in itertools.combinations(range(10), 2):
        x, y, r = m[a], m[b], found[a, b]
        assert r.l0 == len(set(x) ^ set(y))
        assert r.l2 == sum((x.get(c, 0) - y.get(c, 0)) ** 2 for c in {*x, *y})
        assert r.hamming == sum(x.get(c, 0) != y.get(c, 0) for c in {*x, *y})
        u = len({*x, *y})
        assert r.jaccard == (0 if not u else int(np.floor(np.float32(np.float32(1) - np.float32(len({*x} & {*y})) / np.float32(u)) * np.float32(1e6) + np.float32(0.5))))


def test_tree_and_parents(spark):
    rows = random_matrix(12, 8, 0.5, 3)
    coo = spark.createDataFrame(rows, COO)
    placed = order.positions_in(order.equal_cuts(spark.range(12).select(F.col("id").alias("row_id")), 2, ["row_id"]))
    pairs = payload.weighed_pairs(placed, coo, 8)
    tree = graph.spanning_tree(pairs)
    assert tree.count() == 10
    weight = {(r.a, r.b): r.weight for r in pairs.collect()}
    for c in (0, 1):
        nodes = range(6 * c, 6 * c + 6)
        best = min(sum(weight[e] for e in t) for t in itertools.combinations(itertools.combinations(nodes, 2), 5) if spans(nodes, t))
        assert sum(r.weight for r in tree.where(F.col("cluster_id") == c).collect()) == best
    parents = {r.row_id: r.parent for r in graph.parents(tree, placed).collect()}
    assert len(parents) == 12 and parents[0] == 0 and parents[6] == 6
    assert graph.spanning_tree(pairs, cut=0.01).count() < 10


def spans(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in edges:
        a, b = find(a), find(b)
        if a == b:
            return False
        up[a] = b
    return True


def test_edits_and_modes(spark):
    coo = spark.createDataFrame([(0, 0, 4), (0, 2, 1), (1, 0, 5), (1, 3, 2), (2, 2, 1)], COO)
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "parent long, child long")
    d = edits.row_edits(e, coo)
    assert {(r.child, r.col_id, r.op, r.value) for r in d.collect()} == {(1, 2, "remove", None), (1, 0, "update", 5), (1, 3, "add", 2), (2, 0, "remove", None), (2, 3, "remove", None), (2, 2, "add", 1), (3, 2, "remove", None)}
    assert {tuple(r) for r in edits.apply_edits(e, coo, d).collect()} == {(1, 0, 5), (1, 3, 2), (2, 2, 1)}
    rows = spark.range(4).select(F.col("id").alias("row_id"))
    assert {r.row_id: r.full_cost for r in edits.full_cost(rows, coo).collect()}[3] == 2
    modes = {r.row_id: r.mode for r in payload.parent_modes(coo, rows, e.select(F.col("child").alias("row_id"), "parent")).collect()}
    assert modes == {0: 1, 1: 1, 2: 1, 3: 1}
    assert edits.dyadic_positions(1, 5) == [0] and sorted(edits.dyadic_positions(7, 7)) == list(range(7))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=60))
def test_codecs(x):
    assert codecs.vbyte_decode(codecs.vbyte_encode(x)) == x
    assert codecs.entropy_decode(codecs.entropy_encode(x)) == x
    s = sorted(x)
    for kind in ("delta", "elias-fano"):
        assert codecs.sorted_decode(codecs.sorted_encode(s, kind)) == s
        assert codecs.sorted_decode(codecs.sorted_encode(x, kind)) == x


def test_zigzag_and_stream(spark):
    df = spark.range(-50, 50).select("id", edits.unzigzag(edits.zigzag(F.col("id"))).alias("back"), edits.zigzag(F.col("id")).alias("z"))
    assert all(r.id == r.back and r.z >= 0 for r in df.collect())
    s = spark.createDataFrame([([],), ([0],), ([5, 7, 7, 900],)], "x array<long>")
    assert all(r.x == r.y for r in s.select("x", codecs.decode_stream(codecs.encode_stream(F.col("x"))).alias("y")).collect())


def test_quantizer(spark):
    a = spark.createDataFrame([(0, i, v, c) for c in (0, 1) for i, v in enumerate([1, 1, 2, 5, 9, 9] if c else [3, 3])], COO + ", cluster_id long")
    assert {tuple(r) for r in payload.centers(a, 1).collect()} == {(0, 3), (1, 5)}
    assert {tuple(r) for r in payload.centers(a, 2).collect()} == {(0, 3), (1, 1), (1, 9)}
    assert payload.distortion(payload.quantize(a, 10), 12).first().sse == 0
    q = {(r.cluster_id, r.value): r.quantized for r in payload.quantize(a, 2).collect()}
    assert q[1, 5] == 1 and q[1, 2] == 1
    assert payload.sweep([0, 4, 4], 8) == [1, 4, 8]


def test_positions(spark, tmp_path):
    (tmp_path / "p.csv").write_text('barcode,in,r,c,x,y\n"a",1,0,0,1.5,2\n a ,1,0,0,3,4\nb,1,0,0,x,2\n,1,0,0,1,2\nc,1\n')
    assert [tuple(r) for r in tables.positions_csv(spark, str(tmp_path / "p.csv")).collect()] == [("a", 3.0, 4.0)]
    rows = spark.createDataFrame([(0, "a"), (1, "zz")], "row_id long, barcode string")
    with pytest.raises(Exception, match="no position for zz"):
        tables.join_positions(rows, tables.positions_csv(spark, str(tmp_path / "p.csv"))).collect()
    (tmp_path / "d.csv").write_text("id,x,y,g1,g2\nr,1,2,3,bad\n")
    assert tables.dense_csv(spark, str(tmp_path / "d.csv")).first().expr == [3.0, 0.0]
    assert tables.position_columns("xenium", 7, 8) == (1, 2) and tables.position_columns(None) == (1, 2)
    c = tables.from_compressed(spark.createDataFrame([(0, [1, 2], [5, 6]), (1, [], [])], "row_id long, indices array<long>, data array<long>"))
    assert {tuple(r) for r in c.collect()} == {(0, 1, 5), (0, 2, 6)}
    assert tables.to_dense(c, 3).first().expr == [0.0, 5.0, 6.0]


def test_summary_files(spark, tmp_path):
    (tmp_path / "S1_spatial_L0_l0.csv").write_text("p_l0\n0.001\nbad\n0.9\n")
    (tmp_path / "S1_exprs_l0.csv").write_text("p_l0\n0.5\n")
    got = neighbours.benjamini_hochberg(tables.summary_sources(spark, str(tmp_path)), ["dataset", "kind"])
    assert {tuple(r) for r in neighbours.significant(got, ["dataset", "kind"]).collect()} == {("s1", "spatial", 1, 3), ("s1", "exprs", 0, 1)}


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.04, 1.0, -1.0, float("nan"), None, 0.2]
    got = {(str(r.p)): r.q for r in neighbours.benjamini_hochberg(spark.createDataFrame([("k", x) for x in p], "k string, p double"), ["k"]).collect()}
    good, m = sorted(x for x in p if x is not None and x >= 0), len(p)
    for x in set(good):
        want = min(1.0, min(m * good[i] / (i + 1) for i in range(len(good)) if good[i] >= x))
        assert abs(got[str(x)] - want) < 1e-12
    assert got["-1.0"] is None and got["nan"] is None and got["None"] is None


def test_neighbours(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, [1.0, 1.0]), (1, 9.0, 0.0, [1.0, 1.0]), (2, 1.0, 0.0, [0.0, 0.0])], "id long, x double, y double, expr array<double>")
    pts, metric = neighbours.neighbour_points(df, "spatial-l0")
    near = {r.anchor: r.nbr for r in neighbours.knn(pts, 1, metric).collect()}
    assert near[0] == 2
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1]
    v -= v.mean(0)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    ours = neighbours.knn(p, 4, block=16).collect()
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 6)
    np.fill_diagonal(d, np.inf)
    assert {(r.anchor, r["rank"], r.nbr) for r in ours} == {(i, k + 1, int(j)) for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    scores = np.array([r.scores for r in neighbours.pca(p, 2).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(v, full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(u[:, :2] * s[:2]), atol=1e-3)
    test = neighbours.permutation_test(p, neighbours.knn(p, 4), 4, 9, metrics.l2).collect()
    assert len(test) == 60 and all(0.1 <= r.p <= 1 for r in test)
    for k, want in ((4, 4), (70, 55)):  # all others but the neighbours, where fewer than k are left
        drawn = neighbours.random_partners(p, neighbours.knn(p, 4), k, 3, "s").collect()
        assert len(drawn) == len(set(drawn)) == 60 * 3 * want and all(r.anchor != r.nbr for r in drawn)
    s = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("a", "y", 2.0), ("a", "y", 3.0), ("b", "x", 1.0)], "k string, side string, v double")
    assert [(r.k, r.u) for r in neighbours.rank_sum(s, "k").collect()] == [("a", 0.5)]
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    assert zero.select(metrics.cosine(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_orders(spark):
    rows = [(c, c % 8, 3 * (c + 1)) for c in range(12)] + [(c, (c + 1) % 8, 5) for c in range(12)]
    coo = spark.createDataFrame(rows, COO)
    for fast in (False, True):
        assign, cols = order.svd_order(coo, 3, 42, fast=fast)
        assert sorted(r[1] for r in assign.groupBy("cluster_id").count().collect()) == [4, 4, 4]
        assert sorted(r.new_id for r in cols.collect()) == list(range(8))
    assert order.svd_order(coo.where("col_id < 2"), 3)[0].count() > 0
    n = matrix.numbered(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), ["k"])
    assert all(r.k == r.idx for r in n.collect())


def brute_cost(base, child, ratio=1.0):
    """Edits of ``base``, or the whole child, in bytes."""
    sym = lambda v: 1 if v == 0 else max(1, -(-v.bit_length() // 6))

    def listed(ids, vals):
        return sum(sym(i - j) + (sym(vals[i]) if vals else 0) for j, i in zip([0, *sorted(ids)], sorted(ids), strict=False))

    gone, new, changed = set(base) - set(child), set(child) - set(base), {c for c in set(base) & set(child) if base[c] != child[c]}
    n = len(gone) + len(new) + len(changed)
    if n > ratio * len(child) if child else n > 0:
        return listed(child, child) + 2
    return listed(gone, None) + listed(new, child) + listed(changed, child) + 4


def test_encoding_weights(spark):
    rows = random_matrix(12, 9, 0.5, 11)
    coo = spark.createDataFrame(rows, COO)
    m = {i: {c: v for r, c, v in rows if r == i} for i in range(13)}  # row 12 is empty
    pairs = list(itertools.combinations(range(13), 2))
    want = {(a, b): min(brute_cost(m[a], m[b]), brute_cost(m[b], m[a])) for a, b in pairs}
    got = edits.encoding_weights(spark.createDataFrame([(0, a, b) for a, b in pairs], "cluster_id long, a long, b long"), coo)
    assert {(r.a, r.b): r.weight for r in got.collect()} == want
    of, ids, vals = (np.array(x) for x in zip(*rows, strict=True))
    x = tile.lists(13, of, ids, vals)
    a, b = (np.array(c) for c in zip(*pairs, strict=True))
    assert dict(zip(pairs, tile.pair_weights(x, a, b, payload.EncodeConfig(weight="encoding")).tolist(), strict=True)) == want
    for metric in ("l0", "l2", "hamming", "jaccard"):
        placed = spark.createDataFrame([(0, i, i) for i in range(13)], "cluster_id long, row_id long, pos long")
        far = {(r.a, r.b): r.weight for r in payload.weighed_pairs(placed, coo, 12, metric).collect()}
        assert dict(zip(pairs, tile.pair_weights(x, a, b, payload.EncodeConfig(metric=metric)).tolist(), strict=True)) == far, metric


CONFIGS = [
    {"adaptive": True}, {"adaptive": True, "columns": False}, {"adaptive": True, "columns": False, "parent_refs": False}, {"adaptive": True, "rows": False, "index_codec": "stream-vbyte"}, {"rows": False, "column_templates": 3}, {"columns": False, "ratio": None},
    {"rows": False, "column_refs": False}, {"columns": False, "parent_refs": False}, {"weight": "encoding", "forest_cut": 0.9, "window": 3}, {"metric": "jaccard", "prefer_columns": True}, {"metric": "l2", "rows": False},
]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_tiles_decode(cfg):
    """Groups of like rows, an empty row and an empty column, through every mode."""
    cfg, r, seen = payload.EncodeConfig(**cfg), random.Random(5), np.zeros(6, int)
    for height, width in ((1, 1), (2, 5), (40, 30)):
        kinds = [{c: r.randint(1, 9) for c in range(width) if c != 3 and r.random() < 0.5} for _ in range(3)]
        m = {(i, c): v + (r.random() < 0.05) for i in range(height) if i != 1 for c, v in (kinds[r.randrange(3)] or {0: 1}).items() if r.random() < 0.95}
        if not m:
            m = {(0, 0): 7}
        df = pd.DataFrame([(0, 0, i, c, v, height, width) for (i, c), v in m.items()], columns=["cluster_id", "block_id", "pos", "local", "value", "height", "width"])
        t = tile.encode_tile(df, cfg)
        assert t.bytes[0] == sum(t[c][0] for c in tile.CATEGORIES)
        assert {(e.pos, e.local): e.value for e in tile.decode_tile(t, cfg).itertuples()} == m
        seen += t[list(tile.MODES)].iloc[0].to_numpy()
    if cfg.adaptive and cfg.columns is False:  # the form itself: a tile may fall back to the one without templates
        x = tile.lists(height, *(df[c].to_numpy() for c in ("pos", "local", "value")))
        form = tile.row_form(x, width, cfg)
        assert cfg.parent_refs or form[1][2] > 0
        assert {(p, c): v for p, c, v in tile.decode_rows(tile._Reader(tile.packed("row", form, cfg)["streams"], cfg), height)} == m
    if cfg.column_templates:
        assert seen[4] + seen[5] > 0
    with pytest.raises(ValueError):
        tile.encode_tile(df, payload.EncodeConfig(rows=False, columns=False))


def test_template_count_brute_force():
    """The adaptive count is the first that is cheapest among all counts."""
    r = np.random.default_rng(3)
    for _ in range(50):
        base, costs, words = r.integers(1, 40, 7), list(r.integers(1, 40, (5, 7))), r.integers(1, 30, 5)
        totals = [np.minimum.reduce([base, *costs[:k]]).sum() + words[:k].sum() for k in range(6)]
        assert tile.chosen(base, costs, words) == totals.index(min(totals))


def test_references_in_a_circle():
    pack = codecs.entropy_encode
    streams = {k: pack(v) for k, v in {"modes": [1, 1], "wholes": [0, 0], "removes": [0, 0], "adds": [0, 0], "refs": [2, 1]}.items()}
    with pytest.raises(ValueError, match="circle"):
        tile.decode_columns(tile._Reader(streams, payload.EncodeConfig()), 2)


def test_decode_refuses_unknown_places(spark):
    tiled = payload.tiles(spark.createDataFrame(random_matrix(6, 6, 0.6), COO))
    with pytest.raises(Exception, match="has no row_id"):
        payload.decode(payload.encode(tiled), payload.encode_maps(tiled.where("row_id > 2"))).collect()


def test_matrix_folder(spark, tmp_path):
    coo = spark.createDataFrame([(0, 0, 4), (2, 1, 9)], COO)
    tables.write_matrix(coo, str(tmp_path / "m"), 4, 3)
    back, points = tables.load_matrix(spark, str(tmp_path / "m"))
    assert payload.same(back, coo) and points.count() == 4
    f = spark.read.parquet(str(tmp_path / "m/features")).orderBy("col_id").first()
    assert (f.id, f["name"], f.feature_type, f.genome) == ("gene_0", "gene_0", "Gene Expression", "decoded")
    few, points = tables.load_matrix(spark, str(tmp_path / "m"), max_cells=2)
    assert [tuple(r) for r in few.collect()] == [(0, 0, 4)] and points.count() == 2
    turned, points = tables.load_matrix(spark, str(tmp_path / "m"), orientation="gene-cell", max_cells=3)
    assert {tuple(r) for r in turned.collect()} == {(0, 0, 4), (1, 2, 9)} and points.count() == 3
    at = spark.createDataFrame([(f"cell_{i}", float(i), 0.5) for i in range(4)], "barcode string, x double, y double")
    dense = {r.id: (r.x, r.expr) for r in tables.load_dense(spark, str(tmp_path / "m"), at).collect()}
    assert dense[2] == (2.0, [0.0, 9.0, 0.0]) and dense[3] == (3.0, [0.0, 0.0, 0.0])
    with pytest.raises(Exception, match="no position"):
        tables.load_matrix(spark, str(tmp_path / "m"), at.limit(2))[1].collect()
    tables.write_matrix(coo, str(tmp_path / "small"), 2, 2)
    with pytest.raises(Exception, match="outside"):
        tables.load_matrix(spark, str(tmp_path / "small"))[0].collect()
    (tmp_path / "q.csv").write_text('"a,b",1,2.5\n')
    assert [tuple(r) for r in tables.positions_csv(spark, str(tmp_path / "q.csv"), None).collect()] == [("a,b", 1.0, 2.5)]


def test_wide_sinks(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(12, 3))
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    near = neighbours.knn(p, 3)
    wide = tables.permutation_wide({m: neighbours.permutation_test(p, near, 3, 4, f, draws=True) for m, f in (("l2", metrics.l2), ("cos", metrics.cosine))}, "exprL2_perm", 4)
    assert wide.columns == ["cell", "neighbor_by", "mean_obs_l2", *[f"l2_val_{j}" for j in range(4)], "l2_p", "mean_obs_cos", *[f"cos_val_{j}" for j in range(4)], "cos_p"] and wide.count() == 12
    tests = neighbours.neighbour_rank_sum(p, near, 3, metrics.l2)
    one = tests.where("anchor = 0").first()
    pairs = [(x > y) + 0.5 * (x == y) for x in one.obs for y in one.rand]
    assert one.u == sum(pairs) and 0 <= one.p <= 1
    ragged = tests.withColumn("rand", F.when(F.col("anchor") == 3, F.slice("rand", 1, 1)).otherwise(F.col("rand"))).withColumn("u", F.when(F.col("anchor") != 3, F.col("u")))
    wide = tables.rank_sum_wide({"l2": ragged}, "exprL2_utest")
    assert wide.columns[:4] == ["cell", "neighbor_by", "ustat_l2", "p_l2"] and wide.columns[-1] == "l2_rand_2"
    third = wide.where("cell = 3").first()
    assert np.isnan(third.ustat_l2) and third.l2_rand_1 is None and third.l2_obs_2 is not None
    tables.write_wide(wide, str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).count() == 12


def test_normal_cdf(spark):
    from statistics import NormalDist

    z = spark.createDataFrame([(x / 4,) for x in range(-24, 25)], "z double")
    assert all(abs(r.p - NormalDist().cdf(r.z)) < 2e-7 for r in z.select("z", neighbours.normal_cdf(F.col("z")).alias("p")).collect())


def test_summary_and_stats(spark):
    s = spark.createDataFrame([("b", "spatial", 1, 4), ("b", "exprs", 2, 4), ("a", "exprs", 0, 9)], "dataset string, kind string, significant long, total long")
    assert [tuple(r) for r in tables.summary_table(s).collect()] == [("a", "", "", "0/9"), ("b", "1/4", "0.25", "2/4")]
    coo = spark.createDataFrame(random_matrix(20, 10, 0.5), COO)
    enc = payload.encode(payload.tiles(coo))
    row = payload.build_stats(enc, coo, 200, payload.stats_label("/x/run7/out/payload.bin"), matrix_bytes=900, position_bytes=100, stored_bytes=250).first()
    assert len(row) == 20 and row.stats_csv == "run7" and row.gzip_to_input_sum_ratio == 0.25 and row.actual_rate_bits_per_value == 10.0
    assert row.mst_uncompressed_bytes == row.topology_parent_offset_bytes + row.values_root_plus_ops_bytes + row.metadata_num_genes_bytes
    assert payload.rate(enc, payload.quantize(payload.tiles(coo), 2), 200).first().bits_per_value == round(8 * row.mst_uncompressed_bytes / 200, 9)


def test_orders_and_cover(spark):
    coo = spark.createDataFrame(random_matrix(30, 12, 0.4, 9), COO)
    cuts = order.equal_cuts(coo.select("row_id").distinct(), 7, ["row_id"])
    sizes = [r["count"] for r in cuts.groupBy("cluster_id").count().orderBy("cluster_id").collect()]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1 and sum(sizes) == 30
    assert order.equal_cuts(coo.select("row_id").distinct().where("row_id < 3"), 7, ["row_id"]).agg(F.max("cluster_id")).first()[0] == 2
    assert order.covered(cuts, coo) is cuts
    for bad in (cuts.where("row_id > 0"), cuts.unionByName(cuts.where("row_id = 4")), cuts.unionByName(spark.createDataFrame([(99, 0)], "row_id long, cluster_id long"))):
        with pytest.raises(ValueError):
            order.covered(bad, coo)
    assert order.stride(10, 4) == [0, 2, 5, 7] and order.svd_order(coo, 3, None, rows=10)[0].count() == 30
    rows = coo.collect()
    b = np.zeros((30, 12))
    for r in rows:
        b[r.row_id, r.col_id] = 1
    vt = np.linalg.svd(b / np.sqrt(b.sum(0)), full_matrices=False)[2][:2].T
    vt *= np.sign(vt[np.abs(vt).argmax(0), range(2)])
    want = sorted(range(12), key=lambda c: (round(vt[c, 0], 9), round(vt[c, 1], 9), c))
    assert [r.col_id for r in order.support_svd_order(coo).orderBy("new_id").collect()] == want
    assert payload.fingerprints(coo, spark.range(32).withColumnRenamed("id", "row_id")).where("side = 'row'").agg(F.sum("n")).first()[0] == 32


def test_places_hold_for_readers_of_fewer_columns(spark):
    """Ranges are sampled; the counts and the rows must be of the same ranges."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.col("id").cast("string").alias("rest"))
    keys = sorted(i * 7919 % 100_003 for i in range(100_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted((r.idx, r.k) for r in matrix.stride_sample(df, ["k"], 1000).collect()) == [(i, keys[i]) for i in range(0, 100_000, 100)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_tiles_are_cut(spark):
    """A tile's task holds no more than its bounds, however large the matrix; quantising is by whole clusters all the same."""
    coo = spark.createDataFrame(random_matrix(40, 60, 0.5), COO)
    for bins in (None, 2):
        cfg = payload.EncodeConfig(cell_blocks=2, gene_blocks=2, lossy_bins=bins, tile_entries=120, tile_columns=20)
        tiled = payload.tiles(coo, cfg)
        most, width, parts = tiled.groupBy("cluster_id", "block_id").agg(F.count("*").alias("n"), F.max("width").alias("w")).agg(F.max("n"), F.max("w"), F.count("*")).first()
        assert most <= 120 + 20 and width == 15 and parts > 4
        whole = payload.EncodeConfig(cell_blocks=2, gene_blocks=2, lossy_bins=bins)
        assert payload.same(queries.roundtrip(coo, cfg), queries.roundtrip(coo, whole))


@pytest.mark.parametrize("metric", ["l2", "l0"])
def test_neighbours_are_found_once_and_exactly(spark, metric, monkeypatch):
    """Copies, ties, far offsets and points that aren't finite, in blocks that are measured in parts."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(90, 3)) * 2) + np.where(np.arange(90)[:, None] < 45, 0.0, 1e6)
    v[20:32] = v[20]
    v[70], v[71] = np.nan, np.inf
    done = spark.sparkContext.accumulator(0)
    inner = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *a: (done.add(1), inner(*a))[1])
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    near = neighbours.knn(p, 5, metric, block=30)
    ours = {(r.anchor, r["rank"]): (r.nbr, r.dist) for r in near.collect()}
    with np.errstate(invalid="ignore"):
        d = ((v[:, None] > 0) != (v[None] > 0)).sum(-1).astype(float) if metric == "l0" else np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 6)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): (int(j), d[i, j]) for i in range(90) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5]) if np.isfinite(d[i, j])}
    assert ours == want
    assert neighbours.permutation_test(p, near, 5, 3, metrics.l2).count() == near.select("anchor").distinct().count() and done.value == 9
    monkeypatch.setattr(neighbours, "AT_ONCE", 64)  # a few rows and pairs at a time
    u, ids = np.delete(v, [70, 71], 0), np.delete(np.arange(90), [70, 71])
    i, j, far = inner(u, u, ids, ids, 5, metric)
    assert all(d[ids[a], ids[b]] == x for a, b, x in zip(i, j, far, strict=True)) and len(i) == 88 * 5
