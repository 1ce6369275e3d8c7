"""The registered queries and their SQL, over matrices that count line items and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs
from .operators import edits, graph, matrix, metrics, neighbours, order
from .plans import payload
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.counted(read(spark, sf_dir, "lineitem"), F.col("l_suppkey"), F.col("l_partkey"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return matrix.counted(e, F.col("user_id"), F.hour("ts") * 100 + F.length("event_type"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.alias("vec"))


COO = "coo AS (SELECT CAST(l_suppkey AS BIGINT) AS row_id, CAST(l_partkey AS BIGINT) AS col_id, count(*) AS value FROM lineitem GROUP BY ALL)"
EVENTS = "coo AS (SELECT CAST(user_id AS BIGINT) AS row_id, CAST(hour(ts) * 100 + length(event_type) AS BIGINT) AS col_id, count(*) AS value FROM events GROUP BY ALL)"
CLUSTERS = "cl AS (SELECT row_id, CAST(ntile(6) OVER (ORDER BY row_id) - 1 AS BIGINT) AS cluster_id FROM (SELECT DISTINCT row_id FROM coo))"
PLACED = f"{CLUSTERS}, pl AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) - 1 AS pos FROM cl)"
PAIRS = f"{PLACED}, pr AS (SELECT a.cluster_id, a.row_id AS a, b.row_id AS b FROM pl a JOIN pl b ON a.cluster_id = b.cluster_id AND b.pos - a.pos BETWEEN 1 AND 8)"
_J = "CAST(round(CAST((CAST(1 AS FLOAT) - CAST(CAST(i AS FLOAT) / CAST(na + nb - i AS FLOAT) AS FLOAT)) AS FLOAT) * CAST(1000000 AS FLOAT)) AS BIGINT)"
METRICS = f"""{PAIRS}, own AS (SELECT row_id, count(*) AS n, sum(value * value) AS s FROM coo GROUP BY 1),
sh AS (SELECT a, b, count(*) AS i, sum(x.value * y.value) AS dot, count(*) FILTER (WHERE x.value = y.value) AS eq FROM pr JOIN coo x ON x.row_id = a JOIN coo y ON y.row_id = b AND x.col_id = y.col_id GROUP BY 1, 2),
f AS (SELECT pr.*, coalesce(i, 0) AS i, coalesce(dot, 0) AS dot, coalesce(eq, 0) AS eq, p.n AS na, q.n AS nb, p.s AS sa, q.s AS sb FROM pr LEFT JOIN sh USING (a, b) JOIN own p ON p.row_id = a JOIN own q ON q.row_id = b)"""


def clusters(coo: DataFrame, k: int = 6) -> DataFrame:
    return order.equal_cuts(coo.select("row_id").distinct(), k, ["row_id"])


def placed(coo: DataFrame) -> DataFrame:
    return order.positions_in(clusters(coo))


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coo = items(spark, sf_dir)
    p = placed(coo)
    return metrics.pair_metrics(graph.window_pairs(p, 8), coo.join(p.select("row_id", "cluster_id"), "row_id"), ["row_id"], ["cluster_id"])


@query(f"WITH {COO} SELECT * FROM coo")
def coo_build(spark, sf):
    return items(spark, sf)


@query(f"WITH {COO} SELECT col_id AS row_id, row_id AS col_id, value FROM coo")
def coo_transpose(spark, sf):
    return matrix.transpose(items(spark, sf))


@query(f"WITH {COO} SELECT * FROM coo WHERE row_id < 40")
def limit_cells(spark, sf):
    return matrix.limit_cells(items(spark, sf), 40)


@query(f"WITH {COO} SELECT row_id, count(*) AS nnz, CAST(sum(value) AS BIGINT) AS total FROM coo GROUP BY 1")
def row_stats(spark, sf):
    return matrix.stats(items(spark, sf), "row_id")


@query(f"WITH {COO} SELECT col_id, count(*) AS nnz, CAST(sum(value) AS BIGINT) AS total FROM coo GROUP BY 1")
def col_stats(spark, sf):
    return matrix.stats(items(spark, sf), "col_id")


@query(f"WITH {COO} SELECT count(DISTINCT row_id) AS n_rows, count(DISTINCT col_id) AS n_cols, count(*) AS nnz, CAST(sum(value) AS BIGINT) AS total, max(value) AS max_value FROM coo")
def matrix_summary(spark, sf):
    return matrix.summary(items(spark, sf))


@query(f"WITH {COO}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS pos, CAST(s_nationkey + 1 AS BIGINT) AS row_id FROM supplier) SELECT pos AS row_id, col_id, value FROM p JOIN coo USING (row_id)")
def subset_rows(spark, sf):
    picks = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), (F.col("s_nationkey") + 1).cast("long").alias("row_id"))
    return tables.subset_rows(items(spark, sf), picks)


@query(f"WITH {COO} SELECT row_id, string_agg(col_id || ':' || value, ',' ORDER BY col_id) AS entries FROM coo GROUP BY 1")
def row_form(spark, sf):
    e = F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["c"], x["v"])), ",")
    return matrix.row_form(items(spark, sf)).select("row_id", e.alias("entries"))


@query(f"WITH {COO}, b AS (SELECT col_id, CAST(ntile(5) OVER (ORDER BY col_id) - 1 AS BIGINT) AS block_id FROM (SELECT DISTINCT col_id FROM coo)), l AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY col_id DESC) - 1 AS new_id FROM b) SELECT block_id, row_id, new_id AS col_id, value FROM coo JOIN l USING (col_id)")
def project_columns(spark, sf):
    """Each block in turn, its columns from the last to the first."""
    coo = items(spark, sf)
    at = (F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("col_id"))) - 1).cast("long")
    return matrix.project(coo, order.column_blocks(coo.select("col_id").distinct(), 5, ["col_id"]).withColumn("new_id", at))


@query(f"WITH {COO}, s AS (SELECT row_id, s_name AS barcode FROM (SELECT DISTINCT row_id FROM coo) JOIN supplier ON s_suppkey = row_id) SELECT row_id, barcode, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM s JOIN supplier ON s_name = barcode")
def positions_join(spark, sf):
    s = read(spark, sf, "supplier")
    rows = items(spark, sf).select("row_id").distinct().join(s.select(F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("barcode")), "row_id")
    return tables.join_positions(rows, s.select(F.col("s_name").alias("barcode"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))).select("row_id", "barcode", "x", "y")


@query("""WITH l AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE trim(s_name) END AS barcode, TRY_CAST(CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE CAST(s_nationkey AS VARCHAR) END AS DOUBLE) AS x, CAST(s_suppkey AS DOUBLE) AS y FROM supplier)
SELECT barcode, x, y FROM l WHERE barcode <> '' AND x IS NOT NULL""")
def positions_csv_clean(spark, sf):
    s = read(spark, sf, "supplier")
    key = F.when(F.col("s_suppkey") % 7 == 0, '""').otherwise(F.concat(F.lit(' "'), "s_name", F.lit('" ')))
    x = F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise(F.col("s_nationkey").cast("string"))
    return tables.clean_positions(s.select("s_suppkey", F.array(key, x, F.col("s_suppkey").cast("string")).alias("fields")), 1, 2, "s_suppkey")


@query("SELECT s_name AS barcode, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier")
def positions_parquet(spark, sf):
    return tables.positions_parquet(read(spark, sf, "supplier").select("s_name", "s_acctbal", "s_nationkey"), "xenium")


@query(f"WITH {COO}, h AS (SELECT value, count(*) AS n FROM coo GROUP BY 1), t AS (SELECT sum(n) AS t FROM h) SELECT round(sum(-n * log2(n / t)), 4) AS bits, CAST(max(t) AS BIGINT) AS total, count(*) AS symbols FROM h, t")
def value_histogram_entropy(spark, sf):
    return matrix.entropy_bits(matrix.histogram(items(spark, sf)))


@query(f"WITH {COO}, h AS (SELECT value AS symbol, count(*) AS n FROM coo GROUP BY 1) SELECT s AS symbol, CAST(coalesce(n, 0) + 1 AS BIGINT) AS n FROM range(0, (SELECT max(symbol) + 1 FROM h)) AS r(s) LEFT JOIN h ON symbol = s")
def laplace_table(spark, sf):
    return matrix.laplace(matrix.histogram(items(spark, sf)))


@query(f"WITH {COO} SELECT col_id, count(*) AS nnz FROM coo GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_columns(spark, sf):
    return matrix.top_columns(items(spark, sf), 50)


@query(f"WITH {COO}, n AS (SELECT *, row_number() OVER (ORDER BY row_id, col_id) - 1 AS idx, count(*) OVER () AS c FROM coo) SELECT row_id, col_id, value, idx FROM n WHERE idx % greatest(1, CAST(ceil(c / 1000.0) AS BIGINT)) = 0")
def stride_sample(spark, sf):
    return matrix.stride_sample(items(spark, sf), ["row_id", "col_id"], 1000)


@query(f"""WITH {COO}, n AS (SELECT count(DISTINCT row_id) AS n FROM coo), s AS (SELECT col_id, sum(ln(1 + value)) AS s, sum(ln(1 + value) * ln(1 + value)) AS q FROM coo GROUP BY 1),
m AS (SELECT col_id, s / n AS mean, round((q - s * s / n) / (n - 1), 9) AS var FROM s, n), t AS (SELECT * FROM m WHERE var > 1e-12 ORDER BY var DESC, col_id LIMIT 2000)
SELECT row_id, col_id, round((ln(1 + value) - mean) / sqrt(var), 4) AS z, round(-mean / sqrt(var), 4) AS zero_z FROM coo JOIN t USING (col_id)""")
def hvg_zscore(spark, sf):
    coo = items(spark, sf)
    return matrix.top_zscores(coo, coo.select("row_id").distinct().count())


@query(f"WITH {COO}, n AS (SELECT count(DISTINCT row_id) AS n FROM coo), s AS (SELECT col_id, sum(ln(1 + value)) AS s, sum(ln(1 + value) * ln(1 + value)) AS q FROM coo GROUP BY 1) SELECT col_id, round(s / n, 6) AS mean, round((q - s * s / n) / (n - 1), 6) AS var FROM s, n")
def log_moments(spark, sf):
    coo = items(spark, sf)
    return matrix.log_moments(coo, coo.select("row_id").distinct().count())


@query(f"WITH {COO}, {CLUSTERS} SELECT * FROM cl")
def equal_cuts(spark, sf):
    return clusters(items(spark, sf))


@query(f"WITH {EVENTS}, {CLUSTERS}, p AS (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY row_id) - 1) // 7 AS p FROM cl), f AS (SELECT *, min(row_id) OVER (PARTITION BY cluster_id, p) AS f FROM p) SELECT row_id, dense_rank() OVER (ORDER BY f) - 1 AS cluster_id FROM f")
def split_clusters(spark, sf):
    return order.split_clusters(clusters(events(spark, sf)), 7)


@query(f"WITH {COO} SELECT col_id, CAST(ntile(5) OVER (ORDER BY col_id) - 1 AS BIGINT) AS block_id FROM (SELECT DISTINCT col_id FROM coo)")
def column_blocks(spark, sf):
    return order.column_blocks(items(spark, sf).select("col_id").distinct(), 5, ["col_id"])


@query(f"WITH {COO}, {PLACED}, b AS (SELECT col_id, ntile(5) OVER (ORDER BY col_id) - 1 AS block_id FROM (SELECT DISTINCT col_id FROM coo)), l AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY col_id) - 1 AS local FROM b) SELECT row_id, col_id, value, cluster_id, pos, CAST(block_id AS BIGINT) AS block_id, local FROM coo JOIN pl USING (row_id) JOIN l USING (col_id)")
def tile_assign(spark, sf):
    return payload.tiles(items(spark, sf)).select("row_id", "col_id", "value", "cluster_id", "pos", "block_id", "local")


@query(f"WITH {COO}, {PAIRS} SELECT * FROM pr")
def window_pairs(spark, sf):
    return graph.window_pairs(placed(items(spark, sf)), 8)


def _pair(name: str, sql: str) -> None:
    def f(spark, sf):
        return pair_table(spark, sf).select("cluster_id", "a", "b", name)

    f.__name__ = f"pair_{name}" + ("sq" if name == "l2" else "")
    query(f"WITH {COO}, {METRICS} SELECT cluster_id, a, b, {sql} AS {name} FROM f")(f)


_pair("l0", "CAST(na + nb - 2 * i AS BIGINT)")
_pair("l2", "CAST(sa + sb - 2 * dot AS BIGINT)")
_pair("hamming", "CAST(na + nb - i - eq AS BIGINT)")
_pair("jaccard", _J)


@query(f"WITH {COO}, {METRICS}, w AS (SELECT *, na + nb - 2 * i AS weight FROM f) SELECT cluster_id, b AS row_id, a AS parent, CAST(weight AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, b ORDER BY weight, a) AS r FROM w) WHERE r = 1")
def window_cheapest_parent(spark, sf):
    coo = items(spark, sf)
    return graph.cheapest_parent(payload.weighed_pairs(placed(coo), coo, 8))


@query("SELECT id, round({w}, 9) AS weight FROM (SELECT CAST(p_partkey AS BIGINT) AS id FROM part)".replace("{w}", order.weights_sql("id", order.COLUMN_SEEDS[0])))
def projection_weight(spark, sf):
    ids = read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return ids.select("id", F.round(order.projection_weight(F.col("id"), order.COLUMN_SEEDS[0]), 9).alias("weight"))


@query(f"WITH {COO}, st AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM (SELECT DISTINCT row_id FROM coo)), w AS (SELECT row_id, pos, {', '.join(f'{order.weights_sql("pos", s)} AS w{i}' for i, s in enumerate(order.COLUMN_SEEDS))} FROM st), s AS (SELECT col_id, {', '.join(f'round(avg(w{i}), 9) AS s{i}' for i in range(4))}, avg(pos) AS mp, count(*) AS n FROM coo JOIN w USING (row_id) GROUP BY 1) SELECT col_id, row_number() OVER (ORDER BY s0, s1, s2, s3, mp, n DESC, col_id) - 1 AS new_id FROM s")
def projection_col_order(spark, sf):
    coo = items(spark, sf)
    return order.column_order(coo, matrix.numbered(coo.select("row_id").distinct(), ["row_id"]).select("row_id", F.col("idx").alias("pos")))


@query(f"WITH {COO}, c AS (SELECT DISTINCT col_id FROM coo), w AS (SELECT col_id, {', '.join(f'{order.weights_sql("col_id", s)} AS w{i}' for i, s in enumerate(order.ROW_SEEDS))} FROM c), s AS (SELECT row_id, {', '.join(f'round(sum(ln(1 + value) * w{i}), 6) AS s{i}' for i in range(2))}, count(*) AS n FROM coo JOIN w USING (col_id) GROUP BY 1) SELECT row_id, row_number() OVER (ORDER BY s0, s1, n, row_id) - 1 AS pos FROM s")
def column_row_order(spark, sf):
    return order.row_order(items(spark, sf))


EDGES = f"{PLACED}, ed AS (SELECT a.row_id AS parent, b.row_id AS child FROM pl a JOIN pl b ON a.cluster_id = b.cluster_id AND b.pos = a.pos + 1)"
EDITS = f"""{EDGES}, e AS (SELECT coalesce(x.parent, y.parent) AS parent, coalesce(x.child, y.child) AS child, coalesce(x.col_id, y.col_id) AS col_id, x.value AS pv, y.value AS cv
 FROM (SELECT ed.*, col_id, value FROM ed JOIN coo ON row_id = parent) x FULL JOIN (SELECT ed.*, col_id, value FROM ed JOIN coo ON row_id = child) y ON x.parent = y.parent AND x.child = y.child AND x.col_id = y.col_id),
ops AS (SELECT parent, child, col_id, CASE WHEN cv IS NULL THEN 'remove' WHEN pv IS NULL THEN 'add' ELSE 'update' END AS op, cv AS value FROM e WHERE cv IS NULL OR pv IS NULL OR cv <> pv)"""
_SYM = lambda v: f"CASE WHEN {v} = 0 THEN 1 ELSE greatest(1, CAST(ceil(length(bin({v})) / 6.0) AS BIGINT)) END"


def chain(coo: DataFrame) -> DataFrame:
    return graph.window_pairs(placed(coo), 1).select(F.col("a").alias("parent"), F.col("b").alias("child"))


@query(f"WITH {EVENTS}, {EDITS} SELECT * FROM ops")
def row_edits(spark, sf):
    coo = events(spark, sf)
    return edits.row_edits(chain(coo), coo)


@query(f"WITH {EVENTS}, {EDITS} SELECT parent, child, op, string_agg(col_id, ',' ORDER BY col_id) AS cols FROM ops WHERE op <> 'update' GROUP BY 1, 2, 3")
def set_edits(spark, sf):
    coo = events(spark, sf)
    e = edits.row_edits(chain(coo), coo).where("op <> 'update'")
    return e.groupBy("parent", "child", "op").agg(F.array_join(F.sort_array(F.collect_list("col_id")), ",").alias("cols"))


@query(f"WITH {EVENTS}, {EDGES} SELECT child, col_id, value FROM ed JOIN coo ON row_id = child")
def apply_edits_roundtrip(spark, sf):
    coo = events(spark, sf)
    e = chain(coo)
    return edits.apply_edits(e, coo, edits.row_edits(e, coo))


@query(f"WITH {EVENTS}, {EDGES} SELECT child, col_id FROM ed JOIN coo ON row_id = child")
def apply_set_edits_roundtrip(spark, sf):
    coo = events(spark, sf)
    e = chain(coo)
    return edits.apply_set_edits(e, coo, edits.row_edits(e, coo))


@query(f"SELECT v, CAST({_SYM('v')} AS BIGINT) AS arithmetic, CAST(CASE WHEN v <= 255 THEN 1 WHEN v <= 65535 THEN 2 WHEN v <= 16777215 THEN 3 ELSE 4 END AS BIGINT) AS vbyte FROM (SELECT DISTINCT CAST((l_partkey - 1) * l_linenumber * l_suppkey AS BIGINT) AS v FROM lineitem)")
def symbol_cost(spark, sf):
    v = ((F.col("l_partkey") - 1) * F.col("l_linenumber") * F.col("l_suppkey")).cast("long").alias("v")
    return read(spark, sf, "lineitem").select(v).distinct().select("v", edits.symbol_cost(F.col("v")).cast("long").alias("arithmetic"), edits.symbol_cost(F.col("v"), "stream-vbyte").cast("long").alias("vbyte"))


GAPS = "g AS (SELECT *, col_id - coalesce(lag(col_id) OVER (PARTITION BY row_id ORDER BY col_id), 0) AS gap FROM coo)"


@query(f"WITH {COO}, {GAPS} SELECT row_id, CAST(sum({_SYM('gap')} + {_SYM('value')}) + 2 AS BIGINT) AS full_cost FROM g GROUP BY 1")
def list_cost(spark, sf):
    coo = items(spark, sf)
    return edits.full_cost(coo.select("row_id").distinct(), coo)


@query(f"""WITH {EVENTS}, {EDITS}, {GAPS}, fc AS (SELECT row_id, sum({_SYM('gap')} + {_SYM('value')}) + 2 AS fc, count(*) AS nnz FROM g GROUP BY 1),
og AS (SELECT *, col_id - coalesce(lag(col_id) OVER (PARTITION BY parent, child, op ORDER BY col_id), 0) AS gap FROM ops),
dc AS (SELECT parent, child, count(*) AS n, sum({_SYM('gap')} + CASE WHEN op = 'remove' THEN 0 ELSE {_SYM('value')} END) AS c FROM og GROUP BY 1, 2),
d AS (SELECT ed.child, coalesce(n, 0) AS n, coalesce(c, 0) + 4 AS c FROM ed LEFT JOIN dc USING (parent, child)),
m AS (SELECT row_id, CASE WHEN child IS NULL OR n > nnz THEN 1 ELSE 0 END AS mode, fc, c FROM fc LEFT JOIN d ON child = row_id)
SELECT row_id, CAST(mode AS BIGINT) AS mode, CAST(CASE WHEN mode = 0 THEN c ELSE fc END AS BIGINT) AS cost FROM m""")
def delta_vs_full_mode(spark, sf):
    coo = events(spark, sf)
    p = chain(coo).select(F.col("child").alias("row_id"), "parent")
    return payload.parent_modes(coo, coo.select("row_id").distinct(), p)


@query(f"WITH {COO}, {GAPS} SELECT row_id, col_id, gap, CAST((gap - value) * 2 AS BIGINT) ^ 0 AS x, CASE WHEN gap - value >= 0 THEN 2 * (gap - value) ELSE -2 * (gap - value) - 1 END AS zigzag FROM g".replace("CAST((gap - value) * 2 AS BIGINT) ^ 0 AS x, ", ""))
def zigzag_gaps(spark, sf):
    return edits.gaps(items(spark, sf), ["row_id"]).select("row_id", "col_id", "gap", edits.zigzag(F.col("gap") - F.col("value")).alias("zigzag"))


_DYADIC = """dy AS (SELECT n, place, row_number() OVER (PARTITION BY n ORDER BY o) - 1 AS template_id FROM (SELECT n, CAST(floor((n - 1) * (2 * j + 1) / pow(2, d) + 0.5) AS BIGINT) AS place, min(pow(2, d) + j) AS o
FROM (SELECT DISTINCT size AS n FROM sizes), range(1, 9) AS r(d), range(128) AS q(j) WHERE 2 * j + 1 < pow(2, d) GROUP BY 1, 2))"""
_RANKED = """w AS (SELECT member, {w0} AS w0, {w1} AS w1 FROM (SELECT DISTINCT member FROM tg)), sc AS (SELECT grp, item, round(sum({f} * w0), 6) AS s0, round(sum({f} * w1), 6) AS s1, count(*) AS n FROM tg JOIN w USING (member) GROUP BY ALL),
rk AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY s0, s1, n, item) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM sc), sizes AS (SELECT size FROM rk), {dy}, cand AS (SELECT grp, template_id, item FROM rk JOIN dy ON size = dy.n AND rk.place = dy.place WHERE template_id < {most})"""


def _candidates(seeds: tuple[int, int], weighted: bool, most: int) -> str:
    return _RANKED.format(w0=order.weights_sql("member", seeds[0]), w1=order.weights_sql("member", seeds[1]), f="ln(1 + value)" if weighted else "1", dy=_DYADIC, most=most)


@query(f"WITH {COO}, sizes AS (SELECT count(*) AS size FROM coo GROUP BY row_id), {_DYADIC} SELECT n, string_agg(place, ',' ORDER BY template_id) AS picks FROM dy WHERE template_id < 5 GROUP BY n")
def dyadic_positions(spark, sf):
    """Of as many items as a row has entries."""
    sizes = matrix.stats(items(spark, sf), "row_id").select(F.col("nnz").alias("n")).distinct()
    pick = F.udf(lambda n: ",".join(map(str, edits.dyadic_positions(n, 5))), "string", useArrow=True)  # a row for each distinct size
    return sizes.select("n", pick("n").alias("picks"))


_TREE = """own AS (SELECT row_id, count(*) AS n FROM coo GROUP BY 1), sh AS (SELECT a, b, count(*) AS i FROM pr JOIN coo x ON x.row_id = a JOIN coo y ON y.row_id = b AND x.col_id = y.col_id GROUP BY 1, 2),
wt AS (SELECT pr.cluster_id, a, b, CAST(p.n + q.n - 2 * coalesce(i, 0) AS BIGINT) AS weight FROM pr LEFT JOIN sh USING (a, b) JOIN own p ON p.row_id = a JOIN own q ON q.row_id = b)"""
#: Spanning trees edge by edge: a list of component labels by place grows one edge at a time.
_KRUSKAL = """eo AS (SELECT wt.*, x.pos AS pa, y.pos AS pb, row_number() OVER (PARTITION BY wt.cluster_id ORDER BY weight, a, b) AS k FROM wt JOIN pl x ON x.row_id = a AND x.cluster_id = wt.cluster_id JOIN pl y ON y.row_id = b AND y.cluster_id = wt.cluster_id),
kr AS (SELECT cluster_id, CAST(0 AS BIGINT) AS k, CAST(range(count(*)) AS BIGINT[]) AS l, false AS taken, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS weight FROM pl GROUP BY 1
UNION ALL SELECT eo.cluster_id, eo.k, list_transform(kr.l, lambda x: CASE WHEN x = greatest(kr.l[pa + 1], kr.l[pb + 1]) THEN least(kr.l[pa + 1], kr.l[pb + 1]) ELSE x END), kr.l[pa + 1] <> kr.l[pb + 1], eo.a, eo.b, eo.weight FROM kr JOIN eo ON eo.cluster_id = kr.cluster_id AND eo.k = kr.k + 1),
tr AS (SELECT cluster_id, a, b, weight FROM kr WHERE taken)"""
_PARENTS = """ad AS (SELECT cluster_id, a AS x, b AS y FROM ct UNION ALL SELECT cluster_id, b, a FROM ct),
rc AS (SELECT cluster_id, row_id AS x, row_id AS y FROM pl UNION SELECT rc.cluster_id, rc.x, ad.y FROM rc JOIN ad ON ad.cluster_id = rc.cluster_id AND ad.x = rc.y),
pa AS (SELECT cluster_id, x AS row_id, x AS parent FROM rc GROUP BY 1, 2 HAVING min(y) = x UNION ALL SELECT ad.cluster_id, ad.y, ad.x FROM pa JOIN ad ON ad.cluster_id = pa.cluster_id AND ad.x = pa.row_id WHERE ad.y <> pa.parent)"""
_CUT = "md AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight, a, b) AS r, count(*) OVER (PARTITION BY cluster_id) AS c FROM tr), ct AS (SELECT t.* FROM tr t JOIN md ON md.cluster_id = t.cluster_id AND md.r = md.c // 2 + 1 WHERE t.weight <= ceil(md.weight * 1.1))"

_PAIR_OPS = """x AS (SELECT pairs.*, id, v FROM pairs JOIN base ON base.item = pairs.p), y AS (SELECT pairs.*, id, v FROM pairs JOIN base ON base.item = pairs.c),
op AS (SELECT coalesce(x.p, y.p) AS p, coalesce(x.c, y.c) AS c, coalesce(x.id, y.id) AS id, y.v AS v, CASE WHEN y.v IS NULL THEN 'r' WHEN x.v IS NULL THEN 'a' ELSE 'u' END AS op FROM x FULL JOIN y ON x.p = y.p AND x.c = y.c AND x.id = y.id WHERE x.v IS NULL OR y.v IS NULL OR x.v <> y.v),
og AS (SELECT *, id - coalesce(lag(id) OVER (PARTITION BY p, c, op ORDER BY id), 0) AS gap FROM op)"""

_BLOCKS = "bl AS (SELECT col_id, CAST(ntile(5) OVER (ORDER BY col_id) - 1 AS BIGINT) AS block_id FROM (SELECT DISTINCT col_id FROM m))"
#: Events' columns as rows, in blocks as clusters.
_TURNED = f"{EVENTS.replace('coo AS', 'm AS')}, {_BLOCKS}, coo AS (SELECT col_id AS row_id, row_id AS col_id, value FROM m), pl AS (SELECT col_id AS row_id, block_id AS cluster_id, row_number() OVER (PARTITION BY block_id ORDER BY col_id) - 1 AS pos FROM bl), pr AS (SELECT a.cluster_id, a.row_id AS a, b.row_id AS b FROM pl a JOIN pl b ON a.cluster_id = b.cluster_id AND b.pos - a.pos BETWEEN 1 AND 8)"
_REFS = f"{_TURNED}, {_TREE}, {_KRUSKAL}, ct AS (SELECT * FROM tr), {_PARENTS}, rf AS (SELECT pa.row_id AS c, pa.parent AS p, q.pos - o.pos AS delta FROM pa JOIN pl o ON o.row_id = pa.row_id JOIN pl q ON q.row_id = pa.parent WHERE pa.row_id <> pa.parent)"
_REF_COST = f"""base AS (SELECT row_id AS item, col_id AS id, 1 AS v FROM coo), pairs AS (SELECT p, c FROM rf), {_PAIR_OPS}, oc AS (SELECT c, sum({_SYM('gap')}) AS cost FROM og GROUP BY 1),
rw AS (SELECT row_id AS item, sum({_SYM('gap')}) AS raw FROM (SELECT row_id, col_id - coalesce(lag(col_id) OVER (PARTITION BY row_id ORDER BY col_id), 0) AS gap FROM coo) GROUP BY 1),
rr AS (SELECT rf.c AS item, {_SYM('(CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END)')} + coalesce(cost, 0) + 2 AS ref FROM rf LEFT JOIN oc ON oc.c = rf.c)"""


def event_blocks(coo: DataFrame) -> DataFrame:
    return order.column_blocks(coo.select("col_id").distinct(), 5, ["col_id"])


@query(f"WITH RECURSIVE {_REFS} SELECT c AS col_id, p AS parent, delta AS \"offset\" FROM rf")
def column_references(spark, sf):
    coo = events(spark, sf)
    return payload.column_references(event_blocks(coo), coo, 8)


@query(f"WITH RECURSIVE {_REFS}, {_REF_COST} SELECT item AS col_id, CAST(coalesce(ref < raw, false) AS BIGINT) AS mode, CAST(CASE WHEN ref < raw THEN ref ELSE raw END AS BIGINT) AS cost FROM rw LEFT JOIN rr USING (item)")
def column_ref_mode(spark, sf):
    coo = events(spark, sf)
    return edits.column_modes(coo, payload.column_references(event_blocks(coo), coo, 8))


@query(f"WITH {COO}, {CLUSTERS}, tg AS (SELECT cluster_id AS grp, row_id AS item, col_id AS member, value FROM coo JOIN cl USING (row_id)), {_candidates(order.TEMPLATE_SEEDS, True, 16)} SELECT grp AS cluster_id, template_id, item AS row_id FROM cand")
def template_candidates(spark, sf):
    coo = items(spark, sf)
    tagged = coo.join(clusters(coo), "row_id")
    return edits.template_candidates(tagged, "cluster_id", "row_id", "col_id", order.TEMPLATE_SEEDS, 16, True)


@query(f"WITH {COO.replace('coo AS', 'm AS')}, {_BLOCKS}, tg AS (SELECT block_id AS grp, col_id AS item, row_id AS member, value FROM m JOIN bl USING (col_id)), {_candidates(order.SUPPORT_SEEDS, False, 32)} SELECT grp AS block_id, template_id, item AS col_id FROM cand")
def support_template_candidates(spark, sf):
    coo = items(spark, sf)
    tagged = coo.join(order.column_blocks(coo.select("col_id").distinct(), 5, ["col_id"]), "col_id")
    return edits.template_candidates(tagged, "block_id", "col_id", "row_id", order.SUPPORT_SEEDS, 32, False)


_ROW_COSTS = f"""{EVENTS}, {PLACED}, {GAPS}, tg AS (SELECT cluster_id AS grp, row_id AS item, col_id AS member, value FROM coo JOIN cl USING (row_id)), {_candidates(order.TEMPLATE_SEEDS, True, 16)},
base AS (SELECT row_id AS item, col_id AS id, value AS v FROM coo), wd AS (SELECT row_id AS item, sum({_SYM('gap')} + {_SYM('value')}) AS c, count(*) AS nnz FROM g GROUP BY 1),
lk AS (SELECT a.row_id AS p, b.row_id AS c FROM pl a JOIN pl b ON a.cluster_id = b.cluster_id AND b.pos = a.pos + 1), pairs AS (SELECT p, c FROM lk UNION SELECT cand.item, pl.row_id FROM cand JOIN pl ON cluster_id = grp), {_PAIR_OPS},
dc AS (SELECT p, c, count(*) AS n, sum({_SYM('gap')} + CASE WHEN op = 'r' THEN 0 ELSE {_SYM('v')} END) AS cost FROM og GROUP BY 1, 2),
dl AS (SELECT pairs.p, pairs.c, coalesce(n, 0) AS n, coalesce(cost, 0) + 4 AS cost FROM pairs LEFT JOIN dc USING (p, c)),
bs AS (SELECT cluster_id, row_id AS item, CASE WHEN lk.p IS NULL OR dl.n > nnz THEN 1 ELSE 0 END AS mode, CAST(CASE WHEN lk.p IS NULL OR dl.n > nnz THEN wd.c + 2 ELSE dl.cost END AS BIGINT) AS cost FROM pl JOIN wd ON wd.item = pl.row_id LEFT JOIN lk ON lk.c = pl.row_id LEFT JOIN dl ON dl.p = lk.p AND dl.c = pl.row_id),
tc AS (SELECT grp AS cluster_id, pl.row_id AS item, template_id, CAST(dl.cost + {_SYM('template_id')} AS BIGINT) AS cost FROM cand JOIN pl ON cluster_id = grp JOIN dl ON dl.p = cand.item AND dl.c = pl.row_id),
ms AS (SELECT tc.cluster_id, tc.item, template_id + 1 AS k, least(min(tc.cost) OVER (PARTITION BY tc.cluster_id, tc.item ORDER BY template_id), bs.cost) AS m FROM tc JOIN bs USING (cluster_id, item)),
di AS (SELECT grp AS cluster_id, template_id + 1 AS k, sum(c + 1) OVER (PARTITION BY grp ORDER BY template_id) AS d FROM cand JOIN wd USING (item)),
tt AS (SELECT cluster_id, k, CAST(sum(m) + any_value(d) AS BIGINT) AS total FROM ms JOIN di USING (cluster_id, k) GROUP BY 1, 2 UNION ALL SELECT cluster_id, 0, CAST(sum(cost) AS BIGINT) FROM bs GROUP BY 1),
bk AS (SELECT cluster_id, k, total FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total, k) AS r FROM tt) WHERE r = 1)"""


def template_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Costs without templates, with each template, and of the templates, of event rows that may refer to the row before."""
    coo = events(spark, sf_dir)
    cl = clusters(coo)
    base = payload.parent_modes(coo, cl, chain(coo).select(F.col("child").alias("row_id"), "parent")).join(cl, "row_id").withColumnRenamed("row_id", "item")
    words = edits.template_candidates(coo.join(cl, "row_id"), "cluster_id", "row_id", "col_id", order.TEMPLATE_SEEDS, 16, True)
    costs, dictionary = edits.row_template_costs(words, cl, coo, "cluster_id")
    return base, costs, dictionary


@query(f"WITH {_ROW_COSTS} SELECT cluster_id, k, total FROM bk")
def adaptive_template_k(spark, sf):
    base, costs, dictionary = template_tables(spark, sf)
    return edits.adaptive_templates(costs, base, dictionary, "cluster_id")


@query(f"""WITH {_ROW_COSTS}, bt AS (SELECT tc.cluster_id, item, min(cost) AS cost, arg_min(template_id, (cost, template_id)) AS template_id FROM tc JOIN bk USING (cluster_id) WHERE template_id < k GROUP BY 1, 2)
SELECT cluster_id, item, CASE WHEN bt.cost < bs.cost THEN 2 ELSE mode END AS mode, CASE WHEN bt.cost < bs.cost THEN template_id END AS template_id, coalesce(least(bt.cost, bs.cost), bs.cost) AS cost FROM bs LEFT JOIN bt USING (cluster_id, item)""")
def row_template_mode(spark, sf):
    return edits.template_modes(*template_tables(spark, sf), "cluster_id")


@query(f"""WITH {EVENTS}, {PAIRS}, {GAPS}, base AS (SELECT row_id AS item, col_id AS id, value AS v FROM coo), wd AS (SELECT row_id AS item, sum({_SYM('gap')} + {_SYM('value')}) + 2 AS c, count(*) AS nnz FROM g GROUP BY 1),
pairs AS (SELECT a AS p, b AS c FROM pr UNION ALL SELECT b, a FROM pr), {_PAIR_OPS}, dc AS (SELECT p, c, count(*) AS n, sum({_SYM('gap')} + CASE WHEN op = 'r' THEN 0 ELSE {_SYM('v')} END) AS cost FROM og GROUP BY 1, 2),
cc AS (SELECT pairs.p, pairs.c, CASE WHEN coalesce(n, 0) > nnz THEN wd.c ELSE coalesce(cost, 0) + 4 END AS cost FROM pairs LEFT JOIN dc USING (p, c) JOIN wd ON wd.item = pairs.c)
SELECT cluster_id, a, b, CAST(least(x.cost, y.cost) AS BIGINT) AS weight FROM pr JOIN cc x ON x.p = a AND x.c = b JOIN cc y ON y.p = b AND y.c = a""")
def encoding_weights(spark, sf):
    coo = events(spark, sf)
    return payload.weighed_pairs(placed(coo), coo, 8, "encoding")


@query(f"WITH {COO}, h AS (SELECT row_id, value, count(*) AS c FROM coo GROUP BY 1, 2), t AS (SELECT row_id, sum(c) AS n, max(value) AS m, sum(c * log2(c + 1)) AS s FROM h GROUP BY 1) SELECT row_id, CAST(4 * ceil(round(n * log2(n + m + 1) - s, 6) / 32) + 4 * (m + 1) + 8 AS BIGINT) AS size FROM t")
def arithmetic_size(spark, sf):
    return codecs.arithmetic_size(items(spark, sf), ["row_id"], "value")


@query(f"WITH {COO}, {GAPS}, h AS (SELECT row_id, gap, count(*) AS c FROM g GROUP BY 1, 2), t AS (SELECT row_id, sum(c) AS n, max(gap) AS m, sum(c * log2(c + 1)) AS s FROM h GROUP BY 1) SELECT row_id, CAST(4 * ceil(round(n * log2(n + m + 1) - s, 6) / 32) + 4 * (m + 1) + 24 AS BIGINT) AS size FROM t")
def delta_size(spark, sf):
    return codecs.delta_size(items(spark, sf), ["row_id"], "col_id")


@query(f"WITH {COO}, s AS (SELECT row_id, count(*) AS n, max(col_id) AS m FROM coo GROUP BY 1), l AS (SELECT *, least(31, CAST(floor(log2(greatest(1, (m + 1) // n))) AS INT)) AS low FROM s) SELECT row_id, CAST(4 * n + 8 * ceil(((m >> low) + n + 1) / 64.0) + 17 AS BIGINT) AS size FROM l")
def elias_fano_size(spark, sf):
    return codecs.elias_fano_size(items(spark, sf), ["row_id"], "col_id")


@query(f"WITH {COO} SELECT row_id, CAST(ceil(count(*) / 4.0) + sum(CASE WHEN col_id < 256 THEN 1 WHEN col_id < 65536 THEN 2 WHEN col_id < 16777216 THEN 3 ELSE 4 END) + 8 AS BIGINT) AS size FROM coo GROUP BY 1")
def vbyte_size(spark, sf):
    return codecs.vbyte_size(items(spark, sf), ["row_id"], "col_id")


@query(f"WITH {COO}, {GAPS} SELECT row_id, string_agg(gap, ',' ORDER BY col_id) AS gaps FROM g GROUP BY 1")
def stream_roundtrip(spark, sf):
    g = edits.gaps(items(spark, sf), ["row_id"]).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("col_id", "gap"))).alias("x"))
    coded = g.select("row_id", codecs.encode_stream(F.transform("x", lambda e: e["gap"])).alias("bytes"))
    return coded.select("row_id", F.array_join(codecs.decode_stream(F.col("bytes")), ",").alias("gaps"))


QUANT = """a AS (SELECT coo.*, cluster_id FROM coo JOIN cl USING (row_id)), st AS (SELECT cluster_id, count(*) AS n, count(DISTINCT value) AS d FROM a GROUP BY 1),
rk AS (SELECT cluster_id, value, row_number() OVER (PARTITION BY cluster_id ORDER BY value) - 1 AS r FROM a),
ce AS (SELECT DISTINCT cluster_id, value AS center FROM a JOIN st USING (cluster_id) WHERE d <= 2 UNION SELECT DISTINCT rk.cluster_id, value FROM rk JOIN st USING (cluster_id), range(2) AS q(b) WHERE d > 2 AND r = b * (n - 1) // 1)"""


@query(f"WITH {COO}, {CLUSTERS}, {QUANT} SELECT * FROM ce")
def quantizer_centers(spark, sf):
    coo = items(spark, sf)
    return payload.centers(coo.join(clusters(coo), "row_id"), 2)


@query(f"WITH {COO}, {CLUSTERS}, {QUANT}, b AS (SELECT cluster_id, value, center, row_number() OVER (PARTITION BY cluster_id, value ORDER BY abs(value - center), center) AS k FROM (SELECT DISTINCT cluster_id, value FROM a) JOIN ce USING (cluster_id)) SELECT row_id, col_id, center AS quantized FROM a JOIN b USING (cluster_id, value) WHERE k = 1")
def quantize_apply(spark, sf):
    coo = items(spark, sf)
    return payload.quantize(coo.join(clusters(coo), "row_id"), 2).select("row_id", "col_id", "quantized")


@query(f"WITH {COO}, {CLUSTERS}, {QUANT}, b AS (SELECT cluster_id, value, center, row_number() OVER (PARTITION BY cluster_id, value ORDER BY abs(value - center), center) AS k FROM (SELECT DISTINCT cluster_id, value FROM a) JOIN ce USING (cluster_id)), s AS (SELECT CAST(sum((value - center) * (value - center)) AS DOUBLE) AS s FROM a JOIN b USING (cluster_id, value) WHERE k = 1), n AS (SELECT count(DISTINCT row_id) * count(DISTINCT col_id) AS n FROM coo) SELECT round(s, 4) AS sse, round(s / n, 9) AS mse, round(sqrt(s / n), 9) AS rmse FROM s, n")
def rate_distortion(spark, sf):
    coo = items(spark, sf)
    n = coo.agg(F.countDistinct("row_id") * F.countDistinct("col_id")).first()[0]
    return payload.distortion(payload.quantize(coo.join(clusters(coo), "row_id"), 2), n)


@query()
def joint_svd_clusters(spark, sf):
    return order.svd_order(items(spark, sf), 6)[0]


@query()
def svd_col_order(spark, sf):
    return order.support_svd_order(items(spark, sf))


@query(f"WITH {COO}, {CLUSTERS} SELECT row_id, row_number() OVER (ORDER BY cluster_id, row_id) - 1 AS pos FROM cl")
def row_stream(spark, sf):
    coo = items(spark, sf)
    return order.row_stream(order.covered(clusters(coo), coo))


@query(f"WITH RECURSIVE {COO}, {PAIRS}, {_TREE}, {_KRUSKAL} SELECT cluster_id, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM tr GROUP BY 1")
def mst_weight(spark, sf):
    coo = items(spark, sf)
    tree = graph.spanning_tree(payload.weighed_pairs(placed(coo), coo, 8))
    return tree.groupBy("cluster_id").agg(F.count("*").alias("edges"), F.sum("weight").cast("long").alias("weight"))


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    coo = items(spark, sf_dir)
    p = placed(coo)
    return graph.parents(graph.spanning_tree(payload.weighed_pairs(p, coo, 8), cut=1.1), p), p


@query(f"WITH RECURSIVE {COO}, {PAIRS}, {_TREE}, {_KRUSKAL}, {_CUT}, {_PARENTS} SELECT cluster_id, row_id, parent FROM pa")
def forest_parents(spark, sf):
    return forest(spark, sf)[0]


@query(f"WITH RECURSIVE {COO}, {PAIRS}, {_TREE}, {_KRUSKAL}, {_CUT}, {_PARENTS} SELECT pa.cluster_id, pa.row_id, CAST(greatest(c.pos - p.pos, 0) AS BIGINT) AS \"offset\" FROM pa JOIN pl c ON c.row_id = pa.row_id JOIN pl p ON p.row_id = pa.parent")
def parent_offsets(spark, sf):
    return graph.parent_offsets(*forest(spark, sf))


@query()
def encode_tiles(spark, sf):
    return payload.encode(payload.tiles(items(spark, sf))).drop("streams", "symbols")


@query()
def encode_adaptive(spark, sf):
    cfg = payload.EncodeConfig(adaptive=True, weight="encoding", forest_cut=1.5)
    return payload.encode(payload.tiles(events(spark, sf), cfg), cfg).drop("streams", "symbols")


@query()
def encode_report(spark, sf):
    coo = items(spark, sf)
    return payload.report(payload.encode(payload.tiles(coo)), coo)


@query()
def build_stats(spark, sf):
    coo = items(spark, sf)
    s = matrix.summary(coo).first()
    return payload.build_stats(payload.encode(payload.tiles(coo)), coo, s.n_rows * s.n_cols, payload.stats_label(f"{sf}/lineitem/part"))


def roundtrip(coo: DataFrame, cfg: payload.EncodeConfig = payload.EncodeConfig()) -> DataFrame:
    tiled = payload.tiles(coo, cfg)
    return payload.decode(payload.encode(tiled, cfg), payload.encode_maps(tiled), cfg)


@query(f"WITH {COO} SELECT * FROM coo")
def decode_roundtrip(spark, sf):
    return roundtrip(items(spark, sf))


@query(f"WITH {EVENTS} SELECT * FROM coo")
def decode_adaptive(spark, sf):
    return roundtrip(events(spark, sf), payload.EncodeConfig(adaptive=True, weight="encoding", index_codec="stream-vbyte"))


@query(f"WITH {COO}, {CLUSTERS}, {QUANT}, b AS (SELECT cluster_id, value, center, row_number() OVER (PARTITION BY cluster_id, value ORDER BY abs(value - center), center) AS k FROM (SELECT DISTINCT cluster_id, value FROM a) JOIN ce USING (cluster_id)) SELECT row_id, col_id, center AS value FROM a JOIN b USING (cluster_id, value) WHERE k = 1")
def lossy_roundtrip(spark, sf):
    return roundtrip(items(spark, sf), payload.EncodeConfig(lossy_bins=2))


@query("WITH " + COO + "".join(f""", {s} AS (SELECT string_agg(value, ',' ORDER BY value) AS v FROM (SELECT CAST({k} AS BIGINT) AS id FROM {t}) LEFT JOIN coo ON {c} = id GROUP BY id)""" for s, k, t, c in (("r", "s_suppkey", "supplier", "row_id"), ("c", "p_partkey", "part", "col_id"))) + " SELECT 'row' AS side, md5(coalesce(v, '')) AS vals, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'column', md5(coalesce(v, '')), count(*) FROM c GROUP BY ALL")
def verify_fingerprints(spark, sf):
    rows = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("row_id"))
    cols = read(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("col_id"))
    return payload.fingerprints(items(spark, sf), rows, cols)


@query(f"WITH {COO}, u AS (SELECT count(DISTINCT col_id) AS u FROM coo), lf AS (SELECT n, sum(log2(n)) OVER (ORDER BY n) AS lf FROM range(1, (SELECT u + 1 FROM u)) AS r(n)), s AS (SELECT row_id, count(*) AS nnz FROM coo GROUP BY 1) SELECT row_id, nnz, round((SELECT lf FROM lf, u WHERE n = u) - coalesce(a.lf, 0) - coalesce(b.lf, 0), 4) AS bits FROM s CROSS JOIN u LEFT JOIN lf a ON a.n = nnz LEFT JOIN lf b ON b.n = u - nnz")
def log2_choose_bounds(spark, sf):
    coo = items(spark, sf)
    return payload.support_bound(coo.groupBy("row_id").agg(F.count("*").alias("nnz")), coo.select("col_id").distinct().count())


_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_L2 = "round(sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6)"
_NEAR = "nn AS (SELECT a.id AS anchor, row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS rank, b.id AS nbr, {d} AS dist FROM {x} a JOIN e b ON a.id <> b.id QUALIFY rank <= 8)"


def _near(d: str, x: str = "e") -> str:
    return _NEAR.format(d=d, x=x)


@query(f"WITH {_E}, {_near('round(sqrt((a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2])), 6)')} SELECT * FROM nn")
def knn_spatial(spark, sf):
    return neighbours.knn(points(spark, sf).select("id", F.slice("vec", 1, 2).alias("vec")), 8)


@query(f"WITH {_E}, {_near(_L2.format(a='a.v', b='b.v'))} SELECT * FROM nn")
def knn_expression(spark, sf):
    return neighbours.knn(points(spark, sf), 8)


@query(f"WITH {_E}, {_near('CAST(len(list_filter(list_zip(a.v, b.v), lambda z: (z[1] > 0) <> (z[2] > 0))) AS DOUBLE)')} SELECT * FROM nn")
def knn_l0(spark, sf):
    return neighbours.knn(points(spark, sf), 8, "l0")


_XY = _near("round(sqrt((a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2])), 6)")


def _dense(name: str, column, sql: str) -> None:
    """The metric between each point's expression and that of its spatial neighbours."""

    def f(spark, sf):
        return neighbours.with_distance(knn_spatial(spark, sf).select("anchor", "rank", "nbr"), points(spark, sf), column).select("anchor", "rank", "nbr", "d")

    f.__name__ = f"dense_{name}"
    query(f"WITH {_E}, {_XY} SELECT anchor, rank, nbr, {sql} AS d FROM nn JOIN e a ON a.id = anchor JOIN e b ON b.id = nbr")(f)


_dense("cosine", metrics.cosine, "round(1 - list_cosine_similarity(a.v, b.v), 6)")
_dense("l2", metrics.l2, _L2.format(a="a.v", b="b.v"))
_dense("l0", metrics.l0, "CAST(len(list_filter(list_zip(a.v, b.v), lambda z: (z[1] > 0) <> (z[2] > 0))) AS DOUBLE)")


_L0 = "CAST(len(list_filter(list_zip(a.v, b.v), lambda z: (z[1] > 0) <> (z[2] > 0))) AS DOUBLE)"


@query(f"WITH {_E}, {_XY} SELECT anchor, rank, nbr, dist AS xy_l2, {_L0} AS expr_l0 FROM nn JOIN e a ON a.id = anchor JOIN e b ON b.id = nbr")
def neighbor_preview(spark, sf):
    p = points(spark, sf)
    return neighbours.preview(knn_spatial(spark, sf).select("anchor", "rank", "nbr"), p.select("id", F.slice("vec", 1, 2).alias("vec")), p)


@query(f"""WITH {_E}, {_near(_L2.format(a='a.v', b='b.v'))}, n AS (SELECT count(*) AS n FROM e), ix AS (SELECT id AS nbr, row_number() OVER (ORDER BY id) - 1 AS at FROM e),
pm AS (SELECT min(c) AS prime FROM n, range((SELECT n FROM n), (SELECT n + 1000 FROM n)) AS r(c) WHERE NOT EXISTS (FROM range(2, 2000) AS d(x) WHERE x < c AND c % x = 0)),
wk AS (SELECT id AS anchor, p AS perm, md5('42|' || id || '|' || p) AS h, prime FROM e, range(1, 11) AS q(p), pm),
st AS (SELECT anchor, perm, prime, CAST('0x' || substr(h, 1, 15) AS BIGINT) % prime AS start, CAST('0x' || substr(h, 17, 15) AS BIGINT) % (prime - 1) + 1 AS step FROM wk),
pool AS (SELECT anchor, perm, ix.nbr, row_number() OVER (PARTITION BY anchor, perm ORDER BY t) AS r FROM st, range(64) AS w(t) JOIN ix ON ix.at = (start + step * t) % prime WHERE ix.nbr <> anchor AND NOT EXISTS (FROM nn WHERE nn.anchor = st.anchor AND nn.nbr = ix.nbr)),
dr AS (SELECT anchor, perm, round(avg({_L2.format(a='a.v', b='b.v')}), 6) AS m FROM pool JOIN e a ON a.id = anchor JOIN e b ON b.id = nbr WHERE r <= 8 GROUP BY 1, 2),
ob AS (SELECT anchor, round(avg(dist), 6) AS observed FROM nn GROUP BY 1)
SELECT anchor, observed, round((count(*) FILTER (WHERE m <= observed + 1e-12) + 1) / (count(m) + 1), 9) AS p FROM ob LEFT JOIN dr USING (anchor) GROUP BY ALL""")
def permutation_pvalues(spark, sf):
    p = points(spark, sf)
    return neighbours.permutation_test(p, neighbours.knn(p, 8), 8, 10, metrics.l2)


_CDF = f"CASE WHEN z < 0 THEN tl ELSE 1 - tl END AS cdf FROM (SELECT *, ({'(' * 5}0{''.join(f' + {a}) * tt' for a in reversed(neighbours.ERF_A))}) * exp(-z * z / 2) / 2 AS tl FROM (SELECT *, 1 / (1 + {neighbours.ERF_P} * abs(z) / sqrt(2)) AS tt FROM zz))"


@query(f"""WITH s AS (SELECT l_returnflag AS k, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE 'y' END AS side, l_quantity AS v FROM lineitem),
d AS (SELECT k, v, count(*) AS t, count(*) FILTER (WHERE side = 'x') AS tx FROM s GROUP BY 1, 2), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS r FROM d),
g AS (SELECT k, CAST(sum(tx * r) AS DOUBLE) AS r1, CAST(sum(tx) AS DOUBLE) AS n1, CAST(sum(t - tx) AS DOUBLE) AS n2, CAST(sum(CAST(t AS DOUBLE) * t * t - t) AS DOUBLE) AS ties FROM r GROUP BY 1),
zz AS (SELECT k, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM g WHERE n1 > 0 AND n2 > 0)
SELECT k, round(u, 4) AS u, round(z, 6) AS z, round(cdf, 6) AS p FROM (SELECT k, u, z, {_CDF})""")
def rank_sum_u(spark, sf):
    li = read(spark, sf, "lineitem")
    s = li.select(F.col("l_returnflag").alias("k"), F.when(F.col("l_linestatus") == "O", "x").otherwise("y").alias("side"), F.col("l_quantity").alias("v"))
    return neighbours.rank_sum(s, "k")


_MODE_SQL = {"cosine": "round(1 - list_cosine_similarity(a.v, b.v), 6)", "l2": _L2.format(a="a.v", b="b.v"), "l0": _L0, "xy": "round(sqrt((a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2])), 6)"}
_MODE_NEAR = {"spatial": _MODE_SQL["xy"], "spatial-l0": _MODE_SQL["xy"], "expression": _MODE_SQL["l2"], "expression-l0": _L0}


@query(f"WITH {_E}, " + ", ".join(_NEAR.format(d=d, x="e").replace("nn AS", f"n{i} AS") for i, d in enumerate(_MODE_NEAR.values())) + " " + " UNION ALL ".join(
    f"SELECT '{neighbours.label(mode, 'perm')}' AS label, '{m}' AS metric, anchor, round(avg({_MODE_SQL[m]}), 4) AS observed FROM n{i} JOIN e a ON a.id = anchor JOIN e b ON b.id = nbr GROUP BY anchor"
    for i, mode in enumerate(_MODE_NEAR) for m in neighbours.MODE_METRICS[mode][0]))
def mode_metrics(spark, sf):
    """Mean observed distances of each neighbour mode by each metric that it tests."""
    df = points(spark, sf).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.col("vec").alias("expr"))
    out, found = None, {}
    for mode in neighbours.MODE_METRICS:
        for m, d in neighbours.mode_distances(df, 8, mode, found=found).items():
            one = d.groupBy("anchor").agg(F.round(F.avg("d"), 4).alias("observed")).select(F.lit(neighbours.label(mode, "perm")).alias("label"), F.lit(m).alias("metric"), "anchor", "observed")
            out = one if out is None else out.unionByName(one)
    return out


@query()
def pca_scores(spark, sf):
    p = points(spark, sf)
    mean = p.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    centre = F.array(*[F.lit(r.m) for r in mean])
    return neighbours.pca(p.select("id", F.zip_with("vec", centre, lambda a, b: a - b).alias("vec")), 4)


P = "p AS (SELECT l_returnflag AS dataset, l_linestatus AS kind, ((l_orderkey * 7919 + l_linenumber * 104729) % 10007) / 10007.0::DOUBLE AS p FROM lineitem)"
BH = "r AS (SELECT *, row_number() OVER (PARTITION BY dataset, kind ORDER BY p) AS rn, count(*) OVER (PARTITION BY dataset, kind) AS m FROM p), q AS (SELECT dataset, kind, p, least(1.0, min(m * p / rn) OVER (PARTITION BY dataset, kind ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 10007) / F.lit(10007.0)
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("kind"), p.alias("p"))


@query(f"WITH {P}, {BH} SELECT dataset, kind, round(p, 9) AS p, round(max(q), 9) AS q, count(*) AS n FROM q GROUP BY dataset, kind, p")
def bh_adjust(spark, sf):
    a = neighbours.benjamini_hochberg(p_values(spark, sf), ["dataset", "kind"])
    return a.groupBy("dataset", "kind", "p").agg(F.round(F.max("q"), 9).alias("q"), F.count("*").alias("n")).withColumn("p", F.round("p", 9))


@query(f"WITH {P}, {BH} SELECT dataset, kind, count(*) FILTER (WHERE q < 0.05) || '/' || count(*) AS hits, printf('%.2f', count(*) FILTER (WHERE q < 0.05) / count(*)) AS rate FROM q GROUP BY 1, 2")
def bh_summary(spark, sf):
    s = neighbours.significant(neighbours.benjamini_hochberg(p_values(spark, sf), ["dataset", "kind"]), ["dataset", "kind"])
    return s.select("dataset", "kind", F.format_string("%d/%d", "significant", "total").alias("hits"), F.format_string("%.2f", F.col("significant") / F.col("total")).alias("rate"))


@query(f"""WITH {P}, {BH}, h AS (SELECT dataset, CASE WHEN kind = 'O' THEN 'spatial' ELSE 'exprs' END AS kind, count(*) FILTER (WHERE q < 0.05) AS s, count(*) AS t FROM q GROUP BY 1, 2)
SELECT dataset AS filename, coalesce(max(CASE WHEN kind = 'spatial' THEN s || '/' || t END), '') AS spatial_l0, coalesce(max(CASE WHEN kind = 'spatial' THEN printf('%.2f', s / t) END), '') AS "spatial_l0 rate", coalesce(max(CASE WHEN kind = 'exprs' THEN s || '/' || t END), '') AS exprs_l0 FROM h GROUP BY 1""")
def summary_table(spark, sf):
    s = neighbours.significant(neighbours.benjamini_hochberg(p_values(spark, sf), ["dataset", "kind"]), ["dataset", "kind"])
    return tables.summary_table(s.withColumn("kind", F.when(F.col("kind") == "O", "spatial").otherwise("exprs")))
