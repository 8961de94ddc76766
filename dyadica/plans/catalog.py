"""All queries over trajectories by name, and their SQL.

Trajectories come whole from two tables: a curve for each user of ``events``, and for
the searches that grow with subsets or rounds a curve for each nation of ``supplier``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadica.functions.numeric import frechet_expression
from dyadica.operators import clustering, geometry, mining, pathlets, reach, sampling, simplify, validate, vcdim
from dyadica.plans import sql
from dyadica.sources import tables

RADIUS, FREQUENCY, MIN_LENGTH, FACTOR, GRID = 10.0, 0.1, 5, 0.5, 0.5
SUPPLIER_RADIUS = 25.0
EPS, DELTA = 0.1, 0.05

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_points(spark.read.parquet(f"{sf_dir}/events.parquet"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.supplier_points(spark.read.parquet(f"{sf_dir}/supplier.parquet"))


_P, _T = sql.points(), sql.tree()
_L = sql.labels(RADIUS)
_SP = sql.points(sql.SUPPLIERS)
_SL = sql.labels(SUPPLIER_RADIUS)
_E = sql.ends(MIN_LENGTH)

# ---- scans and element access


@_query(sql.query("SELECT * FROM pts", _P))
def points(spark, sf_dir):
    return events(spark, sf_dir)


@_query(sql.query("SELECT tid, n, (sum(n) OVER (ORDER BY tid) - n)::BIGINT AS first_index FROM pts_n", _P))
def trajectory_statistics(spark, sf_dir):
    return tables.statistics(events(spark, sf_dir))


@_query("SELECT user_id::BIGINT AS tid, count(*)::BIGINT AS late FROM (SELECT user_id, ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM events) WHERE bad GROUP BY user_id")
def order_check(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return rows.withColumn("bad", F.col("ts") <= before).where("bad").groupBy(F.col("user_id").cast("long").alias("tid")).agg(F.count("*").alias("late"))


@_query(sql.query("SELECT c.chunk::BIGINT AS chunk, count(DISTINCT tid)::BIGINT AS trajectories, count(*)::BIGINT AS points FROM pts JOIN (SELECT tid, (row_number() OVER (ORDER BY tid) - 1) // 50 AS chunk FROM pts_n) AS c USING (tid) GROUP BY ALL", _P))
def trajectory_chunks(spark, sf_dir):
    return tables.chunks(events(spark, sf_dir), 50).groupBy("chunk").agg(F.count_distinct("tid").alias("trajectories"), F.count("*").alias("points"))


@_query(sql.query("SELECT 0::BIGINT AS tid, (row_number() OVER (ORDER BY tid, pos) - 1)::INT AS pos, x, y FROM pts", _P))
def one_curve(spark, sf_dir):
    return tables.as_one_curve(events(spark, sf_dir))


@_query(sql.query("SELECT * FROM pts WHERE tid BETWEEN 10 AND 19", _P))
def trajectory_slice(spark, sf_dir):
    return tables.between(events(spark, sf_dir), 10, 19)


# ---- joins by distance


@_query(sql.query(f"SELECT a.tid, a.pos, count(*)::BIGINT AS near FROM pts AS a JOIN pts AS b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {RADIUS**2}::DOUBLE GROUP BY ALL", _P))
def radius_neighbours(spark, sf_dir):
    p = events(spark, sf_dir)
    return geometry.radius_join(p, p, RADIUS).groupBy("tid", "pos").agg(F.count("*").alias("near"))


@_query(sql.query(f"SELECT floor(x / {RADIUS})::BIGINT AS cx, floor(y / {RADIUS})::BIGINT AS cy, count(*)::BIGINT AS n FROM pts GROUP BY ALL", _P))
def cell_counts(spark, sf_dir):
    return geometry.cell_counts(events(spark, sf_dir), RADIUS)


@_query(sql.query("SELECT tid, count(*)::BIGINT AS cells, count(*) FILTER (WHERE corners = 4)::BIGINT AS whole FROM touch GROUP BY tid", _P, sql.touched(RADIUS, GRID * RADIUS)))
def touched_cells(spark, sf_dir):
    return geometry.touched_cells(events(spark, sf_dir), RADIUS, GRID * RADIUS).groupBy("tid").agg(F.count("*").alias("cells"), F.count_if("whole").alias("whole"))


_NF = "nf AS (SELECT a.tid, a.pos, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) FILTER (WHERE a.tid != b.tid OR a.pos != b.pos) AS nearest, max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS farthest FROM pts AS a, pts AS b GROUP BY ALL)"


@_query(sql.query("SELECT * FROM nf", _P, _NF))
def nearest_and_farthest(spark, sf_dir):
    return geometry.nearest_and_farthest(events(spark, sf_dir))


@_query(sql.query("SELECT step, d2 FROM ladder", _SP, _NF, "ends AS (SELECT min(nearest) FILTER (WHERE nearest > 0) AS lo, max(farthest) AS hi FROM nf)", "ladder(step, d2, hi) AS (SELECT 0::BIGINT, lo, hi FROM ends WHERE lo < hi UNION ALL SELECT step + 1, 4 * d2, hi FROM ladder WHERE 4 * d2 < hi)"))
def distance_ladder(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(geometry.distance_ladder(suppliers(spark, sf_dir)))), "step long, d2 double")


# ---- pathlets


@_query(sql.query("SELECT * FROM nodes", _P, _T))
def pathlet_tree(spark, sf_dir):
    return pathlets.canonical(tables.pack(events(spark, sf_dir)))


@_query(sql.query("SELECT tid AS mother, l, r, r - l + 1 AS len FROM (SELECT tid, n, unnest(range(n)) AS l FROM pts_n), LATERAL (SELECT unnest(range(l, n)) AS r)", _P))
def pathlet_matrix(spark, sf_dir):
    return pathlets.all_intervals(tables.pack(events(spark, sf_dir)))


@_query(sql.query(f"SELECT mother, node, l, r, len FROM nodes WHERE len >= {MIN_LENGTH}", _P, _T))
def long_pathlets(spark, sf_dir):
    return pathlets.canonical(tables.pack(events(spark, sf_dir))).where(F.col("len") >= MIN_LENGTH).drop("level")


@_query(sql.query("SELECT mother, node, l, r FROM small", _P, _T, _E))
def minimal_pathlets(spark, sf_dir):
    return pathlets.minimal(pathlets.canonical(tables.pack(events(spark, sf_dir))), MIN_LENGTH).select("mother", "node", "l", "r")


@_query(sql.query(f"SELECT sum(2 * (n // {MIN_LENGTH}))::BIGINT AS pathlets FROM pts_n", _P))
def pathlet_bound(spark, sf_dir):
    return pathlets.count_bound(tables.pack(events(spark, sf_dir)), MIN_LENGTH)


@_query(sql.query("SELECT mother, l AS pos, node FROM nodes WHERE len = 1", _P, _T))
def pathlet_leaves(spark, sf_dir):
    return pathlets.leaves(pathlets.canonical(tables.pack(events(spark, sf_dir))))


@_query(sql.query("SELECT mother, node, (f.first_index + l)::BIGINT AS first, (f.first_index + r)::BIGINT AS last FROM nodes JOIN (SELECT tid, sum(n) OVER (ORDER BY tid) - n AS first_index FROM pts_n) AS f ON f.tid = mother", _P, _T))
def global_pathlets(spark, sf_dir):
    p = events(spark, sf_dir)
    return pathlets.to_global(pathlets.canonical(tables.pack(p)), tables.statistics(p)).select("mother", "node", "first", "last")


# ---- reachability and mining


def _packed(spark, sf_dir):
    return tables.pack(events(spark, sf_dir))


def _mined(spark, sf_dir, **options):
    t = _packed(spark, sf_dir)
    return mining.frequent(t, t, RADIUS, FREQUENCY, **options)


_F = sql.frequent(FREQUENCY)
_FREQUENT = "SELECT mother, node, l, r, len, cnt, frequency FROM freq"
_MAXIMAL = "WHERE NOT EXISTS (SELECT 1 FROM freq AS o WHERE o.mother = freq.mother AND o.node != freq.node AND o.l <= freq.l AND o.r >= freq.r)"


@_query(sql.query("SELECT * FROM labs", _P, _L))
def least_labels(spark, sf_dir):
    t = _packed(spark, sf_dir)
    return reach.labels(t, t, RADIUS)


@_query(sql.query("SELECT mother, node, l, r, len, cnt FROM sup", _P, _T, _L, sql.SUPPORT))
def pathlet_support(spark, sf_dir):
    t = _packed(spark, sf_dir)
    return mining.pathlet_support(t, t, RADIUS)


@_query(sql.query(_FREQUENT, _P, _T, _L, sql.SUPPORT, _F))
def frequent_pathlets(spark, sf_dir):
    return _mined(spark, sf_dir)


@_query(sql.query("SELECT mother, node, l, r, len, ids AS supporters, cnt, frequency FROM freq WHERE len >= 2", _P, _T, _L, sql.SUPPORT, _F))
def frequent_with_supporters(spark, sf_dir):
    return _mined(spark, sf_dir, min_length=2, keep_ids=True, joined=True)


@_query(sql.query(f"{_FREQUENT} {_MAXIMAL}", _P, _T, _L, sql.SUPPORT, _F))
def maximal_pathlets(spark, sf_dir):
    return _mined(spark, sf_dir, maximal=True)


_INTERVALS = f"""steps AS (SELECT m, j, minl, sum(count(*)) OVER w AS cnt, coalesce(lead(minl) OVER w, j + 1) AS nx FROM labs GROUP BY m, j, minl WINDOW w AS (PARTITION BY m, j ORDER BY minl)),
    ivals AS (SELECT m AS mother, l, j AS r, j - l + 1 AS len, cnt::BIGINT AS cnt, cnt / (SELECT count(*) FROM pts_n)::DOUBLE AS frequency FROM steps, LATERAL (SELECT unnest(range(minl, nx)) AS l) WHERE cnt >= ceil({FREQUENCY} * (SELECT count(*) FROM pts_n) - 1e-9))"""


@_query(sql.query("SELECT * FROM ivals", _P, _L, _INTERVALS))
def frequent_intervals(spark, sf_dir):
    t = _packed(spark, sf_dir)
    return mining.frequent_intervals(t, t, RADIUS, FREQUENCY)


@_query(sql.query("SELECT * FROM ivals AS a WHERE NOT EXISTS (SELECT 1 FROM ivals AS b WHERE b.mother = a.mother AND b.l <= a.l AND b.r >= a.r AND b.len > a.len)", _P, _L, _INTERVALS))
def maximal_intervals(spark, sf_dir):
    t = _packed(spark, sf_dir)
    return mining.frequent_intervals(t, t, RADIUS, FREQUENCY, maximal=True)


_NET = 1.0


@_query(sql.query(f"SELECT mother, count(*)::BIGINT AS pathlets, bool_or(EXISTS (SELECT 1 FROM pts AS p JOIN sup_pts AS s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= {_NET}::DOUBLE WHERE p.tid = mother)) AS kept FROM nodes GROUP BY mother", _P, f"sup_pts AS ({sql.SUPPLIERS})", _T))
def net_report(spark, sf_dir):
    return mining.net_report(_packed(spark, sf_dir), tables.pack(suppliers(spark, sf_dir)), _NET)


@_query(sql.query(f"{_FREQUENT} WHERE mother IN (SELECT p.tid FROM pts AS p JOIN sup_pts AS s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= {RADIUS**2}::DOUBLE)", _P, f"sup_pts AS ({sql.SUPPLIERS})", _T, _L, sql.SUPPORT, _F))
def net_filtered_pathlets(spark, sf_dir):
    return _mined(spark, sf_dir, net=tables.pack(suppliers(spark, sf_dir)))


@_query(sql.query("SELECT tid, pos, anchor::INT AS anchor, weight FROM kept", _P, sql.simplified(RADIUS, FACTOR)))
def simplified_curves(spark, sf_dir):
    s = simplify.simplify(_packed(spark, sf_dir), RADIUS, FACTOR)
    return s.select("tid", F.posexplode(F.arrays_zip("anchors", "weights")).alias("pos", "a")).select("tid", "pos", F.col("a.anchors").alias("anchor"), F.col("a.weights").alias("weight"))


@_query(
    sql.query(
        "SELECT f.mother, node, a.anchor::BIGINT AS l, (b.anchor + b.weight - 1)::BIGINT AS r, (b.anchor + b.weight - a.anchor)::BIGINT AS len, cnt, frequency FROM freq AS f JOIN kept AS a ON a.tid = f.mother AND a.pos = f.l JOIN kept AS b ON b.tid = f.mother AND b.pos = f.r",
        _P, sql.simplified(RADIUS, FACTOR), sql.tree(sizes="kept_n"), sql.labels(RADIUS, "kept", "kept"), sql.SUPPORT, _F,
    )
)
def simplified_pathlets(spark, sf_dir):
    t = _packed(spark, sf_dir)
    return simplify.frequent_simplified(t, t, RADIUS, FREQUENCY, FACTOR)


@_query()
def frechet_distances(spark, sf_dir):
    """Squared discrete Fréchet distances of all pairs of nations' curves, in expressions only."""
    t = tables.pack(suppliers(spark, sf_dir))
    a, b = t.select(F.col("tid").alias("a"), F.col("xs").alias("ax"), F.col("ys").alias("ay")), t.select(F.col("tid").alias("b"), F.col("xs").alias("bx"), F.col("ys").alias("by"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.expr(frechet_expression("ax", "ay", "bx", "by")).alias("d2"))


# ---- sampling

_NEAR = (sql.near("nb", "begins", RADIUS), sql.near("ne", "stops", RADIUS))


@_query(sql.query("SELECT * FROM counts", _P, _T, _E, *_NEAR, sql.SURVIVE))
def surviving_pathlets(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.vc_counts(p, p, RADIUS, MIN_LENGTH)


@_query(sql.query("SELECT * FROM h", _P, _T, _E, *_NEAR, sql.SURVIVE, sql.H_INDEX))
def vc_bound(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.h_index(sampling.vc_counts(p, p, RADIUS, MIN_LENGTH))


@_query(sql.query(f"SELECT (trunc(trunc(2 / {EPS}::DOUBLE ** 2) * (d + ln(2 / {DELTA}::DOUBLE))))::BIGINT AS size FROM h", _P, _T, _E, *_NEAR, sql.SURVIVE, sql.H_INDEX))
def vc_sample_size(spark, sf_dir):
    p = events(spark, sf_dir)
    return spark.createDataFrame([(sampling.sample_size(2, p, p, RADIUS, eps=EPS, delta=DELTA, min_length=MIN_LENGTH),)], "size long")


@_query(sql.query(f"SELECT (trunc(trunc(12 / {EPS}::DOUBLE ** 2) * ln(2 * sum(2 * (n // {MIN_LENGTH})) / {DELTA}::DOUBLE)))::BIGINT AS size FROM pts_n", _P))
def chernoff_sample_size(spark, sf_dir):
    p = events(spark, sf_dir)
    return spark.createDataFrame([(sampling.sample_size(1, p, p, RADIUS, eps=EPS, delta=DELTA, min_length=MIN_LENGTH),)], "size long")


@_query(sql.query("SELECT tid, count(*)::BIGINT AS c FROM nb GROUP BY tid", _P, _T, _E, _NEAR[0]))
def rough_counts(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.rough_counts(p, p, RADIUS, MIN_LENGTH)


@_query(sql.query("SELECT tid, least(a.c, b.c)::BIGINT AS c FROM (SELECT tid, count(*) AS c FROM nb GROUP BY tid) AS a JOIN (SELECT tid, count(*) AS c FROM ne GROUP BY tid) AS b USING (tid)", _P, _T, _E, *_NEAR))
def rough_least_counts(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.rough_counts(p, p, RADIUS, MIN_LENGTH, least=True)


@_query(sql.query("SELECT tid, count(*)::BIGINT AS c, rank() OVER (ORDER BY count(*) DESC)::INT AS place FROM nb GROUP BY tid", _P, _T, _E, _NEAR[0]))
def trajectories_by_near_pathlets(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.by_near_pathlets(p, p, RADIUS, MIN_LENGTH)


_SIDE = GRID * RADIUS
_CELLS = sql.touched(RADIUS, _SIDE)


@_query(sql.query("SELECT tid, sum(n)::BIGINT AS c FROM touch JOIN marks USING (cx, cy) GROUP BY tid", _P, _T, _E, _CELLS, f"marks AS (SELECT floor(x / {_SIDE})::BIGINT AS cx, floor(y / {_SIDE})::BIGINT AS cy, count(*) AS n FROM begins GROUP BY ALL)"))
def turbo_counts(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.turbo_counts(p, p, RADIUS, MIN_LENGTH, _SIDE)


def _in_cells(name: str, marks: str) -> str:
    return f"{name} AS (SELECT t.tid, t.pos, b.mother, b.node FROM touch AS t JOIN {marks} AS b ON t.cx = floor(b.x / {_SIDE})::BIGINT AND t.cy = floor(b.y / {_SIDE})::BIGINT)"


@_query(sql.query("SELECT * FROM counts", _P, _T, _E, _CELLS, _in_cells("nb", "begins"), _in_cells("ne", "stops"), sql.SURVIVE))
def surviving_by_cells(spark, sf_dir):
    p = events(spark, sf_dir)
    return sampling.vc_counts(p, p, RADIUS, MIN_LENGTH, side=_SIDE, exact=False)


@_query()
def sample_sizes(spark, sf_dir):
    """The size that each numbered mode names, over suppliers' curves."""
    p = suppliers(spark, sf_dir)
    return spark.createDataFrame([(m, sampling.sample_size(m, p, p, SUPPLIER_RADIUS, eps=EPS, delta=DELTA, min_length=2, grid=GRID)) for m in sampling.MODES], "mode long, size long")


@_query(sql.query("SELECT tid, pos, x, y FROM pts WHERE tid IN (SELECT tid FROM pts_n ORDER BY md5('7:' || tid), tid LIMIT 10)", _P))
def drawn_sample(spark, sf_dir):
    """A fixed-size sample of curves, as points."""
    return tables.unpack(sampling.draw(_packed(spark, sf_dir), 10, seed=7))


# ---- exact VC dimension


def _supports(spark, sf_dir):
    t = tables.pack(suppliers(spark, sf_dir))
    return mining.distinct_supports(mining.supporters(pathlets.canonical(t).drop("level"), reach.labels(t, t, SUPPLIER_RADIUS)))


_SETS = (_SP, _T, _SL, sql.SUPPORT, "sets AS (SELECT DISTINCT ids, cnt FROM sup)", "long_sets AS (SELECT ids, unnest(string_split(ids, ','))::BIGINT AS tid FROM sets)", "els AS (SELECT * FROM long_sets WHERE tid NOT IN (SELECT tid FROM long_sets GROUP BY tid HAVING count(*) = (SELECT count(*) FROM sets)))")


@_query(sql.query("SELECT ids AS supporters, cnt AS size FROM sets", *_SETS))
def distinct_supports(spark, sf_dir):
    return _supports(spark, sf_dir).select(F.array_join(F.transform("supporters", lambda t: t.cast("string")), ",").alias("supporters"), F.col("size").cast("long").alias("size"))


@_query(
    sql.query(
        "SELECT a, b FROM both_in JOIN ones AS p ON p.tid = a JOIN ones AS q ON q.tid = b WHERE k < p.n AND k < q.n",
        *_SETS, "ones AS (SELECT tid, count(*) AS n FROM els GROUP BY tid)", "both_in AS (SELECT x.tid AS a, y.tid AS b, count(*) AS k FROM els AS x JOIN els AS y ON x.ids = y.ids AND x.tid < y.tid GROUP BY ALL)",
    )
)
def shattered_pairs(spark, sf_dir):
    ranges = _supports(spark, sf_dir)
    long = vcdim.elements(ranges)
    return vcdim.shattered(vcdim.pairs(long), long, ranges.count()).select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"))


@_query()
def vc_dimension(spark, sf_dir):
    return spark.createDataFrame([(vcdim.vc_dimension(_supports(spark, sf_dir)),)], "d long")


# ---- clustering

_W = clustering.Weights(1.0, 0.005, 128.0)


def _curves(spark, sf_dir):
    p = suppliers(spark, sf_dir).persist()
    return tables.pack(p), geometry.distance_ladder(p)


@_query()
def cluster_center(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    return clustering.center(t, ladder, _W, factor=0.2)[0]


@_query()
def cluster_means(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    clusters, _, data = clustering.means(t, ladder, _W)
    return clustering.to_frame(spark, data, clusters)


def _seeds(t, ladder, factor=0.0):
    return clustering.mined_seeds(t, ladder, FREQUENCY, factor)


@_query()
def cluster_aided_center(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    return clustering.center(t, ladder, _W, seeds=_seeds(t, ladder))[0]


@_query()
def cluster_aided_means(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    clusters, _, data = clustering.means(t, ladder, _W, seeds=_seeds(t, ladder))
    return clustering.to_frame(spark, data, clusters)


@_query()
def cluster_aided_all(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    clusters, _, data = clustering.means(t, ladder, _W, seeds=_seeds(t, ladder), every=True)
    return clustering.to_frame(spark, data, clusters)


@_query()
def cluster_aided_random(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    clusters, _, data = clustering.means(t, ladder, _W, seeds=_seeds(t, ladder, 0.2), tries=5, seed=3)
    return clustering.to_frame(spark, data, clusters)


@_query()
def cluster_basic_length(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    return clustering.basic(t, ladder, _W, length=2)[0]


@_query()
def cluster_basic_size(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    return clustering.basic(t, ladder, _W, size=3)[0]


@_query()
def cluster_vertices_means(spark, sf_dir):
    t, ladder = _curves(spark, sf_dir)
    clusters, _, data = clustering.means(t, ladder, _W, score=lambda d2: clustering.by_vertices(1, 0.0, d2**0.5))
    return clustering.to_frame(spark, data, clusters)


@_query()
def cluster_longest(spark, sf_dir):
    return clustering.bbgll(tables.pack(suppliers(spark, sf_dir)), SUPPLIER_RADIUS**2, 3)


# clusters by design: a half of each curve, a quarter inside it and one outside, so that some points are covered twice and some never
_CLUSTERS = "cl AS (SELECT mother AS cid, mother AS tid, l, r FROM nodes WHERE node IN (1, 3, 5))"


def _levels(spark, sf_dir):
    nodes = pathlets.canonical(_packed(spark, sf_dir)).where("node IN (1, 3, 5)")
    return nodes.select(F.col("mother").alias("cid"), F.col("mother").alias("tid"), "l", "r")


@_query(sql.query("SELECT tid, pos, count(*)::BIGINT AS n FROM cl JOIN pts USING (tid) WHERE pos BETWEEN l AND r GROUP BY ALL HAVING count(*) > 1", _P, _T, _CLUSTERS))
def overlaps(spark, sf_dir):
    return validate.overlaps(_levels(spark, sf_dir)).withColumn("pos", F.col("pos").cast("int"))


@_query(sql.query("SELECT cid, sum(r - l + 1)::BIGINT AS vertices, count(*)::BIGINT AS members FROM cl GROUP BY cid", _P, _T, _CLUSTERS))
def cluster_vertices(spark, sf_dir):
    return validate.cluster_vertices(_levels(spark, sf_dir))


@_query(sql.query("SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.tid = pts.tid AND pos BETWEEN l AND r)) / count(*)::DOUBLE AS uncovered FROM pts", _P, _T, _CLUSTERS))
def uncovered_share(spark, sf_dir):
    return validate.uncovered(events(spark, sf_dir), _levels(spark, sf_dir))


@_query(sql.query("SELECT tid, min(pos)::INT AS pos FROM pts WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.tid = pts.tid AND pts.pos BETWEEN l AND r) GROUP BY tid", _P, _T, _CLUSTERS))
def first_uncovered(spark, sf_dir):
    return validate.first_uncovered(events(spark, sf_dir), _levels(spark, sf_dir))
