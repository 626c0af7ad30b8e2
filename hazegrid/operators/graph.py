"""Road graph tables: indexes, edges, features, audits, neighbourhoods and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazegrid.functions.clean import road_class
from hazegrid.functions.geo import bearing_deg
from hazegrid.operators.scratch import Rounds, with_package


def index_ids(df: DataFrame, key: str, out: str, block: int = 1 << 16) -> DataFrame:
    """Distinct keys numbered from 0 in their order, without one task for all: ranks within ranges of the key plus the ranges' offsets."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.floor(F.col(key) / block))
    counts = ids.groupBy("_b").agg(F.count("*").alias("_n"))
    # one row a range of keys
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return ids.withColumn("_r", rank).join(before, "_b").select(key, (F.col("_before") + F.col("_r") - 1).cast("long").alias(out))


def index_categories(df: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct categories numbered in their order; the ranked table has a row a category."""
    return df.select(column).distinct().where(F.col(column).isNotNull()).withColumn(out, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int"))


def simple_edges(edges: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """One row a (u, v): columns of the first parallel edge, and others of the last."""
    return edges.groupBy("u", "v").agg(*[F.min_by(c, "key").alias(c) for c in first], *[F.max_by(c, "key").alias(c) for c in last])


def edge_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u_idx, v_idx, length, highway, highway_code): indexed ends that exist, both directions, no self-loops, distinct before road classes are normalised."""
    idx = index_ids(nodes, "osmid", "i")
    e = edges.join(idx.toDF("u", "u_idx"), "u").join(idx.toDF("v", "v_idx"), "v").select("u_idx", "v_idx", "length", "highway")
    both = e.unionByName(e.select(F.col("v_idx").alias("u_idx"), F.col("u_idx").alias("v_idx"), "length", "highway")).where("u_idx <> v_idx").dropDuplicates(["u_idx", "v_idx", "length", "highway"])
    both = both.withColumn("highway", road_class(F.col("highway")))
    return both.join(index_categories(both, "highway", "highway_code"), "highway").select("u_idx", "v_idx", "length", "highway", "highway_code")


def one_hot(code: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == code).cast("float"))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with x1, y1, x2, y2 of their ends."""
    a, b = nodes.select(F.col("osmid").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1")), nodes.select(F.col("osmid").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "u").join(b, "v")


def with_bearing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_ends(edges, nodes).withColumn("bearing_deg", bearing_deg(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def midpoint(geometry: Column | None = None) -> tuple[Column, Column]:
    """Middle of a geometry's ends where there is one of two points or more, else of the edge's nodes."""
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    if geometry is None:
        return mx, my
    a, b, ok = F.try_element_at(geometry, F.lit(1)), F.try_element_at(geometry, F.lit(-1)), F.size(geometry) >= 2
    return F.when(ok, (a["x"] + b["x"]) / 2).otherwise(mx), F.when(ok, (a["y"] + b["y"]) / 2).otherwise(my)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.select(F.explode(F.array("u", "v")).alias("osmid")).groupBy("osmid").agg(F.count("*").alias("degree"))
    return nodes.select("osmid").join(n, "osmid", "left").select("osmid", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes, density, shortest and longest edge, ends that are no node."""
    d = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"))
    e = edges.agg(F.count("*").alias("edges"), F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    ids = nodes.select(F.col("osmid").alias("end"))
    bad = edges.select(F.explode(F.array("u", "v")).alias("end")).join(ids, "end", "left_anti").agg(F.count("*").alias("dangling_ends"))
    return d.crossJoin(e).crossJoin(bad).withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def feature_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in columns])


#: Targets that an index of `nearest` is built from at most (6 MB), and those of one of its leaves.
SAMPLE_ROWS, LEAF_ROWS, LEAF_SAMPLE = 1 << 18, 16, 8


def split_plane(x: np.ndarray, y: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(splits by level, places of some targets of each leaf) of a plane cut in halves of equal count, by x and y in turn; len(x) is a multiple of 2**depth."""
    order, splits = np.arange(len(x)), []
    for level in range(depth):
        c = (x, y)[level % 2]
        order = order[np.lexsort((c[order], np.arange(len(x)) // (len(x) >> level)))]
        parts = order.reshape(1 << level, -1)
        splits.append(c[parts[:, parts.shape[1] // 2 - 1]])
    leaves = order.reshape(1 << depth, -1)
    return splits, leaves[:, np.linspace(0, leaves.shape[1] - 1, min(LEAF_SAMPLE, leaves.shape[1])).astype(int)]


def leaf_of(splits: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for level, s in enumerate(splits):
        node = 2 * node + ((x, y)[level % 2] > s[node])
    return node


def leaves_within(splits: list[np.ndarray], x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, leaf) of all leaves that the square of half-side `reach` around each point touches."""
    who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level, s in enumerate(splits):
        c, r, at = (x, y)[level % 2][who], reach[who], s[node]
        low, high = c - r <= at, c + r > at
        who, node = np.concatenate((who[low], who[high])), np.concatenate((2 * node[low], 2 * node[high] + 1))
    return who, node


def _sides_within(points: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Points (id, x, y, leaf) at all leaves that may hold their nearest target, and the leaves' targets (leaf, tid, tx, ty); None without targets. All coordinates are finite."""
    spark = with_package(points.sparkSession)
    t = targets.groupBy("x", "y").agg(F.min("tid").alias("tid"))  # of targets in one place the smallest counts
    n = t.count()
    if not n:
        return None
    picked = t.where(F.pmod(F.xxhash64("x", "y"), F.lit(n)) < SAMPLE_ROWS).select("x", "y").limit(2 * SAMPLE_ROWS).toArrow()
    sx, sy = (picked[c].to_numpy() for c in ("x", "y"))
    depth = max(0, min(int(n // LEAF_ROWS).bit_length() - 1, int(len(sx) // LEAF_SAMPLE).bit_length() - 1))
    whole = len(sx) >> depth << depth
    splits, some = split_plane(sx[:whole], sy[:whole], depth)
    index = spark.sparkContext.broadcast((splits, sx[some], sy[some]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits = index.value[0]
        for b in batches:
            leaf = leaf_of(splits, b.column("x").to_numpy(), b.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, sx, sy = index.value
        for b in batches:
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            own = leaf_of(splits, x, y)
            # a few targets near by tell how far the nearest is at most
            reach = np.sqrt(((sx[own] - x[:, None]) ** 2 + (sy[own] - y[:, None]) ** 2).min(axis=1)) * (1 + 1e-9) + 1e-9
            who, leaf = leaves_within(splits, x, y, reach)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(who)) for c in b.columns), pa.array(leaf)], [*b.schema.names, "leaf"])

    kinds = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    t = t.select("tid", "x", "y")
    held = t.mapInArrow(assign, f"{kinds(t)}, leaf long").select("leaf", "tid", F.col("x").alias("tx"), F.col("y").alias("ty"))
    asked = points.mapInArrow(spread, f"{kinds(points)}, leaf long")
    return asked, held


def _pairs_within(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, tid, d): each point with the targets of all leaves that may hold its nearest; there are targets."""
    asked, held = _sides_within(points, targets)
    return asked.join(held, "leaf").select("id", "tid", F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y")).alias("d"))


def _best_within(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, m): each point's nearest (d, tid) in each of those leaves. A leaf's targets are one array, so that a point and a leaf make one row and no pair is sorted or kept."""
    sides = _sides_within(points, targets)
    if sides is None:
        return points.select("id", F.lit(None).cast(f"struct<d: double, tid: {targets.schema['tid'].dataType.simpleString()}>").alias("m")).where(F.lit(False))
    asked, held = sides
    leaves = held.groupBy("leaf").agg(F.collect_list(F.struct("tid", "tx", "ty")).alias("held"))
    away = F.transform("held", lambda t: F.struct(F.hypot(t["tx"] - F.col("x"), t["ty"] - F.col("y")).alias("d"), t["tid"].alias("tid")))
    return asked.join(leaves, "leaf").select("id", F.array_min(away).alias("m"))


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Each point (id, x, y) with its nearest target (tid, x, y) and metres, ties to the smaller tid; both sides may be large.

    The plane is cut into leaves of equal target count (k-d splits of a bounded sample), so that cells are small where targets
    are dense. A few known targets of a point's own leaf bound its distance; the point goes to all leaves within that reach and
    meets their targets there, so pairs a point do not grow with either side (beyond some 500,000 distinct targets, whose
    leaves are as many as the sample allows, leaves hold more). Points without finite coordinates have a null target, as all have
    where there are no targets; such targets are left out. Rows that share an id count as one.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    number = lambda df, k: df.select(k, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p, t = number(points, "id"), number(targets, "tid").where(fine("x") & fine("y") & F.col("tid").isNotNull())
    met = _best_within(p.where(fine("x") & fine("y")), t)
    every = p.select("id", F.lit(None).cast(met.schema["m"].dataType).alias("m"))
    return met.unionByName(every).groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.tid").alias("tid"), F.col("m.d").alias("distance_meters"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in a node set (osmid)."""
    ids = nodes.select("osmid")
    return edges.join(ids.toDF("u"), "u", "left_semi").join(ids.toDF("v"), "v", "left_semi")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(osmid, hop): nodes from which a seed is reached over at most so many edges. Every hop is written and read back."""
    rounds = Rounds(edges.sparkSession)
    seen = rounds.put("seen", seeds.select("osmid").distinct().withColumn("hop", F.lit(0)))
    for h in range(1, hops + 1):
        front = seen.where(F.col("hop") == h - 1).select(F.col("osmid").alias("v"))
        step = edges.join(front, "v", "left_semi").select(F.col("u").alias("osmid")).withColumn("hop", F.lit(h))
        seen = rounds.put("seen", seen.unionByName(step).groupBy("osmid").agg(F.min("hop").alias("hop")))
    return seen


def cap_nodes(nodes: DataFrame, n: int, order: Column) -> DataFrame:
    """At most n nodes in a fixed pseudo-random order."""
    return nodes.orderBy(order, "osmid").limit(n)


def sensor_mask(nodes: DataFrame, sensors: DataFrame) -> DataFrame:
    """Nodes with train_mask: true where a sensor stands."""
    return nodes.join(sensors.select("osmid").distinct().withColumn("_m", F.lit(True)), "osmid", "left").select("osmid", F.coalesce("_m", F.lit(False)).alias("train_mask"))


def unmatched_sensors(nodes: DataFrame, sensors: DataFrame) -> DataFrame:
    return sensors.select("osmid").distinct().join(nodes.select("osmid"), "osmid", "left_anti")


def spatial_clusters(nodes: DataFrame, k: int = 64, seed: int = 42) -> DataFrame:
    """(osmid, cluster) by k-means on the coordinates."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(nodes.select("osmid", "x", "y"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(v).transform(v).select("osmid", "cluster")


def lloyd(nodes: DataFrame, k: int = 64, rounds: int = 5) -> DataFrame:
    """(osmid, cluster) by Lloyd rounds from fixed seeds: nodes evenly spaced in the order of a hash of their id.

    A round is one pass with the k centres at hand and a grouped mean, k rows of which reach the driver; distances are taken by
    batches of nodes, not by expressions of each centre. Ties go to the smaller cluster, and a centre that loses all its nodes stays. On coordinates whose sums are exact the result is the same everywhere.
    """
    n = nodes.where("x is not null and y is not null")
    total = n.count()
    wanted = sorted({i * total // k for i in range(k)}) if total else []
    # ranks within hash ranges plus the ranges' offsets, so that no task ranks all nodes
    n = n.withColumn("_h", F.pmod(F.pmod("osmid", F.lit(1000003)) * 2654435761, F.lit(1000003)) * (1 << 40) + F.col("osmid"))
    ranked = index_ids(n, "_h", "_rank", 1 << 54)
    seeds = n.join(ranked.where(F.col("_rank").isin(wanted)), "_h").orderBy("_rank").select("x", "y").collect()
    centres = [(float(r.x), float(r.y)) for r in seeds]
    with_package(nodes.sparkSession)
    n = n.select("osmid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def deal(at: list[tuple[float, float]]) -> DataFrame:
        cx, cy = np.array(at).reshape(-1, 2).T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
                d = np.subtract.outer(x, cx) ** 2 + np.subtract.outer(y, cy) ** 2
                # as in Spark's order, NaN is the largest
                near = np.argmin(np.where(np.isnan(d), np.inf, d), axis=1) if len(cx) else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype("int32"))], [*b.schema.names, "cluster"])

        return n.mapInArrow(run, f"osmid {n.schema['osmid'].dataType.simpleString()}, x double, y double, cluster int")

    for _ in range(rounds if centres else 0):
        for r in deal(centres).groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).collect():
            centres[r.cluster] = (r.x, r.y)
    return deal(centres).select("osmid", "cluster")


def relabel(edges: DataFrame, nodes: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """(u_idx, v_idx, columns): edges with both ends among nodes, ends numbered from 0 in the order of osmid."""
    ids = index_ids(nodes, "osmid", "idx")
    e = edges.join(ids.select(F.col("osmid").alias("u"), F.col("idx").alias("u_idx")), "u").join(ids.select(F.col("osmid").alias("v"), F.col("idx").alias("v_idx")), "v")
    return e.select("u_idx", "v_idx", *columns)


def inner_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges whose ends lie in one cluster."""
    a, b = clusters.toDF("u", "cu"), clusters.toDF("v", "cv")
    return edges.join(a, "u").join(b, "v").where("cu = cv").withColumnRenamed("cu", "cluster").drop("cv")


def elevation(nodes: DataFrame) -> DataFrame:
    """nodes with elevation_m from the northing: 800 to 1000 over its range, 900 if it has none."""
    e = nodes.agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return nodes.crossJoin(F.broadcast(e)).withColumn("elevation_m", F.when(span > 0, 800 + 200 * (F.col("y") - F.col("_lo")) / span).otherwise(900.0)).drop("_lo", "_hi")
