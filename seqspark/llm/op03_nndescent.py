"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors become one node that keeps its smallest ids, so a vector that a third of all rows share
is a single node.  The neighbour graph starts from random hyperplanes: nodes are sorted by the sides they
lie on and then along a random direction, and compared inside runs of ``run`` nodes of that order.  Then
each round joins neighbours of neighbours: every node sends its vector to its neighbours (in both
directions); the ``meet`` of them that a node calls, new edges first, are compared pairwise, and a pair
that beats the worst neighbour of one of its ends is offered to it.  Every node keeps its best
``degree``.  Degrees and meetings are bounded, so a round is linear in the number of nodes, and all
exchanges are keyed by node.  While the graph is built, vectors travel as one byte per component and a
scale of their own.

A query walks the graph greedily: it holds the ``beam`` best nodes seen, opens the best ones that are
not yet open, and stops when none is left or after ``hops`` rounds.  Scores are exact Euclidean
distances in double precision on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import save, shuffle_partitions

DEGREE = 24
ROUNDS = 8
ORDERS = 8                      # random orders of the first graph
RUN = 96                        # nodes compared with each other in an order
MEET = 48                       # neighbours that meet at a node in one round
BEAM = 256
HOPS = 12


def usable(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) without null, empty, zero or non-finite vectors."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(v, x -> x <> 0)")


def matrix(column) -> np.ndarray:
    """2-d array of an array<float/double> column with rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def best_edges(edges: DataFrame, degree: int) -> DataFrame:
    """(u, v, d, fresh): the ``degree`` nearest distinct v of every u; an edge known before is not fresh."""
    # dealt by u first: one exchange serves the aggregate and the window
    dealt = edges.repartition(shuffle_partitions(edges.sparkSession), "u")
    known = dealt.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    rank = Window.partitionBy("u").orderBy("d", "v")
    return known.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= degree).drop("_r")


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each row as a float32 scale and one signed byte per component."""
    scale = np.maximum(np.abs(vectors).max(axis=1), 1e-300)
    q = np.rint(vectors / scale[:, None] * 127).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip((scale / 127).astype(np.float32), q)]


def unpacked(column, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dim + 4)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def offers(ids: np.ndarray, vectors: np.ndarray, keep: int, radius: np.ndarray, fresh: np.ndarray | None = None):
    """(u, v, squared distance): of each row the ``keep`` nearest others within its radius; one end must be fresh."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    sq = (vectors * vectors).sum(1)
    d = np.maximum(sq[:, None] + sq[None, :] - 2 * (vectors @ vectors.T), 0)
    np.fill_diagonal(d, np.inf)
    if fresh is not None:
        d[~(fresh[:, None] | fresh[None, :])] = np.inf
    k = min(keep, n - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    u, dist = np.repeat(np.arange(n), k), np.take_along_axis(d, near, 1).ravel()
    ok = np.isfinite(dist) & (dist < radius[u])
    return ids[u[ok]], ids[near.ravel()[ok]], dist[ok]


def _edge_batch(parts) -> pa.RecordBatch:
    u, v, d = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(d.astype(np.float32)),
                                       pa.array(np.ones(len(u), np.int32))], ["u", "v", "d", "fresh"])


_EDGE = "u long, v long, d float, fresh int"


def first_graph(nodes: DataFrame, dim: int, n_nodes: int, orders: int, run: int, degree: int, seed: int) -> DataFrame:
    """Edges between nodes that are close together in one of ``orders`` random orders."""
    bits = max(0, min(40, int(n_nodes / (2 * run)).bit_length()))
    rng = np.random.default_rng(seed)
    planes = [rng.standard_normal((dim, bits + 1)).astype(np.float32) for _ in range(orders)]

    def place(batches):
        for b in batches:
            vec = unpacked(b.column(1), dim)
            for order, w in enumerate(planes):
                p = vec @ w
                side = ((p[:, 1:] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(p), order, np.int32)), pa.array(side),
                                                  pa.array(p[:, 0])], ["node", "v", "order", "side", "p"])

    def compare(batches):
        for b in batches:
            order = b.column(2).to_numpy()
            starts = np.flatnonzero(np.diff(order, prepend=-1))
            for first, end in zip(starts, np.append(starts[1:], len(order))):
                part = b.slice(first, end - first)
                ids, vec = part.column(0).to_numpy(), unpacked(part.column(1), dim)
                free = np.full(len(ids), np.inf)
                cuts = [slice(max(at, 0), at + run) for shift in (0, run // 2) for at in range(-shift, len(ids), run)]
                yield _edge_batch([offers(ids[c], vec[c], degree // 2, free[c]) for c in cuts])

    # all orders in one exchange: their tasks do not multiply with the number of orders
    placed = nodes.select("node", "v").mapInArrow(place, "node long, v binary, order int, side long, p float")
    return (placed.repartitionByRange(shuffle_partitions(nodes.sparkSession), "order", "side", "p")
            .sortWithinPartitions("order", "side", "p", "node").select("node", "v", "order").mapInArrow(compare, _EDGE))


def descend(nodes: DataFrame, graph: DataFrame, dim: int, degree: int, meet: int) -> DataFrame:
    """One round: the neighbours of every node (both directions) meet there and are compared."""
    both = graph.select(F.col("u").alias("at"), F.col("v").alias("node"), "d", "fresh").unionByName(
        graph.select(F.col("v").alias("at"), F.col("u").alias("node"), "d", "fresh"))
    parts = shuffle_partitions(nodes.sparkSession)
    once = both.repartition(parts, "at").groupBy("at", "node").agg(F.min("d").alias("d"), F.max("fresh").alias("fresh"))
    order = Window.partitionBy("at").orderBy(F.desc("fresh"), "d", "node")
    called = (once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= meet)
              .withColumn("_any", F.max("fresh").over(Window.partitionBy("at")))
              .where("_any = 1").select("at", "node", "fresh"))        # nothing new meets at the other nodes
    radius = graph.groupBy(F.col("u").alias("node")).agg(
        F.when(F.count(F.lit(1)) >= degree, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("radius"))
    sent = called.join(nodes.select("node", "v").join(radius, "node"), "node").repartition(
        parts, "at").sortWithinPartitions("at")

    def run(batches):
        held = None
        for b in _with_end(batches):
            t = pa.Table.from_batches([b]) if b is not None else None
            if held is not None:
                t = pa.concat_tables([held, t]) if t is not None else held
            if t is None or not t.num_rows:
                held = None
                continue
            at = t.column("at").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            stop = len(starts) if b is None else len(starts) - 1       # the last group may go on
            if stop:
                ids, vec, reach = t.column("node").to_numpy(), unpacked(t.column("v"), dim), t.column("radius").to_numpy()
                fresh = t.column("fresh").to_numpy() > 0
                ends = np.append(starts, len(at))
                cuts = [slice(ends[g], ends[g + 1]) for g in range(stop)]
                yield _edge_batch([offers(ids[c], vec[c], degree // 2, reach[c], fresh[c]) for c in cuts])
            held = t.slice(starts[stop]) if stop < len(starts) else None

    return sent.select("at", "node", "fresh", "radius", "v").mapInArrow(run, _EDGE)


def _with_end(batches):
    yield from batches
    yield None


def pack_vectors(vectors: DataFrame) -> DataFrame:
    """(node, v binary) of ``vectors(node, v)``, all divided by one power of two that brings the largest component below 1.

    So float32 squares neither overflow nor vanish, whatever the magnitude of the vectors; the order of distances stays.
    """
    largest = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 1.0
    exponent = int(np.frexp(largest)[1])

    def pack(batches):
        for b in batches:
            scaled = np.ldexp(matrix(b.column(1)), -exponent)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed(scaled), pa.binary())], ["node", "v"])

    return vectors.select("node", "v").mapInArrow(pack, "node long, v binary")


def neighbour_graph(nodes: DataFrame, dim: int, degree: int = DEGREE, rounds: int = ROUNDS, orders: int = ORDERS,
                    run: int = RUN, meet: int = MEET, seed: int = 17) -> DataFrame:
    """(u, v, d, fresh) of packed ``nodes(node, v)``: about the ``degree`` nearest nodes of every node (d squared)."""
    n = nodes.count()
    graph = save(best_edges(first_graph(nodes, dim, n, orders, run, degree, seed), degree), "graph")
    for _ in range(rounds):
        more = descend(nodes, graph, dim, degree, meet)
        graph = save(best_edges(graph.withColumn("fresh", F.lit(0)).unionByName(more), degree), "graph")
        if graph.where("fresh = 1").count() < 0.02 * degree * n:
            break
    return graph


def search(starts: DataFrame, nodes: DataFrame, graph: DataFrame, dim: int, beam: int = BEAM, hops: int = HOPS,
           open_at_once: int = 32) -> DataFrame:
    """(query, node): the ``beam`` nearest nodes found for the nodes ``starts(query)`` by greedy search from themselves.

    A hop takes three exchanges of what is reached: by the opened node to its links, by the linked node to its
    vector (those held already are dropped there), and by the query to its beam.
    """
    parts = shuffle_partitions(nodes.sparkSession)
    links = save(graph.select(F.col("u").alias("from"), F.col("v").alias("node")).unionByName(
        graph.select(F.col("v").alias("from"), F.col("u").alias("node"))).distinct(), "links")
    asked = save(starts.join(nodes.select(F.col("node").alias("query"), F.col("v").alias("q")), "query"), "asked")
    none = F.lit(None).cast("binary")

    def step(held: pa.Table, scored: pa.Table) -> pa.Table:
        q = held.column("q").drop_null()
        held = held.filter(held.column("node").is_valid())
        node, d = held.column("node").to_numpy(), held.column("d").to_numpy()
        opened = np.maximum(held.column("opened").to_numpy(), held.column("now").to_numpy())
        if scored.num_rows:
            apart = unpacked(scored.column("v"), dim) - unpacked(q, dim)
            node = np.concatenate([node, scored.column("node").to_numpy()])
            d = np.concatenate([d, (apart * apart).sum(1)])
            opened = np.concatenate([opened, np.zeros(scored.num_rows, opened.dtype)])
        best = np.lexsort((node, d))[:beam]
        opened = opened[best]
        now = np.zeros(len(best), np.int32)
        now[np.flatnonzero(opened == 0)[:open_at_once]] = 1
        query = held.column("query")[0].as_py()                     # a query holds itself at least
        return pa.table({"query": pa.array(np.full(len(best), query)), "node": pa.array(node[best]),
                         "d": pa.array(d[best].astype(np.float32)), "opened": pa.array(opened.astype(np.int32)), "now": pa.array(now)})

    held = save(starts.select("query", F.col("query").alias("node"), F.lit(0.0).cast("float").alias("d"),
                              F.lit(0).alias("opened"), F.lit(1).alias("now")), "beam")
    for _ in range(hops):
        reached = held.where("now = 1").select("query", F.col("node").alias("from")).join(links, "from").select(
            "query", "node", F.lit(0).alias("_h"))
        new = (reached.unionByName(held.select("query", "node", F.lit(1).alias("_h"))).repartition(parts, "node")
               .groupBy("node", "query").agg(F.max("_h").alias("_h")).where("_h = 0"))
        scored = new.join(nodes, "node").select(F.col("query").alias("to"), "node", "v")
        beams = held.select("query", "node", "d", "opened", "now", none.alias("q")).unionByName(asked.select(
            "query", F.lit(None).cast("long").alias("node"), F.lit(None).cast("float").alias("d"),
            F.lit(None).cast("int").alias("opened"), F.lit(None).cast("int").alias("now"), "q"))
        held = save(beams.groupBy("query").cogroup(scored.groupBy("to")).applyInArrow(
            lambda left, right: step(left, right), "query long, node long, d float, opened int, now int"), "beam")
        if held.where("now = 1").limit(1).count() == 0:
            break
    return held.select("query", "node")


def nearest(embeddings: DataFrame, query_mod: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            **graph_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose id is divisible by ``query_mod``.

    Vectors that are null, empty, zero or not finite take no part, nor do those of another length than
    the most frequent one.  Ties go to the smaller id; a repeated row is a candidate of its own, but
    no row with the query's own id is.  Other columns are ignored;
    with fewer than k candidates all are given; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["n"]
    key = F.xxhash64("v")
    rows = save(rows.where(F.size("v") == dim).select("vec_id", "v", key.alias("node")), "vectors")
    smallest = F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1)
    # Of each node the k + 1 smallest ids are enough; they are picked per bucket first, so no task gathers a hot vector.
    bucket = F.pmod(F.xxhash64("vec_id"), F.lit(shuffle_partitions(spark)))
    part = Window.partitionBy("node", "_b").orderBy("vec_id")
    few = (rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k + 1)
           .groupBy("node").agg(smallest.alias("ids")))
    vectors = rows.groupBy("node").agg(F.first("v").alias("v"))
    nodes = save(vectors.join(few, "node").select("node", "v", "ids"), "nodes")
    light = save(pack_vectors(nodes), "packed")
    graph = neighbour_graph(light, dim, **graph_options)
    asked = save(rows.where(F.col("vec_id") % query_mod == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
                 .distinct(), "queries")
    starts = asked.select("query").distinct()
    found = search(starts, light, graph, dim)
    dist = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    exact = (found.join(nodes.select("node", "v", "ids"), "node")
             .join(starts.join(nodes.select(F.col("node").alias("query"), F.col("v").alias("q")), "query"), "query")
             .select("query", F.explode("ids").alias("vec_id"), dist.alias("score")))
    answer = asked.join(exact, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answer.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op3_nn_descent(spark, sf_dir):
    from seqspark.llm.common import table
    return nearest(table(spark, sf_dir, "embeddings"))
