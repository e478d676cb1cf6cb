"""Approximate nearest neighbours by inner product: NN-descent, greedy search.

Equal vectors are one node. Nodes are dealt to shards of at most ``SHARD`` by a hash
of the vector. A shard's graph is made in one task (:mod:`.graphs`). For it each
vector gets one more component, so that all have the norm of the longest; near in
inner product then means near in angle. First lists come from exact comparisons within
runs of nodes that stand together by random hyperplanes and projections; NN-descent
improves them: the nodes that a node has in its list, or that have it in theirs, meet
and are compared, so neighbours of neighbours find one another.

Every query is searched for in every shard, in the same task: it starts from a few
nodes, the longest vectors of the shard and, in its own shard, from its own node, and expands
its best unexpanded nodes until its best ``beam`` nodes are all expanded; queries
that stand together go in groups that share what they see. Only the nearest of each
shard are sent on. Scores are inner products of the original components in double
precision.

A fixed number of queries is also answered by brute force: while too few
of their true neighbours are found, the beam is doubled, and beyond a limit the
lists are made twice as long; if that does not help, it fails.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as queries nor as candidates; null ids neither;
vectors are compared with those of as many components, for each number apart; equal
scores go to the smaller id; products that no double can hold are not defined; repeated rows with one id and vector are one; fewer
candidates than asked for are all returned; an empty table gives no rows; only
the id and vector columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graphs
from .common import join_skewed, materialise, pieces_of, release

#: Nodes of a shard at most: its vectors and lists are held in a Python worker.
SHARD = 1 << 16
#: Tables of fewer nodes are dealt to about ``SHARDS`` shards, but of ``LEAST`` nodes or more.
LEAST, SHARDS = 2048, 8
#: Queries that one task searches for, and buckets of them in which the shards' answers meet.
ASKED, BUCKETS = 1 << 18, 64
#: Nodes that a search starts from: any (or a 32nd of a shard's), and the longest.
ANY, LONGEST = 256, 64
#: Length of lists and beam to begin with.
KEEP, BEAM = 16, 32
#: Queries that are also answered by brute force.
SAMPLE = 256
STATE = "blk int, node long, vec binary, near array<int>, fresh array<boolean>"
BEST = "exact boolean, bucket int, query binary, many binary, node binary, score binary"
FOUND = "exact boolean, query long, node long, score double"


def lists(rows: np.ndarray, good: np.ndarray, kind) -> pa.ListArray:
    """The ``good`` entries of each row."""
    offsets = np.append(0, np.cumsum(good.sum(axis=1))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[good], kind))


def vectors_of(column, kind=np.float32) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), kind).reshape(len(got), -1)


def batch_of(schema: str, cols: list) -> pa.Table:
    return pa.table(cols, names=[x.split()[0] for x in schema.split(", ")])


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, type]:
    """(id, d, top, norm2, x) of the rows that take part, and the kind of the numbers in
    ``x``: floats stay floats, others are doubles. ``top``: the largest component;
    ``norm2``: the squared length of the vector divided by it."""
    kind = "float" if rows.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec")).where("id is not null and vec is not null")
    number = np.float32 if kind == "float" else np.float64

    def pack(batches):
        for batch in batches:
            vec = batch.column("vec")
            v = vec.flatten().to_numpy(zero_copy_only=False).astype(number, copy=False) + number(0)  # null: nan; -0.0: 0.0
            size = vec.value_lengths().to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            upto = lambda x: np.append(0, np.cumsum(x))
            bad, some = upto(~np.isfinite(v)), upto(v != 0)
            good = np.flatnonzero((bad[end] == bad[end - size]) & (some[end] > some[end - size]))
            each = [v[end[i] - size[i] : end[i]] for i in good]
            top = np.array([np.abs(x).max() for x in each], np.float64)
            norm2 = np.array([np.square(x / t, dtype=np.float64).sum() for x, t in zip(each, top)], np.float64)
            yield pa.record_batch([batch.column("id").take(pa.array(good)), pa.array(size[good].astype(np.int32)), pa.array(top), pa.array(norm2), pa.array([x.tobytes() for x in each], pa.binary())], names=["id", "d", "top", "norm2", "x"])

    return materialise(rows.mapInArrow(pack, "id long, d int, top double, norm2 double, x binary").withColumn("node", F.xxhash64("x")), "vectors"), number


def shards_of(n: int) -> int:
    return max(pieces_of(n, SHARD), min(SHARDS, pieces_of(n, LEAST)))


def dealt(rows: DataFrame, shards: int):
    """Grouped by shard, one to a partition."""
    return rows.repartitionById(shards, "blk").groupBy("blk")


def build(nodes: DataFrame, dims: int, keep: int | None = None, trees: int = 2, run: int = 256, named: int | None = None, told: int | None = None, settled: float = 0.1) -> tuple[DataFrame, int]:
    """The graph of ``nodes`` (node, vec: floats of one norm): blk, node, vec, near (places
    among the shard's nodes by id), fresh (entries of the last round); number of shards.

    Rounds go on until at most ``settled`` of the list entries change; each
    change betters a list, so they end.
    """
    n = nodes.count()
    shards = shards_of(n)
    keep = keep or KEEP

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        v = vectors_of(table.column("vec"))
        made = graphs.build(graphs.unit(v.reshape(-1, dims)), keep, trees, run, named, told, settled)
        good = made.near >= 0
        return batch_of(STATE, [table.column("blk"), table.column("node"), table.column("vec"), lists(made.near, good, pa.int32()), lists(made.fresh, good, pa.bool_())])

    return materialise(dealt(nodes.select(shard(shards), "node", "vec"), shards).applyInArrow(graph, STATE), "graph"), shards


def shard(shards: int):
    return F.pmod("node", F.lit(shards)).cast("int").alias("blk")


def best_of(query: np.ndarray, node: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query and what equals the last of them, best first."""
    order = np.lexsort((node, -score, query))
    query, node, score = query[order], node[order], score[order]
    start = np.searchsorted(query, query)
    last = np.minimum(start + k, np.searchsorted(query, query, "right")) - 1
    good = score >= score[last]
    return query[good], node[good], score[good]


def packed(exact: bool, query: np.ndarray, node: np.ndarray, score: np.ndarray) -> list[tuple]:
    """Rows of ``BEST`` of (query, node, score), sorted by query."""
    bucket = query % BUCKETS
    order = np.argsort(bucket, kind="stable")
    query, node, score, bucket = query[order], node[order], score[order], bucket[order]
    out = []
    for b in np.unique(bucket).tolist():
        x, y = np.searchsorted(bucket, (b, b + 1))
        each, many = np.unique(query[x:y], return_counts=True)
        out.append((exact, b, each.tobytes(), many.astype(np.int32).tobytes(), node[x:y].tobytes(), score[x:y].tobytes()))
    return out


def search(nodes: DataFrame, queries: DataFrame, shards: int, widen, keep: int, beam: int, k: int, sample: list[int], scale: float, kind) -> DataFrame:
    """(exact, query, node, score): the ``k`` + 1 nearest nodes that each query has seen,
    its own among them, and what equals the last; exact: those of the queries in
    ``sample``, their own left out, by brute force.

    ``nodes``: (node, x), x the numbers of a vector, of ``kind``; ``widen`` makes of
    them vectors of one norm. ``queries``: (query, x).
    """

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not table.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.bool_(), pa.int32(), *[pa.binary()] * 4)], names=[x.split()[0] for x in BEST.split(", ")])
        table, asked = table.select(["node", "x"]).sort_by("node"), asked.select(["query", "x"]).sort_by("query")
        node, x = table.column("node").to_numpy(), vectors_of(table.column("x"), kind)
        query, q = asked.column("query").to_numpy(), vectors_of(asked.column("x"), kind)
        made = graphs.build(graphs.unit(widen(x)), min(keep, max(1, len(node) - 1)))
        v, w = (x / scale).astype(np.float32), (q / scale).astype(np.float32)
        length = np.einsum("ij,ij->i", v, v)
        rng = np.random.default_rng(11)
        first = rng.choice(len(node), min(len(node), max(ANY, 4 * beam, len(node) // 32)), replace=False)
        first = np.union1d(first, np.argsort(-length, kind="stable")[:LONGEST])
        own = np.searchsorted(node, query)
        own = np.where(node[np.minimum(own, len(node) - 1)] == query, own, -1)
        rows: list[tuple] = []
        for a in range(0, len(query), 1 << 13):
            at, _ = graphs.search(v, made.near, w[a : a + (1 << 13)], first, own[a : a + (1 << 13)], beam, max(8, beam // 2), group_of(len(node)))
            r, c = np.nonzero(at >= 0)
            i, j = r + a, at[r, c]
            got = np.concatenate([(q[i[y : y + 8192]].astype(np.float64) * x[j[y : y + 8192]]).sum(axis=1) for y in range(0, len(i), 8192)])
            rows += packed(False, *best_of(query[i], node[j], got, k + 1))
        tried = np.flatnonzero(np.isin(query, sample))
        for a in range(0, len(tried), 32):  # each piece of the vectors is made double once for many queries
            some = tried[a : a + 32]
            got = np.concatenate([q[some].astype(np.float64) @ x[y : y + 8192].astype(np.float64).T for y in range(0, len(x), 8192)], axis=1)
            for i, s in zip(some.tolist(), got):
                other = np.flatnonzero(node != query[i])
                other = other[np.argpartition(-s[other], k - 1)[:k]] if len(other) > k else other
                rows += packed(True, np.full(len(other), query[i]), node[other], s[other])
        return batch_of(BEST, [pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 6, (pa.bool_(), pa.int32(), *[pa.binary()] * 4))])

    def join(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        exact = table.column("exact")[0].as_py()
        query, node, score = best_of(np.repeat(read("query", np.int64), read("many", np.int32)), read("node", np.int64), read("score", np.float64), k if exact else k + 1)
        return batch_of(FOUND, [pa.array(np.full(len(query), exact)), pa.array(query), pa.array(node), pa.array(score)])

    # beyond ``ASKED`` queries a shard is searched in several tasks
    parts = pieces_of(queries.count(), ASKED)
    part = F.pmod(F.xxhash64("query", F.lit(3)), F.lit(parts)).cast("int")
    every = lambda from_, to, step: F.explode(F.sequence(from_.cast("int"), to.cast("int"), F.lit(step)))
    first = F.pmod("node", F.lit(shards)) * parts
    held = nodes.select(every(first, first + (parts - 1), 1).alias("blk"), "node", "x")
    sent = queries.select(every(part, part + (shards - 1) * parts, parts).alias("blk"), "query", "x")
    best = dealt(held, shards * parts).cogroup(dealt(sent, shards * parts)).applyInArrow(answer, BEST)
    return materialise(best.groupBy("exact", "bucket").applyInArrow(join, FOUND), "found")


def group_of(n: int) -> int:
    """Queries that share what they see: all of them together a part of a shard of ``n`` nodes."""
    return min(512, max(8, n // 128))


def found_share(found: DataFrame, sample: list[int], k: int) -> float:
    """The share of the true nearest that the queries of ``sample`` have seen."""
    true: dict[int, list[float]] = {}
    seen: dict[int, list[float]] = {}
    for r in found.where(F.col("query").isin(sample) & (F.col("exact") | (F.col("node") != F.col("query")))).collect():
        (true if r["exact"] else seen).setdefault(r["query"], []).append(r["score"])
    total = hits = 0
    for query, scores in true.items():
        floor, many = min(scores), min(k, len(scores))
        total += many
        hits += min(many, sum(x >= floor - 1e-9 * max(1.0, abs(floor)) for x in seen.get(query, [])))
    return hits / total if total else 1.0


def nearest(rows: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", is_query=None, beam: int | None = None, target: float = 0.92, measured: list | None = None) -> DataFrame:
    """The ``k`` nearest of each query row: query_id, rank, id, score.

    ``is_query``: a condition on the id; by default those divisible by 20.
    ``beam``: the first to try. ``target``: the share of true neighbours to find
    among sampled queries, above 0.9 by three standard errors. ``measured``
    takes (length of lists, beam, share found) of each trial.
    """
    rows, kind = usable(rows, id_col, vec_col)
    if is_query is None:
        is_query = F.pmod("id", F.lit(20)) == 0
    sizes = sorted((r["d"], r["top"]) for r in rows.groupBy("d").agg(F.max("top").alias("top")).collect())
    found = [_nearest(rows.where(F.col("d") == d), kind, top, k, is_query, beam, target, measured) for d, top in sizes or [(0, 1.0)]]
    out = reduce(DataFrame.unionByName, found)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _nearest(rows: DataFrame, kind: type, scale: float, k: int, is_query, beam: int | None, target: float, measured: list | None) -> DataFrame:
    """:func:`nearest` among vectors of one length, ``scale`` their largest component."""
    # of equal vectors no more than k + 1 ids can be in any answer
    first = rows.select("node", "id").distinct().withColumn("copy", F.row_number().over(W.partitionBy("node").orderBy("id"))).where(F.col("copy") <= k + 1)
    ids = first.groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialise(rows.groupBy("node").agg(F.first("x").alias("x")).join(ids.hint("shuffle_merge"), "node"), "nodes")
    # the graph is of vectors divided by the largest component: no square overflows
    part = F.col("top") / F.lit(scale)
    most = rows.agg(F.max(F.col("norm2") * part * part)).first()[0]
    asked = rows.where(is_query).select("id", F.col("node").alias("query")).distinct()
    asked_nodes = asked.select("query").distinct()
    n = nodes.count()

    def widen(x: np.ndarray) -> np.ndarray:
        v = x / scale
        rest = np.sqrt(np.maximum(most - np.einsum("ij,ij->i", v, v, dtype=np.float64), 0))
        return np.hstack((v, rest[:, None])).astype(np.float32)

    queries = materialise(nodes.join(asked_nodes, nodes["node"] == asked_nodes["query"], "left_semi").select(F.col("node").alias("query"), "x"), "asked")
    sample = [r["query"] for r in queries.select("query").orderBy(F.xxhash64("query", F.lit(5)), "query").limit(SAMPLE).collect()]
    shards = shards_of(n)
    keep, first_beam = KEEP, max(beam or BEAM, k + 1)
    while True:
        beam = first_beam
        while True:
            seen = search(nodes.select("node", "x"), queries, shards, widen, keep, beam, k, sample, scale, kind)
            share = found_share(seen, sample, k)
            if measured is not None:
                measured.append((keep, beam, share))
            if share >= target or beam >= min(n, 32 * keep):
                break
            release(seen)
            beam *= 2
        if share >= target:
            break
        if keep >= n:
            raise RuntimeError(f"found {share:.3f} of the nearest, not {target}")
        release(seen)
        keep *= 2
    # k + 1 nodes hold k ids besides the query's own
    best = seen.where(~F.col("exact")).join(nodes.select("node", "ids"), "node")
    flat = best.select("query", "score", F.explode("ids").alias("id"))
    flat = flat.withColumn("p", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("p") <= k + 1)
    answer = flat.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("p", "id", "score"))).alias("found"))
    # many ids may ask with one vector
    answer = materialise(answer.join(asked.groupBy("query").agg(F.count(F.lit(1)).alias("asks")), "query"), "answers")
    total = answer.agg(F.sum("asks")).first()[0] or 0
    out = join_skewed(asked.withColumnRenamed("id", "query_id"), answer, ["query"], "asks", total)
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "f"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score"))
