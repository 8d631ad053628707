"""Approximate nearest vectors: a neighbour graph by NN-descent, searched greedily.

The records of the news feeds and quotes hold no vectors, so this operator is general: any table of ids and
vectors, such as embeddings of articles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.session import materialise



@dataclass(frozen=True)
class Graph:
    degree: int = 32        # neighbours kept for each vector, and as many that point to it
    tables: int = 4         # random partitions that give the first neighbours
    leaf: int = 256         # vectors compared with each other in such a partition
    rounds: int = 6         # rounds of neighbours of neighbours
    offers: int = 12        # pairs a round may offer a vector from each neighbourhood
    beam: int = 320         # best vectors a search keeps
    width: int = 80         # of which so many are expanded in a step
    steps: int = 4
    seed: int = 5


def small(vectors: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Vectors as one byte a component, and the factor of each: for comparing, not for scores."""
    factor = np.maximum(np.abs(vectors).max(axis=1), 1e-30) / 127
    return [x.tobytes() for x in np.rint(vectors / factor[:, None]).astype(np.int8)], factor.astype(np.float32)


def large(parts: list[bytes], factors) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int8).reshape(len(parts), -1).astype(np.float32) * np.asarray(factors, np.float32)[:, None]


def usable(vector: Column) -> Column:
    """No null, no component that is null, infinite or NaN, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def distinct_vectors(items: DataFrame, copies: int) -> DataFrame:
    """One row per distinct vector: (node, vector, norm2, members); members are its ``copies`` smallest ids."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    return (items.withColumn("_r", first).filter(F.col("_r") <= copies)
            .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
            .select(F.element_at("members", 1).alias("node"), "vector",
                    F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"), "members"))


def _prepared(longest2: float, planes: np.ndarray):
    """Adds a component that gives all vectors the same length, so that near means a large inner product; and keys."""
    tables, bits = planes.shape[:2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            x = np.concatenate([x, np.sqrt(np.maximum(longest2 - batch["norm2"].to_numpy(), 0))[:, None]], axis=1)
            keys = ((x @ planes.reshape(tables * bits, -1).T > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits))
                    if bits else np.zeros((len(x), tables), np.int64))
            code, factor = small(x)
            yield pd.DataFrame({"node": batch["node"], "code": code, "factor": factor, "keys": list(keys.astype(np.int64))})

    return run


def _near_in_leaf(degree: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node, x = frame["node"].to_numpy(), large(frame["code"].tolist(), frame["factor"])
        near = x @ x.T
        np.fill_diagonal(near, -np.inf)
        k = min(degree, len(node) - 1)
        at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(node), 0), int)
        return pd.DataFrame({"a": np.repeat(node, k), "b": node[at].ravel(), "near": np.take_along_axis(near, at, 1).ravel()})

    return run


def nearest_of(pairs: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best neighbours ``b`` of each ``a``. One shuffle by ``a`` serves both steps."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("near"), "b"))
    return (pairs.repartition("a").groupBy("a", "b").agg(F.max("near").alias("near")).withColumn("_r", rank)
            .filter(F.col("_r") <= degree).drop("_r"))


def neighbourhoods(graph: DataFrame, codes: DataFrame, degree: int) -> DataFrame:
    """For every vector those it points to and up to ``degree`` that point to it, with their codes, in arrays."""
    chosen = F.row_number().over(Window.partitionBy("b").orderBy(F.xxhash64("a", "b")))
    back = graph.withColumn("_r", chosen).filter(F.col("_r") <= degree)
    both = graph.select("a", "b").unionByName(back.select(F.col("b").alias("a"), F.col("a").alias("b")))
    worst = graph.groupBy("a").agg(F.min("near").alias("worst"), F.count("*").alias("n"))
    known = codes.select("node", "code", "factor").join(worst, codes["node"] == worst["a"], "left").select(
        F.col("node").alias("b"), "code", "factor",
        F.when(F.col("n") >= degree, F.col("worst")).otherwise(F.lit(float("-inf")).cast("float")).alias("worst"))
    return both.join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "code", "factor", "worst")).alias("h")).select(
        "a", F.col("h.b").alias("b"), F.col("h.code").alias("code"), F.col("h.factor").alias("factor"), F.col("h.worst").alias("worst"))


def _offers(most: int):
    """Pairs of neighbours of one vector that are nearer than what one of them has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for b, code, factor, worst in zip(batch["b"], batch["code"], batch["factor"], batch["worst"], strict=True):
                if len(b) < 2:
                    continue
                b, first = np.unique(np.asarray(b), return_index=True)  # some point to it and are pointed to
                x, worst = large([code[i] for i in first], np.asarray(factor)[first]), np.asarray(worst)[first]
                near = x @ x.T
                np.fill_diagonal(near, -np.inf)
                k = min(most, len(b) - 1)
                if k < 1:
                    continue
                at = np.argpartition(-near, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(near, at, 1)
                i, j = np.nonzero(best > np.asarray(worst, np.float32)[:, None])
                out.append((b[i], b[at[i, j]], best[i, j]))
            if out:
                a, b, near = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b, "near": near})

    return run


def neighbour_graph(codes: DataFrame, graph: Graph) -> DataFrame:
    """Approximately the ``degree`` nearest others of every vector: (a, b, near).

    The first neighbours are the best inside random partitions; then vectors that share a neighbour are
    compared, round by round, and every vector keeps its best.
    """
    keyed = codes.select("node", "code", "factor", F.posexplode("keys").alias("part", "key"))
    sizes = keyed.groupBy("part", "key").count().select("part", "key", F.ceil(F.col("count") / (2 * graph.leaf)).alias("_cuts"))
    leaves = keyed.join(sizes, ["part", "key"]).withColumn("cut", F.pmod(F.xxhash64("node", "part"), F.col("_cuts")))
    pairs = leaves.groupBy("part", "key", "cut").applyInPandas(_near_in_leaf(graph.degree), "a bigint, b bigint, near float")
    found = materialise(nearest_of(pairs, graph.degree), "graph")
    for _ in range(graph.rounds):
        more = neighbourhoods(found, codes, graph.degree).mapInPandas(_offers(graph.offers), "a bigint, b bigint, near float")
        found = materialise(nearest_of(found.unionByName(more), graph.degree), "graph")
    return found


# ---------------------------------------------------------------- search

_BEAM = "query bigint, code binary, factor float, nodes array<bigint>, near array<float>, open array<boolean>"


def _merged(beam: int):
    """Beams with what their expanded vectors offered: the best ``beam``, each once."""

    def run(frame: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=["query", "code", "factor", "nodes", "near", "open"])
        row = frame.iloc[0]
        nodes = np.concatenate([np.asarray(row["nodes"], np.int64), *[np.asarray(x, np.int64) for x in offers["nodes"]]])
        near = np.concatenate([np.asarray(row["near"], np.float32), *[np.asarray(x, np.float32) for x in offers["near"]]])
        fresh = np.concatenate([np.asarray(row["open"], bool), np.ones(len(nodes) - len(row["nodes"]), bool)])
        _, first = np.unique(nodes, return_index=True)  # the beam comes first and knows what is expanded
        order = first[np.lexsort((nodes[first], -near[first]))][:beam]
        return pd.DataFrame([{**row.to_dict(), "nodes": nodes[order], "near": near[order], "open": fresh[order]}])

    return run


def _expanded(beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, code, factor, b, codes, factors in zip(batch["query"], batch["qcode"], batch["qfactor"], batch["b"], batch["code"],
                                                          batch["factor"], strict=True):
                near = large(list(codes), factors) @ large([code], [factor])[0]
                first = np.unique(np.asarray(b), return_index=True)[1]
                best = first[np.argsort(-near[first])[:beam]]
                out.append((q, np.asarray(b)[best], near[best]))
            yield pd.DataFrame(out, columns=["query", "nodes", "near"])

    return run


def _widened(width: int):
    """The best vectors of a beam that were not expanded yet, one row each; and the beam with them closed."""

    def chosen(near, fresh) -> np.ndarray:
        at = np.flatnonzero(np.asarray(fresh, bool))
        return at[:width]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(q, c, f, n) for q, c, f, nodes, near, fresh in zip(*[batch[k] for k in ("query", "code", "factor", "nodes", "near", "open")],
                                                                    strict=True) for n in np.asarray(nodes)[chosen(near, fresh)]]
            yield pd.DataFrame(out, columns=["query", "qcode", "qfactor", "a"])

    def closed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flags = []
            for near, fresh in zip(batch["near"], batch["open"], strict=True):
                fresh = np.array(fresh, bool)
                fresh[chosen(near, fresh)] = False
                flags.append(fresh)
            yield batch.assign(open=flags)

    return rows, closed


def search(hoods: DataFrame, queries: DataFrame, graph: Graph) -> DataFrame:
    """(query, node): the vectors that a greedy walk from each query's own node meets and keeps."""
    start = queries.select("query", "code", "factor", F.array("node").alias("nodes"),
                           F.array(F.lit(float("inf")).cast("float")).alias("near"), F.array(F.lit(True)).alias("open"))
    beams = start
    for _ in range(graph.steps):
        rows, closed = _widened(graph.width)
        asked = beams.mapInPandas(rows, "query bigint, qcode binary, qfactor float, a bigint")
        offers = (asked.join(hoods, "a").select("query", "qcode", "qfactor", "b", "code", "factor")
                  .mapInPandas(_expanded(graph.beam), "query bigint, nodes array<bigint>, near array<float>"))
        beams = materialise(beams.mapInPandas(closed, _BEAM).groupBy("query").cogroup(offers.groupBy("query"))
                            .applyInPandas(_merged(graph.beam), _BEAM), "beams")
    return beams.select("query", F.explode("nodes").alias("node"))


def nearest_vectors(items: DataFrame, queries: Column, k: int = 20, key: str = "id", vector: str = "vector",
                    graph: Graph = Graph()) -> DataFrame:
    """The ``k`` nearest other rows of each query: (query, rank, id, score), nearest first, ties to smaller ids.

    ``queries`` is a condition on the input; its rows are searched for among all rows. ``score`` is the inner
    product of the original vectors in double precision. The graph and the walk compare one-byte codes and
    only propose; scores and ranks are made from the vectors. Equal vectors are one node of the graph, and
    all their rows are candidates, so copies neither fill nor break the graph.

    Rows whose vector is null, zero or holds null or non-finite components take no part, nor do those without
    an id or with another number of components than most. A query whose walk meets fewer than ``k`` candidates is compared with
    all; with fewer than ``k`` in the table, all are returned. An id that comes twice with different vectors is a candidate twice.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = items.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") + 0.0).alias("vector"),
                        F.coalesce(queries, F.lit(False)).alias("asked")).filter(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = materialise(rows, "vectors")
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if size is None:
        return rows.sparkSession.createDataFrame([], "query bigint, rank int, id bigint, score double")
    rows = rows.filter(F.size("vector") == size["n"])
    nodes = materialise(distinct_vectors(rows.select("id", "vector").distinct(), k + 1), "nodes")
    count, longest2 = nodes.agg(F.count("*"), F.max("norm2")).first()
    bits = max(0, int(np.ceil(np.log2(max(1, count / graph.leaf)))))
    planes = np.random.default_rng(graph.seed).standard_normal((graph.tables, bits, size["n"] + 1))
    codes = materialise(nodes.select("node", "vector", "norm2").mapInPandas(
        _prepared(float(longest2), planes), "node bigint, code binary, factor float, keys array<bigint>"), "codes")
    hoods = materialise(neighbourhoods(neighbour_graph(codes, graph), codes, graph.degree).drop("worst"), "neighbourhoods")
    own = nodes.select("node", "vector")
    asked = materialise(rows.filter("asked").select(F.col("id").alias("query"), "vector").distinct()
                        .join(own, "vector").select("query", "node", "vector"), "queries")
    # the query's code has nothing in the added component: near is the plain inner product
    plain = asked.select("query", "node", "vector").mapInPandas(_query_codes, "query bigint, node bigint, code binary, factor float")
    def ranked(met: DataFrame) -> DataFrame:
        scored = (met.join(asked.select("query", F.col("vector").alias("_q")), "query").join(nodes.select("node", "vector", "members"), "node")
                  .select("query", F.explode("members").alias("id"),
                          F.aggregate(F.zip_with("_q", "vector", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
                  .filter("id <> query"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("int")
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "id", "score")

    found = materialise(ranked(search(hoods, plain, graph).distinct()), "ranked")
    enough = min(k, rows.select("id", "vector").distinct().count() - 1)
    has = found.groupBy("query").agg(F.count("*").alias("n"))
    short = materialise(asked.join(has, "query", "left").filter(F.coalesce("n", F.lit(0)) < enough).select("query", "vector"), "short")
    if short.isEmpty():
        return found
    return found.join(short, "query", "left_anti").unionByName(ranked(_compared_with_all(short, nodes, k)))


def _compared_with_all(queries: DataFrame, nodes: DataFrame, k: int, block: int = 500) -> DataFrame:
    """(query, node): for queries whose walk met too few, the best of all nodes, in blocks of about ``block`` queries."""
    blocks = max(1, -(-queries.count() // block))
    out = None
    for at in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == at).collect()  # a block
        names, x = np.array([r["query"] for r in mine], np.int64), np.array([r["vector"] for r in mine], np.float64)

        def best(batches: Iterator[pd.DataFrame], names=names, x=x) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if batch.empty or not len(names):
                    continue
                near = x @ np.stack(batch["vector"].to_numpy()).astype(np.float64).T
                top = np.argsort(-near, axis=1, kind="stable")[:, : k + 8]  # more than k, as sums may differ in their last digits
                yield pd.DataFrame({"query": np.repeat(names, top.shape[1]), "node": batch["node"].to_numpy()[top.ravel()],
                                    "near": np.take_along_axis(near, top, 1).ravel()})

        pairs = nodes.select("node", "vector").mapInPandas(best, "query bigint, node bigint, near double")
        order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "node"))
        pairs = pairs.withColumn("_r", order).filter(F.col("_r") <= k + 8).select("query", "node")
        out = pairs if out is None else out.unionByName(pairs)
    return materialise(out, "compared")


def _query_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not batch.empty:
            x = np.stack(batch["vector"].to_numpy()).astype(np.float64)
            code, factor = small(np.concatenate([x, np.zeros((len(x), 1))], axis=1))
            yield pd.DataFrame({"query": batch["query"], "node": batch["node"], "code": code, "factor": factor})
