"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node; a node keeps its KEPT smallest ids, which is all that an answer of KEPT - 1 neighbours can use, so a
vector with very many copies costs no more than any other. Nodes are numbered in the order of their smallest id, so that of
equal scores the smaller number is the smaller id in every order and cut.

Building. TREES times over, nodes are sorted by the signs of random projections and cut into runs of LEAF; within a run all
products are taken and each node starts with its best. A node that was alone in every run is compared with all others, in blocks.
Then each round of NN-descent brings every node's vector to its neighbours and to a sample of those that have it as neighbour
(Spark joins on the edges), so that at each node the neighbours of a neighbour meet; pairs of which one is new there are scored in one small
matrix, and each node keeps the GRAPH best it has seen.

Search. All queries advance together. A query's state is its beam, the BEAM best nodes found. Each round the unexpanded nodes of
the beam are joined with the graph, and what they lead to is scored where its vectors lie: a query's vector goes once to each part
of the nodes that it asks about. It ends when no beam has anything to expand, however many rounds that takes. The beam is scored
again in double precision from the original vectors; all before that uses single precision.

Defined cases
    null, zero vectors, null or non-finite components   take no part
    vectors of several lengths   each is compared with those of its own length only
    null vec_id       takes no part
    repeated vec_ids  the rows of one id count once for each distinct vector
    ties              smaller vec_id first
    fewer candidates  all of them
    empty table       no rows
    extra columns     not returned
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import workspace as ws

K = 20
KEPT = K + 1
GRAPH = 32
SAMPLE = 32
LEAF = 256
TREES = 6
ROUNDS = 4
#: Of the pairs that meet at a node, each member passes on so many of the best.
PASSED = 8
BEAM = 128
#: Nodes whose vectors one task of the search holds (at 64 components, 16 MB).
PART_NODES = 65_536
#: Nodes without edges that are compared with all others at a time.
ALONE = 1_000


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(sound)


def packed(rows: DataFrame) -> DataFrame:
    """vec_id, v (8 bytes a component)."""

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else [], pa.binary())], names=["vec_id", "v"])

    return rows.mapInArrow(run, "vec_id bigint, v binary")


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, v, ids: distinct vectors with their KEPT smallest ids, numbered in the order of the smallest."""
    ranked = rows.select("v", "vec_id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= KEPT)
    grouped = ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    ordered = grouped.withColumn("least", F.col("ids")[0]).repartitionByRange("least", "v").sortWithinPartitions("least", "v")
    return ordered.withColumn("node", F.monotonically_increasing_id()).select("node", "v", "ids")


def single(nodes: DataFrame) -> DataFrame:
    """node, v (4 bytes a component)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, np.float64).astype(np.float32).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["node", "v"])

    return nodes.select("node", "v").mapInArrow(run, "node bigint, v binary")


def by_length(column, dtype=np.float32) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    sizes = np.array([len(x) for x in column])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([column[i] for i in at]), dtype).reshape(len(at), -1)


def best_within(ids: np.ndarray, x: np.ndarray) -> pd.DataFrame | None:
    """node, nbr, score: the GRAPH best of each among the others."""
    k = min(GRAPH, len(x) - 1)
    if k < 1:
        return None
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"node": np.repeat(ids, k), "nbr": ids[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel().astype(np.float64)})


def leaf_edges(nodes: DataFrame, n: int) -> DataFrame:
    """node, nbr, score: the best of each node within its runs."""
    bits = min(40, max(1, int(np.ceil(np.log2(max(n, 2) / LEAF))) + 4))

    def place(frames):
        for pdf in frames:
            for at, x in by_length(pdf.v.tolist()) if len(pdf) else ():
                planes = np.random.default_rng([11, x.shape[1]]).standard_normal((TREES, x.shape[1], bits)).astype(np.float32)
                for t in range(TREES):
                    yield pd.DataFrame({"tree": np.int32(t), "size": np.int32(x.shape[1]), "code": (x @ planes[t] > 0) @ (1 << np.arange(bits)), "node": pdf.node.to_numpy()[at], "v": pdf.v.to_numpy()[at]})

    order = ("tree", "size", "code", "node")
    placed = nodes.mapInPandas(place, "tree int, size int, code bigint, node bigint, v binary")
    placed = placed.repartitionByRange(max(1, min(2_000, n * TREES // (8 * LEAF))), *order).sortWithinPartitions(*order)

    def run(frames):
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= 3 * LEAF:  # what stays is enough for a last run of more than one
                yield from within(held[:LEAF])
                held = held[LEAF:]
        if held is not None and len(held):
            for at in range(0, max(1, len(held) - LEAF), LEAF):
                end = at + LEAF if at + 2 * LEAF <= len(held) else len(held)
                yield from within(held[at:end])

    def within(pdf):
        ids = pdf.node.to_numpy()
        for at, x in by_length(pdf.v.tolist()):
            if (found := best_within(ids[at], x)) is not None:
                yield found

    return placed.select("node", "v").mapInPandas(run, "node bigint, nbr bigint, score double")


def lone_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, nbr, score: the best of nodes without any edge, from all nodes. Runs leave hardly any, so blocks of ALONE are few."""
    spark = nodes.sparkSession
    lone, path = ws.stage(nodes.join(edges.select("node").distinct(), "node", "left_anti").select("node", "v"), "nn-lone")
    edges = edges.select("node", "nbr", "score")
    after = -1
    while block := lone.where(F.col("node") > after).orderBy("node").limit(ALONE).collect():
        after = block[-1]["node"]
        asked = spark.sparkContext.broadcast([(r["node"], bytes(r["v"])) for r in block])

        def run(frames, asked=asked):
            ids, q = np.array([a for a, _ in asked.value]), [v for _, v in asked.value]
            for pdf in frames:
                for at, x in by_length(pdf.v.tolist()) if len(pdf) else ():
                    mine = [i for i, v in enumerate(q) if len(v) == 4 * x.shape[1]]
                    if mine:
                        s = np.stack([np.frombuffer(q[i], np.float32) for i in mine]) @ x.T
                        near = pdf.node.to_numpy()[at]
                        s[ids[mine][:, None] == near] = -np.inf
                        k = min(GRAPH, len(at))
                        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                        found = pd.DataFrame({"node": np.repeat(ids[mine], k), "nbr": near[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel().astype(np.float64)})
                        found = found[np.isfinite(found.score)]
                        yield found
                        yield found.rename(columns={"node": "nbr", "nbr": "node"})[["node", "nbr", "score"]]

        edges = edges.unionByName(nodes.select("node", "v").mapInPandas(run, "node bigint, nbr bigint, score double"))
    return edges


def best_edges(edges: DataFrame) -> DataFrame:
    """node, nbr, score, since, rank: the GRAPH best neighbours of each node; since: the round that found the edge."""
    once = edges.groupBy("node", "nbr").agg(F.max("score").alias("score"), F.min("since").alias("since"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "nbr"))).where(F.col("rank") <= GRAPH)


def descend(edges: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """node, nbr, score: candidate edges from one round, scored, of pairs that meet at a node and of which one is new there."""
    new = F.col("since") == turn
    forward = edges.select(F.col("node").alias("at"), F.col("nbr").alias("who"), new.alias("new"))
    back = edges.select(F.col("nbr").alias("at"), F.col("node").alias("who"), new.alias("new"))
    order = Window.partitionBy("at").orderBy(F.desc("new"), F.xxhash64("at", "who", F.lit(turn)), "who")
    back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).drop("r")
    floor = edges.where(F.col("rank") == GRAPH).select(F.col("node").alias("who"), F.col("score").alias("floor"))
    meets = forward.unionByName(back).groupBy("at", "who").agg(F.max("new").alias("new")).join(nodes.select(F.col("node").alias("who"), "v").join(floor, "who", "left"), "who")
    meets = meets.select("at", "who", "new", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    ordered = meets.repartition("at").sortWithinPartitions("at")

    def run(frames):
        tail = None
        for pdf in frames:
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            last = pdf["at"].iloc[-1] if len(pdf) else None
            tail = pdf[pdf["at"] == last]
            yield from met(pdf[pdf["at"] != last])
        if tail is not None and len(tail):
            yield from met(tail)

    def met(pdf):
        if not len(pdf):
            return
        at, who, fresh, floor, v = pdf["at"].to_numpy(), pdf.who.to_numpy(), pdf["new"].to_numpy(bool), pdf.floor.to_numpy(), pdf.v.tolist()
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out = []
        for a, b in zip(starts, [*starts[1:], len(at)]):
            if b - a < 2 or not fresh[a:b].any():
                continue
            x = np.frombuffer(b"".join(v[a:b]), np.float32).reshape(b - a, -1)  # neighbours are of one length
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            old = np.flatnonzero(~fresh[a:b])
            s[np.ix_(old, old)] = -np.inf
            k = min(PASSED, b - a - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            score = np.take_along_axis(s, top, 1)
            keep = score > floor[a:b, None]
            out.append((np.broadcast_to(who[a:b, None], top.shape)[keep], who[a:b][top][keep], score[keep]))
        if out:
            node, nbr, score = (np.concatenate(c) for c in zip(*out))
            found = pd.DataFrame({"node": node, "nbr": nbr, "score": score.astype(np.float64)})
            found = found[np.isfinite(found.score)]
            yield found.drop_duplicates(["node", "nbr"])

    return ordered.mapInPandas(run, "node bigint, nbr bigint, score double")


def build_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """node, nbr, score, since, rank of nodes (node, v in single precision). Ends early when a round finds no edge."""
    spark = nodes.sparkSession
    first, first_path = ws.stage(leaf_edges(nodes, nodes.count()), "nn-leaves")
    edges, held = ws.stage(best_edges(lone_edges(nodes, first).withColumn("since", F.lit(0))), "nn-edges")
    ws.drop(spark, first_path)
    for turn in range(rounds):
        found = descend(edges, nodes, turn).withColumn("since", F.lit(turn + 1))
        edges, path = ws.stage(best_edges(edges.drop("rank").unionByName(found)), "nn-edges")
        ws.drop(spark, held)
        held = path
        if not edges.where(F.col("since") == turn + 1).limit(1).count():
            break
    return edges


def links_of(graph: DataFrame) -> DataFrame:
    """node, nbrs: neighbours, and as many of those that have the node as neighbour, the closest first."""
    closest = Window.partitionBy("node").orderBy("rank", F.xxhash64("node", "nbr"), "nbr")
    back = graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "rank").withColumn("r", F.row_number().over(closest)).where(F.col("r") <= GRAPH)
    return graph.select("node", "nbr").unionByName(back.select("node", "nbr")).groupBy("node").agg(F.collect_set("nbr").alias("nbrs"))


def scored(asks: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """start, found (array of (minus score, node, open)) of asks (start, q, part, want). Nodes come to their part's task first and
    are held there, then the asks stream past."""
    left = nodes.select(F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("node").alias("id"), "v", F.lit(None).cast("array<bigint>").alias("want"))
    right = asks.select("part", F.lit(1).alias("kind"), F.col("start").alias("id"), F.col("q").alias("v"), "want")
    dealt = left.unionByName(right).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    kind = pa.list_(pa.struct([("s", pa.float32()), ("node", pa.int64()), ("open", pa.bool_())]))

    def run(batches):
        raw: list[tuple[np.ndarray, list[bytes]]] = []
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            cut = int((kinds == 0).sum())
            ids, v = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            if cut:
                raw.append((ids[:cut], v[:cut]))
            if cut == len(kinds):
                continue
            if raw:
                every, all_v = np.concatenate([a for a, _ in raw]), [x for _, b in raw for x in b]
                for at, x in by_length(all_v):
                    order = np.argsort(every[at])
                    held[4 * x.shape[1]] = every[at][order], x[order]
                raw = []
            starts, found = [], []
            for start, q, want in zip(ids[cut:], v[cut:], batch.column(3).slice(cut)):
                mine, x = held.get(len(q), (np.empty(0, np.int64), None))
                want = np.sort(want.values.to_numpy())
                at = np.searchsorted(mine, want)
                at, want = at[at < len(mine)], want[at < len(mine)]
                ok = mine[at] == want
                if ok.any():
                    starts.append(start)
                    found.append((want[ok], -(x[at[ok]] @ np.frombuffer(q, np.float32))))
            if starts:
                ends = np.concatenate(([0], np.cumsum([len(w) for w, _ in found]))).astype(np.int32)
                ids_, s = np.concatenate([w for w, _ in found]), np.concatenate([y for _, y in found])
                items = pa.StructArray.from_arrays([pa.array(s, pa.float32()), pa.array(ids_, pa.int64()), pa.array(np.ones(len(s), bool))], names=["s", "node", "open"])
                yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.ListArray.from_arrays(ends, items).cast(kind)], names=["start", "found"])

    return dealt.select("kind", "id", "v", "want").mapInArrow(run, "start bigint, found array<struct<s:float,node:bigint,open:boolean>>")


def parts_of(spark: SparkSession, n: int) -> int:
    """Parts that n nodes are dealt to: three a core, or as many as keep a part within PART_NODES. A query asks each of them at most
    once a round, so their number does not follow the session's shuffle partitions."""
    return max(3 * spark.sparkContext.defaultParallelism, -(-n // PART_NODES))


def search(starts: DataFrame, nodes: DataFrame, graph: DataFrame, beam: int = BEAM) -> DataFrame:
    """start, node: the final beam of a search from each of starts (start: a node) for its own vector."""
    spark = nodes.sparkSession
    parts = parts_of(spark, nodes.count())
    links, links_path = ws.stage(links_of(graph), "nn-links")
    mine = nodes.join(starts, nodes["node"] == starts["start"]).select("start", F.col("v").alias("q"))
    nothing = F.array(F.struct(F.lit(0.0).cast("float").alias("s"), F.col("start").alias("node"), F.lit(True).alias("open")))
    # of the start's own score only the sign of its place matters until it is scored with its neighbours: it is asked for at once
    state, held = ws.stage(mine.select("start", "q", nothing.alias("beam")), "nn-beam")
    first = True
    while True:
        open_ = state.select("start", F.explode(F.filter("beam", lambda x: x["open"])).alias("x")).select("start", F.col("x.node").alias("node"))
        pairs = open_.join(links, "node").select("start", F.explode("nbrs").alias("nbr"))
        if first:
            pairs = pairs.unionByName(open_.select("start", F.col("node").alias("nbr")))
        part = F.pmod(F.xxhash64("nbr"), F.lit(parts)).cast("int")
        wanted = pairs.repartition("start").groupBy("start", part.alias("part")).agg(F.collect_set("nbr").alias("want"))
        # one row a query meets its beam, however many parts it asks
        wanted = wanted.groupBy("start").agg(F.collect_list(F.struct("part", "want")).alias("parts"))
        known = F.array().cast("array<bigint>") if first else F.transform("beam", lambda x: x["node"])
        told = wanted.join(state, "start").select("start", "q", known.alias("known"), F.explode("parts").alias("p"))
        asks = told.select("start", "q", "p.part", F.array_except("p.want", "known").alias("want")).where(F.size("want") > 0)
        found = scored(asks, nodes, parts).groupBy("start").agg(F.flatten(F.collect_list("found")).alias("found"))
        empty = F.array().cast("array<struct<s:float,node:bigint,open:boolean>>")
        if first:  # the start is expanded by now, and comes back with its score
            old, new = empty, F.transform(F.coalesce("found", empty), lambda x: F.struct(x["s"].alias("s"), x["node"].alias("node"), (x["node"] != F.col("start")).alias("open")))
        else:
            old, new = F.transform("beam", lambda x: F.struct(x["s"].alias("s"), x["node"].alias("node"), F.lit(False).alias("open"))), F.coalesce("found", empty)
        merged = F.slice(F.sort_array(F.concat(old, new)), 1, beam)
        state, path = ws.stage(state.join(found, "start", "left").select("start", "q", merged.alias("beam")), "nn-beam")
        ws.drop(spark, held)
        held, first = path, False
        if not state.where(F.exists("beam", lambda x: x["open"])).limit(1).count():
            break
    ws.drop(spark, links_path)
    return state.select("start", F.explode("beam").alias("x")).select("start", F.col("x.node").alias("node"))


def exact(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """start, node, score of pairs, in double precision from the original vectors."""
    joined = pairs.join(nodes.select("node", "v"), "node").join(nodes.select(F.col("node").alias("start"), F.col("v").alias("q")), "start")

    def run(batches):
        for batch in batches:
            x, q = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            score = np.zeros(len(x))
            for at, a in by_length(x, np.float64) if x else ():
                score[at] = np.einsum("ij,ij->i", a, np.frombuffer(b"".join([q[i] for i in at]), np.float64).reshape(len(at), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["start", "node", "score"])

    return joined.select("start", "node", "v", "q").mapInArrow(run, "start bigint, node bigint, score double")


def nearest(table: DataFrame, is_query, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the rows of table for which is_query(vec_id) holds."""
    spark = table.sparkSession
    rows, rows_path = ws.stage(packed(vectors(table)), "nn-rows")
    nodes, nodes_path = ws.stage(nodes_of(rows), "nn-nodes")
    light, light_path = ws.stage(single(nodes), "nn-single")
    asked, asked_path = ws.stage(rows.where(is_query(F.col("vec_id"))).distinct().join(nodes.select("node", "v"), "v").select(F.col("vec_id").alias("query"), F.col("node").alias("start")), "nn-asked")
    graph = build_graph(light)
    found = exact(search(asked.select("start").distinct(), light, graph, beam), nodes)
    # the k + 1 best nodes of a start hold its k + 1 best ids, and those what any of its queries can use
    nearer = Window.partitionBy("start").orderBy(F.desc("score"), "node")
    ids = found.withColumn("r", F.row_number().over(nearer)).where(F.col("r") <= k + 1).join(nodes.select("node", "ids"), "node").select("start", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= 2 * (k + 1))
    near = asked.join(ids, "start").where(F.col("vec_id") != F.col("query")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out, _ = ws.stage(near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score"), "nn-found")
    ws.drop(spark, rows_path, nodes_path, light_path, asked_path)
    return out


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 neighbours of each vector whose id is divisible by 20."""
    return nearest(ws.table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0)
