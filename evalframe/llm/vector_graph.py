"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors become one node with a count. Nodes go to their ``overlap`` nearest of K cluster
   centres (spherical k-means on a bounded sample), so shards overlap at their borders.
2. In every shard a graph is built in batches: greedy search from the shard's medoids, robust pruning
   of what the search met (a neighbour goes if a nearer one is closer to it by ALPHA), back edges.
3. The adjacency lists of a node from all its shards are united into one flat graph.
4. Range search: in each shard, every node looks for its neighbours by greedy search over the flat
   graph from the nearest medoids; then every node in range found is expanded, until no new one
   appears. Cosines are computed in double precision, so nothing below the bound is linked. A pair
   that meets in several shards counts in the first they share; both directions are united.
5. Audit: the links of a seeded sample of nodes are counted against all nodes, without the graph. Below
   the recall asked for, everything is done again with twice the overlap and beam, at last over all shards.

A task returns a count and a local component for each of its nodes, never the pairs. Shards of more
than 1.5 times the target size (a group of near copies may hold a third of all rows) are dealt into parts;
graphs are built per part, and every two parts of a shard meet in one task, so no task grows with the
group and no pair goes uncounted. That work grows with the square of such a group, as its links do.

Scale: one pass assigns nodes to shards; then two grouped maps over (shard, part) and one aggregation
by node. The sample, its centres and the audited nodes are bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import hash_sample, written
from evalframe.llm.components import components

#: edges a node keeps, edges it may gather from others before it is pruned again, and the factor of the pruning rule
DEGREE, SLACK, ALPHA = 24, 40, 1.2
#: most numbers of the sample that centres are fitted on; sampled vectors for each centre, at least
FIT_NUMBERS, FIT_ROWS, ROWS_PER_CENTRE = 1 << 21, 1 << 14, 16
#: nodes whose links are counted without the graph
AUDIT_ROWS = 512
#: queries that a task searches at a time, nodes that it expands at a time
QUERIES, EXPANDED = 256, 1 << 14
#: entry points of a search, and nodes it expands in a step
ENTRIES, WIDTH = 4, 4


@dataclass
class Found:
    """What a batch of searches met: the beam of each query (node or -1), the nodes expanded, the pairs in range."""

    beam: np.ndarray
    expanded: np.ndarray
    rows: np.ndarray
    nodes: np.ndarray


def unit_rows(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so no square overflows or vanishes."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def centres_of(v: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = v[rng.choice(len(v), size=min(k, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def medoids_of(v: np.ndarray) -> np.ndarray:
    """Nodes nearest to the centres of the vectors' cells, the first the medoid of all."""
    whole = int((v @ v.mean(axis=0)).argmax())
    cells = (centres_of(v, max(1, int(np.sqrt(len(v)))), rounds=3) @ v.T).argmax(axis=1)
    return np.concatenate(([whole], np.setdiff1d(cells, [whole]))).astype(np.int64)


def _top(sims: np.ndarray, ids: np.ndarray, flags: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (sims, ids, flags))


def greedy_search(v: np.ndarray, edges: np.ndarray, medoids: np.ndarray, q: np.ndarray, beam: int, least: float | None = None) -> Found:
    """Best-first search of every row of ``q`` over the graph (``edges``: padded with -1) of the nodes ``v``.

    With ``least``, the nodes met whose cosine reaches it are returned, and after the search all of them are
    expanded, with all that this finds, until no new one appears.
    """
    n, m = len(q), len(v)
    seen, in_range = np.zeros((n, m), dtype=bool), np.zeros((n, m), dtype=bool) if least is not None else None

    def meet(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs not met before, once each, with their cosines."""
        at = rows * m + nodes
        at = np.unique(at[~seen.ravel()[at]])
        rows, nodes = np.divmod(at, m)
        seen.ravel()[at] = True
        sims = np.empty(len(at))
        for a in range(0, len(at), EXPANDED):
            sims[a : a + EXPANDED] = np.einsum("ij,ij->i", q[rows[a : a + EXPANDED]], v[nodes[a : a + EXPANDED]])
        if least is not None:
            in_range.ravel()[at[sims >= least]] = True
        return rows, nodes, sims

    def around(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = edges[nodes]
        who, col = np.nonzero(near >= 0)
        return rows[who], near[who, col].astype(np.int64)

    start = np.argsort(-(q @ v[medoids].T), axis=1, kind="stable")[:, :ENTRIES]
    start = np.unique(np.concatenate((np.arange(n) * m + medoids[0], (np.arange(n)[:, None] * m + medoids[start]).ravel())))
    new = meet(*np.divmod(start, m))
    sims, ids, done = np.full((n, beam), -np.inf), np.full((n, beam), -1, dtype=np.int64), np.ones((n, beam), dtype=bool)
    trail = []
    while True:
        rows, nodes, got = new
        if len(rows):  # what was met joins the beams
            first = np.searchsorted(rows, np.arange(n + 1))
            place = np.arange(len(rows)) - first[rows]
            shape = (n, int(np.diff(first).max()))
            more = np.full(shape, -np.inf), np.full(shape, -1, dtype=np.int64), np.ones(shape, dtype=bool)
            for x, y in zip(more, (got, nodes, False), strict=True):
                x[rows, place] = y
            sims, ids, done = _top(*[np.concatenate(x, axis=1) for x in zip((sims, ids, done), more, strict=True)], beam)
        pick = np.argsort(done, axis=1, kind="stable")[:, :WIDTH]  # beams are sorted: the best nodes not expanded yet
        fresh = ~np.take_along_axis(done, pick, axis=1)
        if not fresh.any():
            break
        np.put_along_axis(done, pick, True, axis=1)
        chosen = np.where(fresh, np.take_along_axis(ids, pick, axis=1), -1)
        trail.append(chosen)
        rows, col = np.nonzero(chosen >= 0)
        new = meet(*around(rows, chosen[rows, col]))
    expanded = np.concatenate(trail, axis=1) if trail else np.empty((n, 0), dtype=np.int64)
    if least is None:
        return Found(ids, expanded, np.empty(0, np.int64), np.empty(0, np.int64))
    opened = np.zeros((n, m), dtype=bool)
    rows, col = np.nonzero(expanded >= 0)
    opened[rows, expanded[rows, col]] = True
    while True:
        rows, nodes = np.nonzero(in_range & ~opened)
        if not len(rows):
            break
        for a in range(0, len(rows), EXPANDED):
            opened[rows[a : a + EXPANDED], nodes[a : a + EXPANDED]] = True
            meet(*around(rows[a : a + EXPANDED], nodes[a : a + EXPANDED]))
    return Found(ids, expanded, *np.nonzero(in_range))


def robust_prune(v: np.ndarray, p: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """DEGREE neighbours at most of each node of ``p`` from its row of ``candidates`` (padded with -1)."""
    out = np.full((len(p), DEGREE), -1, dtype=np.int32)
    for a in range(0, len(p), 64):
        own, c = p[a : a + 64], np.sort(candidates[a : a + 64], axis=1)
        usable = (c >= 0) & (c != own[:, None])
        usable[:, 1:] &= c[:, 1:] != c[:, :-1]
        x = v[np.maximum(c, 0)]
        sims = np.einsum("bcd,bd->bc", x, v[own])
        between = x @ x.transpose(0, 2, 1)
        far, row = 2 - 2 * sims, np.arange(len(own))
        for k in range(DEGREE):
            best = np.where(usable, sims, -np.inf).argmax(axis=1)
            alive = usable[row, best]
            if not alive.any():
                break
            out[a : a + 64, k] = np.where(alive, c[row, best], -1)
            usable &= ~(ALPHA**2 * (2 - 2 * between[row, best]) <= far)
            usable[row, best] = False
    return out


def build_graph(v: np.ndarray, beam: int) -> np.ndarray:
    """Edges (padded with -1) of a robust-pruned graph of the rows of ``v``."""
    m, medoids = len(v), medoids_of(v)
    edges = np.full((m, SLACK), -1, dtype=np.int32)
    edges[medoids, :DEGREE] = robust_prune(v, medoids, np.tile(medoids, (len(medoids), 1)))
    rest = np.random.default_rng(1).permutation(np.setdiff1d(np.arange(m), medoids))

    def insert(batch: np.ndarray) -> None:
        pools = [edges[batch].astype(np.int64)]
        found = [greedy_search(v, edges, medoids, v[batch[a : a + QUERIES]], beam) for a in range(0, len(batch), QUERIES)]
        width = max(f.expanded.shape[1] for f in found)
        pools += [np.concatenate([f.beam for f in found]), np.concatenate([np.pad(f.expanded, ((0, 0), (0, width - f.expanded.shape[1])), constant_values=-1) for f in found])]
        kept = robust_prune(v, batch, np.concatenate(pools, axis=1))
        edges[batch] = -1
        edges[batch, :DEGREE] = kept
        row, col = np.nonzero(kept >= 0)
        order = np.argsort(kept[row, col], kind="stable")
        target, origin = kept[row, col][order].astype(np.int64), batch[row][order]
        ends = np.append(np.flatnonzero(np.diff(target, prepend=-1)), len(target))
        full, lists = [], []
        for a, b in zip(ends, ends[1:], strict=False):
            t = target[a]
            both = np.union1d(edges[t][edges[t] >= 0], origin[a:b])
            if len(both) <= SLACK:
                edges[t, : len(both)] = both
            else:
                full.append(t)
                lists.append(both)
        if full:
            longest = max(map(len, lists))
            full = np.array(full)
            pruned = robust_prune(v, full, np.array([np.pad(x, (0, longest - len(x)), constant_values=-1) for x in lists]))
            edges[full] = -1
            edges[full, :DEGREE] = pruned

    done, size = 0, max(16, len(medoids))
    while done < len(rest):  # a batch as large as the graph so far, as its nodes don't see each other
        insert(rest[done : done + size])
        done, size = done + size, min(2 * size, 1024)
    for a in range(0, len(rest), 1024):  # once more, over the whole graph
        insert(rest[a : a + 1024])
    return edges


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _local_edges(keys: pa.Array, links: pa.ChunkedArray) -> np.ndarray:
    """Edges among the nodes of a task, as places in ``keys``, padded with -1."""
    links = links.combine_chunks()
    to = pc.fill_null(pc.index_in(links.flatten(), value_set=keys), -1).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(links)), links.value_lengths().to_numpy(zero_copy_only=False))[to >= 0]
    to = to[to >= 0]
    first = np.searchsorted(owner, np.arange(len(links) + 1))
    out = np.full((len(links), max(1, int(np.diff(first).max(initial=0)))), -1, dtype=np.int32)
    out[owner, np.arange(len(owner)) - first[owner]] = to
    return out


def _links_in_range(v: np.ndarray, edges: np.ndarray, side: np.ndarray, beam: int, least: float) -> np.ndarray:
    """Which nodes link (square, symmetric); with two sides, across them only."""
    m = len(v)
    linked = np.zeros((m, m), dtype=bool)
    sides = [np.flatnonzero(side == s) for s in np.unique(side)]
    for own in sides:
        place = np.full(m + 1, -1)
        place[own] = np.arange(len(own))
        inner = place[edges[own]]  # -1 is the last place, and stays -1
        medoids = medoids_of(v[own])
        asked = own if len(sides) == 1 else np.setdiff1d(np.arange(m), own)
        for a in range(0, len(asked), QUERIES):
            found = greedy_search(v[own], inner, medoids, v[asked[a : a + QUERIES]], beam, least)
            linked[asked[a : a + QUERIES][found.rows], own[found.nodes]] = True
    for a in range(0, m, 1024):  # whichever of two nodes found the other
        linked[a : a + 1024] |= linked[:, a : a + 1024].T
        linked[:, a : a + 1024] |= linked[a : a + 1024].T
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """First node of the component of each node."""
    root = np.full(len(linked), -1)
    for s in range(len(linked)):
        front = np.array([s]) if root[s] < 0 else np.empty(0, np.int64)
        while len(front):
            root[front] = s
            near = np.zeros(len(linked), dtype=bool)
            for a in range(0, len(front), 1024):
                near |= linked[front[a : a + 1024]].any(axis=0)
            front = np.flatnonzero(near & (root < 0))
    return root


def _assign(nodes: DataFrame, centres: dict[int, tuple[int, np.ndarray]], overlap: int) -> DataFrame:
    """``nodes`` with _homes: the shards of the ``overlap`` nearest centres of vectors of their length, ascending."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            homes: list = [None] * batch.num_rows
            sizes = batch.column("_vec").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                first, c = centres[int(size)]
                rows = np.flatnonzero(sizes == size)
                sims = unit_rows(_matrix(batch.column("_vec").take(pa.array(rows)))) @ c.T
                near = np.sort(np.argsort(-sims, axis=1, kind="stable")[:, :overlap], axis=1) + first
                for r, h in zip(rows, near.tolist(), strict=True):
                    homes[r] = h
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.list_(pa.int32()))], names=[*batch.schema.names, "_homes"])

    return nodes.mapInArrow(assign, "_key binary, _vec array<double>, _n bigint, _homes array<int>")


def _fit_centres(nodes: DataFrame, overlap: int, target: int) -> dict[int, tuple[int, np.ndarray]]:
    """{vector length: (number of its first shard, centres)}, each fitted on a bounded sample."""
    out, first = {}, 0
    for size, n in sorted((r["s"], r["count"]) for r in nodes.groupBy(F.size("_vec").alias("s")).count().collect()):
        rows = min(FIT_ROWS, max(ROWS_PER_CENTRE, FIT_NUMBERS // size))
        sample = hash_sample(nodes.where(F.size("_vec") == size), ["_key"], rows, seed=29)
        v = np.array([r["_vec"] for r in sample.select("_vec").collect()], dtype=np.float64).reshape(-1, size)
        k = max(1, min(-(-overlap * n // target), rows // ROWS_PER_CENTRE))
        c = centres_of(unit_rows(v), k) if k > 1 and len(v) else np.zeros((1, size))
        out[size] = (first, c)
        first += len(c)
    return out


def _link_counts(nodes: DataFrame, least: float, overlap: int, target: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """(_key, _links) of the nodes that have links, counting copies of the others, and edges (a, b) that join components."""
    placed = written(_assign(nodes, _fit_centres(nodes, overlap, target), overlap), "graph-nodes")
    home = placed.select("_key", F.explode("_homes").alias("_shard"))
    sizes = home.groupBy("_shard").agg(F.ceil(F.count(F.lit(1)) / (3 * target // 2)).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("_key", "_shard"), F.col("_parts")).cast("int").alias("_part")

    def build(table: pa.Table) -> pa.Table:
        edges = build_graph(unit_rows(_matrix(table.column("_vec"))), beam)
        keys = table.column("_key").combine_chunks()
        sizes = (edges >= 0).sum(axis=1)
        flat = keys.take(pa.array(edges[edges >= 0].astype(np.int64)))
        links = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), flat)
        return pa.table({"_key": keys, "_near": links})

    spread = placed.withColumn("_shard", F.explode("_homes")).join(sizes, "_shard").select("*", part)
    lists = spread.select("_shard", "_part", "_key", "_vec").groupBy("_shard", "_part").applyInArrow(build, "_key binary, _near array<binary>")
    flat = lists.groupBy("_key").agg(F.array_distinct(F.flatten(F.collect_list("_near"))).alias("_near"))
    graph = written(placed.join(flat, "_key"), "flat-graph")

    met = graph.withColumn("_shard", F.explode("_homes")).join(sizes, "_shard").select("*", part)
    # every two parts of a shard meet once; a part meets itself
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    met = met.withColumns({"_low": F.least("_part", "_other"), "_high": F.greatest("_part", "_other")})

    def search(table: pa.Table) -> pa.Table:
        keys = table.column("_key").combine_chunks()
        side = table.column("_part").to_numpy()
        if table.column("_low")[0] != table.column("_high")[0] and (side == side[0]).all():
            return pa.table({"_key": keys[:0], "_links": pa.array([], pa.int64()), "_root": keys[:0]})  # the other part is empty
        v = unit_rows(_matrix(table.column("_vec")))
        homes = _matrix(table.column("_homes"), np.int64)
        copies = table.column("_n").to_numpy()
        linked = _links_in_range(v, _local_edges(keys, table.column("_near")), side, beam, least)
        links = np.zeros(len(v), dtype=np.int64)
        step = max(1, (1 << 18) // len(v))
        for start in range(0, len(v), step):
            a, b = np.nonzero(linked[start : start + step])
            a += start
            shared = (homes[a][:, :, None] == homes[b][:, None, :]).any(axis=2)
            mine = homes[a, shared.argmax(axis=1)] == table.column("_shard")[0].as_py()
            np.add.at(links, a[mine], copies[b[mine]])
        some = np.flatnonzero(linked.any(axis=1))
        root = _roots(linked)[some]
        return pa.table({"_key": keys.take(pa.array(some)), "_links": pa.array(links[some]), "_root": keys.take(pa.array(root))})

    columns = ("_shard", "_low", "_high", "_part", "_key", "_vec", "_n", "_homes", "_near")
    found = met.select(*columns).groupBy("_shard", "_low", "_high").applyInArrow(search, "_key binary, _links bigint, _root binary")
    found = written(found, "graph-links")
    return found.groupBy("_key").agg(F.sum("_links").alias("_links")), found.where("_key <> _root").select(F.col("_key").alias("a"), F.col("_root").alias("b"))


def audit_recall(nodes: DataFrame, links: DataFrame, least: float, rows: int = AUDIT_ROWS) -> float:
    """Share of the links of about ``rows`` seeded nodes, counted against all nodes, that ``links`` (_key, _links) holds; 1 without links."""
    asked = hash_sample(nodes, ["_key"], rows, seed=31).join(links, "_key", "left").select("_key", "_vec", "_n", F.coalesce("_links", F.lit(0)).alias("_links")).collect()
    by = {}
    for i, r in enumerate(asked):
        by.setdefault(len(r["_vec"]), []).append(i)
    queries = {size: (np.array(who), unit_rows(np.array([asked[i]["_vec"] for i in who], dtype=np.float64))) for size, who in by.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            sizes = batch.column("_vec").value_lengths().to_numpy(zero_copy_only=False)
            for size, (who, q) in queries.items():
                rows = np.flatnonzero(sizes == size)
                for a in range(0, len(rows), 4096):
                    some = pa.array(rows[a : a + 4096])
                    near = q @ unit_rows(_matrix(batch.column("_vec").take(some))).T >= least
                    total[who] += near @ batch.column("_n").take(some).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(asked))), pa.array(total)], names=["_i", "_true"])

    true = {r["_i"]: r["_true"] for r in nodes.mapInArrow(count, "_i bigint, _true bigint").groupBy("_i").agg(F.sum("_true").alias("_true")).collect()}
    want = sum(true.get(i, 0) - r["_n"] for i, r in enumerate(asked))
    return 1.0 if want <= 0 else sum(r["_links"] for r in asked) / want


def _usable(vec: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, number) & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9,
    *, overlap: int = 4, target: int = 4096, beam: int = 48, recall: float = 0.95,
) -> DataFrame:
    """One row per vector: ``vec_id``, n_links (other vectors of cosine ``least`` or more), component_id (least
    vec_id reachable by links, itself included), kept (vec_id = component_id).

    A vector that is null, empty or zero, or holds a null or non-finite component, links with nothing and is its
    own component, as do vectors of different lengths among each other. Equal vectors, also under one id, link
    with each other, each row for itself. A null id is never a least one unless its whole component lacks ids;
    then component_id is null and all are kept. An empty table gives no rows. Other columns play no part.
    """
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), F.col("_vec"))), 16, "0") for seed in (1, 2)]))
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("_id"), F.col(f"`{embedding}`").cast("array<double>").alias("_vec"))
    rows = rows.withColumn("_key", F.when(_usable(F.col("_vec")), key))
    known = written(rows.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.any_value("_vec").alias("_vec")), "vectors")
    nodes = known.select("_key", "_vec", "_n")
    shards = None
    while True:
        links, edges = _link_counts(nodes, least, overlap, target, beam)
        if shards is None:
            shards = -(-overlap * known.count() // target)
        if overlap >= shards and beam >= 2 * target or audit_recall(nodes, links, least) >= recall:
            break
        overlap, beam = 2 * overlap, 2 * beam
    joined = components(edges).withColumnRenamed("node", "_key")
    joined = known.join(joined, "_key", "left").select("_key", "_least", F.coalesce("component", "_key").alias("_component"))
    least_id = joined.groupBy("_component").agg(F.min("_least").alias("component_id"))
    named = known.select("_key", "_n").join(links, "_key", "left").join(joined.select("_key", "_component"), "_key").join(least_id, "_component")
    named = named.select("_key", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("n_links"), "component_id")
    lone = rows.where("_key is null").select(F.col("_id").alias(vec_id), F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    linked = rows.where("_key is not null").select("_id", "_key").join(named, "_key").select(F.col("_id").alias(vec_id), "n_links", "component_id")
    return linked.unionByName(lone).withColumn("kept", F.col(f"`{vec_id}`").eqNullSafe(F.col("component_id")))
