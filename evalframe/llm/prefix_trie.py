"""Prefix trie of conversations: a z-fast trie built by batch insertion over Spark tables.

A conversation is a string of turns (role, text). ``prefix_keys`` gives each one row with a digest
for every prefix (16 bytes a turn) and the words of every turn; equal conversations become one class.

The compacted trie is a table: a node spans the depths (lo, hi] of its representative class and is
found by its handle, the digest of the prefix whose length is the two-fattest number in (lo, hi]
(the one divisible by the highest power of two). Classes are inserted in batches:

1. Fat binary search: every pending class probes the handle at the two-fattest depth of its interval,
   one join a step, log2(turns) steps. A hit whose whole extent it shares moves its lower end to that
   extent, anything else its upper end below the handle. What is left is the deepest node it passes.
2. Exit: the child along its next turn, if any, is its exit node; the digests of the child's
   representative give the depth at which the two part.
3. Insertion: edges are cut where a class ends or leaves. Of all classes that leave at one place with
   the same next turn, one (least seeded hash) becomes a leaf; the others are the next batch. The
   chosen one follows the heaviest branch as a random member would, so the number of batches grows
   with the logarithm of the classes.

Measures of subtrees are sums and minima over the compacted nodes, gathered by pointer doubling
(log2 of the trie's height rounds); edges are expanded to one row per prefix at the end.

Scale: every step is an equi-join or a partial aggregation on digests; tables are written to the
shared folder between rounds. Copies are one class, so a group of copies costs one row. Joins on a
first turn that many conversations share are left to AQE's skew handling. A conversation's digests
(about 30 bytes a turn) are one row, as the conversation itself is one model input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.common import text_or_empty, words, written

ROOT = hashlib.blake2b(b"", digest_size=16).digest()
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
#: ids of one piece of a node's list of ends
END_CHUNK = 4096

NODE = ("_id", "_parent", "_lo", "_hi", "_first", "_handle", "_rep")


def ordered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, role, text): every turn at its 0-based place in its conversation.

    Turns go by number, null first; equal numbers by role, then by the digest of the text, and
    repeated turns each keep a place. Null role or text is empty. Rows without a conversation id
    belong to none and are left out.
    """
    rows = df.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("_turn"),
        text_or_empty(F.col(f"`{role}`")).alias("role"), text_or_empty(F.col(f"`{text}`")).alias("text"),
    )
    place = Window.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "role", F.md5(F.col("text").cast("binary")))
    return rows.withColumn("pos", (F.row_number().over(place) - 1).cast("int")).select("conv_id", "pos", "role", "text")


def prefix_keys(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(_conv, _n, _hs, _words): for each conversation its turns, the digests of its prefixes (the empty
    one first) and the words of each turn. ``turns`` has (conv_id, pos, role, text), ``conversations``
    every conv_id, those without turns too."""
    symbol = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = turns.select(F.col("conv_id").alias("_conv"), F.struct("pos", symbol.alias("s"), F.size(words("text")).cast("bigint").alias("w")).alias("t"))
    whole = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = conversations.select(F.col("conv_id").alias("_conv")).distinct().join(whole, "_conv", "left").select(
        "_conv", F.coalesce(F.transform("t", lambda x: x["s"]), F.array().cast("array<binary>")).alias("s"),
        F.coalesce(F.transform("t", lambda x: x["w"]), F.array().cast("array<bigint>")).alias("w"),
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for symbols in batch.column("s").to_pylist():
                at, digests = ROOT, [ROOT]
                for s in symbols:
                    at = hashlib.blake2b(at + s, digest_size=16).digest()
                    digests.append(at)
                out.append(digests)
            sizes = pa.array([len(d) - 1 for d in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_conv"), sizes, pa.array(out, pa.list_(pa.binary())), batch.column("w")], names=["_conv", "_n", "_hs", "_words"])

    return whole.mapInArrow(chain, "_conv bigint, _n int, _hs array<binary>, _words array<bigint>")


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the highest power of two divides, for 0 <= a < b."""
    low = F.length(F.bin(a.bitwiseXOR(b).cast("bigint"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", b, low), low)


def _fat_search(pending: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``pending`` (_x, _n, _hs, _a) with _a raised to the deepest extent that each class passes."""
    handles = nodes.where(F.col("_handle").isNotNull()).select("_handle", F.col("_id").alias("_at"), F.col("_hi").alias("_to"))
    s = pending.withColumn("_b", F.col("_n"))
    a, b, to = F.col("_a"), F.col("_b"), F.col("_to")
    for _ in range(longest.bit_length()):
        s = s.withColumn("_f", F.when(a < b, two_fattest(a, b)))
        # a class that is done probes a key of its own that no handle has
        s = s.withColumn("_probe", F.coalesce(F.get("_hs", F.col("_f")), F.concat("_x", F.lit(b"."))))
        s = s.join(handles, F.col("_probe") == F.col("_handle"), "left")
        s = s.withColumn("_hit", F.coalesce((to <= F.col("_n")) & (F.get("_hs", to) == F.col("_at")), F.lit(False)))
        s = s.select(
            "_x", "_n", "_hs", F.when(F.col("_hit"), to).otherwise(a).alias("_a"),
            F.when(F.col("_f").isNull() | F.col("_hit"), b).otherwise(F.col("_f") - 1).alias("_b"),
        )
    return s.drop("_b")


def _exits(pending: DataFrame, nodes: DataFrame, classes: DataFrame, longest: int) -> DataFrame:
    """(_x, _n, _hs, _exit, _to, _l): exit node (null: none), its extent, and the depth at which the class leaves the trie."""
    s = _fat_search(pending, nodes, longest).withColumn("_next", F.coalesce(F.get("_hs", F.col("_a") + 1), F.concat("_x", F.lit(b"."))))
    child = nodes.where(F.col("_first").isNotNull()).select("_first", F.col("_id").alias("_exit"), F.col("_hi").alias("_to"), "_rep")
    s = s.join(child, F.col("_next") == F.col("_first"), "left")
    s = s.join(classes.select(F.col("_x").alias("_rep"), F.col("_hs").alias("_other")), "_rep", "left")
    upto = F.least("_to", "_n")
    shared = F.when(
        F.col("_exit").isNotNull(),
        F.size(F.filter(F.sequence(F.col("_a") + 1, upto), lambda d: F.get("_hs", d) == F.get("_other", d))),
    ).otherwise(0)
    return s.select("_x", "_n", "_hs", "_exit", "_to", (F.col("_a") + shared).cast("int").alias("_l"))


def _edge(lo: Column, hi: Column, rep: Column, digests: str = "_hs") -> list[Column]:
    """Columns of the node that spans (lo, hi] of a class."""
    at = lambda d: F.get(digests, d)
    return [at(hi).alias("_id"), at(lo).alias("_parent"), lo.alias("_lo"), hi.alias("_hi"), at(lo + 1).alias("_first"), at(two_fattest(lo, hi)).alias("_handle"), rep.alias("_rep")]


def _cut_edges(found: DataFrame, nodes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, ids of the nodes they replace): edges that a class ends on or leaves, cut at those depths."""
    cuts = found.where("_exit is not null and _l < _to").groupBy(F.col("_exit").alias("_id")).agg(F.collect_set("_l").alias("_cuts"))
    # an edge has at most as many cuts as turns
    whole = cuts.join(nodes.select("_id", "_lo", "_hi", "_rep"), "_id").select(
        "_rep", F.array_sort(F.concat(F.array("_lo"), "_cuts", F.array("_hi"))).alias("_ends")
    )
    spans = whole.select("_rep", F.explode(F.arrays_zip(F.slice("_ends", 1, F.size("_ends") - 1).alias("lo"), F.slice("_ends", 2, F.size("_ends") - 1).alias("hi"))).alias("_s"))
    pieces = spans.join(classes.select(F.col("_x").alias("_rep"), "_hs"), "_rep")
    return pieces.select(*_edge(F.col("_s.lo"), F.col("_s.hi"), F.col("_rep"))), cuts.select("_id")


def compacted_trie(classes: DataFrame) -> DataFrame:
    """Nodes (_id, _parent, _lo, _hi, _first, _handle, _rep) of the compacted trie of ``classes`` (_x, _n, _hs).

    The root spans (-1, 0]. Every class ends at a node of its own, so an edge is passed by the same classes all along.
    """
    spark = classes.sparkSession
    root = spark.createDataFrame([(ROOT, None, -1, 0, None, None, None)], "_id binary, _parent binary, _lo int, _hi int, _first binary, _handle binary, _rep binary")
    nodes = written(root, "trie-nodes")
    pending = classes.where("_n > 0").select("_x", "_n", "_hs", F.lit(0).alias("_a"))
    batch = 0
    while (longest := pending.agg(F.max("_n")).first()[0]) is not None:
        if batch:
            found = written(_exits(pending, nodes, classes, longest), "trie-exits")
        else:  # nothing to search yet
            found = pending.select("_x", "_n", "_hs", F.lit(None).cast("binary").alias("_exit"), F.lit(None).cast("int").alias("_to"), F.lit(0).alias("_l"))
        leaving = found.where("_l < _n").withColumn("_branch", F.get("_hs", F.col("_l") + 1))
        chosen = leaving.groupBy("_branch").agg(F.min(F.struct(F.xxhash64("_x", F.lit(batch)).alias("r"), F.col("_x").alias("x")))["x"].alias("_x"))
        chosen = written(chosen.select("_x"), "trie-batch")
        leaves = leaving.join(chosen, "_x", "left_semi").select(*_edge(F.col("_l"), F.col("_n"), F.col("_x")))
        grown = leaves
        if batch:
            pieces, cut = _cut_edges(found, nodes, classes)
            grown = nodes.join(cut, "_id", "left_anti").select(*NODE).unionByName(pieces).unionByName(leaves)
        else:
            grown = nodes.unionByName(leaves)
        nodes = written(grown, "trie-nodes")
        pending = written(leaving.join(chosen, "_x", "left_anti").select("_x", "_n", "_hs", F.col("_l").alias("_a")), "trie-pending")
        batch += 1
    return nodes


def subtree_sums(nodes: DataFrame, sums: list[str], least: list[str]) -> DataFrame:
    """``nodes`` (_id, _parent, measures) with each measure summed, or its least taken, over the subtree.

    Pointer doubling: after round k a node holds what lies less than 2**k levels below it, and its
    pointer reaches 2**k levels up.
    """
    held = nodes.withColumn("_up", F.col("_parent"))
    while not (pointing := held.where("_up is not null")).isEmpty():
        more = pointing.groupBy("_up").agg(*[F.sum(c).alias(f"+{c}") for c in sums], *[F.min(c).alias(f"+{c}") for c in least])
        above = pointing.where(F.col("_up") != F.lit(ROOT)).select("_id", "_up").join(held.select(F.col("_id").alias("_up"), F.col("_up").alias("_next")), "_up").select("_id", "_next")
        held = held.drop("_up").join(more.withColumnRenamed("_up", "_id"), "_id", "left").join(above, "_id", "left").select(
            "_id", "_parent", *[(F.col(c) + F.coalesce(f"`+{c}`", F.lit(0))).alias(c) for c in sums],
            *[F.least(c, f"`+{c}`").alias(c) for c in least], F.col("_next").alias("_up"),
        )
        held = written(held, "trie-sums")
    return held.drop("_up")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(_id, _sha): digest of the comma-joined ids (_conv, ascending) that end at each node (_id).

    Pieces of the list are joined by many tasks; one task then reads a node's pieces in order, a batch at a time.
    """
    pieces = ends.groupBy("_id", F.expr(f"_conv div {END_CHUNK}").alias("_chunk")).agg(F.array_join(F.array_sort(F.collect_list("_conv")), ",").alias("_ids"))
    ordered = pieces.repartition("_id").sortWithinPartitions("_id", "_chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("_id").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                if node == last:
                    state.update(b"," + ids.encode())
                else:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["_id", "_sha"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["_id", "_sha"])

    return ordered.mapInArrow(digest, "_id binary, _sha string")


def conversation_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``turns`` (conv_id, pos, role, text): node, parent (digests), depth,
    conv_id (least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``pos`` runs from 0 without gaps in each conversation; ``conversations`` (conv_id) names all of
    them, those without turns too (they end at the root). Members of a node are the conversations that
    start with it. saved_tokens sums, over the subtree, (members - 1) times the words of the node's
    last turn; ends_sha256 digests the ids that end there. No conversations give no rows, not even a
    root. Null or repeated ids in ``conversations`` count not at all or once. Other columns play no part.
    """
    keys = written(prefix_keys(turns, conversations.where("conv_id is not null")).withColumn("_x", F.get("_hs", F.col("_n"))), "trie-keys")
    copies = keys.groupBy("_x").agg(F.min("_conv").alias("_conv"), F.count(F.lit(1)).alias("_ends"))
    classes = written(keys.drop("_x").join(copies, "_conv"), "trie-classes")
    nodes = compacted_trie(classes)

    # words(u) is the sum over an edge, W(e) that over all turns of an ending conversation e; summed over a subtree
    # (members(u) - 1) * words(u) is, by ends, sum W(e) - members * words above the subtree - sum words(u)
    at = nodes.join(classes.select(F.col("_x").alias("_rep"), "_words"), "_rep", "left")
    total = lambda a, b: F.aggregate(F.slice("_words", a + 1, b - a), F.lit(0).cast("bigint"), lambda s, w: s + w)
    edge = F.when(F.col("_hi") > 0, total(F.col("_lo"), F.col("_hi"))).otherwise(F.lit(0).cast("bigint"))
    above = F.when(F.col("_hi") > 0, total(F.lit(0), F.col("_lo"))).otherwise(F.lit(0).cast("bigint"))
    at = at.select("_id", "_parent", "_lo", "_hi", "_rep", edge.alias("_edge"), above.alias("_above"))
    kids = nodes.where("_parent is not null").groupBy(F.col("_parent").alias("_id")).agg(F.count(F.lit(1)).alias("_kids"))
    at = at.join(kids, "_id", "left").join(classes.select(F.col("_x").alias("_id"), "_ends", "_conv"), "_id", "left")
    own = written(at.withColumns({"_kids": F.coalesce("_kids", F.lit(0)), "_ends": F.coalesce("_ends", F.lit(0))}), "trie-own")
    sums = subtree_sums(
        own.select(
            "_id", "_parent", F.col("_ends").alias("_members"), F.when(F.col("_kids") == 0, 1).otherwise(0).cast("bigint").alias("_leaves"),
            F.col("_edge").alias("_below"), (F.col("_ends") * (F.col("_above") + F.col("_edge"))).alias("_spent"), F.col("_conv").alias("_least"),
        ),
        ["_members", "_leaves", "_below", "_spent"], ["_least"],
    ).drop("_parent").where("_members > 0")  # without conversations not even the root

    full = own.drop("_conv", "_ends").join(sums, "_id")
    full = full.join(sums.select(F.col("_id").alias("_parent"), F.col("_least").alias("_over")), "_parent", "left")
    full = full.join(_ends_digest(keys.select(F.col("_x").alias("_id"), "_conv")), "_id", "left")
    full = full.join(classes.select(F.col("_x").alias("_rep"), "_hs", "_words"), "_rep", "left")
    # expand edges: one row per depth; the words above it in the edge are saved by the rows above
    depth, last = F.col("depth"), F.col("depth") == F.col("_hi")
    rows = full.withColumn("depth", F.explode(F.when(F.col("_hi") > 0, F.sequence(F.col("_lo") + 1, F.col("_hi"))).otherwise(F.array(F.lit(0)))))
    saved = F.col("_spent") - F.col("_members") * F.col("_above") - F.col("_below")
    before = F.when(depth > F.col("_lo") + 1, (F.col("_members") - 1) * total(F.col("_lo"), depth - 1)).otherwise(F.lit(0).cast("bigint"))
    return rows.select(
        F.coalesce(F.get("_hs", depth), "_id").alias("node"),
        F.get("_hs", depth - 1).alias("parent"),
        depth.cast("bigint").alias("depth"),
        F.col("_least").alias("conv_id"),
        F.when(depth > F.col("_lo") + 1, F.col("_least")).otherwise(F.col("_over")).alias("parent_conv_id"),
        F.col("_members").alias("n_convs"),
        F.when(last, F.col("_kids")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("_leaves").alias("n_leaves"),
        (saved - before).alias("saved_tokens"),
        F.coalesce(F.when(last, F.col("_sha")), F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
