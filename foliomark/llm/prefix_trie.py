"""Prefix trie of rebuilt conversations by composable fingerprints.

A sequence of turns has a fingerprint (n, s) with ``s = sum(t[i] * R**i) mod 2**64`` over the hashes t of
its turns. Fingerprints form a monoid, ``(n, s) * (m, u) = (n + m, s + R**n * u)``, in which s can be
taken back, so every prefix of "head of the base, then the rest of its own" is put together from
stored prefix products; no rebuilt sequence of texts is ever made. Two independent ones make 128 bits.

1. Turns become rows of numbers and are sorted by range; each part multiplies its own turns, and the
   few conversations that cross parts get the product of what lies before (an associative scan).
2. A conversation's head is at most five rows of its base; its own rows are shifted behind it. Each
   rebuilt turn keeps a reference to the stored turn it comes from.
3. Equal fingerprints are one node. Equality is proved: turns with one hash must have one role and one
   text, and the references of a node's members must lead to one turn hash, one size and one parent node;
   then, by depth, the whole prefixes are equal. Otherwise all is done again with another seed.
4. Sums over subtrees: the nodes of which a conversation is the least member end its path, so they are
   a sum from below along that path; above it, every other member adds its conversation's total.

No step collects a conversation, a node or a path: long paths are cut into blocks of ``SPAN`` depths, and
the digest of a node's ends is taken over pieces that were sorted and joined by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomark.llm.tables import table
from foliomark.llm.words import signed
from foliomark.operators.spool import Scratch

GROUP = 100
HEADS = 6
SPAN = 4096
PIECE = 1 << 16
#: odd multipliers of the two fingerprints
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

NODE = ["d", "sa", "sb"]
REBUILT = "c long, d long, sa long, sb long, qa long, qb long, a long, b long, n long, last boolean, ref_conv long, ref_pos long"


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base**e mod 2**64`` for each exponent; negative ones are powers of the inverse."""
    e = np.abs(exponents).astype(np.uint64)
    square = np.where(exponents < 0, np.uint64(pow(base, -1, 1 << 64)), np.uint64(base))
    out = np.ones(len(e), dtype=np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square, out)
        square = square * square
        e = e >> np.uint64(1)
    return out


def composed(first: tuple, second: tuple) -> tuple:
    """The product of two fingerprints (n, sa, sb) of Python integers."""
    n, sa, sb = first
    m, ua, ub = second
    mask = (1 << 64) - 1
    return n + m, (sa + pow(BASES[0], n, 1 << 64) * ua) & mask, (sb + pow(BASES[1], n, 1 << 64) * ub) & mask


def _unsigned(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy().view(np.uint64)


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, turn, role, a, b, n, tie, text): a row of numbers for every turn; rows without conv_id are no turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    a, b = (F.xxhash64(F.lit(2 * seed + k), role, text) for k in range(2))
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), a.alias("a"), b.alias("b"),
        F.char_length(text).cast("long").alias("n"), F.xxhash64(text).alias("tie"), text.alias("text"),
    )


def _products(turns: DataFrame) -> DataFrame:
    """(part, conv_id, pos, a, b, n, pa, pb): position and prefix product of each turn within its part."""
    order = ["conv_id", "turn", "role", "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, held = None, (0, 0, 0)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1])
            lengths = np.diff(np.append(starts, size))
            pos = np.arange(size) - np.repeat(starts, lengths)
            if conv[0] != now:
                held = (0, 0, 0)
            pos[: lengths[0]] += held[0]
            sums = []
            for k, column in enumerate("ab"):
                total = np.cumsum(_unsigned(batch, column) * powers(BASES[k], pos))
                before = np.concatenate([np.zeros(1, np.uint64), total[starts[1:] - 1]])
                total = total - np.repeat(before, lengths)
                total[: lengths[0]] += np.uint64(held[1 + k])
                sums.append(total)
            now, held = conv[-1], (int(pos[-1]) + 1, int(sums[0][-1]), int(sums[1][-1]))
            yield pa.record_batch(
                {
                    "part": pa.array(np.full(size, part, np.int32)), "conv_id": batch.column("conv_id"), "pos": pos, "a": batch.column("a"),
                    "b": batch.column("b"), "n": batch.column("n"), "pa": signed(sums[0]), "pb": signed(sums[1]),
                }
            )

    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "n")
    return dealt.mapInArrow(run, "part int, conv_id long, pos long, a long, b long, n long, pa long, pb long")


def _joined(scratch: Scratch, products: DataFrame) -> DataFrame:
    """The products with what lies before in earlier parts. Only the two ends of a part can cross parts."""
    ends = products.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).orderBy("part").collect()
    crossing = {hi.hi for hi, lo in zip(ends, ends[1:], strict=False) if hi.hi == lo.lo}
    if not crossing:
        return products.drop("part")
    over = products.join(F.broadcast(scratch.spark.createDataFrame([(c,) for c in crossing], "conv_id long")), "conv_id")
    sums = over.groupBy("conv_id", "part").agg(F.max(F.struct("pos", "pa", "pb")).alias("end")).orderBy("conv_id", "part").collect()
    mask, carry, now, held = (1 << 64) - 1, {}, None, (0, 0, 0)
    for conv, part, end in sums:
        if conv != now:
            now, held = conv, (0, 0, 0)
        carry[conv, part] = held
        held = composed(held, (end.pos + 1, end.pa & mask, end.pb & mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, part = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
            pos = batch.column("pos").to_numpy().copy()
            sums = [_unsigned(batch, c).copy() for c in ("pa", "pb")]
            for (c, p), before in carry.items():
                if before[0] and part[0] <= p <= part[-1]:
                    at = np.flatnonzero((conv == c) & (part == p))
                    pos[at] += before[0]
                    for k in range(2):
                        sums[k][at] = np.uint64(before[1 + k]) + powers(BASES[k], np.full(len(at), before[0])) * sums[k][at]
            columns = {c: batch.column(c) for c in ("conv_id", "a", "b", "n")}
            yield pa.record_batch(columns | {"pos": pos, "pa": signed(sums[0]), "pb": signed(sums[1])})

    fixed = products.sortWithinPartitions("part").mapInArrow(run, "conv_id long, a long, b long, n long, pos long, pa long, pb long")
    return fixed.select("conv_id", "pos", "a", "b", "n", "pa", "pb")


def _block(column: str = "d") -> Column:
    return F.floor(F.col(column) / F.lit(SPAN)).cast("long").alias("block")


def rebuilt(scratch: Scratch, turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """All turns of all rebuilt conversations as fingerprints (``REBUILT``), and the conversations (c, size).

    ``sa, sb`` is the prefix that ends with the turn, ``qa, qb`` the one before it; ``a, b, n`` belong to the
    stored turn at ``ref_conv, ref_pos``.
    """
    products = scratch.spool(_products(turns))
    stored = scratch.spool(_joined(scratch, products))
    scratch.drop(products)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("long")
    mark = F.col("pos") == F.col("h") - 1
    owners = stored.withColumn("h", h).groupBy("conv_id", "h").agg(
        F.count(F.lit(1)).alias("own"), F.max(F.when(mark, F.col("pa"))).alias("pha"), F.max(F.when(mark, F.col("pb"))).alias("phb")
    )
    turn = F.struct("pos", "a", "b", "n", "pa", "pb")
    bases = stored.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(turn)).alias("heads")
    )
    convs = owners.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(bases, "base", "left")
    kept = F.slice(F.coalesce("heads", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,n:bigint,pa:bigint,pb:bigint>>")), 1, F.col("h").cast("int"))
    zero = F.lit(0).cast("long")
    convs = convs.withColumn("heads", kept).withColumn("head", F.size("heads").cast("long"))
    convs = scratch.spool(
        convs.select(
            F.col("conv_id").alias("c"), "base", "h", "own", "head", "heads",
            (F.col("head") + F.greatest(F.col("own") - F.col("h"), zero)).alias("size"),
            F.coalesce("pha", zero).alias("pha"), F.coalesce("phb", zero).alias("phb"),
            F.coalesce(F.try_element_at("heads", F.lit(-1))["pa"], zero).alias("sha"),
            F.coalesce(F.try_element_at("heads", F.lit(-1))["pb"], zero).alias("shb"),
        )
    )
    firsts = convs.filter("head > 0").select("c", "base", "size", "heads", F.explode(F.sequence(F.lit(1).cast("long"), "head")).alias("d"))
    here, before = F.element_at("heads", F.col("d").cast("int")), F.try_element_at("heads", F.greatest(F.col("d") - 1, F.lit(1)).cast("int"))
    previous = [F.when(F.col("d") == 1, zero).otherwise(before[p]) for p in ("pa", "pb")]
    firsts = firsts.select(
        "c", "d", here["pa"].alias("sa"), here["pb"].alias("sb"), previous[0].alias("qa"), previous[1].alias("qb"),
        here["a"].alias("a"), here["b"].alias("b"), here["n"].alias("n"), (F.col("d") == F.col("size")).alias("last"),
        F.col("base").alias("ref_conv"), (F.col("d") - 1).alias("ref_pos"),
    )

    # a conversation of very many turns is joined block by block
    last = F.floor((F.col("own") - 1) / F.lit(SPAN)).cast("long")
    by_block = convs.filter("own > h").drop("base", "heads").withColumn("block", F.explode(F.sequence(zero, last)))
    own = stored.withColumnRenamed("conv_id", "c").withColumn("block", _block("pos")).join(by_block, ["c", "block"])
    own = own.filter("pos >= h").select("c", "h", "head", "size", "pha", "phb", "sha", "shb", "pos", "a", "b", "n", "pa", "pb")
    rests = own.mapInArrow(_behind_heads, REBUILT)
    return scratch.spool(firsts.unionByName(rests)), convs.select("c", "size")


def _behind_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns from position h on, their products shifted behind the head's."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pos, h, head = (batch.column(c).to_numpy() for c in ("pos", "h", "head"))
        depth = head + pos - h + 1
        out = {"c": batch.column("c"), "d": depth}
        for k, x in enumerate("ab"):
            base = BASES[k]
            shift = powers(base, head - h)
            at = _unsigned(batch, f"sh{x}") + shift * (_unsigned(batch, f"p{x}") - _unsigned(batch, f"ph{x}"))
            out[f"s{x}"] = signed(at)
            out[f"q{x}"] = signed(at - _unsigned(batch, x) * powers(base, depth - 1))
        columns = {c: batch.column(c) for c in ("a", "b", "n")}
        names = ["c", "d", "sa", "sb", "qa", "qb"]
        yield pa.record_batch(
            {n: out[n] for n in names} | columns | {"last": depth == batch.column("size").to_numpy(), "ref_conv": batch.column("c"), "ref_pos": pos}
        )


def _nodes(paths: DataFrame) -> DataFrame:
    """Each distinct prefix with its least member, number of members and of ends, and what must be one."""
    one = [f(c).alias(f"{c}_{f.__name__}") for c in ("qa", "qb", "a", "b", "n") for f in (F.min, F.max)]
    return paths.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.min(F.struct("ref_conv", "ref_pos")).alias("ref"), *one,
    )


def _proved(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether equal fingerprints are equal sequences, by what the stored turns say."""
    texts = turns.select("a", "b", "role", "text").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    mixed = nodes.filter(" OR ".join(f"{c}_min <> {c}_max" for c in ("qa", "qb", "a", "b", "n")))
    return texts.isEmpty() and mixed.isEmpty()


def _summed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with the sums of their own path from below, and per conversation (c, first, saved, leaves)."""
    saved = ((F.col("n_convs") - 1) * F.col("n_min")).alias("saved")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf")
    valued = nodes.select(*NODE, "conv_id", "n_convs", "ref", F.col("qa_min").alias("qa"), F.col("qb_min").alias("qb"), saved, leaf, _block())
    blocks = valued.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.min("d").alias("first"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    below = blocks.select(
        "conv_id", "block", F.min("first").over(Window.partitionBy("conv_id")).alias("first"),
        *[F.coalesce(F.sum(c).over(deeper.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_below") for c in ("saved", "leaf")],
    )
    totals = blocks.groupBy(F.col("conv_id").alias("c")).agg(F.min("first").alias("first"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    up = Window.partitionBy("conv_id", "block").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    along = valued.join(below, ["conv_id", "block"])
    path = [(F.sum(c).over(up) + F.col(f"{c}_below")).alias(f"{c}_path") for c in ("saved", "leaf")]
    return along.select(*NODE, "conv_id", "n_convs", "ref", "qa", "qb", "first", *path), totals


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, c): the digest of the sorted, comma-joined numbers.

    The numbers are sorted and joined to pieces by range, so the one task that a digest needs by its
    definition only reads finished pieces, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in NODE])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts = np.unique(np.concatenate([[0], cuts, np.arange(0, batch.num_rows, PIECE)]))
            members = batch.column("c").to_pylist()
            joined = [",".join(map(str, members[i:j])) for i, j in zip(starts, [*starts[1:], len(members)], strict=True)]
            yield pa.record_batch({c: keys[k][starts] for k, c in enumerate(NODE)} | {"c": batch.column("c").take(pa.array(starts)), "ids": pa.array(joined, pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), r, strict=True)) for r in out], schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*now, state.hexdigest()), strict=True))], schema)

    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    node = ", ".join(f"{c} long" for c in NODE)
    order = [*NODE, "c"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, f"{node}, c long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digest, f"{node}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    ``conversations(conv_id, turn, role, text)``: turns in order of ``turn``, nulls first; of one
    turn by role, then by ``xxhash64(text)``. Repeated rows are turns; a null role or text is empty; rows
    without a conv_id are left out. Conversation c begins with the first h turns of conversation
    ``c - c % group``, ``h = crc32(c) % heads``, and goes on with its own after h. No conversations, no
    nodes. Besides the counts a node has ``ref``, the stored turn that ends it.
    """
    spark = conversations.sparkSession
    for seed in count():
        scratch = Scratch(spark, "prefix-trie")
        whole = stored_turns(conversations, seed)
        turns = scratch.spool(whole.drop("text"))
        paths, convs = rebuilt(scratch, turns, group, heads)
        nodes = scratch.spool(_nodes(paths))
        scratch.drop(turns)
        if _proved(whole, nodes):
            break
    summed, totals = _summed(nodes)
    summed, totals = scratch.spool(summed), scratch.spool(totals)

    # what the other members of a node bring, and its children
    above = totals.filter("first > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("first") - 1) / F.lit(SPAN)).cast("long"))))
    members = paths.select(*NODE, "c", _block()).join(above, ["c", "block"]).filter("d < first")
    brought = members.select(*NODE, "saved", "leaf", F.lit(0).cast("long").alias("n_children"))
    zero = F.lit(0).cast("long")
    below = nodes.filter("d > 1").select((F.col("d") - 1).alias("d"), F.col("qa_min").alias("sa"), F.col("qb_min").alias("sb"), zero.alias("saved"), zero.alias("leaf"), F.lit(1).cast("long").alias("n_children"))
    extra = brought.union(below).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in ("saved", "leaf", "n_children")])

    # only the first node of a conversation's own path has a parent with another least member
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("sa").alias("qa"), F.col("sb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    branches = summed.filter("d = first AND d > 1").join(parents, ["d", "qa", "qb"])
    least = convs.agg(F.min("c")).first()[0]
    others = summed.filter("d <> first OR d = 1").withColumn("parent_conv_id", F.when(F.col("d") == 1, F.lit(least)).otherwise(F.col("conv_id")))
    known = branches.unionByName(others).join(extra, NODE, "left")
    counted = known.select(
        *NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        (F.col("leaf_path") + F.coalesce("leaf", zero)).alias("n_leaves"), (F.col("saved_path") + F.coalesce("saved", zero)).alias("saved_tokens"), "ref",
    )
    children, leaves, saved = nodes.agg(
        F.count(F.when(F.col("d") == 1, 1)), F.sum((F.col("n_ends") == F.col("n_convs")).cast("long")), F.sum((F.col("n_convs") - 1) * F.col("n_min"))
    ).first()
    under = {"n_children": children, "n_leaves": leaves or 1, "saved_tokens": saved or 0}
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in NODE], "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        *[F.lit(v).cast("long").alias(c) for c, v in under.items()], F.lit(None).cast("struct<ref_conv:bigint,ref_pos:bigint>").alias("ref"),
    )
    turnless = convs.filter("size = 0").select(*[zero.alias(c) for c in NODE], "c")
    ends = paths.filter("last").select(*NODE, "c").unionAll(turnless)
    nothing = hashlib.sha256(b"").hexdigest()
    done = counted.unionByName(root).join(_digests(ends), NODE, "left")
    return done.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "ref",
    )


def op12_sql() -> str:
    step = "lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT))"
    rounds = "list_concat([xor(c, x)], list_transform(range(8), lambda z: 0::UBIGINT))"
    letters = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], {letters}), lambda c, x: list_reduce({rounds}, {step})), 4294967295::UBIGINT)"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, ({crc} % 6)::BIGINT AS h, conv_id - conv_id % {GROUP} AS base FROM s),
r AS (SELECT h.conv_id AS c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN s b ON b.conv_id = h.base),
p AS (SELECT c, d, md5(to_json(turns[1:d])) AS k, CASE WHEN d > 0 THEN md5(to_json(turns[1:d - 1])) END AS up,
             CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS n, d = len(turns) AS last
      FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(n) AS n, (count(*) = count(*) FILTER (last))::BIGINT AS leaf,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
      FROM p GROUP BY d, k),
u AS (SELECT p.d, p.k, sum(n.leaf)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.n)::BIGINT AS saved_tokens
      FROM n JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY p.d, p.k),
k AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN u USING (d, k) LEFT JOIN k USING (d, k) LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.up
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the head of its hundred's first."""
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).drop("ref")
