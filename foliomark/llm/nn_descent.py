"""Near-duplicate vectors by NN-descent.

Equal vectors are one node with a weight. Nodes meet first in the cells of a few random-hyperplane
partitions, which gives every node a list of neighbours. Then each round joins the neighbours of a
node, in both directions, with each other and keeps the best of each list. A list whose entries all
reach the threshold is saturated and may grow, twice as far each round. The nodes that list a node
are joined in parts of bounded size, none is left out. Rounds end when they link no further node
and add hardly any pair of the threshold.

The pairs found give components. Inside a component all pairs are compared, in square blocks that
emit sums per node and never pairs, so a saturated list in the end is its whole component. Finally a
bounded sample of nodes of each degree class is compared with all vectors; if too many nodes of any
class miss a link, new partitions and rounds follow, and in the end an error that names the recall.
The deeper the partitions, the more there are of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomark.llm.tables import components, group_bounds, map_batches, map_groups, numbered, table
from foliomark.operators.spool import Scratch

THRESHOLD = 0.95
NEIGHBOURS = 8
TREES = 6
CELL = 128
BLOCK = 512
ROUNDS = 6
STOP_SHARE = 0.01
AUDIT_NODES = 1024
#: the least degrees of the classes of linked nodes
DEGREES = (1, 4, 32)
AUDIT_RECALL = 0.98
AUDITS = 12
#: the share of pairs at the threshold that may share no cell of one set of partitions
MISSED = 0.01
SEED = 7


def unit_rows(packed: pa.Array, dtype: str) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    raw = b"".join(packed.to_pylist())
    rows = np.frombuffer(raw, dtype=dtype).reshape(len(packed), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def packed_rows(vectors: DataFrame, dtype: str) -> DataFrame:
    """(row_id, vec_id, packed): the components as bytes, null where a vector can link with nothing."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for row in batch.column("embedding").to_pylist():
                v = np.array([np.nan if x is None else x for x in row], dtype=dtype) if row else np.zeros(0, dtype=dtype)
                good = len(v) > 0 and np.isfinite(v).all() and v.any()
                out.append((v + 0).tobytes() if good else None)  # -0 becomes 0
            yield pa.record_batch({"row_id": batch.column("row_id"), "vec_id": batch.column("vec_id"), "packed": pa.array(out, pa.binary())})

        return each

    return map_batches(vectors, step, f"row_id long, vec_id {dict(vectors.dtypes)['vec_id']}, packed binary")


def _pairs(us: np.ndarray, vs: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64()), "sim": pa.array(sims, pa.float64())})


PAIRS = "u long, v long, sim double"


def partitions(depth: int, threshold: float) -> int:
    """So many that a pair at the threshold shares a cell in one of them, but for a share of ``MISSED``."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** depth
    return 1 if together >= 1 else int(np.ceil(np.log(MISSED) / np.log1p(-together)))


def cells(nodes: DataFrame, trees: int, depth: int, dtype: str, seed: int) -> DataFrame:
    """(node, packed, cell): each node once per partition; large cells are split at random."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lengths = pc.binary_length(batch.column("packed")).to_numpy()
            for length in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == length))
                rows = unit_rows(some.column("packed"), dtype)
                rng = np.random.default_rng([seed, length])
                for tree in range(trees):
                    planes = rng.standard_normal((rows.shape[1], max(1, depth)))
                    code = ((rows @ planes > 0) @ (1 << np.arange(max(1, depth)))) if depth else np.zeros(len(rows), np.int64)
                    yield pa.record_batch({"node": some.column("node"), "tree": pa.array([tree] * len(rows), pa.int32()), "length": pa.array([length] * len(rows), pa.int64()), "code": pa.array(code, pa.int64())})

        return each

    found = map_batches(nodes.select("node", "packed"), step, "node long, tree int, length long, code long")
    sizes = found.groupBy("tree", "length", "code").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / BLOCK))
    placed = found.join(sizes, ["tree", "length", "code"]).select("node", F.xxhash64("tree", "length", "code", part).alias("cell"))
    return placed.join(nodes.select("node", "packed"), "node")


def neighbours_in_cells(placed: DataFrame, k: int, dtype: str) -> DataFrame:
    """The ``k`` nearest of each node in its cell."""

    def each(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, bounds = rows["node"].to_numpy(), group_bounds(rows["cell"].to_numpy())
        packed = rows["packed"].combine_chunks()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2 or len(packed[int(a)].as_py()) != len(packed[int(b) - 1].as_py()):
                continue
            unit = unit_rows(packed[a:b], dtype)
            sims = unit @ unit.T
            np.fill_diagonal(sims, -2)
            most = min(k, b - a - 1)
            best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
            yield _pairs(np.repeat(nodes[a:b], most), nodes[a:b][best].ravel(), np.take_along_axis(sims, best, 1).ravel())

    return map_groups(placed, "cell", each, PAIRS)


def best_lists(pairs: DataFrame, k: int, longest: int, threshold: float) -> DataFrame:
    """Each node's ``k`` best entries, and up to ``longest`` of those that reach the threshold."""
    once = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    kept = (F.col("rank") <= k) | ((F.col("rank") <= longest) & (F.col("sim") >= threshold))
    return once.withColumn("rank", rank).filter(kept)


def joined_neighbours(lists: DataFrame, nodes: DataFrame, k: int, dtype: str) -> DataFrame:
    """Pairs of neighbours of one node, one of them new, that would enter one of their lists."""
    # a node's list meets a part of the nodes that list it; further parts meet the best of its list
    hubs = lists.groupBy("v").agg(F.ceil(F.count("*") / (2 * k)).cast("int").alias("parts"))
    reverse = lists.join(hubs, "v").select("v", "u", "fresh", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    again = lists.filter(F.col("rank") <= 2 * k).join(hubs.filter("parts > 1").select(F.col("v").alias("u"), "parts"), "u")
    again = again.select("u", F.col("v").alias("w"), "fresh", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("part"))
    both = lists.select("u", F.col("v").alias("w"), "fresh", F.lit(0).alias("part")).union(again).union(reverse)
    both = both.groupBy(F.xxhash64("u", "part").alias("u"), "w").agg(F.max("fresh").alias("fresh"))
    worst = lists.groupBy(F.col("u").alias("w")).agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    rows = both.join(worst, "w").join(nodes.select(F.col("node").alias("w"), "packed"), "w")

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = group_bounds(table["u"].to_numpy())
        others, fresh = table["w"].to_numpy(), table["fresh"].to_numpy()
        least = table["worst"].to_numpy()
        unit = unit_rows(table["packed"].combine_chunks(), dtype)
        us, vs, sims = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2 or not fresh[a:b].any():
                continue
            sim = unit[a:b] @ unit[a:b].T
            enters = (sim > least[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b])
            np.fill_diagonal(enters, False)
            i, j = np.nonzero(enters)
            us.append(others[a + i]), vs.append(others[a + j]), sims.append(sim[i, j])
        if us:
            yield _pairs(np.concatenate(us), np.concatenate(vs), np.concatenate(sims))

    def by_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # neighbours always have one length; different nodes' may differ
        lengths = pc.binary_length(table["packed"])
        for length in pc.unique(lengths).to_pylist():
            yield from each(table.filter(pc.equal(lengths, length)))

    return map_groups(rows, "u", by_length, PAIRS)


def links_inside(members: DataFrame, threshold: float, dtype: str) -> DataFrame:
    """(node, links, others): weights and number of the other nodes of its component that reach the threshold.

    ``members(root, node, packed, n)``. A component of s nodes is cut into s / BLOCK parts, and
    each pair of parts is a block of its own.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.join(sizes, "root").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = met.select(F.xxhash64("root", low, high).alias("block"), "node", "packed", "n", (F.col("part") == low).alias("left"), (F.col("part") == high).alias("right"))

    def each(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, n = table["node"].to_numpy(), table["n"].to_numpy()
        left, right = table["left"].to_numpy(), table["right"].to_numpy()
        unit = unit_rows(table["packed"].combine_chunks(), dtype)
        bounds = group_bounds(table["block"].to_numpy())
        out_nodes, out_links, out_others = [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            near = unit[a:b] @ unit[a:b].T >= threshold
            np.fill_diagonal(near, False)
            # in a block of two parts only pairs of both count; else all
            if not left[a:b].all() or not right[a:b].all():
                near &= left[a:b, None] != left[None, a:b]
            out_nodes.append(nodes[a:b]), out_links.append(near @ n[a:b]), out_others.append(near.sum(axis=1))
        columns = {"links": np.concatenate(out_links), "others": np.concatenate(out_others)}
        yield pa.record_batch({"node": pa.array(np.concatenate(out_nodes)), **{name: pa.array(x, pa.int64()) for name, x in columns.items()}})

    def by_length(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lengths = pc.binary_length(table["packed"])
        for length in pc.unique(lengths).to_pylist():
            yield from each(table.filter(pc.equal(lengths, length)))

    return map_groups(rows, "block", by_length, "node long, links long, others long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def audit(nodes: DataFrame, found: DataFrame, threshold: float, dtype: str, seed: int) -> float:
    """Least share, over classes of the true degree, of linked nodes whose links are all in ``found(node, others)``.

    At most ``AUDIT_NODES`` nodes of each class of the found degree, and of those without a link, are
    compared with all. Each stands for its share of its class; copies are one node and links count alike.
    """
    have = F.coalesce("others", F.lit(0))
    known = nodes.select("node", "packed").join(found.select("node", "others"), "node", "left").select("node", "packed", have.alias("have"))
    known = known.withColumn("class", sum((F.col("have") >= least).cast("int") for least in DEGREES))
    sizes = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}
    if not sizes:
        return 1.0
    asked_of = [known.filter(F.col("class") == c).orderBy(F.xxhash64("node", F.lit(seed))).limit(AUDIT_NODES) for c in sorted(sizes)]
    sample = reduce(DataFrame.union, asked_of).toArrow().combine_chunks()
    held = nodes.sparkSession.sparkContext.broadcast(sample.select(["node", "packed"]))

    def step():  # noqa: ANN202
        asked = held.value.combine_chunks()
        asked_length = pc.binary_length(asked["packed"])

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lengths = pc.binary_length(batch.column("packed"))
            for length in pc.unique(lengths).to_pylist():
                some, few = batch.filter(pc.equal(lengths, length)), asked.filter(pc.equal(asked_length, length))
                if not few.num_rows:
                    continue
                few_rows, few_nodes = unit_rows(few["packed"].combine_chunks(), dtype), few["node"].to_numpy()
                true = np.zeros(few.num_rows, dtype=np.int64)
                for at in range(0, some.num_rows, AUDIT_NODES):
                    part = some.slice(at, AUDIT_NODES)
                    near = few_rows @ unit_rows(part.column("packed"), dtype).T >= threshold
                    true += (near & (few_nodes[:, None] != part.column("node").to_numpy()[None, :])).sum(axis=1)
                yield pa.record_batch({"node": few["node"].combine_chunks(), "true": pa.array(true, pa.int64())})

        return each

    counted = map_batches(nodes.select("node", "packed"), step, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    true_of = {r["node"]: r["true"] for r in counted.collect()}
    true = np.array([true_of.get(node, 0) for node in sample["node"].to_pylist()])
    classes, all_found = sample["class"].to_numpy(), sample["have"].to_numpy() >= true
    stands_for = np.array([sizes[c] for c in classes.tolist()]) / np.bincount(classes)[classes]
    degree = np.searchsorted(DEGREES, true, side="right")
    of = [degree == c for c in np.unique(degree[true > 0])]
    return min((float(stands_for[x & all_found].sum() / stands_for[x].sum()) for x in of), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """``vectors(vec_id, embedding, ...)`` -> (vec_id, n_links, component_id, kept), one row per row.

    Two vectors of one length link if their cosine is at least ``threshold``. Null, empty and zero
    vectors and those with null or non-finite components link with nothing. Equal vectors link with
    each other. Repeated vec_ids are different vectors; a null vec_id is in no minimum and not kept.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nn-descent")
    kind = dict(vectors.dtypes)["embedding"]
    dtype = "<f4" if kind == "array<float>" else "<f8"
    rows = scratch.spool(packed_rows(numbered(vectors.select("vec_id", F.col("embedding"))), dtype))
    good = rows.filter("packed is not null")
    nodes = scratch.spool(good.groupBy("packed").agg(F.min("row_id").alias("node"), F.min("vec_id").alias("first_id"), F.count("*").alias("n")))
    total = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / CELL)))))
    trees = max(trees, partitions(depth, threshold))
    lists, roots, links = None, None, None
    for turn in range(AUDITS):
        longest = 2 * k
        met = neighbours_in_cells(cells(nodes, trees, depth, dtype, seed + turn), k, dtype).withColumn("fresh", F.lit(True))
        met = met if lists is None else lists.select("u", "v", "sim", "fresh").union(met)
        lists = _respooled(scratch, best_lists(met, k, longest, threshold), lists)
        linked, reached = _reached(lists, threshold)
        for _ in range(ROUNDS):
            old = lists.select("u", "v", "sim", F.lit(False).alias("fresh"))
            new = joined_neighbours(lists, nodes, k, dtype).withColumn("fresh", F.lit(True))
            longest *= 2
            lists = _respooled(scratch, best_lists(old.union(new), k, longest, threshold), lists)
            linked_before, before = linked, reached
            linked, reached = _reached(lists, threshold)
            if linked == linked_before and reached - before <= STOP_SHARE * before:
                break
        near = lists.filter(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        # what earlier turns linked stays linked, though its entries may have left the lists
        near = near if roots is None else near.union(roots.select("node", "root"))
        roots = scratch.spool(components(scratch, near))
        members = roots.join(nodes.select("node", "packed", "n"), "node")
        links = scratch.spool(links_inside(members, threshold, dtype))
        recall = audit(nodes, links, threshold, dtype, seed + turn)
        if recall >= AUDIT_RECALL:
            break
    else:
        raise RuntimeError(f"nn-descent: after {AUDITS} turns the audit measured a recall of {recall:.4f}, below {AUDIT_RECALL}")
    least = roots.join(nodes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = nodes.join(roots, "node", "left").join(least, "root", "left").join(links, "node", "left")
    known = known.select(
        "packed",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "first_id").alias("component_id"),
    )
    out = rows.join(known, "packed", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _reached(lists: DataFrame, threshold: float) -> tuple[int, int]:
    """How many nodes have an entry that reaches the threshold, and how many entries do."""
    per_node = lists.filter(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n"))
    return tuple(per_node.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first())


def _respooled(scratch: Scratch, df: DataFrame, old: DataFrame | None) -> DataFrame:
    new = scratch.spool(df)
    if old is not None:
        scratch.drop(old)
    return new


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings compared by cosine, linked at 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_sql() -> str:
    return """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (
  WITH RECURSIVE r(a, root) USING KEY (a) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT l.b, min(r.root) FROM r JOIN l ON l.a = r.a JOIN recurring.r AS k ON k.a = l.b WHERE r.root < k.root GROUP BY l.b)
  SELECT * FROM r)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.root AS component_id, c.root = e.vec_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
