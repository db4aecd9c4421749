"""Greedy packing of paragraph rows into chunks, for documents that no row can hold.

Which paragraph opens the next chunk after one that begins at s depends on s alone: it is the first j
behind s with ``size(s..j) > limit``. So every paragraph gets a pointer, found by a range search over sums
of sizes, and the chunks of a document are the paragraphs reached from its first one. That path is
followed inside runs of paragraphs by one task each, for every place a run can be entered at; from run to
run it is found by pointer doubling, in a logarithm of the number of runs. No step folds over a
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomark.functions.chunks import BREAK, CHUNK_LIMIT
from foliomark.operators.ordered import ordered_concat
from foliomark.operators.scans import Running, running
from foliomark.operators.spool import Scratch
from foliomark.operators.unnest import unnest

# Paragraphs of one run.
SPAN = 1 << 14


def paragraph_rows(lines: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``doc_id, para_no, paragraph`` of ``doc_id, line_no, line``: the text cut at every pair of newlines.

    Pairs are taken from left to right, so of a run of empty lines every second one is a break: the
    lines behind a break begin the next paragraph, whatever they hold.
    """
    scratch = Scratch(lines.sparkSession, "paragraphs")
    stored = scratch.spool(lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line")))
    # a break is a newline pair: line i is empty and neither the first nor the last one of its document;
    # in a run of empty lines the 1st, 3rd, ... are breaks, each using up the newlines around it
    empty = F.col("line") == ""
    filled = Running("filled_at", F.when(~empty | (F.col("line_no") == 0), F.col("line_no")))
    near = running(stored, "doc_id", ["line_no"], [filled, Running("next", F.lit(True), after=True)], span)
    nth = F.col("line_no") - F.col("filled_at")
    broken = empty & (F.col("line_no") > 0) & F.col("next").isNotNull() & (nth % 2 == 1)
    marked = scratch.spool(near.select("doc_id", "line_no", "line", F.coalesce(broken, F.lit(False)).alias("breaks")))
    counted = running(marked, "doc_id", ["line_no"], [Running("para_no", F.col("breaks").cast("long"), "sum")], span)
    rows = ordered_concat(counted.where("NOT breaks"), ["doc_id", "para_no"], "line_no", "line", "\n")
    return rows.withColumnRenamed("line", "paragraph")


def chunk_heads(sizes: DataFrame, limit: int, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, para_no``: the paragraphs that open a chunk, of ``doc_id, para_no, size`` without gaps from 0."""
    scratch = scratch or Scratch(sizes.sparkSession, "chunk-heads")
    stored = scratch.spool(sizes.select("doc_id", F.col("para_no").cast("long").alias("para_no"), F.col("size").cast("long").alias("size")))
    summed = scratch.spool(running(stored, "doc_id", ["para_no"], [Running("before", F.col("size"), "sum")], span))
    scratch.drop(stored)

    # a search from s is answered by the first end of a paragraph behind before(s) + limit
    before, end = F.col("before"), F.col("before") + F.col("size")
    asks = summed.select("doc_id", (before + limit).alias("at"), F.lit(1).alias("kind"), "para_no")
    ends = summed.select("doc_id", end.alias("at"), F.lit(0).alias("kind"), "para_no")
    events = scratch.spool(asks.unionByName(ends))
    scratch.drop(summed)
    found = Running("end_of", F.when(F.col("kind") == 0, F.col("para_no")), after=True)
    answered = running(events, "doc_id", ["at", "kind", "para_no"], [found], max(1, span) * 8)
    # a paragraph larger than the limit is a chunk of its own
    following = F.greatest(F.col("end_of"), F.col("para_no") + 1)
    last = F.col("end_of").isNull()
    run = F.floor(F.col("para_no") / F.lit(span)).cast("long").alias("run")
    pointers = answered.where("kind = 1").select("doc_id", run, F.struct("para_no", F.when(~last, following).alias("next")).alias("p"))
    # a run is one row, so that what follows paths in it has no cost for each group
    paras = pointers.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list("p")).alias("p"))
    runs = scratch.spool(paras.select("doc_id", "run", F.col("p.para_no").alias("paras"), F.col("p.next").alias("nexts")))
    scratch.drop(events)

    # where a path that is at a paragraph leaves the paragraph's run; none does in the last run of a document
    dense = F.size("paras") == F.array_max("paras") - F.array_min("paras") + 1
    inside = dense & (F.coalesce(F.array_max("nexts"), F.lit(0)) <= F.array_max("paras"))
    exits = F.udf(_exits, "array<bigint>", useArrow=False)(F.col("paras"), F.col("nexts"))
    left = unnest(runs.where(~inside), ["doc_id"], F.arrays_zip(F.col("paras").alias("para_no"), exits.alias("next")), "x")
    jumps = scratch.spool(left.where("x.next IS NOT NULL").select("doc_id", "x.para_no", "x.next"))
    reached = scratch.spool(unnest(runs, ["doc_id"], F.filter("paras", lambda p: p == 0), "para_no"))
    n = reached.count()
    while True:
        steps = reached.join(jumps, ["doc_id", "para_no"]).select("doc_id", F.col("next").alias("para_no"))
        more = scratch.spool(reached.unionByName(steps).distinct())
        now = more.count()
        if now == n:
            break
        twice = jumps.join(jumps.select("doc_id", F.col("para_no").alias("next"), F.col("next").alias("then")), ["doc_id", "next"])
        doubled = scratch.spool(twice.select("doc_id", "para_no", F.col("then").alias("next")))
        scratch.drop(reached, jumps)
        reached, jumps, n = more, doubled, now
    entries = more.groupBy("doc_id", run).agg(F.collect_list("para_no").alias("entries"))
    path = F.udf(_path, "array<bigint>", useArrow=False)(F.col("paras"), F.col("nexts"), F.col("entries"))
    return scratch.spool(unnest(runs.join(entries, ["doc_id", "run"]), ["doc_id"], path, "para_no"))


def _exits(paras: list[int], nexts: list[int | None]) -> list[int | None]:
    """For every paragraph of a run the first one behind the run on its path; null where the path ends."""
    begin, out = paras[0], list(nexts)
    for k in range(len(out) - 1, -1, -1):
        if nexts[k] is not None and nexts[k] - begin < len(out):
            out[k] = out[nexts[k] - begin]
    return out


def _path(paras: list[int], nexts: list[int | None], entries: list[int]) -> list[int]:
    """The paragraphs of a run on the paths that enter it."""
    begin, entered = paras[0], set(entries)
    on = [p in entered for p in paras]
    for k, x in enumerate(nexts):
        if on[k] and x is not None and x - begin < len(on):
            on[x - begin] = True
    return [p for p, there in zip(paras, on, strict=True) if there]


def pack_paragraphs(paragraphs: DataFrame, limit: int = CHUNK_LIMIT, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, chunk_no, chunk`` of ``doc_id, para_no, paragraph``: the chunks ``chunk_pack`` gives for the whole text.

    Paragraphs are numbered from 0 without gaps; a null one is empty. ``doc_id`` is not null. What is
    written on the way belongs to ``scratch``.
    """
    scratch = scratch or Scratch(paragraphs.sparkSession, "long-chunks")
    text = F.coalesce("paragraph", F.lit(""))
    rows = paragraphs.select("doc_id", F.col("para_no").cast("long").alias("para_no"), text.alias("paragraph"))
    sizes = rows.select("doc_id", "para_no", (F.char_length("paragraph") + len(BREAK)).cast("long").alias("size"))
    heads = chunk_heads(sizes, limit, span, scratch).withColumn("head", F.lit(1).cast("long"))
    marked = scratch.spool(rows.join(heads, ["doc_id", "para_no"], "left"))
    # a head counts itself
    counted = running(marked, "doc_id", ["para_no"], [Running("heads", F.col("head"), "sum")], span)
    chunk_no = F.col("heads") + F.coalesce("head", F.lit(0)) - 1
    return ordered_concat(counted.withColumn("chunk_no", chunk_no), ["doc_id", "chunk_no"], "para_no", "paragraph", BREAK).withColumnRenamed("paragraph", "chunk")
