"""Main text of pages by a site style tree.

The pages of a host are merged into one tree: an element node is a path of labels (name, class, id,
role) below the body, and a leaf is the text directly in an element. Two entropies tell template from
content, both in logarithms to the number m of pages that hold the node:

- presentation: an element whose children come in many different sequences matters, one that looks the
  same on all pages does not (the entropy of its child sequences);
- content: a leaf matters by how little its texts are shared between pages (one minus the mean entropy
  of its distinct texts over the pages; digits and the host's own name do not tell texts apart).

An element's importance mixes its own with that of its children on the page, own weight 1 - 0.9^styles.
A branch goes when it and everything below it is less important than ``LEAST``. Nodes that fewer than
``ENOUGH`` pages of the host hold are judged by the tree of all hosts, and where that has no more, kept.

Presentation that names its part needs no statistics: elements named as template (nav, footer, class
``comments``, ...) go, an article stays, and plain paragraphs in it are never judged. On pages with an
article, what is outside of it goes, but for the h1 before it in the same ``main``.

Only counts are shuffled, never pages. The importances of nodes on many pages, at most ``NEAR`` of
them, travel to all tasks; those of the rest, none of which can be a hot key, are joined by node.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.html_dom import ARTICLE, MAIN, NAMED, TEMPLATE, Page
from foliomark.llm.tables import map_batches, numbered, table
from foliomark.llm.words import slices
from foliomark.operators.spool import Scratch

GAMMA = 0.9
LEAST = 0.4
ENOUGH = 8
NEAR = 1 << 20
#: counted rows after which a task hands on what it has
HELD = 400_000

_DIGITS = re.compile(r"\d+")


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _long(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _features(page: Page, host: str) -> set[tuple[int, int]]:
    """(node, value) of a page: 0 for its presence, else a child sequence or a text."""
    found = {(path, 0) for path in page.path}
    found |= {(path, style | 1) for path, style in zip(page.path, page.style, strict=True) if not path & 1}
    for leaf, text in page.blocks:
        shown = _DIGITS.sub("#", text.replace(host, "@") if host else text)
        found.add((page.path[leaf], _hash(shown) | 1))
    return found


def _counted(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(site, node, value, n): on how many pages of a site the node has the value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = np.array([*held.keys()], dtype=np.uint64).reshape(-1, 3).view(np.int64)
            sums = np.fromiter(held.values(), dtype=np.int64, count=len(held))
            held.clear()
            return pa.record_batch({"site": rows[:, 0], "node": rows[:, 1], "value": rows[:, 2], "n": sums})

        for batch in batches:
            for part in slices(batch, "html"):
                for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    host = host_of(u)
                    site = _hash(host)
                    held.update((site, node, value) for node, value in _features(Page(h or ""), host))
                    if len(held) > HELD:
                        yield out()
        if held:
            yield out()

    texts = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = texts.mapInArrow(run, "site long, node long, value long, n long")
    return rows.groupBy("site", "node", "value").agg(F.sum("n").alias("n"))


def _importance(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, own, weight) of nodes that enough pages hold."""
    value, n = F.col("value") != 0, F.col("n").cast("double")
    stats = counts.groupBy(*keys).agg(
        F.max(F.when(~value, F.col("n"))).alias("m"),
        F.count(F.when(value, 1)).alias("l"),
        F.sum(F.when(value, n)).alias("total"),
        F.sum(F.when(value, n * F.log(n))).alias("n_log_n"),
        F.sum(F.when(value, F.log(n))).alias("logs"),
    ).filter(F.col("m") >= ENOUGH)
    size = F.log(F.col("m").cast("double"))
    leaf = F.col("node").bitwiseAND(F.lit(1)) == 1
    shown = (F.log("total") - F.col("n_log_n") / F.col("total")) / size
    own = F.when(F.col("l") == 0, 0.0).when(leaf, 1 - F.col("logs") / F.col("l") / size).otherwise(shown)
    weight = F.when(leaf, 1.0).otherwise(1 - F.pow(F.lit(GAMMA), F.col("l")))
    return stats.select(*keys, "m", own.cast("float").alias("own"), weight.cast("float").alias("weight"))


def _key() -> Column:
    return F.col("site").bitwiseXOR(F.col("node")).alias("key")


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(key, m, own, weight) of every node of every host that its host or all hosts together can judge.

    ``key`` is the host's hash xor the node's; ``m`` the pages of the host that hold it. Written once.
    """
    scratch = Scratch(pages.sparkSession, "site-tree")
    counts = scratch.spool(_counted(pages, url, html))
    sites = _importance(counts, "site", "node")
    anywhere = _importance(counts.groupBy("node", "value").agg(F.sum("n").alias("n")), "node").drop("m")
    few = counts.filter((F.col("value") == 0) & (F.col("n") < ENOUGH)).select("site", "node", F.col("n").alias("m")).join(anywhere, "node")
    judged = sites.select(_key(), "m", "own", "weight").unionAll(few.select(_key(), "m", "own", "weight"))
    out = Scratch(pages.sparkSession, "site-tree").spool(judged)
    scratch.drop(counts)
    return out


class Importances:
    """Own importance and its weight by node key; unknown nodes are important."""

    def __init__(self, keys: np.ndarray, own: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.own, self.weight = keys[order], own[order], weight[order]

    def of(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether it is known, own importance and weight of each wanted key."""
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.ones(len(wanted)), np.ones(len(wanted))
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return known, np.where(known, self.own[at], 1.0), np.where(known, self.weight[at], 1.0)


def _wanted(page: Page, host: str) -> np.ndarray:
    return (np.array(page.path, dtype=np.uint64) ^ np.uint64(_hash(host))).view(np.int64)


def _main_text(page: Page, known: np.ndarray, own: np.ndarray, weight: np.ndarray) -> str:
    """The texts of the branches that stay, in page order."""
    size = len(page.path)
    parent, role = page.parent, page.role
    template, article, main = ([False] * size for _ in range(3))
    articles = 0
    for k in range(1, size):
        p = parent[k]
        article[k] = article[p] or role[k] == ARTICLE and not template[p]
        articles += article[k] and not article[p]
        main[k] = main[p] or role[k] == MAIN
        template[k] = template[p] or role[k] == TEMPLATE or role[k] == NAMED
    if any(r == NAMED for r in role):
        # A class may name a part that is laid out around the article; then it is no such part.
        around = [0] * size
        for k in range(size - 1, 0, -1):
            around[k] += role[k] in (ARTICLE, MAIN)
            if role[k] != TEMPLATE:
                around[parent[k]] += around[k]
        for k in range(1, size):
            named = role[k] == NAMED and not (around[k] and around[k] == around[0])
            template[k] = template[parent[k]] or role[k] == TEMPLATE or named
            article[k] = article[parent[k]] or role[k] == ARTICLE and not template[k]
        articles = sum(article[k] and not article[parent[k]] for k in range(1, size))
    mains = any(main[k] and not template[k] for k in range(size))

    # importance bottom-up: children come after their parent
    best = np.zeros(size)
    sums, children = np.zeros(size), np.zeros(size)
    for k in range(size - 1, -1, -1):
        if page.path[k] & 1 and not known[k]:
            value = 0.0 if page.name[k] == "#links" and not article[k] and not main[k] else 1.0
        else:
            below = sums[k] / children[k] if children[k] else 0.0
            value = weight[k] * own[k] + (1 - weight[k]) * below
        if article[k] and page.plain[k]:
            value = 1.0
        best[k] = max(best[k], value)
        if k:
            p = parent[k]
            best[p] = max(best[p], best[k])
            sums[p] += value
            children[p] += 1

    kept = [not template[0]] * size
    for k in range(1, size):
        kept[k] = kept[parent[k]] and not template[k] and best[k] >= LEAST

    def chosen(stays: list[bool]) -> list[str]:
        out, begun = [], False
        for leaf, text in page.blocks:
            begun = begun or article[leaf]
            if articles:
                place = article[leaf] or main[leaf] and not begun and page.name[parent[leaf]] == "h1"
            else:
                place = main[leaf] or not mains
            if place and stays[leaf]:
                out.append(text)
        return out

    # Where statistics condemn every branch, they are those of a page that is all template or all copy.
    texts = chosen(kept) or chosen([not t for t in template])
    return "\n\n".join(texts)


def _near(tree: DataFrame, limit: int) -> tuple[Broadcast, DataFrame | None]:
    """Importances for all tasks, of the nodes on the most pages, and the table of the rest, if any."""
    sizes = tree.groupBy(F.floor(F.log2("m")).cast("int").alias("size")).count().orderBy(F.desc("size")).collect()
    total, least = 0, None
    for size, n in sizes:
        if total + n > limit:
            break
        total, least = total + n, size
    size = F.floor(F.log2("m")).cast("int")
    near = tree.filter(size >= least).select("key", "own", "weight").toArrow() if least is not None else None
    arrays = [near[c].to_numpy() if near is not None else np.zeros(0) for c in ("key", "own", "weight")]
    arrays[0] = arrays[0].astype(np.int64)
    rest = None if total == sum(n for _, n in sizes) else tree.filter(size < least) if least is not None else tree
    return tree.sparkSession.sparkContext.broadcast(arrays), rest


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", near: int = NEAR) -> DataFrame:
    """``key, url, text, n_chars``: the main text of every page.

    Null html is an empty page, a null or odd url the host ''. White space is what Unicode calls so
    (the no-break space too); cells of a table row are parted by a space. Pages without main text
    have the empty text. Repeated rows count as pages and give a row each.
    """
    spark = pages.sparkSession
    shared, rest = _near(style_tree(pages, url, html), near)
    kind = dict(pages.dtypes)[key]
    texts = pages.select(
        F.col(key).alias("_key"), F.col(url).alias("_shown"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    far = rest is not None
    if far:
        texts = _with_rest(Scratch(spark, "site-pages").spool(numbered(texts)), rest)

    def step():  # noqa: ANN202
        everywhere = Importances(*shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "html"):
                out = []
                own_nodes = part.column("nodes").to_pylist() if far else [None] * part.num_rows
                for u, h, nodes in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), own_nodes, strict=True):
                    page = Page(h or "")
                    wanted = _wanted(page, host_of(u))
                    known, own, weight = everywhere.of(wanted)
                    if nodes:
                        few = Importances(*(np.array([n[c] for n in nodes]) for c in ("key", "own", "weight")))
                        more, own_few, weight_few = few.of(wanted)
                        known, own, weight = known | more, np.where(more, own_few, own), np.where(more, weight_few, weight)
                    out.append(_main_text(page, known, own, weight))
                yield pa.record_batch({"_key": part.column("_key"), "_shown": part.column("_shown"), "text": pa.array(out, pa.string())})

        return each

    shown = dict(pages.dtypes)[url]
    found = map_batches(texts, step, f"_key {kind}, _shown {shown}, text string")
    return found.select(F.col("_key").alias(key), F.col("_shown").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def _with_rest(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """Numbered pages with the importances of those of their nodes that did not travel to all tasks."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "html"):
                keys = [np.unique(_wanted(Page(h or ""), host_of(u))) for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)]
                ids = np.repeat(part.column("row_id").to_numpy(), [len(k) for k in keys])
                yield pa.record_batch({"row_id": ids, "key": np.concatenate(keys)})

        return each

    needed = map_batches(rows.select("row_id", "url", "html"), step, "row_id long, key long")
    found = needed.join(rest.select("key", "own", "weight"), "key")
    by_page = found.groupBy("row_id").agg(F.collect_list(F.struct("key", "own", "weight")).alias("nodes"))
    return rows.join(by_page, "row_id", "left").drop("row_id")


def op11_sql() -> str:
    """The article's paragraphs and headings as the given pages have them; other pages are left to the tests."""
    return r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'),
        lambda x: regexp_replace(replace(regexp_replace(x, '</?b>', '', 'g'), '<br>', ' '), '\s+', ' ', 'g')) AS blocks FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(
        replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, coalesce(array_to_string(blocks, chr(10) || chr(10)), '') AS text,
       length(coalesce(array_to_string(blocks, chr(10) || chr(10)), '')) AS n_chars FROM c
"""


def op11_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
