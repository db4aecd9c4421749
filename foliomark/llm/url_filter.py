"""URL rules: wildcard patterns packed into Shift-And masks and run over all URLs side by side.

Every position of every pattern is one bit of a row of 64-bit words. For each byte value a mask says
at which positions it may stand; ``*`` keeps the position before it alive. One step over a character
is a shift, an and and an or over the words, for all patterns at once and all URLs of a batch.

A URL is matched in canonical form: ``.host``, a zero byte, then the path; so the pattern
``*.example.com\\0/en/*`` is example.com with all subdomains and paths from /en/ on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.tables import map_batches, table
from foliomark.llm.words import slices, text_bytes

BLOCK_BYTES = 1 << 20

#: fixed values: the rules of the query, (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: for URLs without a rule: blocked if one of these fits, ``*`` any bytes, ``?`` one byte
BLOCKED = (
    "*casino*", "*cheap-*pills*", "*spam-*", "*.porn*", "*-porn*", "*free-money*", "*payday-loan*",
    "*/wp-login.php*", "*/cgi-bin/*", "*.exe", "*.apk", "*.torrent",
)


class ShiftAnd:
    """All patterns as one automaton. ``*`` stands for any bytes, ``?`` for one byte."""

    def __init__(self, patterns: Sequence[str]) -> None:
        parsed = []
        for pattern in patterns:
            chars: list[int | None] = []
            loops = set()  # how many characters are read before a star
            for b in pattern.encode():
                if b == ord("*"):
                    loops.add(len(chars))
                else:
                    chars.append(None if b == ord("?") else b)
            parsed.append((chars, loops))
        # a pattern of n characters has n + 1 states; state 0 is its begin
        size = sum(len(chars) + 1 for chars, _ in parsed)
        self.words = max(1, -(-size // 64))
        self.masks = np.zeros((256, self.words), dtype=np.uint64)
        self.begin, self.stay = (np.zeros(self.words, dtype=np.uint64) for _ in range(2))
        self.accept: list[tuple[int, np.uint64]] = []
        at = 0
        for chars, loops in parsed:
            self._set(self.begin, at)
            for k in loops:
                self._set(self.stay, at + k)
            for k, c in enumerate(chars, 1):
                for b in range(256) if c is None else (c,):
                    self._set(self.masks[b], at + k)
            at += len(chars)
            self.accept.append((at // 64, np.uint64(1 << (at % 64))))
            at += 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def run(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, patterns) booleans: does the pattern fit the whole text?"""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = offsets[:-1][order], sizes[order]
        state = np.tile(self.begin, (len(order), 1))
        for step in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.masks[raw[starts[:live] + step]]) | (now & self.stay)
        fits = np.empty((len(order), len(self.accept)), dtype=bool)
        for k, (word, bit) in enumerate(self.accept):
            fits[order, k] = (state[:, word] & bit) != 0
        return fits


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked: Sequence[str] = BLOCKED,
    key: str = "page_id",
) -> DataFrame:
    """``pages(key, url, ...)`` -> (key, host, path, rule, verdict), one row per row.

    Of the rules that fit, the one with the longest host and path wins, the first of equal ones. A
    URL without a rule is blocked if a pattern of ``blocked`` fits, else allowed. Null and URLs
    without ``://`` have empty host and path, and no rule. Other columns are left out.
    """
    patterns = [f"*.{host.lower()}\0{path}*" for _, host, path in rules] + list(blocked)
    ranks = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    names = [host + path for _, host, path in rules]

    def step():  # noqa: ANN202
        automaton = ShiftAnd(patterns)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "url", BLOCK_BYTES):
                yield verdicts(part, automaton)

        return each

    def verdicts(part: pa.RecordBatch, automaton: ShiftAnd) -> pa.RecordBatch:
        host, path = part.column("host"), part.column("path")
        # the zero byte between the two is the only one
        plain = [pc.replace_substring(x, "\0", "\1") for x in (host, path)]
        canonical = pc.binary_join_element_wise(pc.binary_join_element_wise(".", plain[0], ""), plain[1], "\0")
        fits = automaton.run(*text_bytes(canonical))
        rule = np.full(part.num_rows, -1)
        for k in reversed(ranks):
            rule[fits[:, k]] = k
        bad = fits[:, len(rules) :].any(axis=1)
        chosen = [rules[k][0] if k >= 0 else "block" if b else "allow" for k, b in zip(rule.tolist(), bad.tolist(), strict=True)]
        return pa.record_batch(
            {
                key: part.column(key),
                "host": host,
                "path": path,
                "rule": pa.array([names[k] if k >= 0 else None for k in rule.tolist()], pa.string()),
                "verdict": pa.array(chosen, pa.string()),
            }
        )

    url = F.col("url").cast("string")
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1))
    rest = F.substring_index(rest, "?", 1)
    at = F.instr(rest, "/")
    host = F.translate(F.when(at > 0, F.substr(rest, F.lit(1), at - 1)).otherwise(rest), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(at > 0, F.substr(rest, at)).otherwise("")
    parts = pages.select(key, url.alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    kind = dict(pages.dtypes)[key]
    return map_batches(parts, step, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the fixed rules, else by the blocked patterns."""
    return judged(table(spark, sf_dir, "pages", "page_id", "url"))


def _like(pattern: str) -> str:
    return pattern.replace("_", r"\_").replace("*", "%").replace("?", "_")


def op6_sql() -> str:
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

    def fits(host: str, path: str) -> str:
        return f"(u AND (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"

    rule = " ".join(f"WHEN {fits(host, path)} THEN '{host}{path}'" for _, host, path in cases)
    verdict = " ".join(f"WHEN rule = '{host}{path}' THEN '{kind}'" for kind, host, path in cases)
    bad = " OR ".join(f"('.' || host || chr(1) || path) LIKE '{_like(p)}' ESCAPE '\\'" for p in BLOCKED)
    return rf"""
WITH a AS (SELECT page_id, url, coalesce(contains(url, '://'), false) AS u,
                  CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS h, regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path FROM a),
c AS (SELECT page_id, u, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM b),
d AS (SELECT *, CASE {rule} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM d
"""
