"""Markdown headers inside a text: keys, duplicates, levels.

A text is cut at its headers into segments (header line + the lines below it; the first one
may be a preamble), so the arrays handled here have one element per header, not per line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomark.functions.text import (
    WHITESPACE,
    WS,
    WS_INLINE,
    after_first_line,
    first_line,
    is_blank,
    let,
    lines_of,
    on_lines,
    shifted,
)

# Fixed value: a header seen this often in a document is a running page header.
RUNNING_MIN = 3

HEADER = rf"#{{1,6}}[{WS_INLINE}]+(?!\z)"
LEVEL = rf"#{{1,6}}[{WS}]"


def is_header(line: Column) -> Column:
    return line.rlike(f"^{HEADER}")


def header_key(line: Column) -> Column:
    """Comparison key of a header line: no hashes, marks or whitespace, upper case.

    The hashes of a header end at a blank, so trimming them takes exactly the header mark.
    """
    bare = F.ltrim(line, F.lit("#"))
    return F.upper(F.translate(bare, "*_`" + WHITESPACE, ""))


def header_lines(lines: Column) -> Column:
    """``array<struct<i, k>>``: position and key of every header line."""

    def entry(line: Column, i: Column) -> Column:
        # Only a line that starts with a hash meets the regular expression.
        found = line.startswith("#") & is_header(line)
        return F.when(found, F.struct(i.alias("i"), header_key(line).alias("k")))

    return F.filter(F.transform(lines, entry), lambda e: e.isNotNull())


def header_keys(text: Column) -> Column:
    """Keys of all header lines of a text, in order."""
    return F.transform(header_lines(lines_of(text)), lambda e: e["k"])


def header_segments(lines: Column, headers: Column) -> Column:
    """``array<struct<text, k>>``: the lines cut before every header; at least one header.

    A preamble comes first with a null key. Joined by newlines the segments are the text.
    """
    preamble = F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("k")))
    starts = F.when(F.get(headers, F.lit(0))["i"] == 0, headers).otherwise(
        F.concat(preamble, headers)
    )

    def cut(starts: Column) -> Column:
        positions = F.transform(starts, lambda e: e["i"])
        ends = shifted(positions, -1, F.size(lines))

        def segment(start: Column, end: Column) -> Column:
            own = F.slice(lines, start["i"] + 1, end - start["i"])
            return F.struct(F.array_join(own, "\n").alias("text"), start["k"].alias("k"))

        return F.zip_with(starts, ends, segment)

    return let(starts, cut)


def occurrences(keys: Column, at_least: int) -> Column:
    """Per key, in order: ``struct(often, again)``.

    ``often``: the key occurs ``at_least`` times; ``again``: an equal key came before. Sorts
    (key, position) and looks at sorted neighbours, so it is n log n however often a key
    repeats. Null keys are never often. ``at_least`` is a small constant.
    """
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    offsets = [o for o in range(1 - at_least, at_least) if o]

    def verdict(z: Column) -> Column:
        same = {o: z[f"o{j}"] == z["e"]["k"] for j, o in enumerate(offsets)}
        # Equal keys are adjacent: some window of at_least places must hold this entry.
        often = F.lit(False)
        for lo in range(1 - at_least, 1):
            window = F.lit(True)
            for o in range(lo, lo + at_least):
                window = window & same[o] if o else window
            often = often | window
        return F.struct(
            z["e"]["i"].alias("i"),
            F.coalesce(often, F.lit(False)).alias("often"),
            F.coalesce(same[-1], F.lit(False)).alias("again"),
        )

    def flag(entries: Column) -> Column:
        def with_sorted(sorted_keys: Column) -> Column:
            null = F.lit(None).cast("string")
            near = [shifted(sorted_keys, -o, null) for o in offsets]
            names = ",".join(f"o{j}:string" for j in range(len(offsets)))
            zipped = F.arrays_zip(entries, *near).cast(
                f"array<struct<e:struct<k:string,i:int>,{names}>>"
            )
            return F.transform(zipped, verdict)

        return let(F.transform(entries, lambda e: e["k"]), with_sorted)

    return F.sort_array(let(placed, flag))


def _drop_flagged(segments: Column, flags: Column) -> Column:
    """Text of the segments without the header line of the flagged ones."""
    kept = F.zip_with(
        segments, flags, lambda s, drop: F.when(drop, after_first_line(s)).otherwise(s)
    )
    # A flagged header without lines below leaves nothing, not an empty line.
    return F.array_join(F.filter(kept, lambda s: s.isNotNull()), "\n")


def _running_flags(keys: Column) -> Column:
    seen = occurrences(keys, RUNNING_MIN)
    flags = F.transform(seen, lambda s: s["often"] & s["again"])
    # A running key leaves at least this many fewer distinct keys than keys.
    enough = F.size(keys) - F.size(F.array_distinct(keys)) >= RUNNING_MIN - 1
    return F.when(enough, flags).otherwise(F.array_repeat(F.lit(False), F.size(keys)))


def _consecutive_flags(segments: Column, keys: Column) -> Column:
    """True where the key equals the key before and only blank lines are between."""
    null = F.lit(None).cast("string")
    zipped = F.arrays_zip(keys, shifted(keys, 1, null), shifted(segments, 1, null)).cast(
        "array<struct<k:string,pk:string,ps:string>>"
    )

    def flag(z: Column) -> Column:
        # The body is looked at only when the keys agree.
        again = (z["k"] != "") & (z["k"] == z["pk"])
        body = F.coalesce(after_first_line(z["ps"]), F.lit(""))
        return F.coalesce(again & is_blank(body), F.lit(False))

    return F.transform(zipped, flag)


def _on_repeats(text: Column, step) -> Column:
    """Apply ``step(segments, keys)`` when some key repeats; else the text is left alone."""

    def with_lines(lines: Column) -> Column:
        def with_headers(headers: Column) -> Column:
            keys = F.transform(headers, lambda e: e["k"])
            repeated = F.size(F.array_distinct(keys)) < F.size(keys)

            def with_segments(cut: Column) -> Column:
                texts = F.transform(cut, lambda s: s["text"])
                keys = F.transform(cut, lambda s: s["k"])
                return let(texts, lambda t: let(keys, lambda k: step(t, k)))

            return F.when(repeated, let(header_segments(lines, headers), with_segments)).otherwise(
                text
            )

        return let(header_lines(lines), with_headers)

    return F.when(has_hash_line(text), let(lines_of(text), with_lines)).otherwise(text)


def keep_first_running(text: Column) -> Column:
    """Of every header seen ``RUNNING_MIN`` times or more keep the first, whatever its level."""
    return _on_repeats(text, lambda segments, keys: _drop_flagged(segments, _running_flags(keys)))


def drop_consecutive(text: Column) -> Column:
    """Drop a header equal to the previous one with only blank lines between.

    Expects the running headers to be gone: then the previous header is simply that of the
    previous segment. A header with an empty key is never dropped.
    """
    return _on_repeats(
        text,
        lambda segments, keys: _drop_flagged(segments, _consecutive_flags(segments, keys)),
    )


def dedupe_headers(text: Column) -> Column:
    """``keep_first_running``, then ``drop_consecutive``.

    Segments and keys are shared; the text is cut again only when running headers went away.
    """

    def step(segments: Column, keys: Column) -> Column:
        def with_flags(running: Column) -> Column:
            again = let(_drop_flagged(segments, running), drop_consecutive)
            once = _drop_flagged(segments, _consecutive_flags(segments, keys))
            return F.when(F.exists(running, lambda flag: flag), again).otherwise(once)

        return let(_running_flags(keys), with_flags)

    return _on_repeats(text, step)


def has_hash_line(text: Column) -> Column:
    """Cheap guard: texts without a hash at a line start skip the segment work."""
    return text.startswith("#") | F.contains(text, F.lit("\n#"))


# Levels ----------------------------------------------------------------------------


def line_levels(lines: Column) -> Column:
    """Header level of every line, null where there is none.

    The whitespace after the hashes may be the newline itself, so hashes alone count too,
    unless they are the last line.
    """
    last = F.size(lines) - 1

    def level(line: Column, i: Column) -> Column:
        hashes = F.length(line) - F.length(F.ltrim(line, F.lit("#")))
        bare = (hashes == F.length(line)) & (hashes <= 6) & (i < last)
        return F.when(line.startswith("#"), F.when(bare | line.rlike(f"^{LEVEL}"), hashes))

    return F.transform(lines, level)


def used_levels(levels: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(levels, lambda v: v.isNotNull())))


def header_levels(text: Column) -> Column:
    """Distinct header levels of a text, ascending."""
    return used_levels(let(lines_of(text), line_levels))


def has_gap(used: Column) -> Column:
    """Some level between the lowest and the highest used one is not used."""
    return F.array_max(used) - F.array_min(used) + 1 > F.size(used)


def compress_in(lines: Column) -> Column:
    """The lines with gaps between used header levels closed.

    The k-th used level becomes minimum + k and the whitespace after the hashes one space; for
    a bare hash line that is its newline, so the next line is glued on.
    """
    last = F.size(lines) - 1

    def on_levels(levels: Column) -> Column:
        zipped = F.arrays_zip(lines, levels).cast("array<struct<line:string,level:int>>")

        def on_used(used: Column) -> Column:
            def rewrite(z: Column, i: Column) -> Column:
                new = F.get(used, F.lit(0)) + F.size(F.filter(used, lambda v: v < z["level"]))
                moved = F.concat(
                    F.repeat(F.lit("#"), new), F.lit(" "), F.substr(z["line"], z["level"] + 2)
                )
                glued = z["level"] == F.length(z["line"])
                return F.concat(
                    F.when(z["level"].isNull(), z["line"]).otherwise(moved),
                    F.when((i == last) | glued, "").otherwise("\n"),
                )

            # Cut again, because gluing joins lines.
            closed = lines_of(F.array_join(F.transform(zipped, rewrite), ""))
            return F.when(has_gap(used), closed).otherwise(lines)

        return let(used_levels(levels), on_used)

    return let(line_levels(lines), on_levels)


def compress_levels(text: Column) -> Column:
    """Close gaps between used header levels; texts without a gap are left alone."""
    return F.when(has_hash_line(text), on_lines(text, compress_in)).otherwise(text)
