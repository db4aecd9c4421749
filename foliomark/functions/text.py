"""Shared text expressions with Python's string semantics, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's ``str.strip`` and ``\s`` treat as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a Java character class body. Spelled out, because \s with the Unicode flag
# is several times slower; single characters and one outer range settle most tests at once.
_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0" + _WIDE
# Without the newline, for patterns that must stay on one line.
WS_INLINE = r"\t\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0" + _WIDE

CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Naming an intermediate column is not enough: the optimizer inlines a column used once,
    also into a lambda body, where it would be evaluated once per element. A fold over no
    elements binds its start value and nothing else; taking the single element out of a
    transformed array would do too, but works out the type of the whole body for every row.
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda bound, _: bound, body)


def strip(text: Column) -> Column:
    """Strip Python's whitespace at both ends.

    The end characters are tested first: trimming a character set walks the whole string,
    and most lines have nothing to trim.
    """
    edge = list(WHITESPACE)
    padded = F.left(text, F.lit(1)).isin(edge) | F.right(text, F.lit(1)).isin(edge)
    return F.when(padded, F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE)) == ""


def is_upper(text: Column) -> Column:
    """At least one cased character and every cased character is upper case."""
    return text.rlike(r"\p{IsUppercase}") & ~text.rlike(r"[\p{IsLowercase}\p{Lt}]")


def title(text: Column) -> Column:
    """Title-case every run of cased characters (``IT'S A-B`` -> ``It'S A-B``).

    Meant for upper-case input: the four digraphs are the only upper-case letters whose
    title-case form differs from themselves. A sigma takes its final form by what follows in
    the whole text, so with one the small letters come from lowering the whole text.
    """

    def runs(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(f"([{CASED}]+|[^{CASED}]+)"), F.lit(1))

    def capital(run: Column) -> Column:
        return F.translate(F.upper(F.left(run, F.lit(1))), "ǄǇǊǱ", "ǅǈǋǲ")

    def word(run: Column) -> Column:
        rest = F.substr(F.lower(run), F.length(F.lower(F.left(run, F.lit(1)))) + 1)
        return F.concat(capital(run), rest)

    def paired(run: Column, low: Column) -> Column:
        return F.concat(capital(run), F.substr(low, F.lit(2)))

    lowered = F.lower(text)
    aligned = F.contains(text, F.lit("Σ")) & (F.length(lowered) == F.length(text))
    words = F.when(aligned, F.zip_with(runs(text), runs(lowered), paired)).otherwise(
        F.transform(runs(text), word)
    )
    return F.array_join(words, "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    """What follows the first newline; null when there is none."""
    return F.get(F.split(text, "\n", 2), F.lit(1))


def shifted(items: Column, by: int, pad: Column) -> Column:
    """``items`` moved by ``by`` places (positive: later), same length, edges filled by ``pad``."""
    size = F.size(items)
    fill = F.array(*[pad] * abs(by))
    if by > 0:
        return F.slice(F.concat(fill, items), F.lit(1), size)
    return F.slice(F.concat(items, fill), F.lit(1 - by), size)


# Steps on the lines of a text. Splitting and joining at newlines is far cheaper than one scan
# by a regular expression, so whole-text steps go through their lines.


def on_lines(text: Column, step: Callable[[Column], Column]) -> Column:
    return F.array_join(let(lines_of(text), step), "\n")


def rstrip_each(lines: Column) -> Column:
    """Strip trailing blanks and tabs of every line."""

    def bare(line: Column) -> Column:
        padded = line.endswith(" ") | line.endswith("\t")
        return F.when(padded, F.rtrim(line, F.lit(" \t"))).otherwise(line)

    return F.transform(lines, bare)


def collapse_blank(lines: Column) -> Column:
    """The lines after turning three or more newlines into two.

    Inside a text a run of empty lines keeps one. At its start and end it keeps two: there a
    run of k empty lines is k newlines, not k + 1.
    """
    last = F.size(lines) - 1
    marked = F.zip_with(
        lines,
        shifted(lines, 1, F.lit("-")),
        lambda line, before: F.when((line != "") | (before != ""), line),
    )
    restored = F.transform(
        marked, lambda line, i: F.when(line.isNull() & ((i == 1) | (i == last)), "").otherwise(line)
    )
    return F.filter(restored, lambda line: line.isNotNull())


def drop_last_blank(lines: Column) -> Column:
    """The lines without the empty ones at the end."""
    filled = F.array_position(F.transform(F.reverse(lines), lambda line: line != ""), True)
    count = F.when(filled > 0, F.size(lines) + 1 - filled.cast("int")).otherwise(0)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), count)).otherwise(lines)


def collapse_newlines(text: Column) -> Column:
    """Three or more newlines become two."""
    collapsed = on_lines(text, collapse_blank)
    return F.when(F.contains(text, F.lit("\n\n\n")), collapsed).otherwise(text)
