"""Personal data: fixed patterns, and what their contexts lead to. DataFrame functions only.

The base patterns give emails, addresses, cards and phones with their places. They seed a bootstrap:

1. Each base entity is an instance and a seed, whatever its shape. A token with a digit and at least
   ``SHORTEST`` characters that no base entity overlaps is an instance too. What follows an explicit
   naming word (``NAMED``, as in ``token = "..."``), up to its closing quote or white space, is a seed
   and a span of kind ``id`` by itself, unless a base entity covers it. The one to three units of text
   before an instance, whatever they hold, are its lexical patterns; a single one needs a letter.
   Units come from the ``CONTEXT`` characters before the instance, which is part of what a pattern is.
2. Patterns and instances are a graph, with one edge for each pair however often it occurs. A pattern's
   score is the mean score of its instances, shrunk by ``PRIOR`` instances of score 0; an instance's
   score is that of its best pattern, 1 for seeds. ``ROUNDS`` rounds of joins and sums spread them. Their
   number is part of the definition: with ever more rounds a pattern's own instances would lift it to
   seeds / (seeds + 1), whatever share of its instances the seeds are.
3. Patterns that reach ``CONFIDENT`` over at least ``SUPPORT`` different instances discover: the
   tokens in their contexts that no seed overlaps become spans of kind ``id``.

Within a text, entities, named values and tokens are sorted together and looked at in one pass. The base
entities stay in their rows; only rows with further spans are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.functions.text import let
from foliomark.llm.bits import parted
from foliomark.llm.tables import numbered, table
from foliomark.operators.spool import Scratch

#: fixed values, given: the base patterns by kind, in this order. Possessive repeats and looking
#: behind change no match; they keep the search linear in long runs of their characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text needs for a pattern to be tried
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
FOUND = "id"
KINDS = [*BASE, FOUND]
PART = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
NAMES = r"(?i)(?:token|secret|password|passwd|api[_-]?key|ssn|passport|iban)\s*+[=:]"
#: the value is what quotes of one line hold, else what ends at white space or a double quote, but no further name
OPENING = rf"{NAMES}\s*+[\"']?"
NAMED = rf"{NAMES}\s*+(?:\"[^\"\n]++\"|'[^'\n]++'|(?!{NAMES})[\"']?+[^\s\"]*[^\s\"'])"
SHORTEST = 6
CONTEXT = 64
ROUNDS = 3
PRIOR = 1.0
SUPPORT = 3
CONFIDENT = 0.7
RUN = 256

SPAN = "struct<rank:int,start:long,end:long>"
SPANS = f"array<{SPAN}>"
FOUND_TYPE = "array<struct<start:long,end:long,match:string,before:string>>"
REACH = "struct<entity:long,other:long>"


def placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, before>> of all matches; ``before`` is the end of the text up to one.

    Places come from the lengths of the matches and of what lies between them, summed in runs of
    ``RUN`` matches, so that many matches in one text cost no more than their number. The last
    ``CONTEXT`` characters go along with the sum.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # for each match the text before it and itself
    pairs = F.zip_with(
        F.split(text, pattern, -1), matches, lambda before, match: F.struct(before.alias("before"), match.alias("match"))
    )
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())

    def size(p: Column) -> Column:
        return (F.char_length(p["before"]) + F.char_length(p["match"])).cast("long")

    def places(some: Column) -> Column:
        empty = F.array().cast(FOUND_TYPE)

        def in_run(state: Column, run: Column) -> Column:
            def add(inner: Column, p: Column) -> Column:
                end = inner["at"] + size(p)
                before = F.right(F.concat(inner["tail"], p["before"]), F.lit(CONTEXT))
                one = F.struct(
                    (inner["at"] + F.char_length(p["before"])).alias("start"),
                    end.alias("end"),
                    p["match"].alias("match"),
                    before.alias("before"),
                )
                tail = F.right(F.concat(inner["tail"], p["before"], p["match"]), F.lit(CONTEXT))
                return F.struct(end.alias("at"), tail.alias("tail"), F.concat(inner["out"], F.array(one)).alias("out"))

            begin = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), empty.alias("out"))
            done = F.aggregate(run, begin, add)
            return let(done, lambda d: F.struct(d["at"].alias("at"), d["tail"].alias("tail"), F.concat(state["out"], F.array(d["out"])).alias("out")))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{FOUND_TYPE}>").alias("out"))
        return F.flatten(F.aggregate(in_runs(some), start, in_run)["out"])

    return let(pairs, lambda some: F.when(F.size(some) > 0, places(some)).otherwise(
        F.array().cast(FOUND_TYPE)
    ))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        # the number of digits first, so that only card-like ones are summed
        return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def base_entities(text: Column) -> Column:
    """array<struct<rank, start, end, match, before>> of the base entities, by kind."""
    none = F.array().cast("array<struct<rank:int,start:long,end:long,match:string,before:string>>")

    def of(rank: int, kind: str) -> Column:
        found = F.filter(placed(text, BASE[kind]), lambda m: _passes(kind, m["match"]))
        ranked = F.transform(
            found,
            lambda m: F.struct(F.lit(rank).alias("rank"), *(m[name].alias(name) for name in ("start", "end", "match", "before"))),
        )
        return F.when(text.rlike(NEEDS[kind]), ranked).otherwise(none)

    return F.concat(*(of(rank, kind) for rank, kind in enumerate(BASE)))


def base_spans(text: Column) -> Column:
    """array<struct<rank, start, end>> of the base entities, by start, then kind."""
    return in_order(base_entities(text))


def in_order(spans: Column) -> Column:
    """Spans by start, then by the rank of their kind."""
    by = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.transform(F.array_sort(by), lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", one)


def named_values(text: Column) -> Column:
    """array<struct<start, end, match, before>> of what explicit naming words name."""

    def value(m: Column) -> Column:
        name = F.regexp_extract(m["match"], f"^{OPENING}", 0)
        inside = F.regexp_replace(F.substr(m["match"], F.char_length(name) + 1), "[\"']$", "")
        start = m["start"] + F.char_length(name)
        return F.struct(
            start.alias("start"),
            (start + F.char_length(inside)).alias("end"),
            inside.alias("match"),
            F.right(F.concat(m["before"], name), F.lit(CONTEXT)).alias("before"),
        )

    return F.when(text.rlike(NAMES), F.transform(placed(text, NAMED), value)).otherwise(F.array().cast(FOUND_TYPE))


def patterns_before(before: Column) -> Column:
    """The one, two and three units that end a text, where there are so many."""

    def units(n: int) -> Column:
        return F.trim(F.regexp_extract(F.lower(before), rf"(\S+(?:\s+\S+){{{n - 1}}}\s*)$", 1))

    return F.array_distinct(F.concat(
        F.filter(F.array(units(3), units(2)), lambda p: p != ""), F.filter(F.array(units(1)), lambda p: p.rlike(r"\p{L}"))
    ))


def in_runs(some: Column) -> Column:
    """A non-empty array in slices of ``RUN``, so that what grows by appending stays short."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / RUN).cast("int")), lambda k: F.slice(some, k * RUN + 1, F.lit(RUN)))


def reaches(events: Column) -> Column:
    """For each of ``events(start, tag, end, ...)`` the greatest end of the entities before it, and of all but tokens."""

    def add(state: Column, e: Column) -> Column:
        one = F.struct(state["entity"].alias("entity"), state["other"].alias("other"))
        return F.struct(
            F.when(e["tag"] == 0, F.greatest(state["entity"], e["end"])).otherwise(state["entity"]).alias("entity"),
            F.when(e["tag"] < 2, F.greatest(state["other"], e["end"])).otherwise(state["other"]).alias("other"),
            F.concat(state["out"], F.array(one)).alias("out"),
        )

    def in_run(state: Column, run: Column) -> Column:
        empty = F.array().cast(f"array<{REACH}>")
        done = F.aggregate(run, F.struct(state["entity"].alias("entity"), state["other"].alias("other"), empty.alias("out")), add)
        return let(done, lambda d: F.struct(
            d["entity"].alias("entity"), d["other"].alias("other"), F.concat(state["out"], F.array(d["out"])).alias("out")
        ))

    nothing = F.lit(-1).cast("long")
    start = F.struct(nothing.alias("entity"), nothing.alias("other"), F.array().cast(f"array<array<{REACH}>>").alias("out"))
    return F.flatten(F.aggregate(in_runs(events), start, in_run)["out"])


def instances(text: Column, entities: Column, named: Column) -> Column:
    """Base entities, named values and tokens with a digit apart from them, with their patterns.

    ``seed``: an entity or a named value; ``known``: covered by an entity. All are sorted by start, of
    equal ones entities first, then named values. Tokens do not overlap each other, so what a token meets
    either begins before it and ends after its start, or is the next in order.
    """
    kind = "array<struct<start:long,end:long,token:string,patterns:array<string>,known:boolean,seed:boolean>>"

    def tagged(found: Column, tag: int) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(tag).alias("tag"), m["end"].alias("end"), m["match"].alias("match"), m["before"].alias("before")
        ))

    def judged(events: Column, before: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            reach, after = F.get(before, i), F.get(events, i + 1)
            meets = (reach["other"] > e["start"]) | F.coalesce((after["tag"] < 2) & (after["start"] < e["end"]), F.lit(False))
            return F.struct(
                e.alias("e"),
                ((e["tag"] < 2) | ~meets).alias("counts"),
                ((e["tag"] == 0) | (e["tag"] == 1) & (reach["entity"] >= e["end"])).alias("known"),
            )

        return F.transform(events, one)

    def written_out(j: Column) -> Column:
        e = j["e"]
        return F.struct(
            e["start"].alias("start"),
            e["end"].alias("end"),
            e["match"].alias("token"),
            patterns_before(e["before"]).alias("patterns"),
            j["known"].alias("known"),
            (e["tag"] < 2).alias("seed"),
        )

    tokens = F.filter(placed(text, TOKEN), lambda m: m["end"] - m["start"] >= SHORTEST)
    tokens = F.when(text.rlike("[0-9]"), tokens).otherwise(F.array().cast(FOUND_TYPE))
    every = F.array_sort(F.concat(tagged(entities, 0), tagged(named, 1), tagged(tokens, 2)))
    found = let(every, lambda events: F.when(F.size(events) > 0, let(
        reaches(events), lambda before: F.transform(F.filter(judged(events, before), lambda j: j["counts"]), written_out)
    )))
    return F.coalesce(found.cast(kind), F.array().cast(kind))


def scored_patterns(scratch: Scratch, found: DataFrame) -> DataFrame:
    """(pattern, score, support) of ``found(token, patterns, seed)`` after the rounds."""
    each = found.select("token", "seed", F.explode("patterns").alias("pattern"))
    once = each.groupBy("token", "pattern").agg(F.max("seed").alias("seed"))
    edges = scratch.spool(once)
    fixed = edges.groupBy("token").agg(F.max("seed").cast("int").cast("double").alias("score"))
    scores = fixed
    for _ in range(ROUNDS):
        patterns = scratch.spool(
            edges.select("token", "pattern").join(scores, "token").groupBy("pattern").agg(
                (F.sum("score") / (F.count("*") + PRIOR)).alias("score"), F.count("*").alias("support")
            )
        )
        best = edges.join(patterns.select("pattern", F.col("score").alias("p")), "pattern").groupBy("token").agg(F.max("p").alias("p"))
        scores = fixed.join(best, "token").select("token", F.greatest("score", "p").alias("score"))
    return patterns


def with_spans(docs: DataFrame, keep: list[str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``docs(text, ...)`` -> its columns, or those in ``keep``, and ``spans``, one row per row.

    ``spans`` is array<struct<rank, start, end>> in code points, ends exclusive, by start and kind;
    ``rank`` counts in ``KINDS``. Null and empty texts have none. Repeated rows and nulls elsewhere are
    rows like others; equal tokens in equal contexts count once in the graph. A column of ``docs`` called
    ``spans`` is replaced. What is written on the way, the kept columns once, belongs to ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    keep = [name for name in (docs.columns if keep is None else keep) if name != "spans"]
    # columns by position, so that no name can clash with those made here
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = [f"c{k}" for k in range(len(keep))]
    rows = numbered(docs.select(*(F.col(name).alias(c) for name, c in zip(keep, held, strict=True)), text.alias("text")))
    rows = rows.withColumn("entities", base_entities(F.col("text")))
    rows = rows.withColumn("named", named_values(F.col("text")))
    found = instances(F.col("text"), F.col("entities"), F.col("named"))
    read = scratch.spool(rows.select("row_id", *held, in_order(F.col("entities")).alias("base"), found.alias("found")))
    found = read.select("row_id", F.explode("found").alias("f")).select("row_id", "f.*")
    patterns = scored_patterns(scratch, found.select("token", "patterns", "seed"))
    sure = patterns.filter((F.col("score") >= CONFIDENT) & (F.col("support") >= SUPPORT)).select("pattern")
    more = found.filter("not known")
    discovered = more.filter("not seed").select("row_id", "start", "end", F.explode("patterns").alias("pattern")).join(sure, "pattern", "left_semi")
    new = scratch.spool(
        more.filter("seed").select("row_id", "start", "end")
        .union(discovered.select("row_id", "start", "end"))
        .groupBy("row_id")
        .agg(F.collect_set(F.struct(F.lit(KINDS.index(FOUND)).alias("rank"), "start", "end")).alias("new"))
    )
    may, clear = parted(read.drop("found"), new, "row_id")
    joined = may.join(new, "row_id", "left")
    every = F.when(F.col("new").isNull(), F.col("base")).otherwise(in_order(F.concat("base", "new")))
    out = joined.select(*held, every.cast(SPANS).alias("spans")).union(clear.select(*held, F.col("base").cast(SPANS).alias("spans")))
    return out.toDF(*keep, "spans")


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, spans), one row per row, as ``with_spans`` gives them."""
    return with_spans(docs, ["doc_id"])


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, overlapping ones together, replaced by ``[KIND]`` of the first.

    A run of spans is cut from the text first and its pieces from that, since a place in a text is found
    by reading up to it.
    """
    kinds = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS))
    none = F.array().cast("array<string>")

    def in_run(state: Column, run: Column) -> Column:
        last = F.array_max(F.transform(run, lambda s: s["end"]))
        region = F.substr(text, (state["at"] + 1).cast("int"), F.greatest(last - state["at"], F.lit(0)).cast("int"))

        def cut(piece: Column) -> Column:
            def add(inner: Column, s: Column) -> Column:
                gap = F.substr(piece, (inner["at"] - state["at"] + 1).cast("int"), (s["start"] - inner["at"]).cast("int"))
                more = F.struct(s["end"].alias("at"), F.concat(inner["out"], F.array(gap, F.get(kinds, s["rank"]))).alias("out"))
                inside = F.struct(F.greatest(inner["at"], s["end"]).alias("at"), inner["out"].alias("out"))
                return F.when(s["start"] < inner["at"], inside).otherwise(more)

            return F.aggregate(run, F.struct(state["at"].alias("at"), none.alias("out")), add)

        done = let(region, cut)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(d["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    done = F.aggregate(in_runs(spans), start, in_run)
    whole = let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substr(text, (d["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id",
        *(count(rank).alias(f"n_{kind}") for rank, kind in enumerate(BASE)),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
