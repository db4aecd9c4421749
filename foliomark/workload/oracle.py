"""The registered queries again, as SQL over the same tables.

Written with line tables, windows and recursion where the engine uses arrays inside a row,
so that the two agree only when both are right.
"""

from __future__ import annotations

# Fixed values up to LIMIT: markers and classes the behaviour is defined by.
# Python's whitespace as an RE2 class body (RE2's own \s is ASCII).
WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_INLINE = r"\t\r\f \x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
START = "**----- Start of picture text -----**<br>"
END = "**----- End of picture text -----**<br>"
BLOCK = rf"(?s)\Q{START}\E\n(.*?)\Q{END}\E"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"
LIMIT = 4000


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def key(line: str) -> str:
    bare = f"regexp_replace(regexp_replace({line}, '^#{{1,6}}', ''), '[*_`{WS}]+', '', 'g')"
    return f"upper(replace({bare}, 'ß', 'SS'))"


def edge_key(line: str) -> str:
    return rf"regexp_replace({key(line)}, '\d+', '#', 'g')"


def is_header(line: str) -> str:
    return rf"regexp_matches({line}, '^#{{1,6}}[{WS_INLINE}]+[^\n]')"


def squeeze(x: str) -> str:
    return rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def rstrip_lines(x: str) -> str:
    return rf"regexp_replace({x}, '(?m)[ \t]+$', '', 'g')"


def final_newline(x: str) -> str:
    return f"rtrim({x}, chr(10)) || chr(10)"


def no_placeholders(x: str) -> str:
    return rf"regexp_replace({x}, '\*\*==> picture \[\d+ x \d+\] intentionally omitted <==\*\*\n?', '', 'g')"


FILE_NAME = "CASE WHEN doc_id % 7 = 0 THEN '_' WHEN doc_id % 11 = 0 THEN '.' ELSE '' END || 'd' || doc_id || '.md'"
# a folder between two runs: some files are new, some rewritten, some deleted
CHANGED = f"""SELECT source, {FILE_NAME} AS name, fate, CASE fate WHEN 'rewritten' THEN text || ' again' ELSE text END AS t
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 3 THEN 'deleted'
        WHEN doc_id % 5 = 0 THEN 'rewritten' ELSE 'unchanged' END AS fate FROM documents)"""


def kind(t: str) -> str:
    return rf"""CASE WHEN {t} = '' THEN 'blank'
      WHEN length({t}) < 60 AND regexp_matches({t}, '\p{{Lu}}') AND NOT regexp_matches({t}, '[\p{{Ll}}\p{{Lt}}]') THEN 'heading'
      WHEN {t}[1] IN ('•', '·', '-', '*', '◦') THEN 'bullet'
      WHEN regexp_matches({t}, '^\d+[.)][{WS}]') THEN 'numbered' ELSE 'paragraph' END"""


def title(t: str) -> str:
    runs = f"regexp_extract_all({t}, '[{CASED}]+|[^{CASED}]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def markdown(t: str, k: str) -> str:
    return f"""CASE {k} WHEN 'heading' THEN '## ' || {title(t)}
      WHEN 'bullet' THEN '- ' || {strip(f"{t}[2:]")} ELSE {t} END"""


# Common table expressions ------------------------------------------------------------------

CTES: dict[str, str] = {}


def exploded(name: str, source: str, keep: str = "doc_id", text: str = "text") -> None:
    """A line table with 0-based ``i``."""
    CTES[name] = f"""SELECT {keep}, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line
      FROM (SELECT {keep}, string_split({text}, chr(10)) AS l FROM {source})"""


exploded("doc_lines", "documents", "doc_id, source")

CTES["items"] = rf"""SELECT doc_id, source, i,
    CASE WHEN i % 4 = 0 THEN '# **' || source || '**' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 17 = 0 AND i = 3 THEN '##' || chr(10) ELSE '' END
    || CASE (doc_id * 7 + i) % 13
      WHEN 0 THEN line
      WHEN 1 THEN '### ' || line[:30] || '  ' || chr(10) || line[31:]
      WHEN 2 THEN upper(replace(line[:40], 'ß', 'ss')) || chr(10) || line[41:]
      WHEN 3 THEN '• ' || line
      WHEN 4 THEN '| ' || replace(line, '|', '') || ' | ' || length(line) || ' |'
      WHEN 5 THEN '| ' || replace(line, '|', '') || ' | ' || length(line) || ' |'
      WHEN 6 THEN line || chr(10) || chr(10) || chr(10)
      WHEN 7 THEN line || chr(10) || chr(10) || chr(10)
      WHEN 8 THEN line || chr(10) || chr(10) || chr(10)
      WHEN 9 THEN '**==> picture [12 x 34] intentionally omitted <==**' || chr(10) || line
      WHEN 10 THEN '�' || line || '� ' || chr(9)
      WHEN 11 THEN '## ' || line[:20] || chr(10) || chr(10) || '## **' || line[:20] || '**' || chr(10) || line[21:]
      ELSE '{START}' || chr(10) || 'Name  Qty  Note<br>' || chr(10) || 'x  1  y<br>' || chr(10) || 'z  2  w<br>' || chr(10)
        || line || '  ' || length(line) || '<br>' || chr(10) || 'a  b  c  d<br>' || chr(10) || '{END}'
    END AS item FROM doc_lines"""
CTES["noisy"] = """SELECT doc_id, source, string_agg(item, chr(10) ORDER BY i) AS text
    FROM items GROUP BY doc_id, source"""
CTES["paged"] = """SELECT doc_id, source, (i // 4 + 1)::INT AS page_no,
      string_agg(item, chr(10) ORDER BY i) || chr(10) || 'Page ' || (i // 4 + 1) || chr(10) AS text
    FROM items GROUP BY doc_id, source, i // 4"""
exploded("noisy_lines", "noisy", "doc_id, source")


def blocks_of(prefix: str, source: str) -> None:
    """Picture-text blocks of a text table, from cutting to rendering."""
    CTES[f"{prefix}blocks"] = f"""SELECT doc_id, generate_subscripts(b, 1) - 1 AS block_no, unnest(b) AS block
      FROM (SELECT doc_id, regexp_extract_all(text, '{BLOCK}', 1) AS b FROM {source})"""
    CTES[f"{prefix}rows0"] = f"""SELECT doc_id, block_no, generate_subscripts(r, 1) AS n, {strip('unnest(r)')} AS row
      FROM (SELECT doc_id, block_no, regexp_split_to_array(block, '<br>[{WS}]*\\n?') AS r FROM {prefix}blocks)"""
    CTES[f"{prefix}rows"] = f"""SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY n) - 1 AS row_no,
      row, regexp_split_to_array(row, '[{WS}]{{2,}}') AS cols FROM {prefix}rows0 WHERE row <> ''"""
    CTES[f"{prefix}widths"] = f"""SELECT doc_id, block_no, len(cols) AS width, count(*) AS matching
      FROM {prefix}rows GROUP BY ALL"""
    CTES[f"{prefix}shapes"] = f"""SELECT doc_id, block_no, n_rows, width, matching,
        width > 1 AND matching >= n_rows * 0.4 AS tabular
      FROM (SELECT *, sum(matching) OVER (PARTITION BY doc_id, block_no) AS n_rows FROM {prefix}widths)
      QUALIFY row_number() OVER (PARTITION BY doc_id, block_no ORDER BY matching DESC, width) = 1"""
    CTES[f"{prefix}fitted"] = f"""SELECT doc_id, block_no, row_no, tabular, row,
        CASE WHEN len(cols) > width THEN list_append(cols[:width - 1], array_to_string(cols[width:], '  '))
             ELSE list_concat(cols, list_transform(range(width - len(cols)), lambda x: '')) END AS cells
      FROM {prefix}rows JOIN {prefix}shapes USING (doc_id, block_no)"""
    CTES[f"{prefix}rendered"] = f"""SELECT doc_id, block_no,
        coalesce(string_agg(CASE WHEN NOT tabular THEN row ELSE '| ' || array_to_string(cells, ' | ') || ' |'
          || CASE WHEN row_no = 0 THEN chr(10) || '|' || repeat('---|', len(cells)) ELSE '' END END,
          chr(10) ORDER BY row_no) || chr(10), '') AS md
      FROM {prefix}blocks LEFT JOIN {prefix}fitted USING (doc_id, block_no) GROUP BY doc_id, block_no"""
    CTES[f"{prefix}pictured"] = f"""SELECT doc_id, array_to_string(list_transform(range(1, len(parts) + 1),
          lambda x: parts[x] || coalesce(mds[x], '')), '') AS text
      FROM (SELECT doc_id, regexp_split_to_array(text, '{BLOCK}') AS parts FROM {source})
      LEFT JOIN (SELECT doc_id, list(md ORDER BY block_no) AS mds FROM {prefix}rendered GROUP BY doc_id)
      USING (doc_id)"""


def headers_of(prefix: str, source: str) -> None:
    """Duplicate headers of a text table, with windows over its lines."""
    exploded(f"{prefix}hl0", source)
    CTES[f"{prefix}hl"] = f"""SELECT *, CASE WHEN {is_header('line')} THEN {key('line')} END AS k FROM {prefix}hl0"""
    CTES[f"{prefix}hl1"] = f"""SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c,
      row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS r FROM {prefix}hl"""
    CTES[f"{prefix}hl2"] = f"""SELECT * FROM {prefix}hl1 WHERE NOT (k IS NOT NULL AND c >= 3 AND r > 1)"""
    CTES[f"{prefix}running"] = f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text
      FROM {prefix}hl2 GROUP BY doc_id"""
    CTES[f"{prefix}hl3"] = f"""SELECT *, last_value(CASE WHEN k IS NOT NULL THEN 'H' || k
          WHEN {strip('line')} <> '' THEN 'T' END IGNORE NULLS) OVER
        (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {prefix}hl2"""
    CTES[f"{prefix}deduped"] = f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM {prefix}hl3
      WHERE NOT coalesce(k <> '' AND c < 3 AND p = 'H' || k, false) GROUP BY doc_id"""


def levels_of(prefix: str, source: str) -> None:
    """Header levels of a text table and their compression, line by line."""
    exploded(f"{prefix}ll0", source)
    CTES[f"{prefix}ll1"] = f"""SELECT *, max(i) OVER (PARTITION BY doc_id) AS last_i,
      length(regexp_extract(line, '^#+')) AS h FROM {prefix}ll0"""
    CTES[f"{prefix}ll2"] = f"""SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}[{WS}]')
          OR (regexp_matches(line, '^#{{1,6}}$') AND i < last_i) THEN h END AS level FROM {prefix}ll1"""
    CTES[f"{prefix}used"] = f"""SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY level) - 1 AS k,
        min(level) OVER (PARTITION BY doc_id) AS low, max(level) OVER (PARTITION BY doc_id) AS high,
        count(*) OVER (PARTITION BY doc_id) AS n
      FROM (SELECT DISTINCT doc_id, level FROM {prefix}ll2 WHERE level IS NOT NULL)"""
    CTES[f"{prefix}moved"] = f"""SELECT doc_id, i, CASE WHEN level IS NULL OR high - low + 1 = n THEN line
          ELSE repeat('#', (low + k)::INT) || ' ' || line[h + 2:] END AS line,
        CASE WHEN i = last_i OR (level IS NOT NULL AND high - low + 1 > n AND length(line) = h) THEN ''
          ELSE chr(10) END AS ending
      FROM {prefix}ll2 LEFT JOIN {prefix}used USING (doc_id, level)"""
    CTES[f"{prefix}levelled"] = f"""SELECT doc_id, string_agg(line || ending, '' ORDER BY i) AS text
      FROM {prefix}moved GROUP BY doc_id"""


def islands_of(prefix: str, source: str) -> None:
    """Runs of table rows of a text table, as gaps and islands."""
    exploded(f"{prefix}tl0", source)
    CTES[f"{prefix}tl1"] = f"""SELECT *, {strip('line')} AS t FROM {prefix}tl0"""
    CTES[f"{prefix}tl2"] = f"""SELECT *, starts_with(t, '|') AND ends_with(t, '|') AS is_row,
        sum(CASE WHEN starts_with(t, '|') AND ends_with(t, '|') THEN 0 ELSE 1 END)
          OVER (PARTITION BY doc_id ORDER BY i) AS g,
        coalesce(regexp_matches(lead(t) OVER (PARTITION BY doc_id ORDER BY i), '^\\|[{WS}\\-:]+(\\|[{WS}\\-:]+)+\\|$'), false) AS sep_next
      FROM {prefix}tl1"""
    CTES[f"{prefix}tl3"] = f"""SELECT *, row_number() OVER (PARTITION BY doc_id, g, is_row ORDER BY i) AS r,
        count(*) OVER (PARTITION BY doc_id, g, is_row) AS n_rows FROM {prefix}tl2"""
    CTES[f"{prefix}repaired"] = f"""SELECT doc_id, string_agg(line || CASE WHEN is_row AND r = 1 AND n_rows > 1 AND NOT sep_next
          THEN chr(10) || CASE WHEN line = '|' THEN '||' ELSE '|' || repeat('---|', length(line) - length(replace(line, '|', '')) - 1) END
          ELSE '' END, chr(10) ORDER BY i) AS text
      FROM {prefix}tl3 GROUP BY doc_id"""


def edges_of() -> None:
    exploded("pl0", "paged", "doc_id, source, page_no")
    CTES["pl1"] = f"""SELECT *, min(CASE WHEN {strip('line')} <> '' THEN i END) OVER (PARTITION BY doc_id, page_no) AS top,
        max(CASE WHEN {strip('line')} <> '' THEN i END) OVER (PARTITION BY doc_id, page_no) AS bottom FROM pl0"""
    CTES["pl2"] = f"""SELECT *, count(CASE WHEN i = top THEN 1 END) OVER (PARTITION BY doc_id, {edge_key('line')}) AS n_top,
        count(CASE WHEN i = bottom THEN 1 END) OVER (PARTITION BY doc_id, {edge_key('line')}) AS n_bottom FROM pl1"""
    CTES["stripped_pages"] = """SELECT doc_id, page_no, coalesce(string_agg(line, chr(10) ORDER BY i)
        FILTER (WHERE NOT ((i = top AND n_top >= 3) OR (i = bottom AND n_bottom >= 3))), '') AS text
      FROM pl2 GROUP BY doc_id, page_no"""


def cleaned(prefix: str, source: str) -> str:
    """The whole cleanup over a text table; returns the name of the result."""
    CTES[f"{prefix}c0"] = f"""SELECT doc_id, {no_placeholders("replace(text, '�', '')")} AS text FROM {source}"""
    blocks_of(f"{prefix}c_", f"{prefix}c0")
    headers_of(f"{prefix}c_", f"{prefix}c_pictured")
    CTES[f"{prefix}c1"] = f"SELECT doc_id, {squeeze(rstrip_lines('text'))} AS text FROM {prefix}c_deduped"
    levels_of(f"{prefix}c_", f"{prefix}c1")
    islands_of(f"{prefix}c_", f"{prefix}c_levelled")
    CTES[f"{prefix}clean"] = f"SELECT doc_id, {final_newline('text')} AS text FROM {prefix}c_repaired"
    return f"{prefix}clean"


blocks_of("", "noisy")
headers_of("", "noisy")
levels_of("", "noisy")
islands_of("", "noisy")
edges_of()
cleaned("", "noisy")

CTES["kinds"] = f"""SELECT doc_id, source, i, t, {kind('t')} AS kind
    FROM (SELECT *, {strip('line')} AS t FROM noisy_lines)"""
CTES["headers"] = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS header_no,
      length(regexp_extract(line, '^#+')) AS level, {key('line')} AS key
    FROM noisy_lines WHERE {is_header('line')}"""

CTES["cell_rows"] = """SELECT doc_id, i, string_split(line, ', ') AS cells FROM doc_lines"""
CTES["tables"] = """SELECT doc_id, string_agg('| ' || array_to_string(list_transform(cells, lambda c: coalesce(c, '')), ' | ') || ' |'
      || CASE WHEN i = 0 THEN chr(10) || '|' || repeat('---|', len(cells)) ELSE '' END, chr(10) ORDER BY i) AS md
    FROM cell_rows GROUP BY doc_id"""

CTES["images"] = """SELECT doc_id, (i // 4 + 1)::INT AS page_no, (i % 4 + 1)::INT AS img_no, line,
      'page_' || (i // 4 + 1) || '_img_' || (i % 4 + 1) || '.png' AS name
    FROM doc_lines WHERE NOT contains(line, '|')"""

CTES["paras_text"] = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"
CTES["paras"] = """SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS p
    FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM paras_text)"""


def packed(name: str, limit: int) -> None:
    """Greedy packing by recursion over the paragraphs."""
    CTES[f"{name}_walk"] = f"""SELECT doc_id, n, length(p) + 2 AS size, 0 AS chunk_no FROM paras WHERE n = 0
      UNION ALL
      SELECT w.doc_id, p.n, CASE WHEN w.size + length(p.p) + 2 > {limit} THEN length(p.p) + 2 ELSE w.size + length(p.p) + 2 END,
        w.chunk_no + CASE WHEN w.size + length(p.p) + 2 > {limit} THEN 1 ELSE 0 END
      FROM {name}_walk w JOIN paras p ON p.doc_id = w.doc_id AND p.n = w.n + 1"""
    CTES[name] = f"""SELECT doc_id, chunk_no, string_agg(p, chr(10) || chr(10) ORDER BY n) AS chunk
      FROM {name}_walk JOIN paras USING (doc_id, n) GROUP BY doc_id, chunk_no"""


packed("packed", LIMIT)
packed("packed_small", LIMIT // 4)
CTES["chunks"] = f"""SELECT doc_id, chunk_no, chunk, (count(*) OVER (PARTITION BY doc_id))::INT AS n_chunks FROM (
      SELECT doc_id, 0 AS chunk_no, text AS chunk FROM paras_text WHERE length(text) <= {LIMIT}
      UNION ALL
      SELECT doc_id, chunk_no, chunk FROM packed JOIN (SELECT doc_id FROM paras_text WHERE length(text) > {LIMIT}) USING (doc_id))"""

CTES["first_mode"] = f"""SELECT doc_id, count(*) AS n_calls, count(*) FILTER (bad) AS n_failed,
      count(*) FILTER (blank AND NOT bad) AS n_blank, NOT bool_or(bad OR blank) AS done
    FROM (SELECT doc_id, length(chunk) % 3 = 0 AS bad, {strip("replace(chunk, ' ', '_')")} = '' AS blank
      FROM chunks JOIN paras_text USING (doc_id) WHERE {strip("text")} <> '') GROUP BY doc_id"""

KINDS = ("blank", "heading", "bullet", "numbered", "paragraph")
CLEANED = ("c0", "c_pictured", "c_deduped", "c1", "c_levelled", "c_repaired", "clean")
CTES["profiles"] = f"""SELECT doc_id, source, length(noisy.text) AS n_chars, n_lines, coalesce(n_headers, 0) AS n_headers,
      coalesce(n_picture_blocks, 0) AS n_picture_blocks, {", ".join(f"n_{k}" for k in KINDS)},
      {", ".join(f"length({a}.text) - length({b}.text) AS removed_{n}" for a, b, n in zip(("noisy", *CLEANED), CLEANED, ("artifacts", "pictures", "headers", "blanks", "levels", "tables", "end")))}
    FROM noisy {" ".join(f"JOIN {c} USING (doc_id)" for c in CLEANED)}
    JOIN (SELECT doc_id, count(*) AS n_lines, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)} FROM kinds GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_headers FROM headers GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_picture_blocks FROM blocks GROUP BY doc_id) USING (doc_id)"""
CTES["paths"] = """SELECT doc_id, source || '/d' || (doc_id % 50) || (['.pdf', '.PDF', '.Pdf', '.txt'])[doc_id % 4 + 1] AS rel_path
    FROM documents"""
CTES["named"] = r"""SELECT doc_id, rel_path, '/in/' || rel_path AS path, regexp_extract(rel_path, '[^/]*$') AS name,
      regexp_replace(regexp_extract(rel_path, '[^/]*$'), '\.[^.]+$', '') AS stem,
      regexp_extract(rel_path, '^.*/') AS folder FROM paths"""

CTES["page_marks"] = """SELECT *, CASE WHEN page_no > 1
      THEN chr(10) || '---' || chr(10) || chr(10) || '*Page ' || page_no || '*' || chr(10) || chr(10) || chr(10) ELSE '' END AS mark FROM paged"""
CTES["formatted_lines"] = f"""SELECT doc_id, page_no, i, {markdown('t', 'kind')} AS line
    FROM (SELECT *, {kind('t')} AS kind FROM (SELECT *, {strip('line')} AS t FROM pl0))"""
CTES["formatted_pages"] = f"""SELECT doc_id, page_no, {squeeze("string_agg(line, chr(10) ORDER BY i)")} AS text
    FROM formatted_lines GROUP BY doc_id, page_no"""


def provenance(stem: str) -> str:
    return f"'# ' || {stem} || chr(10) || chr(10) || '*Converted from: ' || {stem} || '.pdf*' || chr(10) || chr(10) || '---' || chr(10) || chr(10)"


STEM = "source || '-' || doc_id"
CTES["raw_converted"] = f"""SELECT doc_id, {provenance('any_value(' + STEM + ')')} || string_agg(mark || f.text, chr(10) ORDER BY page_no) AS text
    FROM page_marks JOIN formatted_pages f USING (doc_id, page_no) GROUP BY doc_id"""
CTES["raw_stripped"] = f"""SELECT doc_id, {provenance('any_value(' + STEM + ')')} || string_agg(s.text, chr(10) ORDER BY page_no) AS text
    FROM paged JOIN stripped_pages s USING (doc_id, page_no) GROUP BY doc_id"""
cleaned("conv_", "raw_converted")
cleaned("strip_", "raw_stripped")
CTES["page_counts"] = "SELECT doc_id, source, count(*) AS n FROM paged GROUP BY doc_id, source"


def sql(final: str) -> str:
    """Put the expressions a query needs, directly or through others, before it."""
    import re

    needed: list[str] = []

    def visit(text: str, me: str = "") -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)):
            if name in CTES and name != me and name not in needed:
                visit(CTES[name], name)
                needed.append(name)

    visit(final)
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    return f"WITH RECURSIVE {body}\n{final}" if needed else final


def texts(source: str, step: str = "text") -> str:
    return sql(f"SELECT doc_id, {step} AS text FROM {source}")


ORACLE: dict[str, str] = {
    "format_text": sql(f"""SELECT doc_id, {squeeze(f"string_agg({markdown('t', 'kind')}, chr(10) ORDER BY i)")} AS text
        FROM kinds GROUP BY doc_id"""),
    "collapse_blank": texts("noisy", squeeze("text")),
    "drop_replacement_char": texts("noisy", "replace(text, '�', '')"),
    "drop_placeholders": texts("noisy", no_placeholders("text")),
    "picture_tables": texts("pictured"),
    "keep_first_running": texts("running"),
    "drop_consecutive": texts("deduped"),
    "rstrip_lines": texts("noisy", rstrip_lines("text")),
    "collapse_blank_lines": texts("noisy", squeeze(rstrip_lines("text"))),
    "compress_levels": texts("levelled"),
    "repair_separator": texts("repaired"),
    "final_newline": texts("noisy", final_newline("text")),
    "cleanup": texts("clean"),
    "incremental_cleanup": texts("clean"),
    "trim_line": sql("SELECT doc_id, i::INT AS line_no, t AS line FROM kinds"),
    "classify_lines": sql(f"SELECT doc_id, i::INT AS line_no, kind, {markdown('t', 'kind')} AS md FROM kinds"),
    "line_kinds": sql("SELECT source, kind, count(*) AS n FROM kinds GROUP BY ALL"),
    "caps_heading": sql("""SELECT doc_id, i::INT AS line_no, t <> '' AND length(t) < 60 AND upper(t) = t AND lower(t) <> t AS is_heading
        FROM kinds"""),
    "bullet": sql("SELECT doc_id, i::INT AS line_no, regexp_matches(t, '^[•·*◦-]') AS is_bullet FROM kinds"),
    "numbered": sql(f"""SELECT doc_id, i::INT AS line_no, regexp_matches({strip("CASE WHEN ends_with(source, '1') THEN (i + 1) || '. ' || line ELSE line END")},
        '^\\d+[.)][{WS}]') AS is_numbered FROM doc_lines"""),
    "parse_headers": sql("SELECT doc_id, header_no::INT AS header_no, level::INT AS level, key FROM headers"),
    "header_key": sql("SELECT key, count(*) AS n FROM headers GROUP BY key"),
    "running_headers": sql("SELECT doc_id, key, count(*) AS n FROM headers GROUP BY ALL HAVING count(*) >= 3"),
    "removed_headers": sql(f"""SELECT source, count(*) AS n_docs, sum(b - coalesce(a, 0))::BIGINT AS n_removed
        FROM (SELECT doc_id, source, count(*) FILTER (WHERE {is_header('line')}) AS b FROM noisy_lines GROUP BY ALL)
        LEFT JOIN (SELECT doc_id, count(*) AS a FROM hl3 WHERE k IS NOT NULL
          AND NOT coalesce(k <> '' AND c < 3 AND p = 'H' || k, false) GROUP BY doc_id) USING (doc_id)
        GROUP BY source"""),
    "header_levels": sql("""SELECT doc_id, level::INT AS level,
        (CASE WHEN high - low + 1 > n THEN low + k ELSE level END)::INT AS new_level FROM used"""),
    "render_table": sql("SELECT doc_id, md FROM tables"),
    "picture_blocks": sql("SELECT doc_id, block_no::INT AS block_no, block FROM blocks"),
    "picture_rows": sql("SELECT doc_id, block_no::INT AS block_no, row_no::INT AS row_no, row FROM rows"),
    "split_columns": sql("""SELECT doc_id, block_no::INT AS block_no, row_no::INT AS row_no, len(cols)::INT AS n_cols,
        array_to_string(cols, '¦') AS cells FROM rows"""),
    "modal_width": sql("""SELECT doc_id, block_no::INT AS block_no, n_rows::INT AS n_rows, width::INT AS width,
        matching::INT AS matching, tabular FROM shapes"""),
    "fit_row": sql("""SELECT doc_id, block_no::INT AS block_no, row_no::INT AS row_no, array_to_string(cells, '¦') AS cells
        FROM fitted WHERE tabular"""),
    "render_block": sql("SELECT doc_id, block_no::INT AS block_no, md FROM rendered"),
    "table_islands": sql("""SELECT doc_id, i::INT AS first_line, n_rows::INT AS n_rows, n_rows > 1 AND sep_next AS has_separator
        FROM tl3 WHERE is_row AND r = 1"""),
    "enumerate_pages": sql("SELECT doc_id, page_no, text FROM paged"),
    "pages_from_text": sql("SELECT doc_id, (i + 1)::INT AS page_no, line AS text FROM doc_lines"),
    "assemble_doc": sql("SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS text FROM paged GROUP BY doc_id"),
    "assemble_turns": """SELECT conv_id AS doc_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "assemble_arrays": sql("""SELECT doc_id, string_agg(mark || f.text || chr(10) || chr(10) || '-----' || chr(10), chr(10) ORDER BY page_no) AS text
        FROM page_marks JOIN formatted_pages f USING (doc_id, page_no) GROUP BY doc_id"""),
    "page_markers": sql("SELECT doc_id, page_no, mark || text AS text FROM page_marks"),
    "page_separators": sql("SELECT doc_id, page_no, text || chr(10) || chr(10) || '-----' || chr(10) AS text FROM paged"),
    "provenance_header": f"SELECT doc_id, {provenance(STEM)} || text AS text FROM documents",
    "page_tables": sql("""SELECT doc_id, 1 AS page_no, 'Page of ' || doc_id || chr(10) || chr(10) || md || chr(10)
        || chr(10) || chr(10) || chr(10) AS text FROM tables"""),
    "strip_headers_footers": sql("SELECT doc_id, page_no, text FROM stripped_pages"),
    "strip_page_table": sql("SELECT doc_id, page_no, text FROM stripped_pages"),
    "image_manifest": sql("SELECT doc_id, page_no, img_no, name, 'images/d' || doc_id || '/' || name AS path FROM images"),
    "attach_images": sql("""SELECT doc_id, page_no, text || coalesce(links, '') AS text FROM paged LEFT JOIN (
        SELECT doc_id, page_no, string_agg(chr(10) || chr(10) || '![' || name || '](images/d' || doc_id || '/' || name || ')' || chr(10), ''
          ORDER BY img_no) AS links FROM images GROUP BY doc_id, page_no) USING (doc_id, page_no)"""),
    "embed_images": sql("SELECT doc_id, page_no, img_no, 'data:image/png;base64,' || base64(encode(line)) AS uri FROM images"),
    "paragraphs": sql("SELECT doc_id, n::INT AS para_no, p AS paragraph FROM paras"),
    "chunk_pack": sql("SELECT doc_id, chunk_no::INT AS chunk_no, chunk FROM packed_small"),
    "chunk_documents": sql("SELECT doc_id, chunk_no::INT AS chunk_no, n_chunks, chunk FROM chunks"),
    "chunk_requests": sql("""SELECT doc_id, chunk_no::INT AS chunk_no, chunk, (chunk_no + 1) || '/' || n_chunks AS position,
        'Tidy this text.' AS instruction FROM chunks"""),
    "map_chunks": sql("""SELECT doc_id, chunk_no::INT AS chunk_no, n_chunks, replace(chunk, ' ', '_') AS result,
        NULL::VARCHAR AS error FROM chunks"""),
    "reassemble": sql("SELECT doc_id, text FROM paras_text"),
    "fallback_to_original": sql(f"""SELECT doc_id, CASE WHEN doc_id % 10 IN (1, 2) THEN text ELSE r END AS text,
          doc_id % 10 NOT IN (1, 2) AS transformed
        FROM paras_text JOIN (SELECT doc_id, {strip("string_agg(' <' || chunk || '> ', chr(10) || chr(10) ORDER BY chunk_no)")} AS r
          FROM chunks GROUP BY doc_id) USING (doc_id)"""),
    "transform_documents": sql(f"""SELECT doc_id, {strip("replace(text, ' ', '_')")} AS text, true AS transformed FROM paras_text"""),
    **{
        name: sql(f"""SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
          FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM {source})""")
        for name, source, text in (
            ("long_artifacts", "noisy", no_placeholders("replace(text, '�', '')")),
            ("long_picture_blocks", "pictured", "text"),
            ("long_headers", "deduped", "text"),
            ("long_blank_lines", "noisy", squeeze(rstrip_lines("text"))),
            ("long_levels", "levelled", "text"),
            ("long_tables", "repaired", "text"),
            ("cleanup_lines", "clean", "text[:-2]"),
        )
    },
    "paragraph_rows": sql("SELECT doc_id, n AS para_no, p AS paragraph FROM paras"),
    "pack_paragraphs": sql("SELECT doc_id, chunk_no::BIGINT AS chunk_no, chunk FROM packed_small"),
    "structure_profile": sql("SELECT * EXCLUDE (source) FROM profiles"),
    "profile_totals": sql(f"""SELECT source, count(*) AS n_docs, {", ".join(f"sum({c})::BIGINT AS {c}" for c in (
        "n_chars", "n_lines", "n_headers", "n_picture_blocks", *(f"n_{k}" for k in KINDS),
        *(f"removed_{s}" for s in ("artifacts", "pictures", "headers", "blanks", "levels", "tables", "end"))))} FROM profiles GROUP BY source"""),
    "sql_transform": sql("""SELECT doc_id, chunk_no::INT AS chunk_no, n_chunks, replace(chunk, ' ', '_') AS result,
        NULL::VARCHAR AS error FROM chunks"""),
    "sql_pages": sql("""SELECT doc_id, page_no, text, NULL::VARCHAR AS error FROM paged JOIN page_counts USING (doc_id) WHERE n > 1
        UNION ALL SELECT doc_id, NULL, NULL, 'ValueError: single page' FROM page_counts WHERE n = 1"""),
    "written_counts": sql("SELECT CASE WHEN n = 1 THEN 'failed' ELSE 'written' END AS status, count(*) AS n FROM page_counts GROUP BY 1"),
    "timed_chunks": sql("""SELECT doc_id, chunk_no::INT AS chunk_no, n_chunks,
        CASE WHEN length(chunk) % 499 <> 7 THEN replace(chunk, ' ', '_') END AS result,
        CASE WHEN length(chunk) % 499 = 7 THEN 'time-out' END AS error FROM chunks"""),
    "cascade_documents": sql(f"""SELECT doc_id, CASE mode WHEN 'chunks' THEN {strip("replace(text, ' ', '_')")}
          WHEN 'whole' THEN '<' || text || '>' ELSE text END AS text, mode
        FROM (SELECT doc_id, text, CASE WHEN done THEN 'chunks' WHEN length(text) % 2 = 0 THEN 'whole' END AS mode
          FROM paras_text LEFT JOIN first_mode USING (doc_id))"""),
    "cascade_attempts": sql("""SELECT doc_id, 'chunks' AS mode, n_calls, n_failed, n_blank,
          CASE WHEN n_failed > 0 THEN 'ValueError: every third' END AS error FROM first_mode
        UNION ALL SELECT doc_id, 'whole', 1, 0, length(text) % 2, NULL
        FROM paras_text JOIN first_mode USING (doc_id) WHERE NOT done"""),
    "validate_inputs": sql("""SELECT doc_id, path, ends_with(lower(path), '.pdf') AS accepted,
        CASE WHEN NOT ends_with(lower(path), '.pdf') THEN 'not a PDF: ' || path END AS reason FROM named"""),
    "with_identity": sql(r"""SELECT doc_id, rel_path, path, name, stem, '/in/' || folder || stem || '.md' AS beside,
        '/out/' || stem || '.md' AS flat,
        '/out/' || folder || regexp_replace(name, '\.(pdf|PDF)$', '') || '.md' AS tree FROM named"""),
    "url_identity": r"""SELECT page_id, url AS path, regexp_extract(url, '[^/]*$') AS name,
        regexp_replace(regexp_extract(url, '[^/]*$'), '([^.])\.[^.]+$', '\1') AS stem,
        '/out/' || regexp_replace(regexp_extract(url, '[^/]*$'), '([^.])\.[^.]+$', '\1') || '.md' AS out_path FROM pages""",
    "corpus_listing": sql("SELECT '/in/' || folder AS folder, count(*) AS n_files FROM named GROUP BY folder"),
    "scan_flat": f"SELECT {FILE_NAME} AS name, text FROM documents",
    "scan_tree": f"""SELECT CASE WHEN source = 'src1' THEN '_src1/in' ELSE source END || '/' || {FILE_NAME} AS rel_path, text FROM documents""",
    "write_markdown": f"""SELECT doc_id, {FILE_NAME} AS name, 'written' AS status, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "exported_images": sql("""SELECT 'images/' || source || '-' || doc_id || '/' || name AS rel_path, line AS content
        FROM images JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"""),
    "exported_manifest": sql("""SELECT 'text' AS kind, '/in/' || source || '-' || doc_id || '.pdf' AS path,
          source || '-' || doc_id || '.md' AS name, 'written' AS status, NULL::VARCHAR AS error FROM documents
        UNION ALL SELECT 'image', '/in/' || source || '-' || doc_id || '.pdf#' || (i // 4 + 1) || '.' || (i % 4 + 1),
          'page_' || (i // 4 + 1) || '_img_' || (i % 4 + 1) || '.png', CASE WHEN contains(line, '|') THEN 'failed' ELSE 'written' END,
          CASE WHEN contains(line, '|') THEN 'no content' END FROM doc_lines"""),
    "file_fates": f"""SELECT name, fate, CASE WHEN length(t) % 10 = 0 THEN 'failed' ELSE 'converted' END AS outcome,
          CASE WHEN length(t) % 10 = 0 THEN 'a multiple of ten' END AS error FROM ({CHANGED})""",
    "changed_corpus": f"""SELECT CASE WHEN source = 'src1' THEN '_src1/in' ELSE source END || '/' || name AS rel_path, t AS text,
          CASE WHEN length(t) % 10 = 0 THEN 'a multiple of ten' END AS error FROM ({CHANGED}) WHERE fate <> 'deleted'""",
    "folder_listing": """SELECT CASE WHEN source = 'src1' THEN '_src1/in' ELSE source END || '/' AS folder, count(*) AS n,
          sum(strlen(text))::BIGINT AS bytes, count(*) AS dated FROM documents GROUP BY source""",
    "path_collisions": sql("""SELECT '/out/' || stem || '.md' AS out_path, count(*) AS n,
        max(struct_pack(upper := ends_with(path, '.PDF'), path := path)).path AS kept FROM named GROUP BY stem HAVING count(*) > 1"""),
    "superseded_outputs": sql("""SELECT doc_id, '/out/' || stem || '.md' AS out_path,
        row_number() OVER (PARTITION BY stem ORDER BY path || '#' || lpad(doc_id::VARCHAR, 9, '0') DESC) > 1 AS superseded FROM named"""),
    "extract_pages": sql("SELECT doc_id, page_no, text FROM paged JOIN page_counts USING (doc_id) WHERE n > 1"),
    "quarantine": sql("SELECT doc_id, 'ValueError: single page' AS error FROM page_counts WHERE n = 1"),
    "manifest": sql(f"""SELECT '/out/' || {STEM} || '.md' AS out_path, CASE WHEN n = 1 THEN 'failed' ELSE 'written' END AS status,
        CASE WHEN n = 1 THEN 'ValueError: single page' END AS error FROM page_counts"""),
    "manifest_counts": sql("""SELECT CASE WHEN n = 1 THEN 'failed' ELSE 'written' END AS status, count(*) AS n
        FROM page_counts GROUP BY 1"""),
    "convert_pages": texts("conv_clean"),
    "convert_stripped": texts("strip_clean"),
}
