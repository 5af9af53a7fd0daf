"""The queries in SQL over the same tables, for checking results."""

from __future__ import annotations

EVENTS = """ev AS (
  SELECT event_id AS seq, event_type || ':' || CAST(user_id % 50 AS VARCHAR) AS key FROM events),
cut AS (SELECT max(event_id) * 8 // 10 AS c FROM events)"""
SNAPSHOT = f"""{EVENTS},
snap AS (SELECT key, count(*) AS n FROM ev WHERE seq <= (SELECT c FROM cut) GROUP BY key)"""
EDITED = f"""{SNAPSHOT},
top AS (SELECT key FROM snap ORDER BY key DESC LIMIT 5),
edited AS (SELECT key, CASE WHEN key IN (SELECT key FROM top) THEN 0 ELSE n END AS n FROM snap)"""
LATE = "late AS (SELECT seq, key FROM ev WHERE seq > (SELECT c FROM cut))"
NUMBERED = "row_number() OVER (PARTITION BY key ORDER BY seq)"
WORDS = """words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS key,
         unnest(range(len(string_split(text, ' ')))) AS pos
  FROM documents)"""
WORD_DROPS = f"""{WORDS},
cut AS (SELECT max(doc_id) * 8 // 10 AS c FROM documents),
early AS (SELECT key, count(*) AS n FROM words WHERE doc_id <= (SELECT c FROM cut) GROUP BY key),
late AS (SELECT key, count(*) AS n FROM words WHERE doc_id > (SELECT c FROM cut) GROUP BY key)"""
DRAWS = """idx AS (
  SELECT event_id AS seq,
         CAST('0x' || substr(md5(event_id || ':42'), 1, 15) AS BIGINT) AS h FROM events),
draws AS (
  SELECT seq, chr(CAST(97 + i // 676 AS INT)) || chr(CAST(97 + i // 26 % 26 AS INT))
              || chr(CAST(97 + i % 26 AS INT)) AS word
  FROM (SELECT seq, h % 17576 AS i FROM idx))"""
BYTES = "b AS (SELECT page_id, html, hex(encode(html)) AS h, octet_length(encode(html)) AS size FROM pages)"
PAGE_FILES = """files AS (SELECT page_id // 100 AS part, string_agg(html || chr(10), '' ORDER BY page_id) AS html
  FROM pages GROUP BY page_id // 100)"""
DUMP = f"""{EVENTS},
st AS (SELECT hex(encode(key)) AS k, count(*) AS n FROM ev GROUP BY key),
val AS (SELECT k, n, '00000004' || lpad(to_hex(n), 8, '0') AS v FROM st),
dump AS (
  SELECT CASE n % 4
    WHEN 0 THEN k || ' seq:' || n || ' => ' || v
    WHEN 1 THEN '''' || k || ''' seq:' || n || ' = ' || v
    WHEN 2 THEN '''x' || k || ''' seq:' || n || ' => ' || v || ' => z'
    ELSE '''' || k || ''' seq:' || n || ', type:1 => ' || v END AS value
  FROM val)"""


def _hex_digits(text: str) -> str:
    digits = f"regexp_replace({text}, '[^0-9a-fA-F]', '', 'g')"
    return f"substr({digits}, 1, length({digits}) - length({digits}) % 2)"


def _double_hex(number: str) -> str:
    """The bits of a double as sixteen hex digits."""
    bits = f"CAST(CAST({number} AS BIT) AS VARCHAR)"
    return f"""array_to_string(list_transform(range(0, 16), lambda i: upper(to_hex(CAST(
      list_sum(list_transform(range(0, 4), lambda k: CAST(substr({bits}, 4 * i + k + 1, 1) AS INT) * (8 >> CAST(k AS INT)))) AS BIGINT)))), '')"""


def _spaced(digits: str) -> str:
    return f"rtrim(regexp_replace(lower({digits}), '(..)', '\\1 ', 'g'))"


def _ascii(digits: str) -> str:
    """Printable text of a short hex string."""
    return f"""array_to_string(list_transform(regexp_extract_all({digits}, '..'),
      lambda p: CASE WHEN p BETWEEN '20' AND '7E' THEN chr(CAST('0x' || p AS INT)) ELSE '.' END), '')"""


def _offset(needle: str) -> str:
    """Byte offset of the first match in ``html``."""
    return f"""CASE WHEN contains(html, '{needle}')
      THEN octet_length(encode(split_part(html, '{needle}', 1))) ELSE -1 END"""


def _parsed(key: str, value: str) -> str:
    good = "regexp_full_match({0}, '[0-9a-fA-F]*') AND length({0}) % 2 = 0"
    return f"""WITH {DUMP},
cuts AS (SELECT value, instr(value, ' => ') AS a FROM dump),
parts AS (
  SELECT value, a, CASE WHEN a > 0 THEN substr(value, 1, a - 1) END AS l,
         CASE WHEN a > 0 THEN substr(value, a + 4) END AS r FROM cuts),
parsed AS (SELECT value, a, {key} AS key_hex, {value} AS value_hex FROM parts)
SELECT value, key_hex, value_hex,
       CASE WHEN a = 0 THEN 'no_arrow'
            WHEN NOT coalesce({good.format('key_hex')}, true) OR NOT ({good.format('value_hex')})
            THEN 'bad_hex' ELSE 'ok' END AS status
FROM parsed"""


QUOTED = "CASE WHEN regexp_matches(l, '''[^'']*''') THEN regexp_extract(l, '''([^'']*)''', 1)"


def _context(start: str, stop: str, width: str, mark: str, h: str = "h") -> str:
    return f"""WITH {BYTES},
f AS (SELECT page_id, h, size, {_offset('<p')} AS off FROM b),
o AS (SELECT page_id, {h} AS h, size, off FROM f),
w AS (SELECT page_id, h, off, {start} AS s, {stop} AS e FROM o),
r AS (SELECT page_id, h, off, e, unnest(range(s, e, 16)) AS row_offset FROM w WHERE s < e),
c AS (SELECT page_id, off, row_offset, off >= row_offset AND off < row_offset + 16 AS is_target,
             {_spaced(f"substr(h, 2 * row_offset + 1, 2 * ({width}))")} AS hex FROM r)
SELECT page_id, CAST(row_offset AS INT) AS row_offset, hex, is_target,
       lpad(lower(to_hex(row_offset)), 8, '0') || ': ' || rpad(hex, 47, ' ')
         || CASE WHEN is_target THEN '{mark}' || off ELSE '' END AS line
FROM (SELECT * REPLACE (CAST(row_offset AS BIGINT) AS row_offset) FROM c)"""


def _u32(start: int, little: bool) -> str:
    pairs = [f"substr(h, {2 * (start + i) + 1}, 2)" for i in range(4)]
    digits = " || ".join(pairs[::-1] if little else pairs)
    return f"CASE WHEN size >= {start + 4} THEN CAST('0x' || {digits} AS BIGINT) END"


REQUESTS = """p AS (SELECT page_id, html, h, size, CASE page_id % 8
    WHEN 0 THEN 100 WHEN 1 THEN size - 4 WHEN 2 THEN size - 3 WHEN 3 THEN size WHEN 4 THEN -1
    WHEN 5 THEN 100 WHEN 6 THEN page_id % 64 END AS pos FROM b),
s AS (SELECT *, CASE WHEN page_id % 8 = 5 THEN 'bad_hex'
    WHEN pos IS NULL OR pos < 0 OR pos >= size THEN 'out_of_range' WHEN pos + 4 > size THEN 'too_long'
    ELSE 'ok' END AS status FROM p)"""
PATCHED = "substr(h, 1, 2 * pos) || '05000000' || substr(h, 2 * pos + 9)"
RUNNING = f"WITH {EVENTS} SELECT key, {NUMBERED} AS n FROM ev"
FINAL = f"WITH {EVENTS} SELECT key, count(*) AS n FROM ev GROUP BY key"
SNAP = f"WITH {SNAPSHOT} SELECT key, n FROM snap"
STATE_AFTER = f"""WITH {EDITED}, {LATE}
SELECT key, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT key, n FROM edited UNION ALL SELECT key, count(*) FROM late GROUP BY key) GROUP BY key"""


def _resumed(base: str, columns: str) -> str:
    ctes = EDITED if base == "edited" else SNAPSHOT
    return f"""WITH {ctes}, {LATE}
SELECT {columns}, coalesce(s.n, 0) + row_number() OVER (PARTITION BY l.key ORDER BY l.seq) AS n
FROM late l LEFT JOIN {base} s ON s.key = l.key"""


def all_sql() -> dict[str, str]:
    return {
        "running_count": f"WITH {EVENTS} SELECT seq, key, {NUMBERED} AS n FROM ev",
        "running_count_split": f"WITH {EVENTS} SELECT seq, key, {NUMBERED} AS n FROM ev",
        "word_running_count": f"""WITH {WORDS} SELECT doc_id, CAST(pos AS INT) AS pos, key,
  row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM words""",
        "emitted_counts": RUNNING,
        "final_count": FINAL,
        "render_tuple": f"""SELECT '(' || key || ',' || n || ')' AS line, key, n FROM ({RUNNING})""",
        "draw_words": f"WITH {DRAWS} SELECT seq, word FROM draws",
        "draw_from_vocab": f"""WITH {DRAWS}, {WORDS},
ws AS (SELECT DISTINCT key AS word FROM words),
numbered AS (
  SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 3), word) - 1 AS id FROM ws)
SELECT i.seq, v.word FROM idx i
JOIN numbered v ON v.id = i.h % (SELECT count(*) FROM ws)""",
        "vocab": f"""WITH {DRAWS},
v AS (
  SELECT id, chr(CAST(97 + id // 676 AS INT)) || chr(CAST(97 + id // 26 % 26 AS INT))
             || chr(CAST(97 + id % 26 AS INT)) AS word
  FROM (SELECT unnest(range(17576)) AS id))
SELECT v.id, v.word, count(d.word) AS n FROM v LEFT JOIN draws d ON d.word = v.word GROUP BY v.id, v.word""",
        "vocab_stats": """SELECT CAST(17576 AS BIGINT) AS combinations, count(*) AS draws,
  count(*) / 17576.0::DOUBLE AS per_combination,
  printf('%.1f', count(*) / 17576.0::DOUBLE) AS per_combination_text FROM events""",
        "vocab_head_tail": f"""WITH {DRAWS}, d AS (SELECT DISTINCT word FROM draws)
SELECT * FROM (SELECT word, 'first' AS part FROM d ORDER BY word LIMIT 10)
UNION ALL SELECT * FROM (SELECT word, 'last' AS part FROM d ORDER BY word DESC LIMIT 10)""",
        "collection_source": f"WITH {DRAWS} SELECT seq, word FROM draws",
        "snapshot_at": SNAP,
        "snapshot_scan": f"{FINAL} ORDER BY key",
        "snapshot_versions": f"""WITH {EDITED}
SELECT key, n, 0 AS version FROM snap UNION ALL SELECT key, n, 1 AS version FROM edited""",
        "edit_last_n": f"WITH {EDITED} SELECT key, n FROM edited",
        "edit_last_n_raw": f"""WITH {EDITED}
SELECT key, CASE WHEN key IN (SELECT key FROM top) THEN repeat('0', 16)
            ELSE '00000004' || lpad(to_hex(n), 8, '0') END AS value FROM snap""",
        "suffix_last": f"""WITH {SNAPSHOT}
SELECT key, CASE WHEN key = (SELECT max(key) FROM snap) THEN n || '_modified'
            ELSE CAST(n AS VARCHAR) END AS value FROM snap""",
        "tail_n": f"""WITH {EDITED}
SELECT * FROM (SELECT key, n, 0 AS version FROM snap ORDER BY key DESC LIMIT 5)
UNION ALL SELECT * FROM (SELECT key, n, 1 AS version FROM edited ORDER BY key DESC LIMIT 5)""",
        "last_record": f"WITH {SNAPSHOT} SELECT key, n FROM snap ORDER BY key DESC LIMIT 1",
        "snapshot_diff": f"""WITH {EDITED}
SELECT key, s.n AS n_before, e.n AS n_after FROM snap s JOIN edited e USING (key)
WHERE s.n IS DISTINCT FROM e.n""",
        "edit_report": f"""WITH {SNAPSHOT}
SELECT count(*) AS total, least(count(*), 5) AS replaced FROM snap""",
        "resume": _resumed("snap", "l.seq, l.key"),
        "resume_edited": _resumed("edited", "l.seq, l.key"),
        "state_after_resume": STATE_AFTER,
        "stream_running_count": RUNNING,
        "stream_word_running_count": f"""WITH {WORDS}
SELECT key, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM words""",
        "stream_word_snapshot_at": f"WITH {WORD_DROPS} SELECT key, n FROM early",
        "stream_word_changes": f"""WITH {WORD_DROPS}
          SELECT late.key, early.n AS n_before, coalesce(early.n, 0) + late.n AS n_after
          FROM late LEFT JOIN early ON late.key = early.key""",
        "stream_word_resume_edited": f"""WITH {WORD_DROPS},
          top AS (SELECT key FROM early ORDER BY key DESC LIMIT 5),
          edited AS (SELECT key, CASE WHEN key IN (SELECT key FROM top) THEN 0 ELSE n END AS n FROM early)
          SELECT late.key, coalesce(edited.n, 0) + unnest(range(1, late.n + 1)) AS n
          FROM late LEFT JOIN edited ON late.key = edited.key""",
        "stream_restart": RUNNING,
        "stream_snapshot_at": SNAP,
        "stream_resume": _resumed("snap", "l.key"),
        "stream_resume_edited": _resumed("edited", "l.key"),
        "stream_state_after_resume": STATE_AFTER,
        "file_arrivals_edit": f"""WITH {SNAPSHOT}
SELECT key, CASE WHEN row_number() OVER (PARTITION BY split_part(key, ':', 1) ORDER BY key DESC) <= 5
            THEN 0 ELSE n END AS n FROM snap""",
        "largest_file": """SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id,
  max(n_chars) AS n_chars FROM documents GROUP BY source""",
        "largest_page": """WITH f AS (
  SELECT url AS path, octet_length(encode(html)) AS length,
         regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages WHERE NOT url LIKE '%/')
SELECT folder, path, length FROM f WHERE length > 0
QUALIFY row_number() OVER (PARTITION BY folder ORDER BY length DESC, path) = 1""",
        "file_filter": """SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name FROM pages
WHERE url LIKE '%.html' AND NOT url LIKE '%/'""",
        "binary_scan": f"""WITH {BYTES}
SELECT page_id, size AS length, substr(h, 1, 32) AS head, md5(html) AS md5 FROM b""",
        "signature_check": f"""WITH {BYTES},
s AS (SELECT page_id, h, size, CASE page_id % 3 WHEN 0 THEN h || 'F7CFF485B741E288' WHEN 1 THEN left(h, 12) ELSE h END AS k FROM b)
SELECT page_id,
  CASE WHEN length(k) < 16 THEN 'too_small' WHEN right(k, 16) = 'F7CFF485B741E288' THEN 'ok'
       ELSE 'bad_signature' END AS store_status,
  CASE WHEN size < 8 THEN 'too_small' WHEN right(h, 16) = hex(encode('></html>')) THEN 'ok'
       ELSE 'bad_signature' END AS page_status FROM s""",
        "byte_search": f"SELECT page_id, {_offset('<p')} AS \"offset\" FROM pages",
        "byte_search_encodings": f"""SELECT page_id, label, off AS "offset", pattern FROM (
  SELECT page_id, 'exact' AS label, {_offset('p/<.>p<>')} AS off,
         hex(encode('p/<.>p<>')) AS pattern FROM pages
  UNION ALL SELECT page_id, 'pair_le', {_offset('.</p><p>')},
         hex(encode('.</p><p>')) FROM pages
  UNION ALL SELECT page_id, 'first_le', {_offset('.</p')},
         hex(encode('.</p')) FROM pages
  UNION ALL SELECT page_id, 'second_le', {_offset('><p>')},
         hex(encode('><p>')) FROM pages)
WHERE off >= 0""",
        "prefix_search": """SELECT page_id, 1 AS prefix_len,
  octet_length(encode(regexp_extract(html, '^[^À-ÿ]*'))) AS "offset"
FROM pages WHERE regexp_matches(html, '[À-ÿ]')""",
        "byte_patch": f"""WITH {BYTES}, {REQUESTS}
SELECT page_id, status,
  CASE WHEN status = 'ok' THEN substr(h, 2 * pos + 1, 8) END AS original,
  CASE WHEN status = 'ok' THEN md5(unhex({PATCHED})) ELSE md5(html) END AS md5
FROM s""",
        "patch_requests": f"""WITH {BYTES}, {REQUESTS},
c AS (SELECT page_id, h, pos, 2 * greatest(0, pos - 16) + 1 AS f, CASE WHEN page_id % 8 = 5 THEN 'ok' ELSE status END AS status,
             CASE WHEN page_id % 8 = 5 THEN '05' ELSE '05000000' END AS new FROM s)
SELECT page_id, pos AS "offset", status,
  CASE WHEN status = 'ok' THEN {_spaced("substr(h, f, 96)")} END AS before,
  CASE WHEN status = 'ok'
    THEN {_spaced("substr(substr(h, 1, 2 * pos) || new || substr(h, 2 * pos + 1 + length(new)), f, 96)")} END AS after
FROM c""",
        "hex_dump": f"""WITH {BYTES},
r AS (SELECT page_id, h, unnest(range(0, size, 16)) AS o FROM b),
c AS (SELECT page_id, o, substr(h, 2 * o + 1, 32) AS c FROM r)
SELECT page_id, CAST(o AS INT) AS "offset", {_spaced('c')} AS hex, {_ascii('c')} AS ascii,
  lpad(lower(to_hex(o)), 8, '0') || ': '
  || rpad(regexp_replace(lower(substr(c, 1, 16)), '(..)', '\\1 ', 'g'), 24, ' ') || ' '
  || rpad(regexp_replace(lower(substr(c, 17)), '(..)', '\\1 ', 'g'), 24, ' ')
  || ' |' || {_ascii('c')} || '|' AS line
FROM c""",
        "hex_context": _context(
            "greatest(0, off - 16)", "least(size, greatest(0, off - 16) + 48)",
            "least(16, e - row_offset)", " <== patch at ",
        ),
        "hex_match_context": _context(
            "CASE WHEN off >= 0 THEN greatest(0, off - 16) END", "least(size, off + 18)",
            "16", "  <== match at ",
        ),
        "patched_context": _context(
            "greatest(0, off - 16)", "least(size, greatest(0, off - 16) + 48)",
            "least(16, e - row_offset)", " <== patch at ",
            "CASE WHEN off >= 0 AND off + 4 <= size "
            "THEN substr(h, 1, 2 * off) || '05000000' || substr(h, 2 * off + 9) ELSE h END",
        ),
        "checksum_verify": f"""WITH {BYTES},
t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 2197175160) ELSE c // 2 END, i)) AS tab),
k AS (SELECT page_id, h, size, CASE page_id % 3 WHEN 0 THEN h WHEN 1 THEN '' ELSE left(h, greatest(0, 2 * size - 16)) END AS body FROM b),
d AS (SELECT page_id, size, h, list_transform(regexp_extract_all(body, '..'),
        lambda p: CAST('0x' || p AS BIGINT)) AS data FROM k),
c AS (SELECT page_id, size, h,
        xor(list_reduce(data, lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS computed
      FROM d, t),
v AS (SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN computed END AS computed,
        CASE page_id % 3 WHEN 0 THEN computed WHEN 2 THEN
          CAST('0x' || substr(h, 2 * size - 1, 2) || substr(h, 2 * size - 3, 2)
               || substr(h, 2 * size - 5, 2) || substr(h, 2 * size - 7, 2) AS BIGINT) END AS stored FROM c)
SELECT page_id, computed, stored,
  CASE WHEN computed IS NULL THEN 'too_small' WHEN computed = stored THEN 'ok' ELSE 'mismatch' END AS status
FROM v""",
        "last_record_offset": f"""WITH {BYTES},
r AS (SELECT page_id, h, unnest(range(4)) AS seq FROM b),
l AS (SELECT page_id, substr(h, 1 + 32 * seq, 8) AS k, CASE WHEN page_id % 5 = 0 THEN reverse(substr(h, 129 + 64 * seq, 16))
             ELSE substr(h, 129 + 64 * seq, 16) END AS v FROM r),
m AS (SELECT page_id, max((k, v)) AS m FROM l GROUP BY page_id),
n AS (SELECT page_id, m[1] AS key_hex, m[2] AS value_hex FROM m),
p AS (SELECT page_id, h, unnest(range(size - 7)) AS i FROM b),
f AS (SELECT page_id, min(i) AS i FROM p JOIN n USING (page_id) WHERE substr(h, 2 * i + 1, 16) = value_hex GROUP BY page_id)
SELECT n.page_id, key_hex, value_hex, coalesce(i, -1) AS "offset" FROM n LEFT JOIN f USING (page_id)""",
        "encoding_contexts": f"""WITH {BYTES},
e AS (SELECT page_id, html, h, size, unnest([
    {{'label': 'exact', 'off': {_offset('p/<.>p<>')}, 'len': 8}}, {{'label': 'pair_le', 'off': {_offset('.</p><p>')}, 'len': 8}},
    {{'label': 'first_le', 'off': {_offset('.</p')}, 'len': 4}}, {{'label': 'second_le', 'off': {_offset('><p>')}, 'len': 4}}]) AS m FROM b),
g AS (SELECT page_id, h, size, m.label AS label, m.off AS off, m.len AS len FROM e WHERE m.off >= 0),
a AS (SELECT * FROM g UNION ALL
      SELECT page_id, h, size, 'prefix', {_offset('p')}, 1 FROM b WHERE page_id NOT IN (SELECT page_id FROM g)),
w AS (SELECT *, greatest(0, off - 16) AS s, least(size, off + len + 16) AS e FROM a WHERE off >= 0),
r AS (SELECT page_id, label, h, off, unnest(range(s, e, 16)) AS o FROM w WHERE s < e),
x AS (SELECT page_id, label, CAST(o AS INT) AS row_offset, off, off >= o AND off < o + 16 AS is_target,
             {_spaced("substr(h, 2 * o + 1, 32)")} AS hex FROM r)
SELECT page_id, row_offset, label, hex, is_target, lpad(lower(to_hex(row_offset)), 8, '0') || ': ' || rpad(hex, 47, ' ')
  || CASE WHEN is_target THEN '  <== match at ' || off ELSE '' END AS line FROM x""",
        "largest_version_file": f"""WITH {SNAPSHOT}
SELECT version, count(*) AS entries FROM snap, (SELECT unnest([0, 1]) AS version) GROUP BY version""",
        "file_arrivals": f"""WITH {SNAPSHOT}
SELECT DISTINCT split_part(key, ':', 1) AS kind, 'ok' AS status, 'ok' AS message FROM snap
UNION ALL SELECT 'broken', 'error', 'bad_signature'""",
        "snapshot_metadata": f"""WITH {EVENTS} SELECT 'default' AS store, 'count' AS variables, CAST(0 AS BIGINT) AS first_batch,
  CAST(count(DISTINCT split_part(key, ':', 1)) - 1 AS BIGINT) AS last_batch, count(DISTINCT key) AS entries FROM ev""",
        "file_changes": f"""WITH {SNAPSHOT},
kinds AS (SELECT DISTINCT split_part(key, ':', 1) AS kind FROM snap UNION ALL SELECT 'empty'),
drops AS (SELECT unnest(['early', 'late']) AS "drop", unnest([0, 1]) AS batch)
SELECT "drop", kind, CAST(batch AS INT) AS batch, CASE WHEN kind = 'empty' THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN kind = 'empty' THEN 'too_small' ELSE 'ok' END AS message FROM kinds, drops""",
        "edit_last_n_double": f"""WITH {EDITED},
vals AS (SELECT key, CASE WHEN key IN (SELECT key FROM top) THEN -0.1::DOUBLE ELSE n::DOUBLE END AS n FROM edited)
SELECT key, {_double_hex('n')} AS value, n FROM vals""",
        "double_roundtrip": f"""WITH x AS (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN -l_extendedprice::DOUBLE
    WHEN 1 THEN 1 / l_extendedprice::DOUBLE ELSE l_extendedprice::DOUBLE END AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, {_double_hex('x')} AS bytes, x = x AS same FROM x""",
        "file_range_search": f"""WITH {PAGE_FILES}
SELECT part, 'border' AS label, CAST({_offset('</html>" || chr(10) || "<').replace('"', "'")} AS BIGINT) AS "offset" FROM files
UNION ALL SELECT part, 'tag', CAST({_offset('</p>')} AS BIGINT) FROM files
UNION ALL SELECT part, 'absent', CAST(-1 AS BIGINT) FROM files""",
        "file_range_search_encodings": f"""WITH {PAGE_FILES}, e AS (SELECT part, unnest([
    {{'label': 'exact', 'off': {_offset('p/<.>p<>')}}}, {{'label': 'pair_le', 'off': {_offset('.</p><p>')}}},
    {{'label': 'first_le', 'off': {_offset('.</p')}}}, {{'label': 'second_le', 'off': {_offset('><p>')}}}]) AS m FROM files)
SELECT part, m.label AS label, CAST(m.off AS BIGINT) AS "offset" FROM e WHERE m.off >= 0""",
        "file_range_context": f"""SELECT page_id AS part, CAST(row_offset AS BIGINT) AS row_offset, hex, is_target, line FROM ({
            _context("CASE WHEN off >= 0 THEN greatest(0, off - 16) END", "least(size, off + 20)", "16", "  <== match at ")
            .replace(BYTES, PAGE_FILES + ", b AS (SELECT part AS page_id, html, hex(encode(html)) AS h, octet_length(encode(html)) AS size FROM files)")
            .replace(_offset("<p"), _offset("</p>"))})""",
        "file_range_prefix": f"""WITH {PAGE_FILES} SELECT part, 1 AS prefix_len,
  CAST(octet_length(encode(regexp_extract(html, '^[^À-ÿ]*', 0, 's'))) AS BIGINT) AS "offset"
FROM files WHERE regexp_matches(html, '[À-ÿ]')""",
        "file_range_dump": f"""WITH {PAGE_FILES}, b AS (SELECT part, hex(encode(html)) AS h FROM files),
c AS (SELECT part, unnest(range(0, length(h) // 2, 16)) AS o, unnest(regexp_extract_all(h, '.{{1,32}}')) AS d FROM b),
t AS (SELECT part, o, {_spaced('d')} AS hex, regexp_replace(lower(d), '(..)', '\\1 ', 'g') AS cells, {_ascii('d')} AS ascii FROM c)
SELECT part, CAST(o AS BIGINT) AS "offset", hex, ascii, lpad(lower(to_hex(o)), 8, '0') || ': '
  || rpad(substr(cells, 1, 24), 24, ' ') || ' ' || rpad(substr(cells, 25, 24), 24, ' ') || ' |' || ascii || '|' AS line FROM t""",
        "file_range_checksum": f"""WITH {PAGE_FILES}
SELECT part, CAST(octet_length(encode(html)) AS BIGINT) AS length, html = html AS same FROM files""",
        "extract_id": """WITH l AS (
  SELECT conv_id, turn, CASE WHEN role = 'assistant'
    THEN text || chr(10) || 'Job has been submitted with JobID ' || md5(text) ELSE text END AS line
  FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(line, 'JobID [a-f0-9]{32}')
  THEN regexp_extract(line, 'JobID ([a-f0-9]{32})', 1) END AS job_id FROM l""",
        "extract_path": """WITH l AS (
  SELECT page_id, CASE WHEN length(url) % 2 = 0
    THEN html || chr(10) || 'Savepoint completed. Path: file:' || url || ' done' || chr(10)
    ELSE html END AS line FROM pages)
SELECT page_id, CASE WHEN contains(line, 'Path: file:')
  THEN regexp_extract(line, '.*Path: file:(\\S*)', 1) END AS path FROM l""",
        "sanitize_hex": f"""SELECT doc_id, length(d) AS digits, md5(d) AS md5
FROM (SELECT doc_id, {_hex_digits('text')} AS d FROM documents)""",
        "hex_roundtrip": f"""WITH {BYTES}
SELECT page_id, md5(h) AS hex_md5, unhex(h) = encode(html) AS same FROM b""",
        "decode_u32_pair": f"""WITH {BYTES},
u AS (SELECT page_id, {_u32(0, False)} AS be1, {_u32(4, False)} AS be2,
             {_u32(0, True)} AS le1, {_u32(4, True)} AS le2, h FROM b)
SELECT page_id, be1, be2, le1, le2,
  substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)
  || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) AS swapped
FROM u""",
        "parse_offset": f"""WITH {WORDS},
p AS (SELECT DISTINCT key AS word, regexp_replace(key, '^\\s+|\\s+$', '', 'g') AS s FROM words),
g AS (SELECT word, s, CASE WHEN s LIKE '-%' THEN -1 ELSE 1 END AS sign,
             regexp_replace(s, '^[+-]|_', '', 'g') AS d FROM p),
k AS (SELECT word, sign,
  regexp_full_match(s, '[+-]?[0-9]+(_[0-9]+)*') AS is_dec,
  regexp_full_match(s, '[+-]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*') AS is_hex,
  ltrim(d, '0') AS dec, ltrim(regexp_replace(d, '^0[xX]', ''), '0') AS hx FROM g)
SELECT word, status, CASE WHEN status = 'ok' THEN CAST(sign * v AS BIGINT) END AS "offset"
FROM (
  SELECT word, sign, v, CASE WHEN NOT (is_dec OR is_hex) THEN 'not_a_number'
    WHEN v IS NULL OR sign * v NOT BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT
    THEN 'too_large' ELSE 'ok' END AS status
  FROM (
    SELECT word, sign, is_dec, is_hex,
      CASE WHEN is_dec THEN TRY_CAST('0' || dec AS HUGEINT)
           WHEN is_hex AND length(hx) <= 16 THEN CAST(CAST('0x0' || hx AS UBIGINT) AS HUGEINT) END AS v
    FROM k))""",
        "dump_lines": f"WITH {DUMP} SELECT value FROM dump",
        "dump_parse": _parsed(f"{QUOTED} ELSE {_hex_digits('l')} END", _hex_digits("r")),
        "dump_parse_quoted": _parsed(f"{QUOTED} END", "trim(r)"),
    }
