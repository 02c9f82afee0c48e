"""SQL with the results of the operators that SQL can express."""

from __future__ import annotations

from framewise.llm import collocations, line_dedup, line_rules, url_classes

BLANK = r"[\x20\x09-\x0D]"

_SYMBOLS, _SEPARATORS = line_rules.SYMBOLS, line_rules.SEPARATORS

LINE_RULES = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  s AS (SELECT r, list_filter(string_split_regex(text, '{BLANK}+'), lambda w: w <> '') AS ws FROM t),
  u AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
  g AS (SELECT r, i, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o AS run
    FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
  c AS (SELECT r, i, (run IS NOT NULL AND count(run) OVER (PARTITION BY r, run) > 1)::INT AS twice FROM g),
  v AS (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS under FROM c),
  n AS (SELECT r, sum(under) AS n_repeat_words FROM v GROUP BY r),
  l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
  a AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled, len(string_split(line, ' ')) AS words,
    length(regexp_replace(line, '[^{_SYMBOLS}]+', '', 'g')) AS symbols, length(regexp_replace(line, '[^{_SEPARATORS}]+', '', 'g')) AS parts FROM l),
  f AS (SELECT *, (regexp_matches(line, '[{_SYMBOLS}{_SEPARATORS}]') AND (symbols * 2 >= words OR (parts >= 4 AND parts * 8 >= words)))
    OR regexp_matches(line, '(?s)!!.*!!.*!!') OR (words >= 5 AND NOT regexp_matches(line, '[.!?…。！？।؟:;]'))
    OR (length(line) <= {line_rules.BOILERPLATE_MAX_CHARS} AND regexp_matches(lower(line), '{"|".join(line_rules.BOILERPLATE)}')) AS fails FROM a),
  d AS (SELECT r, count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS n_dup_lines,
    coalesce(length(string_agg(line, chr(10) ORDER BY k) FILTER (NOT filled OR NOT fails)), 0) AS clean_chars FROM f GROUP BY r),
  j AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^{_SYMBOLS}]+', '', 'g')) AS n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, clean_chars, length(text) AS chars FROM t JOIN s USING (r) JOIN d USING (r) LEFT JOIN n USING (r)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 - clean_chars::DOUBLE / greatest(chars, 1) <= {line_rules.MAX_LOST_SHARE}::DOUBLE AS kept, clean_chars FROM b"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


LINE_DEDUP = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
  x AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
  f AS (SELECT key FROM x WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.MIN_DOCUMENTS}),
  g AS (SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (f.key IS NULL), '') AS kept FROM x LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM t JOIN g USING (r)"""


PHRASES = f"""WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
  p AS (SELECT d, lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece, generate_subscripts(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]'), 1) AS i FROM t),
  w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
  g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
  f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {collocations.MIN_COUNT}),
  s AS (SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r, {collocations.SCALE} * c.a * c.a // (l.a * r.a) AS score FROM c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1 : cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1 :], ' ')),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  ends AS (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a AS longer FROM b WHERE k = 3),
  top AS (SELECT lang, phrase, max(longer) AS longer FROM ends GROUP BY ALL),
  left_over AS (SELECT b.* FROM b LEFT JOIN top USING (lang, phrase) WHERE longer IS NULL OR k = 3 OR 100 * longer < {collocations.COVER_PERCENT} * a),
  o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_over)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= {collocations.TOP}"""


def _rest(url: str) -> str:
    return f"coalesce(CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '')"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"


def _after(url: str) -> str:
    return f"regexp_replace({_rest(url)}, '^[^/?#]*', '')"


def _path(url: str) -> str:
    return f"regexp_extract({_after(url)}, '^[^?#]*')"


def _node(url: str) -> str:
    query = rf"regexp_replace(regexp_replace(regexp_extract({_after(url)}, '^[^?#]*\?([^#]*)', 1), {_quoted(url_classes.TRACKING)}, '', 'g'), '^&', '')"
    plain = rf"regexp_replace({_host(url)}, '^www\.', '') || regexp_replace({_path(url)}, '/+$', '')"
    return f"CASE WHEN contains({url}, '://') THEN {plain} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


def _rule(host: str, path: str, value: int) -> str:
    """The rule's text (0) or its action (1) for the longest rule that fits."""
    cases = [
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, action)[value]}'"
        for action, h, p in sorted(url_classes.RULES, key=lambda r: (-len(r[1] + r[2]), r[0]))
    ]
    return f"CASE {' '.join(cases)} END"


def _target(link: str, url: str) -> str:
    scheme = f"regexp_extract({url}, '^([^:]*)://', 1)"
    site = f"{scheme} || '://' || {_host(url)}"
    return f"""CASE WHEN {link} = '' OR NOT contains({url}, '://') THEN NULL WHEN contains({link}, '://') THEN {link}
      WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link} WHEN starts_with({link}, '/') THEN {site} || {link}
      WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      ELSE {site} || regexp_replace({_path(url)}, '[^/]*$', '') || CASE WHEN {_path(url)} = '' THEN '/' ELSE '' END || {link} END"""


def _found(tag: str, attribute: str) -> str:
    return f"regexp_extract(regexp_extract(coalesce(html, ''), {_quoted(tag)}), {_quoted(attribute)}, 1)"


URL_CLASSES = f"""WITH RECURSIVE p AS (SELECT page_id, url, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node FROM pages),
  k AS (SELECT url, {_found(url_classes.CANONICAL_TAG, url_classes.HREF)} AS link FROM pages
    UNION ALL SELECT url, {_found(url_classes.REFRESH_TAG, url_classes.REFRESH_URL)} FROM pages),
  x AS (SELECT url, {_target('link', 'url')} AS target FROM k),
  e AS (SELECT {_node('url')} AS a, {_node('target')} AS b, target FROM x WHERE target IS NOT NULL),
  two AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
  reach AS (SELECT DISTINCT node, node AS other FROM (SELECT node FROM p UNION SELECT b FROM e) WHERE node IS NOT NULL
    UNION SELECT reach.node, two.b FROM reach JOIN two ON reach.other = two.a),
  cl AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
  said AS (SELECT node, {_rule('host', 'path', 1)} AS action FROM p UNION ALL SELECT b, {_rule(_host('target'), _path('target'), 1)} FROM e),
  decided AS (SELECT class_id, min(action) AS class_action FROM said JOIN cl USING (node) WHERE action IS NOT NULL GROUP BY class_id)
SELECT page_id, host, path, {_rule('host', 'path', 0)} AS rule, coalesce({_rule('host', 'path', 1)}, class_action, 'allow') AS verdict, class_id
FROM p LEFT JOIN cl USING (node) LEFT JOIN decided USING (class_id)"""


def _turn_repair() -> str:
    """Damage, faults, and the cheapest edits worked out from each conversation's last row to its first."""
    v = {s: f"v{s}" for s in range(4)}

    def option(letter: str, cost: str, after: str, line: str = "''") -> str:
        return f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 'r': {line} || {after}.r}}"

    def insert(after: str, role: str) -> str:
        return option("I", "3", after, f"'{role}:' || chr(10)")

    late = "CASE fault WHEN 'truncated' THEN 3 ELSE 0 END"
    own, user, assistant = ("{0} || ':' || text || chr(10)".format(r) for r in ("role", "'user'", "'assistant'"))
    keeps = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
    plain, final = [], []
    for s in range(4):
        stays = [f"CASE WHEN fault IN ('ok', 'truncated') AND left(role, 1) = '{x}' THEN {option('K', late, v[to], own)} END" for x, to in keeps[s]]
        to, line = (3, assistant) if s == 2 else (2, user)
        stays.append(f"CASE WHEN fault IN ('ok', 'truncated') THEN {option('R', f'3 + {late}', v[to], line)} END")
        plain.append(f"list_min(list_filter([{option('D', '4', v[s])}, {', '.join(stays)}], lambda x: x IS NOT NULL)) AS p{s}")
    two = f"least(p2, {insert('p3', 'assistant')})"
    final = [f"least(p0, {insert(two, 'user')}) AS v0", f"least(p1, {insert(two, 'user')}) AS v1", f"{two} AS v2", f"least(p3, {insert('p2', 'user')}) AS v3"]
    end = ["{'c': 0, 'a': '', 'r': ''}", "{'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}", "{'c': 3, 'a': 'I', 'r': 'assistant:' || chr(10)}", "{'c': 0, 'a': '', 'r': ''}"]
    return rf"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  named AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'null') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS codes FROM conversations),
  ruled AS (SELECT k, turn, role, text, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS rule FROM named, tab),
  damaged AS (SELECT k, turn, CASE rule WHEN 4 THEN 'user' ELSE role END AS role, CASE rule WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE rule WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM ruled WHERE rule <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
  marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'ok' END AS fault, left(lag(role) OVER (PARTITION BY k ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
  counts AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY k),
  walk AS (SELECT k, n AS i, {', '.join(f'{e} AS v{s}' for s, e in enumerate(end))} FROM counts
    UNION ALL SELECT k, i, {', '.join(final)} FROM (SELECT w.k, w.i - 1 AS i, {', '.join(plain)} FROM walk w JOIN marked m ON w.k = m.k AND w.i = m.i)),
  done AS (SELECT k, v0.c AS cost, v0.a AS audit, v0.r AS lines FROM walk WHERE i = 0)
SELECT conv_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, coalesce(audit, '') AS audit,
  sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM named) LEFT JOIN counts USING (k) LEFT JOIN done USING (k)"""


TURN_REPAIR = _turn_repair()
