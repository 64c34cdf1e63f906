"""DuckDB SQL for those queries of this package that SQL can state on whole tables.

Problem 1 is approximate; the brute force given here agrees on small tables.
Problems 3 and 9 read and learn, problems 7 and 8 need the tokenizer; their tests are against brute force, public libraries, round
trips and held-out labels instead.
"""

_PAD = "' ' || chr(9) || chr(13) || chr(10)"
_RUNS = f"""WITH cur AS (
  SELECT lower(trim(id, {_PAD})) AS id, raw_text, removed_at,
    row_number() OVER (PARTITION BY lower(trim(id, {_PAD})) ORDER BY indexed_at DESC NULLS LAST, landed_at DESC NULLS LAST) AS rn
  FROM nodes WHERE trim(id, {_PAD}) <> ''),
word AS (SELECT id, regexp_extract_all(lower(raw_text), '[a-z0-9_]+') AS w FROM cur WHERE rn = 1 AND removed_at IS NULL AND raw_text IS NOT NULL),
run AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM word WHERE len(w) >= 25),
whole AS MATERIALIZED (SELECT id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS class FROM run GROUP BY 1),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM run a JOIN run b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pair AS MATERIALIZED (
  SELECT id_a, id_b, a.class AS class_a, b.class AS class_b FROM shared s JOIN whole a ON a.id = s.id_a JOIN whole b ON b.id = s.id_b
  WHERE 10 * c >= 6 * (a.n + b.n - c))"""

_WIDE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
_COUNTS = rf"""WITH doc AS (SELECT doc_id, coalesce(regexp_extract(lower(trim(lang, {_PAD})), '^([a-z]{{2}})', 1), '') AS lang, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
word AS MATERIALIZED (SELECT doc_id, lang, t, regexp_extract_all(regexp_replace(t, '({_WIDE})', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM doc),
total AS (SELECT lang, count(*) AS docs FROM word WHERE trim(t, {_PAD}) <> '' GROUP BY 1),
common AS (SELECT DISTINCT w FROM (SELECT lang, w, count(*) AS n FROM (SELECT DISTINCT doc_id, lang, lower(unnest(w)) AS w FROM word WHERE trim(t, {_PAD}) <> '') GROUP BY ALL) JOIN total USING (lang) WHERE n >= 5 AND n >= 0.4 * docs),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, lower(unnest(w)) AS w FROM word) WHERE w IN (SELECT w FROM common) GROUP BY 1),
one AS (SELECT doc_id, len(w)::DOUBLE AS words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS chars, coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::DOUBLE AS longest_word,
  len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE AS kinds, len(regexp_extract_all(t, '\p{{N}}'))::DOUBLE AS digits, len(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}]'))::DOUBLE AS solid,
  len(regexp_extract_all(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g'), '{_WIDE}'))::DOUBLE AS wide, len(regexp_extract_all(t, '[\p{{L}}\p{{M}}]'))::DOUBLE AS letters,
  len(list_filter(regexp_split_to_array(t, '[\n\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[\p{{L}}\p{{M}}\p{{N}}\p{{P}}\p{{S}}]')))::DOUBLE AS lines FROM word)"""


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN floor({a} / {b} * 1e4 + 0.5) / 1e4 ELSE 0 END"


_NEAR = f"""WITH cur AS (
  SELECT lower(trim(id, {_PAD})) AS id, embedding, removed_at, row_number() OVER (PARTITION BY lower(trim(id, {_PAD})) ORDER BY indexed_at DESC NULLS LAST, landed_at DESC NULLS LAST) AS rn
  FROM nodes WHERE trim(id, {_PAD}) <> ''),
v AS MATERIALIZED (SELECT id, embedding::DOUBLE[64] AS e FROM cur WHERE rn = 1 AND removed_at IS NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS id, b.id AS other, array_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.id <> b.id),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS rank FROM s WHERE sim >= 0.88)"""

_MIX = f"""WITH t AS (SELECT lower(trim(source, {_PAD})) AS source, sum(target_share) / sum(sum(target_share)) OVER () AS share, min(greatest(coalesce(max_repeats, 1), 0)) AS cap FROM mix_targets WHERE trim(source, {_PAD}) <> '' AND target_share > 0 GROUP BY 1),
d AS (SELECT doc_id, t.source, length(text) AS tokens, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS key FROM documents JOIN t ON t.source = lower(trim(documents.source, {_PAD})) WHERE length(text) > 0),
z AS (SELECT t.*, coalesce((SELECT sum(tokens) FROM d WHERE d.source = t.source), 0) AS size FROM t),
b AS (SELECT *, least(CAST(round((SELECT min(size * cap / share) FROM z WHERE size > 0 AND cap > 0) * share) AS BIGINT), size * cap) AS budget FROM z),
r AS (SELECT d.*, CASE WHEN size > 0 THEN budget // size ELSE 0 END AS epochs, budget - CASE WHEN size > 0 THEN budget // size ELSE 0 END * size AS rest,
  sum(tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS fin FROM d JOIN b ON b.source = d.source),
m AS (SELECT doc_id, source, tokens, CAST(epochs + CASE WHEN fin - tokens < rest AND (fin <= rest OR fin - rest < rest - (fin - tokens)) THEN 1 ELSE 0 END AS INTEGER) AS times FROM r)"""

SQL: dict[str, str] = {
    "p8_mix_chars": f"{_MIX} SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, times FROM m WHERE times > 0",
    "p1_found": f"{_NEAR} SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM top WHERE rank <= 5",
    "p9_counts": f"""{_COUNTS} SELECT doc_id, words, {_share('chars', 'words')} AS mean_word, longest_word, {_share('kinds', 'words')} AS unique_share, {_share('digits', 'solid')} AS digit_share, {_share('wide', 'letters')} AS wide_share,
      lines, {_share('words', 'lines')} AS words_per_line, {_share('coalesce(hit.n, 0)', 'words')} AS common_share FROM one LEFT JOIN hit USING (doc_id)""",
    "p2_found": f"{_RUNS} SELECT id_a, id_b FROM pair",
    "p2_groups": f"""{_RUNS}, class AS (SELECT class, min(id) AS class_id, count(*) AS copies FROM whole GROUP BY 1),
      ends AS (SELECT class_a AS class, class_b AS other FROM pair WHERE class_a <> class_b UNION SELECT class_b, class_a FROM pair WHERE class_a <> class_b),
      links AS (SELECT class, count(*) AS links FROM ends GROUP BY 1)
      SELECT w.id, class_id, copies, coalesce(links, 0) AS links FROM whole w JOIN class c ON c.class = w.class LEFT JOIN links l ON l.class = w.class""",
}
