"""DuckDB SQL with the same results as the queries of this subpackage, where SQL can express them."""

from tessera.llm.licences import RULES, known_sentences

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM pos),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
gaps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 8) - i) AS g FROM rep),
cov AS (SELECT rid, CAST(sum(g) AS BIGINT) AS r FROM gaps GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS s FROM d),
dup AS (SELECT rid, count(*) FILTER (regexp_matches(s, '[^\x20\x09-\x0D]')) - count(DISTINCT s) FILTER (regexp_matches(s, '[^\x20\x09-\x0D]')) AS dl, count(*) AS nl FROM lines GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(dl AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, nl,
    length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS caps
  FROM d JOIN w USING (rid) JOIN dup USING (rid) LEFT JOIN cov USING (rid)),
raw AS (
  SELECT rid, lang, source, 0 AS m, 1000 * n_symbols // greatest(word_chars, 1) AS x FROM base
  UNION ALL SELECT rid, lang, source, 1, 1000 * greatest(0, n_dup_lines - 1) // greatest(nl, 1) FROM base
  UNION ALL SELECT rid, lang, source, 2, 1000 * caps // greatest(word_chars, 1) FROM base
  UNION ALL SELECT rid, lang, source, 3, 100 * word_chars // greatest(n_words, 1) FROM base),
metric AS (SELECT rid, lang, source, m, (x >> greatest(0, len(bin(x)) - 10)) << greatest(0, len(bin(x)) - 10) AS v FROM raw),
ranked AS (
  SELECT lang, source, m, v,
    count(*) OVER (PARTITION BY lang, source, m ORDER BY v) AS r0, count(*) OVER (PARTITION BY lang, source, m) AS n0,
    count(*) OVER (PARTITION BY lang, m ORDER BY v) AS r1, count(*) OVER (PARTITION BY lang, m) AS n1,
    count(*) OVER (PARTITION BY m ORDER BY v) AS r2, count(*) OVER (PARTITION BY m) AS n2
  FROM metric),
own AS (SELECT lang, source, m, max(n0) AS n0, max(n1) AS n1, min(CASE WHEN 100 * r0 >= 50 * n0 THEN v END) AS lo0, min(CASE WHEN 100 * r0 >= 90 * n0 THEN v END) AS hi0 FROM ranked GROUP BY ALL),
of_lang AS (SELECT lang, m, min(CASE WHEN 100 * r1 >= 50 * n1 THEN v END) AS lo1, min(CASE WHEN 100 * r1 >= 90 * n1 THEN v END) AS hi1 FROM ranked GROUP BY ALL),
of_all AS (SELECT m, min(CASE WHEN 100 * r2 >= 50 * n2 THEN v END) AS lo2, min(CASE WHEN 100 * r2 >= 90 * n2 THEN v END) AS hi2 FROM ranked GROUP BY ALL),
parents AS (
  SELECT own.lang, own.source, own.m, n0, n1, lo0 + greatest(20, 4 * (hi0 - lo0)) AS l0, lo1 + greatest(20, 4 * (hi1 - lo1)) AS l1, lo2 + greatest(20, 4 * (hi2 - lo2)) AS l2
  FROM own JOIN of_lang ON own.lang IS NOT DISTINCT FROM of_lang.lang AND own.m = of_lang.m JOIN of_all ON own.m = of_all.m),
limits AS (SELECT lang, source, m, (n0 * l0 + 100 * ((n1 * l1 + 100 * l2) // (n1 + 100))) // (n0 + 100) AS lim FROM parents),
fine AS (
  SELECT metric.rid, bool_and(v <= lim) AS ok FROM metric
  JOIN limits ON metric.lang IS NOT DISTINCT FROM limits.lang AND metric.source IS NOT DISTINCT FROM limits.source AND metric.m = limits.m GROUP BY metric.rid),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base JOIN fine USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM judged
"""

_URLS = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS b FROM labels GROUP BY doc_id),
h AS (SELECT host, count(b) AS n, coalesce(CAST(sum(b) AS BIGINT), 0) AS bad FROM p LEFT JOIN lab ON page_id = doc_id GROUP BY host),
named AS (
  SELECT *, regexp_replace(host, ':\d*$', '') AS nm FROM h),
parts AS (
  SELECT host, n, bad,
    CASE WHEN num THEN nm ELSE array_to_string(string_split(nm, '.')[greatest(1, len(string_split(nm, '.')) - CASE WHEN two THEN 2 ELSE 1 END):], '.') END AS domain,
    CASE WHEN num THEN '' ELSE array_to_string(string_split(nm, '.')[greatest(1, len(string_split(nm, '.')) - CASE WHEN two THEN 1 ELSE 0 END):], '.') END AS suffix
  FROM (SELECT *, regexp_matches(nm, '^[0-9.]+$|^\[') AS num, array_to_string(string_split(nm, '.')[greatest(1, len(string_split(nm, '.')) - 1):], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'ne.jp', 'or.jp', 'co.kr', 'com.br', 'com.cn', 'com.mx', 'co.in', 'co.za', 'com.tr', 'com.tw', 'com.sg') AS two FROM named)),
doms AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS sq FROM parts GROUP BY domain, suffix),
sufs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS sq FROM doms GROUP BY suffix),
tot AS (SELECT sum(n) AS n, sum(bad) AS bad, sum(n * n) AS sq FROM sufs),
each AS (
  SELECT 0 AS lev, n, bad, 0 AS sq FROM parts UNION ALL SELECT 1, n, bad, sq FROM doms UNION ALL SELECT 2, n, bad, sq FROM sufs UNION ALL SELECT 3, n, bad, sq FROM tot),
spread AS (
  SELECT lev, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b, count(*) FILTER (n > 0) AS k,
    sum(CASE WHEN n > 0 THEN CAST(bad * bad AS DOUBLE) / n ELSE 0.0 END) AS s, sum(CASE WHEN n > 0 THEN CAST(sq AS DOUBLE) / n ELSE 0.0 END) AS q FROM each GROUP BY lev),
anova AS (
  SELECT g.lev, g.k - p.k AS more, g.n - g.k AS extra, (g.s - p.s) / (g.k - p.k) AS btw, (g.b - g.s) / (g.n - g.k) AS wit, (g.n - p.q) / (g.k - p.k) AS sz FROM spread g JOIN spread p ON p.lev = g.lev + 1),
st AS (
  SELECT lev, CASE WHEN more <= 0 OR extra <= 0 THEN 10.0 WHEN wit <= 0 THEN 1.0 WHEN btw <= wit THEN 10.0
    ELSE greatest(1.0, least(10.0, round((1 - (btw - wit) / (btw + (sz - 1) * wit)) / ((btw - wit) / (btw + (sz - 1) * wit)), 3))) END AS m FROM anova),
one AS (
  SELECT CAST(n AS DOUBLE) AS nn, CAST(bad AS DOUBLE) AS bb, CASE WHEN n > 0 THEN bad / n ELSE 0.5 END AS share,
    (SELECT m FROM st WHERE lev = 0) AS m0, (SELECT m FROM st WHERE lev = 1) AS m1, (SELECT m FROM st WHERE lev = 2) AS m2 FROM tot),
pri AS (
  SELECT domain, suffix, doms.n AS dn, doms.bad AS db, (sufs.bad - doms.bad + m2 * ((bb - sufs.bad + share) / (nn - sufs.n + 1.0))) / (sufs.n - doms.n + m2) AS above
  FROM doms JOIN sufs USING (suffix), one),
hm AS (SELECT host, n, m0, share, (bad + m0 * ((db - bad + m1 * above) / (dn - n + m1))) / (n + m0) AS mean FROM parts JOIN pri USING (domain, suffix), one),
hb AS (SELECT host, mean, share, greatest(0.0, mean - 1.28 * sqrt(mean * (1 - mean) / (n + m0 + 1))) AS bound FROM hm),
r AS (
  SELECT page_id, host, path, mean, bound, share,
    CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM p JOIN hb USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > share THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS bad_mean, round(bound, 6) AS bad_bound
FROM r
"""


def _licences() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    steps, left = [], "left0"
    for i, (_, sequence) in enumerate(RULES):
        part = "".join(f"|{x}|" for x in sequence)
        steps.append(f"step{i + 1} AS (SELECT * EXCLUDE ({left}), contains({left}, '{part}') AS hit{i}, replace({left}, '{part}', '-') AS left{i + 1} FROM step{i})")
        left = f"left{i + 1}"
    names = ", ".join(f"CASE WHEN hit{i} THEN '{name}' END" for i, (name, _) in enumerate(RULES))
    norm = "regexp_replace(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), '^([0-9]+|[a-z]) ', '')"
    cut = "t"
    for pattern, mark in (
        (r"([.!?])([\x20\x09-\x0D])", r"'\1' || chr(30) || '\2'"),
        (r":([\x20\x09\x0B-\x0D]*\n)", r"chr(30) || '\1'"),
        (r":([\x20\x09-\x0D]+\(?[0-9]+[.)])", r"chr(30) || '\1'"),
        (r"\n[\x20\x09\x0B-\x0D]*\n", "chr(30)"),
    ):
        cut = f"regexp_replace({cut}, '{pattern}', {mark}, 'g')"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT rid, string_split({cut}, chr(30)) AS parts FROM d),
unit AS (SELECT rid, unnest(parts) AS u, generate_subscripts(parts, 1) AS i FROM cut),
whole AS (SELECT rid, i, u, id FROM unit LEFT JOIN known ON {norm.format("u")} = sentence),
line AS (SELECT rid, i, unnest(string_split(u, chr(10))) AS s, generate_subscripts(string_split(u, chr(10)), 1) AS j FROM whole WHERE id IS NULL AND contains(u, chr(10))),
every AS (SELECT rid, i, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT rid, i, j, known.id FROM line JOIN known ON {norm.format("s")} = sentence),
found AS (SELECT rid, list(id ORDER BY i, j) AS ids FROM every GROUP BY rid),
step0 AS (SELECT doc_id, coalesce(ids, []) AS ids, CASE WHEN ids IS NULL THEN '' ELSE '|' || array_to_string(ids, '||') || '|' END AS left0 FROM d LEFT JOIN found USING (rid)),
{", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct([x FOR x IN [{names}] IF x IS NOT NULL])), ',') AS licences
FROM step{len(RULES)}
"""


_CHAT = r"""
WITH p AS (
  SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT c, max(position) AS last_answer FROM p WHERE role = 'assistant' GROUP BY c),
pair AS (SELECT a.c, a.last_answer, p.role, p.text FROM last a JOIN last b ON xor(a.c, 1) = b.c JOIN p ON p.c = b.c AND p.position = b.last_answer),
sides AS (
  SELECT p.c, CASE WHEN last_answer IS NULL THEN 'single' ELSE 'chosen' END AS side, position, p.role, p.text FROM p LEFT JOIN pair USING (c)
  UNION ALL SELECT p.c, 'rejected', position, p.role, p.text FROM p JOIN pair USING (c) WHERE position < last_answer
  UNION ALL SELECT c, 'rejected', last_answer, role, text FROM pair),
met AS (
  SELECT coalesce(x.c, y.c) AS c, coalesce(x.position, y.position) AS position, x.c IS NOT NULL AND y.c IS NOT NULL AND x.role IS NOT DISTINCT FROM y.role AND x.text IS NOT DISTINCT FROM y.text AS same
  FROM (SELECT * FROM sides WHERE side = 'chosen') x FULL JOIN (SELECT * FROM sides WHERE side = 'rejected') y ON x.c = y.c AND x.position = y.position),
ends AS (SELECT c, coalesce(min(CASE WHEN NOT same THEN position END), max(position) + 1) AS fork FROM met GROUP BY c),
parts AS (
  SELECT sides.c, CASE WHEN side = 'single' THEN side WHEN position < fork THEN 'prompt' ELSE side END AS part, CASE WHEN side <> 'single' AND position >= fork THEN position - fork ELSE position END AS position,
    '<|' || coalesce(role, '') || '|>' || chr(10) AS head, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS content, coalesce(role = 'assistant', FALSE) AS trained
  FROM sides LEFT JOIN ends USING (c) WHERE side <> 'rejected' OR position >= fork),
cut AS (SELECT *, position // 512 AS record, coalesce(sum(length(content)) OVER (PARTITION BY c, part, position // 512 ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM parts)
SELECT c AS pair_id, CAST(record AS BIGINT) AS record,
  string_agg(content, '' ORDER BY position) FILTER (part = 'prompt') AS prompt, string_agg(content, '' ORDER BY position) FILTER (part = 'chosen') AS chosen,
  string_agg(content, '' ORDER BY position) FILTER (part = 'rejected') AS rejected, string_agg(content, '' ORDER BY position) FILTER (part = 'single') AS single,
  CASE WHEN count(*) FILTER (part = 'chosen') > 0 THEN coalesce(string_agg((CAST(shift AS BIGINT) + length(head)) || '-' || (CAST(shift AS BIGINT) + length(content)), ',' ORDER BY position) FILTER (part = 'chosen' AND trained), '') END AS chosen_loss,
  CASE WHEN count(*) FILTER (part = 'rejected') > 0 THEN coalesce(string_agg((CAST(shift AS BIGINT) + length(head)) || '-' || (CAST(shift AS BIGINT) + length(content)), ',' ORDER BY position) FILTER (part = 'rejected' AND trained), '') END AS rejected_loss
FROM cut GROUP BY c, record
UNION ALL SELECT NULL, 0, NULL, NULL, NULL, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), NULL, NULL FROM conversations WHERE conv_id IS NULL
"""

SQL: dict[str, str] = {"op4_quality_rules": _QUALITY, "op5_url_filters": _URLS, "op6_licence_scans": _licences(), "op9_chat_formatting": _CHAT}
