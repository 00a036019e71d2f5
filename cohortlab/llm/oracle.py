"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from cohortlab.llm.license_scan import TEMPLATES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), o AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, src
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, src
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, src) AS place
  FROM w
), level AS (
  SELECT rest AS l_rest, w_rest AS l_w FROM o
  WHERE weight * rest / w_rest <= 2.0::DOUBLE * source_size ORDER BY place LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * l_rest / l_w) AS target FROM o, level
), line AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS FIRST, d.size
                            ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, want) - least(start, want))
        + greatest(0, least(source_size + start + size, want) - least(source_size + start, want)))::BIGINT AS taken
FROM line
"""

OP2 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM m
"""

# -- quality rules: counts, then the exact bounds as sums of binomial terms ----------------

RULE_RATIOS = (("symbols", "n_symbols", "word_chars"), ("dup_lines", "n_dup_lines", "n_lines"),
               ("repeats", "n_repeat_words", "n_words"), ("upper", "n_upper", "word_chars"), ("bangs", "n_bangs", "n_words"))
_BIN = "CASE WHEN {b} > 0 THEN least((200 * {a} + {b} - 1) // {b}, 201) ELSE 0 END"
_RATIOS = " UNION ALL ".join(
    f"SELECT rid, doc_id, lang, {i} AS place, '{r}' AS rule, {_BIN.format(a=a, b=b)} AS bin FROM counts"
    for i, (r, a, b) in enumerate(RULE_RATIOS))

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), line AS (
  SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY rid
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS n
  FROM (SELECT rid, unnest(generate_series(1, len(w) - 2)) AS i, unnest(w[1:len(w) - 2]) AS w1, unnest(w[2:len(w) - 1]) AS w2,
               unnest(w[3:]) AS w3 FROM d WHERE len(w) > 2)
), repeats AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM windows, (VALUES (0), (1), (2)) v(j) WHERE n > 1 GROUP BY rid
), counts AS (
  SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_bangs
  FROM d LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)
), ratios AS (
  {_RATIOS}
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1
), rows_ AS (
  SELECT rid, doc_id, lang, list(bin ORDER BY place) AS bins, list(rule ORDER BY place) AS rules FROM ratios GROUP BY rid, doc_id, lang
), held AS (
  SELECT lang, unnest(first(rules)) AS rule, unnest(min(bins)) AS bin FROM rows_ JOIN good USING (doc_id) GROUP BY doc_id, lang
), families AS (
  SELECT lang, rule, count(*) AS n, count(*) OVER () AS tests FROM held GROUP BY lang, rule
), cuts AS (
  SELECT f.lang, f.rule, f.n, f.tests, c.cut, count(*) FILTER (WHERE h.bin > c.cut) AS k
  FROM families f CROSS JOIN (SELECT unnest(generate_series(0, 200)) AS cut) c
  JOIN held h ON h.lang IS NOT DISTINCT FROM f.lang AND h.rule = f.rule
  GROUP BY f.lang, f.rule, f.n, f.tests, c.cut
), terms AS (
  SELECT lang, rule, cut, tests, k, n, unnest(generate_series(0, k)) AS i FROM cuts
), bounds AS (
  SELECT lang, rule, cut, tests, k, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
         + i * ln(0.01::DOUBLE) + (n - i) * ln(0.99::DOUBLE))) AS p
  FROM terms GROUP BY lang, rule, cut, tests, k, n
), chosen AS (
  SELECT lang, rule, coalesce(max(cut) FILTER (WHERE k >= n * 0.01 OR p > 0.05 / tests), -1) + 1 AS cut FROM bounds GROUP BY lang, rule
), failed AS (
  SELECT rid, string_agg(r.rule, ',' ORDER BY place) AS reasons
  FROM ratios r JOIN chosen c ON c.lang IS NOT DISTINCT FROM r.lang AND c.rule = r.rule
  WHERE r.bin > c.cut GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND reasons IS NULL) AS kept,
       coalesce(reasons, '') AS reasons
FROM counts LEFT JOIN failed USING (rid)
"""

# total_alpha 0.25 and delta 0.2: 0.05 of the good documents a rule
OP5_WIDE = (OP5.replace("ln(0.01::DOUBLE)", "ln(0.05::DOUBLE)").replace("ln(0.99::DOUBLE)", "ln(0.95::DOUBLE)")
            .replace("k >= n * 0.01 OR p > 0.05 / tests", "k >= n * 0.05 OR p > 0.2 / tests"))

# -- secrets: matches and the pieces between them give the positions -----------------------

_QUOTE = "[\"'']?"                       # a quote, within an SQL string
SECRET_PATTERNS = (
    ("assign", rf"((?i:password|passwd|secret|token|api_?key)){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)"),
    ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"), ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=\x20\x09-\x0D]*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"))


def _secret_matches(rank: int, kind: str, pattern: str) -> str:
    value = f"regexp_extract_all(t, '{pattern}', 2)" if kind == "assign" else "NULL"
    return (f"SELECT rid, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS found, {value} AS secret, "
            f"string_split_regex(t, '{pattern}') AS pieces FROM d WHERE regexp_matches(t, '{pattern}')")


_SECRETS = " UNION ALL ".join(_secret_matches(rank, *rule) for rank, rule in enumerate(SECRET_PATTERNS))

OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), hits AS (
  {_SECRETS}
), each AS (
  SELECT rid, rank, kind, i, found[i] AS m, secret[i] AS s, length(pieces[i]) AS gap
  FROM (SELECT *, unnest(generate_series(1, len(found))) AS i FROM hits)
), placed AS (
  SELECT *, (sum(gap + length(m)) OVER (PARTITION BY rid, rank ORDER BY i))::BIGINT AS e FROM each
), spans AS (
  SELECT rid, rank, kind, e - length(m) AS b, kind || ':' || (e - length(m)) || ':' || e AS span
  FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(s) >= 8 WHEN 'access' THEN length(m) >= 16 WHEN 'hex' THEN length(m) >= 32 ELSE true END
), joined AS (
  SELECT rid, string_agg(span, ',' ORDER BY b, rank) AS spans,
         string_agg(span, ',' ORDER BY b, rank) FILTER (WHERE rank < 3) AS base,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (rid)
"""

# -- licences: Dice of bigram sets through a join on bigrams, no size bounds ---------------

_NOTICES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

OP10 = rf"""
WITH notices AS (
  SELECT rank, license, string_split({_NORMAL.format("text")}, ' ') AS w FROM (VALUES {_NOTICES}) v(rank, license, text)
), gram AS (
  SELECT DISTINCT rank, license, w[i] || ' ' || w[i + 1] AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM notices)
), sizes AS (
  SELECT rank, license, count(*) AS m FROM gram GROUP BY rank, license
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), unit AS (
  SELECT rid, u, row_number() OVER () AS uid FROM (SELECT DISTINCT rid, {_NORMAL.format("u")} AS u FROM (
    SELECT rid, unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '\n[\x20\x09-\x0D]*\n'))) AS u FROM d))
), pair AS (
  SELECT DISTINCT rid, uid, w1 || ' ' || w2 AS g
  FROM (SELECT rid, uid, unnest(w[:len(w) - 1]) AS w1, unnest(w[2:]) AS w2
        FROM (SELECT rid, uid, string_split(u, ' ') AS w FROM unit) WHERE len(w) > 1)
), own AS (
  SELECT uid, count(*) AS b FROM pair GROUP BY uid
), hit AS (
  SELECT rid, rank, license, 2.0::DOUBLE * c / (b + m) AS dice
  FROM (SELECT rid, uid, rank, count(*) AS c FROM pair JOIN gram USING (g) GROUP BY rid, uid, rank)
  JOIN own USING (uid) JOIN sizes USING (rank)
  WHERE 2.0::DOUBLE * c / (b + m) >= 0.8::DOUBLE - 1e-9
), best AS (
  SELECT rid, first(license ORDER BY dice DESC, rank) AS license, max(dice) AS dice, count(*) AS n_matches,
         string_agg(license || ':' || printf('%.4f', dice), ',' ORDER BY dice DESC, rank DESC) AS matches
  FROM hit GROUP BY rid
)
SELECT doc_id, license, round(dice, 6) AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(matches, '') AS matches
FROM d LEFT JOIN best USING (rid)
"""

# -- term shares of all groups, without shards or perfect hashes ----------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), token AS (
  SELECT rid, lang, source, unnest(w) AS t FROM d
), kept AS (
  SELECT lang, t FROM token GROUP BY lang, t HAVING count(DISTINCT rid) >= 10
), size AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, t, count(*) AS n FROM token JOIN kept USING (lang, t) GROUP BY lang, source, t
), cell AS (
  SELECT g.lang, g.source, k.t, coalesce(n.n, 0) AS n
  FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.t = k.t
), share AS (
  SELECT lang, source, t, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM cell JOIN size USING (lang)
), whole AS (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, t, sum(n) AS n FROM cell GROUP BY lang, t) JOIN size USING (lang)
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f
  FROM share a JOIN share b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', t, ((p - q) * (p - q) // (p + q))::BIGINT FROM share JOIN whole USING (lang, t) WHERE n > 0 AND p > q
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM placed WHERE part = 'pair' OR rank <= 10
"""

# -- Merkle trees level by level; crc32 bit by bit -------------------------------------------

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT)")
OP13 = f"""
WITH RECURSIVE d AS (
  SELECT *, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars::HUGEINT + 1)")} AS changed, {_CRC} % 7 = 0 AS tampered FROM documents
), ranked AS (
  SELECT doc_id, lang, leaf, CASE WHEN tampered AND n_chars IS NOT NULL THEN changed ELSE leaf END AS seen,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM d
), node(lang, k, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM ranked
  UNION ALL
  SELECT lang, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, k, i // 2, n
), sub AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1
), top(k, i, n, h) AS (
  SELECT 0, i, n, subroot FROM sub
  UNION ALL
  SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 2, n
), step AS (
  SELECT r.lang, r.i, s.k, CASE WHEN (r.i >> s.k) % 2 = 1 THEN s.h ELSE '' END AS l, CASE WHEN (r.i >> s.k) % 2 = 0 THEN s.h ELSE '' END AS r
  FROM ranked r JOIN node s ON s.lang IS NOT DISTINCT FROM r.lang AND s.n > 1 AND s.i // 2 = (r.i >> s.k) // 2 AND s.i <> (r.i >> s.k)
  UNION ALL
  SELECT lang, i, k, '', '' FROM ranked JOIN (SELECT DISTINCT lang AS l, k, n AS m FROM node WHERE n > 1) ON l IS NOT DISTINCT FROM lang
  WHERE (i >> k) = m - 1 AND m % 2 = 1
), topstep AS (
  SELECT sub.lang, s.k, CASE WHEN (sub.i >> s.k) % 2 = 1 THEN s.h ELSE '' END AS l, CASE WHEN (sub.i >> s.k) % 2 = 0 THEN s.h ELSE '' END AS r
  FROM sub JOIN top s ON s.n > 1 AND s.i // 2 = (sub.i >> s.k) // 2 AND s.i <> (sub.i >> s.k)
  UNION ALL
  SELECT lang, k, '', '' FROM sub JOIN (SELECT DISTINCT k, n AS m FROM top WHERE n > 1) ON (i >> k) = m - 1 AND m % 2 = 1
), low AS (
  SELECT lang, i, list(l || '|' || r ORDER BY k) AS steps FROM step GROUP BY lang, i
), high AS (
  SELECT lang, list(l || '|' || r ORDER BY k) AS steps FROM topstep GROUP BY lang
), path AS (
  SELECT r.doc_id, r.leaf, r.seen, sub.subroot, (SELECT h FROM top WHERE n = 1) AS root,
         list_concat(coalesce(low.steps, []::VARCHAR[]), coalesce(high.steps, []::VARCHAR[])) AS steps
  FROM ranked r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM r.lang AND low.i = r.i LEFT JOIN high ON high.lang IS NOT DISTINCT FROM r.lang
), folded AS (
  SELECT *, list_reduce(list_prepend(seen, steps), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM path
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM folded
"""

ORACLE = {"op1_mix_sources": OP1, "op2_warc_archive": OP2, "op5_quality_rules": OP5, "op9_secret_scan": OP9,
          "op10_license_scan": OP10, "op11_source_divergence": OP11, "op13_merkle_manifest": OP13,
          "quality_rules_wide": OP5_WIDE, "secret_scan_two_versions": OP9}
