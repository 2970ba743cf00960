"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from shelfmark.llm import licenses, phrases, vectors


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_scan() -> str:
    """Containment of every template in every line, by brute force."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    templates = ", ".join(f"({_text(label)}, {_text(text)})" for label, text in licenses.TEMPLATES)
    phrases = ", ".join(f"({_text(label)}, {_text(text)})" for label, text in licenses.BASE.items())
    up, down = licenses.SHARE
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {words.format('t')} AS ws FROM d),
places AS (SELECT r, label, unnest(list_filter(range(len(ws)),
    lambda i: ws[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) AS place
  FROM w, (VALUES {phrases}) p(label, phrase) WHERE list_has_all(ws, string_split(phrase, ' '))),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, list(DISTINCT label) AS ls
  FROM places GROUP BY r),
tpl AS (SELECT label, list_distinct({words.format('wording')}) AS tw
  FROM (VALUES {templates}) v(label, wording)),
blocks AS (SELECT r, list_distinct({words.format('line')}) AS bw
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
hits AS (SELECT r, label, len(list_intersect(bw, tw)) / len(tw) AS c FROM blocks, tpl
  WHERE len(list_intersect(bw, tw)) * {down} >= len(tw) * {up}),
found AS (SELECT r, list(DISTINCT label) AS ls, max(c) AS c FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(
    coalesce(base.ls, []), coalesce(found.ls, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


# All pairs of a label, and all that each vector reaches by links.
EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label,
  CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label
  AND a.r <> b.r AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {vectors.COSINE}),
reach AS (SELECT r AS a, r AS b FROM v
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b
  GROUP BY reach.a),
degree AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id,
  vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN degree USING (r)"""


def phrase_collocations() -> str:
    """Every n-gram of one to four words counted on its own, by brute force."""
    up, down = phrases.CONTAINED
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
    '{phrases.UPPER}', '{phrases.LOWER}'), '{phrases.PIECE_SPLIT}') AS pieces FROM documents),
p AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '{phrases.WORD}') AS w
  FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
pos AS (SELECT lang, pid, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p),
win AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
  FROM pos WINDOW o AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, k, CASE k WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2
    WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3 ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS phrase
  FROM win, (VALUES (1), (2), (3), (4)) t(k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM pos GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM c
  WHERE k >= 2 AND f >= {phrases.LEAST_COUNT}),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') AS lp,
  array_to_string(words[cut + 1 : k], ' ') AS rp FROM cand, range(1, 4) t(cut) WHERE cut < k),
fc AS (SELECT lang || chr(1) || phrase AS key, f FROM c WHERE f >= {phrases.LEAST_COUNT}),
sc AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, cl.f AS l, cr.f AS r,
  CAST((CAST(cuts.a AS HUGEINT) * {phrases.SCALE}) // (CAST(cl.f AS HUGEINT) + cr.f) AS BIGINT) AS score
  FROM cuts JOIN fc cl ON cl.key = cuts.lang || chr(1) || cuts.lp
  JOIN fc cr ON cr.key = cuts.lang || chr(1) || cuts.rp),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o
  FROM sc) WHERE o = 1),
subs AS (SELECT lang, a AS fq, array_to_string(words[s : s + ln - 1], ' ') AS phrase
  FROM cand, range(2, 4) t(ln), range(1, 4) u(s) WHERE k >= 3 AND ln < k AND s + ln - 1 <= k),
strong AS (SELECT lang, phrase, max(fq) AS fq FROM subs GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN strong USING (lang, phrase)
  WHERE strong.fq IS NULL OR strong.fq * {up} < low.a * {down}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rk
  FROM kept)
SELECT lang, CAST(rk AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
  CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN n USING (lang) WHERE rk <= {phrases.TOP}"""


SQL = {"op2_license_scan": license_scan(), "op8_embedding_dedup": EMBEDDING_DEDUP,
       "op12_phrase_collocations": phrase_collocations()}
