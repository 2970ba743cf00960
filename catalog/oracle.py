"""SQL counterparts of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from shelfmark.functions.analysis import STOP_WORDS

from . import inputs

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SPLIT = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _tokens(name: str, source: str, keys: str, text: str) -> str:
    """CTE ``name`` (keys, pos, term) of all tokens of ``text``."""
    return f"""{name} AS (
      SELECT {keys}, CAST(pos AS INTEGER) AS pos, a[pos + 1] AS term FROM (
        SELECT {keys}, a, unnest(range(len(a))) AS pos FROM (
          SELECT {keys}, {SPLIT.format(text)} AS a FROM {source}) t) t)"""


DOCS = """docs AS (SELECT source AS volume, CAST(doc_id AS VARCHAR) AS path, text AS contents
      FROM documents)"""
TOK = DOCS + ",\n" + _tokens("tok", "docs", "volume, path", "contents")
KEPT = TOK + f",\nkept AS (SELECT * FROM tok WHERE term NOT IN ({STOP}))"
DL = """dl AS (SELECT d.volume, d.path, CAST(count(k.term) AS INTEGER) AS dl
      FROM docs d LEFT JOIN kept k USING (volume, path) GROUP BY ALL)"""
POST = KEPT + ",\n" + DL + """,
    post AS (SELECT volume, term, path, CAST(count(*) AS INTEGER) AS tf,
      string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
      FROM kept GROUP BY volume, term, path)"""
STATS = POST + """,
    nd AS (SELECT volume, count(*) AS n_docs FROM docs GROUP BY volume),
    df AS (SELECT volume, term, count(*) AS df FROM post GROUP BY volume, term),
    idf AS (SELECT volume, term, 1 + ln(n_docs / (df + 1)) AS idf FROM df JOIN nd USING (volume))"""

VOLUMES = """vols AS (SELECT DISTINCT source AS volume, source LIKE '%5' AS is_removable,
      source NOT LIKE '%7' AS knows_query, CAST(substr(source, 4) AS INTEGER) AS volume_order
      FROM documents),
    scope AS (SELECT * FROM vols WHERE NOT is_removable AND knows_query)"""

ENTRIES = """entries AS (
      SELECT doc_id, source AS volume, lang AS type,
        CASE WHEN doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)
             THEN 'file' ELSE 'symlink' END AS kind,
        CASE WHEN NOT (coalesce(quality, 1) = 0 AND coalesce(toxic, 0) = 1) THEN
          '/' || lang || '/' || CASE WHEN quality = 0 THEN '.drafts/' ELSE '' END ||
          CASE WHEN toxic = 1 THEN '.' ELSE '' END || doc_id || '.txt' END AS path
      FROM documents LEFT JOIN labels USING (doc_id)
      UNION ALL
      SELECT DISTINCT NULL, source, NULL, 'dir', '/' || lang FROM documents)"""
VISIBLE = r"(NOT regexp_matches(path, '/\.[^/]*$') AND NOT regexp_matches(path, '/\.[^/]+/'))"
EXCLUDED = "EXISTS (SELECT 1 FROM (VALUES {0}) x(v, d) WHERE x.v = volume AND starts_with(path, d))" \
    .format(", ".join(f"('{v}', '{d}')" for v, d in inputs.EXCLUDES))
TYPES = ", ".join(f"'{t}'" for t in inputs.SUPPORTED)
STATUS = f"""CASE WHEN path IS NULL THEN 'bad_value'
      WHEN coalesce(type NOT IN ({TYPES}), true) THEN 'nspt'
      WHEN starts_with(path, '{inputs.INDEX_DIR}') THEN 'excl' ELSE 'OK' END"""

FEED = """feed AS (SELECT event_id AS seq, ts, source AS volume, CAST(user_id AS VARCHAR) AS path,
      user_id AS doc_id, event_type,
      CASE WHEN event_type = 'error' THEN 'removed' ELSE 'created' END AS op,
      CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch
      FROM events JOIN documents ON user_id = doc_id),
    net AS (SELECT batch, volume, path, bool_or(op = 'created') AS is_update
      FROM feed GROUP BY batch, volume, path),
    last AS (SELECT volume, path, arg_max(is_update, batch) AS is_update
      FROM net GROUP BY volume, path),
    gone AS (SELECT CAST(doc_id AS VARCHAR) AS path FROM labels WHERE toxic = 1)"""
# What is in the index after the commit of the whole feed.
LIVE = """live AS (SELECT volume, path FROM docs LEFT JOIN last USING (volume, path)
      WHERE is_update IS NULL OR (is_update AND path NOT IN (SELECT path FROM gone)))"""

QUERY_TOKENS = (
    _tokens("qall", "benchmark", "item_id", "text") + f""",
    qt AS (SELECT item_id AS query_id, pos, term,
      row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS i
      FROM qall WHERE term NOT IN ({STOP})),
    qd AS (SELECT query_id, term,
      row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) - 1 AS i
      FROM qt GROUP BY query_id, term),
    q1 AS (SELECT query_id * {inputs.TOKEN_QUERIES} + i AS query_id, term AS t0 FROM qd)""")


# ---- scoring -----------------------------------------------------------------------------


def _scored(matches: str) -> str:
    """CTE hits from ``cl`` (query_id, clause_id, occur) and matches ``m`` (query_id,
    clause_id, volume, path, w)."""
    return f"""
    shape AS (SELECT query_id, count(*) FILTER (occur = 'must') AS n_must,
      count(*) FILTER (occur <> 'must_not') AS n_scored FROM cl GROUP BY query_id),
    m AS ({matches}),
    met AS (SELECT query_id, volume, path,
      count(*) FILTER (occur = 'must') AS must, count(*) FILTER (occur = 'should') AS should,
      count(*) FILTER (occur = 'must_not') AS must_not,
      coalesce(sum(w) FILTER (occur <> 'must_not'), 0) AS w
      FROM m JOIN cl USING (query_id, clause_id) GROUP BY query_id, volume, path),
    hits AS (SELECT query_id, volume, path,
      round((must + should) / n_scored * w, 6) AS score FROM met JOIN shape USING (query_id)
      WHERE must = n_must AND must_not = 0 AND (n_must > 0 OR should > 0))"""


TERM_MATCHES = """SELECT query_id, clause_id, volume, path,
      boost * sqrt(tf) * idf * idf / sqrt(dl) AS w
      FROM cl JOIN post USING (term) JOIN idf USING (volume, term) JOIN dl USING (volume, path)"""
SHARED_MATCHES = """SELECT query_id, clause_id, volume, path,
      boost * sqrt(tf) * idf * idf / sqrt(dl) AS w
      FROM cl JOIN post USING (term) JOIN dl USING (volume, path)
      JOIN (SELECT term, 1 + ln((SELECT count(*) FROM docs) / (sum(df) + 1)) AS idf
            FROM df GROUP BY term) s USING (term)"""


def _term_clauses(occur: str, boost: str = "1", where: str = "true") -> str:
    """One clause for each distinct token; occur and boost are expressions of its number i."""
    return f"""cl AS (SELECT query_id, i AS clause_id, {occur} AS occur,
      CAST({boost} AS DOUBLE) AS boost, term FROM qd WHERE {where})"""


def _with_hits(clauses: str, matches: str = TERM_MATCHES) -> str:
    return f"WITH {STATS},\n{QUERY_TOKENS},\n{clauses},{_scored(matches)}"


def _search(clauses: str, matches: str = TERM_MATCHES) -> str:
    return _with_hits(clauses, matches) + "\nSELECT query_id, volume, path, score FROM hits"


ANY_TOKEN = _term_clauses("'should'")
EVERY_TOKEN = _term_clauses("'must'")
ONE_TOKEN = """cl AS (SELECT query_id, 0 AS clause_id, 'should' AS occur,
      CAST(1 AS DOUBLE) AS boost, t0 AS term FROM q1)"""
ALL_TOKENS = """cl AS (SELECT query_id, i AS clause_id, 'should' AS occur,
      CAST(1 AS DOUBLE) AS boost, term FROM qt)"""

PHRASE = """pt AS (SELECT query_id, term, pos - min(pos) OVER (PARTITION BY query_id) AS off,
      count(*) OVER (PARTITION BY query_id) AS n FROM qt),
    cl AS (SELECT DISTINCT query_id, 0 AS clause_id, 'should' AS occur FROM pt)"""
PHRASE_MATCHES = """SELECT query_id, 0 AS clause_id, volume, path,
        sqrt(tf) * idf * idf / sqrt(dl) AS w
      FROM (SELECT query_id, volume, path, count(*) AS tf FROM (
              SELECT query_id, volume, path, k.pos - off AS start FROM pt JOIN kept k USING (term)
              GROUP BY query_id, volume, path, start, n HAVING count(*) = n) s
            GROUP BY query_id, volume, path) f
      JOIN (SELECT query_id, volume, sum(idf) AS idf FROM pt JOIN idf USING (term)
            GROUP BY query_id, volume) i USING (query_id, volume)
      JOIN dl USING (volume, path)"""

WINDOW = """pt AS (SELECT query_id, term FROM qd),
    pn AS (SELECT query_id, count(*) AS n FROM pt GROUP BY query_id),
    full_docs AS (SELECT query_id, volume, path FROM pt JOIN post USING (term)
      JOIN pn USING (query_id) GROUP BY query_id, volume, path, n HAVING count(*) = n),
    inside AS (SELECT query_id, volume, path, term, pos FROM pt JOIN kept USING (term)
      JOIN full_docs USING (query_id, volume, path)),
    cl AS (SELECT query_id, 0 AS clause_id, 'should' AS occur FROM pn)"""
WINDOW_MATCHES = f"""SELECT query_id, 0 AS clause_id, volume, path,
        sqrt(tf) * idf * idf / sqrt(dl) AS w
      FROM (SELECT query_id, volume, path, count(*) AS tf FROM (
              SELECT query_id, volume, path, pos, min(seen) AS first, count(*) AS terms FROM (
                SELECT e.query_id, e.volume, e.path, e.pos, b.term, max(b.pos) AS seen
                FROM inside e JOIN inside b
                  ON e.query_id = b.query_id AND e.volume = b.volume AND e.path = b.path
                  AND b.pos <= e.pos
                GROUP BY ALL) s
              GROUP BY query_id, volume, path, pos) s JOIN pn USING (query_id)
            WHERE terms = n AND (n = 1 OR pos - first - n + 1 <= {inputs.SLOP})
            GROUP BY query_id, volume, path) f
      JOIN (SELECT query_id, volume, sum(idf) AS idf FROM pt JOIN idf USING (term)
            GROUP BY query_id, volume) i USING (query_id, volume)
      JOIN dl USING (volume, path)"""

# DuckDB counts edits in bytes: every letter becomes one byte first. These are the letters
# beyond ASCII that the tables hold.
FOLD = "translate({0}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"


def _expanded(pattern: str, condition: str) -> tuple[str, str]:
    clauses = f"""cl AS (SELECT query_id, 0 AS clause_id, 'should' AS occur, {pattern} FROM q1)"""
    return clauses, _expanded_matches(condition)


def _expanded_matches(condition: str, keys: str = "p") -> str:
    """Every distinct pattern is compared with the dictionary once."""
    return f"""SELECT DISTINCT query_id, clause_id, volume, path, 1.0 AS w FROM cl JOIN (
      SELECT {keys}, term FROM (SELECT DISTINCT {keys} FROM cl) c
      JOIN (SELECT DISTINCT term FROM post) d ON {condition}) x USING ({keys})
      JOIN post USING (term)"""


RANGE = """cl AS (
      SELECT query_id, 0 AS clause_id, 'should' AS occur, left(t0, 3) AS low, t0 AS high FROM q1
      UNION ALL
      SELECT query_id, 1, 'must_not', t0, t0 || 'z' FROM q1)"""
RANGE_MATCHES = _expanded_matches(
    "CASE WHEN occur = 'should' THEN term BETWEEN low AND high "
    "ELSE term > low AND term < high END", "occur, low, high")

FIELD = """cl AS (SELECT query_id, i AS clause_id, 'should' AS occur, term FROM qd
      UNION ALL SELECT item_id, -1, 'should', NULL FROM benchmark)"""
FIELD_MATCHES = """SELECT query_id, clause_id, volume, path,
        sqrt(tf) * idf * idf / sqrt(dl) AS w
      FROM cl JOIN post USING (term) JOIN idf USING (volume, term) JOIN dl USING (volume, path)
      UNION ALL
      SELECT query_id, -1, volume, path, pow(1 + ln(n_docs / 2), 2)
      FROM cl JOIN docs ON clause_id = -1 AND path = CAST(query_id AS VARCHAR)
      JOIN nd USING (volume)"""

GROUPS = f"""WITH {STATS},
{QUERY_TOKENS},
    cl AS (SELECT query_id, i AS clause_id, i % 2 AS g, term, CAST(1 AS DOUBLE) AS boost
      FROM qd),
    m AS ({TERM_MATCHES.replace("clause_id,", "clause_id, g,")}),
    sizes AS (SELECT query_id, g, count(*) AS n FROM cl GROUP BY query_id, g),
    inner_hits AS (SELECT query_id, g, volume, path, count(*) / n * sum(w) AS score
      FROM m JOIN sizes USING (query_id, g) GROUP BY query_id, g, volume, path, n)
SELECT query_id, volume, path, round(count(*) / any_value(groups) * sum(score), 6) AS score
FROM inner_hits JOIN (SELECT query_id, count(*) AS groups FROM sizes GROUP BY query_id) s
  USING (query_id)
GROUP BY query_id, volume, path HAVING bool_or(g = 0)"""

def _nested() -> str:
    """Named hit lists, each its own scored search."""
    parts = {
        "one": (_term_clauses("'should'", where="i % 2 = 0"), TERM_MATCHES),
        "two": (_term_clauses("'should'", where="i % 2 = 1"), TERM_MATCHES),
        "phrase": (PHRASE, PHRASE_MATCHES),
        "place": ("cl AS (SELECT item_id AS query_id, 1 AS clause_id, 'should' AS occur "
                  "FROM benchmark)", """SELECT query_id, 1 AS clause_id, volume, path,
      pow(1 + ln(n_docs / 2), 2) AS w FROM cl
      JOIN docs ON path = CAST(query_id AS VARCHAR) JOIN nd USING (volume)""")}
    lists = ",\n".join(
        f"{name} AS (WITH {clauses},{_scored(matches)} SELECT * FROM hits)"
        for name, (clauses, matches) in parts.items())
    return f"""WITH {STATS},\n{QUERY_TOKENS},\n{lists},
    inner_hits AS (SELECT query_id, volume, path, one.score + two.score AS score
      FROM one JOIN two USING (query_id, volume, path)
      WHERE (query_id, volume, path) NOT IN (SELECT (query_id, volume, path) FROM phrase))
    SELECT query_id, volume, path, round(sum(score), 6) AS score FROM (
      SELECT * FROM inner_hits UNION ALL SELECT query_id, volume, path, score FROM place) u
    GROUP BY query_id, volume, path"""


RANK = "row_number() OVER (PARTITION BY query_id, volume ORDER BY score DESC, path)"
POSITIONS = _with_hits(ANY_TOKEN) + f""",
    {VOLUMES},
    pos AS (SELECT query_id, volume, path, {RANK} AS rank,
      row_number() OVER (PARTITION BY query_id ORDER BY volume_order, score DESC, path) AS position
      FROM hits JOIN vols USING (volume))"""
BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, volume)"


def _entries(where: str) -> str:
    return f"WITH {ENTRIES} SELECT volume, path, kind, type FROM entries WHERE {where}"


ADMITTED = f"kind = 'file' AND {VISIBLE} AND type IN ({TYPES}) AND NOT {EXCLUDED} " \
           f"AND NOT starts_with(path, '{inputs.INDEX_DIR}')"
# Files as the corpus, in place of the documents.
FILES = f"""{ENTRIES}, docs AS (SELECT volume, path, text AS contents
      FROM entries JOIN documents USING (doc_id) WHERE {ADMITTED})""" + KEPT[len(DOCS):] + ",\n" + DL


def _postings_of(docs: str, extra: str = "") -> str:
    rest = POST[len(DOCS):]
    return f"""WITH {extra}docs AS ({docs}){rest}
    SELECT volume, term, path, tf, dl, positions FROM post JOIN dl USING (volume, path)"""


PAGE_TEXT = r"""SELECT coalesce(nullif(lower(regexp_extract(
        url, '^(?i:[a-z][a-z0-9+.-]*:)?//([^/?#]+)', 1)), ''), '(no host)') AS volume,
      url AS path,
      -- The references that the pages hold; "&amp;" last, as what it gives is not one.
      replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
        '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&amp;', '&')
      AS contents FROM pages"""
TURNS = """SELECT role AS volume, conv_id || '/' || turn AS path, text AS contents
      FROM conversations"""

SQL: dict[str, str] = {
    "scan_volume": f"WITH {ENTRIES} SELECT volume, path, type FROM entries "
                   f"WHERE kind = 'file' AND {VISIBLE}",
    "eligible_volumes": f"WITH {DOCS}, {VOLUMES} SELECT volume, path FROM docs "
                        "WHERE volume IN (SELECT volume FROM scope)",
    "changes_since": f"WITH {FEED} SELECT seq, volume, path, op FROM feed "
                     f"WHERE ts > TIMESTAMP '{inputs.FEED_START}'",
    "backfill_then_follow": f"WITH {FEED} SELECT seq, volume, path, op FROM feed",
    "bootstrap_or_merge": f"WITH {FILES} SELECT volume, path, dl FROM dl",
    "extract_text": PAGE_TEXT,
    "write_index": f"WITH {POST} SELECT volume, term, path, tf, dl FROM post "
                   "JOIN dl USING (volume, path)",
    "read_index": f"WITH {STATS} SELECT volume, n_docs, count(term) AS n_terms FROM nd "
                  "LEFT JOIN df USING (volume) GROUP BY volume, n_docs",
    "write_hits": _search(ANY_TOKEN),

    "regular_files": _entries("kind = 'file'"),
    "visible_paths": _entries(VISIBLE),
    "no_symlinks": _entries("kind <> 'symlink'"),
    "not_excluded": _entries(f"path IS NULL OR NOT {EXCLUDED}"),
    "not_in_index_dir": _entries(f"NOT starts_with(path, '{inputs.INDEX_DIR}')"),
    "supported_types": _entries(f"type IN ({TYPES})"),
    "admission_status": f"WITH {ENTRIES} SELECT volume, path, kind, {STATUS} "
                        "AS admission_status FROM entries",
    "admit_updates_only": f"""WITH {ENTRIES},
    ch AS (SELECT event_id AS seq, volume, path, kind, CASE WHEN event_type = 'error'
      THEN 'removed' ELSE 'created' END AS op FROM events JOIN entries ON user_id = doc_id
      WHERE path IS NOT NULL)
    SELECT seq, volume, path, op FROM ch
    WHERE op = 'removed' OR (kind = 'file' AND {VISIBLE} AND NOT {EXCLUDED})""",

    "classify_changes": f"WITH {FEED} SELECT seq, volume, path, op FROM feed "
                        "WHERE event_type <> 'signup'",
    "route_to_volume": f"WITH {FEED}, {VOLUMES} SELECT seq, volume, path, op FROM feed "
                       "WHERE volume IN (SELECT volume FROM scope)",
    "drain_batch": f"""WITH {FILES}, {FEED},
    file_last AS (SELECT e.volume, e.path, l.is_update FROM last l
      JOIN entries e ON CAST(e.doc_id AS VARCHAR) = l.path WHERE e.path IS NOT NULL)
    SELECT volume, path, dl FROM dl LEFT JOIN file_last USING (volume, path)
    WHERE coalesce(is_update, true)""",
    "net_changes": f"WITH {FEED} SELECT batch, volume, path, is_update FROM net",
    "late_bound_content": f"WITH {DOCS}, {FEED} SELECT volume, path, contents FROM docs "
                          "JOIN last USING (volume, path) WHERE is_update "
                          "AND path NOT IN (SELECT path FROM gone)",
    "attach_volume": f"WITH {DOCS}, {VOLUMES} SELECT volume, path FROM docs "
                     "JOIN vols USING (volume) WHERE knows_query",
    "detach_volume": f"WITH {DOCS}, {VOLUMES} SELECT volume, path FROM docs "
                     "JOIN scope USING (volume) WHERE volume_order < 10",

    "build_postings": _postings_of(DOCS[len("docs AS ("):-1]),
    "build_postings_pages": _postings_of(PAGE_TEXT),
    "build_postings_conversations": _postings_of(TURNS),
    "build_statistics": f"WITH {STATS} SELECT volume, term, df, n_docs FROM df "
                        "JOIN nd USING (volume)",
    "document_lengths": f"WITH {KEPT}, {DL} SELECT volume, path, dl FROM dl",
    "upsert_docs": f"""WITH {DOCS}, {FEED}, new AS (SELECT volume, path,
      CASE WHEN coalesce(is_update, false) THEN contents || ' revised' ELSE contents END AS c
      FROM docs LEFT JOIN last USING (volume, path))
    SELECT volume, path, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS digest FROM new""",
    "delete_docs": f"WITH {DOCS}, {FEED} SELECT volume, path FROM docs "
                   "LEFT JOIN last USING (volume, path) WHERE coalesce(is_update, true)",
    "commit": f"WITH {POST}, {FEED}, {LIVE} SELECT volume, path, count(*) AS n_terms, "
              "CAST(sum(tf) AS BIGINT) AS n_tokens FROM post JOIN live USING (volume, path) "
              "GROUP BY volume, path",
    "reindex": f"WITH {POST}, {FEED} SELECT volume, term, count(*) AS df FROM post "
               "WHERE path NOT IN (SELECT path FROM gone) GROUP BY volume, term",
    "exclude_volume": f"WITH {KEPT}, {DL}, {VOLUMES} SELECT volume, path, dl FROM dl "
                      "JOIN scope USING (volume)",
    "commit_report": f"WITH {FEED} SELECT batch, volume, count(*) FILTER (op = 'created') "
                     "AS n_updates, count(*) FILTER (op = 'removed') AS n_removals "
                     "FROM feed GROUP BY batch, volume",
    "rejection_report": f"WITH {ENTRIES} SELECT volume, {STATUS} AS admission_status, "
                        "count(*) AS n_entries FROM entries GROUP BY ALL",

    "tokenize": f"WITH {TOK} SELECT volume, path, pos, term FROM tok",
    "lowercase": f"WITH {TOK} SELECT term, count(*) AS n FROM tok GROUP BY term",
    "stop_words": f"WITH {KEPT} SELECT volume, path, pos, term FROM kept",
    "exact_key": f"WITH {DOCS} SELECT volume, path FROM docs "
                 "JOIN benchmark ON path = CAST(item_id AS VARCHAR)",
    "analyze_query": f"WITH {QUERY_TOKENS} SELECT query_id, pos, term FROM qt",

    "search_term": _search(ONE_TOKEN),
    "search_any": _search(ANY_TOKEN),
    "search_all": _search(EVERY_TOKEN),
    "search_not": _search(_term_clauses("CASE WHEN i % 8 = 7 THEN 'must_not' ELSE 'should' END")),
    "search_occur": _search(_term_clauses(
        "CASE WHEN i % 16 = 0 THEN 'must' WHEN i % 16 = 15 THEN 'must_not' ELSE 'should' END")),
    "search_phrase": _search(PHRASE, PHRASE_MATCHES),
    "search_proximity": _search(WINDOW, WINDOW_MATCHES),
    "search_prefix": _search(*_expanded(
        "left(t0, 3) AS p", "starts_with(term, p)")),
    "search_wildcard": _search(*_expanded(
        "left(t0, 1) || '_' || substr(t0, 3, 1) || '%' AS p", "term LIKE p")),
    "search_fuzzy": _search(*_expanded(
        f"{FOLD.format('t0')} AS p, CASE WHEN length(t0) < 6 THEN 1 ELSE 2 END AS k",
        f"abs(length(term) - length(p)) <= k AND levenshtein({FOLD.format('term')}, p) <= k")),
    "search_range": _search(RANGE, RANGE_MATCHES),
    "search_boost": _search(_term_clauses(
        "'should'", "CASE WHEN i % 2 = 0 THEN 2.5 ELSE 0.5 END")),
    "search_groups": GROUPS,
    "search_nested": _nested(),
    "search_field": _search(FIELD, FIELD_MATCHES),
    "score_hits": _search(ALL_TOKENS),
    "rank_hits": _with_hits(ANY_TOKEN) + f" SELECT query_id, volume, path, score, {RANK} AS rank "
                                         "FROM hits",
    "search_batch": _with_hits(ALL_TOKENS) +
                    f" SELECT query_id, volume, path, score, {BEST} AS rank FROM hits",

    "concat_volumes": POSITIONS + " SELECT query_id, position, volume, rank, path FROM pos",
    "merged_ranking": _with_hits(ANY_TOKEN, SHARED_MATCHES) +
                      f" SELECT query_id, volume, path, score, {BEST} AS rank FROM hits",
    "hit_paths": POSITIONS + " SELECT query_id, position, path FROM pos",
    "open_hit": _with_hits(EVERY_TOKEN) + """ SELECT query_id, volume, path, contents
      FROM hits JOIN docs USING (volume, path)""",
    "top_k": _with_hits(ANY_TOKEN) + f""" SELECT * FROM (SELECT query_id, volume, path, score,
      {RANK} AS rank FROM hits) r WHERE rank <= 3""",
}
