"""Fixed schemas, as DDL text. Nothing in the library infers a schema from data."""

VOLUMES = "volume STRING, is_removable BOOLEAN, knows_query BOOLEAN, volume_order INT"
DOCS = "volume STRING, path STRING, contents STRING"
FILE_ENTRIES = "volume STRING, path STRING, kind STRING, type STRING, contents STRING"
# What the binary file source gives.
RAW_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
EXCLUDES = "volume STRING, dir_prefix STRING"
SUPPORTED_TYPES = "type STRING"
CHANGES = "seq BIGINT, ts TIMESTAMP, volume STRING, path STRING, op STRING, batch BIGINT"

# One row per clause. kind: term, phrase, proximity, prefix, wildcard, fuzzy, range,
# range_exclusive. occur and group_occur: must, should, must_not.
CLAUSES = (
    "query_id BIGINT, clause_id INT, group_id INT, group_occur STRING, occur STRING, "
    "kind STRING, field STRING, text STRING, text2 STRING, slop INT, boost DOUBLE")

HITS = "query_id BIGINT, volume STRING, path STRING, score DOUBLE"

# Index tables. ``bucket`` is the hash bucket of the term; bucket -1 holds one row with
# the empty term for every document, which makes it the document list.
POSTINGS = (
    "term STRING, path STRING, tf INT, dl INT, positions ARRAY<INT>, "
    "batch_id BIGINT, volume STRING, bucket INT")
DOC_STATE = "path STRING, dl INT, live BOOLEAN, batch_id BIGINT, volume STRING"
TERMS = "term STRING, df BIGINT, batch_id BIGINT, volume STRING, bucket INT"
VOLUME_STATS = "volume STRING, n_docs BIGINT, batch_id BIGINT"
COMMITS = "batch_id BIGINT, is_base BOOLEAN, buckets INT, token STRING"
EXCLUDED_VOLUMES = "volume STRING"
