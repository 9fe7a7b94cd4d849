"""Queries for listing, filtering, windows, hashes, incremental indexing, batches and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import chunking, embedding
from kestrel.operators import files as FL
from kestrel.plans.queries import query
from kestrel.session import each_once
from kestrel.sources.tables import table
from kestrel.streaming import watch

_NAME = "split_part(path, '/', -1)"
_SUFFIX = " OR ".join(f"ends_with({_NAME}, '{s}')" for s in FL.SKIP_SUFFIXES)
_DIRS = ", ".join(f"'{s}'" for s in FL.SKIP_DIRS)
_LANG = "CASE " + " ".join(f"WHEN ends_with(path, '{s}') THEN '{g}'" for s, g in FL.LANGUAGE_OF_SUFFIX.items()) + " END"
_ONCE = "files AS (SELECT DISTINCT file_id, repo, path, text FROM source_files)"


def _files(spark, d):
    return each_once(table(spark, d, "source_files", "file_id", "repo", "path", "text"), "file_id")


@query("language_detect", f"SELECT DISTINCT file_id, coalesce({_LANG}, 'text') AS language FROM source_files")
def language_detect(spark, d):
    return table(spark, d, "source_files", "file_id", "path").select("file_id", F.coalesce(FL.language_of(F.col("path")), F.lit("text")).alias("language")).distinct()


@query("file_filter", f"SELECT DISTINCT file_id, NOT ({_NAME} = '.env' OR starts_with({_NAME}, '.env.') OR {_SUFFIX}) AS wanted FROM source_files")
def file_filter(spark, d):
    return table(spark, d, "source_files", "file_id", "path").select("file_id", FL.file_wanted(F.col("path")).alias("wanted")).distinct()


@query("dir_filter", f"SELECT DISTINCT file_id, len(list_filter(string_split(path, '/')[:-2], lambda x: list_contains([{_DIRS}], x) OR ends_with(x, '.egg-info'))) = 0 AS wanted FROM source_files")
def dir_filter(spark, d):
    return table(spark, d, "source_files", "file_id", "path").select("file_id", FL.dirs_wanted(F.col("path")).alias("wanted")).distinct()


@query("size_filter", "SELECT DISTINCT file_id, n_bytes * 50 <= 1000000 AS wanted FROM source_files")
def size_filter(spark, d):
    """Sizes are scaled up, so that the limit separates the test files."""
    return table(spark, d, "source_files", "file_id", "n_bytes").select("file_id", FL.size_wanted(F.col("n_bytes") * 50).alias("wanted")).distinct()


_NORM = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"


@query("file_hash", "SELECT DISTINCT file_id, sha1('v2' || chr(0) || 'hashed-tokens:64' || chr(0) || " + _NORM + ") AS file_hash FROM source_files")
def file_hash(spark, d):
    tag = FL.embed_tag(embedding.HashedEmbedder())
    return _files(spark, d).select("file_id", FL.file_hash(FL.normal_newlines(F.col("text")), tag).alias("file_hash"))


_LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"
_WINDOWS = "WITH " + _ONCE + f""",
l0 AS (SELECT file_id, {_LINES} AS a FROM files WHERE length(text) > 0),
l AS (SELECT file_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM l0),
s AS (SELECT file_id, a, unnest(generate_series(0, CASE WHEN len(a) <= 60 THEN 0 ELSE (ceil((len(a) - 60) / 50.0) * 50)::INT END, 50)) AS start FROM l WHERE len(a) > 0),
w AS (SELECT file_id, (start + 1)::INT AS start_line, (start + len(a[start + 1:start + 60]))::INT AS end_line, array_to_string(a[start + 1:start + 60], chr(10)) AS text FROM s)"""


@query("window_chunks", _WINDOWS + " SELECT file_id, start_line, end_line, md5(text) AS text_md5 FROM w")
def window_chunks(spark, d):
    return FL.windows(_files(spark, d)).select("file_id", "start_line", "end_line", F.md5("text").alias("text_md5"))


@query("blank_drop", _WINDOWS + " SELECT file_id, start_line, regexp_matches(text, '\\S') AS kept FROM w")
def blank_drop(spark, d):
    return FL.windows(_files(spark, d)).select("file_id", "start_line", FL.not_blank(F.col("text")).alias("kept"))


@query("breadcrumb", """SELECT DISTINCT chunk_id, md5(CASE WHEN parent IS NOT NULL AND parent <> '' THEN '# in ' || parent || ':' || chr(10) || text ELSE text END) AS text_md5 FROM chunks""")
def breadcrumb(spark, d):
    c = table(spark, d, "chunks", "chunk_id", "text", "parent")
    return c.select("chunk_id", F.md5(FL.breadcrumb(F.col("text"), F.col("parent"))).alias("text_md5")).distinct()


@query("syntax_chunks")
def syntax_chunks(spark, d):
    c = chunking.chunk_files(table(spark, d, "source_files"))
    return c.select("file_id", "kind", "name", "start_line", "end_line", F.md5("text").alias("text_md5"), "parent").distinct()


# previous index: what an earlier run had seen of the same files
_PREV = """cur AS (SELECT DISTINCT repo, path, md5(text) AS file_hash FROM source_files),
prev AS (SELECT repo, path, CASE WHEN hash_digit < '4' THEN 'old' ELSE file_hash END AS file_hash FROM
  (SELECT repo, path, file_hash, substr(md5(path), 1, 1) AS hash_digit FROM cur) WHERE hash_digit < 'd' UNION ALL SELECT repo, path || '.gone', file_hash FROM cur)"""


def _runs(spark, d):
    cur = table(spark, d, "source_files", "repo", "path", "text").select("repo", "path", F.md5("text").alias("file_hash")).distinct()
    digit = F.substring(F.md5("path"), 1, 1)
    prev = cur.where(digit < "d").select("repo", "path", F.when(digit < "4", "old").otherwise(F.col("file_hash")).alias("file_hash"))
    return cur, prev.union(cur.select("repo", F.concat("path", F.lit(".gone")), "file_hash"))


@query("incremental_reuse", "WITH " + _PREV + " SELECT p.repo, p.path, p.file_hash FROM prev p WHERE EXISTS (SELECT 1 FROM cur c WHERE c.repo = p.repo AND c.path = p.path AND c.file_hash = p.file_hash)")
def incremental_reuse(spark, d):
    from kestrel.operators.changes import unchanged

    cur, prev = _runs(spark, d)
    return unchanged(prev, cur, ["repo", "path"])


@query("incremental_changed", "WITH " + _PREV + " SELECT c.repo, c.path, c.file_hash FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE c.repo = p.repo AND c.path = p.path AND c.file_hash = p.file_hash)")
def incremental_changed(spark, d):
    from kestrel.operators.changes import changed

    cur, prev = _runs(spark, d)
    return changed(cur, prev, ["repo", "path"])


@query("incremental_deleted", "WITH " + _PREV + " SELECT p.repo, p.path FROM prev p WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.repo = p.repo AND c.path = p.path)")
def incremental_deleted(spark, d):
    cur, prev = _runs(spark, d)
    return prev.join(cur, ["repo", "path"], "left_anti").select("repo", "path")


@query("incremental_union", "WITH " + _PREV + """ SELECT p.repo, p.path, p.file_hash, 'reused' AS origin FROM prev p WHERE EXISTS (SELECT 1 FROM cur c WHERE c.repo = p.repo AND c.path = p.path AND c.file_hash = p.file_hash)
UNION ALL SELECT c.repo, c.path, c.file_hash, 'new' FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE c.repo = p.repo AND c.path = p.path AND c.file_hash = p.file_hash)""")
def incremental_union(spark, d):
    return incremental_reuse(spark, d).withColumn("origin", F.lit("reused")).unionByName(incremental_changed(spark, d).withColumn("origin", F.lit("new")))


@query("token_estimate", "SELECT DISTINCT chunk_id, greatest(1, length(text) // 3)::INT AS tokens FROM chunks")
def token_estimate(spark, d):
    return table(spark, d, "chunks", "chunk_id", "text").select("chunk_id", FL.token_estimate(F.col("text")).alias("tokens")).distinct()


@query("greedy_batches", """
WITH RECURSIVE c AS (SELECT DISTINCT repo || '/' || path AS grp, chunk_id AS id, greatest(1, length(text) // 3)::INT AS tokens FROM chunks),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM c),
r AS (SELECT grp, id, tokens, k, 0 AS batch_no, 1 AS held, tokens AS used FROM o WHERE k = 1
  UNION ALL SELECT o.grp, o.id, o.tokens, o.k, CASE WHEN r.held = 3 OR r.used + o.tokens > 1500 THEN r.batch_no + 1 ELSE r.batch_no END,
    CASE WHEN r.held = 3 OR r.used + o.tokens > 1500 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held = 3 OR r.used + o.tokens > 1500 THEN o.tokens ELSE r.used + o.tokens END
  FROM r JOIN o ON o.grp = r.grp AND o.k = r.k + 1)
SELECT grp, id, tokens, batch_no::INT AS batch_no FROM r""")  # fmt: skip
def greedy_batches(spark, d):
    """Greedy batches of each file's chunks, with small limits so that every file needs several."""
    c = table(spark, d, "chunks", "chunk_id", "repo", "path", "text").select(F.concat("repo", F.lit("/"), "path").alias("grp"), F.col("chunk_id").alias("id"), FL.token_estimate(F.col("text")).alias("tokens"))
    return embedding.batch_numbers(c.distinct(), 3, 1500)


#: Chunk ids that share a stream of batches; a group is never larger.
STREAM = 2_000


@query("greedy_batches_default", """
WITH RECURSIVE c AS (SELECT DISTINCT repo || '/' || (chunk_id // 2000) AS grp, chunk_id AS id, greatest(1, length(text) // 3)::INT AS tokens FROM chunks),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM c),
r AS (SELECT grp, id, tokens, k, 0 AS batch_no, 1 AS held, tokens AS used FROM o WHERE k = 1
  UNION ALL SELECT o.grp, o.id, o.tokens, o.k, CASE WHEN r.held = 128 OR r.used + o.tokens > 80000 THEN r.batch_no + 1 ELSE r.batch_no END,
    CASE WHEN r.held = 128 OR r.used + o.tokens > 80000 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held = 128 OR r.used + o.tokens > 80000 THEN o.tokens ELSE r.used + o.tokens END
  FROM r JOIN o ON o.grp = r.grp AND o.k = r.k + 1)
SELECT grp, id, tokens, batch_no::INT AS batch_no FROM r""")  # fmt: skip
def greedy_batches_default(spark, d):
    """Greedy batches with the limits of the remote model, over stretches of each repository's chunks."""
    c = table(spark, d, "chunks", "chunk_id", "repo", "text")
    grp = F.concat("repo", F.lit("/"), F.floor(F.col("chunk_id") / STREAM).cast("string"))
    return embedding.batch_numbers(c.select(grp.alias("grp"), F.col("chunk_id").alias("id"), FL.token_estimate(F.col("text")).alias("tokens")).distinct())


_EVENTS = """ev AS (SELECT event_id, ts, user_id, '/repo/' || event_type || CASE WHEN event_id % 5 = 0 THEN '/.git/x' WHEN event_id % 7 = 0 THEN '/node_modules/x' ELSE '/src/x' END AS path, event_id % 11 = 0 AS is_directory FROM events)"""


def _events(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    tail = F.when(F.col("event_id") % 5 == 0, "/.git/x").when(F.col("event_id") % 7 == 0, "/node_modules/x").otherwise("/src/x")
    return e.select("event_id", "ts", "user_id", F.concat(F.lit("/repo/"), "event_type", tail).alias("path"), (F.col("event_id") % 11 == 0).alias("is_directory"))


_WANTED = "NOT is_directory AND NOT (contains(path, '/.git/') OR contains(path, '/__pycache__/') OR contains(path, '/.venv/') OR contains(path, '/node_modules/')) AND NOT starts_with(path, '/repo/view')"


@query("event_filter", "WITH " + _EVENTS + f" SELECT event_id FROM ev WHERE {_WANTED}")
def event_filter(spark, d):
    return _events(spark, d).where(watch.wanted_event(F.col("path"), F.col("is_directory"), ("/repo/view",))).select("event_id")


@query("debounce_sessions", "WITH " + _EVENTS + f""",
o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM ev WHERE {_WANTED} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, epoch_us(min(ts)) AS started_us, count(*) AS n_events FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, d):
    """Bursts of wanted events per user, half an hour apart."""
    e = _events(spark, d).where(watch.wanted_event(F.col("path"), F.col("is_directory"), ("/repo/view",)))
    s = watch.sessions(e, ["user_id"], gap="30 minutes")
    return s.select("user_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), "n_events")
