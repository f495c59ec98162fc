"""Queries of the core over whole tables, each with the SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ATTEMPTS, SearchConfig
from ..functions import text as X
from ..functions.arrow import arrow_map, materialize, shared_path, table
from ..functions.tokens import token_count, token_count_regex, truncate, was_truncated
from ..operators import cache as caching
from ..operators.judge import LexicalJudge, Rejected, terms, waits
from ..operators.outline import captures, chunk_text, chunked, head_rule, outlines, runs, tokens, top_classes
from ..operators.packing import oversize, pack, with_singletons
from ..operators.relational import not_within, placed, sample_exactly, sorted_concat, survivors
from ..operators.scanners import CLASS_LIKE
from ..sources.scan import as_files, existing, missing
from ..streaming.files import search_stream
from . import goldens, pipeline, prompts

QUESTION = "Where does the constructor wire a session into the adapter, and which resolver checks the deadline?"
PACK_LIMIT = 2000

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def digest(c: Column) -> Column:
    return F.md5(F.coalesce(c, F.lit("")))


# ---------------------------------------------------------------- scans and filters


@query("SELECT file_path AS path, file_id AS ord, md5(coalesce(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '')) AS text_md5, length(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS n FROM source_text")
def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    files = as_files(table(spark, folder, "source_text"))
    return files.select("path", "ord", digest(F.col("text")).alias("text_md5"), F.length("text").cast("bigint").alias("n"))


def _paths(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents").select(F.col("file_path").alias("path"), "doc_id"), table(spark, folder, "source_text").select(F.col("file_path").alias("path"))


@query("SELECT file_path AS path, doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM source_text s WHERE s.file_path = d.file_path)")
def path_exists_semi(spark: SparkSession, folder: str) -> DataFrame:
    return existing(*_paths(spark, folder))


@query("SELECT file_path AS path, doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM source_text s WHERE s.file_path = d.file_path)")
def path_missing_anti(spark: SparkSession, folder: str) -> DataFrame:
    return missing(*_paths(spark, folder))


@query(r"SELECT lower(regexp_extract(file_path, '[^/.](\.[^./]+)$', 1)) AS suffix, coalesce(lower(regexp_extract(file_path, '[^/.](\.[^./]+)$', 1)) IN ('.java', '.py', '.cs'), false) AS parseable, count(*) AS n FROM source_text GROUP BY 1, 2")
def suffix_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_text")
    return rows.groupBy(X.suffix(F.col("file_path")).alias("suffix"), X.parseable(F.col("file_path")).alias("parseable")).agg(F.count("*").alias("n"))


@query("SELECT file_path AS path, file_id AS ord, 'other' AS side FROM source_text")
def skip_skeleton_branch(spark: SparkSession, folder: str) -> DataFrame:
    return _sides(spark, folder, False)


@query("""SELECT path, ord, side FROM (SELECT file_path AS path, file_id AS ord, CASE WHEN parseable THEN 'outlined' ELSE 'other' END AS side,
    row_number() OVER (PARTITION BY file_path, parseable ORDER BY file_id DESC) AS k FROM source_text) WHERE side = 'other' OR k = 1""")
def split_sides(spark: SparkSession, folder: str) -> DataFrame:
    return _sides(spark, folder, True)


def _sides(spark: SparkSession, folder: str, outlines_too: bool) -> DataFrame:
    outlined, other = pipeline.sides(as_files(table(spark, folder, "source_text")), SearchConfig(analyze_skeletons=outlines_too))
    return outlined.select("path", "ord", F.lit("outlined").alias("side")).unionByName(other.select("path", "ord", F.lit("other").alias("side")))


@query("SELECT file_id, file_path FROM source_text ORDER BY md5('7:' || CAST(file_id AS VARCHAR)), file_id LIMIT 100")
def sample_exact_n(spark: SparkSession, folder: str) -> DataFrame:
    return sample_exactly(table(spark, folder, "source_text").select("file_id", "file_path"), 100, 7, "file_id")


@query("""SELECT DISTINCT q.cache_key, q.path FROM (SELECT DISTINCT cache_key, path FROM requests WHERE path IS NOT NULL) q
    JOIN responses r ON r.cache_key = q.cache_key WHERE contains(r.response, q.path)""")
def substring_survivors(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "responses").select("cache_key", F.col("response").alias("answer"))
    members = table(spark, folder, "requests").select("cache_key", "path").where("path is not null").distinct()
    return survivors(answers, members, "cache_key").select("cache_key", "path").distinct()


@query("SELECT source, count(*) AS n, CAST(sum(length(response)) AS BIGINT) AS chars FROM responses WHERE regexp_matches(response, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY source")
def not_blank_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "responses").where(~X.is_blank(F.col("response")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("response")).alias("chars"))


@query("SELECT file_id, (length(text) + 3) // 4 AS t FROM source_text WHERE (length(text) + 3) // 4 > 4000")
def oversize_split(spark: SparkSession, folder: str) -> DataFrame:
    return oversize(table(spark, folder, "source_text").select("file_id", token_count(F.col("text")).cast("bigint").alias("t")), 4000)[1]


# ---------------------------------------------------------------- tokens


@query("SELECT file_id, coalesce((length(text) + 3) // 4, 0) AS t FROM source_text")
def token_count_chars(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_text").select("file_id", token_count(F.col("text")).cast("bigint").alias("t"))


@query(r"SELECT file_id, CAST(coalesce(len(regexp_extract_all(text, '\w+|[^\w\s]')), 0) AS BIGINT) AS t FROM source_text")
def token_count_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_text").select("file_id", token_count_regex(F.col("text")).cast("bigint").alias("t"))


@query("SELECT doc_id, md5(coalesce(substring(text, 1, 1200), '')) AS cut_md5, coalesce((length(text) + 3) // 4 > 300, false) AS was_truncated FROM documents")
def truncate_budget(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", digest(truncate(t, 300)).alias("cut_md5"), was_truncated(t, 300).alias("was_truncated"))


# ---------------------------------------------------------------- packing

_SIZED = "SELECT doc_id, coalesce((length(text) + 3) // 4, 0) AS t FROM documents"
_NEXT_FIT = f"""WITH RECURSIVE sized AS ({_SIZED}), small AS (SELECT doc_id, t, row_number() OVER (ORDER BY doc_id) AS k FROM sized WHERE t <= {PACK_LIMIT}),
    fit AS (SELECT k, doc_id, t, t AS held, CAST(0 AS BIGINT) AS group_id FROM small WHERE k = 1
    UNION ALL SELECT s.k, s.doc_id, s.t, CASE WHEN f.held + s.t > {PACK_LIMIT} THEN s.t ELSE f.held + s.t END, f.group_id + CASE WHEN f.held + s.t > {PACK_LIMIT} THEN 1 ELSE 0 END
    FROM fit f JOIN small s ON s.k = f.k + 1)"""


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", token_count(F.col("text")).alias("size"))
    return pack(rows, ["doc_id"], F.col("size"), PACK_LIMIT).drop("size")


@query(f"{_NEXT_FIT} SELECT doc_id, t, group_id FROM fit")
def pack_next_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("not is_large").select("doc_id", "t", "group_id")


@query(f"{_NEXT_FIT} SELECT doc_id, t, false AS alone FROM fit UNION ALL SELECT doc_id, t, true FROM sized WHERE t > {PACK_LIMIT}")
def pack_with_singletons(spark: SparkSession, folder: str) -> DataFrame:
    return with_singletons(_packed(spark, folder), ["doc_id"]).select("doc_id", "t", (F.col("group_id") < 0).alias("alone"))


@query(f"{_NEXT_FIT} SELECT group_id, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS n FROM fit GROUP BY group_id")
def pack_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("not is_large").groupBy("group_id").agg(F.sum("t").alias("tokens"), F.count("*").alias("n"))


# ---------------------------------------------------------------- chunks and structure


def _lines(df: DataFrame) -> DataFrame:
    return df.select("file_id", F.posexplode(F.split(X.universal_newlines(F.col("text")), "\n")).alias("pos", "line"))


@query("""SELECT file_id, CAST(generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) - 1 AS INTEGER) AS chunk_no,
    md5(unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)))) AS line_md5 FROM source_text WHERE text IS NOT NULL""")
def flatten_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(table(spark, folder, "source_text")).select("file_id", F.col("pos").alias("chunk_no"), F.md5("line").alias("line_md5"))


@query("""WITH l AS (SELECT file_id, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) AS line FROM source_text WHERE text IS NOT NULL)
    SELECT file_id, CAST(sum(length(regexp_extract(line, '^[ \\t]*'))) AS BIGINT) AS blanks, max(length(regexp_extract(line, '^[ \\t]*'))) AS deepest FROM l GROUP BY file_id""")
def indent_of_line(spark: SparkSession, folder: str) -> DataFrame:
    n = F.length(X.indentation(F.col("line")))
    return _lines(table(spark, folder, "source_text")).groupBy("file_id").agg(F.sum(n).alias("blanks"), F.max(n).cast("bigint").alias("deepest"))


@query("SELECT doc_id, hex(encode(text))[1:64] AS first_bytes, octet_length(encode(text)) AS n_bytes FROM documents")
def byte_slice(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.hex(X.byte_slice(t, 0, 32)).alias("first_bytes"), F.octet_length(t).cast("bigint").alias("n_bytes"))


@query("""SELECT file_id, coalesce((length(head) + 3) // 4, 0) AS head_tokens, (length(head) + 3) // 4 <= 250 AND head <> '' AS head_used,
    CASE WHEN (length(head) + 3) // 4 <= 250 AND head <> '' THEN 500 - (length(head) + 3) // 4 ELSE 500 END AS body_budget
    FROM (SELECT file_id, regexp_extract(text, '^[^{]*') AS head FROM source_text WHERE text IS NOT NULL)""")
def chunk_head_budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_text").where("text is not null").select("file_id", F.regexp_extract("text", "^[^{]*", 0).alias("head"))

    def rule(c: dict[str, list]):
        for i, head in zip(c["file_id"], c["head"]):
            yield i, tokens(head), *head_rule(head, 500)

    return arrow_map(rows, rule, "file_id bigint, head_tokens bigint, head_used boolean, body_budget bigint")


_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""SELECT file_id, md5('head' || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || body END || repeat(chr(10) || '}}', 2)) AS rendered_md5
    FROM (SELECT file_id, regexp_replace(coalesce(text, ''), '{_BLANKS}+$', '') AS body FROM source_text)""")
def chunk_render(spark: SparkSession, folder: str) -> DataFrame:
    def render(c: dict[str, list]):
        for i, text in zip(c["file_id"], c["text"]):
            yield i, chunk_text("head", 2, [text or ""])

    return arrow_map(table(spark, folder, "source_text").select("file_id", "text"), render, "file_id bigint, text string").select("file_id", F.md5("text").alias("rendered_md5"))


@query("""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k) - 1 AS INTEGER) AS chunk_no, first, n FROM (
    WITH RECURSIVE lines AS (SELECT file_id, generate_subscripts(l, 1) AS k, (length(unnest(l)) + 3) // 4 AS t FROM (SELECT file_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM source_text WHERE text IS NOT NULL)),
    fit AS (SELECT file_id, k, least(t, 200) AS held, k AS first FROM lines WHERE k = 1
    UNION ALL SELECT s.file_id, s.k, CASE WHEN f.held + least(s.t, 200) > 200 THEN least(s.t, 200) ELSE f.held + least(s.t, 200) END, CASE WHEN f.held + least(s.t, 200) > 200 THEN s.k ELSE f.first END FROM fit f JOIN lines s ON s.file_id = f.file_id AND s.k = f.k + 1)
    SELECT file_id, min(k) AS k, CAST(first - 1 AS INTEGER) AS first, count(*) AS n FROM fit GROUP BY file_id, first)""")
def chunk_lines_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The chunker's packing over the lines of every file, each of which counts as a block that is cut to the budget."""
    rows = table(spark, folder, "source_text", True).where("text is not null").select("file_id", X.universal_newlines(F.col("text")).alias("text"))

    def packed(c: dict[str, list]):
        for i, text in zip(c["file_id"], c["text"]):
            for k, (a, b) in enumerate(runs([min(200, tokens(x)) for x in text.split("\n")], 200)):
                yield i, k, a, b - a

    return arrow_map(rows, packed, "file_id bigint, chunk_no int, first int, n bigint")


# Spans over whole tables that SQL can make too: a response lies where its number and length put it within its path.
_SPANS = """SELECT DISTINCT path, CASE WHEN source = 'edge-cache' THEN 'class' ELSE 'method' END AS type, CAST(seq % 997 AS INTEGER) AS "start", CAST(seq % 997 + length(response) % 400 AS INTEGER) AS "end"
    FROM responses WHERE path IS NOT NULL AND response IS NOT NULL"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "responses").where("path is not null and response is not null")
    start = F.col("seq") % 997
    kind = F.when(F.col("source") == "edge-cache", "class").otherwise("method")
    return rows.select("path", kind.alias("type"), start.cast("int").alias("start"), (start + F.length("response") % 400).cast("int").alias("end")).distinct()


@query(f"""WITH s AS ({_SPANS}) SELECT path, type, "start", "end" FROM s b WHERE NOT EXISTS (SELECT 1 FROM s a WHERE a.path = b.path AND a.type = 'class' AND a."start" <= b."start" AND b."end" <= a."end" AND NOT (a.type = b.type AND a."start" = b."start" AND a."end" = b."end"))""")
def containment_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    spans = _spans(spark, folder)
    rank = F.when(F.col("type") == "class", "z").otherwise("m")
    return not_within(spans.withColumns({"kind": F.col("type"), "type": rank}), F.col("type") == "z").select("path", F.col("kind").alias("type"), "start", "end")


@query(f"""WITH s AS ({_SPANS}) SELECT path, type, "start", "end", CAST(row_number() OVER (PARTITION BY path ORDER BY "start", "end", type) AS INTEGER) AS place FROM s""")
def stable_sort_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return placed(_spans(spark, folder), "path")


@query()
def captures_not_within(spark: SparkSession, folder: str) -> DataFrame:
    """containment_antijoin over all captures of source_text, with the place of each that is left within its file; a failed scan is a row with its error."""
    spans = captures(table(spark, folder, "source_text", True))
    keep = F.col("type").isin(*CLASS_LIKE)
    ranked = spans.where("error is null").withColumn("type", F.concat(F.when(keep, "z").otherwise("a"), "type"))
    left = not_within(ranked, F.col("type").startswith("z"), "file_id").withColumn("type", F.substring("type", 2, 1 << 30))
    return placed(left, "file_id").select("file_id", "type", "start", "end", "place", "error").unionByName(spans.where("error is not null").withColumn("place", F.lit(None).cast("int")))


def _of_language(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    return table(spark, folder, "source_text", True).where(X.suffix(F.col("file_path")) == extension)


@query()
def skeleton_java(spark: SparkSession, folder: str) -> DataFrame:
    return outlines(_of_language(spark, folder, ".java"))


@query()
def skeleton_python(spark: SparkSession, folder: str) -> DataFrame:
    return outlines(_of_language(spark, folder, ".py"))


@query()
def skeleton_csharp(spark: SparkSession, folder: str) -> DataFrame:
    return outlines(_of_language(spark, folder, ".cs"))


@query()
def chunk_java(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(_of_language(spark, folder, ".java"), 2000)


@query()
def chunk_python(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(_of_language(spark, folder, ".py"), 2000)


@query()
def chunk_csharp(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(_of_language(spark, folder, ".cs"), 2000)


@query("SELECT file_id, substring(text, 1, 8000) AS chunk FROM source_text WHERE text IS NOT NULL AND NOT coalesce(lower(regexp_extract(file_path, '[^/.](\\.[^./]+)$', 1)) IN ('.java', '.py', '.cs'), false)")
def chunk_other(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_text", True).where(~X.parseable(F.col("file_path")) & F.col("text").isNotNull())
    return chunked(rows, 2000).select("file_id", "chunk")


@query()
def class_count(spark: SparkSession, folder: str) -> DataFrame:
    return top_classes(table(spark, folder, "source_text", True))


def _quoted(x) -> str:
    if x is None or isinstance(x, bool | int):
        return "NULL" if x is None else str(x)
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) v({columns})"


@query(_values([(k, outline) for k, (_, _, outline, _) in enumerate(goldens.CASES)], "file_id, text"))
def outline_goldens(spark: SparkSession, folder: str) -> DataFrame:
    """The outlines of sources whose outlines were written down by hand."""
    return outlines(goldens.files(spark)).select(F.col("file_id").cast("int").alias("file_id"), "text")


@query(_values([(k, n, chunk) for k, (_, _, _, chunks) in enumerate(goldens.CASES) for n, chunk in enumerate(chunks)], "file_id, chunk_no, chunk"))
def chunk_goldens(spark: SparkSession, folder: str) -> DataFrame:
    return chunked(goldens.files(spark), goldens.LIMIT).select(F.col("file_id").cast("int").alias("file_id"), "chunk_no", "chunk")


# ---------------------------------------------------------------- grouping, sets


@query("SELECT path, md5(substring(string_agg(response, chr(10) || chr(10) ORDER BY response), 1, 20000)) AS joined_md5 FROM responses WHERE response IS NOT NULL GROUP BY path")
def group_sorted_concat(spark: SparkSession, folder: str) -> DataFrame:
    return sorted_concat(table(spark, folder, "responses"), "path", "response", 20000).select("path", F.md5("response").alias("joined_md5"))


@query("SELECT path FROM responses UNION ALL SELECT path FROM errors")
def union_all_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "responses").select("path").unionByName(table(spark, folder, "errors").select("path"))


@query("SELECT DISTINCT file_path AS path FROM source_text")
def distinct_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_text").select(F.col("file_path").alias("path")).dropDuplicates(["path"])


@query("SELECT DISTINCT file_path AS path FROM source_text s WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.path = s.file_path)")
def anti_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = table(spark, folder, "source_text").select(F.col("file_path").alias("path")).distinct()
    return missing(paths, table(spark, folder, "responses").where("path is not null"))


@query("SELECT model, CAST(sum(length(response) - length(replace(response, chr(10), ''))) AS BIGINT) AS lines FROM responses GROUP BY model")
def newline_progress(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "responses").groupBy("model").agg(F.sum(X.newlines(F.col("response"))).alias("lines"))


# ---------------------------------------------------------------- messages, cache


@query("""SELECT cache_key, md5(array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10) || chr(10))) AS rendered_md5, len(messages) AS turns FROM requests""")
def render_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "requests").select("cache_key", F.md5(prompts.transcript(F.col("messages"))).alias("rendered_md5"), F.size("messages").cast("bigint").alias("turns"))


_ASKED = f"The question is:\n```\n{QUESTION}\n```"


@query(f"""SELECT file_id, md5(m1 || d || m2) AS map_md5, md5(r1 || d || m2 || r2) AS recheck_md5 FROM (SELECT file_id, '<<< ' || coalesce(file_path, '') || ' >>>' || chr(10) || text || chr(10) || chr(10) AS d,
    {_quoted("system: map" + chr(10) + prompts.MAP + chr(10) * 2 + "user: ")} AS m1, {_quoted(chr(10) * 2 + "assistant: " + prompts.READ_SOURCE + chr(10) * 2 + "user: " + _ASKED)} AS m2,
    {_quoted("system: map" + chr(10) + prompts.MAP + chr(10) * 2 + "user: ")} AS r1, {_quoted(chr(10) * 2 + "assistant: first" + chr(10) * 2 + "user: " + prompts.LEFT_OUT + chr(10) + _ASKED)} AS r2 FROM source_text WHERE text IS NOT NULL)""")
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    messages = prompts.map_messages(F.col("file_path"), F.col("text"), QUESTION)
    again = prompts.recheck_messages(messages, F.lit("first"), QUESTION)
    rows = table(spark, folder, "source_text").where("text is not null")
    return rows.select("file_id", F.md5(prompts.transcript(messages)).alias("map_md5"), F.md5(prompts.transcript(again)).alias("recheck_md5"))


@query("SELECT sha256(to_json({messages: messages, model: coalesce(model, '')})) AS own_key, count(*) AS n FROM requests GROUP BY 1")
def message_cache_key(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "requests").groupBy(caching.cache_key(F.col("messages"), F.col("model")).alias("own_key")).agg(F.count("*").alias("n"))




@query("SELECT cache_key, seq, md5(coalesce(response, '')) AS response_md5 FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, seq DESC) AS k FROM responses) WHERE k = 1")
def cache_upsert_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = caching.last_wins(table(spark, folder, "responses").select("cache_key", "response", "ts", "seq"))
    return rows.select("cache_key", "seq", digest(F.col("response")).alias("response_md5"))


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    stored = table(spark, folder, "responses").where(F.col("source") == "edge-cache")
    return caching.last_wins(stored.select("cache_key", "response", "ts", "seq"))


@query("SELECT DISTINCT q.cache_key FROM requests q WHERE q.cache_key IN (SELECT cache_key FROM responses WHERE source = 'edge-cache')")
def cache_probe_hits(spark: SparkSession, folder: str) -> DataFrame:
    return caching.hits(caching.once_each(table(spark, folder, "requests")), _cache(spark, folder)).select("cache_key")


@query("SELECT DISTINCT q.cache_key FROM requests q WHERE q.cache_key NOT IN (SELECT cache_key FROM responses WHERE source = 'edge-cache')")
def cache_probe_misses(spark: SparkSession, folder: str) -> DataFrame:
    return caching.misses(caching.once_each(table(spark, folder, "requests")), _cache(spark, folder)).select("cache_key")


@query("""SELECT cache_key, md5(coalesce(response, '')) AS response_md5 FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, seq DESC) AS k FROM responses)
    WHERE k = 1 AND cache_key NOT IN (SELECT cache_key FROM requests WHERE model IS NULL)""")
def cache_delete(spark: SparkSession, folder: str) -> DataFrame:
    """A cache on disk of the last responses, from which keys are deleted."""
    cache = caching.Cache(spark, shared_path(spark, "deleted-cache"))
    cache.upsert(caching.last_wins(table(spark, folder, "responses").select("cache_key", "response", "ts", "seq")))
    cache.delete(table(spark, folder, "requests").where("model is null").select("cache_key").distinct())
    return cache.rows().select("cache_key", digest(F.col("response")).alias("response_md5"))


@query("SELECT seq, md5(CASE WHEN json_valid(response) THEN json_extract_string(response, '$.answer') END) AS answer_md5 FROM responses")
def cache_payload_json(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "responses").select("seq", F.md5(caching.answer_of(F.col("response"))).alias("answer_md5"))


@query("SELECT cache_key, count(*) AS asked, CAST(1 AS INTEGER) AS called FROM requests GROUP BY cache_key")
def stampede_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "requests")
    return caching.once_each(rows).select("cache_key").join(rows.groupBy("cache_key").agg(F.count("*").alias("asked")), "cache_key").withColumn("called", F.lit(1))


# ---------------------------------------------------------------- errors and waits


@query("""SELECT kind, path, coalesce(message, '') || CASE WHEN path IS NOT NULL THEN ' [File: ' || path || ']' ELSE '' END || CASE WHEN cause IS NOT NULL THEN ' (Original exception: ' || cause || ')' ELSE '' END AS line FROM errors""")
def error_render(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "errors").select("kind", "path", X.error_text(F.col("message"), F.col("path"), F.col("cause")).alias("line"))


class HalfJudge(LexicalJudge):
    """Turns down texts with an odd number of characters, and fails inside on those of a multiple of six. For queries and tests."""

    def ask(self, messages, model):
        n = len(messages[0]["content"])
        if n % 2:
            raise Rejected("odd")
        if n % 6 == 0:
            raise KeyError("six")
        return "even"


@query("SELECT CASE WHEN length(text) % 2 = 1 THEN 'request' WHEN length(text) % 6 = 0 THEN 'internal' ELSE 'answered' END AS kind, count(DISTINCT text) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def partial_failure_split(spark: SparkSession, folder: str) -> DataFrame:
    """Every text once to a judge that fails on some: answers and failures side by side."""
    docs = table(spark, folder, "documents", True).where("text is not null").select(F.lit("").alias("path"), "text")
    requests = pipeline.as_requests(docs, F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))), "half")
    asked = pipeline.answered(requests.select("path", "cache_key", "model", "messages"), HalfJudge(), SearchConfig(cache_mode="none"), None)
    kinds = pipeline.failures(asked).select("kind").unionByName(asked.where("answer is not null").select(F.lit("answered").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT path, kind, attempt, CAST(power(2, attempt) AS BIGINT) AS wait FROM (SELECT path, kind, CAST((row_number() OVER (PARTITION BY path, kind ORDER BY failed_at) - 1) % 10 AS INTEGER) AS attempt
    FROM (SELECT DISTINCT path, kind, failed_at FROM errors))""")
def retry_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The waits, had the failed calls of a path been the attempts at one call."""
    failed = table(spark, folder, "errors").select("path", "kind", "failed_at").distinct()
    attempt = (F.row_number().over(Window.partitionBy("path", "kind").orderBy("failed_at")) - 1) % ATTEMPTS
    return failed.select("path", "kind", attempt.alias("attempt")).withColumn("wait", waits(F.col("attempt")).cast("bigint"))


# ---------------------------------------------------------------- semantic stages, with the lexical judge

_TERMS = terms(QUESTION)
_COUNTS = " OR ".join(f"contains(lower({{0}}), '{t}')" for t in _TERMS)


@query(f"SELECT DISTINCT file_path AS path FROM source_text WHERE file_path IS NOT NULL AND text IS NOT NULL AND NOT coalesce(lower(regexp_extract(file_path, '[^/.](\\.[^./]+)$', 1)) IN ('.java', '.py', '.cs'), false) AND ({_COUNTS.format('text')})")
def semantic_filter_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The filter stage, asking the judge over each file without a scanner as its own outline and batch, so that SQL can state it."""
    files = table(spark, folder, "source_text", True).where(~X.parseable(F.col("file_path")) & F.col("text").isNotNull() & F.col("file_path").isNotNull())
    groups = files.select(F.col("file_id").alias("group_id"), F.col("file_path").alias("path"), "text")
    return pipeline.sifted(groups, QUESTION, SearchConfig(cache_mode="none"), LexicalJudge())[0]


@query(f"""SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE {_COUNTS.format('line')}), 'nothing relevant')) AS answer_md5
    FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
    GROUP BY doc_id""")
def semantic_map_lexical(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", True).where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text"))
    requests = pipeline.as_requests(docs, prompts.map_messages(F.col("path"), F.col("text"), QUESTION), "lexical")
    asked = pipeline.answered(requests.select("path", "cache_key", "model", "messages"), LexicalJudge(), SearchConfig(cache_mode="none", concurrency=64), None)
    return asked.select(F.col("path").cast("bigint").alias("doc_id"), F.md5("answer").alias("answer_md5"))


@query(rf"""SELECT doc_id, md5(once || chr(10) || chr(10) || once) AS both_md5 FROM (
    SELECT doc_id, coalesce(string_agg(DISTINCT line, chr(10) ORDER BY line) FILTER (WHERE regexp_replace(line, '{_BLANKS}+', '', 'g') <> '' AND NOT regexp_matches(line, '^<<< .+ >>>$')), 'nothing relevant') AS once
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id)""")
def semantic_reduce_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    """The reduce stage with its two calls over every document as a group; semantic_condense_notes packs the groups first."""
    docs = table(spark, folder, "documents", True).where("text is not null").select(F.col("doc_id").alias("group_id"), F.lit("note").alias("path"), "text")
    both = pipeline.condensed(docs, QUESTION, SearchConfig(cache_mode="none"), LexicalJudge())[0]
    return both.select(F.col("group_id").alias("doc_id"), F.md5("context").alias("both_md5"))


@query()
def semantic_condense_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The reduce stage over every response with text, each a note under its source and number: packed, then two judge calls a group."""
    rows = table(spark, folder, "responses").where("response is not null")
    notes = rows.select(F.format_string("%s/%012d", F.coalesce("source", F.lit("")), "seq").alias("path"), F.col("response").alias("text"))
    config = SearchConfig(cache_mode="none", concurrency=64, input_tokens=54_000)
    return pipeline.refined(notes, QUESTION, config, LexicalJudge())[0]


@query("SELECT file_id, md5('File: ' || file_path || chr(10) || text) AS shown_md5 FROM source_text WHERE text IS NOT NULL AND file_path IS NOT NULL")
def no_refine_render(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "source_text").where("text is not null and file_path is not null")
    return rows.select("file_id", F.md5(pipeline.shown_finding(F.col("file_path"), F.col("text"))).alias("shown_md5"))


def _search(spark: SparkSession, folder: str, **changes) -> DataFrame:
    files = as_files(table(spark, folder, "source_text", True))
    config = SearchConfig(cache_mode="none", concurrency=64, **changes)
    return pipeline.search(files, QUESTION, LexicalJudge(), config).contexts


@query()
def search_end_to_end(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, input_tokens=54_000)


@query()
def search_no_outlines(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, analyze_skeletons=False, refine=False)


_OTHER = r"NOT coalesce(lower(regexp_extract(file_path, '[^/.](\.[^./]+)$', 1)) IN ('.java', '.py', '.cs'), false)"


@query(rf"""WITH l AS (SELECT file_id, file_path AS path, generate_subscripts(x, 1) AS k, unnest(x) AS line FROM (SELECT file_id, file_path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM source_text WHERE text IS NOT NULL AND {_OTHER})),
    a AS (SELECT DISTINCT path, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT regexp_matches(line, '^<<< .+ >>>$') AND ({_COUNTS.format('line')})), 'nothing relevant') AS answer FROM l GROUP BY file_id, path)
    SELECT path, md5('File: ' || path || chr(10) || substring(string_agg(answer, chr(10) || chr(10) ORDER BY answer), 1, 2000000)) AS context_md5 FROM a GROUP BY path""")
def search_other_files(spark: SparkSession, folder: str) -> DataFrame:
    """A whole search without outlines and refinement over all files that have no scanner, whose chunks SQL can state."""
    files = as_files(table(spark, folder, "source_text", True)).where("not parseable")
    found = pipeline.search(files, QUESTION, LexicalJudge(), SearchConfig(cache_mode="none", analyze_skeletons=False, refine=False)).contexts
    return found.select("path", F.md5("context").alias("context_md5"))


@query()
def stream_of_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The responses as a stream, each micro-batch upserted into a cache; the cache after the last."""
    rows = table(spark, folder, "responses")
    sink, checkpoint = shared_path(spark, "stream-cache"), shared_path(spark, "stream-checkpoint")
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/responses.parquet*")

    search_stream(source, lambda batch: caching.last_wins(batch.select("cache_key", "response", "ts", "seq")), sink, checkpoint).awaitTermination()
    return caching.last_wins(spark.read.parquet(sink).select("cache_key", "response", "ts", "seq")).select("cache_key", "seq")


SQL["stream_of_batches"] = "SELECT cache_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, seq DESC) AS k FROM responses) WHERE k = 1"

__all__ = ["QUERIES", "QUESTION", "SQL", "materialize"]
