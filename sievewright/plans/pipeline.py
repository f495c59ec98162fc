"""The staged search: outlines, packed and filtered; chunks, analysed; findings, joined, packed and condensed.

Each stage that asks a judge is written before it is read, so that no call is made twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.arrow import materialize
from ..functions.text import error_text, is_blank
from ..functions.tokens import BpeCounter, Counter
from ..operators import cache as caching
from ..operators.judge import Judge, ask_all
from ..operators.outline import chunked, outlines
from ..operators.packing import pack, pack_in_buckets, with_singletons
from ..operators.relational import ordered_concat, sample_exactly, sorted_concat, survivors
from ..schemas import ERRORS
from . import prompts

#: Batches of outlines that a packing task should fill at least.
GROUPS_A_BUCKET = 16


@dataclass
class Result:
    """contexts: ord, path, context in the order to show; errors: kind, message, path, cause; warnings: path, message, of texts that
    were cut to the budget."""

    contexts: DataFrame
    errors: DataFrame
    warnings: DataFrame

    def render(self) -> str:
        """The text to show: contexts that aren't empty, in order, a blank line between them."""
        rows = self.contexts.where(~is_blank(F.col("context"))).orderBy("ord", "path").select("context")
        return "\n\n".join(r["context"] for r in rows.toLocalIterator())

    def error_lines(self) -> DataFrame:
        return self.errors.select(error_text(F.col("message"), F.col("path"), F.col("cause")).alias("line"))


def counter_of(spark: SparkSession, config: SearchConfig) -> Counter:
    return BpeCounter(spark, config.tokenizer) if config.tokenizer else Counter()


def answered(requests: DataFrame, judge: Judge, config: SearchConfig, store: caching.Cache | None, stage: str = "answers") -> DataFrame:
    """cache_key, path, answer, kind, message, cause, from_cache for each distinct request: from the cache where it may be read
    and holds the key, else asked; new answers are stored where they may be, by the workers as they come.

    Messages are shuffled once, by key. A judge that is a service gets as many tasks as the concurrency allows; one that works on
    a core gets as many as any shuffle."""
    spark = requests.sparkSession
    parts = max(1, config.concurrency // config.threads) if getattr(judge, "remote", True) else int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = caching.once_each(requests, parts)
    stored = store.rows() if store and config.reads_cache else None
    if stored is not None:
        known = caching.hits(requests.select("cache_key", "path").dropDuplicates(["cache_key"]), stored).select("cache_key", "path", caching.answer_of(F.col("response")).alias("answer"), *[F.lit(None).cast("string").alias(c) for c in ("kind", "message", "cause")], F.lit(True).alias("from_cache"))
        known = materialize(known.where(~is_blank(F.col("answer"))), "answers-known")
        once = caching.misses(once, known)
    writes = store is not None and config.writes_cache
    lines = spark.sparkContext.accumulator(0)
    fresh = ask_all(once, judge, config.threads, store.path if writes and store.direct else None, lines)
    fresh = materialize(fresh.drop("attempts").withColumn("from_cache", F.lit(False)), "answers-fresh")
    if writes and not store.direct:
        store.upsert(fresh.where("answer is not null").select("cache_key", caching.payload(F.col("answer")).alias("response")))
    if config.on_stage:
        config.on_stage(f"{stage}: {lines.value} lines received")
    return fresh if stored is None else fresh.unionByName(known)


def failures(asked: DataFrame) -> DataFrame:
    return asked.where("kind is not null").select("kind", "message", "path", "cause")


def as_requests(df: DataFrame, messages: Column, model: str, path: str = "path") -> DataFrame:
    rows = df.withColumn("messages", messages).withColumn("model", F.lit(model))
    return rows.withColumn("cache_key", caching.cache_key(F.col("messages"), F.col("model"))).withColumn("path", F.col(path))


def sides(files: DataFrame, config: SearchConfig) -> tuple[DataFrame, DataFrame]:
    """(files that go through the filter over outlines, others). Of a path's versions the one of greatest ord stands for it on the
    first side; without outlines all files are on the other."""
    if not config.analyze_skeletons:
        return files.where("false"), files
    return caching.last_wins(files.where("parseable"), "path", ("ord", "text")).select(*files.columns), files.where("not parseable")


def sifted(packed: DataFrame, question: str, config: SearchConfig, judge: Judge, store: caching.Cache | None = None) -> tuple[DataFrame, DataFrame]:
    """(path of each member of a group (group_id, path, text) whose path stands in the answer over the group, errors)."""
    batches = ordered_concat(packed, "group_id", ["path"], prompts.labelled(F.col("path"), F.col("text")))
    requests = materialize(as_requests(batches.withColumn("where", F.lit(None).cast("string")), prompts.filter_messages(F.col("text"), question), config.analyze_model, "where").select("group_id", "cache_key", "model", "messages", "path"), "filter-requests")
    asked = answered(requests, judge, config, store, "filter")
    answers = requests.select("group_id", "cache_key").join(asked.where("answer is not null").select("cache_key", "answer"), "cache_key")
    return survivors(answers, packed.select("group_id", "path"), "group_id").select("path").distinct(), failures(asked)


def coarse(files: DataFrame, question: str, config: SearchConfig, judge: Judge, store: caching.Cache | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths that survive the filter over outlines, errors)."""
    counter = counter_of(files.sparkSession, config)
    shown = materialize(outlines(files, "ord", "path", "text").withColumn("n", counter.count(F.col("text"))), "outlines")
    failed = shown.where("error is not null").select(F.lit("internal").alias("kind"), F.lit("the outline failed").alias("message"), "path", F.col("error").alias("cause"))
    good = shown.where("error is null").select("path", "text", "n")
    total = good.agg(F.sum("n").alias("t")).first()["t"] or 0
    buckets = max(1, total // (GROUPS_A_BUCKET * config.skeleton_batch))  # each may leave one batch part-filled
    packed = materialize(pack_in_buckets(good, "path", ["path"], F.col("n"), config.skeleton_batch, buckets), "outline-groups")
    kept, errors = sifted(packed, question, config, judge, store)
    return kept, errors.unionByName(failed)


def shown_finding(path: Column, text: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit("\n"), text)


def findings(files: DataFrame, question: str, config: SearchConfig, judge: Judge, store: caching.Cache | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path, text: the analyses of each file's chunks, sorted, joined and cut to the budget; errors; warnings)."""
    counter = counter_of(files.sparkSession, config)
    cut = materialize(chunked(files, config.input_tokens, "ord", "path", "text", counter), "chunks")
    failed = cut.where("error is not null").select(F.lit("internal").alias("kind"), F.lit("the chunks failed").alias("message"), "path", F.col("error").alias("cause"))
    requests = materialize(as_requests(cut.where("chunk is not null").select("path", "chunk"), prompts.map_messages(F.col("path"), F.col("chunk"), question), config.analyze_model).select("path", "cache_key", "model", "messages"), "map-requests")
    asked = answered(requests, judge, config, store, "map")
    notes = requests.select("path", "cache_key").join(asked.where("answer is not null").select("cache_key", "answer"), "cache_key").distinct()
    # A token has no bound in characters; of the usual ones eight are more than any budget's worth.
    joined = materialize(sorted_concat(notes, "path", "answer", (8 if config.tokenizer else 4) * config.input_tokens + 1), "analyses")
    text = counter.cut(F.col("answer"), config.input_tokens)
    warnings = cut.where("was_truncated").select("path", F.format_string("chunk %d was cut to the budget", "chunk_no").alias("message"))
    warnings = warnings.unionByName(joined.where(counter.count(F.col("answer")) > config.input_tokens).select("path", F.lit("the analyses were cut to the budget").alias("message")))
    return joined.select("path", text.alias("text")), failures(asked).unionByName(failed), warnings


def condensed(groups: DataFrame, question: str, config: SearchConfig, judge: Judge, store: caching.Cache | None = None) -> tuple[DataFrame, DataFrame]:
    """(group_id, context: both answers of the two calls over each group, errors)."""
    notes = ordered_concat(groups, "group_id", ["path"], prompts.labelled(F.col("path"), F.col("text")))
    first = materialize(as_requests(notes.withColumn("where", F.lit(None).cast("string")), prompts.reduce_messages(F.col("text"), question), config.refine_model, "where").select("group_id", "cache_key", "model", "messages", "path"), "reduce-requests")
    one = answered(first, judge, config, store, "reduce")
    seen = first.join(one.where("answer is not null").select("cache_key", F.col("answer").alias("first")), "cache_key")
    second = materialize(as_requests(seen, prompts.recheck_messages(F.col("messages"), F.col("first"), question), config.refine_model).select("group_id", "first", "cache_key", "model", "messages", "path"), "recheck-requests")
    two = answered(second, judge, config, store, "recheck")
    both = second.join(two.where("answer is not null").select("cache_key", F.col("answer").alias("second")), "cache_key")
    return both.select("group_id", F.concat_ws("\n\n", "first", "second").alias("context")), failures(one).unionByName(failures(two))


def refined(notes: DataFrame, question: str, config: SearchConfig, judge: Judge, store: caching.Cache | None = None) -> tuple[DataFrame, DataFrame]:
    """(contexts as in Result: notes (path, text) packed in order of path and condensed, those over the budget as they are, errors)."""
    counter = counter_of(notes.sparkSession, config)
    packed = materialize(pack(notes, ["path"], counter.count(F.col("text")), config.input_tokens), "note-groups")
    contexts, errors = condensed(packed.where("not is_large"), question, config, judge, store)
    large = packed.where("is_large").select(F.lit(1 << 62).cast("bigint").alias("ord"), "path", shown_finding(F.col("path"), F.col("text")).alias("context"))
    return contexts.select(F.col("group_id").alias("ord"), F.lit("").alias("path"), "context").unionByName(large), errors


def search(files: DataFrame, question: str, judge: Judge, config: SearchConfig | None = None, store: caching.Cache | None = None) -> Result:
    """Answers a question over files (path, ord, text, parseable). A path's versions are kept on the side without a scanner, and
    meet again when findings are joined by path; on the other the one of greatest ord counts."""
    config = config or SearchConfig()
    spark = files.sparkSession
    files = sample_exactly(files, config.sample, config.seed, "path")
    if files.isEmpty():
        raise ValueError("there are no files to search")
    errors = spark.createDataFrame([], ERRORS)
    outlined, relevant = sides(files, config)
    if config.analyze_skeletons:
        kept, coarse_errors = coarse(outlined, question, config, judge, store)
        errors = errors.unionByName(coarse_errors)
        relevant = outlined.join(kept, "path", "left_semi").unionByName(relevant)
    notes, more, warnings = findings(relevant, question, config, judge, store)
    errors = errors.unionByName(more)
    if not config.refine:
        shown = notes.select(F.lit(0).cast("bigint").alias("ord"), "path", shown_finding(F.col("path"), F.col("text")).alias("context"))
        return Result(shown, errors, warnings)
    contexts, last = refined(notes, question, config, judge, store)
    return Result(contexts, errors.unionByName(last), warnings)


__all__ = ["Result", "answered", "coarse", "condensed", "findings", "refined", "search", "sides", "sifted", "with_singletons"]
