"""Problem 1: files that were not written by hand.

Method: a random forest on compression ratio, token entropy, identifier lengths, comment density and the like, of the text
without its head, and on how many repositories hold the same text. Notices in heads, places and names (marks) label its
sample and are hidden from it; so do, for bundles and data, which carry no notice, shapes beyond doubt. The forest's score
decides every row; a mark moves the score from which a row is a case, for copies of libraries to none, as a copy that no
other repository holds reads like any code.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialize

#: Rows that the forest is fitted on at most, taken by a hash of the id; its trees, depth, rows of a leaf and seed.
SAMPLE_ROWS, TREES, DEPTH, LEAST_ROWS, SEED = 20_000, 40, 8, 8, 7
#: Depth and rows of a leaf of the first forest, which is to give a region its share of labels rather than learn each.
COARSE = (6, 60)
#: Rows without a mark that a first forest gives so much are no sure negatives, and the second does without them.
UNSURE = 0.3
#: The share of trees that makes a case: without a mark, with a place or name, with a notice of a tool, with a mark of a copy.
THRESHOLD, MARKED_THRESHOLD, NOTICED_THRESHOLD, COPY_THRESHOLD = 0.5, 0.2, 0.05, 0.0
#: Code with more characters a line on average, or a greater share of them in literals, is labelled as bundle or data.
PACKED_LINE, LITERAL_SHARE, LEAST_DATA = 150, 0.8, 200
#: Prose under the name of code has long lines too: more blanks than this a character, and fewer signs a token.
PROSE_SPACES, PROSE_SIGNS = 0.05, 0.25
#: Shorter texts recur by chance.
LEAST_BODY = 120

# Notices of tools and of copied libraries, and places and names that say what a file is.
_TOOL = re.compile(
    r"(?i)do not (?:edit|modify|change|touch)|(?:auto(?:matically|matisch)?[- ]?)(?:generated|created|erzeugt|produced|written)|<auto-generated|@generated|generated (?:by|from|on|with|code|file|automatically)|code generated|machine[- ](?:made|generated|written)"
    r"|erzeugt (?:von|durch|aus|mit)|generiert (?:von|durch|aus|mit)|(?:produit|g[ée]n[ée]r[ée]) (?:par|automatiquement)|generado (?:por|autom)|gerado (?:por|autom)|wygenerowan|vygenerov[áa]n|сгенерирован|создан автоматически|自動生成"
    r"|ne pas modifier|no modificar|n[ãa]o (?:editar|modificar)|nicht (?:von hand )?(?:bearbeiten|[äa]ndern)|nie edytowa|neupravovat|не редактировать|(?:changes|edits) (?:will be|get|are) (?:lost|overwritten)|(?:output|emitted|written|compiled|produced|created|built) by [\w.\-]+(?: v?\d|$| from)|this (?:file|code) (?:was|is) (?:produced|generated|created|emitted|compiled)"
)
_COPY = re.compile(r"(?i)copyright \(c\) the [\w.\-]+ contributors|bundled copy|vendored|third[- ]party|upstream:|redistribution in source and binary|copied (?:verbatim|unchanged) from|copy of [\w.\-]+ v?\d|@license|licensed under the (?:mit|apache|bsd)|permission is hereby granted")
_COPY_PLACE = re.compile(r"(?i)(?:^|/)(?:vendor|vendors|third[_-]?party|3rdparty|node_modules|bower_components|deps|site-packages|thirdparty|jspm_packages|pods|external)/(?=[^/]+/)")
_TOOL_PLACE = re.compile(r"(?i)(?:^|/)(?:generated|gen|gen-src|generated-sources|generated-src|__generated__|build/out|dist)/")
_TOOL_NAME = re.compile(r"(?i)(?:\.(?:g|designer|generated|pb|gen)\.\w+|_pb2?(?:_grpc)?\.\w+|\.pb\.\w+|_generated\.\w+|[._-]gen\.\w+)$")
_LOCK_NAME = re.compile(r"(?i)(?:^|/)(?:[\w.\-]*\.lock(?:\.(?:json|ya?ml|toml))?|(?:package|npm|composer|yarn|poetry|pnpm|gradle|packages)[-.]lock(?:\.\w+)?|[\w.\-]*-lock\.(?:json|ya?ml)|npm-shrinkwrap\.json|go\.sum|paket\.lock|mix\.lock)$")
_BUNDLE_NAME = re.compile(r"(?i)\.(?:min|bundle|packed|chunk|umd)\.\w+$")
#: Extensions of code.
CODE = "py java cs js ts jsx tsx mjs c cc cpp h hpp go rb php kt rs swift scala sh".split()
PATH_MARKS = {"copy_place": _COPY_PLACE, "tool_place": _TOOL_PLACE, "tool_name": _TOOL_NAME, "lock_name": _LOCK_NAME, "bundle_name": _BUNDLE_NAME}
MARKS = ("tool_notice", "copy_notice", *PATH_MARKS)

_HEAD = re.compile(r"\A(?:[ \t]*(?:(?://|#|--|;|\*|<!--|%)[^\n]*|/\*.*?\*/|<!--.*?-->|@echo[^\n]*)?[ \t]*(?:\r?\n|\Z))*", re.S)
#: Words that point to the file itself.
_THIS = frozenset("this the all diese dieser dieses ce cette este esta ten ta tento tato ten этот данный".split())
_LEADER = re.compile(r"[\s/#;*%<!\-\"'@]*")
#: Strings, comments, names, numbers and signs in one pass, so that no quote is taken for another's end.
_TOKEN = re.compile(
    r"\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|@\"(?:\"\"|[^\"])*(?:\"|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*(?:`|\Z)"
    r"|//[^\n]*|/\*.*?\*/|(?:^|(?<=\s))#[^\n]*|<!--.*?-->|[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]",
    re.S | re.M,
)
_NUMBER_LIST = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)[LlFfUu]?\s*[,;]\s*){6,}")
_RUN = re.compile(r"a[a9_]*|9+")
_SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$"}, **{c: "9" for c in "0123456789"}, " ": None, "\t": None, "\r": None})

NUMBERS = ("ratio", "entropy", "identifier", "identifier_spread", "comments", "line_mean", "line_max", "spaces", "digits", "literals", "repeated", "shapes", "vocabulary", "symbols", "log_size", "deep")
INPUTS = (*NUMBERS, "code", "log_repos")
FEATURES = "file_id bigint, repo string, body bigint, has_text boolean, " + ", ".join(f"{m} boolean" for m in MARKS) + ", " + ", ".join(f"{n} double" for n in (*NUMBERS, "code"))


def head(text: str) -> tuple[str, str]:
    """The comments that a file begins with, and the rest."""
    text = text.lstrip("﻿")
    m = _HEAD.match(text)
    cut = m.end() if m else 0
    first = text[cut : cut + 3]
    if first in ('"""', "'''"):
        end = text.find(first, cut + 3)
        if 0 <= end < cut + 4000:
            cut = end + 3
    return text[:cut], text[cut:]


def notices(top: str) -> tuple[bool, bool]:
    """Whether a head states that a tool made the file, or that it is a library's copy. A tool's notice opens its sentence, behind
    two words at most or three such as "this file was"; further in, a sentence speaks of other files."""
    tool = False
    for m in _TOOL.finditer(top):
        line = top[top.rfind("\n", 0, m.start()) + 1 : m.start()]
        before = re.split(r"[.:;!?—–]\s|,\s", line[_LEADER.match(line).end() :])[-1]
        words = before.lower().split()
        if len(words) <= 2 or len(words) == 3 and words[0] in _THIS:
            tool = True
            break
    return tool, bool(_COPY.search(top))


def numbers(body: str) -> list[float]:
    """The features of NUMBERS, of a text without its head."""
    n = max(1, len(body))
    raw = body.encode("utf-8", "replace")
    counts = Counter(_TOKEN.findall(body))
    total = max(1, sum(counts.values()))
    entropy, names, length, square, comment, literal, symbols = 0.0, 0, 0, 0, 0, 0, 0
    for token, c in counts.items():
        p, first, size = c / total, token[0], len(token)
        entropy -= p * math.log2(p)
        if first.isalpha() or first in "_$":
            names, length, square = names + c, length + size * c, square + size * size * c
        elif size == 1:
            symbols += c * (not first.isalnum())
        elif first in "\"'`@":
            wordy = token.count(" ") > size / 12  # words, and code behind a quote that isn't closed
            if wordy and token[:3] in ('"""', "'''"):
                comment += size * c
            elif size > 16 and not wordy:
                literal += size * c
        elif first in "/#<":
            comment += size * c
    mean = length / max(1, names)
    spread = math.sqrt(max(0.0, square / max(1, names) - mean**2))
    digits = sum(map(body.count, "0123456789")) / n
    if digits > 0.05:
        literal += sum(m.end() - m.start() for m in _NUMBER_LIST.finditer(body))
    lines = body.split("\n")
    full = [x for x in lines if x and not x.isspace()]
    shapes = Counter(x for x in _RUN.sub("a", body.translate(_SHAPE)).split("\n") if x)
    top_shapes = sum(c for _, c in shapes.most_common(5)) / max(1, len(full))
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy / max(1.0, math.log2(total + 1)), mean, spread, comment / n, n / max(1, len(full)),
        math.log1p(max(map(len, lines))), body.count(" ") / n, digits, min(1.0, literal / n),
        1 - len(set(full)) / max(1, len(full)), top_shapes, len(counts) / total, symbols / total, math.log1p(n), sum(x.startswith("            ") for x in full) / max(1, len(full)),
    ]


def features(df: DataFrame, id_column: str = "file_id", path_column: str = "file_path", text_column: str = "text") -> DataFrame:
    """FEATURES of every row with text. body: a hash of the text without head and blanks, null of short ones; repo: the path's first part."""
    rows = df.select(F.col(id_column).cast("bigint").alias("file_id"), F.col(path_column).alias("path"), F.col(text_column).alias("text")).where(F.col("text").isNotNull())

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        import xxhash

        for i, path, text in zip(c["file_id"], c["path"], c["text"]):
            path = path or ""
            top, body = head(text)
            inner = "/" + path[path.find("/") + 1 :]
            solid = "".join(body.split())
            same = int.from_bytes(xxhash.xxh64_digest(solid.encode("utf-8", "replace")), "big", signed=True) if len(solid) >= LEAST_BODY else None
            yield i, path.split("/", 1)[0], same, bool(text.strip()), *notices(top), *[bool(r.search(inner)) for r in PATH_MARKS.values()], *numbers(body), float(path.rsplit(".", 1)[-1].lower() in CODE)

    return arrow_map(rows, per_batch, FEATURES)


def with_repos(known: DataFrame) -> DataFrame:
    """log_repos: the logarithm of the number of repositories that hold the same text. Repositories of a text are made distinct
    before they are counted, and only texts of several come to the join, whose hot keys the planner splits."""
    several = known.where("body is not null").select("body", "repo").distinct().groupBy("body").agg(F.count("*").alias("n")).where("n > 1")
    several = materialize(several, "handwritten-recurring")
    return known.join(several, "body", "left").withColumn("log_repos", F.log(F.coalesce("n", F.lit(1)).cast("double"))).drop("n")


def marked(*marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.col(m)
    return out


def packed() -> Column:
    return (F.col("code") == 1) & (F.col("line_mean") > PACKED_LINE) & ((F.col("spaces") < PROSE_SPACES) | (F.col("symbols") > PROSE_SIGNS))


def literal() -> Column:
    return (F.col("code") == 1) & (F.col("literals") > LITERAL_SHARE) & (F.col("log_size") > math.log(LEAST_DATA))


def fit(known: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """The forest, fitted on at most sample_rows rows of least hash: any mark or shape beyond doubt is a positive label. Machine-made
    files without one stand among the negatives; a first, coarse forest finds them, and a second is fitted without them."""
    from pyspark.ml.functions import vector_to_array

    n = known.where("has_text").count()
    h = F.pmod(F.xxhash64("file_id"), F.lit(1 << 62))
    rows = known.where("has_text").where(h < F.lit(int((1 << 62) * min(1.0, 1.5 * sample_rows / max(1, n)))))  # so that only about the sample is sorted
    rows = rows.select((marked(*MARKS) | packed() | literal()).cast("double").alias("label"), h.alias("h"), *INPUTS).orderBy("h").limit(sample_rows)
    rows = materialize(rows.drop("h"), "handwritten-sample")
    first = _forest(rows, *COARSE)
    if first is None:
        return None
    doubtful = vector_to_array("probability")[1] > UNSURE
    sure = first.transform(rows).where((F.col("label") == 1) | ~doubtful).select("label", *INPUTS)
    return _forest(materialize(sure, "handwritten-sure"), DEPTH, LEAST_ROWS) or first


def _forest(rows: DataFrame, depth: int, least_rows: int):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    share = rows.agg(F.avg("label").alias("x")).first()["x"]
    if not share or share == 1.0:
        return None
    weighed = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=depth, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight", minInstancesPerNode=least_rows)
    return Pipeline(stages=[VectorAssembler(inputCols=list(INPUTS), outputCol="features"), forest]).fit(weighed)


def judge(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """file_id, score (of the forest; null where none could be fitted, and marks decide), least (the score from which the row is
    a case), mark (has it one), kind (tool, bundle, copy, data, lock; null: by hand).

    Null texts give no rows, empty and blank ones are by hand; a null path has no mark; repeated rows count by their own ids;
    an empty table gives no rows; other columns are not looked at."""
    from pyspark.ml.functions import vector_to_array

    known = materialize(with_repos(materialize(features(df), "handwritten-features")), "handwritten-known")
    model = fit(known, sample_rows)
    if model is None:
        scored = known.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(known).withColumn("score", vector_to_array("probability")[1])
    place = marked("tool_place", "tool_name", "lock_name", "bundle_name")
    least = F.when(marked("copy_place", "copy_notice"), COPY_THRESHOLD).when(F.col("tool_notice"), NOTICED_THRESHOLD).when(place, MARKED_THRESHOLD).otherwise(THRESHOLD)
    case = F.col("has_text") & F.coalesce(F.col("score") >= least, marked(*MARKS))
    kind = (
        F.when(F.col("lock_name"), "lock")
        .when(marked("copy_place", "copy_notice"), "copy")
        .when(F.col("tool_notice"), "tool")
        .when(F.col("bundle_name") | (F.col("code") == 1) & (F.col("line_mean") > PACKED_LINE / 1.5) & (F.col("literals") < LITERAL_SHARE), "bundle")
        .when(literal(), "data")
        .when((F.col("log_repos") > 0) & ~place, "copy")
        .otherwise("tool")
    )
    return scored.select("file_id", "score", least.alias("least"), marked(*MARKS).alias("mark"), F.when(case, kind).alias("kind"))


def find_machine_made(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return judge(df, sample_rows).where("kind is not null")


def evidence(df: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Of the cases of each kind: n_marked, n_by_score (the score alone suffices), n_mark_lowers (a mark lowers what is asked for),
    n_mark_alone (a copy's mark against the score)."""
    counted = lambda c: F.sum(c.cast("bigint"))
    alone = (F.col("score") < THRESHOLD) | F.col("score").isNull()
    return find_machine_made(df, sample_rows).groupBy("kind").agg(
        F.count("*").alias("n"), counted(F.col("mark")).alias("n_marked"), counted(~alone).alias("n_by_score"),
        counted(alone & (F.col("least") > 0)).alias("n_mark_lowers"), counted(alone & (F.col("least") == 0)).alias("n_mark_alone"),
    )
