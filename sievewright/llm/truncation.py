"""Problem 2: responses that stop before their end.

Method: lengths are treated as survival times. For each source and each way to measure a response, the discrete hazard of
every length is the number of distinct texts that end there over those at least as long, from window functions over the
counts; each is tested against the hazards of its neighbourhood, with false-discovery control. At a significant length any
ending that isn't plainly finished is flagged, and a finished one too where nearly all that end there are cut; elsewhere
(cut in transfer) the ending itself must be incomplete.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from math import exp, lgamma, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import arrow_map, materialize

#: Lengths to each side that a hazard is tested against, the false-discovery rate, and the least number of distinct texts.
NEIGHBOURS, FALSE_DISCOVERIES, LEAST_TEXTS = 25, 0.001, 4
#: Where this share of a form's texts of a significant length is unfinished, a finished look doesn't clear the rest of that form.
MOSTLY_CUT = 0.9
#: A text of so many characters at most that is the whole answer under so many cache keys and for so many paths is a stock reply, not a stump.
STOCK_LENGTH, STOCK_CALLS = 60, 3

# File extensions that end a path, and what writers put behind a cut.
EXTENSIONS = "py java cs js ts json yml yaml properties md sh xml toml sql env txt html css csv cfg ini go rs c cpp h rb kt".split()
_MARKER = re.compile(r"\s*(?:…|\.\.\.|\[\s*(?:…|\.\.\.|truncated|cut|output truncated|snip)\s*\]|\((?:…|\.\.\.|truncated|cut)\)|<(?:truncated|cut)>|\[\+?\d+ (?:more )?(?:chars|characters|bytes|tokens)[^\]]*\])\s*$", re.I)
_PATH_END = re.compile(rf"[\w.\-@+]+(?:/[\w.\-@+]+)*\.(?:{'|'.join(EXTENSIONS)})[`'\"*)]*$", re.I)
_PATH_CUT = re.compile(r"(?:[\w\-]+/)+[\w.\-]*\.$")
_ENTRY_FORMS = ("json", "literal")
OPEN, MARKED, BARE, ENDED = "open", "marked", "bare", "ended"


def unclosed(text: str) -> bool:
    """The end lies within a string or a bracket of a JSON-like text."""
    depth, quote, k, n = 0, "", 0, len(text)
    while k < n:
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
        k += 1
    return bool(quote) or depth > 0


def unpack(response: str) -> tuple[str, str | None]:
    """(form, answer) of a stored response: json, literal (other quoting), broken or plain. The answer of an entry without one is None."""
    body = response.strip()
    if body[:1] in "{[\"" and body:
        try:
            value = json.loads(body)
        except ValueError:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")  # of escapes that Python doesn't know
                    value = ast.literal_eval(body)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                value = None
                if body[0] == "{":
                    return "broken", body
            form = "literal"
        else:
            form = "json"
        if isinstance(value, dict):
            answer = value.get("answer")
            return form, answer if isinstance(answer, str) else None
    return "plain", response


def ending(text: str) -> str:
    """How a text ends: open (cut within a block, word or path), marked (a cut's mark stands behind it), bare (prose without a stop), ended."""
    body = text.rstrip()
    if not body:
        return ENDED
    m = _MARKER.search(body)
    if m and m.start() > 0:
        return MARKED
    if body.count("```") % 2:
        return OPEN
    line = body[body.rfind("\n") + 1 :].strip()
    if line.startswith("```"):
        return ENDED
    if line.startswith("|"):
        rows = []
        for x in reversed(body.split("\n")):
            if not x.lstrip().startswith("|"):
                break
            rows.append(x.strip())
        cells = rows[-1].count("|")
        return ENDED if line.endswith("|") and line.count("|") == cells and len(rows) > 2 else OPEN
    if re.fullmatch(r"[-*+>]|\d+[.)]|#+", line):
        return OPEN
    last = line.split()[-1]
    if last[-1] in ".!?。！？":
        if _PATH_CUT.search(last) and not _PATH_END.search(last[:-1]):
            return OPEN
        return ENDED
    if _PATH_END.search(last):
        words = line.lstrip("-*+> ").split()
        return BARE if len(words) > 3 and words[0][0] != "`" else ENDED  # a list's entry, or prose that stops at a path
    if re.fullmatch(r"\*\*[^*]+\*\*|#+ .*|.*:", line):
        return OPEN if body != line else BARE
    if last.rstrip("`'\"*)»”’")[-1:] in tuple(".!?。！？") and last[-1] in "`'\"*)»”’":
        return ENDED
    return BARE


FEATURES = "seq bigint, source string, key bigint, path bigint, head string, text_hash bigint, answer_hash bigint, form string, ending string, n_chars int, n_bytes int, answer_chars int, answer_bytes int"


def endings(df: DataFrame) -> DataFrame:
    """Form, ending and lengths of every response with text, its call (cache_key and path where df has them, else the row
    stands for itself) and the head of its answer. Null and blank responses give no rows."""
    call = [F.xxhash64("seq") if c not in df.columns else F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in ("cache_key", "path")]
    rows = df.select(F.col("seq").cast("bigint").alias("seq"), "source", call[0].alias("key"), call[1].alias("path"), F.col("response")).where(F.col("response").rlike(r"\S"))

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        import xxhash

        h = lambda x: int.from_bytes(xxhash.xxh64_digest(x), "big", signed=True)
        for seq, source, key, path, text in zip(c["seq"], c["source"], c["key"], c["path"], c["response"]):
            form, answer = unpack(text)
            answer = answer or ""
            end = (OPEN if unclosed(answer) else ending(answer)) if form == "broken" else ending(answer)
            core = _MARKER.sub("", answer.rstrip()) if end == MARKED else answer
            raw, a = text.encode("utf-8", "surrogatepass"), core.encode("utf-8", "surrogatepass")
            yield seq, source, key, path, answer.strip()[: STOCK_LENGTH + 1], h(raw), h(answer.strip().encode("utf-8", "surrogatepass")), form, end, len(text), len(raw), len(core), len(a)

    return arrow_map(rows, per_batch, FEATURES)


def _poisson_tail(d: int, mu: float) -> float:
    """P(X >= d) for a Poisson variable with mean mu."""
    if d <= 0:
        return 1.0
    if mu <= 0:
        return 0.0
    term, total, k = exp(d * log(mu) - mu - lgamma(d + 1)), 0.0, d
    if mu > d:
        return min(1.0, 1.0 - sum(exp(j * log(mu) - mu - lgamma(j + 1)) for j in range(d)))
    while term > total * 1e-12 and k < d + 10000:
        total += term
        k += 1
        term *= mu / k
    return min(1.0, total)


MEASURES = ("n_chars", "n_bytes", "answer_chars", "answer_bytes")


def by_measure(df: DataFrame, *columns: str) -> DataFrame:
    """These columns with measure and length, a row for each measure."""
    lengths = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in MEASURES]))
    return df.select(*columns, lengths.alias("x")).select(*columns, "x.*").where("length > 0")


HAZARDS = "source string, measure string, length int, texts bigint, at_risk bigint, expected double, p double"


def hazards(features: DataFrame) -> DataFrame:
    """Hazard of each length with its test: HAZARDS' columns and significant. Copies of a text count once within a source.

    A window here holds one source's distinct lengths of one measure, so no more rows than the longest text has bytes."""
    texts = features.groupBy("source", "text_hash").agg(*[F.first(m).alias(m) for m in MEASURES])
    counts = by_measure(texts, "source").groupBy("source", "measure", "length").agg(F.count("*").alias("texts"))
    w = Window.partitionBy("source", "measure")
    tested = counts.select("*", F.sum("texts").over(w.orderBy(F.desc("length"))).alias("at_risk"), F.max("length").over(w).alias("longest")).withColumn("hazard", F.col("texts") / F.col("at_risk"))
    near = [F.coalesce(F.sum("hazard").over(w.orderBy("length").rangeBetween(*r)), F.lit(0.0)) for r in ((-NEIGHBOURS, -1), (1, NEIGHBOURS))]
    # Of the neighbourhood's lengths, those that no text has count as well, their hazard is 0; behind the longest text there is none.
    lengths = F.least(F.col("length") - 1, F.lit(NEIGHBOURS)) + F.least(F.col("longest") - F.col("length"), F.lit(NEIGHBOURS))
    expected = (F.col("at_risk") * (near[0] + near[1]) + 0.5) / F.greatest(lengths, F.lit(1))

    def test(c: dict[str, list]) -> Iterator[tuple]:
        for row in zip(*[c[k] for k in ("source", "measure", "length", "texts", "at_risk", "expected")]):
            yield *row, _poisson_tail(row[3], row[5])

    tested = arrow_map(tested.select("source", "measure", "length", "texts", "at_risk", expected.alias("expected")), test, HAZARDS)
    k = F.row_number().over(w.orderBy("p", "length"))
    m = F.count("*").over(w)
    passed = F.when(F.col("p") <= F.lit(FALSE_DISCOVERIES) * F.col("k") / F.col("m"), F.col("k"))
    ranked = tested.withColumns({"k": k, "m": m}).withColumn("cut", F.max(passed).over(w))
    return ranked.withColumn("significant", F.coalesce((F.col("k") <= F.col("cut")) & (F.col("texts") >= LEAST_TEXTS), F.lit(False))).drop("k", "m", "cut")


def stock_replies(features: DataFrame) -> DataFrame:
    """answer_hash of short whole answers that recur by themselves: under several cache keys and for several paths, which copies
    of a row don't have, and no other answer goes on within their last word."""
    short = features.where((F.col("ending") == BARE) & (F.col("answer_chars") <= STOCK_LENGTH))
    often = short.groupBy("answer_hash").agg(F.countDistinct("key").alias("keys"), F.countDistinct("path").alias("paths"), F.first("head").alias("head"))
    often = materialize(often.where((F.col("keys") >= STOCK_CALLS) & (F.col("paths") >= STOCK_CALLS)).select("answer_hash", "head"), "truncation-stock")
    lengths = [r["n"] for r in often.select(F.length("head").alias("n")).distinct().collect()]  # STOCK_LENGTH at most
    n = F.col("n")
    longer = features.select("head").distinct().withColumn("n", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")))
    longer = longer.where(F.substring("head", n, F.lit(2)).rlike(r"^[\p{L}\p{N}_]{2}$")).select(F.substring("head", F.lit(1), n).alias("head"))
    return often.join(longer, "head", "left_anti").select("answer_hash")


def find_truncated(df: DataFrame) -> DataFrame:
    """seq, source, form, ending, evidence (length or ending) of each truncated response.

    Null, empty and blank responses are not cases; a null source is a source of its own; repeated rows count by their own
    seq; an empty table gives no rows; cache_key and path, where df has them, tell stock replies from copies of a stump; other
    columns are not looked at."""
    features = materialize(endings(df), "truncation-features")
    spikes = materialize(hazards(features).where("significant").select("source", "measure", "length"), "truncation-spikes")
    # The lengths at which a source cuts are few; the joins let the planner choose, by their written size.
    s = spikes.select(F.col("source").alias("s"), F.col("measure").alias("m"), F.col("length").alias("l"))
    there = by_measure(features, "source", "form", "ending").join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")) & (F.col("length") == F.col("l")))
    there = there.groupBy("s", "m", "l", F.col("form").alias("f")).agg(F.count("*").alias("n"), F.sum((F.col("ending") != ENDED).cast("int")).alias("u"))
    there = materialize(there.select("s", "m", "l", "f", ((F.col("u") >= MOSTLY_CUT * F.col("n")) & (F.col("u") >= LEAST_TEXTS)).alias("mostly")), "truncation-limits")
    marked = features
    for m in MEASURES:
        at = there.where(F.col("m") == m).select("s", "l", "f", F.col("mostly").alias(f"all_{m}"))
        marked = marked.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col(m) == F.col("l")) & (F.col("form") == F.col("f")), "left").drop("s", "l", "f")
    at_spike = F.coalesce(*[f"all_{m}" for m in MEASURES]).isNotNull()
    cut_there = F.greatest(*[F.coalesce(f"all_{m}", F.lit(False)) for m in MEASURES])
    # The planner chooses the join by what is written: a stock reply is one row, however often it is given.
    stock = materialize(stock_replies(features), "truncation-stock-replies").withColumn("stock", F.lit(True))
    out = marked.join(stock, "answer_hash", "left")
    other = ~F.coalesce("stock", F.lit(False))
    by_length = at_spike & ((F.col("ending") != ENDED) | cut_there)
    by_ending = F.col("ending").isin(OPEN, MARKED) | (F.col("ending") == BARE) & other
    return out.where(by_length | by_ending).select("seq", "source", "form", "ending", F.when(by_length, "length").otherwise("ending").alias("evidence"))


def evidence(df: DataFrame) -> DataFrame:
    """evidence, ending, n: what the truncated responses rest on, a significant length or their ending alone."""
    return find_truncated(df).groupBy("evidence", "ending").agg(F.count("*").alias("n"))


def truncation_rates(df: DataFrame) -> DataFrame:
    """source, n_rows (all of its rows), n_truncated, share."""
    cut = find_truncated(df).groupBy("source").agg(F.count("*").alias("n_truncated")).withColumnRenamed("source", "s")
    rows = df.groupBy("source").agg(F.count("*").alias("n_rows"))
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.select("source", "n_rows", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_rows"))
