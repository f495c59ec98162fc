"""Problem 7: evaluation items whose wording appears in training documents.

Method: winnowing. Every K words make a hash; of each WINDOW neighbouring hashes the least is kept, on both sides, so
that every run of K + WINDOW - 1 equal words shares a fingerprint. Documents' fingerprints are joined with the items', map side
while the items' index has a size that may be sent, by a shuffle of fingerprints beyond it, and each hit is extended word by
word over changed, added and missing words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialize

K, WINDOW = 4, 2
#: Words of a stretch that gives an item away, and how many words there may be to each change: "about one in eight" is read as no more than one in six.
LEAST_WORDS, WORDS_PER_CHANGE = 20, 6
#: A standing instruction is an end of so many words at least, of no more than half the item, that items carry behind so many
#: different wordings, of which there are at least this share of the suite's different texts.
SHARED_RUN, SHARED_ITEMS, SHARED_SHARE = 10, 6, 0.01
#: Words before such an end, and of an item's opening, by which wordings differ.
CONTEXT, OPENING = 3, 6
#: Words of items whose index may be sent to every worker.
INDEX_WORDS = 2_000_000

#: Signs of scripts that are written without blanks are words by themselves.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[^\W_\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")
_MARKUP = re.compile(r"<[a-zA-Z/][^<>\n]{0,60}>|<[a-zA-Z][\w:\-]*(?:\s+[\w:@.\-]+\s*=\s*(?:\"[^\"\n]*\"|'[^'\n]*'))+\s*/?>|&(?:[a-z]{2,6}|#\d{1,5});|\\[nrt]|[​­‌‍﻿]")
_SPLIT_WORD = re.compile(r"(?<=[a-zà-ÿ])-[ \t]*\r?\n[ \t]*(?:(?://|[#>*])[ \t]*)?(?=[a-zà-ÿ])")
_PRIME = np.uint64(1099511628211)


class Words(dict):
    """Word -> 64-bit hash, kept while a worker lives and emptied before it grows without bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


_words = Words()


def words(text: str | None) -> list[str]:
    """Lower-case words without punctuation, markup and line layout."""
    if not text:
        return []
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _SPLIT_WORD.sub("", text)
    if "<" in text or "&" in text or "\\" in text or not text.isascii():
        text = _MARKUP.sub(lambda m: "" if ord(m.group()[0]) > 127 else " ", text)
    return _WORD.findall(text.lower())


def hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words(text)), dtype=np.uint64)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of every k neighbouring words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ h[j : j + n]) * _PRIME
            out ^= out >> np.uint64(29)
    return out


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window, the last of equals."""
    n = len(g)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(g[::-1]))])
    m = n - window + 1
    best = np.arange(m, dtype=np.int64)
    for j in range(1, window):
        other = np.arange(j, j + m)
        best = np.where(g[other] <= g[best], other, best)
    return np.unique(best)


class Index:
    """Fingerprints of a block of items, their words, and which words are their own."""

    def __init__(self, items: list[tuple[int, np.ndarray]], shared: np.ndarray) -> None:
        self.items = []
        prints, where = [], []
        for item_id, h in items:
            own = np.ones(len(h), bool)
            for j in np.flatnonzero(np.isin(grams(h, SHARED_RUN), shared)):
                own[j : j + SHARED_RUN] = False
            g = grams(h, K)
            at = winnow(g)
            at = at[[bool(own[p : p + K].all()) for p in at]] if len(at) else at
            prints.append(g[at])
            where += [(len(self.items), int(p)) for p in at]
            self.items.append((item_id, h.tolist(), own.tolist()))
        g = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.prints, self.where = g[order], [where[i] for i in order]

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(place in docs, item id, first word in the document, words, changes) of each document and item with a stretch long enough."""
        sizes = [len(h) for h in docs]
        total = sum(sizes)
        if total < K or not len(self.prints):
            return []
        all_words = np.concatenate(docs)
        g = grams(all_words, K)
        owner = np.repeat(np.arange(len(docs)), sizes)
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        # A gram that runs into the next text is no gram: it gets the greatest hash, and a window that has only such keeps nothing.
        g = np.where(owner[: len(g)] == owner[K - 1 :], g, np.uint64(0xFFFFFFFFFFFFFFFF))
        at = winnow(g)
        at = at[g[at] != np.uint64(0xFFFFFFFFFFFFFFFF)]
        lo = np.searchsorted(self.prints, g[at], "left")
        hit = (lo < len(self.prints)) & (self.prints[np.minimum(lo, len(self.prints) - 1)] == g[at])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for p, k in zip(at[hit].tolist(), lo[hit].tolist()):
            doc = int(owner[p])
            while k < len(self.prints) and self.prints[k] == g[p]:
                item, q = self.where[k]
                k += 1
                d = p - int(start[doc])
                done = seen.setdefault((doc, item), set())
                if (d, q) in done:
                    continue
                _, words_i, own = self.items[item]
                a, n, changes, run = stretch(docs[doc], d, words_i, own, q)
                done.update(run)  # a hit in the same run of equal words gives the same stretch
                item_id = self.items[item][0]
                if n >= LEAST_WORDS and ((doc, item_id) not in best or n > best[doc, item_id][1]):
                    best[doc, item_id] = a, n, changes
        return [(doc, item_id, *x) for (doc, item_id), x in best.items()]


def _grow(doc: np.ndarray, d: int, item: list[int], own: list[bool], q: int, step: int, before: int) -> list[tuple[int, int, int, int]]:
    """Runs of equal words met from (d, q) in one direction: (its words, changes before the run, words of the document with
    those of the gap before it, words of the item in that gap).
    before: equal words already met in the other direction."""
    n, m = len(doc), len(item)

    def same(i: int, j: int) -> bool:
        return 0 <= i < n and 0 <= j < m and own[j] and int(doc[i]) == item[j]

    def further() -> tuple[int, int] | None:
        """The nearest three words that agree again, as far as the changes that the item's words may bear reach."""
        most = (before + sum(r[0] for r in runs) + (m - q if step > 0 else q + 1)) // WORDS_PER_CHANGE
        places: dict[int, list[int]] = {}
        for b in range(most + 1):
            if not 0 <= q + b * step < m or not own[q + b * step]:
                break
            places.setdefault(item[q + b * step], []).append(b)
        met = [(max(a, b), abs(a - b), a, b) for a in range(most + 1) if 0 <= d + a * step < n for b in places.get(int(doc[d + a * step]), ()) if all(same(d + (a + k) * step, q + (b + k) * step) for k in (1, 2))]
        return min(met)[2:] if met else None

    runs, changes, gap_i, gap_d, length = [], 0, 0, 0, 0
    while True:
        if same(d, q):
            length, d, q = length + 1, d + step, q + step
            continue
        if length:
            runs.append((length, changes, length + gap_d, gap_i))
        # The next words that agree again: changed, added or missing words, at most three at first, two of which must then be equal.
        for cost in (1, 2, 3):
            moves = [(cost, cost)] + [(a, b) for a in range(cost + 1) for b in range(cost + 1) if max(a, b) == cost and a != b]
            found = next(((a, b) for a, b in moves if same(d + a * step, q + b * step) and (same(d + (a + 1) * step, q + (b + 1) * step) or cost == 1 and not 0 <= q + (b + 1) * step < m)), None)
            if found and all(own[j] for j in range(min(q, q + step * found[1]), max(q, q + step * found[1]) + 1) if 0 <= j < m):
                break
            found = None
        if not found:
            found = further()
            if not found:
                return runs
            cost = max(found)
        changes, gap_d, gap_i, length = cost, found[0], found[1], 0
        d, q = d + found[0] * step, q + found[1] * step


def stretch(doc: np.ndarray, d: int, item: list[int], own: list[bool], q: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """The longest stretch through the seed (d, q): (its first word of the document, words of the item, changes, all places of
    the run of equal words that the seed lies in)."""
    run = 0
    while run < min(d, q) and own[q - run - 1] and int(doc[d - run - 1]) == item[q - run - 1]:
        run += 1
    right = _grow(doc, d, item, own, q, 1, run)
    left = _grow(doc, d - 1, item, own, q - 1, -1, sum(r[0] for r in right))
    # The seed's run goes on to the left without a change.
    head = 0
    if left and left[0][1] == 0:
        head, left = left[0][0], left[1:]
    own_run = head + (right[0][0] if right else 0)
    same = [(d - head + k, q - head + k) for k in range(own_run)]
    # All runs in order, as (words, changes before it, words of the item in the gap before it, first word in the document); any
    # part of the chain may be the stretch, which begins and ends with a run.
    chain: list[tuple[int, int, int, int]] = []
    at = d - head
    for n, _, with_gap, _ in left:
        at -= with_gap
        chain.append((n, 0, 0, at))
    chain.reverse()
    gaps = [(x[1], x[3]) for x in left][::-1]  # of a run to the left, what lies behind it
    chain = [(x[0], *(gaps[k - 1] if k else (0, 0)), x[3]) for k, x in enumerate(chain)]
    chain.append((own_run, *(gaps[-1] if gaps else (0, 0)), d - head))
    at = d - head + own_run
    for n, changes, with_gap, gap in right[1:]:
        at += with_gap
        chain.append((n, changes, gap, at - n))
    most = (0, 0, d)
    for i in range(len(chain)):
        n, c = chain[i][0], 0
        for j in range(i, len(chain)):
            if j > i:
                n, c = n + chain[j][2] + chain[j][0], c + chain[j][1]
            if c * WORDS_PER_CHANGE <= n and n > most[0]:
                most = (n, c, chain[i][3])
    return max(0, most[2]), most[0], most[1], same


LEAKS = "item_id bigint, doc_id bigint, first_word int, n_words int, n_changes int"


def _ends(h: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, hash of all words from it on) of the ends of an item that may be a standing instruction."""
    end = 0
    for p in range(len(h) - 1, (len(h) - 1) // 2, -1):
        end = ((end ^ int(h[p])) * 0x100000001B3 + p - len(h)) % (1 << 64)
        if len(h) - p >= SHARED_RUN:
            yield p, end


def shared_runs(items: DataFrame) -> np.ndarray:
    """Hashes of the runs of words within standing instructions.

    Copies and versions of an item share its words before an end, or its opening, and so count once; the number of
    instructions is bounded by the items, which are the query set."""
    suite = F.coalesce(F.col("suite").cast("string"), F.lit("")) if "suite" in items.columns else F.lit("")
    signed = lambda x: int(x) - (1 << 64) if int(x) >= 1 << 63 else int(x)

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for suite, text in zip(c["suite"], c["text"]):
            h = hashes(text)
            opening = hash(tuple(h[:OPENING].tolist()))
            for p, end in _ends(h):
                yield suite, signed(end), hash(tuple(h[p - CONTEXT : p].tolist())), opening

    texts = items.select(suite.alias("suite"), "text").distinct()
    totals = texts.groupBy("suite").agg(F.count("*").alias("n"))
    ends = arrow_map(texts, per_batch, "suite string, end bigint, context bigint, opening bigint")
    ends = ends.groupBy("suite", "end").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("opening").alias("openings"))
    enough = F.least("contexts", "openings")
    many = ends.join(totals, "suite").groupBy("end").agg(F.sum(enough).alias("k"), F.max(enough / F.col("n")).alias("share"))
    many = many.where((F.col("k") >= SHARED_ITEMS) & (F.col("share") >= SHARED_SHARE)).select("end")
    found = frozenset(r["end"] for r in many.toLocalIterator())

    def runs(c: dict[str, list]) -> Iterator[tuple]:
        for text in c["text"]:
            h = hashes(text)
            for p, end in _ends(h):
                if signed(end) in found:
                    for x in grams(h[p:], SHARED_RUN).view(np.int64).tolist():
                        yield (x,)

    if not found:
        return np.zeros(0, np.uint64)
    inside = arrow_map(texts.select("text"), runs, "run bigint").distinct()
    return np.array([r["run"] for r in inside.toLocalIterator()], dtype=np.int64).view(np.uint64)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and each item it gives away, in LEAKS' columns, with the longest stretch.

    The items are the stated query set; their standing instructions don't count, by suite where items have that column. Null,
    empty and short texts give no rows on either side; copies of a document or an item count by their own ids; an empty table
    gives no rows; other columns are not looked at. Documents are read once and not shuffled while the items have no more than
    INDEX_WORDS words; with more of them fingerprints are shuffled, and the texts of documents that share one with an item."""
    suite = ["suite"] if "suite" in items.columns else []
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text", *suite).where("item_id is not null and text is not null")
    size = items.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shared = shared_runs(items)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull())
    if size > 4 * INDEX_WORDS:
        return _by_shuffle(rows, items, shared)
    index = Index([(r["item_id"], hashes(r["text"])) for r in items.toLocalIterator()], shared)  # INDEX_WORDS words at most
    sent = documents.sparkSession.sparkContext.broadcast(index)

    def setup():
        index = sent.value

        def per_batch(c: dict[str, list]) -> Iterator[tuple]:
            for doc, item, first, n, changes in index.search([hashes(t) for t in c["text"]]):
                yield item, c["doc_id"][doc], first, n, changes

        return per_batch

    return arrow_map(rows, None, LEAKS, setup)


def _prints(text: str) -> list[int]:
    g = grams(hashes(text), K)
    return np.unique(g[winnow(g)]).view(np.int64).tolist()


def _by_shuffle(rows: DataFrame, items: DataFrame, shared: np.ndarray) -> DataFrame:
    """The same for items of any number: distinct pairs of a text and an item that share a fingerprint meet by it, and each pair is
    extended. Equal texts are looked at once. Hot fingerprints are left to the planner, which splits them."""
    rows = rows.withColumn("k", F.md5("text"))
    items = items.select("item_id", "text").distinct()

    def of_documents(c: dict[str, list]) -> Iterator[tuple]:
        for k, text in zip(c["k"], c["text"]):
            for x in _prints(text):
                yield x, k

    def of_items(c: dict[str, list]) -> Iterator[tuple]:
        for i, text in zip(c["item_id"], c["text"]):
            for x in _prints(text):
                yield x, i

    mine = arrow_map(rows.select("k", "text"), of_documents, "print bigint, k string")
    theirs = arrow_map(items, of_items, "print bigint, item_id bigint").distinct()
    pairs = materialize(mine.join(theirs, "print").select("k", "item_id").distinct(), "leak-candidates")
    texts = rows.select("k", "text").join(pairs.select("k").distinct(), "k", "left_semi").dropDuplicates(["k"])
    both = pairs.join(texts, "k").join(items.withColumnRenamed("text", "item"), "item_id")

    def extend(c: dict[str, list]) -> Iterator[tuple]:
        known: dict[tuple[int, str], Index] = {}
        for k, text, i, item in zip(c["k"], c["text"], c["item_id"], c["item"]):
            if (i, item) not in known:
                known[i, item] = Index([(i, hashes(item))], shared)
            for _, _, first, n, changes in known[i, item].search([hashes(text)]):
                yield i, k, first, n, changes

    found = arrow_map(both.select("k", "text", "item_id", "item"), extend, "item_id bigint, k string, first_word int, n_words int, n_changes int")
    found = found.groupBy("item_id", "k").agg(F.max_by(F.struct("first_word", "n_words", "n_changes"), F.struct("n_words", "first_word")).alias("x")).select("item_id", "k", "x.*")
    return rows.select("doc_id", "k").join(found, "k").select("item_id", "doc_id", "first_word", "n_words", "n_changes")
