"""Problem 8: find passages that were decoded with a wrong encoding and put them right.

Method: for every pair (true encoding, wrong decoding) the garbled form of each character is computed beforehand; one
multi-pattern automaton over all of them finds the spans; a span counts only where its surroundings agree; only counted
spans are replaced. A document without a character beyond ASCII is ruled out in the JVM.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

# Letters of the collection's languages beyond ASCII, usual typographic signs, and encodings.
LATIN = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßąćęłńśźżáčďéěíňóřšťúůýžÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒĄĆĘŁŃŚŹŻÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
SIGNS = "“”‘’„‚«»‹›–—…•€™©®°µ·×÷±¿¡§¶ªº¹²³¼½¾→←≤≥†‡ ﻿"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
KANA = [chr(c) for c in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FD), 0x3001, 0x3002)]
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1254", "iso8859-15")
LATIN_READ_AS = (("latin-1", "mac_roman"), ("latin-1", "cp437"), ("latin-1", "cp850"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "latin-1"), ("cp852", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1250", "cp1251"))
CYRILLIC_READ_AS = (("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("iso8859-5", "cp1252"), ("cp1251", "mac_roman"), ("cp1251", "cp1250"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("iso8859-5", "cp1251"), ("cp1251", "cp866"), ("koi8-r", "cp866"), ("cp1251", "cp437"), ("cp1251", "cp850"))
KANA_READ_AS = (("cp932", "cp1252"), ("euc_jp", "cp1252"), ("euc_jp", "cp932"), ("cp932", "euc_jp"), ("utf-8", "cp932"), ("utf-8", "gbk"), ("utf-8", "euc_jp"), ("utf-8", "big5"), ("utf-8", "cp949"), ("cp932", "mac_roman"), ("cp932", "gbk"), ("euc_jp", "gbk"))
#: The letters beyond ASCII of each language; a passage is in one of them.
LETTERS = ("äöüßÄÖÜ", "éèàçêôîâûùëïœÉÈÀÇÊÔÎ", "ñáíóúéüÑÁÍÓÚÉ", "ãõáéíóúâêôçàÃÕÁÉÍÓÚÂÊÔÇ", "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "čďěňřšťůýžáíéóúČĎĚŇŘŠŤŮÝŽÁÍÉÓÚ")
#: Bytes that the usual single-byte Western code page leaves open.
OPEN_BYTES = "\x81\x8d\x8f\x90\x9d"
#: Russian letters, most frequent first.
RUSSIAN_ORDER = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"

LOST = "�"
_QUOTES = {"`": "`", '"': '"', "“": "”", "„": "“", "«": "»", "'": "'", "(": ")"}


def _wrong(data: bytes, wrong: str) -> str:
    """Decode as lenient readers do: bytes that the code page leaves open stay as control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _back(text: str, wrong: str) -> bytes:
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(wrong)
        except UnicodeEncodeError:
            if ord(ch) > 255:
                raise
            out.append(ord(ch))
    return bytes(out)


class Garbling:
    """The automaton and what each pattern stands for. Built once in each worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.sequences: dict[str, dict[str, str]] = defaultdict(dict)  # pattern -> family -> original
        self.kinds: dict[str, str] = {}
        legit = set(LATIN + SIGNS + CYRILLIC)
        wide = [chr(c) for c in range(0x4E00, 0x9FA1)] + KANA
        for wrong in UTF8_READ_AS:
            cjk = wide if wrong in ("cp1252", "latin-1") else KANA
            for ch in [*LATIN, *SIGNS, *CYRILLIC, *cjk]:
                once = _wrong(ch.encode(), wrong)
                self._add(once, f"utf-8>{wrong}", ch)
                if ch in LATIN + SIGNS and wrong in ("cp1252", "latin-1", "cp1250"):
                    for again in (wrong, "cp1252"):
                        twice = _wrong(once.encode(), again)
                        self._add(twice, f"utf-8>{again}", ch)
                        if ch in LATIN:
                            self._add(_wrong(twice.encode(), again), f"utf-8>{again}", ch)
        self.one: dict[str, dict[str, dict[str, str]]] = {}
        for true, wrong in LATIN_READ_AS:
            family = f"{true}>{wrong}"
            table = {}
            for ch in LATIN:
                try:
                    g = _wrong(ch.encode(true), wrong)
                except UnicodeEncodeError:
                    continue
                if g != ch and len(g) == 1:
                    table[g] = ch
            self.one[family] = table
            for g in table:
                if g not in LATIN or g.isupper():
                    self.kinds.setdefault(g, "letter")
        self.cyrillic: dict[str, dict[str, str]] = {}
        small = CYRILLIC[:33]
        for true, wrong in CYRILLIC_READ_AS:
            table = {_wrong(ch.encode(true, "ignore"), wrong): ch for ch in CYRILLIC if ch.encode(true, "ignore")}
            table = {g: ch for g, ch in table.items() if len(g) == 1}
            self.cyrillic[f"{true}>{wrong}"] = table
            to = {ch: g for g, ch in table.items()}
            for a in small + CYRILLIC[33:]:
                for b in small:
                    if a in to and b in to:
                        g = to[a] + to[b]
                        if all(x in CYRILLIC for x in g) and not (g[0].islower() and g[1].isupper()):
                            continue  # looks like plain Russian; the case that is turned round gives the word away
                        self.kinds.setdefault(g, "cyrillic")
        self.kana: dict[str, str] = {}
        for true, wrong in KANA_READ_AS:
            family = f"{true}>{wrong}"
            leads = [ch.encode(true)[:1] for ch in "のアに、日"] if wrong not in ("cp1252", "mac_roman") else [b""]
            leads += [bytes([x]) for x in range(0xE4, 0xEA)] if true == "utf-8" else []
            for ch in KANA:
                try:
                    data = ch.encode(true)
                except UnicodeEncodeError:
                    continue
                for lead in leads:
                    try:
                        g = (data + lead).decode(wrong) if lead else _wrong(data, wrong)
                    except UnicodeDecodeError:
                        g = data.decode(wrong, "replace").rstrip(LOST)
                    if len(g) >= 2 and LOST not in g and not g.isascii() and not all(x in KANA for x in g):
                        self.kana.setdefault(g, family)
                        self.kinds.setdefault(g, "kana")
        for c in range(0x80, 0xA0):
            self.kinds[chr(c)] = "control"
        self.kinds[LOST] = "lost"
        self.legit = legit
        self.automaton = ahocorasick.Automaton()
        for p in self.sequences:
            self.automaton.add_word(p, (p, "sequence"))
        for p, kind in self.kinds.items():
            if p not in self.sequences:
                self.automaton.add_word(p, (p, kind))
        self.automaton.make_automaton()

    def _add(self, garbled: str, family: str, original: str) -> None:
        if len(garbled) > 1 and garbled != original:
            self.sequences[garbled].setdefault(family, original)

    # ------------------------------------------------------------------ evidence

    def look(self, text: str) -> tuple[list[tuple[int, int, str, str | None]], bool]:
        """Accepted spans (start, end, family, replacement or None where the original is lost), sorted and disjoint."""
        hits = [(end - len(p) + 1, end + 1, p, kind) for end, (p, kind) in self.automaton.iter(text)]
        if not hits:
            return [], False
        hits.sort(key=lambda h: (h[0], -h[1]))  # leftmost, then longest
        spans: list[tuple[int, int, str, str | None]] = []
        spans += self._sequences(text, [h for h in hits if h[3] == "sequence"])
        taken = {i for a, b, _, _ in spans for i in range(a, b)}
        kana = [h for h in hits if h[3] == "kana" and h[0] not in taken]
        if kana:
            found = self._kana(text, kana)
            spans += found
            for a, b, _, _ in found:  # what else such a line holds is not looked at by letters
                a, b = text.rfind("\n", 0, a) + 1, text.find("\n", b)
                taken.update(range(a, b if b >= 0 else len(text)))
        cyr = [h for h in hits if h[3] == "cyrillic" and h[0] not in taken]
        if cyr:
            spans += self._cyrillic(text, cyr, taken)
            taken |= {i for a, b, _, _ in spans for i in range(a, b)}
        letters = [h for h in hits if (h[3] == "letter" or h[2] in OPEN_BYTES) and h[0] not in taken]
        if letters:
            spans += self._letters(text, letters, taken)
            taken |= {i for a, b, _, _ in spans for i in range(a, b)}
        for a, b, p, kind in hits:
            if a in taken or kind not in ("control", "lost"):
                continue
            if kind == "control":
                if not _quoted(text, a, b):
                    plain = _wrong(bytes([ord(p)]), "cp1252")
                    spans.append((a, b, "cp1252>latin-1", plain if ord(plain) > 0x9F else None))
            else:
                around = text[a - 1 : a] + text[b : b + 1]
                if any(c.isalnum() or c in LOST or "\x80" <= c < "\xa0" for c in around) and not _quoted(text, a, b):
                    spans.append((a, b, "lost", None))
        spans.sort()
        out: list[tuple[int, int, str, str | None]] = []
        for s in spans:
            if not out or s[0] >= out[-1][1]:
                out.append(s)
        return out, bool(out)

    def _sequences(self, text: str, hits: list) -> list:
        hits = [h for h in hits if not _quoted(text, h[0], h[1])]
        if not hits:
            return []
        votes: Counter = Counter()
        weight: Counter = Counter()  # a capital within a word of small letters speaks against a pair
        for a, _, p, _ in hits:
            inside = text[a - 1 : a].islower()
            for f, ch in self.sequences[p].items():
                votes[f] += 1
                weight[f] += 2 if not (inside and ch.isupper()) else 1
        starts, ends = {h[0] for h in hits}, {h[1] for h in hits}
        best = [f for f, _ in sorted(weight.items(), key=lambda x: (-x[1], UTF8_READ_AS.index(x[0].split(">")[1])))]
        out, end = [], -1
        for a, b, p, _ in hits:
            if a < end:
                continue
            end = b
            family = next(f for f in best if f in self.sequences[p])
            ch = self.sequences[p][family]
            alone = votes[family] < 2
            if alone and (_box(p, text, a, b) or family.split(">")[1] in ("cp1251", "koi8-r", "cp866", "cp850", "cp437", "cp852") and ch not in LATIN + "“”‘’–—…€µ"):
                continue
            if _box(p, text, a, b) and (alone or a not in ends and b not in starts):
                continue
            if all(x in CYRILLIC for x in p) and votes[family] < 4:
                continue
            out.append((a, b, family, ch))
        if len(out) == 1 and out[0][3] in LATIN and len(text[out[0][0] : out[0][1]]) == 2 and text[out[0][0]] in "ÂÃ" and text[out[0][1] - 1] in SIGNS and not text[out[0][1] - 1].isalnum() and text[max(0, out[0][0] - 1) : out[0][0]].isupper():
            return []  # a capital with an accent before a closing sign
        return out

    def _kana(self, text: str, hits: list) -> list:
        lines: dict[int, list] = defaultdict(list)
        for h in hits:
            lines[text.rfind("\n", 0, h[0]) + 1].append(h)
        out = []
        for start, run in lines.items():
            families = Counter(self.kana[h[2]] for h in run)
            if len({h[0] for h in run}) < 3 or _quoted(text, run[0][0], run[-1][1]):
                continue
            end = text.find("\n", start)
            for m in re.finditer(r"[^ ]+", text[start : end if end >= 0 else len(text)]):
                token, a, b = m.group(), start + m.start(), start + m.end()
                if token.isascii():
                    continue
                for family, _ in families.most_common():
                    true, wrong = family.split(">")
                    try:
                        plain = _back(token, wrong).decode(true) if wrong in ("cp1252", "mac_roman") else token.encode(wrong).decode(true)
                        out.append((a, b, family, plain))
                        break
                    except UnicodeError:
                        continue
                else:
                    if any(a <= h[0] < b for h in run):
                        out.append((a, b, families.most_common(1)[0][0], None))
        return out

    def _cyrillic(self, text: str, hits: list, taken: set[int]) -> list:
        out, end = [], -1
        for a, b, _, _ in hits:
            if a < end or a in taken:
                continue
            line_a, line_b = text.rfind("\n", 0, a) + 1, text.find("\n", b)
            line_b = len(text) if line_b < 0 else line_b
            best = None
            for family, table in self.cyrillic.items():
                if text[a] not in table or text[b - 1] not in table:
                    continue
                s, e = a, b
                while s > line_a and (text[s - 1] in table or text[s - 1] in " ,.-:;«»()" and s - 2 >= line_a and (text[s - 2] in table or text[s - 2] in ",.")):
                    s -= 1
                while e < line_b and (text[e] in table or text[e] in " ,.-:;" and e + 1 < line_b and (text[e + 1] in table or text[e + 1] == " ")):
                    e += 1
                s0 = text[s:e]
                s += len(s0) - len(s0.lstrip(" ,.-:;"))
                e = s + len(text[s:e].rstrip(" "))
                plain = "".join(table.get(c, c) for c in text[s:e])
                letters = sum(c in CYRILLIC for c in plain)
                gain = _russian(plain) - (_russian(text[s:e]) if any(c in CYRILLIC for c in text[s:e]) else -4.6)
                turned = len(re.findall(r"[а-яё][А-ЯЁ]", plain))
                if letters >= 4 and gain > 0.35 and turned * 8 <= letters and (best is None or (gain, letters) > best[0]):
                    best = (gain, letters), s, e, family, plain
            if best and not _quoted(text, best[1], best[2]):
                out.append(best[1:])
                end = best[2]
                table = self.cyrillic[best[3]]
                for m in re.finditer(r"\S+(?: \S+)*", text[line_a:line_b]):  # the same line's other words
                    for w in re.finditer(r"[^\s\x21-\x7e]+", m.group()):
                        s = line_a + m.start() + w.start()
                        plain = "".join(table.get(c, c) for c in w.group())
                        if all(c in table for c in w.group()) and plain != w.group() and (s < best[1] or s >= best[2]) and _russian(plain) > _russian(w.group()):
                            out.append((s, s + len(plain), best[3], plain))
        return out

    def _letters(self, text: str, hits: list, taken: set[int]) -> list:
        """One wrong character for one letter: counts only inside words, by the family that makes most words of the line whole,
        of equals the one that does most in the text. Hits that it can't put right become spans without an original."""
        lines: dict[int, list[int]] = defaultdict(list)
        for a, b, p, _ in hits:
            before, after = text[a - 1 : a], text[b : b + 1]
            inside = _latin(before) and _latin(after)
            if p.isalpha() and p in LATIN:
                strong = before.isalpha() and before.islower() and after.islower() and _latin(before) and p.isupper() and not text[max(0, a - 2) : a - 1].isupper()
                if strong and re.search(r"[A-Z_]", _word(text, a)[2].replace(p, "")):
                    strong = False
            elif p.isalpha() or p in "ªº":
                strong = inside or (_latin(before) or _latin(after)) and p not in "ªºµ" + CYRILLIC and not p.isascii()
            else:
                strong = inside and p not in "’'‘·-–—…“”×÷→←±/" or inside and p in "·×÷±„" and before.islower() and after.islower()
            if p in OPEN_BYTES:
                strong = _latin(before) or _latin(after)
            if strong and not _quoted(text, a, b):
                lines[text.rfind("\n", 0, a) + 1].append(a)
        out = []
        for start, at in lines.items():
            end = text.find("\n", start)
            words = [(m.start(), m.group()) for m in _WORDS.finditer(text, start, end if end >= 0 else len(text)) if not m.group().isascii() and not taken.intersection(range(*m.span()))]
            family, table = max(self.one.items(), key=lambda x: _gain(x[1], [w for _, w in words]))
            if _gain(table, [w for _, w in words])[0] <= 0:
                continue
            # Where each sign beyond ASCII may come from this pair and two words at least do, the line is garbled throughout.
            throughout = all(c.isascii() or c in table for _, w in words for c in w) and sum(_whole(_through(table, w)) for _, w in words) >= 2
            done = set()
            for a, w in words:
                plain = _through(table, w)
                if not throughout and (not any(c in table for c in w) or all(c in LATIN and not c.isupper() or c not in table for c in w) and not _odd(w)):
                    pass_on = any(c in table and table[c] in LATIN for c in w) and family in ("cp1250>cp1252", "iso8859-2>latin-1", "cp852>cp1252")
                    if not pass_on:
                        continue
                if plain != w and _whole(plain):
                    out.append((a, a + len(w), family, plain))
                    done.update(range(a, a + len(w)))
            for a, b, w in sorted({_word(text, i) for i in at if i not in done and i not in taken}):
                if not taken.intersection(range(a, b)) and not done.intersection(range(a, b)) and not re.search(rf"[\x80-\x9f{LOST}]", w):
                    out.append((a, b, "unknown", None))
        return out


_WORDS = re.compile(r"[^ \t\r\n\f\v()\[\]{}`\"/.,;:!?]+")


def _through(table: dict[str, str], word: str) -> str:
    return "".join(table.get(c, c) for c in word)


def _gain(table: dict[str, str], words: list[str]) -> tuple[int, float]:
    """(words that a pair makes whole less those that it leaves with foreign signs, how well its letters fit one language)."""
    plains = [(w, _through(table, w)) for w in words]
    whole = sum(p != w and _whole(p) for w, p in plains)
    foreign = sum(not _whole(p) and _odd(p) for w, p in plains)
    letters = [c for w, p in plains if p != w for c in p if not c.isascii()]
    fit = max(sum(c in language for c in letters) for language in LETTERS) / len(letters) if letters else 0.0
    return whole - foreign if whole else 0, fit


def _latin(c: str) -> bool:
    return bool(c) and (c.isascii() and c.isalpha() or c in LATIN)


def _odd(word: str) -> bool:
    return any(not c.isascii() and c not in LATIN and c not in SIGNS for c in word) or bool(re.search(r"[a-zß-ÿ][À-Þ][a-zß-ÿ]", word)) or any(c in SIGNS and 0 < i < len(word) - 1 for i, c in enumerate(word))


def _word(text: str, i: int) -> tuple[int, int, str]:
    a = b = i
    while a > 0 and not text[a - 1].isspace() and text[a - 1] not in "()[]{}`\"/.,;:!?":
        a -= 1
    while b < len(text) and not text[b].isspace() and text[b] not in "()[]{}`\"/.,;:!?":
        b += 1
    return a, b, text[a:b]


def _whole(word: str) -> bool:
    """Letters only, and capitals only in front or throughout."""
    core = word.strip("'’-*_#>\"«»“”¿¡")
    return bool(core) and all(_latin(c) or c in "-'’" for c in core) and (core.isupper() or not any(c.isupper() for p in re.split("[-'’]", core) for c in p[1:]))


@lru_cache(maxsize=1)
def _russian_rank() -> dict[str, float]:
    from math import log

    weights = [1 / (k + 3) for k in range(len(RUSSIAN_ORDER))]
    return {c: log(w / sum(weights)) for c, w in zip(RUSSIAN_ORDER, weights)}


def _russian(text: str) -> float:
    """Mean log likelihood of the letters under Russian frequencies, less what a turned case costs."""
    rank = _russian_rank()
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return -9.0
    turned = len(re.findall(r"[а-яё][А-ЯЁ]|(?<![А-ЯЁа-яё])[А-ЯЁ]{2}", text))
    return sum(rank.get(c.lower(), -7.0) for c in letters) / len(letters) - 2.0 * turned / len(letters)


def _box(p: str, text: str, a: int, b: int) -> bool:
    """Part of a line drawing rather than of a word."""
    if text[a - 1 : a].isalpha() or text[b : b + 1].isalpha():
        return False
    around = text[max(0, a - 1) : b + 1]
    drawn = sum("─" <= c <= "▟" for c in around)
    return drawn >= 2 and all("─" <= c <= "▟" or c.isspace() for c in p)


def _quoted(text: str, a: int, b: int) -> bool:
    """A short sequence put between quotes as the thing talked about, not a passage of the text itself."""
    s, e = a, b
    while s > 0 and not text[s - 1].isspace() and text[s - 1] not in _QUOTES and a - s < 24:
        s -= 1
    while e < len(text) and not text[e].isspace() and text[e] not in "`\"”“»')" and e - b < 24:
        e += 1
    left, right = text[s - 1 : s], text[e : e + 1]
    return bool(left) and left in _QUOTES and left not in "„“«" and right == _QUOTES[left] and e - s <= 24


@lru_cache(maxsize=1)
def garbling() -> Garbling:
    return Garbling()


FOUND = "doc_id bigint, n_spans int, families array<string>, recovered boolean, text string"


def repair(text: str) -> tuple[list[tuple[int, int, str, str | None]], str]:
    """The garbled spans of a text, and the text with those put right whose original is known."""
    spans, _ = garbling().look(text)
    out, at = [], 0
    for a, b, _, plain in spans:
        out += [text[at:a], text[a:b] if plain is None else plain]
        at = b
    return spans, "".join(out) + text[at:]


def find_garbled(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document with a garbled passage, in FOUND's columns; recovered: every span was put right, and nothing
    garbled is found in the text that came of it.

    Null, empty and ASCII texts give no rows and never leave the JVM; repeated rows count by their own ids; an empty table
    gives no rows; other columns are not looked at. No shuffle."""
    rows = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7F]"))

    def setup():
        g = garbling()

        def per_batch(c: dict[str, list]) -> Iterator[tuple]:
            for i, text in zip(c["doc_id"], c["text"]):
                spans, plain = repair(text)
                if spans:
                    recovered = all(p is not None for _, _, _, p in spans) and not g.look(plain)[0]
                    yield i, len(spans), sorted({f for _, _, f, _ in spans}), recovered, plain

        return per_batch

    return arrow_map(rows, None, FOUND, setup)
