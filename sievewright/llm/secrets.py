"""Problem 4: credentials embedded in files.

Method: files are cut into chunks of whole lines; each segment of chunks gets an inverted index from trigrams to chunks.
From each detection regex the trigrams that every match must hold are derived (an AND of ORs of literals); the postings
are intersected, and the regex runs on the chunks that remain. A match may go on over the lines that follow, so each chunk
carries as many more as a match can reach, and a match belongs to the chunk where it begins. Lines bound values, nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

CHUNK = 256
#: Lines with something in them that a match can reach behind the one where it begins.
REACH = 4
_FOLLOWING = re.compile(rf"(?:\s*+[^\n]*+(?:\n|\Z)){{0,{REACH}}}")
#: Characters of files that one segment of the index covers.
SEGMENT = 4 << 20

# Names that stand before a credential.
_NAMES = (
    r"passw(?:or[dt]|d|ort)|passphrase|passwort|pass_?phrase|pwd|_pass|_pw|secret|token|credential|contrase(?:na|ña)|mot_?de_?passe|senha|heslo|haslo|bearer|authorization"
    r"|(?:api|access|account|auth|encryption|signing|private|master|salt|storage|shared|service|license|client|crypt)[_\-]?key"
)
_STRING = r"""[fFbBrRuU@$]{0,2}(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])+)(?P=q)"""
_MORE = r"""(?:\s{0,40}\+\s{0,40}(?P<q2>["'])(?P<v2>(?:\\.|(?!(?P=q2))[^\\\n])+)(?P=q2))?"""
#: name -> (regex with the group v, may the value be as plain as a password with spaces ruled out).
DETECTORS: dict[str, str] = {
    "assigned": rf"""(?i)(?:{_NAMES})(?!_?(?:hash|sha\d+|md5|checksum|fingerprint|hint|path|file|ur[il])\d*\b)[\w.\-]*+["']?\]?\)?\s{{0,40}}(?:(?:=>|:=|\|\||\?\?|\bor\b|[:=])\s{{0,40}}|,\s{{0,3}}){_STRING}{_MORE}""",
    "attribute": rf"""(?i)(?:{_NAMES})[\w.\-]*+["']\s+value\s{{0,2}}=\s{{0,2}}(?P<q>["'])(?P<v>[^"'\n]+)(?P=q)""",
    "element": rf"""(?i)<[\w.\-:]*(?:{_NAMES})[\w.\-:]*+>(?P<v>[^<>\n]{{6,}})</""",
    "setting": rf"""(?im)^[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+|ENV[ \t]+)?[\w.\-]*(?:{_NAMES})[\w.\-]*+[ \t]*[=:][ \t]*(?P<v>[^\s"'#;{{\[(][^\s"',;]{{5,}})[ \t]*\r?(?:$|#)""",
    "address": r"""(?i)\b[a-z][a-z0-9+.\-]{1,20}://[^\s:/@"'<>]*:(?P<v>[^\s@"'/<>]+)@""",
    "header": r"""(?i)["'`:=][ \t]?(?:bearer|basic|token|api-?key)[ \t]+(?P<v>[A-Za-z0-9][A-Za-z0-9._~+/!#*@$%^&\-]{7,}={0,2})""",
    "api header": r"""(?i)\bx-[a-z\-]*(?:key|token|secret|auth)["']?\s{0,2}[:,=]\s{0,2}["']?(?P<v>[^\s"'`,;]{6,})""",
    "login option": r"""(?i)(?: -u|\t-u|--user|--login)[ =]+["']?[\w.@\-]+:["']?(?P<v>[^\s"'`]{4,})""",
    "password option": r"""(?i)--(?:password|passwd|token|secret|api-key)[ =]+["']?(?P<v>[^\s"'`\-][^\s"'`]{5,})""",
    "connection": r"""(?i);[ \t]*(?:pwd|password|accountkey|sharedaccesskey|secret|token)[ \t]*=[ \t]*(?P<v>[^;"'\s]{4,})""",
    "statement": r"""(?i)\b(?:identified[ \t]+by|with[ \t]+password|[ \t]password)[ \t]+(?P<q>['"])(?P<v>[^'"\n]{4,})(?P=q)""",
    "remark": rf"""(?i)(?:{_NAMES}|login|\bkey(?= is)|\bpin |rotate|\bpw[ :])[^\n"'=]{{0,48}}?(?:\bis|\bwas|->|[:/=])[ \t]+["'`]?(?P<v>[^\s"'`]{{8,}}?)(?=["'`]?[.,;]?(?:\s|$))""",
    "call": r"""\([ \t]*["'][\w\-]+(?:\.[\w\-]+)+(?:","|", "|','|', ')[\w.@\-]+["'][ \t]*,[ \t]*(?P<q>["'])(?P<v>[^"'\n]{6,})(?P=q)""",
    "aws": r"""(?<![A-Za-z0-9])(?P<v>A(?:KIA|SIA)[0-9A-Z]{12,})(?![A-Za-z0-9])""",
    "ghp": r"""(?<![A-Za-z0-9])(?P<v>(?:ghp|gho|ghs)_[A-Za-z0-9]{12,})(?![A-Za-z0-9])""",
    "glpat": r"""(?<![A-Za-z0-9])(?P<v>glpat-[A-Za-z0-9_\-]{12,})(?![A-Za-z0-9])""",
    "live": r"""(?<![A-Za-z0-9])(?P<v>(?:sk|rk|pk)_live_[A-Za-z0-9]{12,})(?![A-Za-z0-9])""",
    "xox": r"""(?<![A-Za-z0-9])(?P<v>xox[abprs]-[A-Za-z0-9\-]{10,})(?![A-Za-z0-9])""",
    "pat": r"""(?<![A-Za-z0-9\-])(?P<v>pat-[A-Z0-9]{12,})(?![A-Za-z0-9])""",
    "tok": r"""(?<![A-Za-z0-9])(?P<v>tok_[A-Z0-9]{12,})(?![A-Za-z0-9])""",
    "jwt": r"""(?<![A-Za-z0-9])(?P<v>eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,})""",
    "pem": r"""(?P<v>-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----)""",
}
#: Detectors whose matches may go on over lines.
OVER_LINES = ("assigned", "attribute", "api header")
#: Detectors whose format alone shows a credential.
BY_FORMAT = ("aws", "ghp", "glpat", "live", "xox", "pat", "tok", "jwt")

_PLACEHOLDER = re.compile(r"(?i)^(?:\$|\{\{|#\{|%\(|%[A-Z_]+%|<.*>$|env:|vault:|ref:|secret:|ssm:|file:|arn:|@|op://|\*+$|x+$|\.+$|-+$|_+$|null$|none$|true$|false$|nil$|undefined$|todo|tbd|fixme|redacted|masked)|\$\{|\{\{|<[^<>]*>|(?:your|my|insert|enter|put|replace|change)[-_ ]?(?:me|this|here|it|the|own|your|api|token|key|password|secret)|changeme|placeholder|example[-_]?(?:key|token|pass)|dummy|(?:xxx|\*\*\*|\.\.\.)")
_REFERENCE = re.compile(r"(?i)^(?:[\w.]+\(|/|\./|~/|\w:\\|(?:process|os|system|env|config|settings|self|this)\.|https?://[^@]*$|[\w\-]+(?:/[\w\-]+)+(?:#\w+)?$|[\w.\-]+\.(?:py|java|cs|js|json|ya?ml|md|txt|pem|toml|xml|env|properties|sh|key|crt)$)")
_PLAIN_WORDS = re.compile(r"^[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*(?:[-_. /][A-Za-z][a-z]+)*$|^[a-z]+(?:[-_][a-z]+)*-?\d{0,4}$|^[A-Z]+(?:_[A-Z0-9]+)*$|^[+-]?\d{1,9}(?:\.\d+)?$")
_SHORT_ID = re.compile(r"^[A-Za-z_]\w*(?:\.\w+|\(\)|\[\w*\])*$")


def usable(value: str, detector: str) -> bool:
    """A literal that could be used as it stands, not a placeholder, a reference or a plain message."""
    v = value.strip()
    if detector == "pem":
        return True
    if len(v) < 6 or re.search(r"\s", v) or _PLACEHOLDER.search(v):
        return False
    if detector in BY_FORMAT:
        return len(set(v)) > 8
    if re.match(r"(?i)[a-z][a-z0-9+.\-]*://", v):
        m = re.search(DETECTORS["address"], v)
        return bool(m) and usable(m["v"], "address")
    if _REFERENCE.search(v) or re.search(r"\{.*\}|\\[wsdbWSD(.]|^\^", v):
        return False
    if detector in ("address", "login option", "connection", "statement"):
        return not re.fullmatch(r"[a-z]+|[A-Z]+|(?i:pass(?:word)?|user|secret|pwd|token)", v)
    if _PLAIN_WORDS.match(v) or len(v) < 8 or re.match(r"sha(?:1|256|384|512)[-:]|data:|urn:", v):
        return False
    kinds = bool(re.search(r"\d", v)) + bool(re.search(r"[a-z]", v)) + bool(re.search(r"[A-Z]", v)) + bool(re.search(r"[^\w]", v))
    if detector in ("remark", "setting") and re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*\d{0,3}[,;]?", v):
        return False  # a name
    if detector in ("remark", "setting", "header", "api header"):
        if re.search(r"[(){}\[\]<>\\|]", v) and not re.search(r"\d", v):
            return False
        if detector == "remark" and (not re.search(r"\d", v) and kinds < 3 or kinds < 2 or "/" in v and re.search(r"\.\w{1,5}$", v)):
            return False
        if re.search(r"\w\(|\)\.|;$|::|->|=>|^[(\[{]", v):
            return False
    return kinds >= 2 and len(set(v)) > 4


# ---------------------------------------------------------------- required literals


def _literals(tree) -> list[set[str]]:
    """Clauses that each match must satisfy: of each set at least one string stands in the text (lower case)."""
    clauses: list[set[str]] = []
    runs = {""}

    def close() -> None:
        nonlocal runs
        if all(len(r) >= 3 for r in runs):
            clauses.append({r.lower() for r in runs})
        runs = {""}

    for op, arg in tree:
        few = None  # the strings that this node may be, if they are few
        if op is sre.LITERAL:
            few = {chr(arg)}
        elif op is sre.IN and len(arg) <= 6 and all(o is sre.LITERAL for o, _ in arg):
            few = {chr(a) for _, a in arg}
        elif op is sre.SUBPATTERN and all(o is sre.LITERAL for o, _ in arg[-1]):
            few = {"".join(chr(a) for _, a in arg[-1])}
        elif op is sre.BRANCH and all(o is sre.LITERAL for branch in arg[1] for o, _ in branch):
            few = {"".join(chr(a) for _, a in branch) for branch in arg[1]}
        if few and len(few) * len(runs) <= 64:
            runs = {r + x for r in runs for x in few}
            continue
        before = runs
        close()
        if op is sre.SUBPATTERN:
            clauses += _literals(arg[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            clauses += _literals(arg[2])
        elif op is sre.BRANCH:
            options: set[str] = set()
            for branch in arg[1]:
                lead = ""
                for o, x in branch:
                    if o is not sre.LITERAL:
                        break
                    lead += chr(x)
                found = _literals(branch)
                joined = {(r + lead).lower() for r in before}
                if lead and all(len(j) >= 3 for j in joined):
                    found.append(joined)
                if not found:
                    options = set()
                    break
                options |= max(found, key=lambda c: (min(map(len, c)), -len(c)))
            if options:
                clauses.append(options)
    close()
    return clauses


def required(pattern: str) -> list[set[str]]:
    """The pattern's clauses; of a string beyond ASCII only its longest ASCII part is asked for."""
    ascii_part = lambda x: max(re.findall(r"[\x00-\x7f]+", x) or [""], key=len)
    clauses = [{ascii_part(x) for x in c} for c in _literals(sre_parse.parse(pattern))]
    return [c for c in clauses if all(len(x) >= 3 for x in c)]


class Plan:
    """For each detector the clauses over trigrams, and the trigrams of all of them."""

    def __init__(self, detectors: dict[str, str]) -> None:
        self.regexes = {n: re.compile(p, re.A) for n, p in detectors.items()}
        # Of a match over lines only the first clause is sure to stand on the line where it begins, and so in the chunk that owns it.
        self.clauses = {n: required(p)[: 1 if n in OVER_LINES else None] for n, p in detectors.items()}
        self.trigrams = sorted({s[i : i + 3] for cs in self.clauses.values() for c in cs for s in c for i in range(len(s) - 2)})
        self.number = {t: k + 1 for k, t in enumerate(self.trigrams)}
        self.lookup = np.zeros(1 << 24, np.uint16)
        for t, k in self.number.items():
            a, b, c = t.encode()
            self.lookup[a << 16 | b << 8 | c] = k

    def index(self, chunks: list[str]) -> dict[int, np.ndarray]:
        """Trigram number -> sorted chunk numbers, of the plan's trigrams."""
        data = [c.lower().encode("ascii", "replace") for c in chunks]
        starts = np.cumsum([0, *[len(d) + 1 for d in data]])
        b = np.frombuffer(b"\n".join(data), np.uint8).astype(np.uint32)
        if len(b) < 3:
            return {}
        t = self.lookup[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
        at = np.flatnonzero(t)
        owner = np.searchsorted(starts, at, "right") - 1
        keys = np.unique(t[at].astype(np.int64) * len(chunks) + owner)
        numbers, owners = keys // len(chunks), keys % len(chunks)
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        return {int(n[0]): o for n, o in zip(np.split(numbers, cuts), np.split(owners, cuts)) if len(n)}

    def candidates(self, postings: dict[int, np.ndarray], n_chunks: int) -> dict[str, np.ndarray]:
        none = np.zeros(0, np.int64)
        out = {}
        for name, clauses in self.clauses.items():
            left = None
            for clause in clauses:
                some = none
                for s in clause:
                    have = None
                    for i in range(len(s) - 2):
                        p = postings.get(self.number[s[i : i + 3]], none)
                        have = p if have is None else np.intersect1d(have, p, assume_unique=True)
                        if not len(have):
                            break
                    some = np.union1d(some, have)
                left = some if left is None else np.intersect1d(left, some, assume_unique=True)
            out[name] = np.arange(n_chunks) if left is None else left
        return out


@lru_cache(maxsize=1)
def plan() -> Plan:
    return Plan(DETECTORS)


def chunks_of(text: str, size: int = CHUNK) -> Iterator[tuple[int, int, str]]:
    """(offset, own length, chunk) of whole lines, of about the size; a longer line is a chunk by itself. Behind its own lines a
    chunk holds the next ones, REACH of them with something in them."""
    at, n = 0, len(text)
    while at < n:
        end = n if at + size >= n else text.rfind("\n", at, at + size) + 1
        if end <= at:
            end = text.find("\n", at + size) + 1 or n
        more = _FOLLOWING.match(text, end).end() if end < n else n
        yield at, end - at, text[at:more]
        at = end


def hits(name: str, regex: re.Pattern, chunk: str, own: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts to mask) of each usable value that the regex finds from one of the chunk's own lines on."""
    for m in regex.finditer(chunk) if name in OVER_LINES else regex.finditer(chunk, 0, own):
        if m.start() >= own:
            return
        a, b = m.span("v")
        parts, value = [(a, b)], m["v"]
        groups = regex.groupindex
        if "v2" in groups and m["v2"]:
            parts.append(m.span("v2"))
            value += m["v2"]
        inner = re.search(DETECTORS["address"], value) if "://" in value else None
        if inner and name not in ("address", "pem"):
            continue  # the address detector masks the credential alone
        if name == "assigned" and re.match(r"(?i)(?:bearer|basic|token)\s", value):
            continue
        if name == "assigned" and ";" in value and re.search(DETECTORS["connection"], value):
            continue
        if usable(value, name):
            yield a, b, parts


_PEM_END = re.compile(r"-----(?:END|BEGIN) (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
#: A key's line: a run of its letters with nothing but quotes, signs of comments and joins, and escapes around it.
_KEY_LINE = re.compile(r"[ \t\"'`#*/;+,(>\-]*(?:\\+[nrt])*(?:[A-Za-z0-9+/=]+(?:\\+[nrt])*)+[ \t\r\"'`+,;)\\]*(?:\n|\Z)")
_KEY_PART = re.compile(r"(?P<escape>\\+[nrt])|(?P<run>[A-Za-z0-9+/=]+)")


def key_spans(text: str, a: int) -> Iterator[tuple[int, int]]:
    """The runs of a private key whose BEGIN mark ends at a: up to its END mark, or without one over the lines that look like a
    key's. Short runs count where they are bounded as a line of the key is, so that no word of code is taken for one."""
    m = _PEM_END.search(text, a)
    if m and "END" in m.group():
        stop = m.start()
    else:
        stop = text.find("\n", a) + 1 or len(text)
        before = text[text.rfind("-----BEGIN", 0, a) - 1 :][:1]
        quote = text.find(before, a, stop) if before in tuple("\"'`") else -1
        if quote >= 0 and text[quote:stop].strip("\"'`+,;)\\ \t\r\n"):
            stop = quote  # more code stands behind the string
        else:
            while stop < len(text) and (line := _KEY_LINE.match(text, stop)):
                stop = line.end()
        stop = min(stop, m.start()) if m else stop
    behind = -1  # where the last escape ends
    for part in _KEY_PART.finditer(text, a, stop):
        if part["escape"]:
            behind = part.end()
            continue
        s, e = part.span()
        left, right = text[s - 1], text[e : e + 1]
        opened = left in "\"'`\n-" or behind == s or left in " \t" and right in "\"'`\r\n\\"
        if e - s >= 12 or opened and right in "\"'`\r\n\\ -" and re.search(r"[A-Za-z0-9]", part.group()):
            yield s, e


def spans_of(text: str, found: list[tuple[str, int, list[tuple[int, int]]]]) -> list[tuple[int, int]]:
    """Spans to mask, sorted and merged; a private key is masked up to its end mark, its frame left as it is."""
    spans = []
    for name, _, parts in found:
        if name == "pem":
            spans += key_spans(text, parts[0][1])
        else:
            spans += parts
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_MASKED = re.compile(r"(\\[^\s])|[^\s\"'`\\]")


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """Each masked character becomes an x, an escape as a whole, so that offsets, quotes and line ends stay and no escape is left
    half; a backslash at a span's end stays, as it belongs to what follows."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], _MASKED.sub(lambda m: "xx" if m[1] else "x", text[a:b])]
        at = b
    return "".join(out) + text[at:]


def search(texts: list[str | None]) -> list[list[tuple[str, int, list[tuple[int, int]]]]]:
    """For each text its finds: (detector, start, parts), over one segment's index."""
    p = plan()
    chunks, owned, home = [], [], []
    for k, text in enumerate(texts):
        for at, own, c in chunks_of(text or ""):
            chunks.append(c)
            owned.append(c[:own])
            home.append((k, at, own))
    out: list[list] = [[] for _ in texts]
    if not chunks:
        return out
    for name, left in p.candidates(p.index(owned), len(owned)).items():
        regex = p.regexes[name]
        for i in left.tolist():
            k, at, own = home[i]
            for a, _, parts in hits(name, regex, chunks[i], own):
                out[k].append((name, at + a, [(at + x, at + y) for x, y in parts]))
    return out


def segments(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SEGMENT:
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(ids):
        yield ids[start:], texts[start:]


FOUND = "file_id bigint, line_no int, detectors array<string>"
REDACTED = "file_id bigint, n_credentials int, text string"


def _rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("bigint").alias("file_id"), F.col(text_column).alias("text")).where(F.length("text") > 0)


def find_credentials(df: DataFrame, id_column: str = "file_id", text_column: str = "text") -> DataFrame:
    """One row for each line where a credential begins, in FOUND's columns; lines end at a line feed and count from 1.

    Null and empty texts give no rows; repeated rows count by their own ids; an empty table gives no rows; other columns are
    not looked at. No shuffle."""

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for ids, texts in segments(c["file_id"], c["text"]):
            for i, text, found in zip(ids, texts, search(texts)):
                lines: dict[int, set[str]] = {}
                for name, a, _ in found:
                    lines.setdefault(text.count("\n", 0, a) + 1, set()).add(name)
                for line, names in sorted(lines.items()):
                    yield i, line, sorted(names)

    return arrow_map(_rows(df, id_column, text_column), per_batch, FOUND)


def redact(df: DataFrame, id_column: str = "file_id", text_column: str = "text") -> DataFrame:
    """The files that hold credentials, with each value masked and all else as it was, in REDACTED's columns."""

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        for ids, texts in segments(c["file_id"], c["text"]):
            for i, text, found in zip(ids, texts, search(texts)):
                if found:
                    spans = spans_of(text, found)
                    yield i, len(spans), mask(text, spans)

    return arrow_map(_rows(df, id_column, text_column), per_batch, REDACTED)


INDEX = "file_id bigint, trigram string, chunk_offsets array<int>"


def trigram_index(df: DataFrame, id_column: str = "file_id", text_column: str = "text") -> DataFrame:
    """The index itself, in INDEX's columns: of each file and each trigram that a detector needs, its chunks."""

    def per_batch(c: dict[str, list]) -> Iterator[tuple]:
        p = plan()
        for i, text in zip(c["file_id"], c["text"]):
            chunks = list(chunks_of(text))
            for number, owners in p.index([x[:own] for _, own, x in chunks]).items():
                yield i, p.trigrams[number - 1], [chunks[o][0] for o in owners]

    return arrow_map(_rows(df, id_column, text_column), per_batch, INDEX)
