"""Python 3 for problem 3: logical lines by recursive descent and precedence climbing, blocks by their indentation.

A logical line's validity depends on the kinds of its tokens alone, so each shape of a line is parsed once."""

from __future__ import annotations

import re

from .syntax import Bad, Kinds, Letters, lines_of

# The words and operators of the language.
WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = frozenset("match case type _".split())
BINARY = {"|": 6, "^": 7, "&": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "//": 11, "%": 11, "@": 11}
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
COMPARE = frozenset("< > <= >= == != in is".split())
_PREFIX = r"(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?"
_LEXER = re.compile(
    r"(?:[ \t\f]+|\\\r?\n|#[^\r\n]*)*+(\r?\n[ \t\f]*|\r[ \t\f]*"
    rf"|{_PREFIX}\"\"\"(?s:(?:\\.|[^\\])*?)\"\"\"|{_PREFIX}'''(?s:(?:\\.|[^\\])*?)'''|{_PREFIX}\"(?!\"\")(?:\\(?:\r\n|(?s:.))|[^\"\\\r\n])*\"|{_PREFIX}'(?!'')(?:\\(?:\r\n|(?s:.))|[^'\\\r\n])*'"
    r"|[^\W\d]\w*|\d(?:[\w.]|(?<=[eE])[+-])*|\.\d(?:\w|(?<=[eE])[+-])*|\.\.\.|->|:=|\*\*=?|//=?|<<=?|>>=?|[=!<>+\-*/%&|^@]=|\S|\Z)"
)
_NUMBER = re.compile(r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]")
#: Escapes that no string may hold.
_BAD_BYTE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!000[0-9a-fA-F]{5}|0010[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
_ZEROS = re.compile(r"0\d[\d_]*")


class Line:
    """Parses one logical line, given as kinds."""

    def __init__(self, t: list[str]) -> None:
        self.t, self.i = [*t, "end", "end", "end"], 0

    def fail(self, why: str = "") -> None:
        raise Bad(self.i, why or f"unexpected {self.t[self.i]}")

    def take(self, kind: str) -> None:
        if self.t[self.i] != kind:
            raise Bad(self.i, f"expected {kind}, found {self.t[self.i]}")
        self.i += 1

    def maybe(self, kind: str) -> bool:
        if self.t[self.i] == kind:
            self.i += 1
            return True
        return False

    def is_name(self, k: int = 0) -> bool:
        return self.t[self.i + k] == "id" or self.t[self.i + k] in SOFT

    def name(self) -> None:
        if not self.is_name():
            raise Bad(self.i, f"expected a name, found {self.t[self.i]}")
        self.i += 1

    # statements: gives the line's head and whether a block must follow

    def parse(self) -> tuple[str, bool]:
        t, k = self.t, self.t[self.i]
        if k == "@":
            self.i += 1
            self.named()
            self.take("end")
            return "@", False
        if k == "async":
            self.i += 1
            if t[self.i] not in ("def", "for", "with"):
                self.fail()
            head, opens = self.parse()
            return head, opens
        compound = getattr(self, f"{k}_line", None) if k in ("if", "elif", "else", "while", "for", "try", "except", "finally", "with", "def", "class") else None
        if compound:
            self.i += 1
            head = compound() or k
        elif k == "match" and self.soft("match"):
            head = "match"
        elif k == "case" and self.soft("case"):
            head = "case"
        else:
            self.simple()
            return "", False
        self.take(":")
        if self.maybe("end"):
            return head, True
        if head == "match":
            self.fail()
        self.simple()
        return head, False

    def soft(self, word: str) -> bool:
        at = self.i
        try:
            self.i += 1
            if word == "match":
                self.star_list()
            else:
                self.patterns()
                if self.maybe("if"):
                    self.named()
            if self.t[self.i] != ":" or word == "match" and self.t[self.i + 1] != "end":
                self.fail()
            return True
        except Bad:
            self.i = at
            return False

    def if_line(self) -> None:
        self.named()

    elif_line = while_line = if_line

    def else_line(self) -> None:
        pass

    try_line = finally_line = else_line

    def for_line(self) -> None:
        self.targets("in")
        self.take("in")
        self.star_list()

    def except_line(self) -> None:
        star = self.maybe("*")
        if self.t[self.i] != ":":
            self.expression()
            while self.maybe(","):
                self.expression()
            if self.maybe("as"):
                self.name()
        elif star:
            self.fail()

    def with_line(self) -> None:
        at = self.i
        if self.t[self.i] == "(":
            try:
                self.i += 1
                while True:
                    self.with_item()
                    if not self.maybe(",") or self.t[self.i] == ")":
                        break
                self.take(")")
                if self.t[self.i] == ":":
                    return
            except Bad:
                pass
            self.i = at
        self.with_item()
        while self.maybe(","):
            self.with_item()

    def with_item(self) -> None:
        self.expression()
        if self.maybe("as"):
            at = self.i
            if not self.star_target():
                raise Bad(at, "cannot assign")

    def def_line(self) -> None:
        self.name()
        self.type_parameters()
        self.take("(")
        self.parameters(")", True)
        self.take(")")
        if self.maybe("->"):
            self.expression()

    def class_line(self) -> None:
        self.name()
        self.type_parameters()
        if self.maybe("("):
            self.arguments()

    def type_parameters(self) -> None:
        if not self.maybe("["):
            return
        while True:
            self.maybe("*") or self.maybe("**")
            self.name()
            if self.maybe(":"):
                self.expression()
            if self.maybe("="):
                self.expression()
            if not self.maybe(",") or self.t[self.i] == "]":
                break
        self.take("]")

    def parameters(self, end: str, typed: bool) -> None:
        default = star = slash = False
        n = 0
        while self.t[self.i] != end:
            if self.maybe("**"):
                self.name()
                if typed and self.maybe(":"):
                    self.expression()
                self.maybe(",")
                if self.t[self.i] != end:
                    self.fail()
                return
            if self.maybe("/"):
                if slash or star or not n:
                    self.fail()
                slash = True
            elif self.maybe("*"):
                if star:
                    self.fail()
                star = True
                if self.is_name():
                    self.name()
                    if typed and self.maybe(":"):
                        self.star_or_expression()
                elif self.t[self.i] != "," or self.t[self.i + 1] in (end, "**"):
                    self.fail()
            else:
                self.name()
                n += 1
                if typed and self.maybe(":"):
                    self.expression()
                if self.maybe("="):
                    self.expression()
                    default = True
                elif default and not star:
                    self.fail("a parameter without default behind one with it")
            if not self.maybe(","):
                break
        if self.t[self.i] != end:
            self.fail()

    def star_or_expression(self) -> None:
        self.maybe("*")
        self.expression()

    def simple(self) -> None:
        while True:
            self.small()
            if self.maybe("end"):
                return
            self.take(";")
            if self.maybe("end"):
                return

    def small(self) -> None:
        t, k = self.t, self.t[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if t[self.i] not in (";", "end"):
                self.star_list()
        elif k == "raise":
            self.i += 1
            if t[self.i] not in (";", "end"):
                self.expression()
                if self.maybe("from"):
                    self.expression()
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.maybe(","):
                self.name()
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.maybe(","):
                self.expression()
        elif k == "del":
            self.i += 1
            while True:
                at = self.i
                if not self.star_target(False):
                    raise Bad(at, "cannot delete")
                if not self.maybe(",") or t[self.i] in (";", "end"):
                    return
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.maybe("as"):
                    self.name()
                if not self.maybe(","):
                    return
        elif k == "from":
            self.i += 1
            dots = False
            while t[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if not dots or self.is_name():
                self.dotted()
            self.take("import")
            if self.maybe("*"):
                return
            wrapped = self.maybe("(")
            while True:
                self.name()
                if self.maybe("as"):
                    self.name()
                if not self.maybe(",") or wrapped and t[self.i] == ")":
                    break
            if wrapped:
                self.take(")")
        elif k == "type" and self.is_name(1) and t[self.i + 2] in ("=", "["):
            self.i += 2
            self.type_parameters()
            self.take("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.name()
        while self.maybe("."):
            self.name()

    def assignment(self) -> None:
        if self.is_name() and self.t[self.i + 1] == ":=":
            raise Bad(self.i + 1, "unexpected :=")
        at = self.i
        form = self.value()
        k = self.t[self.i]
        if k == ":":
            if form not in ("name", "part") and form != "(name":
                raise Bad(at, "cannot annotate")
            self.i += 1
            self.expression()
            if self.maybe("="):
                self.value()
            return
        if k in AUGMENTED:
            if form not in ("name", "part"):
                raise Bad(at, "cannot assign")
            self.i += 1
            self.value()
            return
        while self.maybe("="):
            if form not in ("name", "part", "many", "(name"):
                raise Bad(at, "cannot assign")
            at = self.i
            form = self.value()
        if form == "star":
            raise Bad(at, "a starred expression alone")

    def value(self) -> str:
        if self.t[self.i] == "yield":
            self.yielded()
            return "value"
        return self.star_list()

    def yielded(self) -> None:
        self.take("yield")
        if self.maybe("from"):
            self.expression()
        elif self.t[self.i] not in (")", "]", "}", ";", "end", "=", ",", ":"):
            self.star_list()

    # targets and lists; forms: name, part (attribute or item), many (all of it can be assigned), star, value

    def star_list(self) -> str:
        forms = [self.starred()]
        many = False
        while self.maybe(","):
            many = True
            if self.t[self.i] in (")", "]", "}", ";", "end", "=", ":") or self.t[self.i] in AUGMENTED:
                break
            forms.append(self.starred())
        if not many:
            return forms[0]
        return "many" if all(f in ("name", "part", "many", "star", "(name") for f in forms) else "value"

    def starred(self) -> str:
        if self.maybe("*"):
            at = self.i
            form = self.binary(6)
            return "star" if form in ("name", "part", "many", "(name") else "star value" if at else ""
        return self.named()

    def star_target(self, star: bool = True) -> bool:
        if star and self.t[self.i] == "*":
            self.i += 1
        return self.primary() in ("name", "part", "many", "(name")

    def targets(self, end: str) -> None:
        at = self.i
        while True:
            if not self.star_target():
                raise Bad(at, "cannot assign")
            if not self.maybe(",") or self.t[self.i] == end:
                return

    # expressions

    def named(self) -> str:
        if self.is_name() and self.t[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            return "value"
        return self.expression()

    def expression(self) -> str:
        if self.t[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.take(":")
            self.expression()
            return "value"
        form = self.disjunction()
        if self.maybe("if"):
            self.disjunction()
            self.take("else")
            self.expression()
            return "value"
        return form

    def disjunction(self) -> str:
        form = self.negation()
        while self.t[self.i] in ("or", "and"):
            self.i += 1
            self.negation()
            form = "value"
        return form

    def negation(self) -> str:
        if self.maybe("not"):
            self.negation()
            return "value"
        form = self.binary(6)
        while True:
            k = self.t[self.i]
            if k == "not" and self.t[self.i + 1] == "in":
                self.i += 2
            elif k in COMPARE:
                self.i += 1
                if k == "is":
                    self.maybe("not")
            else:
                return form
            self.binary(6)
            form = "value"

    def binary(self, least: int) -> str:
        form = self.unary()
        while True:
            level = BINARY.get(self.t[self.i])
            if level is None or level < least:
                return form
            self.i += 1
            self.binary(level + 1)
            form = "value"

    def unary(self) -> str:
        if self.t[self.i] in ("+", "-", "~"):
            self.i += 1
            self.unary()
            return "value"
        awaited = self.maybe("await")
        form = self.primary()
        if self.maybe("**"):
            self.unary()
            return "value"
        return "value" if awaited else form

    def primary(self) -> str:
        t, k = self.t, self.t[self.i]
        if k == "id" or k in SOFT:
            self.i += 1
            form = "name"
        elif k in ("num", "True", "False", "None", "..."):
            self.i += 1
            form = "value"
        elif k in ("str", "bytes"):
            while t[self.i] == k:
                self.i += 1
            if t[self.i] in ("str", "bytes"):
                self.fail("bytes and text side by side")
            form = "value"
        elif k == "(":
            form = self.tuple()
        elif k == "[":
            form = self.list()
        elif k == "{":
            self.braces()
            form = "value"
        else:
            self.fail()
        while True:
            k = t[self.i]
            if k == ".":
                self.i += 1
                self.name()
                form = "part"
            elif k == "(":
                self.i += 1
                self.arguments()
                form = "value"
            elif k == "[":
                self.i += 1
                self.slices()
                form = "part"
            else:
                return form

    def tuple(self) -> str:
        self.take("(")
        if self.maybe(")"):
            return "many"
        if self.t[self.i] == "yield":
            self.yielded()
            self.take(")")
            return "value"
        at = self.i
        form = self.starred()
        if self.t[self.i] in ("for", "async"):
            if form.startswith("star"):
                raise Bad(at, "an unpacking in a comprehension")
            self.comprehension()
            self.take(")")
            return "value"
        if self.maybe(")"):
            if form.startswith("star"):
                raise Bad(at, "a starred expression alone")
            return "(name" if form in ("name",) else form
        forms = [form]
        while self.maybe(","):
            if self.t[self.i] == ")":
                break
            forms.append(self.starred())
        self.take(")")
        return "many" if all(f in ("name", "part", "many", "star", "(name") for f in forms) else "value"

    def list(self) -> str:
        self.take("[")
        forms = []
        while not self.maybe("]"):
            forms.append(self.starred())
            if len(forms) == 1 and self.t[self.i] in ("for", "async"):
                if forms[0].startswith("star"):
                    self.fail()
                self.comprehension()
                self.take("]")
                return "value"
            if self.t[self.i] != "]":
                self.take(",")
        return "many" if all(f in ("name", "part", "many", "star", "(name") for f in forms) else "value"

    def braces(self) -> None:
        self.take("{")
        n, kind = 0, ""
        while not self.maybe("}"):
            if self.maybe("**"):
                self.binary(6)
                this = "dict"
            else:
                self.starred()
                this = "set"
                if self.maybe(":"):
                    self.expression()
                    this = "dict"
            n += 1
            if kind and kind != this:
                self.fail("a set and a dict in one")
            kind = this
            if n == 1 and self.t[self.i] in ("for", "async"):
                self.comprehension()
                self.take("}")
                return
            if self.t[self.i] != "}":
                self.take(",")

    def comprehension(self) -> None:
        while self.t[self.i] in ("for", "async"):
            self.maybe("async")
            self.take("for")
            self.targets("in")
            self.take("in")
            self.disjunction()
            while self.maybe("if"):
                if self.is_name() and self.t[self.i + 1] == ":=":
                    self.named()
                else:
                    self.disjunction()

    def slices(self) -> None:
        n = 0
        while not self.maybe("]") or not n:
            n += 1
            if self.maybe("*"):
                self.binary(6)
            elif self.t[self.i] != ":":
                self.named()
            if self.maybe(":"):
                if self.t[self.i] not in (":", "]", ","):
                    self.expression()
                if self.maybe(":") and self.t[self.i] not in ("]", ","):
                    self.expression()
            if self.t[self.i] != "]":
                self.take(",")

    def arguments(self) -> None:
        keyword = unpacked = False
        n = 0
        while not self.maybe(")"):
            n += 1
            if self.maybe("**"):
                self.expression()
                unpacked = True
            elif self.maybe("*"):
                if unpacked:
                    self.fail()
                self.expression()
            elif self.is_name() and self.t[self.i + 1] == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                at = self.i
                self.named()
                if self.t[self.i] in ("for", "async"):
                    self.comprehension()
                    if n > 1 or self.t[self.i] != ")":
                        self.fail()
                elif keyword or unpacked:
                    raise Bad(at, "a positional argument behind a keyword")
            if self.t[self.i] != ")":
                self.take(",")

    # patterns of match

    def patterns(self) -> None:
        while True:
            self.pattern()
            if not self.maybe(",") or self.t[self.i] in (":", "if"):
                return

    def pattern(self) -> None:
        if self.maybe("*"):
            self.name()
            return
        while True:
            self.closed()
            if not self.maybe("|"):
                break
        if self.maybe("as"):
            self.name()

    def closed(self) -> None:
        t, k = self.t, self.t[self.i]
        if k in ("num", "-"):
            self.binary(10)
        elif k in ("str", "bytes", "True", "False", "None"):
            self.primary()
        elif k in ("(", "["):
            end = ")" if k == "(" else "]"
            self.i += 1
            while not self.maybe(end):
                self.pattern()
                if t[self.i] != end:
                    self.take(",")
        elif k == "{":
            self.i += 1
            while not self.maybe("}"):
                if self.maybe("**"):
                    self.name()
                else:
                    self.closed()
                    self.take(":")
                    self.pattern()
                if t[self.i] != "}":
                    self.take(",")
        else:
            self.dotted()
            if self.maybe("("):
                while not self.maybe(")"):
                    if self.is_name() and t[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()
                    if t[self.i] != ")":
                        self.take(",")


class Python:
    """The whole file; the same face as the other languages' parsers."""

    kinds: Kinds
    letters = Letters()
    good: dict[str, tuple] = {}

    @classmethod
    def kind(cls, token: str) -> str:
        c = token[0]
        if c in "\r\n":
            return "nl"
        if token[-1] in "\"'" and len(token) > 1:
            prefix = token[: min(token.find(q) for q in "\"'" if q in token)].lower()
            if "r" not in prefix and "\\" in token and (_BAD_BYTE if "b" in prefix else _BAD_ESCAPE).search(token):
                return "err"
            if "b" in prefix:
                return "bytes" if token.isascii() else "err"
            return "str" if "f" not in prefix or cls.holes(token, prefix) else "err"
        if c.isalpha() or c == "_" or ord(c) > 127 and token.isidentifier():
            return token if token in WORDS or token in SOFT else "id" if token.isidentifier() else "err"
        if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            return "num" if _NUMBER.fullmatch(token) and not _ZEROS.fullmatch(token.replace("_", "")) or _ZEROS.fullmatch(token) and not token.strip("0_") else "err"
        return "err" if c in "\"'\\$?`!" and token != "!=" or ord(c) > 127 or not c.isprintable() else token

    @classmethod
    def holes(cls, token: str, prefix: str) -> bool:
        """The expressions within an f-string parse."""
        body = token[len(prefix) :]
        body = body[3:-3] if body[:3] in ('"""', "'''") else body[1:-1]
        k, n = 0, len(body)
        while k < n:
            c = body[k]
            if c in "{}" and body[k : k + 2] == c * 2:
                k += 2
                continue
            if c == "}":
                return False
            if c != "{":
                k += 1
                continue
            depth, start, colon = 1, k + 1, -1
            k += 1
            while k < n and depth:
                c = body[k]
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                elif depth == 1 and colon < 0 and (c == ":" or c == "!" and body[k + 1 : k + 2] != "="):
                    colon = k
                k += 1
            if depth:
                return False
            inner = body[start : colon if colon >= 0 else k - 1].strip()
            inner = re.sub(r"(?<![=!<>])=$", "", inner).strip()
            line = Line([cls.kinds[x] for x in _LEXER.findall(inner) if x and x[0] not in "\r\n"])
            try:
                line.value()
                line.take("end")
            except (Bad, RecursionError):
                return False
        return True

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = _LEXER.findall(text)
        while self.tokens and not self.tokens[-1]:
            self.tokens.pop()
        self.t = list(map(self.kinds.__getitem__, self.tokens))
        self.errors: list[tuple[int, str]] = []

    def lines_of(self, places: list[int]) -> list[int]:
        return lines_of(_LEXER, self.text, 1, places)

    def shape(self, s: str, at: int, end: int) -> tuple:
        """(head, opens a block, None) or ("", False, (place in the line, why))."""
        known = self.good.get(s)
        if known is None:
            if len(self.good) > 300_000:
                self.good.clear()
            line = Line([k for k in self.t[at:end] if k != "nl"])
            try:
                known = (*line.parse(), None)
            except Bad as e:
                known = ("", False, (e.at, e.why))
            self.good[s] = known
        return known

    def check(self) -> list[tuple[int, str]]:
        errors = self.errors
        s = "".join(map(self.letters.__getitem__, self.t))
        nl = self.letters["nl"]
        opens, closes = ("".join(self.letters[k] for k in ks) for ks in ("([{", ")]}"))
        tokens = self.tokens
        at, n = 0, len(s)
        indent = ""
        if n and self.text[:1] in " \t":
            indent = re.match(r"[ \t]*", self.text).group()
        stack: list[tuple[str, str, str]] = [("", "", "")]  # indentation; last compound head at this level; the block's owner
        want = False  # a block must begin
        decorated = False
        while at < n:
            end = s.find(nl, at)
            end = n if end < 0 else end
            if end == at:  # blank, or a comment alone
                indent = tokens[at].lstrip("\r\n")
                at += 1
                continue
            part = s[at:end]
            depth = sum(map(part.count, opens)) - sum(map(part.count, closes))
            while depth > 0 and end < n:
                nxt = s.find(nl, end + 1)
                nxt = n if nxt < 0 else nxt
                more = s[end + 1 : nxt]
                depth += sum(map(more.count, opens)) - sum(map(more.count, closes))
                part += more
                end = nxt
            head, block, bad = self.shape(part, at, end)
            width = indent.expandtabs(8)
            top = stack[-1][0].expandtabs(8)
            why = ""
            if want:
                if len(width) <= len(top):
                    why = "an indented block is missing"
                else:
                    stack.append((indent, "", stack[-1][1]))
            elif len(width) > len(top):
                why = "unexpected indentation"
            if not want or why:
                while len(stack) > 1 and len(width) < len(stack[-1][0].expandtabs(8)):
                    if stack[-1][1] == "try":
                        why = why or "a try without except or finally"
                    stack.pop()
                if not why and len(width) != len(stack[-1][0].expandtabs(8)):
                    why = "the indentation fits no outer block"
                if not why and indent != stack[-1][0] and (len(indent.replace("\t", " ")) != len(stack[-1][0].replace("\t", " "))):
                    why = "tabs and spaces mixed"
            want = False
            level, before, owner = stack[-1]
            if not bad and not why:
                if decorated and head not in ("def", "class", "@"):
                    why = "a decorator before something else"
                elif head in ("elif", "else", "except", "finally"):
                    fits = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "tryelse")}[head]
                    if before not in fits:
                        why = f"{head} without its beginning"
                elif before == "try":
                    why = "a try without except or finally"
                elif head == "case" and owner != "match" or owner == "match" and head != "case" and not (head == "" and False):
                    why = "case and match apart"
            if why or bad:
                errors.append((at, why) if why else (at + min(bad[0], end - at), bad[1]))
                # panic: go on as if the line were right, with whatever indentation comes next
                stack = [x for x in stack if len(x[0].expandtabs(8)) <= len(width)] or [("", "", "")]
                if len(stack[-1][0].expandtabs(8)) != len(width):
                    stack.append((indent, "", ""))
            keep = head
            if head == "else" and before == "except":
                keep = "tryelse"
            elif head in ("finally",) or head == "else":
                keep = "done"
            decorated = head == "@"
            stack[-1] = (stack[-1][0], keep, stack[-1][2])
            want = block and not bad
            indent = tokens[end].lstrip("\r\n") if end < n else ""
            at = end + 1
        if want:
            errors.append((n, "an indented block is missing"))
        elif decorated:
            errors.append((n, "a decorator before the end"))
        else:
            for level in stack:
                if level[1] == "try":
                    errors.append((n, "a try without except or finally"))
                    break
        return errors


Python.kinds = Kinds(Python)
