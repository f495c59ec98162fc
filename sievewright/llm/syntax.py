"""Parsers behind problem 3: the machinery and the languages with braces (Java, C#, JavaScript) and JSON.

Statements are parsed by recursive descent, expressions by precedence climbing, and after an error the parser panics: it
skips to the next statement's start and goes on. A statement's validity depends on the kinds of its tokens alone, so the
kinds of every simple statement and header that was accepted once are remembered, and met again are accepted at once.
"""

from __future__ import annotations

import re
from functools import lru_cache

_MEMORY = 400_000


class Bad(Exception):
    def __init__(self, at: int, why: str) -> None:
        self.at, self.why = at, why


class Kinds(dict):
    """Token text -> kind: the text itself for operators and words of the language, else id, num, str or err."""

    def __init__(self, language: type[Parser]) -> None:
        super().__init__()
        self.language = language

    def __missing__(self, token: str) -> str:
        kind = self.language.kind(token)
        if len(self) > _MEMORY:
            self.clear()
        self[token] = kind
        return kind


class Letters(dict):
    """Kind -> one character, so that a run of kinds is a string."""

    def __missing__(self, kind: str) -> str:
        c = self[kind] = chr(0xE000 + len(self))
        return c


def lines_of(lexer: re.Pattern, text: str, group: int, places: list[int]) -> list[int]:
    """The line of each of these tokens, in one pass; a place behind the last token is on the last line."""
    wanted, lines, line, done = set(places), {}, 1, 0
    for k, m in enumerate(lexer.finditer(text)):
        if k in wanted:
            line += text.count("\n", done, m.start(group))
            done = m.start(group)
            lines[k] = line
            if len(lines) == len(wanted):
                break
    last = text.count("\n") + 1
    return [lines.get(k, last) for k in places]


class Parser:
    """What the languages with braces share. i is the place in t, the kinds of the tokens."""

    words: frozenset = frozenset()
    contextual: frozenset = frozenset()
    lexer: re.Pattern
    binary: dict[str, int] = {}
    assign: frozenset = frozenset()
    kinds: Kinds
    letters: Letters
    good: set

    def __init_subclass__(cls) -> None:
        cls.kinds, cls.letters, cls.good = Kinds(cls), Letters(), set()
        for k in (";", "{", "}"):
            cls.letters[k]  # noqa: B018
        a, b, c = (cls.letters[k] for k in ";{}")
        cls.simple = re.compile(f"[^{a}{b}{c}]*{a}")
        cls.heading = re.compile(f"[^{a}{b}{c}]*{b}")

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = self.lexer.findall(text)
        while self.tokens and not self.tokens[-1]:  # what stands behind the last token
            self.tokens.pop()
        self.t = list(map(self.kinds.__getitem__, self.tokens))
        self.s = "".join(map(self.letters.__getitem__, self.t))
        self.t += ["eof"] * 4
        self.i = 0
        self.errors: list[tuple[int, str]] = []
        self.partners: dict[str, dict[int, int]] = {}
        self.names: list[str | None] = [None]  # the types that the place lies in

    # ---------------------------------------------------------------- tools

    @classmethod
    def kind(cls, token: str) -> str:
        c = token[0]
        if c.isalpha() or c in "_$" or c == "@" and len(token) > 1:
            return token if token in cls.words or token in cls.contextual else "id"
        if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            return "num" if cls.number.fullmatch(token) else "err"
        return cls.other(token)

    @classmethod
    def other(cls, token: str) -> str:
        if len(token) > 1 and token[0] in "\"'`":
            return "str"
        return "err" if token in ("\"", "'", "`", "/*", "\\", "#") or not token.isascii() else token

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
        kind = self.t[self.i + k]
        return kind == "id" or kind in self.contextual

    def name(self) -> None:
        if not self.is_name():
            raise Bad(self.i, f"expected a name, found {self.t[self.i]}")
        self.i += 1

    def attempt(self, f, *args) -> bool:
        at = self.i
        try:
            f(*args)
            return True
        except Bad:
            self.i = at
            return False

    def matching(self, at: int, opens: str = "(", closes: str = ")") -> int:
        """Place of the bracket that closes the one at this place, or that of the end."""
        depth, t = 0, self.t
        n = len(t) - 4
        if at < n and t[at] == opens:
            if opens not in self.partners:
                known, waiting = {}, []
                for k, kind in enumerate(t):
                    if kind == opens:
                        waiting.append(k)
                    elif kind == closes and waiting:
                        known[waiting.pop()] = k
                self.partners[opens] = known
            return self.partners[opens].get(at, n)
        while at < n:
            if t[at] == opens:
                depth += 1
            elif t[at] == closes:
                depth -= 1
                if not depth:
                    return at
            at += 1
        return n

    def remembered(self, space: str, f, pattern: re.Pattern, keep: int = 0) -> None:
        """Run f here; its kinds up to the pattern's end (less keep) are remembered if f ends just there."""
        m = pattern.match(self.s, self.i)
        if not m:
            f()
            return
        key = (space, m.group())
        if key in self.good:
            self.i = m.end() - keep
            return
        f()
        if self.i == m.end() - keep:
            if len(self.good) > _MEMORY:
                self.good.clear()
            self.good.add(key)

    def repeat(self, f, end: str) -> None:
        """f until end; after an error in it, on from the next statement."""
        while self.t[self.i] != end:
            if self.t[self.i] == "eof":
                self.fail(f"the file ends before {end}")
            at = self.i
            try:
                f()
            except Bad as e:
                place = e.at
                if e.why != "given up":
                    self.errors.append((place, e.why))
                if self.t[place] == "eof":
                    raise Bad(len(self.t) - 4, "given up") from None
                self.i = max(place, at)
                self.panic(at)

    def panic(self, start: int) -> None:
        depth = 0
        t = self.t
        self.i = max(self.i, start)
        while t[self.i] != "eof":
            k = t[self.i]
            if k == "{":
                depth += 1
            elif k == "}":
                if depth <= 0:
                    if self.i == start:
                        self.i += 1
                    return
                depth -= 1
                if depth == 0:
                    self.i += 1
                    return
            elif k == ";" and depth <= 0:
                self.i += 1
                return
            self.i += 1

    def check(self) -> list[tuple[int, str]]:
        """All errors as (place of the token, what), the first cause first. RecursionError: the text nests deeper than the stack goes."""
        try:
            self.file()
        except Bad as e:
            if e.why != "given up":
                self.errors.append((e.at, e.why))
        self.errors = list(dict.fromkeys(self.errors))  # what was tried twice counts once
        return self.errors

    def lines_of(self, places: list[int]) -> list[int]:
        return lines_of(self.lexer, self.text, 1, places)

    # ---------------------------------------------------------------- expressions

    def expression(self, least: int = 0) -> None:
        self.unary()
        t = self.t
        while True:
            op = t[self.i]
            if op == ">" and t[self.i + 1] in (">", ">="):
                n = 2 if t[self.i + 1] == ">=" or t[self.i + 2] not in (">", ">=") else 3
                if t[self.i + n - 1] == ">=":
                    self.i += n
                    self.expression(0)
                    return
                if 12 < least:
                    return
                self.i += n
                self.expression(13)
                continue
            level = self.binary.get(op)
            if level is None:
                break
            if level < least:
                return
            self.i += 1
            if self.operand(op):
                continue
            self.expression(level if op in ("**", "??") else level + 1)
        if least <= 1 and self.t[self.i] == "?":
            self.i += 1
            self.expression()
            self.take(":")
            self.expression()
        if self.t[self.i] in self.assign:
            if least > 2:
                self.fail()
            self.i += 1
            self.expression()

    def operand(self, op: str) -> bool:
        """What some operators take on their right instead of an expression."""
        return False

    def arguments(self) -> None:
        self.take("(")
        if self.maybe(")"):
            return
        while True:
            self.argument()
            if self.maybe(")"):
                return
            self.take(",")

    def argument(self) -> None:
        self.expression()

    def parens(self, f=None) -> None:
        self.take("(")
        (f or self.expression)()
        self.take(")")

    def header(self, f) -> None:
        """( ... ) before a block, remembered."""
        self.remembered("(" + f.__name__, lambda: self.parens(f), self.heading, 1)


_C_SKIP = r"(?:\s+|//[^\n]*|(?s:/\*.*?\*/))*+"
_C_BINARY = {"||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "<<": 12, "+": 14, "-": 14, "*": 15, "/": 15, "%": 15}
_C_ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="))
_WORDS = r"[^\W\d]\w*"


class Java(Parser):
    # The words of the language.
    words = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
    contextual = frozenset("var yield record sealed permits non module open opens exports requires uses provides to with transitive when".split())
    primitive = frozenset("boolean byte char short int long float double".split())
    modifiers = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
    number = re.compile(r"0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?[fFdDlL]?|\d[\d_]*\.(?:[eE][+-]?\d+)?[fFdD]?")
    lexer = re.compile(
        _C_SKIP + r"((?:[^\W\d]|\$)[\w$]*|\d(?:[\w.]|(?<=[eE])[+-])*|\.\d(?:\w|(?<=[eE])[+-])*|\"\"\"[ \t\f]*\r?\n(?s:(?:\\.|[^\\])*?)\"\"\"|\"(?:\\[btnfrs\"'\\0-7u]|[^\"\\\r\n])*\"|'(?:\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[btnfrs\"'\\])|[^'\\\r\n])'"
        r"|/\*|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|<<=?|\S|\Z)"
    )
    binary = _C_BINARY | {"instanceof": 9}
    assign = _C_ASSIGN

    @classmethod
    def other(cls, token: str) -> str:
        return "str" if len(token) > 1 and token[0] in "\"'" else super().other(token)

    def file(self) -> None:
        self.repeat(self.top, "eof")

    def top(self) -> None:
        if self.maybe(";"):
            return
        self.remembered("top", self.unit, self.simple) if self.t[self.i] in ("import", "package") else self.declaration(True)

    def unit(self) -> None:
        at = self.t[self.i]
        self.i += 1
        if at == "import":
            self.maybe("static")
        self.name()
        if at == "import" and self.t[self.i] != ".":
            self.fail()
        while self.maybe("."):
            if at == "import" and self.maybe("*"):
                break
            self.name()
        self.take(";")

    def annotation(self) -> None:
        self.take("@")
        self.name()
        while self.maybe("."):
            self.name()
        if self.t[self.i] == "(":
            self.i += 1
            while not self.maybe(")"):
                self.element()
                if self.t[self.i] != ")":
                    self.take(",")

    def element(self) -> None:
        if self.is_name() and self.t[self.i + 1] == "=":
            self.i += 2
        if self.t[self.i] == "@":
            self.annotation()
        elif self.maybe("{"):
            while not self.maybe("}"):
                self.element()
                if self.t[self.i] != "}":
                    self.take(",")
        else:
            self.expression(1)

    def prefix(self) -> None:
        while True:
            k = self.t[self.i]
            if k == "@" and self.t[self.i + 1] != "interface":
                self.annotation()
            elif k == "non" and self.t[self.i + 1] == "-" and self.t[self.i + 2] == "sealed":
                self.i += 3
            elif k in self.modifiers and not (k == "sealed" and self.t[self.i + 1] in ("=", ".", "(")) and not (k == "default" and self.t[self.i + 1] in (":", "->")):
                self.i += 1
            else:
                return

    def is_type_word(self) -> bool:
        k = self.t[self.i]
        return k in ("class", "interface", "enum", "@") or k == "record" and self.is_name(1) and self.t[self.i + 2] in ("(", "<")

    def declaration(self, top: bool = False) -> None:
        """A type; inside a type any member, by the caller."""
        if top and self.t[self.i] not in ("@", "class", "interface", "enum", "record", "non") and self.t[self.i] not in self.modifiers:
            if self.t[self.i] in ("open", "module"):
                return self.module()
            self.fail()
        self.remembered("type", self.type_head, self.heading, 1)
        word = self.word
        if word is None:  # remembered: look back for the word
            k = self.i
            while self.t[k] not in ("class", "interface", "enum", "record"):
                k -= 1
            word = self.t[k]
        self.word = None
        k = self.i
        while self.t[k] != word or not self.is_name(k + 1 - self.i):
            k -= 1
        self.names.append(self.tokens[k + 1])
        self.body(word == "enum")
        self.names.pop()

    word: str | None = None

    def module(self) -> None:
        self.maybe("open")
        self.take("module")
        self.name()
        while self.maybe("."):
            self.name()
        self.i = self.matching(self.i, "{", "}")
        self.take("}")

    def type_head(self) -> None:
        self.word = None
        self.prefix()
        self.maybe("@")
        word = self.t[self.i]
        if not (word in ("class", "interface", "enum") or word == "record"):
            self.fail()
        self.i += 1
        self.name()
        if self.t[self.i] == "<":
            self.type_parameters()
        if word == "record":
            self.parameters()
        while self.t[self.i] in ("extends", "implements", "permits"):
            self.i += 1
            self.type()
            while self.maybe(","):
                self.type()
        if self.t[self.i] != "{":
            self.fail()
        self.word = word

    def type_parameters(self) -> None:
        self.take("<")
        while True:
            while self.t[self.i] == "@":
                self.annotation()
            self.name()
            if self.maybe("extends"):
                self.type()
                while self.maybe("&"):
                    self.type()
            if self.maybe(">"):
                return
            self.take(",")

    def body(self, enum: bool = False) -> None:
        self.take("{")
        if enum:
            while self.t[self.i] not in (";", "}"):
                while self.t[self.i] == "@":
                    self.annotation()
                self.name()
                if self.t[self.i] == "(":
                    self.arguments()
                if self.t[self.i] == "{":
                    self.body()
                if not self.maybe(","):
                    break
            if not self.maybe(";"):
                self.take("}")
                return
        self.repeat(self.member, "}")
        self.take("}")

    def member(self) -> None:
        if self.maybe(";"):
            return
        m = self.heading.match(self.s, self.i)
        if m and ("method", m.group()) in self.good:
            self.i = m.end() - 1
            self.block()
            return
        if not m:
            m = self.simple.match(self.s, self.i)
            if m and ("member", m.group()) in self.good:
                self.i = m.end()
                return
        start = self.i
        if self.t[self.i] == "{" or self.t[self.i] == "static" and self.t[self.i + 1] == "{":
            self.maybe("static")
            self.block()
            return
        self.prefix()
        if self.is_type_word():
            self.i = start
            self.declaration()
            return
        if self.t[self.i] == "<":
            self.type_parameters()
        method = False
        made = self.is_name() and self.t[self.i + 1] in ("(", "{")
        if made and self.tokens[self.i] != self.names[-1]:
            self.fail("a method without a type")
        if made and self.t[self.i + 1] == "{":  # a record's compact constructor
            self.i += 1
            method = True
        else:
            if made:
                self.i += 1
            else:
                if not self.maybe("void"):
                    self.type()
                self.name()
            if self.t[self.i] == "(":
                method = True
                self.parameters()
                self.dims()
                if self.maybe("throws"):
                    self.type()
                    while self.maybe(","):
                        self.type()
                if self.maybe("default"):
                    self.element()
        if method:
            if self.t[self.i] == "{":
                if m and self.i == m.end() - 1 and not made:
                    self.good.add(("method", m.group()))
                self.block()
                return
            self.take(";")
        else:
            self.declarators()
            self.take(";")
        if m and self.i == m.end() and not made:
            self.good.add(("member", m.group()))

    def dims(self) -> None:
        while self.t[self.i] == "[" and self.t[self.i + 1] == "]":
            self.i += 2

    def declarators(self) -> None:
        """From behind the first name on."""
        while True:
            self.dims()
            if self.maybe("="):
                self.initializer()
            if not self.maybe(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.maybe("{"):
            while not self.maybe("}"):
                self.initializer()
                if self.t[self.i] != "}":
                    self.take(",")
        else:
            self.expression()

    def parameters(self) -> None:
        self.take("(")
        if self.maybe(")"):
            return
        while True:
            self.prefix()
            self.type()
            while self.t[self.i] == "@":
                self.annotation()
            self.maybe("...")
            if self.t[self.i] == "this":
                self.i += 1
            else:
                self.name()
                while self.maybe("."):
                    if self.t[self.i + 1] == ".":
                        self.name()
                    else:
                        self.take("this")
            self.dims()
            if self.maybe(")"):
                return
            self.take(",")

    def type(self) -> None:
        while self.t[self.i] == "@":
            self.annotation()
        if self.t[self.i] in self.primitive:
            self.i += 1
        else:
            while True:
                self.name()
                if self.t[self.i] == "<":
                    self.type_arguments()
                if self.t[self.i] == "." and (self.is_name(1) or self.t[self.i + 1] == "@"):
                    self.i += 1
                    while self.t[self.i] == "@":
                        self.annotation()
                else:
                    break
        self.dims()

    def type_arguments(self) -> None:
        self.take("<")
        if self.maybe(">"):
            return
        while True:
            while self.t[self.i] == "@":
                self.annotation()
            if self.maybe("?"):
                if self.t[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            if self.maybe(">"):
                return
            self.take(",")

    # statements

    def block(self) -> None:
        self.take("{")
        self.repeat(self.statement, "}")
        self.take("}")

    def statement(self) -> None:
        m = self.simple.match(self.s, self.i)
        if m:
            key = ("s", m.group())
            if key in self.good:
                self.i = m.end()
                return
            self.any_statement()
            if self.i == m.end():
                self.good.add(key)
        else:
            self.any_statement()

    def any_statement(self) -> None:
        t, k = self.t, self.t[self.i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k in ("if", "while"):
            self.i += 1
            self.header(self.expression)
            self.statement()
            if k == "if" and self.maybe("else"):
                self.statement()
        elif k == "for":
            self.i += 1
            self.header(self.for_header)
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.take("while")
            self.parens()
            self.take(";")
        elif k == "try":
            self.i += 1
            plain = True
            if self.maybe("("):
                plain = False
                while not self.maybe(")"):
                    if not self.attempt(self.local, True):
                        self.expression()
                    if self.t[self.i] != ")":
                        self.take(";")
            self.block()
            while self.maybe("catch"):
                plain = False
                self.header(self.caught)
                self.block()
            if self.maybe("finally"):
                plain = False
                self.block()
            if plain:
                self.fail("a try without catch or finally")
        elif k == "switch":
            self.switch()
            if self.t[self.i] in (".", "?", "+"):
                self.fail()
        elif k == "synchronized" and t[self.i + 1] == "(":
            self.i += 1
            self.header(self.expression)
            self.block()
        elif k == "return":
            self.i += 1
            if t[self.i] != ";":
                self.expression()
            self.take(";")
        elif k == "throw":
            self.i += 1
            self.expression()
            self.take(";")
        elif k in ("break", "continue"):
            self.i += 1
            if self.is_name():
                self.i += 1
            self.take(";")
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.maybe(":"):
                self.expression()
            self.take(";")
        elif k == "yield" and t[self.i + 1] not in ("=", ".", "(", "++", "--", "["):
            self.i += 1
            self.expression()
            self.take(";")
        elif k in ("else", "catch", "finally", "case"):
            self.fail()
        elif self.is_name() and t[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            at = self.i
            self.prefix()
            if self.is_type_word() and (self.i > at or k != "@"):
                self.i = at
                self.declaration()
                return
            moved = self.i > at
            self.i = at
            if moved or k in self.primitive and t[self.i + 1] not in (".", "::") or self.is_name():
                if self.attempt(self.local):
                    self.declarators()
                    self.take(";")
                    return
                if moved:
                    self.prefix()
                    self.type()
                    self.name()
            start = self.i
            self.expression()
            if not self.effect(start):
                raise Bad(start, "not a statement")
            self.take(";")

    def effect(self, start: int) -> bool:
        """An expression that stands alone must assign, call, count or create."""
        last, first = self.t[self.i - 1], self.t[start]
        if first in ("+", "-", "!", "~"):
            return False
        depth, angles = 0, 0
        for k in self.t[start : self.i]:
            if k in ("(", "[", "{"):
                depth += 1
            elif k in (")", "]", "}"):
                depth -= 1
            elif depth == 0:
                if k in self.assign or k == ">=" or k == "->":
                    angles = 0
                    break
                angles += (k == "<") - (k == ">")
                if k in self.binary and k not in ("<", ">"):
                    return False
        if angles:
            return False
        if last in (")", "++", "--") and first != "(" or first in ("++", "--", "new") or first == "(" and last == ")":
            return True
        depth = 0
        for k in self.t[start : self.i]:
            if k in "([{" and len(k) == 1:
                depth += 1
            elif k in ")]}" and len(k) == 1:
                depth -= 1
            elif depth == 0 and (k in self.assign or k == ">="):
                return True
        return last == "}"

    def local(self, resource: bool = False) -> None:
        self.prefix()
        self.type()
        self.name()
        if self.t[self.i] not in ("=", ";", ",", ":", "[") or self.t[self.i] == "[" and self.t[self.i + 1] != "]":
            self.fail()
        if resource:
            self.take("=")
            self.expression()

    def for_header(self) -> None:
        if self.attempt(self.local):
            if self.maybe(":"):
                self.expression()
                return
            self.declarators()
        elif self.t[self.i] != ";":
            self.expressions()
        self.take(";")
        if self.t[self.i] != ";":
            self.expression()
        self.take(";")
        if self.t[self.i] != ")":
            self.expressions()

    def expressions(self) -> None:
        self.expression()
        while self.maybe(","):
            self.expression()

    def caught(self) -> None:
        self.prefix()
        self.type()
        while self.maybe("|"):
            self.type()
        self.name()

    def switch(self) -> None:
        self.take("switch")
        self.parens()
        self.take("{")
        self.repeat(self.switch_part, "}")
        self.take("}")

    def switch_part(self) -> None:
        if self.t[self.i] in ("case", "default"):
            if not self.maybe("default"):
                self.i += 1
                while True:
                    if not self.maybe("default") and not self.attempt(self.pattern):
                        self.expression(1)
                    if self.maybe("when"):
                        self.expression()
                    if not self.maybe(","):
                        break
            if self.maybe("->"):
                if self.t[self.i] == "{":
                    self.block()
                elif self.t[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.take(";")
            else:
                self.take(":")
        else:
            self.statement()

    def pattern(self) -> None:
        self.prefix()
        self.type()
        if self.t[self.i] == "(":
            self.i += 1
            while not self.maybe(")"):
                self.pattern()
                if self.t[self.i] != ")":
                    self.take(",")
            if self.is_name():
                self.i += 1
        else:
            self.name()

    # expressions

    def operand(self, op: str) -> bool:
        if op != "instanceof":
            return False
        if not self.attempt(self.pattern):
            self.prefix()
            self.type()
        return True

    def unary(self) -> None:
        t = self.t
        while t[self.i] in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
        k = t[self.i]
        if k == "(":
            close = self.matching(self.i)
            if t[close + 1] == "->":
                self.lambda_parameters(close)
                self.lambda_body()
                return
            if self.attempt(self.cast):
                self.unary()
                return
            self.parens()
        elif (k == "id" or k in self.contextual) and t[self.i + 1] == "->":
            self.i += 1
            self.lambda_body()
            return
        elif k in ("id", "this", "super") or k in self.contextual:
            self.i += 1
            if k == "id" and t[self.i] in ("<", "[") and self.attempt(self.generic_reference):
                return self.postfix()
        elif k in ("str", "num", "true", "false", "null"):
            self.i += 1
        elif k == "new":
            self.created()
        elif k == "switch":
            self.switch()
        elif k in self.primitive or k == "void":
            self.i += 1
            self.dims()
            if t[self.i] == "::":
                pass
            else:
                self.take(".")
                self.take("class")
        else:
            self.fail()
        self.postfix()

    def generic_reference(self) -> None:
        if self.t[self.i] == "<":
            self.type_arguments()
        self.dims()
        if self.t[self.i] != "::" and not (self.t[self.i] == "." and self.t[self.i + 1] == "class" and self.t[self.i - 1] == "]"):
            self.fail()

    def postfix(self) -> None:
        t = self.t
        while True:
            k = t[self.i]
            if k == "(":
                if t[self.i - 1] not in ("id", "this", "super", ">") and t[self.i - 1] not in self.contextual:
                    self.fail()
                self.arguments()
            elif k == "." :
                self.i += 1
                if t[self.i] == "<":
                    self.type_arguments()
                if t[self.i] == "new":
                    self.created()
                elif t[self.i] in ("class", "this", "super"):
                    self.i += 1
                else:
                    self.name()
            elif k == "[":
                self.i += 1
                if self.maybe("]"):
                    self.dims()
                    if t[self.i] not in ("::", "."):
                        self.fail()
                    continue
                self.expression()
                self.take("]")
            elif k == "::":
                self.i += 1
                if t[self.i] == "<":
                    self.type_arguments()
                if not self.maybe("new"):
                    self.name()
            elif k in ("++", "--"):
                if t[self.i - 1] in ("num", "str") or t[self.i - 1] == ")":
                    self.fail()
                self.i += 1
            else:
                return

    def cast(self) -> None:
        self.take("(")
        primitive = self.t[self.i] in self.primitive and self.t[self.i + 1] != "["
        self.type()
        while self.maybe("&"):
            self.type()
        self.take(")")
        k = self.t[self.i]
        if not (k in ("id", "str", "num", "true", "false", "null", "this", "super", "new", "(", "!", "~", "switch") or k in self.contextual or k in self.primitive or primitive and k in ("+", "-", "++", "--")):
            self.fail()

    def lambda_parameters(self, close: int) -> None:
        at = self.i
        self.i += 1
        if self.t[self.i] == ")":
            self.i += 1
        elif all(k == "," or k == "id" or k in self.contextual or k == "_" for k in self.t[at + 1 : close]) and not any(a == b for a, b in zip(self.t[at + 1 : close], self.t[at + 2 : close])):
            self.i = close + 1
        else:
            self.i = at
            self.parameters()
        if self.i != close + 1:
            self.fail()

    def lambda_body(self) -> None:
        self.take("->")
        if self.t[self.i] == "{":
            self.block()
        else:
            self.expression()

    def created(self) -> None:
        self.take("new")
        while self.t[self.i] == "@":
            self.annotation()
        if self.t[self.i] in self.primitive:
            self.i += 1
        else:
            while True:
                self.name()
                if self.t[self.i] == "<":
                    self.type_arguments()
                if not self.maybe("."):
                    break
        if self.t[self.i] == "[":
            sized = False
            while self.t[self.i] == "[":
                self.i += 1
                if not self.maybe("]"):
                    if self.t[self.i - 2] == "]" and not sized:
                        self.fail()
                    sized = True
                    self.expression()
                    self.take("]")
            if self.t[self.i] == "{":
                if sized:
                    self.fail()
                self.initializer()
            elif not sized:
                self.fail("an array without size")
            return
        self.arguments()
        if self.t[self.i] == "{":
            self.names.append(None)
            self.body()
            self.names.pop()


class Json(Parser):
    words = frozenset(("true", "false", "null"))
    number = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
    lexer = re.compile(r"[ \t\r\n]*+(\"(?:\\[\"\\/bfnrt]|\\u[0-9a-fA-F]{4}|[^\"\\\x00-\x1f])*\"|-?\d(?:[\w.]|(?<=[eE])[+-])*|\w+|(?s:.)|\Z)")

    @classmethod
    def kind(cls, token: str) -> str:
        if token[0] == '"' and len(token) > 1:
            return "str"
        if token[0].isdigit() or token[0] == "-":
            return "num" if cls.number.fullmatch(token) else "err"
        return token if token in cls.words or token in ("{", "}", "[", "]", ",", ":") else "err"

    def file(self) -> None:
        """One value; brackets are kept on a stack, as values nest without bound. After an error, on from the next comma or bracket."""
        t, stack, held, i, want = self.t, [], {"}": 0, "]": 0}, 0, "value"
        while True:
            k = t[i]
            if want == "name":
                if k == "str" and t[i + 1] == ":":
                    i, want = i + 2, "value"
                    continue
                why = "expected a name and a colon"
            elif want == "value":
                if k in ("{", "["):
                    stack.append("}" if k == "{" else "]")
                    held[stack[-1]] += 1
                    i += 1
                    want = "end" if t[i] == stack[-1] else "name" if k == "{" else "value"
                    continue
                if k in ("str", "num", "true", "false", "null"):
                    i, want = i + 1, "end"
                    continue
                why = f"expected a value, found {k}"
            else:
                if stack and k == stack[-1]:
                    held[stack.pop()] -= 1
                    i += 1
                    continue
                if stack and k == ",":
                    i, want = i + 1, "name" if stack[-1] == "}" else "value"
                    continue
                if not stack and k == "eof":
                    return
                why = f"expected a comma or {stack[-1]}, found {k}" if stack else "more than one value"
            self.errors.append((i, why))
            at = i
            while t[i] not in ("{", "[", ",", "eof") and not held.get(t[i]):
                i += 1
            k = t[i]
            if k in ("{", "["):
                want = "value"
            elif k == ",":
                i, want = i + 1, "name" if stack and stack[-1] == "}" else "value"
                if not stack and t[i] == "eof":
                    return
            elif k == "eof":
                if stack and i > at:
                    self.errors.append((i, f"the file ends before {stack[-1]}"))
                return
            else:  # a bracket that closes this value or one around it
                while stack[-1] != k:
                    held[stack.pop()] -= 1
                want = "end"


@lru_cache(maxsize=1)
def languages() -> dict[str, type[Parser]]:
    from .csharp import CSharp
    from .javascript import JavaScript
    from .python_syntax import Python

    return {"java": Java, "json": Json, "cs": CSharp, "js": JavaScript, "py": Python}
