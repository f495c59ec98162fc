"""C# for problem 3."""

from __future__ import annotations

import re

from .syntax import _C_ASSIGN, _C_BINARY, Bad, Parser


_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(if|elif|else|endif|define|undef)\b([^\n]*)")
#: What may hold the sign of a directive without being one, or a directive at a line's start.
_PASSED = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|(?:@\$|\$@|@)\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|^[ \t]*#[ \t]*(?:if|elif|else|endif|define|undef)\b[^\n]*", re.S | re.M)


class _Condition:
    """The value of a directive's condition; ValueError if it is none."""

    def __init__(self, text: str, symbols: set[str]) -> None:
        text = text.split("//", 1)[0]
        self.t, self.i, self.symbols = [*re.findall(r"\w+|&&|\|\||==|!=|\S", text), ""], 0, symbols

    def value(self) -> bool:
        out = self.level(0)
        if self.t[self.i]:
            raise ValueError
        return out

    def level(self, k: int) -> bool:
        ops = (("||",), ("&&",), ("==", "!="))
        if k == len(ops):
            return self.unary()
        out = self.level(k + 1)
        while self.t[self.i] in ops[k]:
            op = self.t[self.i]
            self.i += 1
            other = self.level(k + 1)
            out = out or other if op == "||" else out and other if op == "&&" else (out == other) == (op == "==")
        return out

    def unary(self) -> bool:
        word = self.t[self.i]
        self.i += 1
        if word == "!":
            return not self.unary()
        if word == "(":
            out = self.level(0)
            if self.t[self.i] != ")":
                raise ValueError
            self.i += 1
            return out
        if not word.isidentifier():
            raise ValueError
        return word == "true" or word != "false" and word in self.symbols


def sections(text: str) -> tuple[str, str]:
    """(the text with what its conditional sections leave out blanked, so that lines stay; what is wrong with the directives).

    Only the symbols that the file defines are defined, as in a build without options."""
    out, symbols, at, why = [], set(), 0, ""
    open_: list[tuple[bool, bool, bool]] = []  # (is this section read, has one been, was #else met); those around it are read
    n = len(text)
    while at < n and not why:
        reading = all(x[0] for x in open_)
        if reading:
            m = _PASSED.search(text, at)
            if not m:
                break
            out.append(text[at : m.start()])
            if not (d := _DIRECTIVE.fullmatch(m.group())):
                out.append(m.group())
                at = m.end()
                continue
            at = m.end()
        else:
            end = text.find("\n", at)
            end = n if end < 0 else end
            d = _DIRECTIVE.fullmatch(text, at, end)
            at = min(n, end + 1)
            if not d:
                out.append("\n" if end < n else "")
                continue
            if end < n:
                out.append("\n")
        word, rest = d[1], d[2].rstrip("\r")
        try:
            if word == "if":
                value = reading and _Condition(rest, symbols).value()
                open_.append((value, value or not reading, False))
            elif word in ("define", "undef"):
                if reading:
                    (symbols.add if word == "define" else symbols.discard)(rest.strip())
            elif not open_ or open_[-1][2] and word != "endif":
                why = f"#{word} without its beginning"
            elif word == "endif":
                open_.pop()
            else:
                _, done, _ = open_[-1]
                value = not done and (word == "else" or _Condition(rest, symbols).value())
                open_[-1] = (value, done or value, word == "else")
        except ValueError:
            why = f"#{word} without a condition"
    if open_ and not why:
        why = "#if without its end"
    return "".join(out) + text[at:], why


class CSharp(Parser):
    # The words of the language.
    words = frozenset("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split())
    contextual = frozenset("add alias and ascending async await by descending dynamic equals field file from get global group init into join let nameof not on or orderby partial record remove required scoped select set unmanaged value var when where with yield nint nuint".split())
    predefined = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort".split())
    modifiers = frozenset("abstract async const extern file internal new override partial private protected public readonly required sealed static unsafe virtual volatile fixed".split())
    number = re.compile(r"0[xX][0-9a-fA-F_]+(?:[uU]?[lL]|[lL]?[uU])?|0[bB][01_]+(?:[uU]?[lL]|[lL]?[uU])?|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?(?:[fFdDmM]|[uU]?[lL]|[lL]?[uU])?")
    lexer = re.compile(
        r"(?:\s+|//[^\n]*|(?s:/\*.*?\*/)|#[ \t]*(?:region|endregion|if|else|elif|endif|pragma|nullable|define|undef|line|warning|error)\b[^\n]*)*+"
        r"(@?(?:[^\W\d])\w*|\d(?:\.(?=\d)|\w|(?<=[eE])[+-])*|\.\d(?:\w|(?<=[eE])[+-])*"
        r"|\$*\"\"\"(?!\")(?s:.*?)\"\"\"|(?:@\$|\$@)\"(?:\"\"|[^\"])*\"|@\"(?:\"\"|[^\"])*\"|\$\"(?:\\.|\{\{|\}\}|\{[^{}\"\n]*(?:\"(?:\\.|[^\"\\\n])*\"[^{}\"\n]*|\{[^{}\n]*\}[^{}\"\n]*)*\}|[^\"\\{}\r\n])*\"|\"(?:\\[abefnrtv0'\"\\xuU]|[^\"\\\r\n])*\"(?:u8)?|'(?:\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{1,4}|U[0-9a-fA-F]{8}|[abefnrtv0'\"\\])|[^'\\\r\n])'"
        r"|/\*|=>|\.\.|->|::|\+\+|--|&&|\|\||\?\?=?|\?\.(?!\d)|[=!<>+\-*/%&|^]=|<<=?|\S|\Z)"
    )
    binary = _C_BINARY | {"??": 2, "is": 9, "as": 9, "..": 16, "switch": 17, "with": 17}
    assign = _C_ASSIGN | {"??="}

    def __init__(self, text: str) -> None:
        self.directives = ""
        if "#" in text and re.search(r"(?m)^[ \t]*#[ \t]*(?:if|elif|else|endif)\b", text):
            text, self.directives = sections(text)
        super().__init__(text)

    @classmethod
    def kind(cls, token: str) -> str:
        c = token[0]
        if c == "@" and len(token) > 1 and (token[1].isalpha() or token[1] == "_"):
            return "id"
        if c == "$" or c == "@":
            if len(token) < 3:
                return "err"
            if '"""' in token[:6] or token[:2] in ("@\"",):
                return "str"
            return "str" if cls.holes(token) else "err"
        return super().kind(token)

    @classmethod
    def other(cls, token: str) -> str:
        return "str" if len(token) > 1 and token[0] in "\"'" else super().other(token)

    @classmethod
    def holes(cls, token: str) -> bool:
        """The expressions within an interpolated string parse."""
        body = token[token.index('"') + 1 : -1].replace("{{", "").replace("}}", "")
        for m in re.finditer(r"\{((?:[^{}]|\{[^{}]*\})*)\}", body):
            inner = re.sub(r"(?<![?:]):(?![:?])[^:?\"()]*$", "", m.group(1)) if "?" not in m.group(1) else m.group(1)
            p = cls(inner.replace('""', '"') if token.startswith(("@$", "$@")) else inner)
            try:
                p.expression()
                if p.maybe(","):
                    p.expression()
                if p.t[p.i] != "eof":
                    return False
            except Bad:
                return False
        return re.sub(r"\{((?:[^{}]|\{[^{}]*\})*)\}", "", body).count("{") == 0

    def check(self) -> list[tuple[int, str]]:
        errors = super().check()
        if self.directives:
            errors.append((len(self.t) - 4, self.directives))
        if not errors and "#region" in self.text:
            depth = 0
            for m in re.finditer(r"(?m)^[ \t]*#[ \t]*(region|endregion)\b", self.text):
                depth += 1 if m.group(1) == "region" else -1
                if depth < 0:
                    break
            if depth:
                errors.append((len(self.t) - 4, "a region without its end"))
        return errors

    # ---------------------------------------------------------------- declarations

    def file(self) -> None:
        self.repeat(self.top, "eof")

    def top(self) -> None:
        t, k = self.t, self.t[self.i]
        if k == ";":
            self.i += 1
        elif k == "using" and t[self.i + 1] != "(" and not (t[self.i + 1] == "var"):
            self.remembered("using", self.using, self.simple)
        elif k == "global" and t[self.i + 1] == "using":
            self.i += 1
            self.using()
        elif k == "namespace":
            self.i += 1
            self.dotted()
            if self.maybe(";"):
                return
            self.take("{")
            self.repeat(self.top, "}")
            self.take("}")
            self.maybe(";")
        elif k == "extern" and t[self.i + 1] == "alias":
            self.i += 2
            self.name()
            self.take(";")
        elif k == "[" and t[self.i + 2] == ":":
            self.attribute()
        elif self.starts_type():
            self.type_declaration()
        else:
            self.statement()

    def using(self) -> None:
        self.take("using")
        self.maybe("static")
        if self.is_name() and self.t[self.i + 1] == "=":
            self.i += 2
            self.type()
        else:
            self.dotted()
            if self.t[self.i] == "<":
                self.type_arguments()
        self.take(";")

    def dotted(self) -> None:
        self.name()
        while self.t[self.i] in (".", "::"):
            self.i += 1
            self.name()

    def attribute(self) -> None:
        self.take("[")
        if self.t[self.i + 1] == ":":
            self.i += 2
        while True:
            self.type()
            if self.t[self.i] == "(":
                self.i += 1
                while not self.maybe(")"):
                    if self.is_name() and self.t[self.i + 1] in ("=", ":"):
                        self.i += 2
                    self.expression()
                    if self.t[self.i] != ")":
                        self.take(",")
            if self.maybe("]"):
                return
            self.take(",")
            if self.maybe("]"):
                return

    def prefix(self) -> None:
        t = self.t
        while t[self.i] == "[":
            self.attribute()
        while t[self.i] in self.modifiers or t[self.i] == "ref" and t[self.i + 1] in ("struct", "partial"):
            k = t[self.i]
            if k in self.contextual and not (t[self.i + 1] in self.words and t[self.i + 1] not in ("in", "is", "as") or self.is_name(1) or t[self.i + 1] == "("):
                return
            if k in ("async", "partial", "file", "required") and t[self.i + 1] in ("=", ";", ",", ".", "("):
                return
            self.i += 1

    def starts_type(self) -> bool:
        at = self.i
        try:
            self.prefix()
            k = self.t[self.i]
            return k in ("class", "struct", "interface", "enum", "delegate") and not (k == "delegate" and self.t[self.i + 1] in ("(", "{", "*")) or k == "record" and (self.is_name(1) or self.t[self.i + 1] in ("class", "struct"))
        except Bad:
            return False
        finally:
            self.i = at

    def type_declaration(self) -> None:
        self.prefix()
        word = self.t[self.i]
        self.i += 1
        if word == "record" and self.t[self.i] in ("class", "struct"):
            self.i += 1
        if word == "delegate":
            self.return_type()
            self.name()
            if self.t[self.i] == "<":
                self.type_parameters()
            self.parameters()
            self.constraints()
            self.take(";")
            return
        self.name()
        if self.t[self.i] == "<":
            self.type_parameters()
        if self.t[self.i] == "(":
            self.parameters()
        if self.maybe(":"):
            while True:
                self.type()
                if self.t[self.i] == "(":
                    self.arguments()
                if not self.maybe(","):
                    break
        self.constraints()
        if word in ("record", "class", "struct", "interface") and self.maybe(";"):
            return
        self.take("{")
        if word == "enum":
            while not self.maybe("}"):
                while self.t[self.i] == "[":
                    self.attribute()
                self.name()
                if self.maybe("="):
                    self.expression()
                if self.t[self.i] != "}":
                    self.take(",")
        else:
            self.repeat(self.member, "}")
            self.take("}")
        self.maybe(";")

    def type_parameters(self) -> None:
        self.take("<")
        while True:
            while self.t[self.i] == "[":
                self.attribute()
            if self.t[self.i] in ("in", "out"):
                self.i += 1
            self.name()
            if self.maybe(">"):
                return
            self.take(",")

    def constraints(self) -> None:
        while self.maybe("where"):
            self.name()
            self.take(":")
            while True:
                if self.t[self.i] in ("class", "struct", "default", "unmanaged"):
                    self.i += 1
                    self.maybe("?")
                elif self.t[self.i] == "new":
                    self.i += 1
                    self.take("(")
                    self.take(")")
                else:
                    self.type()
                if not self.maybe(","):
                    break

    def member(self) -> None:
        if self.maybe(";"):
            return
        h = self.heading.match(self.s, self.i)
        if h and ("method", h.group()) in self.good:
            self.i = h.end() - 1
            self.block()
            return
        m = self.simple.match(self.s, self.i)
        if m and ("member", m.group()) in self.good:
            self.i = m.end()
            return
        if self.starts_type():
            self.type_declaration()
            return
        start = self.i
        self.prefix()
        t = self.t
        if t[self.i] == "~":
            self.i += 1
            self.name()
            self.take("(")
            self.take(")")
            self.method_body()
        elif t[self.i] in ("implicit", "explicit"):
            self.i += 1
            self.take("operator")
            self.maybe("checked")
            self.type()
            self.parameters()
            self.method_body()
        elif t[self.i] == "event":
            self.i += 1
            self.type()
            self.dotted()
            if t[self.i] == "{":
                self.accessors()
            else:
                self.declarators()
                self.take(";")
        elif self.is_name() and t[self.i + 1] == "(" and not (self.t[self.i] == "async"):
            self.i += 1
            self.parameters()
            if self.maybe(":"):
                if t[self.i] not in ("base", "this"):
                    self.fail()
                self.i += 1
                self.arguments()
            self.method_body(h, start)
        else:
            self.return_type()
            if t[self.i] == "operator":
                self.i += 1
                self.maybe("checked")
                if t[self.i] == ">":
                    while self.maybe(">") or self.maybe(">="):
                        pass
                elif t[self.i] in ("true", "false", "+", "-", "!", "~", "++", "--", "*", "/", "%", "&", "|", "^", "<<", "==", "!=", "<", "<=", ">="):
                    self.i += 1
                else:
                    self.fail()
                self.parameters()
                self.method_body()
                return
            if t[self.i] == "this":
                self.i += 1
                self.indexer()
                return
            self.name()
            while True:
                if t[self.i] == "<":
                    self.type_parameters() if self.attempt(self.type_parameters_ahead) else self.type_arguments()
                if t[self.i] in (".", "::"):
                    self.i += 1
                    if t[self.i] == "this":
                        self.i += 1
                        self.indexer()
                        return
                    self.name()
                else:
                    break
            if t[self.i] == "(":
                self.parameters()
                self.constraints()
                self.method_body(h, start)
            elif t[self.i] == "{":
                self.accessors()
                if self.maybe("="):
                    self.initializer()
                    self.take(";")
            elif t[self.i] == "=>":
                self.i += 1
                self.expression()
                self.take(";")
            else:
                self.maybe("[") and (self.expression(), self.take("]"))
                self.declarators()
                self.take(";")
                if m and self.i == m.end():
                    self.good.add(("member", m.group()))

    def type_parameters_ahead(self) -> None:
        at = self.i
        self.type_parameters()
        if self.t[self.i] not in ("(",):
            self.fail()
        self.i = at

    def indexer(self) -> None:
        self.take("[")
        self.parameter_list("]")
        if self.t[self.i] == "=>":
            self.i += 1
            self.expression()
            self.take(";")
        else:
            self.accessors()

    def accessors(self) -> None:
        self.take("{")
        n = 0
        while not self.maybe("}"):
            while self.t[self.i] == "[":
                self.attribute()
            while self.t[self.i] in ("private", "protected", "internal", "public", "readonly", "static"):
                self.i += 1
            if self.t[self.i] not in ("get", "set", "init", "add", "remove"):
                self.fail()
            self.i += 1
            n += 1
            self.method_body()
        if not n:
            self.fail("a property without accessors")

    def method_body(self, heading: re.Match | None = None, start: int = 0) -> None:
        if self.t[self.i] == "=>":
            self.i += 1
            self.expression()
            self.take(";")
        elif not self.maybe(";"):
            if self.t[self.i] != "{":
                self.fail()
            if heading and self.i == heading.end() - 1:
                self.good.add(("method", heading.group()))
            self.block()
            self.maybe(";")

    def return_type(self) -> None:
        if self.t[self.i] == "void" and self.t[self.i + 1] != "*":
            self.i += 1
            return
        if self.maybe("ref"):
            self.maybe("readonly")
        self.type()

    def declarators(self) -> None:
        while True:
            if self.maybe("="):
                self.initializer()
            if not self.maybe(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.t[self.i] == "{":
            self.braced()
        else:
            self.expression()

    def braced(self) -> None:
        """A collection's or object's initializer."""
        self.take("{")
        while not self.maybe("}"):
            if self.t[self.i] == "{":
                self.braced()
            else:
                if self.t[self.i] == "[":
                    self.i += 1
                    self.expressions()
                    self.take("]")
                    self.take("=")
                    self.initializer()
                elif self.is_name() and self.t[self.i + 1] == "=":
                    self.i += 2
                    self.initializer()
                else:
                    self.expression()
            if self.t[self.i] != "}":
                self.take(",")

    def parameters(self) -> None:
        self.take("(")
        self.parameter_list(")")

    def parameter_list(self, end: str) -> None:
        if self.maybe(end):
            return
        while True:
            while self.t[self.i] == "[":
                self.attribute()
            while self.t[self.i] in ("ref", "out", "in", "params", "this", "readonly") or self.t[self.i] == "scoped" and self.is_name(1):
                self.i += 1
            self.type()
            self.name()
            if self.maybe("="):
                self.expression()
            if self.maybe(end):
                return
            self.take(",")

    # ---------------------------------------------------------------- types

    def type(self, plain: bool = False) -> None:
        """plain: without a question mark behind, as an expression may go on with one."""
        t = self.t
        if t[self.i] in self.predefined:
            self.i += 1
        elif t[self.i] == "void" and t[self.i + 1] == "*":
            self.i += 1
        elif t[self.i] == "(":
            self.i += 1
            n = 0
            while True:
                self.type()
                if self.is_name():
                    self.i += 1
                n += 1
                if self.maybe(")"):
                    break
                self.take(",")
            if n < 2:
                self.fail()
        else:
            while True:
                self.name()
                if t[self.i] == "<":
                    self.type_arguments()
                if t[self.i] in (".", "::") and self.is_name(1):
                    self.i += 1
                else:
                    break
        while True:
            if t[self.i] == "?" and not plain:
                self.i += 1
            elif t[self.i] == "*" and not plain:
                self.i += 1
            elif t[self.i] == "[" and t[self.i + 1] in ("]", ","):
                k = self.i + 1
                while t[k] == ",":
                    k += 1
                if t[k] != "]":
                    return
                self.i = k + 1
            else:
                return

    def type_arguments(self) -> None:
        self.take("<")
        if self.t[self.i] in (",", ">"):
            while self.maybe(","):
                pass
            self.take(">")
            return
        while True:
            self.type()
            if self.maybe(">"):
                return
            self.take(",")

    # ---------------------------------------------------------------- statements

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
        elif k in ("if", "while", "lock"):
            self.i += 1
            self.header(self.expression)
            self.statement()
            if k == "if" and self.maybe("else"):
                self.statement()
        elif k == "for":
            self.i += 1
            self.header(self.for_header)
            self.statement()
        elif k == "foreach" or k == "await" and t[self.i + 1] == "foreach":
            self.maybe("await")
            self.i += 1
            self.header(self.foreach_header)
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.take("while")
            self.parens()
            self.take(";")
        elif k == "try":
            self.i += 1
            self.block()
            plain = True
            while self.maybe("catch"):
                plain = False
                if self.t[self.i] == "(":
                    self.header(self.caught) if t[self.matching(self.i) + 1] == "{" else self.parens(self.caught)
                if self.maybe("when"):
                    self.parens()
                self.block()
            if self.maybe("finally"):
                plain = False
                self.block()
            if plain:
                self.fail("a try without catch or finally")
        elif k == "switch" and t[self.i + 1] == "(":
            self.i += 1
            self.parens(self.expressions)
            self.take("{")
            self.repeat(self.switch_part, "}")
            self.take("}")
        elif k == "using" or k == "await" and t[self.i + 1] == "using":
            self.maybe("await")
            self.i += 1
            if self.t[self.i] == "(":
                self.header(self.resource)
                self.statement()
            else:
                self.local()
                self.declarators()
                self.take(";")
        elif k == "fixed" and t[self.i + 1] == "(":
            self.i += 1
            self.parens(self.resource)
            self.statement()
        elif k in ("checked", "unchecked", "unsafe") and t[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif k == "return":
            self.i += 1
            if t[self.i] != ";":
                self.maybe("ref")
                self.expression()
            self.take(";")
        elif k == "throw":
            self.i += 1
            if t[self.i] != ";":
                self.expression()
            self.take(";")
        elif k in ("break", "continue"):
            self.i += 1
            self.take(";")
        elif k == "goto":
            self.i += 1
            if self.maybe("case"):
                self.expression()
            elif not self.maybe("default"):
                self.name()
            self.take(";")
        elif k == "yield" and t[self.i + 1] in ("return", "break"):
            self.i += 2
            if t[self.i - 1] == "return":
                self.expression()
            self.take(";")
        elif k in ("else", "catch", "finally", "case"):
            self.fail()
        elif self.is_name() and t[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            at = self.i
            if k == "const":
                self.i += 1
                self.local()
                self.declarators()
                self.take(";")
                return
            if self.attempt(self.local_function):
                self.method_body()
                return
            self.i = at
            if self.attempt(self.local):
                self.declarators()
                self.take(";")
                return
            self.expression()
            if not self.effect(at):
                raise Bad(at, "not a statement")
            self.take(";")

    def effect(self, start: int) -> bool:
        """An expression that stands alone must assign, call, count, create or await."""
        first, last = self.t[start], self.t[self.i - 1]
        if first in ("+", "-", "!", "~", "&"):
            return False
        depth, angles = 0, 0
        for k in self.t[start : self.i]:
            if k in ("(", "[", "{"):
                depth += 1
            elif k in (")", "]", "}"):
                depth -= 1
            elif depth == 0:
                if k in self.assign or k in (">=", "=>"):
                    return True
                angles += (k == "<") - (k == ">")
                if k in self.binary and k not in ("<", ">", "switch", "with"):
                    return False
        if angles:
            return False
        return first in ("await", "new", "++", "--") or last in ("++", "--", "!") or last == ")" and (first != "(" or self.matching(start) < self.i - 1)

    def local_function(self) -> None:
        t = self.t
        while t[self.i] == "[":
            self.attribute()
        while t[self.i] in ("static", "async", "unsafe", "extern"):
            self.i += 1
        self.return_type()
        self.name()
        if t[self.i] == "<":
            self.type_parameters()
        self.parameters()
        self.constraints()
        if t[self.i] not in ("{", "=>"):
            self.fail()

    def local(self) -> None:
        self.maybe("scoped")
        if self.maybe("ref"):
            self.maybe("readonly")
        if self.t[self.i] == "var" and self.t[self.i + 1] == "(":
            self.i = self.matching(self.i + 1) + 1
        else:
            self.type()
            self.name()
        if self.t[self.i] not in ("=", ";", ",", "in", ")"):
            self.fail()

    def resource(self) -> None:
        if self.attempt(self.local):
            self.declarators()
        else:
            self.expression()

    def for_header(self) -> None:
        if self.t[self.i] != ";":
            if self.attempt(self.local):
                self.declarators()
            else:
                self.expressions()
        self.take(";")
        if self.t[self.i] != ";":
            self.expression()
        self.take(";")
        if self.t[self.i] != ")":
            self.expressions()

    def foreach_header(self) -> None:
        if not self.attempt(self.foreach_local):
            self.expression()
        self.take("in")
        self.expression()

    def foreach_local(self) -> None:
        self.local()
        if self.t[self.i] != "in":
            self.fail()

    def expressions(self) -> None:
        self.expression()
        while self.maybe(","):
            self.expression()

    def caught(self) -> None:
        self.type()
        if self.is_name():
            self.i += 1

    def switch_part(self) -> None:
        if self.maybe("default"):
            self.take(":")
        elif self.maybe("case"):
            self.pattern()
            if self.maybe("when"):
                self.expression()
            self.take(":")
        else:
            self.statement()

    # ---------------------------------------------------------------- patterns

    def pattern(self) -> None:
        self.pattern_unit()
        while self.t[self.i] in ("or", "and"):
            self.i += 1
            self.pattern_unit()

    def pattern_unit(self) -> None:
        t = self.t
        if t[self.i] == "not":
            self.i += 1
            self.pattern_unit()
            return
        if t[self.i] in ("<", ">", "<=", ">="):
            self.i += 1
            self.expression(10)
            return
        if t[self.i] == "var" and (self.is_name(1) or t[self.i + 1] == "("):
            self.i += 1
            if t[self.i] == "(":
                self.i = self.matching(self.i) + 1
            else:
                self.name()
            return
        if t[self.i] == "[":
            self.i += 1
            while not self.maybe("]"):
                if self.maybe(".."):
                    if t[self.i] not in (",", "]"):
                        self.pattern()
                else:
                    self.pattern()
                if t[self.i] != "]":
                    self.take(",")
            return
        at = self.i
        if t[self.i] not in ("(", "{") and (t[self.i] in self.predefined or self.is_name()) and self.attempt(self.type, True):
            if t[self.i] == "?" and t[self.i + 1] not in ("id",):
                self.i += 1
            if t[self.i] in ("(", "{") or self.is_name() and t[self.i] not in ("or", "and", "when"):
                pass
            elif t[self.i] in (")", "or", "and", "when", ":", "=>", ",", ";", "&&", "||", "?", "}", "]", "==", "!="):
                return
            else:
                self.i = at
                self.expression(10)
                return
        elif t[self.i] not in ("(", "{"):
            self.expression(10)
            return
        if t[self.i] == "(":
            self.i += 1
            while not self.maybe(")"):
                if self.is_name() and t[self.i + 1] == ":":
                    self.i += 2
                self.pattern()
                if t[self.i] != ")":
                    self.take(",")
        if t[self.i] == "{":
            self.i += 1
            while not self.maybe("}"):
                self.dotted()
                self.take(":")
                self.pattern()
                if t[self.i] != "}":
                    self.take(",")
        if self.is_name() and t[self.i] not in ("or", "and", "when"):
            self.i += 1

    # ---------------------------------------------------------------- expressions

    def operand(self, op: str) -> bool:
        t = self.t
        if op == "is":
            self.pattern()
            return True
        if op == "as":
            self.type(True)
            return True
        if op == "..":
            if t[self.i] in (")", "]", ",", ";"):
                return True
            return False
        if op == "with":
            self.braced()
            return True
        if op == "switch":
            self.take("{")
            while not self.maybe("}"):
                self.pattern()
                if self.maybe("when"):
                    self.expression()
                self.take("=>")
                self.expression()
                if t[self.i] != "}":
                    self.take(",")
            return True
        if op == "??" and t[self.i] == "throw":
            self.i += 1
            self.expression()
            return True
        return False

    def argument(self) -> None:
        t = self.t
        if self.is_name() and t[self.i + 1] == ":" and t[self.i + 2] != ":":
            self.i += 2
        if t[self.i] in ("ref", "out", "in"):
            self.i += 1
            at = self.i
            try:
                self.type()
                self.name()
                if t[self.i] in (",", ")"):
                    return
            except Bad:
                pass
            self.i = at
        self.expression()

    def unary(self) -> None:
        t = self.t
        while t[self.i] in ("+", "-", "!", "~", "++", "--", "^", "&", "*") or t[self.i] == "await" and (self.is_name(1) or t[self.i + 1] in ("(", "this", "base", "new")):
            self.i += 1
        k = t[self.i]
        if k == "throw":
            self.i += 1
            self.expression()
            return
        if k in ("async", "static") and (t[self.i + 1] in ("(", "async", "delegate", "static") or self.is_name(1) and t[self.i + 2] == "=>"):
            self.i += 1
            self.unary()
            return
        if k == "..":
            self.i += 1
            if t[self.i] not in (")", "]", ",", ";"):
                self.unary()
            return
        if k == "(":
            close = self.matching(self.i)
            if t[close + 1] == "=>":
                self.lambda_parameters(close)
                self.lambda_body()
                return
            if self.attempt(self.cast):
                self.unary()
                return
            self.i += 1
            while True:
                if self.is_name() and t[self.i + 1] == ":":
                    self.i += 2
                if not self.attempt(self.deconstructed):
                    self.expression()
                if not self.maybe(","):
                    break
            self.take(")")
        elif self.is_name() and t[self.i + 1] == "=>":
            self.i += 1
            self.lambda_body()
            return
        elif k == "from" and self.is_name(1) and t[self.i + 1] != "=" and self.attempt(self.query):
            return
        elif self.is_name():
            self.i += 1
            if t[self.i] == "::":
                self.i += 1
                self.name()
            if t[self.i] == "<":
                self.attempt(self.generic)
        elif k in ("this", "base", "str", "num", "true", "false", "null"):
            self.i += 1
        elif k in self.predefined:
            self.i += 1
            if t[self.i] not in (".",):
                self.fail()
        elif k == "new":
            self.created()
        elif k in ("typeof", "sizeof"):
            self.i += 1
            self.take("(")
            self.maybe("void") or self.type()
            self.take(")")
        elif k in ("checked", "unchecked"):
            self.i += 1
            self.parens()
        elif k == "default":
            self.i += 1
            if self.maybe("("):
                self.type()
                self.take(")")
        elif k == "stackalloc":
            self.i += 1
            if t[self.i] != "[":
                self.type(True)
            self.take("[")
            if t[self.i] != "]":
                self.expression()
            self.take("]")
            if t[self.i] == "{":
                self.braced()
        elif k == "delegate":
            self.i += 1
            if t[self.i] == "(":
                self.parameters()
            self.block()
        elif k == "[":
            self.i += 1
            while not self.maybe("]"):
                self.maybe("..")
                self.expression()
                if t[self.i] != "]":
                    self.take(",")
        else:
            self.fail()
        self.postfix()

    def deconstructed(self) -> None:
        self.type()
        self.name()
        if self.t[self.i] not in (",", ")"):
            self.fail()

    def generic(self) -> None:
        self.type_arguments()
        if self.t[self.i] not in ("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!=", "|", "^", "&&", "||", "&", "[", "eof", "{", "?."):
            self.fail()

    def query(self) -> None:
        t = self.t
        n = 0
        while True:
            k = t[self.i]
            if k == "from":
                self.i += 1
                if t[self.i + 1] != "in":
                    self.type()
                self.name()
                self.take("in")
                self.expression()
            elif k == "where":
                self.i += 1
                self.expression()
            elif k == "let":
                self.i += 1
                self.name()
                self.take("=")
                self.expression()
            elif k == "join":
                self.i += 1
                if t[self.i + 1] != "in":
                    self.type()
                self.name()
                self.take("in")
                self.expression()
                self.take("on")
                self.expression()
                self.take("equals")
                self.expression()
                if self.maybe("into"):
                    self.name()
            elif k == "orderby":
                self.i += 1
                while True:
                    self.expression()
                    if t[self.i] in ("ascending", "descending"):
                        self.i += 1
                    if not self.maybe(","):
                        break
            elif k in ("select", "group"):
                self.i += 1
                self.expression()
                if k == "group":
                    self.take("by")
                    self.expression()
                if not self.maybe("into"):
                    return
                self.name()
            else:
                self.fail()
            n += 1

    def postfix(self) -> None:
        t = self.t
        while True:
            k = t[self.i]
            if k == "(":
                if t[self.i - 1] in ("num", "str", "true", "false", "null"):
                    self.fail()
                self.arguments()
            elif k in (".", "?.", "->"):
                self.i += 1
                self.name()
                if t[self.i] == "<":
                    self.attempt(self.generic)
            elif k == "[" or k == "?" and t[self.i + 1] == "[" and self.attempt(self.maybe_index):
                if k == "[":
                    self.index()
            elif k in ("++", "--"):
                if t[self.i - 1] in ("num", "str"):
                    self.fail()
                self.i += 1
            elif k == "!" and t[self.i + 1] in (".", ")", ";", ",", "[", "]", "}", "?.", "==", "!=", "=", "??", "?", "&&", "||", ":", "(", "=>"):
                self.i += 1
            else:
                return

    def maybe_index(self) -> None:
        self.take("?")
        self.index()
        if self.t[self.i] == ":":
            self.fail()

    def index(self) -> None:
        self.take("[")
        while True:
            self.argument()
            if self.maybe("]"):
                return
            self.take(",")

    def cast(self) -> None:
        self.take("(")
        simple = self.t[self.i] in self.predefined
        self.type()
        self.take(")")
        k = self.t[self.i]
        if not (k in ("str", "num", "true", "false", "null", "this", "base", "new", "(", "!", "~", "typeof", "default", "sizeof", "stackalloc", "checked") or self.is_name() and k not in ("or", "and", "when", "with", "equals", "by", "on", "into", "select", "where", "orderby", "ascending", "descending") or k in self.predefined or simple and k in ("+", "-", "++", "--", "[", "&", "*")):
            self.fail()

    def lambda_parameters(self, close: int) -> None:
        t = self.t
        at = self.i
        inner = t[at + 1 : close]
        if all(k == "," or k == "id" or k in self.contextual for k in inner) and (not inner or len(inner) % 2 and all((k == ",") == bool(j % 2) for j, k in enumerate(inner))):
            self.i = close + 1
        else:
            self.parameters()
        if self.i != close + 1:
            self.fail()

    def lambda_body(self) -> None:
        self.take("=>")
        if self.t[self.i] == "{":
            self.block()
        else:
            self.maybe("ref")
            self.expression()

    def created(self) -> None:
        t = self.t
        self.take("new")
        if t[self.i] == "(":
            self.arguments()
            if t[self.i] == "{":
                self.braced()
            return
        if t[self.i] == "{":
            self.i += 1
            while not self.maybe("}"):
                if self.is_name() and t[self.i + 1] == "=":
                    self.i += 2
                self.expression()
                if t[self.i] != "}":
                    self.take(",")
            return
        if t[self.i] == "[":
            self.i += 1
            while self.maybe(","):
                pass
            self.take("]")
            self.braced()
            return
        self.type(True)
        if self.maybe("?"):
            pass
        if t[self.i] == "(":
            self.arguments()
            if t[self.i] == "{":
                self.braced()
        elif t[self.i] == "[":
            self.index()
            while t[self.i] == "[":
                self.i += 1
                while self.maybe(","):
                    pass
                self.take("]")
            if t[self.i] == "{":
                self.braced()
        elif t[self.i] == "{":
            self.braced()
        else:
            self.fail()

