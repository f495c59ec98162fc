"""JavaScript, as a script or a module, for problem 3."""

from __future__ import annotations

import re

from .syntax import _C_ASSIGN, _C_BINARY, Bad, Parser, lines_of

#: Regular expressions, which only what stands before them tells from a division, become plain strings beforehand.
_REGEX_HINT = re.compile(r"(?:[(,=:\[!&|?{};+\-*%<>~^\n]|\b(?:return|typeof|case|in|of))[ \t]*/(?![/*])")
_REGEX = re.compile(
    r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*[\s\S]*?\*/)"
    r"|((?:[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do|yield|await))[ \t\r\n]*|^[ \t]*)(/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/(?:[dgimsuvy]*)(?![\w$]))",
    re.S | re.M,
)


def _pattern(literal: str) -> bool:
    """A regular expression's groups are closed, nothing is repeated that isn't there, and no flag stands twice."""
    body, flags = literal[1:].rsplit("/", 1)
    body = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "a", body)
    body = re.sub(r"\(\?(?::|=|!|<=|<!|<[\w$]+>|[ims]*(?:-[ims]+)?:)", "(", body)
    depth = 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return not depth and not re.search(r"(?:^|[(|])[*+?]", body) and len(set(flags)) == len(flags) and not {"u", "v"} <= set(flags)


class JavaScript(Parser):
    # The words of the language.
    words = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
    contextual = frozenset("as async await from get let of set static yield".split())
    number = re.compile(r"0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|0[0-7]+|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?")
    lexer = re.compile(
        r"((?:\s+|//[^\n]*|(?s:/\*.*?\*/))*+)"
        r"([#]?(?:[^\W\d]|[$])[\w$]*|\d(?:[\w.]|(?<=[eE])[+-])*|\.\d(?:\w|(?<=[eE])[+-])*|\"(?:\\(?:\r\n|(?s:.))|[^\"\\\r\n])*\"|'(?:\\(?:\r\n|(?s:.))|[^'\\\r\n])*'|`(?:\\(?s:.)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`"
        r"|/\*|\.\.\.|=>|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|>>>=?|>>=?|<<=?|===|!==|\+\+|--|[=!<>+\-*/%&|^]=|\S|\Z)"
    )
    binary = _C_BINARY | {"===": 8, "!==": 8, "instanceof": 9, "in": 9, ">>": 12, ">>>": 12, "**": 17, "??": 2}
    assign = _C_ASSIGN | {"**=", ">>=", ">>>=", "&&=", "||=", "??="}

    def __init__(self, text: str) -> None:
        if text.startswith("#!"):
            text = "//" + text[2:]
        if _REGEX_HINT.search(text):
            text = _REGEX.sub(lambda m: m[1] or m[2] + ('"r"' if _pattern(m[3]) else "\\"), text)
        self.text = text
        pairs = self.lexer.findall(text)
        while pairs and not pairs[-1][1]:
            pairs.pop()
        self.tokens = [b for _, b in pairs]
        self.t = list(map(self.kinds.__getitem__, self.tokens))
        self.s = "".join(map(self.letters.__getitem__, self.t))
        self.newline = ["\n" in a for a, _ in pairs] + [True] * 4
        self.t += ["eof"] * 4
        self.i = 0
        self.errors: list[tuple[int, str]] = []
        self.partners: dict[str, dict[int, int]] = {}
        self.functions, self.no_in = 0, False
        self.form = ""

    @classmethod
    def kind(cls, token: str) -> str:
        if token[0] == "#":
            return "#id" if len(token) > 1 else "err"
        if token[0] == "`":
            return "str" if len(token) > 1 and cls.holes(token) else "err"
        return super().kind(token)

    @classmethod
    def holes(cls, token: str) -> bool:
        """The expressions within a template parse."""
        k, n = 1, len(token) - 1
        while k < n:
            if token[k] == "\\":
                k += 2
                continue
            if token.startswith("${", k):
                depth, start = 1, k + 2
                k += 2
                while k < n and depth:
                    depth += (token[k] == "{") - (token[k] == "}")
                    k += 1
                if depth:
                    return False
                p = cls(token[start : k - 1])
                try:
                    p.expressions()
                    if p.t[p.i] != "eof":
                        return False
                except (Bad, RecursionError):
                    return False
                continue
            k += 1
        return True

    def lines_of(self, places: list[int]) -> list[int]:
        return lines_of(self.lexer, self.text, 2, places)

    def any_word(self) -> None:
        k = self.t[self.i]
        if k == "id" or k in self.words or k in self.contextual:
            self.i += 1
        else:
            self.fail()

    def end(self) -> None:
        """A semicolon, or what stands for one."""
        if not self.maybe(";") and self.t[self.i] not in ("}", "eof") and not self.newline[self.i]:
            raise Bad(self.i, f"expected ;, found {self.t[self.i]}")

    # ---------------------------------------------------------------- statements

    def file(self) -> None:
        self.repeat(self.top, "eof")

    def top(self) -> None:
        t, k = self.t, self.t[self.i]
        if k == "import" and t[self.i + 1] not in ("(", "."):
            self.import_line()
        elif k == "export":
            self.export_line()
        else:
            self.statement()

    def import_line(self) -> None:
        t = self.t
        self.take("import")
        if self.maybe("str"):
            return self.attributes()
        if t[self.i] not in ("{", "*"):
            self.name()
            if self.maybe(","):
                if t[self.i] not in ("{", "*"):
                    self.fail()
        if self.maybe("*"):
            self.take("as")
            self.name()
        elif t[self.i] == "{":
            self.specifiers(True)
        self.take("from")
        self.take("str")
        self.attributes()

    def attributes(self) -> None:
        if self.t[self.i] == "with":
            self.i += 1
            self.object()
        self.end()

    def specifiers(self, imported: bool) -> None:
        self.take("{")
        while not self.maybe("}"):
            if not self.maybe("str"):
                self.any_word()
            if self.maybe("as"):
                self.name() if imported else self.maybe("str") or self.any_word()
            if self.t[self.i] != "}":
                self.take(",")

    def export_line(self) -> None:
        t = self.t
        self.take("export")
        if self.maybe("default"):
            if t[self.i] == "function" or t[self.i] == "async" and t[self.i + 1] == "function":
                self.maybe("async")
                self.function(False)
            elif t[self.i] == "class":
                self.class_(False)
            else:
                self.expression()
                self.end()
        elif self.maybe("*"):
            if self.maybe("as"):
                self.maybe("str") or self.any_word()
            self.take("from")
            self.take("str")
            self.attributes()
        elif t[self.i] == "{":
            self.specifiers(False)
            if self.maybe("from"):
                self.take("str")
            self.attributes()
        elif t[self.i] in ("var", "let", "const", "function", "class") or t[self.i] == "async" and t[self.i + 1] == "function":
            self.statement()
        else:
            self.fail()

    def block(self) -> None:
        self.take("{")
        self.repeat(self.statement, "}")
        self.take("}")

    def statement(self) -> None:
        m = self.simple.match(self.s, self.i)
        if m:
            key = ("s" if self.functions else "o", m.group())
            if key in self.good:
                self.i = m.end()
                return
            asi = self.i
            self.any_statement()
            if self.i == m.end() and not any(self.newline[asi + 1 : self.i]):
                self.good.add(key)
        else:
            self.any_statement()

    def any_statement(self) -> None:
        t, k = self.t, self.t[self.i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k in ("var", "const") or k == "let" and (self.is_name(1) or t[self.i + 1] in ("[", "{")):
            self.i += 1
            self.declarators(k == "const")
            self.end()
        elif k == "function" or k == "async" and t[self.i + 1] == "function" and not self.newline[self.i + 1]:
            self.maybe("async")
            self.function(True)
        elif k == "class":
            self.class_(True)
        elif k in ("if", "while", "with"):
            self.i += 1
            self.header(self.expressions)
            self.statement()
            if k == "if" and self.maybe("else"):
                self.statement()
        elif k == "for":
            self.i += 1
            self.maybe("await")
            self.header(self.for_header)
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.take("while")
            self.parens(self.expressions)
            self.maybe(";")
        elif k == "try":
            self.i += 1
            self.block()
            plain = True
            if self.maybe("catch"):
                plain = False
                if self.maybe("("):
                    self.binding()
                    self.take(")")
                self.block()
            if self.maybe("finally"):
                plain = False
                self.block()
            if plain:
                self.fail("a try without catch or finally")
        elif k == "switch":
            self.i += 1
            self.parens(self.expressions)
            self.take("{")
            self.repeat(self.switch_part, "}")
            self.take("}")
        elif k == "return":
            if not self.functions:
                self.fail("return outside a function")
            self.i += 1
            if t[self.i] not in (";", "}", "eof") and not self.newline[self.i]:
                self.expressions()
            self.end()
        elif k == "throw":
            self.i += 1
            if self.newline[self.i]:
                self.fail()
            self.expressions()
            self.end()
        elif k in ("break", "continue"):
            self.i += 1
            if self.is_name() and not self.newline[self.i]:
                self.i += 1
            self.end()
        elif k == "debugger":
            self.i += 1
            self.end()
        elif k == "import" and t[self.i + 1] in ("(", ".") or k not in ("import", "export", "else", "catch", "finally", "case", "default"):
            if self.is_name() and t[self.i + 1] == ":":
                self.i += 2
                self.statement()
                return
            self.expressions()
            self.end()
        else:
            self.fail()

    def switch_part(self) -> None:
        if self.maybe("case"):
            self.expressions()
            self.take(":")
        elif self.maybe("default"):
            self.take(":")
        else:
            self.statement()

    def for_header(self) -> None:
        t = self.t
        if t[self.i] == ";":
            pass
        else:
            self.no_in = True
            try:
                if t[self.i] in ("var", "const") or t[self.i] == "let" and (self.is_name(1) or t[self.i + 1] in ("[", "{")):
                    self.i += 1
                    self.binding()
                    if t[self.i] not in ("of", "in"):
                        self.declarator_rest(False)
                        while self.maybe(","):
                            self.binding()
                            self.declarator_rest(False)
                else:
                    self.expressions()
            finally:
                self.no_in = False
            if t[self.i] in ("of", "in"):
                self.i += 1
                self.expressions()
                return
        self.take(";")
        if t[self.i] != ";":
            self.expressions()
        self.take(";")
        if t[self.i] != ")":
            self.expressions()

    def declarators(self, must: bool) -> None:
        while True:
            pattern = self.t[self.i] in ("[", "{")
            self.binding()
            self.declarator_rest(must or pattern)
            if not self.maybe(","):
                return

    def declarator_rest(self, must: bool) -> None:
        if self.maybe("="):
            self.expression()
        elif must:
            self.fail("a value is missing")

    def binding(self) -> None:
        t = self.t
        if self.maybe("["):
            while not self.maybe("]"):
                if t[self.i] == ",":
                    self.i += 1
                    continue
                self.maybe("...")
                self.binding()
                if self.maybe("="):
                    self.expression()
                if t[self.i] != "]":
                    self.take(",")
        elif self.maybe("{"):
            while not self.maybe("}"):
                if self.maybe("..."):
                    self.name()
                else:
                    plain = self.is_name()
                    self.property_name()
                    if self.maybe(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.maybe("="):
                        self.expression()
                if t[self.i] != "}":
                    self.take(",")
        else:
            self.name()

    def function(self, named: bool) -> None:
        self.take("function")
        self.maybe("*")
        if named or self.is_name():
            self.name()
        self.rest_of_function()

    def rest_of_function(self) -> None:
        self.parameters()
        self.functions += 1
        no_in, self.no_in = self.no_in, False
        self.block()
        self.no_in = no_in
        self.functions -= 1

    def parameters(self) -> None:
        self.take("(")
        while not self.maybe(")"):
            if self.maybe("..."):
                self.binding()
                self.take(")")
                return
            self.binding()
            if self.maybe("="):
                self.expression()
            if self.t[self.i] != ")":
                self.take(",")

    def class_(self, named: bool) -> None:
        self.take("class")
        if named or self.is_name():
            self.name()
        if self.maybe("extends"):
            self.unary()
        self.take("{")
        self.repeat(self.class_member, "}")
        self.take("}")

    def class_member(self) -> None:
        t = self.t
        if self.maybe(";"):
            return
        if t[self.i] == "static" and t[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        if t[self.i] == "static" and t[self.i + 1] not in ("(", "=", ";", "}"):
            self.i += 1
        self.method_or(True)

    def method_or(self, in_class: bool) -> None:
        """A method, accessor or (in a class) field."""
        t = self.t
        if t[self.i] == "async" and t[self.i + 1] not in ("(", "=", ";", "}", ",", ":") and not self.newline[self.i + 1]:
            self.i += 1
        if self.maybe("*"):
            pass
        elif t[self.i] in ("get", "set") and t[self.i + 1] not in ("(", "=", ";", "}", ",", ":"):
            self.i += 1
        self.property_name()
        if t[self.i] == "(":
            self.rest_of_function()
            return
        if not in_class:
            self.fail()
        if self.maybe("="):
            self.functions += 1
            self.expression()
            self.functions -= 1
        self.end()

    def property_name(self) -> None:
        if self.maybe("["):
            self.expression()
            self.take("]")
        elif not (self.maybe("str") or self.maybe("num") or self.maybe("#id")):
            self.any_word()

    # ---------------------------------------------------------------- expressions

    def expressions(self) -> None:
        self.expression()
        while self.maybe(","):
            self.expression()

    def expression(self, least: int = 0) -> None:
        t = self.t
        if least == 0:
            if self.arrow():
                return
            if t[self.i] == "yield" and t[self.i + 1] not in ("=", ".", "=>"):
                self.i += 1
                if not self.newline[self.i] and t[self.i] not in (")", "]", "}", ",", ";", ":", "eof", "in", "of"):
                    self.maybe("*")
                    self.expression()
                return
        self.unary()
        form = self.form
        while True:
            op = t[self.i]
            level = self.binary.get(op)
            if level is None or op == "in" and self.no_in:
                break
            if level < least:
                return
            self.i += 1
            self.expression(level if op == "**" else level + 1)
            form = "value"
        if least > 1:
            return
        if self.maybe("?"):
            no_in, self.no_in = self.no_in, False
            self.expression()
            self.no_in = no_in
            self.take(":")
            self.expression()
            form = "value"
        elif t[self.i] in self.assign:
            if form != "target" and not (form == "pattern" and t[self.i] == "="):
                self.fail("cannot assign")
            self.i += 1
            self.expression()
            form = "value"
        self.form = form

    def arrow(self) -> bool:
        t, at = self.t, self.i
        if t[at] == "async" and not self.newline[at + 1] and (self.is_name(1) and t[at + 2] == "=>" or t[at + 1] == "(" and t[self.matching(at + 1) + 1] == "=>"):
            self.i += 1
        if self.is_name() and t[self.i + 1] == "=>":
            self.i += 1
        elif t[self.i] == "(" and t[self.matching(self.i) + 1] == "=>":
            self.parameters()
        else:
            self.i = at
            return False
        if self.newline[self.i]:
            self.fail()
        self.take("=>")
        if t[self.i] == "{":
            self.functions += 1
            no_in, self.no_in = self.no_in, False
            self.block()
            self.no_in = no_in
            self.functions -= 1
        else:
            self.functions += 1
            self.expression()
            self.functions -= 1
        self.form = "value"
        return True

    def unary(self) -> None:
        t = self.t
        n = 0
        while t[self.i] in ("+", "-", "!", "~", "typeof", "void", "delete") or t[self.i] in ("++", "--") or t[self.i] == "await" and t[self.i + 1] not in (".", "=", ")", ";", ",", "=>", "(") or t[self.i] == "await" and t[self.i + 1] == "(":
            counts = t[self.i] in ("++", "--")
            self.i += 1
            n += 1
        self.primary()
        if n:
            if counts and self.form != "target":
                self.fail("cannot count")
            if t[self.i] == "**" and not counts:
                self.fail()
            self.form = "value"
        elif t[self.i] in ("++", "--") and not self.newline[self.i]:
            if self.form != "target":
                self.fail("cannot count")
            self.i += 1
            self.form = "value"

    def primary(self) -> None:
        t, k = self.t, self.t[self.i]
        if k == "async" and t[self.i + 1] == "function":
            self.i += 1
            k = "function"
        if k == "id" or k in self.contextual:
            self.i += 1
            form = "target"
        elif k in ("num", "str", "this", "null", "true", "false"):
            self.i += 1
            form = "value"
        elif k == "(":
            self.i += 1
            no_in, self.no_in = self.no_in, False
            self.expressions()
            self.no_in = no_in
            form = "target" if self.form == "target" else "value"
            self.take(")")
        elif k == "[":
            self.i += 1
            while not self.maybe("]"):
                if self.maybe(","):
                    continue
                self.maybe("...")
                self.expression()
                if t[self.i] != "]":
                    self.take(",")
            form = "pattern"
        elif k == "{":
            self.object()
            form = "pattern"
        elif k == "function":
            self.function(False)
            form = "value"
        elif k == "class":
            self.class_(False)
            form = "value"
        elif k == "new":
            self.i += 1
            if self.maybe("."):
                self.name()
            else:
                self.created()
            form = "value"
        elif k == "super" and t[self.i + 1] in ("(", ".", "["):
            self.i += 1
            form = "value"
        elif k == "import" and t[self.i + 1] in ("(", "."):
            self.i += 1
            if self.maybe("."):
                self.name()
            form = "value"
        elif k == "#id" and t[self.i + 1] == "in":
            self.i += 1
            form = "value"
        else:
            self.fail()
        self.form = self.postfix(form)

    def created(self) -> None:
        t = self.t
        if self.maybe("new"):
            self.created()
        elif t[self.i] in ("(", "[", "{", "function", "class"):
            self.primary_only()
        else:
            if t[self.i] != "this" and t[self.i] != "import":
                self.name()
            else:
                self.i += 1
        while t[self.i] in (".", "["):
            if self.maybe("."):
                self.maybe("#id") or self.any_word()
            else:
                self.i += 1
                self.expressions()
                self.take("]")
        if t[self.i] == "(":
            self.arguments()

    def primary_only(self) -> None:
        k = self.t[self.i]
        if k == "(":
            self.parens(self.expressions)
        elif k == "function":
            self.function(False)
        elif k == "class":
            self.class_(False)
        elif k == "{":
            self.object()
        else:
            self.fail()

    def postfix(self, form: str) -> str:
        t = self.t
        while True:
            k = t[self.i]
            if k == ".":
                self.i += 1
                self.maybe("#id") or self.any_word()
                form = "target"
            elif k == "?.":
                self.i += 1
                if t[self.i] == "(":
                    self.arguments()
                elif t[self.i] == "[":
                    self.i += 1
                    self.expressions()
                    self.take("]")
                elif t[self.i] != "str":
                    self.maybe("#id") or self.any_word()
                form = "value"
            elif k == "(":
                self.arguments()
                form = "value"
            elif k == "[":
                self.i += 1
                no_in, self.no_in = self.no_in, False
                self.expressions()
                self.no_in = no_in
                self.take("]")
                form = "target"
            elif k == "str" and self.tokens[self.i][0] == "`":
                self.i += 1
                form = "value"
            else:
                return form

    def arguments(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.take("(")
        while not self.maybe(")"):
            self.maybe("...")
            self.expression()
            if self.t[self.i] != ")":
                self.take(",")
        self.no_in = no_in

    def object(self) -> None:
        t = self.t
        no_in, self.no_in = self.no_in, False
        self.take("{")
        while not self.maybe("}"):
            if self.maybe("..."):
                self.expression()
            elif t[self.i] in ("*", "get", "set", "async") and t[self.i + 1] not in (",", ":", "}", "(", "="):
                self.method_or(False)
            else:
                plain = self.is_name()
                self.property_name()
                if t[self.i] == "(":
                    self.rest_of_function()
                elif self.maybe(":"):
                    self.expression()
                elif not plain:
                    self.fail()
                elif self.maybe("="):
                    self.expression()
            if t[self.i] != "}":
                self.take(",")
        self.no_in = no_in
