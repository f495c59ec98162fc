"""Structure of source files: captured declarations with their places, for outlines and chunks.

Python goes through the standard parser, with a scanner by indentation where that fails; Java and C# through a scanner that
knows strings, comments and brackets and reads declarations, not statements."""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass, field

CLASS_LIKE = ("class", "interface", "annotation", "enum")


@dataclass
class Item:
    """A captured declaration: places count characters; body and sig are the starts of the body and of the return type."""

    kind: str
    start: int
    end: int
    body: int | None = None
    sig: int | None = None
    parent: Item | None = None
    top: bool = False
    inside: list[Item] = field(default_factory=list)


_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|[$]?@[$]?\"(?:\"\"|[^\"])*(?:\"|\Z)|\$?\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|(?:^|(?<=\n))[ \t]*#[^\n]*|[^\W\d][\w$]*|=>|::|\S",
    re.S,
)
# Words that stand before a declaration.
_JAVA_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
_SHARP_MODIFIERS = frozenset("abstract async const extern file internal new override partial private protected public readonly required sealed static unsafe virtual volatile".split())


class Braces:
    """The scanner for Java and C#."""

    def __init__(self, text: str, sharp: bool) -> None:
        self.text, self.sharp = text, sharp
        self.tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text) if not m.group().startswith(("//", "/*")) and not m.group().lstrip().startswith("#")]
        self.n = len(self.tokens)
        self.items: list[Item] = []
        self.modifiers = _SHARP_MODIFIERS if sharp else _JAVA_MODIFIERS

    def word(self, i: int) -> str:
        return self.tokens[i][0] if i < self.n else ""

    def close(self, i: int) -> int:
        """The token that closes the bracket at i; the last token if none does."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        depth = 0
        opens, closes = self.word(i), pairs[self.word(i)]
        while i < self.n:
            depth += (self.word(i) == opens) - (self.word(i) == closes)
            if not depth:
                return i
            i += 1
        return self.n - 1

    def scan(self) -> list[Item]:
        self.members(0, self.n, None, None, True)
        self.items.sort(key=lambda x: (x.start, -x.end))
        return self.items

    def add(self, kind: str, first: int, last: int, parent: Item | None, body: int | None = None, sig: int | None = None, top: bool = False) -> Item:
        item = Item(kind, self.tokens[first][1], self.tokens[min(last, self.n - 1)][2], None if body is None else self.tokens[body][1], sig, parent, top)
        self.items.append(item)
        return item

    def members(self, i: int, end: int, parent: Item | None, owner: str | None, top: bool) -> None:
        while i < end:
            i = self.member(i, end, parent, owner, top)

    def member(self, i: int, end: int, parent: Item | None, owner: str | None, top: bool) -> int:
        first, k = i, i
        call = None  # the parameters' bracket
        words: list[int] = []  # places of plain words outside brackets
        if self.word(i) in (";", "}", ","):
            return i + 1
        while k < end:
            w = self.word(k)
            if w in ("{", ";", "=") or self.sharp and w == "=>":
                break
            if w == "@" and self.word(k + 1) != "interface" or self.sharp and w == "[" and k == first:
                if w == "[":
                    k = self.close(k) + 1
                    continue
                k += 2
                while self.word(k) == ".":
                    k += 2
                if self.word(k) == "(":
                    k = self.close(k) + 1
                continue
            if w == "(":
                if call is None and words:
                    call = k
                k = self.close(k) + 1
                continue
            if w == "[":
                k = self.close(k) + 1
                continue
            if w[0].isalpha() or w[0] == "_":
                words.append(k)
            k += 1
        if k >= end:
            return end
        names = [self.word(x) for x in words]
        ends_at = self.word(k)
        if names[:1] == ["namespace"] and self.sharp:
            if ends_at == "{":
                last = self.close(k)
                self.members(k + 1, last, None, None, False)
                return last + 1
            return k + 1
        if names[:1] in (["import"], ["package"], ["using"], ["global"]):
            while k < end and self.word(k) != ";":
                k += 1
            if self.sharp and "using" in names[:2]:
                self.add("using", first, k, parent, top=top)
            return k + 1
        kind_at = next((x for x in words if self.word(x) in ("class", "interface", "enum", "struct", "record") and self.word(x - 1) != "." and (call is None or x < call)), None)
        if kind_at is not None and (ends_at == "{" or ends_at == ";" and self.word(kind_at) != "record") and self.word(kind_at + 1)[:1].isidentifier():
            kind = self.word(kind_at)
            if kind == "interface" and self.word(kind_at - 1) == "@":
                kind = "annotation"
            captured = kind in CLASS_LIKE
            name = self.word(kind_at + 1)
            if ends_at == ";":
                if captured:
                    self.add(kind, first, k, parent, top=top)
                return k + 1
            last = self.close(k)
            item = self.add(kind, first, last, parent, body=k, top=top) if captured else parent
            inner = k + 1
            if kind == "enum":
                depth_end = inner
                while depth_end < last and self.word(depth_end) != ";":
                    depth_end = self.close(depth_end) + 1 if self.word(depth_end) in ("(", "{", "[") else depth_end + 1
                inner = depth_end + 1
            self.members(inner, last, item, name, False)
            return last + 1
        if call is not None and ends_at in ("{", ";", "=>") or call is not None and self.sharp and "delegate" in names:
            name_at = max((x for x in words if x < call), default=None)
            sig = self.signature(first, call)
            made = name_at is not None and (sig is None or sig == name_at and (self.word(name_at) == owner or owner is None))
            if ends_at == "=>":
                last = k
                while last < end and self.word(last) != ";":
                    last = self.close(last) + 1 if self.word(last) in ("(", "{", "[") else last + 1
            else:
                last = self.close(k) if ends_at == "{" else k
            if not names or name_at is None or "delegate" in names:
                return last + 1
            if made:
                if self.sharp:
                    self.add("constructor", first, last, parent, body=k if ends_at != ";" else None)
            else:
                self.add("method", first, last, parent, body=k if ends_at != ";" else None, sig=self.tokens[sig][1])
            return last + 1
        if ends_at == "{" and (not names or all(x in self.modifiers for x in names)):
            return self.close(k) + 1  # an initializer
        if ends_at in ("{", "=>") and self.sharp:
            last = self.close(k) if ends_at == "{" else k
            if ends_at == "=>" or self.word(last + 1) == "=":
                last += 1
                while last < end and self.word(last) != ";":
                    last = self.close(last) + 1 if self.word(last) in ("(", "{", "[") else last + 1
            self.add("property", first, last, parent, body=k)
            return last + 1
        last = k
        while last < end and self.word(last) != ";":
            last = self.close(last) + 1 if self.word(last) in ("(", "{", "[") else last + 1
        if names and (parent is not None or owner is not None) and ends_at != "{":
            self.add("field", first, last, parent)
        return last + 1

    def signature(self, i: int, call: int) -> int | None:
        """The token where the return type begins."""
        while i < call:
            w = self.word(i)
            if w == "@":
                i += 2
                while self.word(i) == ".":
                    i += 2
                if self.word(i) == "(":
                    i = self.close(i) + 1
            elif self.sharp and w == "[":
                i = self.close(i) + 1
            elif w in self.modifiers:
                i += 1
            elif w == "<":
                depth = 0
                while i < call:
                    depth += (self.word(i) == "<") - (self.word(i) == ">")
                    i += 1
                    if not depth:
                        break
            else:
                return i
        return None


def python_items(text: str) -> list[Item]:
    """Classes, functions and assignments to self, without decorators, as the standard parser sees them."""
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    # ast counts lines by \n, \r\n and \r only, and columns in bytes
    plain = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    starts = [0]
    for line in plain:
        starts.append(starts[-1] + len(line))

    def place(line: int, column: int) -> int:
        raw = plain[line - 1]
        return starts[line - 1] + (column if raw.isascii() else len(raw.encode()[:column].decode("utf-8", "ignore")))

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    items: list[Item] = []

    def visit(node: ast.AST, parent: Item | None, top: bool) -> None:
        for child in ast.iter_child_nodes(node):
            item = parent
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method"
                body = place(child.body[0].lineno, child.body[0].col_offset)
                if getattr(child.body[0], "decorator_list", None):
                    first = child.body[0].decorator_list[0]
                    body = text.rfind("@", 0, place(first.lineno, first.col_offset))
                item = Item(kind, place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), body, None, parent, top)
                items.append(item)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                target = child.targets[0] if isinstance(child, ast.Assign) else child.target
                if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                    items.append(Item("field", place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset), None, None, parent, top))
            visit(child, item, False)

    visit(tree, None, True)
    return sorted(items, key=lambda x: (x.start, -x.end))


_DEF = re.compile(r"^([ \t]*)(class|(?:async[ \t]+)?def)[ \t]+\w+[^\n]*", re.M)


def python_by_indentation(text: str) -> list[Item]:
    """The same for text that the standard parser refuses: heads of classes and functions, ended by the next line as far out."""
    items: list[Item] = []
    for m in _DEF.finditer(text):
        width = len(m.group(1).expandtabs())
        head = re.compile(r":[ \t]*(?:#[^\n]*)?(?:\r?\n|\Z)").search(text, m.start(2))
        body_at = head.end() if head else m.end()
        end = len(text)
        for line in re.compile(r"^([ \t]*)(?=[^\s#])", re.M).finditer(text, body_at):
            if len(line.group(1).expandtabs()) <= width:
                end = line.start()
                break
        end = len(text[:end].rstrip())
        first = re.compile(r"\S").search(text, body_at)
        items.append(Item("class" if m.group(2) == "class" else "method", m.start(2), max(end, m.end()), first.start() if first and first.start() < end else m.end(), None, None, width == 0))
    for x in items:
        around = [y for y in items if y is not x and y.start < x.start and x.end <= y.end]
        x.parent = max(around, key=lambda y: y.start) if around else None
    return items


def items_of(text: str, suffix: str) -> list[Item]:
    if suffix == ".py":
        try:
            return python_items(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return python_by_indentation(text)
    return Braces(text, suffix == ".cs").scan()
