"""TypeScript and TSX source cut into tokens whose brackets are paired.

The scanner keeps a stack of what it is inside of: brackets, template strings
and, in TSX, elements. Text of elements and templates makes no tokens; the
expressions inside them do. Whether a slash opens a regular expression and
whether ``<`` opens an element follows from the token before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)+", re.S)
_WORD = re.compile(r"#?(?:[^\W\d]|\$|\\u[\da-fA-F{}]+)(?:[\w$]|\\u[\da-fA-F{}]+)*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-zA-Z]*")
# A closing angle stands alone, so type arguments that end together pair up.
_MARK = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\?\?=|&&=|\|\|=|\*\*=|<<=|===|!==|==|!=|<=|&&|\|\||\?\?|\*\*|\+\+|--|<<|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")
_CHUNK = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=)")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Words after which an operand follows.
BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new else do await yield default instanceof extends as satisfies".split())

WORD, NUMBER, STRING, REGEX, MARK, TEMPLATE, TEMPLATE_END, ELEMENT, ELEMENT_END, END = "word", "number", "string", "regex", "mark", "template", "template_end", "element", "element_end", "end"


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    after_line: bool = False
    pair: int = -1


class Scanner:
    """``tokens`` of a source, the last of kind END; ``broken`` if something doesn't close."""

    def __init__(self, source: str, elements: bool):
        self.source, self.elements = source, elements
        self.tokens: list[Token] = []
        self.broken = False
        self._inside: list[tuple[str, int]] = []
        self._at, self._line = 0, False
        if source.startswith("#!"):
            self._at = source.find("\n") % (len(source) + 1)
        self._scan()
        while self._inside:
            kind, at = self._inside.pop()
            self.broken = True
            if at >= 0:
                self.tokens[at].pair = len(self.tokens)
        self._put(END, len(source))

    def _put(self, kind: str, end: int) -> int:
        self.tokens.append(Token(kind, self.source[self._at : end], self._at, end, self._line))
        self._at, self._line = end, False
        return len(self.tokens) - 1

    def _operand_next(self) -> bool:
        """Whether the token before leaves room for an operand."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == WORD:
            return t.text in BEFORE_OPERAND
        if t.text == "}" and t.kind == MARK:
            return self._line
        return t.kind == MARK and t.text not in (")", "]", "++", "--")

    def _open(self, kind: str, end: int, inside: str) -> None:
        self._inside.append((inside, self._put(kind, end)))

    def _close(self, kind: str, end: int) -> None:
        at = self._inside.pop()[1]
        here = self._put(kind, end)
        self.tokens[at].pair, self.tokens[here].pair = here, at

    def _scan(self) -> None:
        source = self.source
        while self._at < len(source):
            inside = self._inside[-1][0] if self._inside else ""
            if inside == "`":
                self._chunk()
            elif inside in ("tag", "body"):
                self._element(inside)
            else:
                self._token()

    def _chunk(self) -> None:
        at = _CHUNK.match(self.source, self._at).end()
        self._at = at
        if self.source.startswith("`", at):
            self._close(TEMPLATE_END, at + 1)
        elif self.source.startswith("${", at):
            self._open(MARK, at + 2, "${")
        else:
            self.broken, self._at = True, len(self.source)

    def _element(self, inside: str) -> None:
        source, at = self.source, self._at
        if inside == "body":
            stops = [x for x in (source.find("<", at), source.find("{", at)) if x >= 0]
            if not stops:
                self.broken, self._at = True, len(source)
                return
            self._at = at = min(stops)
            if source[at] == "{":
                self._open(MARK, at + 1, "{")
            elif source.startswith("</", at):
                end = source.find(">", at)
                self._leave(end + 1 if end >= 0 else len(source))
            else:
                self._at = at + 1
                self._inside.append(("tag", -1))
            return
        space = _SPACE.match(source, at)
        if space:
            self._at = at = space.end()
        if source.startswith("/>", at):
            self._leave(at + 2)
        elif source.startswith(">", at):
            self._inside[-1] = ("body", self._inside[-1][1])
            self._at = at + 1
        elif source.startswith("{", at):
            self._open(MARK, at + 1, "{")
        elif found := re.compile(r"'[^']*'|\"[^\"]*\"|<|[^\s<>{}'\"/]+|.", re.S).match(source, at):
            self._at = found.end()
            if found[0] == "<":
                self._inside.append(("tag", -1))

    def _leave(self, end: int) -> None:
        """An element ends; the outermost one is a token."""
        if self._inside[-1][1] >= 0:
            self._at = end - 1
            self._close(ELEMENT_END, end)
        else:
            self._inside.pop()
            self._at = end

    def _token(self) -> None:
        source = self.source
        space = _SPACE.match(source, self._at)
        if space:
            self._line = self._line or "\n" in space[0]
            self._at = space.end()
            if self._at >= len(source):
                return
        at, c = self._at, source[self._at]
        if c == "`":
            self._open(TEMPLATE, at + 1, "`")
            return
        if c in "'\"":
            found = _STRING.match(source, at)
            if not found:
                self.broken = True
                end = source.find("\n", at)
            self._put(STRING, found.end() if found else end if end >= 0 else len(source))
            return
        if c == "/" and not source.startswith(("//", "/*"), at) and self._operand_next() and (found := _REGEX.match(source, at)):
            self._put(REGEX, found.end())
            return
        if c == "<" and self.elements and self._operand_next() and re.compile(r"<(?:[A-Za-z_$>])").match(source, at) and not _GENERIC.match(source, at):
            self._open(ELEMENT, at + 1, "tag")
            return
        for pattern, kind in ((_WORD, WORD), (_NUMBER, NUMBER), (_MARK, MARK)):
            if found := pattern.match(source, at):
                break
        else:
            self.broken = True
            self._at += 1
            return
        if kind == MARK and c in "([{":
            self._open(MARK, found.end(), c)
        elif kind == MARK and c in ")]}":
            self._shut(c, found.end())
        else:
            self._put(kind, found.end())

    def _shut(self, c: str, end: int) -> None:
        opener = _PAIRS[c]
        names = [x[0] for x in self._inside]
        fits = [i for i, x in enumerate(names) if x == opener or (c == "}" and x == "${")]
        if not fits:
            self.broken = True
            self._put(MARK, end)
            return
        while len(self._inside) - 1 > fits[-1]:  # left open in between
            self.broken = True
            _, at = self._inside.pop()
            if at >= 0:
                self.tokens[at].pair = len(self.tokens)
        self._close(MARK, end)
