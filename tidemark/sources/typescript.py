"""What one TypeScript or TSX file declares: functions with metrics and calls, imports, exports.

A reader walks the paired tokens of ``tokens.Scanner`` once and notes facts on
its way; no tree is built. It tolerates what it doesn't know: a part that can't
be read is stepped over within its brackets. A decision counts one more for each
decision around it in its function; an ``else if`` lies inside its ``if``. What
a nested function holds counts to that function alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from ..functions.text import physical_lines, segment, source_lines
from .tokens import ELEMENT, END, MARK, NUMBER, REGEX, STRING, TEMPLATE, WORD, Scanner

ANONYMOUS = "<anonymous>"
DEFAULT, NAMESPACE, NAMED = "default", "namespace", "named"
_QUOTES = "'\"`"
_MODIFIERS = frozenset("public private protected static override readonly abstract declare async accessor get set const in out".split())
_BINARY = frozenset("* / % + - ** & | ^ == != === !== < <= << instanceof in && || ??".split())
_ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= &&= ||= ??=".split())
_PREFIX = frozenset("! ~ + - ++ -- typeof void delete await".split())
_NO_OPERAND = frozenset("in instanceof else case catch finally extends implements".split())
_TYPE_PREFIX = frozenset("keyof unique readonly infer asserts abstract new typeof".split())


@dataclass
class Function:
    kind: str
    name: str
    start: int
    end: int = 0
    levels: list[int] = field(default_factory=list)  # of each decision
    shortcuts: int = 0
    calls: list[tuple[str, str | None, int]] = field(default_factory=list)
    nesting: int = 0


@dataclass
class Export:
    exported: str
    local: str
    source: str | None
    line: int


class Reader:
    """Facts of one source. ``functions`` come in source order, each container before what it holds."""

    def __init__(self, source: str, elements: bool = False):
        scanned = Scanner(source, elements)
        self.source, self.t, self.broken = source, scanned.tokens, scanned.broken
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.i = 0
        self.functions: list[Function] = []
        self.specifiers: dict[str, int] = {}
        self.bindings: dict[str, tuple[str, str | None, str, int]] = {}
        self.surface: set[str] = set()
        self.exports: dict[str, Export] = {}
        self.modules: set[str] = set()
        self._starts: set[int] = set()
        self._counts: dict[str, int] = {}
        self._containers: list[str] = []
        self._frame: Function | None = None
        self._assigned: str | None = None
        self._choosing = False  # between ? and : of a conditional
        self._quiet = False  # trying, without taking notes
        try:
            while self.t[self.i].kind != END:
                self._block(len(self.t) - 1)
                if self.t[self.i].kind != END:
                    self.broken, self.i = True, self.i + 1
        except RecursionError:  # nested deeper than any source that people write; what was read so far stays
            self.broken = True

    # ---- tokens

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1 and column from 0 in bytes."""
        line = bisect_right(self.lines, at)
        return line, len(self.source[self.lines[line - 1] : at].encode())

    def _is(self, *texts: str, ahead: int = 0) -> bool:
        t = self.t[min(self.i + ahead, len(self.t) - 1)]
        return t.kind in (MARK, WORD) and t.text in texts

    def _word(self, ahead: int = 0) -> bool:
        return self.t[min(self.i + ahead, len(self.t) - 1)].kind == WORD

    def _same_line(self, ahead: int = 1) -> bool:
        return not self.t[min(self.i + ahead, len(self.t) - 1)].after_line

    def _pair(self, at: int | None = None) -> int:
        at = self.i if at is None else at
        return self.t[at].pair if self.t[at].pair > at else len(self.t) - 1

    def _past(self, close: int) -> None:
        self.i = min(close + 1, len(self.t) - 1)

    def _text(self, first: int, last: int) -> str:
        return self.source[self.t[first].start : self.t[last - 1].end] if last > first else ""

    # ---- scopes

    def _inside(self, run, *args, **state) -> None:
        """``run`` with some of the reader's state changed for its length."""
        before = {k: getattr(self, k) for k in state}
        for k, v in state.items():
            setattr(self, k, v)
        try:
            run(*args)
        finally:
            for k, v in before.items():
                setattr(self, k, v)

    def _nested(self, run, *args) -> None:
        frame = self._frame
        if frame:
            frame.nesting += 1
        run(*args)
        if frame:
            frame.nesting -= 1

    def _decision(self) -> None:
        if self._frame and not self._quiet:
            self._frame.levels.append(1 + self._frame.nesting)

    def _within(self, name: str | None, run, *args) -> None:
        if name is None:
            run(*args)
            return
        self._containers.append(name)
        run(*args)
        self._containers.pop()

    # ---- functions

    def _function(self, kind: str, name: str | None, start: int, run) -> None:
        """A function that starts at token ``start``; ``run`` reads its parameters and body."""
        at = self.t[start].start
        if self._quiet or at in self._starts:
            run()
            return
        self._starts.add(at)
        if name is None and kind in ("function", "arrow_function"):
            name = self._assigned
        if name is None:
            scope = ".".join(self._containers)
            self._counts[scope] = self._counts.get(scope, 0) + 1
            name = f"{ANONYMOUS}#{self._counts[scope]}"
        made = Function(kind, ".".join([*self._containers, name]), at)
        self.functions.append(made)
        self._inside(run, _frame=made, _choosing=False)
        made.end = self.t[self.i - 1].end

    def _signature(self, body: bool = True) -> None:
        """Type parameters, parameters, the type of the result and the body where there is one."""
        if self._is("<"):
            self._angle()
        if self._is("("):
            self._parameters()
        if self._is(":"):
            self.i += 1
            self._type()
        if body and self._is("{"):
            self._braces()

    def _has_body(self) -> bool:
        """Whether the signature that starts here is followed by a body."""
        at, quiet = self.i, self._quiet
        self._quiet = True
        self._signature(body=False)
        found = self._is("{")
        self.i, self._quiet = at, quiet
        return found

    def _parameters(self) -> None:
        close = self._pair()
        self.i += 1
        choosing, self._choosing = self._choosing, False
        while self.i < close:
            before = self.i
            if self._is("@"):
                self._decorator()
            elif self._is(",", "...", "?"):
                self.i += 1
            elif self._is("{", "["):
                self._primary()
            elif self._is(":"):
                self.i += 1
                self._type()
            elif self._is("="):
                self.i += 1
                self._assignment()
            else:
                self.i += 1
            if self.i == before:
                self.i += 1
        self._choosing = choosing
        self._past(close)

    def _braces(self) -> None:
        """A block in braces."""
        close = self._pair()
        self.i += 1
        self._inside(self._block, close, _assigned=None, _choosing=False)
        self._past(close)

    # ---- statements

    def _block(self, end: int) -> None:
        while self.i < end:
            before = self.i
            self._statement()
            if self.i == before:
                self.broken = True
                self.i += 1

    def _statement(self) -> list[str]:
        """One statement; the names that it declares."""
        t = self.t[self.i]
        if t.kind == MARK:
            if t.text == "{":
                self._braces()
                return []
            if t.text == ";":
                self.i += 1
                return []
            if t.text == "@":
                self._decorator()
                return []
        if t.kind == WORD and (known := getattr(self, f"_on_{t.text}", None)) and (found := known()) is not None:
            return found
        if t.kind == WORD and self._is(":", ahead=1):
            self.i += 2
            return []
        before = self.i
        self._expression()
        if self.i > before and self._is(";"):
            self.i += 1
        return []

    def _decorator(self) -> None:
        self.i += 1
        self._postfix()

    def _on_function(self, start: int | None = None) -> list[str] | None:
        start = self.i if start is None else start
        at = self.i
        self.i += 1
        if self._is("*"):
            self.i += 1
        if not self._word():
            self.i = at
            return None
        name = self.t[self.i].text
        self.i += 1
        if self._has_body():
            self._function("function", name, start, self._signature)
        else:
            self._signature(body=False)
            if self._is(";"):
                self.i += 1
        return [name]

    def _on_async(self) -> list[str] | None:
        if self._is("function", ahead=1) and self._same_line():
            self.i += 1
            found = self._on_function(self.i - 1)
            if found is None:
                self.i -= 1
            return found
        return None

    def _on_class(self) -> list[str] | None:
        name = self.t[self.i + 1].text if self._word(1) and not self._is("extends", "implements", ahead=1) else None
        self.i += 1
        if name:
            self.i += 1
        self._class(name)
        return [name] if name else []

    def _on_abstract(self) -> list[str] | None:
        if not self._is("class", ahead=1):
            return None
        self.i += 1
        return self._on_class()

    def _class(self, container: str | None) -> None:
        """What follows a class's name."""
        if self._is("<"):
            self._angle()
        while not self._is("{") and self.t[self.i].kind != END:
            before = self.i
            if self._is("extends"):
                self.i += 1
                self._within(container, self._postfix)
                if self._is("<"):
                    self._angle()
            elif self._is("implements", ","):
                self.i += 1
                self._type()
            if self.i == before:
                break
        if self._is("{"):
            self._within(container, self._inside_class)

    def _inside_class(self) -> None:
        close = self._pair()
        self.i += 1
        self._inside(self._members, close, _assigned=None, _choosing=False)
        self._past(close)

    def _members(self, close: int) -> None:
        while self.i < close:
            before = self.i
            if self._is(";", ","):
                self.i += 1
            elif self._is("@"):
                self._decorator()
            elif self._is("static") and self._is("{", ahead=1):
                self.i += 1
                self._braces()
            else:
                self._member()
            if self.i == before:
                self.i += 1

    def _modifiers(self) -> None:
        while self._is("*") or (self._is(*_MODIFIERS) and not self._is("(", "=", ";", ":", "?", "!", "}", "<", ",", ahead=1) and self.t[self.i + 1].kind != END):
            self.i += 1

    def _key(self) -> str | None:
        """The name of a member as written, without quotes."""
        t = self.t[self.i]
        if t.kind in (WORD, STRING, NUMBER):
            self.i += 1
            return t.text.strip(_QUOTES)
        if self._is("["):
            first, close = self.i, self._pair()
            self._group(close)
            return self._text(first, self.i).strip(_QUOTES)
        return None

    def _member(self) -> None:
        start = self.i
        self._modifiers()
        key = self._key()
        if key is None:
            if self._is("(", "<"):  # a call signature
                self._signature(body=False)
            return
        if self._is("?", "!"):
            self.i += 1
        if self._is("(", "<"):
            self._function("constructor" if key == "constructor" else "method", key, start, self._signature)
            return
        if self._is(":"):
            self.i += 1
            self._type()
        if self._is("="):
            self.i += 1
            self._inside(self._assignment, _assigned=key)

    def _on_interface(self) -> list[str] | None:
        if not self._word(1):
            return None
        name = self.t[self.i + 1].text
        self.i += 2
        if self._is("<"):
            self._angle()
        while self._is("extends", ","):
            self.i += 1
            self._type()
        if self._is("{"):
            self._within(name, self._object_type)
        return [name]

    def _object_type(self) -> None:
        close = self._pair()
        self.i += 1
        if not self._quiet:
            self._inside(self._signatures, close, _assigned=None)
        self._past(close)

    def _signatures(self, close: int) -> None:
        while self.i < close:
            before = self.i
            if self._is(";", ",", "+", "-"):
                self.i += 1
            elif self._is("new") and self._is("(", "<", ahead=1):
                self.i += 1
                self._signature(body=False)
            elif self._is("[") and self._word(1) and self._is(":", "in", ahead=2):
                self._past(self._pair())  # an index or a mapped type
                while self._is("?", "-", "+", ":"):
                    colon = self._is(":")
                    self.i += 1
                    if colon:
                        self._type()
            else:
                self._member()
            if self.i == before:
                self.i += 1

    def _on_type(self) -> list[str] | None:
        if not self._word(1) or not self._is("=", "<", ahead=2) or not self._same_line():
            return None
        name = self.t[self.i + 1].text
        self.i += 2
        if self._is("<"):
            self._angle()
        if self._is("="):
            self.i += 1
            self._type()
        if self._is(";"):
            self.i += 1
        return [name]

    def _on_enum(self) -> list[str] | None:
        if not self._word(1) or not self._is("{", ahead=2):
            return None
        name = self.t[self.i + 1].text
        self.i += 2
        self._group(self._pair())
        return [name]

    def _on_namespace(self) -> list[str] | None:
        if not (self._word(1) or self.t[self.i + 1].kind == STRING) or not self._is("{", ".", ahead=2) or not self._same_line():
            return None
        first = self.i + 1
        self.i += 2
        while self._is(".") and self._word(1):
            self.i += 2
        name = self._text(first, self.i).strip(_QUOTES)
        if self._is("{"):
            self._within(name, self._braces)
        return [name]

    _on_module = _on_namespace

    def _on_declare(self) -> list[str] | None:
        if not self._word(1) or not self._same_line():
            return None
        self.i += 1
        if self._is("global") and self._is("{", ahead=1):
            self.i += 1
            self._braces()
        else:
            self._statement()
        return []

    def _on_const(self) -> list[str] | None:
        if self._is("enum", ahead=1):
            self.i += 1
            return self._on_enum()
        return self._declaration()

    def _on_let(self) -> list[str] | None:
        return self._declaration() if self._word(1) or self._is("{", "[", ahead=1) else None

    def _on_var(self) -> list[str] | None:
        return self._declaration()

    def _declaration(self) -> list[str]:
        names = []
        self.i += 1
        while True:
            first = self.i
            if self._is("{", "["):
                close = self._pair()
                self._inside(self._primary, _assigned=self._text(first, close + 1).strip(_QUOTES))
            elif self._word() and not self._is("of", "in"):
                self.i += 1
            else:
                break
            name = self._text(first, self.i).strip(_QUOTES)
            names.append(name)
            if self._is("!"):
                self.i += 1
            if self._is(":"):
                self.i += 1
                self._type()
            if self._is("="):
                self.i += 1
                self._inside(self._assignment, _assigned=name)
            if not self._is(","):
                break
            self.i += 1
        if self._is(";"):
            self.i += 1
        return names

    def _condition(self) -> None:
        if self._is("("):
            self._group(self._pair())

    def _on_if(self) -> list[str]:
        self.i += 1
        self._decision()

        def rest() -> None:
            self._condition()
            self._statement()
            if self._is("else"):
                self.i += 1
                self._statement()

        self._nested(rest)
        return []

    def _on_while(self) -> list[str]:
        self.i += 1
        self._decision()
        self._nested(lambda: (self._condition(), self._statement()))
        return []

    def _on_with(self) -> list[str] | None:
        if not self._is("(", ahead=1):
            return None
        self.i += 1
        self._condition()
        self._statement()
        return []

    def _on_for(self) -> list[str]:
        self.i += 1
        self._decision()

        def rest() -> None:
            if self._is("await"):
                self.i += 1
            if self._is("("):
                close = self._pair()
                self.i += 1
                if self._is("const", "let", "var"):
                    self._declaration()
                while self.i < close:
                    before = self.i
                    if self._is("of", "in", ";", ","):
                        self.i += 1
                    else:
                        self._expression()
                    if self.i == before:
                        self.i += 1
                self._past(close)
            self._statement()

        self._nested(rest)
        return []

    def _on_do(self) -> list[str]:
        self.i += 1
        self._decision()

        def rest() -> None:
            self._statement()
            if self._is("while"):
                self.i += 1
                self._condition()

        self._nested(rest)
        if self._is(";"):
            self.i += 1
        return []

    def _on_try(self) -> list[str]:
        self.i += 1
        if self._is("{"):
            self._braces()
        if self._is("catch"):
            self.i += 1
            self._decision()

            def rest() -> None:
                if self._is("("):
                    self._parameters()
                if self._is("{"):
                    self._braces()

            self._nested(rest)
        if self._is("finally"):
            self.i += 1
            if self._is("{"):
                self._braces()
        return []

    def _on_switch(self) -> list[str]:
        self.i += 1
        self._condition()
        if not self._is("{"):
            return []
        close = self._pair()
        self.i += 1

        def arm(case: bool) -> None:
            if case:
                self._expression()
            if self._is(":"):
                self.i += 1
            while self.i < close and not self._is("case", "default"):
                before = self.i
                self._statement()
                if self.i == before:
                    self.i += 1

        while self.i < close:
            case = self._is("case")
            if case:
                self._decision()
            self.i += 1
            if case:
                self._nested(arm, True)
            else:
                arm(False)
        self._past(close)
        return []

    def _on_return(self) -> list[str]:
        self.i += 1
        if not self.t[self.i].after_line and not self._is(";", "}"):
            self._expression()
        if self._is(";"):
            self.i += 1
        return []

    _on_throw = _on_return

    def _on_break(self) -> list[str]:
        self.i += 1
        if self._word() and not self.t[self.i].after_line:
            self.i += 1
        if self._is(";"):
            self.i += 1
        return []

    _on_continue = _on_debugger = _on_break

    # ---- modules

    def _from(self) -> str | None:
        """A quoted specifier here, noted with its line."""
        text = self.t[self.i].text
        if self.t[self.i].kind != STRING or len(text) < 2 or text[-1] != text[0]:
            return None
        specifier, line = text.strip(_QUOTES), self.line(self.t[self.i].start)
        self.specifiers[specifier] = min(line, self.specifiers.get(specifier, line))
        self.i += 1
        if self._is("with", "assert") and self._is("{", ahead=1):
            self._past(self._pair(self.i + 1))
        if self._is(";"):
            self.i += 1
        return specifier

    def _named(self) -> list[tuple[str, str]]:
        """(name, alias) of each entry in braces; the alias is the name where there is none."""
        close, out = self._pair(), []
        self.i += 1
        while self.i < close:
            words = []
            while self.i < close and not self._is(","):
                words.append(self.t[self.i].text)
                self.i += 1
            if self._is(","):
                self.i += 1
            if len(words) > 1 and words[0] == "type" and not (words[1] == "as" and len(words) < 4):
                words = words[1:]
            if words:
                out.append((words[0].strip(_QUOTES), words[2].strip(_QUOTES) if len(words) > 2 and words[1] == "as" else words[0].strip(_QUOTES)))
        self._past(close)
        return out

    def _on_import(self) -> list[str] | None:
        if self._is("(", ".", ahead=1):
            return None
        self.i += 1
        if self._from() is not None:
            return []
        if self._is("type") and not self._is(",", "=", ahead=1) and (not self._is("from", ahead=1) or self._is("from", ahead=2)):
            self.i += 1
        found: list[tuple[str, str, str | None]] = []
        while self.t[self.i].kind != END and not (self._is("from") and self.t[self.i + 1].kind == STRING):
            if self._is("="):
                self.i += 1
                self._expression()
                return []
            if self._is("*") and self._is("as", ahead=1) and self._word(2):
                found.append((self.t[self.i + 2].text, NAMESPACE, None))
                self.i += 3
            elif self._is("{"):
                found += [(alias, NAMED, name) for name, alias in self._named()]
            elif self._word():
                found.append((self.t[self.i].text, DEFAULT, None))
                self.i += 1
            elif self._is(","):
                self.i += 1
            else:
                return []
        self.i += 1
        line = self.line(self.t[self.i].start) if self.i < len(self.t) else 0
        specifier = self._from()
        if specifier is not None:
            for local, kind, name in found:
                if local:
                    self.bindings.setdefault(local, (kind, name, specifier, line))
        return []

    def _export(self, exported: str, local: str, source: str | None, line: int) -> None:
        if exported:
            self.exports.setdefault(exported, Export(exported, local, source, line))

    def _on_export(self) -> list[str]:
        line = self.line(self.t[self.i].start)
        self.i += 1
        if self._is("default"):
            self.i += 1
            self._default(line)
        elif self._is("*") or (self._is("type") and self._is("*", ahead=1)):
            self.i += 2 if self._is("type") else 1
            name = None
            if self._is("as"):
                name = self.t[self.i + 1].text.strip(_QUOTES)
                self.i += 2
            if self._is("from"):
                self.i += 1
            source = self._from()
            self.surface.add("*")
            if source:
                self.modules.add(source)
            if name:
                self._export(name, "*", source, line)
        elif self._is("{") or (self._is("type") and self._is("{", ahead=1)):
            if self._is("type"):
                self.i += 1
            named, source = self._named(), None
            if self._is("from"):
                self.i += 1
                source = self._from() or None
            if source:
                self.modules.add(source)
            for name, alias in named:
                self.surface.add(alias)
                self._export(alias, name, source, line)
            if self._is(";"):
                self.i += 1
        elif self._is("="):
            self.i += 1
            self._expression()
        elif self._is("as") and self._is("namespace", ahead=1):
            self.i += 3
        elif self._is("import"):
            self._on_import()
        else:
            while self._is("@"):
                self._decorator()
            for name in sorted(set(self._statement())):
                self.surface.add(name)
                self._export(name, name, None, line)
        return []

    def _default(self, line: int) -> None:
        """A default export: a declaration is found by its own name, an identifier by itself."""
        while self._is("@"):
            self._decorator()
        named: list[str] | None = None
        if self._is("function") or (self._is("async") and self._is("function", ahead=1)):
            named = self._on_async() if self._is("async") else self._on_function()
        elif self._is("class") and self._word(1) and not self._is("extends", "implements", ahead=1):
            named = self._on_class()
        elif self._is("abstract"):
            named = self._on_abstract()
        elif self._is("interface"):
            named = self._on_interface()
        if named:
            self.surface |= set(named)
            self._export("default", named[0], None, line)
            return
        first = self.i
        if named is None:
            self._expression()
        alone = self.i == first + 1 and self.t[first].kind == WORD
        if self._is(";"):
            self.i += 1
        self.surface.add("default")
        self._export("default", self.t[first].text if alone else "default", None, line)

    # ---- expressions

    def _expression(self) -> None:
        self._assignment()
        while self._is(","):
            self.i += 1
            self._assignment()

    def _group(self, close: int) -> None:
        """What stands between here and the bracket at ``close``, expressions for the most part."""
        self.i += 1
        choosing, self._choosing = self._choosing, False
        while self.i < close:
            before = self.i
            if self._is(",", ";", ":"):
                self.i += 1
            else:
                self._assignment()
            if self.i == before:
                self.i += 1
        self._choosing = choosing
        self._past(close)

    def _assignment(self) -> None:
        if self._is("..."):
            self.i += 1
        if self._arrow():
            return
        if self._is("yield"):
            self.i += 1
            if self._is("*"):
                self.i += 1
            if not self.t[self.i].after_line:
                self._assignment()
            return
        first, frame = self.i, self._frame
        mark = len(frame.levels) if frame else 0
        self._binary()
        if self.i == first:
            return
        if self._is("?"):
            self._conditional(mark)
        elif self._is(*_ASSIGN) or self._shifted():
            name = self._text(first, self.i).strip(_QUOTES)
            plain = self._is("=")
            while self._is(">"):
                self.i += 1
            self.i += 1
            if plain:
                self._inside(self._assignment, _assigned=name)
            else:
                self._assignment()

    def _shifted(self) -> bool:
        """Whether ``>>=`` or ``>>>=`` follows."""
        k = 0
        while self._is(">", ahead=k):
            k += 1
        return k >= 2 and self._is("=", ahead=k)

    def _conditional(self, mark: int) -> None:
        frame = self._frame
        if frame and not self._quiet:
            # What the condition decides lies inside as well.
            frame.levels[mark:] = [x + 1 for x in frame.levels[mark:]]
        self._decision()
        self.i += 1

        def rest() -> None:
            self._inside(self._assignment, _choosing=True)
            if self._is(":"):
                self.i += 1
            self._assignment()

        self._nested(rest)

    def _binary(self) -> None:
        while True:
            before = self.i
            self._unary()
            if self.i == before:
                return
            while self._is("as", "satisfies") and not self.t[self.i].after_line:
                self.i += 1
                if self._is("const"):
                    self.i += 1
                else:
                    self._type()
            if self._is("&&", "||", "??"):
                if self._frame and not self._quiet:
                    self._frame.shortcuts += 1
                self.i += 1
            elif self._is(">"):
                if self._shifted():
                    return
                while self._is(">"):
                    self.i += 1
                if self._is("=") and self.t[self.i].start == self.t[self.i - 1].end:
                    self.i += 1
            elif self._is(*_BINARY):
                self.i += 1
            else:
                return

    def _unary(self) -> None:
        while self._is(*_PREFIX) and not (self._word() and self._is("=>", "=", ",", ")", ".", ";", ahead=1)):
            self.i += 1
        if self._is("<"):  # an assertion of type
            at = self.i
            if not self._angle():
                self.i = at
                return
            self._unary()
            return
        if not self._arrow():
            self._postfix()

    def _try(self, run) -> bool:
        """Whether ``run`` succeeds from here; nothing is noted or moved."""
        at, quiet = self.i, self._quiet
        self._quiet = True
        found = run()
        self.i, self._quiet = at, quiet
        return bool(found)

    def _arrow(self) -> bool:
        """Read an arrow function that starts here."""
        start = self.i
        k = 1 if self._is("async") and self._same_line() and not self._is("=>", ahead=1) else 0
        if self._word(k) and self._is("=>", ahead=k + 1):
            self.i += k

            def single() -> None:
                self.i += 2
                self._arrow_body()

            self._function("arrow_function", None, start, single)
            return True
        if not self._is("(", "<", ahead=k):
            return False

        def head() -> bool:
            self.i = start + k
            if self._is("<") and not self._angle():
                return False
            if not self._is("("):
                return False
            self._past(self._pair())
            if self._is(":") and not self._choosing:
                self.i += 1
                if not self._type():
                    return False
            return self._is("=>") and not self.t[self.i].after_line

        if not self._try(head):
            return False

        def full() -> None:
            self.i = start + k
            self._signature(body=False)
            self.i += 1
            self._arrow_body()

        self._function("arrow_function", None, start, full)
        return True

    def _arrow_body(self) -> None:
        if self._is("{"):
            self._braces()
        else:
            self._assignment()

    def _postfix(self) -> None:
        """An operand and what is applied to it: members, calls, templates."""
        first = self.i
        callee = self._primary()
        if self.i == first:
            return
        while True:
            t = self.t[self.i]
            if self._is(".", "?.") and self._word(1):
                name = self.t[self.i + 1].text
                receiver = callee[1] if callee and callee[0] == "name" else None
                callee = ("member", name, receiver) if receiver and not name.startswith("#") else None
                self.i += 2
            elif self._is("["):
                callee = self._subscript(callee)
            elif self._is("?.") and self._is("[", ahead=1):
                self.i += 1
                callee = self._subscript(callee)
            elif self._is("(") or (self._is("?.") and self._is("(", ahead=1)):
                called = self._text(first, self.i)
                if self._is("?."):
                    self.i += 1
                self._call(callee, first)
                self._arguments(called)
                callee = None
            elif t.kind == TEMPLATE:
                self._call(callee, first)
                self._template()
                callee = None
            elif self._is("<") and self._try(lambda: self._angle() and (self._is("(") or self.t[self.i].kind == TEMPLATE)):
                called = self._text(first, self.i)
                self._angle()
                if self._is("("):
                    self._call(callee, first)
                    self._arguments(called)
                    callee = None
            elif self._is("!") and not t.after_line:
                callee = None
                self.i += 1
            elif self._is("++", "--") and not t.after_line:
                self.i += 1
                return
            else:
                return

    def _subscript(self, callee):
        key = self.t[self.i + 1]
        literal = key.kind == STRING and self._pair() == self.i + 2 and len(key.text) > 2 and "\\" not in key.text
        self._group(self._pair())
        return ("member", key.text[1:-1], callee[1]) if literal and callee and callee[0] == "name" else None

    def _call(self, callee, first: int) -> None:
        if callee and self._frame and not self._quiet:
            self._frame.calls.append((callee[1], callee[2], self.line(self.t[first].start)))

    def _arguments(self, called: str) -> None:
        """A call's arguments; functions in them are named by the call and its first literal, or their place."""
        open_, close = self.i, self._pair()
        label, fresh = None, True
        for k in range(open_ + 1, close):
            t = self.t[k]
            if fresh and t.kind in (STRING, TEMPLATE) and label is None:
                last = k if t.kind == STRING else t.pair
                if (t.kind == STRING or last == k + 1) and (last + 1 == close or self.t[last + 1].text == ","):
                    label = segment(self.source[t.start : self.t[last].end].strip("`" if t.kind == TEMPLATE else "'\""))
            fresh = t.kind == MARK and t.text == "," and self._top(k, open_)
        name, place = segment(called), 0
        self.i += 1
        choosing, self._choosing = self._choosing, False
        while self.i < close:
            before = self.i
            if self._is(","):
                self.i, place = self.i + 1, place + 1
                continue
            self._within(f'{name}("{label}")' if label is not None else f"{name}#{place}", self._assignment)
            if self.i == before:
                self.i += 1
        self._choosing = choosing
        self._past(close)

    def _top(self, at: int, open_: int) -> bool:
        """Whether the token at ``at`` lies directly in the bracket at ``open_``."""
        k = open_ + 1
        while k < at:
            k = self.t[k].pair + 1 if self.t[k].pair > k else k + 1
        return k == at

    def _new(self) -> None:
        """``new`` with the constructor it names and its arguments."""
        first = self.i
        self.i += 1
        named = self.i
        if self._is("new"):
            self._new()
            callee = None
        else:
            callee = self._primary()
        while True:
            if self._is(".") and self._word(1):
                name, receiver = self.t[self.i + 1].text, callee[1] if callee and callee[0] == "name" else None
                callee = ("member", name, receiver) if receiver and not name.startswith("#") else None
                self.i += 2
            elif self._is("["):
                callee = self._subscript(callee)
            else:
                break
        called = self._text(named, self.i)
        if self._is("<") and self._try(lambda: self._angle() and self._is("(")):
            self._angle()
        self._call(callee, first)
        if self._is("("):
            self._arguments(called)

    def _template(self) -> None:
        """Template text or an element: only the expressions inside count."""
        close = self._pair()
        self.i += 1
        while self.i < close:
            if self._is("{", "${"):
                self._group(self._pair())
            else:
                self.i += 1
        self._past(close)

    def _primary(self) -> tuple[str, str, str | None] | None:
        """An operand; ("name", identifier, None) where it is one."""
        t = self.t[self.i]
        if t.kind in (NUMBER, STRING, REGEX):
            self.i += 1
        elif t.kind in (TEMPLATE, ELEMENT):
            self._template()
        elif t.kind == WORD:
            return self._named_operand(t.text)
        elif self._is("(", "["):
            self._group(self._pair())
        elif self._is("{"):
            self._object()
        elif self._is("@"):
            self._decorator()
            self._primary()
        return None

    def _named_operand(self, text: str) -> tuple[str, str, str | None] | None:
        start = self.i
        if text == "function" or (text == "async" and self._is("function", ahead=1) and self._same_line()):
            self.i += 2 if text == "async" else 1
            if self._is("*"):
                self.i += 1
            name = None
            if self._word():
                name = self.t[self.i].text
                self.i += 1
            self._function("function", name, start, self._signature)
        elif text == "class":
            self.i += 1
            if self._word() and not self._is("extends", "implements"):
                self.i += 1
            self._class(None)
        elif text == "new" and not self._is(".", ahead=1):
            self._new()
        elif text not in _NO_OPERAND:
            self.i += 2 if text == "new" else 1
            if text == "new" or text in ("this", "super", "import", "null", "true", "false") or text.startswith("#"):
                return None
            return ("name", text, None)
        return None

    def _object(self) -> None:
        close = self._pair()
        self.i += 1
        choosing, self._choosing = self._choosing, False
        while self.i < close:
            before = self.i
            if self._is(",", ";"):
                self.i += 1
            elif self._is("..."):
                self._assignment()
            else:
                self._property()
            if self.i == before:
                self.i += 1
        self._choosing = choosing
        self._past(close)

    def _property(self) -> None:
        start = self.i
        self._modifiers()
        key = self._key()
        if key is None:
            return
        if self._is("(", "<"):
            self._function("constructor" if key == "constructor" else "method", key, start, self._signature)
        elif self._is(":"):
            self.i += 1
            self._inside(self._assignment, _assigned=key)
        elif self._is("="):
            self.i += 1
            self._assignment()

    # ---- types

    def _angle(self) -> bool:
        """Type arguments or parameters, from ``<`` to its ``>``."""
        self.i += 1
        while not self._is(">"):
            before = self.i
            while self._is("const", "in", "out") and self._word(1):
                self.i += 1
            if not self._type():
                return False
            if self._is("="):
                self.i += 1
                if not self._type():
                    return False
            if self._is(","):
                self.i += 1
            elif not self._is(">"):
                return False
            if self.i == before:
                return False
        self.i += 1
        return True

    def _type(self) -> bool:
        """Step over one type; false where none stands."""
        if self._is("|", "&"):
            self.i += 1
        while True:
            while self._is(*_TYPE_PREFIX) and (self._word(1) or self._is("(", "{", "[", "<", ahead=1)):
                self.i += 1
            t = self.t[self.i]
            if self._is("("):
                self._past(self._pair())
                if self._is("=>"):
                    self.i += 1
                    return self._type()
            elif self._is("<"):
                if not self._angle():
                    return False
                continue
            elif self._is("{"):
                self._object_type()
            elif self._is("["):
                self._past(self._pair())
            elif t.kind == TEMPLATE:
                self._past(self._pair())
            elif t.kind in (STRING, NUMBER):
                self.i += 1
            elif self._is("-"):
                self.i += 2
            elif t.kind == WORD and t.text not in _NO_OPERAND:
                self.i += 1
                if t.text == "import" and self._is("("):
                    self._past(self._pair())
                while self._is(".") and self._word(1):
                    self.i += 2
                if self._is("<") and not self.t[self.i].after_line:
                    at = self.i
                    if not self._angle():
                        self.i = at
                        return False
                if self._is("is") and not self.t[self.i].after_line:
                    self.i += 1
                    continue
            else:
                return False
            while self._is("[") and not self.t[self.i].after_line:
                self._past(self._pair())
            if self._is("extends"):
                self.i += 1
                if not self._type():
                    return False
                if self._is("?"):
                    self.i += 1
                    self._type()
                    if self._is(":"):
                        self.i += 1
                    return self._type()
            if not self._is("|", "&"):
                return True
            self.i += 1


def read_source(source: str, elements: bool = False) -> dict:
    """All facts of a source as plain values."""
    r = Reader(source, elements)
    functions = []
    leaves: dict[str, list[int]] = {}
    for f in sorted(r.functions, key=lambda f: (*r.place(f.start), f.name, f.kind)):
        text = source[f.start : f.end]
        (line, column), (end_line, end_column) = r.place(f.start), r.place(f.end)
        leaves.setdefault(f.name.rsplit(".", 1)[-1], []).append(len(functions))
        functions.append(
            {
                "kind": f.kind,
                "qualified_name": f.name,
                "start_line": line,
                "start_column": column,
                "end_line": end_line,
                "end_column": end_column,
                "physical_loc": physical_lines(text),
                "source_loc": source_lines(text),
                "cyclomatic": 1 + len(f.levels) + f.shortcuts,
                "cognitive": sum(f.levels) + f.shortcuts,
                "body_key": hashlib.sha256(re.sub(r"[ \t\n\f\r]+", " ", text).strip(" ").encode("utf-8", "surrogatepass")).hexdigest(),
                "calls": [{"name": n, "receiver": o, "line": x} for n, o, x in f.calls],
            }
        )
    exports = []
    for e in sorted(r.exports.values(), key=lambda e: e.exported):
        own = leaves.get(e.local, []) if e.source is None else []
        exports.append({"exported": e.exported, "local": e.local, "from_specifier": e.source, "line": e.line, "fn_ix": own[0] if len(own) == 1 else None})
    end_line, end_column = r.place(len(source))
    return {"functions": functions, "surface": sorted(r.surface), "exports": exports, "modules": sorted(r.modules), "malformed": [1, 0, end_line, end_column] if r.broken else None}


def read_imports(source: str, elements: bool = False) -> dict:
    """Specifiers with their first line and local bindings; the source may be cut anywhere."""
    r = Reader(source, elements)
    return {
        "specifiers": [{"specifier": s, "line": line} for s, line in sorted(r.specifiers.items()) if s],
        "bindings": [{"local": local, "imported_kind": kind, "imported": name, "specifier": s, "line": line} for local, (kind, name, s, line) in sorted(r.bindings.items()) if s],
    }
