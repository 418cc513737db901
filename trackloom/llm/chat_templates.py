"""A sandboxed template language: parsed into a syntax tree, folded, and compiled to Python closures.

    {{ value }}  {% if a %} {% elif b %} {% else %} {% endif %}  {% for x in xs %} {% endfor %}
    {% set name = value %}  {% generation %} {% endgeneration %}  {# a remark #}

A minus inside a mark (``{%-``, ``-%}``) drops white space on that side. Values are strings, whole
numbers, ``true false none``, names, ``a.key a['key'] a[0]``, ``+ - * // % ~``, comparisons, ``in``,
``and or not``, ``a if b else c``, ``is [not] defined | none`` and filters after a bar. A loop tells
``loop.index loop.index0 loop.first loop.last``. What lies inside ``generation`` is marked as such.

Sandbox: members are those of records and lists only, never of Python objects; nothing can be called
but the filters below; strings can't be multiplied; loops run over what the caller gave, so a
rendering ends. A missing member is undefined: it prints nothing and is false.

Texts stand in the output in an escaped form in which no control string occurs, and which
``unescape`` takes back: a backslash before each backslash and after the first character of a
control string, and in ``line`` also ``\\n`` for a line's end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

MOST_NESTED = 50


class TemplateError(ValueError):
    pass


class _Undefined:
    __slots__ = ()

    def __bool__(self) -> bool:
        return False


UNDEFINED = _Undefined()
_MARKS = re.compile(r"\{\{-?|\{%-?|\{#-?")
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<sign>//|==|!=|<=|>=|[-+*%~<>.\[\](),|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "is", "if", "else", "for"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _printed(value) -> str:
    if value is UNDEFINED or value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str | int):
        return str(value)
    raise TemplateError("only texts and numbers can be printed")


def _member(value, key):
    if isinstance(value, dict) and isinstance(key, str):
        return value.get(key, UNDEFINED)
    if isinstance(value, list | str) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return UNDEFINED


def _number(value) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TemplateError("not a number")
    return value


def _plus(a, b):
    return a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b)


def _whole(divide: Callable):
    def run(a, b):
        if not _number(b):
            raise TemplateError("division by zero")
        return divide(_number(a), b)

    return run


def _ordered(test: Callable):
    def run(a, b):
        if not (isinstance(a, str) and isinstance(b, str)):
            a, b = _number(a), _number(b)
        return test(a, b)

    return run


def _inside(a, b) -> bool:
    if isinstance(b, str) and isinstance(a, str) or isinstance(b, list | dict):
        return a in b
    raise TemplateError("nothing can be in this")


BINARY: dict[str, Callable] = {
    "+": _plus,
    "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b),
    "//": _whole(lambda a, b: a // b),
    "%": _whole(lambda a, b: a % b),
    "~": lambda a, b: _printed(a) + _printed(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": _inside,
}
LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%"))


class _Parser:
    """Expressions as tuples: ``(kind, *parts)``; statements likewise, in lists."""

    def __init__(self, source: str):
        self.parts, self.at, self.depth = list(_split(source)), 0, 0
        self.tokens: list[tuple[str, str]] = []

    # Statements

    def body(self, *until: str) -> tuple[list, str]:
        """Statements up to a tag named in ``until``, and that tag's name."""
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise TemplateError("nested too deeply")
        found = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                found.append(("text", text))
                continue
            self.tokens = list(_tokens(text))
            if kind == "value":
                found.append(("print", self._all(self.choice)))
                continue
            name = self.take("name")
            if name in until:
                self.depth -= 1
                return found, name
            found.append(self._statement(name))
        if until:
            raise TemplateError(f"{' or '.join(until)} is missing")
        self.depth -= 1
        return found, ""

    def _statement(self, name: str) -> tuple:
        if name == "set":
            target = self._target()
            self.take("sign", "=")
            return "set", target, self._all(self.choice)
        if name == "for":
            target = self._target()
            self.take("name", "in")
            items = self._all(self.choice)
            return "for", target, items, self._closed("endfor")
        if name == "generation":
            self._end()
            return "generation", self._closed("endgeneration")
        if name == "if":
            branches, test = [], self._all(self.choice)
            while True:
                inner, tag = self.body("elif", "else", "endif")
                branches.append((test, inner))
                if tag == "elif":
                    test = self._all(self.choice)
                    continue
                self._end()
                return "if", branches, self._closed("endif") if tag == "else" else []
        raise TemplateError(f"unknown tag {name}")

    def _closed(self, tag: str) -> list:
        inner, _ = self.body(tag)
        self._end()
        return inner

    def _target(self) -> str:
        name = self.take("name")
        if name in _RESERVED or name in _WORDS or name == "loop":
            raise TemplateError(f"{name} can't be set")
        return name

    # Expressions

    def peek(self, *texts: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] != "string" and self.tokens[0][1] in texts

    def take(self, kind: str, text: str | None = None) -> str:
        if not self.tokens or self.tokens[0][0] != kind or text not in (None, self.tokens[0][1]):
            raise TemplateError(f"{text or kind} is missing")
        return self.tokens.pop(0)[1]

    def _end(self) -> None:
        if self.tokens:
            raise TemplateError(f"{self.tokens[0][1]} is out of place")

    def _all(self, rule: Callable) -> tuple:
        found = rule()
        self._end()
        return found

    def choice(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise TemplateError("nested too deeply")
        value = self._either()
        if self.peek("if"):
            self.take("name")
            test = self._either()
            self.take("name", "else")
            value = "choice", test, value, self.choice()
        self.depth -= 1
        return value

    def _either(self) -> tuple:
        value = self._both()
        while self.peek("or"):
            self.take("name")
            value = "or", value, self._both()
        return value

    def _both(self) -> tuple:
        value = self._not()
        while self.peek("and"):
            self.take("name")
            value = "and", value, self._not()
        return value

    def _not(self) -> tuple:
        turns = 0
        while self.peek("not"):
            self.take("name")
            turns += 1
        value = self._level(0)
        return ("not", value) if turns % 2 else ("not", ("not", value)) if turns else value

    def _level(self, k: int) -> tuple:
        if k == len(LEVELS):
            return self._postfix()
        value = self._level(k + 1)
        while True:
            if k == 0 and self.peek("is"):
                self.take("name")
                negated = self.peek("not") and bool(self.take("name"))
                what = self.take("name")
                if what not in ("defined", "none"):
                    raise TemplateError(f"unknown test {what}")
                value = ("not", ("is", what, value)) if negated else ("is", what, value)
            elif k == 0 and self.peek("not"):
                self.take("name")
                self.take("name", "in")
                value = "not", ("binary", "in", value, self._level(1))
            elif self.peek(*LEVELS[k]):
                value = "binary", self.tokens.pop(0)[1], value, self._level(k + 1)
            else:
                return value

    def _postfix(self) -> tuple:
        value = self._atom()
        while self.peek(".", "[", "|"):
            sign = self.take("sign")
            if sign == ".":
                value = "member", value, ("constant", self.take("name"))
            elif sign == "[":
                value = "member", value, self.choice()
                self.take("sign", "]")
            else:
                name, args = self.take("name"), []
                if self.peek("("):
                    self.take("sign")
                    while not self.peek(")"):
                        args.append(self.choice())
                        if not self.peek(")"):
                            self.take("sign", ",")
                    self.take("sign", ")")
                value = "filter", name, value, args
        return value

    def _atom(self) -> tuple:
        if not self.tokens:
            raise TemplateError("a value is missing")
        kind, text = self.tokens.pop(0)
        if kind == "number":
            return "constant", int(text)
        if kind == "string":
            return "constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind == "name" and text in _WORDS:
            return "constant", _WORDS[text]
        if kind == "name" and text not in _RESERVED:
            return "name", text
        if text == "(":
            value = self.choice()
            self.take("sign", ")")
            return value
        if text == "-":
            return "binary", "-", ("constant", 0), self._postfix()
        raise TemplateError(f"{text} is out of place")


def _split(source: str) -> Iterator[tuple[str, str]]:
    """Texts, values and tags in order."""
    at, trim = 0, False
    while found := _MARKS.search(source, at):
        text = source[at : found.start()]
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if found[0].endswith("-") else text
        closing = {"{": "}}", "%": "%}", "#": "#}"}[found[0][1]]
        end = _closing(source, found.end(), closing)
        trim = source[end - 1] == "-" and end > found.end()
        if closing != "#}":
            yield ("value" if closing == "}}" else "tag"), source[found.end() : end - trim]
        at = end + 2
    yield "text", source[at:].lstrip() if trim else source[at:]


def _closing(source: str, at: int, closing: str) -> int:
    """Where a mark closes: not inside a string."""
    quoted = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|" if closing != "#}" else ""
    for found in re.compile(quoted + re.escape(closing), re.S).finditer(source, at):
        if found[0] == closing:
            return found.start()
    raise TemplateError(f"{closing} is missing")


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at, text = 0, text.rstrip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise TemplateError(f"{text[at:].strip()[:20]} isn't understood")
        yield found.lastgroup, found[found.lastgroup]
        at = found.end()


class Template:
    """A compiled template. ``controls``: the strings that mark turns, which escaped texts never hold."""

    def __init__(self, source: str, controls: Iterable[str] = ()):
        self.controls = tuple(controls)
        inner = {c for s in self.controls for c in s[1:]}
        if any(len(s) < 2 or s[0] in inner or "\\" in s or s[1] == "n" for s in self.controls):
            raise TemplateError("a control string has two characters or more, no backslash, no n as its second one, and a first one that stands first only")
        self._found = re.compile("|".join(re.escape(s) for s in sorted(self.controls, key=len, reverse=True)) or r"(?!)")
        self.filters: dict[str, Callable] = {
            "escape": lambda v: self.escape(_printed(v)),
            "line": lambda v: self.escape(_printed(v)).replace("\n", "\\n"),
            "trim": lambda v: _printed(v).strip(),
            "upper": lambda v: _printed(v).upper(),
            "lower": lambda v: _printed(v).lower(),
            "length": lambda v: len(v) if isinstance(v, str | list | dict) else 0,
            "default": lambda v, other: other if v is UNDEFINED else v,
        }
        parser = _Parser(source)
        self.tree = self._fold_body(parser.body()[0])
        self._run = self._body(self.tree)

    def escape(self, text: str) -> str:
        return self._found.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))

    def render(self, **given) -> Iterator[tuple[str, int]]:
        """Pieces of the output, each with the number of the ``generation`` block it lies in (from 1; 0: none).
        A list may be given as an iterator: it is read once, as the loop over it goes on."""
        yield from self._run(dict(given), [0, 0])

    # Folding

    def _fold(self, node: tuple) -> tuple:
        kind, *rest = node
        if kind == "filter":
            name, value, args = rest
            if name not in self.filters:
                raise TemplateError(f"unknown filter {name}")
            parts = [self._fold(value), *map(self._fold, args)]
            node = kind, name, parts[0], parts[1:]
        else:
            parts = [self._fold(p) for p in rest if isinstance(p, tuple)]
            folded = iter(parts)
            node = kind, *(next(folded) if isinstance(p, tuple) else p for p in rest)
        if kind not in ("constant", "name") and all(p[0] == "constant" for p in parts):
            return "constant", self._value(node)({})
        if kind in ("and", "or") and parts[0][0] == "constant":
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        if kind == "choice" and parts[0][0] == "constant":
            return parts[1] if parts[0][1] else parts[2]
        return node

    def _fold_body(self, nodes: list) -> list:
        """Constant values become text, branches never taken go, neighbouring texts are joined."""
        found: list[tuple] = []
        for kind, *rest in nodes:
            if kind == "text":
                new = [(kind, *rest)]
            elif kind == "print":
                value = self._fold(rest[0])
                new = [("text", _printed(value[1]))] if value[0] == "constant" else [(kind, value)]
            elif kind == "set":
                new = [(kind, rest[0], self._fold(rest[1]))]
            elif kind == "for":
                new = [(kind, rest[0], self._fold(rest[1]), self._fold_body(rest[2]))]
            elif kind == "generation":
                new = [(kind, self._fold_body(rest[0]))]
            else:
                new = self._fold_if(*rest)
            for node in new:
                if node[0] == "text" and found and found[-1][0] == "text":
                    node = "text", found.pop()[1] + node[1]
                if node != ("text", ""):
                    found.append(node)
        return found

    def _fold_if(self, branches: list, other: list) -> list:
        kept = []
        for test, inner in branches:
            test = self._fold(test)
            if test[0] == "constant" and not test[1]:
                continue
            if test[0] == "constant":
                other = inner
                break
            kept.append((test, self._fold_body(inner)))
        other = self._fold_body(other)
        return [("if", kept, other)] if kept else other

    # Closures

    def _value(self, node: tuple) -> Callable:
        kind, *rest = node
        if kind == "constant":
            constant = rest[0]
            return lambda env: constant
        if kind == "name":
            name = rest[0]
            return lambda env: env.get(name, UNDEFINED)
        if kind == "filter":
            run, value, args = self.filters[rest[0]], self._value(rest[1]), [self._value(a) for a in rest[2]]
            if len(args) != (rest[0] == "default"):
                raise TemplateError(f"{rest[0]} takes {int(rest[0] == 'default')} values")
            return lambda env: run(value(env), *(a(env) for a in args))
        if kind == "binary":
            run, a, b = BINARY[rest[0]], self._value(rest[1]), self._value(rest[2])
            return lambda env: run(a(env), b(env))
        if kind == "is":
            value = self._value(rest[1])
            return (lambda env: value(env) is None) if rest[0] == "none" else (lambda env: value(env) is not UNDEFINED)
        parts = [self._value(p) for p in rest]
        if kind == "not":
            return lambda env, a=parts[0]: not a(env)
        a, b = parts[:2]
        if kind == "member":
            return lambda env: _member(a(env), b(env))
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "or":
            return lambda env: a(env) or b(env)
        c = parts[2]
        return lambda env: b(env) if a(env) else c(env)

    def _body(self, nodes: list) -> Callable:
        runs = [getattr(self, f"_{kind}")(*rest) for kind, *rest in nodes]

        def run(env: dict, block: list[int]) -> Iterator[tuple[str, int]]:
            for each in runs:
                yield from each(env, block)

        return run

    def _text(self, text: str) -> Callable:
        return lambda env, block: ((text, block[0]),)

    def _print(self, node: tuple) -> Callable:
        value = self._value(node)
        return lambda env, block: ((_printed(value(env)), block[0]),)

    def _set(self, name: str, node: tuple) -> Callable:
        value = self._value(node)

        def run(env: dict, block: list[int]) -> tuple:
            env[name] = value(env)
            return ()

        return run

    def _if(self, branches: list, other: list) -> Callable:
        tests = [(self._value(test), self._body(inner)) for test, inner in branches]
        last = self._body(other)
        return lambda env, block: next((inner for test, inner in tests if test(env)), last)(env, block)

    def _for(self, name: str, node: tuple, inner: list) -> Callable:
        items, body = self._value(node), self._body(inner)

        def run(env: dict, block: list[int]) -> Iterator[tuple[str, int]]:
            found = items(env)
            if isinstance(found, str | dict | int) or found is None:
                raise TemplateError("only a list can be gone through")
            rest, end = iter(found if found is not UNDEFINED else ()), object()
            item, k = next(rest, end), 0
            while item is not end:
                after = next(rest, end)
                loop = {"index": k + 1, "index0": k, "first": k == 0, "last": after is end}
                yield from body(env | {name: item, "loop": loop}, block)
                item, k = after, k + 1

        return run

    def _generation(self, inner: list) -> Callable:
        body = self._body(inner)

        def run(env: dict, block: list[int]) -> Iterator[tuple[str, int]]:
            outer = block[0]
            block[1] += 1
            block[0] = block[1]
            yield from body(env, block)
            block[0] = outer

        return run
