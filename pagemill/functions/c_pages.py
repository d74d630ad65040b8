"""Pages of a C file: the file itself, functions, initialised variables, tagged types, typedefs and macros.

A scanner over tokens, without a grammar: definitions are told at file scope by their
braces, parentheses and initialisers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pagemill.functions.links import LINK
from pagemill.functions.pagetext import normalized, own_text
from pagemill.functions.python_pages import link_rows

#: fixed values: words of the language, which shapes keep
KEYWORDS = frozenset(
    """auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short
    signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary _Alignas _Alignof _Atomic _Generic _Noreturn
    _Static_assert _Thread_local defined""".split()
)
_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//(?:[^\n\\]|\\.)*)|(?P<directive>^[ \t]*\#(?:/\*.*?\*/|//[^\n]*|[^\n\\/]|/(?![*/])|\\\n|\\.)*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<id>[A-Za-z_]\w*)|(?P<num>\.?\d(?:[\w.]|(?<=[eEpP])[+-])*)|(?P<space>\s+)|(?P<op>->|\+\+|--|<<=|>>=|\.\.\.|&&|\|\||[-+*/%&|^!=<>]=|<<|>>|.)""",
    re.X | re.S | re.M,
)


def c_shape(text: str) -> str:
    """Names numbered by first appearance, literals without value, the rest as it is."""
    seen: dict[str, str] = {}
    words: list[str] = []

    def scan(part: str) -> None:
        for m in _TOKEN.finditer(part):
            kind, t = m.lastgroup, m[0]
            if kind in ("comment", "space"):
                continue
            if kind == "directive":
                head = re.match(r"\s*#\s*(\w*)", t)
                words.append("#" + head[1])
                rest = t[head.end() :]
                if head[1] == "include" and "<" in rest:
                    words.append("<str>")
                else:
                    scan(rest.replace("\\\n", " "))
            elif kind == "num":
                words.append("<num>")
            elif kind == "str":
                words.append("<str>")
            elif kind == "id" and t not in KEYWORDS and t not in _TYPES:
                words.append(seen.setdefault(t, f"${len(seen)}"))
            else:
                words.append(t)

    scan(normalized(text))
    return " ".join(words)


_CATEGORY = {"id": "identifier", "num": "number", "str": "string", "op": "punctuation", "directive": "directive"}


def c_tokens(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(row from 1, position from 0, category, token) of a text's tokens, comments left out."""
    row, upto, position = 1, 0, 0
    for m in _TOKEN.finditer(text):
        if m.lastgroup in ("comment", "space"):
            continue
        row, upto = row + text.count("\n", upto, m.start()), m.start()
        yield row, position, "keyword" if m.lastgroup == "id" and m[0] in KEYWORDS else _CATEGORY[m.lastgroup], m[0].strip()
        position += 1


_TYPES = frozenset("size_t ssize_t ptrdiff_t intptr_t uintptr_t bool int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t".split())


#: what makes a comment of a text: its ends, and what its lines begin with
_MARKS = re.compile(r"\*+/\Z|^[ \t]*(?:/\*+|/{2,}|\*++(?!/))?[ \t]*", re.M)


def _said_above(text: str, comment: re.Match | None, start: int) -> str | None:
    """A comment's first paragraph in one line, up to where parameters are told; null unless it ends right above ``start``, or for a link line."""
    if comment is None or text.count("\n", comment.end(), start) != 1 or LINK.match(comment[0]):
        return None
    prose = _MARKS.sub("", comment[0]).strip()
    first = re.split(r"\n\s*(?:\n|@)", prose, maxsplit=1)[0]
    return None if first.startswith("@") else " ".join(x.strip() for x in first.split("\n")) or None


def _flat(text: str) -> str:
    return " ".join(text.split())


def definitions(text: str) -> Iterator[tuple[str, str, int, int, str, str | None]]:
    """(symbol, kind, start, end, signature, comment) of the definitions at file scope, in order, repeats included."""
    comment: re.Match | None = None
    begin: int | None = None
    above: re.Match | None = None
    parts: list[tuple[str, str, int]] = []  # tokens of the current statement at depth 0; groups as one token
    depth, opener = 0, 0
    for m in _TOKEN.finditer(text):
        kind, t, at = m.lastgroup, m[0], m.start()
        if kind == "space":
            continue
        if kind == "comment":
            if depth == 0 and begin is None:
                comment = m
            continue
        if kind == "directive":
            if depth == 0 and (d := re.match(r"[ \t]*#[ \t]*define[ \t]+(\w+)(\([^)]*\))?", t)):
                start = at + len(t) - len(t.lstrip())
                yield d[1], "macro", start, m.end(), d[1] + _flat(d[2] or ""), _said_above(text, comment, start)
            if begin is None:
                comment = None
            continue
        if begin is None:
            begin, above, comment, parts = at, comment, None, []
        if t in "([{" and kind == "op":
            if depth == 0:
                opener = at
            depth += 1
            continue
        if t in ")]}" and kind == "op":
            depth = max(0, depth - 1)
            if depth == 0:
                parts.append((text[opener], text[opener : m.end()], opener))
                if t == "}" and _is_function(parts):
                    yield from _statement(text, parts, begin, m.end(), above)
                    begin = None
            continue
        if depth == 0:
            if t == ";":
                yield from _statement(text, parts, begin, m.end(), above)
                begin = None
            else:
                parts.append(("id" if kind == "id" else t, t, at))


def _is_function(parts: list[tuple[str, str, int]]) -> bool:
    kinds = [k for k, _, _ in parts]
    return "(" in kinds and "=" not in kinds and kinds[-1] == "{" and kinds[-2:-1] != ["id"] and "typedef" not in {t for _, t, _ in parts}


def _statement(text: str, parts: list, begin: int, end: int, above: re.Match | None) -> Iterator[tuple]:
    kinds, words = [k for k, _, _ in parts], [t for _, t, _ in parts]
    doc = _said_above(text, above, begin)
    for i, w in enumerate(words):  # tagged types with a body, wherever they stand in the statement
        if w in ("struct", "union", "enum") and kinds[i + 1 : i + 3] == ["id", "{"]:
            stop = parts[i + 2][2] + len(words[i + 2])
            alone = i == 0
            yield f"{w}.{words[i + 1]}", "type", parts[i][2], stop, f"{w} {words[i + 1]}", doc if alone else None
    if not words:
        return
    if words[0] == "typedef":
        names = [t for k, t, _ in parts if k == "id" and t not in KEYWORDS]
        if names and kinds[-1] == "id":
            head = text[begin : parts[kinds.index("{")][2]] if "{" in kinds else text[begin : end - 1]
            yield names[-1], "type", begin, end, _flat(head), doc
        return
    if kinds[-1] == "{" and _is_function(parts):
        name = next((words[i - 1] for i in range(1, len(kinds)) if kinds[i] == "(" and kinds[i - 1] == "id"), None)
        if name:
            yield name, "function", begin, end, _flat(text[begin : parts[-1][2]]), doc
        return
    if "=" in words:
        at = words.index("=")
        name = next((words[i] for i in range(at - 1, -1, -1) if kinds[i] == "id" and words[i] not in KEYWORDS), None)
        if name and at > 1:
            yield name, "constant", begin, end, _flat(text[begin : parts[at][2]]), doc


def c_pages(source: str) -> Iterator[dict]:
    """Pages as dicts; the file first, of several definitions of a symbol the first."""
    text = normalized(source)
    lines = text.split("\n")
    kept, links = own_text(lines)
    none = {"refs": [], "unresolved": [], "parsed": True}
    yield {"symbol": None, "kind": "script", "source": normalized("\n".join(kept)) if links else text, "first": 1, "last": text.count("\n"), "links": links} | none
    done: set[str] = set()
    for symbol, kind, start, stop, head, doc in definitions(text):
        if symbol in done:
            continue
        done.add(symbol)
        first, last = text.count("\n", 0, start) + 1, text.count("\n", 0, stop - 1) + 1
        own = lines[first - 1 : last]
        yield {"symbol": symbol, "kind": kind, "source": normalized("\n".join(own)), "first": first, "last": last, "signature": head, "docstring": doc, "links": link_rows(own, first)} | none
