"""Functions paired with their documentation.

A state machine that knows strings and comments lexes a source; braces (C) or
indentation (Python) delimit functions; the docstring, or the comments that stand
immediately before a function, are its documentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.links import LINK
from pagemill.session import spread

SCHEMA = "identity string, signature string, documentation string, code string, trivial boolean"

_PY = re.compile(
    r"""(?P<comment>\#[^\n]*)
    |(?P<string>(?P<prefix>[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)))
    |(?P<word>\w+)|(?P<join>\\\n)|(?P<newline>\n)|(?P<blank>[ \t\r\f]+)|(?P<other>.)""",
    re.X | re.S,
)
_C = re.compile(
    r"""(?P<comment>//(?:[^\n\\]|\\.)*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))
    |(?P<directive>^[ \t]*\#(?:/\*.*?\*/|//[^\n]*|[^\n\\/]|/(?![*/])|\\.)*)
    |(?P<word>\w+)|(?P<blank>\s+)|(?P<other>.)""",
    re.X | re.S | re.M,
)


def _unquote(prefix: str, token: str) -> str:
    body = token[len(prefix) :]
    q = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    body = body[len(q) :]
    body = body[: -len(q)] if body.endswith(q) else body
    if "r" not in prefix.lower():
        body = re.sub(r"\\(\n|[\\'\"nt])", lambda m: {"\n": "", "n": "\n", "t": "\t"}.get(m[1], m[1]), body)
    return body


def python_functions(source: str, first_only: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, signature, docstring or '') of each function, by indentation."""
    tokens = [(m.lastgroup if m.lastgroup != "prefix" else "string", m) for m in _PY.finditer(source)]
    n, depth, line_start = len(tokens), 0, True
    for k in range(n):
        kind, m = tokens[k]
        if kind == "other":
            depth += (m[0] in "([{") - (m[0] in ")]}")
        if kind in ("newline", "blank", "comment", "join"):
            line_start = (line_start or kind == "newline") if depth <= 0 or kind == "newline" else line_start
            continue
        starts, line_start = line_start, False
        if not (kind == "word" and m[0] in ("def", "async") and starts and depth <= 0):
            continue
        if m[0] == "async" and not any(t[1][0] == "def" for t in tokens[k + 1 : k + 3]):
            continue
        # the signature ends at the colon outside brackets
        d, j = 0, k
        while j < n:
            t = tokens[j][1][0]
            if tokens[j][0] == "other":
                d += (t in "([{") - (t in ")]}")
                if t == ":" and d == 0:
                    break
            j += 1
        if j >= n:
            return
        signature = " ".join(source[m.start() : tokens[j][1].start()].split())
        doc, i = [], j + 1
        while i < n:
            what, t = tokens[i]
            if what == "string" and not set(t["prefix"].lower()) & set("bft"):
                doc.append(_unquote(t["prefix"], t[0]))
            elif what in ("newline", "join", "comment") and doc and what == "newline" or what not in ("newline", "blank", "comment", "join"):
                break
            i += 1
        if i < n and tokens[i][0] not in ("newline",) and tokens[i][1][0] != ";":
            doc = []  # a string within a larger expression is none
        indent = len(m.string[: m.start()].rpartition("\n")[2])
        end = re.compile(r"^[ \t]{0,%d}(?=[^\s#])" % indent, re.M).search(source, tokens[j][1].end())
        while end and (not source[end.start() : end.end()].isspace() and end.start() != end.end() or _inside(tokens, end.end())):
            end = re.compile(r"^[ \t]{0,%d}(?=[^\s#])" % indent, re.M).search(source, end.end() + 1)
        yield m.start(), end.start() if end else len(source), signature, "".join(doc)
        if first_only:
            return


def _inside(tokens: list, at: int) -> bool:
    """Whether a place lies within a string token."""
    lo, hi = 0, len(tokens)
    while lo < hi:
        mid = (lo + hi) // 2
        if tokens[mid][1].end() <= at:
            lo = mid + 1
        else:
            hi = mid
    return lo < len(tokens) and tokens[lo][0] == "string" and tokens[lo][1].start() < at


#: fixed values: words whose parentheses hold no parameters
_NO_PARAMETERS = frozenset("__attribute__ __attribute __declspec _Alignas alignas __asm__ __asm asm _Atomic typeof __typeof__ __typeof throw noexcept".split())


def _parameters(head: list[str]) -> tuple[int, int] | None:
    """Places of the parentheses of a definition's parameters among its code tokens, None when it is no function's."""
    if head[0] == "typedef":
        return None
    depth, found, start = 0, None, 0
    for k, t in enumerate(head):
        if t == "(":
            if depth == 0:
                start = k
            depth += 1
        elif t == ")":
            depth -= 1
            if depth == 0 and start and found is None:
                named = head[start - 1] not in _NO_PARAMETERS and (re.match(r"[^\W\d]", head[start - 1]) or head[start - 1] == ")")
                tag = start > 1 and head[start - 2] in ("struct", "union", "enum")
                # the parentheses of a pointer's or a bracketed name are followed by those of its parameters
                if (named or head[start + 1] != "*" and head[start - 1] == "*") and not tag and head[k + 1 : k + 2] != ["("]:
                    found = start, k
        elif t == "=" and depth <= 0:
            return None
    return found if depth <= 0 else None


def _old_style(head: list[str], since: int) -> bool:
    """Whether the tokens from ``since`` on, up to a ';', declare parameters that the head lists by name alone."""
    at = _parameters(head)
    if at is None:
        return False
    listed = head[at[0] + 1 : at[1]]
    names = set(listed[::2])
    said = head[max(since, at[1] + 1) :]
    return set(listed[1::2]) <= {","} and all(re.match(r"[^\W\d]", n) for n in names) and len(said) > 1 and bool(names & set(said[1:]))


def c_functions(source: str, first_only: bool = False) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, signature, comments before or '') of each function, by matched braces.

    Code tokens alone tell a function: comments, attributes, macros and old-style declarations may stand
    between its parameters and its body. Signatures are without comments.
    """
    comments: list[str] = []
    late: list[str] = []  # comments since the last ';' of an old-style head
    head: list[str] = []
    places: list[int] = []
    cuts: list[tuple[int, int]] = []  # comments and directives within the head
    begin, depth, parens, since, signature = None, 0, 0, 0, None
    for m in _C.finditer(source):
        kind, t = m.lastgroup, m[0]
        if depth:
            if kind == "other":
                depth += (t == "{") - (t == "}")
                if depth == 0:
                    if signature is not None:
                        yield begin, m.end(), signature, "\n".join(comments)
                        if first_only:
                            return
                    comments, begin = [], None
            continue
        if kind == "comment":
            if begin is None:
                comments.append(t)
            else:
                cuts.append(m.span())
                if since == len(head):
                    late.append(t)
        elif kind == "directive":
            if begin is not None and parens > 0:
                cuts.append(m.span())
            else:
                comments, begin = [], None
        elif kind == "blank":
            continue
        else:
            if begin is None:
                begin, parens, since, signature = m.start(), 0, 0, None
                head, places, cuts, late = [], [], [], []
            if t == "{":
                if 0 < since < len(head):  # the declarations before were no function's
                    begin, comments = places[since], late
                    head = head[since:]
                depth = 1
                if parens <= 0 and head and _parameters(head):
                    text, at = [], begin
                    for x, y in cuts:
                        if x >= begin:
                            text.append(source[at:x])
                            at = y
                    signature = " ".join(" ".join([*text, source[at : m.start()]]).split())
                continue
            if t == ";" and parens <= 0:
                if head and _old_style(head, since):
                    head.append(t)
                    places.append(m.start())
                    since, late = len(head), []
                else:
                    comments, begin = [], None
                continue
            parens += (t == "(") - (t == ")")
            head.append(t)
            places.append(m.start())
    if depth and signature is not None:  # cut off within its body
        yield begin, len(source), signature, "\n".join(comments)


FUNCTIONS = {"python": python_functions, "c": c_functions}


def documentation(language: str | None, docstring: str | None, source: str | None) -> str:
    """The docstring when it is not blank, else what the source holds: of C also the comment that opens it."""
    if docstring and docstring.strip():
        return docstring
    find = FUNCTIONS.get(language or "")
    found = next((f[3] for f in find(source or "", True)), "") if find else ""
    return found if found or language != "c" else _opening(source or "")


def _opening(source: str) -> str:
    """The comments that stand before everything else in a C source."""
    found = []
    for m in _C.finditer(source):
        if m.lastgroup == "comment":
            found.append(m[0])
        elif m.lastgroup != "blank":
            break
    return "\n".join(found)


# --- what makes documentation trivial ---

_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\w)|//+[!/]?<?|#+)?[ \t]*|[ \t]*\*+/[ \t]*$", re.M)
_TITLE = re.compile(
    r"^\W*(?:args?|arguments?|param(?:eter)?s?|returns?|yields?|raises?|throws?|exceptions?|notes?|examples?|see also|attributes?|keyword args?(?:uments)?|other parameters|warnings?|todo|usage"
    r"|argumente?|parametri|parámetros|paramètres|argumentos|rückgabe|rückgabewert|devuelve|retorna|retours?|renvoie|ausnahmen|hinweise?|notas?|ejemplos?|beispiele?)\W*$",
    re.I,
)
_ENTRY = re.compile(
    r"^\W*(?:[@\\:]\s*(?:param|parameter|arg|argument|tparam|type|rtype|returns?|retval|throws?|raises?|exception|yields?|ivar|cvar|var|in|out)\b(?:\s*\[[^\]]*\])?[ \t]*(?:[\w.*\[\], ]*?:|[\w*.]+(?=\s*$|\s))?|(?:returns?|yields?|raises?|\*{0,2}\w+)[ \t]*(?:\([^)\n]*\))?[ \t]*:)[ \t]*(?P<rest>.*)$",
    re.I,
)
#: fixed values: words by which a text says that documentation is wanting, in several languages
_WANTING = re.compile(
    r"\b(?:todo|fixme|xxx+|tbd|tba|tbc|wip|hack|placeholder|undocumented|autogenerated|auto-generated|generated|lorem|later|missing|pending|follows?|soon|none|no|not|goes here|here|please|fill in|add|write|document|describe|update|insert|needs?|to be|internal"
    r"|fehlt|fehlen|folgt|folgen|noch|später|ergänzen|kommt|keine?|platzhalter|undokumentiert|offen|nachtragen|bitte"
    r"|falta|faltan|pendiente|por|sin|luego|después|más tarde|completar|añadir|agregar|escribir|rellenar|aquí"
    r"|manque|manquante?|à|faire|venir|compléter|remplir|aucune?|plus tard|ajouter|écrire|sans"
    r"|manca|mancante|scrivere|aggiungere|dopo|da|nessuna|falta|adicionar|escrever|depois|sem|ontbreekt|volgt|nog|geen|brak|uzupełnić|później)\b",
    re.I,
)
_SUBJECT = re.compile(
    r"\b(?:docs?|docstrings?|documentation|documents?|documented|documenting|descriptions?|describe|summary|comments?|explanation|javadoc|doxygen"
    r"|beschreibung(?:en)?|dokumentation|doku|kommentar|zusammenfassung|erklärung"
    r"|descripción|documentación|documentar|documentado|resumen|comentario|describir"
    r"|documenter|commentaire|résumé|décrire|descrizione|documentazione|documentare|commento|descrição|documentação|beschrijving|documentatie|opis|dokumentacja)\b",
    re.I,
)
_NOTHING = re.compile(
    r"^\W*(?:todo|fixme|xxx+|tbd|tba|tbc|wip|n/?a|none|null|nil|placeholder|internal|private|undocumented|autogenerated(?: \w+)?|see (?:above|below|source|code|the code|parent|base class)|siehe oben|ver arriba|voir ci-dessus|inherited|_\w+_|\.+|-+|lorem ipsum.*)\W*$",
    re.I,
)
_MARKER = re.compile(r"^\W*(?:todo|fixme|xxx+|tbd|tba|hack)\b", re.I)
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_CJK_WANTING = re.compile(r"待补充|待完善|待写|暂无|未记录|未完成|後で|未記載|ドキュメント.*(?:なし|後)|説明なし|추후|없음|자리표시")


def content(doc: str) -> str:
    """The documentation without comment marks, section titles, rules and entries that say nothing."""
    kept = []
    doc = re.sub(r"[ \t]+(?=[@\\:](?:param|return|returns|throws|raises|type|rtype)\b)", "\n", doc)  # entries in one line
    for line in _MARKS.sub("", doc).split("\n"):
        line = line.strip()
        if not re.search(r"\w", line) or LINK.match(line) or _TITLE.match(line):
            continue
        e = _ENTRY.match(line)
        if e:
            rest = e["rest"].strip()
            # a type alone, or the entry's own name again, says nothing
            if not re.search(r"\w", rest) or re.fullmatch(r"[\w.\[\], |*]{1,24}", rest) and len(rest.split()) < 2:
                continue
        kept.append(line)
    return "\n".join(kept)


def _placeholder(text: str, n: int) -> bool:
    """Whether a text of n words only says that documentation is still missing."""
    if _NOTHING.match(text) or _CJK_WANTING.search(text):
        return True
    if _MARKER.match(text) and (n <= 12 or _SUBJECT.search(text)) and not re.search(r"[.!?]\s+\w+(?:\W+\w+){3}", text):
        return True
    return n <= 10 and bool(_SUBJECT.search(text)) and bool(_WANTING.search(text)) and not re.search(r"[.!?]\s+\w", text.strip())


def is_trivial(doc: str, name: str | None) -> bool:
    """Fewer than four words, the function's name again, or a placeholder."""
    text = content(doc or "")
    found = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text)
    n = len(found) + len(_CJK.findall(text)) // 2
    if n < 4:
        return True
    own = re.sub(r"[\W_]+", "", (name or "")).lower()
    if own and re.sub(r"[\W_]+", "", text).lower() in (own, own * 2):
        return True
    said = {w.lower() for w in re.findall(r"[^\W_]+", text)} - {"the", "a", "an", "of", "this", "function", "method"}
    if name and said <= {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}:
        return True
    return _placeholder(text, n)


def documented_functions(definitions: DataFrame) -> DataFrame:
    """Code-description pairs of the function pages: identity, signature, documentation, code, trivial.

    Pages without any documentation are left out; ``trivial`` marks documentation that is empty of
    content. Null or blank docstrings fall back to the source, a null source to nothing; a null
    name repeats nothing; languages other than python and c use the docstring alone. Repeated
    rows count once and extra columns do not matter. Whole sources are read, of any length.
    """
    rows = definitions.where("kind = 'function'").select("identity", "language", "name", "docstring", "signature", "source")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for identity, language, name, doc, signature, text in zip(*(c.to_pylist() for c in b.columns)):
                found = documentation(language, doc, text)
                if not found.strip():
                    continue
                if not signature and language in FUNCTIONS:
                    signature = next((f[2] for f in FUNCTIONS[language](text or "", True)), None)
                for column, x in zip(out, (identity, signature, found, text, is_trivial(found, name))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _ARROW.types)], schema=_ARROW)

    return spread(rows).mapInArrow(paired, SCHEMA)


_ARROW = pa.schema([("identity", pa.string()), ("signature", pa.string()), ("documentation", pa.string()), ("code", pa.string()), ("trivial", pa.bool_())])


def extracted_functions(files: DataFrame) -> DataFrame:
    """(identity, start, stop, signature, documentation, trivial) of every documented function in whole files (identity, language, source).

    Braces, or indentation, delimit a function; ``start`` and ``stop`` are its place in the source, the documentation included. Functions
    without any documentation have no row; null sources and other languages than python and c have none.
    """
    kinds = "identity string, start int, stop int, signature string, documentation string, trivial boolean"
    schema = pa.schema([("identity", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("signature", pa.string()), ("documentation", pa.string()), ("trivial", pa.bool_())])

    def lexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (i, *f[:4], is_trivial(f[3], f[2].split("(")[0].split()[-1] if f[2].split("(")[0].split() else None))
                for i, lang, text in zip(*(c.to_pylist() for c in b.columns)) if text and lang in FUNCTIONS for f in FUNCTIONS[lang](text) if f[3].strip()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return spread(files.select("identity", "language", "source")).mapInArrow(lexed, kinds)
