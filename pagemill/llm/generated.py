"""Files that nobody in a repository wrote by hand.

Each file is lexed and its canonical layout emitted (one statement a line); the
original layout is held against it. Lines that expand extremely are minified,
definitions that repeat one shape without exception are generated, and a file whose
text is mostly literals of one collection is a data blob. Marks that programs
leave in comments, and marks or folders of third-party copies, count as well; the same
words in strings, docstrings or names do not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.links import LINK
from pagemill.session import spread
from pagemill.tables import whole_files

#: how many canonical lines a line of code holds, on average, before it counts as minified
EXPANSION = 5.0
#: and how many characters such a line has at least
LONG_LINE = 200
#: share of the characters of code, and of the tokens, that are literals in a data blob; and how many characters at least
BLOB_CHARS, BLOB_TOKENS, BLOB_LEAST = 0.6, 0.3, 200
#: share of the definitions (at least so many) that have one shape in a generated file
UNIFORM, UNIFORM_LEAST = 0.9, 3
#: share of the lines that are records of one shape, where there are fewer definitions
ROWS_ALIKE = 0.5

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|`(?:[^`\\]|\\.)*(?:`|\Z))
    |(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$\x80-\U0010ffff][\w$]*)|(?P<line>\n)|(?P<other>[^\s])""",
    re.X | re.S,
)
_HASH = re.compile(_TOKEN.pattern.replace("//[^\\n]*|/\\*.*?(?:\\*/|\\Z)", "\\#[^\\n]*"), re.X | re.S)

#: fixed values: how generators mark their output, in comments, where its layout does not tell
GENERATED = re.compile(
    r"@generated\b|\b(?:auto(?:matically)?|machine|code)[- _]?generated\b(?! (?:doc|comment|descr|summar|stub))|\bgenerated (?:by|from|using|with|automatically|file|code|source|at|on)\b"
    r"|\bautomatically (?:produced|created|built|made|written|derived)\b|\bdo not (?:edit|modify|change)(?: (?:this|it|by hand|manually|directly)\b|[ .!*/#-]*$)"
    r"|\bgénéré (?:par|automatiquement)\b|\b(?:maschinell|automatisch)\b.{0,40}\b(?:erzeugt|erstellt|generiert)\b|\bgenerado (?:por|automáticamente)\b|\bgenerato (?:da|automaticamente)\b|\bgerado (?:por|automaticamente)\b",
    re.I | re.M,
)
#: fixed values: how carried-over files are marked, in comments
VENDORED = re.compile(
    r"\bvendored (?:from|copy|in from|version)\b|\bthird[- ]party (?:copy|code|file|source|library|component)\b|\b(?:bundled|embedded|verbatim|unmodified|local) (?:copy|version) of\b"
    r"|\b(?:taken over|imported|copied|borrowed|pulled|mirrored)(?: (?:in|unmodified|verbatim|unchanged|as is|directly))* from (?:the \S+ project|\S+[./]\S+|\S+ (?:at|rev|version|release)\b)"
    r"|(?:^|[\s*/#])upstream: ?\S+|\bthis is a snapshot of\b|\bsnapshot of \S+ [\d.]+|\bkept in sync (?:by|with)\b|\breport (?:faults|bugs|issues) to its (?:makers|authors)\b|\bsee its own repository\b|\blocal (?:changes|modifications): none\b"
    r"|\bübernommen aus\b|\bkopie (?:von|aus)\b.*\S+[./]\S+|\bcopie (?:conforme )?de \S+[./]\S+|\bcopiado de \S+[./]\S+",
    re.I | re.M,
)
#: fixed values: folders that hold carried-over projects
VENDOR_FOLDER = re.compile(
    r"(?:^|/)(?:third[_-]?party|3rd[_-]?party|3rdparty|thirdparty|vendor|_vendor|vendored|_vendored|extern|externals?|ext[_-]?libs?|deps|_deps|dependencies|subprojects|packagefiles|_?bundled|contrib/ext|contrib/third_party|node_modules|bower_components|site-packages|godeps|pods|carthage|foreign|imported)/",
    re.I,
)


def _lex(text: str, hash_comments: bool) -> list[tuple[str, str, int]]:
    return [(m.lastgroup, m[0], m.start()) for m in (_HASH if hash_comments else _TOKEN).finditer(text)]


#: fixed values: suffixes of languages whose comments are // and /* */
_SLASHES = ("c", "h", "js", "ts", "java", "go", "rs", "cc", "cpp", "hpp", "css", "jsx", "tsx", "mjs")


def _hash_comments(language: str | None, path_hint: str) -> bool:
    return language == "python" or not path_hint.rsplit(".", 1)[-1].lower() in _SLASHES and language != "c"


def canonical_lines(tokens: list[tuple[str, str, int]], by_line: bool) -> int:
    """Lines of the canonical layout: one statement a line. Statements end at ';' and braces, or (``by_line``) at line ends too."""
    lines, depth, filled, words = 0, 0, False, False
    for kind, t, _ in tokens:
        if kind == "comment":
            continue
        if kind == "line":
            if by_line and depth <= 0 and filled:
                lines, filled = lines + 1, False
            continue
        filled = True
        if t in ("(", "["):
            depth += 1
        elif t in (")", "]"):
            depth -= 1
        elif t in ("{", "}") and not by_line or t == ";" and depth <= 0:
            lines, filled = lines + 1, False
    return lines + filled


def _shapes(tokens: list[tuple[str, str, int]], by_line: bool) -> Counter:
    """Shapes of the definitions that stand at the margin: names and literals without their values."""
    shapes: Counter = Counter()
    text: list[str] = []
    depth, prev_line, opened = 0, True, False
    column = True  # the next token starts a line
    last_end = -1

    def close() -> None:
        nonlocal text
        if "(" in text:
            shapes[" ".join(text)] += 1
        text = []

    if by_line:
        start_of: list[int] = []
        for kind, t, at in tokens:
            if kind == "line":
                column, last_end = True, at + 1
                continue
            if kind == "comment":
                column = False
                continue
            if column and at == last_end and t in ("def", "class", "async", "@") or last_end == -1 and not text:
                close()
            elif column and at == last_end and depth <= 0:
                close()
                column = False
                start_of.append(at)
                text = ["\0"]  # no definition
            if text[:1] != ["\0"]:
                text.append(t if kind == "other" or t in ("def", "class", "return", "if", "for", "while", "with", "try", "raise") else "9" if kind in ("number", "string") else "n")
            depth += (t in "([{") - (t in ")]}") if kind == "other" else 0
            column = False
        if text[:1] != ["\0"]:
            close()
        return shapes
    for kind, t, _ in tokens:
        if kind in ("line", "comment"):
            continue
        text.append(t if kind == "other" or t in ("return", "if", "for", "while", "static", "const", "struct", "function") else "9" if kind in ("number", "string") else "n")
        depth += (t == "{") - (t == "}") if kind == "other" else 0
        opened |= t == "{"
        if depth <= 0 and (t == ";" or t == "}"):
            if opened and "(" in text:
                shapes[" ".join(text)] += 1
            text, opened, depth = [], False, max(0, depth)
    return shapes


def verdict(text: str | None, language: str | None, path: str = "") -> str | None:
    """'generated', 'vendored', 'minified' or 'data' for a file's text, None for a hand-written or empty one."""
    if not text or not text.strip():
        return None
    hashes = _hash_comments(language, path)
    tokens = _lex(text, hashes)
    code = [(k, t, a) for k, t, a in tokens if k not in ("comment", "line")]
    # marks of a whole file stand above all code, or below it
    begin, end = (code[0][2], code[-1][2]) if code else (len(text), -1)
    for kind, t, at in tokens:
        if kind != "comment" or begin < at < end or text[text.rfind("\n", 0, at) + 1 : at].strip():
            continue
        for line in t.split("\n"):
            line = "" if LINK.match(line) else line.strip("#/*! \t")
            if at < begin and VENDORED.search(line):
                return "vendored"
            if GENERATED.search(line):
                return "generated"
    if not code:
        return None
    by_line = hashes
    size = sum(len(t) for _, t, _ in code)
    documents = _standing_strings(tokens)
    n_lines = _code_lines(text, [(t, a) for _, t, a in code if a not in documents])
    literals = [t for k, t, a in code if k in ("number", "string") and a not in documents]
    size -= sum(len(t) for _, t, a in code if a in documents)
    literal_size = sum(len(t) for t in literals)
    words = Counter(t for k, t, _ in code if k == "word")
    defines = sum(words[w] for w in ("def", "class", "function", "return", "if", "for", "while"))
    expansion = canonical_lines(tokens, by_line) / max(1, n_lines)
    if expansion >= EXPANSION and size / max(1, n_lines) >= LONG_LINE / 2 or size / max(1, n_lines) >= LONG_LINE and literal_size < BLOB_CHARS * size:
        return "minified"
    # punctuation between the members of a collection belongs to its literals
    inside = literal_size + sum(1 for k, t, _ in code if t == ",")
    statements = canonical_lines(tokens, by_line)
    if literal_size >= BLOB_LEAST and inside >= BLOB_CHARS * size and len(literals) >= BLOB_TOKENS * len(code) and not defines and literal_size / max(1, statements) >= BLOB_LEAST / 4:
        return "data"
    shapes = _shapes(tokens, by_line)
    total = sum(shapes.values())
    said = documents or any(k == "comment" and begin < a < end for k, _, a in tokens)
    if total and shapes.most_common(1)[0][1] >= UNIFORM * total and not said and _plain(shapes):
        if total >= UNIFORM_LEAST or _rows_alike(tokens) >= ROWS_ALIKE:
            return "generated"
    return None


def _code_lines(text: str, code: list[tuple[str, int]]) -> int:
    """Lines that hold code tokens or parts of them, in one pass over the tokens' places."""
    n, last, line, upto = 0, -1, 0, 0
    for t, at in code:
        line, upto = line + text.count("\n", upto, at), at
        end = line + t.count("\n")
        n += end - max(line - 1, last)
        last = end
    return n


def _rows_alike(tokens: list[tuple[str, str, int]]) -> float:
    """The share of a file's lines that are records of one shape, bracketed and of several members, if there are at least eight."""
    lines: list[list[str]] = [[]]
    for kind, t, _ in tokens:
        if kind == "line":
            lines.append([])
        elif kind != "comment":
            lines[-1].append(t if kind == "other" else "9" if kind in ("number", "string") else "n")
    shapes = Counter(" ".join(x) for x in lines if x)
    rows = {k: n for k, n in shapes.items() if k[0] in "{([" and k.count("9") > 1}
    most = max(rows.values(), default=0)
    return most / sum(shapes.values()) if most >= 8 else 0.0


def _standing_strings(tokens: list[tuple[str, str, int]]) -> set[int]:
    """Places of strings that are statements of their own: documentation, and no data."""
    found, depth, fresh = set(), 0, True
    for n, (kind, t, at) in enumerate(tokens):
        if kind == "string" and fresh and depth == 0 and (n + 1 == len(tokens) or tokens[n + 1][0] in ("line", "comment")):
            found.add(at)
        if kind == "other":
            depth += (t in "([{") - (t in ")]}")
        fresh = kind == "line" or fresh and kind == "comment"
    return found


def _plain(shapes: Counter) -> bool:
    """Whether the uniform definitions do one thing each: return something."""
    top = shapes.most_common(1)[0][0].split()
    return len(top) <= 40 and top.count("return") == 1 and not {"if", "for", "while", "with", "try", "class"} & set(top)


def carried(path: str | None) -> bool:
    """Whether a path lies in a folder of carried-over projects."""
    return bool(path and VENDOR_FOLDER.search(path))


def machine_files(definitions: DataFrame, locations: DataFrame) -> DataFrame:
    """(repo, sha, path, verdict) of the whole-file places whose file nobody there wrote by hand.

    verdict: generated, minified, data or vendored. The text decides once for each identity and comment
    style, which the path's suffix tells; the folder decides once for each place. Empty or null texts are no cases, in whatever folder; places of pages
    without a row are left out; a null path is in no folder; repeated rows count once.
    """
    schema = pa.schema([("identity", pa.string()), ("hashes", pa.bool_()), ("verdict", pa.string()), ("blank", pa.bool_())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, texts = (c.to_pylist() for c in b.columns)
            rows = []
            for i, x, t in zip(ids, langs, texts):
                blank = not (t and t.strip())
                # only where the language doesn't tell the style do both have to be judged
                for hashes in sorted({_hash_comments(x, ""), _hash_comments(x, "a.js")}):
                    rows.append((i, hashes, verdict(t, x, "" if hashes else "a.js"), blank))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    pages = (
        spread(definitions.where("kind = 'script' and identity is not null").select("identity", "language", "source"))
        .mapInArrow(judged, "identity string, hashes boolean, verdict string, blank boolean").where("not blank").dropDuplicates(["identity", "hashes"])
    )
    folder = F.col("path").rlike(f"(?i){VENDOR_FOLDER.pattern}")
    slashes = F.coalesce(F.lower(F.substring_index("path", ".", -1)).isin(*_SLASHES), F.lit(False))
    places = whole_files(locations).withColumn("slashes", slashes)
    # a page judged in one style has it at every path
    fits = (F.col("hashes") != F.col("slashes")) | ~F.col("both")
    pages = pages.groupBy("identity").agg(F.collect_list(F.struct("hashes", "verdict")).alias("styles"))
    pages = pages.select("identity", F.explode("styles").alias("style"), (F.size("styles") > 1).alias("both")).select("identity", "both", "style.*")
    return (
        places.join(pages, "identity").where(fits)
        .select("repo", "sha", "path", F.when(folder, F.lit("vendored")).otherwise(F.col("verdict")).alias("verdict"))
        .where("verdict is not null").distinct()
    )
