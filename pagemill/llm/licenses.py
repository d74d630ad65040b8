"""The licence of each code file and revision.

Names, notices and short texts of the known licences are token sequences in metric trees, one
for each length. Each stretch of a title, notice or field that may name a licence is
compared with them by token edit distance (bit-parallel), pruned by the triangle
inequality; the nearest template counts when it lies within a bound. Words themselves are read
in the same way, by the edit distance of their letters to the templates' words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.links import LINK
from pagemill.llm.functions_docs import _C, _PY
from pagemill.session import spread
from pagemill.tables import whole_files

#: fixed values: the licences and the ways they are named; '' stands for licences that are not among the eight
NAMES = {
    "MIT": ["mit", "expat", "expat mit", "mit expat", "mit x11", "x11 mit"],
    "Apache-2.0": ["apache 2", "apache software 2", "asl 2", "apache software foundation 2", "al 2"],
    "GPL-3.0": ["gpl 3", "gnu gpl 3", "gnu general public 3", "general public 3", "gnu general public gpl 3", "gnu 3"],
    "GPL-2.0": ["gpl 2", "gnu gpl 2", "gnu general public 2", "general public 2", "gnu general public gpl 2", "gnu 2"],
    "BSD-3-Clause": ["bsd 3", "bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd new", "bsd 3 clause new or revised", "3 bsd", "new or revised bsd", "bsd 3 clauses", "bsd with 3 clause"],
    "BSD-2-Clause": ["bsd 2", "bsd 2 clause", "2 clause bsd", "simplified bsd", "simplified bsd 2 clause", "bsd 2 clause simplified", "freebsd", "bsd simplified", "2 bsd"],
    "MPL-2.0": ["mpl 2", "mozilla public 2", "mozilla 2", "mozilla public mpl 2"],
    "ISC": ["isc", "internet systems consortium", "internet software consortium"],
    "": ["mit 0", "bsd 0", "0 bsd", "0 clause bsd", "lesser gpl 3", "lesser gpl 2", "lesser general public 3", "lesser general public 2", "gnu lesser general public 3", "gnu lesser general public 2", "library general public 2", "gnu library general public 2", "affero general public 3", "gnu affero general public 3", "affero gpl 3", "bsd 4 clause", "4 clause bsd", "gnu free documentation 3"],
}
#: fixed values: sentences by which a text grants a licence without naming it
NOTICES = {
    "MIT": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "BSD-3-Clause": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
}
_BSD = "redistribution and use in source and binary forms with or without modification are permitted"
#: fixed values: the texts of the short licences, after their titles and copyright lines
TEXTS = {
    "MIT": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software""",
    "ISC": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "BSD-2-Clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution""",
    "BSD-3-Clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission""",
}
_DROPPED = frozenset("the a version v ver license licenses licensed only later plus".split())
_SAME = {"licence": "license", "licences": "license", "licenced": "licensed", "two": "2", "three": "3", "four": "4", "zero": "0", "clauses": "clause", "gplv": "gpl", "mplv": "mpl", "lgplv": "lgpl", "aplv": "apache"}
_ANCHOR = re.compile(r"mit\b|expat|apache|asl|\bal\b|gpl|gnu|general|bsd|mpl|mozilla|isc\b|consortium|permission|redistribution|neither", re.I)
#: words that tell licences of a family apart: a template is never accepted with one more or less of them
_TELLING = frozenset("lesser library affero documentation new modified revised simplified clause free lgpl agpl".split())
_CONTEXT = re.compile(r"licen[sc]e|lizenz|licencia|spdx|free software|public|copying|released|terms|governed|covered|subject to|rights", re.I)
_NOTICE_SHARE = 0.2


def tokens(text: str) -> list[str]:
    """Words and numbers in lower case, misspelt ones as the templates spell them; versions lose words for 'version', and '.0'."""
    out: list[str] = []
    for t in re.findall(r"[a-z]+|\d+", text.lower()):
        t = _SAME.get(t, t)
        if len(t) > 4:
            t = _spelt(t)
            t = _SAME.get(t, t)
        if t in _DROPPED or t == "0" and out and out[-1].isdigit():
            continue
        out.append(t)
    return out


@lru_cache(maxsize=100_000)
def _spelt(word: str) -> str:
    """The templates' word that a word is with one letter wrong, missing or too many (two from ten letters on), else the word."""
    bound = 1 if len(word) < 10 else 2
    if word in _words()[1]:
        return word
    near = [hit for n in range(len(word) - bound, len(word) + bound + 1) if n in _words()[0] and (hit := _words()[0][n].nearest(tuple(word), bound))]
    return min(near)[1] if near else word


@lru_cache(maxsize=1)
def _words() -> tuple[dict[int, MetricTree], frozenset[str]]:
    """Words of names, in metric trees of letters by their length."""
    every = {w for texts in NAMES.values() for text in texts for w in re.findall(r"[a-z]+", text)} | _DROPPED | {"licence", "permission", "redistribution"}
    by_length: dict[int, MetricTree] = {}
    for w in sorted(every):
        if len(w) > 4:
            by_length.setdefault(len(w), MetricTree()).add(tuple(w), w)
    return by_length, frozenset(every)


def distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """Token edit distance, with a column of the table held in the bits of one number (Myers)."""
    m = len(a)
    if not m:
        return len(b)
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for t in b:
        eq = at.get(t, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        grow, shrink = down | ~(diag | up) & full, up & diag
        score += bool(grow & top) - bool(shrink & top)
        grow, shrink = (grow << 1 | 1) & full, shrink << 1 & full
        up, down = shrink | ~(diag | grow) & full, grow & diag
    return score


class MetricTree:
    """Templates by their distance to their parent; a search skips what the triangle inequality rules out."""

    def __init__(self) -> None:
        self.root: tuple | None = None

    def add(self, key: tuple[str, ...], value: str) -> None:
        if self.root is None:
            self.root = (key, value, {})
            return
        node = self.root
        while True:
            d = distance(node[0], key)
            if d == 0:
                return
            if d not in node[2]:
                node[2][d] = (key, value, {})
                return
            node = node[2][d]

    def nearest(self, key: tuple[str, ...], bound: int) -> tuple[int, str, tuple[str, ...]] | None:
        best, todo = None, [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = distance(node[0], key)
            if d <= bound and (best is None or d < best[0]):
                best, bound = (d, node[1], node[0]), d
            todo += [k for e, k in node[2].items() if abs(e - d) <= bound]
        return best


@lru_cache(maxsize=1)
def _index() -> dict[int, MetricTree]:
    by_length: dict[int, MetricTree] = {}
    for source in (NAMES, NOTICES, {"BSD": [_BSD]}):
        for spdx, texts in source.items():
            for text in texts:
                key = tuple(tokens(text))
                by_length.setdefault(len(key), MetricTree()).add(key, spdx)
    return by_length


@lru_cache(maxsize=1)
def _texts() -> dict[int, MetricTree]:
    by_length: dict[int, MetricTree] = {}
    for spdx, text in TEXTS.items():
        key = tuple(tokens(text))
        by_length.setdefault(len(key), MetricTree()).add(key, spdx)
    return by_length


def whole_text(text: str) -> str | None:
    """The licence whose whole text stands in ``text``, from its first sentence on, with at most a fifth of its tokens changed; of several the longest."""
    words = tokens(text)
    at = next((k for k, w in enumerate(words) if w in ("permission", "redistribution")), None)
    if at is None:
        return None
    hits = []
    for n, tree in _texts().items():
        if hit := tree.nearest(tuple(words[at : at + n]), int(n * _NOTICE_SHARE)):
            hits.append((-n, hit[0], hit[1]))
    return min(hits)[2] if hits else None


def _bound(length: int) -> int:
    """Short names must match token by token; from five tokens on one may differ, and a fifth of a notice."""
    return int(length * _NOTICE_SHARE) if length > 4 else 0


def _accepted(found: tuple[str, ...], template: tuple[str, ...]) -> bool:
    """Whether what differs between a name and its template leaves the licence as it is: no number, and no word that tells licences apart."""
    telling = lambda words: sorted(w for w in words if w.isdigit() or w in _TELLING)
    return found == template or telling(found) == telling(template)


@lru_cache(maxsize=50_000)
def named(text: str, sure: bool = False) -> tuple[str, ...]:
    """The licences that a title, notice or field names, in order of mention.

    ``sure``: the text is known to state a licence, so that a bare name is enough.
    """
    words = tokens(text)
    if not any(_ANCHOR.match(w) for w in words):
        return ()
    sure = sure or bool(_CONTEXT.search(text)) or any(w in ("license", "licensed") for w in map(_spelt, re.findall(r"[a-z]{5,}", text.lower())))
    found: list[str] = []
    k = 0
    lengths = sorted(_index(), reverse=True)
    while k < len(words):
        step = 1
        if _ANCHOR.match(words[k]) or words[k] in ("new", "modified", "revised", "simplified", "lesser", "library", "affero", "internet", "freebsd") or words[k].isdigit():
            for n in lengths:
                w = tuple(words[k : k + n])
                if len(w) < n:
                    continue
                hit = _index()[n].nearest(w, _bound(n))
                if hit and _accepted(w, hit[2]):
                    if n == 1 and not (sure and (len(words) == 1 or w[0].upper() in re.findall(r"[A-Z]+|\w+", text) or re.search(r"spdx|licen[sc]e\W*[:=]", text, re.I) or text.strip().lower() == w[0] or w[0] == "expat")):
                        break
                    step = n
                    found.append(hit[1])
                    break
        k += step
    found = [f for f in found if f]
    if "BSD" in found:  # the clauses tell which of the two it is
        found = [f for f in found if f != "BSD"] or ["BSD-2-Clause"]
    return tuple(dict.fromkeys(found))


_TERMS = re.compile(r"(?i)\W*(?:permission is hereby|permission to use|redistribution and use|terms and conditions|preamble\b|everyone is permitted|1\s*[.)]\s|section 1\b)")


def title(text: str | None) -> str:
    """What stands above the copyright line and the terms."""
    if not text:
        return ""
    head = re.split(r"(?im)^\W*(?:copyright|©)", text, maxsplit=1)[0]
    said = []
    for paragraph in re.split(r"\n[ \t]*(?:\n[ \t]*)+", head):
        if _TERMS.match(paragraph):
            break
        said.append(paragraph)
    return " ".join(" ".join(said).split())


def title_license(text: str | None) -> tuple[str, ...]:
    """Licences named by a licence file's title; where it has none, by its whole text or the sentence that grants it."""
    got = named(title(text), True)
    if got or not text:
        return got
    if not re.match(r"(?i)\W*(?:copyright|©|permission|redistribution)", text):
        return ()
    flat = " ".join(text.split())
    if not _GRANT.search(flat):
        return ()
    whole = whole_text(flat)
    return (whole,) if whole else named(flat)


_GRANT = re.compile(r"(?i)permission is hereby granted|permission to use|redistribution and use")
_ASSIGNED = re.compile(r"^[ \t]*_*licen[sc]e_*[ \t]*(?::[ \t]*\w+[ \t]*)?=[ \t]*[rRuUbB]?(?P<q>[\"'])(?P<value>[^\"'\n]*)(?P=q)", re.I | re.M)


def header(language: str, source: str) -> list[str]:
    """The statements of a file's header: lines of comments, and assigned licences, before its first definition."""
    lines: list[str] = []
    if language == "python":
        for m in _PY.finditer(source):
            if m.lastgroup == "word" and m[0] in ("def", "class", "async") and (m.start() == 0 or source[m.start() - 1] == "\n") or m[0] == "@" and (m.start() == 0 or source[m.start() - 1] == "\n"):
                break
            if m.lastgroup == "comment":
                lines.append(m[0].strip("# \t!"))
            elif m.lastgroup == "word" and re.fullmatch(r"_*licen[sc]e_*", m[0], re.I) and (a := _ASSIGNED.match(source, source.rfind("\n", 0, m.start()) + 1)):
                lines.append("License: " + a["value"])
    else:
        for m in _C.finditer(source):
            if m.lastgroup in ("word", "other") and m[0] != "MODULE_LICENSE":
                break
            if m[0] == "MODULE_LICENSE" and (a := re.match(r'\s*\(\s*"([^"\n]*)"', source[m.end() : m.end() + 200])):
                lines.append("License: " + a[1])
                break
            if m.lastgroup == "comment":
                lines += [x.strip("/* \t!") for x in m[0].split("\n")]
    return [x for x in lines if x and not LINK.match(x)]


def offered(language: str, source: str | None) -> list[list[str]]:
    """One list for each statement of the header: the licences of which it offers a choice."""
    lines = header(language, source or "")
    out: list[list[str]] = []
    k = 0
    while k < len(lines):
        here, nxt = lines[k], lines[k + 1] if k + 1 < len(lines) else ""
        got = named(here)
        if not got and nxt and _CONTEXT.search(here) and not named(nxt):
            got = named(here + " " + nxt)  # a name broken over two lines
            k += bool(got)
        if got:
            either = len(got) > 1 and re.search(r"\bor\b|\beither\b|/|,|\boder\b", here + " " + nxt, re.I) and not re.search(r"\band\b(?! conditions)", here, re.I)
            out += [list(got)] if either or len(got) == 1 else [[g] for g in got]
        k += 1
    if not out and _GRANT.search(whole := " ".join(lines)):
        text = whole_text(whole)
        got = [text] if text else list(named(whole))
        out = [got] if got else []
    return [list(x) for x in dict.fromkeys(tuple(sorted(o)) for o in out)]


def file_licenses(definitions: DataFrame) -> DataFrame:
    """(identity, offers) of each whole-file page in python or c; no offers where its header names none of the eight."""
    schema = pa.schema([("identity", pa.string()), ("offers", pa.list_(pa.list_(pa.string())))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, texts = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([offered(x, t) for x, t in zip(langs, texts)], schema.types[1])], schema=schema)

    pages = definitions.where("kind = 'script' and language in ('python', 'c') and identity is not null").select("identity", "language", "source")
    return (
        spread(pages).mapInArrow(read, "identity string, offers array<array<string>>")
        .dropDuplicates(["identity"])
    )


def revision_licenses(revisions: DataFrame, root_files: DataFrame) -> DataFrame:
    """(repo, sha, named, flag) of every revision: what its licence files and rows name, distinct and sorted.

    ``flag`` is 'unknown' for none, 'conflict' for several, null for one. Null, blank or
    unreadable licences name none; licence files below the root do not count.
    """

    def reader(read) -> object:
        schema = pa.schema([("repo", pa.string()), ("sha", pa.string()), ("spdx", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(r, s, x) for r, s, t in zip(*(c.to_pylist() for c in b.columns)) for x in read(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

        return run

    files = root_files.where(r"path rlike '^(?i)(license|licence|copying)(\\.[^/]*)?$' and text is not null").select("repo", "sha", "text")
    rows = revisions.where("trim(license) <> ''").select("repo", "sha", "license").distinct()
    kind = "repo string, sha string, spdx string"
    said = files.mapInArrow(reader(title_license), kind).unionByName(rows.mapInArrow(reader(lambda t: named(t, True)), kind))
    got = said.groupBy("repo", "sha").agg(F.sort_array(F.collect_set("spdx")).alias("named"))  # eight at most
    n = F.size(F.coalesce("named", F.array().cast("array<string>")))
    return (
        revisions.where("repo is not null and sha is not null").select("repo", "sha").distinct()
        .join(got, ["repo", "sha"], "left")
        .withColumn("flag", F.when(n == 0, "unknown").when(n > 1, "conflict"))
    )


def license_verdicts(definitions: DataFrame, locations: DataFrame, revisions: DataFrame, root_files: DataFrame) -> DataFrame:
    """(repo, sha, path, license, flag): the licence settled for each revision (path '') and each python or c file.

    A file whose header names licences has the revision's where the header offers it; if the
    revision's is settled and not offered, the flag is 'conflict' and the licence the header's; if it is
    not settled, the header decides alone. A file whose header names none has the revision's licence and
    flag. Locations of pages without a row or of other languages, and of revisions without a row, are left out.
    Repeated rows count once.
    """
    verdict = revision_licenses(revisions, root_files)
    settled = F.when(F.col("flag").isNull(), F.col("named")[0])
    per_revision = verdict.select("repo", "sha", F.lit("").alias("path"), settled.alias("license"), "flag")
    files = whole_files(locations).join(file_licenses(definitions), "identity").join(verdict.withColumn("settled", settled), ["repo", "sha"])
    own = F.size("offers") > 0
    against = F.exists("offers", lambda o: ~F.array_contains(o, F.col("settled")))
    flag = F.when(own, F.when(F.col("settled").isNotNull() & against, "conflict")).otherwise(F.col("flag"))
    lic = F.when(own & (F.col("settled").isNull() | against), F.array_join(F.array_sort(F.array_distinct(F.flatten("offers"))), " OR ")).otherwise(F.col("settled"))
    per_file = files.select("repo", "sha", "path", lic.alias("license"), flag.alias("flag"))
    return per_revision.unionByName(per_file).distinct()
