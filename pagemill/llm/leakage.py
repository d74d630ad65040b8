"""Evaluation items that leaked into a corpus, by one Aho-Corasick automaton.

Items and texts are read as words (runs of ASCII letters and digits, lower case).
Each distinct word of the items gets a code point, so that an item's run of
``run`` words is a pattern of ``run`` characters; all patterns form one automaton.
A text becomes such a string, with one code for every word that no item has, and
is scanned once. Offsets of a hit are mapped to the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import spread

RUN = 12
SCHEMA = "doc_id bigint, item_id bigint, words int, start int, stop int"
#: items of at most so many characters make one automaton, which takes about 130 bytes a character in each Python worker; larger
#: collections are scanned for part by part, and refused beyond so many parts
MAX_ITEM_CHARS, MAX_PARTS = 2_000_000, 64
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_WORD = re.compile(rb"[A-Za-z0-9]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_WORDS).split()


class Leaks:
    """The automaton over the runs of all items."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN):
        self.run, self.codes = run, {}
        runs: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            coded = "".join(chr(self._code(w)) for w in words(text or ""))
            for at in range(len(coded) - run + 1):
                runs.setdefault(coded[at : at + run], []).append((item, at))
        self.code = {w: chr(c) for w, c in self.codes.items()}
        self.automaton = ahocorasick.Automaton()
        for key, where in runs.items():
            self.automaton.add_word(key, tuple(where))
        self.empty = not runs
        if not self.empty:
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> int:
        c = self.codes.setdefault(word, len(self.codes) + 1)
        return c if c < 0xD800 else c + 0x800  # past the surrogates

    def scan(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, words of its longest run here, start, stop in characters of ``text``) of each item found."""
        if self.empty or not text:
            return []
        get = self.code.get
        coded = "".join([get(w, "\0") for w in words(text)])
        best: dict[int, tuple[int, int]] = {}
        open_: dict[tuple[int, int], tuple[int, int]] = {}
        for end, where in self.automaton.iter(coded):
            for item, at in where:
                # hits of one item on one diagonal that follow each other are one longer run
                first, last = open_.get((item, end - at), (end - self.run + 1, end))
                if last < end - 1:
                    first = end - self.run + 1
                open_[item, end - at] = (first, end)
                if item not in best or end - first > best[item][1] - best[item][0]:
                    best[item] = (first, end)
        if not best:
            return []
        raw = text.encode("utf-8", "replace")
        spans = [m.span() for m in _WORD.finditer(raw)]
        chars = lambda n: len(raw[:n].decode("utf-8", "replace"))
        return [(item, b - a + 1, chars(spans[a][0]), chars(spans[b][1])) for item, (a, b) in best.items()]


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """One row for each document and item with at least ``run`` consecutive words of the item.

    ``words`` is the longest such run, ``start`` and ``stop`` its place in the text.
    ``documents`` has doc_id, text; ``items`` item_id, text; other columns do not matter.
    Null or blank texts hold nothing; items of fewer words than ``run`` can't leak; repeated
    rows count once; a null id gives a row with a null id. Empty tables give no rows. The items are
    gathered after their size is checked, in as many parts by a hash of their texts as MAX_ITEM_CHARS asks for, each with one
    pass over the corpus; the corpus is never shuffled but for the last distinct over the few hits.
    """
    own = items.select("item_id", "text").where("text is not null").distinct()
    size, longest = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    # parts by hash are not all alike: they are planned at half of what one may hold
    parts = -(-2 * size // MAX_ITEM_CHARS) if size > MAX_ITEM_CHARS else 1
    if parts > MAX_PARTS or longest > MAX_ITEM_CHARS:
        raise ValueError(f"{size} characters of items, up to {longest} in one; at most {MAX_PARTS} parts of {MAX_ITEM_CHARS} are scanned for")
    texts = spread(documents.select("doc_id", "text").where("length(text) > 0"))
    out = None
    for part in range(parts):
        mine = own if parts == 1 else own.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        hits = texts.mapInArrow(_scanner(documents.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in mine.collect()]), run), SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


#: the automaton a Python worker built last, with the name of its items
_BUILT: dict[str, Leaks] = {}


def _scanner(held, run: int):
    name = uuid.uuid4().hex

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaks = _built(name, held, run)
        for b in batches:
            rows = [(doc, *hit) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for hit in leaks.scan(text)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "words", "start", "stop"), r)) for r in rows], schema=_ARROW)

    return found


def _built(name: str, held, run: int) -> Leaks:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Leaks(held.value, run)
    return _BUILT[name]


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
