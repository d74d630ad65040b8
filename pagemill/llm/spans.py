"""Long exact spans that records share, by recompression.

Texts are rewritten in rounds: runs of a symbol become one symbol, then pairs whose
symbols fall on the two sides of a partition become one. A new symbol's name is a hash of
what it replaces, so equal stretches get equal names everywhere without a common
dictionary, up to their margins. Rounds only touch symbols that are short
enough for them, which bounds the symbols' lengths and the margins. A symbol that has grown to ``least`` characters
and stands in two texts is a span they share, told by its name and a second hash of its characters. Where two texts have
only a shorter symbol with equal surroundings in common, they are compared; every span of at
least ``least`` characters that two texts share has such a symbol in its middle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut, spread

LEAST = 240
#: longest symbols that a round still rewrites; a symbol ends up with at most twice the last
ROUNDS = (1, 1, 2, 2, 4, 4, 8, 8, 16, 16, 32, 32)
#: and the rounds after these, by which symbols grow that are long enough to be spans themselves
LONG_ROUNDS = (64, 64, 128, 128, 256, 256, 512, 512)
#: so many pages are picked from the table by a broadcast list of their numbers, 8 bytes each; more are joined by shuffles alone
FEW_PAGES = 400_000
#: records of a key that one task pairs with one another; larger groups are paired block by block
BLOCK = 200

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0x5851F42D4C957F2D)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _runs(sym: np.ndarray, start: np.ndarray, first: np.ndarray, size: np.ndarray, most: int) -> tuple:
    """Runs of one symbol, of up to 2 * ``most`` characters together, become one symbol named by symbol and length."""
    if len(sym) < 2:
        return sym, start, first, size
    same = np.concatenate([[False], (sym[1:] == sym[:-1]) & ~first[1:]])
    heads = np.flatnonzero(~same)
    count = np.diff(np.append(heads, len(sym)))
    total = count * size[heads]
    merge = (count > 1) & (total <= 2 * most)
    if not merge.any():
        return sym, start, first, size
    keep = ~same
    run_of = np.cumsum(keep) - 1
    keep |= ~merge[run_of]
    name = sym.copy()
    name[heads[merge]] = _mix(sym[heads[merge]] * _M3 + count[merge].astype(np.uint64))
    long = size.copy()
    long[heads[merge]] = total[merge]
    return name[keep], start[keep], first[keep], long[keep]


def _pairs(sym: np.ndarray, start: np.ndarray, first: np.ndarray, size: np.ndarray, most: int, salt: int) -> tuple:
    """A left symbol before a right one, both of at most ``most`` characters, become one symbol named by both."""
    if len(sym) < 2:
        return sym, start, first, size
    right = (_mix(sym + np.uint64(salt) * _M3) & np.uint64(1)).astype(bool)
    fit = size <= most
    join = np.flatnonzero(~right[:-1] & right[1:] & fit[:-1] & fit[1:] & ~first[1:])
    if not len(join):
        return sym, start, first, size
    name, long = sym.copy(), size.copy()
    name[join] = _mix(_mix(sym[join] + _M3) * _ODD + sym[join + 1])
    long[join] += size[join + 1]
    keep = np.ones(len(sym), bool)
    keep[join + 1] = False
    return name[keep], start[keep], first[keep], long[keep]


def recompress(texts: list[str], rounds: tuple[int, ...] = ROUNDS) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Several texts laid end to end: the state (names, starts, whether a text begins, sizes) of their top-level symbols, the ends of the texts, and the code points of all."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    first = np.zeros(len(codes), bool)
    first[(ends - lengths)[lengths > 0]] = True
    sym = _mix(codes.astype(np.uint64) + _M3)
    state = (sym, np.arange(len(codes)), first, np.ones(len(codes), np.int64))
    return _further(state, rounds), ends, codes


def _further(state: tuple, rounds: tuple[int, ...], number: int = 0) -> tuple:
    for n, most in enumerate(rounds, number + 1):
        with np.errstate(over="ignore"):
            state = _pairs(*_runs(*state, most), most, n)
    return state


def _sums(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Prefix sums of code * odd^place, and the inverse of the greatest power."""
    power = np.ones(len(codes), np.uint64)
    power[1:] = np.cumprod(np.full(len(codes) - 1, _ODD))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64) + _M3) * power)])
    return sums, power


def _hash(sums: np.ndarray, power: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of stretches, comparable between batches."""
    got = (sums[stop] - sums[start]) * power[len(power) - 1 - start]
    # the power left over depends on the batch's size alone; dividing it out makes hashes comparable between batches
    return got * np.uint64(pow(int(_ODD), -(len(power) - 1), 2**64))


def fingerprints(texts: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of every top-level symbol with room around it, distinct.

    A key names a symbol together with the quarter of ``least`` before its start and five
    twelfths after. A shared span has a symbol that starts where both lie within the span, since no
    symbol is longer than the third of ``least`` that is left.
    """
    with np.errstate(over="ignore"):
        return _fingerprints(*recompress(texts), least)


def _owners(start: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, start, side="right")


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(np.unique(np.stack(columns), axis=1)) if len(columns[0]) else columns


def _fingerprints(state: tuple, ends: np.ndarray, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = least // 4, least * 5 // 12
    name, start = state[:2]
    if not len(name):
        return np.array([], np.int64), np.array([], np.int64)
    owner = _owners(start, ends)
    begins = np.concatenate([[0], ends])[owner]
    ok = (start - before >= begins) & (start + after <= ends[owner])
    name, start, owner = name[ok], start[ok], owner[ok]
    key = _mix(_hash(*_sums(codes), start - before, start + after) ^ (name * _M1)).view(np.int64)
    return _distinct(owner, key)


def long_symbols(texts: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, name, second hash) of the symbols that reach ``least`` characters, each when it first does, distinct.

    A text that holds both holds the symbol's characters: equal names and equal hashes of two kinds stand for equal stretches.
    """
    with np.errstate(over="ignore"):
        return _long_symbols(*recompress(texts), least)


def _long_symbols(state: tuple, ends: np.ndarray, codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(codes):
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    sums, power = _sums(codes)
    found: list[tuple] = []
    for n, most in enumerate((0, *LONG_ROUNDS)):
        short = state[3] < least
        if most:
            state = _further(state, (most,), len(ROUNDS) + n)
        grown = state[3] >= least
        # what has stood since an earlier round is known already
        if most and grown.any():
            old = np.isin(state[1], before[0]) & (state[3] == before[1][np.minimum(np.searchsorted(before[0], state[1]), len(before[0]) - 1)]) if len(before[0]) else np.zeros(len(grown), bool)
            grown &= ~old
        if grown.any():
            name, start, size = state[0][grown], state[1][grown], state[3][grown]
            found.append((_owners(start, ends), name.view(np.int64), _mix(_hash(sums, power, start, start + size) + size.astype(np.uint64)).view(np.int64)))
        kept = state[3] >= least
        before = state[1][kept], state[3][kept]
        if not short.any():
            break
    if not found:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)
    return _distinct(*[np.concatenate(c) for c in zip(*found)])


def windows(text: str, least: int = LEAST) -> np.ndarray:
    """A hash of each window of ``least`` characters, by its start, comparable between texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) < least:
        return np.array([], np.uint64)
    with np.errstate(over="ignore"):
        letters = _mix(codes.astype(np.uint64) + _M3)
        out, width, done = np.zeros(len(codes), np.uint64), 1, 0
        # by doubling: hashes of widths 1, 2, 4, … make up the width asked for
        part = letters
        while True:
            if least & width:
                at = np.zeros(len(codes), np.uint64)
                at[: len(codes) - done] = part[done:]
                out = _mix(out * _M1 + at) if done else part.copy()
                done += width
            width *= 2
            if width > least:
                break
            ahead = np.zeros(len(codes), np.uint64)
            ahead[: len(codes) - width // 2] = part[width // 2 :]
            part = _mix(part * _ODD + ahead)
    return out[: len(codes) - least + 1]


def have_run(a: str, b: str, hashed_a: np.ndarray, hashed_b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two texts have a run of ``least`` characters in common."""
    return bool(len(_true_windows(a, b, hashed_a, hashed_b, least, enough=1)))


def shared_runs(a: str, b: str, hashed_a: np.ndarray, hashed_b: np.ndarray, least: int = LEAST) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, stop) of the stretches of each text that lie in runs of at least ``least`` characters which stand in the other.

    Time grows with the texts' lengths alone, whatever repeats in them. Equal hashes are held against the characters.
    """
    true = _true_windows(a, b, hashed_a, hashed_b, least)
    out = []
    for hashed in (hashed_a, hashed_b):
        at = np.flatnonzero(np.isin(hashed, true)) if len(true) else true
        if not len(at):
            out.append([])
            continue
        breaks = np.flatnonzero(np.diff(at) > least)
        starts, stops = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + least
        out.append([(int(x), int(y)) for x, y in zip(starts, stops)])
    return out[0], out[1]


def _true_windows(a: str, b: str, hashed_a: np.ndarray, hashed_b: np.ndarray, least: int, enough: int | None = None) -> np.ndarray:
    """Hashes of the windows that both texts hold, ``enough`` of them if that is given.

    The first places of windows that lie on one diagonal are compared as one stretch, so that no character is compared often.
    """
    once_a, first_a = np.unique(hashed_a, return_index=True)
    once_b, first_b = np.unique(hashed_b, return_index=True)
    both, in_a, in_b = np.intersect1d(once_a, once_b, assume_unique=True, return_indices=True)
    if not len(both):
        return both
    at, shift = first_a[in_a], first_b[in_b] - first_a[in_a]
    order = np.lexsort((at, shift))
    at, shift, both = at[order], shift[order], both[order]
    new = np.flatnonzero((np.diff(shift) != 0) | (np.diff(at) > least)) + 1
    true = []
    for k, n in zip([0, *new], [*new, len(at)]):
        start, stop, d = int(at[k]), int(at[n - 1]) + least, int(shift[k])
        if a[start:stop] == b[start + d : stop + d]:
            true.append(both[k:n])
        else:  # hashes that are equal by chance
            true.append(np.array([h for h, p in zip(both[k:n], at[k:n]) if a[p : p + least] == b[p + d : p + d + least]], np.uint64))
        if enough and len(true[-1]) >= enough:
            break
    return np.concatenate(true)


class _Hashed:
    """Window hashes of the texts met last."""

    def __init__(self, least: int, most: int = 400) -> None:
        self.least, self.most, self.known = least, most, {}

    def __call__(self, name: str, text: str) -> np.ndarray:
        got = self.known.get(name)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            got = self.known[name] = windows(text, self.least)
        return got


def _postings(pages: DataFrame, least: int) -> DataFrame:
    """(key, check, page): keys of short symbols, with a null check, and long symbols."""
    schema = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("page", pa.string())])

    def rows(ids: list[str], texts: list[str]) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            state, ends, codes = recompress(texts)
            owner, key = _fingerprints(state, ends, codes, least)
            who, name, check = _long_symbols(state, ends, codes, least)
        names = pa.array(ids, pa.string()).take(pa.array(np.concatenate([owner, who])))
        checks = pa.array(np.concatenate([np.zeros(len(key), np.int64), check]), mask=np.concatenate([np.ones(len(key), bool), np.zeros(len(check), bool)]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, name])), checks, names], schema=schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group: tuple[list[str], list[str]] = ([], [])
            size = 0
            for identity, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                group[0].append(identity)
                group[1].append(text)
                size += len(text)
                if size > 400_000:
                    yield rows(*group)
                    group, size = ([], []), 0
            if group[0]:
                yield rows(*group)

    return spread(pages).mapInArrow(named, "key bigint, check bigint, page string")


def candidate_pairs(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Distinct (a, b, sure), a < b, of the pages (identity, source) that have a key or a long symbol in common; ``sure`` where it is a long symbol.

    Groups above BLOCK are paired in blocks of bounded size spread over the cluster, so that no
    large group is paired in one task; no pair is left out.
    """
    # A key stands once for each page, which has many keys: even one that all pages hold is a small share of the
    # rows, so that rows can be placed by key. Counting and grouping share that one exchange; what a task makes
    # of a large group is its cells, each of two blocks, and these are spread before they are paired.
    postings = _postings(pages, least).select("key", "check", _number("page").alias("page")).repartition("key")
    shared = postings.withColumn("n", F.expr("count(*) over (partition by key, check)")).where("n > 1")
    blocks = shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.hash("page"), "blocks"))
    placed = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.groupBy("key", "check", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.array_sort(F.collect_set("page")).alias("pages"))
    groups = cells.where("size(pages) > 1").groupBy("pages").agg(F.max(F.col("check").isNotNull()).alias("sure"))
    pairs = groups.select("pages", "sure", F.posexplode("pages").alias("at", "a")).select("a", F.explode(F.expr("slice(pages, at + 2, size(pages))")).alias("b"), "sure")
    return pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _number(identity: str) -> F.Column:
    """Pages go by a number here. Two pages of one number would both be compared with either's partners."""
    return F.xxhash64(identity)


def script_pages(definitions: DataFrame, least: int = LEAST) -> DataFrame:
    """(identity, source) of the whole-file pages that are long enough to hold a span; repeated rows stand, and fall where pairs are made distinct."""
    return definitions.where(f"kind = 'script' and identity is not null and length(source) >= {least}").select("identity", "source")


def _with_texts(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pairs, which are kept in the checkpoint folder, with the identities and texts of their pages."""
    asked = pairs.select(F.col("a").alias("page")).unionByName(pairs.select(F.col("b").alias("page"))).distinct()
    if asked.count() <= FEW_PAGES:
        asked = F.broadcast(asked)
    keyed = pages.select(_number("identity").alias("page"), "identity", "source").join(asked, "page", "left_semi")
    left = keyed.select(F.col("page").alias("a"), F.col("identity").alias("one"), F.col("source").alias("text_one"))
    right = keyed.select(F.col("page").alias("b"), F.col("identity").alias("two"), F.col("source").alias("text_two"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("one", "two", "text_one", "text_two")


def sharing_pairs(definitions: DataFrame, locations: DataFrame, least: int = LEAST) -> DataFrame:
    """(identity_a, identity_b), a < b, of whole-file pages that share a run of ``least`` characters and never stood at one (repo, path).

    Null or shorter sources share nothing, places with a symbol or a null repo or path do not count, and
    repeated rows count once. Sources are compared as stored, whole.
    """
    pages = script_pages(definitions, least)
    pairs = cut(candidate_pairs(pages, least))
    places = (
        locations.where("symbol is null and repo is not null and path is not null")
        .select(_number("identity").alias("page"), F.xxhash64("repo", "path").alias("place"), "repo", "path").distinct()
    )
    at_a = pairs.select("a", "b").join(places.withColumnRenamed("page", "a"), "a")
    together = at_a.join(places.withColumnRenamed("page", "b"), ["b", "place", "repo", "path"], "left_semi").select("a", "b").distinct()
    apart = cut(pairs.join(together, ["a", "b"], "left_anti"))
    schema = pa.schema([("identity_a", pa.string()), ("identity_b", pa.string())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(least)
        for b in batches:
            rows = [sorted((x, y)) for x, y, s, t in zip(*(c.to_pylist() for c in b.columns)) if have_run(s, t, hashed(x, s), hashed(y, t), least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], schema=schema)

    # a number that two pages have tells neither, and what it is in is compared by texts
    names = pages.groupBy(_number("identity").alias("page")).agg(F.min("identity").alias("name"), F.max("identity").alias("last")).where("name = last")
    named = apart.where("sure").join(names.select(F.col("page").alias("a"), F.col("name").alias("one")), "a", "left").join(names.select(F.col("page").alias("b"), F.col("name").alias("two")), "b", "left")
    told = named.where("one is not null and two is not null").select(F.least("one", "two").alias("identity_a"), F.greatest("one", "two").alias("identity_b"))
    rest = cut(apart.where("not sure").select("a", "b").unionByName(named.where("one is null or two is null").select("a", "b")))
    return told.unionByName(_with_texts(rest, pages).mapInArrow(checked, "identity_a string, identity_b string")).distinct()


def shared_characters(definitions: DataFrame, least: int = LEAST) -> DataFrame:
    """(identity, characters, shared) of every whole-file page that shares a span with any other page.

    ``shared`` counts the page's characters that lie in a run of at least ``least`` characters
    that stands in another page too; overlapping runs count once.
    """
    pages = script_pages(definitions, least)
    schema = pa.schema([("identity", pa.string()), ("characters", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed(least)
        for b in batches:
            rows = set()
            for x, y, s, t in zip(*(c.to_pylist() for c in b.columns)):
                mine, theirs = shared_runs(s, t, hashed(x, s), hashed(y, t), least)
                rows |= {(x, len(s), i, j) for i, j in mine} | {(y, len(t), i, j) for i, j in theirs}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    found = _with_texts(cut(candidate_pairs(pages, least)), pages).mapInArrow(spans, "identity string, characters int, start int, stop int").distinct()
    # what a run adds is what reaches beyond all runs that start before it
    reach = F.expr("max(stop) over (partition by identity order by start, stop rows between unbounded preceding and 1 preceding)")
    added = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("reach", F.lit(0))))
    return found.withColumn("reach", reach).groupBy("identity", "characters").agg(F.sum(added).cast("int").alias("shared"))
