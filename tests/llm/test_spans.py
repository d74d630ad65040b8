import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import spans


def text(r, n):
    return "".join(r.choice("abcdefgh (){};=\n    ") for _ in range(n))


def brute(a, b, least):
    grams = {a[i : i + least] for i in range(len(a) - least + 1)}
    return any(b[i : i + least] in grams for i in range(len(b) - least + 1))


def corpus(seed=1):
    r = random.Random(seed)
    pages = [text(r, r.randrange(300, 1500)) for _ in range(30)]
    for k in range(25):
        a, b = r.sample(range(30), 2)
        n = r.choice([200, 230, 239, 240, 241, 300, 600])
        at = r.randrange(max(1, len(pages[a]) - n))
        piece = pages[a][at : at + n]
        to = r.randrange(len(pages[b]))
        pages[b] = pages[b][:to] + piece + pages[b][to:]
    return pages + ["=" * 500, "x" + "=" * 300 + "y", " " * 240, "", "short", "é" * 100 + "日本語" * 100, pages[0], "z" + "日本語" * 90]


def test_keys_do_not_depend_on_the_batch():
    pages = [p for p in corpus() if len(p) >= 240]
    owner, key = spans.fingerprints(pages)
    for n, p in enumerate(pages):
        alone = spans.fingerprints([p])[1]
        assert sorted(key[owner == n].tolist()) == sorted(alone.tolist())


def test_long_symbols_are_shared_spans():
    pages = [p for p in corpus(3)] + [corpus(3)[4][:900] + "!", "q" * 3000, "ab" * 900]
    owner, name, check = spans.long_symbols(pages)
    assert len(owner) > 10
    held = {}
    for o, *symbol in zip(owner.tolist(), name.tolist(), check.tolist()):
        held.setdefault(tuple(symbol), set()).add(o)
    groups = [g for g in held.values() if len(g) > 1]
    assert groups and all(brute(pages[i], pages[j], 240) for g in groups for i in g for j in g if i < j)
    for n, p in enumerate(pages):  # they do not depend on the batch
        alone = spans.long_symbols([p])
        assert sorted(zip(alone[1].tolist(), alone[2].tolist())) == sorted(zip(name[owner == n].tolist(), check[owner == n].tolist()))
    assert len(spans.long_symbols([])[0]) == 0 == len(spans.long_symbols(["", "x"])[0])


def test_pages_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(spans, "_number", lambda c: F.xxhash64(F.substring(c, 1, 3)))
    pages = corpus(5)
    defs = spark.createDataFrame([(f"i{n // 3:02}x{n}", "script", p) for n, p in enumerate(pages)], "identity string, kind string, source string")
    locs = spark.createDataFrame([], "identity string, repo string, path string, symbol string")
    got = {(r.identity_a, r.identity_b) for r in spans.sharing_pairs(defs, locs).collect()}
    every = [(f"i{n // 3:02}x{n}", p) for n, p in enumerate(pages)]
    # pages of one number can't be told apart by it, so pairs among them are not looked for; no others are lost or made up
    want = {tuple(sorted((x, y))) for x, p in every for y, q in every if x < y and x[:3] != y[:3] and brute(p, q, 240)}
    assert got == want


def covered(a, b, least):
    grams = {b[i : i + least] for i in range(len(b) - least + 1)}
    return {k for i in range(len(a) - least + 1) if a[i : i + least] in grams for k in range(i, i + least)}


@pytest.mark.parametrize("least", [1, 5, 8, 13, 240])
def test_shared_runs(least):
    r = random.Random(2)
    texts = [text(r, 900), text(r, 700), " " * 400, "ab" * 300, "", "x", "\ud800" * 20 + "é" * 300]
    piece = text(r, 241)
    texts += [texts[0][:100] + piece + texts[0][100:], texts[1][:333] + piece + texts[1][333:] + piece, "y" + " " * 300 + "ab" * 130]
    hashed = [spans.windows(t, least) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            got = spans.shared_runs(a, b, hashed[i], hashed[j], least)
            for stretches, x, y in ((got[0], a, b), (got[1], b, a)):
                assert {k for s, e in stretches for k in range(s, e)} == covered(x, y, least)
            assert spans.have_run(a, b, hashed[i], hashed[j], least) == bool(got[0])


def test_equal_hashes_by_chance():
    a, b = "x" * 10, "y" * 10
    assert spans.shared_runs(a, b, np.array([7], np.uint64), np.array([7], np.uint64), 10) == ([], [])


def test_repetitive_texts_take_linear_time():
    a, b = " " * 400_000, " " * 300_000 + "x"
    start = time.perf_counter()
    assert spans.shared_runs(a, b, spans.windows(a), spans.windows(b)) == ([(0, 400_000)], [(0, 300_000)])
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("block", [200, 2])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spans, "BLOCK", block)
    pages = corpus()
    rows = [(f"id{n:02}", "script", p, "x") for n, p in enumerate(pages)] + [("id00", "script", pages[0], "x"), (None, "script", pages[0], "x"), ("nul", "script", None, "x"), ("fn", "function", pages[0], "x")]
    defs = spark.createDataFrame(rows, "identity string, kind string, source string, page string")
    # the first page and its exact copy stood at one place; the copy must not be a pair
    copy = f"id{pages.index(pages[0], 1):02}"
    locs = spark.createDataFrame([("id00", "r", "p", None, 1), (copy, "r", "p", None, 1), ("id01", "r", "p", "sym", 1), ("id02", None, "p", None, 1)], "identity string, repo string, path string, symbol string, key int")
    got = {(r.identity_a, r.identity_b) for r in spans.sharing_pairs(defs, locs).collect()}
    want = {(f"id{i:02}", f"id{j:02}") for i in range(len(pages)) for j in range(i + 1, len(pages)) if brute(pages[i], pages[j], 240)} - {("id00", copy)}
    assert got == want and len(want) > 8


def test_shared_characters(spark):
    pages = corpus()
    defs = spark.createDataFrame([(f"id{n:02}", "script", p) for n, p in enumerate(pages)], "identity string, kind string, source string")
    got = {r.identity: r.shared for r in spans.shared_characters(defs).collect()}
    for n, p in enumerate(pages):
        covered = set()
        for m, q in enumerate(pages):
            if m != n:
                grams = {q[i : i + 240] for i in range(len(q) - 239)}
                for i in range(len(p) - 239):
                    if p[i : i + 240] in grams:
                        covered |= set(range(i, i + 240))
        assert got.get(f"id{n:02}", 0) == len(covered)


def test_empty(spark):
    defs = spark.createDataFrame([], "identity string, kind string, source string")
    locs = spark.createDataFrame([], "identity string, repo string, path string, symbol string")
    assert spans.sharing_pairs(defs, locs).collect() == [] and spans.shared_characters(defs).collect() == []
