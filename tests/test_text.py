import hashlib
import random

from pyspark.sql import functions as F

from pagemill.functions import links as L
from pagemill.functions import pagetext as P
from pagemill.functions.text import identity, language_of, normalize, spdx


def test_normalize_is_the_plain_one(spark):
    r = random.Random(5)
    texts = ["", "\n", "  x\r\n  y  \r\n\n\n", "\tx\n\t  y", " a\n\n  b", "x\x0b\x1c\n", "  \n  a\n \t\n   b\x85\n", " a "]
    texts += ["".join(r.choice(" \t\nab\r\x0b ") for _ in range(r.randrange(40))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", normalize("t").alias("n"), identity("t").alias("i")).collect()
    for row in rows:
        if row.t is None:
            assert row.n is None
        else:
            assert row.n == P.normalized(row.t), repr(row.t)
            assert row.i == P.digest(row.t)


def test_known_identity():
    assert P.digest('print("hello world!")') == "75a27070015ebce788a4dd572e5c3acffb9e0edffecb96611db6fc1da6f39acb"
    assert hashlib.sha256(b'print("hello world!")\n').hexdigest() == P.digest('print("hello world!")')


def test_spdx(spark):
    cases = {
        "Apache License\nVersion 2.0": "Apache-2.0", "GNU GENERAL PUBLIC LICENSE\n Version 3": "GPL-3.0", "GNU Lesser General Public License, version 3, see the GNU General Public License": None,
        "Permission is hereby granted, free of charge, to any person\n obtaining a copy": "MIT", "Redistribution and use in source and binary forms ... Neither the name of": "BSD-3-Clause", "own terms": None, None: None,
    }
    got = {r.t: r.s for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", spdx("t").alias("s")).collect()}
    assert got == cases


def test_language(spark):
    got = [r[0] for r in spark.createDataFrame([("a/b.py",), ("x.h",), ("x.c",), ("Makefile",), ("a.py/b",), ("x.PY",)], "p string").select(language_of("p")).collect()]
    assert got == ["python", "c", "c", "text", "text", "text"]


ADDRESSES = {
    "a.b-c@v1#f.g": ("name", "a.b-c", None, None, "v1", "f.g", None), "Host.Example/Own/Repo@ABCDEF012345/p/q.py#f": ("locator", None, "host.example/Own/Repo", "p/q.py", "abcdef012345", "f", None),
    "sha256:" + "AB" * 32: ("identity", None, None, None, None, None, "ab" * 32), "h.x/o/r@main/a.c": ("locator", None, "h.x/o/r", "a.c", "main", None, None),
    "A.b": None, "h.x/o/r/a.py": None, "h.x/o@main/a.py": None, "sha256:xyz": None, "a.b#1x": None, "a.b#": None, "h.x/o/r@m/../a": None, "": None, "sha256:abc": None,
}


def test_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES], "t string").select("t", L.address("t").alias("a")).select("t", "a", L.format_address(F.col("a")).alias("back"), L.pinned(F.col("a")).alias("pinned")).collect()
    for r in rows:
        assert (tuple(r.a) if r.a else None) == ADDRESSES[r.t], r.t
    assert {r.t: r.pinned for r in rows if r.a}["h.x/o/r@main/a.c"] is False
    assert {r.t: r.back for r in rows}["a.b-c@v1#f.g"] == "a.b-c@v1#f.g"


LINES = {
    '# link: a.b@v1 id=0123456789ab  ~"says so"': ("is", "a.b@v1", {"id": "0123456789ab"}, "says so", True), "    // link-from: h.x/o/r@main/a.c#f lang=c": ("from", "h.x/o/r@main/a.c#f", {"lang": "c"}, None, None),
    "/* link-see: a.b */": ("see", "a.b", {}, None, None), "/* link-see: a.b": None, "# link: a.b k": None, "# link: a.b k=1 k=2": None, "x = 1  # link: a.b": None, "# link:": None,
}


def test_link_lines(spark):
    rows = spark.createDataFrame([(a,) for a in LINES], "t string").select("t", L.link("t").alias("k")).collect()
    for r in rows:
        got = (r.k.relation, r.k.address, r.k.fields, r.k.description, r.k.derived) if r.k else None
        assert got == LINES[r.t], r.t
        plain = P.read_link(0, r.t)
        assert isinstance(plain, P.LinkLine) == (got is not None)


TEXT = """import os
# link: a.b id=0123456789ab
# link-see: a.c
def f():
    return 1

def g():
    pass

    # link-from: a.d id=0123456789ab
    x = 1

    y = 2
z = 3
"""


def test_blocks_fold_and_own_text():
    lines = TEXT.split("\n")
    first, see, inner = P.link_lines(lines)
    assert lines[first.start : first.stop] == ["def f():", "    return 1"] and see.start == first.start
    assert lines[inner.start : inner.stop] == ["    x = 1", "", "    y = 2", "z = 3"] or lines[inner.start : inner.stop] == ["    x = 1"]
    text, entries = P.folded(TEXT)
    assert "def f" not in text and entries[0] == ("a.b", 4, 5)
    assert P.folded(TEXT, frozenset(["a.b", "a.d"]))[0] == TEXT
    kept, links = P.own_text(lines)
    assert len(links) == 3 and "def f():" not in kept and "def g():" in kept and "    x = 1" in kept


def test_expand_check_and_add():
    page = "def f():\n    return 1\n"
    text, missing = P.expanded("# link: a.b\nx = 1\n", {"a.b": [(P.digest("y = 2"), "y = 2\n"), (P.digest(page), page)]}, {"a.b": ["import os"]})
    assert not missing and "import os" in text and text.index("y = 2") < text.index("def f")
    assert P.expanded(text, {})[0] == text  # stamped links stay
    lines = "# link: a.b id={}\n{}".format(P.digest(page)[:12], page).split("\n")
    (k,) = P.link_lines(lines)
    assert P.block_status(lines, k, P.digest(page)) == "ok" and P.block_status(lines, k, "f" * 64) == "mismatch" and P.block_status(lines, k, None) == "unresolvable"
    lines[2] = "    return 2"
    (k,) = P.link_lines(lines)
    assert P.block_status(lines, k, P.digest(page)) == P.block_status(lines, k, None) == "drift"
    assert P.with_link("def f():\n    x\n", "a.b", 2) == "def f():\n    # link: a.b\n    x\n"
    assert P.moved_stamp(k, ("a.b", "f" * 64)) == ("a.b", "f" * 64) and P.moved_stamp(k, None) is None
    assert isinstance(P.read_link(0, P.stamped("a.b", "f" * 64, 'he said "no"')), P.LinkLine)


def test_answers(spark):
    from pagemill.operators.records import answer_lines

    text = "# my answer\n- `a.py#f`\n* b.c\n\n1. a.py#f\n  c\n"
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(answer_lines("t")).collect()[0][0] == ["a.py#f", "b.c", "c"]
