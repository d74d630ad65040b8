import subprocess

import pytest

from pagemill.functions.c_pages import c_pages, c_shape
from pagemill.functions.python_pages import module_exports, python_pages, python_shape
from pagemill.operators import extraction as E
from pagemill.operators.ingest import crawl

BAKERY = '''"""Ovens and what they bake."""
import json
from .grain import mill as ground, Flour
import yeast.wild as wild
TEMPERATURE: float = 230.5
TEMPERATURE = 180.0

@json.cached
@logged(level=3)
def bake(loaf, *, hot=TEMPERATURE) -> Flour:
    """
    Bake one loaf
    until it is done.

    Slowly.
    """
    crumbs = [ground(x) for x in loaf if x]
    try:
        return wild.rise(crumbs), prove(loaf)
    except ValueError as burnt:
        return burnt, undefined_thing

class Oven(Flour, metaclass=Kind):
    racks = 4
    async def open(self, door=None):
        def hinge(): return door
        return Oven.racks, self.close(), hinge
    def close(self): ...

def bake(loaf):
    match loaf:
        case [first, *others] if first: return others
        case {"crust": c, **left}: return c
'''
PUMP = '''#include "valve.h"
// What one stroke moves, in millilitres
#define STROKE(n) ((n) * 12u)

union reading {
    float f; unsigned u;
};

typedef int (*hook)(union reading *r);

/*
 * Litres by the hour, from the tank's label.
 *
 * Measured once.
 */
const double rates[3] = { 0.5, 1.25, 4 };

/** prime - fill the line
 * @rounds: how often
 */
void prime(int rounds) { while (rounds--) (void)STROKE(rounds); }

/* a note that stands apart */

static unsigned drain(struct tank *t, unsigned most)
{
    enum state { OPEN, SHUT } now = OPEN;
    return now == OPEN ? most : 0;
}
extern int later(void);
static unsigned drain(struct tank *t, unsigned most) { return 1; }
'''


def test_python_pages():
    pages = {p["symbol"]: p for p in python_pages(BAKERY)}
    assert list(pages) == [None, "TEMPERATURE", "bake", "Oven", "Oven.racks", "Oven.open", "Oven.close"]
    assert pages["TEMPERATURE"]["signature"] == "TEMPERATURE: float" and pages["TEMPERATURE"]["first"] == 5
    # of two functions of a name the last one is the page; both are in the file
    assert pages["bake"]["signature"] == "bake(loaf)" and pages["bake"]["refs"] == [] and pages["bake"]["unresolved"] == []
    assert pages["Oven"]["signature"] == "Oven(Flour, metaclass=Kind)" and pages["Oven"]["unresolved"] == ["Kind"]
    assert pages["Oven.open"]["signature"] == "async open(self, door=None)" and ("Oven.racks", -1, ("Oven", "racks"), None) in pages["Oven.open"]["refs"]
    assert pages[None]["unresolved"] == ["prove", "undefined_thing", "logged", "Kind"]
    first = next(p for p in python_pages(BAKERY.rsplit("def bake", 1)[0]) if p["symbol"] == "bake")
    assert (first["first"], first["last"], first["docstring"]) == (8, 21, "Bake one loaf until it is done.") and first["signature"] == "bake(loaf, *, hot=TEMPERATURE) -> Flour"
    assert ("ground", 1, ("grain", "mill"), "from .grain import mill as ground") in first["refs"] and ("wild.rise", 0, ("yeast", "wild", "rise"), "import yeast.wild as wild") in first["refs"]
    assert first["unresolved"] == ["prove", "undefined_thing", "logged"]
    (bad,) = python_pages("class :\n")
    assert not bad["parsed"]
    deep = list(python_pages("x = " + "-" * 50_000 + "1\n"))
    assert len(deep) == 1 and not deep[0]["parsed"]
    assert python_shape("while price < 3:\n    price = max(price, cost) + 2.5\n") == "while $0 < <num> : <nl> <in> $0 = max ( $0 , $1 ) + <num> <nl> <out>"
    assert python_shape("f(") is None


def test_c_pages():
    got = {p["symbol"]: (p["kind"], p["first"], p["last"], p["signature"], p["docstring"]) for p in c_pages(PUMP) if p["symbol"]}
    assert got == {
        "STROKE": ("macro", 3, 3, "STROKE(n)", "What one stroke moves, in millilitres"), "union.reading": ("type", 5, 7, "union reading", None),
        "rates": ("constant", 16, 16, "const double rates[3]", "Litres by the hour, from the tank's label."),
        "prime": ("function", 21, 21, "void prime(int rounds)", "prime - fill the line"), "drain": ("function", 25, 29, "static unsigned drain(struct tank *t, unsigned most)", None),
    }
    assert c_shape('int area(int w, int h) { return w * h + sizeof(w) - 0x1F; } /* x */ char *s = "q";') == "int $0 ( int $1 , int $2 ) { return $1 * $2 + sizeof ( $1 ) - <num> ; } char * $3 = <str> ;"


def test_module_exports():
    e = module_exports(
        "from .a import one, two as deux\nimport far.off\nif 1:\n    from .b import *\n    with x:\n        from ..c import *\n__all__ = ['one', 'zwei']\n"
        "zwei = deux2 = deux\nuno = one\nmine = also = helper\ndef helper():\n    from .hidden import inner\n"
    )
    assert dict((n, (lv, ps)) for n, lv, ps in e.named) == {
        "one": (1, ("a", "one")), "deux": (1, ("a", "two")), "far": (0, ("far",)), "zwei": (1, ("a", "two")), "deux2": (1, ("a", "two")), "mine": (-1, ("helper",)), "also": (-1, ("helper",))
    }
    assert e.stars == [(1, ("b",)), (2, ("c",))] and e.listed == ["one", "zwei"] and e.defined == ["__all__", "uno", "helper"]
    assert module_exports("__all__ = names()").listed is None and module_exports("import (").named == []


TREE = {
    # a shop whose front re-exports what its back rooms define
    "shop/__init__.py": "from .counter import weigh, Scale as Balance\nfrom .cellar import *\nfrom .attic import *\nfrom . import tools\nquick = fast = weigh\nslow = weigh\n",
    "shop/counter.py": "class Scale:\n    def tare(self): pass\ndef weigh(x): return Scale\n",
    "shop/cellar.py": "__all__ = ['barrel', 'rope']\nfrom .attic import rope\ndef barrel(): pass\ndef spider(): pass\ndef _rat(): pass\n",
    "shop/attic.py": "def rope(): pass\ndef spider(): pass\ndef _bat(): pass\n",
    "shop/tools/__init__.py": "from .saw import *\n", "shop/tools/saw.py": "from .hammer import *\ndef cut(): pass\n", "shop/tools/hammer.py": "from .saw import *\ndef hit(): pass\n",
    "shop/round/__init__.py": "from .west import turn\n", "shop/round/west.py": "from .east import turn\n", "shop/round/east.py": "from .west import turn\n",
    "shop/dyn.py": "def __getattr__(name):\n    from .attic import rope\n    return rope\n",
    "src/yard/gate.py": "import requests, os.path, shop\nfrom hay import bale\ndef swing(): return os.path.join(requests.get, shop.weigh, bale)\n",
    "lib/hay/__init__.py": "bale = 1\n", "shop/json.py": "loads = 1\n",
    "visit.py": (
        "import shop\nfrom shop import weigh, rope, spider, _bat, fast, slow, Balance\nfrom shop.tools import hit, cut\nfrom shop.round import turn\nfrom shop.dyn import lost\nfrom yard.gate import swing\nimport json\n"
        "def go(): return weigh, rope, spider, _bat, fast, slow, Balance.tare(), hit, cut, turn, lost, swing, json.loads, shop.barrel, shop\n"
    ),
    "plain.txt": "nothing\n", "see.txt": "# link-see: a.b@v1\n# link: sha256:xyz\n# link-from: a.b@v1 = \n", "torn.py": "if (:\n",
}
SHA = "c" * 40


def tree(spark, texts=TREE, sha=SHA):
    return spark.createDataFrame([("h/o/r", sha, p, t) for p, t in texts.items()] + [("h/o/r", sha, "null.py", None)], "repo string, sha string, path string, text string")


@pytest.fixture(scope="module")
def read(spark):
    f = tree(spark)
    pages = E.extract(f)
    refs = E.references(pages, f)
    return f, pages.persist(), refs.persist(), E.forwarded(refs, E.exports(f), f).persist()


def test_references_and_forwarding(read):
    f, pages, refs, far = read
    got = {r.name: (r.target_path, r.target_symbol) for r in refs.where("path = 'visit.py' and symbol = 'go'").collect()}
    assert got["weigh"] == ("shop/__init__.py", "weigh") and got["swing"] == ("src/yard/gate.py", "swing") and "json.loads" not in got and got["shop"] == ("shop/__init__.py", None)
    got = {r.name: (r.target_path, r.target_symbol) for r in far.where("path = 'visit.py' and symbol = 'go'").collect()}
    front = "shop/__init__.py"
    assert got == {
        "weigh": ("shop/counter.py", "weigh"), "Balance.tare": ("shop/counter.py", "Scale.tare"), "fast": ("shop/counter.py", "weigh"), "slow": (front, "slow"),
        "shop.barrel": ("shop/cellar.py", "barrel"), "rope": ("shop/attic.py", "rope"),  # listed by the first star, which has it from the second
        "spider": ("shop/attic.py", "spider"), "_bat": (front, "_bat"),  # left out of a list; private
        "hit": ("shop/tools/hammer.py", "hit"), "cut": ("shop/tools/saw.py", "cut"),  # stars in a ring
        "turn": got["turn"], "lost": ("shop/dyn.py", "lost"), "swing": ("src/yard/gate.py", "swing"), "shop": (front, None),
    }
    assert got["turn"][0].startswith("shop/round/") and far.count() == refs.count()
    assert {r.name: r.target_path for r in refs.where("path = 'shop/__init__.py' and symbol is null").collect()}["tools"] == "shop/tools/__init__.py"


def test_long_chain_of_hands(spark):
    texts = {f"m{i}.py": f"from m{i + 1} import x\n" for i in range(30)} | {"m30.py": "x = 1\n", "use.py": "from m0 import x\ny = x\n"}
    f = tree(spark, texts)
    refs = E.references(E.extract(f), f).where("path = 'use.py' and symbol = 'y'")
    assert [r.target_path for r in E.forwarded(refs, E.exports(f), f).collect()] == ["m30.py"]


def test_imports_and_unmapped(read):
    f, pages, _, _ = read
    got = {(r.path, r.symbol): (r.stdlib, r.third_party, r.statements) for r in E.imports(pages, f).collect()}
    assert got["src/yard/gate.py", None] == (["os"], ["hay", "requests"], [])
    assert got["src/yard/gate.py", "swing"] == (["os"], ["hay", "requests"], ["from hay import bale", "import os.path", "import requests"])
    assert [(r.module, r.files) for r in E.unmapped(E.imports(pages, f), f).collect()] == [("hay", 1)]


def test_index_tables(spark, read):
    f, pages, refs, far = read
    revisions = spark.createDataFrame([("h/o/r", SHA, 9)], "repo string, sha string, files int")
    t = E.index_tables(pages, far, revisions, f)
    r = t["revisions"].first()
    assert r.unmapped == {"hay": 1} and r.skipped == ["see.txt: line 3: `` is not a field name; the line was ignored", "torn.py: the file did not parse"]
    assert {r.path for r in t["locations"].select("path").collect()} >= {"see.txt", "torn.py"} and t["locations"].where("path = 'plain.txt'").isEmpty()
    links = {(k.relation, k.target_address): k for k in t["links"].collect()}
    assert links["see", "a.b@v1"].target_form == "name" and links["ref", f"h/o/r@{SHA[:12]}/shop/counter.py#weigh"].target_symbol == "weigh"
    assert E.index_tables(pages, refs, revisions)["definitions"].where("size(imports.stdlib) > 0").isEmpty()
    d = t["definitions"].where("name = 'swing'").first()
    assert d.imports.third_party == ["hay", "requests"] and t["definitions"].count() == t["definitions"].select("identity").distinct().count()
    assert E.new_revisions(revisions, t["locations"]).isEmpty()


def test_crawl_twice_and_by_force(spark):
    names = spark.createDataFrame([("a.b", "main", "h/o/r/lib/one.py", {"v1": "d" * 40})], "name string, registry string, target string, versions map<string,string>")
    rev = lambda sha, at: spark.createDataFrame([("h/o/r", sha, at, None, "2020-01-01T00:00:00Z")], "repo string, sha string, committed_at bigint, license string, crawled_at string")
    one, two = "c" * 40, "d" * 40
    first, n = crawl(None, tree(spark, {"use.py": "# link-see: a.b@v1\nfrom lib import one\ndef f(): return one.g\n", "lib/__init__.py": "", "torn.py": "if (:\n"}, one), rev(one, 1), names)
    assert n.first().asDict() == {"repo": "h/o/r", "sha": one, "skipped": 1, "pages": 4, "links": 3, "forwarded": 0}
    assert first["links"].where("relation = 'see'").first().target_identity is None
    # a page that comes later answers the old link; nothing of the known revision is written again
    both, n = crawl(first, tree(spark, {"lib/one.py": "def g(): pass\n"}, two).unionByName(tree(spark, {"use.py": "x = 1\n"}, one)), rev(one, 1).unionByName(rev(two, 2)), names)
    assert [r.sha for r in n.collect()] == [two] and both["revisions"].count() == 2 and both["links"].count() == 3
    answered = both["links"].where("relation = 'see'").first()
    assert answered.target_identity == both["locations"].where("path = 'lib/one.py' and symbol is null").first().identity
    seqs = [r.crawl_seq for r in both["revisions"].orderBy("committed_at").collect()]
    assert seqs == sorted(set(seqs)) and both["links"].select("link_seq").distinct().count() == 3
    forced, _ = crawl(both, tree(spark, {"use.py": "x = 1\n"}, one), rev(one, 1), names, force=True)
    assert {r.path for r in forced["locations"].where(f"sha = '{one}'").collect()} == {"use.py"} and forced["revisions"].count() == 2 and forced["links"].isEmpty()
    assert forced["definitions"].count() > both["definitions"].count() - 1


def test_stream_in_parts(spark, tmp_path):
    from pagemill.streaming.crawl import crawl_stream

    every = tree(spark)
    every.where("path < 'shop/n'").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        crawl_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        every.write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out/pages")).count() == E.extract(every).count()


def test_git_source(spark, tmp_path):
    from pagemill.sources.git import GitTree

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "bin").write_bytes(b"\xff\xfe\x00")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@example.org", "commit", "-qm", "x")
    spark.dataSource.register(GitTree)
    got = {r.path: r.text for r in spark.read.format("git_tree").option("path", str(tmp_path)).option("repo", "h/o/r").load().collect()}
    assert got == {"a.py": "x = 1\n", "bin": None}


def test_registry(spark, tmp_path):
    from pagemill.sources.registry import first_registry, locator_of, read_names, snapshot

    (tmp_path / "a.toml").write_text('name = "a.b"\ntarget = "h/o/r/p.py"\ndefault = "v1"\n[versions]\nv1 = "x"\n')
    (tmp_path / "bad.toml").write_text("=")
    names = read_names(spark, str(tmp_path), "main")
    assert [(r.name, r.versions) for r in names.collect()] == [("a.b", {"v1": "x"})]
    two = names.unionByName(names.selectExpr("name", "'other' registry", "'x' target", "description", "owner", "default_label", "versions"))
    assert first_registry(two, ["other", "main"]).first().target == "x"
    old = names.selectExpr("*", "'1' snapshotted_at")
    assert snapshot(old, old.selectExpr("name", "registry", "'new' target", "description", "owner", "default_label", "versions", "'2' snapshotted_at")).first().target == "new"
    urls = ["https://Host/o/r.git", "git@host:o/r.git", "ssh://git@host:22/o/r", "nothing"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(locator_of("u")).collect()] == ["host/o/r"] * 3 + [None]
