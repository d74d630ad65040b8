import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import pagetext as T
from pagemill.functions.stemming import stem, stems
from pagemill.operators import closure, lookup, records, search
from pagemill.sources import clones, config, corpus, objects


def repo(folder):
    folder.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "trunk")
    for name in ("a.py", "deep/b.py"):
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "one")
    run("remote", "add", "origin", "git@host.example:own/er.git")
    return run


def test_clones(spark, tmp_path):
    run = repo(tmp_path / "src")
    url, cache = str(tmp_path / "src"), str(tmp_path / "cache")
    place = clones.fetched(cache, "host.example/own/er", url)
    assert clones.default_branch(place) == "trunk" == clones.checked_out(url) and not clones.is_sparse(url)
    head = clones.git(url, "rev-parse", "HEAD")
    (tmp_path / "src/a.py").write_text("x = 2\n")
    run("commit", "-qam", "two")
    # a commit that is there asks for no fetch, one that is not does
    clones.fetched(cache, "host.example/own/er", url, head)
    assert clones.git(place, "rev-parse", "trunk") == head
    clones.fetched(cache, "host.example/own/er", url, clones.git(url, "rev-parse", "HEAD"))
    assert clones.git(place, "rev-parse", "trunk") != head
    assert clones.handle({"locator": "host.example/own/er"}, cache, url, head)[1] == head and clones.handle({"local_path": url}, cache, "")[2] == "trunk"
    with pytest.raises(subprocess.CalledProcessError):
        clones.fetched(cache, "host.example/own/none", str(tmp_path / "nowhere"))
    assert not (tmp_path / "cache/host.example/own/none").exists() and not list((tmp_path / "cache/host.example/own").glob(".clone-*"))
    run("tag", "v1")
    run("checkout", "-q", "--detach")
    assert clones.checked_out(url) == "v1"
    run("sparse-checkout", "set", "--no-cone", "/deep/")
    files = spark.createDataFrame([("a.py",), ("deep/b.py",)], "path string")
    assert [r.path for r in clones.on_disk(files, url).collect()] == ["deep/b.py"]
    known = spark.createDataFrame([("host.example/own/er", "old", None, "2020"), ("h/o/x", None, None, "2019")], "locator string, default_branch string, local_path string, added_at string")
    got = {r.locator: r for r in clones.registered(known, spark, url, "2021").collect()}
    assert got["host.example/own/er"].local_path == url and got["host.example/own/er"].default_branch == "v1" and got["host.example/own/er"].added_at == "2020"
    assert clones.registered(known, spark, "h/o/y", "2021").count() == 3 and clones.registered(known, spark, "host.example/own/er", "2021").where("default_branch = 'old'").count() == 1


def test_settings(spark, tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('registries = ["https://r.example", "names"]\n[remotes]\n"h/" = "https://mirror.example/"\n"h/o/" = "local/"\n')
    s = config.read_settings(str(f))
    assert s.registries == ("https://r.example", str(tmp_path / "names")) and config.read_settings(str(f), "x").registries == (str(tmp_path / "x"),)
    asked = ["h/o/r", "h/p/r", "g/o/r"]
    got = {r.locator: r.url for r in config.urls(spark.createDataFrame([(x,) for x in asked], "locator string"), s).collect()}
    assert got == {x: s.url_for(x) for x in asked} == {"h/o/r": f"{tmp_path}/local/r", "h/p/r": "https://mirror.example/p/r", "g/o/r": "https://g/o/r.git"}
    for bad in ("registries = []", "registries = 1", "=", 'registries = ["a"]\nremotes = 3'):
        f.write_text(bad)
        with pytest.raises(ValueError):
            config.read_settings(str(f))


def test_objects(spark, tmp_path):
    folder = str(tmp_path / "store")
    page = lambda i, address, seen, text: (i, text, "function", "f", address, seen)
    one, two = "ab" * 32, "ab" * 31 + "cd"
    assert objects.lookup(spark, folder, one) is None
    objects.store(spark.createDataFrame([page(one, "x", "1", "t"), page(two, "y", "1", "u")], objects.COLUMNS), folder)
    objects.store(spark.createDataFrame([page(one, "z", "2", "t"), page(one, "x", "3", "t")], objects.COLUMNS), folder)
    got = objects.lookup(spark, folder, "sha256:" + one.upper())
    assert got.source == "t" and [(p.address, p.seen) for p in got.places] == [("z", "2"), ("x", "3")]
    with pytest.raises(ValueError, match="ambiguous"):
        objects.lookup(spark, folder, "ab" * 8)
    with pytest.raises(ValueError):
        objects.lookup(spark, folder, "ab")
    assert objects.held({"o": folder, "none": str(tmp_path / "q")})["o"]["files"] > 0
    assert objects.clear({"o": folder, "none": str(tmp_path / "q")}, ["o", "none"]) == ["o"] and objects.lookup(spark, folder, one) is None


def test_corpus(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.c").write_bytes(b"int \xff;\n")
    (tmp_path / "b.c").write_text("é\n")
    (tmp_path / "c.h").write_text("no\n")
    assert sorted(r.text for r in corpus.read_corpus(spark, str(tmp_path)).collect()) == ["int �;\n", "é\n"]


def test_update_texts():
    page = "def f():\n    return 1\n"
    new = "def f():\n    return 2\n"
    old, now = T.digest(page), T.digest(new)
    text = f"import os\n\n    # link: a.b@v1 id={old[:12]} track=latest \"says\"\n    def f():\n        return 1\n\nx = 1\n# link-from: a.c@v1 id={old[:12]}\n# link-see: a.d\n# link: a.e@v1\n"
    lines = text.split("\n")
    k = T.tracked(lines)
    assert [x.address for x in k] == ["a.b@v1"] and len(T.tracked(lines, every=True)) == 3 and [x.address for x in T.tracked(lines, ("a.c@v9",))] == ["a.c@v1"]
    move = T.planned(lines, k[0], ("a.b@v2", now, new))
    assert move.status == "updated" and "-    return 1" in move.diff and "+    return 2" in move.diff
    after = T.moved(lines, [move])
    assert after[2:5] == [f'    # link: a.b@v2 id={now[:12]} track=latest "says"', "    def f():", "        return 2"] and after[5:] == lines[5:]
    assert T.planned(lines, k[0], ("a.b@v2", old, page)).status == "unchanged" and T.planned(lines, k[0], None).status == "not-found"
    edited = [*lines[:4], "        return 3", *lines[5:]]
    assert T.planned(edited, T.tracked(edited)[0], ("a.b@v2", now, new)).status == "drift"
    forked, bare = T.tracked(lines, ("a.c",))[0], T.tracked(lines, ("a.e",))[0]
    assert T.planned(lines, forked, ("a.c@v2", now, new), (old, page)).diff and T.planned(lines, forked, ("a.c@v2", old, page), (old, page)).diff == "" and T.planned(lines, bare, None).status == "unexpanded"
    assert T.text_diff("a\n", "a\n", "x", "y") == "" and T.same_page("h/o/r@v1/p.py#f", "h/o/r@0123/p.py#f") and not T.same_page("h/o/r@v1/p.py#f", "h/o/r@v1/p.py#g")
    assert [T.distribution(r) for r in ("Some_Thing[x]>=1; python_version > '3'", "a @ http://x", " b ")] == ["some-thing", "a", "b"]
    assert T.module_name(None, "h/o/my-repo/src/p.py", "src/p.py", "Box.open") == "my_repo_p_box_open" and T.module_name("9.lives", "", "", None) == "_9_lives"
    module, said = T.packaged("a.b@v1", [("1" * 64, "def g(): pass\n"), (old, page)], ["import os"], "a_b", ["f"])
    assert module.startswith("import os\n\n\ndef g(): pass\n\n\n# link: a.b@v1 id=") and module.endswith(page) and said == "from vendored.a_b import f"


def test_closures_against_brute_force(spark):
    import random

    r = random.Random(9)
    pages = [f"p{i}" for i in range(30)]
    pairs = {(r.choice(pages), r.choice(pages)) for _ in range(45)}
    pairs = {(a, b) for a, b in pairs if a != b}
    df = spark.createDataFrame(sorted(pairs), "source string, target string")

    def reached(root):
        got, todo = {root}, [root]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in got:
                    got.add(b)
                    todo.append(b)
        return got

    roots = spark.createDataFrame([(p,) for p in pages[:10]], "root string")
    full = closure.reach(df, roots).collect()
    assert {(x.root, x.page) for x in full} == {(p, q) for p in pages[:10] for q in reached(p)} and len(full) == len(set(full))
    d = spark.createDataFrame([(p, 10, "function", p, [p, "zz"]) for p in pages], "identity string, lines int, kind string, name string, unresolved array<string>")
    told = {x.root: x for x in closure.budgeted(df, roots, d, 5, 45).collect()}
    for p in pages[:10]:
        n = len(reached(p))
        assert told[p].within == (n <= 4) and told[p].pages == (n if n <= 5 else None)
    order = {}
    for x in closure.ordered(df, closure.reach(df, roots)).orderBy("root", "place").collect():
        order.setdefault(x.root, []).append(x.page)
    for p, listed in order.items():
        assert set(listed) == reached(p) and listed[-1] == p
        for a, b in pairs:  # what a page needs stands before it, but on rings
            if a in listed and b in listed and p not in reached(b) and a not in reached(b):
                assert listed.index(b) < listed.index(a)
    assert {x.name for x in closure.free_names(closure.reach(df, roots), d).collect()} == {"zz"}
    assert closure.reach(df.limit(0), roots).count() == 10 and closure.ordered(df, closure.reach(df, roots.limit(0))).collect() == []


def test_search_by_stems_and_phrases(spark):
    d = spark.createDataFrame([("1", "read_temps", "reads the temperature", None), ("2", "temp_read", None, "Framing of Größen."), ("3", None, None, "frames")], "identity string, name string, signature string, docstring string")
    at = spark.createDataFrame([("1", "read_temps"), ("2", None), ("3", None)], "identity string, symbol string")
    docs = search.search_documents(d, at)
    found = lambda q: {r.identity for r in search.search(docs, q).collect()}
    assert found("frame") == {"2", "3"} and found("FRAMES") == {"2", "3"} and found("grossen") == set() and found("großen") == {"2"} and found("read_tem") == {"1"} and found("temp_rea") == {"2"} and found("nothing") == set()
    with pytest.raises(ValueError):
        search.search(docs, "  ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeilnostuyz", min_size=1, max_size=14))
def test_stems_do_not_grow(word):
    assert len(stem(word)) <= len(word) + 1 and stems(word + " " + word) == [stem(word)] * 2


def test_answers(spark):
    rows = lambda *x: spark.createDataFrame(x, "run string, name string")
    want = rows(("a", "f"), ("a", "C"), ("b", "f"), ("c", "f"))
    given_ = rows(("a", "f"), ("a", "C.m"), ("a", "C.m.inner"), ("b", "f"), ("b", "g.h"))
    assert sorted((r.run, r.name) for r in records.folded(given_, want, "run", "name").collect()) == [("a", "C"), ("a", "f"), ("b", "f"), ("b", "g.h")]
    told = records.verdicts(given_, want, "run", "name")
    assert {r.run: (r.strict, r.folded) for r in told.collect()} == {"a": (False, True), "b": (False, False), "c": (False, False)}
    arms = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "run string, arm string")
    assert {(r.arm, r.answers, r.strict, r.folded) for r in records.verdict_counts(told, arms, "run").collect()} == {("x", 2, 0, 1), ("y", 1, 0, 0)}
    links = spark.createDataFrame([("a", "is", "p"), ("a", "see", "q"), ("b", "see", "p")], "run string, relation string, target_address string")
    wanted = spark.createDataFrame([("a", "is", "p"), ("a", None, "q"), ("b", "is", "p")], "run string, relation string, target_address string")
    assert {(r.run, r.passed) for r in records.link_grades(links, wanted).collect()} == {("a", True), ("b", False)}
    runs = spark.createDataFrame([("F", "t", "x", "pass", 10.0), ("F", "t", "y", "pass", 4.0), ("F", "t", "x", "fail", 30.0)], "family string, task string, arm string, status string, tokens double")
    assert {(r.family, r.task, r.ratio) for r in records.ratios(runs, "x", "y").collect()} == {("F", "t", 5.0), ("F", "*", 5.0), ("*", "*", 5.0)}


def test_lookup(spark):
    a, b = "a" * 64, "b" * 64
    d = spark.createDataFrame([(a, "function", "f", "f()", "Says.", 2, None), (b, "script", "p.py", None, None, 9, None), (a, "function", "f", "f()", "Says.", 2, None)], "identity string, kind string, name string, signature string, docstring string, lines int, imports struct<stdlib:array<string>,third_party:array<string>>")
    at = spark.createDataFrame([(a, "h/o/r", "c" * 40, "p.py", "f", 3, 4), (b, "h/o/r", "c" * 40, "p.py", None, 1, 9)], "identity string, repo string, sha string, path string, symbol string, span_first int, span_last int")
    revs = spark.createDataFrame([("h/o/r", "c" * 40, 5, 1)], "repo string, sha string, committed_at bigint, crawl_seq bigint")
    names = spark.createDataFrame([("n.p", "main", "h/o/r/p.py", {"v1": "c" * 40}, None)], "name string, registry string, target string, versions map<string,string>, description string")
    links = spark.createDataFrame([(a, "h/o/r", "c" * 40, "p.py", 4, "see", "asserted", "n.p@v1", b, "d", 1), (a, "h/o/r", "c" * 40, "p.py", 3, "ref", "derived", "x.y", None, None, 2)], "source_identity string, repo string, sha string, file string, line int, relation string, origin string, target_address string, target_identity string, description string, link_seq bigint")
    asked = spark.createDataFrame([(x,) for x in ("n.p@v1", "h/o/r@" + "c" * 12 + "/p.py#f", "sha256:" + "a" * 12, "h/o/r@main/q.py", "???", None)], "address string")
    got = {r.address: (r.status, r.identity) for r in lookup.resolve(asked, d, at, revs, names).collect()}
    assert got == {"n.p@v1": ("found", b), "h/o/r@" + "c" * 12 + "/p.py#f": ("found", a), "sha256:" + "a" * 12: ("found", a), "h/o/r@main/q.py": ("unknown", None), "???": ("malformed", None)}
    o = {r.identity: r for r in lookup.page_objects(d, at, revs, links, names).collect()}
    assert [(x.line, x.relation, x.description) for x in o[a].links] == [(2, "see", "d")] and [x.line for x in o[a].refs] == [1] and o[b].entry == "n.p" and o[b].links == []
    assert '"version":"1"' in lookup.as_json(lookup.page_objects(d, at, revs, links, names), "1").first().json
    p = {r.prefix: r for r in lookup.definition_pages(spark.createDataFrame([("aaaaaa",), ("cccccc",)], "prefix string"), d, at, revs, links).collect()}
    assert (p["aaaaaa"].matches, p["aaaaaa"].name, p["aaaaaa"].places, p["aaaaaa"].backlinks) == (1, "f", 1, 0) and p["cccccc"].matches == 0
    from pagemill.operators import pages

    told = lookup.who_asked(asked, d, at, revs, names, pages.who(links, revs, d), pages.current_places(at, revs)).collect()
    assert [(r.address, r.relation, r.place, r.at) for r in told] == [("n.p@v1", "see", "h/o/r/p.py#f", 1)]
    want = spark.createDataFrame([(1, a, "h/o/r", "p.py", None, None), (2, a, None, None, None, None)], "ask int, identity string, at_repo string, at_path string, at_symbol string, at_rev string")
    assert {r.ask for r in lookup.preferred_location(want, at, revs).collect()} == {1, 2}
    assert lookup.unregistered(spark.createDataFrame([("x",), ("y",)], "locator string"), spark.createDataFrame([("x",)], "locator string")).first().locator == "y"


def test_streams(spark, tmp_path):
    import gzip
    import json

    from pagemill.sources.records import parsed_stream, read_stream

    use = {"input_tokens": 5, "cache_read_input_tokens": 7, "output_tokens": 1}
    said = lambda **k: json.dumps(k)
    lines = [
        said(type="system", subtype="init"), "not json", "",
        said(type="assistant", message={"id": "m1", "usage": use, "content": [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"a": 1}}]}),
        said(type="assistant", message={"id": "m1", "usage": use, "content": [{"type": "tool_use", "id": "t2", "name": "Read", "input": {}}, {"type": "text", "text": "x"}]}),
        said(type="assistant", parent_tool_use_id="t1", message={"id": "m9", "usage": use, "content": "inner"}),
        said(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "abc"}, {"type": "text", "text": "de"}], "is_error": True}]}),
        said(type="user", message={"content": [{"type": "tool_result", "tool_use_id": "t2", "content": "four"}]}),
        said(type="system", subtype="permission_denied", tool_use_id="t2"), said(type="rate_limit_event", rate_limit_info={"n": 1}), said(type="rate_limit_event", rate_limit_info={"n": 2}),
        said(type="result", usage={"input_tokens": 100, "output_tokens": 20}, num_turns=3),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(lines[:4]))
    p = parsed_stream(read_stream(spark, str(tmp_path)))
    got = {r.run: r for r in records.stream_summary(p).collect()}
    a, b = got["a"], got["b"]
    assert (a.requests, a.input_tokens, a.tokens, a.num_turns, a.calls) == (1, 12, 120, 3, {"Read": 2}) and json.loads(a.rate_limit) == {"n": 2}
    assert (b.requests, b.tokens, b.calls) == (1, None, {"Read": 1})
    calls = {r.id: (r.denied, r.error, r.result_chars) for r in records.stream_calls(p).where("run = 'a'").collect()}
    assert calls == {"t1": (False, True, 5), "t2": (True, False, 4)}


def test_live_closures_and_what_became_of_pages(spark):
    from pagemill.operators import extraction, ingest

    sha = "e" * 40
    texts = {
        "m.py": "import os\nfrom n import h\ndef f(): return g() + h()\ndef g(): return 1\ndef lost(): return nowhere_at_all\n", "n.py": "def h(): return os_\nos_ = 1\n",
        "o.py": "from n import h as g\nfrom m import g as own\ndef two(): return h2() + own()\ndef h2(): return g()\n", "x.py": "from p import q\nfrom r.s import q as q2\ndef both(): return q(), q2()\n", "p.py": "def q(): return 1\n", "r/s.py": "def q(): return 2\n",
    }
    files = spark.createDataFrame([("h/o/r", sha, p, t) for p, t in texts.items()], "repo string, sha string, path string, text string")
    roots = spark.createDataFrame([("h/o/r", sha, p, s) for p, s in (("m.py", "f"), ("m.py", "lost"), ("x.py", "both"), ("q.py", "none"), ("o.py", "two"))], "repo string, sha string, path string, symbol string")
    got = {r.symbol: (r.status, r.pages, r.detail) for r in ingest.live_closures(files, roots).collect()}
    assert got == {"f": ("ok", 4, None), "lost": ("free names", 1, "nowhere_at_all"), "both": ("clash", 3, "q"), "none": ("not found", None, None), "two": ("ok", 5, None)}
    assert ingest.live_closures(files, roots, most_pages=2).where("symbol = 'f'").first().status == "over budget"
    head = extraction.extract(files)
    at = {(r.path, r.symbol): r.identity for r in head.where("kind is not null").collect()}
    asked = spark.createDataFrame([("h/o/r", "m.py", "f", "0"), ("h/o/r", "old.py", "q", at["p.py", "q"]), ("h/o/r", "old.py", None, at["n.py", None]), ("h/o/r", "old.py", "x", "0")], "repo string, path string, symbol string, identity string")
    told = {(r.path, r.symbol): (r.rule, r.to_path, r.to_symbol) for r in ingest.latest_in_tree(asked, head).collect()}
    assert told == {("m.py", "f"): ("place", "m.py", "f"), ("old.py", "q"): ("identity", "p.py", "q"), ("old.py", None): ("identity", "n.py", None), ("old.py", "x"): (None, None, None)}


def test_tokens_and_declared_names(spark, tmp_path):
    from pagemill.operators.extraction import tokens
    from pagemill.sources.registry import declared, read_names

    got = [tuple(r) for r in tokens(spark.createDataFrame([("a", "int x; // no\n\n#define A 1\nchar *s = \"q\";\n"), ("n", None)], "file string, text string")).orderBy("position").collect()]
    assert got[:3] == [("a", 1, 0, "keyword", "int"), ("a", 1, 1, "identifier", "x"), ("a", 1, 2, "punctuation", ";")] and got[3][1:] == (3, 3, "directive", "#define A 1") and got[7][1] == 4 and got[8][3:] == ("string", '"q"')
    run = repo(tmp_path / "r")
    (tmp_path / "r/own.toml").write_text('names = ["a.b", "a.c", 3]\n')
    run("add", ".")
    run("commit", "-qm", "names")
    assert declared(str(tmp_path / "r"), "HEAD", "own.toml")[1] == ["a.b", "a.c"] and declared(str(tmp_path / "r"), "HEAD~1", "own.toml")[1] == []
    assert read_names(spark, str(tmp_path / "nowhere"), "main").collect() == []


def test_fixed_links():
    page = "def f():\n    return 1\n"
    stamp = T.digest(page)[:12]
    lines = f"# link: a.b@v1 id={stamp}\ndef f():\n    return 1\n\n\n# link: a.c@v1 id={stamp}\ndef f():\n    return 2\n\n\n# link: a.d@v1\n\n# link-see: a.e@v1\n".split("\n")
    out, told = T.fixed(lines, {"a.b@v1": T.digest(page), "a.c@v1": T.digest(page)})
    assert [x[2] for x in told] == ["ok", "fixed", "unexpanded", "unresolvable"] and out[5].startswith("# link-from: a.c@v1") and out[0] == lines[0]
    assert T.block_status(lines, T.link_lines(lines)[0], "f" * 64) == "mismatch"


def test_small_inputs_are_spread(spark):
    from pagemill import session

    df = spark.range(100).coalesce(1)
    wide = session.spread(df)
    assert wide.rdd.getNumPartitions() == session.task_slots(spark) and sorted(r.id for r in wide.collect()) == list(range(100))
    large = spark.range(10**10)
    assert session.spread(large) is large
