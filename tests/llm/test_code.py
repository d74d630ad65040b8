"""Generated files, documented functions, syntax and licences."""

import ast
import random
import warnings
from functools import cache

import pytest

from pagemill.llm import functions_docs as D
from pagemill.llm import generated as G
from pagemill.llm import licenses as K
from pagemill.llm import syntax as S
from pagemill.llm.chart import Grammar

HAND = '"""Helpers for generated tag reports; do not edit the late relay by hand."""\n\nimport os\n\n\ndef f(a):\n    """Says what it does here."""\n    if a:\n        return os.path.join(a, "b")\n    return None\n\n\ndef g(b, c):\n    for x in b:\n        c += x\n    return c\n'


@pytest.mark.parametrize(
    "text, language, want",
    [
        (HAND, "python", None), ("", "python", None), (None, "c", None), ("# Code generated by x 1.0. DO NOT EDIT.\n" + HAND, "python", "generated"), ('BANNER = "# Code generated by x. DO NOT EDIT."\n' + HAND, "python", None),
        ("// Diese Datei wird maschinell aus a.def erzeugt\nint a(void)\n{\n    return 1;\n}\n", "c", "generated"), ("// Vendored from h.example/o/r at 0123456789ab.\nint a(void)\n{\n    return 1;\n}\n", "c", "vendored"),
        ("/* Autogenerated docstring */\nint a(int x)\n{\n    while (x)\n        x--;\n    return 1;\n}\n", "c", None),
        ("".join(f"function a{i}(b,c){{var d={i};return e?f({i}):'x'+g[{i}]}}" for i in range(60)) + "\n", "text", "minified"), ("".join(f"a{i}={i};b{i}=lambda c:{i};" for i in range(60)) + "\n", "python", "minified"),
        ("const unsigned char d[] = {\n" + "".join("    0x%02x, 0x%02x, 0x%02x, 0x%02x,\n" % (i, i + 1, i + 2, i + 3) for i in range(90)) + "};\n", "c", "data"), ('P = "' + "0123456789abcdef" * 90 + '"\n', "python", "data"),
        ("LIMIT = 924224124\n\nOTHER = 12\n", "python", None), ("".join(f"def f{i}(x):\n    return _t[{i}](x, {i * 7})\n\n\n" for i in range(6)), "python", "generated"), ("key = 1\nother = 22\n" * 20, "text", None),
        ("// odd words 12\n\nstatic const struct row t[] = {\n" + "".join(f'    {{ 0x{i}, {i * 3}, "w{i}" }},\n' for i in range(12)) + "};\n\nint f(int k)\n{\n    return k + 1;\n}\n", "c", "generated"),
    ],
)
def test_verdict(text, language, want):
    assert G.verdict(text, language, "a.js" if language == "text" else "") == want


def test_machine_files(spark):
    defs = spark.createDataFrame([("a", "python", "script", HAND, 1), ("a", "python", "script", HAND, 1), ("b", "python", "script", "", 1), ("c", None, "script", None, 1), ("f", "python", "function", "# @generated\n", 1)], "identity string, language string, kind string, source string, verdict int")
    locs = spark.createDataFrame([("a", "r", "s", "x.py", None), ("a", "r", "s", "third_party/x.py", None), ("a", "r", "s", "third_party/x.py", None), ("a", "r", "s", "vendors/x.py", None), ("b", "r", "s", "vendor/e.py", None), ("a", "r", "s", None, None), ("gone", "r", "s", "vendor/y", None), ("a", "r", "s", "vendor/z.py", "f")], "identity string, repo string, sha string, path string, symbol string")
    assert [(r.path, r.verdict) for r in G.machine_files(defs, locs).collect()] == [("third_party/x.py", "vendored")]
    assert G.machine_files(defs.limit(0), locs.limit(0)).collect() == []


def test_lines_of_comments_are_no_code_at_any_size():
    for n in (30, 400):
        assert G.verdict("/*\n" + "plain words about the file\n" * n + "*/\n" + "".join(f"int a{i}(int b){{return b+{i};}}" for i in range(n)) + "\n", "c") == "minified"
    assert G._code_lines('x = """a\nb\n"""; y\n\nz\n', [("x", 0), ('"""a\nb\n"""', 4), ("y", 16), ("z", 19)]) == 4


def test_comment_styles_of_text_pages(spark):
    marked = "// Code generated by x 1.0. DO NOT EDIT.\nvar a = 1;\n"
    defs = spark.createDataFrame([("j", "text", "script", marked), ("h", "text", "script", "# @generated\nkey = 1\n"), ("c", "c", "script", marked)], "identity string, language string, kind string, source string")
    locs = spark.createDataFrame([("j", "r", "s", "a.JS", None), ("j", "r", "s", "a.txt", None), ("h", "r", "s", "b.cfg", None), ("h", "r", "s", "b.go", None), ("c", "r", "s", "c.inc", None)], "identity string, repo string, sha string, path string, symbol string")
    assert {(r.path, r.verdict) for r in G.machine_files(defs, locs).collect()} == {("a.JS", "generated"), ("b.cfg", "generated"), ("c.inc", "generated")}


DOCS = {
    "Drops each tree that was public before the lock became sparse.": False, "TODO: document this": True, "": True, "Args:\n    x:\nReturns:": True, "Args:\n    x: the raw map of all tiles": False, ":param a:\n:return:": True, "@param a @param b @return": True, "Beschreibung fehlt noch": True,
    "Prüft jeden Eintrag im Feld und verwirft alte. TODO: handle more": False, "Docs for this will be written later": True, "Add a description here please": True, "...": True, "/** Says what it is for, plainly. */": False, "do the thing": True, "Do the thing now.": True, "----------": True, "None": True,
    "No description.": True, "FIXME write docs for this one later": True, "Descripción pendiente de escribir": True, "This writes the documentation of each missing page into its folder.": False, "待补充": True,
}


@pytest.mark.parametrize("doc", DOCS)
def test_trivial(doc):
    assert D.is_trivial(doc, "do_the_thing_now") == DOCS[doc]


def test_functions():
    source = 'X = "def no(): pass"\n# def no2(): pass\n\n@deco\ndef f(a,\n      b="):"):  # why\n    r\'\'\'Doc "one".\n    two\'\'\'\n    return """\ndef not_here():\n"""\n\nclass C:\n    async def m(self): "doc of m" ; x = 1\n    def n(self):\n        x = "no doc"\n        return x\ndef last(): return 1\n'
    got = {s: d for _, _, s, d in D.python_functions(source)}
    assert list(got) == ['def f(a, b="):")', "async def m(self)", "def n(self)", "def last()"]
    assert list(got.values()) == ['Doc "one".\n    two', "doc of m", "", ""]
    spans = [source[a:b] for a, b, s, _ in D.python_functions(source)]
    assert spans[0].endswith('"""\n\n') and "not_here" in spans[0]
    c = '// one\n// two\nstatic int f(int a)\n{\n    char *s = "}"; // }\n    return \'}\';\n}\n#define X\n/* of g */\nint g(void) { if (1) { } return 0; }\nint proto(int);\nint arr[] = { 1 };\n/* cut */ int h(int x) {\n'
    assert [(s, d) for _, _, s, d in D.c_functions(c)] == [("static int f(int a)", "// one\n// two"), ("int g(void)", "/* of g */"), ("int h(int x)", "/* cut */")]


@pytest.mark.parametrize(
    "source, want",
    [
        ("// Blocks until a raw tuple arrives.\nstatic int f(int a) // eager 41170\n{\n    return a;\n}\n", ("static int f(int a)", "// Blocks until a raw tuple arrives.")), ("/* one */\nvoid f(void) NOEXCEPT {\n}\n", ("void f(void) NOEXCEPT", "/* one */")),
        ("/* one */\nint f(a, b) int a; char *b; /* two */\n{\n}\n", ("int f(a, b) int a; char *b;", "/* one */")), ("DECLARE(x) int x;\n/* one */ int main(void) { }\n", ("int main(void)", "/* one */")),
        ("/* no */\nstruct __attribute__((packed)) s { int a; };\n/* no */ int a = g((struct s){ 1 });\n/* one */ int (*f(int a))(int) __attribute__((cold)) { return 0; }\n", ("int (*f(int a))(int) __attribute__((cold))", "/* one */")),
    ],
)
def test_c_heads(source, want):
    assert [(s, d) for _, _, s, d in D.c_functions(source)] == [want]


def test_opening_comment_of_c():
    assert D.documentation("c", " ", "/* Says what it does here. */\n#define X\nint f(void)\n{\n}\n") == "/* Says what it does here. */"
    assert D.documentation("c", None, "int x;\n/* no */\n") == "" and D.documentation("c", None, None) == ""


def test_functions_against_ast():
    r = random.Random(4)
    for _ in range(200):
        doc = r.choice(['"""a\n    b"""', "'x'", 'r"""q"""', 'b"no"', 'f"no"', '"a" "b"', "", 'x = "no"', '"no".strip()', "# c\n    'after'", "u'''u'''"])
        source = f"{r.choice(['', '@d(1)' + chr(10)])}def f(a: int = {r.randrange(9)}, *b) -> {r.choice(['int', '{1: 2}'])}:\n    {doc}\n    return a\n"
        f = ast.parse(source).body[0]
        want = ast.get_docstring(f, clean=False) or ""
        assert next(D.python_functions(source))[3] == want, source


def test_documented(spark):
    rows = [("a", "python", "function", "f", None, None, 'def f():\n    """Says what it does here."""\n', 1), ("a", "python", "function", "f", None, None, 'def f():\n    """Says what it does here."""\n', 1), ("b", "c", "function", "g", "s", " \n", "int g(void) {}\n", 1), ("c", "python", "function", None, None, "Tells all there is to tell.", None, 1), ("d", None, None, None, None, None, None, 1), ("e", "text", "function", "x", None, None, "whatever", 1), ("l", "python", "function", "big", None, "", "def big():\n" + "    x = 1\n" * 50_000, 1)]
    df = spark.createDataFrame(rows, "identity string, language string, kind string, name string, signature string, docstring string, source string, documentation int")
    got = D.documented_functions(df).where("not trivial").dropDuplicates(["identity"]).collect()
    assert {r.identity for r in got} == {"a", "c"} and {r.signature for r in got if r.identity == "a"} == {"def f()"}
    assert D.documented_functions(df.limit(0)).collect() == []


VALID = ["x = 1\n", "", "\n\n", HAND, "match x:\n    case [1, *_] if y: pass\n    case {'a': b, **c} | D(e=f): pass\n", "type X[T] = list[T]\n", "async def f():\n    async with a as b, c: await d\n    return [x async for x in y if z]\n", "f(*a, c=1, *(d for d in e), **b)\n", "x: int = lambda a, *b, c=1, **d: (yield)\n", "a[1:2, ::3, ...] = b if c else d\n", "try:\n    pass\nexcept* E as e:\n    pass\nelse:\n    pass\nfinally:\n    pass\n", "with (a as b, c as d,): pass\n", "def f[T: int](a, /, b, *, c) -> x: ...\n", "print(f'{a!r:>{b}}' \"x\" r'\\d')\n", "if a: b; c\nelif d: e\nelse: f\n", "match = case = type = 1; print(match)\n", "x = [\n  1,\n\n  2,  # c\n]\n", "@a.b(c)\n@d\nclass E(F, g=h): i = 1\n", "del a, b[0]; global_ = not a in b is not c\n", "from . import (a as b, c,)\nfrom ..x.y import *\n", "0x_ff + 0b1 + 1_0.5e-3j if a else 1if b else 2\n", "for a, *b in c: pass\nelse: pass\n", "\tif a:\n\t\tb\n".replace("\tif", "if", 1).replace("\n\t\tb", "\n\tb"), "x = yield\n".join(["def f():\n    ", ""]), "raise A from b\nassert c, d\n", "lambda: (yield)\n", "(a := 1) + (b, *c)[0]\n", "{**a, 'b': c}; {*a, b}; {a: b for c in d}\n"]
INVALID = ["x = (\n", "def f(:\n    pass\n", 'print "x", 1\n', "if a\n    b\n", "x = 1 +\n", "  x = 1\ny = 2\n    z = 3\n", '"""open\n', "'open\n", "a b c\n", "def f():\nreturn 1\n", "class:\n    pass\n", "<<<<<<< ours\nx = 1\n=======\nx = 2\n>>>>>>> theirs\n", "x = [1, (2, 3]\n", "int main(void) { return 0; }\n", "f() = 1\n", "else:\n    pass\n", "try:\n    x\n", "0b12\n", "1abc\n", "for x y in z: pass\n", "import\n", "x = ? 1\n", "steps:\n  - a: b c\n", "@d\nx = 1\n", "return = 1\n", "x ==\n", "f(a b)\n", "d = {1: 2, 3}\n", "while True:\n"]


@pytest.mark.parametrize("source", VALID + INVALID)
def test_python_chart_agrees_with_the_parser(source):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(source)
            ok = True
        except SyntaxError:
            ok = False
    cost, cause = S.repairs("python", source)
    assert (cost == 0) == ok and (cause is None) == ok


C_VALID = ["", "int x;\n", "#include <a.h>\nstatic const char *const a[] = { \"x\", [2] = \"y\" \"z\", };\n", "struct s { int a:3; struct { int b; } c[2]; };\nenum e { A = 1, B, };\ntypedef int (*fn)(const char *, ...);\n", "int f(int a, char **b)\n{\n\tint i, *p = &a;\n\tfor (i = 0; i < 3; i++) { if (a) continue; else break; }\n\tdo { a--; } while (a > 0);\n\tswitch (a) { case 1: case 2: return -1; default: goto out; }\n\tp->x[3].y = (int)sizeof(struct s) + a ? b : c;\nout:\n\treturn a ? 1 : 0;\n}\n", "extern \"C\" {\nint a(void);\n}\n", "#define A(x) \\\n  (x)\n#ifdef B\nint b = 1;\n#endif\n", "MODULE(\"x\");\nunsigned long long y = 0x10ull, z;\n", "for_each(x);\n", "int g(void) { list_for(a, b) { c(); } while (1); return 'a'; }\n"]
C_INVALID = ["int f(int a)\n{\n    return a;\n", "int f(int a)\n{\n    int b = ;\n}\n", "int x = 3\nint y = 4;\n", "int f(void)\n{\n<<<<<<< HEAD\n    a();\n=======\n    b();\n>>>>>>> x\n}\n", "def f(a):\n    return a\n", "char *s = \"open;\n", "/* open\nint a;\n", "int f(void) { if (1 > (3 { return 1; } }\n", "#ifdef A\nint a;\n", "int f(void) { return 1 }\n", "<html><body>x</body></html>\n", "int a[3;\n", "int f(void) { else return 1; }\n", "int f(void) { long v = for\n"]


@pytest.mark.parametrize("source, ok", [(s, True) for s in C_VALID] + [(s, False) for s in C_INVALID])
def test_c_chart(source, ok):
    assert (S.repairs("c", source)[0] == 0) == ok


PY_TRICKY = ["def f(a=1, b): pass", "f(a=1, 2)", "f(**k, *a)", "[a, 1] = x", "def f(*): pass", "{**a for a in b}", 'f"{a b}"', "match x:\n  case (1 2):\n    pass", "try:\n  pass\nexcept A:\n  pass\nexcept* B:\n  pass", "b'\u00e9'", 'f"{a +}"', "if 1:\n        x\n\ty", "(" * 4000 + ")" * 4001]
PY_DEEP = ["x = " + "(" * 5000 + "1" + ")" * 5000, "a = " + " + ".join(["b"] * 5000), "x = " + "-" * 50_000 + "1", "f(" + ", ".join(["a"] * 3000) + ")"]
C_TRICKY = ["int x = _Generic(a, int: 1, default: 2);", 'asm volatile ("nop" : : : "memory");', 'void f(void) { asm volatile ("a" ::: "m"); asm goto ("" : : : : l); l: ; }', "int f(a, b) int a; char *b; { return a; }", "int f(void) { return (struct s){1}.a; }", "void f(void) { if (a) for (;;) if (b) c(); else d(); else e(); }", "void f(void) { do if (a) b(); else c(); while (x); g(); }", "static inline notrace u32 f(void) { return 1; }", "extern API(char *) f (const char *);", "int f(void) { " + "{" * 3000 + "}" * 3000 + " return 0; }", "int x = " + "(" * 4000 + "1" + ")" * 4000 + ";"]
C_WRONG = ["struct s { int a int b; };", "int int;", "x y z w;", "int f(void) { do x(); y(); }", "int f(void) { if (a) }", "int f(void) { if (a) b(); c(); else d(); }", "short long x;"]


@pytest.mark.parametrize("language, source, ok", [("python", s, False) for s in PY_TRICKY] + [("python", s, True) for s in PY_DEEP] + [("c", s, True) for s in C_TRICKY] + [("c", s, False) for s in C_WRONG])
def test_tricky_and_deep(language, source, ok):
    assert (S.repairs(language, source + "\n")[0] == 0) == ok


def test_shortened_chains_keep_the_verdict():
    for good in ("a = b" + " + b" * 40, "f(" + "a, " * 40 + "a)", "x = " + "not " * 40 + "a", "import " + "a, " * 40 + "b"):
        assert S.repairs("python", good)[0] == 0
    for bad in ("a = b" + " + b" * 40 + " +", "f(" + "a, " * 40 + ", a)", "x = a" + " b" * 40, "assert " + "a, " * 40 + "b"):
        assert S.python_edits(bad).cost > 0


def test_causes_and_least_cost():
    assert S.repairs("python", "def f():\n    x = (1,\n")[1] == "truncation" and S.repairs("python", INVALID[11])[1] == "conflict" and S.repairs("python", "int main(void)\n{\n    return 0;\n}\n")[1] == "mismatch"
    assert S.PYTHON.repair("line", ("n", "=", "n", "n"))[0] == 1 and S.PYTHON.repair("line", ("n", "=", "n"))[0] == 0


@pytest.mark.parametrize(
    "language, source, want",
    [
        ("python", "a b c d " * 10 + "\n", 20), ("python", "a b " * 35 + "\n", 35), ("python", "a b " * 2500 + "\n", 2500), ("python", "a b c d e f g h i j\n" * 12, 60),
        ("python", "def f(" + "1, " * 40 + "): pass\n", 40), ("python", "f(" + "a b c d e f, " * 12 + ")\n", 36), ("c", "int f(void)\n{\n" + "    a = 1 2 3 4 5;\n" * 12 + "}\n", 24), ("c", "int x = a" + " b" * 60 + " : c" * 60 + ";\n", 31),
        ("c", "int x[] = { " + "1 2 3, " * 40 + "};\n", 40), ("c", "int f(void) { g(a ? b, c : d, " + "e, " * 12 + "h); }\n", 0), ("c", "int x = " + "a ? " * 100 + "b c" + " : d" * 100 + ";\n", 1),
    ],
)
def test_no_piece_or_edit_is_left_out(language, source, want):
    assert S.repairs(language, source)[0] == want


def test_repairs_are_the_cheapest():
    grammar = Grammar("e -> b | b ? e : e | - e\nb -> x | l | x + b\nl -> x [ | l [")
    kinds, r = "x+?:-[", random.Random(5)

    @cache
    def cost(tokens):
        return grammar.repair("e", tokens)[0]

    for _ in range(60):
        tokens = tuple(r.choices(kinds + ":?", k=r.randrange(9)))
        cuts = [(tokens[:i], tokens[i:]) for i in range(len(tokens) + 1)]
        near = [a + b[1:] for a, b in cuts if b] + [a + (k,) + b for a, b in cuts for k in kinds] + [a + (k,) + b[1:] for a, b in cuts if b for k in kinds]
        assert (cost(tokens) == 0) == grammar.accepts("e", tokens) and len(grammar.repair("e", tokens)[1]) == cost(tokens)
        # no edit saves more than one, and some edit saves one: that is the distance
        assert not cost(tokens) or min(map(cost, near)) == cost(tokens) - 1
    # calls inside calls, as deep as it takes
    assert cost(tuple("x" + "?x" * 40 + ":x" * 40)) == 0 and cost(tuple("x" + ":x" * 40)) == 20


def test_invalid_files(spark):
    defs = spark.createDataFrame([("a", "python", "script", "x = (\n", 1), ("a", "python", "script", "x = (\n", 1), ("b", "python", "script", None, 1), ("c", "text", "script", "x = (", 1), ("d", "c", "script", "int x;\n", 1)], "identity string, language string, kind string, source string, cost int")
    locs = spark.createDataFrame([(i, "r", "s", f"{i}.py", None) for i in "aabcd"], "identity string, repo string, sha string, path string, symbol string")
    notes = ["n.py: invalid syntax (n.py, line 1)", "m.c: the grammar reports an error near line 4", "k.py#f: did not parse", "j.py: larger than 1000000 bytes", "i.py: 'utf-8' codec can't decode byte 0x8f in position 6: invalid start byte", "h.py: line 3: unexpected `x` after the address", "g.py: git cat-file failed: object a9 is missing", "nothing", None]
    revs = spark.createDataFrame([("r", "s", notes, 10), ("r", "s", None, 10)], "repo string, sha string, skipped array<string>, files int")
    got = S.invalid_files(defs, locs, revs)
    assert {(r.path, r.cause) for r in got.collect()} == {("a.py", "truncation"), ("n.py", "reported"), ("m.c", "reported")}
    assert {(r.language, r.invalid, r.rate) for r in S.invalid_rates(got, revs).collect()} == {("python", 2, 0.2), ("c", 1, 0.1)}
    assert S.invalid_files(defs.limit(0), locs.limit(0), revs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, want",
    [("Apche License 2.0", ("Apache-2.0",)), ("GNU Genral Public License v3", ("GPL-3.0",)), ("Mozila Public License 2.0", ("MPL-2.0",)), ("GNU Leser General Public License v3", ()), ("GNU Affero Genral Public License 3", ()), ("The MTI License", ()), ("GNU General Public License 4", ()), ("MIT License", ("MIT",)), ("Expat/MIT", ("MIT",)), ("Apache License, Version 2.0", ("Apache-2.0",)), ("GNU GENERAL PUBLIC LICENSE Version 3", ("GPL-3.0",)), ("GPLv2+", ("GPL-2.0",)), ("LGPL-3.0", ()), ("GNU Lesser General Public License v3", ()), ("AGPL-3.0-only", ()), ("The 3-Clause BSD License", ("BSD-3-Clause",)), ("Simplified BSD License (2 clauses)", ("BSD-2-Clause",)), ("0BSD", ()), ("BSD-4-Clause", ()), ("MPL 2.0", ("MPL-2.0",)), ("The ISC Licence", ("ISC",)), ("NOASSERTION", ()), ("", ()), ("All rights reserved.", ()), ("MIT OR Apache-2.0", ("MIT", "Apache-2.0"))],
)
def test_named(text, want):
    assert K.named(text, True) == want


def test_distance_is_the_edit_distance():
    r = random.Random(6)
    for _ in range(300):
        a, b = (tuple(r.choice("xyz") for _ in range(r.randrange(9))) for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
        assert K.distance(a, b) == d[-1]


def test_metric_tree_finds_the_nearest():
    r = random.Random(7)
    keys = [tuple(r.choice("abc") for _ in range(6)) for _ in range(60)]
    tree = K.MetricTree()
    for k in keys:
        tree.add(k, "".join(k))
    for _ in range(100):
        q = tuple(r.choice("abc") for _ in range(6))
        best = min(K.distance(k, q) for k in keys)
        got = tree.nearest(q, 2)
        assert (got[0] == best) if best <= 2 else got is None


def test_offered():
    assert K.offered("python", "# SPDX-License-Identifier: BSD-3-Clause OR GPL-3.0\nX = ('ISC', 1)\ndef f():\n    # License: MIT\n    pass\n") == [["BSD-3-Clause", "GPL-3.0"]]
    assert K.offered("python", '"""License: MIT"""\n__license__ = "Apache 2.0"\n') == [["Apache-2.0"]] and K.offered("python", "def f(): pass\n__license__ = 'MIT'\n") == []
    assert K.offered("c", "/*\n * Free software under the GNU General Public\n * License, version 2.\n */\nint a;\n// License: MIT\n") == [["GPL-2.0"]] and K.offered("c", None) == []
    assert K.offered("python", "# Datei mit Hilfen\nx = 1\n") == []


def test_no_text_is_cut():
    assert K.title_license("A long word of thanks. " * 60 + "\n\n\nMore.\n\nAnd more.\n\nMIT License\n\nCopyright x") == ("MIT",)
    assert K.offered("c", "/*" + " blah\n" * 5000 + "*/\n/* Redistribution and use in source and binary forms, with or without modification, are permitted provided */\nint a;") == [["BSD-2-Clause"]]
    for spdx, text in K.TEXTS.items():
        words = text.split()
        words[5:7] = ["changed"]
        assert K.title_license("Copyright (c) x\n\n" + " ".join(words)) == (spdx,) and K.whole_text(text) == spdx
    assert K.whole_text("permission to use") is None and K.whole_text("") is None


def test_verdicts(spark):
    defs = spark.createDataFrame([("m", "python", "script", "# License: MIT\n", 1), ("g", "c", "script", "// License: GPLv3\n", 1), ("n", "python", "script", "x = 1\n", 1), ("o", "python", "script", "# SPDX-License-Identifier: MIT OR ISC\n", 1), ("t", "text", "script", "# License: ISC\n", 1), ("z", "python", "script", None, 1)], "identity string, language string, kind string, source string, license int")
    locs = spark.createDataFrame([(i, r, "s", f"{i}", None) for i in "mgnotz" for r in ("mit", "none", "two")] + [("m", "mit", "s", "m", None)], "identity string, repo string, sha string, path string, symbol string")
    revs = spark.createDataFrame([("mit", "s", None), ("mit", "s", "mit"), ("none", "s", "other"), ("two", "s", "MIT"), ("two", "s", "MIT")], "repo string, sha string, license string")
    roots = spark.createDataFrame([("mit", "s", "LICENSE", "The MIT License (MIT)\n\nCopyright x"), ("mit", "s", "docs/COPYING", "Apache License 2.0\n"), ("two", "s", "Licence.txt", "ISC License\n\nCopyright y"), ("two", "s", "COPYING", None), ("none", "s", "LICENSE-old", "MIT License")], "repo string, sha string, path string, text string")
    got = {(r.repo, r.path): r.flag for r in K.license_verdicts(defs, locs, revs, roots).collect()}
    assert got == {
        ("mit", ""): None, ("none", ""): "unknown", ("two", ""): "conflict", ("mit", "m"): None, ("mit", "g"): "conflict", ("mit", "n"): None, ("mit", "o"): None, ("mit", "z"): None,
        ("none", "m"): None, ("none", "g"): None, ("none", "n"): "unknown", ("none", "o"): None, ("none", "z"): "unknown", ("two", "m"): None, ("two", "g"): None, ("two", "n"): "conflict", ("two", "o"): None, ("two", "z"): "conflict",
    }
    assert K.license_verdicts(defs.limit(0), locs.limit(0), revs.limit(0), roots.limit(0)).collect() == []


def test_functions_of_whole_files(spark):
    py = 'import os\n\n\ndef a(x):\n    """Says what the first one really does here."""\n    return "def fake(): {"\n\n\nclass B:\n    def m(self):\n        """TODO: document this."""\n\n    def bare(self):\n        return 1\n'
    c = '/* Opens the valve by so many turns of the wheel. */\nstatic int open_valve(int turns)\n{\n\tchar *s = "}";\n\treturn turns; /* } */\n}\n\nint other(void) { return 0; }\n'
    files = spark.createDataFrame([("p", "python", py, 1), ("c", "c", c, 1), ("n", "c", None, 1), ("t", "text", c, 1)], "identity string, language string, source string, start int")
    rows = {(r.identity, r.signature.split("(")[0].split()[-1]): r for r in D.extracted_functions(files).collect()}
    assert {k: r.trivial for k, r in rows.items()} == {("p", "a"): False, ("p", "m"): True, ("c", "open_valve"): False}
    assert c[rows["c", "open_valve"].start : rows["c", "open_valve"].stop].rstrip().endswith("}") and D.extracted_functions(files.limit(0)).collect() == []
