"""Files to pages, references and links: the tables of an index from the texts of a tree."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.c_pages import c_pages, c_shape, c_tokens
from pagemill.functions.links import address
from pagemill.functions.pagetext import LinkLine, own_text, read_link
from pagemill.functions.python_pages import module_exports, python_pages, python_shape
from pagemill.functions.text import language_of, short
from pagemill.session import cut
from pagemill.tables import identity_of

#: longer files, in characters, are skipped and noted
MOST_CHARACTERS = 1_000_000
_LINK_TYPE = pa.struct([("line", pa.int32()), ("relation", pa.string()), ("address", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("description", pa.string()), ("derived", pa.bool_()), ("indent", pa.int32())])
_REF_TYPE = pa.struct([("name", pa.string()), ("level", pa.int32()), ("parts", pa.list_(pa.string())), ("statement", pa.string())])
_PAGE = pa.schema(
    [
        ("language", pa.string()), ("digest", pa.string()), ("symbol", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("signature", pa.string()), ("docstring", pa.string()),
        ("span_first", pa.int32()), ("span_last", pa.int32()), ("lines", pa.int32()), ("source", pa.string()), ("identity", pa.string()), ("shape", pa.string()), ("unresolved", pa.list_(pa.string())),
        ("refs", pa.list_(_REF_TYPE)), ("links", pa.list_(_LINK_TYPE)), ("page_seq", pa.int32()), ("note", pa.string()),
    ]
)
_PAGE_SCHEMA = (
    "language string, digest string, symbol string, kind string, name string, signature string, docstring string, span_first int, span_last int, lines int, source string, identity string, shape string, unresolved array<string>, "
    "refs array<struct<name:string,level:int,parts:array<string>,statement:string>>, links array<struct<line:int,relation:string,address:string,fields:map<string,string>,description:string,derived:boolean,indent:int>>, page_seq int, note string"
)


def _text_pages(text: str) -> Iterator[dict]:
    """A file of no known language is a page only if it has a link line."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    kept, links = own_text(lines)
    if links:
        yield {"symbol": None, "kind": "script", "source": "\n".join(kept).rstrip("\n") + "\n", "first": 1, "last": len(lines) - (lines[-1] == ""), "links": links, "refs": [], "unresolved": [], "statements": [], "parsed": True}


def _rows(language: str, digest: str, text: str) -> Iterator[dict]:
    base = dict.fromkeys(_PAGE.names) | {"language": language, "digest": digest}
    if len(text) > MOST_CHARACTERS:
        yield base | {"note": f"larger than {MOST_CHARACTERS} characters"}
        return
    lines = text.split("\n")
    for n, line in enumerate(lines):
        if isinstance(bad := read_link(n, line), str) and bad != "no address":
            yield base | {"note": f"line {n + 1}: {bad}; the line was ignored"}
    pages = {"python": python_pages, "c": c_pages}.get(language, _text_pages)
    shape = {"python": python_shape, "c": c_shape}.get(language, lambda _: None)
    for seq, p in enumerate(pages(text)):
        if not p["parsed"]:
            yield base | {"note": "the file did not parse"}
        form = shape(p["source"])
        symbol = p["symbol"]
        yield base | {
            "symbol": symbol, "kind": p["kind"], "name": symbol.rsplit(".", 1)[-1] if symbol else None, "signature": p.get("signature"), "docstring": p.get("docstring"),
            "span_first": p["first"], "span_last": p["last"], "lines": p["last"] - p["first"] + 1, "source": p["source"], "identity": hashlib.sha256(p["source"].encode("utf-8", "replace")).hexdigest(),
            "shape": hashlib.sha256(form.encode("utf-8", "replace")).hexdigest() if form is not None else None, "unresolved": p.get("unresolved", []),
            "refs": [{"name": n, "level": lv, "parts": list(ps), "statement": said} for n, lv, ps, said in p.get("refs", [])], "links": [_link(k) for k in p["links"]], "page_seq": seq,
        }


def _link(k: LinkLine) -> dict:
    return {"line": k.row + 1, "relation": k.relation, "address": k.address, "fields": list(k.fields.items()), "description": k.description, "derived": k.derived, "indent": k.indent}


def extract_texts(texts: DataFrame) -> DataFrame:
    """Pages of distinct (language, digest, text); rows with a ``note`` and no kind say what was skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for language, digest, text in zip(*(c.to_pylist() for c in b.columns)):
                out += _rows(language, digest, text)
                if len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=_PAGE)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)

    return texts.select("language", "digest", "text").mapInArrow(run, _PAGE_SCHEMA)


def extract(files: DataFrame) -> DataFrame:
    """Pages of files (repo, sha, path, text), each text parsed once however many places it has; rows with a ``note`` and no kind say what was skipped.

    Files that do not parse are one page with a note; null texts give nothing, an empty text one empty page.
    Files without a known language are pages only where they hold a link line.
    """
    at = files.where("text is not null").select("repo", "sha", "path", language_of("path").alias("language"), F.sha2("text", 256).alias("digest"), "text")
    pages = extract_texts(at.dropDuplicates(["language", "digest"]))
    placed = at.select("repo", "sha", "path", "language", "digest").distinct().join(pages, ["language", "digest"]).drop("digest")
    return placed.withColumn("name", F.when(F.col("kind").isNotNull(), F.coalesce("name", F.substring_index("path", "/", -1)))).withColumn("note", F.concat("path", F.lit(": "), "note"))


def _looked_up(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (repo, sha, path, symbol, name, level, parts, statement) with the file and the parts left over; nulls where no file fits.

    A module is looked for beside its file for relative imports, and for absolute ones in the
    file's ancestor folders that are no packages, nearest first, then in ``src``; the longest prefix of the
    dotted name that is a file wins. Every candidate is one row of an equi-join with the files.
    """
    key = ["repo", "sha", "path", "level", "parts"]
    asked = refs.where("level >= 0").select(*key).distinct()
    tree = files.select("repo", "sha", F.col("path").alias("file")).distinct()
    packages = tree.where("file like '%/__init__.py' or file = '__init__.py'").select("repo", "sha", F.expr("left(file, length(file) - 11)").alias("folder")).withColumn("package", F.lit(True))
    # the folders over a file, nearest first, each with a final slash ('' is the root)
    over = F.expr("transform(sequence(size(split(path, '/')) - 1, 0, -1), n -> case when n = 0 then '' else array_join(slice(split(path, '/'), 1, n), '/') || '/' end)")
    far = asked.withColumn("over", over)
    absolute = far.where("level = 0").select("*", F.posexplode(F.array_union("over", F.array(F.lit("src/")))).alias("near", "folder"))
    absolute = absolute.join(packages, ["repo", "sha", "folder"], "left").where("package is null or folder = 'src/'").drop("package")
    relative = far.where("level > 0 and size(over) >= level").select("*", F.lit(0).alias("near"), F.expr("element_at(over, level)").alias("folder"))
    tried = absolute.select(*relative.columns).unionByName(relative).where("size(parts) > 0 or level > 0")
    # of `from . import x` where x is no module, and of `from . import *`, the package itself is the last resort
    tried = tried.select("*", F.explode(F.expr("sequence(case when level > 0 then 0 else 1 end, size(parts))")).alias("taken"))
    stem = F.concat("folder", F.array_join(F.expr("slice(parts, 1, taken)"), "/"))
    names = F.when(F.col("taken") == 0, F.array(F.concat("folder", F.lit("__init__.py")))).otherwise(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))))
    hit = tried.where("taken > 0 or size(parts) <= 1").select("*", F.explode(names).alias("file")).join(tree, ["repo", "sha", "file"])
    best = hit.groupBy(*key).agg(F.max_by(F.struct("file", "taken"), F.struct("taken", -F.col("near"), F.length("file") * -1)).alias("b"))
    return refs.where("level >= 0").join(best, key, "left").select(
        "repo", "sha", "path", "symbol", "name", "level", "parts", "statement", F.col("b.file").alias("file"), F.expr("slice(parts, b.taken + 1, size(parts))").alias("rest")
    )


def _asked(pages: DataFrame) -> DataFrame:
    return pages.where("kind is not null").select("repo", "sha", "path", "symbol", F.explode("refs").alias("r")).select("repo", "sha", "path", "symbol", "r.*")


def references(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, sha, path, symbol, name, target_path, target_symbol): references into the same tree, as written."""
    r = _asked(pages)
    own = r.where("level = -1").select("repo", "sha", "path", "symbol", "name", F.col("path").alias("target_path"), F.array_join("parts", ".").alias("target_symbol"))
    found = _looked_up(r, files).where("file is not null")
    rest = F.array_join("rest", ".")
    return own.unionByName(found.select("repo", "sha", "path", "symbol", "name", F.col("file").alias("target_path"), F.when(rest != "", rest).alias("target_symbol"))).distinct()


def is_stdlib(module: Column | str) -> Column:
    """Whether a module is one of the running interpreter's library."""
    return (F.col(module) if isinstance(module, str) else module).isin(*sorted(sys.stdlib_module_names))


def imports(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, sha, path, symbol, stdlib, third_party, statements) of pages that import from outside their tree, each list sorted."""
    out = _looked_up(_asked(pages), files).where("file is null and level = 0 and size(parts) > 0").withColumn("module", F.element_at("parts", 1))
    listed = lambda c: F.array_sort(F.collect_set(c))
    return out.groupBy("repo", "sha", "path", "symbol").agg(
        listed(F.when(is_stdlib("module"), F.col("module"))).alias("stdlib"), listed(F.when(~is_stdlib("module"), F.col("module"))).alias("third_party"), listed("statement").alias("statements")
    )


def unmapped(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, sha, module, files): modules a tree could provide that files import without their being found; ``found`` is ``imports``.

    A tree provides its packages, at any depth, and the Python files at its root.
    """
    inside = F.regexp_extract("path", "(?:^|/)([^/]+)/__init__[.]py$", 1)
    at_root = F.regexp_extract("path", "^([^/]+)[.]py$", 1)
    provided = files.select("repo", "sha", F.explode(F.array(inside, at_root)).alias("module")).where("module <> ''").distinct()
    asked = found.where("symbol is null").select("repo", "sha", "path", F.explode("third_party").alias("module"))
    return asked.join(provided, ["repo", "sha", "module"], "left_semi").groupBy("repo", "sha", "module").agg(F.count("*").cast("int").alias("files"))


_EXPORTS = pa.schema(
    [
        ("digest", pa.string()), ("named", pa.list_(pa.struct([("name", pa.string()), ("level", pa.int32()), ("parts", pa.list_(pa.string()))]))),
        ("stars", pa.list_(pa.struct([("level", pa.int32()), ("parts", pa.list_(pa.string()))]))), ("listed", pa.list_(pa.string())), ("defined", pa.list_(pa.string())),
    ]
)
_EXPORTS_SCHEMA = "digest string, named array<struct<name:string,level:int,parts:array<string>>>, stars array<struct<level:int,parts:array<string>>>, listed array<string>, defined array<string>"


def exports(files: DataFrame) -> DataFrame:
    """(repo, sha, path, named, stars, listed, defined) of each Python module: see ``module_exports``. Each text is parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, text in zip(*(c.to_pylist() for c in b.columns)):
                e = module_exports(text)
                rows.append({"digest": digest, "named": [{"name": n, "level": lv, "parts": list(ps)} for n, lv, ps in e.named], "stars": [{"level": lv, "parts": list(ps)} for lv, ps in e.stars], "listed": e.listed, "defined": e.defined})
            yield pa.RecordBatch.from_pylist(rows, schema=_EXPORTS)

    at = files.where("path like '%.py' and text is not null").select("repo", "sha", "path", F.sha2("text", 256).alias("digest"), "text")
    told = at.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(run, _EXPORTS_SCHEMA)
    return at.select("repo", "sha", "path", "digest").distinct().join(told, "digest").drop("digest")


def handed_on(told: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, sha, path, name, to_path, to_symbol): what a name that a module hands on stands for, one step on.

    ``told`` is ``exports``. Imports and aliases come first, then the first star import whose module defines the name or hands
    it on itself, unless its ``__all__`` leaves the name out; private names pass no star. Rounds follow chains of star imports
    until nothing is added, so chains may be of any length and rings end.
    """
    told = cut(told)
    where = ["repo", "sha", "path"]
    asked = told.select(*where, F.explode("named").alias("n")).select(*where, F.col("n.name").alias("symbol"), "n.name", "n.level", "n.parts", F.lit(None).cast("string").alias("statement"))
    rest = F.array_join("rest", ".")
    by_name = (
        _looked_up(asked, files).where("file is not null").select(*where, "name", F.col("file").alias("to_path"), F.when(rest != "", rest).alias("to_symbol"))
        .unionByName(asked.where("level = -1").select(*where, "name", F.col("path").alias("to_path"), F.element_at("parts", 1).alias("to_symbol")))
    )
    by_name = cut(by_name.distinct())
    starred = told.select(*where, F.posexplode("stars").alias("at", "s")).select(*where, F.col("at").cast("string").alias("symbol"), F.lit("*").alias("name"), "s.level", "s.parts", F.lit(None).cast("string").alias("statement"))
    stars = _looked_up(starred, files).where("file is not null and size(rest) = 0").groupBy(*where, F.col("file").alias("star")).agg(F.min(F.col("symbol").cast("int")).alias("at"))
    limits = told.where("listed is not null").select("repo", "sha", F.col("path").alias("star"), "listed")
    stars = cut(stars.join(limits, ["repo", "sha", "star"], "left"))
    if stars.isEmpty():
        return by_name
    defined = told.select("repo", "sha", F.col("path").alias("star"), F.explode("defined").alias("name")).withColumn("own", F.lit(True))
    out, size = by_name, -1
    while True:
        passed = out.select("repo", "sha", F.col("path").alias("star"), "name").withColumn("own", F.lit(False))
        offered = defined.unionByName(passed).where("not startswith(name, '_')").groupBy("repo", "sha", "star", "name").agg(F.max("own").alias("own"))
        given = stars.join(offered, ["repo", "sha", "star"]).where("(listed is null or array_contains(listed, name)) and star <> path")
        first = given.groupBy(*where, "name").agg(F.min_by("star", "at").alias("to_path")).withColumn("to_symbol", F.col("name"))
        now = cut(by_name.unionByName(first.join(by_name, [*where, "name"], "left_anti")))
        # what is handed on only grows, and is settled when it no longer does and no star is chosen anew
        n = now.select(F.struct(F.count("*"), F.sum(F.xxhash64("repo", "sha", "path", "name", "to_path").cast("decimal(38,0)")))).first()[0]
        if n == size:
            return now
        out, size = now, n


def forwarded(refs: DataFrame, told: DataFrame, files: DataFrame) -> DataFrame:
    """References followed through what modules hand on, to the definition or as far as it goes; rings end on the ring.

    ``told`` is ``exports``. Each round moves every reference that stands on a handed-on name which its file does not
    define one module further, until none moves; those that stand still leave the rounds.
    """
    steps = handed_on(told, files)
    own = told.select("repo", "sha", "path", F.explode("defined").alias("name"))
    steps = cut(steps.join(own, ["repo", "sha", "path", "name"], "left_anti").select("repo", "sha", F.col("path").alias("target_path"), F.col("name").alias("head"), "to_path", "to_symbol"))
    head = F.substring_index("target_symbol", ".", 1)
    tail = F.when(F.contains("target_symbol", F.lit(".")), F.expr("substring(target_symbol, instr(target_symbol, '.') + 1)"))
    to = F.concat_ws(".", "to_symbol", "tail")
    mark = F.concat_ws("#", "target_path", "target_symbol")
    moving, done = refs.select("repo", "sha", "path", "symbol", "name", "target_path", "target_symbol").withColumn("seen", F.array(mark)), None
    while True:
        looked = cut(moving.withColumn("head", head).withColumn("tail", tail).join(steps, ["repo", "sha", "target_path", "head"], "left"))
        still = looked.where("to_path is null").select("repo", "sha", "path", "symbol", "name", "target_path", "target_symbol")
        done = still if done is None else done.unionByName(still)
        moved = looked.where("to_path is not null").withColumn("target_symbol", F.when(to != "", to)).withColumn("target_path", F.col("to_path")).withColumn("ring", F.array_contains("seen", mark))
        done = done.unionByName(moved.where("ring").select(*still.columns))
        moving = moved.where("not ring").withColumn("seen", F.array_append("seen", mark)).drop("head", "tail", "to_path", "to_symbol", "ring")
        if moved.where("not ring").isEmpty():
            return done.distinct()


def index_tables(pages: DataFrame, refs: DataFrame, revisions: DataFrame, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """definitions, locations and links of extracted pages, and revisions with what was skipped and left unmapped.

    ``refs`` are ``references`` or ``forwarded``. Without ``files`` imports and unmapped modules are not told.
    """
    real = pages.where("kind is not null")
    place = ["repo", "sha", "path", "symbol"]
    found = imports(pages, files) if files is not None else None
    if found is None:
        found = real.select(*place).limit(0).select("*", *[F.lit(None).cast("array<string>").alias(c) for c in ("stdlib", "third_party", "statements")])
    same = F.expr("r.repo = f.repo and r.sha = f.sha and r.path = f.path and r.symbol <=> f.symbol")
    lists = real.alias("r").join(found.alias("f"), same, "left").select("r.*", "f.stdlib", "f.third_party", "f.statements")
    none = F.array().cast("array<string>")
    lists = lists.withColumn("imports", F.struct(*[F.coalesce(c, none).alias(c) for c in ("stdlib", "third_party", "statements")]))
    # one row an identity: the reading of its first place
    body = ["shape", "language", "kind", "name", "signature", "docstring", "lines", "source", "imports", "unresolved"]
    definitions = lists.groupBy("identity").agg(F.min_by(F.struct(*body), F.struct("repo", "sha", "path", F.coalesce("symbol", F.lit("")))).alias("d")).select("identity", "d.*")
    locations = real.select("identity", *place, "span_first", "span_last").distinct()
    links = _link_table(real, refs)
    notes = pages.where("note is not null").groupBy("repo", "sha").agg(F.array_sort(F.collect_list("note")).alias("skipped"))
    out = revisions.join(notes, ["repo", "sha"], "left")
    if files is not None:
        modules = unmapped(found, files).groupBy("repo", "sha").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "files")))).alias("unmapped"))
        out = out.join(modules, ["repo", "sha"], "left")
    return {"definitions": definitions, "locations": locations, "links": links, "revisions": out}


def _link_table(real: DataFrame, refs: DataFrame) -> DataFrame:
    """Links of pages with the parsed parts of their addresses: asserted ones by link line, derived ones by reference."""
    asserted = real.select(F.col("identity").alias("source_identity"), "repo", "sha", F.col("path").alias("file"), "symbol", "page_seq", F.explode("links").alias("k"))
    # a link inside a definition belongs to it and not to the file
    inner = asserted.where("symbol is not null").select("repo", "sha", "file", F.col("k.line").alias("line")).distinct()
    mine = asserted.withColumn("line", F.col("k.line"))
    mine = mine.where("symbol is not null").unionByName(mine.where("symbol is null").join(inner, ["repo", "sha", "file", "line"], "left_anti").select(*mine.columns))
    said = mine.select(
        "source_identity", "repo", "sha", "file", "line", F.col("k.relation").alias("relation"), F.lit("asserted").alias("origin"), F.col("k.address").alias("target_address"),
        F.col("k.description").alias("description"), F.col("k.derived").alias("derived"), F.col("k.fields").alias("fields"), F.col("k.indent").alias("indent"), F.lit(None).cast("string").alias("name"),
    )
    pinned = F.concat(F.col("r.repo"), F.lit("@"), short("r.sha"), F.lit("/"), F.col("target_path"), F.coalesce(F.concat(F.lit("#"), F.col("target_symbol")), F.lit("")))
    of = real.select("repo", "sha", "path", "symbol", "identity", "span_first").alias("p")
    derived = refs.alias("r").join(of, F.expr("r.repo = p.repo and r.sha = p.sha and r.path = p.path and r.symbol <=> p.symbol")).select(
        F.col("p.identity").alias("source_identity"), "r.repo", "r.sha", F.col("r.path").alias("file"), F.col("p.span_first").alias("line"), F.lit("ref").alias("relation"), F.lit("derived").alias("origin"), pinned.alias("target_address"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("boolean").alias("derived"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit(None).cast("int").alias("indent"), "r.name",
    )
    a = said.unionByName(derived).withColumn("a", address("target_address"))
    stamp = identity_of(F.try_element_at("fields", F.lit("id")))
    return a.select(
        *[c for c in a.columns if c != "a"], F.col("a.form").alias("target_form"), F.col("a.name").alias("target_name"), F.col("a.locator").alias("target_locator"), F.col("a.path").alias("target_path"), F.col("a.rev").alias("target_rev"),
        F.col("a.symbol").alias("target_symbol"), F.coalesce(identity_of("a.identity"), stamp).alias("target_id"),
    ).dropDuplicates(["source_identity", "repo", "sha", "file", "line", "relation", "target_address"])


def new_revisions(revisions: DataFrame, crawled: DataFrame) -> DataFrame:
    """Revisions that are not crawled yet."""
    return revisions.join(crawled.select("repo", "sha").distinct(), ["repo", "sha"], "left_anti")


_TOKENS = pa.schema([("file", pa.string()), ("row", pa.int32()), ("position", pa.int32()), ("category", pa.string()), ("token", pa.string())])


def tokens(files: DataFrame) -> DataFrame:
    """(file, row, position, category, token) of C texts (file, text): identifier, keyword, number, string, directive or punctuation, without comments. Rows count from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(file, *t) for file, text in zip(*(c.to_pylist() for c in b.columns)) if text for t in c_tokens(text)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TOKENS.types)] if rows else [pa.array([], t) for t in _TOKENS.types], schema=_TOKENS)

    return files.select("file", "text").mapInArrow(run, "file string, row int, position int, category string, token string")
