"""Queries of the index itself, each over its whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import links as L
from pagemill.functions.text import identity, spdx
from pagemill.operators import closure, extraction, lines, lookup, pages, records, search
from pagemill.tables import identity_of, latest_revision, table

#: the text that the registered search asks for
SEARCH = "frame"


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of each table."""
    keys = {"repos": ["locator"], "revisions": ["repo", "sha"], "definitions": ["identity"], "locations": ["repo", "sha", "path", "symbol"], "links": ["link_seq"], "registry_names": ["name", "registry"]}
    out = None
    for name, key in keys.items():
        one = table(spark, d, name, *key).distinct().agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def status(spark: SparkSession, d: str) -> DataFrame:
    return pages.status(table(spark, d, "repos"), table(spark, d, "revisions"))


def current_revision(spark: SparkSession, d: str) -> DataFrame:
    return latest_revision(table(spark, d, "revisions", "repo", "sha", "crawl_seq"))


def normalize_identity(spark: SparkSession, d: str) -> DataFrame:
    """Identities of the stored sources, recomputed."""
    return table(spark, d, "definitions", "identity", "source").distinct().select("identity", identity("source").alias("computed"))


def spdx_license(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "root_files", "repo", "sha", "path", "text").distinct().select("repo", "sha", "path", spdx("text").alias("license"))


def parse_address(spark: SparkSession, d: str) -> DataFrame:
    """Every target address with its parts; those that do not parse have a null form."""
    a = table(spark, d, "links", "target_address").distinct().withColumn("a", L.address("target_address"))
    return a.select("target_address", *[F.col(f"a.{c}").alias(c) for c in ("form", "name", "locator", "path", "rev", "symbol", "identity")])


def find_links(spark: SparkSession, d: str) -> DataFrame:
    """Link lines in whole files, by relation."""
    s = table(spark, d, "definitions", "identity", "kind", "source").where("kind = 'script'").select("identity", "source").distinct()
    k = s.select("identity", F.explode(F.split("source", "\n")).alias("line")).withColumn("k", L.link("line")).where("k is not null")
    k = k.where(L.address("k.address").isNotNull())
    return k.groupBy("identity", F.col("k.relation").alias("relation")).agg(F.count("*").alias("links"), F.count_if(F.col("k.description").isNotNull()).alias("described"))


def dups_identity(spark: SparkSession, d: str) -> DataFrame:
    return pages.dups(table(spark, d, "definitions"), table(spark, d, "locations"), table(spark, d, "revisions"))


def dups_shape(spark: SparkSession, d: str) -> DataFrame:
    return pages.dups(table(spark, d, "definitions"), table(spark, d, "locations"), table(spark, d, "revisions"), "shape")


def locations_of(spark: SparkSession, d: str) -> DataFrame:
    """Current places with their address and registry entry."""
    at = pages.registry_entry(pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions")), table(spark, d, "registry_names"))
    return at.select("identity", pages.locator().alias("address"), "entry")


def history(spark: SparkSession, d: str) -> DataFrame:
    return pages.history(table(spark, d, "locations"), table(spark, d, "revisions"))


def resolve_targets(spark: SparkSession, d: str) -> DataFrame:
    return pages.resolve_targets(*(table(spark, d, t) for t in ("links", "definitions", "locations", "revisions", "registry_names")))


def rank_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return pages.rank(table(spark, d, "links"))


def rank(spark: SparkSession, d: str) -> DataFrame:
    return pages.top_ranked(table(spark, d, "links"))


def who(spark: SparkSession, d: str) -> DataFrame:
    return pages.who(table(spark, d, "links"), table(spark, d, "revisions"), table(spark, d, "definitions"))


def who_counts(spark: SparkSession, d: str) -> DataFrame:
    return pages.who_counts(who(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return pages.coverage(table(spark, d, "revisions"), table(spark, d, "locations"), table(spark, d, "links"))


def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    return pages.coverage_totals(coverage(spark, d), table(spark, d, "links"))


def directories(spark: SparkSession, d: str) -> DataFrame:
    return pages.directories(table(spark, d, "locations"))


def unresolved_matching(spark: SparkSession, d: str) -> DataFrame:
    return pages.unresolved_matching(table(spark, d, "links"), table(spark, d, "definitions"))


def forward(spark: SparkSession, d: str) -> DataFrame:
    return pages.forward(table(spark, d, "definitions"), table(spark, d, "locations"), table(spark, d, "revisions"), table(spark, d, "links"))


def link_owners(spark: SparkSession, d: str) -> DataFrame:
    return pages.link_owners(table(spark, d, "links"), table(spark, d, "locations"))


def link_rows(spark: SparkSession, d: str) -> DataFrame:
    return pages.link_rows(table(spark, d, "links"))


def merged_definitions(spark: SparkSession, d: str) -> DataFrame:
    return pages.merged_definitions(table(spark, d, "definitions"))


def repo_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.repo_pages(table(spark, d, "locations"), table(spark, d, "revisions"), table(spark, d, "definitions"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_links(table(spark, d, "links"))


def names_now(spark: SparkSession, d: str) -> DataFrame:
    return pages.names_now(table(spark, d, "registry_names"))


def name_checks(spark: SparkSession, d: str) -> DataFrame:
    return pages.name_checks(table(spark, d, "registry_names"), table(spark, d, "locations"), table(spark, d, "revisions"))


def innermost(spark: SparkSession, d: str) -> DataFrame:
    return pages.innermost(pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions")))


def _reach(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "links", "source_identity", "relation", "origin", "target_identity")
    return closure.reach(closure.edges(k), closure.names_of_roots(k))


def symbol_files(spark: SparkSession, d: str) -> DataFrame:
    return pages.symbol_files(table(spark, d, "locations"))


def latest_places(spark: SparkSession, d: str) -> DataFrame:
    return pages.latest_places(table(spark, d, "locations"), table(spark, d, "revisions"))


def closure_reach(spark: SparkSession, d: str) -> DataFrame:
    return _reach(spark, d)


def closure_sizes(spark: SparkSession, d: str) -> DataFrame:
    return closure.closure_sizes(_reach(spark, d), table(spark, d, "definitions", "identity", "lines"))


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, d, "links", "source_identity", "relation", "origin", "target_identity")
    return closure.edges(k), closure.names_of_roots(k)


def closure_budget(spark: SparkSession, d: str) -> DataFrame:
    """Closures within the budget; those beyond it are followed no further than that takes."""
    return closure.budgeted(*_edges(spark, d), table(spark, d, "definitions", "identity", "lines"))


def closure_order(spark: SparkSession, d: str) -> DataFrame:
    """Closures in the order of writing, what a page needs before the page."""
    pairs, roots = _edges(spark, d)
    return closure.ordered(pairs, closure.reach(pairs, roots, 50))


def closure_free_names(spark: SparkSession, d: str) -> DataFrame:
    return closure.free_names(_reach(spark, d), table(spark, d, "definitions", "identity", "kind", "name", "unresolved"))


def closure_nodes(spark: SparkSession, d: str) -> DataFrame:
    now = pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions"))
    return closure.closure_nodes(_reach(spark, d), table(spark, d, "definitions"), table(spark, d, "registry_names"), now)


def closure_clashes(spark: SparkSession, d: str) -> DataFrame:
    return closure.name_clashes(_reach(spark, d), table(spark, d, "definitions", "identity", "kind", "name"))


def closure_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Modules that the files import in which the pages of a closure stand now; definitions have no imports of their own in these tables."""
    now = pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions"))
    return closure.requirements(closure.files_of(_reach(spark, d), now), table(spark, d, "definitions", "identity", "imports"))


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = search.search_documents(table(spark, d, "definitions"), table(spark, d, "locations"))
    return search.search(docs, SEARCH).select("identity", "symbol", F.round("score", 6).alias("score"))


def line_duplication(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "definitions", "identity", "kind", "language", "source").where("kind = 'script' and language = 'c'")
    return lines.duplication(lines.line_keys(s.select(F.col("identity").alias("file"), F.col("source").alias("text")).distinct()))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Events in the part of runs: user is the task, its last digit the family, the kind of event the arm."""
    return table(spark, d, "events", "user_id", "event_type", "value").select(
        (F.col("user_id") % 10).cast("string").alias("family"), F.col("user_id").cast("string").alias("task"), F.col("event_type").alias("arm"), F.when(F.col("value") > 50, "pass").otherwise("fail").alias("status"), F.col("value").alias("tokens")
    )


def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.summary(_runs(spark, d))


def benchmark_statuses(spark: SparkSession, d: str) -> DataFrame:
    return records.statuses(_runs(spark, d))


def answer_difference(spark: SparkSession, d: str) -> DataFrame:
    """Paths of each repository's current revision against those of all its revisions."""
    now = pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions")).select("repo", "path")
    return records.answer_difference(now, table(spark, d, "locations", "repo", "path"), "repo", "path")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Whole files as the tables hold them, in the part of a crawled tree."""
    text = table(spark, d, "definitions", "identity", "kind", "source").where("kind = 'script'").dropDuplicates(["identity"]).select("identity", F.col("source").alias("text"))
    return table(spark, d, "locations", "identity", "repo", "sha", "path", "symbol").where("symbol is null").distinct().join(text, "identity").select("repo", "sha", "path", "text")


def _index(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("definitions", "locations", "revisions", "registry_names")]


def resolve_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Every address that links write, to the page it names."""
    return lookup.resolve(table(spark, d, "links", F.col("target_address").alias("address")), *_index(spark, d))


def preferred_locations(spark: SparkSession, d: str) -> DataFrame:
    """Of each page that a link with a place names, the location to show for it."""
    k = table(spark, d, "links").where("target_identity is not null and target_form = 'locator'").select(
        F.col("link_seq").alias("ask"), identity_of("target_identity").alias("identity"), F.col("target_locator").alias("at_repo"), F.col("target_path").alias("at_path"), F.col("target_symbol").alias("at_symbol"), F.col("target_rev").alias("at_rev")
    )
    return lookup.preferred_location(k.distinct(), table(spark, d, "locations"), table(spark, d, "revisions")).withColumnRenamed("ask", "link_seq")


def page_objects(spark: SparkSession, d: str) -> DataFrame:
    """Pages as objects, their links as texts ``line relation address``."""
    o = lookup.page_objects(table(spark, d, "definitions"), table(spark, d, "locations"), table(spark, d, "revisions"), table(spark, d, "links"), table(spark, d, "registry_names"))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["line"], x["relation"], x["address"])), ";").alias(c)
    return o.select("address", "entry", "identity", "kind", "name", "signature", "docstring", "lines", "first", "last", line("links"), line("refs"))


def definition_pages(spark: SparkSession, d: str) -> DataFrame:
    """By the first eight digits of every identity that links name."""
    asked = table(spark, d, "links", F.substring(identity_of("target_identity"), 1, 8).alias("prefix")).where("prefix is not null")
    return lookup.definition_pages(asked, table(spark, d, "definitions"), table(spark, d, "locations"), table(spark, d, "revisions"), table(spark, d, "links"))


def who_by_address(spark: SparkSession, d: str) -> DataFrame:
    """Backlinks of every address that asserted links write."""
    asked = table(spark, d, "links").where("origin = 'asserted'").select(F.col("target_address").alias("address"))
    now = pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions"))
    return lookup.who_asked(asked, *_index(spark, d), who(spark, d), now)


def locations_in_order(spark: SparkSession, d: str) -> DataFrame:
    return lookup.locations_in_order(table(spark, d, "locations"), table(spark, d, "revisions"))


def hits_with_places(spark: SparkSession, d: str) -> DataFrame:
    """The pages most linked to, with their places."""
    return pages.hits_with_places(rank(spark, d), table(spark, d, "definitions"), table(spark, d, "locations"), table(spark, d, "revisions"))


def links_in_order(spark: SparkSession, d: str) -> DataFrame:
    return lookup.links_in_order(table(spark, d, "links"))


def greatest_dups(spark: SparkSession, d: str) -> DataFrame:
    return lookup.greatest_dups(dups_identity(spark, d))


def top_level_symbols(spark: SparkSession, d: str) -> DataFrame:
    return lookup.top_level(table(spark, d, "locations"), table(spark, d, "revisions"))


def unregistered(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that links name and nobody registered."""
    return lookup.unregistered(table(spark, d, "links").where("target_locator is not null").select(F.col("target_locator").alias("locator")), table(spark, d, "repos"))


def benchmark_ratios(spark: SparkSession, d: str) -> DataFrame:
    return records.ratios(_runs(spark, d), "click", "view")


def answer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of each repository's current revision as answers, those of all its revisions without members as what is expected."""
    now = pages.current_places(table(spark, d, "locations"), table(spark, d, "revisions")).where("symbol is not null").select("repo", "symbol")
    want = table(spark, d, "locations", "repo", "symbol").where("symbol is not null and not contains(symbol, '.')")
    return records.verdicts(now, want, "repo", "symbol")


def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Definitions found in the files, with their identity and whether the tables have them at that place."""
    got = extraction.extract(_tree(spark, d)).where("kind is not null").select("repo", "sha", "path", "symbol", "kind", "identity", "shape", "span_first", "span_last")
    held = table(spark, d, "locations", "identity", "repo", "sha", "path").distinct().withColumn("held", F.lit(True))
    return got.join(held, ["identity", "repo", "sha", "path"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def extracted_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Functions, classes and methods found in the Python files, with identity and span."""
    got = extraction.extract(_tree(spark, d).where("path like '%.py'")).where("language = 'python' and kind in ('function', 'class')")
    return got.select("repo", "sha", "path", "symbol", "identity", "span_first", "span_last").distinct()


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Whole files with their texts, and all paths of each tree."""
    return _tree(spark, d), table(spark, d, "locations", "repo", "sha", "path").distinct()


def extracted_references(spark: SparkSession, d: str) -> DataFrame:
    """References between the files of each tree, as written."""
    tree, every = _trees(spark, d)
    return extraction.references(extraction.extract(tree), every)


def forwarded_references(spark: SparkSession, d: str) -> DataFrame:
    """References between the files of each tree, followed to the definition they mean."""
    tree, every = _trees(spark, d)
    return extraction.forwarded(extraction.references(extraction.extract(tree), every), extraction.exports(tree), every)


def unmapped_modules(spark: SparkSession, d: str) -> DataFrame:
    tree, every = _trees(spark, d)
    return extraction.unmapped(extraction.imports(extraction.extract(tree), every), every)


def file_imports(spark: SparkSession, d: str) -> DataFrame:
    """Modules from outside the tree that each Python file imports, joined by commas."""
    tree, every = _trees(spark, d)
    found = extraction.imports(extraction.extract(tree.where("path like '%.py'")), every).where("symbol is null")
    return found.select("repo", "sha", "path", F.array_join("stdlib", ",").alias("stdlib"), F.array_join("third_party", ",").alias("third_party"))


def skipped_notes(spark: SparkSession, d: str) -> DataFrame:
    """What extraction has to note of each file: links it ignores and files that do not parse."""
    return extraction.extract(_tree(spark, d)).where("note is not null").select("repo", "sha", "path", "note").distinct()


_TI = "regexp_replace(lower(target_identity), '^sha256:', '')"
_CURRENT = "latest AS (SELECT repo, arg_max(sha, crawl_seq) sha FROM revisions GROUP BY repo), cur AS (SELECT DISTINCT l.* FROM locations l JOIN latest USING (repo, sha))"
_CRAWLS = "crawls AS (SELECT DISTINCT repo, sha, committed_at, crawl_seq, files, skipped, unmapped FROM revisions QUALIFY row_number() OVER (PARTITION BY repo, sha ORDER BY crawl_seq DESC) = 1)"
_DEFS = "defs AS (SELECT identity, any_value(shape) shape, any_value(kind) kind, any_value(name) name, any_value(lines) lines, any_value(imports) imports FROM definitions GROUP BY identity)"
_REACH = f"""e AS (SELECT DISTINCT source_identity s, {_TI} t FROM links WHERE relation IN ('is', 'ref') AND target_identity IS NOT NULL AND source_identity <> {_TI}),
    roots AS (SELECT DISTINCT source_identity root FROM links WHERE relation = 'is' AND origin = 'asserted'),
    reach AS (SELECT root, root AS page FROM roots UNION SELECT r.root, e.t FROM reach r JOIN e ON e.s = r.page)"""


def _dups_sql(key: str) -> str:
    return f"""WITH {_CURRENT}, {_DEFS}, pl AS (SELECT cur.*, d.shape, d.kind, d.name, d.lines FROM cur JOIN defs d USING (identity)),
        kept AS (SELECT * FROM pl a WHERE symbol IS NOT NULL OR NOT EXISTS (SELECT 1 FROM pl b WHERE b.symbol IS NOT NULL AND b.repo = a.repo AND b.path = a.path AND b.identity = a.identity))
        SELECT {key} "key", count(*) places, count(DISTINCT identity) identities, string_agg(DISTINCT name, ',' ORDER BY name) "names", arg_min(kind, (repo, path, coalesce(symbol, ''))) kind, arg_min(lines, (repo, path, coalesce(symbol, ''))) lines
        FROM kept WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1"""


_LICENSE_SQL = """WITH f AS (SELECT DISTINCT repo, sha, path, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) flat FROM root_files), h AS (SELECT *, substr(flat, 1, 2000) head FROM f),
    g AS (SELECT *, nullif(instr(head, 'gnu general public license'), 0) a, nullif(instr(head, 'gnu lesser general public license'), 0) b, nullif(instr(head, 'gnu affero general public license'), 0) c FROM h),
    t AS (SELECT *, CASE WHEN a = least(a, b, c) THEN substr(head, a) END title FROM g)
    SELECT repo, sha, path, CASE WHEN contains(head, 'apache license') AND contains(head, 'version 2.0') THEN 'Apache-2.0' WHEN contains(head, 'mozilla public license') AND contains(head, '2.0') THEN 'MPL-2.0'
      WHEN contains(title, 'gnu general public license') AND contains(title, 'version 3') THEN 'GPL-3.0' WHEN contains(title, 'gnu general public license') AND contains(title, 'version 2') THEN 'GPL-2.0'
      WHEN contains(flat, 'permission is hereby granted, free of charge, to any person obtaining a copy') THEN 'MIT' WHEN contains(flat, 'permission to use, copy, modify, and/or distribute this software for any purpose') THEN 'ISC'
      WHEN contains(flat, 'redistribution and use in source and binary forms') AND contains(flat, 'neither the name') THEN 'BSD-3-Clause' WHEN contains(flat, 'redistribution and use in source and binary forms') THEN 'BSD-2-Clause' END license FROM t"""

_TOKENS = r"""[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|"[^"]*"|''[^'']*''|[^\sA-Za-z0-9_]"""

_ADDRESS = rf"(?:sha256:[0-9A-Fa-f]{{12,64}}|(?:{L.HOST}/{L.SEGMENT}/{L.SEGMENT}/*@{L.REV}/+[^#@\s]*[^#@/\s]/*|{L.NAME}(?:@{L.NAME_REV})?)(?:#{L.SYMBOL})?)"
_LINK_BODY = rf"[ \t]*{L.MARKER}(?:-from|-see)?:[ \t]*{_ADDRESS}(?:[ \t]+[A-Za-z_][A-Za-z0-9_-]*=[^\"\s]*)*(?:[ \t]+~?\"[^\"]*\")?[ \t]*"
_LINK_SQL = rf"^[ \t]*(?:(?:#|//|--|;+){_LINK_BODY}|/\*{_LINK_BODY}\*/[ \t]*)$"

QUERIES = {
    f.__name__: f
    for f in (
        counts, status, current_revision, normalize_identity, spdx_license, parse_address, find_links, dups_identity, dups_shape, locations_of, history, resolve_targets, rank_by_relation, rank, who, who_counts,
        coverage, coverage_totals, directories, unresolved_matching, forward, link_owners, link_rows, merged_definitions, repo_pages, page_links, names_now, name_checks, innermost, symbol_files, latest_places,
        closure_reach, closure_sizes, closure_budget, closure_order, closure_free_names, closure_nodes, closure_clashes, closure_requirements, search_bm25, line_duplication, benchmark_summary, benchmark_statuses, answer_difference, answer_verdicts, benchmark_ratios, resolve_addresses, preferred_locations, page_objects, definition_pages, who_by_address, locations_in_order, hits_with_places, links_in_order, greatest_dups, top_level_symbols, unregistered,
        extracted_pages, extracted_definitions, extracted_references, forwarded_references, unmapped_modules, file_imports, skipped_notes,
    )
}

SQL = {
    "counts": """SELECT 'repos' table_name, count(DISTINCT locator) n FROM repos UNION ALL SELECT 'revisions', count(*) FROM (SELECT DISTINCT repo, sha FROM revisions) UNION ALL SELECT 'definitions', count(DISTINCT identity) FROM definitions
        UNION ALL SELECT 'locations', count(*) FROM (SELECT DISTINCT repo, sha, path, symbol FROM locations) UNION ALL SELECT 'links', count(DISTINCT link_seq) FROM links UNION ALL SELECT 'registry_names', count(*) FROM (SELECT DISTINCT name, registry FROM registry_names)""",
    "status": f"""WITH {_CRAWLS}, k AS (SELECT locator repo, min(added_at) added_at FROM repos GROUP BY 1), p AS (SELECT repo, count(*) revisions, arg_max(sha, crawl_seq) "current", arg_max(committed_at, crawl_seq) committed_at, arg_max(files, crawl_seq) files FROM crawls GROUP BY repo)
        SELECT repo, added_at, coalesce(revisions, 0) revisions, "current", committed_at, files FROM k LEFT JOIN p USING (repo)""",
    "current_revision": "SELECT repo, arg_max(sha, crawl_seq) sha FROM revisions GROUP BY repo",
    "normalize_identity": r"""WITH d AS (SELECT DISTINCT identity, source FROM definitions), l AS (SELECT *, list_transform(string_split_regex(source, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[ \t]+$', '')) x FROM d),
        m AS (SELECT *, list_transform(list_filter(x, lambda y: regexp_matches(y, '[^ \t]')), lambda y: regexp_extract(y, '^[ \t]*')) g FROM l), e AS (SELECT *, list_min(g) low, list_max(g) high FROM m),
        w AS (SELECT *, coalesce(list_max(list_filter(range(0, coalesce(least(length(low), length(high)), 0) + 1), lambda n: substr(low, 1, n) = substr(high, 1, n))), 0) w FROM e)
        SELECT identity, sha256(regexp_replace(array_to_string(list_transform(x, lambda y: regexp_replace(CASE WHEN y = '' THEN y ELSE substr(y, CAST(w AS INTEGER) + 1) END, '[\x09-\x0d\x1c-\x1f\x{85}\p{Z}]+$', '')), chr(10)), '\n+$', '') || chr(10)) computed FROM w""",
    "spdx_license": _LICENSE_SQL,
    "parse_address": "SELECT DISTINCT target_address, target_form form, target_name AS \"name\", target_locator \"locator\", target_path path, target_rev rev, target_symbol symbol, CASE WHEN target_form = 'identity' THEN lower(regexp_replace(target_address, '^sha256:', '')) END \"identity\" FROM links",
    "find_links": f"""WITH l AS (SELECT identity, unnest(string_split(source, chr(10))) line FROM (SELECT DISTINCT identity, source FROM definitions WHERE kind = 'script'))
        SELECT identity, CASE regexp_extract(line, '[a-z]+(-from|-see)?:', 1) WHEN '-from' THEN 'from' WHEN '-see' THEN 'see' ELSE 'is' END relation, count(*) links, count(*) FILTER (regexp_matches(line, '"[ \t]*([*]/)?[ \t]*$')) described FROM l WHERE regexp_matches(line, '{_LINK_SQL}') GROUP BY ALL""",
    "dups_identity": _dups_sql("identity"),
    "dups_shape": _dups_sql("shape"),
    "locations_of": f"""WITH {_CURRENT}, n AS (SELECT target, min(name) entry FROM registry_names GROUP BY target)
        SELECT identity, repo || '@' || substr(sha, 1, 12) || '/' || path || coalesce('#' || symbol, '') address, entry FROM cur LEFT JOIN n ON n.target = repo || '/' || path""",
    "history": f"""WITH {_CRAWLS}, s AS (SELECT repo, path, symbol, sha, max(identity) identity FROM locations GROUP BY ALL), g AS (SELECT DISTINCT s.repo, s.path, s.symbol, c.sha, c.committed_at, c.crawl_seq FROM s JOIN crawls c USING (repo))
        SELECT g.repo, g.path, g.symbol, g.sha, s.identity, s.identity IS NULL absent
        FROM g LEFT JOIN s ON s.repo = g.repo AND s.sha = g.sha AND s.path = g.path AND s.symbol IS NOT DISTINCT FROM g.symbol
        QUALIFY s.identity IS DISTINCT FROM lag(s.identity) OVER (PARTITION BY g.repo, g.path, g.symbol ORDER BY g.committed_at NULLS FIRST, g.crawl_seq)""",
    "resolve_targets": f"""WITH {_CRAWLS}, o AS (SELECT DISTINCT link_seq, target_form, target_name, target_locator, target_path, target_rev, target_symbol, regexp_replace(lower(target_id), '^sha256:', '') tid FROM links WHERE target_identity IS NULL),
        ids AS (SELECT DISTINCT identity FROM definitions), p AS (SELECT link_seq, min(identity) f FROM o JOIN ids ON substr(tid, 1, 12) = substr(identity, 1, 12) AND starts_with(identity, tid) GROUP BY link_seq HAVING count(*) = 1),
        n AS (SELECT name, arg_min(target, registry) target, arg_min(versions, registry) versions FROM registry_names GROUP BY name),
        nm AS (SELECT link_seq, string_split(target, '/') parts, target_symbol, CASE WHEN regexp_matches(target_rev, '^[0-9a-fA-F]{{12,40}}$') THEN target_rev ELSE versions[target_rev] END v FROM o JOIN n ON n.name = o.target_name WHERE tid IS NULL AND target_form = 'name'),
        a AS (SELECT link_seq, target_locator repo, target_path path, target_symbol symbol, CASE WHEN regexp_matches(target_rev, '^[0-9a-fA-F]{{12,40}}$') THEN lower(target_rev) END rev FROM o WHERE tid IS NULL AND target_form = 'locator' AND target_path IS NOT NULL
              UNION ALL SELECT link_seq, array_to_string(parts[1:3], '/'), array_to_string(parts[4:], '/'), target_symbol, CASE WHEN regexp_matches(v, '^[0-9a-fA-F]{{12,40}}$') THEN lower(v) END FROM nm WHERE len(parts) >= 4),
        l AS (SELECT DISTINCT identity, repo, sha, path, symbol FROM locations),
        x AS (SELECT link_seq, min(identity) f FROM a JOIN l ON l.repo = a.repo AND l.path = a.path AND l.symbol IS NOT DISTINCT FROM a.symbol AND starts_with(l.sha, a.rev) WHERE a.rev IS NOT NULL GROUP BY link_seq),
        w AS (SELECT repo, path, symbol, arg_max(identity, (crawl_seq, identity)) f FROM l JOIN crawls USING (repo, sha) GROUP BY ALL),
        y AS (SELECT link_seq, f FROM a JOIN w ON w.repo = a.repo AND w.path = a.path AND w.symbol IS NOT DISTINCT FROM a.symbol WHERE a.rev IS NULL)
        SELECT link_seq, f target_identity FROM p UNION ALL SELECT * FROM x UNION ALL SELECT * FROM y""",
    "rank_by_relation": f"SELECT identity, relation, origin, count(DISTINCT (source_identity, repo, file)) pages FROM (SELECT *, {_TI} identity FROM links) WHERE identity IS NOT NULL AND NOT (origin = 'derived' AND identity = source_identity) GROUP BY GROUPING SETS ((identity), (identity, relation, origin))",
    "rank": f"SELECT identity, count(DISTINCT (source_identity, repo, file)) pages FROM (SELECT *, {_TI} identity FROM links) WHERE identity IS NOT NULL AND NOT (origin = 'derived' AND identity = source_identity) GROUP BY identity ORDER BY pages DESC, identity LIMIT 20",
    "who": f"""WITH {_CRAWLS}, {_DEFS}, r AS (SELECT k.*, row_number() OVER (PARTITION BY source_identity, repo, file, relation, target_address ORDER BY committed_at DESC NULLS LAST, crawl_seq DESC, link_seq) rn FROM links k JOIN crawls USING (repo, sha))
        SELECT source_identity, repo, sha, file, d.kind, d.name, relation, origin, line, target_address, {_TI} target_identity FROM r JOIN defs d ON d.identity = r.source_identity WHERE rn = 1""",
    "who_counts": f"""WITH {_CRAWLS}, {_DEFS}, r AS (SELECT k.*, row_number() OVER (PARTITION BY source_identity, repo, file, relation, target_address ORDER BY committed_at DESC NULLS LAST, crawl_seq DESC, link_seq) rn FROM links k JOIN crawls USING (repo, sha))
        SELECT {_TI} target_identity, relation, origin, count(*) backlinks FROM r JOIN defs d ON d.identity = r.source_identity WHERE rn = 1 AND target_identity IS NOT NULL GROUP BY ALL""",
    "directories": "SELECT repo, sha, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END directory, count(DISTINCT path) paths FROM locations GROUP BY ALL",
    "unresolved_matching": """WITH m AS (SELECT leaf, count(*) links FROM (SELECT DISTINCT link_seq, lower(string_split(target_symbol, '.')[-1]) leaf FROM links WHERE target_identity IS NULL AND target_symbol IS NOT NULL) GROUP BY leaf)
        SELECT DISTINCT name, links FROM definitions JOIN m ON lower(name) = leaf""",
    "link_owners": """SELECT link_seq, arg_min(symbol, (span_last - span_first, span_first, symbol)) "owner" FROM (SELECT DISTINCT link_seq, repo, sha, file, line FROM links) k JOIN (SELECT DISTINCT repo, sha, path, symbol, span_first, span_last FROM locations WHERE symbol IS NOT NULL) l
        ON l.repo = k.repo AND l.sha = k.sha AND l.path = k.file AND k.line BETWEEN span_first AND span_last GROUP BY link_seq""",
    "link_rows": "SELECT source_identity, repo, sha, file, line, relation, target_address, min(link_seq) link_seq FROM links GROUP BY ALL",
    "merged_definitions": "SELECT identity, arg_min(kind, (CAST(kind = 'script' AS INTEGER), kind, name)) kind, arg_min(name, (CAST(kind = 'script' AS INTEGER), kind, name)) \"name\", max(lines) lines FROM definitions GROUP BY identity",
    "repo_pages": f"""WITH {_CURRENT}, {_DEFS} SELECT repo, path, symbol, d.kind, d.name, span_first, span_last, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY span_first NULLS FIRST, symbol IS NOT NULL, symbol NULLS FIRST) AS INTEGER) place FROM cur JOIN defs d USING (identity)""",
    "page_links": """WITH k AS (SELECT source_identity, repo, sha, file, line, relation, target_address FROM links WHERE source_identity IS NOT NULL GROUP BY ALL)
        SELECT source_identity, repo, sha, count(*) FILTER (relation <> 'ref') links, count(*) FILTER (relation = 'ref') refs, coalesce(string_agg(DISTINCT target_address, ' ' ORDER BY target_address) FILTER (relation <> 'ref'), '') targets FROM k GROUP BY ALL""",
    "names_now": "SELECT name, min(registry) registry, arg_min(target, registry) target, count(DISTINCT registry) registries FROM registry_names GROUP BY name",
    "name_checks": f"""WITH {_CURRENT}, e AS (SELECT DISTINCT name, registry, target, "owner", default_label, versions FROM registry_names), h AS (SELECT DISTINCT repo || '/' || path place FROM cur)
        SELECT name, registry, regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*(\\.[a-z0-9]+(-[a-z0-9]+)*)*') name_ok, "owner" IS NOT DISTINCT FROM nullif(split_part(target, '/', 2), '') owner_ok, target IN (SELECT place FROM h) target_ok, default_label IS NULL OR list_contains(map_keys(versions), default_label) label_ok,
        coalesce(list_bool_and([regexp_full_match(v, '[a-z0-9]+(-[a-z0-9]+)*') FOR v IN map_keys(versions)]), true) labels_ok,
        coalesce(list_bool_and([regexp_full_match(v, '[0-9a-fA-F]{{12,40}}') FOR v IN map_values(versions)]), true) pinned FROM e""",
    "innermost": f"""WITH {_CURRENT}, p AS (SELECT DISTINCT repo, path, symbol FROM cur)
        SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.repo = a.repo AND b.path = a.path AND b.symbol IS NOT NULL AND (a.symbol IS NULL OR starts_with(b.symbol, a.symbol || '.')))""",
    "symbol_files": "SELECT repo, sha, symbol, count(*) files, CASE WHEN count(*) = 1 THEN min(path) END path FROM (SELECT DISTINCT repo, sha, symbol, path FROM locations WHERE symbol IS NOT NULL) GROUP BY ALL",
    "latest_places": f"""WITH {_CURRENT}, w AS (SELECT DISTINCT repo, path, symbol, identity FROM locations), n AS (SELECT DISTINCT repo, identity, path, symbol FROM cur),
        f AS (SELECT w.repo, w.path, w.symbol, coalesce(bool_or(n.path = w.path AND n.symbol IS NOT DISTINCT FROM w.symbol), false) same, min((n.path, coalesce(n.symbol, ''))) FILTER (n.path IS NOT NULL) t FROM w LEFT JOIN n ON n.repo = w.repo AND n.identity = w.identity GROUP BY ALL),
        g AS (SELECT f.*, CASE WHEN same THEN 'same' WHEN t IS NOT NULL THEN 'moved' WHEN EXISTS (SELECT 1 FROM n WHERE n.repo = f.repo AND n.path = f.path AND n.symbol IS NOT DISTINCT FROM f.symbol) THEN 'changed' ELSE 'gone' END state FROM f)
        SELECT repo, path, symbol, state, CASE WHEN state = 'moved' THEN t[1] || CASE WHEN t[2] <> '' THEN '#' || t[2] ELSE '' END END moved_to FROM g""",
    "closure_reach": f"WITH RECURSIVE {_REACH} SELECT root, page FROM reach",
    "closure_sizes": f"WITH RECURSIVE {_REACH}, {_DEFS} SELECT root, count(*) pages, coalesce(sum(lines), 0) lines, count(*) FILTER (lines IS NULL) missing, count(*) <= 50 AND coalesce(sum(lines), 0) <= 2000 AS \"within\" FROM reach LEFT JOIN defs ON identity = page GROUP BY root",
    "closure_budget": f"WITH RECURSIVE {_REACH}, {_DEFS}, s AS (SELECT root, count(*) n, coalesce(sum(lines), 0) l, count(*) FILTER (lines IS NULL) m FROM reach LEFT JOIN defs ON identity = page GROUP BY root) SELECT root, CASE WHEN n <= 50 THEN n END pages, CASE WHEN n <= 50 THEN l END lines, CASE WHEN n <= 50 THEN m END missing, n <= 50 AND l <= 2000 \"within\" FROM s",
    "closure_free_names": f"""WITH RECURSIVE {_REACH}, d AS (SELECT identity, any_value(kind) kind, any_value(name) "name", any_value(unresolved) unresolved FROM definitions GROUP BY identity)
        SELECT root, x "name" FROM (SELECT DISTINCT root, unnest(unresolved) x FROM reach JOIN d ON identity = page) u WHERE NOT EXISTS (SELECT 1 FROM reach r JOIN d ON d.identity = r.page WHERE r.root = u.root AND d.kind <> 'script' AND d."name" = u.x)""",
    "closure_nodes": f"""WITH RECURSIVE {_REACH}, {_CURRENT}, d AS (SELECT identity, any_value(kind) kind, any_value(name) "name", any_value(signature) signature, any_value(docstring) docstring FROM definitions GROUP BY identity),
        a AS (SELECT identity, min((repo, path, coalesce(symbol, ''))) p FROM cur GROUP BY identity), b AS (SELECT d.*, CASE WHEN p IS NOT NULL THEN p[1] || '/' || p[2] ELSE '' END place, p[3] symbol FROM d LEFT JOIN a USING (identity)),
        n AS (SELECT target, arg_min(description, registry) said FROM registry_names WHERE description IS NOT NULL GROUP BY target)
        SELECT root, page, CASE WHEN kind <> 'script' THEN coalesce(nullif(split_part(symbol, '.', 1), ''), "name") END defines, coalesce(said, nullif(trim(docstring), ''), signature) description, place FROM reach JOIN b ON b.identity = page LEFT JOIN n ON n.target = b.place""",
    "closure_clashes": f"WITH RECURSIVE {_REACH}, {_DEFS} SELECT root, name, count(*) pages FROM reach JOIN defs ON identity = page WHERE kind <> 'script' GROUP BY root, name HAVING count(*) > 1",
    "closure_requirements": f"""WITH RECURSIVE {_REACH}, {_CURRENT}, {_DEFS}, f AS (SELECT DISTINCT root, w.identity page FROM reach JOIN cur c ON c.identity = reach.page JOIN cur w ON w.repo = c.repo AND w.sha = c.sha AND w.path = c.path AND w.symbol IS NULL),
        m AS (SELECT DISTINCT root, 's' k, unnest(imports.stdlib) m FROM f JOIN defs ON identity = page UNION SELECT DISTINCT root, 't', unnest(imports.third_party) FROM f JOIN defs ON identity = page)
        SELECT root, coalesce(string_agg(m, ',' ORDER BY m) FILTER (k = 's'), '') stdlib, coalesce(string_agg(m, ',' ORDER BY m) FILTER (k = 't'), '') third_party FROM m GROUP BY root""",
    "search_bm25": f"""WITH d AS (SELECT identity, any_value(name) "name", any_value(signature) signature, any_value(docstring) docstring FROM definitions GROUP BY identity), docs AS (SELECT DISTINCT l.identity, l.symbol, d.name, d.signature, d.docstring FROM locations l JOIN d USING (identity)),
        t AS (SELECT identity, symbol, list_filter(string_split_regex(lower(translate(coalesce(name, '') || ' ' || coalesce(symbol, '') || ' ' || coalesce(signature, '') || ' ' || coalesce(docstring, ''), 'áàâäãéèêëíìîïóòôöõúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') w FROM docs),
        p AS (SELECT identity, symbol, len(w) length, len(list_filter(w, lambda x: starts_with(x, '{SEARCH}'))) f FROM t), s AS (SELECT count(*) n, avg(length) mean, count(*) FILTER (f > 0) df FROM p)
        SELECT identity, symbol, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)), 6) score FROM p, s WHERE f > 0 ORDER BY score DESC, identity, symbol NULLS FIRST LIMIT 20""",
    "benchmark_summary": """SELECT coalesce(family, '*') family, coalesce(task, '*') task, arm, count(*) runs, count(*) FILTER (status = 'pass') passed, median(tokens) median_tokens FROM
        (SELECT CAST(user_id % 10 AS VARCHAR) family, CAST(user_id AS VARCHAR) task, event_type arm, CASE WHEN value > 50 THEN 'pass' ELSE 'fail' END status, value tokens FROM events) GROUP BY GROUPING SETS ((arm), (arm, family), (arm, family, task))""",
    "benchmark_statuses": "SELECT event_type arm, CASE WHEN value > 50 THEN 'pass' ELSE 'fail' END status, count(*) runs FROM events GROUP BY ALL",
    "answer_difference": f"""WITH {_CURRENT}, a AS (SELECT DISTINCT repo, path FROM cur), e AS (SELECT DISTINCT repo, path FROM locations), l AS (SELECT repo, count(*) missing FROM (SELECT * FROM e EXCEPT SELECT * FROM a) GROUP BY repo), m AS (SELECT repo, count(*) extra FROM (SELECT * FROM a EXCEPT SELECT * FROM e) GROUP BY repo)
        SELECT repo, coalesce(missing, 0) missing, coalesce(extra, 0) extra FROM l FULL JOIN m USING (repo)""",
    "line_duplication": f"""WITH f AS (SELECT DISTINCT identity file, source FROM definitions WHERE kind = 'script' AND language = 'c'), r AS (SELECT file, generate_subscripts(x, 1) row_, unnest(x) line FROM (SELECT file, string_split_regex(source, '\\r\\n|\\r|\\n') x FROM f)),
        t AS (SELECT file, regexp_extract_all(line, '{_TOKENS}') t FROM r WHERE NOT starts_with(line, '#include')), u AS (SELECT file, t, list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z_]')) ids FROM t WHERE len(list_filter(t, lambda x: regexp_matches(x, '[A-Za-z0-9_]'))) > 0),
        k AS (SELECT file, len(t) tokens, array_to_string(t, ' ') verbatim, array_to_string(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') THEN '$' || len(list_distinct(ids[1:list_position(ids, x)])) WHEN regexp_matches(x, '^[0-9]') THEN '<num>' WHEN regexp_matches(x, '^["''].*["'']$') AND length(x) > 1 THEN '<str>' ELSE x END), ' ') shape FROM u),
        sh AS (SELECT shape FROM k GROUP BY shape HAVING count(DISTINCT file) > 1), ve AS (SELECT verbatim FROM k GROUP BY verbatim HAVING count(DISTINCT file) > 1)
        SELECT least, count(*) lines, round(100 * count(*) FILTER (shape IN (SELECT shape FROM sh)) / count(*), 1) shape_percent, round(100 * count(*) FILTER (verbatim IN (SELECT verbatim FROM ve)) / count(*), 1) verbatim_percent FROM k JOIN (SELECT unnest([1, 3, 5, 8]) least) ON tokens >= least GROUP BY least""",
    "coverage": f"""WITH {_CRAWLS}, latest AS (SELECT repo, arg_max(sha, crawl_seq) sha FROM revisions GROUP BY repo), pg AS (SELECT repo, sha, count(*) pages, count(DISTINCT path) paths FROM (SELECT DISTINCT identity, repo, sha, path, symbol, span_first, span_last FROM locations) GROUP BY ALL), ln AS (SELECT repo, sha, count(DISTINCT link_seq) links FROM links GROUP BY ALL)
        SELECT repo, sha, sha = latest.sha is_current, files, coalesce(pages, 0) pages, coalesce(paths, 0) paths, coalesce(links, 0) links, len(skipped) skipped, len(list_filter(skipped, lambda x: NOT contains(x, 'the line was ignored') AND regexp_matches(split_part(x, ': ', 1), '\\.(py|c|h)$'))) unread, len(list_filter(skipped, lambda x: contains(x, 'the line was ignored'))) ignored_links, CAST(cardinality(unmapped) AS INTEGER) unmapped
        FROM crawls JOIN latest USING (repo) LEFT JOIN pg USING (repo, sha) LEFT JOIN ln USING (repo, sha)""".replace("SELECT repo, sha, sha = latest.sha is_current", "SELECT crawls.repo, crawls.sha, crawls.sha = latest.sha is_current").replace("LEFT JOIN pg USING (repo, sha) LEFT JOIN ln USING (repo, sha)", "LEFT JOIN pg ON pg.repo = crawls.repo AND pg.sha = crawls.sha LEFT JOIN ln ON ln.repo = crawls.repo AND ln.sha = crawls.sha"),
    "forward": f"""WITH {_CURRENT}, {_CRAWLS}, gone AS (SELECT DISTINCT repo, identity FROM locations EXCEPT SELECT DISTINCT repo, identity FROM cur),
        dated AS (SELECT cur.*, c.committed_at, c.crawl_seq FROM cur JOIN crawls c ON c.repo = cur.repo AND c.sha = cur.sha),
        same AS (SELECT g.repo, g.identity, arg_max(n.repo || '/' || n.path, (coalesce(n.committed_at, -1), n.crawl_seq, n.repo, n.path, coalesce(n.symbol, ''))) "to", 'same-identity' "rule" FROM gone g JOIN dated n ON n.identity = g.identity AND n.repo <> g.repo GROUP BY ALL),
        b AS (SELECT {_TI} identity, relation, k.repo from_repo, file, link_seq, c.committed_at, c.crawl_seq FROM links k JOIN crawls c ON c.repo = k.repo AND c.sha = k.sha WHERE relation IN ('is', 'from') AND target_identity IS NOT NULL),
        back AS (SELECT g.repo, g.identity, arg_max(from_repo || '/' || file, (CASE WHEN relation = 'is' THEN 1 ELSE 0 END, coalesce(committed_at, -1), crawl_seq, link_seq)) "to", 'backlink' "rule" FROM gone g JOIN b ON b.identity = g.identity AND b.from_repo <> g.repo
                 WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.repo = g.repo AND s.identity = g.identity) GROUP BY g.repo, g.identity)
        SELECT * FROM same UNION ALL SELECT * FROM back""",
}
_ORDERED = "SELECT DISTINCT identity, l.repo, l.sha, path, symbol, committed_at, crawl_seq FROM locations l JOIN crawls c ON c.repo = l.repo AND c.sha = l.sha"
_LINK_ROWS = "rows_ AS (SELECT source_identity, repo, sha, file, line, relation, target_address, min(link_seq) link_seq FROM links GROUP BY ALL)"
SQL |= {
    "locations_in_order": f"""WITH {_CRAWLS}, o AS ({_ORDERED}) SELECT identity, repo, sha, path, symbol, CAST(row_number() OVER (PARTITION BY identity ORDER BY committed_at NULLS FIRST, crawl_seq, repo, path, symbol NULLS FIRST) AS INTEGER) "at" FROM o""",
    "hits_with_places": f"""WITH {_CURRENT}, t AS ({SQL["rank"]}), d AS (SELECT identity, any_value(kind) kind, any_value("name") "name" FROM definitions GROUP BY identity),
        a AS (SELECT DISTINCT l.identity, l.repo || '@' || substr(l.sha, 1, 12) || '/' || path || coalesce('#' || symbol, '') a, latest.sha IS NOT NULL now_ FROM locations l LEFT JOIN latest ON latest.repo = l.repo AND latest.sha = l.sha)
        SELECT identity, kind, "name", coalesce(string_agg(a, ' ' ORDER BY a) FILTER (now_), string_agg(a, ' ' ORDER BY a), '') places, coalesce(bool_or(now_), false) "current" FROM t JOIN d USING (identity) LEFT JOIN a USING (identity) GROUP BY ALL""",
    "extracted_definitions": """WITH f AS (SELECT DISTINCT repo, sha, path FROM locations JOIN definitions USING (identity) WHERE symbol IS NULL AND kind = 'script' AND path LIKE '%.py'), d AS (SELECT identity, any_value(kind) kind FROM definitions GROUP BY identity)
        SELECT DISTINCT repo, sha, path, symbol, identity, span_first, span_last FROM locations JOIN f USING (repo, sha, path) LEFT JOIN d USING (identity) WHERE symbol IS NOT NULL AND coalesce(kind, 'function') <> 'constant'""",
    "links_in_order": f"""WITH {_LINK_ROWS} SELECT source_identity, repo, sha, link_seq, CAST(row_number() OVER (PARTITION BY source_identity, repo, sha ORDER BY line, link_seq) AS INTEGER) "at" FROM rows_""",
    "greatest_dups": f"""SELECT * FROM ({SQL["dups_identity"]}) ORDER BY places DESC, lines DESC NULLS LAST, "names", "key" LIMIT 50""",
    "top_level_symbols": f"""WITH {_CURRENT}, t AS (SELECT DISTINCT repo, path, symbol, span_first FROM cur WHERE symbol IS NOT NULL AND NOT contains(symbol, '.')) SELECT repo, path, string_agg(symbol, ',' ORDER BY span_first, symbol) symbols FROM t GROUP BY ALL""",
    "unregistered": "SELECT DISTINCT target_locator \"locator\" FROM links WHERE target_locator IS NOT NULL AND target_locator NOT IN (SELECT locator FROM repos)",
    "preferred_locations": f"""WITH {_CRAWLS}, o AS ({_ORDERED}), k AS (SELECT DISTINCT link_seq, {_TI} ti, target_locator r, target_path p, target_symbol s, lower(target_rev) v FROM links WHERE target_identity IS NOT NULL AND target_form = 'locator'),
        c AS (SELECT *, o.repo = r AND path = p AND symbol IS NOT DISTINCT FROM s same_, regexp_matches(v, '^[0-9a-f]{{12,40}}$') AND starts_with(o.sha, v) rev FROM k JOIN o ON o.identity = ti)
        SELECT link_seq, repo, sha, path, symbol FROM c QUALIFY row_number() OVER (PARTITION BY link_seq ORDER BY CASE WHEN same_ AND rev THEN 0 WHEN same_ THEN 1 WHEN repo = r AND rev THEN 2 WHEN repo = r THEN 3 ELSE 4 END, coalesce(committed_at, -1) DESC, crawl_seq DESC, repo DESC, path DESC, coalesce(symbol, '') DESC) = 1""",
    "page_objects": f"""WITH {_CURRENT}, n AS (SELECT target, min(name) entry FROM registry_names GROUP BY target), d AS (SELECT identity, any_value(kind) kind, any_value(name) "name", any_value(signature) signature, any_value(docstring) docstring, any_value(lines) lines FROM definitions GROUP BY identity),
        {_LINK_ROWS}, p AS (SELECT c.*, entry, d.* EXCLUDE (identity) FROM (SELECT DISTINCT identity, repo, sha, path, symbol, span_first, span_last FROM cur) c JOIN d ON d.identity = c.identity LEFT JOIN n ON n.target = c.repo || '/' || c.path)
        SELECT p.repo || '@' || substr(p.sha, 1, 12) || '/' || path || coalesce('#' || symbol, '') address, entry, identity, kind, p."name", signature, docstring, lines, span_first "first", span_last "last",
          coalesce(string_agg((line - span_first + 1) || ' ' || relation || ' ' || target_address, ';' ORDER BY line, link_seq) FILTER (relation <> 'ref'), '') links, coalesce(string_agg((line - span_first + 1) || ' ' || relation || ' ' || target_address, ';' ORDER BY line, link_seq) FILTER (relation = 'ref'), '') refs
        FROM p LEFT JOIN rows_ k ON k.source_identity = p.identity AND k.repo = p.repo AND k.sha = p.sha AND k.file = p.path GROUP BY p.repo, p.sha, path, symbol, entry, identity, kind, p."name", signature, docstring, lines, span_first, span_last""",
    "definition_pages": f"""WITH p AS (SELECT DISTINCT substr({_TI}, 1, 8) prefix FROM links WHERE target_identity IS NOT NULL), d AS (SELECT identity, min((CAST(kind = 'script' AS INTEGER), kind, name)) m FROM definitions GROUP BY identity),
        h AS (SELECT prefix, count(identity) matches, coalesce(array_to_string(list_slice(list_sort(list(identity) FILTER (identity IS NOT NULL)), 1, 10), ' '), '') identities, min(identity) one, arg_min(m, identity) m FROM p LEFT JOIN d ON starts_with(identity, prefix) GROUP BY prefix)
        SELECT prefix, matches, identities, CASE WHEN matches = 1 THEN m[2] END kind, CASE WHEN matches = 1 THEN m[3] END "name", CASE WHEN matches = 1 THEN (SELECT count(*) FROM (SELECT DISTINCT repo, path, symbol FROM locations WHERE identity = one)) END places,
          CASE WHEN matches = 1 THEN (SELECT count(*) FROM (SELECT DISTINCT source_identity, repo, file FROM links WHERE {_TI} = one)) END backlinks FROM h""",
    "benchmark_ratios": f"""WITH s AS ({SQL["benchmark_summary"]}) SELECT a.family, a.task, a.median_tokens median, b.median_tokens base, CASE WHEN b.median_tokens > 0 THEN a.median_tokens / b.median_tokens END ratio FROM s a JOIN s b USING (family, task) WHERE a.arm = 'click' AND b.arm = 'view'""",
    "answer_verdicts": f"""WITH {_CURRENT}, a AS (SELECT DISTINCT repo, symbol FROM cur WHERE symbol IS NOT NULL), e AS (SELECT DISTINCT repo, symbol FROM locations WHERE symbol IS NOT NULL AND NOT contains(symbol, '.')),
        f AS (SELECT DISTINCT a.repo, coalesce((SELECT arg_max(e.symbol, length(e.symbol)) FROM e WHERE e.repo = a.repo AND (e.symbol = a.symbol OR starts_with(a.symbol, e.symbol || '.'))), a.symbol) symbol FROM a), r AS (SELECT repo FROM a UNION SELECT repo FROM e),
        off_ AS (SELECT DISTINCT repo FROM ((SELECT * FROM a EXCEPT SELECT * FROM e) UNION ALL (SELECT * FROM e EXCEPT SELECT * FROM a))), off2 AS (SELECT DISTINCT repo FROM ((SELECT * FROM f EXCEPT SELECT * FROM e) UNION ALL (SELECT * FROM e EXCEPT SELECT * FROM f)))
        SELECT repo, repo NOT IN (SELECT repo FROM off_) "strict", repo NOT IN (SELECT repo FROM off2) folded FROM r""",
}
_BY_ADDRESS = SQL["resolve_targets"].replace(
    "SELECT DISTINCT link_seq, target_form, target_name, target_locator, target_path, target_rev, target_symbol, regexp_replace(lower(target_id), '^sha256:', '') tid FROM links WHERE target_identity IS NULL",
    "SELECT DISTINCT target_address link_seq, target_form, target_name, target_locator, target_path, target_rev, target_symbol, CASE WHEN target_form = 'identity' THEN regexp_replace(lower(target_address), '^sha256:', '') END tid FROM links",
)
SQL["resolve_addresses"] = f"""WITH found AS ({_BY_ADDRESS}), d AS (SELECT identity, any_value(kind) kind, any_value("name") "name" FROM definitions GROUP BY identity), a AS (SELECT DISTINCT target_address, target_form FROM links WHERE target_address IS NOT NULL)
    SELECT target_address address, CASE WHEN target_form IS NULL THEN 'malformed' WHEN target_identity IS NULL THEN 'unknown' WHEN d.identity IS NOT NULL THEN 'found' ELSE 'no row' END status, target_identity "identity", d.kind, d."name"
    FROM a LEFT JOIN found ON found.link_seq = a.target_address LEFT JOIN d ON d.identity = found.target_identity"""
SQL["who_by_address"] = f"""WITH who AS ({SQL["who"]}), res AS ({SQL["resolve_addresses"]}), {_CURRENT},
    ad AS (SELECT DISTINCT target_address, target_form f, target_name n, target_locator l, target_path p, target_symbol s FROM links WHERE target_form IS NOT NULL), ask AS (SELECT DISTINCT target_address address FROM links WHERE origin = 'asserted'),
    a AS (SELECT ask.address, f, n, l, p, s, res.identity FROM ask JOIN ad ON ad.target_address = ask.address JOIN res ON res.address = ask.address), b AS (SELECT who.*, f, n, l, p, s FROM who LEFT JOIN ad ON ad.target_address = who.target_address),
    e AS (SELECT a.address, b.source_identity, b.repo, b.file, b.line, b.relation, b.origin, b.target_address FROM a JOIN b ON b.target_identity = a.identity
          UNION SELECT a.address, b.source_identity, b.repo, b.file, b.line, b.relation, b.origin, b.target_address FROM a JOIN b ON a.f = 'locator' AND b.l = a.l AND b.p = a.p AND b.s IS NOT DISTINCT FROM a.s
          UNION SELECT a.address, b.source_identity, b.repo, b.file, b.line, b.relation, b.origin, b.target_address FROM a JOIN b ON a.f = 'name' AND b.n = a.n AND b.s IS NOT DISTINCT FROM a.s),
    h AS (SELECT identity, arg_min(repo || '/' || path || coalesce('#' || symbol, ''), (CAST(symbol IS NULL AS INTEGER), repo, path, coalesce(symbol, ''))) place FROM cur GROUP BY identity)
    SELECT address, source_identity, place, relation, origin, target_address, CAST(row_number() OVER (PARTITION BY address ORDER BY list_position(['is', 'from', 'see', 'ref'], relation), origin <> 'asserted', repo, file, line, target_address, source_identity) AS INTEGER) "at"
    FROM e LEFT JOIN h ON h.identity = e.source_identity"""
SQL["coverage_totals"] = f"""SELECT *, CASE WHEN unmapped > 0 OR unread > 0 OR ignored_links > 0 THEN false WHEN unread IS NULL THEN NULL ELSE true END complete FROM (SELECT count(DISTINCT repo) repos, count(*) revisions, sum(files) files, CASE WHEN count(*) = count(skipped) THEN coalesce(sum(skipped), 0) END skipped, CASE WHEN count(*) = count(unread) THEN coalesce(sum(unread), 0) END unread,
    CASE WHEN count(*) = count(ignored_links) THEN coalesce(sum(ignored_links), 0) END ignored_links, sum(unmapped) unmapped, (SELECT count(DISTINCT link_seq) FROM links WHERE target_identity IS NULL) unresolved_targets FROM ({SQL["coverage"]}))"""
