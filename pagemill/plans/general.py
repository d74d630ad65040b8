"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.hierarchy import descendant_pairs, hierarchies
from pagemill.operators.references import orphan_counts, orphan_references, orphan_status, reference_status, statuses_by_month
from pagemill.tables import identity_of, table


def _tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    rows = table(spark, d, "links", "source_identity", "relation", "target_identity").where("relation = 'from' and target_identity is not null")
    return hierarchies(rows.select(identity_of("source_identity").alias("c"), identity_of("target_identity").alias("p")), "c", "p", paths=paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(F.col("node").alias("identity"), F.col("root").alias("root_identity"), F.col("depth").cast("int").alias("depth"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select(
        F.col("node").alias("identity"), F.col("root").alias("root_identity"), "depth", F.concat_ws("/", "path").alias("path"), "descendants"
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendant_pairs(_tree(spark, d))


def p4_rings(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d, paths=False).where("ring is not null").groupBy("ring").agg(F.count("*").alias("members"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "links", "link_seq", "target_address", "repo", "sha", "target_form", "target_name", "target_locator", "target_path", "target_rev", "target_symbol", "target_id", "target_identity"),
        table(spark, d, "revisions", "repo", "sha", "crawl_seq", "unmapped"),
        table(spark, d, "definitions", "identity"),
        table(spark, d, "locations", "repo", "sha", "path", "symbol"),
        table(spark, d, "registry_names", "name", "versions"),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_key", "target").distinct()


def p6_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(
        orphan_status(
            table(spark, d, "links", "link_seq", "target_address", "repo", "sha", "target_form", "target_name", "target_locator", "target_path", "target_rev", "target_symbol", "target_id", "target_identity"),
            table(spark, d, "revisions", "repo", "sha", "crawled_at", "crawl_seq", "unmapped"),
            table(spark, d, "definitions", "identity"),
            table(spark, d, "locations", "identity", "repo", "sha", "path", "symbol"),
            table(spark, d, "registry_names", "name", "versions"),
        )
    )


def p6_status(spark: SparkSession, d: str) -> DataFrame:
    return reference_status(
        table(spark, d, "links", "link_seq", "target_address", "target_identity", "repo", "sha"),
        table(spark, d, "revisions", "repo", "sha", "crawled_at", "crawl_seq"),
        table(spark, d, "definitions", "identity"),
        table(spark, d, "locations", "identity", "repo", "sha"),
    ).groupBy("status").agg(F.count("*").alias("links"))


def p6_status_by_month(spark: SparkSession, d: str) -> DataFrame:
    return statuses_by_month(
        table(spark, d, "links", "link_seq", "target_address", "repo", "sha", "target_form", "target_name", "target_locator", "target_path", "target_rev", "target_symbol", "target_id", "target_identity"),
        table(spark, d, "revisions", "repo", "sha", "crawled_at", "crawl_seq", "unmapped"),
        table(spark, d, "definitions", "identity"),
        table(spark, d, "locations", "identity", "repo", "sha", "path", "symbol"),
        table(spark, d, "registry_names", "name", "versions"),
    )


_EDGES = """
e AS (SELECT lower(source_identity) c, min(regexp_replace(lower(target_identity), '^sha256:', '')) p
      FROM links WHERE relation = 'from' AND target_identity IS NOT NULL AND source_identity IS NOT NULL GROUP BY 1),
n AS (SELECT c AS id FROM e UNION SELECT p FROM e),
w AS (SELECT id, id AS root, 0 AS depth, id AS path FROM n WHERE id NOT IN (SELECT c FROM e)
      UNION ALL SELECT e.c, w.root, w.depth + 1, w.path || '/' || e.c FROM w JOIN e ON e.p = w.id)"""

_ORPHANS = """
l AS (SELECT DISTINCT link_seq, target_address, repo, sha, target_form, target_name, target_locator, target_path, target_rev, target_symbol,
        regexp_replace(lower(target_id), '^sha256:', '') tid, regexp_replace(lower(target_identity), '^sha256:', '') ti FROM links WHERE target_form IS NOT NULL),
latest AS (SELECT repo, arg_max(sha, crawl_seq) sha FROM revisions GROUP BY repo),
places AS (SELECT DISTINCT repo, path, coalesce(symbol, chr(30)) symbol, sha FROM locations),
k AS (SELECT l.*, CASE WHEN ti IS NOT NULL THEN 'identity' WHEN tid IS NOT NULL THEN 'prefix' WHEN target_form = 'locator' THEN 'place' WHEN target_form = 'name' AND target_rev IS NULL THEN 'name' WHEN target_form = 'name' THEN 'version' END kind,
        CASE WHEN regexp_matches(target_rev, '^[0-9a-fA-F]{12,40}$') THEN lower(target_rev) ELSE latest.sha END rev FROM l LEFT JOIN latest ON latest.repo = l.target_locator),
o AS (SELECT 'links' ref_table, CAST(link_seq AS VARCHAR) ref_key, target_address target, kind, repo, sha FROM k WHERE
        (kind = 'identity' AND NOT EXISTS (SELECT 1 FROM definitions d WHERE d.identity = k.ti))
     OR (kind = 'prefix' AND NOT EXISTS (SELECT 1 FROM definitions d WHERE substr(d.identity, 1, 12) = substr(k.tid, 1, 12) AND starts_with(d.identity, k.tid)))
     OR (kind = 'place' AND NOT EXISTS (SELECT 1 FROM places p WHERE p.repo = k.target_locator AND p.path = k.target_path AND p.symbol = coalesce(k.target_symbol, chr(30)) AND starts_with(p.sha, k.rev)))
     OR (kind = 'name' AND NOT EXISTS (SELECT 1 FROM registry_names r WHERE r.name = k.target_name))
     OR (kind = 'version' AND NOT EXISTS (SELECT 1 FROM registry_names r WHERE r.name = k.target_name AND list_contains(map_keys(r.versions), k.target_rev)))
     UNION
     SELECT 'revisions', repo || '@' || sha, m, 'module', repo, sha FROM (SELECT DISTINCT repo, sha, unnest(map_keys(unmapped)) m FROM revisions) u
     WHERE NOT EXISTS (SELECT 1 FROM locations x WHERE x.repo = u.repo AND x.sha = u.sha AND (ends_with('/' || x.path, '/' || replace(m, '.', '/') || '.py') OR ends_with('/' || x.path, '/' || replace(m, '.', '/') || '/__init__.py'))))"""

QUERIES = {f.__name__: f for f in (p4_found, p4_hierarchy, p4_descendants, p4_rings, p6_found, p6_by_month, p6_status, p6_status_by_month)}

SQL = {
    "p4_found": f"WITH RECURSIVE {_EDGES} SELECT id identity, root root_identity, CAST(depth AS INTEGER) depth FROM w UNION ALL SELECT id, '', -1 FROM n WHERE id NOT IN (SELECT id FROM w)",
    "p4_hierarchy": f"""WITH RECURSIVE {_EDGES}, s AS (SELECT id, count(*) - 1 descendants FROM (SELECT unnest(string_split(path, '/')) id FROM w) GROUP BY id)
        SELECT w.id identity, root root_identity, CAST(depth AS INTEGER) depth, path, s.descendants FROM w JOIN s ON s.id = w.id
        UNION ALL SELECT id, '', -1, '', NULL FROM n WHERE id NOT IN (SELECT id FROM w)""",
    "p4_descendants": f"""WITH RECURSIVE {_EDGES}, x AS (SELECT id, depth, unnest(string_split(path, '/')) a, generate_subscripts(string_split(path, '/'), 1) - 1 k FROM w)
        SELECT a ancestor, id descendant, CAST(depth - k AS INTEGER) distance FROM x WHERE a <> id""",
    "p4_rings": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT c, p FROM e WHERE c NOT IN (SELECT id FROM w)),
        r AS (SELECT c start, p here, 1 steps FROM b UNION ALL SELECT r.start, b.p, r.steps + 1 FROM r JOIN b ON b.c = r.here WHERE r.here <> r.start AND r.steps < 10000),
        g AS (SELECT start FROM r WHERE here = start), m AS (SELECT start, min(here) ring FROM r WHERE start IN (SELECT start FROM g) GROUP BY start)
        SELECT ring, count(*) members FROM m GROUP BY ring""",
    "p6_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_table, ref_key, target FROM o",
    "p6_by_month": f"""WITH {_ORPHANS}, w AS (SELECT repo, sha, max(crawled_at) seen FROM revisions GROUP BY ALL), lw AS (SELECT DISTINCT l.identity, l.repo, l.path, coalesce(l.symbol, chr(30)) symbol, w.seen FROM locations l JOIN w ON w.repo = l.repo AND w.sha = l.sha),
        ki AS (SELECT identity, min(seen) f FROM lw GROUP BY identity), kp AS (SELECT repo, path, symbol, min(seen) f FROM lw GROUP BY ALL),
        km AS (SELECT u.repo, u.m, min(lw.seen) f FROM (SELECT DISTINCT repo, unnest(map_keys(unmapped)) m FROM revisions) u JOIN lw ON lw.repo = u.repo AND (ends_with('/' || lw.path, '/' || replace(m, '.', '/') || '.py') OR ends_with('/' || lw.path, '/' || replace(m, '.', '/') || '/__init__.py')) GROUP BY ALL),
        t AS (SELECT DISTINCT CAST(link_seq AS VARCHAR) ref_key, target_address target, ti, target_locator, target_path, coalesce(target_symbol, chr(30)) target_symbol FROM l),
        g AS (SELECT DISTINCT o.*, coalesce(ki.f, kp.f, km.f) f FROM o LEFT JOIN t ON o.ref_table = 'links' AND t.ref_key = o.ref_key AND t.target = o.target LEFT JOIN ki ON o.kind = 'identity' AND ki.identity = t.ti
          LEFT JOIN kp ON o.kind = 'place' AND kp.repo = t.target_locator AND kp.path = t.target_path AND kp.symbol = t.target_symbol LEFT JOIN km ON o.kind = 'module' AND km.repo = o.repo AND km.m = o.target)
        SELECT ref_table, kind, CASE WHEN f IS NULL THEN 'missing' WHEN f > seen THEN 'late' ELSE 'deleted' END status, coalesce(substr(seen, 1, 7), '') AS "month", count(*) orphans FROM g LEFT JOIN w USING (repo, sha) GROUP BY ALL""",
    "p6_status_by_month": f"""WITH {_ORPHANS}, w AS (SELECT repo, sha, max(crawled_at) seen FROM revisions GROUP BY ALL), lw AS (SELECT DISTINCT l.identity, l.repo, l.sha, l.path, coalesce(l.symbol, chr(30)) symbol, w.seen, latest.sha = l.sha now_ FROM locations l JOIN w ON w.repo = l.repo AND w.sha = l.sha JOIN latest ON latest.repo = l.repo),
        ki AS (SELECT d.identity, min(seen) f, max(CAST(now_ AS INTEGER)) c FROM (SELECT DISTINCT identity FROM definitions) d LEFT JOIN lw ON lw.identity = d.identity GROUP BY d.identity), kp AS (SELECT repo, path, symbol, min(seen) f, max(CAST(now_ AS INTEGER)) c FROM lw GROUP BY ALL),
        m AS (SELECT DISTINCT repo, sha, unnest(map_keys(unmapped)) m FROM revisions), mf AS (SELECT DISTINCT repo, m FROM m),
        ka AS (SELECT mf.repo, mf.m, lw.sha, min(lw.seen) f FROM mf JOIN lw ON lw.repo = mf.repo AND (ends_with('/' || lw.path, '/' || replace(m, '.', '/') || '.py') OR ends_with('/' || lw.path, '/' || replace(m, '.', '/') || '/__init__.py')) GROUP BY ALL), km AS (SELECT repo, m, min(f) f FROM ka GROUP BY ALL),
        s AS (
          SELECT 'links' t, CAST(link_seq AS VARCHAR) k, target_address g, k.repo, k.sha, ki.identity IS NOT NULL known, ki.f, ki.c, NULL e FROM k LEFT JOIN ki ON ki.identity = k.ti WHERE kind = 'identity'
          UNION ALL SELECT 'links', CAST(link_seq AS VARCHAR), target_address, k.repo, k.sha, count(ki.identity) > 0, min(ki.f), max(ki.c), NULL FROM k LEFT JOIN ki ON substr(ki.identity, 1, 12) = substr(k.tid, 1, 12) AND starts_with(ki.identity, k.tid) WHERE kind = 'prefix' GROUP BY ALL
          UNION ALL SELECT 'links', CAST(link_seq AS VARCHAR), target_address, k.repo, k.sha, count(lw.sha) > 0, min(lw.seen), max(kp.c), min(CASE WHEN NOT coalesce(regexp_matches(target_rev, '^[0-9a-fA-F]{{12,40}}$'), false) THEN kp.f END)
            FROM k LEFT JOIN kp ON kp.repo = target_locator AND kp.path = target_path AND kp.symbol = coalesce(target_symbol, chr(30)) LEFT JOIN lw ON lw.repo = kp.repo AND lw.path = kp.path AND lw.symbol = kp.symbol AND starts_with(lw.sha, k.rev) WHERE kind = 'place' GROUP BY ALL
          UNION ALL SELECT 'links', CAST(link_seq AS VARCHAR), target_address, repo, sha, EXISTS (SELECT 1 FROM registry_names r WHERE r.name = k.target_name AND (kind = 'name' OR list_contains(map_keys(r.versions), k.target_rev))), NULL, NULL, NULL FROM k WHERE kind IN ('name', 'version')
          UNION ALL SELECT 'revisions', m.repo || '@' || m.sha, m.m, m.repo, m.sha, ka.sha IS NOT NULL, NULL, NULL, km.f FROM m LEFT JOIN ka ON ka.repo = m.repo AND ka.sha = m.sha AND ka.m = m.m LEFT JOIN km ON km.repo = m.repo AND km.m = m.m),
        z AS (SELECT DISTINCT t, k, g, s.repo, s.sha, coalesce(substr(seen, 1, 7), '') "month", CASE WHEN known THEN CASE WHEN f > seen THEN 'late' WHEN c = 0 THEN 'deleted' ELSE 'live' END WHEN e > seen THEN 'late' WHEN e IS NOT NULL THEN 'deleted' ELSE 'missing' END status FROM s LEFT JOIN w ON w.repo = s.repo AND w.sha = s.sha)
        SELECT t ref_table, status, "month", count(*) "references" FROM z GROUP BY ALL""",
    "p6_status": """WITH crawl AS (SELECT repo, sha, max(crawled_at) seen FROM revisions GROUP BY ALL), newest AS (SELECT repo, arg_max(sha, crawl_seq) newest FROM revisions GROUP BY repo),
        held AS (SELECT DISTINCT identity, repo, sha FROM locations),
        spans AS (SELECT identity, min(crawl.seen) first, max(CASE WHEN sha = newest THEN 1 ELSE 0 END) current FROM held JOIN crawl USING (repo, sha) JOIN newest USING (repo) GROUP BY identity),
        known AS (SELECT DISTINCT d.identity, first, current FROM definitions d LEFT JOIN spans USING (identity)),
        r AS (SELECT link_seq, target_address, regexp_replace(lower(target_identity), '^sha256:', '') identity, crawl.seen crawled FROM links LEFT JOIN crawl USING (repo, sha) WHERE target_identity IS NOT NULL),
        g AS (SELECT DISTINCT link_seq, target_address, CASE WHEN known.identity IS NULL THEN 'missing' WHEN first > crawled THEN 'late' WHEN current = 0 THEN 'deleted' ELSE 'live' END status FROM r LEFT JOIN known USING (identity))
        SELECT status, count(*) links FROM g GROUP BY status""",
}
