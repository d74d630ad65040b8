"""Queries of the operators for training text and code, and SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.abuse import REVIEW, abuse_rates, abuse_scores, calibration
from pagemill.llm.functions_docs import documented_functions, extracted_functions
from pagemill.llm.generated import machine_files
from pagemill.llm.leakage import leaked_items
from pagemill.llm.licenses import license_verdicts
from pagemill.llm.mixing import counted, mix_rates, mix_report, mixed
from pagemill.llm.spans import shared_characters, sharing_pairs
from pagemill.llm.syntax import invalid_files, invalid_rates
from pagemill.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_pairs(table(spark, d, "definitions", "identity", "kind", "source"), table(spark, d, "locations", "identity", "repo", "path", "symbol"))


def p1_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_characters(table(spark, d, "definitions", "identity", "kind", "source"))


def p3_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Documented functions cut out of whole files, per language: how many, how many with documentation of content, and how many stand as pages of their own."""
    files = table(spark, d, "definitions", "identity", "kind", "language", "source").where("kind = 'script'").dropDuplicates(["identity"])
    return extracted_functions(files).join(files.select("identity", "language"), "identity").groupBy("language").agg(
        F.count("*").alias("functions"), F.count_if(~F.col("trivial")).alias("documented"), F.countDistinct("identity").alias("files")
    )


def _machine(spark: SparkSession, d: str) -> DataFrame:
    return machine_files(
        table(spark, d, "definitions", "identity", "language", "kind", "source"), table(spark, d, "locations", "identity", "repo", "sha", "path", "symbol")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _machine(spark, d).select("repo", "sha", "path").distinct()


def p2_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _machine(spark, d).groupBy("repo", "verdict").agg(F.count("*").alias("files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "definitions", "identity", "language", "kind", "name", "signature", "docstring", "source")
    return documented_functions(pages).where("not trivial").select("identity").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "definitions", "identity", "language", "kind", "name", "signature", "docstring", "source")
    return documented_functions(pages).where("not trivial").drop("trivial").dropDuplicates(["identity"])


def _invalid(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files(
        table(spark, d, "definitions", "identity", "language", "kind", "source"),
        table(spark, d, "locations", "identity", "repo", "sha", "path", "symbol"),
        table(spark, d, "revisions", "repo", "sha", "skipped"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _invalid(spark, d).select("repo", "sha", "path").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_rates(_invalid(spark, d), table(spark, d, "revisions", "repo", "sha", "files"))


def _licenses(spark: SparkSession, d: str) -> DataFrame:
    return license_verdicts(
        table(spark, d, "definitions", "identity", "language", "kind", "source"),
        table(spark, d, "locations", "identity", "repo", "sha", "path", "symbol"),
        table(spark, d, "revisions", "repo", "sha", "license"),
        table(spark, d, "root_files", "repo", "sha", "path", "text"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _licenses(spark, d).where("flag is not null").select("repo", "sha", "path", "flag")


def p7_licenses(spark: SparkSession, d: str) -> DataFrame:
    return _licenses(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, with the documents that hold them and the longest run."""
    hits = leaked_items(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    counts = counted(table(spark, d, "documents", "doc_id", "text", "source"))
    rates = mix_rates(counts, table(spark, d, "mix_targets", "mix", "source", "share", "max_repeats"))
    return mixed(counts, rates).select("mix", "doc_id", "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    counts = counted(table(spark, d, "documents", "doc_id", "text", "source"))
    return mix_report(counts, table(spark, d, "mix_targets", "mix", "source", "share", "max_repeats"))


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "labels", "doc_id", "annotator", "toxic"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).where(F.col("score") >= REVIEW).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse_rates(_abuse(spark, d), table(spark, d, "documents", "doc_id", "source"))


def p10_calibration(spark: SparkSession, d: str) -> DataFrame:
    return calibration(_abuse(spark, d), table(spark, d, "labels", "doc_id", "annotator", "toxic"))


#: runs of words by position, joined on the whole run; the Spark side scans with an automaton instead
_RUNS = """WITH i AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')), ' ') w FROM benchmark),
    d AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')), ' ') w FROM documents WHERE length(text) > 0),
    ir AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) k FROM i)),
    dr AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) k FROM d))"""

QUERIES = {f.__name__: f for f in (p1_found, p1_shared, p2_found, p2_verdicts, p3_found, p3_pairs, p3_extracted, p5_found, p5_rates, p7_found, p7_licenses, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_scores, p10_rates, p10_calibration)}

#: every window of 240 characters by its hash; the Spark side names symbols and compares only what shares one
_WINDOWS = """WITH d AS (SELECT DISTINCT identity, source FROM definitions WHERE kind = 'script' AND identity IS NOT NULL AND length(source) >= 240),
    k AS (SELECT identity, source, unnest(range(1, length(source) - 238)) k FROM d), w AS (SELECT identity, k, hash(substr(source, k, 240)) h FROM k),
    s AS (SELECT h FROM w GROUP BY h HAVING min(identity) <> max(identity))"""

SQL = {
    "p1_found": f"""{_WINDOWS}, t AS (SELECT DISTINCT identity, h FROM w WHERE h IN (SELECT h FROM s)), p AS (SELECT DISTINCT a.identity identity_a, b.identity identity_b FROM t a JOIN t b ON a.h = b.h AND a.identity < b.identity),
        l AS (SELECT DISTINCT identity, repo, path FROM locations WHERE symbol IS NULL)
        SELECT identity_a, identity_b FROM p WHERE NOT EXISTS (SELECT 1 FROM l x JOIN l y ON x.repo = y.repo AND x.path = y.path WHERE x.identity = identity_a AND y.identity = identity_b)""",
    "p1_shared": f"""{_WINDOWS}, t AS (SELECT identity, k, lead(k) OVER (PARTITION BY identity ORDER BY k) n FROM w WHERE h IN (SELECT h FROM s))
        SELECT identity, CAST(any_value(length(source)) AS INTEGER) characters, CAST(sum(least(240, coalesce(n - k, 240))) AS INTEGER) shared FROM t JOIN d USING (identity) GROUP BY identity""",
    "p8_found": f"{_RUNS} SELECT DISTINCT doc_id, item_id FROM ir JOIN dr USING (r)",
    "p8_items": f"""{_RUNS.replace("SELECT DISTINCT item_id, array_to_string", "SELECT DISTINCT item_id, k, array_to_string").replace("SELECT DISTINCT doc_id, array_to_string", "SELECT DISTINCT doc_id, k, array_to_string")},
        h AS (SELECT DISTINCT doc_id, item_id, dr.k at_, dr.k - ir.k diagonal FROM ir JOIN dr USING (r)), g AS (SELECT *, at_ - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY at_) island FROM h),
        l AS (SELECT doc_id, item_id, count(*) + 11 n FROM g GROUP BY doc_id, item_id, diagonal, island) SELECT item_id, count(DISTINCT doc_id) documents, CAST(max(n) AS INTEGER) longest FROM l GROUP BY item_id""",
}
