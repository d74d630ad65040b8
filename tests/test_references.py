import pytest

from pagemill.operators.references import orphan_counts, orphan_references, orphan_status, reference_status, reference_statuses, status_by_month

LINKS = "link_seq bigint, target_address string, repo string, sha string, target_form string, target_name string, target_locator string, target_path string, target_rev string, target_symbol string, target_id string, target_identity string, kind string"
A, B = "a" * 64, "b" * 64
SHA = "0123456789abcdef0123456789abcdef01234567"


def link(n, form, name=None, locator=None, path=None, rev=None, symbol=None, tid=None, ti=None):
    return (n, f"t{n}", "r", SHA, form, name, locator, path, rev, symbol, tid, ti, "clash")


@pytest.fixture
def tables(spark):
    links = [
        link(1, "locator", ti="SHA256:" + A.upper()), link(2, "locator", ti=B), link(3, "identity", tid=A[:12]), link(4, "identity", tid=B[:14]), link(5, "identity", tid="aa"), link(6, "identity", tid="ab"),
        link(7, "locator", locator="r", path="x.py", rev=SHA[:12], symbol="f"), link(8, "locator", locator="r", path="x.py", rev=SHA[:12]), link(9, "locator", locator="r", path="x.py", rev="main", symbol="f"),
        link(10, "locator", locator="gone", path="x.py", rev="main"), link(11, "locator", locator="r", path=None, rev=SHA), link(12, "name", name="a.b"), link(13, "name", name="a.c"), link(14, "name", name="a.b", rev="v1"),
        link(15, "name", name="a.b", rev="v9"), link(16, None), link(17, "identity"), link(2, "locator", ti=B), link(18, "locator", locator="r", path="x.py", rev=SHA[:20].upper(), symbol="f"), link(19, "name"),
    ]
    return dict(
        links=spark.createDataFrame(links, LINKS),
        revisions=spark.createDataFrame(
            [("r", SHA, {"pkg.mod": 1, "pkg.sub": 2, "nowhere": 1, "mod": 1}, "2025-02-01T00:00:00Z", 2), ("r", "f" * 40, None, "2025-01-01T00:00:00Z", 1)], "repo string, sha string, unmapped map<string,int>, crawled_at string, crawl_seq bigint"
        ),
        definitions=spark.createDataFrame([(A,), (A,), (None,)], "identity string"),
        locations=spark.createDataFrame([(A, "r", SHA, "x.py", "f"), (A, "r", SHA, "lib/pkg/mod.py", None), (A, "r", SHA, "pkg/sub/__init__.py", None)], "identity string, repo string, sha string, path string, symbol string"),
        names=spark.createDataFrame([("a.b", {"v1": "x"}), ("a.b", {"v2": "x"}), ("a.z", None), (None, None)], "name string, versions map<string,string>"),
    )


def test_each_rule(tables):
    got = {(r.ref_table, r.ref_key, r.target) for r in orphan_references(**tables).collect()}
    links = {int(k) for t, k, _ in got if t == "links"}
    assert links == {2, 4, 6, 8, 10, 11, 13, 15, 19}
    assert {m for t, _, m in got if t == "revisions"} == {"nowhere"}


def test_counts_and_status(tables):
    counts = {(r.ref_table, r.month): r.orphans for r in orphan_counts(orphan_status(**tables)).groupBy("ref_table", "month").sum("orphans").withColumnRenamed("sum(orphans)", "orphans").collect()}
    assert counts == {("links", "2025-02"): 9, ("revisions", "2025-02"): 1}
    status = {r.link_seq: r.status for r in reference_status(tables["links"], tables["revisions"], tables["definitions"], tables["locations"]).collect()}
    assert status == {1: "live", 2: "missing"}


def test_empty_tables(spark, tables):
    none = {k: spark.createDataFrame([], v.schema) for k, v in tables.items()}
    assert orphan_references(**none).collect() == []
    only = none | {"links": tables["links"]}
    assert orphan_references(**only).count() == 17 - 2 + 2  # all but those without a form or rule


def test_statuses_of_every_kind(spark, tables):
    old, new = "e" * 40, "d" * 40
    more = [("q", old, {"was.here": 1, "comes": 1, "never": 1}, "2025-03-01T00:00:00Z", 3), ("q", new, {"was.here": 1}, "2025-04-01T00:00:00Z", 4)]
    revisions = tables["revisions"].union(spark.createDataFrame(more, tables["revisions"].schema))
    places = [(A, "q", old, "gone.py", None), (A, "q", new, "comes.py", None), (A, "q", "f" * 40, "no.py", None)]
    locations = tables["locations"].union(spark.createDataFrame(places, tables["locations"].schema))
    links = tables["links"].union(spark.createDataFrame([link(30, "locator", locator="q", path="gone.py", rev="main"), link(31, "locator", locator="q", path="comes.py", rev="main"), link(32, "locator", locator="q", path="gone.py", rev=old)], LINKS))
    args = dict(tables, links=links, revisions=revisions, locations=locations)
    rows = reference_statuses(**args)
    got = {(r.ref_table, r.ref_key, r.target): r.status for r in rows.collect()}
    status = {int(k): s for (t, k, _), s in got.items() if t == "links"}
    assert {n for n, s in status.items() if s == "missing"} == {2, 4, 6, 8, 10, 11, 13, 15, 19}
    assert (status[30], status[31], status[32]) == ("late", "late", "late") and status[1] == status[3] == status[7] == status[14] == "live"
    modules = {m: s for (t, k, m), s in got.items() if t == "revisions" and k == f"q@{old}"}
    assert modules == {"was.here": "missing", "comes": "late", "never": "missing"}
    assert sum(r.references for r in status_by_month(rows).collect()) == len(got) == rows.count()
    # the same of the orphans alone; an identity that places hold and definitions do not was deleted
    held = tables["locations"].sparkSession.createDataFrame([(B, "q", old, "b.py", None)], tables["locations"].schema)
    orphans = {(r.ref_table, r.ref_key, r.target): (r.kind, r.status) for r in orphan_status(**dict(args, locations=locations.union(held))).collect()}
    assert set(orphans) == {(r.ref_table, r.ref_key, r.target) for r in orphan_references(**args).collect()}
    assert {k: s for k, (kind, s) in orphans.items() if kind != "identity"} == {k: got[k] for k, (kind, _) in orphans.items() if kind != "identity"}
    assert orphans["links", "2", "t2"] == ("identity", "late")
    assert orphan_status(**{k: v.limit(0) for k, v in args.items()}).collect() == []
    assert reference_statuses(**{k: v.limit(0) for k, v in args.items()}).collect() == []
