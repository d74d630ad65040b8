"""References to records that do not exist: one sort-merge of references and parent keys.

References and parents of every kind are brought under one key, co-partitioned
and sorted by it, and merged as two streams (Spark's sort-merge join). Parents
are reduced to one row a key (``reference_statuses``: with the interval in which they
were valid) before they are merged; adaptive execution splits a key that draws very many references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.tables import identity_of, is_sha, latest_revision

#: revisions are written with at least so many hex digits, identities in links likewise
PREFIX = 12

REFERENCE = ["ref_table", "ref_key", "target", "repo", "sha", "kind", "key", "starts", "ends"]


def merge_references(references: DataFrame, parents: DataFrame, how: str = "left_anti") -> DataFrame:
    """References without a parent (``left_anti``) or with one (``left_semi``).

    ``references`` has (kind, key, starts, ends, ...), ``parents`` (kind, key, value): a
    parent answers a reference of equal kind and key whose value begins with
    ``starts`` and ends with ``ends`` ('' asks for nothing). A reference with a null
    in one of these has no parent.
    """
    r, p = references.alias("r"), parents.hint("merge").alias("p")
    on = (
        (F.col("r.kind") == F.col("p.kind"))
        & (F.col("r.key") == F.col("p.key"))
        & F.expr("startswith(p.value, r.starts)")
        & F.expr("endswith(p.value, r.ends)")
    )
    return r.join(p, on, how)


def _place(repo: str, path: str, symbol: str) -> F.Column:
    return F.concat_ws("\x1f", F.col(repo), F.col(path), F.coalesce(F.col(symbol), F.lit("\x1e")))


def link_references(links: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row (REFERENCE columns) for each link that the first matching rule can decide.

    Links whose address did not parse are left out, and so are identity addresses
    that name neither an identity nor a prefix.
    """
    latest = latest_revision(revisions).select(F.col("repo").alias("target_locator"), F.col("sha").alias("latest_sha"))
    l = links.select(
        F.col("link_seq").cast("string").alias("ref_key"), F.col("target_address").alias("target"), "repo", "sha", "target_form",
        "target_name", "target_locator", "target_path", "target_rev", "target_symbol", identity_of("target_identity").alias("ti"), identity_of("target_id").alias("tid"),
    ).where("target_form is not null")
    kind = (
        F.when(F.col("ti").isNotNull(), "identity")
        .when(F.col("tid").isNotNull(), "prefix")
        .when(F.col("target_form") == "locator", "place")
        .when((F.col("target_form") == "name") & F.col("target_rev").isNull(), "name")
        .when(F.col("target_form") == "name", "version")
    )
    l = l.withColumn("kind", kind).where("kind is not null")
    # only places without a sha need the latest revision of their repository
    l = l.withColumn("at_latest", (F.col("kind") == "place") & ~F.coalesce(is_sha("target_rev"), F.lit(False)))
    l = l.join(latest, (F.col("at_latest")) & (l.target_locator == latest.target_locator), "left").drop(latest.target_locator)
    rev = F.when(F.col("at_latest"), F.col("latest_sha")).otherwise(F.lower("target_rev"))
    key = (
        F.when(F.col("kind") == "identity", F.col("ti"))
        .when(F.col("kind") == "prefix", F.substring("tid", 1, PREFIX))
        .when((F.col("kind") == "place") & F.col("target_locator").isNotNull() & F.col("target_path").isNotNull(), F.concat_ws("\x1f", F.substring(rev, 1, PREFIX), _place("target_locator", "target_path", "target_symbol")))
        .when(F.col("kind") == "name", F.col("target_name"))
        .when(F.col("kind") == "version", F.concat_ws("\x1f", "target_name", "target_rev"))
    )
    starts = F.when(F.col("kind") == "prefix", F.col("tid")).when(F.col("kind") == "place", rev).otherwise("")
    return l.select(F.lit("links").alias("ref_table"), "ref_key", "target", "repo", "sha", "kind", key.alias("key"), starts.alias("starts"), F.lit("").alias("ends"), "at_latest")


def import_references(revisions: DataFrame) -> DataFrame:
    """One row (REFERENCE columns) for each unmapped module of a revision."""
    m = revisions.where("unmapped is not null").select("repo", "sha", F.explode(F.map_keys("unmapped")).alias("target"))
    as_path = F.replace(F.col("target"), F.lit("."), F.lit("/"))
    return m.select(
        F.lit("revisions").alias("ref_table"), F.concat_ws("@", "repo", "sha").alias("ref_key"), "target", "repo", "sha", F.lit("module").alias("kind"),
        F.concat_ws("\x1f", "repo", "sha", F.substring_index(as_path, "/", -1)).alias("key"), F.lit("").alias("starts"), F.explode(F.array(F.concat(F.lit("/"), as_path, F.lit(".py")), F.concat(F.lit("/"), as_path, F.lit("/__init__.py")))).alias("ends"),
    )


def parent_keys(definitions: DataFrame, locations: DataFrame, names: DataFrame, short: list[int]) -> DataFrame:
    """(kind, key, value) of every record that a reference may name, distinct.

    ``short`` lists the lengths below PREFIX in which identities are written in links.
    """
    ids = definitions.select("identity").where("identity is not null").distinct()
    by_id = ids.select(F.lit("identity").alias("kind"), F.col("identity").alias("key"), F.lit("").alias("value"))
    prefixes = F.array(*[F.substring("identity", 1, n) for n in sorted({*short, PREFIX})])
    by_prefix = ids.select(F.lit("prefix").alias("kind"), F.explode(F.array_distinct(prefixes)).alias("key"), F.col("identity").alias("value"))
    places = locations.select("repo", "sha", "path", "symbol").distinct()
    by_place = places.where("repo is not null and path is not null and sha is not null").select(
        F.lit("place").alias("kind"), F.concat_ws("\x1f", F.substring("sha", 1, PREFIX), _place("repo", "path", "symbol")).alias("key"), F.col("sha").alias("value")
    )
    last = F.substring_index("path", "/", -1)
    stem = F.expr("left(path, length(path) - 3)")
    py = locations.where("path like '%.py'").select("repo", "sha", "path").distinct()
    stems = F.array_distinct(F.array(F.substring_index(stem, "/", -1), F.when(last == "__init__.py", F.element_at(F.split(F.concat(F.lit("/"), "path"), "/"), -2)).otherwise(F.substring_index(stem, "/", -1))))
    py = py.select("repo", "sha", "path", F.explode(stems).alias("stem"))
    by_module = py.select(F.lit("module").alias("kind"), F.concat_ws("\x1f", "repo", "sha", "stem").alias("key"), F.concat(F.lit("/"), "path").alias("value"))
    named = names.where("name is not null")
    by_name = named.select(F.lit("name").alias("kind"), F.col("name").alias("key"), F.lit("").alias("value")).distinct()
    labels = named.where("versions is not null").select("name", F.explode(F.map_keys("versions")).alias("label")).distinct()
    by_version = labels.select(F.lit("version").alias("kind"), F.concat_ws("\x1f", "name", "label").alias("key"), F.lit("").alias("value"))
    return by_id.unionByName(by_prefix).unionByName(by_place).unionByName(by_module).unionByName(by_name).unionByName(by_version)


def _short(links: DataFrame) -> list[int]:
    """The lengths below PREFIX in which identities are written: at most PREFIX numbers come to the driver."""
    return [
        r[0]
        for r in links.where(f"target_identity is null and target_id is not null and length(target_id) < {PREFIX + 7}")
        .select(F.length(identity_of("target_id")).alias("n")).where(f"n < {PREFIX}").distinct().collect()
    ]


def orphan_references(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (ref_table, ref_key, target, repo, sha, kind) of the references whose record the whole tables lack.

    A target that arrives after the reference is no orphan. Nulls: a link without an
    address form is skipped; a locator without a locator or path, or whose repository has no
    revision, is an orphan; a null or empty ``unmapped`` holds no reference. Repeated rows
    count once; empty tables of records make every reference an orphan.
    """
    return _orphans(links, revisions, definitions, locations, names).select("ref_table", "ref_key", "target", "repo", "sha", "kind").distinct()


def _orphans(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame) -> DataFrame:
    """Orphans with the key and ending by which they were looked for."""
    parents = parent_keys(definitions, locations, names, _short(links))
    lost = merge_references(link_references(links, revisions), parents)
    cols = ["ref_table", "ref_key", "target", "repo", "sha", "kind"]
    imports = import_references(revisions)
    # a module has two spellings as a path: either one found settles it
    met = merge_references(imports, parents.where("kind = 'module'"), "left_semi").select(*cols).distinct()
    unmet = imports.select(*cols, "key", "ends").join(met, cols, "left_anti")
    return lost.select(*cols, "key", "ends").unionByName(unmet)


def orphan_status(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (ref_table, ref_key, target, repo, sha, kind, status, month) of the orphans, whatever their kind.

    A record that the asked revision lacks may be held by others. It was valid from the first crawl of a revision of its
    repository that has the place, the module's file or (of any repository) the identity: 'late' where that is after the last crawl of the
    referring revision, 'deleted' where it is not, 'missing' where no revision has it. Registry names and versions carry no dates:
    'missing'. Only the places that orphans ask for are looked at, and joined by their loose keys. ``month`` is that of the
    referring crawl ('' where it is unknown).
    """
    lost = _orphans(links, revisions, definitions, locations, names)
    module = F.split("key", "\x1f")
    loose = (
        F.when(F.col("kind") == "identity", F.col("key")).when(F.col("kind") == "place", F.expr(f"substr(key, {PREFIX + 2})"))
        .when(F.col("kind") == "module", F.concat_ws("\x1f", module[0], module[2]))
    )
    asked = lost.withColumn("loose", loose).alias("o")
    crawl = revisions.groupBy("repo", "sha").agg(F.max("crawled_at").alias("crawled_at"))
    stem = F.expr("left(path, length(path) - 3)")
    last = F.when(F.col("path").like("%.py"), F.substring_index(stem, "/", -1))
    folder = F.when(F.col("path").like("%/__init__.py"), F.element_at(F.split("path", "/"), -2))
    entry = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("loose"))
    keys = F.array(
        entry("identity", F.col("identity")), entry("place", _place("repo", "path", "symbol")),
        entry("module", F.when(last.isNotNull(), F.concat_ws("\x1f", "repo", last))), entry("module", F.when(folder.isNotNull(), F.concat_ws("\x1f", "repo", folder))),
    )
    wanted = asked.select("o.kind", "o.loose").where("loose is not null").distinct()
    at = locations.where("repo is not null and sha is not null and path is not null").select("identity", "repo", "sha", "path", "symbol").select("repo", "sha", "path", F.explode(keys).alias("k")).select("repo", "sha", "path", "k.*")
    held = at.where("loose is not null").join(wanted, ["kind", "loose"], "left_semi").join(crawl, ["repo", "sha"])
    seen = held.groupBy("kind", "loose", F.when(F.col("kind") == "module", F.concat(F.lit("/"), "path")).otherwise("").alias("value")).agg(F.min("crawled_at").alias("first")).alias("h")
    both = asked.join(seen, F.expr("o.kind = h.kind and o.loose = h.loose and (o.kind <> 'module' or endswith(h.value, o.ends))"), "left")
    cols = ["ref_table", "ref_key", "target", "repo", "sha", "kind"]
    got = both.groupBy(*[F.col(f"o.{c}").alias(c) for c in cols]).agg(F.min("h.first").alias("first")).join(crawl, ["repo", "sha"], "left")
    status = F.when(F.col("first").isNull(), "missing").when(F.col("first") > F.col("crawled_at"), "late").otherwise("deleted")
    return got.select(*cols, status.alias("status"), F.coalesce(F.substring("crawled_at", 1, 7), F.lit("")).alias("month"))


def orphan_counts(told: DataFrame) -> DataFrame:
    """Orphans per table, kind, status and month; ``told`` is ``orphan_status``."""
    return told.groupBy("ref_table", "kind", "status", "month").agg(F.count("*").alias("orphans"))


def reference_status(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame) -> DataFrame:
    """(link_seq, target, status) of the links that carry a target identity.

    The interval in which an identity was valid runs from the first to the last crawl
    of a revision that holds it. 'missing': no definition; 'late': its first crawl comes after the
    reference's; 'deleted': the repositories it was seen in were crawled again since without it;
    'live' otherwise, also for definitions without any place.
    """
    crawl = revisions.groupBy("repo", "sha").agg(F.max("crawled_at").alias("crawled_at"))
    newest = latest_revision(revisions).select("repo", F.col("sha").alias("newest"))
    seen = locations.select("identity", "repo", "sha").distinct().join(crawl, ["repo", "sha"]).join(newest, "repo")
    spans = seen.groupBy("identity").agg(F.min("crawled_at").alias("first"), F.max((F.col("sha") == F.col("newest")).cast("int")).alias("current"))
    known = definitions.select("identity").where("identity is not null").distinct().join(spans, "identity", "left")
    refs = (
        links.where("target_identity is not null")
        .select("link_seq", F.col("target_address").alias("target"), identity_of("target_identity").alias("identity"), "repo", "sha")
        .join(crawl, ["repo", "sha"], "left")
    )
    got = refs.join(known.withColumn("known", F.lit(True)).hint("merge"), "identity", "left")
    status = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("first") > F.col("crawled_at"), "late")
        .when(F.col("current") == 0, "deleted")
        .otherwise("live")
    )
    return got.select("link_seq", "target", status.alias("status")).distinct()


def _digest(*columns) -> F.Column:
    """Sixteen bytes that stand for some texts: long keys are merged by these."""
    return F.unhex(F.md5(F.concat_ws("\x1d", *columns)))


def _dated_parents(revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame, short: list[int]) -> DataFrame:
    """(k, value, first, current) of every record that a reference may name, and of places and modules in any revision of their repository.

    ``k`` stands for kind and key. ``first`` is the first crawl of a revision that holds the record, ``current`` whether the newest one of a
    repository does. Rows repeat; what is made of them does not count them.
    """
    crawl = revisions.groupBy("repo", "sha").agg(F.max("crawled_at").alias("crawled_at"))
    newest = latest_revision(revisions).select("repo", F.col("sha").alias("newest"))
    dated = crawl.join(newest, "repo").select("repo", "sha", "crawled_at", (F.col("sha") == F.col("newest")).cast("int").alias("now"))
    spans = [F.min("crawled_at").alias("first"), F.max("now").alias("current")]
    seen = locations.select("identity", "repo", "sha", "path", "symbol").join(dated, ["repo", "sha"])
    none = [F.lit(None).cast("string").alias("first"), F.lit(None).cast("int").alias("current")]
    kind = lambda name, *key: _digest(F.lit(name), *key).alias("k")

    by_identity = seen.where("identity is not null").groupBy("identity").agg(*spans)
    ids = definitions.select("identity").where("identity is not null").distinct().join(by_identity, "identity", "left")
    prefixes = F.array_distinct(F.array(*[F.substring("identity", 1, n) for n in sorted({*short, PREFIX})]))
    out = ids.select(kind("identity", F.col("identity")), F.lit("").alias("value"), "first", "current")
    out = out.unionByName(ids.select(F.explode(prefixes).alias("p"), "identity", "first", "current").select(kind("prefix", F.col("p")), F.col("identity").alias("value"), "first", "current"))

    # one exchange by place tells both what a revision held and what any did
    at = seen.where("path is not null").select(kind("place of any", _place("repo", "path", "symbol")), kind("place", F.concat_ws("\x1f", F.substring("sha", 1, PREFIX), _place("repo", "path", "symbol"))).alias("at"), "sha", "crawled_at", "now")
    spots = Window.partitionBy("k")
    at = at.select("*", F.min("crawled_at").over(spots).alias("first"), F.max("now").over(spots).alias("current"))
    out = out.unionByName(at.groupBy("k").agg(F.first("first").alias("first"), F.first("current").alias("current")).select("k", F.lit("").alias("value"), "first", "current"))
    out = out.unionByName(at.select(F.col("at").alias("k"), F.col("sha").alias("value"), F.col("crawled_at").alias("first"), "current"))

    last, stem = F.substring_index("path", "/", -1), F.expr("left(path, length(path) - 3)")
    stems = F.array_distinct(F.array(F.substring_index(stem, "/", -1), F.when(last == "__init__.py", F.element_at(F.split(F.concat(F.lit("/"), "path"), "/"), -2)).otherwise(F.substring_index(stem, "/", -1))))
    py = seen.where("path like '%.py' and symbol is null").select("repo", "sha", "path", "crawled_at", "now", F.explode(stems).alias("stem"))
    # a file may be known by its symbols alone
    inner = seen.where("path like '%.py' and symbol is not null").select("repo", "sha", "path", "crawled_at", "now").distinct().select("repo", "sha", "path", "crawled_at", "now", F.explode(stems).alias("stem"))
    py = py.unionByName(inner).withColumn("value", F.concat(F.lit("/"), "path"))
    out = out.unionByName(py.select(kind("module", F.concat_ws("\x1f", "repo", "sha", "stem")), "value", *none).distinct())
    out = out.unionByName(py.groupBy(kind("module of any", F.concat_ws("\x1f", "repo", "stem")), "value").agg(*spans))

    named = names.where("name is not null")
    out = out.unionByName(named.select(kind("name", F.col("name")), F.lit("").alias("value"), *none).distinct())
    labels = named.where("versions is not null").select("name", F.explode(F.map_keys("versions")).alias("label"))
    return out.unionByName(labels.select(kind("version", F.concat_ws("\x1f", "name", "label")), F.lit("").alias("value"), *none).distinct())


_STATUS = ["ref_table", "ref_key", "target", "repo", "sha", "kind"]


def _status_rows(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References with a digest of their own columns (``rid``), and (rid, ref_table, status, month) of each."""
    crawl = revisions.groupBy("repo", "sha").agg(F.max("crawled_at").alias("crawled_at"))
    refs = link_references(links, revisions).unionByName(import_references(revisions).withColumn("at_latest", F.lit(False)))
    refs = refs.withColumn("rid", _digest("ref_table", "ref_key", F.coalesce("target", F.lit("\x1e")), F.coalesce("repo", F.lit("\x1e")), F.coalesce("sha", F.lit("\x1e")), "kind"))
    dated = refs.join(crawl, ["repo", "sha"], "left")
    module = F.split("key", "\x1f")
    exact = dated.select("rid", "ref_table", "crawled_at", F.lit(True).alias("own"), F.when(F.col("key").isNotNull(), _digest("kind", "key")).alias("k"), "starts", "ends")
    any_key = F.when(F.col("kind") == "place", F.expr(f"substr(key, {PREFIX + 2})")).otherwise(F.concat_ws("\x1f", module[0], module[2]))
    loose = dated.where("(at_latest or kind = 'module') and key is not null").select("rid", "ref_table", "crawled_at", F.lit(False).alias("own"), _digest(F.concat("kind", F.lit(" of any")), any_key).alias("k"), F.lit("").alias("starts"), "ends")
    r, p = exact.unionByName(loose).alias("r"), _dated_parents(revisions, definitions, locations, names, _short(links)).hint("merge").alias("p")
    met = r.join(p, F.expr("r.k = p.k and startswith(p.value, r.starts) and endswith(p.value, r.ends)"), "left")
    own = F.col("r.own")
    got = met.groupBy(F.col("r.rid").alias("rid")).agg(
        F.first("r.ref_table").alias("ref_table"), F.first("r.crawled_at").alias("crawled_at"), F.max(own & F.col("p.k").isNotNull()).alias("known"), F.min(F.when(own, F.col("p.first"))).alias("first"),
        F.max(F.when(own, F.col("p.current"))).alias("current"), F.min(F.when(~own, F.col("p.first"))).alias("elsewhere"),
    )
    status = (
        F.when(F.col("known"), F.when(F.col("first") > F.col("crawled_at"), "late").when(F.col("current") == 0, "deleted").otherwise("live"))
        .when(F.col("elsewhere") > F.col("crawled_at"), "late").when(F.col("elsewhere").isNotNull(), "deleted").otherwise("missing")
    )
    return refs, got.select("rid", "ref_table", status.alias("status"), F.coalesce(F.substring("crawled_at", 1, 7), F.lit("")).alias("month"))


def reference_statuses(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (ref_table, ref_key, target, repo, sha, kind, status, month) of the references of every kind that ``orphan_references`` decides.

    'late', 'deleted' and 'live' are told by the first crawl that saw the record and by whether the newest
    revision of a repository holds it, as in ``reference_status``. A place without a sha, or a module, that the
    revision asked for lacks is 'late' or 'deleted' if another revision of its repository has it, by its first crawl.
    'missing' is what no revision has. Registry names and versions carry no dates: 'missing' or 'live'.
    """
    refs, told = _status_rows(links, revisions, definitions, locations, names)
    return refs.select("rid", *_STATUS).distinct().join(told.drop("ref_table"), "rid").drop("rid")


def statuses_by_month(links: DataFrame, revisions: DataFrame, definitions: DataFrame, locations: DataFrame, names: DataFrame) -> DataFrame:
    """``status_by_month`` of ``reference_statuses``, without bringing the references' own columns to it."""
    return status_by_month(_status_rows(links, revisions, definitions, locations, names)[1])


def status_by_month(statuses: DataFrame) -> DataFrame:
    """References per table, status and month of the last ``crawled_at`` of the referring revision ('' where it is unknown)."""
    return statuses.groupBy("ref_table", "status", "month").agg(F.count("*").alias("references"))
