"""Queries over the index as a whole: every place, page or target at once.

Each takes the tables as DataFrames and counts exact repeats of a row once. Sequence
columns decide order: ``crawl_seq`` the crawl, ``link_seq`` the links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import short
from pagemill.tables import identity_of, is_sha, latest_revision

def locator(repo: str = "repo", sha: str = "sha", path: str = "path", symbol: str = "symbol") -> Column:
    """The address of a place at the short form of its revision."""
    return F.concat(F.col(repo), F.lit("@"), short(sha), F.lit("/"), F.col(path), F.coalesce(F.concat(F.lit("#"), F.col(symbol)), F.lit("")))


def places(locations: DataFrame) -> DataFrame:
    return locations.select("identity", "repo", "sha", "path", "symbol", "span_first", "span_last").distinct()


def crawls(revisions: DataFrame) -> DataFrame:
    """One row a (repo, sha): that of its last crawl."""
    w = Window.partitionBy("repo", "sha").orderBy(F.desc("crawl_seq"))
    return revisions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def definitions_once(definitions: DataFrame) -> DataFrame:
    """One row an identity."""
    return definitions.dropDuplicates(["identity"])


def status(repos: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per repository: crawled revisions, the current one, its commit time and files."""
    known = repos.groupBy("locator").agg(F.min("added_at").alias("added_at"))
    per = crawls(revisions).groupBy("repo").agg(
        F.count("*").alias("revisions"), F.max_by("sha", "crawl_seq").alias("current"), F.max_by("committed_at", "crawl_seq").alias("committed_at"), F.max_by("files", "crawl_seq").alias("files")
    )
    return known.join(per, known.locator == per.repo, "left").select(F.col("locator").alias("repo"), "added_at", F.coalesce("revisions", F.lit(0)).alias("revisions"), "current", "committed_at", "files")


def current_places(locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Places at the current revision of their repository."""
    return places(locations).join(latest_revision(revisions), ["repo", "sha"])


def registry_entry(places_: DataFrame, names: DataFrame) -> DataFrame:
    """Places with the least registry name whose target is ``repo/path``, if there is one (column ``entry``)."""
    by_target = names.where("target is not null").groupBy("target").agg(F.min("name").alias("entry"))
    return places_.join(by_target, F.concat_ws("/", "repo", "path") == by_target.target, "left").drop("target")


def dups(definitions: DataFrame, locations: DataFrame, revisions: DataFrame, key: str = "identity") -> DataFrame:
    """Groups of places with one identity or one shape at current revisions, two at least.

    A whole-file place is left out where a definition of the same file has its identity. Kind and lines are those
    of the first place by repository, path and symbol. Null shapes form no group.
    """
    at = current_places(locations, revisions).join(definitions_once(definitions).select("identity", "shape", "kind", "name", "lines"), "identity")
    inner = at.where("symbol is not null").select("repo", "path", "identity").distinct()
    kept = at.where("symbol is not null").unionByName(at.where("symbol is null").join(inner, ["repo", "path", "identity"], "left_anti"))
    order = F.struct("repo", "path", F.coalesce("symbol", F.lit("")))
    return (
        kept.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
        .agg(
            F.count("*").alias("places"), F.countDistinct("identity").alias("identities"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"),
            F.min_by("kind", order).alias("kind"), F.min_by("lines", order).alias("lines"),
        ).where("places > 1")
    )


def history(locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """The changes of every place over the crawled revisions of its repository, oldest commit first: (repo, path, symbol, sha, identity, absent).

    One row where a place appears, has another identity than at the revision before, or is gone (``absent``, null identity).
    Revisions are numbered in their order, so a gap tells an absence: the rows are as many as there are changes, whatever
    the number of revisions.
    """
    order = Window.partitionBy("repo").orderBy(F.col("committed_at").asc_nulls_first(), "crawl_seq")
    numbered = crawls(revisions).select("repo", "sha", F.row_number().over(order).alias("at"), F.count("*").over(Window.partitionBy("repo")).alias("of"))
    seen = places(locations).groupBy("repo", "path", "symbol", "sha").agg(F.max("identity").alias("identity")).where("identity is not null").join(numbered, ["repo", "sha"])
    spot = Window.partitionBy("repo", "path", "symbol").orderBy("at")
    told = seen.select("*", F.lag("at").over(spot).alias("before"), F.lag("identity").over(spot).alias("was"), F.lead("at").over(spot).alias("next"))
    event = lambda when, at, identity: F.when(when, F.struct(at.cast("int").alias("at"), identity.alias("identity")))
    came = event(F.expr("before is null or before < at - 1 or was <> identity"), F.col("at"), F.col("identity"))
    went = event(F.expr("coalesce(next, of + 1) > at + 1 and at < of"), F.col("at") + 1, F.lit(None).cast("string"))
    changes = told.select("repo", "path", "symbol", F.explode(F.array_compact(F.array(came, went))).alias("e")).select("repo", "path", "symbol", "e.*")
    every = changes.join(numbered.select("repo", "at", "sha"), ["repo", "at"])
    return every.select("repo", "path", "symbol", "sha", "identity", F.col("identity").isNull().alias("absent"))


def resolve_targets(links: DataFrame, definitions: DataFrame, locations: DataFrame, revisions: DataFrame, names: DataFrame) -> DataFrame:
    """(link_seq, target_identity) that the index can tell for links without one: by a unique identity prefix, by a
    place at a commit, by a place at the last crawled revision that has it, or by a registry name's target. Never a guess."""
    open_ = links.where("target_identity is null").select(
        "link_seq", "target_form", "target_name", "target_locator", "target_path", "target_rev", "target_symbol", identity_of("target_id").alias("tid")
    ).distinct()
    ids = definitions.select("identity").distinct()
    by_id = open_.where("tid is not null")
    prefix = (
        by_id.join(ids, (F.substring("tid", 1, 12) == F.substring("identity", 1, 12)) & F.col("identity").startswith(F.col("tid")))
        .groupBy("link_seq").agg(F.min("identity").alias("found"), F.count("*").alias("n")).where("n = 1").drop("n")
    )
    entry = names.groupBy("name").agg(F.min_by("target", "registry").alias("target"), F.min_by("versions", "registry").alias("versions"))
    named = open_.where("tid is null and target_form = 'name'").join(entry, F.col("target_name") == F.col("name"))
    label = F.when(is_sha("target_rev"), F.col("target_rev")).otherwise(F.try_element_at("versions", F.col("target_rev")))
    parts = F.split("target", "/", 4)
    from_names = named.where(F.size(parts) == 4).select(
        "link_seq", F.array_join(F.slice(parts, 1, 3), "/").alias("repo"), F.element_at(parts, 4).alias("path"), "target_symbol", F.when(is_sha(label), F.lower(label)).alias("rev")
    )
    direct = open_.where("tid is null and target_form = 'locator' and target_path is not null").select(
        "link_seq", F.col("target_locator").alias("repo"), F.col("target_path").alias("path"), "target_symbol", F.when(is_sha("target_rev"), F.lower("target_rev")).alias("rev")
    )
    asked = direct.unionByName(from_names).alias("a")
    at = places(locations).select("identity", "repo", "sha", "path", "symbol").alias("l")
    same = F.expr("a.repo = l.repo and a.path = l.path and a.target_symbol <=> l.symbol")
    pinned = asked.where("rev is not null").join(at, same & F.expr("startswith(l.sha, a.rev)")).groupBy("link_seq").agg(F.min("l.identity").alias("found"))
    seq = crawls(revisions).select("repo", "sha", "crawl_seq")
    newest = at.join(seq, ["repo", "sha"]).groupBy("repo", "path", "symbol").agg(F.max_by("identity", F.struct("crawl_seq", "identity")).alias("found")).alias("l")
    moving = asked.where("rev is null").join(newest, same).select("link_seq", "found")
    return prefix.unionByName(pinned).unionByName(moving).select("link_seq", F.col("found").alias("target_identity"))


def rank(links: DataFrame) -> DataFrame:
    """Distinct (source, repo, file) that link to each identity: in all (null relation and origin) and by relation and origin.

    Derived references of a page to itself do not count. One pass over grouping sets.
    """
    k = links.select(identity_of("target_identity").alias("identity"), "relation", "origin", "source_identity", "repo", "file").where(
        "identity is not null and not (origin = 'derived' and identity = source_identity)"
    )
    sets = [[F.col("identity")], [F.col("identity"), F.col("relation"), F.col("origin")]]
    return k.groupingSets(sets, "identity", "relation", "origin").agg(F.countDistinct("source_identity", "repo", "file").alias("pages"))


def top_ranked(links: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` identities that most pages link to."""
    return rank(links).where("relation is null and origin is null").select("identity", "pages").orderBy(F.desc("pages"), "identity").limit(limit)


def who(links: DataFrame, revisions: DataFrame, definitions: DataFrame) -> DataFrame:
    """Every backlink once for each (source, repo, file, relation, address), at its latest commit."""
    dated = links.join(crawls(revisions).select("repo", "sha", "committed_at", "crawl_seq"), ["repo", "sha"])
    w = Window.partitionBy("source_identity", "repo", "file", "relation", "target_address").orderBy(F.desc("committed_at"), F.desc("crawl_seq"), "link_seq")
    last = dated.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    d = definitions_once(definitions).select(F.col("identity").alias("source_identity"), "kind", "name")
    return last.drop("name").join(d, "source_identity").select(
        "source_identity", "repo", "sha", "file", "kind", "name", "relation", "origin", "line", "target_address", identity_of("target_identity").alias("target_identity")
    )


def who_counts(backlinks: DataFrame) -> DataFrame:
    """Backlinks of each identified target by relation and origin."""
    return backlinks.where("target_identity is not null").groupBy("target_identity", "relation", "origin").agg(F.count("*").alias("backlinks"))


def _note_counts() -> tuple[Column, Column]:
    """Files that an extractor would have read but could not, and link lines that were ignored."""
    ignored = F.filter("skipped", lambda x: x.contains("the line was ignored"))
    path = lambda x: F.substring_index(x, ": ", 1)
    unread = F.filter(
        "skipped", lambda x: ~x.contains("the line was ignored") & path(x).rlike(r"\.(?:py|c|h)$")
    )
    return F.when(F.col("skipped").isNotNull(), F.size(unread)), F.when(F.col("skipped").isNotNull(), F.size(ignored))


def coverage(revisions: DataFrame, locations: DataFrame, links: DataFrame) -> DataFrame:
    """Per crawled revision: files, pages, links, notes, and what was unread or ignored (null where it was not recorded)."""
    unread, ignored = _note_counts()
    v = crawls(revisions)
    now = latest_revision(revisions).withColumn("is_current", F.lit(True))
    pages = places(locations).groupBy("repo", "sha").agg(F.count("*").alias("pages"), F.countDistinct("path").alias("paths"))
    edges = links.select("repo", "sha", "link_seq").distinct().groupBy("repo", "sha").agg(F.count("*").alias("links"))
    return (
        v.join(now, ["repo", "sha"], "left").join(pages, ["repo", "sha"], "left").join(edges, ["repo", "sha"], "left")
        .select(
            "repo", "sha", F.coalesce("is_current", F.lit(False)).alias("is_current"), "files", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("paths", F.lit(0)).alias("paths"), F.coalesce("links", F.lit(0)).alias("links"),
            F.when(F.col("skipped").isNotNull(), F.size("skipped")).alias("skipped"), unread.alias("unread"), ignored.alias("ignored_links"),
            F.when(F.col("unmapped").isNotNull(), F.size("unmapped")).alias("unmapped"),
        )
    )


def coverage_totals(cover: DataFrame, links: DataFrame) -> DataFrame:
    """One row over all revisions. A sum is null where any revision lacks the record; ``complete`` is null where it cannot be told."""

    def total(c: str) -> Column:
        return F.when(F.count("*") == F.count(c), F.coalesce(F.sum(c), F.lit(0))).alias(c)

    unresolved = links.where("target_identity is null").select("link_seq").distinct().agg(F.count("*").alias("unresolved_targets"))
    t = cover.agg(F.countDistinct("repo").alias("repos"), F.count("*").alias("revisions"), F.sum("files").alias("files"), total("skipped"), total("unread"), total("ignored_links"), F.sum("unmapped").alias("unmapped"))
    gap = F.lit(False)
    for c in ("unmapped", "unread", "ignored_links"):
        gap = gap | F.coalesce(F.col(c) > 0, F.lit(False))
    return t.crossJoin(F.broadcast(unresolved)).withColumn("complete", F.when(gap, False).when(F.col("unread").isNull(), F.lit(None)).otherwise(True))


def directories(locations: DataFrame) -> DataFrame:
    """Distinct paths of each revision by top directory, '.' for files at the root."""
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(".")
    return locations.groupBy("repo", "sha", top.alias("directory")).agg(F.countDistinct("path").alias("paths"))


def unresolved_matching(links: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each defined name: links without an identity whose symbol is, or ends in, that name."""
    leaf = F.lower(F.substring_index("target_symbol", ".", -1))
    missing = links.where("target_identity is null and target_symbol is not null").select("link_seq", leaf.alias("leaf")).distinct().groupBy("leaf").agg(F.count("*").alias("links"))
    names = definitions.where("name is not null").select(F.lower("name").alias("leaf"), "name").distinct()
    return names.join(missing, "leaf").select("name", "links")


def forward(definitions: DataFrame, locations: DataFrame, revisions: DataFrame, links: DataFrame) -> DataFrame:
    """Where pages have gone that their repository's current revision no longer holds.

    For each (repo, identity) seen before but not now: another repository whose current revision holds the identity
    ('same-identity', the latest commit first), else the page that links back with is or from ('backlink', is first).
    """
    now = current_places(locations, revisions)
    seq = crawls(revisions).select("repo", "sha", "committed_at", "crawl_seq")
    gone = places(locations).select("repo", "identity").distinct().join(now.select("repo", "identity").distinct(), ["repo", "identity"], "left_anti")
    dated = now.join(seq, ["repo", "sha"])
    other = gone.alias("g").join(dated.alias("n"), F.expr("g.identity = n.identity and g.repo <> n.repo"))
    order = F.struct(F.coalesce("n.committed_at", F.lit(-1)), "n.crawl_seq", "n.repo", "n.path", F.coalesce("n.symbol", F.lit("")))
    same = other.groupBy("g.repo", "g.identity").agg(F.max_by(F.concat_ws("/", "n.repo", "n.path"), order).alias("to")).withColumn("rule", F.lit("same-identity"))
    rest = gone.join(same, ["repo", "identity"], "left_anti")
    back = links.where("relation in ('is', 'from') and target_identity is not null").select(identity_of("target_identity").alias("identity"), "relation", F.col("repo").alias("from_repo"), "sha", "file", "link_seq")
    back = back.join(seq.withColumnRenamed("repo", "from_repo"), ["from_repo", "sha"])
    rank_ = F.struct(F.when(F.col("relation") == "is", 1).otherwise(0), F.coalesce("committed_at", F.lit(-1)), "crawl_seq", "link_seq")
    linked = rest.join(back, "identity").where("from_repo <> repo").groupBy("repo", "identity").agg(F.max_by(F.concat_ws("/", "from_repo", "file"), rank_).alias("to")).withColumn("rule", F.lit("backlink"))
    return same.unionByName(linked)


def link_owners(links: DataFrame, locations: DataFrame) -> DataFrame:
    """(link_seq, owner): the innermost page whose span holds the link's line; ties to the earlier start, then the symbol."""
    l = links.select("link_seq", "repo", "sha", "file", "line").distinct()
    spans = places(locations).where("symbol is not null").select("repo", "sha", F.col("path").alias("file"), "symbol", "span_first", "span_last")
    hit = l.join(spans, ["repo", "sha", "file"]).where("line between span_first and span_last")
    inner = F.struct((F.col("span_last") - F.col("span_first")).alias("width"), "span_first", "symbol")
    return hit.groupBy("link_seq").agg(F.min_by("symbol", inner).alias("owner"))


def link_rows(links: DataFrame) -> DataFrame:
    """Links as the index keeps them: the first of each (source, repo, sha, file, line, relation, address)."""
    key = ["source_identity", "repo", "sha", "file", "line", "relation", "target_address"]
    return links.groupBy(*key).agg(F.min("link_seq").alias("link_seq"))


def merged_definitions(definitions: DataFrame) -> DataFrame:
    """One row an identity; a definition's kind and name take the place of a script's."""
    first = F.min_by(F.struct("kind", "name"), F.struct((F.col("kind") == "script").cast("int"), "kind", "name"))
    return definitions.groupBy("identity").agg(first.alias("d"), F.max("lines").alias("lines")).select("identity", "d.kind", "d.name", "lines")


def repo_pages(locations: DataFrame, revisions: DataFrame, definitions: DataFrame) -> DataFrame:
    """Pages at current revisions with the place of each in its file (the file itself first)."""
    at = current_places(locations, revisions).join(definitions_once(definitions).select("identity", "kind", "name"), "identity")
    w = Window.partitionBy("repo", "path").orderBy("span_first", F.col("symbol").isNotNull(), "symbol")
    return at.select("repo", "path", "symbol", "kind", "name", "span_first", "span_last", F.row_number().over(w).alias("place"))


def page_links(links: DataFrame) -> DataFrame:
    """Per page and revision: its asserted links and derived references, counted and listed."""
    k = link_rows(links.where("source_identity is not null"))
    ref = F.col("relation") == "ref"
    return k.groupBy("source_identity", "repo", "sha").agg(
        F.count_if(~ref).alias("links"), F.count_if(ref).alias("refs"), F.array_join(F.array_sort(F.collect_set(F.when(~ref, F.col("target_address")))), " ").alias("targets")
    )


def names_now(names: DataFrame) -> DataFrame:
    """The first registry that knows each name, and how many do."""
    return names.groupBy("name").agg(F.min("registry").alias("registry"), F.min_by("target", "registry").alias("target"), F.countDistinct("registry").alias("registries"))


def name_checks(names: DataFrame, locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per registry entry: whether its name is well formed, its owner is the target's account, the target is crawled, the default label exists, labels are well formed, and all of them are commits."""
    parts = F.split("target", "/", 4)
    e = names.select("name", "registry", "target", "owner", "default_label", "versions").dropDuplicates(["name", "registry"]).withColumn("repo", F.array_join(F.slice(parts, 1, 3), "/")).withColumn("path", F.when(F.size(parts) == 4, F.element_at(parts, 4)))
    held = current_places(locations, revisions).select("repo", "path").distinct().withColumn("held", F.lit(True))
    ok_label = F.col("default_label").isNull() | F.array_contains(F.map_keys("versions"), F.col("default_label"))
    return e.join(held, ["repo", "path"], "left").select(
        "name", "registry", F.col("name").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*(?:\.[a-z0-9]+(?:-[a-z0-9]+)*)*$").alias("name_ok"), F.col("owner").eqNullSafe(F.element_at(F.split("repo", "/"), 2)).alias("owner_ok"),
        F.coalesce("held", F.lit(False)).alias("target_ok"), ok_label.alias("label_ok"), F.forall(F.map_keys("versions"), lambda k: k.rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$")).alias("labels_ok"),
        F.forall(F.map_values("versions"), lambda v: v.rlike("^[0-9a-fA-F]{12,40}$")).alias("pinned"),
    )


def innermost(pages: DataFrame) -> DataFrame:
    """Pages of a file without those that hold another listed one: a class beside its member, a file beside a definition."""
    p = pages.select("repo", "path", "symbol").distinct()
    inner = p.where("symbol is not null")
    prefixes = inner.select("repo", "path", F.explode(F.expr("transform(sequence(1, size(split(symbol, '[.]'))), n -> array_join(slice(split(symbol, '[.]'), 1, n - 1), '.'))")).alias("outer_")).distinct()
    holders = prefixes.select("repo", "path", F.col("outer_").alias("symbol"))
    return p.withColumn("k", F.coalesce("symbol", F.lit(""))).join(holders.withColumnRenamed("symbol", "k"), ["repo", "path", "k"], "left_anti").drop("k")


def symbol_files(locations: DataFrame) -> DataFrame:
    """Per revision and symbol: how many files define it, and the file where it is the only one."""
    p = locations.where("symbol is not null").select("repo", "sha", "symbol", "path").distinct()
    return p.groupBy("repo", "sha", "symbol").agg(F.count("*").alias("files"), F.min("path").alias("first")).select("repo", "sha", "symbol", "files", F.when(F.col("files") == 1, F.col("first")).alias("path"))


def latest_places(locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """What has become of each place of a repository at its current revision.

    'same': the place still has one of its identities; 'moved': an identity it had stands elsewhere in the
    repository (the least path and symbol are given); 'changed': the place has another identity; 'gone' otherwise.
    """
    p = places(locations).select("identity", "repo", "path", "symbol", "sha").distinct()
    now = p.join(latest_revision(revisions), ["repo", "sha"]).select("repo", "identity", F.col("path").alias("now_path"), F.col("symbol").alias("now_symbol"))
    was = p.select("repo", "path", "symbol", "identity").distinct()
    spot = F.struct(F.col("now_path").alias("p"), F.coalesce("now_symbol", F.lit("")).alias("s"))
    here = (F.col("now_path") == F.col("path")) & F.col("now_symbol").eqNullSafe(F.col("symbol"))
    found = was.join(now, ["repo", "identity"], "left").groupBy("repo", "path", "symbol").agg(
        F.coalesce(F.max(here), F.lit(False)).alias("same"), F.min(F.when(F.col("now_path").isNotNull(), spot)).alias("to")
    )
    held = now.select("repo", F.col("now_path").alias("path"), F.col("now_symbol").alias("symbol")).distinct().withColumn("held", F.lit(True)).alias("h")
    f = found.alias("f").join(held, F.expr("f.repo = h.repo and f.path = h.path and f.symbol <=> h.symbol"), "left").select("f.*", "h.held")
    state = F.when(F.col("same"), "same").when(F.col("to").isNotNull(), "moved").when(F.col("held"), "changed").otherwise("gone")
    to = F.when(state == "moved", F.concat(F.col("to.p"), F.when(F.col("to.s") != "", F.concat(F.lit("#"), F.col("to.s"))).otherwise("")))
    return f.select("repo", "path", "symbol", state.alias("state"), to.alias("moved_to"))


def hits_with_places(hits: DataFrame, definitions: DataFrame, locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(identity, kind, name, places, current) of distinct hits (column ``identity``) that have a definition: their current places, or all of them where there are none now, as addresses joined by blanks."""
    h = hits.select("identity").where("identity is not null").distinct().join(definitions_once(definitions).select("identity", "kind", F.col("name").alias("page_name")), "identity")
    at = places(locations).select("identity", "repo", "sha", "path", "symbol").distinct().join(latest_revision(revisions).withColumn("now", F.lit(True)), ["repo", "sha"], "left")
    spots = h.join(at, "identity", "left").groupBy("identity", "kind", "page_name").agg(
        F.array_sort(F.collect_set(F.when(F.col("now"), locator()))).alias("here"), F.array_sort(F.collect_set(locator())).alias("ever")
    )
    now = F.size("here") > 0
    return spots.select("identity", "kind", F.col("page_name").alias("name"), F.array_join(F.when(now, F.col("here")).otherwise(F.col("ever")), " ").alias("places"), now.alias("current"))
