"""Addresses to pages, and pages as objects: what a reader of the index asks for, for many addresses or pages at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.links import address
from pagemill.operators.pages import crawls, current_places, definitions_once, link_rows, locator, places, registry_entry, resolve_targets
from pagemill.session import cut
from pagemill.tables import identity_of, is_sha

#: order of relations in lists of backlinks
RELATIONS = ("is", "from", "see", "ref")


def resolve(addresses: DataFrame, definitions: DataFrame, locations: DataFrame, revisions: DataFrame, names: DataFrame) -> DataFrame:
    """(address, status, identity, kind, name) of each distinct address (column ``address``).

    status: 'found'; 'malformed' where it does not parse; 'unknown' where the index cannot tell one page, ambiguous
    prefixes included; 'no row' where a place names an identity without a definition.
    """
    # each address is parsed once for all the ways in which it is looked up, which go by the address itself
    asked = cut(addresses.select("address").where("address is not null").distinct().withColumn("a", address("address")).withColumn("link_seq", F.col("address")))
    as_links = asked.select(
        "link_seq", F.col("a.form").alias("target_form"), F.col("a.name").alias("target_name"), F.col("a.locator").alias("target_locator"), F.col("a.path").alias("target_path"), F.col("a.rev").alias("target_rev"),
        F.col("a.symbol").alias("target_symbol"), F.col("a.identity").alias("target_id"), F.lit(None).cast("string").alias("target_identity"),
    )
    found = resolve_targets(as_links, definitions, locations, revisions, names)
    d = definitions_once(definitions).select(F.col("identity").alias("target_identity"), "kind", "name", F.lit(True).alias("held"))
    both = asked.join(found, "link_seq", "left").join(d, "target_identity", "left")
    status = F.when(F.col("a").isNull(), "malformed").when(F.col("target_identity").isNull(), "unknown").when(F.col("held"), "found").otherwise("no row")
    return both.select("address", status.alias("status"), F.col("target_identity").alias("identity"), "kind", "name")


def preferred_location(asked: DataFrame, locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(ask, repo, sha, path, symbol): one location for each row of ``asked`` (ask, identity, at_repo, at_path, at_symbol, at_rev; all but the first two may be null).

    In this order: the place asked for at the revision asked for, the place at another revision, the repository at the
    revision, any place of the repository, and of what is left the latest commit, then crawl, then the greatest place.
    """
    seq = crawls(revisions).select("repo", "sha", "committed_at", "crawl_seq")
    at = places(locations).select("identity", "repo", "sha", "path", "symbol").distinct().join(seq, ["repo", "sha"])
    both = asked.join(at, "identity")
    same = (F.col("repo") == F.col("at_repo")) & (F.col("path") == F.col("at_path")) & F.col("symbol").eqNullSafe(F.col("at_symbol"))
    rev = F.startswith("sha", F.lower("at_rev")) & is_sha("at_rev")
    choice = F.when(same & rev, 0).when(same, 1).when((F.col("repo") == F.col("at_repo")) & rev, 2).when(F.col("repo") == F.col("at_repo"), 3).otherwise(4)
    order = F.struct(-choice, F.coalesce("committed_at", F.lit(-1)), "crawl_seq", "repo", "path", F.coalesce("symbol", F.lit("")))
    return both.groupBy("ask").agg(F.max_by(F.struct("repo", "sha", "path", "symbol"), order).alias("l")).select("ask", "l.*")


def page_objects(definitions: DataFrame, locations: DataFrame, revisions: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """Every page at its current places, as the object a resolver hands out.

    (address, entry, identity, kind, name, signature, docstring, lines, first, last, stdlib, third_party, links, refs): ``links`` and ``refs``
    hold structs of line (from 1 within the page), relation, address and description, by line and number.
    """
    at = registry_entry(current_places(locations, revisions), names)
    d = definitions_once(definitions).select("identity", "kind", F.col("name").alias("page_name"), "signature", "docstring", "lines", "imports")
    k = link_rows(links).join(links.select("link_seq", "description").dropDuplicates(["link_seq"]), "link_seq").select(F.col("source_identity").alias("identity"), "repo", "sha", F.col("file").alias("path"), "line", "relation", "target_address", "description", "link_seq")
    pages = at.join(d, "identity")
    own = pages.join(k, ["identity", "repo", "sha", "path"], "left").withColumn("at", F.col("line") - F.col("span_first") + 1)
    entry = F.struct("at", "link_seq", "relation", "target_address", "description")
    ref = F.col("relation") == "ref"
    told = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(x["at"].alias("line"), x["relation"].alias("relation"), x["target_address"].alias("address"), x["description"].alias("description")))
    key = ["repo", "sha", "path", "symbol", "identity", "entry", "kind", "page_name", "signature", "docstring", "lines", "span_first", "span_last", "imports"]
    got = own.groupBy(*key).agg(told(F.when(F.col("relation").isNotNull() & ~ref, entry)).alias("links"), told(F.when(ref, entry)).alias("refs"))
    return got.select(
        locator().alias("address"), "entry", "identity", "kind", F.col("page_name").alias("name"), "signature", "docstring", "lines", F.col("span_first").alias("first"), F.col("span_last").alias("last"),
        F.col("imports.stdlib").alias("stdlib"), F.col("imports.third_party").alias("third_party"), "links", "refs",
    )


def as_json(objects: DataFrame, version: str) -> DataFrame:
    """(address, json): objects as texts with a version stamp; nulls are written."""
    fields = [F.lit(version).alias("version"), *[F.col(c) for c in objects.columns]]
    return objects.select("address", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def definition_pages(prefixes: DataFrame, definitions: DataFrame, locations: DataFrame, revisions: DataFrame, links: DataFrame, listed: int = 10) -> DataFrame:
    """(prefix, matches, identities, kind, name, places, backlinks) for each distinct prefix of an identity, of 6 digits at least.

    ``identities`` lists the first ``listed`` that begin with it; the rest is told where just one does.
    """
    p = prefixes.select(identity_of("prefix").alias("prefix")).where("length(prefix) >= 6").distinct()
    d = merged_names(definitions)
    hit = p.join(d, (F.substring("prefix", 1, 6) == F.substring("identity", 1, 6)) & F.startswith("identity", F.col("prefix")))
    ranked = hit.withColumn("n", F.row_number().over(Window.partitionBy("prefix").orderBy("identity")))
    per = ranked.groupBy("prefix").agg(F.count("*").alias("matches"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= listed, F.col("identity")))), " ").alias("identities"), F.min(F.struct("identity", "kind", "name")).alias("one"))
    one = F.when(F.col("matches") == 1, F.col("one.identity"))
    held = places(locations).select("identity", "repo", "path", "symbol").distinct().groupBy("identity").agg(F.count("*").alias("places"))
    back = links.select(identity_of("target_identity").alias("identity"), "source_identity", "repo", "file").where("identity is not null").distinct().groupBy("identity").agg(F.count("*").alias("backlinks"))
    got = p.join(per, "prefix", "left").withColumn("identity", one).join(held, "identity", "left").join(back, "identity", "left")
    return got.select(
        "prefix", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("identities", F.lit("")).alias("identities"), F.when(one.isNotNull(), F.col("one.kind")).alias("kind"), F.when(one.isNotNull(), F.col("one.name")).alias("name"),
        F.when(one.isNotNull(), F.coalesce("places", F.lit(0))).alias("places"), F.when(one.isNotNull(), F.coalesce("backlinks", F.lit(0))).alias("backlinks"),
    )


def merged_names(definitions: DataFrame) -> DataFrame:
    return definitions.where("identity is not null").groupBy("identity").agg(F.min(F.struct((F.col("kind") == "script").cast("int").alias("last"), "kind", "name")).alias("m")).select("identity", "m.kind", "m.name")


def who_asked(addresses: DataFrame, definitions: DataFrame, locations: DataFrame, revisions: DataFrame, names: DataFrame, backlinks: DataFrame, current: DataFrame) -> DataFrame:
    """(address, source_identity, place, relation, origin, target_address, at): backlinks of each address, in the order of a list.

    A backlink counts whose target identity is the address's, or whose target is the same name, or the same place (repository,
    path and symbol) at any revision. ``backlinks`` is ``pages.who`` with its target fields, ``current`` are current places; ``place`` is that
    of the linking page, a definition before a file. ``at`` numbers an address's backlinks: relation (is, from, see, ref), asserted first, then repository, file and line.
    """
    told = resolve(addresses, definitions, locations, revisions, names)
    a = cut(told.select("address", "identity").withColumn("a", address("address")).where("a is not null"))
    at_place = a.where("a.form = 'locator'").select("address", F.col("a.locator").alias("l"), F.col("a.path").alias("p"), F.col("a.symbol").alias("s"))
    at_name = a.where("a.form = 'name'").select("address", F.col("a.name").alias("n"), F.col("a.symbol").alias("s"))
    row = ["source_identity", "repo", "file", "line", "relation", "origin", "target_address"]
    b = cut(backlinks.select(*row, "target_identity").withColumn("b", address("target_address")))
    by_id = a.where("identity is not null").select("address", F.col("identity").alias("target_identity")).join(b, "target_identity").select("address", *row)
    by_place = at_place.join(b, F.expr("b.locator = l and b.path = p and b.symbol <=> s")).select("address", *row)
    by_name = at_name.join(b, F.expr("b.name = n and b.symbol <=> s")).select("address", *row)
    every = by_id.unionByName(by_place).unionByName(by_name).distinct()
    spot = F.min_by(F.concat(F.concat_ws("/", "repo", "path"), F.coalesce(F.concat(F.lit("#"), F.col("symbol")), F.lit(""))), F.struct(F.col("symbol").isNull(), "repo", "path", "symbol"))
    held = current.groupBy(F.col("identity").alias("source_identity")).agg(spot.alias("place"))
    rank = F.array_position(F.array(*[F.lit(r) for r in RELATIONS]), F.col("relation"))
    w = Window.partitionBy("address").orderBy(rank, F.col("origin") != "asserted", "repo", "file", "line", "target_address", "source_identity")
    return every.join(held, "source_identity", "left").select("address", "source_identity", "place", "relation", "origin", "target_address", F.row_number().over(w).alias("at"))


def locations_in_order(locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(identity, repo, sha, path, symbol, at): locations of each identity by commit time (unknown first), crawl, and place."""
    seq = crawls(revisions).select("repo", "sha", "committed_at", "crawl_seq")
    w = Window.partitionBy("identity").orderBy(F.col("committed_at").asc_nulls_first(), "crawl_seq", "repo", "path", F.col("symbol").asc_nulls_first())
    at = places(locations).select("identity", "repo", "sha", "path", "symbol").distinct().join(seq, ["repo", "sha"])
    return at.select("identity", "repo", "sha", "path", "symbol", F.row_number().over(w).alias("at"))


def links_in_order(links: DataFrame) -> DataFrame:
    """(source_identity, repo, sha, link_seq, at): links of each page at each revision by line and number."""
    k = link_rows(links)
    w = Window.partitionBy("source_identity", "repo", "sha").orderBy("line", "link_seq")
    return k.select("source_identity", "repo", "sha", "link_seq", F.row_number().over(w).alias("at"))


def greatest_dups(groups: DataFrame, limit: int = 50) -> DataFrame:
    """The first ``limit`` duplicate groups: most places, most lines, then by their names and key."""
    return groups.orderBy(F.desc("places"), F.desc_nulls_last("lines"), "names", "key").limit(limit)


def top_level(locations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(repo, path, symbols): symbols of each current file that are no members of others, in the order of their spans, joined by commas."""
    at = current_places(locations, revisions).where("symbol is not null and not contains(symbol, '.')").select("repo", "path", "symbol", "span_first").distinct()
    spans = F.transform(F.array_sort(F.collect_list(F.struct("span_first", "symbol"))), lambda x: x["symbol"])
    return at.groupBy("repo", "path").agg(F.array_join(spans, ",").alias("symbols"))


def unregistered(requested: DataFrame, repos: DataFrame) -> DataFrame:
    """Requested repositories (column ``locator``) that are not registered."""
    return requested.select("locator").subtract(repos.select("locator"))
