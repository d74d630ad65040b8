"""A crawl from files to all tables of an index, on top of what the index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import closure, extraction, pages
from pagemill.session import cut

#: the tables that a crawl writes; ``registry_names`` is taken over as it is given
TABLES = ("definitions", "locations", "links", "revisions")


def crawl(held: dict[str, DataFrame] | None, files: DataFrame, revisions: DataFrame, names: DataFrame, force: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The index with more revisions in it, and counters of what was added to each (repo, sha).

    ``files`` are (repo, sha, path, text), ``revisions`` (repo, sha, committed_at, license, crawled_at). A revision the index
    holds is left alone, or with ``force`` replaced: its locations, links and revision row go first, its definitions stay. Of a
    definition the row that is held wins. ``files`` without a row in ``revisions`` are left out. Links that name no
    identity are looked up again in the whole index afterwards, as new pages can answer old links; a link
    that has an identity keeps it. Numbers of new rows follow those that are held.
    """
    fresh = revisions if force or not held else extraction.new_revisions(revisions, held["revisions"])
    fresh = fresh.dropDuplicates(["repo", "sha"])
    mine = files.join(fresh.select("repo", "sha"), ["repo", "sha"], "left_semi")
    found = cut(extraction.extract(mine))
    asked = cut(extraction.references(found, mine))
    told = extraction.exports(mine)
    meant = cut(extraction.forwarded(asked, told, mine))
    counted = mine.select("repo", "sha", "path").distinct().groupBy("repo", "sha").agg(F.count("*").cast("int").alias("files"))
    new = extraction.index_tables(found, meant, fresh.join(counted, ["repo", "sha"], "left"), mine)
    new["links"] = new["links"].withColumn("target_identity", F.lit(None).cast("string"))
    known = None
    if held:
        known = held["definitions"].select("identity").distinct()
        new["definitions"] = new["definitions"].join(known, "identity", "left_anti")
        if force:
            gone = fresh.select("repo", "sha")
            held = held | {t: held[t].join(gone, ["repo", "sha"], "left_anti") for t in ("locations", "links", "revisions")}
    for table, number in (("links", "link_seq"), ("revisions", "crawl_seq")):
        start = held[table].agg(F.coalesce(F.max(number), F.lit(0))).first()[0] if held else 0
        new[table] = cut(new[table].withColumn(number, F.monotonically_increasing_id() + 1 + start))
    out = {t: held[t].unionByName(new[t], allowMissingColumns=True) if held else new[t] for t in TABLES}
    out["definitions"], out["locations"] = cut(out["definitions"]), cut(out["locations"])
    answers = pages.resolve_targets(out["links"], out["definitions"], out["locations"], out["revisions"], names).withColumnRenamed("target_identity", "answer")
    linked = out["links"].join(answers, "link_seq", "left")
    out["links"] = linked.withColumn("target_identity", F.coalesce("target_identity", "answer")).drop("answer")
    return out | {"registry_names": names}, counters(new, asked, meant)


def counters(new: dict[str, DataFrame], asked: DataFrame, meant: DataFrame) -> DataFrame:
    """(repo, sha, pages, links, skipped, forwarded) of the revisions that were added; forwarded counts references that were followed further."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("repo", "sha").agg(F.count("*").alias(name))

    key = ["repo", "sha", "path", "symbol", "name", "target_path", "target_symbol"]
    moved = meant.select(*key).exceptAll(asked.select(*key))
    out = new["revisions"].select("repo", "sha", F.coalesce(F.size("skipped"), F.lit(0)).alias("skipped"))
    for df, name in ((new["locations"], "pages"), (new["links"], "links"), (moved, "forwarded")):
        out = out.join(count(df, name), ["repo", "sha"], "left")
    return out.na.fill(0, ["pages", "links", "forwarded"])


def page_edges(found: DataFrame, meant: DataFrame) -> DataFrame:
    """(source, target) identities of the references and is-links between pages of the same files; ``found`` are extracted pages, ``meant`` references."""
    p = found.where("kind is not null").select("repo", "sha", "path", "symbol", "identity")
    own = F.expr("r.repo = p.repo and r.sha = p.sha and r.path = p.path and r.symbol <=> p.symbol")
    there = F.expr("r.repo = t.repo and r.sha = t.sha and r.target_path = t.path and r.target_symbol <=> t.symbol")
    refs = meant.alias("r").join(p.alias("p"), own).join(p.alias("t"), there)
    return refs.where("p.symbol is not null").select(F.col("p.identity").alias("source"), F.col("t.identity").alias("target")).where("source <> target").distinct()


def live_closures(files: DataFrame, roots: DataFrame, most_pages: int = 50, most_lines: int = 2000) -> DataFrame:
    """(repo, sha, path, symbol, root, status, pages, lines, detail): closures of pages straight from files, and why one is refused.

    ``roots`` (repo, sha, path, symbol) name definitions of ``files`` (repo, sha, path, text). status, the first that applies: 'not found'; 'over budget';
    'clash' where two pages bind one name; 'free names' where nothing in the closure binds a name that it needs; 'ok'. ``detail`` lists
    those names.
    """
    found = cut(extraction.extract(files))
    meant = extraction.forwarded(extraction.references(found, files), extraction.exports(files), files)
    real = found.where("kind is not null")
    # a file of one definition has that definition's identity, and counts as it
    first = F.min_by(F.struct("kind", "name", "lines", "unresolved"), F.struct((F.col("kind") == "script").cast("int"), "repo", "sha", "path", "symbol"))
    d = real.groupBy("identity").agg(first.alias("d")).select("identity", "d.*")
    asked = roots.alias("a").join(real.alias("p"), F.expr("a.repo = p.repo and a.sha = p.sha and a.path = p.path and a.symbol <=> p.symbol"), "left").select("a.repo", "a.sha", "a.path", "a.symbol", F.col("p.identity").alias("root"))
    start = asked.where("root is not null").select("root").distinct()
    reached = cut(closure.reach(page_edges(found, meant), start, most_pages))
    sizes = closure.closure_sizes(reached, d, most_pages, most_lines).select("root", "pages", "lines", "within")
    listed = lambda df, name: df.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias(name))
    told = asked.join(sizes, "root", "left").join(listed(closure.name_clashes(reached, d), "clash"), "root", "left").join(listed(closure.free_names(reached, d), "free"), "root", "left")
    status = F.when(F.col("root").isNull(), "not found").when(~F.col("within"), "over budget").when(F.col("clash").isNotNull(), "clash").when(F.col("free").isNotNull(), "free names").otherwise("ok")
    return told.select("repo", "sha", "path", "symbol", "root", status.alias("status"), "pages", "lines", F.when(status == "clash", F.col("clash")).when(status == "free names", F.col("free")).alias("detail"))


def latest_in_tree(asked: DataFrame, head: DataFrame) -> DataFrame:
    """(repo, path, symbol, identity, rule, to_path, to_symbol, to_identity): what has become of pages in the files of a later revision.

    ``asked`` are (repo, path, symbol, identity), ``head`` extracted pages of one revision of each repository. Rule 'place': the place is still
    there, with whatever it holds now; 'identity': the same page stands elsewhere, one of the same last name before others, then by place;
    null: neither.
    """
    h = head.where("kind is not null").select("repo", F.col("path").alias("to_path"), F.col("symbol").alias("to_symbol"), F.col("identity").alias("to_identity"))
    a = asked.select("repo", "path", "symbol", "identity").distinct().alias("a")
    place = a.join(h.alias("h"), F.expr("a.repo = h.repo and a.path = h.to_path and a.symbol <=> h.to_symbol")).select("a.*", F.lit(0).alias("order"), "to_path", "to_symbol", "to_identity")
    last = lambda c: F.substring_index(c, ".", -1)
    same = a.join(h.alias("h"), F.expr("a.repo = h.repo and a.identity = h.to_identity")).select("a.*", F.when(last("a.symbol").eqNullSafe(last("h.to_symbol")), 1).otherwise(2).alias("order"), "to_path", "to_symbol", "to_identity")
    best = place.unionByName(same).groupBy("repo", "path", "symbol", "identity").agg(F.min(F.struct("order", "to_path", "to_symbol", "to_identity")).alias("b"))
    got = a.join(best.alias("g"), F.expr("a.repo = g.repo and a.path = g.path and a.symbol <=> g.symbol and a.identity = g.identity"), "left")
    return got.select("a.*", F.when(F.col("b.order") == 0, "place").when(F.col("b.order") > 0, "identity").alias("rule"), "b.to_path", "b.to_symbol", "b.to_identity")
