"""What pages need: transitive references, by rounds over the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut
from pagemill.tables import identity_of


def edges(links: DataFrame) -> DataFrame:
    """(source, target) of the is-links and references with an identity, without self references."""
    return (
        links.where("relation in ('is', 'ref') and target_identity is not null")
        .select(F.col("source_identity").alias("source"), identity_of("target_identity").alias("target")).where("source <> target").distinct()
    )


def reach(pairs: DataFrame, roots: DataFrame | None = None, most_pages: int | None = None) -> DataFrame:
    """(root, page) of everything that roots (all sources, if none are given) reach, themselves included.

    Each round joins only what the last one added and drops what is known, so rings end and
    a round costs what it finds; frontiers are written to the checkpoint folder once each and never again. With
    ``most_pages`` a root whose closure has more pages goes no further: its rows then are those found
    so far, more than ``most_pages``.
    """
    pairs = cut(pairs)
    start = (roots if roots is not None else pairs.select(F.col("source").alias("root"))).distinct()
    frontier = cut(start.select("root", F.col("root").alias("page")))
    known = frontier
    while True:
        going = frontier
        if most_pages is not None:
            over = known.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most_pages)
            going = frontier.join(over, "root", "left_anti")
        step = going.join(pairs, F.col("page") == F.col("source")).select("root", F.col("target").alias("page")).distinct()
        frontier = cut(step.join(known, ["root", "page"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def budgeted(pairs: DataFrame, roots: DataFrame, definitions: DataFrame, most_pages: int = 50, most_lines: int = 2000) -> DataFrame:
    """(root, pages, lines, missing, within) of closures that are followed only as far as the budget goes; the counts of one beyond it are null."""
    told = closure_sizes(reach(pairs, roots, most_pages), definitions, most_pages, most_lines)
    inside = F.col("pages") <= most_pages
    return told.select("root", *[F.when(inside, F.col(c)).alias(c) for c in ("pages", "lines", "missing")], "within")


def ordered(pairs: DataFrame, reached: DataFrame, most_pages: int = 50) -> DataFrame:
    """(root, page, place): closures of at most ``most_pages`` pages in the order of writing, what a page needs before the page, the root last.

    Depth first, targets by identity; of a ring the page met first comes last. Larger closures, which are refused anyway, are left out,
    so that what one task holds is bounded.
    """
    small = reached.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= most_pages).select("root")
    mine = reached.join(small, "root")
    inner = mine.join(pairs, F.col("page") == F.col("source"), "left").groupBy("root", "page").agg(F.array_sort(F.collect_set("target")).alias("needs"))

    def walk(key, rows):
        import pandas as pd

        needs = dict(zip(rows["page"], rows["needs"]))
        root, done, out = key[0], {key[0]}, []
        todo = [(root, iter(needs.get(root, ())))]
        while todo:
            page, rest = todo[-1]
            nxt = next((t for t in rest if t in needs and t not in done), None)
            if nxt is None:
                out.append(page)
                todo.pop()
            else:
                done.add(nxt)
                todo.append((nxt, iter(needs[nxt])))
        return pd.DataFrame({"root": root, "page": out, "place": range(1, len(out) + 1)})

    return inner.groupBy("root").applyInPandas(walk, "root string, page string, place int")


def free_names(reached: DataFrame, definitions: DataFrame) -> DataFrame:
    """(root, name): names that pages of a closure need and none of its pages binds; such a closure is refused."""
    d = definitions.dropDuplicates(["identity"]).select(F.col("identity").alias("page"), "kind", "name", "unresolved")
    both = reached.join(d, "page")
    needs = both.select("root", F.explode("unresolved").alias("name")).distinct()
    return needs.join(both.where("kind <> 'script'").select("root", "name").distinct(), ["root", "name"], "left_anti")


def closure_nodes(reached: DataFrame, definitions: DataFrame, names: DataFrame, places: DataFrame) -> DataFrame:
    """(root, page, defines, description, place): what each page of a closure binds, what is said of it, and one current place of it.

    ``defines`` is the first part of the symbol; the description is that of the registry entry for the place, else the docstring, else the signature.
    """
    d = definitions.dropDuplicates(["identity"]).select(F.col("identity").alias("page"), "kind", "name", "signature", "docstring")
    at = places.groupBy(F.col("identity").alias("page")).agg(F.min(F.struct("repo", "path", F.coalesce("symbol", F.lit("")).alias("symbol"))).alias("at"))
    said = names.where("description is not null").groupBy("target").agg(F.min_by("description", "registry").alias("said"))
    both = reached.join(d, "page").join(at, "page", "left").withColumn("target", F.concat_ws("/", "at.repo", "at.path")).join(said, "target", "left")
    binds = F.when(F.col("kind") != "script", F.coalesce(F.nullif(F.substring_index("at.symbol", ".", 1), F.lit("")), F.col("name")))
    return both.select("root", "page", binds.alias("defines"), F.coalesce("said", F.nullif(F.trim("docstring"), F.lit("")), "signature").alias("description"), F.col("target").alias("place"))


def closure_sizes(reached: DataFrame, definitions: DataFrame, most_pages: int = 50, most_lines: int = 2000) -> DataFrame:
    """Per root: pages and lines of its closure, pages without a row, and whether it stays within the budget."""
    d = definitions.dropDuplicates(["identity"]).select(F.col("identity").alias("page"), "lines")
    return (
        reached.join(d, "page", "left").groupBy("root")
        .agg(F.count("*").alias("pages"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.count_if(F.col("lines").isNull()).alias("missing"))
        .withColumn("within", (F.col("pages") <= most_pages) & (F.col("lines") <= most_lines))
    )


def name_clashes(reached: DataFrame, definitions: DataFrame) -> DataFrame:
    """(root, name, pages): names that several pages of one closure bind."""
    d = definitions.where("kind <> 'script' and name is not null").dropDuplicates(["identity"]).select(F.col("identity").alias("page"), "name")
    return reached.join(d, "page").groupBy("root", "name").agg(F.count("*").alias("pages")).where("pages > 1")


def requirements(reached: DataFrame, definitions: DataFrame) -> DataFrame:
    """(root, stdlib, third_party): the modules that a closure imports, sorted, joined by commas."""
    d = definitions.dropDuplicates(["identity"]).select(F.col("identity").alias("page"), "imports.stdlib", "imports.third_party")
    both = reached.join(d, "page")
    parts = [
        both.select("root", F.lit(name).alias("of"), F.explode(name).alias("module")).distinct()
        for name in ("stdlib", "third_party")
    ]
    rows = parts[0].unionByName(parts[1])
    listed = lambda of: F.array_join(F.array_sort(F.collect_list(F.when(F.col("of") == of, F.col("module")))), ",")
    return rows.groupBy("root").agg(listed("stdlib").alias("stdlib"), listed("third_party").alias("third_party"))


def files_of(reached: DataFrame, places: DataFrame) -> DataFrame:
    """(root, page): the whole-file pages in which the pages of each closure stand; ``places`` are places of both."""
    at = places.select(F.col("identity").alias("page"), "repo", "sha", "path")
    whole = places.where("symbol is null").select(F.col("identity").alias("file"), "repo", "sha", "path")
    return reached.join(at.join(whole, ["repo", "sha", "path"]).select("page", "file").distinct(), "page").select("root", F.col("file").alias("page")).distinct()


def names_of_roots(links: DataFrame) -> DataFrame:
    """Sources of asserted is-links: the pages whose closure an expansion would write."""
    return links.where("relation = 'is' and origin = 'asserted'").select(F.col("source_identity").alias("root")).distinct()
