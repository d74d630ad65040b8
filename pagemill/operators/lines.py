"""How much of a corpus of code is said twice, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_.]*|\"[^\"]*\"|'[^']*'|[^\sA-Za-z0-9_]"
_WORDS = r"^[A-Za-z_]"


def line_keys(files: DataFrame) -> DataFrame:
    """(file, row, tokens, verbatim, shape) of the substantive lines of files (file, text).

    A line counts when it has a token that is no punctuation and it includes nothing. Its verbatim key is its
    tokens; in its shape names are numbered by first appearance and literals have no value.
    """
    rows = files.where("text is not null").select("file", F.posexplode(F.split("text", "\\r\\n|\\r|\\n", -1)).alias("row", "line")).where("not line like '#include%'")
    rows = rows.withColumn("t", F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).where(F.exists("t", lambda x: x.rlike(r"[A-Za-z0-9_]")))
    names = F.array_distinct(F.filter("t", lambda x: x.rlike(_WORDS)))
    rows = rows.withColumn("names", names)
    shape = F.transform(
        "t",
        lambda x: F.when(x.rlike(_WORDS), F.concat(F.lit("$"), F.array_position("names", x) - 1)).when(x.rlike("^[0-9]"), "<num>").when(x.rlike("^[\"'].*[\"']$") & (F.length(x) > 1), "<str>").otherwise(x),
    )
    return rows.select("file", "row", F.size("t").alias("tokens"), F.array_join("t", " ").alias("verbatim"), F.array_join(shape, " ").alias("shape"))


def duplication(keys: DataFrame, thresholds: tuple[int, ...] = (1, 3, 5, 8)) -> DataFrame:
    """(least, lines, shape_percent, verbatim_percent): the share of lines of at least so many tokens whose key stands in another file too.

    A key tells its number of tokens, so one pass a key counts its lines and says whether two files have it.
    """

    def repeated(key: str) -> DataFrame:
        per = keys.groupBy(key).agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"), F.min("file").alias("a"), F.max("file").alias("b"))
        return per.where("a <> b").groupBy("tokens").agg(F.sum("n").alias(key))

    by = keys.groupBy("tokens").agg(F.count("*").alias("n")).join(repeated("shape"), "tokens", "left").join(repeated("verbatim"), "tokens", "left").na.fill(0)
    least = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("least")
    t = by.select("*", least).where("tokens >= least").groupBy("least").agg(F.sum("n").alias("lines"), F.sum("shape").alias("shape"), F.sum("verbatim").alias("verbatim"))
    percent = lambda c: F.round(100 * F.col(c) / F.col("lines"), 1).alias(f"{c}_percent")
    return t.select("least", "lines", percent("shape"), percent("verbatim"))
