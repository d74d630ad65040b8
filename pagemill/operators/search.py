"""Text search over names, symbols, signatures and docstrings, ranked by bm25."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.stemming import stems
from pagemill.session import cut

K1, B = 1.2, 0.75
COLUMNS = ("name", "symbol", "signature", "docstring")


def search_documents(definitions: DataFrame, locations: DataFrame) -> DataFrame:
    """(identity, name, symbol, signature, docstring): one row for every symbol under which an identity stands."""
    d = definitions.dropDuplicates(["identity"]).select("identity", "name", "signature", "docstring")
    return locations.select("identity", "symbol").distinct().join(d, "identity").select("identity", *COLUMNS)


def terms(documents: DataFrame) -> DataFrame:
    """(identity, symbol, column, position, term): runs of letters and digits in lower case, without diacritics, stemmed.

    ``position`` goes on over the parts of a word such as ``read_temp``. Nulls have no terms.
    """
    fields = pa.schema([("identity", pa.string()), ("symbol", pa.string()), ("column", pa.string()), ("position", pa.int32()), ("term", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, *columns = (c.to_pylist() for c in b.columns)
            rows: list[tuple] = []
            for n, identity in enumerate(ids):
                symbol = columns[COLUMNS.index("symbol")][n]
                for name, values in zip(COLUMNS, columns):
                    rows += [(identity, symbol, name, k, w) for k, w in enumerate(stems(values[n]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields.types)] if rows else [pa.array([], t) for t in fields.types], schema=fields)

    return documents.select("identity", *COLUMNS).mapInArrow(split, "identity string, symbol string, column string, position int, term string")


def search(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(identity, symbol, score) of the documents that hold a stem beginning with that of every term of the query, best first.

    The score is the sum over terms of idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean length)), frequencies and
    lengths over all columns; the idf is at least 1e-6. Lengths and counts are of all documents. A
    document stands for an (identity, symbol); ties go to the lower identity. A blank query is an error.
    """
    asked = sorted({words[-1] for t in query.split() if (words := stems(t))})
    phrases = sorted({tuple(words) for t in query.split() if len(words := stems(t)) > 1})
    if not asked:
        raise ValueError("search needs some text")
    words = terms(documents)
    key = ["identity", "symbol"]
    hit = F.array(*[F.when(F.startswith("term", F.lit(t)), F.lit(t)) for t in asked])
    per = words.withColumn("hits", F.filter(hit, lambda x: x.isNotNull())).groupBy(*key).agg(
        F.count("*").alias("length"), *[F.count_if(F.array_contains("hits", t)).alias(f"f{i}") for i, t in enumerate(asked)]
    )
    per = cut(per)  # one small row a document, for the statistics and for the ranking
    total = documents.select(*key).distinct().count()
    stats = per.agg(F.sum("length").alias("all"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(asked))]).first()
    mean = (stats["all"] or 0) / max(1, total)
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(asked)):
        n = stats[f"n{i}"]
        idf = F.greatest(F.log((F.lit(float(total)) - n + 0.5) / (F.lit(float(n)) + 0.5)), F.lit(1e-6))
        f = F.col(f"f{i}").cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / max(mean, 1e-9)))
        every = every & (F.col(f"f{i}") > 0)
    found = per.where(every)
    for phrase in phrases:  # a word such as read_temp asks for its parts one after the other
        spot = words.alias("w0").where(F.col("w0.term") == phrase[0])
        for n, part in enumerate(phrase[1:], 1):
            fits = F.startswith(F.col(f"w{n}.term"), F.lit(part)) if n == len(phrase) - 1 else F.col(f"w{n}.term") == part
            at = F.expr(f"w0.identity = w{n}.identity and w0.symbol <=> w{n}.symbol and w0.column = w{n}.column and w{n}.position = w0.position + {n}")
            spot = spot.join(words.alias(f"w{n}").where(fits), at, "left_semi")
        spot = spot.select(F.col("w0.identity").alias("i"), F.col("w0.symbol").alias("s")).distinct()
        found = found.join(spot, F.expr("identity = i and symbol <=> s"), "left_semi")
    return found.select(*key, score.alias("score")).orderBy(F.desc("score"), "identity", "symbol").limit(limit)
