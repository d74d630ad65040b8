"""Mixing sources to target weights.

Tokens are summed per source, rates of repetition follow from the target shares, and
each document is used floor(rate) times plus once more with the probability of the
rest, drawn from a hash of its id.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut

#: where the vocabulary files of public tokenizers lie
TOKENIZERS = os.environ.get("PAGEMILL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed value: the pattern by which this vocabulary's tokenizer cuts a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: longer texts are handed to the tokenizer in pieces of at least this length, cut only between two words where it cuts itself
PIECE = 100_000
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces whose tokens are just those of the whole: a blank between two letters always begins a new word."""
    start = 0
    while len(text) - start > PIECE:
        m = _BETWEEN_WORDS.search(text, start + PIECE)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def token_counts(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of each document; source without case and outer spaces, null texts with 0 tokens."""
    path = os.path.join(tokenizers, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            sizes = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], schema=schema)

    source = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    rows = documents.select("doc_id", source.alias("source"), "text").where("doc_id is not null").distinct()
    return rows.mapInArrow(counted, "doc_id bigint, source string, tokens bigint")


def mix_rates(counts: DataFrame, targets: DataFrame, size: float | None = None) -> DataFrame:
    """(mix, source, share, max_repeats, available, rate) of every target.

    Shares are taken relative to the sum of those of a mix whose source has tokens. The
    mix is made as large as its shares and caps allow, but not larger than the tokens its sources
    have, or than ``size``; a larger ``size`` lets scarce sources stay at their cap. A
    source without tokens has rate 0; shares or caps that are null or not positive give 0 too. Of several rows of a
    mix and source the one of the largest share counts.
    """
    have = counts.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = (
        targets.select("mix", F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("source"), "share", "max_repeats")
        .groupBy("mix", "source").agg(F.max_by("max_repeats", F.struct("share", "max_repeats")).alias("max_repeats"), F.max("share").alias("share"))
    )
    t = wanted.join(have, "source", "left")
    live = (F.col("available") > 0) & (F.col("share") > 0) & (F.col("max_repeats") > 0)
    t = t.withColumn("part", F.when(live, F.col("share")))
    per_mix = t.groupBy("mix").agg(F.sum("part").alias("parts"), F.sum(F.when(live, F.col("available"))).alias("all"))
    t = t.join(per_mix, "mix").withColumn("part", F.col("part") / F.col("parts"))
    room = t.groupBy("mix").agg(F.min(F.col("max_repeats") * F.col("available") / F.col("part")).alias("room"))
    t = t.join(room, "mix")
    total = F.least("all", "room") if size is None else F.lit(float(size))
    rate = F.when(F.col("part").isNotNull(), F.least(F.col("part") * total / F.col("available"), F.col("max_repeats").cast("double")))
    return t.select("mix", "source", "share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mixed(counts: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """(mix, doc_id, source, tokens, copies) of the documents that a mix uses at least once.

    The draw depends on mix, id and seed alone, so a rerun or another partitioning gives the same mix.
    """
    share = F.pmod(F.xxhash64(F.lit(seed), "mix", "doc_id"), F.lit(2**53)) / F.lit(float(2**53))
    whole = F.floor("rate")
    copies = (whole + (share < F.col("rate") - whole).cast("int")).cast("int")
    return (
        counts.join(rates.where("rate > 0").select("mix", "source", "rate"), "source")
        .select("mix", "doc_id", "source", "tokens", copies.alias("copies")).where("copies > 0")
    )


def mix_report(counts: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 0) -> DataFrame:
    """Per mix and source: target share, available tokens, rate, documents used, tokens and share reached."""
    rates = mix_rates(counts, targets, size)
    used = mixed(counts, rates, seed).groupBy("mix", "source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    r = rates.join(used, ["mix", "source"], "left").na.fill(0, ["documents", "tokens"])
    total = r.groupBy("mix").agg(F.sum("tokens").alias("total"))
    return r.join(total, "mix").select(
        "mix", "source", "share", "max_repeats", "available", "rate", "documents", "tokens", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).alias("reached")
    )


def counted(documents: DataFrame, **where: str) -> DataFrame:
    """``token_counts``, kept in the checkpoint folder for the passes that follow."""
    return cut(token_counts(documents, **where))
