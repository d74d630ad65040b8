"""Abusive, hateful or sexual content, by the nearest labelled examples.

Texts are split into sentences of undisguised words. The examples are sentences of labelled
documents and nothing else. A document judged harmful does not say which of its sentences is meant, and its
judge may have erred: the label is laid on those of its sentences whose nearest labelled
neighbours, each vote weighted by its distance, agree with it more than they do not. Every
sentence of the corpus is then compared with the examples by exact TF-IDF cosine through
a block-max index; the votes of the nearest give its score, and a document's score is that of its
worst sentence, which is kept as evidence together with the nearest example.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.plaintext import plain_words, sentences
from pagemill.session import cut, spread

#: labelled documents the examples are taken from, at most, and the sentences of these together; beyond either the documents least by a hash of their id
MAX_LABELLED, MAX_SENTENCES = 20_000, 400_000
#: rarer words than one in this many distinct sentences count as alike rare, so that the words with a frequency of their own are few
RAREST = 10_000
#: neighbours that vote on a sentence, and on where a label lies, and the least similarity of one
NEIGHBOURS, AGREEING, NEAR = 10, 20, 0.3
#: share of the votes from which a label lies on a sentence
AGREED = 0.6
#: weight of the base rate in a sentence's score
PRIOR = 1.0
#: score from which a document is listed for review
REVIEW = 0.35
#: examples of one block of the index; bounds of so many words and blocks are held as a table
BLOCK, DENSE = 16, 4_000_000


class Weights:
    """Unit TF-IDF vectors; frequencies are shares of the distinct sentences."""

    def __init__(self, frequent: dict[str, int], total: int):
        self.rare = math.log((total + 1) / (max(1.0, total / RAREST) + 0.5)) + 1
        self.idf = {w: math.log((total + 1) / (n + 0.5)) + 1 for w, n in frequent.items()}

    def vector(self, words: list[str]) -> dict[str, float]:
        idf, rare = self.idf, self.rare
        v = {w: idf.get(w, rare) for w in words}
        if len(v) < len(words):
            for w, n in Counter(words).items():
                v[w] *= 1 + math.log(n)
        norm = math.sqrt(sum([x * x for x in v.values()])) or 1.0
        return {w: x / norm for w, x in v.items()}


class BlockMax:
    """Examples in blocks, with the largest weight of each word in each block; ``top`` is exact."""

    def __init__(self, examples: list[list[str]], weights: Weights):
        vectors = [weights.vector(e) for e in examples]
        # texts with the same frequent words, which are of one make, stand together, so that few blocks hold what is near one
        order = sorted(range(len(examples)), key=lambda i: (sorted(vectors[i], key=lambda w: (vectors[i][w], w)), i))
        self.number = np.array(order, np.int64)
        self.words = {w: n for n, w in enumerate(sorted({w for v in vectors for w in v}))}
        sizes = [len(vectors[i]) for i in order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.cols = np.array([self.words[w] for i in order for w in vectors[i]], np.int32)
        self.vals = np.array([x for i in order for x in vectors[i].values()])
        self.blocks = -(-len(order) // BLOCK)
        at = np.repeat(np.arange(len(order)) // BLOCK, sizes)
        by = np.lexsort((at, self.cols))
        cols, at, vals = self.cols[by], at[by], self.vals[by]
        new = np.flatnonzero(np.concatenate([[True], (cols[1:] != cols[:-1]) | (at[1:] != at[:-1])])) if len(cols) else np.array([], np.int64)
        self.block = at[new].astype(np.int32)
        self.bound = np.maximum.reduceat(vals, new) if len(new) else vals
        self.lists = np.searchsorted(cols[new], np.arange(len(self.words) + 1))
        most = np.maximum.reduceat(self.bound, self.lists[:-1]).tolist() if len(new) else []
        self.most = {w: most[n] for w, n in self.words.items()}
        self.query = np.zeros(len(self.words))
        self.table: np.ndarray | None = None
        if len(self.words) * self.blocks <= DENSE:
            self.table = np.zeros((len(self.words), self.blocks))
            self.table[cols[new], self.block] = self.bound

    def near(self, vector: dict[str, float], least: float = NEAR) -> bool:
        """Whether anything can be as near as ``least``: by the most each word adds, and as examples are of length one."""
        most, sum_, square = self.most, 0.0, 0.0
        for w, x in vector.items():
            if w in most:
                sum_ += x * most[w]
                square += x * x
        return sum_ >= least - 1e-9 and square >= (least - 1e-9) ** 2

    def top(self, vector: dict[str, float], k: int, least: float = NEAR) -> list[tuple[float, int]]:
        """The ``k`` examples of largest cosine, of at least ``least``; ties to the lower number."""
        if not self.near(vector, least):
            return []
        known = [(self.words[w], x) for w, x in vector.items() if w in self.words]
        ids, weights = [n for n, _ in known], [x for _, x in known]
        bar = least - 1e-9
        if self.table is not None:
            bounds = np.dot(weights, self.table[ids])
        else:
            bounds = np.zeros(self.blocks)
            for n, x in known:
                a, b = self.lists[n], self.lists[n + 1]
                bounds[self.block[a:b]] += x * self.bound[a:b]
        if bounds.max() < bar:
            return []
        todo = np.flatnonzero(bounds >= bar)
        todo = todo[np.argsort(-bounds[todo], kind="stable")]
        self.query[ids] = weights
        found, scores = np.array([], np.int64), np.array([])
        for b in todo.tolist():
            if bounds[b] < bar:
                break
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.number))
            s, e = self.starts[lo], self.starts[hi]
            got = np.add.reduceat(self.query[self.cols[s:e]] * self.vals[s:e], self.starts[lo:hi] - s)
            fit = np.flatnonzero(got >= bar)
            if len(fit):
                found, scores = np.concatenate([found, self.number[lo + fit]]), np.concatenate([scores, got[fit]])
                if len(scores) >= k:
                    bar = max(bar, float(np.partition(scores, len(scores) - k)[len(scores) - k]) - 1e-9)
                    kept = scores >= bar
                    found, scores = found[kept], scores[kept]
        self.query[ids] = 0
        order = np.lexsort((found, -scores.round(12)))[:k]
        return [(float(scores[i]), int(found[i])) for i in order if scores[i] >= least - 1e-9]


class Judge:
    """Scores sentences by their nearest examples, given as (words, harmful documents, harmless documents) of labelled sentences."""

    def __init__(self, labelled: list[tuple[str, int, int]], frequent: dict[str, int], total: int, base: float):
        self.base = base
        self.weights = Weights(frequent, total)
        self.vocabulary = Counter()
        for words, pos, neg in labelled:
            for w in words.split(" "):
                if "*" not in w:
                    self.vocabulary[w] += pos - neg
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.vocabulary):
            self.by_length.setdefault(len(w), []).append(w)
        self.filled: dict[str, str] = {}
        self.known: dict[str, tuple[float, str | None]] = {}
        labelled = sorted(labelled)
        texts = [self.read(words.split(" ")) for words, _, _ in labelled]
        self.every = BlockMax(texts, self.weights)
        harmful = [n for n, (_, pos, _) in enumerate(labelled) if pos and self._agreed(texts[n], labelled)]
        self.names = [labelled[n][0] for n in harmful]
        # a label that does not lie on a sentence is no vote for it
        lies = set(harmful)
        self.votes = [(pos if n in lies else 0, neg) for n, (_, pos, neg) in enumerate(labelled)]
        self.harmful = BlockMax([texts[n] for n in harmful], self.weights)
        # of each word: its square weight, and with what the harmful examples make of it
        self.quick = {w: (x * x, x * self.harmful.most.get(w, 0.0)) for w, x in self.weights.idf.items()}
        for w, most in self.harmful.most.items():
            self.quick.setdefault(w, (self.weights.rare**2, self.weights.rare * most))
        self.unknown = (self.weights.rare**2, 0.0)

    def _agreed(self, words: list[str], labelled: list[tuple[str, int, int]]) -> bool:
        near = self.every.top(self.weights.vector(words), AGREEING)
        pos = sum(s * s * labelled[n][1] for s, n in near)
        neg = sum(s * s * labelled[n][2] for s, n in near)
        return pos >= AGREED * (pos + neg) > 0

    def read(self, words: list[str]) -> list[str]:
        """A sentence's words; starred and run-together ones are read by the words of labelled sentences."""
        out = []
        for w in words:
            if ("*" in w or len(w) > 11) and w not in self.vocabulary:
                if len(self.filled) >= 100_000:
                    self.filled.clear()
                if w not in self.filled:
                    self.filled[w] = self._fill(w) if "*" in w else " ".join(self._split(w) or [w])
                out += self.filled[w].split(" ")
            else:
                out.append(w)
        return out

    def _fill(self, word: str) -> str:
        shape = re.compile("".join("." if c == "*" else re.escape(c) for c in word) + r"\Z")
        return max((w for w in self.by_length.get(len(word), ()) if shape.match(w)), key=lambda w: (self.vocabulary[w], w), default=word)

    def _split(self, word: str) -> list[str] | None:
        """Known words that a run of letters is made of, the fewest."""
        best: list[list[str] | None] = [[]] + [None] * len(word)
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - 20), i - 1):
                part = word[j:i]
                if best[j] is not None and part in self.vocabulary and (best[i] is None or len(best[j]) + 1 < len(best[i])):
                    best[i] = [*best[j], part]
        return best[-1] if best[-1] and len(best[-1]) <= 6 else None

    def score(self, words: str) -> tuple[float, str | None]:
        """Score of a sentence, 0 where no harmful example is near, and the nearest harmful example."""
        read = words.split(" ")
        if "*" in words or max(map(len, read)) > 11:
            read = self.read(read)
        if not self._may_be_near(read):
            return 0.0, None
        got = self.known.get(words)
        if got is None:
            got = self._score(self.weights.vector(read))
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[words] = got
        return got

    def _may_be_near(self, words: list[str]) -> bool:
        """Whether a harmful example can be near, by the most each word adds; for repeated words their counts add as well."""
        square = most = known = 0.0
        quick, unknown = self.quick, self.unknown
        for w in words:
            xx, x = quick.get(w, unknown)
            square += xx
            if x:
                most += x
                known += xx
        bar = (NEAR - 1e-9) ** 2 * square
        return most * most >= bar and known >= bar or len(set(words)) < len(words)

    def _score(self, vector: dict[str, float]) -> tuple[float, str | None]:
        near = self.harmful.top(vector, 1)
        if not near:
            return 0.0, None
        pos = neg = 0.0
        for s, n in self.every.top(vector, NEIGHBOURS):
            p, q = self.votes[n]
            pos += s * s * p
            neg += s * s * q
        return (pos + self.base * PRIOR) / (pos + neg + PRIOR), self.names[near[0][1]]


def tokenized(documents: DataFrame) -> DataFrame:
    """(doc_id, sentences) of every row with words, in the order of the text; a sentence is its words with blanks between."""
    schema = pa.schema([("doc_id", pa.int64()), ("sentences", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, held = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [" ".join(w) for s in sentences(text or "") if (w := plain_words(s))]
                if words:
                    ids.append(doc)
                    held.append(words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), pa.array(held, schema.types[1])], schema=schema)

    return spread(documents.select("doc_id", "text").where("length(trim(text)) > 0")).mapInArrow(split, "doc_id bigint, sentences array<string>")


def judgements(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the mean of a document's distinct judgements; nulls and even splits do not count."""
    each = labels.where("toxic is not null and doc_id is not null").select("doc_id", "annotator", "toxic").distinct()
    return each.groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where("toxic <> 0.5").withColumn("toxic", F.col("toxic") > 0.5)


def word_counts(tokens: DataFrame) -> tuple[dict[str, int], int]:
    """How many distinct sentences of the corpus hold a word, for words in more than one of RAREST, and how many sentences there are.

    At most RAREST times the mean words of a sentence have an entry, however large the corpus is.
    """
    # copies of a sentence count once; the word '', which no sentence has, counts the sentences
    each = tokens.select(F.explode("sentences").alias("s")).distinct().select(F.explode(F.array_append(F.array_distinct(F.split("s", " ")), F.lit(""))).alias("word"))
    counts = cut(each.groupBy("word").agg(F.count("*").alias("n")))
    total = next((r.n for r in counts.where("word = ''").collect()), 0)
    return {r.word: r.n for r in counts.where((F.col("n") > total / RAREST) & (F.col("word") != "")).collect()}, total


def fit(tokens: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_sentences: int = MAX_SENTENCES) -> Judge:
    """Examples from at most ``max_labelled`` labelled documents with ``max_sentences`` sentences; word counts from all of ``tokens``."""
    sample = judgements(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    held = cut(tokens.join(sample, "doc_id").select("doc_id", "toxic", F.array_distinct("sentences").alias("sentences")))
    # rows of at most max_labelled documents; those are kept whose sentences together are within the bound
    room, kept, harmful = max_sentences, [], 0
    for r in held.groupBy("doc_id").agg(F.sum(F.size("sentences")).alias("n"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= room:
            room -= r.n
            kept.append((r.doc_id,))
            harmful += r.toxic
    chosen = held.join(tokens.sparkSession.createDataFrame(kept, "doc_id bigint"), "doc_id").select("doc_id", "toxic", F.explode("sentences").alias("s")).distinct()
    labelled = chosen.groupBy("s").agg(F.count_if("toxic").cast("int").alias("pos"), F.count_if(~F.col("toxic")).cast("int").alias("neg")).collect()
    return Judge([tuple(r) for r in labelled], *word_counts(tokens), (harmful + 1) / (len(kept) + 10))


def abuse_scores(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, sentences, evidence, example) for every document with words: its worst sentence's score from 0 to 1.

    ``sentences`` counts those at or above REVIEW, ``evidence`` holds the words of the worst and ``example`` those of the
    labelled sentence nearest to it. Null, blank and wordless texts have no row; repeated rows count once, of
    several texts with one id the worst counts; without labels every score is 0; labels of documents that do
    not exist are ignored; ties go to the earlier sentence.
    """
    tokens = cut(tokenized(documents))
    judge = documents.sparkSession.sparkContext.broadcast(fit(tokens, labels, max_labelled))
    fields = "doc_id bigint, score double, sentences int, evidence string, example string"
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("sentences", pa.int32()), ("evidence", pa.string()), ("example", pa.string())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = judge.value.score
        for b in batches:
            rows = []
            for doc, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = [(*score(s), s) for s in held]
                worst = max(got, key=lambda x: x[0])
                rows.append((doc, worst[0], sum(x[0] >= REVIEW for x in got), *((worst[2], worst[1]) if worst[0] >= REVIEW else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    scored = tokens.mapInArrow(judged, fields)
    return scored.groupBy("doc_id").agg(F.max(F.struct("score", "sentences", "evidence", "example")).alias("w")).select("doc_id", "w.*")


def abuse_rates(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, documents to review and mean score per source (read without case and outer spaces; '' for none)."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit(""))
    rows = documents.select("doc_id", source.alias("source")).distinct()
    return (
        rows.join(scores, "doc_id", "left").groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= REVIEW).alias("review"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"))
        .withColumn("rate", F.col("review") / F.col("documents"))
    )


def calibration(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents by tenths of the score: how many, and the share judged harmful. Judges err, so that share is no precision."""
    return (
        scores.join(judgements(labels), "doc_id").groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int").alias("tenth"))
        .agg(F.count("*").alias("labelled"), F.avg(F.col("toxic").cast("double")).alias("judged_harmful"), F.avg("score").alias("mean_score"))
    )
