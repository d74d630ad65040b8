"""Leaks, mixing and abuse."""

import random
import re

import pytest

from pagemill.llm import abuse as A
from pagemill.llm import leakage as L
from pagemill.llm import mixing as M
from pagemill.llm import plaintext as T


def words(t):
    return re.findall(r"[a-z0-9]+", re.sub(r"[^A-Za-z0-9]", " ", t).lower())


def test_leaks_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünder", "the", "K"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 40)))) for i in range(30)] + [(99, None), (98, ""), (3, "again the same")]
    docs = []
    for d in range(120):
        t = [r.choice(vocabulary) for _ in range(60)]
        if r.random() < 0.6:
            w = r.choice(items[:30])[1].split()
            n = r.randrange(9, 16)
            k = r.randrange(max(1, len(w) - n))
            t[20:20] = w[k : k + n]
        docs.append((d, r.choice([" ", "\n> ", " -- ", "_"]).join(x.upper() if r.random() < 0.2 else x for x in t), "x"))
    docs += [(500, None, "x"), (501, "", "x"), docs[0]]
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = got.collect()
    runs = {i: {tuple(words(t)[k : k + 12]) for i2, t in items if i2 == i and t for k in range(len(words(t)) - 11)} for i, _ in items}
    want = {(d, i) for d, t, _ in docs if t for i, rs in runs.items() if rs & {tuple(words(t)[k : k + 12]) for k in range(len(words(t)) - 11)}}
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(rows) == len(want) > 5
    texts = {d: t for d, t, _ in docs}
    for x in rows:
        hit = words(texts[x.doc_id][x.start : x.stop])
        assert len(hit) == x.words >= 12 and tuple(hit[:12]) in runs[x.item_id]


def test_leaks_empty_and_long(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    item = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id bigint, text string")
    assert L.leaked_items(none, item).collect() == [] and L.leaked_items(none, item.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "filler " * 300_000 + " ".join(f"Q{i}" for i in range(30)))], "doc_id bigint, text string")
    assert [(r.words, r.start) for r in L.leaked_items(long, item).collect()] == [(30, 7 * 300_000)]
    assert L.leaked_items(long, item.limit(0)).collect() == []


def test_mix(spark):
    r = random.Random(2)
    docs = [(i, "word " * r.randrange(1, 60), s, "x") for i, s in enumerate(r.choices(["Big ", "big", " SMALL"], [10, 10, 1], k=1500))] + [(9000, None, "big", "x"), (9001, "text", None, "x")]
    docs += [docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens string")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.3, 4), ("m", "absent", 0.2, 3), ("n", "big", None, 2), ("n", "small", 0.1, 1), ("n", "small", 0.1, 1)], "mix string, source string, share double, max_repeats int")
    counts = M.counted(df)
    report = {(x.mix, x.source): x for x in M.mix_report(counts, targets).collect()}
    assert abs(report["m", "big"].reached - 0.625) < 0.05 and abs(report["m", "small"].reached - 0.375) < 0.05 and report["m", "absent"].tokens == 0
    assert report["n", "big"].tokens == 0 and report["n", "small"].rate == 1.0 and report["n", "small"].reached == 1.0
    used = M.mixed(counts, M.mix_rates(counts, targets)).collect()
    caps = {("m", "big"): 1, ("m", "small"): 4, ("n", "small"): 1}
    assert all(1 <= x.copies <= caps[x.mix, x.source] for x in used)
    again = M.mixed(counts.repartition(7), M.mix_rates(counts, targets)).collect()
    assert {(x.mix, x.doc_id): x.copies for x in again} == {(x.mix, x.doc_id): x.copies for x in used}
    small = {x.doc_id: x.tokens for x in counts.where("source = 'small'").collect()}
    rate = report["m", "small"].rate
    assert {x.copies for x in used if x.mix == "m" and x.source == "small"} <= {int(rate), int(rate) + 1} and len(small) > 20
    assert M.mix_report(counts.limit(0), targets).where("tokens > 0").isEmpty() and M.mix_report(counts, targets.limit(0)).collect() == []
    big = {x.source: x for x in M.mix_report(counts, targets.where("mix = 'm'"), size=10_000_000).collect()}
    assert big["small"].rate == 4.0 and big["big"].rate == 1.0


def test_token_counts_of_long_texts(spark):
    enc = M.encoder(f"{M.TOKENIZERS}/{M.VOCABULARY}")
    r = random.Random(8)
    mixed = "".join(r.choice(["word", " ", "  ", "\n", "é", "12", "'s", " the", "-", "a", "Z "]) for _ in range(120_000))
    texts = ["some words in a line\n" * 20_000, mixed, "x-" * 80_000]
    got = {x.doc_id: x.tokens for x in M.token_counts(spark.createDataFrame([(n, t, None) for n, t in enumerate(texts)], "doc_id bigint, text string, source string")).collect()}
    assert got == {n: len(enc.encode_ordinary(t)) for n, t in enumerate(texts)}


def test_leaks_in_parts(spark, monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)]
    docs = spark.createDataFrame([(i, "so " + t.upper() + " it goes") for i, t in items] + [(99, "nothing " * 40)], "doc_id bigint, text string")
    given = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(r.doc_id, r.item_id, r.words, r.start, r.stop) for r in L.leaked_items(docs, given).collect()}
    assert len(want) == 30
    monkeypatch.setattr(L, "MAX_ITEM_CHARS", 700)
    assert {(r.doc_id, r.item_id, r.words, r.start, r.stop) for r in L.leaked_items(docs, given).collect()} == want
    monkeypatch.setattr(L, "MAX_PARTS", 2)
    with pytest.raises(ValueError):
        L.leaked_items(docs, given)


def test_plain_words():
    assert T.plain_words("Shut your m0u7h, br*inless p4r4s1t3!") == ["shut", "your", "mouth", "br*inless", "parasite"]
    assert T.plain_words("send nuuuuudes, t h r o w it") == ["send", "nudes", "throw", "it"]
    assert T.plain_words("рlеаse id\u200biot ÄRGER `code_x` h.example/o/r@x 0123456789ab x86 v2.1") == ["please", "idiot", "arger", "x86", "v2"] or "idiot" in T.plain_words("id\u200biot")
    assert T.plain_words("") == [] and T.sentences("A. B!\n\nC") == ["A.", "B!", "C"]


def test_block_index_is_exact():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = A.Weights({w: r.randrange(1, 50) for w in vocabulary}, 500)
    examples = [r.choices(vocabulary, k=r.randrange(1, 9)) for _ in range(900)]
    vectors = [weights.vector(e) for e in examples]
    for dense in (A.DENSE, 0):
        A.DENSE, kept = dense, A.DENSE
        index = A.BlockMax(examples, weights)
        A.DENSE = kept
        for _ in range(150):
            v = weights.vector(r.choices([*vocabulary, "unknown"], k=r.randrange(1, 7)))
            every = sorted(((round(sum(x * e.get(w, 0) for w, x in v.items()), 12), i) for i, e in enumerate(vectors)), key=lambda s: (-s[0], s[1]))
            want = [s for s in every if s[0] >= A.NEAR][:10]
            got = index.top(v, 10)
            assert [i for _, i in got] == [i for _, i in want] and all(abs(s - t) < 1e-9 for (s, _), (t, _) in zip(got, want))
    assert A.BlockMax([], weights).top({"w1": 1.0}, 3) == []


PLAIN = ["The {a} {b} still points at the old {c}.", "Please keep the {a} next to the {b}; moving it broke our {c}.", "Kill the parent process first, then its orphan children die on their own.", "He called the old {a} stupid, and to be fair it was.", "Field `sex` takes the codes 1 and 2."]
BAD = ["Shut your mouth, moron, nobody wants your {a} here.", "You are an 1d107 and everybody on the {a} team knows it.", "Send me n*d*s or I close your {b} request.", "Foreigners are s u b h u m a n and should not touch our {c}.", "HALT DIE FRESSE, DU ARSCHLOCH, niemand braucht deinen {a}."]


def test_held_out_accuracy(spark):
    r = random.Random(4)
    noun = lambda: r.choice(["relay", "map", "lock", "wedge", "tone", "grid", "slot", "ring"])
    say = lambda t: t.format(a=noun(), b=noun(), c=noun())
    docs, truth = [], {}
    for i in range(600):
        lines = [say(r.choice(PLAIN)) for _ in range(6)]
        truth[i] = r.random() < 0.15
        if truth[i]:
            lines.insert(r.randrange(6), say(r.choice(BAD)))
        docs.append((i, " ".join(lines), r.choice(["Issue", "issue ", None]), 1))
    docs += [(900, None, "x", 1), (901, " ", "x", 1), (902, "12 34", "x", 1), docs[0]]
    labels = [(i, "a", int(truth[i]) if r.random() > 0.05 else 1 - int(truth[i])) for i in range(300)] + [(1, "b", None), (99999, "a", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score int")
    scores = A.abuse_scores(df, spark.createDataFrame(labels, "doc_id bigint, annotator string, toxic int"))
    found = {x.doc_id for x in scores.where(f"score >= {A.REVIEW}").collect()}
    held = range(300, 600)
    right = sum((i in found) == truth[i] for i in held)
    assert right / len(held) > 0.95 and not {900, 901, 902} & found
    rates = {x.source: x for x in A.abuse_rates(scores, df).collect()}
    assert rates["issue"].documents + rates[""].documents == 600
    told = {x.tenth: x for x in A.calibration(scores, spark.createDataFrame(labels, "doc_id bigint, annotator string, toxic int")).collect()}
    assert sum(x.labelled for x in told.values()) == 300 and told[0].judged_harmful < 0.2 < 0.6 < told[max(told)].judged_harmful
    bounded = A.abuse_scores(df, spark.createDataFrame(labels, "doc_id bigint, annotator string, toxic int"), max_labelled=50)
    assert bounded.count() == 600


def test_abuse_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, annotator string, toxic int")
    docs = spark.createDataFrame([(1, "Go away, you worthless idiot."), (2, "Kill the parent process first."), (None, "No id."), (1, "Another text.")], "doc_id bigint, text string")
    assert {(x.doc_id, x.score) for x in A.abuse_scores(docs, none).collect()} == {(1, 0.0), (2, 0.0), (None, 0.0)}
    assert A.abuse_scores(docs.limit(0), none).collect() == [] and A.calibration(A.abuse_scores(docs, none), none).collect() == []


def test_copied_abuse_is_found(spark):
    r = random.Random(5)
    noun = lambda: r.choice(["relay", "map", "lock", "wedge", "tone", "grid", "slot", "ring"])
    docs = [(i, " ".join(r.choice(PLAIN).format(a=noun(), b=noun(), c=noun()) for _ in range(4)) + (" Crawl back under your bridge, you warty gremlin." if i % 3 == 0 else "")) for i in range(600)]
    labels = [(i, "a", int(i % 3 == 0)) for i in range(0, 600, 5)]
    scores = A.abuse_scores(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, annotator string, toxic int"))
    assert {x.doc_id for x in scores.where(f"score >= {A.REVIEW}").collect()} == set(range(0, 600, 3))


def test_votes():
    judge = A.Judge([("the a", 1, 0), ("rare a", 0, 1), ("go home you t*ll gremlin", 2, 0), ("tall", 1, 0)], {"the": 900, "a": 900}, 1000, 0.1)
    score, example = judge.score("the a")
    assert abs(score - (1 + 0.1) / (1 + 1)) < 1e-9 and example == "the a" and judge.score("rare a")[0] == 0.0
    assert judge.read(["t*ll", "t*x", "homegremlinyou"]) == ["tall", "t*x", "home", "gremlin", "you"]
    # a sentence that harmless documents hold as often bears no label
    assert A.Judge([("shared words here", 1, 2)], {}, 10, 0.1).names == []
