"""Reports over records of runs: medians, rates and answers against what was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.records import content_of


def summary(runs: DataFrame) -> DataFrame:
    """Per family and task, per family, and in all (rollup, pooled values): runs, pass rate and exact median tokens of each arm.

    ``runs`` has family, task, arm, status, tokens. Limited and timed-out runs count, null tokens are left out of medians.
    """
    arm, family, task = (F.col(c) for c in ("arm", "family", "task"))
    return (
        runs.groupingSets([[arm], [arm, family], [arm, family, task]], "arm", "family", "task")
        .agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "pass").alias("passed"), F.median("tokens").alias("median_tokens"))
        .select(F.coalesce("family", F.lit("*")).alias("family"), F.coalesce("task", F.lit("*")).alias("task"), "arm", "runs", "passed", "median_tokens")
    )


def ratios(runs: DataFrame, arm: str, base: str) -> DataFrame:
    """Median tokens of one arm over those of another, per task, family and in all (levels as in ``summary``); null without both."""
    at = lambda which, name: summary(runs).where(F.col("arm") == which).select("family", "task", F.col("median_tokens").alias(name))
    both = at(arm, "median").join(at(base, "base"), ["family", "task"])
    return both.select("family", "task", "median", "base", F.when(F.col("base") > 0, F.col("median") / F.col("base")).alias("ratio"))


def statuses(runs: DataFrame) -> DataFrame:
    """How each run ended, counted by arm: a timeout before a limit before an error before its grade."""
    return runs.groupBy("arm", "status").agg(F.count("*").alias("runs"))


def run_status(timed_out: str, limited: str, error: str, passed: str) -> F.Column:
    return F.when(F.col(timed_out), "timeout").when(F.col(limited), "limited").when(F.col(error), "error").when(F.col(passed), "pass").otherwise("fail")


def answer_difference(answers: DataFrame, expected: DataFrame, by: str, value: str) -> DataFrame:
    """(by, missing, extra): what each answer lacks and what it has beyond the expected set."""
    a, e = answers.select(by, value).distinct(), expected.select(by, value).distinct()
    lost = e.join(a, [by, value], "left_anti").groupBy(by).agg(F.count("*").alias("missing"))
    more = a.join(e, [by, value], "left_anti").groupBy(by).agg(F.count("*").alias("extra"))
    return lost.join(more, by, "full_outer").na.fill(0, ["missing", "extra"])


def usage(events: DataFrame) -> DataFrame:
    """(run, messages, tokens, calls): usage once for each message, calls by name, of events (run, seq, message_id, tokens, tool)."""
    first = events.where("message_id is not null").groupBy("run", "message_id").agg(F.min_by("tokens", "seq").alias("tokens"))
    used = first.groupBy("run").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))
    calls = events.where("tool is not null").groupBy("run", "tool").agg(F.count("*").alias("n")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("calls"))
    return used.join(calls, "run", "full_outer")


def answer_lines(text: F.Column | str) -> F.Column:
    """The entries of an answer: lines without bullets, comments and blanks, each once, in order."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.transform(F.split(c, "\\r?\\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", ""), "`", "")))
    return F.array_distinct(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))))


def folded(answers: DataFrame, expected: DataFrame, by: str, value: str) -> DataFrame:
    """Answers (by, value) with what is nested in an expected name (``name`` or ``name.member``) brought up to the longest such name; the rest as it is."""
    parts = F.split(value, "[.]")
    up = answers.select(by, value).distinct().select(by, value, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("outer"))
    names = expected.select(by, F.col(value).alias("outer")).distinct().withColumn("held", F.lit(True))
    best = up.join(names, [by, "outer"], "left").groupBy(by, value).agg(F.max_by("outer", F.when(F.col("held"), F.length("outer"))).alias("to"))
    return best.select(by, F.coalesce("to", F.col(value)).alias(value)).distinct()


def verdicts(answers: DataFrame, expected: DataFrame, by: str, value: str) -> DataFrame:
    """(by, strict, folded): whether an answer is just the expected set, as given and with nested names folded. An answer without rows is empty."""
    def same(given: DataFrame, name: str) -> DataFrame:
        off = answer_difference(given, expected, by, value).select(by, (F.col("missing") + F.col("extra") == 0).alias(name))
        every = given.select(by).unionByName(expected.select(by)).distinct()
        return every.join(off, by, "left").select(by, F.coalesce(name, F.lit(True)).alias(name))

    return same(answers, "strict").join(same(folded(answers, expected, by, value), "folded"), by)


def verdict_counts(told: DataFrame, runs: DataFrame, by: str) -> DataFrame:
    """Strict and folded passes of each arm; ``runs`` has (by, arm), ``told`` is ``verdicts``."""
    return runs.select(by, "arm").distinct().join(told, by).groupBy("arm").agg(F.count("*").alias("answers"), F.count_if("strict").alias("strict"), F.count_if("folded").alias("folded"))


def link_grades(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run, passed): whether the links a run wrote (run, file, relation, target_address) include what was wanted of it (run, relation, target_address; null relation: any)."""
    given = links.select("run", "relation", "target_address").distinct().alias("g")
    asked = wanted.select("run", "relation", "target_address").distinct().withColumn("n", F.monotonically_increasing_id()).alias("w")
    met = asked.join(given, F.expr("w.run = g.run and w.target_address = g.target_address and (w.relation is null or w.relation = g.relation)"), "left_semi").select("n").withColumn("met", F.lit(True))
    return asked.join(met, "n", "left").groupBy("run").agg(F.every(F.coalesce("met", F.lit(False))).alias("passed"))


_SPENT = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def total_tokens(usage: F.Column) -> F.Column:
    """All tokens of a usage object: absent counts are 0, an absent object is null."""
    total = F.lit(0).cast("bigint")
    for name in _SPENT:
        total = total + F.coalesce(usage[name], F.lit(0))
    return F.when(usage.isNotNull(), total)


def stream_calls(parsed: DataFrame) -> DataFrame:
    """(run, seq, id, name, denied, error, result_chars) of every tool call of parsed streams, joined with its result and denial by its id."""
    blocks = parsed.select("run", "seq", "e", F.explode(content_of(F.col("e.message.content"))).alias("b"))
    calls = blocks.where("e.type = 'assistant' and b.type = 'tool_use'").select("run", "seq", "b.id", "b.name")
    # a result's content is a text, or a list of blocks with texts
    parts = F.from_json("b.content", "array<struct<text:string>>")
    said = F.when(F.startswith("b.content", F.lit("[")) & parts.isNotNull(), F.array_join(F.transform(parts, lambda x: x["text"]), "")).otherwise(F.col("b.content"))
    results = blocks.where("e.type = 'user' and b.type = 'tool_result'").groupBy("run", F.col("b.tool_use_id").alias("id")).agg(
        F.max_by(F.struct(F.coalesce(F.length(said), F.lit(0)).alias("chars"), F.coalesce("b.is_error", F.lit(False)).alias("error")), "seq").alias("r")
    )
    denied = parsed.where("e.type = 'system' and e.subtype = 'permission_denied'").select("run", F.col("e.tool_use_id").alias("id")).distinct().withColumn("denied", F.lit(True))
    got = calls.join(results, ["run", "id"], "left").join(denied, ["run", "id"], "left")
    return got.select("run", "seq", "id", "name", F.coalesce("denied", F.lit(False)).alias("denied"), F.coalesce("r.error", F.lit(False)).alias("error"), F.coalesce("r.chars", F.lit(0)).alias("result_chars"))


def stream_summary(parsed: DataFrame) -> DataFrame:
    """(run, requests, input_tokens, tokens, num_turns, rate_limit, calls) of each run.

    The input side is summed once for each message id of the run itself (the first line of a message counts); ``tokens`` are those of its
    result line, null without one, which is authoritative; ``rate_limit`` is the last one told; ``calls`` counts tool calls by name.
    """
    own = parsed.where("e.type = 'assistant' and e.parent_tool_use_id is null and e.message.usage is not null")
    once = own.groupBy("run", F.col("e.message.id").alias("id")).agg(F.min_by("e.message.usage", "seq").alias("u"))
    spent = F.coalesce("u.input_tokens", F.lit(0)) + F.coalesce("u.cache_read_input_tokens", F.lit(0)) + F.coalesce("u.cache_creation_input_tokens", F.lit(0))
    asked = once.groupBy("run").agg(F.count("*").alias("requests"), F.sum(spent).alias("input_tokens"))
    ends = parsed.groupBy("run").agg(
        F.max_by("e", F.when(F.col("e.type") == "result", F.col("seq"))).alias("last"), F.max_by("e.rate_limit_info", F.when(F.col("e.type") == "rate_limit_event", F.col("seq"))).alias("rate_limit")
    )
    calls = stream_calls(parsed).groupBy("run", "name").agg(F.count("*").alias("n")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("calls"))
    out = ends.join(asked, "run", "left").join(calls, "run", "left")
    return out.select("run", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), total_tokens(F.col("last.usage")).alias("tokens"), F.col("last.num_turns").alias("num_turns"), "rate_limit", "calls")
