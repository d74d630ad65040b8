"""Records of runs from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "task string, family string, arm string, run int, status string, tokens bigint, num_turns int, wall_seconds double, tool_counts map<string,int>, index struct<crawl:string>, _corrupt string"


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each readable ``*/*/*.json`` below a folder, with its file name; unreadable ones are dropped."""
    df = spark.read.schema(RECORD).json(f"{folder}/*/*/*.json", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", multiLine=True)
    return df.withColumn("file", F.col("_metadata.file_path")).where("_corrupt is null and task is not null").drop("_corrupt")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of runs from JSON lines, plain or compressed."""
    return spark.read.schema("run string, seq bigint, message_id string, tokens bigint, tool string").json(path)


_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
_CONTENT = "array<struct<type:string,id:string,name:string,tool_use_id:string,content:string,is_error:boolean,text:string>>"
_LINE = (
    f"type string, subtype string, tool_use_id string, parent_tool_use_id string, message struct<id:string,usage:{_USAGE},content:string>, usage {_USAGE}, rate_limit_info string, num_turns int, is_error boolean, duration_ms bigint"
)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(run, seq, line) of streams of JSON lines, plain or compressed; a file is a run, and ``seq`` orders its lines.

    A file is read whole where it lies, so that the order of its lines is kept.
    """
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:[.]jsonl?)?(?:[.]gz)?$", 1).alias("run"), "value")
    return texts.select("run", F.posexplode(F.split("value", "\\r?\\n")).alias("seq", "line")).where("trim(line) <> ''")


def parsed_stream(lines: DataFrame) -> DataFrame:
    """(run, seq, e) of lines that are JSON objects; others are left out."""
    return lines.select("run", "seq", F.from_json("line", _LINE, {"mode": "PERMISSIVE"}).alias("e")).where("e.type is not null")


def content_of(text: F.Column) -> F.Column:
    """The blocks of a message: an array of objects; a text alone has none."""
    return F.coalesce(F.from_json(text, _CONTENT), F.array().cast(_CONTENT))
