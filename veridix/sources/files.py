"""Readers and writers of the evaluation's files."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.functions.text import number_with_unit
from veridix.session import written

TRACE_SCHEMA = "trace_id string, session_id string, turn_idx int, query string, status string, gate_action string, total_ms double, generation_ms double, image_search_ms double, web_search_ms double, search_call_count int, additional_web_evidence int, answer_token_count int, image_evidence array<struct<evidence_id:string,text:string,score:double>>, web_evidence array<struct<evidence_id:string,text:string,score:double>>, errors array<string>, answer string, refusal_reason string"


def read_parquet(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A dataset folder; a split is its subfolder, or the first there is if it has none of that name."""
    if split is None:
        return spark.read.parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    if not names:
        raise ValueError(f"no splits in {path}")
    return spark.read.parquet(f"{path}/{split if split in names else names[0]}")


def select_positions(df: DataFrame, row_id: str, manifest: DataFrame) -> DataFrame:
    """Rows by manifest (pos, row_id), with pos to order by."""
    return df.join(manifest.withColumnRenamed("row_id", "__r"), df[row_id] == F.col("__r")).drop("__r")


def read_run_csv(spark: SparkSession, path: str, required: list[str], key: str = "query") -> DataFrame:
    """A CSV file with a header; missing columns, no rows, and empty or repeated keys raise."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    n, distinct, empty = df.agg(F.count("*"), F.count_distinct(key), F.count_if(F.coalesce(F.trim(key), F.lit("")) == "")).first()
    if not n or n != distinct or empty:
        raise ValueError(f"{path}: keys must be present, not empty and unique")
    return df


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless telemetry lines with padded fields and units; lines of fewer than eight fields are left out."""
    p = spark.read.text(path).select(F.split(F.trim("value"), r",\s*").alias("p")).where(F.size("p") >= 8)
    at = lambda i: F.col("p")[i]
    return p.select(F.try_to_timestamp(at(0), F.lit("yyyy/MM/dd HH:mm:ss.SSS")).alias("ts"), at(1).try_cast("int").alias("gpu"), at(2).alias("name"), *[number_with_unit(at(i)).alias(n) for i, n in ((3, "temp_c"), (4, "power_w"), (5, "mem_mib"), (6, "mem_total_mib"), (7, "util"))])


def read_traces(spark: SparkSession, path: str, file_name: str = "agent_trace_v3.jsonl") -> DataFrame:
    """Traces of a folder's JSON lines; blank lines don't count; no file gives no rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{file_name}")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], TRACE_SCHEMA)
    lines = spark.read.text(f"{path}/{file_name}").where(F.trim("value") != "")
    return lines.select(F.from_json("value", TRACE_SCHEMA).alias("t")).select("t.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of objects with source_index -> pos, row_id; what is no whole number, or comes twice, raises."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<struct<source_index:string>>")).alias("pos", "x")).select("pos", F.col("x.source_index").try_cast("int").alias("row_id"))
    n, distinct, bad = rows.agg(F.count("*"), F.count_distinct("row_id"), F.count_if(F.col("row_id").isNull())).first()
    if bad or n != distinct:
        raise ValueError(f"{path}: indices must be whole numbers and unique")
    return rows


def hydrate_entities(info: Column) -> Column:
    """An entity map in JSON as pairs of name and attributes."""
    return F.map_entries(F.from_json(info, "map<string,map<string,string>>"))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; of no rows a single empty line."""
    if df.isEmpty():
        df.sparkSession.createDataFrame([("",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_traces(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_results(turns: DataFrame, scores: DataFrame, path: str) -> None:
    """All turns and the ego turns by session and turn (part files hold ranges of that order), the score rows as JSON."""
    for name, rows in (("turns_all", turns), ("turns_ego", turns.where("is_ego"))):
        rows.orderBy("session_id", "turn_idx").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
    scores.coalesce(1).write.mode("overwrite").json(f"{path}/scores")


def atomic_json(path: str, payload: object) -> None:
    """A driver-side file that is there whole or not at all."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)


def with_page_content(hits: DataFrame, pages: DataFrame, hit_key: str = "page_url", page_key: str = "url") -> DataFrame:
    """Hits with their page's content, joined after the top k are known; null where no page has the key. A hit stays one
    row: addresses may repeat, and of pages with one key it has the least content in order. Hits are written once."""
    hits = written(hits)
    asked = hits.select(F.col(hit_key).alias("__u")).distinct()
    own = pages.select(F.col(page_key).alias("__u"), "html").join(asked, "__u", "left_semi").groupBy("__u").agg(F.min("html").alias("page_content"))
    return hits.join(own, F.col(hit_key) == F.col("__u"), "left").drop("__u")


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """A results file of any number of parts, every column a string; quotes are doubled, texts may hold line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_review_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Filled review sheets; missing columns, empty labels and response ids that come twice raise."""
    df = read_results_csv(spark, path)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    n, distinct, blank = df.agg(F.count("*"), F.count_distinct("response_id"), F.count_if(F.coalesce(F.trim("label"), F.lit("")) == "")).first()
    if n != distinct or blank:
        raise ValueError(f"{path}: labels must not be empty, response ids unique")
    return df


def reviewed_results(results: DataFrame, review: DataFrame) -> DataFrame:
    """results (query, ground_truth, agent_response) with their review (query, label, cause, note); a result without a
    review raises."""
    both = results.join(review.select("query", "label", "cause", "note"), "query", "left")
    label = F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no review of: "), F.coalesce("query", F.lit("null")))).cast("string")).otherwise(F.col("label"))
    return both.select("query", "ground_truth", F.col("agent_response").alias("answer"), label.alias("label"), "cause", "note")


def copy_assets(spark: SparkSession, source: str, target: str, names: list[str]) -> list[str]:
    """Copies the named files or folders; the first that is missing raises before anything is copied."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda folder, n: jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")
    for n in names:
        if not at(source, n).getFileSystem(conf).exists(at(source, n)):
            raise ValueError(f"missing asset: {n}")
    for n in names:
        jvm.org.apache.hadoop.fs.FileUtil.copy(at(source, n).getFileSystem(conf), at(source, n), at(target, n).getFileSystem(conf), at(target, n), False, True, conf)
    return names


def tokenizer_source(environment: dict[str, str], variables: list[str], default: str) -> tuple[str, str]:
    """Where an evaluator's tokenizer comes from: ("file", path) if a variable names a file or a folder with
    tokenizer.json, ("name", value) if it names anything else, ("name", default) if none is set."""
    found = next((environment[v] for v in variables if environment.get(v)), None)
    if found is None:
        return "name", default
    path = os.path.expanduser(found)
    path = os.path.join(path, "tokenizer.json") if os.path.isdir(path) else path
    return ("file", path) if os.path.isfile(path) else ("name", found)
