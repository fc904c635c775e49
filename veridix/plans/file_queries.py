"""Queries through files: what a query reads it has first written to the shared folder, so readers and writers are run
as a user would run them."""

from __future__ import annotations

import hashlib
import json

from pyarrow import fs
from pyspark.sql import functions as F

from veridix.operators import calibrate as C
from veridix.operators import order as O
from veridix.operators import scoring as S
from veridix.operators import telemetry as T
from veridix.plans import adapters as A
from veridix.plans.queries import adjusted, query, rounded
from veridix.session import scratch, written
from veridix.sources import files as X
from veridix.sources.cache import ContentCache, file_hashes, pinned
from veridix.sources.paged import looked_up, read_paged
from veridix.sources.sinks import append_once, file_system, read_committed


@query
def dataset_split(spark, d):
    """A split that isn't there falls back to the first."""
    path = scratch(spark)
    A.table(spark, d, "nation").write.parquet(f"{path}/train")
    return X.read_parquet(spark, path, "validation").select("n_nationkey", "n_name")


@query
def manifest_rows(spark, d):
    """The first 20 of a manifest of sampled positions, joined to their documents."""
    path = scratch(spark)
    sample = C.stratified_sample(A.table(spark, d, "documents"), ["lang", "source"], "doc_id", 60, 7)  # 60 rows
    entries = F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda x: F.struct(x["doc_id"].alias("source_index")))
    sample.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)
    first = O.first_of(X.read_manifest(spark, path), "pos", 20)
    return rounded(X.select_positions(A.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", first))


def _answers(spark, d, version):
    r = A.reviews(spark, d).where(F.col("version") == version)
    return r.select(F.col("query_id").cast("string").alias("query"), F.lit("the truth").alias("ground_truth"), F.concat("label", F.lit(', "quoted"\nanswer')).alias("agent_response"), "label", "error_cause", "n_chars")


@query
def run_csv(spark, d):
    path = scratch(spark)
    rows = _answers(spark, d, "b0").select("query", "ground_truth", "agent_response")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return X.read_run_csv(spark, path, ["query", "ground_truth", "agent_response"])


@query
def reviewed_results(spark, d):
    path = scratch(spark)
    rows = _answers(spark, d, "a1")
    rows.select("query", "ground_truth", "agent_response").write.option("header", True).option("escape", '"').csv(f"{path}/results")
    X.write_csv(rows.select(F.concat(F.lit("R"), "query").alias("response_id"), "query", "label", F.col("error_cause").alias("cause"), F.concat(F.lit("n"), "n_chars").alias("note")), f"{path}/review")
    review = X.read_review_csv(spark, f"{path}/review", ["response_id", "query", "label", "cause", "note"])
    return X.reviewed_results(X.read_results_csv(spark, f"{path}/results"), review)


@query
def telemetry_csv(spark, d):
    path = scratch(spark)
    t = A.telemetry(spark, d)
    unit = lambda c, u: F.concat(F.col(c).cast("string"), F.lit(u))
    line = F.concat_ws(", ", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS"), F.col("gpu").cast("string"), F.lit("A800"), F.col("temp_c").cast("string"), unit("power_w", " W"), unit("mem_mib", " MiB"), F.lit("81920 MiB"), unit("util", " %"))
    t.select(F.explode(F.array(line, F.lit("broken, line"))).alias("value")).write.text(path)
    got = X.read_telemetry_csv(spark, path)
    days = got.groupBy(F.col("gpu").alias("__g")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH").alias("first_hour"))
    return rounded(T.gpu_summary(got).join(days, F.col("gpu") == F.col("__g")).drop("__g"))


@query
def trace_files(spark, d):
    """Two appends to one trace, read back and counted."""
    path = scratch(spark)
    t = A.traces(spark, d).select("trace_id", "gpu", "status", "gate_action", "total_ms", "generation_ms", "search_call_count", "answer_token_count", "answer")
    for gpu in (0, 1):
        X.append_traces(t.where(F.col("gpu") == gpu).drop("gpu"), f"{path}/agent_trace_v3.jsonl")
    got = X.read_traces(spark, path)
    return rounded(got.groupBy("gate_action", "status").agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("n_traces"), F.sum("search_call_count").alias("search_calls"), F.max("answer_token_count").alias("most_tokens"), F.max("total_ms").alias("max_ms")))


@query
def json_documents(spark, d):
    """One JSON document of all regions and their nations, read whole and unnested."""
    path = scratch(spark)
    n = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = n.groupBy(F.col("r_name").alias("name")).agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("nations"))  # 25 nations
    regions.agg(F.to_json(F.struct(F.collect_list(F.struct("name", "nations")).alias("regions"))).alias("value")).coalesce(1).write.text(path)
    got = X.read_json(spark, path).select(F.explode("regions").alias("r")).select(F.col("r.name").alias("region"), F.explode("r.nations").alias("n"))
    return got.select("region", "n.n_name", "n.n_nationkey")


@query
def results_files(spark, d):
    """The ego turns' file, with the number of turns that the scores' file says."""
    path = scratch(spark)
    flags = adjusted(spark, d)
    X.write_results(flags.select("session_id", "turn_idx", "is_ego", "status"), S.score_dictionary(flags), path)
    total = spark.read.json(f"{path}/scores").where("scope = 'ego'").select(F.col("total").alias("ego_turns"))
    got = X.read_results_csv(spark, f"{path}/turns_ego").select(F.col("session_id").cast("long").alias("session_id"), F.col("turn_idx").cast("long").alias("turn_idx"), "status")
    return got.crossJoin(F.broadcast(total))  # one row


@query
def hydrated_entities(spark, d):
    info = F.to_json(F.create_map("p_name", F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type")))
    p = A.table(spark, d, "part").select("p_partkey", F.explode(X.hydrate_entities(info)).alias("e"))
    return p.select("p_partkey", F.col("e.key").alias("entity_name"), F.col("e.value")["brand"].alias("brand"), F.col("e.value")["type"].alias("kind"))


@query
def page_content(spark, d):
    got = X.with_page_content(A.web_hits(spark, d).select("turn_id", "pos", "page_id", "page_url"), A.table(spark, d, "pages"), "page_id", "page_id")
    return rounded(got.select("turn_id", "pos", "page_url", F.length("page_content").alias("n_chars"), F.md5("page_content").alias("content_md5")))


@query
def cached_pages(spark, d):
    """Every page's address fetched into an empty cache, where some fail, and once more with nothing left that answers: what
    was fetched comes from the cache."""

    def get(url):
        if hashlib.md5(url.encode()).hexdigest()[0] == "0":
            raise OSError("not found")
        return f"page of {url}".encode()

    def down(url):
        raise OSError("down")

    pages = A.table(spark, d, "pages").select("page_id", "url")
    cache = ContentCache(spark, scratch(spark))
    status = lambda c, name: F.when(F.col("error").isNotNull(), "failed").when(c, "cached").otherwise("fetched").alias(name)
    first = cache.fetch(pages, get, attempts=1).select("url", status(F.col("cached"), "first_status"))
    second = cache.fetch(pages, down, attempts=1).select("url", "key", status(F.col("cached"), "second_status"), F.md5("content").alias("content_md5"))
    return pages.join(first, "url").join(second, "url").select("page_id", "key", "first_status", "second_status", "content_md5")


@query
def committed_traces(spark, d):
    """Two batches of a trace, each written twice under its name, read back and counted."""
    path = scratch(spark)
    t = written(A.traces(spark, d).select("trace_id", "gpu", "status", "gate_action", "total_ms", "generation_ms", "search_call_count", "answer_token_count", "answer"))
    for gpu in (0, 1, 0, 1):
        append_once(t.where(F.col("gpu") == gpu).drop("gpu"), path, f"gpu-{gpu}")
    got = read_committed(spark, path, X.TRACE_SCHEMA)
    return rounded(got.groupBy("gate_action", "status").agg(F.count("*").alias("n"), F.count_distinct("trace_id").alias("n_traces"), F.sum("search_call_count").alias("search_calls"), F.max("answer_token_count").alias("most_tokens"), F.max("total_ms").alias("max_ms")))


def _collection(spark, d, size):
    """Documents as a collection outside: a folder of page files, and what gives its number of rows and its pages."""
    path = scratch(spark)
    O.pages(A.table(spark, d, "documents").select("doc_id", "n_chars"), ["doc_id"], size).repartition("page").write.partitionBy("page").json(path)

    def page(limit, offset):
        at, root = file_system(path)
        files = at.get_file_info(fs.FileSelector(f"{root}/page={offset // size}"))
        rows = [json.loads(x) for f in files if f.base_name.startswith("part-") for x in at.open_input_stream(f.path).read().decode().splitlines()]
        return [(r["doc_id"], r["n_chars"]) for r in sorted(rows, key=lambda r: r["place"])][:limit]

    return spark.read.json(path).count, page


@query
def paged_collection(spark, d):
    """All documents through a client that gives them 128 at a time."""
    count, page = _collection(spark, d, 128)
    return read_paged(spark, count, page, "doc_id bigint, n_chars bigint", 128, tasks=8)


@query
def looked_up_pages(spark, d):
    """The titles of the pages that searches have found, by id from a collection that lacks every seventh."""
    ids = A.web_hits(spark, d).select(F.col("page_url").alias("id"))
    return looked_up(ids, lambda own: {i: f"title of {i}" for i in own if int(hashlib.md5(i.encode()).hexdigest()[:4], 16) % 7}, size=10)


@query
def file_checksums(spark, d):
    """Files of document ids, a hundred a file, by their bytes and by the hash of their pieces; they are what a manifest of
    the same files says."""
    path = scratch(spark)
    docs = A.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("bucket"), "doc_id").repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    docs.select("bucket", F.col("doc_id").cast("string").alias("value")).write.partitionBy("bucket").text(path)
    manifest = written(file_hashes(spark, path, "*.txt").select("name", "sha256"))
    found = pinned(file_hashes(spark, path, "*.txt", piece=64), manifest)
    return found.select(F.regexp_extract("name", r"bucket=(\d+)/", 1).cast("bigint").alias("bucket"), "length", "sha256", "tree_sha256")
