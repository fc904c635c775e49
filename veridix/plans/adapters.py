"""The driver's tables as the engine's frames. Labels and verdicts made here are synthetic and carry no meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridix.functions.text import IDK
from veridix.operators.evidence import kg_evidence, web_evidence
from veridix.operators.answering import Search, indexed
from veridix.operators.retrieval import cosine_top_k, lexical_index, lexical_search, lexical_top_k
from veridix.session import written

VERSIONS = {"src0": "b0", "src1": "a1", "src2": "a2", "src3": "a3", "src4": "full"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_code(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next row as the response."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"nr": F.lead("role").over(w), "nt": F.lead("text").over(w)}).where("role = 'user'")
    own = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    response = F.when(F.col("nr") == "assistant", F.col("nt")).otherwise("I don't know")
    c = c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 3 == 0).alias("is_ego"), (F.row_number().over(w) - 1).alias("turn_idx"), F.count("*").over(Window.partitionBy("conv_id")).alias("total_turn_count"), own.alias("interaction_id"), F.col("text").alias("query"), response.alias("agent_response"), (hash_code(own) % 10).alias("h"))
    truth = F.when(F.col("h") < 3, F.concat(F.lit(" "), "agent_response")).otherwise(F.concat(F.lit("gt "), F.col("h").cast("string")))
    return c.withColumns({"ground_truth": truth, "verdict": F.col("h").isin(3, 4)})


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    version = F.col("source")
    for source, name in VERSIONS.items():
        version = F.when(F.col("source") == source, name).otherwise(version)
    label = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "incorrect").when(F.col("toxic") == 1, "partial").otherwise("correct")
    cause = F.when(F.col("label") == "missing", "refusal").when(F.col("label") == "incorrect", "quality").when(F.col("label") == "partial", "toxicity")
    d = d.select(F.floor(F.col("doc_id") / 20).alias("query_id"), version.alias("version"), label.alias("label"), F.floor(F.col("doc_id") / 20).alias("source_order"), "n_chars")
    return d.withColumn("error_cause", cause)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    b0 = r.where("version = 'b0'").select("query_id", (F.pmod("n_chars", F.lit(101)) / 100.0).alias("score"), F.col("label").alias("b0_label"))
    return b0.join(r.where("version = 'a2'").select("query_id", F.col("label").alias("enriched_label")), "query_id")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces; whole milliseconds divided by powers of two, so no rounding meets a tie."""
    kind, n, ms = F.col("event_type"), F.col("event_id"), F.floor("value").cast("double")
    action = F.when(kind == "error", "abstain").when(kind == "purchase", "expand").otherwise("answer")
    some = lambda x, k: F.array_repeat(F.lit(x), (n % k).cast("int"))
    e = table(spark, sf_dir, "events").withColumn("gate_action", action)
    return e.select("event_id", F.concat(F.lit("t"), n).alias("trace_id"), (F.col("user_id") % 2).alias("gpu"), "event_type", "gate_action", F.when(kind == "error", "search_error").otherwise("ok").alias("status"), F.col("value").alias("total_ms"), (ms / 2).alias("generation_ms"), ms.alias("image_search_ms"), (ms / 4).alias("web_search_ms"), (F.lit(2) + F.when(kind == "purchase", 1).otherwise(0)).cast("long").alias("search_call_count"), F.when(kind == "purchase", n % 3).otherwise(0).cast("long").alias("additional_web_evidence"), some("i", 4).alias("image_evidence"), some("w", 3).alias("web_evidence"), (n % 60 + 40).alias("answer_token_count"), F.when(F.col("gate_action") == "abstain", IDK).otherwise("an answer").alias("answer"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 2).alias("gpu"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("double").alias("mem_mib"), F.least(F.col("value"), F.lit(100.0)).alias("util"), (n % 50 + 30).cast("double").alias("temp_c"), (n % 300 + 100).cast("double").alias("power_w"))


def image_search(spark: SparkSession, sf_dir: str) -> Search:
    """Parts by the cosine of their embeddings: a hit is a part with four attributes; vectors without a part are no hits."""
    e, p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), table(spark, sf_dir, "part")
    attrs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(c).cast("string").alias("value")) for f, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"), ("retail price", "p_retailprice"))])
    hit = F.struct("score", F.array(F.struct(F.col("p_name").alias("entity_name"), attrs.alias("entity_attributes"))).alias("entities"))

    def search(requests: DataFrame, k: int, source: str) -> DataFrame:
        near = cosine_top_k(e, requests.select(F.col("turn_id").alias("query_id"), F.col("value").alias("embedding")), k)
        return indexed(requests, near.join(p, F.col("item_id") == F.col("p_partkey")).select(F.col("query_id").alias("turn_id"), "rank", hit.alias("hit")))

    return search


def page_search(spark: SparkSession, sf_dir: str) -> Search:
    """Pages by shared tokens, through one stored index for all searches."""
    p = page_fields(spark, sf_dir)
    index = written(lexical_index(p.select(F.col("page_id").alias("item_id"), F.concat_ws(" ", "title", "snippet").alias("text"))))
    hit = F.struct("score", F.col("title").alias("page_name"), F.col("snippet").alias("page_snippet"), F.col("url").alias("page_url"))

    def search(requests: DataFrame, k: int, source: str) -> DataFrame:
        near = lexical_search(index, requests.select(F.col("turn_id").alias("query_id"), F.col("value").alias("text")), k)
        return indexed(requests, near.join(p, F.col("item_id") == F.col("page_id")).select(F.col("query_id").alias("turn_id"), "rank", hit.alias("hit")))

    return search


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 100 = 0")
    return p.select(F.col("p_partkey").alias("turn_id"), F.concat(F.lit("what is the size of "), "p_name").alias("query"))


def image_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top three parts by cosine for every vector whose id is divisible by 100; metadata joined after the top k."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    near = cosine_top_k(e, e.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), 3)
    p = table(spark, sf_dir, "part")
    attrs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, c in (("brand", "p_brand"), ("type", "p_type"), ("size", "p_size"), ("retail price", "p_retailprice"))])
    hits = near.join(p, near["item_id"] == p["p_partkey"]).select(F.col("query_id").alias("turn_id"), F.col("rank").alias("hit_pos"), "score", F.lit(0).alias("entity_pos"), F.col("p_name").alias("entity_name"), F.posexplode(attrs).alias("attr_pos", "a"))
    return hits.select("turn_id", "hit_pos", "score", "entity_pos", "entity_name", "attr_pos", "a.field", "a.value").join(part_queries(spark, sf_dir), "turn_id")


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippet = F.regexp_replace(F.regexp_extract("html", r"<p>(.*?)(?:</p>|<p>)", 1), r"<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"), snippet.alias("snippet"))


def web_hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """Top pages by token F1 for the title of every page whose id is divisible by 100."""
    p = page_fields(spark, sf_dir)
    q = p.where("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), F.col("title").alias("text"))
    near = lexical_top_k(p.select(F.col("page_id").alias("item_id"), F.concat_ws(" ", "title", "snippet").alias("text")), q, k)
    out = near.join(p, near["item_id"] == p["page_id"]).select(F.col("query_id").alias("turn_id"), "page_id", F.col("rank").alias("pos"), "score", F.col("title").alias("page_name"), F.col("snippet").alias("page_snippet"), F.col("url").alias("page_url"))
    return out.join(q.select(F.col("query_id").alias("turn_id"), F.col("text").alias("query")), "turn_id")


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg_evidence(image_hits(spark, sf_dir), 8)


def web(spark: SparkSession, sf_dir: str, items: int = 3) -> DataFrame:
    return web_evidence(web_hits(spark, sf_dir), items, 0.05)
