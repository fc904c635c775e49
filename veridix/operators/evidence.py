"""Ranked, deduplicated and budgeted evidence; entity agreement; conflicts; the answer gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridix.functions.text import clamp, clean_markup, clean_markup_v1, evidence_line, is_numeric_question, numbers, relevance, strip, terms, token_f1, tokens

VARIANTS = ["b0", "a1", "a2", "a3", "full", "a2_enrich_all"]


def kg_evidence(hits: DataFrame, max_fields: int = 12) -> DataFrame:
    """hits (turn_id, query, hit_pos, score, entity_pos, entity_name, attr_pos, field, value) -> turn_id, rank,
    evidence_id, text, score, query_relevance: attributes by relevance, then hit score, then position; the first of
    equal (entity, attribute), max_fields a turn."""
    c = hits.select("turn_id", "query", F.coalesce("score", F.lit(0.0)).alias("score"), "hit_pos", "entity_pos", "attr_pos", clean_markup(F.coalesce("entity_name", F.lit(""))).alias("name"), clean_markup(F.coalesce("field", F.lit(""))).alias("f"), clean_markup(F.coalesce("value", F.lit(""))).alias("v"))
    c = c.where("f <> '' and v <> ''").withColumn("rel", relevance(terms(F.col("query")), terms(F.concat_ws(" ", "name", "f", "v"))))
    c = c.withColumn("attr", F.concat(F.col("f"), F.lit(": "), F.col("v")))
    order = [F.desc("rel"), F.desc("score"), "hit_pos", "entity_pos", "attr_pos"]
    first = Window.partitionBy("turn_id", F.lower("name"), F.lower("attr")).orderBy(*order)
    c = c.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("turn_id").orderBy(*order))).where(F.col("rank") <= max_fields)
    text = F.when(F.col("name") != "", F.concat_ws(" | ", "name", "attr")).otherwise(F.col("attr"))
    return c.select("turn_id", "rank", F.concat(F.lit("KG"), "rank").alias("evidence_id"), text.alias("text"), "score", F.col("rel").alias("query_relevance"))


def web_evidence(hits: DataFrame, max_items: int = 3, threshold: float = 0.2) -> DataFrame:
    """hits (turn_id, query, pos, score, page_name, page_snippet, page_url) -> as kg_evidence, with url: hits with a
    snippet and a score of at least the threshold, the first of equal (url, snippet), by relevance, score, position."""
    c = hits.select("turn_id", "query", "pos", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(F.nullif(clean_markup(F.coalesce("page_name", F.lit(""))), F.lit("")), F.lit("Untitled page")).alias("title"), clean_markup(F.coalesce("page_snippet", F.lit(""))).alias("snippet"), clean_markup(F.coalesce("page_url", F.lit(""))).alias("url"))
    c = c.where((F.col("snippet") != "") & (F.col("score") >= threshold))
    first = Window.partitionBy("turn_id", F.lower("url"), F.lower("snippet")).orderBy("pos")
    c = c.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    c = c.withColumn("rel", relevance(terms(F.col("query")), terms(F.concat_ws(" ", "title", "snippet"))))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("turn_id").orderBy(F.desc("rel"), F.desc("score"), "pos"))).where(F.col("rank") <= max_items)
    return c.select("turn_id", "rank", F.concat(F.lit("WEB"), "rank").alias("evidence_id"), F.concat_ws(": ", "title", "snippet").alias("text"), "score", F.col("rel").alias("query_relevance"), "url")


def within_budget(evidence: DataFrame, most: int | Column) -> DataFrame:
    """Evidence lines in rank order up to the first that would pass `most` code points in all; line ends don't count."""
    line = evidence_line(F.col("evidence_id"), F.col("score"), F.col("text"))
    out = evidence.withColumn("line", line).withColumn("used", F.sum(F.length("line")).over(Window.partitionBy("turn_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("used") <= most)


def lines_of(evidence: DataFrame, name: str) -> DataFrame:
    """turn_id and its evidence lines in rank order, one a line."""
    said = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return evidence.groupBy("turn_id").agg(F.array_join(F.transform(said, lambda x: x["line"]), "\n").alias(name))


def shared_budget(kg: DataFrame, web: DataFrame, turns: DataFrame, most: int) -> DataFrame:
    """turns (turn_id, ...) with kg_lines and web_lines under one budget: image evidence first, web evidence in what
    the joined image lines (their line ends too) leave. No evidence: empty."""
    out = turns.join(lines_of(within_budget(kg, most), "kg_lines"), "turn_id", "left").na.fill("", ["kg_lines"])
    rest = out.select("turn_id", (F.lit(most) - F.length("kg_lines")).alias("left"))
    held = within_budget(web.join(rest, "turn_id"), F.col("left"))
    return out.join(lines_of(held, "web_lines"), "turn_id", "left").na.fill("", ["web_lines"])


def leading_names(items: DataFrame, most: int = 2) -> DataFrame:
    """items (turn_id, rank, text) -> turn_id, names: the first `most` entity names that differ in more than case, in
    rank order; an item without a name has none."""
    name = strip(F.split("text", " \\| ", 2)[0])
    own = items.select("turn_id", "rank", name.alias("name")).where("name <> ''")
    first = own.groupBy("turn_id", F.lower("name").alias("key")).agg(F.min(F.struct("rank", "name")).alias("x"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("turn_id").orderBy("x.rank"))).where(F.col("n") <= most)
    return ranked.groupBy("turn_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("names"))


def items_by_entity(image: DataFrame, ranked: DataFrame) -> DataFrame:
    """image items (turn_id, rank, text, score) in the order of their entities' rank (agreement's rows), then their own:
    with entity_rank and position from 1."""
    keyed = image.withColumn("key", entity_key(F.col("text"), F.col("rank")))
    order = ranked.select("turn_id", "entity_rank", F.col("first_rank").alias("rank")).join(keyed.select("turn_id", "rank", "key"), ["turn_id", "rank"]).select("turn_id", "key", "entity_rank")
    w = Window.partitionBy("turn_id").orderBy("entity_rank", "rank")
    return keyed.join(order, ["turn_id", "key"]).withColumn("position", F.row_number().over(w)).drop("key")


def entity_key(text: Column, rank: Column) -> Column:
    name = strip(F.split(text, " \\| ", 2)[0])
    return F.when(name == "", F.concat(F.lit("__unnamed_"), rank - 1)).otherwise(F.array_join(tokens(name), " "))


def merge_web(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both results in order, the first of equal url (of equal tokens where there is none), numbered anew."""
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    key = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("u:"), "url")).otherwise(F.concat(F.lit("t:"), F.array_join(tokens(F.col("text")), " ")))
    w = Window.partitionBy("turn_id", "key").orderBy("src", "rank")
    out = both.withColumn("key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    n = F.row_number().over(Window.partitionBy("turn_id").orderBy("src", "rank"))
    return out.withColumn("new_rank", n).select("turn_id", F.col("new_rank").alias("rank"), F.concat(F.lit("WEB"), "new_rank").alias("evidence_id"), "text", "score", "query_relevance", "url")


def agreement(image: DataFrame, web: DataFrame, queries: DataFrame) -> DataFrame:
    """image (turn_id, rank, text, score), web (turn_id, rank, text), queries (turn_id, query) -> one row per candidate
    entity, ranked: its scores, first rank, and the turn's top and second score and margin."""
    name = strip(F.split("text", " \\| ", 2)[0])
    attr = F.coalesce(F.get(F.split("text", " \\| ", 2), 1), F.lit(""))
    item = image.select("turn_id", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), name.alias("name"), attr.alias("attr"))
    g = item.withColumn("key", entity_key(F.col("name"), F.col("rank"))).groupBy("turn_id", "key").agg(F.min("rank").alias("first_rank"), F.max("score").alias("best"), F.min_by("name", "rank").alias("entity_name"), F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "attr"))), lambda x: x["attr"]), " ").alias("attrs"))
    pages = web.groupBy("turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("web_text"))
    g = g.join(pages, "turn_id", "left").join(queries, "turn_id", "left")
    image_score, web_score, attr_score = clamp(F.col("best")), token_f1(tokens(F.col("entity_name")), tokens(F.col("web_text"))), token_f1(tokens(F.col("query")), tokens(F.col("attrs")))
    g = g.withColumns({"image_score": image_score, "web_support": web_score, "attribute_support": attr_score})
    g = g.withColumn("entity_score", 0.50 * F.col("image_score") + 0.35 * F.col("web_support") + 0.15 * F.col("attribute_support"))
    g = g.withColumn("entity_rank", F.row_number().over(Window.partitionBy("turn_id").orderBy(F.desc("entity_score"), "first_rank")))
    whole = Window.partitionBy("turn_id")
    top = F.max(F.when(F.col("entity_rank") == 1, F.col("entity_score"))).over(whole)
    second = F.coalesce(F.max(F.when(F.col("entity_rank") == 2, F.col("entity_score"))).over(whole), F.lit(0.0))
    return g.select("turn_id", "entity_rank", "entity_name", "first_rank", "n_items", "image_score", "web_support", "attribute_support", "entity_score", top.alias("top_score"), second.alias("second_score"), F.greatest(F.lit(0.0), top - second).alias("margin"))


def numeric_conflict(query: Column, image_text: Column, web_text: Column) -> Column:
    """Whether a numeric question finds numbers on both sides and none in common."""
    a, b = numbers(image_text), numbers(web_text)
    return F.coalesce(is_numeric_question(query) & (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b), F.lit(False))


def should_expand(score: Column, low: float, high: float, force: bool = False) -> Column:
    return F.lit(True) if force else (score > low) & (score < high)


def gate_action(variant: Column, score: Column, conflict: Column, low: float = 0.3, high: float = 0.6) -> Column:
    """answer, expand or abstain. A variant that isn't known raises."""
    if not 0 <= low < high <= 1:
        raise ValueError("thresholds must be 0 <= low < high <= 1")
    band, under = (score > low) & (score < high), score <= low
    act = F.when(variant.isin("b0", "a1"), "answer")
    act = act.when(variant == "a2", F.when(band, "expand").otherwise("answer"))
    act = act.when(variant == "a3", F.when(conflict | under, "abstain").otherwise("answer"))
    act = act.when(variant == "full", F.when(conflict | under, "abstain").when(band, "expand").otherwise("answer"))
    act = act.when(variant == "a2_enrich_all", F.when(under, "abstain").otherwise("expand"))
    return act.otherwise(F.raise_error(F.concat(F.lit("unknown variant: "), variant)).cast("string"))


def refusal_reason(is_idk: Column, generation_failed: Column, search_failed: Column, given: Column, no_retrieval: Column, normaliser: Column) -> Column:
    """The first that holds: generation_error, search_error, a reason set before, no_retrieval, the normaliser's reason
    or insufficient_evidence; null for answers that are no refusal."""
    reason = F.when(generation_failed, "generation_error").when(search_failed, "search_error").when(given.isNotNull(), given).when(no_retrieval, "no_retrieval").otherwise(F.coalesce(normaliser, F.lit("insufficient_evidence")))
    return F.when(is_idk, reason)


def score_text(score: Column, lead: str) -> Column:
    """The lead and the score to three digits; nothing for no score."""
    return F.coalesce(F.concat(F.lit(lead), F.replace(F.format_number(score, 3), F.lit(","), F.lit(""))), F.lit(""))


def image_lines_v1(hits: DataFrame, max_items: int = 3, max_fields: int = 8) -> DataFrame:
    """First generation: hits (turn_id, hit_pos from 1, score, entity_pos, entity_name, attr_pos, field, value) ->
    turn_id, evidence: one line a hit of the first max_items, its entities' names and first max_fields attributes with a
    value; hits without either have no line and keep their number."""
    c = hits.where(F.col("hit_pos") <= max_items).select("turn_id", "hit_pos", "score", "entity_pos", "attr_pos", clean_markup_v1(F.coalesce("entity_name", F.lit(""))).alias("name"), clean_markup_v1(F.coalesce("field", F.lit(""))).alias("f"), clean_markup_v1(F.coalesce("value", F.lit(""))).alias("v"))
    pair = F.when(F.col("v") != "", F.struct("attr_pos", F.concat_ws(": ", "f", "v").alias("t")))
    e = c.groupBy("turn_id", "hit_pos", "score", "entity_pos").agg(F.first("name").alias("name"), F.slice(F.array_sort(F.collect_list(pair)), 1, max_fields).alias("a"))
    line = F.array_join(F.concat(F.array(F.nullif("name", F.lit(""))), F.transform("a", lambda x: x["t"])), "; ")
    e = e.withColumn("line", line).where("line <> ''")
    h = e.groupBy("turn_id", "hit_pos", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_pos", "line"))), lambda x: x["line"]), " | ").alias("lines"))
    h = h.select("turn_id", F.col("hit_pos").alias("rank"), F.concat(F.lit("[Image KG "), "hit_pos", score_text(F.col("score"), ", score="), F.lit("] "), "lines").alias("line"))
    return lines_of(h, "evidence")


def web_lines_v1(hits: DataFrame, max_items: int = 3) -> DataFrame:
    """First generation: hits (turn_id, pos from 1, score, page_name, page_snippet, page_url) -> turn_id, evidence: one
    line a hit of the first max_items that has a snippet, with title and address; numbers are the hits'."""
    clean = lambda c: clean_markup_v1(F.coalesce(c, F.lit("")))
    c = hits.where(F.col("pos") <= max_items).select("turn_id", F.col("pos").alias("rank"), "score", F.coalesce(F.nullif(clean("page_name"), F.lit("")), F.lit("Untitled page")).alias("title"), clean("page_snippet").alias("snippet"), clean("page_url").alias("url")).where("snippet <> ''")
    source = F.when(F.col("url") != "", F.concat("title", F.lit(" ("), "url", F.lit(")"))).otherwise(F.col("title"))
    return lines_of(c.select("turn_id", "rank", F.concat(F.lit("[Web "), "rank", score_text(F.col("score"), ", score="), F.lit("] "), source, F.lit(": "), "snippet").alias("line")), "evidence")


def info_lines(hits: DataFrame) -> DataFrame:
    """The plain retrieval agent's context: turn_id, evidence: `[Info i] snippet` of the hits that have one."""
    c = hits.where(F.coalesce("page_snippet", F.lit("")) != "")
    return lines_of(c.select("turn_id", F.col("pos").alias("rank"), F.concat(F.lit("[Info "), "pos", F.lit("] "), "page_snippet").alias("line")), "evidence")


def prompt(mode: Column, question: Column, kg_lines: Column, web_lines: Column) -> Column:
    """Instructions, the evidence that the mode may see, and the question."""
    rules = F.lit("Answer briefly from the picture and the evidence. If they don't settle it, answer exactly: I don't know")
    kg = F.when(mode != "vision", F.concat(F.lit("Image evidence:\n"), F.coalesce(F.nullif(kg_lines, F.lit("")), F.lit("none"))))
    web = F.when(mode == "task2", F.concat(F.lit("Web evidence:\n"), F.coalesce(F.nullif(web_lines, F.lit("")), F.lit("none"))))
    return F.concat_ws("\n\n", rules, kg, web, F.concat(F.lit("Question: "), question))
