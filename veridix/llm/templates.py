"""Operator 6 (native): line dedup by a fixed-depth template tree.

The tree has three levels: the token count of a line, its leading tokens with fields masked, and a leaf that holds
the lines' masked forms. In a leaf, positions whose tokens vary between the lines are generalised too, so lines
that differ in variable fields alone meet in one template. A template that stands in enough different texts is
recurring, and its lines are dropped from all texts but the first that has it. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridix.llm.common import cut, flagged, maybe, read_table, remove_written, tables_written

#: Leading tokens that route a line below its token count.
DEPTH = 3
#: Different texts a template must stand in to be recurring.
MIN_TEXTS = 3
#: A position is variable where no token holds this part of the leaf's lines.
DOMINANT = 0.5
#: Lines of fewer tokens are kept unless the caller asks otherwise: a heading or a closing bracket isn't boilerplate.
MIN_TOKENS = 3
#: Of a leaf's positions at most this part may be variable; a leaf with more holds unrelated lines.
VARIABLE = 0.3


def _has(t: Column, *parts: str) -> Column:
    return reduce(or_, [F.contains(t, F.lit(c)) for c in parts])


def spaced_once(t: Column) -> Column:
    """White space in a line as one space; only texts that have other white space pay for it."""
    return F.when(_has(t, "  ", "\t", "\r", "\x0b", "\f"), F.regexp_replace(t, r"[ \t\x0B\f\r]+", " ")).otherwise(t)


def trimmed(t: Column) -> Column:
    """No space at a line's ends."""
    return F.trim(F.when(_has(t, " \n", "\n "), F.regexp_replace(t, " ?\n ?", "\n")).otherwise(t))


def mask_digits(t: Column) -> Column:
    """Tokens that hold a digit as <*>."""
    return F.when(t.rlike("[0-9]"), F.regexp_replace(t, "(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")).otherwise(t)


def mask_hexadecimal(t: Column) -> Column:
    """Of a text without digits, long hexadecimal tokens as <*>."""
    return F.when(t.rlike("[a-f]{16}"), F.regexp_replace(t, "(?<![^ \n])[a-f]{16,}+(?![^ \n])", "<*>")).otherwise(t)


def _lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(text_id, doc_id, place, n, masked, form): every line with enough tokens."""
    masked = F.array("text")  # whole texts, once for all their lines
    for step in (F.lower, spaced_once, trimmed, mask_digits, mask_hexadecimal):
        masked = F.transform(masked, step)  # a lambda's variable is computed once, however often the step names it
    masked = docs.select("text_id", "doc_id", F.posexplode(F.split(masked[0], "\n")).alias("place", "masked"))
    n = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return masked.withColumn("n", n).where((F.col("n") >= min_tokens) & (F.col("masked") != "")).withColumn("form", F.xxhash64("masked"))


def _agreeing(words: DataFrame) -> DataFrame:
    """words (leaf, form, all, texts, first, n, tokens) -> those that agree with their leaf at all its fixed positions, of
    leaves with few enough variable ones. A position has one fixed token at most, so a leaf's are one short array, which
    meets whole forms."""
    weight = words.select("leaf", "all", "texts", "n", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("texts").alias("c"), F.max("all").alias("all"), F.max("n").alias("n"))
    fixed = weight.where(F.col("c") > F.col("all") * DOMINANT).groupBy("leaf").agg(F.collect_list(F.struct("at", "token")).alias("fixed"), F.max("n").alias("most"))
    shape = fixed.where(F.size("fixed") >= F.col("most") * (1 - VARIABLE)).select("leaf", "fixed")
    return words.join(shape, "leaf").where(F.forall("fixed", lambda f: F.get("tokens", f["at"]) == f["token"])).select("leaf", "form", "texts", "first")


def _split(words: DataFrame, depth: int, min_texts: int, rare: bool) -> DataFrame:
    """words (leaf, form, all, texts, first, n, tokens) -> the same of smaller leaves: a form goes to the rarest (or the most
    common) of its further tokens that stand in enough texts of its leaf, so neither another template nor unrelated lines
    outvote its own. A form goes to one leaf, so there are no more rows than before."""
    tokens = words.select("leaf", "form", "texts", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= depth)
    weight = tokens.groupBy("leaf", "at", "token").agg(F.sum("texts").alias("all")).where(F.col("all") >= min_texts)
    pick = F.min(F.struct("all", "at", "token")) if rare else F.max(F.struct("all", "at", "token"))
    named = tokens.join(weight, ["leaf", "at", "token"]).groupBy("leaf", "form").agg(pick.alias("g"), F.max("texts").alias("texts"))
    named = cut(named.select("form", "texts", F.xxhash64("leaf", "g.at", "g.token").alias("leaf")))
    full = named.groupBy("leaf").agg(F.sum("texts").alias("all")).where(F.col("all") >= min_texts)
    return words.drop("leaf", "all").join(named.join(full, "leaf").select("form", "leaf", "all"), "form")


def _hits(docs: DataFrame, min_texts: int, depth: int, min_tokens: int) -> DataFrame:
    """recurring_lines, a line once for each copy of its text."""
    leaf = F.xxhash64("n", F.substring_index("masked", " ", depth))
    seen = cut(_lines(docs, min_tokens).select("text_id", "doc_id", "place", "n", "form", leaf.alias("leaf")))
    first = F.struct("doc_id", "place", "text_id")
    # copies of a text and repeats in it fall together here, and a hot form is partly summed before it is shuffled
    per_text = seen.groupBy("leaf", "form", "n", "text_id").agg(F.min(first).alias("first"))
    forms = cut(per_text.groupBy("leaf", "form", "n").agg(F.count("*").alias("texts"), F.min("first").alias("first")))
    exact = forms.where(F.col("texts") >= min_texts).select("form", "first")

    # leaves of several forms, none of them recurring by itself: their positions are looked at
    rest = forms.where(F.col("texts") < min_texts)
    crowded = cut(rest.groupBy("leaf").agg(F.sum("texts").alias("all"), F.count("*").alias("kinds")).where((F.col("kinds") > 1) & (F.col("all") >= min_texts)).select("leaf", "all"))
    wanted = cut(maybe(rest, "leaf", crowded).join(crowded, "leaf").select("leaf", "form", "all", "texts", "first"))
    holders = maybe(docs, "text_id", wanted.select(F.col("first.text_id").alias("text_id")))
    some = maybe(_lines(holders, min_tokens).select("form", "n", "masked"), "form", wanted)
    tokens = F.transform(F.split("masked", " "), lambda t: F.xxhash64(t))
    left = cut(some.dropDuplicates(["form"]).join(wanted, "form").select("leaf", "form", "all", "texts", "first", "n", tokens.alias("tokens")))
    drop = exact
    for rare in (None, True, False):
        parts = left if rare is None else cut(_split(left, depth, min_texts, rare))
        held = cut(_agreeing(parts))
        inside = held.groupBy("leaf").agg(F.sum("texts").alias("all"), F.min("first").alias("kept")).where(F.col("all") >= min_texts)
        whole = cut(held.join(inside, "leaf").select("form", F.col("kept").alias("first")))
        drop = drop.unionAll(whole)
        if rare is not False:
            left = cut(left.join(whole.select("form"), "form", "left_anti"))
    drop = cut(drop)
    hit = maybe(seen, "form", drop).join(drop, "form")
    return hit.where((F.col("text_id") != F.col("first.text_id")) | (F.col("place") != F.col("first.place"))).select("text_id", "place")


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, depth: int = DEPTH, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs (text_id, doc_id, text) -> (text_id, place): lines to drop, by text and line number; text_id is a hash of
    the text, so its copies are one text.

    Masked forms that recur as they are; then, among leaves with enough different texts, forms generalised at the
    leaf's variable positions; then the same twice among a leaf's forms that are left, split by a further token (see
    _split). A template's first line, by (doc_id, place), stays.
    """
    return _hits(docs, min_texts, depth, min_tokens).distinct()


def drop_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """docs (doc_id, text, ...) -> the same rows and columns with recurring lines taken out of text, and `dropped`, the
    number of lines that went.

    Equal texts are one text, so copies of a document don't make its lines recurring and stay equal; of a template's
    lines the one of the smallest doc_id stays. Null texts stay null, empty ones empty; lines of fewer than
    `min_tokens` tokens stay (1: none, blank lines aside); line ends stay as they are. Rows with null or repeated ids are kept; an empty table
    gives no rows; an input column named `dropped` goes.
    """
    docs = docs.drop("dropped")
    text_id = F.xxhash64("text")
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    named = docs.where("text is not null").select(text_id.alias("text_id"), own.alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = tables_written()
    marks = cut(_hits(named, min_texts, DEPTH, min_tokens).groupBy(F.col("text_id").alias("__h")).agg(F.collect_set("place").alias("__gone")))
    remove_written(at, keep=1)
    told = flagged(docs.withColumn("__h", text_id), "__h", marks)  # texts that surely keep all their lines aren't shuffled
    some = told.where("__maybe").join(marks.hint("merge"), "__h", "left")  # the plan of any large input
    out = told.where("not __maybe").withColumn("__gone", F.lit(None).cast("array<int>")).unionByName(some).drop("__maybe")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).alias("dropped"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("dropped").cast("long").alias("n_dropped"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


QUERIES = {"op6_line_templates": op6_line_templates}


def _judged(tokens: str, name: str) -> str:
    """CTEs that judge a tokens table as recurring_lines does: {name} (form, kept) are its recurring templates' forms."""
    return f"""{name}w AS (SELECT leaf, pos, token, sum(texts) AS c, max(whole) AS whole, max(n) AS n FROM {tokens} GROUP BY 1, 2, 3),
{name}f AS (SELECT leaf, pos, token, n FROM {name}w WHERE c > whole * {DOMINANT}),
{name}s AS (SELECT leaf, count(*) AS held FROM {name}f GROUP BY 1 HAVING count(*) >= max(n) * {1 - VARIABLE}::DOUBLE),
{name}a AS (SELECT t.leaf, t.form, max(s.held) AS held, count(*) AS same FROM {tokens} t JOIN {name}f f ON t.leaf = f.leaf AND t.pos = f.pos AND t.token = f.token JOIN {name}s s ON t.leaf = s.leaf GROUP BY 1, 2),
{name}h AS (SELECT a.leaf, a.form, m.texts, m.first FROM {name}a a JOIN forms m ON a.form = m.form WHERE a.same = a.held),
{name}i AS (SELECT leaf, min(first) AS kept FROM {name}h GROUP BY 1 HAVING sum(texts) >= {MIN_TEXTS}),
{name} AS (SELECT h.form, i.kept FROM {name}h h JOIN {name}i i ON h.leaf = i.leaf)"""


def _dealt(tokens: str, name: str, pick: str) -> str:
    """CTEs that deal the forms of a tokens table to smaller leaves: the tokens table {name}."""
    return f"""{name}w AS (SELECT leaf, pos, token, sum(texts) AS c FROM {tokens} WHERE pos >= {DEPTH} GROUP BY 1, 2, 3 HAVING sum(texts) >= {MIN_TEXTS}),
{name}g AS (SELECT t.form, any_value(t.leaf) AS leaf, {pick}([w.c, t.pos]) AS g, max(t.texts) AS texts FROM {tokens} t JOIN {name}w w ON t.leaf = w.leaf AND t.pos = w.pos AND t.token = w.token GROUP BY 1),
{name}n AS (SELECT g.form, g.texts, g.leaf || chr(1) || t.pos || chr(1) || t.token AS leaf FROM {name}g g JOIN {tokens} t ON g.form = t.form AND g.g[2] = t.pos),
{name}a AS (SELECT leaf, sum(texts) AS whole FROM {name}n GROUP BY 1 HAVING sum(texts) >= {MIN_TEXTS}),
{name} AS (SELECT t.form, t.texts, t.n, t.pos, t.token, n.leaf, a.whole FROM {tokens} t JOIN {name}n n ON t.form = n.form JOIN {name}a a ON n.leaf = a.leaf)"""


#: The same over the strings themselves: no hashes, no bitmaps.
SQL = rf"""
WITH texts AS (SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1),
raw AS (SELECT text, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM texts),
spaced AS (SELECT text, doc_id, place, trim(regexp_replace(lower(line), '[ 	
]+', ' ', 'g')) AS line FROM raw),
words AS (SELECT text, doc_id, place, list_transform(string_split(line, ' '), lambda z: CASE WHEN regexp_matches(z, '[0-9]') OR regexp_full_match(z, '[a-f]{{16,}}') THEN '<*>' ELSE z END) AS w FROM spaced WHERE line <> ''),
lines AS (SELECT text, doc_id, place, len(w) AS n, array_to_string(w, ' ') AS form, len(w) || chr(1) || array_to_string(w[1:{DEPTH}], ' ') AS leaf FROM words WHERE len(w) >= {MIN_TOKENS}),
forms AS (SELECT form, any_value(leaf) AS leaf, any_value(n) AS n, count(DISTINCT text) AS texts, min([doc_id, place]) AS first FROM lines GROUP BY 1),
crowded AS (SELECT leaf, sum(texts) AS whole FROM forms WHERE texts < {MIN_TEXTS} GROUP BY 1 HAVING count(*) > 1 AND sum(texts) >= {MIN_TEXTS}),
t0 AS (SELECT form, texts, n, unnest(string_split(form, ' ')) AS token, generate_subscripts(string_split(form, ' '), 1) - 1 AS pos, leaf, whole FROM forms JOIN crowded USING (leaf) WHERE texts < {MIN_TEXTS}),
{_judged('t0', 'r0')},
l1 AS (SELECT * FROM t0 WHERE form NOT IN (SELECT form FROM r0)),
{_dealt('l1', 't1', 'min')},
{_judged('t1', 'r1')},
l2 AS (SELECT * FROM l1 WHERE form NOT IN (SELECT form FROM r1)),
{_dealt('l2', 't2', 'max')},
{_judged('t2', 'r2')},
gone AS (SELECT form, first AS kept FROM forms WHERE texts >= {MIN_TEXTS} UNION ALL SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2),
hits AS (SELECT DISTINCT text, place FROM lines JOIN gone USING (form) WHERE [doc_id, place] <> kept),
marks AS (SELECT text, list(place) AS places FROM hits GROUP BY 1),
cleaned AS (SELECT doc_id, coalesce(len(places), 0) AS n_dropped, CASE WHEN places IS NULL THEN text ELSE coalesce((SELECT string_agg(r.line, chr(10) ORDER BY r.place) FROM raw r WHERE r.text = documents.text AND NOT list_contains(places, r.place)), '') END AS text FROM documents LEFT JOIN marks USING (text))
SELECT doc_id, n_dropped, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5 FROM cleaned"""

ORACLE: dict[str, str] = {"op6_line_templates": SQL}
