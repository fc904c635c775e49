import math
import time

import pytest
from pyspark.sql import functions as F

from veridix.functions import text as X
from veridix.functions.stats import mcnemar_p, percentile_linear, percentiles


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("[[Frank Gehry|Gehry]]<br />{{convert|870|ft|m|0}} &amp; Co.", "Gehry 870 ft & Co."), ("{{URL|x.org}} {{other|a}} ;|", "x.org"), ("", ""), ("  a\n\tb ", "a b")],
)
def test_clean_markup(spark, raw, clean):
    assert one(spark, X.clean_markup(F.col("t")), t=raw) == clean


def test_tokens_and_numbers(spark):
    assert one(spark, X.tokens(F.col("t")), t="A-b 12") == ["a", "b", "12"]
    assert one(spark, X.numbers(F.col("t")), t="x12 3.5 7") == ["2", "3.5", "7"]
    assert one(spark, X.terms(F.col("t")), t="What is the Tower of a Tower") == ["tower"]


def test_token_f1(spark):
    f1 = X.token_f1(X.tokens(F.col("a")), X.tokens(F.col("b")))
    assert one(spark, f1, a="", b="x") == 0.0
    assert one(spark, f1, a="x y", b="y z z") == pytest.approx(0.5)


def test_strip_takes_unicode_space(spark):
    assert one(spark, X.strip(F.col("t")), t="  a \n") == "a"


def test_evidence_line_rounds_half_to_even(spark):
    assert one(spark, X.evidence_line(F.lit("KG1"), F.col("s"), F.lit("t")), s=0.0625) == "[KG1 score=0.062] t"


def test_normalise_answer(spark):
    got = lambda t: tuple(one(spark, X.normalise_answer(F.col("t")), t=t))
    assert got("") == (X.IDK, "empty_generation")
    assert got("Well, i do  not know") == (X.IDK, "insufficient_evidence")
    assert got(" Paris ") == ("Paris", None)


def test_urls(spark):
    thumb = X.thumbnail_url(F.col("t"))
    assert one(spark, thumb, t="https://upload.wikimedia.org/wikipedia/commons/a/ab/F.jpg") == "https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/F.jpg/1280px-F.jpg"
    assert one(spark, thumb, t="https://example.org/wikipedia/commons/a/ab/F.jpg") is None
    assert one(spark, X.cache_key_md5(F.col("t")), t="http://a.b/c?x=1.png").endswith(".jpg")
    assert one(spark, X.is_url(F.col("t")), t="no") is False
    with pytest.raises(ValueError, match="positive"):
        X.thumbnail_url(F.lit("x"), 0)


def test_number_with_unit(spark):
    assert one(spark, X.number_with_unit(F.col("t")), t=" 100 MiB") == 100.0


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    r = df.agg(percentile_linear(F.col("v"), 0.5), percentile_linear(F.col("v"), 0.95)).first()
    assert tuple(r) == pytest.approx((2.5, 3.85))
    assert percentiles(df, [], "v", {"p": ("nearest", 0.5)}).first()["p"] == 3
    assert percentiles(df.where("v > 9"), [], "v", {"p": ("nearest", 0.5)}).first()["p"] is None


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (1, 0, 1.0), (8, 2, 0.109375), (20, 40, 2 * sum(math.comb(60, k) for k in range(21)) / 2**60)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, mcnemar_p(F.col("b"), F.col("c")), b=b, c=c) == pytest.approx(p, abs=1e-9)


def test_mcnemar_of_large_counts(spark):
    """The cost of a group grows with the root of its count; the sum is that of all terms."""

    def exact(b, c):
        n, k = b + c, min(b, c)
        top = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
        return min(1.0, 2 * math.fsum(map(math.exp, top)))

    pairs = [(0, 5), (1, 0), (3, 3), (17, 40), (16, 16), (2000, 2100), (100_000, 100_400), (1_000_000, 1_001_500), (90_000, 120_000)]
    df = spark.createDataFrame(pairs, "b long, c long")
    got = [r[0] for r in df.coalesce(1).select(mcnemar_p(F.col("b"), F.col("c"))).collect()]
    assert got == pytest.approx([exact(b, c) for b, c in pairs], rel=1e-7, abs=1e-300)
    began = time.perf_counter()
    assert len(spark.range(300, numPartitions=1).select(mcnemar_p(F.lit(50_000) + F.col("id"), F.lit(50_500) + F.col("id")).alias("p")).where("p > 0").collect()) == 300
    assert time.perf_counter() - began < 60
