import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veridix.llm import decontam, edits, htmltext, mpeg, quality, templates
from veridix.llm.common import hash_bytes


@pytest.fixture(scope="module")
def counter():
    return edits.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_edits_equal_a_full_count(counter):
    rng = random.Random(5)
    some = "ab é1 2\n\t 's,.!日   "
    for k in range(250):
        x = "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 5, 50, 400, 3000])))
        x = rng.choice(["    ", "aaaa", "\n\n \n"]) * rng.randint(0, 300) if k % 7 == 0 else x
        d = edits.Document(x, counter)
        for _ in range(5):
            s = rng.randint(0, len(x) + 2)
            e, new = s + rng.choice([0, 0, 1, 3, 20, 200]), "".join(rng.choice(some) for _ in range(rng.choice([0, 1, 2, 10, 300])))
            d.edit(s, e, new)
            s, e = min(s, len(x)), max(min(s, len(x)), min(e, len(x)))
            x = x[:s] + new + x[e:]
            assert (d.text(), d.total, d.length) == (x, len(counter.encoding.encode_ordinary(x)), len(x))


def test_an_edit_reads_little(counter):
    d = edits.Document("word other thing. " * 20_000, counter)
    d.edit(100_000, 100_004, "new")
    assert d.encoded < 60


def test_edit_query(docs, rows, no_docs, counter):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = {r["doc_id"]: r for r in edits.count_edited(docs, path, pattern).collect()}
    for r in rows:
        x = r[1] or ""
        assert got[r[0]]["n_tokens_before"] == len(counter.encoding.encode_ordinary(x))
        for s, e, new in edits.production_edits(len(x)):
            s, e = min(s, len(x)), min(e, len(x))
            x = x[:s] + new + x[max(s, e) :]
        assert (got[r[0]]["n_tokens_after"], got[r[0]]["n_chars_after"]) == (len(counter.encoding.encode_ordinary(x)), len(x))
    assert edits.count_edited(no_docs, path, pattern).count() == 0
    own = docs.select("doc_id", "text").withColumn("edits", F.expr("cast(null as array<struct<start:int,stop:int,new:string>>)"))
    assert edits.count_edited(own, path, pattern).where("n_tokens_before <> n_tokens_after").count() == 0


def test_media_round_trip(docs, rows, no_docs):
    got = {r["doc_id"]: r for r in mpeg.probe_media(mpeg.encode_media(docs)).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = got[r[0]]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert "badcrc=0;resync=0;lost=0" in x["feature"] and len(x["frame_offsets"]) * 1152 / 48000 == pytest.approx(x["duration_seconds"])
    assert mpeg.probe_media(mpeg.encode_media(no_docs)).count() == 0


def test_broken_streams():
    good = mpeg.write_stream(bytes(5000))
    p = mpeg.read_stream(good)
    cut = p.offsets[2]
    q = mpeg.read_stream(good[:cut] + b"junk\xff\xfb" + good[cut:])
    assert (q.resyncs, q.lost_bytes, len(q.offsets), q.payload) == (1, 6, len(p.offsets), p.payload)
    bad = bytearray(good)
    bad[p.offsets[1] + 8] ^= 1  # in the side information
    assert mpeg.read_stream(bytes(bad)).bad_crc == 1
    assert len(mpeg.read_stream(good[:-1]).offsets) == len(p.offsets) - 1
    assert mpeg.read_stream(b"").offsets == [] and mpeg.read_stream(b"\xff" * 50).offsets == []
    tagged = mpeg.read_stream(good + b"TAG" + b"Song".ljust(125, b"\0"))
    assert tagged.tags["TIT2"] == "Song" and tagged.payload == p.payload and p.vbr_frames == len(p.offsets)


def test_a_payload_that_looks_like_a_tag():
    for n in (1100, 3008):
        for k in range(n - 1100, n - 2):
            payload = b"x" * k + b"TAG" + b"y" * (n - k - 3)
            p = mpeg.read_stream(mpeg.write_stream(payload))
            assert (p.payload, p.lost_bytes, "TIT2" in p.tags) == (payload, 0, False)


def test_crc_of_a_known_string():
    assert mpeg.frame_crc(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_html(spark):
    model = htmltext.default_model()
    page = "<html><body><nav><ul><li><a href=/a>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>A &amp; B</h1><p>One  two<br>three.<p>Four <script>x</script>five.</p></article><section class=comments><p>I disagree.</p></section><footer>&copy; me</footer>"
    assert htmltext.main_text(page, model) == "A & B\n\nOne two three.\n\nFour five."
    rows = [(1, "u", page, "x"), (2, None, None, None), (3, "u", "", "x"), (4, "u", "<p", "x"), (1, "u", page, "x"), (5, "u", "<article><p>" + "word. " * 30_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = htmltext.extract_main_text(df).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 33), (1, 33), (2, 0), (3, 0), (4, 0), (5, 179_999)]
    assert htmltext.extract_main_text(df.limit(0)).count() == 0


def test_html_on_held_out_pages():
    model = htmltext.default_model()
    right = sum(htmltext.main_text(s, model) == "\n\n".join(t) for seed in (99, 100, 101) for s, t in htmltext.labelled_pages(200, seed))
    assert right >= 570


HILLS, RAIN = "It stands on seven hills. Nobody counts them.", "Rain falls all year, as they say."
SHAPES = [
    ("<article><header><h1>The old town</h1></header><p>It stands on seven hills. Nobody counts them.</p></article>", ["The old town", "It stands on seven hills. Nobody counts them."]),
    ("<html><body><h1>The old town</h1><p>It stands on seven hills. Nobody counts them.</p><p>Rain falls all year.</p></body></html>", ["The old town", "It stands on seven hills. Nobody counts them.", "Rain falls all year."]),
    ('<body><nav><a href="/">Home</a></nav><article class="article-sidebar-left"><h1>The old town</h1><p>It stands on seven hills. Nobody counts them.</p><p>Rain falls all year, as they say.</p></article><footer>&copy; us</footer>', ["The old town", "It stands on seven hills. Nobody counts them.", "Rain falls all year, as they say."]),
    ("<article><h1>Sums</h1><p>We know that <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is <label>the sum</label> of both.</p></article>", ["Sums", "We know that a+b is the sum of both."]),
    ("<body>It stands on seven hills. Nobody counts them.<br><br>Rain falls all year, as they say.</body>", ["It stands on seven hills. Nobody counts them. Rain falls all year, as they say."]),
    ("<body><h2>The old town</h2><font size=2>It stands on seven hills. Nobody counts them.</font><script>x()</script><p>Rain falls all year, as they say.</p><div class=ads>Buy now.</div></body>", ["The old town", "It stands on seven hills. Nobody counts them.", "Rain falls all year, as they say."]),
    # end tags left out: options, head and body
    (f"<article><p>{HILLS}</p><datalist><option value=a><option value=b></datalist><p>{RAIN}</p></article>", [HILLS, RAIN]),
    (f"<article><p>{HILLS}</p><select><option>a<option>b</select><p>{RAIN}</p></article>", [HILLS, RAIN]),
    (f"<article><p>{HILLS}</p><option>a<p>{RAIN}</p></article>", [HILLS, RAIN]),
    (f"<html><head><title>t</title><p>{HILLS}</p><p>{RAIN}</p>", [HILLS, RAIN]),
    (f"<head><script>var s='</head><p>';</script><template><p>no</p></template></head><body><article><p>{HILLS}</p></article>", [HILLS]),
    # what is dropped ends with the element it stands in, or hides nothing if it never ends
    (f"<article><p>{HILLS}</p><div><button>x</div><p>{RAIN}</p></article><footer><button>y</button></footer>", [HILLS, RAIN]),
    (f"<article><p>{HILLS}</p><video src=x><p>{RAIN}</p></article>", [HILLS, RAIN]),
    # no names at all
    (f"<div><div><div>{HILLS}</div><div>{RAIN}</div></div></div>", [HILLS, RAIN]),
    (f"<body><div><div><a href=/>Home</a> <a href=/b>Blog</a></div><div><div>{HILLS}</div><div>{RAIN}</div></div></div></body>", [HILLS, RAIN]),
    # the footer and address of an article, and the page's
    (f"<body><nav><a href=/>Home</a></nav><article><p>{HILLS}</p><footer><p>Note 1: a source.</p></footer></article><footer><p>Us. All rights reserved.</p></footer>", [HILLS, "Note 1: a source."]),
    (f"<article><p>{HILLS}</p><address>Ada Byron, London.</address></article>", [HILLS, "Ada Byron, London."]),
]


@pytest.mark.parametrize("at", range(len(SHAPES)))
def test_html_of_shapes_that_training_lacks(at):
    source, blocks = SHAPES[at]
    assert htmltext.main_text(source, htmltext.default_model()) == "\n\n".join(blocks)


def test_marginals_equal_enumeration():
    page = htmltext.parse("<div class=ad>x<p>y</p></div><article><p>Long text. More.</p><ul><li>z</li></ul></article>")
    model = htmltext.default_model()
    n = len(page.nodes)
    total, on = 0.0, np.zeros(n)
    for mask in range(1 << n):
        y = [mask >> i & 1 for i in range(n)]
        e = 0.0
        for i, node in enumerate(page.nodes):
            e += y[i] * sum(model.unary[j] * v for j, v in htmltext.node_features(page, node))
            if i:
                e += model.edge[node.kind] * (1 if y[i] == y[node.parent] else -1)
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert htmltext.marginals(page, model) == pytest.approx((on / total).tolist(), abs=1e-6)


ITEMS = [(1, "The red fox ran over seven hills. Who saw it run? An owl did, at night."), (2, "Blue whales sing low songs in cold water\nnobody knows why they stop"), (3, None), (4, ""), (5, "short one")]


def test_leaks(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    filler = "lorem ipsum dolor sit amet " * 60
    rows = [(1, filler + ITEMS[0][1].upper() + filler), (2, "red fox hills owl night " * 3), (3, None), (4, ITEMS[1][1].replace("\n", " ")), (5, filler + "The red fox ran over seven hills. " + filler), (6, "")]
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (4, 2)}
    assert decontam.find_leaks(no_docs, items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0
    assert decontam.find_leaks(docs, items).count() == 0


def test_leaks_equal_every_passage_against_every_item(spark):
    """Full BM25 of every window with every segment, then the overlaps, without index, blocks or essential terms."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{say(rng.randint(4, 12))}? {say(rng.randint(2, 90))}.") for i in range(25)]
    rows = []
    for d in range(60):
        t = say(rng.randint(0, 300)).split()
        if d % 2:
            _, own = rng.choice(items)
            w = own.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            at = rng.randint(0, len(t))
            t[at:at] = w
        rows.append((d, " ".join(t)))
    index = decontam.build_index(items)
    segments = [set(np.concatenate([q, a]).tolist()) for q, a in zip(index.question, index.answer, strict=True)]
    weight = [{} for _ in segments]
    for t, (seg, val) in enumerate(index.postings):
        for s, v in zip(seg.tolist(), val.tolist(), strict=True):
            weight[s][int(index.vocabulary[t])] = v
    assert all(set(w) == s for w, s in zip(weight, segments, strict=True))
    want = set()
    for d, text in rows:
        h = hash_bytes(decontam.terms(text)) if text else np.zeros(0, np.uint64)
        step = decontam.PASSAGE - decontam.OVERLAP
        for s in range(0, max(1, len(h)), step):
            part, near = set(h[s : s + decontam.PASSAGE].tolist()), h[max(0, s - decontam.OVERLAP) : s + decontam.PASSAGE + decontam.OVERLAP]
            for k, w in enumerate(weight):
                if sum(v for t, v in w.items() if t in part) >= index.threshold[k]:
                    shares = [decontam._share(x, near) for x in (index.question[k], index.answer[k])]
                    if min(x for x in shares if x is not None) >= decontam.OVERLAPS:
                        want.add((d, int(index.item[k])))
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 10


def test_wand_equals_full_scoring():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(70)]
    for limit in (1 << 22, 0):
        decontam.DENSE, old = limit, decontam.DENSE
        try:
            index = decontam.build_index(items, threshold=0.5)
        finally:
            decontam.DENSE = old
        for _ in range(150):
            h = hash_bytes([rng.choice(words).encode() for _ in range(rng.randint(1, 60))])
            q = np.unique(np.flatnonzero(np.isin(index.vocabulary, h)))
            score = np.zeros(len(index.item))
            for t in q:
                seg, val = index.postings[t]
                score[seg] += val
            want = {i: score[i] for i in np.flatnonzero(score >= index.threshold)}
            got = dict(decontam.wand(index, q))
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_templates(spark, docs, no_docs):
    head, foot = "This page was made by robots for you", "Read on 12 May at id 77 in our long list of things"
    rows = [(i, f"{head}\nown line {w} of text here\n{foot.replace('12', str(i)).replace('77', str(i * 9))}", "clash") for i, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    rows += [(9, rows[0][1], "clash"), (10, "ok", "x"), (11, None, "x"), (12, "", "x")]
    got = {r["doc_id"]: (r["text"], r["dropped"]) for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, masked string")).collect()}
    assert got[0] == got[9] and got[0][1] == 0
    assert got[1] == ("own line beta of text here", 2)
    assert (got[10], got[11], got[12]) == (("ok", 0), (None, 0), ("", 0))
    assert templates.drop_recurring_lines(no_docs).count() == 0
    assert templates.drop_recurring_lines(docs).count() == docs.count()


def test_templates_generalise_variable_words(spark):
    names = ["anna", "bert", "carl", "dora", "emil", "fred"]
    rows = [(i, f"posted by our friend the user {n} on a sunny day\nbody {n}") for i, n in enumerate(names)]
    got = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["dropped"] for r in got.orderBy("doc_id").collect()] == [0, 1, 1, 1, 1, 1]


def test_templates_take_white_space_and_hexadecimal_fields_alike(spark):
    forms = ["all rights reserved by us\r", "all rights\treserved  by us", " all rights reserved by us", "all\x0brights reserved by\fus "]
    rows = [(i, f"{x}\nbody {'abcd'[i]}\nName\tPrice\tStock\tSeller\nkey {'abcdef'[i] * 16} of the file") for i, x in enumerate(forms)]
    got = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["dropped"], r["text"]) for r in got] == [(0, rows[0][1]), *((3, f"body {c}") for c in "bcd")]


def test_templates_of_one_leaf_are_told_apart(spark):
    names = ["anna", "bert", "carl", "dora"]
    rows = [f"click here to read more about {n} today with us now" for n in names] + [f"click here to join our weekly list for {n} every day" for n in names]
    rows += [f"see also the long list of old {n} in this town" for n in names] + ["see also the " + " ".join(f"{w}{chr(97 + i)}" for w in "qrstuvwx") for i in range(10)]
    got = templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert [r["dropped"] for r in got.orderBy("doc_id").collect()] == [0, 1, 1, 1] * 3 + [0] * 10


def test_short_lines_go_where_asked(spark):
    rows = [(i, f"Menu\n\nown text number {w}") for i, w in enumerate("abcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["dropped"] for r in templates.drop_recurring_lines(df).orderBy("doc_id").collect()] == [0, 1, 1, 1]
    got = templates.drop_recurring_lines(df, min_tokens=1).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["Menu\n\nown text number a", "", "", ""]


def test_templates_equal_sql(spark, tmp_path):
    """Exact forms, templates of whole leaves and of split ones, copies, white space, empty and null texts."""
    rng = random.Random(31)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "pqrst"]
    lines = [
        lambda: "click here to read more about " + rng.choice(names) + " today", lambda: "click here to join our list for " + rng.choice(names) + " now", lambda: f"posted on {rng.randint(1, 30)} May by us all",
        lambda: "See  also\tthe page of " + rng.choice(names), lambda: " ".join(rng.choice(names) for _ in range(rng.randint(1, 9))), lambda: "click here to " + " ".join(rng.choice(names) for _ in range(5)), lambda: "", lambda: "key " + "abcdef"[rng.randrange(6)] * 17 + " of it",
    ]
    texts = ["\n".join(rng.choice(lines)() for _ in range(rng.randint(0, 7))) for _ in range(150)]
    texts += texts[:9] + [None, "", "\n\n"]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in templates.op6_line_templates(spark, str(tmp_path)).select("doc_id", "n_dropped", "n_bytes", "text_md5").collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(db.execute(templates.SQL).fetchall()) and sum(r[1] for r in got) > 200


def test_quality(spark, docs, no_docs):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "ri", "no", "sel", "um", "ka"]) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randint(20, 120))]
        toxic, junk = i % 8 == 1, i % 8 == 2
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["idiotic", "moronic"])
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en", f"s{i % 5}"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in quality.classify(d, known).collect()}
    assert got == {i: bool(t or not q) for i, q, t in labels}
    nothing = quality.classify(docs, known.limit(0))
    assert nothing.where("rejected").count() == 0 and nothing.count() == docs.count()
    assert quality.classify(no_docs, known).count() == 0


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("a", "en", 1)] * 90 + [("a", "en", 0)] * 10 + [("b", "en", 0)] * 100 + [("c", "en", 1)] + [("d", "en", None)]
    got = {r["source"]: r["site_rate"] for r in quality.site_rates(spark.createDataFrame(rows, "source string, lang string, bad int"), ["source", "lang"]).collect()}
    assert got["a"] > 0.8 and got["b"] < 0.1
    assert got["d"] == pytest.approx(92 / 203, abs=0.02) and got["d"] < got["c"] < 0.9


def test_site_rates_equal_plain_python(spark):
    rng = random.Random(21)
    rows = [(f"s{rng.randrange(6)}", rng.choice(["en", "de", None]), rng.choice([None, 0, 0, 1])) for _ in range(500)]
    got = {(r["source"], r["lang"]): (r["site_rate"], r["global_rate"]) for r in quality.site_rates(spark.createDataFrame(rows, "source string, lang string, bad int"), ["source", "lang"]).collect()}
    known = [r for r in rows if r[2] is not None]
    n, k = len(known), sum(r[2] for r in known)
    rate = (k + 1) / (n + 2)

    def level(depth, above, parent):
        sums = {}
        for *place, bad in known:
            c = sums.setdefault(tuple(place[:depth]), [0, 0])
            c[0] += 1
            c[1] += bad
        a, s = sum(y * y / x for x, y in sums.values()), len(sums)
        icc = ((a - above[0]) - rate * (1 - rate) * (s - above[1])) / n / (rate * (1 - rate))
        strength = (1 - icc) / icc if icc > 1e-4 else 1e4
        places = {tuple(r[:depth]) for r in rows}
        return {p: (sums.get(p, (0, 0))[1] + parent(p) * strength) / (sums.get(p, (0, 0))[0] + strength) for p in places}, (a, s)

    hosts, above = level(1, (k * k / n, 1), lambda p: rate)
    paths, _ = level(2, above, lambda p: hosts[p[:1]])
    assert set(got) == set(paths)
    for p, (site, whole) in got.items():
        assert site == pytest.approx(paths[p]) and whole == pytest.approx(rate)


def test_site_weight_follows_the_evidence():
    rng = np.random.default_rng(3)
    shift, odds = rng.choice([-2.0, 2.0], 4000), rng.normal(0, 1, 4000)
    y = lambda w: (rng.random(4000) < 1 / (1 + np.exp(-(odds + w * shift)))).astype(float)
    assert quality.site_weight(odds, shift, y(0.6)) == pytest.approx(0.6, abs=0.08)
    assert quality.site_weight(odds, shift, y(-0.5)) == 0 and quality.site_weight(odds, shift, y(2.0)) == 1
    assert quality.site_weight(odds[:0], shift[:0], odds[:0]) == 0


def test_probabilities_equal_the_formula(spark):
    """classify's p_bad is the regression's log-odds and the weighted site shift, computed here from its parts."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "plain", "WORD!!"]) for _ in range(rng.randint(5, 40))), "en", f"s{i % 4}") for i in range(240)]
    labels = [(i, int(not (i % 4 == 1 and i % 3)), int(i % 11 == 0)) for i in range(0, 240, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, unseen = quality.train(docs, known)
    bad = known.selectExpr("doc_id", "cast(toxic > 0 or quality < 1 as int) bad")
    sites = docs.join(bad, "doc_id", "left")
    rates = {(r["source"], r["lang"]): quality._logit(r["site_rate"]) - quality._logit(r["global_rate"]) for r in quality.site_rates(sites.select("source", "lang", "bad"), quality.LEVELS).collect()}
    half = sites.select("source", "lang", F.when(quality._fold("doc_id") == 0, F.col("bad")).alias("bad"))
    weights = quality._weights(unseen, quality.site_rates(half, quality.LEVELS))
    got = {r["doc_id"]: r for r in quality.classify(docs, known).collect()}
    for i, text, lang, source in rows:
        x = quality.features(model.lexicon, model.weight, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        for odds, w, name in zip(model.log_odds(x), weights, ("p_bad", "p_toxic"), strict=True):
            assert got[i][name] == pytest.approx(1 / (1 + np.exp(-(odds[0] + w * rates[source, lang]))), rel=1e-6)
        assert got[i]["rejected"] == (got[i]["p_bad"] > 0.5 or got[i]["p_toxic"] > 0.5)


def test_other_columns_may_have_any_name(spark):
    """Columns named like an operator's own intermediate or result columns change nothing."""
    html = "<article><h1>A</h1><p>One two three. Four five.</p></article>"
    plain = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    clash = plain.selectExpr("*", "'x' as text", "7 as n_chars", "'y' as b")
    assert htmltext.extract_main_text(clash).collect() == htmltext.extract_main_text(plain).collect()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = spark.createDataFrame([(1, "so: " + ITEMS[0][1])], "doc_id long, text string")
    names = d.selectExpr("*", "9 as item_id", "0.5 as score", "1 as passage_start", "2 as question_overlap", "3 as answer_overlap")
    got = decontam.find_leaks(names, items.selectExpr("*", "5 as doc_id", "1 as score")).collect()
    assert got == decontam.find_leaks(d, items).collect() and len(got) == 1
