"""Text signals on hand-written reviews, chunking against a plain loop."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from gristmill.functions import hashing as hs
from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.operators import chunking as ch
from gristmill.operators import intelligence as intel
from gristmill.operators import routing
from gristmill.plans import catalog
from gristmill.plans.registry import REGISTRY

REVIEWS = {
    1: "Excellent phone, I love it. Good value!",
    2: "Terrible. It broke and the seller was awful, worst purchase ever.",
    3: "Not good, not bad.",
    4: "URGENT: broken screen, still waiting for my refund, defective and useless!",
    5: "How do I install this?",
    6: "Better than the old one, compared to its price of $20 it is 10% cheaper",
    7: "",
    8: None,
    9: "plate",
}


@pytest.fixture(scope="module")
def signals(spark):
    df = spark.createDataFrame(list(REVIEWS.items()), "chunk_id int, chunk_text string")
    return {r["chunk_id"]: r for r in intel.generate(df).collect()}


def test_sentiment(signals):
    assert signals[1]["sentiment_score"] == 1.0 and signals[1]["sentiment_label"] == "positive"
    assert signals[2]["sentiment_score"] == -1.0 and signals[2]["sentiment_intensity"] == "strong"
    # "good" halved by the negation, "bad" full: (0.5 - 1) / 1.5
    assert signals[3]["sentiment_score"] == pytest.approx(-0.333) and signals[3]["sentiment_label"] == "negative"
    assert signals[7]["sentiment_label"] == "neutral"


def test_flags_and_labels(signals):
    assert signals[4]["is_urgent"] and signals[4]["severity"] == "CRITICAL" and signals[4]["intent"] == "complaint"
    # broken, useless, defective count twice, refund once
    assert signals[4]["complaint_score"] == 7
    assert signals[5]["intent"] == "inquiry" and signals[5]["has_question"]
    assert signals[6]["intent"] == "comparison" and signals[6]["has_currency"] and signals[6]["has_percent"] and signals[6]["has_numbers"]
    assert signals[7]["is_blank"] and signals[8]["is_blank"] and signals[8]["clean_chunk_text"] == ""
    assert signals[7]["topics_keywords"] == "none" and signals[7]["sentence_count"] == 0
    assert signals[1]["length_bucket"] == "short" and signals[1]["sentence_count"] == 2


def test_patterns_have_no_word_boundaries(signals):
    assert signals[9]["delivery_signal"] and "delivery" in signals[9]["aspects_detected"]


def test_topic_words_prefer_rare_words(spark):
    df = spark.createDataFrame([(1, "battery battery screen camera"), (2, "camera lens camera"), (3, "")], "id int, t string")
    got = {r["id"]: r["topics_keywords"] for r in intel.topic_words(df, "id", "t").collect()}
    assert got[1].split(",")[0] == "battery" and got[1].split(",")[-1] == "camera" and got[3] == "none"


@pytest.mark.parametrize("common", [0, 1, 3])
def test_topic_words_are_the_same_with_few_common_words(spark, monkeypatch, common):
    df = spark.createDataFrame([(i, " ".join(f"word{chr(97 + (i * k) % 9)}" for k in range(1, 14))) for i in range(20)], "id int, t string")
    want = sorted(intel.topic_words(df, "id", "t").collect())
    monkeypatch.setattr(intel, "COMMON_TERMS", common)
    assert sorted(intel.topic_words(df, "id", "t").collect()) == want


def test_char_ngrams_have_their_sizes_and_are_counted_by_word(spark):
    df = spark.createDataFrame([("Ab c", "x"), ("ab zz ab", "y")], "t string, l string")
    grams = [r[0] for r in df.select(routing.char_ngrams(F.col("t"))).collect()]
    assert sorted(grams[0]) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c ", " c "])
    words = routing._vocabulary(df, "t", 4)
    assert words == [" a", " ab", " ab ", "ab"]
    count = routing._gram_counts(spark.sparkContext.broadcast(words))
    rows = df.select(count(tx.words(F.lower(F.col("t")))).alias("v")).collect()
    assert [r["v"].toArray().tolist() for r in rows] == [[1, 1, 1, 1], [2, 2, 2, 2]]


def test_texts_of_fewer_than_five_words_share_no_shingles(spark, tmp_path):
    long = "one two three four five six"
    spark.createDataFrame([(1, "same four words here"), (2, long)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "Same four words here"), (2, f"a {long}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    catalog.load()
    assert [tuple(r) for r in REGISTRY["shingles_shared_with_benchmark"](spark, str(tmp_path)).collect()] == [(2, 2)]


def plain_chunks(text, size, overlap, least, most):
    """Sequential restatement used only to check the distributed version."""
    def windows(t):
        w = t.split()
        return [" ".join(w[i:i + size]) for i in range(0, len(w), size - overlap)]

    def packed(units):
        out, now = [], []
        for u in units:
            n = len(u.split())
            if n > size:
                out += [" ".join(now)] if now else []
                now = []
                out += windows(u)
            elif sum(len(x.split()) for x in now) + n <= size:
                now.append(u)
            else:
                out.append(" ".join(now))
                tail = []
                for x in now[::-1]:
                    if sum(len(y.split()) for y in tail) + len(x.split()) > overlap:
                        break
                    tail = [x, *tail]
                now = [*tail, u]
        return out + ([" ".join(now)] if now else [])

    text = text.strip()
    if len(text.split()) <= size:
        return [text] if len(text.split()) >= max(1, least) else []
    paras = [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
    sents = lambda t: [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]
    fine = lambda t: packed(sents(t)) if len(sents(t)) > 1 else windows(t)
    raw = []
    for p in (packed(paras) if len(paras) > 1 else [text]):
        raw += [p] if len(p.split()) <= size else fine(p)
    kept = []
    for c in raw:
        if len(c.split()) >= least and c not in kept:
            kept.append(c)
    return kept[:most]


def random_document(seed):
    rng = random.Random(seed)
    parts = []
    for _ in range(rng.randint(1, 6)):
        sentences = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(1, rng.choice([8, 70])))) + rng.choice([".", "!", "?", ""])
                     for _ in range(rng.randint(1, 12))]
        parts.append(" ".join(sentences))
    return rng.choice(["\n\n", "\n", " "]).join(parts)


def test_chunks_equal_the_sequential_rule(spark):
    docs = [(i, random_document(i)) for i in range(150)]
    rule = ch.ChunkRule(40, 10, 5, 25)
    rows = spark.createDataFrame(docs, "id int, t string").select("id", ch.chunk_udf(rule)("t").alias("c")).collect()
    for r in rows:
        assert r["c"] == plain_chunks(docs[r["id"]][1], 40, 10, 5, 25), r["id"]


def test_chunk_table_numbers_chunks_and_caps_words(spark):
    docs = [(i, random_document(i).replace("\n", " ")) for i in range(40)]
    out = ch.chunk_table(spark.createDataFrame(docs, "id int, t string"), "id", ["t"], ch.ChunkRule(40, 10, 1, None)).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in out] == list(range(len(out)))
    assert [(r["record_id"], r["chunk_index"]) for r in out] == sorted((r["record_id"], r["chunk_index"]) for r in out)
    # A chunk may hold the overlap on top of one full unit.
    assert max(r["chunk_word_count"] for r in out) <= 50


def test_whole_documents_without_a_cap(spark):
    long = " ".join(f"w{i}." for i in range(9000))
    rows = spark.createDataFrame([(1, long)], "id int, t string").select(ch.chunk_udf(ch.ChunkRule(most=None))("t").alias("c")).first()["c"]
    assert rows[-1].endswith("w8999.") and len(rows) > 25


def test_chunk_table_function(spark):
    ch.register_chunk_function(spark)
    got = spark.sql("select * from chunk_document(repeat('word ', 20))").collect()
    assert len(got) == 1 and got[0]["chunk_index"] == 0


def test_point_ids_equal_uuid5(spark):
    names = ["1", "abc", "é ß", "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "6BA7B8109DAD11D180B400C04FD430C8", "{6ba7b810-9dad-11d1-80b4-00c04fd430c8}"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", hs.as_point_id(F.col("n")).alias("id"))
    for r in df.collect():
        try:
            want = str(uuid.UUID(r["n"]))
        except ValueError:
            want = str(uuid.uuid5(uuid.NAMESPACE_DNS.__class__(hs.NAMESPACE), r["n"]))
        assert r["id"] == want


def test_point_id_order_of_preference(spark):
    df = spark.createDataFrame([("k", 7, "h"), (None, 7, "h"), ("null", None, "h")], "key string, record_id int, text_hash string")
    got = [r["id"] for r in df.select(hs.point_id(df, ["key"]).alias("id")).collect()]
    space = uuid.UUID(hs.NAMESPACE)
    assert got == [str(uuid.uuid5(space, x)) for x in ("k", "7", "h")]


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


def test_small_text_functions(spark):
    lit = F.lit
    assert one(spark, tx.list_length(lit("a, b|c;; "))) == 3
    assert one(spark, tx.merge_columns([lit(" a\nb "), lit(None), lit("a b"), lit("c")])) == "a b | c"
    assert one(spark, tx.collapse_punctuation(lit("wow!!! ok...?"))) == "wow! ok.?"
    assert one(spark, tx.truncate(lit("hello world"), 6)) == "hello…"
    assert one(spark, tx.shingles(lit("a b c"), 5)) == ["a b c"]
    assert one(spark, tx.shingles(lit("a b c d"), 3)) == ["a b c", "b c d"]
    assert one(spark, tx.shingles(lit(""), 3)) == []
    assert one(spark, tx.identifier_tokens(lit("customerID_code-x"))) == ["customer", "id", "code", "x"]
    assert one(spark, tx.normalise(lit("Éclair,  STRAßE!"))) == "eclair strasse"
    assert one(spark, tx.query_variants(lit("How does the engine work?"))) == ["How does the engine work?", "does the engine work", "how engine work"]
    assert one(spark, tx.build_query(lit("q"), {"brand": lit("x")}, [lit("boost")], synonyms=F.array(lit("s")))) == "brand:x | boost | (also: s) | q"
    assert one(spark, tx.alias_tokens(lit("best SKU by stars!"))) == "best product_id by rating"
    assert one(spark, tx.numeric_range(lit("rated at least 4.5 stars")))["gte"] == 4.5


@pytest.mark.parametrize("text,kind", [
    ("", "search"), ("red shoes", "search"), ("compare a and b", "comparison"), ("summarize the report", "summarization"),
    ("why is it slow", "explanation"), ("where is my parcel", "informational"), ("one two three four five six", "informational"),
    ("what would happen if it rains", "reasoning"), ("trend of sales", "analytical")])
def test_query_type(spark, text, kind):
    assert one(spark, tx.query_type(F.lit(text))) == kind


@pytest.mark.parametrize("text,status", [
    ("  ", "empty"), ("?!...", "punctuation_only"), ("Assistant: hi there", "hallucinated_prefix"), ("a b c " * 5, "repeated"), ("all is well", "valid")])
def test_response_status(spark, text, status):
    # "a b c" five times: 3 distinct runs, the most frequent 5 times.
    assert one(spark, tx.response_status(F.lit(text))) == status


def test_route_and_rules(spark):
    df = spark.createDataFrame([(1, "how many orders last month"), (2, "why do people hate it"), (3, "hello there")], "id int, q string")
    assert {r["id"]: r["mode"] for r in routing.route(df, "q").collect()} == {1: "structured_only", 2: "semantic_only", 3: "hybrid_parallel"}
    follow = spark.createDataFrame([("and what about those, compare them", "semantic_only", 2)], "q string, last string, turns int")
    assert routing.route(follow, "q", "last", "turns").first()["mode"] == "hybrid_sequential"
    rules = routing.classify(df, "q").collect()
    assert {r["id"]: r["label"] for r in rules} == {1: "structured", 2: "semantic", 3: "hybrid"}
    custom = {"a": [routing.keyword_matcher([("hello", 2.0)])], "b": [routing.phrase_matcher([("last month", 2.0)])]}
    got = routing.classify(df, "q", custom, fallback="none", available={"vector"}).collect()
    assert {r["id"]: r["label"] for r in got} == {1: "b", 2: "none", 3: "a"}


def test_patterns_are_looked_for_where_their_words_are(spark):
    rng, pieces = random.Random(3), [" ", " ", " ", ".", "-", "_", "'", "x", "1", "2024", "\u0661\u0662\u0663\u0664", "\u00e9", "\u0301", "\u0130", "\u0131", "\u017f", "\u212a"]
    for pattern, _, _ in lx.ROUTE_SIGNALS.values():
        assert all(word.isalpha() or not word for word in routing.first_words(pattern))
        pieces += re.findall("[a-z]+", pattern.replace("\\b", "").replace("\\d", ""))
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 5))) for _ in range(6000)]
    texts += [t.upper() for t in texts[:2000]] + ["\u017fum", "ran\u212a", "t\u0130me", "\u0130\u017f\u017fue", "doesn't work", "vs.", "filtered by", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    marked, flags = routing.with_signals(df, "text")
    assert "CASE WHEN" in marked._jdf.queryExecution().optimizedPlan().toString()
    plain = [tx.squeeze(F.col("text")).rlike(f"(?iU){pattern}") for pattern, _, _ in lx.ROUTE_SIGNALS.values()]
    rows = marked.select("text", F.array(*flags.values()).alias("got"), F.array(*plain).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows), [r for r in rows if r["got"] != r["want"]][:3]
    assert all(0 < sum(r["want"][k] for r in rows) < len(rows) for k in range(len(flags)))


def test_trained_text_classifier_separates(spark):
    rows = [("count the rows total", "sql")] * 6 + [("people feel happy opinions", "text")] * 6
    df = spark.createDataFrame(rows, "q string, label string")
    model = routing.train_text(df, "q", "label")
    got = model(spark.createDataFrame([("total count",), ("happy people",)], "q string")).collect()
    assert [r["label"] for r in got] == ["sql", "text"] and all(r["confidence"] <= 0.95 for r in got)


@pytest.mark.parametrize("spec, ids", [
    ({"k": {"not_in": [1, 2]}}, {3}), ({"k": {"is_null": True}}, {4}), ({"k": {"is_null": False}}, {1, 2, 3}), ({"k": {"is_not_null": True}}, {1, 2, 3}),
    ({"t": {"ilike": "A_"}}, {1}), ({"k": {"between": [2, 3]}}, {2, 3}),
])
def test_every_filter_filters(spark, spec, ids):
    from gristmill.operators import filters as flt

    df = spark.createDataFrame([(1, 1, "ab"), (2, 2, "abc"), (3, 3, "b"), (4, None, None)], "id int, k int, t string")
    assert {r["id"] for r in df.filter(flt.from_spec(df, spec)).collect()} == ids


@pytest.mark.parametrize("spec", [{"k": {"near": 1}}, {"k": {"between": [1]}}, {"k": {"is_null": 1}}])
def test_unknown_filters_are_errors(spark, spec):
    from gristmill.operators import filters as flt

    df = spark.createDataFrame([(1, 1)], "id int, k int")
    with pytest.raises(ValueError):
        flt.from_spec(df, spec)


def test_rounding_goes_by_the_double(spark):
    values = [686 / 80, 4899 / 600, -0.0000004, 2.5, -2.5, 0.0]
    row = spark.createDataFrame([(v,) for v in values], "v double").select("v", tx.rounded(F.col("v"), 2).alias("r")).collect()
    assert [repr(r["r"]) for r in row] == ["8.57", "8.16", "-0.0", "2.5", "-2.5", "0.0"]
    counts = spark.createDataFrame([(686, 80)], "chars int, n int")
    assert counts.select(tx.average_word_length(F.col("chars"), F.col("n"))).first()[0] == 8.57


def test_quick_patterns_find_the_same():
    rng = random.Random(2)
    lists = [lx.POSITIVE_STRONG, lx.POSITIVE_MILD, lx.NEGATIVE_STRONG, lx.NEGATIVE_MILD, lx.NEGATIONS, lx.URGENCY,
             *lx.ASPECTS.values(), *lx.COMPLAINT_TYPES.values(), *lx.INTENTS.values(), *lx.SIGNALS.values()]
    for pattern in lists:
        assert tx.quick(pattern) != pattern
        pieces = [p.replace("?", "") for p in pattern.split("|")] + [p[:-1] for p in pattern.split("|")] + [" ", "x", "day ago", "userxfriendly", "followup", "é"]
        for _ in range(200):
            text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
            assert re.findall(tx.quick(pattern), text) == re.findall(pattern, text)
    assert tx.quick("a?b|cd") == "a?b|cd" and tx.quick(lx.CURRENCY) == lx.CURRENCY


def test_classifying_long_texts_holds_few_bytes_at_a_time(spark):
    long = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("count rows "), 1000).alias("text"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        routed = routing.classify(long, "text").select("label")
        held = F.pandas_udf(lambda s: s.map(len).sum() + 0 * s.map(len), "long")
        assert long.agg(F.max(held("text"))).first()[0] <= 9 << 20
        assert {r["label"] for r in routed.limit(5).collect()} == {"structured"}
    finally:
        spark.conf.set(key, before)
