"""Text columns over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import hashing as hs
from gristmill.functions import lexicon as lx
from gristmill.functions import text as tx
from gristmill.operators import intelligence as intel
from gristmill.operators import routing
from gristmill.plans.registry import Tables, query


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def has_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


#: SQL for the clean text; the twin engine's word boundaries are ASCII, so for
#: those patterns letters beyond ASCII are first turned into an ASCII letter.
CLEAN = r"trim(regexp_replace(regexp_replace(text, '[\n\t\r]+', ' ', 'g'), ' {2,}', ' ', 'g'), E' \n\t\r')"
ASCII = r"regexp_replace({0}, '[\x{{80}}-\x{{10FFFF}}]', '_', 'g')"
DOCS = f"with d as (select doc_id, {CLEAN} as c, lower({CLEAN}) as l from documents)"


def labels_sql(text: str, patterns: dict[str, str]) -> str:
    parts = ", ".join(f"case when {has_sql(text, p)} then '{n}' end" for n, p in patterns.items())
    return f"list_filter([{parts}], lambda x: x is not null)"


def word_list_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


SENTIMENT = f"""
, s as (select *, {count_sql('l', lx.POSITIVE_STRONG)} * 2 + {count_sql('l', lx.POSITIVE_MILD)} as p0,
  {count_sql('l', lx.NEGATIVE_STRONG)} * 2 + {count_sql('l', lx.NEGATIVE_MILD)} as n,
  regexp_matches({ASCII.format('l')}, {quoted(rf'\b(?:{lx.NEGATIONS})\b')}) as negated from d),
 v as (select *, case when negated then p0 * 0.5::double else p0::double end as p from s),
 w as (select *, case when p + n > 0 then round((p - n) / (p + n), 3) else 0.0::double end as score from v)"""


def documents(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", tx.clean(F.col("text")).alias("clean")).withColumn("lower", F.lower("clean"))


@query("X1 X23 V1", f"{DOCS} select doc_id, sha256(c) as hash, length(c) as n from d")
def clean_text_hash(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", hs.text_hash(F.col("clean")).alias("hash"), F.length("clean").cast("long").alias("n"))


@query("X2 X3 X5", rf"""{DOCS}, n as (select doc_id, c, length(c) as chars, {count_sql('c', r'[^\s]+')} as words,
  {count_sql('c', '[.!?]+')} as marks from d)
select doc_id, chars, words, case when chars > 0 and marks = 0 then 1 else marks end as sentences,
  case when words > 0 then round(chars / words, 2) else 0 end as average, cast(round(words * 1.3::double) as integer) as by_words,
  cast(ceil(words * 1.35::double) as integer) as ceiling, greatest(chars // 4, 1) as by_chars,
  case when words < 20 then 'short' when words < 80 then 'medium' when words < 150 then 'long' else 'very_long' end as bucket
from n""")
def text_counts(t: Tables) -> DataFrame:
    c, n = F.col("clean"), F.col("words")
    rows = documents(t).withColumn("words", tx.word_count(c)).withColumn("chars", F.length(c))
    return rows.select(
        "doc_id", F.col("chars").cast("long").alias("chars"), n.cast("long").alias("words"),
        tx.sentence_count(c).cast("long").alias("sentences"),
        tx.average_word_length(F.col("chars"), n).alias("average"), tx.tokens_by_words(n).alias("by_words"),
        tx.tokens_ceiling(c).alias("ceiling"), tx.tokens_by_chars(c).alias("by_chars"),
        tx.length_bucket(n).alias("bucket"))


@query("X4", f"""{DOCS} select doc_id, length(c) = 0 as blank, {has_sql('c', '[0-9]')} as numbers, contains(c, '?') as question,
  contains(c, '!') as exclamation, regexp_matches(c, {quoted('(?i)' + lx.CURRENCY)}) as currency, contains(c, '%') as percent from d""")
def text_flags(t: Tables) -> DataFrame:
    docs = t.spread("documents", "doc_id").select("doc_id", F.col("text").alias("chunk_text"))
    return intel.signals(docs).select(
        "doc_id", F.col("is_blank").alias("blank"), F.col("has_numbers").alias("numbers"),
        F.col("has_question").alias("question"), F.col("has_exclamation").alias("exclamation"),
        F.col("has_currency").alias("currency"), F.col("has_percent").alias("percent"))


@query("X6", rf"""{DOCS}, n as (select doc_id, length(c) as chars, {count_sql('c', r'[^\s]+')} as words,
  case when length(c) > 0 and {count_sql('c', '[.!?]+')} = 0 then 1 else {count_sql('c', '[.!?]+')} end as sentences from d),
 r as (select doc_id, round(least(greatest(206.835::double - 1.015::double * (words / greatest(sentences, 1))
   - 84.6::double * greatest(case when words > 0 then round(chars / words, 2) else 0 end / 5, 0.1::double), 0), 100), 2) as score from n)
select doc_id, score, case when score >= 70 then 'easy' when score >= 50 then 'moderate' when score >= 30 then 'difficult'
  else 'very_difficult' end as label from r""")
def readability(t: Tables) -> DataFrame:
    c, n = F.col("clean"), F.col("words")
    rows = documents(t).withColumn("words", tx.word_count(c))
    rows = rows.withColumn("score", tx.readability(n, tx.sentence_count(c), tx.average_word_length(F.length(c), n)))
    return rows.select("doc_id", "score", tx.readability_label(F.col("score")).alias("label"))


@query("X7", f"""{DOCS}{SENTIMENT}
select doc_id, score, case when score >= 0.3 then 'positive' when score <= -0.3 then 'negative'
  when score between -0.1 and 0.1 then 'neutral' else 'mixed' end as label,
  case when abs(score) >= 0.7 then 'strong' when abs(score) >= 0.4 then 'moderate' else 'mild' end as intensity from w""")
def sentiment(t: Tables) -> DataFrame:
    score = F.col("score")
    return documents(t).withColumn("score", tx.sentiment(F.col("lower"))).select(
        "doc_id", "score", tx.sentiment_label(score).alias("label"), tx.sentiment_intensity(score).alias("intensity"))


@query("X8", f"""{DOCS}, a as (select doc_id, {labels_sql('l', lx.ASPECTS)} as found from d)
select doc_id, case when len(found) = 0 then 'none' else array_to_string(found, ',') end as aspects, len(found) as n from a""")
def aspects(t: Tables) -> DataFrame:
    found = F.col("found")
    return documents(t).withColumn("found", tx.labels_found(F.col("lower"), lx.ASPECTS)).select("doc_id", tx.joined_or_none(found).alias("aspects"), F.size(found).cast("long").alias("n"))


STOP_SQL = "[" + ", ".join(quoted(w) for w in sorted(set(lx.TOPIC_STOPWORDS))) + "]"


LETTERS = r"regexp_replace(l, '[^a-z\s]', ' ', 'g')"
NOT_WORD_SQL = r"([^\p{L}\p{N}_]\s*|$)"
QUESTION_SQL = quoted(f"(?i)^(?:{lx.QUESTION_WORDS}){NOT_WORD_SQL}")


@query("X9", rf"""{DOCS}, k as (select doc_id, list_filter({word_list_sql(LETTERS)},
   lambda w: length(w) > 3 and not list_contains({STOP_SQL}, w)) as words from d),
 e as (select doc_id, len(words) as total, unnest(words) as term, unnest(range(len(words))) as pos from k),
 f as (select doc_id, total, term, count(*) as tf, min(pos) as first from e group by all),
 v as (select term, count(*) as df from f group by term),
 s as (select doc_id, term, first, round(tf / total * ln(((select count(*) from documents) + 1) / (df + 1)), 12) as score
   from f join v using (term)),
 b as (select doc_id, term, row_number() over (partition by doc_id order by score desc, first) as n from s),
 g as (select doc_id, string_agg(term, ',' order by n) as topics from b where n <= 5 group by doc_id)
select documents.doc_id, coalesce(topics, 'none') as topics from documents left join g using (doc_id)""")
def topic_words(t: Tables) -> DataFrame:
    return intel.topic_words(t.spread("documents", "doc_id"), "doc_id", "text").withColumnRenamed("topics_keywords", "topics")


@query("X10", f"""{DOCS}, a as (select doc_id, l, {labels_sql('l', lx.COMPLAINT_TYPES)} as found from d)
select doc_id, case when len(found) = 0 then 'none' else array_to_string(found, ',') end as types,
  {count_sql('l', lx.NEGATIVE_STRONG)} * 2 + {count_sql('l', lx.NEGATIVE_MILD)} as score from a""")
def complaints(t: Tables) -> DataFrame:
    found = F.col("found")
    return documents(t).withColumn("found", tx.labels_found(F.col("lower"), lx.COMPLAINT_TYPES)).select("doc_id", tx.joined_or_none(found).alias("types"),
                               tx.complaint_score(F.col("lower")).cast("long").alias("score"))


INTENT_SQL = " ".join(f"when {has_sql('l', p)} then '{n}'" for n, p in lx.INTENTS.items())


@query("X11 X12", f"{DOCS} select doc_id, {has_sql('l', lx.URGENCY)} as urgent, case {INTENT_SQL} else 'general' end as intent from d")
def urgency_and_intent(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", tx.is_urgent(F.col("lower")).alias("urgent"), tx.intent(F.col("lower")).alias("intent"))


@query("X13", f"""{DOCS}{SENTIMENT}, q as (select doc_id, n, score, len({labels_sql('l', lx.COMPLAINT_TYPES)}) > 0 as typed,
  {has_sql('l', lx.URGENCY)} as urgent from w)
select doc_id, case when n >= 4 and (score <= -0.6 or urgent) then 'CRITICAL' when n >= 3 or (score <= -0.6 and typed) then 'HIGH'
  when n >= 1 or score <= -0.2 then 'MEDIUM' else 'LOW' end as severity from q""")
def severity(t: Tables) -> DataFrame:
    low = F.col("lower")
    # As columns, so that each is computed once and not in every branch.
    rows = documents(t).withColumns({
        "complaint": tx.complaint_score(low), "score": tx.sentiment(low),
        "typed": F.size(tx.labels_found(low, lx.COMPLAINT_TYPES)) > 0, "urgent": tx.is_urgent(low)})
    return rows.select("doc_id", tx.severity(F.col("complaint"), F.col("score"), F.col("typed"), F.col("urgent")).alias("severity"))


@query("X14", f"{DOCS} select doc_id, {', '.join(f'{has_sql(chr(108), p)} as {n}' for n, p in lx.SIGNALS.items())} from d")
def domain_signals(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", *[F.col("lower").rlike(tx.quick(p)).alias(n) for n, p in lx.SIGNALS.items()])


@query("X15", """select conv_id, turn, len(list_filter(regexp_split_to_array(text, '[,|;]'), lambda p: trim(p) <> '')) as n from conversations""")
def list_length(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.list_length(F.col("text")).cast("long").alias("n"))


@query("X16", f"""{DOCS}{SENTIMENT}, m as (select case when n >= 4 and (score <= -0.6 or {has_sql('l', lx.URGENCY)}) then 'CRITICAL'
   when n >= 3 or (score <= -0.6 and len({labels_sql('l', lx.COMPLAINT_TYPES)}) > 0) then 'HIGH'
   when n >= 1 or score <= -0.2 then 'MEDIUM' else 'LOW' end as severity, case {INTENT_SQL} else 'general' end as intent,
   {has_sql('l', lx.SIGNALS['price_signal'])} as price_signal, length(c) as chars, score from w)
select severity, intent, price_signal, count(*) as docs, cast(sum(chars) as bigint) as chars, round(avg(score), 6) as score from m group by all""")
def intelligence_table(t: Tables) -> DataFrame:
    """The full table over all documents, then grouped by three of its columns."""
    chunks = t.spread("documents", "doc_id").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    table = intel.generate(chunks)
    return table.groupBy("severity", "intent", "price_signal").agg(
        F.count("*").alias("docs"), F.sum("char_count").alias("chars"),
        F.round(F.avg(F.round(F.col("sentiment_score").cast("double"), 3)), 6).alias("score"))


@query("X17", r"""select c_custkey, array_to_string(list_filter([trim(c_name), trim(c_mktsegment), trim(n_name),
  case when trim(n_name) <> trim(r_name) then trim(r_name) end], lambda x: x is not null and x <> ''), ' | ') as doc
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def merge_columns(t: Tables) -> DataFrame:
    joined = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    texts = [F.col(c) for c in ("c_name", "c_mktsegment", "n_name", "r_name")]
    return joined.select("c_custkey", tx.merge_columns(texts).alias("doc"))


@query("X24 X25", """select c_custkey, sha256(c_name || '|' || cast(c_nationkey as varchar) || '|') as composite,
  sha256(c_name) as named from customer""")
def composite_hash(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_nationkey"), F.col("c_name").alias("name_text"))
    keyed = hs.composite_hash(F.col("name_text"), F.col("c_nationkey"), F.lit(None).cast("string"))
    return rows.select("c_custkey", keyed.alias("composite"), hs.content_hash(rows).alias("named"))


UUID_SQL = """with k as (select doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({0})) as h from documents),
 u as (select doc_id, h[1:12] || '5' || h[14:16] || ['8','9','a','b'][(instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:32] as d from k)
select doc_id, d[1:8] || '-' || d[9:12] || '-' || d[13:16] || '-' || d[17:20] || '-' || d[21:32] as point_id from u"""


@query("X26", UUID_SQL.format("cast(doc_id as varchar)"))
def point_ids_from_key(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("record_id"))
    return rows.select(F.col("record_id").alias("doc_id"), hs.point_id(rows).alias("point_id"))


@query("X26 X24", UUID_SQL.format("sha256(text)"))
def point_ids_from_hash(t: Tables) -> DataFrame:
    rows = t.spread("documents", "doc_id").select("doc_id", hs.text_hash(F.col("text")).alias("text_hash"))
    return rows.select("doc_id", hs.point_id(rows).alias("point_id"))


NORMAL = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))"


@query("X27", rf"""select doc_id, sha256({NORMAL}) as dedup_form,
  sha256(trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'))) as compare_form from documents""")
def normal_forms(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", F.sha2(tx.dedup_form(F.col("text")), 256).alias("dedup_form"),
                              F.sha2(tx.compare_form(F.col("text")), 256).alias("compare_form"))


@query("X28", rf"""with n as (select doc_id, {word_list_sql(NORMAL)} as w from documents)
select doc_id, len(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as shingles from n""")
def shingle_counts(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", F.size(tx.shingles(tx.dedup_form(F.col("text")))).cast("long").alias("shingles"))


@query("X29", rf"""with n as (select conv_id, turn, {word_list_sql(NORMAL)} as w from conversations),
 p as (select a.conv_id, a.turn, list_distinct(a.w) as x, list_distinct(b.w) as y from n a join n b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, case when len(x) = 0 or len(y) = 0 then 0 else round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) end as score from p""")
def jaccard_of_neighbours(t: Tables) -> DataFrame:
    """Word overlap of each message with the next of its conversation."""
    words = F.array_distinct(tx.words(tx.dedup_form(F.col("text"))))
    left = t.conversations.select("conv_id", "turn", words.alias("x"))
    right = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), words.alias("y"))
    return left.join(right, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(tx.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query("X30")
def sequence_similarity_of_neighbours(t: Tables) -> DataFrame:
    form = tx.compare_form(F.col("text"))
    talk = t.spread("conversations", "conv_id")
    left = talk.select("conv_id", "turn", form.alias("x"))
    right = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), form.alias("y"))
    ratio = tx.sequence_ratio()
    return left.join(right, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ratio("x", "y"), 6).alias("score"))


@query("X31", r"""select conv_id, turn, sha256(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'),
  '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) as normal from conversations""")
def unicode_normal_form(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.sha2(tx.normalise(F.col("text")), 256).alias("normal"))


@query("X32", "select conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') as tokens from conversations")
def ascii_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


SYNONYM_SQL = " ".join(
    f"when {quoted(w)} then [{', '.join(quoted(g) for g in group)}]" for w, group in tx.synonym_map(lx.COLUMN_SYNONYMS).items())


@query("X33", f"""with w as (select p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+') as a, ['item', 'ring', 'small'] as b from part),
 x as (select p_partkey, list_distinct(a || flatten(list_transform(a, lambda t: case t {SYNONYM_SQL} else [] end))) as a,
   list_distinct(b || flatten(list_transform(b, lambda t: case t {SYNONYM_SQL} else [] end))) as b from w)
select p_partkey, len(a) as n, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) as score from x""")
def synonym_overlap(t: Tables) -> DataFrame:
    left = tx.expand_synonyms(tx.tokens(F.concat_ws(" ", "p_name", "p_type")), lx.COLUMN_SYNONYMS)
    right = tx.expand_synonyms(F.array(F.lit("item"), F.lit("ring"), F.lit("small")), lx.COLUMN_SYNONYMS)
    rows = t.part.select("p_partkey", left.alias("a"), right.alias("b"))
    return rows.select("p_partkey", F.size("a").cast("long").alias("n"), F.round(tx.overlap(F.col("a"), F.col("b")), 6).alias("score"))


@query("X34", f"""with d as (select doc_id, {ASCII.format('text')} as a from documents)
select doc_id, len(list_filter(regexp_extract_all(a, {quoted(lx.CAPITALISED)}), lambda m: not list_contains([{', '.join(quoted(w) for w in lx.QUERY_STOPWORDS)}], lower(m)))) as concepts,
  array_to_string(regexp_extract_all(a, {quoted('(?i)' + lx.DATE_LIKE)}, 1), '|') as dates,
  array_to_string(regexp_extract_all(a, {quoted('(?i)' + lx.METRIC_LIKE)}, 1), '|') as metrics,
  len(regexp_extract_all(a, {quoted(lx.ACRONYM)})) as acronyms from d""")
def pattern_entities(t: Tables) -> DataFrame:
    found = F.col("found")
    return t.spread("documents", "doc_id").select("doc_id", tx.entities(F.col("text")).alias("found")).select(
        "doc_id", F.size(found["concepts"]).cast("long").alias("concepts"), F.array_join(found["dates"], "|").alias("dates"),
        F.array_join(found["metrics"], "|").alias("metrics"), F.size(found["acronyms"]).cast("long").alias("acronyms"))


QUERY_STOP_SQL = "[" + ", ".join(quoted(w) for w in lx.QUERY_STOPWORDS) + "]"
KEYWORDS_SQL = rf"list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: not list_contains({QUERY_STOP_SQL}, w))"
PLAIN_SQL = rf"""trim(regexp_replace(trim(text, E' \n\t\r'), {QUESTION_SQL}, ''), ' ?')"""


@query("X35", f"select conv_id, turn, array_to_string({KEYWORDS_SQL}[1:8], ' ') as keywords, {PLAIN_SQL} as plain from conversations")
def query_keywords(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", F.array_join(F.slice(tx.keywords(F.col("text")), 1, 8), " ").alias("keywords"),
        tx.without_question_word(F.col("text")).alias("plain"))


@query("X36", rf"""with c as (select conv_id, turn, trim(text, E' \n\t\r') as q, {PLAIN_SQL} as p, array_to_string({KEYWORDS_SQL}, ' ') as k from conversations),
 v as (select conv_id, turn, list_filter([q, case when lower(p) <> lower(q) then p end,
   case when lower(k) <> lower(q) and (lower(k) <> lower(p) or lower(p) = lower(q)) then k end], lambda x: x is not null and x <> '') as vs from c)
select conv_id, turn, unnest(range(len(vs))) as n, sha256(unnest(vs)) as variant from v""")
def query_variants(t: Tables) -> DataFrame:
    variants = t.conversations.select("conv_id", "turn", F.posexplode(tx.query_variants(F.col("text"))).alias("n", "v"))
    return variants.select("conv_id", "turn", F.col("n").cast("long").alias("n"), F.sha2("v", 256).alias("variant"))


TYPE_SQL = " ".join(f"when regexp_matches(a, {quoted('(?i)' + p)}) then '{n}'" for n, p in lx.QUERY_TYPES.items())


@query("X37", rf"""with c as (select conv_id, turn, trim({ASCII.format('text')}, E' \n\t\r') as a from conversations)
select conv_id, turn, case when a = '' then 'search' {TYPE_SQL} when ends_with(a, '?') or regexp_matches(a, {quoted(rf'(?i)^(?:{lx.QUESTION_WORDS})\b')})
  then 'informational' when {count_sql('a', r'[^\s]+')} <= 4 then 'search' else 'informational' end as type from c""")
def query_types(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.query_type(F.col("text")).alias("type"))


ROUTE_SCORES = " + ".join(f"case when regexp_matches(a, {quoted('(?i)' + p)}) then {s}::double else 0 end" for p, s, _ in lx.ROUTE_SIGNALS.values())
ROUTE_SEMANTIC = " + ".join(f"case when regexp_matches(a, {quoted('(?i)' + p)}) then {s}::double else 0 end" for p, _, s in lx.ROUTE_SIGNALS.values())


@query("X38", rf"""with d as (select doc_id, trim(regexp_replace({ASCII.format('text')}, '\s+', ' ', 'g')) as a from documents),
 s as (select doc_id, {ROUTE_SCORES} as x, {ROUTE_SEMANTIC} as y from d),
 n as (select doc_id, x + y as total, x / nullif(x + y, 0) as x, y / nullif(x + y, 0) as y from s)
select doc_id, case when total <= 0 then 'hybrid_parallel' when x >= 0.75 then 'structured_only' when y >= 0.75 then 'semantic_only'
  else 'hybrid_parallel' end as mode, round(case when total <= 0 then 0.3 when x >= 0.75 then x when y >= 0.75 then y
  else 0.5 + 0.5 * (1 - abs(x - y)) end, 4) as confidence, round(coalesce(x, 0), 4) as structured, round(coalesce(y, 0), 4) as semantic from n""")
def route_by_signals(t: Tables) -> DataFrame:
    return routing.route(t.spread("documents", "doc_id"), "text").select(
        "doc_id", "mode", "confidence", F.col("structured_signal").alias("structured"), F.col("semantic_signal").alias("semantic"))


def rule_score_sql(label: str) -> str:
    return " + ".join(f"case when regexp_matches(a, {quoted('(?i)' + p)}) then {w}::double else 0 end" for p, w in lx.ROUTING_RULES[label])


RULE_LIST = ", ".join(f"{{'s': {rule_score_sql(n)}, 'i': {-i}, 'l': '{n}'}}" for i, n in enumerate(lx.ROUTING_RULES))


@query("X39 Y3", rf"""with d as (select doc_id, trim(regexp_replace(regexp_replace({ASCII.format('lower(strip_accents(text))')}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) as a from documents),
 r as (select doc_id, list_reverse_sort([{RULE_LIST}]) as r from d),
 q as (select doc_id, r[1].l as top, r[1].s as s1, r[2].s as s2 from r),
 f as (select doc_id, s1, case when s1 < 0.5 then 'hybrid' when s1 >= 1.2 and s1 - s2 >= 0.4 then top
   when s2 >= 0.6 * 1.2 and s1 - s2 < 0.4 then 'hybrid' else top end as label,
   case when s1 < 0.5 then 0 when s1 >= 1.2 and s1 - s2 >= 0.4 then least(s1 / (s1 + s2 + 1e-9), 0.98)
   when s2 >= 0.6 * 1.2 and s1 - s2 < 0.4 then least(s1 / (s1 + s2 + 1e-9) * 0.85, 0.35) else least(s1 / (s1 + s2 + 1e-9), 0.9) end as c from q)
select doc_id, label, round(c, 4) as confidence from f""")
def classify_by_rules(t: Tables) -> DataFrame:
    return routing.classify(t.spread("documents", "doc_id"), "text").select("doc_id", "label", "confidence")


@query("X40")
def classify_trained_text(t: Tables) -> DataFrame:
    labelled = t.spread("documents", "doc_id").join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    model = routing.train_text(labelled, "text", "label")
    return model(t.spread("documents", "doc_id").select("doc_id", "text")).groupBy("label").agg(F.count("*").alias("docs"))


@query("X41")
def classify_trained_vectors(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    model = routing.train_vectors(rows, "embedding", "label")
    guessed = model(rows.withColumnRenamed("label", "truth"))
    return guessed.agg(F.count("*").alias("rows"), F.round(F.avg((F.col("truth") == F.col("label")).cast("double")), 2).alias("accuracy"))


@query("X42", rf"""with c as (select conv_id, turn, trim(text, E' \n\t\r') as b, {word_list_sql('text')} as w from conversations),
 g as (select conv_id, turn, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as t from c where len(w) >= 9),
 f as (select conv_id, turn, t, count(*) as n from g group by all),
 h as (select conv_id, turn, max(n) / count(*) as share from f group by all)
select c.conv_id, c.turn, case when b = '' then 'empty' when not regexp_matches(b, '[\p{{L}}\p{{N}}]') then 'punctuation_only'
  when share > 0.5 then 'repeated' when starts_with(lower(b), 'assistant:') or starts_with(lower(b), E'assistant\n')
  or starts_with(lower(b), 'user:') or starts_with(lower(b), E'user\n') or starts_with(lower(b), '<|im_start|>') then 'hallucinated_prefix'
  else 'valid' end as status from c left join h on c.conv_id = h.conv_id and c.turn = h.turn""")
def response_checks(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.response_status(F.col("text")).alias("status"))


@query("X43", """select doc_id, case when trim(text) = '' then 'blank' when length(text) > 10000 then 'too_long' when contains(text, chr(0)) then 'null_byte'
  when contains(lower(text), 'password') or contains(lower(text), 'license') then 'blocked' else 'ok' end as status from documents""")
def prompt_checks(t: Tables) -> DataFrame:
    return t.spread("documents", "doc_id").select("doc_id", tx.prompt_status(F.col("text"), ["Password", "license"], 10_000).alias("status"))


@query("X44", r"""select conv_id, turn, case when length(text) > 60 then rtrim(text[1:60], E' \n\t\r') || '…' else text end as short,
  case when length(text) > 80 then text[-80:] else text end as newest,
  length(regexp_replace(regexp_replace(text, '([.])[.]+', '\1', 'g'), '([!])[!]+', '\1', 'g')) <= length(text) as collapses from conversations""")
def truncate_text(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.conversations.select("conv_id", "turn", tx.truncate(text, 60).alias("short"),
                                  tx.truncate_tokens(text, 20).alias("newest"),
                                  (F.length(tx.collapse_punctuation(text)) <= F.length(text)).alias("collapses"))


@query("X45", r"""select p_partkey, case when p_type = p_brand then trim(p_name) || E'\n\n' || trim(p_type)
  else trim(p_name) || E'\n\n' || trim(p_type) || E'\n\n' || trim(p_brand) end as body from part""")
def combine_fields(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.combine_fields([F.col(c) for c in ("p_name", "p_type", "p_name", "p_brand")]).alias("body"))


ALIAS_SQL = " ".join(f"when {quoted(a)} then {quoted(c)}" for c, aliases in lx.CANONICAL_NAMES.items() for a in aliases)


@query("X47", rf"""select event_id, array_to_string(list_transform({word_list_sql(r"regexp_replace(lower('Show cost, stars & feedback by ' || event_type || ' store!'), '[^\p{L}\p{N}_\s]', ' ', 'g')")},
  lambda w: case w {ALIAS_SQL} else w end), ' ') as q from events""")
def canonical_vocabulary(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Show cost, stars & feedback by "), F.col("event_type"), F.lit(" store!"))
    return t.events.select("event_id", tx.alias_tokens(text).alias("q"))


@query("P26", rf"""{DOCS}{SENTIMENT}, m as (select case when {count_sql('c', r'[^\s]+')} < 20 then 'short' when {count_sql('c', r'[^\s]+')} < 80 then 'medium'
   when {count_sql('c', r'[^\s]+')} < 150 then 'long' else 'very_long' end as length_bucket,
   case when score >= 0.3 then 'positive' when score <= -0.3 then 'negative' when score between -0.1 and 0.1 then 'neutral' else 'mixed' end as sentiment_label,
   case {INTENT_SQL} else 'general' end as intent from w),
 u as (select 'length_bucket' as "column", length_bucket as value from m union all select 'sentiment_label', sentiment_label from m union all select 'intent', intent from m)
select "column", value, count(*) as frequency from u group by all""")
def category_summary(t: Tables) -> DataFrame:
    table = intel.signals(t.spread("documents", "doc_id").select("doc_id", F.col("text").alias("chunk_text")))
    return intel.summary(table.select("length_bucket", "sentiment_label", "intent"))
