"""Text functions as Column expressions.

Java classes are ASCII by default, so word characters and white space are
spelled as Unicode classes (``(?U)``) wherever text of any language may occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions import lexicon as lx

SPACE = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"(?U)[^\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the
    body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(text: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0))


def squeeze(text: Column) -> Column:
    """All white space to single spaces, ends stripped, null to empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(""))


def clean(text: Column) -> Column:
    """Line breaks and tabs to spaces, runs of spaces to one, ends stripped."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[\n\t\r]+", " "), " {2,}", " ")
    return strip(F.coalesce(flat, F.lit("")))


def rounded(number: Column, places: int) -> Column:
    """Half away from zero by the double itself, the sign kept at zero, as SQL
    engines round; Spark's own ``round`` goes by the shortest decimal that prints it."""
    return let(number, lambda x: F.signum(x) * F.round(F.abs(x) * 10.0 ** places) / 10.0 ** places)


# --- counts and readability ------------------------------------------------------


def sentence_count(text: Column) -> Column:
    marks = F.regexp_count(text, F.lit("[.!?]+"))
    return F.when((F.length(text) > 0) & (marks == 0), 1).otherwise(marks)


def average_word_length(chars: Column, count: Column) -> Column:
    return F.when(count > 0, rounded(chars / count, 2)).otherwise(F.lit(0.0))


def readability(count: Column, sentences: Column, average: Column) -> Column:
    per_sentence = count / F.greatest(sentences, F.lit(1))
    weight = F.greatest(average / 5, F.lit(0.1))
    score = 206.835 - 1.015 * per_sentence - 84.6 * weight
    return rounded(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2)


def readability_label(score: Column) -> Column:
    return (F.when(score >= 70, "easy").when(score >= 50, "moderate").when(score >= 30, "difficult")
            .otherwise("very_difficult"))


def length_bucket(count: Column) -> Column:
    return F.when(count < 20, "short").when(count < 80, "medium").when(count < 150, "long").otherwise("very_long")


def tokens_by_words(count: Column) -> Column:
    return F.round(count * 1.3).cast("int")


def tokens_ceiling(text: Column) -> Column:
    return F.ceil(word_count(text) * 1.35).cast("int")


def tokens_by_chars(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")


# --- lexicon columns (take lower-cased text) --------------------------------------


def quick(pattern: str) -> str:
    """The same alternatives behind a look at the next letters, which spares most
    places of a text from trying each alternative. Only lists of plain words gain."""
    words = pattern.split("|")
    heads = [re.match(r"(?:[a-z' ](?![?*{])){0,3}", w)[0] for w in words]
    size = min(map(len, heads))
    if not size or re.search(r"[()\[\]\\]", pattern):
        return pattern
    ahead = "".join(f"[{''.join(sorted({h[i] for h in heads}))}]" for i in range(size))
    return f"(?={ahead})(?:{pattern})"


def hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(quick(pattern)))


def sentiment(lower: Column) -> Column:
    found = F.struct((hits(lower, lx.POSITIVE_STRONG) * 2 + hits(lower, lx.POSITIVE_MILD)).alias("good"), complaint_score(lower).alias("bad"),
                     lower.rlike(rf"(?iU)\b{quick(lx.NEGATIONS)}\b").alias("negated"))

    def score(f: Column) -> Column:
        positive = F.when(f["negated"], f["good"] * 0.5).otherwise(f["good"].cast("double"))
        total = positive + f["bad"]
        return F.when(total > 0, (positive - f["bad"]) / total).otherwise(F.lit(0.0))

    return rounded(let(found, score), 3)


def sentiment_label(score: Column) -> Column:
    return (F.when(score >= 0.3, "positive").when(score <= -0.3, "negative")
            .when(score.between(-0.1, 0.1), "neutral").otherwise("mixed"))


def sentiment_intensity(score: Column) -> Column:
    return F.when(F.abs(score) >= 0.7, "strong").when(F.abs(score) >= 0.4, "moderate").otherwise("mild")


def labels_found(lower: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur, in their order."""
    return F.array_compact(F.array(*[F.when(lower.rlike(quick(p)), name) for name, p in patterns.items()]))


def joined_or_none(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, "none").otherwise(F.array_join(labels, ","))


def complaint_score(lower: Column) -> Column:
    return hits(lower, lx.NEGATIVE_STRONG) * 2 + hits(lower, lx.NEGATIVE_MILD)


def is_urgent(lower: Column) -> Column:
    return lower.rlike(quick(lx.URGENCY))


def intent(lower: Column) -> Column:
    """First label by priority, else general."""
    found = F.coalesce(*[F.when(lower.rlike(quick(p)), name) for name, p in lx.INTENTS.items()])
    return F.coalesce(found, F.lit("general"))


def severity(complaint: Column, score: Column, has_type: Column, urgent: Column) -> Column:
    bad = score <= -0.6
    return (
        F.when((complaint >= 4) & (bad | urgent), "CRITICAL")
        .when((complaint >= 3) | (bad & has_type), "HIGH")
        .when((complaint >= 1) | (score <= -0.2), "MEDIUM")
        .otherwise("LOW")
    )


def list_length(cell: Column) -> Column:
    """Filled entries of a text cell delimited by comma, bar or semicolon."""
    parts = F.filter(F.split(cell.cast("string"), "[,|;]"), lambda p: F.trim(p) != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("short")


# --- rows to documents ------------------------------------------------------------------


def merge_columns(columns: Iterable[Column], separator: str = " | ") -> Column:
    """One text of the filled, not repeated values."""
    parts = [F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"[\n\t\r ]+", " ")), F.lit("")) for c in columns]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), separator)


def combine_fields(columns: Iterable[Column]) -> Column:
    """Distinct filled fields as paragraphs."""
    kept = F.array_distinct(F.array_compact(F.array(*[F.when(strip(c) != "", c) for c in columns])))
    return F.array_join(F.transform(kept, strip), "\n\n")


# --- normal forms and similarity -----------------------------------------------------------


def dedup_form(text: Column) -> Column:
    """Lower case with every run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def compare_form(text: Column) -> Column:
    """Lower case, single spaces, punctuation removed."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " ")
    return F.trim(F.regexp_replace(flat, r"[^\p{L}\p{N}_ ]", ""))


def collapse_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}_\s])\1+", "$1")


def truncate(text: Column, size: int) -> Column:
    short = F.concat(F.regexp_replace(F.substring(text, 1, size), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(text) > size, short).otherwise(text)


def truncate_tokens(text: Column, budget: int, side: str = "left") -> Column:
    """Keeps ``budget`` tokens of four characters; ``left`` drops the oldest."""
    size = budget * 4
    kept = F.substring(text, 1, size) if side == "right" else F.right(text, F.lit(size))
    return F.when(F.length(text) > size, kept).otherwise(text)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; a shorter text is one shingle."""

    def runs(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, size), " "))

    return F.array_distinct(F.filter(let(words(text), runs), lambda s: s != ""))


def shingle_hashes(words: pa.ListArray, size: int = 5) -> list[np.ndarray]:
    """64-bit hashes of the distinct runs of ``size`` words of each row; fewer words are one run."""
    named = words.flatten().dictionary_encode()
    known = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in named.dictionary.to_pylist()], np.uint64)
    hashed = known[named.indices.to_numpy()]
    ends = np.cumsum([0, *pc.list_value_length(words).to_numpy(zero_copy_only=False).tolist()])

    def mixed(total: np.ndarray, word: np.ndarray) -> np.ndarray:
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
        return (total ^ (total >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)

    runs = np.full(max(len(hashed) - size + 1, 0), size, np.uint64)
    for i in range(size):
        runs = mixed(runs, hashed[i:i + len(runs)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        else:
            short = np.full(min(b - a, 1), b - a, np.uint64)
            for i in range(a, b):
                short = mixed(short, hashed[i:i + 1])
            out.append(short)
    return out


@F.arrow_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType())]))
def shingle_print(form: pa.Array) -> pa.Array:
    """Digest of a text in dedup or compare form, hashes of its distinct runs of five words, and its number of words."""
    form = form.cast(pa.large_string())
    words = pc.split_pattern(form, " ")
    flat, owner = words.flatten(), pc.list_parent_indices(words)
    kept = pc.not_equal(flat, "")
    width = np.bincount(owner.filter(kept).to_numpy(), minlength=len(form))
    words = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *width.tolist()])), flat.filter(kept))
    sets = shingle_hashes(words)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    digests = [hashlib.sha256(t.encode()).digest() for t in form.to_pylist()]
    return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                                       pa.array(width.astype(np.int32))], ["digest", "set", "n"])


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / union)


def sequence_ratio() -> Column:
    """Vectorised Ratcliff/Obershelp similarity of two texts in compare form."""
    from difflib import SequenceMatcher

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right)])

    return ratio


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """Compatibility form without combining marks, case folded."""
    import unicodedata

    def fold(value: str | None) -> str:
        parts = unicodedata.normalize("NFKD", value or "")
        return "".join(ch for ch in parts if not unicodedata.combining(ch)).casefold()

    return text.map(fold)


def normalise(text: Column, accents: bool = True, punctuation: bool = True) -> Column:
    """Folded text, punctuation to spaces, single spaces."""
    out = fold_accents(text) if accents else F.lower(text)
    if punctuation:
        out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", " ")
    return squeeze(out)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def identifier_tokens(name: Column) -> Column:
    """Parts of a snake, kebab or camel case name."""
    return tokens(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", " "))


def synonym_map(groups: Iterable[tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Word to its group; a word of several groups keeps the last."""
    return {word: group for group in groups for word in group}


def expand_synonyms(parts: Column, groups: Iterable[tuple[str, ...]]) -> Column:
    table = F.create_map(*[x for word, group in synonym_map(groups).items()
                           for x in (F.lit(word), F.array(*[F.lit(g) for g in group]))])
    more = F.flatten(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), F.array().cast("array<string>"))))
    return F.array_union(parts, more)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the size of the smaller set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    small = F.least(F.size(x), F.size(y))
    return F.when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / small)


def alias_tokens(text: Column, names: dict[str, list[str]] | None = None) -> Column:
    """Text whose tokens are rewritten to the canonical vocabulary."""
    table = {a.lower(): canonical for canonical, aliases in (names or lx.CANONICAL_NAMES).items() for a in [canonical, *aliases]}
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_join(F.transform(words(flat), lambda w: F.coalesce(F.try_element_at(lookup, w), w)), " ")


# --- queries ----------------------------------------------------------------------------------


def without_question_word(text: Column) -> Column:
    bare = F.regexp_replace(strip(text), rf"(?iU)^(?:{lx.QUESTION_WORDS})\b\s*", "")
    return F.regexp_replace(bare, r"^[ ?]+|[ ?]+$", "")


def keywords(text: Column) -> Column:
    """Word tokens without the generic stop words, in order."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(parts, lambda w: ~w.isin(*lx.QUERY_STOPWORDS))


def build_query(text: Column, entities: dict[str, Column] | None = None, boosters: Iterable[Column] = (),
                context: Iterable[Column] = (), synonyms: Column | None = None) -> Column:
    """Query text enriched by entities, boosters, context words and synonyms."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}:"), v.cast("string"))) for k, v in (entities or {}).items()]
    parts += [*boosters, *context]
    if synonyms is not None:
        filled = F.filter(synonyms, lambda s: s.isNotNull() & (s != ""))
        parts.append(F.when(F.size(filled) > 0, F.concat(F.lit("(also: "), F.array_join(filled, ", "), F.lit(")"))))
    parts.append(strip(text))
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " | ")


def query_variants(text: Column, expanded: Column | None = None, limit: int = 3,
                   extra: Column | None = None) -> Column:
    """Distinct reformulations, the (expanded) query first."""
    bare, base = F.lower(strip(text)), strip(expanded if expanded is not None else text)

    def unlike(option: Column) -> Column:
        return let(option, lambda o: F.when(F.lower(o) != bare, o))

    options = F.array(base, unlike(without_question_word(text)), unlike(F.array_join(keywords(text), " ")))
    if extra is not None:
        options = F.concat(options, F.transform(extra, strip))
    filled = F.filter(options, lambda v: v.isNotNull() & (v != ""))

    def first_of_kind(found: Column) -> Column:
        lowered = F.transform(found, F.lower)
        return F.filter(found, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)

    return F.slice(let(filled, first_of_kind), 1, max(1, limit))


def query_type(text: Column) -> Column:
    q = strip(F.coalesce(text, F.lit("")))
    found = F.coalesce(*[F.when(q.rlike(f"(?iU){p}"), name) for name, p in lx.QUERY_TYPES.items()])
    asks = q.endswith("?") | q.rlike(rf"(?iU)^(?:{lx.QUESTION_WORDS})\b")
    return (F.when(q == "", "search").when(found.isNotNull(), found).when(asks, "informational")
            .when(word_count(q) <= 4, "search").otherwise("informational"))


def entities(text: Column) -> Column:
    """Struct of concepts, dates, metrics and acronyms found by pattern."""
    found = {
        "concepts": F.filter(F.regexp_extract_all(text, F.lit(f"(?U){lx.CAPITALISED}"), F.lit(0)),
                             lambda m: ~F.lower(m).isin(*lx.QUERY_STOPWORDS)),
        "dates": F.regexp_extract_all(text, F.lit(f"(?iU){lx.DATE_LIKE}"), F.lit(1)),
        "metrics": F.regexp_extract_all(text, F.lit(f"(?iU){lx.METRIC_LIKE}"), F.lit(1)),
        "acronyms": F.regexp_extract_all(text, F.lit(f"(?U){lx.ACRONYM}"), F.lit(0)),
    }
    return F.struct(*[c.alias(n) for n, c in found.items()])


def numeric_range(text: Column) -> Column:
    """Leftmost "above / below / at least / at most <number>" as struct(gte, lte)."""
    num = r"\s+(\d+(?:\.\d+)?)"
    pattern = rf"(?i)(?:(above)|(below)|(at least|minimum|min)|(at most|maximum|max)){num}"

    def group(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    number = F.nullif(group(5), F.lit("")).cast("double")
    low = (group(1) != "") | (group(3) != "")
    return F.struct(F.when(low, number).alias("gte"), F.when(~low, number).alias("lte"))


# --- checks -------------------------------------------------------------------------------------


def _repeats(parts: Column) -> Column:
    """Whether one run of three words makes up more than half of the distinct runs."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, i, 3), " "))
    # In sorted order the longest run of equal neighbours is the highest count.
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("top"), F.lit(0).alias("kinds"))

    def step(acc: Column, item: Column) -> Column:
        same = (acc["last"] == item) & (acc["n"] > 0)
        n = F.when(same, acc["n"] + 1).otherwise(1)
        return F.struct(item.alias("last"), n.alias("n"), F.greatest(acc["top"], n).alias("top"),
                        F.when(same, acc["kinds"]).otherwise(acc["kinds"] + 1).alias("kinds"))

    often = F.aggregate(F.array_sort(runs), state, step, lambda acc: acc["top"] / acc["kinds"] > 0.5)
    return (F.size(parts) >= 9) & often


def response_status(text: Column) -> Column:
    """Why an answer is unusable: empty, punctuation only, repeating, role
    prefix, malformed; else valid."""
    body = strip(F.coalesce(text, F.lit("")))
    prefixed = F.lit(False)
    for prefix in lx.ROLE_PREFIXES:
        prefixed = prefixed | F.lower(body).startswith(prefix)
    return (
        F.when(body == "", "empty")
        .when(~body.rlike(r"[\p{L}\p{N}]"), "punctuation_only")
        .when(let(words(body), _repeats), "repeated")
        .when(prefixed, "hallucinated_prefix")
        .when(~F.is_valid_utf8(text), "malformed_unicode")
        .otherwise("valid")
    )


def prompt_status(text: Column, blocked: Iterable[str] = (), limit: int = 200_000) -> Column:
    """Why a prompt is refused: blank, too long, null byte, blocked fragment; else ok."""
    lowered = F.lower(text)
    banned = F.lit(False)
    for fragment in blocked:
        banned = banned | lowered.contains(fragment.lower())
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", "blank")
        .when(F.length(text) > limit, "too_long")
        .when(text.contains("\x00"), "null_byte")
        .when(banned, "blocked")
        .otherwise("ok")
    )
