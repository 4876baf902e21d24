"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote on a document or abstain, expectation-maximisation estimates how
often each errs, and the posterior probability of good quality decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import store, weak

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"'()+,-./:;=?@[\\]^_`{}~" + SYMBOLS
WINDOW = 5
#: A document is kept from this posterior probability on.
KEEP = 0.5


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than white space (0x20, 0x09-0x0D)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words inside a window of five that occurs at least twice.

    Windows are compared by the chained 64-bit hash of their words. A document
    whose windows all differ, the usual case, stops after counting them; the
    others sort (hash, place), which costs n log n for n words.
    """
    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            twice = F.transform(p, lambda x, k: F.when(
                ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | (F.get(p, k + 1)["h"] == x["h"]), x["i"]))
            return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

        def width(at: Column) -> Column:
            step = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0), lambda total, n: total + n)

        return bind(bind(pairs, places), width)

    def from_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) <= WINDOW, 0).otherwise(bind(windows, from_windows))

    return bind(words, of)


def measure(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, the carried columns and the counts that the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select("doc_id", *carried, text.alias("_text"), words_of(text).alias("_words"), lines.alias("_lines"))
    bare = without(F.col("_text"), SPACE)
    words = F.col("_words")
    adjacent = bind(words, lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))))
    closed = F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?…:。！？।؟][\"'»”’)]*\s*$")))
    return read.select(
        *[c for c in read.columns if c not in ("_text", "_words", "_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        F.length(without(bare, MARKS)).cast("long").alias("n_letters"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        closed.cast("long").alias("n_closed_lines"),
        adjacent.cast("long").alias("n_adjacent_equal"),
        (F.length("_text") - F.length(without(F.col("_text"), "!"))).cast("long").alias("n_exclaims"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )


def rules() -> dict[str, Column]:
    """Rule -> vote: -1 bad, 1 good, 0 abstains."""
    c = F.col
    n = c("n_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": vote(c("n_symbols") * 5 > n, c("n_symbols") * 50 <= n),
        "letters": vote(c("n_letters") * 100 < c("word_chars") * 88, c("n_letters") * 100 > c("word_chars") * 93),
        "dup_lines": vote(c("n_dup_lines") * 3 > c("n_lines"), c("n_dup_lines") * 10 <= c("n_lines")),
        "repeats": vote(c("n_repeat_words") * 10 > n, c("n_repeat_words") * 50 <= n),
        "capitals": vote(c("n_upper") * 10 > c("word_chars") * 4, c("n_upper") * 10 <= c("word_chars") * 2),
        "adjacent": vote(c("n_adjacent_equal") * 5 > n, c("n_adjacent_equal") * 20 <= n),
        "closed_lines": vote((n >= 20) & (c("n_closed_lines") == 0), c("n_closed_lines") * 2 >= c("n_lines")),
        "exclaims": vote(c("n_exclaims") * 5 > n, c("n_exclaims") * 30 <= n),
    }


def judge(docs: DataFrame, *carried: Column) -> DataFrame:
    """One row per document: doc_id, what is carried, counts, votes, ``p_good`` and ``kept``.

    A null or empty text has no words: every count is 0, every rule abstains
    and ``base_failed`` is true. Equal documents get equal rows; a repeated
    row is judged as often as it occurs. No document gives no row. Only
    ``doc_id`` and ``text`` are read, so other columns may have any name.
    """
    votes = {f"vote_{name}": vote for name, vote in rules().items()}
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    voted = measure(docs, *carried).select("*", *[v.cast("int").alias(name) for name, v in votes.items()], base.alias("base_failed"))
    voted = store.stash(voted, "quality-rules")  # the texts are measured once
    model = weak.estimate(weak.vote_patterns(voted, list(votes)), len(votes))
    p_good = model.posterior({name: F.col(name) for name in votes})
    return voted.withColumn("p_good", p_good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns as given."""
    return judge(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).where("kept").select("_row.*")
