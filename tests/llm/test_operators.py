"""The operators against brute force on small tables, with the awkward cases of each."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import (
    bpe, graph, html_text, kmeans_tree, language, near_sets, packing, quality_rules, queries, simhash, suffix_dedup, warc, weak, weak_quality,
)

FOLDER = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n", "One.", "a  b", " a b ", "tab\tand\xa0space here", "it's  I'll", "é" * 120, "x" * 400, "日本 語 1 23 4a", "<|endoftext|> hi",
         "The same text twice over.", "The same text twice over."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, host string"


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts with clashing extra columns, a repeated row and a null doc_id."""
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 9.0, None, "h") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id at all", "en", None, None, None, True, None)], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- repeated strings -------------------------------------------------------------------------

def without_repeats(rows):
    seen, out = set(), {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if (w := raw[s:s + 100]) in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, y in zip(raw, gone) if not y)
        out[doc_id] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def cut_texts():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2500))
    for i in range(50):
        at = rng.randrange(2000)
        text = base[at:at + rng.randrange(50, 500)]
        if i % 3:
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice("éXY") + text[k:]
        if i % 7 == 0:
            text = "x" * rng.randrange(300) + text + "ab" * rng.randrange(200)
        yield i, text


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats_equal_brute_force(spark, hot):
    rows = [*cut_texts(), (60, None), (61, ""), (62, "é" * 120), (63, "é" * 120)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    want = without_repeats(rows)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 5000


def test_repeats_of_documents(spark, documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    got = queries.QUERIES["op1_suffix_dedup"](spark, FOLDER).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == without_repeats(rows)


def test_repeats_odd_rows(odd):
    got = suffix_dedup.remove_repeats(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    assert len({r["kept_sha256"] for r in rows if r["doc_id"] == 5}) == 1
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_refining_holds_few_bytes_a_position():
    import tracemalloc

    rng = random.Random(2)
    line = bytes(rng.randrange(97, 123) for _ in range(175))
    texts = [line[:80 + k % 20] + b"%05d" % (k % 700) + line[85 + k % 20:] for k in range(2000)]
    ids, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    tracemalloc.start()
    rows = suffix_dedup.repeated_windows(ids // 2, ids % 2, zero, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) > 1000 and peak < 48 * sum(map(len, texts)), peak / sum(map(len, texts))
    seen, want = {}, set()
    for k, t in enumerate(texts):
        for at in range(len(t) - 99):
            if seen.setdefault(t[at:at + 100], (k, at)) != (k, at):
                want.add((k, at))
    got = {(2 * d + m, at) for d, m, spans in rows for low, high in np.frombuffer(spans, np.int64).reshape(-1, 2) for at in range(low, high)}
    assert got == {(k, at + i) for k, at in want for i in range(100)}


def test_refined_pointers_name_strings():
    rng = np.random.default_rng(0)
    for n in (0, 5, 40, 2000):
        data = rng.integers(97, 99, n).astype(np.uint8)
        raw, pointer = data.tobytes(), suffix_dedup.refine(data, 20)
        names = {}
        for i in range(n - 19):
            names.setdefault(raw[i:i + 20], set()).add(int(pointer[i]))
        assert all(len(v) == 1 for v in names.values())
        by_pointer = [s for _, s in sorted((min(v), s) for s, v in names.items())]
        assert by_pointer == sorted(names)


# --- language ----------------------------------------------------------------------------------

def test_language_of_held_out_documents(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_language_id"](spark, FOLDER).collect()}
    true = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert got.keys() == true.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == true[i] for i in held) >= 0.97 * len(held)


def test_language_odd_rows(odd):
    rows = language.identify(odd, F.lit(None).cast("boolean")).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2, 3)} == {"und"}
    assert language.identify(odd.limit(0), F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()} == {"und"}


def test_gram_hashes_do_not_cross_texts():
    alone, start = language.hashed(["abc"])
    both, starts = language.hashed(["abc", "xyz"])
    assert start.tolist() == [0] and starts.tolist() == [0, 5]
    assert (alone == both[:, :5]).all() and (language.hashed(["xyz"])[0] == both[:, 5:]).all()


# --- archives ----------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    rows = [(1, "u", "<p>x"), (2, "u", "<p>x"), (3, None, None), (4, "a", ""), (5, "é\r\nb", "<p>é"), (5, "é", "<p>é"), (None, "z", "q"), (6, "l", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "response", None),
         (None, "response", None), (6, "response", None)])
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        raw = html[r["page_id"]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert bytes(r["payload"]) == (raw if r["record_type"] == "response" else b"")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_bad_archives_are_refused():
    import zstandard

    dictionary = warc.train([b"<html>"])
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    record = warc.make_record(1, "u", b"hello", None)
    good = warc.pack(dictionary) + packer.compress(record) + packer.compress(warc.make_record(2, "u", b"hello", 1))
    assert [r["record_type"] for r in warc.read_archive(good)] == ["response", "revisit"]
    for bad in (good[8:], good[:-3], b"", warc.pack(dictionary) + b"junk", warc.pack(dictionary) + packer.compress(record.replace(b"hello", b"hullo")),
                warc.pack(dictionary) + packer.compress(record[:-1]), warc.pack(dictionary) + packer.compress(record.replace(b"WARC/1.1", b"WARC/9.9"))):
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(bad))


def test_compressed_dictionary_is_read():
    import struct

    import zstandard

    dictionary = warc.train([b"<html>" * 40] * 3)
    data = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    front = struct.pack("<II", warc.DICTIONARY_FRAME, len(data)) + data
    frame = zstandard.ZstdCompressor(dict_data=dictionary).compress(warc.make_record(1, "u", b"<html>", None))
    assert [r["page_id"] for r in warc.read_archive(front + frame)] == [1]


# --- quality -----------------------------------------------------------------------------------

def test_weak_labels_agree_with_labels(spark):
    folder = FOLDER.replace("0.001", "0.01")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for name, column in (("op4_weak_quality", "good"), ("op7_quality_rules", "kept")):
        rows = [r for r in queries.QUERIES[name](spark, folder).collect() if r["doc_id"] in label]
        clean = [r for r in rows if label[r["doc_id"]] == 1 and (name[2] == "4" or not r["base_failed"])]
        junk = [r for r in rows if label[r["doc_id"]] == 0]
        assert sum(r[column] for r in clean) >= 0.98 * len(clean)
        assert sum(not r[column] for r in junk) >= 0.95 * len(junk)


def test_quality_odd_rows(odd):
    judged = weak_quality.judge(odd)
    rows = judged.collect()
    assert len(rows) == odd.count() and set(odd.columns) < set(judged.columns)
    assert all(r["score"] == 0 and not r["good"] for r in rows if not r["text"])
    assert weak_quality.judge(odd.limit(0)).count() == 0


def rule_counts(text):
    w = words(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_equal_brute_force(spark, documents, odd):
    extra = spark.createDataFrame([(900, "a b c d e " * 3), (901, "a b c d e f a b c d e g"), (902, "a a a a a a a"), (903, "x\n\nx\n y\nx \nx")], "doc_id long, text string")
    for docs in (documents.select("doc_id", "text"), extra, odd.where("doc_id is not null")):
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = quality_rules.judge(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = rule_counts(text[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(odd.limit(0)).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_rules_plan_has_no_python(odd, capsys):
    quality_rules.judge(odd).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_estimated_accuracies():
    rng = random.Random(3)
    false, true = (0.005, 0.01, 0.002), (0.8, 0.6, 0.7)
    seen = Counter()
    for _ in range(20_000):
        bad = rng.random() < 0.15
        seen[tuple(-1 if rng.random() < (t if bad else f) else 1 for f, t in zip(false, true))] += 1
    found = weak.estimate(sorted(seen.items()), 3)
    assert abs(found.good - 0.85) < 0.03
    assert all(abs(a - b) < 0.08 for a, b in zip(found.bad_if_bad, true))
    assert weak.estimate([], 3).good > 0.5


# --- pages -------------------------------------------------------------------------------------

PAGE = """<html><body class="has-sidebar"><header class=top><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div id=cookie-notice>We use cookies</div><script>var t="</p>";</script><div class="wrap"><main><div class="post post-%d">
<h2>Title &amp; so</h2><p>Hello <i>wor</i>ld &nbsp; a<br>b<p>Second <a href=x>link</a> text that is long enough to count.<ul><li>one<li>two</ul>
<div class="comments"><p>Nice post!</p></div><form><label>Name</label></form></div></main><aside>Side</aside></div><footer>(c)</footer>"""
TEXT = "Title & so\nHello world a b\nSecond link text that is long enough to count.\none\ntwo"


def test_main_text(spark):
    rows = [(1, "https://a.org/1", PAGE % 1), (2, "https://a.org/2", PAGE % 2), (3, "https://a.org/3", None), (4, None, ""), (5, "x", "plain <b>words"),
            (6, "https://a.org/4", "<p>cut <a href='"), (7, "https://a.org/5", "a < b & c<!-- open"), (1, "https://a.org/1", PAGE % 1)]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, path string")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == TEXT and text[3] == text[4] == "" and text[5] == "plain words" and text[7] == "a < b & c"
    assert html_text.extract(pages.limit(0)).count() == 0


LONG = "A sentence of the article that is long enough to matter. " * 8


@pytest.mark.parametrize("html,want", [
    (f"<body><main><h1>Title</h1><p class=lead>Lead.</p><div class=body><p>{LONG}</div></main>", ["Title", "Lead.", LONG.strip()]),
    (f"<body><div class=content><h1>Title</h1><p class=lead>Lead.</p><div class=body><p>{LONG}</div></div><div>tag line</div>", ["Title", "Lead.", LONG.strip()]),
    (f'<div class="layout has-sidebar"><p>{LONG}</p><div class="sidebar">Side</div></div>', [LONG.strip()]),
    (f'<article><div class="article-social-legal"><p>{LONG}</p></div><p>short</p></article>', [LONG.strip(), "short"]),
    (f'<article><header class="entry-header"><h1>Title</h1></header><p>{LONG}</p><footer>By me</footer></article>', ["Title", LONG.strip()]),
    (f'<div id=sidebar><article><h1>Title</h1><p>{LONG}</p></article></div><nav>Menu</nav>', ["Title", LONG.strip()]),
    (f'<article><p>Short article.</p></article><div class="post-comments"><p>{LONG}</p></div>', ["Short article."]),
    (f"<main><article><p>One.</p></article><article><p>{LONG}</p></article></main><div class=related-posts><p>{LONG}</p></div>", ["One.", LONG.strip()]),
    (f"<body><p>{LONG}</p><div style='display: none'>{LONG}</div><p>2 < 3 <b x='\">bold</b>", [LONG.strip(), "2 < 3 bold"]),
])
def test_article_is_whole(html, want):
    assert html_text.text_at(html_text.parse(html), None).split("\n") == want


@pytest.mark.parametrize("html", [
    "<a " * 350_000, "<a " * 350_000 + ">x", "<a '\">" * 150_000, "<!" * 500_000, "</b " * 250_000, "<div>" * 100_000, "<div class=x>y" * 80_000,
    "<ul><p>" * 70_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><span>" * 60_000 + "</section>" * 50_000, "<script>" * 100_000])
def test_broken_pages_take_linear_time(html):
    start = time.process_time()
    html_text.text_at(html_text.parse(html), "html/body/div")
    assert time.process_time() - start < 4


def test_main_text_of_pages(spark):
    import html

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.QUERIES["op5_html_text"](spark, FOLDER).collect():
        article = rows[r["page_id"]].partition("<article>")[2].partition("</article>")[0]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        assert r["text"] == "\n".join(x for x in lines if x)


# --- fingerprints ------------------------------------------------------------------------------

def slow_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in root}


def test_simhash_equals_brute_force(spark, documents, odd):
    for docs in (documents.select("doc_id", "text"), odd.where("doc_id is not null").select("doc_id", "text")):
        prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in docs.collect()}
        root = slow_components(prints.values())
        least = {}
        for doc_id, p in prints.items():
            least[root[p]] = min(doc_id, least.get(root[p], doc_id))
        rows = simhash.near_duplicates(docs).collect()
        assert len(rows) == docs.count()
        assert all((r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", least[root[prints[r["doc_id"]]]]) for r in rows)


def test_covering_finds_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300).astype(np.int64)
    rows = [base]
    for _ in range(3):
        flips = np.zeros(300, np.int64)
        for _ in range(4):
            flips |= np.int64(1) << rng.integers(0, 63, 300).astype(np.int64)
        rows.append(base ^ flips)
    prints = np.unique(np.concatenate(rows)).tolist()
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in graph.components(simhash.links(frame)).collect()}
    assert {p: found.get(p, p) for p in prints} == slow_components(prints)


def test_keep_first_of_each_component(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] in (5, 13, 14)) in ([5, 13], [13])
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert simhash.keep_first(odd.limit(0)).count() == 0


def test_keep_first_without_or_with_clashing_ids(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(5)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (9, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3]), (8, texts[4])}
    got = [tuple(r) for r in simhash.keep_first(docs).collect()]
    assert len(got) == len(want) and set(got) == want


def jaccard_firsts(texts):
    """Of each component of 5-word Jaccard 0.8 or more, the least id."""
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


def edited(rng, base, n):
    w = base.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("cell", [2000, 7])
def test_near_copies_equal_brute_force(spark, documents, cell, monkeypatch):
    monkeypatch.setattr(near_sets, "CELL", cell)
    rng, texts = random.Random(5), []
    for n in (12, 60, 300):
        base = " ".join(f"b{rng.randrange(10**9)}" for _ in range(n))
        texts += [base, base.upper()] + [edited(rng, base, k) for k in range(1, n // 40 + 6) for _ in range(6)]
    line = " ".join(f"common{k}" for k in range(30))
    texts += [f"{line} " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(4, 40))) for _ in range(40)]
    rows = list(enumerate([*texts, None, "", "a b", "A  b", "a b c d e", "a b c d e f"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(documents.select(F.col("doc_id") + 1000, "text"))
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in near_sets.keep_first(docs).collect()} == jaccard_firsts(every)
    assert near_sets.keep_first(docs.limit(0)).count() == 0


def test_sets_just_too_different_never_become_all_pairs(spark, monkeypatch):
    rng, held, stash = random.Random(8), [], near_sets.store.stash
    base, own = [f"b{k}" for k in range(344)], set(range(20, 340, 40))
    texts = [" ".join(f"o{rng.randrange(10**9)}" if k in own else w for k, w in enumerate(base)) for _ in range(60)]
    texts += [f"{texts[0]} more", f"less {texts[1]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard_firsts(dict(enumerate(texts))) == set(range(60))

    def counted(df, name):
        out = stash(df, name)
        held.append((out.count(), name))
        return out

    monkeypatch.setattr(near_sets.store, "stash", counted)
    assert {r["doc_id"] for r in near_sets.keep_first(docs).collect()} == set(range(60))
    assert max(held)[0] < 60 * 59 // 4, held


def test_forests_join_what_all_pairs_join():
    rng = np.random.default_rng(6)
    every = [np.unique(rng.integers(0, 300, 40 + 3 * k).astype(np.uint64)) for k in range(50)]
    every += [np.delete(s, rng.integers(0, len(s), rng.integers(1, 8))) for s in every]
    label = rng.integers(0, 80, len(every))
    pairs = np.array([(a, b) for a in range(len(every)) for b in range(len(every)) if a != b]).T
    alike = [(a, b) for a, b in pairs.T if 5 * (n := len(np.intersect1d(every[a], every[b]))) >= 4 * (len(every[a]) + len(every[b]) - n)]

    def joined(found):
        up = label.copy()
        for a, b in found:
            up[up == up[a]] = up[b]
        return {frozenset(np.flatnonzero(up == u)) for u in up}

    forest = near_sets.alike_forest(iter([pairs[:, ::2], pairs[:, :0], pairs[:, 1::2]]), [s.tobytes() for s in every], label)
    assert {tuple(p) for p in forest.T} <= set(alike) and joined(forest.T) == joined(alike) and forest.shape[1] < len(every)
    some = np.array(alike).T
    assert joined(near_sets.spanning(iter([some[:, :30], some[:, 30:]]), label).T) == joined(alike)
    assert near_sets.spanning(iter([]), label[:0]).shape == near_sets.alike_forest(iter([]), [], label[:0]).shape == (2, 0)


def test_fingerprints_name_the_first_candidates(spark, monkeypatch):
    rng, asked = random.Random(7), []
    base = [" ".join(f"b{rng.randrange(10**9)}" for _ in range(400)) for _ in range(3)]
    texts = [edited(rng, b, k % 3) for b in base for k in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = np.zeros(0, np.uint64)
    nodes = near_sets.prepare(docs, none).select("node", "size", "fp")
    prints = {r["node"]: r["fp"] for r in nodes.collect()}
    root = slow_components(prints.values())
    least = {}
    for name, p in prints.items():
        least[root[p]] = min(name, least.get(root[p], name))
    want = {(least[root[p]], name) for name, p in prints.items() if least[root[p]] != name}
    assert want and {tuple(r) for r in near_sets.by_fingerprint(nodes.distinct()).collect()} == want
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda p: asked.append(1) or links(p))
    assert corpus_pipeline.near_dedup(spark, docs, FOLDER).count() == 3 and asked


def test_sketches_never_rule_out_alike_sets():
    rng = np.random.default_rng(3)
    for n in (1, 9, 63, 65, 255, 257, 1025, 40_000):
        every = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        parts = [every[:k] for k in sorted({n, n - n // 9, n - n // 5, n // 2}) if k]
        args = np.zeros(len(parts), np.int64), np.array([len(p) for p in parts]), [near_sets.parity(p) for p in parts], np.arange(len(parts))
        found = {(int(a), int(b)) for a, b in zip(*near_sets.close_pairs(*args, np.zeros(len(parts), bool)))}
        assert found >= {(a, b) for b in range(len(parts)) for a in range(b) if 5 * len(parts[a]) >= 4 * len(parts[b])}
        assert not any(5 * len(parts[a]) < 4 * len(parts[b]) for a, b in found)


def test_crowded_shingles_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "ENTRIES", 20)
    monkeypatch.setattr(near_sets, "TASK", 50)
    rng = random.Random(9)
    base = " ".join(f"b{k}" for k in range(60))
    texts = [edited(rng, base, rng.randrange(6)) for _ in range(80)]
    rows = [(i, t, 1, "x", 2, 3, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _root int, _place string, root int, node long, _DOC_ID string")
    got = near_sets.keep_first(docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == jaccard_firsts(dict(enumerate(texts)))
    assert simhash.keep_first(docs.withColumnRenamed("node", "_mark").limit(9)).count() > 0


def test_texts_outside_the_wanted_are_not_shuffled(spark):
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(k if k else None, " ".join(words[k:k + 30])) for k in range(300)], "doc_id long, text string")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("node"), F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("first"))
    wanted = hashed.where("doc_id is null or doc_id % 50 = 7")
    got = near_sets.texts_of(docs, hashed, wanted.select("node"))
    want = {r["node"]: r["text"] for r in wanted.join(docs, F.col("node") == F.xxhash64("text")).select("node", "text").collect()}
    assert len(want) == 7 and sorted(want.items()) == sorted(tuple(r) for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and plan.count("Join") == 2


def test_one_of_rows_that_share_the_least_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "b"), (1, text, "a"), (1, f"{text} z", "c"), (2, text, "a"), (3, "alone here", "x"), (None, "no id", "y"), (None, "no id", "x"), (4, None, "n")]
    got = near_sets.keep_first(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[4], rows[6], rows[7]], got.schema).collect()))


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {(r["node"], r["root"]) for r in graph.components(edges).collect()} == {(i, 0) for i in range(1, 60)}
    assert graph.components(edges.limit(0)).count() == 0


# --- neighbours --------------------------------------------------------------------------------

def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    usable = {r["vec_id"]: np.array(r["embedding"], float) for r in rows if r["embedding"] and all(x is not None for x in r["embedding"])}
    got = {}
    for r in queries.QUERIES["op8_kmeans_tree"](spark, FOLDER).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for q, found in got.items():
        true = sorted((-float(v @ usable[q]), i) for i, v in usable.items() if i != q)[:20]
        assert all(abs(float(usable[q] @ usable[i]) - s) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and len(found) == min(20, len(usable) - 1)
        hits, total = hits + len({i for _, i in true} & {i for i, _ in found}), total + len(true)
    assert hits >= 0.9 * total


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0])]
    points = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, leaf int, rank int")
    got = kmeans_tree.search(points, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 20, 1.0), (0, 2, 21, 1.0), (20, 1, 0, 1.0), (20, 2, 21, 1.0)]
    assert kmeans_tree.search(points.limit(0), F.lit(True)).count() == 0


def test_equal_vectors_go_by_id():
    rng = np.random.default_rng(4)
    vectors, queries = rng.normal(size=(900, 33)), rng.normal(size=(300, 33))
    vectors[[17, 401, 872]] = queries[:1] * 3
    for k in range(1, 300):
        vectors[[k, k + 300, k + 600]] = queries[k] + 0.01
    found = kmeans_tree._search(np.arange(900), vectors, np.arange(300) + 5000, queries, 3)
    for q in range(1, 300):
        at = found[0] == q + 5000
        ids, scores = found[1][at], found[2][at]
        assert all(a < b or x > y for a, b, x, y in zip(ids, ids[1:], scores, scores[1:]))


def test_ragged_vectors_and_small_leaves(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)] + [(500 + i, (rng.normal(size=3) * 0.01 + [90, 90 * i, 7]).tolist()) for i in range(7)]
    rows += [(900, [1.0, 2.0]), (920, [1.0, 2.0, 3.0, 4.0]), (940, [])]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = kmeans_tree.search(points, F.col("vec_id") % 20 == 0, 20, recall=0.1).collect()
    asked = {i for i, v in rows if i % 20 == 0 and len(v) == 3}
    assert {r["query_id"] for r in got} == asked and len(got) == 20 * len(asked) and not {r["vec_id"] for r in got} & {900, 920, 940}


# --- packing -----------------------------------------------------------------------------------

def test_packing_of_documents(spark, documents, odd):
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for docs in (documents.select("doc_id", "text"), odd.dropDuplicates(["doc_id"])):
        rows = packing.pack(docs, path).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for r in docs.collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
            mine = sorted(by_doc[r["doc_id"]], key=lambda x: x["piece"])
            assert [x["piece"] for x in mine] == list(range(len(mine))) and sum(x["length"] for x in mine) == len(ids)
            assert all(x["length"] == 1024 for x in mine[1:])
            assert all(x["ids_crc32"] == zlib.crc32(ids[x["start"]:x["start"] + x["length"]].tobytes()) for x in mine)
        for places in by_sequence.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 1024
        total = sum(r["length"] for r in rows)
        assert len(by_sequence) <= -(-total // 1024) * 1.02 + 1
    assert packing.pack(odd.limit(0), path).count() == 0
    assert packing.pack(odd, path).groupBy("doc_id", "piece").count().where("count = 2").count() == 1


def least_bins(lengths, capacity):
    """Exact, by trying every open bin for each item."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins.index(bins[k]) == k:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        bins.append(lengths[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_bin_completion_on_small_cases():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted((rng.randrange(1, 20) for _ in range(rng.randrange(0, 10))), reverse=True)
        counts = [lengths.count(i) for i in range(21)]
        plan = packing.complete(counts, 20)
        assert sum(bins for _, bins in plan) == (least_bins(lengths, 20) if lengths else 0)
        used = Counter()
        for filling, bins in plan:
            assert sum(length * copies for length, copies in filling) <= 20
            for length, copies in filling:
                used[length] += copies * bins
        assert used == Counter(lengths)


def test_tasks_leave_no_words_behind():
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    class Docs:
        schema = StructType([StructField("doc_id", LongType())])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return list(run(iter([pa.record_batch({"doc_id": [k], "text": [f"some{k} words{k}"]}) for k in range(9)])))

    path = vocabularies.path("byte_bpe_50k.json")
    assert len(packing.pieces(Docs(), path)) == 9
    assert not packing._ENCODERS[path].first and not packing._ENCODERS[path].later


# --- byte-level BPE ----------------------------------------------------------------------------

def test_bpe_equals_the_library(spark, documents, odd):
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    library = bpe._library(path, vocabularies.PATTERN)
    long = spark.createDataFrame([(1, "z" * 500 + " q"), (2, "\n\n\n" * 100), (3, "a\n b \nc"), (4, "a\x1c b \x1d c")], "doc_id long, text string")
    for docs in (long, documents.select("doc_id", "text"), odd.dropDuplicates(["doc_id"])):
        rows = {r["doc_id"]: r for r in bpe.round_trip(docs, path, vocabularies.PATTERN).collect()}
        assert len(rows) == docs.count()
        for r in docs.collect():
            ids = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
            assert tuple(rows[r["doc_id"]])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert bpe.round_trip(odd.limit(0), path, vocabularies.PATTERN).count() == 0
    assert bpe.round_trip(odd, path, vocabularies.PATTERN).count() == odd.count()


def test_bpe_merges_words_of_any_length():
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    library, ranks = bpe._library(path, vocabularies.PATTERN), dict(bpe.read_ranks(path))
    rng = random.Random(4)
    for n in [*range(1, 40), 99, 100, 201, 3000]:
        for letters in ("ab", "etaoin", "é日z", "ABCDEFabcdef"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert bpe.merge(word.encode(), ranks) == library._core_bpe.encode_single_piece(word.encode())


def test_bpe_parts_at_white_space():
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    coder, library = bpe.Coder(vocabularies.PATTERN, bpe.read_ranks(path)), bpe._library(path, vocabularies.PATTERN)
    rng = random.Random(6)
    texts = ["foo\n", "foo\n bar", "\n\n", "\n\n foo", " ", "  ", " foo", "foo ", "foo", "a \u00a0b", "\x1c", "a\x1c b", "b \x1da"]
    texts += ["".join(rng.choice(["a", "b", "foo", "'s", ",", "1", " ", " ", " ", "\n", "\t", "\x1c", "\u00a0", "\u2003", "\u00e9"]) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    for text in texts:
        assert coder.round_trip(text) == (np.array(library.encode_ordinary(text), "<u4").tobytes(), text.encode()), text


def test_bpe_remembers_a_word_once_and_merges_short_ones_from_a_list(monkeypatch):
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    coder, heaps = bpe.Coder(vocabularies.PATTERN, bpe.read_ranks(path)), []
    monkeypatch.setattr(bpe, "heapify", lambda h: heaps.append(len(h)))
    coder.round_trip(" ".join(f"wxq{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)))
    assert coder.size <= 300 * (6 + bpe.EACH) and not heaps


def test_bpe_forgets_words_without_losing_any(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    coder, library = bpe.Coder(vocabularies.PATTERN, bpe.read_ranks(path)), bpe._library(path, vocabularies.PATTERN)
    for text in [t or "" for t in TEXTS] * 2:
        assert coder.round_trip(text) == (np.array(library.encode_ordinary(text), "<u4").tobytes(), text.encode())


# --- the pipeline ------------------------------------------------------------------------------

def test_pipeline_stages(spark, documents):
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.store.stash(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name != "suffix_array_dedup":
            assert all(before[i] == t for i, t in after.items())
        else:
            assert after.keys() == before.keys()
            want = without_repeats(sorted(before.items()))
            assert all(want[i][3] == hashlib.sha256(t.encode()).hexdigest() for i, t in after.items() if len(t.encode()) == want[i][0] - want[i][1])
        if name == "simhash_near_dedup":
            assert after.keys() == jaccard_firsts(before)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == after.keys()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_no_local_checkpoints():
    from pathlib import Path

    for path in Path(queries.__file__).parent.glob("*.py"):
        assert ".localCheckpoint(" not in path.read_text()
