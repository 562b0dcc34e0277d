"""The operators of llm against plain Python, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import time
import tracemalloc
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import public_tokenizers
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shotledger.llm import bpe, components, fingerprints, html, language, licenses, mixing, quality, simhash, suffixes, urls
from shotledger.llm.queries import ORACLE, QUERIES
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
#: Texts that any operator must take.
ODD = [None, "", " \t\n", "a", "a" * 700, "Öer " * 120, "ab" * 300 + "\n" + "ab" * 300, "don't　stop \x1c é日本語 \U0001f600!! 123,456\n\n  \tx  ", "\n".join(["one line of words"] * 40)]


def odd_docs(spark, extra=()):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}" if i else None, len(t or ""), "kept?", 0.5) for i, t in enumerate([*ODD, *extra])]
    rows += [rows[5], (None, "no key", None, None, 6, "x", None)]
    # Columns beyond those of documents have names that operators give to theirs.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, connection, name):
    same(spark, connection, QUERIES[name], ORACLE[name], SF)


def test_empty_tables_give_no_rows(spark, docs):
    none = docs.filter("doc_id < 0")
    assert fingerprints.fingerprint_edits(none).count() == 0
    assert language.identify(none, language.train(none)).count() == 0
    assert suffixes.dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert licenses.scan(none, licenses.known_table(spark)).count() == 0
    assert bpe.encode(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert quality.quality(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(pages).count() == 0
    assert urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


# 1 fingerprints


def sentences(t):
    return [p.strip(" ") for p in re.split(fingerprints.BREAKS, t or "") if p.strip(" ")]


def alike(t, u):
    return like(set(sentences(t)), set(sentences(u)))


def like(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def check_fingerprints(rows, got):
    rows = sorted(((-1 if k is None else k, t or "") for k, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, after), 9)))
    have = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(have) == sorted(want)


def test_fingerprints_recover_what_differs(spark, docs):
    for df in (docs, odd_docs(spark)):
        got = fingerprints.fingerprint_edits(df).collect()
        check_fingerprints([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], got)
    prints = {}
    for r in docs.join(fingerprints.fingerprint_edits(docs).select("doc_id", "fingerprint"), "doc_id").collect():
        assert prints.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]


def test_keys_of_any_order_and_many_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 4)
    monkeypatch.setattr(fingerprints, "SAMPLED", 2)
    rows = [(f"k{r['doc_id'] % 150:03d}", r["text"]) for r in docs.select("doc_id", "text").collect()] + [(None, "x. y."), (None, None)]
    got = {(r["doc_id"], r["text"], r["next"]) for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    line = sorted(((k, t or "") for k, t in rows if k), key=lambda r: r[1])
    line = sorted(line, key=lambda r: r[0], reverse=True) + sorted((k, t or "") for k, t in rows if not k)
    assert got == {(k, t, line[(i + 1) % len(line)][1]) for i, (k, t) in enumerate(line)}


def test_fingerprints_hold_the_cells_of_their_digests(spark):
    text = "One. Two. Three!"
    count, *cells = fingerprints.fingerprint_edits(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]["fingerprint"].split(":")
    signed = lambda x: x - (x >> 63 << 64)
    digests = [xxhash.xxh64_intdigest(p.encode(), 42) for p in ("One.", "Two.", "Three!")]
    want = [[0, 0, 0] for _ in range(12)]
    for d in digests:
        check = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42))
        for t in range(3):
            cell = want[4 * t + ((signed(d) >> 10 * t) & 3)]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] ^ d, cell[2] ^ check
    assert int(count, 16) == 3 and [x.split(".")[:2] for x in cells] == [[f"{c:x}", f"{k:x}"] for c, k, _ in want]


def test_a_sketch_that_is_too_small_is_tried_larger(spark):
    a = F.sequence(F.lit(1), F.lit(60)).cast("array<bigint>")
    b = F.sequence(F.lit(31), F.lit(90)).cast("array<bigint>")
    hashed = lambda s: F.transform(s, lambda x: F.xxhash64(x))
    row = spark.range(1).select(fingerprints.peel(fingerprints.subtract(fingerprints.sketch(hashed(a), 12), fingerprints.sketch(hashed(b), 12)), 12).alias("small"), fingerprints.differing(hashed(a), hashed(b)).alias("d")).collect()[0]
    assert row["small"] is None and sorted(x["side"] for x in row["d"]) == [-1] * 30 + [1] * 30


def test_long_texts_are_compared_sentence_by_sentence(spark):
    many = [f"Sentence number {i} of a long text." for i in range(300)]
    edited = [f"{x} Edited." if i % 10 == 0 else x for i, x in enumerate(many)]
    few = [f"Line {i % 11}." for i in range(55)]
    texts = ["\n".join(x) for x in (many, edited, few, [*few[:50], "Another line."])]
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{p for p in re.split(fingerprints.BREAKS, t) if p} for t in texts]
    assert all(abs(rows[i]["near_next"] - like(sets[i], sets[i - 1])) < 1e-9 for i in (1, 2, 3))
    assert [int(rows[i]["fingerprint"].split(":")[0], 16) for i in range(4)] == list(map(len, sets))



# 2 language


def test_languages_are_told_apart_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df, language.train(df)).withColumn("h", language.held_out("doc_id")).filter("h").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_texts_without_letters_are_unknown(spark, docs):
    df = odd_docs(spark, ["123 !!", "§ 4"])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, language.train(docs)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 9, 10)) and got[4][0] != "und"
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}


def test_a_held_out_label_changes_nothing(docs):
    changed = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language.train(docs), language.train(changed)
    assert a.languages == b.languages and np.allclose(a.weights, b.weights)


def plain_grams(text):
    """The numbers of a text's hashed n-grams, one by one."""
    letters = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    codes = [c for i, c in enumerate(letters) if c != 32 or i == 0 or letters[i - 1] != 32]
    found = set()
    for n in range(1, language.SPECTRUM + 1):
        for i in range(len(codes) - n + 1):
            rolled = 0
            for c in codes[i : i + n]:
                rolled = (rolled * 1_000_003 + c + 1) % 2**64
            found.add((rolled * 0x9E3779B97F4A7C15) % 2**64 >> (64 - language.BITS))
    return found


def test_scores_are_those_of_the_exact_kernel_machine(spark, docs):
    """With every sample a landmark, the approximation is exact: presences are counted in sets, the ridge is solved in its dual form."""
    rows = [(r["text"], r["lang"]) for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL AND n_chars < 900").orderBy("doc_id").limit(60).collect()]
    learnt, asked = rows[:45], [*(t for t, _ in rows[45:]), "Öer " * 40, "the the"]
    grams = [plain_grams(t) for t, _ in learnt]
    kernel = lambda xs: np.array([[len(x & g) / (len(x) * len(g)) ** 0.5 for g in grams] for x in xs])
    own, names = kernel(grams), sorted({n for _, n in learnt})
    rank = int((np.linalg.eigvalsh(own) > 1e-6 * np.linalg.eigvalsh(own).max()).sum())
    target = np.array([[1.0 if n == m else -1.0 for m in names] for _, n in learnt])
    found = kernel([plain_grams(t) for t in asked]) @ np.linalg.solve(own + language.RIDGE * len(learnt) / rank * np.eye(len(learnt)), target)
    model = language.fit([t for t, _ in learnt], [n for _, n in learnt], landmarks=len(learnt))
    got = language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == [names[i] for i in found.argmax(axis=1)]
    assert np.allclose([r["score"] for r in got], np.clip((found.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)


def test_low_scores_and_unknown_texts_are_rejected(spark, docs):
    df = odd_docs(spark, [r["text"] for r in docs.limit(20).collect()])
    scored = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in language.identify(df, language.train(df.withColumn("lang", F.coalesce("lang", F.lit("fr"))))).collect()}
    kept = language.keep_identified(df.withColumn("lang", F.coalesce("lang", F.lit("fr"))))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {k for k, (name, score) in scored.items() if name != "und" and score >= language.MIN_SCORE}
    assert kept.columns == df.columns


def test_equal_scores_take_the_first_name_and_a_score_at_the_limit_stays(spark, docs):
    model = language.Model(("aa", "bb"), np.ones((1 << language.BITS, 1), np.float32), np.full((1, 2), 0.01, np.float32))
    got = language.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == "aa"
    scores = sorted({r["score"] for r in language.identify(docs, language.train(docs)).collect() if r["lang_pred"] != "und"})
    limit = scores[len(scores) // 2]
    kept = {r["doc_id"] for r in language.keep_identified(docs, min_score=limit).collect()}
    assert kept == {r["doc_id"] for r in language.identify(docs, language.train(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= limit}


def test_the_fit_holds_its_sample_in_little_memory():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghij klmno") for _ in range(60)) for _ in range(1000)]
    tracemalloc.start()
    model = language.fit(texts, [("aa", "bb")[i % 2] for i in range(1000)])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ("aa", "bb") and most < 60_000_000


# 3 suffix arrays


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 50))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_windows_are_cut_only_where_they_part_themselves(monkeypatch):
    """Pairs that have nothing in common with other pairs need few symbols, however many places those part at."""
    rng = random.Random(7)
    windows = []
    for i in range(60):
        left, right = (bytes([i + 1]) + bytes(rng.randrange(65, 91) for _ in range(n)) for n in (140, 150))
        windows += [(142, b"x" + left[::-1] + right + b"x"), (142, b"y" + left[::-1] + right[: 60 + i] + b"z" * 20)]
    seen, built = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda s: seen.append(len(s)) or built(s))
    got = [suffixes.merged(x) for x in suffixes.by_suffix_array(windows)]
    assert got == [[(1, 202 + i)] for i in range(60) for _ in range(2)]
    assert seen[0] < 6 * len(windows)


def test_anchors_of_texts_side_by_side_are_those_of_each():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é") for _ in range(n)) for n in (0, 30, 199, 200, 201, 900, 5, 40_000, 300)] + [None, "a" * 500]
    _, _, rows, places, found = suffixes._anchors_of(pa.array(["skipped", *texts])[1:])
    got = [(int(r), int(p), int(h)) for r, p, h in zip(rows, places, found, strict=True)]
    assert got == [(i, int(p), int(h)) for i, t in enumerate(texts) for p, h in zip(*(x.astype(np.int64) for x in suffixes.anchors(np.frombuffer((t or "").encode(), np.uint8))), strict=True)]


def brute_removed(rows, length=200):
    counts = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            counts[b[i : i + length]] = counts.get(b[i : i + length], 0) + 1
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((-1 if k is None else k, len(b), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])[: len(b)]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_are_removed_wherever_they_are(spark, docs):
    base = " ".join(f"w{i}" for i in range(200))
    rng = random.Random(2)
    near = []
    for i in range(90):  # more surroundings of an anchor than are sorted
        words = base.split()
        words[rng.randrange(200)] = f"x{i}"
        near.append(" ".join(words))
    for df in (docs.select("doc_id", "text"), odd_docs(spark, [base[:260], f"§{base[30:400]}§", *near])):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(df).collect())
        assert got == brute_removed(rows)


def test_cores_of_frequent_anchors_find_the_same(monkeypatch):
    """The spans of rows of cores, put together by hand, are those of a plain search."""
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(99)}" for _ in range(150))
    texts = [base, base[:300] + "x" + base[301:], "y" * 50 + base[100:420], base[60:300], "".join(rng.choice("abc") for _ in range(500)), "ab" * 200]
    batches = []
    for i, t in enumerate(texts):
        _, found = suffixes.anchors(np.frombuffer(t.encode(), np.uint8))
        repeated = [{"anchor": int(h), "times": 2} for h in set(found.view(np.int64).tolist())]
        batches.append(pa.RecordBatch.from_pydict({"_a": pa.array([i], pa.int64()), "_b": pa.array([i], pa.int64()), "_text": pa.array([t]), "repeated": pa.array([repeated])}))
    for frequent in (1, 512):
        monkeypatch.setattr(suffixes, "FREQUENT", frequent)
        windows = pa.Table.from_batches([*suffixes._window_rows(iter(batches))]).sort_by([("anchor", "ascending"), ("core", "ascending")])
        spans = [r for b in suffixes._span_rows(iter(windows.to_batches())) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got = sorted((i, len(t), sum(y - x for x, y in suffixes.merged([(x, y) for a, _, x, y in spans if a == i]))) for i, t in enumerate(texts))
        assert got == [r[:3] for r in brute_removed(list(enumerate(texts)))]


def test_many_different_surroundings_of_one_anchor(spark):
    """Near copies by the thousand meet by cores; what a core's group is compared by changes nothing."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(999)}" for _ in range(70)]
    texts = []
    for i in range(700):
        words = list(base)
        words[rng.randrange(70)] = f"x{rng.randrange(300)}"
        texts.append((i, " ".join(words)))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == brute_removed(texts)


# 4 simhash


def plain_fingerprint(text):
    """Bit by bit, from the contract's words."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    found = list(range(len(rows)))

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                found[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted((-1 if k is None else k, f"{prints[i]:016x}", least.get(root(i), -1)) for i, (k, _) in enumerate(rows))


def test_near_copies_are_grouped(spark, docs):
    rng = random.Random(3)
    words = [f"w{rng.randrange(999)}" for _ in range(300)]
    near = []
    for _ in range(60):
        words[rng.randrange(300)] = f"w{rng.randrange(999)}"
        near.append(" ".join(words))
    for df in (docs.select("doc_id", "text"), odd_docs(spark, near)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = simhash.near_duplicates(df).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute_components(rows)


def test_very_long_texts_are_read_whole(spark):
    """Two texts of some 100,000 words that differ in their last words alone."""
    rng = random.Random(13)
    base = " ".join(rng.choice(["one", "two", "three", "four", "five", f"w{i}"]) for i in range(100_000))
    texts = [base, base + " last", base + " " + " ".join(f"z{i}" for i in range(90_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(df).collect()}
    assert prints == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}
    assert [r["doc_id"] for r in simhash.representatives(df).orderBy("doc_id").collect()] == sorted({least for _, _, least in brute_components(list(enumerate(texts)))})
    counts = {r["doc_id"]: r["n_words"] for r in quality.quality(df).collect()}
    assert counts == {i: len(t.split()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["digest"] for r in licenses.scan(df, licenses.known_table(spark)).collect()}[1] == hashlib.sha256((base + " last").encode()).hexdigest()


def test_keys_of_many_fingerprints_in_tiles(spark):
    rng = random.Random(4)
    prints = sorted({sum(1 << b for b in rng.sample(range(12), rng.randrange(5))) for _ in range(400)} | {1 << 60, 1 << 61 | 1 << 55 | 1 << 50 | 1 << 45})
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    for few, tile in ((1000, 512), (4, 50)):
        roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, few=few, tile=tile)).collect()}
        near = {x: min(y for y in prints if (x ^ y).bit_count() <= 3) for x in prints}
        for x in prints:
            assert roots.get(x, x) == roots.get(near[x], near[x])


def test_paths_and_stars_are_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_one_document_of_a_group_stays(spark):
    df = odd_docs(spark)
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and len(ids) == len(set(ids))


def apart(t, u):
    return (plain_fingerprint(t) ^ plain_fingerprint(u)).bit_count()


def edited(rng, text, least, most):
    """The text with some words in other words' place, whose fingerprint is so many bits off."""
    while True:
        words = text.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        if least <= apart(text, " ".join(words)) <= most:
            return " ".join(words)


def test_near_copies_that_are_not_exact_leave_the_pipeline(spark):
    """The middle one of each three is within three bits, the last just beyond."""
    rng = random.Random(5)
    rows = []
    for i in range(12):
        text = " ".join(f"w{rng.randrange(9999)}" for _ in range(200))
        far = edited(rng, text, 4, 6)
        rows += [(3 * i, text), (3 * i + 1, next(x for x in iter(lambda: edited(rng, text, 1, 3), None) if apart(x, far) > 3)), (3 * i + 2, far)]
    kept = sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())
    assert kept == [i for i in range(36) if i % 3 != 1]


def test_the_pipelines_near_copies_are_those_of_operator_4(spark, docs):
    """Texts of nearly the same shingles whose fingerprints are further apart are no near copies."""
    rng = random.Random(17)
    text = " ".join(f"w{rng.randrange(9999)}" for _ in range(300))
    more = [edited(rng, text, 6, 12), *(edited(rng, text, 1, 3) for _ in range(6))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([text, *more])], "doc_id long, text string"))
    least = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    kept = [r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, df, SF).collect()]
    assert sorted(kept) == sorted(least) and {10**6, 10**6 + 1} <= least


def chain(seed, b_id):
    """A and C are not near copies, B is one of both, and sixty more of A fill every key that they have."""
    rng = random.Random(seed)
    a = " ".join(f"w{rng.randrange(9999)}" for _ in range(300))
    b = edited(rng, a, 2, 3)
    c = next(x for x in iter(lambda: edited(rng, b, 2, 3), None) if apart(a, x) > 3)
    rows = [(1, a), (b_id, b), (900, c)]
    while len(rows) < 63:
        copy = edited(rng, a, 1, 3)
        if apart(copy, c) > 3:
            rows.append((100 + len(rows), copy))
    return rows + [(5000 + i, " ".join(f"z{rng.randrange(999)}" for _ in range(40))) for i in range(5)]


@pytest.mark.parametrize("b_id", [0, 2, 800])
def test_groups_do_not_hang_on_sizes_of_keys_or_on_ids(spark, monkeypatch, b_id):
    rows = chain(11, b_id)
    assert apart(rows[0][1], rows[1][1]) <= 3 and apart(rows[1][1], rows[2][1]) <= 3 and apart(rows[0][1], rows[2][1]) > 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few, tile in ((1, 16), (32, 512), (1000, 512)):
        monkeypatch.setattr(simhash.links, "__defaults__", (simhash.DISTANCE, simhash.BLOCKS, few, tile))
        kept = sorted(r["doc_id"] for r in simhash.representatives(df).collect())
        assert kept == [min(b_id, 1), *range(5000, 5005)]


def test_documents_of_one_key_and_different_texts_stay(spark):
    rows = [(1, "first text of this key", "a"), (1, "another one altogether", "b"), (2, "First  Text of this key", "c"), (1, "first text of this key", "d"), (None, "x", "e"), (None, "x", "f")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, _same string"))
    assert sorted(str(r["doc_id"]) + r["text"] for r in kept.collect()) == sorted(["1first text of this key", "1another one altogether", "Nonex", "Nonex"])


# 5 licences


def test_licences_are_found_whatever_their_spelling(spark):
    mit = next(t for n, k, t in licenses.KNOWN if n == "MIT")
    texts = {1: "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("COPYRIGHT HOLDERS", "copyright owners"), 2: mit + " and more", 3: None, 4: "Copyright 2020 X", 5: "text\n  released under the M.I.T.: no\nReleased under the MIT Licence!"}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), licenses.known_table(spark)).collect()}
    assert {k: r["license"] for k, r in got.items()} == {1: "MIT", 2: None, 3: None, 4: None, 5: None}
    assert got[5]["notices"] == "MIT" and got[3]["digest"] == got[4]["digest"] == hashlib.sha256(b"").hexdigest()


def test_whole_texts_of_licences_are_known(spark, tmp_path):
    header = "Copyright (c) 2001-2020, Some One\nAll rights reserved.\n\n"
    rows = [(i, header + "  " + t.replace(" ", "\n  ", 3).lower()) for i, (_, k, t) in enumerate(licenses.KNOWN) if k == "text"] + [(99, None), (100, "")]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = licenses.scan(df, licenses.known_table(spark)).collect()
    assert len(got) == len(rows) + 1 and {r["doc_id"]: r["license"] for r in got} == {i: licenses.KNOWN[i][0] if i < 99 else None for i, _ in rows}
    (tmp_path / "Own-1.0.txt").write_text("Do what you will.\nKeep this.")
    own = licenses.scan(spark.createDataFrame([(1, "(c) 2020 me\nDO what you will; keep this")], "doc_id long, text string"), licenses.known_files(spark, str(tmp_path)))
    assert [r["license"] for r in own.collect()] == ["Own-1.0"]


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not COMMON.is_dir(), reason="no licence texts on this machine")
def test_long_licences_are_known_as_whole_texts(spark, tmp_path):
    names = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0") if (COMMON / n).is_file()]
    texts = {n: (COMMON / n).read_text() for n in names}
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    respelt = {n: "(c) 2019 Some One\n\n" + t.upper().replace("LICENSE", "LICENCE").replace(",", " -").replace("\n", " \n\n") + "\nAll Rights Reserved." for n, t in texts.items()}
    rows = [*((n, t) for n, t in respelt.items()), *((f"less {n}", t[: len(t) // 2]) for n, t in texts.items()), *((f"more {n}", t + "\nAnd one more term.") for n, t in texts.items())]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licenses.known_files(spark, str(tmp_path))).collect()}
    assert got == {k: (k if k in names else None) for k, _ in rows} and len(names) >= 4


# 6 urls

URLS = [None, "", "no scheme", "http://org", "HTTP://A.ORG/x?y", "http://example.org/es/1", "http://www.EXAMPLE.org/en/12#z", "http://notexample.org/en/1", "http://a.com/de/", "http://a.com/fr/x", "http://com/de/a/b", "http://x.net/fr/", "a://b://c.org/", "http://example.org/en/2", "http://org?/a"]


def test_names_of_columns_do_not_clash(spark):
    names = ["_row", "_found", "_p", "_best", "_ws", "_ls", "_grams", "_text", "_key", "host", "kept"]
    df = spark.createDataFrame([(1, "http://a.org/x", "some words " * 60, *(f"v{i}" for i in range(len(names))))], "page_id long, url string, text string, " + ", ".join(f"`{n}` string" for n in names))
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    for got, replaced in ((urls.judge(df, rules), {"host"}), (urls.judge(df, rules, max_trie_rules=1), {"host"}), (quality.quality(df), {"kept"}), (language.identify(df, None), set())):
        row = got.collect()[0].asDict()
        assert all(row[n] == f"v{i}" for i, n in enumerate(names) if n not in replaced) and row["page_id"] == 1


@pytest.mark.parametrize("limit", [100, 1])
def test_urls_by_trie_and_by_join(spark, limit):
    pages = spark.createDataFrame([*enumerate(URLS), (0, URLS[0])], "page_id long, url string")
    rules = [*urls.RULES, ("example.org", "/en/12", "allow"), ("www.example.org", "/", "block"), ("example.org", "/en/12", "block")]
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), max_trie_rules=limit).collect()

    def brute(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, key=lambda f: (-f[0], -f[1], f[3]), default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: brute(u) for i, u in enumerate(URLS)}


# 7 tokens


def test_tokens_are_the_librarys(spark, docs):
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = odd_docs(spark, ["<|endoftext|>", "x" * 600, "ab" * 260]).select("doc_id", "text").union(docs.select("doc_id", "text").filter("doc_id < 60"))
    texts = {(r["doc_id"], r["text"]) for r in df.collect()}
    want = {}
    for k, t in texts:
        ids = own.encode_ordinary(t or "")
        want.setdefault(k, set()).add((len(ids), ",".join(map(str, ids)), (t or "").encode()))
    got = bpe.encode(df, group_words=3_000, known_words=2_000).collect()
    assert len(got) == df.count() and all((r["n_tokens"], r["ids"], bytes(r["decoded"])) in want[r["doc_id"]] for r in got)
    packed = bpe.encode(df, packed=True).collect()
    assert all(",".join(map(str, np.frombuffer(bytes(r["ids"]), "<u4"))) in {w[1] for w in want[r["doc_id"]]} for r in packed)


def test_words_beyond_the_fold_and_just_below_are_the_librarys(spark):
    rng = random.Random(12)
    n = bpe.MAX_FOLD_BYTES
    words = ["x" * (n + 1), "é" * (n // 2 + 1), "".join(rng.choice("abcdeénst日") for _ in range(n)), "".join(rng.choice("etaoin") for _ in range(n - 1)), "".join(rng.choice("etaoin") for _ in range(n + 1)), "ab" * n]
    texts = [f"one {w} two" for w in words] + words
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {i: ",".join(map(str, own.encode_ordinary(t))) for i, t in enumerate(texts)}


def test_classes_of_characters_are_the_librarys_at_every_code_point(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(pd.DataFrame({"c": every}))
    byte = {bytes([i]): i for i in range(256)}
    for java, theirs in ((f"[{bpe.LETTERS}]", r"\p{L}"), (f"[{bpe.NUMBERS}]", r"\p{N}"), (bpe.WHITE, r"\s")):
        known = tiktoken.Encoding("own", pat_str=theirs, mergeable_ranks=byte, special_tokens={})
        want = {c for c in every if known.encode_ordinary(c)}
        assert {r["c"] for r in df.filter(F.col("c").rlike(f"(?s)^{java}\\z")).collect()} == want


def test_vocabularies_that_a_fold_cannot_hold_are_refused():
    byte = {bytes([i]): i for i in range(256)}
    assert bpe.checked(byte) == byte
    for wrong in ({}, byte | {b"ab": 1 << 16}, {b"a": 0}):
        with pytest.raises(ValueError):
            bpe.checked(wrong)


# 8 pages

BODY = "<article><h1>Title &amp; more</h1><p>First  part<br>of it with <a href='x'>a link</a>.<p>Short.</article>"
SIDES = [
    "<nav><a href=/>Home</a></nav>", "<header class='top'>Site</header>", "<div class='cookie-notice'>We use cookies, and this text is long enough to look like a part.</div>", "<aside>See also many other words here</aside>",
    "<div id=comments><p>I think that this comment has as many words as a whole paragraph of it.</p></div>", "<form><label>Name</label></form>", "<script>var a='</p>';</script><style>p{}</style>", "<footer>&copy; someone</footer>", "<div class=\"ad\">Buy now, all of it</div>", "<!-- x <p>no</p> -->",
]


def test_the_article_is_extracted(spark):
    want = "Title & more\nFirst part\nof it with a link.\nShort."
    pages = [BODY, *(f"<html><head><title>T</title></head><body>{s}{BODY}{s}</body></html>" for s in SIDES), None, "", "<", "<script>never closed"]
    got = html.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    by = {r["page_id"]: (r["text"], r["n_chars"]) for r in got}
    assert all(by[i] == (want, len(want)) for i in range(len(SIDES) + 1))
    assert all(by[i] == ("", 0) for i in range(len(SIDES) + 1, len(pages)) if pages[i] != "<")


#: What the test tables' pages have of both: lists of the test's own.
IN_LINE, AROUND = {"a", "b", "i", "em", "strong", "span", "code"}, {"nav", "footer", "aside", "form", "script", "style", "head", "button", "noscript"}


class Plain(HTMLParser):
    """An article's text by the standard library's parser: what stands in article or main, but not in an element of the sides or an advert."""

    def __init__(self):
        super().__init__()
        self.open, self.parts, self.out = [], [], []

    def bad(self, tag, attrs):
        words = {w.lower() for k, v in attrs if k in ("class", "id") for w in re.findall("[a-z]+|[A-Z][a-z]*", v or "")}
        inside = any(t in ("article", "main") for t, _ in self.open)
        return tag in AROUND or "ad" in words or tag == "header" and not inside

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        self.out += [text] if text else []

    def handle_starttag(self, tag, attrs):
        if tag not in IN_LINE:
            self.flush()
        if tag not in ("br", "img", "meta", "link", "input", "hr", "p", "li", "td", "tr", "th"):
            self.open.append((tag, self.bad(tag, attrs)))

    def handle_endtag(self, tag):
        if tag not in IN_LINE:
            self.flush()
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(b for _, b in self.open):
            self.parts.append(data)


def plain_text(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    p.flush()
    return "\n".join(p.out)


def test_pages_give_what_a_plain_parser_finds(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: plain_text(r["html"]) for r in pages.select("page_id", "html").collect()}
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got == want


def test_formulas_and_objects_of_an_article_stay():
    rows = np.array(html.LABELLED, float)
    tree = html.grow(rows[:, :-1], rows[:, -1].astype(int))
    page = "<nav><a href=/>Home</a></nav><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=t>x=2</annotation></math> be so.</p><object data=a.pdf><p>The words of it.</p></object></article>"
    assert html.main_text(page, tree) == "Let x=2 be so.\nThe words of it."


def test_neighbours_decide_where_nothing_marks_an_article(spark):
    """Of two pages without an article only the neighbours of one short block differ."""
    long, short, links = "<p>" + "some words of a whole paragraph " * 12 + "</p>", "<p>Four words are here.</p>", "<p>" + "<a href=x>a b</a> " * 2 + "</p>"
    pages = [(1, "u", long + short + long), (2, "u", links + short + links)]
    got = {r["page_id"]: "Four words" in r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: True, 2: False}


def test_pages_that_never_close_are_read_in_linear_time():
    for page in ("<div>x" * 50_000, "<option>x" * 50_000, "</div>x" * 50_000, "<div class=\"" * 50_000):
        began = time.process_time()
        html.blocks(page)
        assert time.process_time() - began < 5


def test_the_tree_fits_its_table_and_places():
    rows = np.array(html.LABELLED, float)
    tree = html.grow(rows[:, :-1], rows[:, -1].astype(int))
    assert (html.verdicts(tree, rows[:, :-1]) == rows[:, -1]).mean() > 0.97
    rng = np.random.default_rng(1)
    some = np.column_stack([rng.integers(1, 99, 500), rng.random(500), rng.integers(0, 99, 500), rng.random(500), rng.integers(0, 99, 500), rng.random(500)])
    for side, place, want in ((0, html.INSIDE, True), (1, html.INSIDE, False), (0, html.OUTSIDE, False), (1, html.NONE, False)):
        assert (html.verdicts(tree, np.column_stack([some, np.full((500, 1), side), np.full((500, 1), place), np.zeros((500, 1))])) == want).all()


# 9 mix


def plain_mix(rows):
    """rows: (key, source, size). (key, size, source_size, target, taken) of each, worked out one source at a time."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    weights, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}, 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sources if s not in target]
        level = left / sum(weights[s] for s in free) if free else 0
        full = [s for s in free if weights[s] * level > 2 * sizes[s]]
        if not full:
            target |= {s: weights[s] * level for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
    out = []
    for s in sources:
        at, wanted = 0, int(target[s] + 0.5)
        for k, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], -1 if r[0] is None else r[0], r[2])):
            taken = sum(max(0, min(wanted, at + n + turn * sizes[s]) - (at + turn * sizes[s])) for turn in (0, 1))
            out.append((-1 if k is None else k, n, sizes[s], round(target[s], 6), taken))
            at += n
    return sorted(out)


def sizes_of(df):
    return [(r["doc_id"], r["source"], len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) for r in df.select("doc_id", "source", "text").collect()]


def test_the_mix_takes_what_each_source_is_to_give(spark, docs):
    tail = spark.createDataFrame([(10**6 + i, "one two three " * 10, "tiny") for i in range(2)] + [(2 * 10**6, "word " * 20_000, "big")], "doc_id long, text string, source string")
    for df in (docs.select("doc_id", "text", "source"), odd_docs(spark), docs.select("doc_id", "text", "source").union(tail)):
        got = mixing.mix(df).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == plain_mix(sizes_of(df))
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_a_small_source_beside_a_huge_one_has_slots(spark):
    per = spark.createDataFrame([("a", 1, 30, 60.0), ("b", 2, 5 * 10**12, 9.0e12)], "source string, place int, source_size long, target double")
    line = mixing.schedule(per)
    small = {r["source"]: (r["wanted"], r["block"]) for r in mixing.blocks(per, line).collect()}
    assert small["a"] == (60, 1) and line.filter("place = 1").count() >= 60
    assert sorted(r["rank"] for r in line.filter("place = 1").collect()) == list(range(line.filter("place = 1").count()))


def test_limits_of_sources_are_shared_out_again(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, size long")
    got = {r["source"]: (r["place"], r["weight"], r["target"]) for r in mixing.targets(sized).collect()}
    assert got["a"] == (1, 3, 20.0) and got["b"] == (2, 1, 200.0) and got[None] == (4, 3, 0.0)
    assert got["c"][2] == pytest.approx(1.5 * 1110 - 220)


def test_the_mix_takes_odd_rows(spark):
    df = odd_docs(spark)
    assert mixing.mix(df).count() == df.count()
    assert {r["doc_id"] for r in mixing.mixed(df).collect()} <= {r["doc_id"] for r in df.collect()}


# 10 quality


def test_quality_of_odd_rows(spark):
    df = odd_docs(spark, ["the cat and the dog of it in a house " * 3 + "with " + " ".join(f"word{i} of the" for i in range(40))])
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert not got[0]["kept"] and got[0]["n_words"] == 0 and got[0]["base_failed"]
    assert got[8]["n_dup_lines"] == 39 and got[8]["n_repeat_words"] == 160 and got[8]["base_failed"]
    assert got[4]["word_chars"] == 700 and got[9]["n_words"] == 151


# The pipeline


def keep_one(rows):
    """One row of each group of near copies: components of fingerprints within three bits."""
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in range(len(rows))}, [find(i) for i in range(len(rows))]


def test_the_pipeline_by_stages(spark, docs):
    now, ranks = docs, bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").orderBy("doc_id").collect()]
        if name.startswith("language"):
            scored = language.identify(before, language.train(before)).filter("lang_pred <> 'und' AND score >= 0.35")
            assert sorted(r["doc_id"] for r in now.collect()) == sorted(r["doc_id"] for r in scored.collect()) and now.count() >= 0.97 * before.count()
        if name.startswith("SimHash"):
            groups, of = keep_one(rows)
            place = {k: of[i] for i, (k, _) in enumerate(rows)}
            kept = [place[r["doc_id"]] for r in now.collect()]
            assert len(kept) == len(set(kept)) and set(kept) == groups
        if name.startswith("suffix"):
            want = {k: digest for k, _, _, _, digest in brute_removed(rows)}
            dedup = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.dedup(before).collect()}
            assert {k: hashlib.sha256(x).hexdigest() for k, x in dedup.items()} == want
            assert {r["doc_id"]: r["text"] for r in now.collect()} == {k: x.decode("utf-8", "ignore") for k, x in dedup.items()}
        if name.startswith("mixing"):
            taken = {k: (n, t) for k, n, _, _, t in plain_mix(sizes_of(before))}
            times = {}
            for r in now.collect():
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
            assert times == {k: int(t / n + 0.5) for k, (n, t) in taken.items() if n and int(t / n + 0.5)}
    out = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert out.columns == ["doc_id", "n_tokens", "tokens"]
    want = {(r["doc_id"], *bpe.reference_digests(r["text"], ranks)[:2]) for r in now.collect()}
    assert {(r["doc_id"], r["n_tokens"], hashlib.sha256(",".join(map(str, np.frombuffer(bytes(r["tokens"]), "<u4"))).encode()).hexdigest()) for r in out.collect()} == want and out.count() == now.count()


def test_the_pipelines_stages_take_odd_and_empty_tables(spark, docs):
    odd = odd_docs(spark, [r["text"] for r in docs.limit(8).collect()]).withColumn("lang", F.coalesce("lang", F.lit("fr")))
    for df in (odd, odd.filter("doc_id < 0"), docs.filter("doc_id < 0")):
        now = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF).cache()
            assert now.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
        assert (now.count() > 0) == (df.count() > 0)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_takes_odd_rows(spark, name):
    df = odd_docs(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, df.withColumn("lang", F.coalesce("lang", F.lit("fr"))), SF)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= {r["doc_id"] for r in df.collect()}


def test_no_text_of_a_plan_spells_out_the_vocabulary(spark):
    encoded = bpe.encode(spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_tokens"] for r in encoded.collect()} == {1: 3, 2: 0}
    # The driver makes such texts for each query and its listeners keep them; the rank map as a literal came to millions of characters.
    assert len(encoded._jdf.queryExecution().toString()) < 200_000
