"""The quality classifier, the repair of conversations and the mining of hard negatives against plain Python."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotledger.llm import negatives, repair, subwords
from shotledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# 11 quality classifier


def plain_features(text):
    """The hashes of a text's words, pairs and n-grams, one at a time."""
    roll, mask = 1_000_003, (1 << 64) - 1
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    one = [sum((ord(c) + 1) * pow(roll, i + 1, 1 << 64) for i, c in enumerate(w)) & mask for w in words]
    pairs = [a ^ b for a, b in itertools.pairwise(one)]
    grams = []
    for w in words:
        padded = f" {w} "
        for n in subwords.GRAMS:
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (h * roll + ord(c) + 1) & mask
                grams.append(h)
    return one, pairs, grams


def plain_buckets(hashes, kind):
    return sorted((((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - subwords.BITS)) + (kind << subwords.BITS) for h in hashes)


@pytest.mark.parametrize("text", ["", " ", "a", "Öl  und\tWasser.\nWasser Wasser", "x" * 50 + " y z", "é日本 \U0001f600 **"])
@pytest.mark.parametrize("piece", [1, 2, 20_000])
def test_features_are_those_of_each_word(monkeypatch, text, piece):
    monkeypatch.setattr(subwords, "PIECE", piece)
    got = [[], [], []]
    for part in subwords.pieces(text):
        for mine, ids in zip(got, part, strict=True):
            mine += ids.tolist()
    assert [sorted(x) for x in got] == [plain_buckets(h, k) for k, h in enumerate(plain_features(text))]


def labelled(spark, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_is_told_on_held_out_documents(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.01")
    got = subwords.classify(docs.select("doc_id", "text"), subwords.train(docs, labels)).join(labels, "doc_id").withColumn("held", subwords.held_out("doc_id")).collect()
    held = [r for r in got if r["held"]]
    assert len(held) > 50 and sum((r["predicted"]) == r["quality"] for r in held) / len(held) > 0.97
    good, bad = ([r["score"] for r in held if r["quality"] == x] for x in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98 and min(good) >= subwords.LEAST
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_a_score_is_the_softmax_of_the_mean_vector(spark):
    docs, labels = labelled(spark)
    model = subwords.train(docs, labels)
    for text in ("", "one two two", docs.orderBy(F.desc("n_chars")).first()["text"]):
        at, shares = subwords.weights(text)
        mean = shares.astype(float) @ model.vectors[at].astype(float) if len(at) else np.zeros(subwords.SIZE)
        assert model.score(text) == pytest.approx(subwords.softmax(mean @ model.heads + model.bias)[1], abs=1e-5)
    again = subwords.train(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.heads, model.heads)


def test_held_out_labels_and_odd_ones_are_not_learnt_from(spark):
    docs, labels = labelled(spark)
    odd = labels.select("doc_id", F.when(subwords.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    more = spark.createDataFrame([(1, None), (None, 1), (2, 7), (10**9, 1)], "doc_id long, quality int")
    a, b = subwords.train(docs, labels), subwords.train(docs, odd.union(more).union(odd))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.bias, b.bias)


def test_classifier_takes_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, " \n", "x"), (3, "a " * 70_000, "x"), (4, "w" * 300_000, "x"), (4, "w" * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    _, labels = labelled(spark)
    assert subwords.train(docs.filter("doc_id > 99"), labels) is None
    for model in (None, subwords.train(*labelled(spark))):
        got = subwords.classify(docs, model).collect()
        by = {r["doc_id"]: r["score"] for r in got}
        assert len(got) == 6 and by[None] == by[1] == by[2] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert subwords.classify(docs.filter("doc_id > 99"), model).count() == 0


# 12 conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """rows: role, text, fault. Dijkstra over (rows read, what was written last), by (cost, audit)."""
    todo, seen = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, last, made = heapq.heappop(todo)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(made)
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for x in follows:
            if x != "s":
                heapq.heappush(todo, (cost + 5, audit + "I", i, x, (*made, (repair.NAMES[x], ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, last, made))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                for x in follows:
                    if role[:1] == x:
                        heapq.heappush(todo, (cost + late, audit + "K", i + 1, x, (*made, (role, text))))
                    if x != "s":
                        heapq.heappush(todo, (cost + 1 + late, audit + "R", i + 1, x, (*made, (repair.NAMES[x], text))))
    raise AssertionError


def plain_report(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in mine:
            fault = "" if text.strip(" \t\n\x0b\f\r") else "blank"
            fault = fault or ("duplicate" if (role, text) in seen else "") or ("" if text.rstrip(" \t\n\x0b\f\r")[-1] in ".!?" else "truncated")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[0] for r in mine if r[0] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, made = cheapest(marked)
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def check_report(spark, rows, run=repair.RUN):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = repair.report(df, repair.damaged(df), run=run).select(*repair.COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == plain_report(rows, plain_damage(rows)) and len(got) == len({r[0] for r in rows})


def test_conversations_are_repaired_as_cheaply_as_can_be(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_report(spark, rows)


def test_odd_conversations_in_short_runs(spark):
    rng = random.Random(1)
    texts = ["ok.", "why?", "no stop", "", " \t", None, "ends! \n", "é.", "a.\nb"]
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None, "urgent"]
    rows = [(c, rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(60), None, None] for _ in range(rng.randrange(1, 9))]
    rows += [(777, t, rng.choice(roles[:5]), rng.choice(texts[:3]) + str(t % 50)) for t in range(300)] + [(778, None, "user", "x.")] * 40
    rows += [(779, 1, "user", "y." * 100_000)]
    check_report(spark, rows, run=3)
    check_report(spark, rows)


def test_conversations_of_no_rows_and_empty_tables(spark):
    dropped = next(t for t in itertools.count() if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    check_report(spark, [(5, dropped, "user", "x.")])
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(none, repair.damaged(none)).count() == 0


def test_stacks_are_all_that_the_grammar_leaves():
    found, todo = {(0,)}, [(0,)]
    while todo:
        stack = todo.pop()
        for x in "sua":
            after = repair.pushed(stack, x)
            if after and after not in found:
                found.add(after)
                todo.append(after)
    assert found == set(repair.STACKS)


# 13 hard negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 70, 5), (40, 64, 90), (101, 67, 130), (0, 64, 9)])
def test_strassen_multiplies_exactly(shape):
    n, k, m = shape
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**24), 2**24, (n, k)), rng.integers(-(2**24), 2**24, (k, m))
    for leaf in (1, 8, 32):
        assert np.array_equal(negatives.strassen(a, b, leaf), a @ b)
    assert np.array_equal(negatives.strassen(a.astype(object), b.astype(object), 8).astype(np.int64), a @ b)


def plain_negatives(rows):
    good = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in {(i, y, tuple(v)) for i, y, v in good if i % 100 == 0}:
        line = sorted((-max(-negatives.MOST, min(negatives.MOST, sum(x * y for x, y in zip(v, w, strict=False)))), i, y) for i, y, w in good if i != a)
        for p, pid, _ in [r for r in line if r[2] == label][:5]:
            fits = [r for r in line if r[2] != label and -30 * p <= -100 * r[0] <= -90 * p][:10]
            out += [(a, pid, rank + 1, i, -p, -s) for rank, (s, i, _) in enumerate(fits)]
    return sorted(out)


def mined(df, **sizes):
    rows = negatives.usable(negatives.relabelled(df))
    return [tuple(r) for r in negatives.mine(rows, rows.filter("item % 100 = 0"), **sizes).select(*negatives.COLUMNS).collect()]


def test_negatives_are_the_best_of_each_window_in_tiles_of_any_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain_negatives([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])
    for sizes in ({}, {"n_anchors": 2, "n_candidates": 37}):
        got = mined(df, **sizes)
        assert sorted(got) == want


def test_odd_vectors(spark):
    rng = random.Random(2)
    vector = lambda: [rng.choice([0.0, 0.25, -0.5, 1.0, 2.0]) for _ in range(3)]
    rows = [(i, vector(), rng.randrange(3)) for i in range(0, 1000, 5)]
    rows += [(1100, [float("nan"), 1.0, 1.0], 1), (1200, None, 1), (1300, [1.0, None, 0.0], 1), (1400, [1.0, float("inf"), 0.0], 1), (1500, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(1600, [], 1), (1700, [1.0], 2), (1800, [3e38, 1.0, 1.0], 1), (1801, [3e38, -1.0, 1.0], 1), (1803, [2e38, 1.0, 0.5], 0), (1900, [7e5, 8e5, 9e5], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, item string")
    got = mined(df.drop("item"), n_candidates=50)
    assert sorted(got) == plain_negatives(rows)
    assert sorted(mined(df.drop("item").union(df.drop("item").filter("vec_id % 100 = 0")))) == plain_negatives(rows + [r for r in rows if r[0] is not None and r[0] % 100 == 0])
    assert mined(df.filter("vec_id = 0").drop("item")) == [] and mined(df.filter("vec_id < 0").drop("item")) == []


@pytest.mark.parametrize("name", ["op11_quality_classifier", "op12_conversation_repair", "op13_hard_negatives"])
def test_queries_return_what_is_asked(spark, name):
    columns = {"op11": subwords.COLUMNS, "op12": repair.COLUMNS, "op13": negatives.COLUMNS}[name[:4]]
    assert QUERIES[name](spark, SF).columns == columns
