"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotledger.llm.common import let

#: A sentence ends with its line or its mark.
BREAKS = r"\n|(?<=[.!?]) +"
#: Cells of a fingerprint and of a group's first sketch, and of its retries: three tables of a power of two.
CELLS, RETRIES = 12, (48, 192, 768)
#: Digests in a group of the larger text, about, and rounds of peeling.
IN_GROUP, ROUNDS = 2, 8
#: Documents in a bucket of neighbouring keys, about, buckets at the most, and keys of a bucket that are sampled for its edges.
BUCKET, BUCKETS, SAMPLED = 256, 1 << 14, 16
CELL = "struct<c:int,k:bigint,h:bigint>"


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's sentences that hold more than blanks."""
    pieces = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAKS), F.trim), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _in(digest: Column, cell: Column, cells: int) -> Column:
    """Whether a digest has a cell: each table takes it by bits of its own."""
    return F.call_function("shiftright", digest, cell["s"]).bitwiseAND(cells // 3 - 1) == cell["i"]


def _put(cell: Column, digest: Column, count: Column) -> Column:
    """cell with a digest in it, count times; as often as it is put and taken, it leaves nothing."""
    return F.struct(
        (cell["c"] + count).cast("int").alias("c"), cell["k"].bitwiseXOR(digest).alias("k"), cell["h"].bitwiseXOR(_check(digest)).alias("h")
    )


def _at(cells: int) -> Column:
    """Of each cell the shift of its table and its number in it."""
    each = cells // 3
    return F.from_json(F.lit(str([{"s": 10 * t, "i": i} for t in range(3) for i in range(each)]).replace("'", '"')), "array<struct<s:int,i:bigint>>")


def sketch(digests: Column, cells: int) -> Column:
    """An array of cells (count, xor of digests, xor of their checks)."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    return F.transform(_at(cells), lambda a: F.aggregate(digests, zero, lambda x, d: F.when(_in(d, a, cells), _put(x, d, F.lit(1))).otherwise(x)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).cast("int").alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(difference: Column, cells: int, rounds: int = ROUNDS) -> Column:
    """The digests (struct of digest and side, 1 or -1) that only one of the two sets has; null if peeling gets stuck.

    A cell that one digest alone is left in shows it by its check. Each round takes out all that show, from all cells;
    the last is known by the first table, of which they leave nothing.
    """
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def turn(state: Column) -> Column:
        shown = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"]))
        alone = F.array_distinct(F.transform(shown, lambda x: F.struct(x["k"].alias("digest"), x["c"].alias("side"))))

        def taken(out: Column) -> Column:
            found = F.concat(state["found"], out).alias("found")
            table = F.aggregate(
                F.slice(state["cells"], 1, cells // 3), zero,
                lambda x, y: F.struct((x["c"] + y["c"]).cast("int").alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")),
            )
            rest = F.aggregate(out, table, lambda y, p: _put(y, p["digest"], -p["side"]))
            left = F.zip_with(
                state["cells"], _at(cells), lambda x, a: F.aggregate(F.filter(out, lambda p: _in(p["digest"], a, cells)), x, lambda y, p: _put(y, p["digest"], -p["side"]))
            )
            last = F.struct(F.slice(state["cells"], 1, 0).alias("cells"), found, F.lit(False).alias("open"))
            return F.when(rest == zero, last).when(F.size(out) == 0, F.struct(state["cells"].alias("cells"), found, F.lit(False).alias("open"))).otherwise(
                F.struct(left.alias("cells"), found, F.lit(True).alias("open"))
            )

        return F.when(~state["open"], state).otherwise(let(alone, taken))

    start = F.struct(difference.alias("cells"), F.array().cast("array<struct<digest:bigint,side:int>>").alias("found"), F.lit(True).alias("open"))
    done = lambda s: F.when(F.forall(s["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0)), s["found"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: turn(s), done)


def dealt(a: Column, b: Column) -> Column:
    """Structs (x, y) of the digests of two sets in one group, by bits of their own: in two steps, so that a digest is
    looked at by twice the root of the number of groups."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.greatest(F.size(a), F.size(b)) / IN_GROUP)).cast("int"))
    own = lambda s, shift, g: F.filter(s, lambda d: F.pmod(F.shiftright(d, shift), n) == g)

    def step(groups: Column, shift: int) -> Column:
        parts = lambda q: F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.struct(own(q["x"], shift, g).alias("x"), own(q["y"], shift, g).alias("y")))
        return F.flatten(F.transform(groups, parts))

    return step(step(F.array(F.struct(a.alias("x"), b.alias("y"))), 30), 41)


def differing(a: Column, b: Column, of_a: Column | None = None, of_b: Column | None = None) -> Column:
    """The digests that only one of two sets has, by sketches alone; of_a and of_b are their fingerprints' sketches, where known.

    First from the two fingerprints. Where peeling those fails, the digests are dealt into groups by other bits, each
    group has a sketch of its own, and a group whose peeling fails is sketched again, larger each time. A group that
    fails to the last (less than one in 10^9) is compared digest by digest, so that the result is always right.
    """
    of_a, of_b = sketch(a, CELLS) if of_a is None else of_a, sketch(b, CELLS) if of_b is None else of_b

    def group(x: Column, y: Column) -> Column:
        tries = [peel(subtract(sketch(x, n), sketch(y, n)), n, ROUNDS if n == CELLS else 4 * ROUNDS) for n in (CELLS, *RETRIES)]
        whole = lambda s, side: F.transform(s, lambda d: F.struct(d.alias("digest"), F.lit(side).alias("side")))
        return F.coalesce(*tries, F.concat(whole(F.array_except(x, y), 1), whole(F.array_except(y, x), -1)))

    first = F.when(F.abs(F.size(a) - F.size(b)) < CELLS, peel(subtract(of_a, of_b), CELLS))
    return F.coalesce(first, F.flatten(F.transform(dealt(a, b), lambda g: group(g["x"], g["y"]))))


def likeness(a: Column, b: Column, of_a: Column | None = None, of_b: Column | None = None) -> Column:
    """1 - the share of differing digests among all of both sets; 1 for two empty ones."""
    every = F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(1 - F.size(differing(a, b, of_a, of_b)) / every)


def as_text(digests: Column, cells: Column) -> Column:
    """A fingerprint: the number of digests and the cells of their sketch, in hexadecimal."""
    cells = F.transform(cells, lambda x: F.concat(F.hex(x["c"]), F.lit("."), F.hex(x["k"]), F.lit("."), F.hex(x["h"])))
    return F.lower(F.concat_ws(":", F.hex(F.size(digests)), F.array_join(cells, ":")))


def _edges(docs: DataFrame, key: str, n: int, count: int) -> list[str]:
    """About n - 1 keys as strings, in the keys' order, that part docs into buckets of neighbours: taken from a sample of some SAMPLED * n keys, chosen by a digest."""
    if n < 2:
        return []
    share = min(1.0, SAMPLED * n / count)
    # The sample is a small share of the keys, or all of few.
    mark = F.xxhash64(F.col(key).cast("string"), F.lit("edge")).cast("double") / 2.0**64 + 0.5
    rows = docs.select(F.col(key).alias("k"), F.col(key).cast("string").alias("s")).filter(F.col("k").isNotNull() & (mark < share)).distinct().collect()
    sample = [r["s"] for r in sorted(rows, key=lambda r: r["k"])]
    return list(dict.fromkeys(sample[i * len(sample) // n] for i in range(1, n))) if sample else []


def _bucket(key: Column, edges: list[str], kind: str) -> Column:
    """How many edges are less than the key, by two looks at lists as long as the root of their number; -1 for a null key."""
    if not edges:
        return F.when(key.isNull(), -1).otherwise(0)
    size = math.isqrt(len(edges)) + 1
    parts = [edges[i : i + size] for i in range(0, len(edges), size)]
    lists = F.from_json(F.lit(json.dumps(parts)), "array<array<string>>").cast(f"array<array<{kind}>>")
    none = F.array().cast(f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda e: e < key))
    inside = let(below(F.transform(lists, lambda p: F.element_at(p, -1))), lambda k: k * size + below(F.coalesce(F.get(lists, k), none)))
    return F.when(key.isNull(), -1).otherwise(F.least(inside, F.lit(len(edges))))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text ("" for null) and next, the text of the next document by descending key; the first's after the last.

    Keys are of any type that has an order. Rows without a key come last, rows of one key in order of their texts.
    Keys fall into buckets of neighbours, whose number grows with the rows, by edges from a bounded sample; each bucket's
    greatest key comes to the driver. A text moves once, to its bucket, and only the first text of each bucket a
    second time. Rows of one key, or without one, are one bucket, which its task sorts on disk.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    count, kind = docs.count(), docs.schema[key].dataType.simpleString()
    n = min(BUCKETS, math.ceil(count / BUCKET))
    placed = rows.withColumn("_bucket", _bucket(F.col("_key"), _edges(docs, key, n, count), kind))
    tops = [r[1] for r in placed.groupBy("_bucket").agg(F.max("_key")).collect()]
    heads = placed.filter(F.col("_key").isin([t for t in tops if t is not None]) | F.lit(None in tops) & F.col("_key").isNull())
    heads = heads.groupBy("_bucket").agg(F.min("_text").alias("_head"))
    down, every = W.orderBy(F.desc("_bucket")), W.orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select("_bucket", F.coalesce(F.lead("_head").over(down), F.first("_head").over(every)).alias("_after"))
    inside = W.partitionBy("_bucket").orderBy(F.desc_nulls_last("_key"), "_text")
    out = placed.withColumn("_next", F.lead("_text").over(inside)).join(heads, "_bucket")
    return out.select(F.col("_key").alias(key), F.col("_text").alias(text), F.coalesce("_next", "_after").alias("next"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its fingerprint and that of its edited text, whose last half is the next document's first.

    Columns: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (the likeness of
    the document's digests to the edited text's and the next document's). A null text is empty; equal texts have equal
    fingerprints; one document alone is its own next; repeated rows stay rows; an empty table gives no rows; long texts
    are cut into all their sentences; columns beyond the key and the text are not looked at.
    """
    rows = with_next(docs, key, text)
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.substring(F.col(text), F.lit(1), F.length(text) - half), F.substring(F.col("next"), F.lit(1), half))
    rows = rows.select(key, text, "next", edited.alias("edited"))
    rows = rows.select(
        key, F.length(text).cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col(text)).alias("a"), paragraphs(F.col("edited")).alias("b"), paragraphs(F.col("next")).alias("c"),
    )
    rows = rows.select("*", *(sketch(F.col(x), CELLS).alias(f"of_{x}") for x in "abc"))
    a, b, c, of_a, of_b, of_c = (F.col(x) for x in ("a", "b", "c", "of_a", "of_b", "of_c"))
    return rows.select(
        key, "n_chars", "edited_sha256", as_text(a, of_a).alias("fingerprint"), as_text(b, of_b).alias("edited_fingerprint"),
        likeness(a, b, of_a, of_b).alias("near_edited"), likeness(a, c, of_a, of_c).alias("near_next"),
    )


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
