"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words by Spark's higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.llm.common import let, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words of documents that travel as one row, about, and distinct words that a task knows at once; beyond them it starts anew.
GROUP_WORDS, KNOWN_WORDS = 100_000, 1_000_000
#: A longer word is merged with a heap in the task that read it, with the same result: a fold's steps over it would grow with its square.
MAX_FOLD_BYTES = 4096
#: Letters and numbers (hexadecimal ranges) that the tokenizer's library knows and Java 17's classes don't.
NEW_LETTERS = (
    "870-887 889-88E 8B5-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F-2C5F 9FFD-9FFF A7C0-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 "
    "105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 "
    "1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def _also(ranges: str) -> str:
    """A nested class of the ranges; most characters lie outside the span of all and are told so at once."""
    ends = [x.split("-") for x in ranges.split()]
    inner = "".join(f"\\x{{{e[0]}}}-\\x{{{e[-1]}}}" for e in ends)
    return f"[\\x{{{ends[0][0]}}}-\\x{{{ends[-1][-1]}}}&&[{inner}]]"


#: The tokenizer's pattern for Java: its classes of letters, numbers and white space as the library has them.
LETTERS, NUMBERS, WHITE = r"\p{L}" + _also(NEW_LETTERS), r"\p{N}" + _also(NEW_NUMBERS), r"\p{IsWhite_Space}"
PATTERN = (
    public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", "[^@S@L@N]").replace(r"\p{L}", "[@L]").replace(r"\p{N}", "[@N]").replace(r"\s", "@S").replace(r"\S", r"\P{IsWhite_Space}")
    .replace("@L", LETTERS).replace("@N", NUMBERS).replace("@S", WHITE)
)
#: In a fold, a token is one number: the rank of its pair with the next (NONE if the two are no token), the place of its first byte, its id.
PLACE, ID = 16, (1 << 16) - 1
RANK, NONE = 16 + 13, 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def checked(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """ranks, if a fold's numbers can hold them: ids of 16 bits at most, and every byte a token."""
    if not ranks or max(ranks.values()) > ID or min(ranks.values()) < 0:
        raise ValueError(f"ids must lie in 0..{ID}")
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("each byte must be a token")
    return ranks


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The rank of each two tokens whose bytes together are a token."""
    return {(ranks[t[:i]], ranks[t[i:]]): rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def heap_merge(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """ids after merging, again and again, the first pair of the least rank."""
    ids, right, left = list(ids), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], right[i] = rank, -1, right[j]
        if right[j] < len(ids):
            left[right[j]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < len(ids) and (p := (ids[k], ids[right[k]])) in pairs:
                heapq.heappush(heap, (pairs[p], k, *p))
    return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def _tables(path: str) -> pa.Table:
    """The rank map as a row of lists, by which the rank of tokens a and b is rank[base[a] + b] where owner[base[a] + b] is a, ids of the bytes, and the ranks of two bytes.

    Each token's row of followers is laid over the free places of one list, the longest rows first.
    """
    ranks = checked(load_ranks(path))
    pairs = pair_ranks(ranks)
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pairs.items():
        rows.setdefault(a, []).append((b, rank))
    n, span = max(ranks.values()) + 1, 1 << 20
    free, owner, rank_at = np.ones(span + n, bool), np.full(span + n, -1), np.full(span + n, -1)
    base, top, begin, size = np.full(1 << 16, span + n), 0, 0, 0
    for a in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        followers, own = (np.array(x) for x in zip(*sorted(rows[a]), strict=True))
        off = followers - followers[0]
        begin, size = (0 if len(off) < min(size, 6) else begin), len(off)
        while True:
            places = np.flatnonzero(free[begin : begin + 2048]) + begin
            fits = places[free[places[:, None] + off].all(axis=1)]
            if len(fits):
                break
            begin += 2048
        at = fits[0] + off
        free[at], owner[at], rank_at[at], base[a], top = False, a, own, fits[0] - followers[0], max(top, at[-1] + 1)
    byte = [ranks[bytes([i])] for i in range(256)]
    two = [[pairs.get((a, b), NONE) for b in byte] for a in byte]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = pa.schema({"base": ints, "owner": ints, "rank": longs, "byte": ints, "two": pa.list_(longs)})
    return pa.Table.from_arrays([pa.array([x], kind) for x, kind in zip((base, owner[:top], rank_at[:top], byte, two), kinds.types, strict=True)], schema=kinds)


def rank_map(spark: SparkSession, path: str) -> Column:
    """A subquery of one local row, whose size is the vocabulary's. Not a literal, whose whole value stands in every text that the driver makes and keeps of a plan."""
    tables = spark.createDataFrame(_tables(path))
    return tables.select(F.struct(*(F.col(c) for c in tables.columns)).alias("ranks")).scalar()


def fold(word: Column, ranks: Column) -> Column:
    """The ids of a word's tokens from its bytes (integers): a step for each byte but the first merges the first pair of the least rank, if any is left."""
    long, least = (lambda x: F.lit(x).cast("long")), F.lit(NONE << RANK).cast("long")
    token = lambda x: x.bitwiseAND(long(ID)).cast("int")

    def rank(a: Column, b: Column) -> Column:
        at = F.get(ranks["base"], a) + b
        return F.when(F.get(ranks["owner"], at) == a, F.get(ranks["rank"], at)).otherwise(long(NONE))

    def first(x: Column, i: Column) -> Column:
        pair = F.coalesce(F.get(F.get(ranks["two"], x), F.get(word, i + 1)), long(NONE))
        return F.shiftleft(pair, RANK).bitwiseOR(F.shiftleft(i.cast("long"), PLACE)).bitwiseOR(F.get(ranks["byte"], x).cast("long"))

    def step(tokens: Column) -> Column:
        def merged(lowest: Column, at: Column) -> Column:
            new, before = F.shiftright(lowest, RANK).cast("int"), F.get(tokens, at - 2)
            left = F.shiftleft(rank(token(before), new), RANK).bitwiseOR(before.bitwiseAND(long((1 << RANK) - 1)))
            own = F.shiftleft(rank(new, token(F.get(tokens, at + 1))), RANK).bitwiseOR(lowest.bitwiseAND(long((1 << RANK) - 1 - ID))).bitwiseOR(new.cast("long"))
            return F.concat(F.slice(tokens, 1, at - 2), F.array(left, own), F.slice(tokens, at + 2, F.size(word)))

        found = lambda lowest: let(F.array_position(tokens, lowest).cast("int"), lambda at: merged(lowest, at))
        return let(F.array_min(tokens), lambda lowest: F.when(lowest >= least, tokens).otherwise(found(lowest)))

    # A token that pairs with none stands at both ends, so that each token has two neighbours.
    edge = F.array(F.lit(NONE << RANK | ID).cast("long"))
    start = F.concat(edge, F.transform(word, first), edge)
    done = lambda tokens: F.transform(F.slice(tokens, 2, F.size(tokens) - 2), token)
    bare = F.transform(word, lambda x: F.get(ranks["byte"], x))
    return F.when(F.size(word) < 2, bare).otherwise(F.aggregate(F.slice(word, 2, F.size(word)), start, lambda tokens, _: step(tokens), done))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, group_words: int = GROUP_WORDS, known_words: int = KNOWN_WORDS, packed: bool = False) -> DataFrame:
    """A row for each document: the key, n_tokens, ids (decimal, joined by commas; packed: 32-bit little-endian) and decoded (the bytes of the ids).

    The text is split by the tokenizer's pattern; special tokens are plain text. Null and empty texts have no ids;
    repeated rows stay rows; an empty table gives no rows; a text of any length is encoded whole; other columns are not
    looked at. A task numbers the distinct words of what it reads: those that it has not met yet go through the fold,
    with the documents as lists of numbers, and the end of the task keeps their tokens and joins them. Beyond
    known_words distinct words both ends start anew. Nothing is shuffled or broadcast but the vocabulary.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    ranks = checked(load_ranks(path))
    kind = docs.schema[key].dataType
    context = docs.sparkSession.sparkContext
    merges = context.broadcast((pair_ranks(ranks), [ranks[bytes([i])] for i in range(256)]))
    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        by_id[i] = piece
    tokens = context.broadcast(by_id)

    def listed(values, ends: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)

    def bytes_of(words: list[bytes]) -> tuple[pa.ListArray, pa.Array]:
        """The words' bytes, or the ids of words that are too long, and whether they are ids."""
        long = np.array([len(w) > MAX_FOLD_BYTES for w in words], bool)
        if long.any():
            pairs, byte = merges.value
            arrays = [heap_merge([byte[x] for x in w], pairs) if done else list(w) for w, done in zip(words, long, strict=True)]
            return pa.array(arrays, pa.list_(pa.int32())), pa.array(long)
        values = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        return listed(pa.array(values), np.cumsum([len(w) for w in words], dtype=np.int64)), pa.array(long)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + group_words, "right")))
                coded = batch.column(1).slice(lo, hi - lo).flatten().dictionary_encode()
                own = coded.dictionary.cast(pa.binary()).to_pylist()
                anew = len(numbers) > known_words or not numbers
                if anew:
                    numbers = {}
                new = [w for w in own if w not in numbers]
                numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
                at = np.fromiter(map(numbers.__getitem__, own), np.int32, len(own))[coded.indices.to_numpy()]
                words, done = bytes_of(new)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = {"keys": one(batch.column(0).slice(lo, hi - lo)), "ends": one(pa.array(sizes[lo:hi] - before, pa.int64())), "at": pa.array([at.tobytes()]), "words": one(words), "done": one(done), "anew": pa.array([anew])}
                yield pa.RecordBatch.from_pydict(columns)
                lo = hi

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(tokens.value, pa.binary())
        sizes = texts = decoded = None
        for batch in batches:
            for row in range(batch.num_rows):
                keys, ends, ids = (batch.column(i)[row].values for i in (0, 1, 2))
                at = np.frombuffer(batch.column(3)[row].as_py(), np.int32)
                flat, upto = ids.flatten(), ids.offsets.to_numpy()[1:] - ids.offsets[0].as_py()
                own = np.diff(upto, prepend=0)
                if packed:
                    raw = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], 4 * upto]).astype(np.int32)), pa.py_buffer(flat.to_numpy().astype("<u4"))])
                else:
                    raw = pc.binary_join(listed(flat.cast(pa.string()), upto), ",")
                back = pc.binary_join(listed(pieces.take(flat), upto), b"")
                fresh = batch.column(4)[row].as_py()
                sizes = own if fresh else np.concatenate([sizes, own])
                texts, decoded = (raw, back) if fresh else (pa.concat_arrays([texts, raw]), pa.concat_arrays([decoded, back]))
                ends, words = ends.to_numpy(), pa.array(at)
                total = np.concatenate([[0], np.cumsum(sizes[at])])
                joined = lambda x, by, e=ends, w=words: pc.binary_join(listed(x.take(w), e), by)
                counts = pa.array(np.diff(total[ends], prepend=0))
                yield pa.RecordBatch.from_arrays([keys, counts, joined(texts, b"" if packed else ","), joined(decoded, b"")], [key, "n_tokens", "ids", "decoded"])

    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))
    grouped = docs.select(key, words.alias("_words")).mapInArrow(tidy(split), f"keys array<{kind.simpleString()}>, ends array<bigint>, at binary, words array<array<int>>, done array<boolean>, anew boolean")
    ids = let(F.col("_ranks"), lambda m: F.zip_with("words", "done", lambda w, done: F.when(done, w).otherwise(fold(w, m))))
    merged = grouped.withColumn("_ranks", rank_map(docs.sparkSession, path)).select("keys", "ends", ids.alias("ids"), "at", "anew")
    return merged.mapInArrow(tidy(assemble), f"`{key}` {kind.simpleString()}, n_tokens long, ids {'binary' if packed else 'string'}, decoded binary")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    return encoded.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reference_digests(text: str | None, ranks: dict[bytes, int]) -> tuple[int, str, str]:
    """The same of one text by the public library, for tests."""
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()


COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
