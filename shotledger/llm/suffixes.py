"""Suffix-array dedup: repeated byte strings, found in suffix arrays that are built by linear grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.llm.common import tidy

#: A removed byte lies in a string of so many bytes that starts elsewhere, too.
LENGTH = 200
#: Bytes of an anchor. Each string of LENGTH bytes holds an anchor at a place that its bytes alone decide.
ANCHOR = 32
REACH = LENGTH - ANCHOR
#: Surroundings of anchors with more places are told apart by a longer core before they meet.
FREQUENT = 512
#: The strings around a frequent anchor by how far they reach to its left: classes of so many bytes, each with a core that its strings share.
CLASSES = tuple((x, min(x + 41, REACH)) for x in range(0, REACH + 1, 42))
#: More different surroundings of an anchor than these are compared by digests of all their strings, not by a suffix array.
MOST_SORTED = 512
ODD = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(s: list[int]) -> list[int]:
    """The sorted suffixes of s, whose last symbol is its least and stands there alone.

    First the suffixes are grouped by first symbol, and the groups are processed from the greatest down. Each suffix of
    a group points to the last suffix before it of a lower group, whose prefix it continues; those pointed at move to
    groups of their own just above the rest of theirs, the more often pointed at the higher. In the end a group holds
    the suffixes that begin with one Lyndon word. Then the order is read off from the least suffix on: the suffix before
    a placed one, and those it points to, take the next free places of their groups.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    # A group's key is its first place in the order; -1, before the text, counts as its last symbol, which is in no group but its own.
    groups: dict[int, set[int]] = {}
    rank, of_end, end_of = [0] * n, {}, {}
    start = 0
    while start < n:
        symbol, end = s[order[start]], start + 1
        while end < n and s[order[end]] == symbol:
            end += 1
        for i in order[start:end]:
            rank[i] = start
        groups[start] = set(order[start:end])
        of_end[end], end_of[start] = start, end
        start = end
    previous = [-1] * n
    end = n
    while end > 1:
        at = of_end[end]
        pointed: list[int] = []
        times: dict[int, int] = {}
        last = -1
        # Members come by their places in the text, so that those which point to one suffix follow each other.
        for i in sorted(groups[at]):
            j = i - 1
            while rank[j] >= at:
                j = previous[j]
            previous[i] = j
            if j == last:
                if j >= 0:
                    times[j] = times.get(j, 1) + 1
            elif j >= 0:
                pointed.append(j)
                last = j
        end = at
        by_count: dict[tuple[int, int], list[int]] = {}
        for j in pointed:
            low = rank[j]
            if len(groups[low]) > 1:
                by_count.setdefault((times.get(j, 1), low), []).append(j)
        for of in sorted(by_count, reverse=True) if times else by_count:
            moved, rest = by_count[of], groups[of[1]]
            if len(moved) == len(rest):
                continue
            low = of[1]
            high = end_of[low]
            cut = high - len(moved)
            rest.difference_update(moved)
            groups[cut] = set(moved)
            for j in moved:
                rank[j] = cut
            of_end[high], end_of[cut] = cut, high
            of_end[cut], end_of[low] = low, cut
    out, free, placed = [-1] * n, {g: g for g in groups}, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = out[i] - 1
        while not placed[j]:
            g = rank[j]
            at = free[g]
            out[at], placed[j], free[g] = j, True, at + 1
            j = previous[j]
    return out


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """For each suffix the number of symbols that it shares with the one of its neighbours in order that shares more."""
    n = len(s)
    before = [-1] * n
    for i, j in zip(order, order[1:], strict=False):
        before[j] = i
    best, h = [0] * n, 0
    for i, j in enumerate(before):
        if j < 0:
            h = 0
            continue
        # The last symbol stands alone, so that two suffixes part before the end.
        while s[i + h] == s[j + h]:
            h += 1
        if h:
            if best[i] < h:
                best[i] = h
            if best[j] < h:
                best[j] = h
            h -= 1
    return best


def _sorted_sides(sides: list[bytes], away: str) -> tuple[list[int], list[int]]:
    """The order of the strings, read from an anchor on, and how many bytes each shares with the next in it; away: big if the first byte is read first, else little."""
    width = max(map(len, sides))
    # As numbers of one width the strings sort alike, and what two share shows in their XOR. Of those that zeros alone tell apart the shorter comes first.
    values = [int.from_bytes(x, away) << 8 * (width - len(x)) for x in sides]
    order = sorted(range(len(sides)), key=lambda i: (values[i], len(sides[i])))
    return order, [min(width - ((values[i] ^ values[j]).bit_length() + 7 >> 3), len(sides[i]), len(sides[j])) for i, j in zip(order, order[1:], strict=False)]


def _reach(order: list[int], shared: list[int]) -> list[int]:
    """Of each string the most bytes that it shares with another."""
    best = [0] * len(order)
    for i, before, after in zip(order, [0, *shared], [*shared, 0], strict=True):
        best[i] = max(before, after)
    return best


def able(windows: list[tuple[int, bytes]], length: int) -> list[int]:
    """The windows that may share length bytes with another: what they share at the most to both sides of the anchor comes to that."""
    right, left = _reach(*_sorted_sides([w[a:] for a, w in windows], "big")), _reach(*_sorted_sides([w[:a] for a, w in windows], "little"))
    return [i for i, (x, y) in enumerate(zip(right, left, strict=True)) if x + y >= length]


def _branches(order: list[int], shared: list[int], other: list[int], length: int, first: int) -> tuple[list[list[int]], list[list[int]], int]:
    """Of each string the places where it parts from others, from the deepest up, and numbers from first on of the pieces that end there:
    strings have a number in common if they share all bytes up to that place. The next number.

    other: what each can share to the other side of the anchor. Where that doesn't come to length for any that shares a place, no
    string of length bytes can end; such places are left out."""
    depth, parent, most, stack, last = [0], [0], [length], [0], [0] * len(order)
    for i, h in zip(order, [*shared, 0], strict=True):
        if depth[stack[-1]] < h:
            depth.append(h)
            parent.append(stack[-1])
            most.append(0)
            stack.append(len(depth) - 1)
        last[i] = k = stack[-1]
        if most[k] < other[i]:
            most[k] = other[i]
        while depth[stack[-1]] > h:
            below = stack.pop()
            if depth[stack[-1]] < h:
                depth.append(h)
                parent.append(stack[-1])
                most.append(0)
                parent[below] = len(depth) - 1
                stack.append(len(depth) - 1)
    down = sorted(range(len(depth)), key=depth.__getitem__)
    for k in reversed(down[1:]):
        if most[parent[k]] < most[k]:
            most[parent[k]] = most[k]
    places, numbers = [[] for _ in depth], [[] for _ in depth]
    for k in down[1:]:
        above = parent[k]
        if depth[k] + most[k] >= length:
            places[k], numbers[k] = [depth[k], *places[above]], [first + k, *numbers[above]]
        else:
            places[k], numbers[k] = places[above], numbers[above]
    return [places[k] for k in last], [numbers[k] for k in last], first + len(depth)


def by_suffix_array(windows: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """windows: (place of the anchor, bytes), all different. Of each, the parts that a string of length bytes or more
    covers which another window has at the same place from the anchor.

    Strings that two windows share end where the two begin to differ. So each window is cut where it itself parts from another, to
    either side of the anchor, and what it shares with none falls away. Pieces are equal symbols if all between them and
    the anchor is equal, too; the suffix array is one of these symbols, and holds all that one of bytes would show.
    """
    right, left = _sorted_sides([w[a:] for a, w in windows], "big"), _sorted_sides([w[:a] for a, w in windows], "little")
    rights, of_right, free = _branches(*right, _reach(*left), length, len(windows) + 1)
    lefts, of_left, _ = _branches(*left, _reach(*right), length, free)
    symbols, owner, begin = [], [], []
    for k, (a, _) in enumerate(windows):
        edges = [a - x for x in lefts[k]]
        edges.append(a)
        edges += [a + x for x in reversed(rights[k])]
        symbols += of_left[k]
        symbols += reversed(of_right[k])
        symbols.append(k + 1)
        owner += [k] * len(edges)
        begin += edges
    symbols.append(0)
    best = common_prefixes(symbols, suffix_array(symbols))
    out: list[list[tuple[int, int]]] = [[] for _ in windows]
    for i, k in enumerate(owner):
        if best[i] and (stop := begin[i + best[i]]) - begin[i] >= length:
            out[k].append((begin[i], stop))
    return out


def _rolled(data: np.ndarray, length: int) -> np.ndarray:
    """A digest of each string of length bytes, from digests of strings of powers of two."""
    digests, n, out, done = (data.astype(np.uint64) + np.uint64(1)) * ODD, 1, None, 0
    while n <= length:
        if length & n:
            size = len(data) - length + 1 if length < 2 * n else None
            part = digests[done:] if out is None else digests[done : done + len(out)]
            out = part.copy() if out is None else out[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part
            done += n
            out = out if size is None else out[:size]
        digests = digests[: max(0, len(digests) - n)] * np.uint64((2 * n + 1) * 0xA0761D6478BD642F & (1 << 64) - 1) + digests[n:]
        digests = (digests ^ (digests >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        n *= 2
    return (out ^ (out >> np.uint64(32))) * ODD


def by_digests(windows: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """The same as by_suffix_array(), for many windows, from 64-bit digests of all their strings."""
    where, what = [], []
    for a, w in windows:
        digests = _rolled(np.frombuffer(w, np.uint8), length) if len(w) >= length else np.zeros(0, np.uint64)
        what.append(digests)
        where.append(np.arange(len(digests), dtype=np.int64) - a)
    owner = np.repeat(np.arange(len(windows)), [len(x) for x in what])
    what, where = np.concatenate(what), np.concatenate(where)
    _, at, times = np.unique((what ^ (where.view(np.uint64) * ODD)), return_inverse=True, return_counts=True)
    out: list[list[tuple[int, int]]] = [[] for _ in windows]
    for i in np.flatnonzero(times[at] > 1):
        k = int(owner[i])
        x = int(where[i]) + windows[k][0]
        if out[k] and out[k][-1][1] >= x:
            out[k][-1] = (out[k][-1][0], x + length)
        else:
            out[k].append((x, x + length))
    return out


def _slid(x: np.ndarray, size: int, of) -> np.ndarray:
    """of (a minimum or maximum) over each run of size elements."""
    n = 1
    while 2 * n <= size:
        x, n = of(x[:-n], x[n:]), 2 * n
    return x if n == size else of(x[: len(x) - (size - n)], x[size - n :])


def _marks(data: np.ndarray) -> np.ndarray:
    """A number other than 0 for each string of ANCHOR bytes, from four words of eight. Equal numbers of different strings cost time, no more."""
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)) * ODD
    words ^= words >> np.uint64(32)
    out = words[: len(data) - ANCHOR + 1] * np.uint64(0xD6E8FEB86659FD93)
    for i, odd in enumerate((0xA0761D6478BD642F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), 1):
        out += words[8 * i :][: len(out)] * np.uint64(odd)
    out ^= out >> np.uint64(32)
    out *= ODD
    out ^= out >> np.uint64(29)
    out |= np.uint64(1)
    return out


def anchors(data: np.ndarray, ends: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and digests of the anchors of texts that stand in data without gaps, all but the last up to one of ends: those that are least
    among the REACH + 1 of any string of LENGTH bytes of one text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    digests = _marks(data)
    least = _slid(digests, REACH + 1, np.minimum)
    for end in ends:
        least[max(0, end - LENGTH + 1) : end] = 0  # such a string reaches into the next text
    edge = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(_slid(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == digests)
    return at, digests[at]


#: Texts are looked through together up to so many bytes, which a processor's cache holds.
TOGETHER = 1 << 14


def _anchors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts, where each begins and the last ends, and of all anchors the text, the place in it and the digest, in order."""
    texts = column.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    places, digests, i = [], [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + TOGETHER, "right")) - 1)
        at, found = anchors(data[offsets[i] : offsets[j]], (offsets[i + 1 : j] - offsets[i]).tolist())
        places.append(at + offsets[i])
        digests.append(found)
        i = j
    places = np.concatenate(places or [np.zeros(0, np.int64)])
    rows = np.searchsorted(offsets, places, "right") - 1
    return data, offsets, rows, places - offsets[rows], np.concatenate(digests or [np.zeros(0, np.uint64)]).view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        _, _, rows, _, found = _anchors_of(b.column("_text"))
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
        new = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1]))[: len(rows)])
        times = np.diff(np.append(new, len(rows)))
        own = pa.array(rows[new])
        yield pa.RecordBatch.from_arrays([b.column("_a").take(own), b.column("_b").take(own), pa.array(found[new]), pa.array(times.astype(np.int64))], ["_a", "_b", "anchor", "times"])


WINDOWS = "_a long, _b long, anchor long, core int, at int, window binary, starts array<int>"


def _cores(data: bytes, p: int, anchor: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """Of a frequent anchor at p and each class: a digest of the anchor's core, its length, what stands before it, the bytes around it, their start.

    A string of the class reaches to the core's left and right; the core is in all of them, so it is left out and stands for itself in the digest.
    """
    for low, high in CLASSES:
        x, y = p - low, p + LENGTH - high
        if x >= 0 and y <= len(data):
            before, after = max(0, p - high), p + LENGTH - low
            digest = hashlib.blake2b(data[x:y], digest_size=8, key=f"{anchor} {low}".encode()).digest()
            yield int.from_bytes(digest, "little", signed=True), y - x, x - before, data[before:x] + data[y:after], before


def _listed(starts: list[list[int]]) -> pa.ListArray:
    """starts as an Arrow array, without a look at each list's values by itself."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, starts)]), pa.int32()), pa.array(np.fromiter(chain.from_iterable(starts), np.int32), pa.int32()))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets, rows, places, found = _anchors_of(b.column("_text"))
        repeated = b.column("repeated")
        known, times = (repeated.flatten().field(c).to_numpy() for c in ("anchor", "times"))
        upto = np.concatenate([[0], np.cumsum(repeated.value_lengths().fill_null(0).to_numpy())])
        first = np.searchsorted(rows, np.arange(b.num_rows + 1))
        out: list[tuple] = []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            row, anchor, core, at, window, starts = zip(*out, strict=True)
            row = pa.array(row, pa.int64())
            return pa.RecordBatch.from_arrays([b.column("_a").take(row), b.column("_b").take(row), pa.array(anchor, pa.int64()), pa.array(core, pa.int32()), pa.array(at, pa.int32()), pa.array(window, pa.binary()), _listed(starts)], ["_a", "_b", "anchor", "core", "at", "window", "starts"])  # noqa: B023

        for i in range(b.num_rows):
            of = dict(zip(known[upto[i] : upto[i + 1]].tolist(), times[upto[i] : upto[i + 1]].tolist(), strict=True))
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            own: dict[tuple, list[int]] = {}
            for p, h in zip(places[first[i] : first[i + 1]].tolist(), found[first[i] : first[i + 1]].tolist(), strict=True):
                n = of.get(h, 0)
                if n > FREQUENT:
                    for digest, core, at, around, lo in _cores(text, p, h):
                        own.setdefault((digest, core, at, around), []).append(lo)
                elif n:
                    lo = max(0, p - REACH)
                    own.setdefault((h, 0, p - lo, text[lo : p + LENGTH]), []).append(lo)
            out += [(i, *key, starts) for key, starts in own.items()]
            if len(out) > 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)


def _covered(at: list[int], window: list[bytes], several: list[bool], core: int) -> Iterator[tuple[int, int, int]]:
    """Surroundings of one anchor or, less its bytes, one core; several: stands more than once in its text. (number, start, stop) of what to remove, from each one's start."""
    held: dict[tuple[int, bytes], list[int]] = {}
    for i, key in enumerate(zip(at, window, strict=True)):
        held.setdefault(key, []).append(i)
    windows, length = list(held), LENGTH - core
    alone = [len(m) == 1 and not several[m[0]] for m in held.values()]
    parts: list[list[tuple[int, int]]] = [[] for _ in windows]
    if len(windows) > 1 and any(alone):
        some = able(windows, length)
        found = (by_suffix_array if len(some) <= MOST_SORTED else by_digests)([windows[i] for i in some], length) if any(alone[i] for i in some) else [[] for _ in some]
        for i, spans in zip(some, found, strict=True):
            parts[i] = spans
    for (_, around), members, one, spans in zip(windows, held.values(), alone, parts, strict=True):
        if not one and len(around) >= length:
            spans = [(0, len(around))]
        for x, y in merged(spans):
            for i in members:
                yield i, x, y + core


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("anchor").to_numpy(), b.column("core").to_numpy()


def _spans_of(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of whole groups that follow each other, what to remove."""
    anchor, core = _keys(b)
    counts = b.column("starts").value_lengths().to_numpy()
    begin = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (core[1:] != core[:-1])))
    size = np.diff(np.append(begin, len(anchor)))
    # A place alone meets nothing.
    meets = (size > 1) | (counts[begin] > 1)
    b = b.filter(pa.array(np.repeat(meets, size)))
    size, core = size[meets].tolist(), core[begin[meets]].tolist()
    counts = b.column("starts").value_lengths().to_numpy()
    at, window, several = b.column("at").to_numpy().tolist(), b.column("window").to_pylist(), (counts > 1).tolist()
    row, start, stop, i = [], [], [], 0
    for n, c in zip(size, core, strict=True):
        for k, x, y in _covered(at[i : i + n], window[i : i + n], several[i : i + n], c):
            row.append(i + k)
            start.append(x)
            stop.append(y)
        i += n
    if not row:
        return None
    # Each span once for every place where its row's window starts.
    row, upto = np.array(row), np.append(0, np.cumsum(counts))
    times = counts[row]
    which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    lo = b.column("starts").flatten().to_numpy()[np.repeat(upto[row], times) + which]
    rows = pa.array(np.repeat(row, times))
    return pa.RecordBatch.from_arrays([b.column("_a").take(rows), b.column("_b").take(rows), *(pa.array((np.repeat(np.array(x), times) + lo).astype(np.int32)) for x in (start, stop))], ["_a", "_b", "start", "stop"])


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come sorted, and may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        anchor, core = _keys(b)
        now = anchor[-1], core[-1]
        at = int(np.append(-1, np.flatnonzero((anchor != now[0]) | (core != now[1])))[-1]) + 1
        # The last group waits, for it may go on.
        if at:
            held.append(b.slice(0, at))
        if (at or now != last) and held:
            if (out := _spans_of(pa.concat_batches(held))) is not None:
                yield out
            held = []
        held.append(b.slice(at))
        last = now
    if held and (out := _spans_of(pa.concat_batches(held))) is not None:
        yield out


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """docs (key, text and more) with spans, array<struct<start, stop>> of bytes to remove, sorted and apart; [] where there are none.

    A string of LENGTH bytes that occurs twice holds one anchor at one place in both. Anchors are counted over all texts; a text
    gives the surroundings of those that occur again, LENGTH bytes in all to either side, and these meet by anchor.
    Matches never cross texts. Null and empty texts have no spans; repeated rows repeat each other; a string may repeat
    in one text, and overlap itself; very long texts are read whole; an empty table gives no rows; other columns are
    not looked at but for those named. The surroundings of a frequent anchor meet by longer cores, and without the
    cores' bytes: their rows grow with its places, not with its pairs.
    """
    rows = docs.select(key, *more, F.col(text).alias("_text"), F.xxhash64(F.col(key).cast("string")).alias("_a"), F.xxhash64(text).alias("_b"))
    marks = rows.select("_a", "_b", "_text").mapInArrow(tidy(_anchor_rows), "_a long, _b long, anchor long, times long")
    frequent = marks.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1")
    own = marks.select("_a", "_b", "anchor").join(frequent, "anchor").groupBy("_a", "_b").agg(F.collect_set(F.struct("anchor", "times")).alias("repeated"))
    # All columns of rows, so that the texts' move to their rows' keys is the one that the last join uses, too.
    windows = rows.join(own, ["_a", "_b"]).mapInArrow(tidy(_window_rows), WINDOWS)
    dealt = windows.repartition("anchor", "core").sortWithinPartitions("anchor", "core")
    spans = dealt.mapInArrow(tidy(_span_rows), "_a long, _b long, start int, stop int")
    spans = spans.groupBy("_a", "_b").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = rows.join(spans, ["_a", "_b"], "left")

    return out.select(key, *more, F.col("_text").alias(text), joined(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))


SPANS = "array<struct<start:int,stop:int>>"


def joined(spans: Column) -> Column:
    """Sorted spans, those that meet as one: a fold in the JVM, whose state is as long as what is left apart."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        meets = (F.size(done) > 0) & (last["stop"] >= s["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def cut_text(text: str | None, spans) -> bytes:
    data, out, at = _bytes(text), [], 0
    for s in spans:
        out.append(data[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, data[at:]])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the key, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256."""

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    def apart(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            kept, n = cut_text(t, s), len(_bytes(t))
            rows.append((n, n - len(kept), len(s), kept, hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return repeated_spans(docs, key, text).withColumn("_o", apart(text, "spans")).select(key, "_o.*")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs, with the texts that remain and their lengths. A character that loses some of its bytes goes; a text may become empty."""

    @F.pandas_udf("string")
    def kept(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from tidy(lambda parts: (left(*x) for x in parts))(batches)

    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_text(t, s).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    # The other columns travel as one, whose names meet no others; chars is counted anew.
    others = [c for c in docs.columns if c not in (key, text, chars)]
    out = repeated_spans(docs.withColumn("_row", F.struct(*others) if others else F.lit(0)), key, text, "_row").withColumn("_kept", kept(text, "spans"))
    columns = {c: F.col("_row").getField(c) for c in others} | {key: F.col(key), text: F.col("_kept")} | ({chars: F.length("_kept").cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return out.select(*(columns[c].alias(c) for c in docs.columns))


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
