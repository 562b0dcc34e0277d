"""Scalar expressions: rounding, sampling, parsing of replies, text building. All are Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    """x held to 0..1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def seconds(frame: Column, fps: Column) -> Column:
    """A frame's time, rounded half to even at three places."""
    return F.bround(frame / fps, 3)


def picked(n: Column, most: int) -> Column:
    """Indices of at most `most` of n evenly spread items, truncated (all of them if there are no more)."""
    m = F.least(n, F.lit(most))
    spread = F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), lambda i: F.when(m == 1, F.lit(0)).otherwise(F.floor(i * (n - 1) / F.greatest(m - 1, F.lit(1)))).cast("int"))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<int>"))


def middle(first: Column, last: Column) -> Column:
    """The middle frame of first..last, rounded down."""
    return F.floor((first + last) / 2)


def middle_of(n: Column, lower: bool = False) -> Column:
    """The middle index of n items; of an even number the upper, or the lower one; null of none."""
    return F.when(n > 0, F.floor((n - 1) / 2 if lower else n / 2))


def keyframes(first: Column, last: Column, n: int) -> Column:
    """n evenly spread frames of first..last, rounded half to even; all of them if there are no more, the first where last isn't after it.

    One keyframe alone is the middle, rounded down, since no spread has one item."""
    all_ = F.sequence(first.cast("int"), F.greatest(first, last).cast("int"))
    spread = F.array(F.floor((first + last) / 2).cast("int")) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(first + (last - first) * i / (n - 1)).cast("int"))
    return F.when(last <= first, F.array(first.cast("int"))).when(last - first + 1 <= n, all_).otherwise(spread)


def paired(n_source: Column, n_edit: Column, most: int) -> Column:
    """Indices of matched frames of two lists: the middle one alone, or spread evenly and rounded half to even."""
    n = F.least(n_source, n_edit)
    m = F.greatest(F.lit(1), F.least(n, F.lit(most)))
    middle = F.array(F.floor((n - 1) / 2).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(2)) - 1), lambda i: F.bround(i * (n - 1) / F.greatest(m - 1, F.lit(1))).cast("int"))
    return F.when(n < 1, F.array().cast("array<int>")).when(m == 1, middle).otherwise(spread)


def rating(reply: Column, most: float = 5.0) -> Column:
    """The first number of one digit and at most one decimal in a reply, held to 0..most and divided by it; null if there is none."""
    first = F.nullif(F.regexp_extract(reply, r"\b([0-9](?:\.[0-9])?)\b", 1), F.lit("")).try_cast("double")
    return F.when(first.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(0.0), first)) / most)


def says_yes(reply: Column) -> Column:
    """Whether a reply means yes: a leading word decides, else a yes that no "no" stands before. A word ends at what is no letter, digit or underscore of any script."""
    text = F.lower(F.coalesce(reply, F.lit("")))
    yes = F.rlike(text, F.lit(r"(?U)^\s*(yes|true|是)\b"))
    no = F.rlike(text, F.lit(r"(?U)^\s*(no|false|否|不)\b"))
    before = F.split_part(text, F.lit("yes"), F.lit(1))
    return F.when(yes, F.lit(True)).when(no, F.lit(False)).otherwise(F.contains(text, F.lit("yes")) & ~F.contains(before, F.lit("no")))


def lenient_json(reply: Column, schema: str) -> Column:
    """What stands between the first { and the last }, parsed; null where nothing does."""
    body = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return F.from_json(body, schema)


def winner(label: Column) -> Column:
    """A, B or C from the label's first letter; null for any other."""
    first = F.upper(F.substring(F.trim(label), 1, 1))
    return F.when(first.isin("A", "B", "C"), first)


#: Words that name a new order of shots.
REORDER = r"\b(reorder|shot order|shot sequence|trade positions|trade places)\b"
#: Kinds of edit of older prompts and their words, in order.
OLDER_KINDS = (("insert", r"\b(insert|add)\b"), ("delete", r"\b(delete|remove)\b"), ("swap", r"\bswap\b"))


def operation(instruction: Column, given: Column, older: bool = False) -> Column:
    """"reorder" where that is given or the instruction says so, else "unknown"; older also names the kinds that older prompts have."""
    text = F.lower(F.coalesce(instruction, F.lit("")))
    out = F.when(F.coalesce(given == "reorder", F.lit(False)) | F.rlike(text, F.lit(REORDER)), F.lit("reorder"))
    for kind, words in OLDER_KINDS if older else ():
        out = out.when(F.rlike(text, F.lit(words)), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


#: Fixed value: where a text spells out an order.
ORDERED = r"(?i)shot order\s*([0-9,\s]+)"


def expected_order(given: Column, instruction: Column) -> Column:
    """The new order of shots as integers: from a list that isn't empty (null if an entry is none), else from what follows "shot order" in
    the text, parted by commas or blanks; null where there is neither."""
    cast = F.transform(given, lambda x: x.try_cast("int"))
    listed = F.when(F.forall(cast, lambda x: x.isNotNull()), cast)
    named = F.regexp_extract(F.coalesce(instruction, F.lit("")), ORDERED, 1)
    parsed = F.transform(F.filter(F.split(named, r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("int"))
    return F.when(F.size(given) > 0, listed).otherwise(F.when(named != "", parsed))


def hash_unit(*items: Column) -> Column:
    """0..1 from the first four bytes of the MD5 of the items joined by |."""
    text = F.concat_ws("|", *(i.cast("string") for i in items))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def filled(template: Column, **names: Column) -> Column:
    for name, value in names.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def listed(value: Column) -> Column:
    """A list of the texts in a value that is one text or a JSON list of texts; empty ones and nulls are left out."""
    many = F.from_json(value, "array<string>")
    bare = F.when(F.rlike(value, F.lit(r"(?s)^\s*\[.*\]\s*$")) & many.isNotNull(), many).otherwise(F.array(value))
    return F.filter(bare, lambda v: F.coalesce(v, F.lit("")) != "")


def queries_joined(queries: Column) -> Column:
    """Non-empty queries joined by "; ", null if there are none."""
    return F.nullif(F.array_join(F.filter(queries, lambda q: q != ""), "; "), F.lit(""))


#: Fixed value: a tag of a caption and the text after it.
TAGGED = r"(?s)\[(.*?)\]\s*([^\[]*)"


def shots_of_caption(caption: Column) -> Column:
    """ "Shot i: [tag] action" for each [tag] of a caption, which stays as it is, and the text after it, whose blanks become single."""
    tags, rest = (F.regexp_extract_all(caption, F.lit(TAGGED), F.lit(i)) for i in (1, 2))
    clean = lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" "))
    both = F.arrays_zip(tags.alias("tag"), rest.alias("rest"))
    return F.transform(both, lambda x, i: F.concat(F.lit("Shot "), (i + 1).cast("string"), F.lit(": ["), x["tag"], F.lit("] "), clean(x["rest"])))


def multishot_prompt(caption: Column) -> Column:
    """struct<prompt, n_shots>: a caption's shots as one text, with nothing between them, and their number."""
    shots = shots_of_caption(caption)
    return F.struct(F.array_join(shots, "").alias("prompt"), F.size(shots).alias("n_shots"))


def article(word: Column) -> Column:
    return F.concat(F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), F.lit("an ")).otherwise(F.lit("a ")), word)


def prompt_text(template: str, instruction: Column, target: Column) -> Column:
    """A judge's prompt; a blank target is "the requested change"."""
    target = F.coalesce(F.nullif(F.trim(target), F.lit("")), F.lit("the requested change"))
    return filled(F.lit(template), instruction=F.trim(instruction), target=target)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
