"""Quality rules: a threshold table compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotledger.llm.common import SPACES, let, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are be with as by this from or at an not he she his her they which have had but "
    "le la les de des du et un une est que qui dans pour pas sur par au avec en "
    "der die das und ist zu den von mit sich nicht ein eine auf dem es im für als auch "
    "el los las y del se una por con no para su al lo como más"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """low <= 1000 * part / whole <= high; a document whose whole is 0 passes. None leaves a side open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None


#: The production table. Lengths in code points; a line counts if it has a word.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2000, high=14000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
    Rule("repeated_words", "n_repeat_words", "n_words", high=500),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _covered(grams: Column) -> Column:
    """Words in the windows of three that grams holds the hashes of, for those hashes that occur twice or more."""

    def spans(pairs: Column) -> Column:
        at = F.filter(pairs, lambda x, i: F.get(pairs, i - 1)["h"].eqNullSafe(x["h"]) | F.get(pairs, i + 1)["h"].eqNullSafe(x["h"]))
        return let(
            F.sort_array(F.transform(at, lambda x: x["at"])),
            lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x),
        )

    return let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), spans)


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words=tuple(STOP_WORDS), min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """docs with the columns of the measures, base_failed, failed_rules and kept.

    Narrow projections only, no shuffle and no user function: the scan's rows never move. A null or empty text has
    zero in every measure, fails the base rule and is not kept. Equal rows give equal results. A column of docs with
    the name of a measure is replaced; other names don't matter. An empty table gives no rows; a very long text is
    measured whole. Windows of three words are compared by a 64-bit hash within one document.
    """
    measures = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "failed_rules", "kept")
    others = [c for c in docs.columns if c not in measures]
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    any_case = [*stop_words, *(w.capitalize() for w in stop_words)]
    count = lambda c: F.size(c).cast("long")
    # A column that is used more than once stays a projection of its own, computed once.
    out = docs.select(F.struct(*(F.col(c) for c in others)).alias("_row"), F.col(text).alias("_text"))
    out = out.withColumns({"_ws": words(F.col("_text")), "_ls": lines})
    shifted = F.arrays_zip(F.col("_ws"), F.slice("_ws", 2, F.size("_ws")), F.slice("_ws", 3, F.size("_ws")))
    out = out.withColumns(
        {
            "n_words": count(F.col("_ws")),
            "word_chars": F.length(F.concat_ws("", "_ws")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_lines": count(F.col("_ls")),
            "n_dup_lines": count(F.col("_ls")) - count(F.array_distinct("_ls")),
            "n_stop_words": count(F.filter("_ws", lambda w: w.isin(*any_case))),
            "_grams": F.slice(F.transform(shifted, lambda z: F.xxhash64(z)), 1, F.greatest(F.size("_ws") - 2, F.lit(0))),
        }
    ).drop("_ws", "_ls")
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    out = out.withColumn("n_repeat_words", F.when(twice, _covered(F.col("_grams"))).otherwise(0).cast("long")).drop("_grams")
    broken = []
    for r in rules:
        low = F.lit(r.low is not None) & (1000 * F.col(r.part) < (r.low or 0) * F.col(r.whole))
        high = F.lit(r.high is not None) & (1000 * F.col(r.part) > (r.high or 0) * F.col(r.whole))
        broken.append(F.when(low | high, F.lit(r.name)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("failed_rules", F.array_compact(F.array(*broken)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in others), *measures)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def oracle_sql() -> str:
    stop = ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x.capitalize()))
    parts = " AND ".join(
        x for r in RULES for x in ([f"1000 * {r.part} >= {r.low} * {r.whole}"] if r.low is not None else []) + ([f"1000 * {r.part} <= {r.high} * {r.whole}"] if r.high is not None else [])
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM d)),
r AS (SELECT rid, count(DISTINCT j) AS n_repeat_words
    FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines,
    len(list_filter(ws, lambda w: w IN ({stop}))) AS n_stop_words
    FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {parts}) AS kept FROM b"""
