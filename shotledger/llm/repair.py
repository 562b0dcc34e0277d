"""Repair of conversations: generalised LR parsing of their roles with weighted edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotledger.llm.common import tidy
from shotledger.operators import lineage

#: LR states of the role grammar  S -> s P | P | nothing,  P -> P E | E,  E -> u a.
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 4, (3, "u"): 4, (4, "a"): 5}
REDUCE = {5: ("E", 2), 6: ("P", 1), 7: ("P", 2)}
GOTO = {(0, "E"): 6, (1, "E"): 6, (2, "E"): 7, (3, "E"): 7, (0, "P"): 2, (1, "P"): 3}
ACCEPT = (0, 2, 3)
#: The stacks that may stand between two rows. The grammar recurs on the left, so that these are all.
STACKS = ((0,), (0, 1), (0, 2), (0, 1, 3), (0, 4), (0, 1, 4), (0, 2, 4), (0, 1, 3, 4))
RENAME, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
#: Rows of a conversation that are parsed in one go; what a run makes of each stack is joined with the next run's.
RUN = 512
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
WORDLY, FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def pushed(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after a role's initial and all reductions that it allows; None if the grammar has none such here."""
    state = SHIFT.get((stack[-1], symbol))
    if state is None:
        return None
    stack += (state,)
    while stack[-1] in REDUCE:
        name, size = REDUCE[stack[-1]]
        stack = stack[:-size]
        stack += (GOTO[stack[-1], name],)
    return stack


#: What follows each stack under each initial.
PUSHED = {(stack, x): after for stack in STACKS for x in INITIALS if (after := pushed(stack, x))}


def _better(tops: dict, stack: tuple[int, ...], cost: int, audit: str) -> bool:
    """Equal stacks are one: the least (cost, audit) stays. Two audits of one cost are never each other's beginning, so that what follows changes no choice."""
    if stack in tops and tops[stack] <= (cost, audit):
        return False
    tops[stack] = (cost, audit)
    return True


def _inserted(tops: dict) -> dict:
    """tops with all that insertions reach."""
    todo = list(tops)
    while todo:
        stack = todo.pop()
        cost, audit = tops[stack]
        for x in NAMES:
            after = PUSHED.get((stack, x))
            if after and _better(tops, after, cost + INSERT, audit + "I"):
                todo.append(after)
    return tops


def parsed(codes: str, start: int = 0) -> dict[tuple[int, ...], tuple[int, str]]:
    """The stacks that rows lead to from one of STACKS, each with the least (cost, audit). codes: two characters a row, initial and fault (see coded())."""
    tops = _inserted({STACKS[start]: (0, "")})
    for at in range(0, len(codes), 2):
        initial, fault = codes[at], codes[at + 1]
        after: dict = {}
        late = UNFINISHED if fault == "3" else 0
        for stack, (cost, audit) in tops.items():
            _better(after, stack, cost + DELETE, audit + "D")
            if fault in "03":
                if (stack, initial) in PUSHED:
                    _better(after, PUSHED[stack, initial], cost + late, audit + "K")
                for x in NAMES:
                    if (stack, x) in PUSHED:
                        _better(after, PUSHED[stack, x], cost + RENAME + late, audit + "R")
        tops = _inserted(after)
    return tops


def replayed(codes: str, audit: str, start: int) -> tuple[list[str], int]:
    """For each row what stands in its place: K for itself, u or a for its text under that role, U or A for an empty text; and the last stack."""
    stack, out, at = STACKS[start], [""], -2
    for edit in audit:
        if edit != "I":
            at += 2
            if at:
                out.append("")
        symbol = codes[at] if edit == "K" else next((x for x in NAMES if (stack, x) in PUSHED), "")
        if edit != "D":
            stack = PUSHED[stack, symbol]
            out[-1] += {"K": "K", "R": symbol, "I": symbol.upper()}[edit]
    return out, STACKS.index(stack)


_MOVES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_RUNS = T.ArrayType(T.StructType([T.StructField("run", T.LongType()), T.StructField("codes", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("audit", T.StringType())]))
_FOLD = T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("runs", _RUNS)])


@F.pandas_udf(_MOVES)
def _moves(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """From each stack that a run of rows may begin with to each that it may end with, the least (cost, audit). The first run begins with nothing."""
    known: dict = {}
    for codes, run in batches:
        out = []
        for c, first in zip(codes, run == 0, strict=True):
            if (c, first) not in known:
                if len(known) > 10_000:
                    known.clear()
                known[c, first] = [{"start": s, "end": STACKS.index(stack), "cost": cost, "audit": audit} for s in range(1 if first else len(STACKS)) for stack, (cost, audit) in parsed(c, s).items()]
            out.append(known[c, first])
        yield pd.Series(out)


def folded(runs: list) -> dict:
    """The cheapest way through all runs of a conversation, in order, and which part of it falls to each run."""
    tops, back = {0: (0, "")}, []
    for r in runs:
        after, came = {}, {}
        for m in r["moves"]:
            if m["start"] in tops:
                cost, audit = tops[m["start"]]
                if _better(after, m["end"], cost + m["cost"], audit + m["audit"]):
                    came[m["end"]] = (m["start"], m["audit"])
        tops = after
        back.append(came)
    end = min((x for x in tops if STACKS[x][-1] in ACCEPT), key=lambda x: tops[x])
    cost, audit = tops[end]
    out = []
    for r, came in zip(reversed(runs), reversed(back), strict=True):
        start, part = came[end]
        out.append({"run": r["run"], "codes": r["codes"], "start": start, "audit": part})
        end = start
    return {"cost": cost, "audit": audit, "runs": out[::-1]}


@F.pandas_udf(_FOLD)
def _folds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for lists in batches:
        yield pd.DataFrame([folded(list(runs)) for runs in lists], columns=["cost", "audit", "runs"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _places(codes: pd.Series, audits: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([replayed(c, a, s)[0] for c, a, s in zip(codes, audits, starts, strict=True)])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """rows as conv, turn, role, text with planted faults: by a digest of conversation and turn a row goes, loses its text or its stops, stands twice, or is the user's. A null role or text is one blank."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv), F.lit(":"), part(turn))) % 20
    said = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    known = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), part(role).alias("_role"), part(text).alias("_text"), kind.alias("_kind")).filter("_kind <> 0")
    out = known.select("conv", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"), said.alias("text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_twice"))
    return out.drop("_twice")


def coded(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with key (conv, null or not), n (from 0 by turn, nulls first, then role and text), initial and fault (a place of FAULTS).

    A repeated row's place is known by counting, not by gathering a conversation.
    """
    whole = rows.select(F.struct("conv").alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = lineage.cut(lineage.numbered(whole, ["key"], ["turn", "role", "text"], "n"))
    first = placed.groupBy("key", "role", F.sha2("text", 256).alias("_d")).agg(F.min("n").alias("n")).select("key", "n", F.lit(True).alias("_first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(~F.col("text").rlike(WORDLY), 1).when(F.col("_first").isNull(), 2).when(~F.col("text").rlike(FINISHED), 3).otherwise(0)
    return placed.join(first, ["key", "n"], "left").select("key", "n", "turn", "role", "text", F.when(initial.isin(*INITIALS), initial).otherwise("x").alias("initial"), fault.alias("fault"))


def paths(rows: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each conversation of coded() rows: key, cost, audit, runs, and the counts blank, duplicate, truncated and illegal.

    Rows are parsed in runs of `run`, from every stack that they may begin with; only runs' results meet. What grows
    with a conversation is its audit alone.
    """
    one = F.struct("n", F.concat("initial", F.col("fault").cast("string")).alias("c"))
    faults = [F.count_if(F.col("fault") == i).alias(name) for i, name in enumerate(FAULTS) if i]
    runs = rows.groupBy("key", F.floor(F.col("n") / run).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]), "").alias("codes"), *faults)
    pairs = F.transform(F.sequence(F.lit(1), F.length("codes"), F.lit(2)), lambda i: F.concat(F.substring("codes", i, F.lit(1)), F.substring("codes", i + 2, F.lit(1))))
    wrong = lambda p: ~p.isin("su", "ua", "au") & (F.length(p) == 2)
    runs = runs.withColumn("illegal", F.size(F.filter(pairs, wrong)).cast("long")).withColumn("moves", _moves("codes", "run"))
    line = F.array_sort(F.collect_list(F.struct("run", "codes", "moves")))
    each = runs.groupBy("key").agg(line.alias("line"), *(F.sum(c).alias(c) for c in (*FAULTS[1:], "illegal")))
    # Where one run ends and the next begins.
    ends = F.transform(F.sequence(F.lit(1), F.size("line")), lambda i: F.concat(F.substring(F.get(F.col("line.codes"), i - 1), -2, 1), F.substring(F.coalesce(F.get(F.col("line.codes"), i), F.lit("")), 1, 1)))
    each = each.withColumn("illegal", F.col("illegal") + F.size(F.filter(ends, wrong)))
    return each.select("key", *FAULTS[1:], "illegal", _folds("line").alias("f")).select("key", *FAULTS[1:], "illegal", "f.*")


def repaired(rows: DataFrame, found: DataFrame, run: int = RUN) -> DataFrame:
    """The rows that repair leaves of coded() rows, by their paths(): key, n (of the row in whose place it stands), part (several may), role and text."""
    parts = found.select("key", F.explode("runs").alias("r")).select("key", F.col("r.run").alias("run"), _places("r.codes", "r.audit", "r.start").alias("p"))
    edits = parts.select("key", "run", F.posexplode("p").alias("i", "edits")).select("key", (F.col("run") * run + F.col("i")).alias("n"), "edits").filter("edits <> ''")
    both = rows.select("key", "n", "role", "text").join(edits, ["key", "n"])
    lines = both.select("key", "n", "role", "text", F.posexplode(F.split("edits", "(?<=.)(?=.)")).alias("part", "e"))
    given = F.lower("e")
    name = F.when(given == "u", NAMES["u"]).when(given == "a", NAMES["a"]).otherwise(F.col("role"))
    return lines.select("key", "n", "part", name.alias("role"), F.when(F.col("e").isin("U", "A"), "").otherwise(F.col("text")).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """key and sha256 (hex) of a conversation's lines "role:text" joined by newlines. A digest is taken of a stream of sorted lines: no conversation is held."""
    said = lines.select("key", "n", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = said.repartition("key").sortWithinPartitions("key", "n", "part").select("key", "line")
    schema = T.StructType([dealt.schema["key"], T.StructField("sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None
        for batch in batches:
            kind, keys, shas = batch.schema.field("key").type, [], []
            for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        keys.append(now)
                        shas.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(shas, pa.string())], ["key", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([digest.hexdigest()], pa.string())], ["key", "sha256"])

    return dealt.mapInArrow(tidy(hashed), schema)


def report(original: DataFrame, rows: DataFrame, conv: str = "conv_id", run: int = RUN) -> DataFrame:
    """A row for each conversation of original: its gaps, faults, cost and audit of repair, and the digest of what repair makes of its rows (conv, turn, role, text).

    Rows of a null conversation are one conversation; null turns come first and leave no gaps; a null role or text is one
    blank; rows of one turn stand by role and text; a repeated row is a duplicate; a conversation without rows has zeros,
    an empty audit and the digest of nothing. Long texts stream; an empty table gives no rows; other columns are not read.
    """
    marked = lineage.cut(coded(rows))
    found = lineage.cut(paths(marked, run))
    gaps = marked.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = original.select(F.struct(F.col(conv).alias("conv")).alias("key")).distinct()
    out = every.join(gaps, "key", "left").join(found.drop("runs"), "key", "left").join(digests(repaired(marked, found, run)), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("key.conv").alias(conv), *map(zero, ("gaps", *FAULTS[1:], "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The states of the SQL: 0 nothing yet, 1 after s, 2 after u, 3 after a. Each row's edits are followed by two insertions at the most: more lead back."""
    word = r"[^\x20\x09-\x0D]"
    return rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS h
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS twice
  FROM (SELECT *, xor(h, 4294967295) % 20 AS kind FROM c)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini FROM d),
f AS (SELECT * EXCLUDE again, CASE WHEN NOT regexp_matches(text, '{word}') THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault, coalesce(conv_id::VARCHAR, ' ') AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM n)),
s(q, x, r) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), more(q, r, x) AS (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (2, 2, 'II'), (3, 2, 'I'), (3, 3, 'II')),
e AS (SELECT q, x AS ini, 'K' AS edit, r, 0 AS cost FROM s UNION ALL SELECT s.q, i.ini, 'R', s.r, 1 FROM s, (SELECT DISTINCT ini FROM f) i WHERE s.x <> 's' UNION ALL SELECT q.q, i.ini, 'D', q.q, 2 FROM (SELECT DISTINCT q FROM more) q, (SELECT DISTINCT ini FROM f) i),
w(id, i, q, best) AS (SELECT id, 0::BIGINT, r, lpad((5 * len(x))::VARCHAR, 9, '0') || x FROM (SELECT DISTINCT id FROM f), more WHERE q = 0
  UNION ALL (SELECT w.id, f.i, more.r, min(lpad((w.best[:9]::BIGINT + e.cost + 5 * len(more.x) + CASE WHEN f.fault = 3 AND e.edit <> 'D' THEN 5 ELSE 0 END)::VARCHAR, 9, '0') || w.best[10:] || e.edit || more.x)
  FROM w JOIN f ON f.id = w.id AND f.i = w.i + 1 JOIN e ON e.q = w.q AND e.ini = f.ini AND (f.fault IN (0, 3) OR e.edit = 'D') JOIN more ON more.q = e.r GROUP BY w.id, f.i, more.r)),
z AS (SELECT w.id, min(best) AS best FROM w JOIN (SELECT id, max(i) AS i FROM f GROUP BY id) USING (id, i) WHERE q IN (0, 3) GROUP BY w.id),
a AS (SELECT id, best[10:] AS audit, unnest(range(1, len(best) - 8)) AS p FROM z),
o AS (SELECT a.id, a.p, x, sum((x <> 'I')::INT) OVER (PARTITION BY a.id ORDER BY a.p) AS i, sum((x <> 'D')::INT) OVER (PARTITION BY a.id ORDER BY a.p) AS j FROM (SELECT *, audit[p] AS x FROM a) a),
g AS (SELECT o.*, f.role, f.text, f.ini, bool_or(x = 'K' AND j = 1 AND f.ini = 's') OVER (PARTITION BY o.id) AS lead FROM o LEFT JOIN f ON f.id = o.id AND f.i = o.i AND o.x <> 'I' WHERE x <> 'D'),
t AS (SELECT id, string_agg(CASE WHEN x = 'K' THEN role WHEN (j - lead::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS lines FROM g GROUP BY id),
m AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated FROM f GROUP BY id),
b AS (SELECT id, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT id, rpad(ini, 1, ' ') || rpad(lead(ini) OVER (PARTITION BY id ORDER BY i), 1, ' ') AS pair FROM f) WHERE pair IS NOT NULL GROUP BY id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[:9]::BIGINT, 0) AS cost,
coalesce(best[10:], '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN m ON m.id = coalesce(k.conv_id::VARCHAR, ' ') LEFT JOIN b USING (id) LEFT JOIN z USING (id) LEFT JOIN t USING (id)"""


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
