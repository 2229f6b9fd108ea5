"""Conversation structure repair: cheapest edits, found once per shared prefix.

A conversation is described by a signature, a symbol per row: ``d`` for a row
that must go (blank or a duplicate), otherwise the class of its role (``s``
system, ``u`` user, ``a`` assistant, ``x`` any other), in capitals if its text
is truncated.  The repaired roles' initials must match ``(s?(ua)+)?``.

Which edits are cheapest depends on the signature alone, so the different
signatures are sorted over ranges and read as a prefix trie, of which a task
holds one branch: a signature shares the layers of the dynamic programme with
the one before it as far as their prefixes agree, computes the others, and
answers at its end.  Answers go back to the conversations by signature: of
frequent ones (at most four a partition) by broadcast, of the others by a join.

A layer holds for each state of the roles' automaton (nothing yet, after s,
after u, after a) the cost of the cheapest edits that lead there, the rank of
their ASCII-least initials among the states, and the step that they ended with.
Two such strings end with edits of the same row, so neither begins the other
and ranks stay right when edits are added; answers are read back along the
steps, and nothing longer is kept.

Edits: keep (K, 0), rerole to the user or assistant that is due (R, 3), delete
(D, 4), insert an empty user or assistant row (I, 3); a truncated row that
stays costs 3 more.  Ties go to the ASCII-least string of initials.

Defined cases: rows are taken by turn (null first), then role and text; a null
role or text is one space; rows without conv_id are one conversation; a row's
first fault counts, in the order blank, duplicate, truncated; an empty table
gives no row; other columns are ignored, whatever their names.  A conversation
is a unit that one row holds.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.llm._spark import saved, shuffle_partitions, small_batches

ROWS = "array<struct<role:string,text:string>>"
_KINDS = {"s": "s", "u": "u", "a": "a"}
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
# the automaton: what each state reads, and the row due in it
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_DUE = {0: "u", 1: "u", 2: "a", 3: "u"}
_NAMES = {"u": "user", "a": "assistant"}
_DONE = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with seeded faults: by crc32(conv_id:turn) % 20 a row is dropped (0), emptied (1),
    stripped of ``[.!?]`` (2), repeated (3) or given to the user (4); nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))).drop("col")


def diagnosed(rows: list[tuple[str, str]]) -> tuple[str, int, int, int, int]:
    """Signature, blank, duplicate, truncated and illegal of a conversation's (role, text) rows in order."""
    seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for row in rows:
        role, text = row
        last = _LAST.search(text)
        kind = _KINDS.get(role[:1], "x")
        if last is None:
            fault = "blank"
        elif row in seen:
            fault = "duplicate"
        else:
            fault = None if last[1] in ".!?" else "truncated"
        seen.add(row)
        if fault:
            faults[fault] += 1
        symbols.append("d" if fault in ("blank", "duplicate") else kind.upper() if fault else kind)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return "".join(symbols), faults["blank"], faults["duplicate"], faults["truncated"], illegal


ROOT = {0: (0, 0, None, "")}  # state: cost, rank, state before, edits since


def layer(before: dict, symbol: str) -> dict:
    """The layer behind one more row."""
    best: dict[int, tuple] = {}

    def offer(state: int, cost: int, rank: int, source: int, edits: str) -> None:
        if state not in best or (cost, rank, edits) < (best[state][0], best[state][1], best[state][3]):
            best[state] = (cost, rank, source, edits)

    late = TRUNCATED if symbol.isupper() else 0
    for source, (cost, rank, _, _) in before.items():
        state, edits = source, ""
        for _ in range(3):  # a third insertion would lead back to a state at hand
            offer(state, cost + DELETE, rank, source, edits + "D")
            if symbol != "d":
                if symbol.lower() in _NEXT[state]:
                    offer(_NEXT[state][symbol.lower()], cost + KEEP + late, rank, source, edits + "K")
                offer(_NEXT[state][_DUE[state]], cost + REROLE + late, rank, source, edits + "R")
            state, edits, cost = _NEXT[state][_DUE[state]], edits + "I", cost + INSERT
    order = sorted(best, key=lambda s: (best[s][1], best[s][3]))
    return {s: (best[s][0], order.index(s), best[s][2], best[s][3]) for s in order}


def answer(layers: list[dict]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits at the end of a branch of layers."""
    ends = []
    for state, (cost, rank, _, _) in layers[-1].items():
        at = state
        for k in range(3):
            if at in _DONE:
                ends.append((cost + k * INSERT, rank, "I" * k, state))
            at = _NEXT[at][_DUE[at]]
    cost, _, edits, state = min(ends)
    parts = [edits]
    for rows in reversed(layers[1:]):
        _, _, source, edits = rows[state]
        parts.append(edits)
        state = source
    return cost, "".join(reversed(parts))


def solved(signatures):
    """(signature, cost, audit) of each of the sorted signatures; layers of a shared prefix are computed once."""
    branch, path = [ROOT], ""
    for signature in signatures:
        shared = 0
        while shared < min(len(path), len(signature)) and path[shared] == signature[shared]:
            shared += 1
        del branch[shared + 1 :]
        for symbol in signature[shared:]:
            branch.append(layer(branch[-1], symbol))
        path = signature
        yield signature, *answer(branch)


def edited(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The rows after the edits of an audit."""
    out, state, left = [], 0, iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(left)
        if edit == "D":
            continue
        due = role[:1] if edit == "K" else _DUE[state]
        out.append((role if edit == "K" else _NAMES[due], text))
        state = _NEXT[state][due]
    return out


def _read(batches):
    for b in batches:
        found = [diagnosed([(r["role"], r["text"]) for r in rows]) for rows in b.column("rows").to_pylist()]
        columns = list(zip(*found, strict=True)) or [()] * 5
        more = [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]]
        yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "signature", "blank", "duplicate", "truncated", "illegal"])


def _solve(batches):
    found = solved(x for b in batches for x in b.column("signature").to_pylist())
    while rows := list(islice(found, 1000)):
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], ["signature", "cost", "audit"])


def _edit(batches):
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for b in batches:
        rows = [edited([(r["role"], r["text"]) for r in rows], audit) for rows, audit in zip(b.column("rows").to_pylist(), b.column("audit").to_pylist(), strict=True)]
        at = b.schema.get_field_index("rows")
        yield b.set_column(at, "rows", pa.array([[{"role": r, "text": t} for r, t in x] for x in rows], kind))


def signatures(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, rows, signature, blank, duplicate, truncated and illegal of each conversation of ``turns``."""
    spark = turns.sparkSession
    small_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    row = F.struct(F.col("turn"), space("role").alias("role"), space("text").alias("text"))
    whole = turns.select("conv_id", F.col("turn"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    numbers = F.filter(F.transform("rows", lambda r: r["turn"]), lambda x: x.isNotNull())
    gaps = F.when(F.size(numbers) == 0, 0).otherwise(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)))
    plain = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    whole = whole.select("conv_id", gaps.cast("long").alias("gaps"), plain.alias("rows"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(_read, f"conv_id {kind}, gaps long, rows {ROWS}, signature string, blank long, duplicate long, truncated long, illegal long")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired rows (role, text) of each conversation of
    ``turns(conv_id, turn, role, text)``."""
    spark = turns.sparkSession
    whole = saved(signatures(turns))
    counts = whole.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    answers = saved(counts.repartitionByRange("signature").sortWithinPartitions("signature").select("signature").mapInArrow(_solve, "signature string, cost long, audit string"))
    most = max(1, whole.count() // (4 * shuffle_partitions(spark)))
    often = saved(counts.where(F.col("n") > most).join(answers, "signature").drop("n"))
    hot = whole.join(F.broadcast(often), "signature")
    cold = whole.join(F.broadcast(often.select("signature")), "signature", "left_anti").join(answers, "signature")
    both = hot.unionByName(cold).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "rows")
    return both.mapInArrow(_edit, both.schema)


def written(rows: Column) -> Column:
    """The rows as ``role:text`` lines."""
    return F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
