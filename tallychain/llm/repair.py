"""Repair of conversations' structure: the cheapest edits by a dynamic program over turns, many conversations at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallychain.llm.common import SALTS, bounded_batches, salted, staged

#: White space and ends of sentences, as in the damage's and the faults' rules.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Turn numbers of one span of a conversation; spans are solved apart and put together.
SPAN = 4096
#: What a row may be, by its role's initial (s, u, a or another) and its fault (none, to be deleted, truncated): the letters of a span's `kinds`.
KINDS = "abcdefghijkl"
#: States: nothing yet, after a system, a user, an assistant turn. Edits in order of their letters: delete, insert, keep, rerole.
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE, NONE = range(5)
FAR = 1 << 40
#: The state after one more user or assistant turn, and what ending in a state costs: the turns to insert.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ENDING = np.array([0, 6, 3, 0], np.int64)


def _rules() -> tuple[np.ndarray, np.ndarray]:
    """(cost, state after) of each edit that takes a row, [kind, state, edit]; the last kind is no row."""
    cost, after = np.full((len(KINDS) + 1, 4, 5), FAR, np.int64), np.zeros((len(KINDS) + 1, 4, 5), np.int64)
    follows = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
    for kind in range(len(KINDS)):
        role, fault = divmod(kind, 3)
        for state in range(4):
            cost[kind, state, DELETE], after[kind, state, DELETE] = 4, state
            if fault != 1:
                extra = 3 if fault == 2 else 0
                cost[kind, state, REROLE], after[kind, state, REROLE] = 3 + extra, NEXT[state]
                if state in follows[role]:
                    cost[kind, state, KEEP], after[kind, state, KEEP] = extra, follows[role][state]
    for state in range(4):
        cost[-1, state, NONE], after[-1, state, NONE] = 0, state
    return cost, after


COST, AFTER = _rules()
#: Whether a role may follow another, by the initials s, u, a, another, and no row.
LEGAL = np.zeros((5, 5), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True


def costs(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """kinds[turn, conversation], ends[conversation, state]: what ending in a state costs -> [turn, conversation, state]: the least cost from
    before each turn on, insertions before it included."""
    out = np.empty((len(kinds) + 1, *ends.shape), np.int64)
    out[-1] = now = ends
    at = np.arange(ends.shape[0])[:, None, None]
    for t in range(len(kinds) - 1, -1, -1):
        now = (COST[kinds[t]] + now[at, AFTER[kinds[t]]]).min(axis=2)
        for _ in range(2):  # an inserted turn, and one before it
            now = np.minimum(now, np.where((kinds[t] < len(KINDS))[:, None], 3 + now[:, NEXT], FAR))
        out[t] = now
    return out


def trace(kinds: np.ndarray, cost: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits of the least cost, of these the first in order of their letters: (letters[conversation, turn, 3], states after all). Of the letters the
    first two are inserted turns (u, a), the third is the row's edit: D, K, or U and A for a new role; 0 is none."""
    n = kinds.shape[1]
    letters, state, each = np.zeros((n, len(kinds), 3), np.uint8), start.copy(), np.arange(n)
    for t in range(len(kinds)):
        k, after = kinds[t], cost[t + 1]
        for slot in range(2):
            best, follow = cost[t][each, state], NEXT[state]
            insert = (4 + after[each, state] != best) & (3 + cost[t][each, follow] == best) & (k < len(KINDS))
            letters[insert, t, slot] = np.where(follow[insert] == USER, ord("u"), ord("a"))
            state = np.where(insert, follow, state)
        best = cost[t][each, state]
        sums = COST[k, state] + after[each[:, None], AFTER[k, state]]
        sums[:, INSERT] = FAR
        edit = np.argmax(sums == best[:, None], axis=1)
        role = np.where(NEXT[state] == USER, ord("U"), ord("A"))
        letters[:, t, 2] = np.select([edit == DELETE, edit == KEEP, edit == REROLE], [ord("D"), ord("K"), role], 0)
        state = AFTER[k, state, edit]
    return letters, state


def _buckets(kinds: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, kinds[turn, place]) of the texts of kinds, those of lengths up to the same power of two together, shorter ones filled up with no row."""
    lengths = kinds.str.len().to_numpy()
    of = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for bucket in np.unique(of):
        places = np.flatnonzero(of == bucket)
        out = np.full((int(lengths[places].max()), len(places)), len(KINDS))
        for n, p in enumerate(places):
            out[: lengths[p], n] = np.frombuffer(kinds.iloc[p].encode(), np.uint8) - ord(KINDS[0])
        yield places, out


def _between(kinds: pd.Series) -> pd.Series:
    """A span's least costs from each state before it to each state after it, 16 numbers."""
    out = np.empty((len(kinds), 4, 4), np.int64)
    for places, k in _buckets(kinds):
        for last in range(4):
            ends = np.full((len(places), 4), FAR)
            ends[:, last] = 0
            out[places, :, last] = costs(k, ends)[0]
    return pd.Series(list(out.reshape(-1, 16)))


def _ends(ends: pd.Series) -> np.ndarray:
    return np.array([ENDING if e is None else e for e in ends], np.int64).reshape(-1, 4)


def _through(kinds: pd.Series, ends: pd.Series) -> pd.Series:
    """The state after a span for each state before it, on the way that is cheapest to the end."""
    out, all_ends = np.empty((len(kinds), 4), np.int32), _ends(ends)
    for places, k in _buckets(kinds):
        cost = costs(k, all_ends[places])
        for first in range(4):
            out[places, first] = trace(k, cost, np.full(len(places), first))[1]
    return pd.Series(list(out))


def _solved(kinds: pd.Series, ends: pd.Series, start: pd.Series) -> pd.DataFrame:
    """Each row's letters (see trace), the least cost from the span's start to the conversation's end, the state after it, and how many neighbours
    are in no legal order."""
    out, all_ends, starts = [None] * len(kinds), _ends(ends), start.fillna(START).to_numpy(np.int64)
    for places, k in _buckets(kinds):
        cost = costs(k, all_ends[places])
        letters, state = trace(k, cost, starts[places])
        wrong = ~LEGAL[k[:-1] // 3, k[1:] // 3] & (k[1:] < len(KINDS))
        for n, p in enumerate(places):
            own = letters[n, : len(kinds.iloc[p])].reshape(-1).view("S3")
            out[p] = ([x.replace(b"\0", b"").decode() for x in own.tolist()], int(cost[0][n, starts[p]]), int(state[n]), int(wrong[:, n].sum()))
    return pd.DataFrame(out, columns=["steps", "cost", "state", "illegal"])


def _backwards(found: pd.Series) -> pd.Series:
    """Of a conversation's spans in order: what ending in each state costs after each, and whether its first row and the one before are in no legal order."""

    def one(parts: list) -> list[dict]:
        ends, out = ENDING, []
        for p in reversed(parts):
            out.append(ends)
            ends = (np.array(p["between"], np.int64).reshape(4, 4) + ends).min(axis=1)
        role = lambda kind: KINDS.index(kind) // 3
        joints = [0, *(int(not LEGAL[role(x["final"]), role(y["first"])]) for x, y in zip(parts, parts[1:]))]
        return [{"ends": e.tolist(), "joint": j} for e, j in zip(reversed(out), joints)]

    return pd.Series([one(list(x)) for x in found])


def _forwards(found: pd.Series) -> pd.Series:
    """The state that each of a conversation's spans in order starts in."""

    def one(parts: list) -> list[int]:
        out = [START]
        for p in parts[:-1]:
            out.append(int(p["through"][out[-1]]))
        return out

    return pd.Series([one(list(x)) for x in found])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ordered(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> (..., span, nth, fault, kind), written: rows in order of turn, nulls first, then role and text; nth counts within
    a span of turn numbers. A row's fault is the first that holds of blank, duplicate and truncated.

    The first of equal texts of one role is known by its turn; rows of one turn are neighbours. Texts that repeat look their first up in
    salted parts, so that a conversation of many equal rows is dealt over tasks.
    """
    span = F.coalesce(F.floor(F.col("turn") / F.lit(SPAN)).cast("long"), F.lit(-(1 << 62)).cast("long"))
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), span.alias("span"))
    own = own.withColumn("said", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = own.groupBy("conv_id", "said").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = salted(firsts.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"))
    place = F.pmod(F.xxhash64("turn", "text"), F.lit(SALTS)).cast("int")
    met = own.withColumn("part", place).join(firsts, _same(F.col("conv_id"), F.col("c")) & (F.col("said") == F.col("s")) & (F.col("part") == F.col("__salt")), "left")
    met = met.withColumn("again", F.coalesce(order > F.col("first"), F.lit(False)))
    within = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    met = met.withColumns({"nth": F.row_number().over(within), "beside": (F.lag("said").over(within) == F.col("said")) & _same(F.lag("turn").over(within), F.col("turn"))})
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "blank").when(F.col("again") | F.coalesce("beside", F.lit(False)), "duplicate").when(F.instr(F.lit(ENDS), F.substring(bare, -1, 1)) == 0, "truncated")
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    role = F.when((initial == 0) | (F.col("role") == ""), 3).otherwise(initial - 1)
    met = met.withColumn("fault", fault)
    kind = 3 * role + F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    return staged(met.select("conv_id", "turn", "role", "text", "span", "nth", "fault", F.substring(F.lit(KINDS), kind + 1, F.lit(1)).alias("kind")), "turns")


def spans(turns: DataFrame) -> DataFrame:
    """turns of ordered() -> (conv_id, span, steps, cost, illegal, audit), written: for each span of a conversation the letters of its rows, those of turns
    to insert at the end with the last; audit has the edits' initials. cost is null but for the first span, where it is the conversation's.

    A conversation in one span, as nearly all are, is solved as it is. The spans of a longer one are solved apart between all pairs of
    states, few numbers each; of these come the cost of ending after each span, and then the state that each starts in.
    """
    between_, through = F.pandas_udf(_between, "array<long>"), F.pandas_udf(_through, "array<int>")
    backwards_, forwards = F.pandas_udf(_backwards, "array<struct<ends: array<long>, joint: int>>"), F.pandas_udf(_forwards, "array<int>")
    solve = F.pandas_udf(_solved, "steps array<string>, cost long, state int, illegal long")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "kind"))), lambda x: x["kind"]), "")
    every = staged(turns.groupBy("conv_id", "span").agg(letters.alias("kinds")), "kinds")
    several = every.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    long = staged(every.join(several, _same(F.col("conv_id"), F.col("c")), "left_semi"), "long")

    def gathered(rows: DataFrame, *fields) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", *fields))).alias("found"))

    def dealt(rows: DataFrame, made: Column, name: str) -> DataFrame:
        zipped = rows.withColumn("made", made).select("conv_id", F.inline(F.zip_with("found", "made", lambda x, y: F.struct(x["span"].alias("span"), y.alias(name)))))
        return zipped.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), name)

    on = _same(F.col("conv_id"), F.col("c")) & (F.col("span") == F.col("s"))
    between = gathered(long.select("conv_id", "span", "kinds", between_("kinds").alias("between")), F.col("between"), F.substring("kinds", 1, 1).alias("first"), F.substring("kinds", -1, 1).alias("final"))
    backwards = dealt(between, backwards_("found"), "back")
    known = staged(long.join(backwards, on).select("conv_id", "span", "kinds", "back"), "backwards")
    starts = dealt(gathered(known.withColumn("through", through("kinds", F.col("back.ends"))), F.col("through")), forwards("found"), "start")
    known = known.join(starts, on).select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "back", "start", F.col("span").isNotNull().alias("long"))
    last = gathered(long).select(F.col("conv_id").alias("c2"), F.array_min("found")["span"].alias("lo"), F.array_max("found")["span"].alias("hi"))
    known = known.join(last, _same(F.col("c"), F.col("c2"))).withColumns({"is_first": F.col("s") == F.col("lo"), "is_last": F.col("s") == F.col("hi")})
    rows = every.join(known.drop("c2", "lo", "hi"), on, "left").withColumn("r", solve("kinds", F.col("back.ends"), F.coalesce("start", F.lit(START))))
    tail = F.when(F.coalesce("is_last", F.lit(True)), F.element_at(F.array(F.lit(""), F.lit("ua"), F.lit("a"), F.lit("")), F.col("r.state") + 1)).otherwise("")
    rows = rows.withColumn("steps", F.transform("r.steps", lambda x, i: F.when(i == F.size("r.steps") - 1, F.concat(x, tail)).otherwise(x)))
    audit_ = F.translate(F.array_join("steps", ""), "uaUA", "IIRR")
    cost = F.when(F.coalesce("is_first", F.lit(True)), F.col("r.cost"))
    return staged(rows.select("conv_id", "span", "steps", cost.alias("cost"), (F.col("r.illegal") + F.coalesce("back.joint", F.lit(0))).alias("illegal"), audit_.alias("audit")), "spans")


def edits(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, span, nth, slot, turn, fault, edit, role, text): the repair itself, a row for each edit in order of span, nth and slot. edit is D, I, K
    or R; role and text are those after it, null for a deleted row. An inserted turn has an empty text and no turn number."""
    s = solved.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "steps")
    rows = turns.join(s, _same(F.col("conv_id"), F.col("c")) & (F.col("span") == F.col("s"))).withColumn("step", F.get("steps", F.col("nth") - 1))
    each = rows.select("conv_id", "span", "nth", "turn", "fault", "role", "text", F.posexplode(F.split("step", "")).alias("slot", "letter"))
    inserted, lower = F.col("letter").isin("u", "a"), F.lower("letter")
    role = F.when(lower == "u", "user").when(lower == "a", "assistant").when(F.col("letter") == "K", F.col("role"))
    return each.select(
        "conv_id", "span", "nth", "slot", F.when(~inserted, F.col("turn")).alias("turn"), F.when(~inserted, F.col("fault")).alias("fault"),
        F.translate("letter", "uaUA", "IIRR").alias("edit"), role.alias("role"), F.when(inserted, "").when(F.col("letter") != "D", F.col("text")).alias("text"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> the edits that repair every conversation at the least cost, see edits(). Null roles and texts are one space, rows of
    a null conv_id are one conversation, null turns come first; ties of turn go by role, then text. Further columns are not read. An empty
    table gives an empty table."""
    turns = ordered(rows)
    return edits(turns, spans(turns))


def hashed(rows: DataFrame) -> DataFrame:
    """edits -> (conv_id, repaired_sha256) of what is left, as role:text joined by newlines. A task streams its conversations in order and holds one
    running hash; SHA-256 has no other order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    lines = rows.where("role is not null").select("conv_id", "span", "nth", "slot", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "span", "nth", "slot").select("conv_id", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, digest, found = None, None, []
        of_type = None
        for batch in batches:
            of_type = batch.schema.field(0).type
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or own != owner:
                    if digest is not None:
                        found.append((owner, digest.hexdigest()))
                    owner, digest = own, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], of_type), pa.array([f[1] for f in found])], ["conv_id", "repaired_sha256"])
                found = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([owner], of_type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text), nulls of text and role as one space, damaged by the CRC-32 of `conv_id:turn`, modulo 20: dropped, emptied,
    without ends of sentences, repeated, or given the role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    own = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), by.alias("by")).where("by <> 0")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("by") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired(original: DataFrame) -> DataFrame:
    """One row for each conv_id of original(conv_id, turn, role, text), with the faults, the cheapest edits and the repaired text's hash of its damaged rows.
    A conversation that has no rows left has zeros, no edits and the hash of the empty text."""
    bounded_batches(original.sparkSession, 2000)
    turns = ordered(damaged(original))
    solved = spans(turns)
    n = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = turns.groupBy("conv_id").agg(gaps, n("blank"), n("duplicate"), n("truncated"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "audit"))), lambda x: x["audit"]), "")
    told = solved.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), joined.alias("audit"))
    out = original.select("conv_id").distinct().alias("o")
    for name, other in (("n", counts), ("t", told), ("h", hashed(edits(turns, solved)))):
        out = out.join(other.alias(name), F.col("o.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("o.conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
