"""Repair of the turn structure of conversations by iterative-deepening A*.

A conversation is legal when its role initials read `(s?(ua)+)?`. Rows may be
kept, given another role or deleted, and empty rows may be put in, each at a
cost. The search goes depth first through the edits in the order of their
initials D, I, K, R under a cost bound that rises to the least cost that went
beyond it, so the first accepting path is the cheapest one and, of those, the
first in ASCII order. States that failed are remembered with the least cost
that they still need, which also serves the later bounds.

A conversation is cut into segments of at most SEGMENT rows. A segment is
searched for every state it may begin and end with; the cheapest chain of
segments is the answer. No row is put in behind the last row of a segment other
than the last, so a path splits into segments in one way only, the parts of one
segment are prefix-free, and the least parts make the least whole.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgemeter.llm.ordering import positions
from edgemeter.llm.storage import staged, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = 64
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after `s`, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {"u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "s": {START: SYSTEM}}
TURNS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 30
#: A row's code: its role's initial, large where the row is truncated; `-` for a row that must go.
SPACE = r"[\x20\x09-\x0D]"


class _Search:
    """Cheapest edits of a segment to one set of end states."""

    def __init__(self, codes: str, goals: frozenset[int], closing: bool):
        self.codes, self.goals, self.closing = codes, goals, closing
        self.floor = [0] * (len(codes) + 1)
        for i in range(len(codes) - 1, -1, -1):
            least = DELETE if codes[i] == "-" else TRUNCATED if codes[i].isupper() else 0
            self.floor[i] = self.floor[i + 1] + least
        self.need: dict[tuple[int, int, int], int] = {}

    def edits(self, i: int, state: int, put: int):
        """(initial, cost, next place, next state, rows put in here) in ASCII order."""
        code = self.codes[i] if i < len(self.codes) else ""
        if code:
            yield "D", DELETE, i + 1, state, 0
        if put < 2 and (code or self.closing):  # a third row would lead back to a state seen here
            yield "I", INSERT, i, TURNS[state], put + 1
        if code and code != "-":
            extra = TRUNCATED if code.isupper() else 0
            kept = KEEPS.get(code.lower(), {}).get(state)
            if kept is not None:
                yield "K", extra, i + 1, kept, 0
            yield "R", RENAME + extra, i + 1, TURNS[state], 0

    def dive(self, i: int, state: int, put: int, budget: int) -> str | None:
        """The first accepting path within the budget; else what this place needs is noted."""
        if i == len(self.codes) and state in self.goals:
            return ""
        least = NEVER
        for initial, cost, *place in self.edits(i, state, put):
            place = tuple(place)
            more = cost + self.need.get(place, self.floor[place[0]])
            if more <= budget:
                rest = self.dive(*place, budget - cost)
                if rest is not None:
                    return initial + rest
                more = cost + self.need[place]
            least = min(least, more)
        self.need[(i, state, put)] = least
        return None

    def run(self, state: int) -> tuple[int, str] | None:
        """(cost, audit) of the cheapest path, least in ASCII order; None if there is none."""
        bound, place = self.floor[0], (0, state, 0)
        while bound < NEVER:
            found = self.dive(*place, bound)
            if found is not None:
                return bound, found
            bound = self.need[place]
        return None


@lru_cache(maxsize=4096)
def ways(codes: str, first: bool, last: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(begin, end, cost, audit) of a segment; the end is 0 for a whole conversation's."""
    ends = [frozenset({START, ASSISTANT})] if last else [frozenset({s}) for s in range(4)]
    out = []
    for goals in ends:
        search = _Search(codes, goals, last)
        for begin in (START,) if first else range(4):
            reachable = last or not (
                goals == {START} and begin != START
                or goals == {SYSTEM} and not (begin == SYSTEM or begin == START and "s" in codes.lower()))
            found = search.run(begin) if reachable else None
            if found is not None:
                out.append((begin, 0 if last else min(goals), *found))
    return tuple(out)


def _solved():
    """The ways through each segment."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    names = ("begin", "end", "cost", "audit")

    def run(batches):
        for batch in batches:
            found = [
                [dict(zip(names, way, strict=True)) for way in ways(codes, seg == 0, final)]
                for codes, seg, final in zip(
                    *(batch.column(c).to_pylist() for c in ("codes", "seg", "final")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("seg"), pa.array(found, kind)],
                names=["conv", "seg", "ways"])

    return run


def _chained():
    """The cheapest chain of segments: its cost and the audit of every segment."""
    kind = pa.list_(pa.struct([("seg", pa.int64()), ("begin", pa.int32()), ("audit", pa.string())]))

    def chain(segments):
        # From the end: of the ways that begin alike, no audit is a prefix of another, so
        # equal costs are settled by the segment's own audit.
        segments.sort(key=lambda x: x["seg"])
        rest, picks = {0: 0}, []
        for last, segment in enumerate(reversed(segments)):
            best: dict[int, tuple] = {}
            for way in segment["ways"]:
                after = rest.get(way["end"]) if last else 0
                if after is None:
                    continue
                here = (way["cost"] + after, way["audit"], way["end"])
                if way["begin"] not in best or here[:2] < best[way["begin"]][:2]:
                    best[way["begin"]] = here
            picks.append(best)
            rest = {begin: cost for begin, (cost, _, _) in best.items()}
        state, plan = START, []
        for segment, best in zip(segments, reversed(picks), strict=True):
            _, audit, end = best[state]
            plan.append({"seg": segment["seg"], "begin": state, "audit": audit})
            state = end
        return rest[START], plan

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                done = [chain(segments) for segments in part.column("segments").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv"), pa.array([c for c, _ in done], pa.int64()),
                     pa.array([p for _, p in done], kind)], names=["conv", "cost", "plan"])

    return run


def apply_edits(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """`role:text` of the rows that the edits leave; `state` is the one before them."""
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = KEEPS[role[0]][state]
        else:
            state = TURNS[state]
            role = "user" if state == USER else "assistant"
        out.append(f"{role}:{text}")
    return out


def _repaired():
    """Lines of each segment after its edits, joined by line feeds; null where none is left."""

    def run(batches):
        for batch in batches:
            out = []
            for rows, audit, begin in zip(
                *(batch.column(c) for c in ("rows", "audit", "begin")), strict=True
            ):
                kept = apply_edits([(r["role"], r["text"]) for r in rows.as_py()], audit.as_py(), begin.as_py())
                out.append("\n".join(kept) if kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("seg"), pa.array(out, pa.string())],
                names=["conv", "seg", "repaired"])

    return run


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults, chosen by crc32(`conv_id:turn`) modulo 20: 0 drops the
    row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 makes it the user's.
    A null is read as one space; a null conv_id or turn stays null in its own column."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    kind = F.col("_kind")
    return (
        rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("_kind"))
        .filter(kind != 0)
        .select(
            "conv_id", "turn",
            F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of every conversation.

    Rows stand by turn, nulls first, rows of one turn by role and text. The first
    fault of a row counts: blank (ASCII white space only), duplicate (role and text
    stood earlier), truncated (the last character other than white space is not one
    of `.!?`). `gaps` are the missing turns between the smallest and the largest,
    `illegal` the adjacent rows whose role initials are not su, ua or au. `audit`
    lists the cheapest edits; `repaired` has the lines `role:text` they leave,
    joined by line feeds. Null roles and texts count as one space. A null
    conversation id is a conversation.
    """
    conv = F.coalesce(F.concat(F.lit("1"), F.col(conv_col).cast("string")), F.lit("0"))
    given = rows.select(
        conv.alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    listed = positions(given, "conv", ["turn", "role", "text"], "turns")
    # The first row of each role and text; `at` names a row, so the join has no hot key.
    firsts = listed.groupBy("conv", "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("at"))
    firsts = firsts.select("at", F.lit(True).alias("is_first"))
    body = F.col("text")
    blank = ~body.rlike(r"[^\x20\x09-\x0D]")
    whole = body.rlike(r"[.!?]" + SPACE + r"*\z")
    fault = F.when(blank, "b").when(F.col("is_first").isNull(), "d").when(~whole, "t").otherwise("-")
    initial: Column = F.substring("role", 1, 1)
    known = F.when(initial.isin("u", "a", "s"), initial).otherwise("x")
    code = F.when(fault.isin("b", "d"), "-").when(fault == "t", F.upper(known)).otherwise(known)
    marked = staged(
        listed.join(firsts, "at", "left").select(
            "conv", "conv_id", "turn", "role", "text", "pos", "n",
            F.expr(f"pos div {SEGMENT}").alias("seg"), fault.alias("fault"), code.alias("code"),
            known.alias("initial")),
        "turn-faults",
    )
    in_order = F.sort_array(F.collect_list(F.struct("pos", "code", "initial")))
    text_of = lambda c: F.array_join(F.transform("listed", lambda x: x[c]), "")
    pairs = F.transform(F.sequence(F.lit(1), F.length("initials") - 1), lambda i: F.substring("initials", i, F.lit(2)))
    bad = F.when(F.length("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(0)
    segments = marked.groupBy("conv", "seg").agg(
        in_order.alias("listed"), F.max("n").alias("n"),
        *[F.count_if(F.col("fault") == short).alias(name)
          for short, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
    ).withColumns({"codes": text_of("code"), "initials": text_of("initial")}).select(
        "conv", "seg", "codes", "blank", "duplicate", "truncated", bad.cast("long").alias("illegal"),
        (F.col("seg") == F.expr(f"(n - 1) div {SEGMENT}")).alias("final"),
        F.substring("initials", 1, 1).alias("head"), F.expr("right(initials, 1)").alias("tail"),
    )
    segments = staged(segments, "segments")
    # Segments of a conversation are a SEGMENT-th of its rows; a window streams them.
    before = F.lag("tail").over(Window.partitionBy("conv").orderBy("seg"))
    edge = F.concat("before", "head")
    counts = (
        segments.withColumn("before", before)
        .groupBy("conv").agg(
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
            (F.sum("illegal") + F.count_if(F.col("before").isNotNull() & ~edge.isin(*LEGAL))).alias("illegal"))
    )
    plans = staged(
        segments.select("conv", "seg", "codes", "final")
        .mapInArrow(_solved(), "conv string, seg long, ways array<struct<begin: int, end: int, cost: long, audit: string>>")
        .groupBy("conv").agg(F.collect_list(F.struct("seg", "ways")).alias("segments"))
        .mapInArrow(_chained(), "conv string, cost long, plan array<struct<seg: long, begin: int, audit: string>>"),
        "plans",
    )
    steps = plans.select("conv", F.explode("plan").alias("step")).select("conv", "step.*")
    texts = marked.groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("rows"))
    repaired = (
        texts.join(steps, ["conv", "seg"]).select("conv", "seg", "rows", "audit", "begin")
        .mapInArrow(_repaired(), "conv string, seg long, repaired string")
        .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "repaired"))).alias("parts"))
        .select("conv", F.array_join(F.transform("parts", lambda x: x["repaired"]), "\n").alias("repaired"))
    )
    gaps = marked.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    audit = F.array_join(F.transform("plan", lambda x: x["audit"]), "").alias("audit")
    return (
        gaps.join(counts, "conv").join(plans.select("conv", "cost", audit), "conv").join(repaired, "conv")
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    )


def repair_all(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """`repair` of the damaged rows for every conversation of `rows`; one that has no row
    left gets zeros, an empty audit and an empty text."""
    name = unused(damaged, "original_id")
    ids = rows.select(F.col("conv_id").alias(name)).distinct()
    found = repair(damaged)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.col(name).eqNullSafe(F.col("conv_id")), "left").select(
        F.col(name).alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("audit", "repaired")],
    )
