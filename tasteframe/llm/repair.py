"""Conversation structure repair: generalised LR parsing of roles, with weighted edits.

The parser's tables come from the grammar (LR(0) item sets; a stack keeps both itself and what its reductions make of it).
A stack is a state on a lower stack, and equal stacks are one object, so all live stacks form a graph. Before each row
symbols may be inserted; the row is then deleted, kept or given another role. Stacks that become equal are merged into
the one of least (cost, audit).

Rows are sorted over the whole table by conversation and turn and dealt into ranges, so a conversation may lie in
several. A range summarises its part of a conversation for every stack that may stand at its begin: the cost of each
stack at its end, and the order of their audits. The few summaries of a conversation are folded, which fixes where each
part begins and ends; then each part is parsed once more and its edits applied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import discard, table, tidy, written

#: Conversations are nothing, or pairs of user and assistant after at most one system row.
ROLES = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("P",)), ("T", ("T", "P")), ("P", ("u", "a")))
NAMES = {"u": "user", "a": "assistant"}
BLANK = r"^[\x20\x09-\x0D]*$"
CUT = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"
PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


@dataclass(frozen=True, eq=False)
class Stack:
    """A state (LR(0) items) on a lower stack. Grammar.on() makes equal stacks one object."""

    state: frozenset
    symbol: str
    below: Stack | None
    number: int


class Grammar:
    """LR(0) tables of rules (left, right), the stacks they allow, and what edits do to them. The rules must bound the
    depth of stacks, as left recursion does."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...] = ROLES):
        self.rules, self.stacks, self.live, self._made = rules, [], [], {}
        self.bottom = self.on(None, "", self._closure(("", (rules[0][0],)), 0))
        self.moves, self.inserts = cache(self._moves), cache(self._inserts)

    def _closure(self, rule: tuple, dot: int) -> frozenset:
        items, todo = set(), [(rule, dot)]
        while todo:
            item = todo.pop()
            if item not in items:
                items.add(item)
                (_, right), at = item
                todo += [(r, 0) for r in self.rules if at < len(right) and r[0] == right[at]]
        return frozenset(items)

    def on(self, below: Stack | None, symbol: str, state: frozenset) -> Stack:
        name = (below and below.number, symbol)
        if name not in self._made:
            self._made[name] = Stack(state, symbol, below, len(self.stacks))
            self.stacks.append(self._made[name])
        return self._made[name]

    def _pushed(self, stack: Stack, symbol: str) -> list[Stack]:
        moved = [(rule, at + 1) for rule, at in sorted(stack.state) if at < len(rule[1]) and rule[1][at] == symbol]
        return [self.on(stack, symbol, frozenset().union(*(self._closure(*item) for item in moved)))] if moved else []

    def reduced(self, stacks: list[Stack]) -> list[Stack]:
        """The stacks and what their reductions make of them."""
        out, todo = [], list(stacks)
        while todo:
            stack = todo.pop()
            out.append(stack)
            for rule, at in sorted(stack.state):  # in the same order in every process
                if at == len(rule[1]) and rule[0]:
                    low = stack
                    for _ in rule[1]:
                        low = low.below
                    todo += self._pushed(low, rule[0])
        return out

    def shift(self, stack: Stack, symbol: str) -> list[Stack]:
        """Stacks after a symbol that something may follow; whole() tells where a conversation may end."""
        tops = self.reduced(self._pushed(stack, symbol))
        return [t for t in tops if any(self._pushed(t, x) for x in "sua")]

    def whole(self, stack: Stack) -> bool:
        """Whether a stack reduces to a complete parse."""
        return any(s.symbol == self.rules[0][0] and s.below is self.bottom for s in self.reduced([stack]))

    def _inserts(self, stack: Stack) -> list[tuple[Stack, str]]:
        """Stacks that the fewest insertions reach, with the symbols inserted."""
        out, todo = {stack: ""}, [stack]
        for low in todo:  # grows meanwhile, by rising number of insertions
            for symbol in NAMES:
                for top in self.shift(low, symbol):
                    if top not in out:
                        out[top] = out[low] + symbol
                        todo.append(top)
        return list(out.items())

    def _moves(self, stack: Stack, initial: str, fault: str) -> list[tuple[Stack, int, str, str]]:
        """What edits before and of one row make of a stack, the least (cost, letters) per result: stack, cost, letters
        and, per letter, the symbol that it puts into the conversation ("-" for none)."""
        best: dict[Stack, tuple[int, str, str]] = {}
        for low, symbols in self.inserts(stack):
            cost, letters = INSERT * len(symbols), "I" * len(symbols)
            made = [(low, cost + DELETE, letters + "D", symbols + "-")]
            if fault not in ("blank", "duplicate"):
                cost += TRUNCATED if fault == "truncated" else 0
                made += [(top, cost, letters + "K", symbols + initial) for top in self.shift(low, initial)]
                made += [(top, cost + REROLE, letters + "R", symbols + x) for x in NAMES for top in self.shift(low, x)]
            for top, *value in made:
                best[top] = min(best.get(top, tuple(value)), tuple(value))
        return [(top, *value) for top, value in best.items()]


@cache
def grammar() -> Grammar:
    """The grammar with all stacks that edits can reach, numbered alike in every process."""
    made = Grammar()
    made.live = [made.bottom]
    for stack in made.live:  # grows meanwhile
        made.live += [t for x in "sua" for t in made.shift(stack, x) if t not in made.live]
    return made


#: A live stack's cost, and the rank of its audit among those of all live stacks.
Live = dict[Stack, tuple[int, int]]


def merged(offers: Iterator[tuple[Stack, int, tuple, object]]) -> tuple[Live, dict[Stack, object]]:
    """Of the offers (stack, cost, audit, origin), the least (cost, audit) per stack; audits become ranks."""
    best: dict[Stack, tuple] = {}
    for top, cost, audit, origin in offers:
        if top not in best or (cost, audit) < best[top][:2]:
            best[top] = (cost, audit, origin)
    order = {audit: i for i, audit in enumerate(sorted({v[1] for v in best.values()}))}
    return {top: (v[0], order[v[1]]) for top, v in best.items()}, {top: v[2] for top, v in best.items()}


def step(live: Live, initial: str, fault: str) -> tuple[Live, dict[Stack, tuple]]:
    """Live stacks after one more row, and for each the stack before, the letters and the symbols.

    Audits of live stacks all end with a row's letter and have one such letter a row, so none begins another: their order
    is that of their ranks, then of what is added.
    """
    moves, initial = grammar().moves, initial if initial in ("s", "u", "a") else "?"
    return merged((top, cost + c, (rank, letters), (low, letters, symbols)) for low, (cost, rank) in live.items() for top, c, letters, symbols in moves(low, initial, fault))


def finish(live: Live) -> tuple[int, Stack, str]:
    """The least (cost, audit) of a whole conversation: cost, the stack before the last insertions, and their symbols."""
    ends = ((low, cost, rank, symbols) for low, (cost, rank) in live.items() for top, symbols in grammar().inserts(low) if grammar().whole(top))
    cost, _, _, symbols, low = min(((cost + INSERT * len(symbols), rank, "I" * len(symbols), symbols, low) for low, cost, rank, symbols in ends), key=lambda x: x[:3])
    return cost, low, symbols


def parsed(rows: list[tuple[str, str]], begin: Stack, end: Stack) -> tuple[str, str]:
    """Letters and symbols of the best edits of rows (initial, fault) that lead from one stack to another."""
    live, back, letters, symbols = {begin: (0, 0)}, [], [], []
    for initial, fault in rows:
        live, origin = step(live, initial, fault)
        back.append(origin)
    for origin in reversed(back):
        end, more, shown = origin[end]
        letters.append(more)
        symbols.append(shown)
    return "".join(reversed(letters)), "".join(reversed(symbols))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv (conv_id as text), turn, role, text of all rows as the damage leaves them. Nulls are one space, also in the
    key of the damage; a null turn stays null beside it."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    luck = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(luck == 1, "").when(luck == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(luck == 4, "user").otherwise(space("role"))
    copy = F.explode(F.sequence(F.lit(1), F.when(luck == 3, 2).otherwise(1)))
    return conversations.where(luck != 0).select(space("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), copy.alias("copy")).drop("copy")


def placed(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """rows with their place: `at` rises with conversation, turn (null first), role and text; `part` is the range that
    holds it. Equal rows may lie in several ranges. With initial and first fault: a duplicate is found by the digest of
    role and text, of which each conversation's first place is none."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("salt")]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(ranges, *order) if ranges else salted.repartitionByRange(*order)
    same = F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    sorted_rows = dealt.sortWithinPartitions(*order).drop("salt").select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part"), same.alias("same"))
    turns = written(sorted_rows, "turns")
    first = turns.groupBy("conv", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("text").rlike(BLANK), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("text").rlike(CUT), "truncated").otherwise("")
    out = written(turns.drop("same").join(first, "at", "left").select("conv", "part", "at", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "faults")
    discard(turns)
    return out


#: The lower bits of `at` count the rows of a range.
COUNT = (1 << 33) - 1


def summarised(rows: DataFrame) -> DataFrame:
    """Per part of a conversation and stack that may stand before it (entry): the stacks at its end (exits), their costs
    and ranks; the initials at both ends and the number of adjacent pairs within that are no dialogue. A part that does
    not stand first in its range begins its conversation, before which only the lowest stack can stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lives, pair, illegal, done = None, {}, ["", ""], 0, []
        numbers = pa.list_(pa.int64())
        kinds = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("entry", pa.int64()), ("exits", numbers), ("costs", numbers), ("ranks", numbers), ("head", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])

        def closed() -> list[list]:
            return [[*now, low.number, [s.number for s in live], *([v[i] for v in live.values()] for i in (0, 1)), *pair, illegal] for low, live in lives.items()]

        for batch in batches:
            for conv, part, at, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "at", "initial", "fault")), strict=True):
                if (conv, part) == now:
                    illegal += pair[1] + initial not in PAIRS
                    pair[1] = initial
                else:
                    if now:
                        done += closed()
                    stacks = grammar().live if at & COUNT == 0 else [grammar().bottom]
                    now, lives, pair, illegal = (conv, part), {s: {s: (0, 0)} for s in stacks}, [initial, initial], 0
                lives = {low: step(live, initial, fault)[0] for low, live in lives.items()}
            if done:
                yield _batch(done, kinds)
                done = []
        if now:
            yield _batch(closed(), kinds)

    light = rows.select("conv", "part", "at", "initial", "fault").repartition("conv", "part").sortWithinPartitions("conv", "part", "at")
    return light.mapInArrow(tidy(run), "conv string, part int, entry long, exits array<long>, costs array<long>, ranks array<long>, head string, last string, illegal long")


def _batch(rows: list, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def folded(parts: DataFrame) -> DataFrame:
    """Per part, where the best parse of its conversation enters and leaves it; with the conversation's cost, last
    insertions (symbols) and illegal pairs. A conversation has no more parts than there are ranges."""

    def fold(rows: list[dict]) -> list[tuple]:
        live, back, illegal, last = {grammar().bottom: (0, 0)}, [], 0, None
        for part, entries in groupby(rows, key=lambda r: r["part"]):
            ways = {r["entry"]: r for r in entries}
            one = next(iter(ways.values()))
            exits = {low: zip(*(ways[low.number][c] for c in ("exits", "costs", "ranks")), strict=True) for low in live}
            live, origin = merged((grammar().stacks[top], cost + c, (rank, r), low) for low, (cost, rank) in live.items() for top, c, r in exits[low])
            back.append((part, origin))
            illegal, last = illegal + one["illegal"] + (last is not None and last + one["head"] not in PAIRS), one["last"]
        cost, end, symbols = finish(live)
        out = []
        for part, origin in reversed(back):
            out.append((rows[0]["conv"], part, origin[end].number, end.number, cost, symbols, illegal))
            end = origin[end]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("entry", pa.int64()), ("exit", pa.int64()), ("cost", pa.int64()), ("tail", pa.string()), ("illegal", pa.int64())])
        waiting: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if waiting and waiting[0]["conv"] != row["conv"]:
                    done += fold(waiting)
                    waiting = []
                waiting.append(row)
            if done:
                yield _batch(done, kinds)
        if waiting:
            yield _batch(fold(waiting), kinds)

    ordered = parts.repartition("conv").sortWithinPartitions("conv", "part", "entry")
    return ordered.mapInArrow(tidy(run), "conv string, part int, entry long, exit long, cost long, tail string, illegal long")


def edited(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation its cost, illegal pairs, audit and the digest of what the edits make of it. A part's rows are
    held at a time; a digest is of one stream, so the rows of a conversation pass through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv", "part", "entry", "exit", "cost", "tail", "illegal", "initial", "fault", "role", "text")
        part: list[tuple] = []
        audit, digest, started = [], hashlib.sha256(), False

        def show(role: str, text: str) -> None:
            nonlocal started
            digest.update((("\n" if started else "") + f"{role}:{text}").encode())
            started = True

        def close(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal audit, digest, started, part
            letters, symbols = parsed([(r[7], r[8]) for r in part], grammar().stacks[part[0][2]], grammar().stacks[part[0][3]])
            audit.append(letters)
            waiting = iter(part)
            for letter, symbol in zip(letters, symbols, strict=True):
                row = None if letter == "I" else next(waiting)
                if letter != "D":
                    show(row[9] if letter == "K" else NAMES[symbol], row[10] if row else "")
            if whole:
                for symbol in part[0][5]:
                    show(NAMES[symbol], "")
                audit.append("I" * len(part[0][5]))
                columns = [[part[0][0]], [part[0][4]], [part[0][6]], ["".join(audit)], [digest.hexdigest()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv", "cost", "illegal", "audit", "repaired_sha256"])
                audit, digest, started = [], hashlib.sha256(), False
            part = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if part and row[:2] != part[0][:2]:
                    yield from close(row[0] != part[0][0])
                part.append(row)
        if part:
            yield from close(True)

    ordered = rows.join(plan, ["conv", "part"]).repartition("conv").sortWithinPartitions("conv", "at")
    return ordered.mapInArrow(tidy(run), "conv string, cost long, illegal long, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Repairs of rows (conv, turn, role, text; no nulls but turns), one per conv_id of conversations: gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation that has no rows costs nothing and is empty; so is one of which all rows are deleted, with its cost. A
    role that is no dialogue role (another initial, or empty) can be deleted or changed, not kept. Rows of one turn are
    ordered by role and text. Null conv_ids are one conversation; extra columns are not read.
    """
    faults = placed(rows, ranges)
    counts = faults.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"), *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated"))
    )
    repaired = edited(faults, folded(summarised(faults)))
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(counts, "conv", "left").join(repaired, "conv", "left").drop("conv")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    return written(out.select("conv_id", *(F.coalesce(c, F.lit(nothing[c])).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))), "repaired")


def op13_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))
