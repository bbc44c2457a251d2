"""Conversation structure repair by a Viterbi search that emits edits as soon as they are sure.

The rows of a conversation, in the order of their turns, become a sequence of
roles of the form system? (user assistant)+, or nothing, by the cheapest edits:
keep a row, give it another role, delete it, or insert an empty one.  After each
row there are four states (nothing yet, system, user or assistant last), and
each has one survivor: the cheapest edits that end there, and of those of equal
cost the ones whose string of initials is least.

Survivors are leaves of one tree of backpointers with reference counts.  A node
that no survivor descends from is freed at once; when the root is left with one
child, that child's edits are final and are emitted.  So only the stretch on
which survivors differ is held.  A survivor that can't win any more, because
another can be brought to its state at a smaller cost, is given up; ties never
are.  Ties are settled on the whole unresolved strings: two survivors' strings
differ within both (each has one letter per row, and a row's letter ends its
part), so their order, once known, holds for all continuations, and it is carried
along as a rank.

A conversation is sorted by Spark and walked through by one task, as its repaired
text is one hash over all its rows in order.  Memory is the unresolved stretch,
the batch at hand and one byte per row for the string of edits, however long the
conversation is.  A run of rows of which none can be kept as it is (no legal
role, or system rows in the middle) has two readings that stay open to its end
and is held whole.

Nulls and edge cases: a null role or text is one space, so such a row is blank or
has no legal role; an empty role is not legal either; null turns come first;
conversations without id are one conversation; rows of equal turn are ordered by
role and text, and equal rows lie side by side; texts of any length are compared
and hashed whole; a conversation without rows is kept with an empty result;
columns other than id, turn, role and text are left out, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.textkit import map_texts
from ebbtide.plans.scratch import materialize

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What a truncated row costs that isn't deleted.
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL_PAIRS = {"su", "ua", "au"}
#: [p][q]: how much more the cheapest rest from state p can cost than that from state q.
#: From p the rest of q is followed after an insertion, or without its system row.
_EXTRA = [[0, 0, 3, 0], [6, 0, 3, 6], [7, 3, 0, 3], [4, 0, 3, 0]]


def _steps(initial: str, must_delete: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state after a row, the (state before, cost, edits) that lead there."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        now, cost, path = before, 0, ""
        for _ in range(3):  # two insertions bring any state to any other that insertions can reach
            options = [(now, DELETE, "D")]
            if not must_delete:
                more = TRUNCATED if truncated else 0
                own = _OF_INITIAL.get(initial)
                if own == _NEXT[now] or (own == SYSTEM and now == START):
                    options.append((own, KEEP + more, "K"))
                options.append((_NEXT[now], REROLE + more, "R"))
            for after, price, letter in options:
                found = (cost + price, path + letter)
                best[before, after] = min(best.get((before, after), found), found)
            now, cost, path = _NEXT[now], cost + INSERT, path + "I"
    steps: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
    for (before, after), (cost, path) in sorted(best.items()):
        steps[after].append((before, cost, path))
    return steps


_TABLE = {(i, d, t): _steps(i, d, t) for i in ("s", "u", "a", "") for d in (False, True) for t in (False, True)}


class _Node:
    __slots__ = ("parent", "path", "row", "refs")

    def __init__(self, parent: _Node | None, path: str, row: object):
        self.parent, self.path, self.row, self.refs = parent, path, row, 0


class Repair:
    """One conversation, a row at a time; ``add`` and ``end`` yield (edit, state, row) in order."""

    def __init__(self):
        self.root = _Node(None, "", None)
        self.root.refs = 1
        # state -> (cost, rank among the survivors' strings, leaf)
        self.alive: dict[int, tuple[int, int, _Node]] = {START: (0, 0, self.root)}
        self.state = START  # of the root
        self.held = 0  # nodes below the root

    def add(self, initial: str, must_delete: bool, truncated: bool, row: object) -> Iterator[tuple[str, int, object]]:
        steps = _TABLE[initial if initial in _OF_INITIAL else "", must_delete, truncated]
        chosen = {}
        for after in range(4):
            options = [(self.alive[b][0] + cost, self.alive[b][1], path, b) for b, cost, path in steps[after] if b in self.alive]
            if options:
                chosen[after] = min(options)
        for q in list(chosen):
            if any(p != q and chosen[p][0] + _EXTRA[p][q] < chosen[q][0] for p in chosen):
                del chosen[q]
        order = {s: n for n, s in enumerate(sorted(chosen, key=lambda s: chosen[s][1:3]))}
        old, self.alive = self.alive, {}
        for after, (cost, _, path, before) in chosen.items():
            leaf = _Node(old[before][2], path, row)
            leaf.refs = 1
            leaf.parent.refs += 1
            self.held += 1
            self.alive[after] = (cost, order[after], leaf)
        for _, _, leaf in old.values():
            self._release(leaf)
        if self.root.refs == 1:
            yield from self._emit()

    def _release(self, node: _Node | None) -> None:
        """A survivor or child of the node is gone; nodes that nothing refers to are freed."""
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            self.held -= 1
            node = node.parent

    def _emit(self) -> Iterator[tuple[str, int, object]]:
        """Hand out the edits that all survivors share."""
        chain = []
        node = next(iter(self.alive.values()))[2]
        while node is not self.root:
            chain.append(node)
            node = node.parent
        leaves = {id(leaf) for _, _, leaf in self.alive.values()}
        while chain and self.root.refs == 1 and id(self.root) not in leaves:
            first = chain.pop()
            yield from self._edits(first.path, first.row)
            first.parent = None
            self.root, self.held = first, self.held - 1

    def _edits(self, path: str, row: object) -> Iterator[tuple[str, int, object]]:
        for letter in path:
            if letter == "K":
                initial = row[0][:1]
                self.state = _OF_INITIAL[initial]
            elif letter != "D":
                self.state = _NEXT[self.state]
            yield letter, self.state, row if letter != "I" else None

    def end(self) -> tuple[int, list[tuple[str, int, object]]]:
        """The cost of the whole, and the edits not yet emitted."""
        finals = []
        for state, (cost, rank, leaf) in self.alive.items():
            now, path = state, ""
            while now not in (START, ASSISTANT):
                now, cost, path = _NEXT[now], cost + INSERT, path + "I"
            finals.append((cost, rank, path, leaf))
        # the strings differ within both, so that the insertions at the end don't decide
        cost, _, path, leaf = min(finals, key=lambda f: f[:3])
        chain = []
        while leaf is not self.root:
            chain.append(leaf)
            leaf = leaf.parent
        out = [edit for node in reversed(chain) for edit in self._edits(node.path, node.row)]
        return cost, out + list(self._edits(path, None))


def faults(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text, first_turn) of every row, in partitions by conversation and in order within.

    ``first_turn`` is the first turn at which the conversation has this role and text; it is found by
    sums per distinct row, so a text that repeats without end is no hot group.
    """
    clean = rows.select(F.col(key).alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    # conversation, role and text as a hash; the texts themselves travel once
    same = ["conv", "mark_a", "mark_b"]
    marked = clean.withColumn("mark_a", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).withColumn("mark_b", F.length("text"))
    first = marked.groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    # written, so that both sides of the join are shuffles whose hot keys can be split
    first = materialize(first.select(F.col("conv").alias("of"), *(F.col(c).alias(f"of_{c}") for c in same[1:]), F.col("first.turn").alias("first_turn")), "first")
    on = F.col("conv").eqNullSafe(F.col("of")) & (F.col("mark_a") == F.col("of_mark_a")) & (F.col("mark_b") == F.col("of_mark_b"))
    joined = marked.join(first, on).select("conv", "turn", "role", "text", "first_turn")
    return joined.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


def _words(text: str) -> str:
    return text.rstrip(" \t\n\x0b\x0c\r")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the sorted rows of whole conversations; one last row per conversation (edit ``.``) has its sums."""
    out: list[tuple] = []
    names = ["conv", "edit", "turn", "role", "text", "fault", "sums"]
    schema = pa.schema([("conv", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("sums", pa.list_(pa.int64()))])
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal out, size
        rows, out, size = out, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=names)

    def give(edits) -> None:
        nonlocal size
        for letter, state, row in edits:
            role, text, turn, fault = row if row is not None else (_ROLE[state], "", None, None)
            out.append((conv, letter, turn, _ROLE[state] if letter == "R" else role, text, fault, None))
            size += len(text) + 64

    def close() -> None:
        cost, rest = search.end()
        give(rest)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        out.append((conv, ".", None, None, None, None, [gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost]))

    search = None
    for batch in batches:
        for conv_now, turn, role, text, first in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if search is None or conv_now != conv:
                if search is not None:
                    close()
                conv, search, before, turns, illegal = conv_now, Repair(), None, None, 0
                counts = {"blank": 0, "duplicate": 0, "truncated": 0}
            spoken = _words(text)
            fault = None
            if not spoken:
                fault = "blank"
            elif first != turn or (before is not None and before[:3] == (turn, role, text)):
                fault = "duplicate"
            elif spoken[-1] not in ".!?":
                fault = "truncated"
            if fault:
                counts[fault] += 1
            if turn is not None:
                turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
            if before is not None:
                illegal += before[1][:1] + role[:1] not in LEGAL_PAIRS
            before = (turn, role, text)
            give(search.add(role[:1], fault in ("blank", "duplicate"), fault == "truncated", (role, text, turn, fault)))
            if size > 8 << 20 or len(out) > 4000:
                yield flush()
    if search is not None:
        close()
    if out:
        yield flush()


_EDITS = "conv long, edit string, turn long, role string, text string, fault string, sums array<long>"


def edits(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every edit of every conversation, in order within a partition.

    ``edit`` is K, R, D or I, ``role`` and ``text`` those of the repaired row (of the deleted one for D); a row with
    edit ``.`` ends a conversation and holds gaps, blank, duplicate, truncated, illegal and cost.
    """
    return faults(rows, key).mapInArrow(_edited, _EDITS)


def repaired(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, place, role, text): the repaired conversations; places count from 0."""
    return map_texts(edits(rows, key), _numbered, "conv long, place long, role string, text string", "repaired").withColumnRenamed("conv", key)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place = 0
    for batch in batches:
        kept, places = [], []
        for number, edit in enumerate(batch.column(1).to_pylist()):
            if edit == ".":
                place = 0
            elif edit != "D":
                kept.append(number)
                places.append(place)
                place += 1
        part = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places, pa.int64()), part.column(3), part.column(4)], names=["conv", "place", "role", "text"])


SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_DIGEST = "conv long, " + ", ".join(f"{c} long" for c in SUMS) + ", audit string, repaired_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, from its edits as they come."""
    audit, digest, first, out = [], hashlib.sha256(), True, []
    for batch in batches:
        for conv, edit, _, role, text, _, sums in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if edit == ".":
                out.append((conv, *sums, "".join(audit), digest.hexdigest()))
                audit, digest, first = [], hashlib.sha256(), True
                continue
            audit.append(edit)
            if edit != "D":
                digest.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
        if out:
            types = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", *SUMS, "audit", "repaired_sha256"])
            out = []


def repair_report(rows: DataFrame, conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Faults, cost, edits and a hash of the repaired text for every conversation of ``conversations``."""
    found = map_texts(edits(rows, key), _digested, _DIGEST, "repairs")
    ids = conversations.select(F.col(key).alias("id")).distinct()
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left")
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        F.col("id").alias(key), *(F.coalesce(c, F.lit(0)).alias(c) for c in SUMS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """A test bed: rows dropped, emptied, cut off, repeated or given a wrong role by a checksum of id and turn."""
    space = F.lit(" ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.pmod(F.crc32(F.concat(text(key), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    marked = rows.select(key, "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    damaged_text: Column = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select(key, "turn", role.alias("role"), damaged_text.alias("text"), F.explode(times).alias("copy")).drop("copy")
