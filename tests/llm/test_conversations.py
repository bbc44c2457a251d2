"""Conversation repair: the search against all edits, the report against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import conversations

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def all_edits(rows):
    """The least (cost, string) of all edit strings; rows are (role initial, must go, truncated)."""
    open_ends = {(0, "", "")}

    def inserted(ends):
        out, now = set(ends), ends
        for _ in range(2):
            now = {(c + 3, p + "I", NEXT[s]) for c, p, s in now}
            out |= now
        return out

    for initial, gone, truncated in rows:
        new = set()
        for c, p, s in inserted(open_ends):
            new.add((c + 4, p + "D", s))
            if not gone:
                more = 3 if truncated else 0
                if initial == NEXT[s] or (initial == "s" and s == ""):
                    new.add((c + more, p + "K", initial))
                new.add((c + 3 + more, p + "R", NEXT[s]))
        least = min(new)[0]
        open_ends = {e for e in new if e[0] <= least + 8}
    return min((c, p) for c, p, s in inserted(open_ends) if s in ("", "a"))


def searched(rows):
    repair, out, most = conversations.Repair(), [], 0
    for initial, gone, truncated in rows:
        out += repair.add(initial, gone, truncated, (initial,))
        most = max(most, repair.held)
    cost, rest = repair.end()
    out += rest
    return cost, "".join(e[0] for e in out), "".join(" sua"[e[1]] for e in out if e[0] != "D"), most


def test_search_finds_the_cheapest_and_least_edits():
    rng = random.Random(2)
    for _ in range(1500):
        rows = [(rng.choice("suauauax "), gone, not gone and rng.random() < 0.2) for _ in range(rng.randint(0, 6)) for gone in [rng.random() < 0.2]]
        cost, edits, roles, _ = searched(rows)
        assert (cost, edits) == all_edits(rows)
        assert re.fullmatch("(s?(ua)+)?", roles)


@pytest.mark.parametrize("cycle", ["ua", "u", "aus", "suauaa", "uuaa"])
def test_edits_are_emitted_early(cycle):
    rows = [(cycle[k % len(cycle)], False, k % 5 == 0) for k in range(5000)]
    assert searched(rows)[3] < 60


def test_a_reading_open_to_the_end_is_kept_whole():
    cost, edits, roles, most = searched([("x", False, False)] * 501)
    assert (cost, edits) == (4 + 3 * 500, "D" + "R" * 500) and len(roles) == 500 and most >= 500


def brute_report(rows):
    """Every column by hand for rows (conv_id, turn, role, text), damaged as the query asks."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        count, seen, states = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in kept:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            if fault:
                count[fault] += 1
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit = all_edits(states) if kept else (0, "")
        lines, place, state = [], 0, ""
        for letter in audit:
            if letter == "I":
                state = NEXT[state]
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, role, text = kept[place]
            place += 1
            if letter == "K":
                state = role[:1]
                lines.append(f"{role}:{text}")
            elif letter == "R":
                state = NEXT[state]
                lines.append({"u": "user", "a": "assistant"}[state] + ":" + text)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def dirty(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", " \t\n", "", None, "é…", "Fine. \x0b\r", "x" * 5000 + "?", "user: a\nassistant: b.", " "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "User", "tool", "ux"]
    rows = []
    for conv in [*range(60), None]:
        rows += [(conv, rng.choice([k, k, k, k + 3, None]), rng.choice(roles), rng.choice(texts)) for k in range(rng.randint(1, 7))]
    return rows + [(61, 9, "user", "Same.")] * 3 + [(None, None, None, None)]


def test_report_matches_plain_python(spark):
    rows = dirty(6)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("k")).withColumn("edit", F.lit(1)).repartition(4)
    found = conversations.repair_report(conversations.damaged(frame), frame).collect()
    want = brute_report(rows)
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_repaired_rows_are_those_of_the_hash(spark):
    rows = dirty(7)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair_report(frame, frame).collect()}
    parts = sorted(conversations.repaired(frame).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"]))
    for conv, ours in groupby(parts, key=lambda r: r["conv_id"]):
        ours = list(ours)
        assert [r["place"] for r in ours] == list(range(len(ours)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in ours).encode()).hexdigest() == hashes[conv]
    assert conversations.repair_report(frame.limit(0), frame.limit(0)).count() == 0
    gone = conversations.repair_report(frame.limit(0), frame)
    assert gone.filter("cost = 0 and audit = ''").count() == gone.count() == len({r[0] for r in rows})
