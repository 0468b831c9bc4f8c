"""Conversation structure repair over a suffix-shared automaton.

Each conversation becomes a signature, one symbol a row: what role it has and whether
it must go or lacks its end. Signatures are taken apart from the end: conversations
that end alike share the nodes of their ending. Distinct signatures are sorted by
their reverse over all tasks, so a task meets shared endings one after another and
holds only the path it stands on. For every node and grammar state it computes once
the cost to go and the best audit suffix, kept as its first edit and where that leads.
Signatures then meet their conversations again, and the edits are applied to the rows.

The repaired roles follow ``(s?(ua)+)?`` by their initials. Edits: Keep (0), Rerole to
user or assistant (3), Delete (4, required for blank rows and duplicates), Insert an
empty user or assistant (3); a truncated row that stays adds 3. Of the cheapest edits
the ASCII-least audit is taken. Which role a Rerole or Insert gives follows from the
state, so the audit says all.

A conversation's rows are read as a sorted stream: a task holds one byte of a
conversation per row, never its texts, however long it is. Signatures that many
conversations share are sliced when they rejoin.

Defined results: a null role or text is one space; in the damage key a null id or turn
is one space; null turns come first, equal turns go by role, then text; rows of one
null id form one conversation; the initial of an empty role is empty; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import lookup
from .components import saved

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
MUST_GO = "d"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)    # what was given last
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_GIVEN = {_USER: "user", _ASSISTANT: "assistant"}
_NONE = 1 << 60
_ROWS = "conv_id long, place long, role string, text string"


def damaged(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, gone``: some dropped (``gone``), emptied, cut, repeated or given to the user, by a digest of their place."""
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _in_order(rows: DataFrame) -> list[Column]:
    return [F.col("conv_id"), F.col("kind"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]


def _marked(rows: DataFrame) -> DataFrame:
    """Rows by conversation, in order, with fault and symbol; rows that are gone leave only their id."""
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = Window.partitionBy("conv_id", "kind", "role", "_digest").orderBy(F.asc_nulls_first("turn"))
    marked = (
        rows.withColumns({"kind": F.when(F.col("gone"), 0).otherwise(1), "_digest": F.sha2("text", 256)})
        .repartition("conv_id")    # the windows and the stream below all go by conversation
        .withColumn("_again", F.row_number().over(seen) > 1)
        .withColumn("fault", F.when(left == "", "blank").when(F.col("_again"), "duplicate")
                    .when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none"))
    )
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO) \
        .when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return marked.sortWithinPartitions(*_in_order(marked)) \
        .select("conv_id", "kind", "turn", initial.alias("initial"), "fault", symbol.alias("symbol"))


def _by_conversation(batches: Iterator[pa.RecordBatch]):
    """Conversation by conversation the rows of a sorted stream, as an iterator of tuples."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return groupby(rows, key=lambda row: row[0])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and signature of each conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]

    def told(out: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    out = []
    for conv, rows in _by_conversation(batches):
        faults = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}
        first = last = before = None
        turns = illegal = 0
        signature = bytearray()
        for _, kind, turn, initial, fault, symbol in rows:
            if not kind:
                continue
            faults[fault] += 1
            signature += symbol.encode()
            if turn is not None and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
            if before is not None and before + initial not in ("su", "ua", "au"):
                illegal += 1
            before = initial
        gaps = last - first + 1 - turns if turns else 0
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, signature.decode()))
        if len(out) == 5000:
            yield told(out)
            out = []
    if out:
        yield told(out)


def _closed(best: list) -> tuple:
    """The values of a node with insertions before its row: (cost, edit, state after the edit) by state."""
    def inserted(state: int, to: tuple) -> tuple:
        return min(best[state], (to[0] + INSERT, "I", _NEXT[state]), key=lambda v: v[:2])

    user, assistant = inserted(_USER, best[_ASSISTANT]), inserted(_ASSISTANT, best[_USER])
    return inserted(_START, user), inserted(_SYSTEM, user), user, assistant


END = _closed([(0, "", _START), (_NONE, "", _START), (_NONE, "", _START), (0, "", _ASSISTANT)])
_FITS = {("s", _START): _SYSTEM, ("u", _START): _USER, ("u", _SYSTEM): _USER, ("u", _ASSISTANT): _USER, ("a", _USER): _ASSISTANT}


def node(symbol: str, rest: tuple) -> tuple:
    """The values of the node that reads ``symbol`` and goes on to the node with the values ``rest``."""
    best = []
    for state in range(4):
        edits = [(rest[state][0] + DELETE, "D", state)]
        if symbol != MUST_GO:
            extra = TRUNCATED if symbol.isupper() else 0
            to = _FITS.get((symbol.lower(), state))
            if to is not None:
                edits.append((rest[to][0] + KEEP + extra, "K", to))
            edits.append((rest[_NEXT[state]][0] + REROLE + extra, "R", _NEXT[state]))
        best.append(min(edits, key=lambda v: v[:2]))
    return _closed(best)


def _audit(path: list[tuple]) -> str:
    """The edits from the start state at the top of a path of nodes."""
    edits, state, at = [], _START, len(path) - 1
    while True:
        _, edit, state_after = path[at][state]
        if not edit:
            return "".join(edits)
        edits.append(edit)
        state, at = state_after, at if edit == "I" else at - 1


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost and audit of signatures that come sorted by their reverse.

    ``path`` holds the nodes of the last one, the end first; what the next one shares stays.
    """
    path, before = [END], ""
    for batch in batches:
        costs, audits = [], []
        for ending in batch.column(0).to_pylist():
            shared = next((i for i, (x, y) in enumerate(zip(ending, before)) if x != y), min(len(ending), len(before)))
            del path[shared + 1:]
            for symbol in ending[shared:]:
                path.append(node(symbol, path[-1]))
            before = ending
            costs.append(path[-1][_START][0])
            audits.append(_audit(path))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                         names=["signature", "cost", "audit"])


def solved(signatures: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of every distinct signature."""
    distinct = saved(signatures.select("signature").distinct().withColumn("ending", F.reverse("signature")))
    ranged = distinct.repartitionByRange("ending").sortWithinPartitions("ending")
    return ranged.select("ending", "signature").mapInArrow(_solve, "signature string, cost long, audit string")


def audit_conversations(rows: DataFrame) -> DataFrame:
    """Counts of faults, the cost of the cheapest edits and their audit, one row per conversation.

    ``rows``: ``conv_id, turn, role, text`` without nulls but in id and turn, and
    ``gone`` for rows that only tell that their conversation exists.
    """
    profile = saved(_marked(rows).mapInArrow(
        _profile, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"))
    return lookup(profile, solved(profile), "signature", "conv_id").drop("signature")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of conversations whose audit stands before their rows."""
    out: list[tuple] = []
    size = 0

    def told() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "place", "role", "text"])

    for conv, rows in _by_conversation(batches):
        audit, at, state, place = next(rows)[3], 0, _START, 0

        def given(role: str, text: str) -> None:
            nonlocal place, size
            out.append((conv, place, role, text))
            place += 1
            size += len(text)

        def inserts() -> None:
            nonlocal at, state
            while audit[at:at + 1] == "I":
                state = _NEXT[state]
                given(_GIVEN[state], "")
                at += 1

        for _, _, role, text in rows:
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _FITS[role[:1], state]
                given(role, text)
            elif edit == "R":
                state = _NEXT[state]
                given(_GIVEN[state], text)
            if len(out) >= 5000 or size > 1 << 22:
                yield told()
                out.clear()
                size = 0
        inserts()
    if out:
        yield told()


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the rows after the edits of ``audits`` (``conv_id, audit``), conversations whole and in order in their tasks."""
    none = F.lit(None)
    first = audits.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rest = rows.where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = first.unionByName(rest).repartition("conv_id")
    return both.sortWithinPartitions(*_in_order(both)).select("conv_id", "kind", "role", "text").mapInArrow(_apply, _ROWS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's ``role:text`` lines, from a stream that holds them in order."""
    ids, digests = [], []
    for conv, rows in _by_conversation(batches):
        digest = hashlib.sha256()
        for _, place, role, text in rows:
            digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        ids.append(conv)
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def repair_report(turns: DataFrame) -> DataFrame:
    """Damage, audit and digest of the repaired rows of every conversation."""
    rows = damaged(turns)
    audits = saved(audit_conversations(rows))
    digests = repaired_turns(rows, audits).mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "id")
    empty = hashlib.sha256(b"").hexdigest()
    return audits.join(digests, audits["conv_id"].eqNullSafe(digests["id"]), "left").select(
        *audits.columns, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
