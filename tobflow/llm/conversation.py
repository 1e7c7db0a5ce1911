"""Conversation structure repair by a lazily determinised weighted automaton.

The edits of a row (keep, rerole, delete, insert before it) are arcs of a weighted automaton over the states that role
initials of the form ``(s?(ua)+)?`` pass through. Rows are scanned from the last to the first: the vector of least costs
from each state to the end, less its minimum, is one state of a deterministic automaton, made when first met and kept in
a transition table with the weight taken off, so a scan is table lookups. The trace goes back over the scan, first row
to last, along tight arcs, and takes the ASCII-least of them, which gives the audit.

Rows are sorted over all tasks by range, so a conversation of any size lies in segments of bounded size. A segment at a
border is solved from each state to each state; segments of a conversation are then chained by their costs and audits
alone. Texts take no part in this: rows are known by a digest of their text (SHA-256, 128 bits of it), and texts are
joined to the rows that may stay at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby, pairwise, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tobflow.llm.common import drop_tables, small_batches, table

#: Rows and bytes of text of a block of segments, beyond which it is closed.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
#: Costs of the edits, and the addition for a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after s, after u, after a (0 and 3 end a conversation); what an inserted or reroled turn leads to.
FREE, NEVER = 0, 1 << 40
NEXT = (2, 2, 3, 2)
#: Where keeping a row of initial s, u, a or any other leads to, by state.
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
ROLE = {2: "user", 3: "assistant"}
END = 4
KEY = ["c0", "c1", "t0", "t1", "role", "digest"]
WAY = "struct<entry:int,exit:int,cost:long,audit:string>"
SEGMENT = f"struct<rows:long,blank:long,duplicate:long,truncated:long,illegal:long,first:int,last:int,lowest:long,highest:long,turns:long,ways:array<{WAY}>>"
NUMBERED = f"c0 boolean, c1 long, t0 boolean, t1 long, role string, digest binary, block long, at long, segment {SEGMENT}"
CHAINED = "c0 boolean, c1 long, block long, whole boolean, entry int, audit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, all_audit string"
PIECES = "c0 boolean, c1 long, block long, whole boolean, repaired string"


def _closed(vector: list[int]) -> list[int]:
    """Least costs when turns may be inserted first."""
    for _ in range(3):
        vector = [min(v, INSERT + vector[NEXT[p]]) for p, v in enumerate(vector)]
    return [min(v, NEVER) for v in vector]


class Automaton:
    """Deterministic states are normalised cost vectors; both tables are filled as transitions are met.

    A row's code is 0 if it must go, else 1 + 2 * (0 for s, 1 for u, 2 for a, 3 for others) + (1 if it is truncated).
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.moves: dict[tuple[int, int], tuple[int, int]] = {}
        self.choices: dict[tuple[int, int], list[tuple[str, int] | None]] = {}
        self.ends = [self._state([FREE if p == q else NEVER for p in range(4)])[0] for q in range(4)]
        self.ends.append(self._state(_closed([FREE, NEVER, NEVER, FREE]))[0])

    def _state(self, vector: list[int]) -> tuple[int, int]:
        low = min(vector)
        normal = tuple(v - low if v < NEVER else NEVER for v in vector)
        if normal not in self.known:
            self.known[normal] = len(self.vectors)
            self.vectors.append(normal)
        return self.known[normal], low

    def _arcs(self, vector: tuple[int, ...], code: int, p: int) -> list[tuple[str, int, int]]:
        """Arcs over a row from p, in ASCII order: initial, next state, cost to the end."""
        out = [("D", p, DELETE + vector[p])]
        if code:
            extra = TRUNCATED * (1 - code % 2)
            kept = KEEP[(code - 1) // 2].get(p)
            if kept is not None:
                out.append(("K", kept, extra + vector[kept]))
            out.append(("R", NEXT[p], REROLE + extra + vector[NEXT[p]]))
        return out

    def move(self, after: int, code: int) -> tuple[int, int]:
        """The state before a row of ``code``, and the weight to add to its vector."""
        if (found := self.moves.get((after, code))) is None:
            vector = self.vectors[after]
            found = self.moves[after, code] = self._state(_closed([min(cost for _, _, cost in self._arcs(vector, code, p)) for p in range(4)]))
        return found

    def choose(self, after: int, code: int) -> list[tuple[str, int] | None]:
        """By state before a row: the initials of the tight arcs up to and over it, and the state behind it."""
        if (found := self.choices.get((after, code))) is None:
            before, weight = self.move(after, code)
            vector, behind, found = self.vectors[before], self.vectors[after], []
            for p in range(4):
                initials, at = "", p
                while vector[at] < NEVER:
                    tight = [(initial, to) for initial, to, cost in self._arcs(behind, code, at) if cost == weight + vector[at]]
                    if vector[NEXT[at]] + INSERT == vector[at]:
                        tight.append(("I", -1))
                    initial, to = min(tight)
                    initials += initial
                    if to >= 0:
                        break
                    at = NEXT[at]
                found.append((initials, to) if vector[at] < NEVER else None)
            self.choices[after, code] = found
        return found

    def scan(self, rows: list[tuple[int, int]], end: int) -> tuple[list[int], int]:
        """States behind the last row to before the first, and the weight taken off; rows are (code, times)."""
        states, total = [self.ends[end]], 0
        for code, times in reversed(rows):
            state, weight = self.move(states[-1], code)
            states.append(state)
            total += weight + DELETE * (times - 1)  # only rows that must go repeat; once closed, a vector stays the same over them
        return states, total

    def trace(self, rows: list[tuple[int, int]], states: list[int], entry: int, end: int) -> str:
        out, p, n = [], entry, len(rows)
        for k, (code, times) in enumerate(rows):
            if times > 1:
                out.append("D" * (times - 1))
            initials, p = self.choose(states[n - k - 1], code)[p]
            out.append(initials)
        while end == END and p in (1, 2):
            out.append("I")
            p = NEXT[p]
        return "".join(out)

    def ways(self, rows: list[tuple[int, int]], *, entries: range, ends: list[int]) -> list[dict]:
        out = []
        for end in ends:
            states, total = self.scan(rows, end)
            for p in entries:
                if (cost := self.vectors[states[-1]][p]) < NEVER:
                    out.append({"entry": p, "exit": end, "cost": total + cost, "audit": self.trace(rows, states, p, end)})
        return out


class _Segment:
    """Rows of one conversation within a block, added in order."""

    def __init__(self, c0: bool, c1: int, block: int, open_left: bool):
        self.c0, self.c1, self.block, self.open_left = c0, c1, block, open_left
        self.rows: list[tuple[int, int]] = []
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.lowest = self.highest = None

    def add(self, known: bool, turn: int, code: int, kind: int, blank: bool, times: int) -> None:
        self.illegal += times - 1 + (self.last is not None and not legal(self.last, kind))
        self.first, self.last = kind if self.first is None else self.first, kind
        if known and turn != self.highest:
            self.turns, self.highest = self.turns + 1, turn
            self.lowest = turn if self.lowest is None else self.lowest
        self.n += times
        again = times if code == 0 else times - 1
        if blank:
            self.blank += times
        else:
            self.duplicate += again
            self.truncated += code > 0 and code % 2 == 0
        if code:
            self.rows.append((code, 1))
        if again:
            self.rows.append((0, again))

    def close(self, automaton: Automaton, open_right: bool) -> dict:
        ways = automaton.ways(self.rows, entries=range(4 if self.open_left else 1), ends=[0, 1, 2, 3, END] if open_right else [END])
        return {"rows": self.n, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "first": self.first, "last": self.last, "lowest": self.lowest, "highest": self.highest, "turns": self.turns, "ways": ways}


def legal(before: int, now: int) -> bool:
    """su, ua or au, by the kinds of initials."""
    return (before, now) in ((0, 1), (1, 2), (2, 1))


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _number(block_rows: int, block_bytes: int):
    """Sorted rows in: rows that may stay, with their place, and a row for each segment."""
    schema = _arrow(NUMBERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        automaton, segment = Automaton(), None
        block, used, size = TaskContext.get().partitionId() << 32, 0, 0

        def closed(open_right: bool) -> dict:
            return {"c0": segment.c0, "c1": segment.c1, "block": segment.block, "segment": segment.close(automaton, open_right)}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                other = segment is None or (segment.c0, segment.c1) != (r["c0"], r["c1"])
                full = used >= block_rows or size >= block_bytes
                if other or full:
                    if segment is not None:
                        out.append(closed(not other))
                    if full or other and 2 * used >= block_rows:
                        block, used, size = block + 1, 0, 0
                    segment = _Segment(r["c0"], r["c1"], block, segment is None or not other)
                at = segment.n
                segment.add(r["t0"], r["t1"], r["code"], r["kind"], r["blank"], r["copies"])
                used, size = used + 1, size + r["size"]
                if r["code"]:
                    out.append({**{k: r[k] for k in KEY}, "block": segment.block, "at": at})
            yield pa.RecordBatch.from_pylist(out, schema)
        if segment is not None:
            yield pa.RecordBatch.from_pylist([closed(True)], schema)

    return run


def _audit_before(a: tuple, b: tuple) -> bool:
    """Whether the audit of chain a (audit, rest of the chain) comes before that of b in ASCII order."""

    def letters(chain):
        while chain:
            yield from chain[0]
            chain = chain[1]

    for x, y in zip_longest(letters(a), letters(b), fillvalue=""):
        if x != y:
            return x < y
    return False


def _chain(segments: list[dict]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost of a conversation, and the entry state and audit of each segment."""
    best: dict[int, tuple[int, tuple | None]] = {END: (0, None)}
    for k in range(len(segments) - 1, -1, -1):
        found: dict[int, tuple[int, tuple]] = {}
        for way in segments[k]["ways"]:
            if (rest := best.get(way["exit"])) is None or (way["exit"] == END) != (k == len(segments) - 1):
                continue
            cost, chain = way["cost"] + rest[0], (way["audit"], rest[1], way["entry"])
            had = found.get(way["entry"])
            if had is None or cost < had[0] or cost == had[0] and _audit_before(chain, had[1]):
                found[way["entry"]] = (cost, chain)
        best = found
    cost, chain = best[0]
    steps = []
    while chain:
        steps.append((chain[2], chain[0]))
        chain = chain[1]
    return cost, steps


def _chains(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in the order of conversation and block in: each with its entry and audit, the first with the totals."""
    rows = (r for b in batches for k in range(0, b.num_rows, 512) for r in b.slice(k, 512).to_pylist())
    out, held = [], 0
    for (c0, c1), group in groupby(rows, lambda r: (r["c0"], r["c1"])):
        own = list(group)
        segments = [r["segment"] for r in own]
        cost, steps = _chain(segments)
        total = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        known = [s for s in segments if s["lowest"] is not None]
        for a, b in pairwise(segments):
            total["illegal"] += not legal(a["last"], b["first"])
        for a, b in pairwise(known):
            total["turns"] -= a["highest"] == b["lowest"]
        turns = total.pop("turns")
        gaps = known[-1]["highest"] - known[0]["lowest"] + 1 - turns if known else 0
        whole = len(own) == 1
        for r, (entry, audit) in zip(own, steps, strict=True):
            out.append({"c0": c0, "c1": c1, "block": r["block"], "whole": whole, "entry": entry, "audit": audit})
            held += len(audit)
        out[-len(own)] |= {**total, "gaps": gaps, "cost": cost, "all_audit": None if whole else "".join(a for _, a in steps)}
        if len(out) >= 2000 or held > 4 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def repaired_lines(audit: str, entry: int, rows: Iterator[tuple[int, str, str]]) -> list[str]:
    """``role:text`` of a segment's repaired turns; rows are (place, role, text) of those that may stay, in order."""
    out, p, at, row = [], entry, 0, next(rows, None)
    for initial in audit:
        if initial == "I":
            p = NEXT[p]
            out.append(f"{ROLE[p]}:")
            continue
        if initial != "D":
            while row[0] != at:
                row = next(rows)
            kind = "sua".find(row[1][:1]) if row[1] else -1
            p = KEEP[kind][p] if initial == "K" else NEXT[p]
            out.append(f"{row[1] if initial == 'K' else ROLE[p]}:{row[2]}")
        at += 1
    return out


def _pieces(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            out = []
            for r in batch.slice(k, 64).to_pylist():
                rows = iter((x["at"], x["role"], x["text"]) for x in sorted(r["lines"] or [], key=lambda x: x["at"]))
                out.append({"c0": r["c0"], "c1": r["c1"], "block": r["block"], "whole": r["whole"], "repaired": "\n".join(repaired_lines(r["audit"], r["entry"], rows))})
            yield pa.RecordBatch.from_pylist(out, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of conversation and block in: the digest of each conversation, a piece at a time."""
    schema = pa.schema([("c0", pa.bool_()), ("c1", pa.int64()), ("repaired_sha256", pa.string())])
    rows = (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist())
    for (c0, c1), group in groupby(rows, lambda r: (r["c0"], r["c1"])):
        state, begun = hashlib.sha256(), False
        for r in group:
            if r["repaired"]:
                state.update(("\n" if begun else "").encode() + r["repaired"].encode())
                begun = True
        yield pa.RecordBatch.from_pylist([{"c0": c0, "c1": c1, "repaired_sha256": state.hexdigest()}], schema)


def damage(conversations: DataFrame) -> DataFrame:
    """c0, c1 (conv_id, nulls told apart), t0, t1 (turn), role, text and copies of the rows left after the seeded damage."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").isNotNull().alias("c0"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c1"),
        F.col("turn").isNotNull().alias("t0"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t1"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
        kind.alias("kind"),
    )
    return rows.where("kind <> 0").drop("kind")


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows (KEY) with copies, code, kind of initial, blank and size, without their texts."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    known = rows.select(
        *KEY,
        "copies",
        (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.octet_length("text").alias("size"),
    )
    known = known.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("size").alias("size"))
    turn = F.struct("t0", "t1")
    first = known.groupBy("c0", "c1", "role", "digest").agg(F.min(turn).alias("turn")).select("c0", "c1", "turn.*", "role", "digest", F.lit(True).alias("is_first"))
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    gone = F.col("blank") | F.col("is_first").isNull()
    code = F.when(gone, 0).otherwise(1 + 2 * kind + F.col("cut").cast("int"))
    return known.join(first, KEY, "left").select(*KEY, "copies", "blank", "size", kind.alias("kind"), code.alias("code"))


def repair(conversations: DataFrame, *, block_rows: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired pieces of damaged conversations (c0, c1, t0, t1, role, text, copies as from ``damage``).

    The report has c0, c1, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation; pieces has
    c0, c1, block, whole and repaired (lines of ``role:text``); pieces of a conversation follow each other by block.
    Rows are taken by turn, nulls first; rows of one turn by role, then by the digest of their text, copies together.
    Null ids form one conversation; empty texts are blank; a very long text closes its block; an empty table gives none.
    """
    rows = conversations.withColumn("digest", F.expr("substring(unhex(sha2(text, 256)), 1, 16)"))
    columns = [*KEY, "copies", "blank", "size", "kind", "code"]
    ordered = _coded(rows).select(columns).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    numbered = table(ordered.mapInArrow(_number(block_rows, block_bytes), NUMBERED), "turns")
    segments = numbered.where("segment IS NOT NULL").select("c0", "c1", "block", "segment")
    chained = table(segments.repartition("c0", "c1").sortWithinPartitions("c0", "c1", "block").mapInArrow(partial(_chains, _arrow(CHAINED)), CHAINED), "chains")
    texts = rows.groupBy(*KEY).agg(F.any_value("text").alias("text"))
    lines = numbered.where("segment IS NULL").select(*KEY, "block", "at").join(texts, KEY)
    lines = lines.groupBy("c0", "c1", "block").agg(F.collect_list(F.struct("at", "role", "text")).alias("lines"))
    pieces = chained.select("c0", "c1", "block", "whole", "entry", "audit").join(lines, ["c0", "c1", "block"], "left").mapInArrow(partial(_pieces, _arrow(PIECES)), PIECES)
    report = chained.where("cost IS NOT NULL").select("c0", "c1", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce("all_audit", "audit").alias("audit"))
    pieces = table(pieces, "repaired")
    drop_tables(numbered)
    return report, pieces


def digests(pieces: DataFrame) -> DataFrame:
    """c0, c1 and the SHA-256 of each repaired conversation. One in many pieces is hashed piece by piece, in order: its rows never meet."""
    whole = pieces.where("whole").select("c0", "c1", F.sha2("repaired", 256).alias("repaired_sha256"))
    split = pieces.where("NOT whole").repartition("c0", "c1").sortWithinPartitions("c0", "c1", "block")
    return whole.unionByName(split.select("c0", "c1", "block", "repaired").mapInArrow(_digests, "c0 boolean, c1 long, repaired_sha256 string"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: faults after the seeded damage, the cheapest repair's cost and audit, and the digest of what it gives."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report, pieces = repair(damage(raw))
    ids = raw.select(F.col("conv_id").isNotNull().alias("c0"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("c1")).distinct()
    with small_batches(spark):
        sums = table(digests(pieces), "digests")
    out = ids.join(report, ["c0", "c1"], "left").join(sums, ["c0", "c1"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.when(F.col("c0"), F.col("c1")).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
