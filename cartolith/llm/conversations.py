"""Conversation repair: the cheapest edits that give roles in order, found on signatures that share their suffixes.

A conversation becomes a signature, one letter a row: what its role and its first fault mean for the repair. Read from the end, signatures are paths of
an automaton in which all conversations with the same rest share the nodes of that rest. A node has, for every state of the role grammar, the cost to
the end and the first of the best edits (the others stand at the nodes that follow), so both are worked out once per node and state.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cartolith.llm.common import written

# The grammar of role initials, (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a.
START, STATES, ENDS = 0, 4, (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}          # what can be inserted, or a row made into
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
Step = tuple[int, tuple[int, ...], str]            # cost, relative costs per state, and the first edit per state


class Steps:
    """What a node adds to the one behind it. Costs per state matter only against the cheapest state, and those take few values; so every
    (relative costs, letter) is worked out once, however many nodes have it."""

    def __init__(self):
        self.known: dict[tuple[tuple[int, ...], str], Step] = {}
        self.end = self.relaxed([(0, "") if s in ENDS else None for s in range(STATES)])

    @staticmethod
    def relaxed(found: list[tuple[int, str] | None]) -> Step:
        """Insertions lead to another state of the same node; of equal costs the smallest letter wins, and no two edits of one state share a letter."""
        best = list(found)
        for _ in range(STATES):
            for s in range(STATES):
                there = best[NEXT[s, WANTED[s]]]
                if there is not None and (best[s] is None or (there[0] + INSERT, "I") < best[s]):
                    best[s] = (there[0] + INSERT, "I")
        least = min(c for c, _ in best)
        return least, tuple(c - least for c, _ in best), tuple(e for _, e in best)

    def before(self, behind: tuple[int, ...], letter: str) -> Step:
        """letter: role initial, upper case if truncated; o: another role; x: must go."""
        key = (behind, letter)
        if key not in self.known:
            found = []
            for s in range(STATES):
                ways = [(DELETE + behind[s], "D")]
                if letter != "x":
                    more = TRUNCATED if letter.isupper() else 0
                    if (s, letter.lower()) in NEXT:
                        ways.append((more + behind[NEXT[s, letter.lower()]], "K"))
                    ways.append((REROLE + more + behind[NEXT[s, WANTED[s]]], "R"))
                found.append(min(ways))
            self.known[key] = self.relaxed(found)
        return self.known[key]


class Path:
    """The nodes from the end to the start of one signature. The next signature keeps the nodes of the rest that both share; with signatures in the
    order of their reversed letters, each node is made once, and what is held is one path, not the automaton."""

    def __init__(self):
        self.steps = Steps()
        self.kinds: list[Step] = [self.steps.end]
        self.number = {self.steps.end: 0}
        self.letters = ""                        # reversed
        self.kind, self.cost = array("i", [0]), array("q", [self.steps.end[0]])
        self.made = 0

    def go(self, letters: str) -> None:
        same = shared(self.letters, letters)
        del self.kind[same + 1:], self.cost[same + 1:]
        for letter in letters[same:]:
            step = self.steps.before(self.kinds[self.kind[-1]][1], letter)
            if step not in self.number:
                self.number[step] = len(self.kinds)
                self.kinds.append(step)
            self.kind.append(self.number[step])
            self.cost.append(self.cost[-1] + step[0])
            self.made += 1
        self.letters = letters

    def best(self) -> tuple[int, str]:
        """Cost and edits from the start of the grammar."""
        edits, state, at = [], START, len(self.letters)
        cost = self.cost[at] + self.kinds[self.kind[at]][1][START]
        while True:
            edit = self.kinds[self.kind[at]][2][state]
            if not edit:
                return cost, "".join(edits)
            edits.append(edit)
            if edit in "IR":
                state = NEXT[state, WANTED[state]]
            elif edit == "K":
                state = NEXT[state, self.letters[at - 1].lower()]
            at -= edit != "I"


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.startswith(b[:mid]):
            lo = mid
        else:
            hi = mid - 1
    return lo


def repaired(rows: Iterable[tuple[str, str]], edits: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Role and text of what the edits leave."""
    state = START
    for role, text in rows:
        for edit in edits:
            if edit == "D":
                break
            to = WANTED[state] if edit in "IR" else role[:1]
            state = NEXT[state, to]
            yield (ROLES[to], "") if edit == "I" else (ROLES[to] if edit == "R" else role, text)
            if edit != "I":
                break
    for _ in edits:   # only insertions are left
        to = WANTED[state]
        state = NEXT[state, to]
        yield ROLES[to], ""


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, copies: rows after the damage that crc32 of `conv:turn` gives (nulls: one space), as they come; copies is 0 for a dropped
    row and 2 for a repeated one."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank(F.col(conv)), F.lit(":"), blank(F.col(turn))).cast("binary")) % 20
    base = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(F.col(role)).alias("role"), blank(F.col(text)).alias("text"), code.alias("code"))
    return base.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


ORDER = ["conv", "turn", "role", "h"]   # ties of a turn go by role and by the text's hash; then rows are equal and need no order


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def signatures(rows: DataFrame) -> DataFrame:
    """conv, signature, illegal, gaps, from the rows of damaged().

    Rows are cut into key ranges by (conversation, turn, role, text, row), so that a conversation with a third of all rows is spread over a third of
    the tasks; each task makes letters for its stretch of a conversation. Whether a row's role and text came up in an earlier stretch is asked for
    stretches at the edge of a task only, by one entry per distinct row and stretch; the stretches of a conversation, one per task, then meet.
    Only flags, initials and 128-bit hashes of role and text are shuffled.
    """
    end = trimmed(F.col("text"))
    flags = rows.select("conv", "turn", "role", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "copies",
                        F.substring("role", 1, 1).alias("initial"), F.when(end == "", 2).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(1).cast("int").alias("fault"),
                        F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))).alias("digest"))
    keys = [*ORDER, "row"]
    ordered = flags.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "copies", "initial", "fault", "digest", F.spark_partition_id().alias("part"))
    conv_type = rows.schema["conv"].dataType
    types = [to_arrow_type(conv_type), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    names = ["conv", "part", "edge", "letters", "illegal", "first", "last", "low", "high", "turns", "digests", "places"]

    def runs(batches):
        now, conv, part = None, None, 0
        for batch in batches:
            for conv_, turn, copies, initial, fault, digest, part_ in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_ != conv:
                    if now is not None:
                        yield conv, part, now, False
                    now, conv, part = Stretch(), conv_, part_
                now.add(turn, copies, initial, fault, digest)
        if now is not None:
            yield conv, part, now, True

    def stretch(batches):
        out, first = [], True
        for conv, part, s, last in runs(batches):
            out.append((conv, part, *s.row(first or last)))
            first = False
            if len(out) >= 2048 or last:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []

    schema = f"conv {conv_type.simpleString()}, part int, edge boolean, letters string, illegal long, first string, last string, low long, high long, turns long, digests array<binary>, places array<long>"
    made = written(ordered.mapInArrow(stretch, schema), "stretches")
    inner = made.where("NOT edge").select("conv", F.col("letters").alias("signature"), "illegal", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"))

    edge = made.where("edge")   # two stretches a task at most
    seen = edge.select("conv", "part", F.explode(F.arrays_zip("digests", "places")).alias("z")).select("conv", "part", F.col("z.digests").alias("digest"), F.col("z.places").alias("place"))
    met = seen.groupBy("conv", "digest").agg(F.min("part").alias("first_part"), F.collect_list(F.struct("part", "place")).alias("all")).where("size(all) > 1")   # one entry per task
    later = met.select("conv", F.explode("all").alias("z"), "first_part").where("z.part > first_part").groupBy("conv", F.col("z.part").alias("part")).agg(F.collect_list("z.place").alias("again"))   # a task's rows at most
    later = later.select(F.col("conv").alias("late_conv"), F.col("part").alias("late_part"), "again")
    same = F.col("conv").eqNullSafe(F.col("late_conv")) & (F.col("part") == F.col("late_part"))
    cut = edge.drop("edge", "digests", "places").join(later, same, "left").select("conv", "part", "letters", "illegal", "first", "last", "low", "high", "turns", "again")

    def whole(key, table):
        letters, illegal, turns, last, low, high = [], 0, 0, None, None, None
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            own = list(r["letters"])
            for i in r["again"] or []:
                own[i] = "d"
            letters.extend(own)
            illegal += r["illegal"] + (last is not None and r["first"] is not None and not legal(last, r["first"]))
            last = last if r["last"] is None else r["last"]
            if r["low"] is not None:
                turns += r["turns"] - (high == r["low"])
                low, high = r["low"] if low is None else low, r["high"]
        gaps = 0 if low is None else high - low + 1 - turns
        return pa.table([pa.array([key[0].as_py()], types[0]), pa.array(["".join(letters)]), pa.array([illegal], pa.int64()), pa.array([gaps], pa.int64())], ["conv", "signature", "illegal", "gaps"])

    return inner.unionByName(cut.groupBy("conv").applyInArrow(whole, f"conv {conv_type.simpleString()}, signature string, illegal long, gaps long"))


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Stretch:
    """What one task knows of a conversation's consecutive rows."""

    def __init__(self):
        self.letters, self.seen, self.illegal, self.turns = [], {}, 0, 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, copies: int, initial: str, fault: int, digest: bytes) -> None:
        for _ in range(copies):
            if fault == 2:
                letter = "b"
            elif digest in self.seen:
                letter = "d"
            else:
                self.seen[digest] = len(self.letters)
                letter = initial if initial in ("s", "u", "a") else "o"
                letter = letter.upper() if fault else letter
            self.letters.append(letter)
            self.illegal += self.last is not None and not legal(self.last, initial)
            self.first, self.last = self.first if self.first is not None else initial, initial
        if copies and turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, at_edge: bool) -> tuple:
        firsts = self.seen if at_edge else {}
        return at_edge, "".join(self.letters), self.illegal, self.first, self.last, self.low, self.high, self.turns, list(firsts), list(firsts.values())


def edits_of(found: DataFrame, conv_type: str) -> DataFrame:
    """The rows of signatures() with cost and audit. Sorted by reversed signature (ranges by its first 64 letters, then by conversation, so that a
    signature of a third of all conversations is no hot key), each task walks its range with one Path."""
    base = found.select("conv", "signature", "illegal", "gaps", F.reverse(F.translate("signature", "bd", "xx")).alias("back"))
    ordered = base.withColumn("near", F.substring("back", 1, 64)).repartitionByRange("near", "conv").sortWithinPartitions("near", "back", "conv").select("conv", "signature", "illegal", "gaps", "back")

    def run(batches):
        path, last = Path(), None
        for batch in batches:
            cost, audit = [], []
            for back in batch.column(4).to_pylist():
                if back != last:
                    path.go(back)
                    best, last = path.best(), back
                cost.append(best[0])
                audit.append(best[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cost, pa.int64()), pa.array(audit, pa.string())], ["conv", "signature", "illegal", "gaps", "cost", "audit"])

    return ordered.mapInArrow(run, f"conv {conv_type}, signature string, illegal long, gaps long, cost long, audit string")


def edited(rows: DataFrame) -> DataFrame:
    """conv, signature, illegal, gaps, cost, audit: one row per conversation in the rows of damaged()."""
    return written(edits_of(written(signatures(rows), "signatures"), rows.schema["conv"].dataType.simpleString()), "edits")


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, messages) of conversations as they are: report as from digests(), messages with conv, place, role, text of the repaired rows."""
    rows = undamaged(conversations, conv, turn, role, text)
    report = edited(rows)
    kind = rows.schema["conv"].dataType
    arrow = to_arrow_type(kind)
    return mended(rows, report, lambda found: emit_digests(found, arrow), f"conv_id {kind.simpleString()}, {REPORT}"), mended(rows, report, lambda found: emit_messages(found, arrow), f"conv {kind.simpleString()}, place long, role string, text string")


def undamaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form of damaged()."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(F.col(role)).alias("role"), blank(F.col(text)).alias("text"), F.lit(1).alias("copies"))


def mended(rows: DataFrame, report: DataFrame, emit, schema: str) -> DataFrame:
    """emit(conv, audit row, iterator of repaired (role, text)) for each conversation, its rows streamed in order behind its row of the report. The rows
    of a conversation pass through one task, as its digest needs; they are sorted on disk if need be and never held."""
    sides = [F.lit(1).alias("side"), F.lit(None).cast("string").alias("signature"), *[F.lit(None).cast("long").alias(c) for c in ("illegal", "gaps", "cost")], F.lit(None).cast("string").alias("audit")]
    data = rows.where("copies > 0").select("conv", "turn", "role", F.xxhash64("text").alias("h"), "text", F.col("copies").cast("int").alias("copies"), *sides)
    head = report.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("text"),
                         F.lit(1).cast("int").alias("copies"), F.lit(0).alias("side"), "signature", "illegal", "gaps", "cost", "audit")
    both = data.unionByName(head).repartition("conv").sortWithinPartitions("conv", "side", "turn", "role", "h")

    def run(batches):
        rows = ((c, *r) for batch in batches for c, *r in zip(*(batch.column(n).to_pylist() for n in ("conv", "side", "role", "text", "copies", "signature", "illegal", "gaps", "cost", "audit"))))
        row = next(rows, None)
        while row is not None:
            head, tail = row, [None]

            def own():
                for r in rows:
                    if r[1] == 0:
                        tail[0] = r
                        return
                    for _ in range(r[4]):
                        yield r[2], r[3]

            mine = own()
            yield head[0], head[5:], repaired(mine, iter(head[9]))
            for _ in mine:
                pass
            row = tail[0]

    def out(batches):
        return emit(run(batches))

    return both.mapInArrow(out, schema)


def emit_messages(found, conv_type):
    for conv, _, messages in found:
        messages = enumerate(messages)
        while some := list(islice(messages, 1024)):
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(some), conv_type), pa.array([i for i, _ in some], pa.int64()), *[pa.array([m[k] for _, m in some], pa.string()) for k in (0, 1)]], ["conv", "place", "role", "text"])


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, signature string"


def emit_digests(found, conv_type):
    names = ["conv_id", *[f.split()[0] for f in REPORT.split(", ")]]
    types = [conv_type, *[pa.int64()] * 6, *[pa.string()] * 3]

    def rows():
        for conv, (signature, illegal, gaps, cost, audit), messages in found:
            sha = hashlib.sha256()
            for i, (role, text) in enumerate(messages):
                sha.update(("\n" if i else "").encode() + f"{role}:{text}".encode())
            yield conv, gaps, signature.count("b"), signature.count("d"), sum(signature.count(c) for c in "SUAO"), illegal, cost, audit, sha.hexdigest(), signature

    every = rows()
    while some := list(islice(every, 2048)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names)


def digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage=damaged) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, signature, after `damage`.

    Rows are taken by turn, nulls first; ties go by role, then by a hash of the text. A null conversation is one conversation; null roles and texts
    are one space. Only s, u and a as first letters of a role fit the grammar; other roles are rewritten or deleted. A conversation without rows after
    damage has zeros, an empty signature and audit, and the digest of no bytes. An empty table gives an empty result; other columns are not read.
    """
    rows = damage(conversations, conv, turn, role, text)
    kind = rows.schema["conv"].dataType
    arrow = to_arrow_type(kind)
    return mended(rows, edited(rows), lambda found: emit_digests(found, arrow), f"conv_id {kind.simpleString()}, {REPORT}")
