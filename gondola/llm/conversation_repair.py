"""Conversation structure repair: a survivor-coalescence Viterbi search over the edits of each conversation.

A repaired conversation is empty, or has an optional system turn and then user and assistant turns in pairs. Each turn is
kept (0), given the role user or assistant (1) or deleted (2); an empty user or assistant turn can be inserted anywhere
(5). Blank turns and repeats of an earlier turn must be deleted; a truncated turn that stays costs 5 more. The cheapest
edits win; of equally cheap ones, those whose initials (Delete, Insert, Keep, Rerole) come first in ASCII order.

The turns of a conversation pass in order. For each of four states (nothing kept, system, user or assistant kept last)
the cheapest way there survives, as a leaf of a tree of back pointers whose nodes count what refers to them and hold the
edits between two forks. A node that nothing refers to any more goes; as soon as all survivors share an ancestor, the
edits up to it are final and leave the tree. Ties are settled by the whole unresolved suffixes: these part at a fork, and
the edits there are never the same. A survivor also goes when another could do all that it can do and would still be
cheaper, so that hopeless survivors don't hold back the rest.

Memory: an Arrow batch, the tree (at most seven nodes) and a letter a turn and survivor. Texts never wait in the tree:
each leaf carries the running hash of the repaired turns on its way. So a conversation of any length can stay unresolved
to its end (turns of one role only, say, where the number of turns decides the first edit) at the cost of its audit.
Exact copies of a turn are counted before anything is shuffled, and repeats are found by a join on (conversation, turn,
digest of role and text), so that no set of seen turns is held. The last step reads each conversation in order in one
task, from Spark's sort, which spills: a hash of the whole conversation can only be computed in order.

Turns are ordered by number (nulls first), then role, then text, by code point; rows without conv_id form one conversation.
Null roles and texts count as one space. A role's initial is its first character; a turn whose role is an empty string
has none, makes the pairs next to it illegal and can't be kept as it is. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import let

# fixed values: costs of the edits
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
BLANKS = " \t\n\v\f\r"
#: EXTRA[y][x]: what it costs at most to do from state y whatever can be done from state x.
EXTRA = ((0, 0, INSERT, 0), (12, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))

Line = tuple[str, str] | None


class Node:
    """The edits from a fork to the next, and the hash of the repaired turns up to its end. ``refs`` counts its children
    (``forks``) and the survivor that ends in it."""

    __slots__ = ("digest", "empty", "forks", "letters", "parent", "refs")

    def __init__(self, parent: Node | None):
        self.parent, self.letters, self.refs, self.forks = parent, bytearray(), 0, []
        self.digest, self.empty = (hashlib.sha256(), True) if parent is None else (parent.digest.copy(), parent.empty)
        if parent is not None:
            parent.refs += 1
            parent.forks.append(self)

    def put(self, letter: str, line: Line) -> Node:
        self.letters += letter.encode()
        if line is not None:
            self.digest.update(f"{'' if self.empty else chr(10)}{line[0]}:{line[1]}".encode())
            self.empty = False
        return self


class Survivors:
    """The search over one conversation; ``emit`` gets the letters of edits as soon as they are final."""

    def __init__(self, emit: Callable[[bytes], None]):
        self.emit, self.root = emit, Node(None)
        self.root.refs = 1
        self.alive: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self._insertions()

    def turn(self, role: str, text: str, delete: bool, truncated: bool) -> None:
        """The next turn; ``delete``: it has to go."""
        found: list[tuple[int, Node, str, Line] | None] = [None] * 4
        extra = TRUNCATED if truncated else 0

        def offer(state: int, cost: int, node: Node, letter: str, line: Line) -> None:
            best = found[state]
            if best is None or cost < best[0] or cost == best[0] and self._before(node, letter, best[1], best[2]):
                found[state] = (cost, node, letter, line)

        for state, survivor in enumerate(self.alive):
            if survivor is None:
                continue
            cost, node = survivor
            offer(state, cost + DELETE, node, "D", None)
            if delete:
                continue
            to = ASSISTANT if state == USER else USER
            if role[:1] == NAMES[to][0]:
                offer(to, cost + extra, node, "K", (role, text))
            else:
                offer(to, cost + REROLE + extra, node, "R", (NAMES[to], text))
            if state == START and role[:1] == "s":
                offer(SYSTEM, cost + extra, node, "K", (role, text))
        uses = [f[1] for f in found if f]
        old = [s[1] for s in self.alive if s]
        grown = {}  # a leaf that goes on in one way grows; others fork
        for state, f in enumerate(found):
            if f and not (f[1].refs == 1 and uses.count(f[1]) == 1):
                grown[state] = Node(f[1]).put(f[2], f[3])
                grown[state].refs += 1
        for state, f in enumerate(found):
            if f and state not in grown:
                grown[state] = f[1].put(f[2], f[3])
                f[1].refs += 1
        self.alive = [f and (f[0], grown[state]) for state, f in enumerate(found)]
        for node in old:
            self._let_go(node)
        self._insertions()
        self._settle()

    def end(self) -> tuple[int, str]:
        """Emits what is left; the cost of all edits and the hash of the repaired turns."""
        ends = [s for s in (self.alive[START], self.alive[ASSISTANT]) if s]
        best = ends[0]
        for other in ends[1:]:
            if other[0] < best[0] or other[0] == best[0] and self._before(other[1], "", best[1], ""):
                best = other
        self.emit(b"".join(node.letters for node in self._below_root(best[1])))
        return best[0], best[1].digest.hexdigest()

    def _insertions(self) -> None:
        for state, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for source in sources:
                if self.alive[source] is None:
                    continue
                cost, node = self.alive[source]
                best = self.alive[state]
                if best is None or cost + INSERT < best[0] or cost + INSERT == best[0] and self._before(node, "I", best[1], ""):
                    new = Node(node).put("I", (NAMES[state], ""))
                    new.refs += 1
                    self.alive[state] = (cost + INSERT, new)
                    if best:
                        self._let_go(best[1])

    def _settle(self) -> None:
        """Drops survivors that another beats whatever follows; joins nodes without forks; emits what all survivors share."""
        costs = [s and s[0] for s in self.alive]
        for x, survivor in enumerate(self.alive):
            if survivor and any(c is not None and c + EXTRA[y][x] < survivor[0] for y, c in enumerate(costs)):
                self.alive[x] = None
                self._let_go(survivor[1])
        open_ = [self.root]
        while open_:
            node = open_.pop()
            while node.refs == 1 and node.forks:
                child = node.forks[0]
                node.letters += child.letters
                node.digest, node.empty, node.forks, node.refs = child.digest, child.empty, child.forks, child.refs
                for x in node.forks:
                    x.parent = node
                self.alive = [(s[0], node) if s and s[1] is child else s for s in self.alive]
            open_ += node.forks
        if self.root.letters:
            self.emit(bytes(self.root.letters))
            self.root.letters.clear()

    def _let_go(self, node: Node) -> None:
        node.refs -= 1
        while not node.refs and node is not self.root:
            node.parent.forks.remove(node)
            node = node.parent
            node.refs -= 1

    def _below_root(self, node: Node) -> list[Node]:
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        return path[::-1]

    def _before(self, a: Node, letter: str, b: Node, other: str) -> bool:
        """Whether the edits up to ``a`` and ``letter`` come before those up to ``b`` and ``other``."""
        x, y = self._below_root(a), self._below_root(b)
        while x and y and x[0] is y[0]:
            del x[0], y[0]
        return bytes(x[0].letters[:1] if x else letter.encode()) < bytes(y[0].letters[:1] if y else other.encode())


def prepare(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """A row for each distinct turn: conv_id, turn, role, text, n (how often it occurs), first (no earlier turn of the
    conversation has its role and text), blank, truncated.

    ``copies``: how often a row counts; a conversation all of whose rows count 0 is still known, by a row with n = 0.
    """
    n = F.lit(1) if copies is None else copies
    some = rows.select("conv_id", F.when(n > 0, F.col("turn")).alias("turn"), *[F.when(n > 0, F.coalesce(c, F.lit(" "))).otherwise("").alias(c) for c in ("role", "text")], n.cast("bigint").alias("n"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    keyed = some.select("*", name("conv_id").alias("ck"), F.when(F.col("n") > 0, name("turn")).otherwise("").alias("tk"), digest.alias("d"))
    distinct = keyed.groupBy("ck", "tk", "d").agg(*[F.first(c).alias(c) for c in ("conv_id", "turn", "role", "text")], F.sum("n").alias("n"))
    earliest = keyed.where("n > 0").groupBy("ck", "d").agg(F.min(F.struct("turn", "tk")).alias("t")).select("ck", F.col("t.tk").alias("tk"), "d", F.lit(True).alias("first"))
    end = let(F.rtrim(F.col("text"), F.lit(BLANKS)), lambda t: F.struct((t == "").alias("blank"), (~F.right(t, F.lit(1)).isin(".", "!", "?")).alias("truncated")))
    return distinct.join(earliest, ["ck", "tk", "d"], "left").select("conv_id", "turn", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"), end.alias("end")).select("conv_id", "turn", "role", "text", "n", "first", "end.*")


def _in_order(turns: DataFrame, *first: str) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text")


def _ids(turns: DataFrame) -> str:
    """The type of ids; all whole numbers become long."""
    return "string" if turns.schema["conv_id"].dataType.simpleString() == "string" else "bigint"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """``rows``, which are then forgotten."""
    columns = list(zip(*rows, strict=True))
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Report:
    """What ``prepare``'s rows of one conversation, given in order, have and lack."""

    def __init__(self, conv_id):
        self.conv_id, self.audit = conv_id, bytearray()
        self.search = Survivors(self.audit.extend)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool, blank: bool, truncated: bool) -> None:
        if n and turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        for _ in range(n):
            self.illegal += self.last is not None and self.last + role[:1] not in LEGAL
            self.last = role[:1]
            self.blank += blank
            self.duplicate += not blank and not first
            self.truncated += not blank and first and truncated
            self.search.turn(role, text, blank or not first, truncated)
            first = False

    def row(self) -> tuple:
        cost, repaired = self.search.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.audit.decode(), repaired


def digest(turns: DataFrame) -> DataFrame:
    """A row for each of ``prepare``'s conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    (the edits' letters) and repaired_sha256 (of ``role:text`` of the repaired turns, newline-joined)."""
    counts, ids = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), _ids(turns)
    schema = pa.schema([("conv_id", pa.string() if ids == "string" else pa.int64()), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, report = [], None
        for batch in batches:
            for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if report is None or report.conv_id != conv_id:
                    if report is not None:
                        done.append(report.row())
                    report = Report(conv_id)
                report.add(*row)
            if done:
                yield _batch(done, schema)
        if report is not None:
            yield _batch([report.row()], schema)

    sql = ", ".join([f"conv_id {ids}", *[f"{c} bigint" for c in counts], "audit string", "repaired_sha256 string"])
    return _in_order(turns).mapInArrow(run, sql)


def edits(turns: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """All edits of ``prepare``'s conversations: conv_id, place (from 0, in order), edit (a letter), and the role and text
    that it leaves (null for a deletion). ``found``: ``digest``'s rows for them, where they are at hand.

    Each conversation's audit goes ahead of its turns, so that these leave a task as they come.
    """
    ids = _ids(turns)
    schema = pa.schema([("conv_id", pa.string() if ids == "string" else pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    none = F.lit(None)
    audits = (digest(turns) if found is None else found).select("conv_id", none.cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(-1).cast("bigint").alias("n"))
    both = audits.unionByName(turns.select("conv_id", F.col("turn").cast("bigint"), "role", "text", "n")).withColumn("late", F.col("n") >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, audit, place, last = None, "", 0, "a"

        def upto_turn() -> None:
            """Insertions that come next."""
            nonlocal place, last
            while audit[place : place + 1] == "I":
                last = "a" if last == "u" else "u"
                out.append((conv, place, "I", "user" if last == "u" else "assistant", ""))
                place += 1

        for batch in batches:
            for conv_id, _, role, text, n, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if n < 0:
                    upto_turn()
                    conv, audit, place, last = conv_id, text, 0, "a"
                for _ in range(n):
                    upto_turn()
                    letter = audit[place]
                    if letter == "R":
                        role = "assistant" if last == "u" else "user"
                    if letter != "D":
                        last = role[:1]
                    out.append((conv, place, letter, *((None, None) if letter == "D" else (role, text))))
                    place += 1
            if out:
                yield _batch(out, schema)
        upto_turn()
        if out:
            yield _batch(out, schema)

    return _in_order(both, "late").mapInArrow(run, f"conv_id {ids}, place bigint, edit string, role string, text string")


def repair(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, place (in order), edit, role, text."""
    return edits(prepare(rows, copies)).where("edit != 'D'")


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with known faults, and how often each counts: by crc32(conv_id:turn) % 20, a row is dropped (0), emptied (1),
    loses its ends of sentences (2), is repeated (3) or gets the role user (4); nulls count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    faulty = rows.select(
        "conv_id",
        "turn",
        F.when(how == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"),
    )
    return faulty, F.col("copies")
