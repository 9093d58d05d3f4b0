"""Conversation structure repair with Four-Russians block tables.

A conversation's turns are edited at least cost until their roles read
``(system? (user assistant)+)?``: keep a turn (0), give it the role user or assistant
(3), delete it (4; blank and repeated turns must go), insert an empty user or
assistant turn (3); a truncated turn that stays costs 3 more. Of the cheapest edit
sequences, written K, R, D, I in order, the ASCII-least is taken.

A turn is one of nine symbols: first letter of the role (s, u, a, other), truncated or
not, or to be deleted. The cost to go from the four grammar states, less its
minimum, is one of a few vectors; a table gives for every block of ``BLOCK`` symbols and
every vector behind it the vector before it and the cost added. A conversation is
walked backwards by one lookup a block; the edits are then read forwards, each block
being expanded backwards from the vector behind it, so that ties are seen whole.

Faults and repeats are found by Spark on digests, rows equal in everything being counted
first. One shuffle brings a conversation together, its symbols before its texts: a
task holds one byte a turn, as the audit does, and streams the texts, whose digest
can only be taken in order.

Null roles and texts are one space; a null turn comes first, a null conversation is a
conversation. Turns of equal number are ordered by role, then by a digest of role and
text. A conversation without rows (``copies`` 0) has an empty audit. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import crc_of_text, table

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a. The state each letter leads to, and the next inserted letter's.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
LETTERS = "sua?"
#: Symbols: place in LETTERS, plus 4 if truncated; 8 must go.
GONE, SYMBOLS = 8, 9
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}


def closed(costs: list[float]) -> tuple:
    """Costs to go from the four states, with insertions allowed first."""
    user, assistant = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + user), min(costs[1], INSERT + user), user, assistant


END = closed([0, np.inf, np.inf, 0])


def options(symbol: int, state: int):
    """(edit, cost, state after it) of the edits that consume a symbol, in the order of their letters."""
    yield "D", DELETE, state
    if symbol != GONE:
        more = CUT_SHORT if symbol >= 4 else 0
        if (kept := STEPS[state].get(LETTERS[symbol % 4])) is not None:
            yield "K", KEEP + more, kept
        yield "R", REROLE + more, NEXT[state]


def before(symbol: int, after: tuple) -> tuple:
    """Costs to go before a symbol from those after it."""
    return closed([min(cost + after[to] for _, cost, to in options(symbol, state)) for state in range(4)])


class BlockTables:
    """``vectors``: all costs to go less their minimum; ``lookup[k][v, code]``: vector before and cost added by k + 1 symbols before vector v."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, place = block, [END], {END: 0}
        step, added = [], []
        for vector in self.vectors:  # grows while it is walked
            found = [before(symbol, vector) for symbol in range(SYMBOLS)]
            least = [min(f) for f in found]
            for f, m in zip(found, least):
                small = tuple(c - m for c in f)
                if small not in place:
                    place[small] = len(self.vectors)
                    self.vectors.append(small)
            step.append([place[tuple(c - m for c in f)] for f, m in zip(found, least)])
            added.append(least)
        one, cost = np.array(step), np.array(added, dtype=np.int64)
        self.lookup = [(one, cost)]
        for _ in range(block - 1):
            to, so_far = self.lookup[-1]  # of the symbols behind the first one
            self.lookup.append((one[to].transpose(0, 2, 1).reshape(len(one), -1), (so_far[:, :, None] + cost[to]).transpose(0, 2, 1).reshape(len(one), -1)))
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.known: dict = {}

    def expand(self, symbols, vector: int, state: int) -> tuple[str, int]:
        """Edits of a block, up to its last symbol, and the state after it."""
        costs = [self.vectors[vector]]
        for symbol in reversed(symbols):
            costs.append(before(symbol, costs[-1]))
        costs.reverse()
        edits, at = [], 0
        while at < len(symbols):
            choices = [(edit, cost + costs[at + 1][to], at + 1, to) for edit, cost, to in options(symbols[at], state)]
            choices.append(("I", INSERT + costs[at][NEXT[state]], at, NEXT[state]))
            edit, _, at, state = min(c for c in choices if c[1] == costs[at][state])
            edits.append(edit)
        return "".join(edits), state

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and ASCII-least edits of a conversation."""
        whole = len(symbols) // self.block * self.block
        codes = (np.frombuffer(symbols, np.uint8, whole).reshape(-1, self.block) @ self.weights).tolist()
        tail = list(symbols[whole:])
        vector, cost = 0, 0
        one, added = self.lookup[0]
        for symbol in reversed(tail):
            vector, cost = one[vector, symbol], cost + added[vector, symbol]
        behind = [int(vector)] * len(codes)
        jump, more = self.lookup[-1]
        for at in range(len(codes) - 1, -1, -1):
            behind[at] = int(vector)
            vector, cost = jump[vector, codes[at]], cost + more[vector, codes[at]]
        cost = int(cost + self.vectors[int(vector)][0])
        edits, state = [], 0
        for at, code in enumerate(codes):
            key = (code, behind[at], state)
            if key not in self.known:
                self.known[key] = self.expand(symbols[at * self.block:(at + 1) * self.block], behind[at], state)
            found, state = self.known[key]
            edits.append(found)
        found, state = self.expand(tail, 0, state)
        return cost, "".join([*edits, found, ("", "II", "I", "")[state]])


class Conversation:
    """What is known of one conversation while its rows pass by: all symbols first, then the texts in the same order."""

    def __init__(self, tables: BlockTables, conv_id, sink):
        self.tables, self.conv_id, self.sink = tables, conv_id, sink
        self.symbols, self.with_text = bytearray(), bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.letter = self.audit = self.text_key = None
        self.cost = self.at = self.edit = self.state = 0

    def symbol(self, turn, role, n: int, blank: bool, first: bool, cut_short: bool) -> None:
        """A row that stands ``n`` times in a row; ``first``: none like it came before."""
        letter = role[:1]
        self.illegal += (self.letter is not None and self.letter + letter not in _LEGAL) + (n - 1) * (letter * 2 not in _LEGAL)
        self.letter = letter
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        alone = not blank and first
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += first and cut_short
        place = LETTERS.find(letter) if letter and letter in "sua" else 3
        self.symbols.append(place + 4 * cut_short if alone else GONE)
        self.symbols.extend(bytes([GONE]) * (n - 1))
        self.with_text.append(not blank)
        self.with_text.extend(bytes(n - 1))

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = self.tables.solve(bytes(self.symbols))

    def text(self, key: tuple, role: str, text: str) -> None:
        """The next text; rows equal in everything come once among the symbols that have a text."""
        self.solve()
        if key != self.text_key:
            self.text_key = key
            self.replay(role, text)

    def replay(self, role=None, text=None) -> None:
        """Apply edits up to the next symbol with a text, or to the end."""
        while self.edit < len(self.audit):
            edit = self.audit[self.edit]
            self.edit += 1
            if edit == "I":
                self.state = NEXT[self.state]
                self.sink.turn(self, "user" if self.state == 2 else "assistant", "", edit)
                continue
            self.at += 1
            if self.with_text[self.at - 1]:
                if edit == "R":
                    self.state = NEXT[self.state]
                    self.sink.turn(self, "user" if self.state == 2 else "assistant", text, edit)
                elif edit == "K":
                    self.state = STEPS[self.state][role[0]]
                    self.sink.turn(self, role, text, edit)
                return

    def end(self) -> None:
        self.solve()
        self.replay()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        self.sink.end(self, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit))


class Summaries:
    """Sink: one row a conversation, with the digest of its repaired turns."""
    SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self):
        self.rows, self.hash, self.any = [], hashlib.sha256(), False

    def turn(self, conversation, role, text, edit):
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def end(self, conversation, known):
        self.rows.append((conversation.conv_id, *known, self.hash.hexdigest()))
        self.hash, self.any = hashlib.sha256(), False


class Turns:
    """Sink: one row a repaired turn."""
    SCHEMA = "at long, edit string, role string, text string"

    def __init__(self):
        self.rows, self.at = [], 0

    def turn(self, conversation, role, text, edit):
        self.rows.append((conversation.conv_id, self.at, edit, role, text))
        self.at += 1

    def end(self, conversation, known):
        self.at = 0


def dealt(rows: DataFrame) -> DataFrame:
    """Symbols and texts of all conversations, each conversation in one piece and in order.

    ``rows``: conv_id, turn, role, text, copies (how often the row stands there; 0: it only names its conversation).
    """
    whole = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    whole = whole.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))))
    bare = F.rtrim("text", F.lit(_SPACE))
    each = (whole.select("conv_id", "turn", "role", "digest", "copies", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*".!?")).alias("cut_short"))
            .groupBy("conv_id", "turn", "role", "digest")
            .agg(F.sum("copies").cast("long").alias("n"), F.max("blank").alias("blank"), F.max("cut_short").alias("cut_short")))
    # the first turn of each digest; the join is on the turn too, so that no frequent text gathers in a task
    firsts = (each.filter("n > 0").groupBy("conv_id", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))["turn"].alias("turn"))
              .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("turn").alias("t")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    symbols = each.join(firsts, same, "left").select("conv_id", F.lit(0).alias("pass"), "turn", "role", "digest", "n", "blank",
                                                     F.col("d").isNotNull().alias("first"), "cut_short", F.lit(None).cast("string").alias("text"))
    unknown = {c: F.lit(None) for c in ("n", "blank", "first", "cut_short")}
    texts = whole.filter((F.col("copies") > 0) & (bare != "")).withColumn("pass", F.lit(1)).withColumns(unknown).select(symbols.columns)
    return (symbols.unionByName(texts).repartition("conv_id")
            .sortWithinPartitions("conv_id", "pass", F.col("turn").asc_nulls_first(), "role", "digest"))


def walked(rows: DataFrame, sink) -> DataFrame:
    """What ``sink`` makes of the repaired conversations."""
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id"] + [c.strip().split(" ")[0] for c in sink.SCHEMA.split(",")]
    kinds = [c.strip().split(" ")[1] for c in sink.SCHEMA.split(",")]

    def run(batches):
        import pyarrow as pa
        arrow = {"long": pa.int64(), "string": pa.string()}
        tables, out, now, id_type = BlockTables(), sink(), None, pa.null()

        def made():
            columns = list(zip(*out.rows))
            out.rows = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, arrow[k]) for c, k in zip(columns[1:], kinds)]], names=names)
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv_id, step, turn, role, digest, n, blank, first, cut_short, text in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv_id != conv_id:
                    if now:
                        now.end()
                    now = Conversation(tables, conv_id, out)
                if step:
                    now.text((turn, digest), role, text)
                elif n:
                    now.symbol(turn, role, n, blank, first, cut_short)
            if out.rows:
                yield made()
        if now:
            now.end()
        if out.rows:
            yield made()
    return dealt(rows).mapInArrow(run, f"conv_id {kind}, {sink.SCHEMA}")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows``."""
    return walked(rows, Summaries)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, at (place in the repaired conversation), edit, role, text of every repaired turn."""
    return walked(rows, Turns)


def damaged(conversations: DataFrame) -> DataFrame:
    """Every twentieth row each dropped, emptied, stripped of ends of sentences, repeated, or given to the user."""
    space = F.lit(" ")
    named = F.concat(*[F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    kind, text = crc_of_text(named) % 20, F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_repair_conversations(spark, sf_dir):
    return audits(damaged(table(spark, sf_dir, "conversations")))


QUERIES, CHECKS = {"op11_repair_conversations": op11_repair_conversations}, {}
