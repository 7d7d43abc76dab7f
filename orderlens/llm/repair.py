"""Least-cost repair of conversation structure by min-plus matrices over a Re-Pair grammar."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .base import stored
from .grammar import fold_rest, re_pair

VISIBLE = r"[^\x20\x09-\x0D]"
FINISHED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows end in so far
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
DROP = 0  # symbol of a row that has to go; others: 1 + 2 * kind of role + truncated
KINDS = {"s": 0, "u": 1, "a": 2}
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
GROUP_SEGMENTS, GROUP_CHARS = 2000, 4 << 20


def _symbol_matrix(symbol: int) -> tuple[list[int], list[str | None]]:
    """Cheapest cost and edits from state to state over one row: inserts before it, then an edit of it."""
    best: list[tuple] = [(FAR, "")] * 16
    kind, cut = ((symbol - 1) // 2, (symbol - 1) % 2 * TRUNCATED) if symbol else (None, 0)
    for begin in range(4):
        state, cost, edits = begin, 0, ""
        for _ in range(4):
            moves = [(state, cost + DELETE, edits + "D")]
            if symbol:
                moves.append((NEXT[state], cost + REROLE + cut, edits + "R"))
                kept = LEGAL.get("sua-"[kind], {}).get(state)
                if kept is not None:
                    moves.append((kept, cost + KEEP + cut, edits + "K"))
            for end, total, text in moves:
                best[4 * begin + end] = min(best[4 * begin + end], (total, text))
            state, cost, edits = NEXT[state], cost + INSERT, edits + "I"
    return [c for c, _ in best], [t if c < FAR else None for c, t in best]


BASE = [_symbol_matrix(s) for s in range(9)]
BASE_COST = np.array([c for c, _ in BASE]).reshape(9, 4, 4)
# what is inserted after the last row, by state, to end in nothing or an assistant's row
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _ranks(order: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(order, axis=-1, kind="stable"), axis=-1, kind="stable")


BASE_RANK = _ranks(np.array([[4 if t is None else sorted(x for x in texts[4 * p:4 * p + 4] if x is not None).index(t)
                              for t in texts[4 * p:4 * p + 4]] for _, texts in BASE for p in range(4)]).reshape(9, 4, 4))


class Matrices:
    """Transfer matrices of sequences of row symbols, one product per grammar rule.

    An entry is the least cost from state to state, with the ASCII-least edits of that cost. Edits
    are kept as ropes: the two factors' entries. Of edits that leave one state over the same rows none
    is the beginning of another, so ties are settled by the rank of the left factor's entry, then of
    the right factor's; no texts are compared.
    """

    def __init__(self, sequences: list[bytes]):
        codes = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64) - 48
        owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        grammar = re_pair(codes, owner)
        shift = len(BASE) - grammar.first  # rules are numbered behind all base symbols
        def own(symbols):
            return np.where(symbols < grammar.first, symbols, symbols + shift)
        self.cost, self.rank = BASE_COST, BASE_RANK
        self.left = self.right = np.zeros(len(BASE), np.int64)
        self.via = np.zeros(BASE_COST.shape, np.int64)
        left, right = own(grammar.left), own(grammar.right)
        for low, high in zip(grammar.rounds[:-1], grammar.rounds[1:]):
            self._extend(left[low:high], right[low:high])
        symbols, owners = own(grammar.symbols), grammar.owner
        for i, j, _, _, _, keep in fold_rest(grammar):
            made = len(self.left) + np.arange(len(i))
            self._extend(symbols[i], symbols[j])
            symbols = symbols.copy()
            symbols[i] = made
            symbols, owners = symbols[keep], owners[keep]
        self.root = dict(zip(owners.tolist(), symbols.tolist()))  # an empty sequence has none
        self.texts: dict[tuple, str | None] = {}

    def _extend(self, left: np.ndarray, right: np.ndarray) -> None:
        total = self.cost[left][:, :, :, None] + self.cost[right][:, None, :, :]
        via = np.argmin(total * 4 + self.rank[left][:, :, :, None], axis=2)
        cost = np.minimum(np.take_along_axis(total, via[:, :, None, :], axis=2)[:, :, 0, :], FAR)
        order = np.take_along_axis(self.rank[left], via, axis=2) * 4
        order += self.rank[right[:, None, None], via, np.arange(4)[None, None, :]]
        order[cost >= FAR] = 99
        self.cost = np.concatenate([self.cost, cost])
        self.rank = np.concatenate([self.rank, _ranks(order)])
        self.via = np.concatenate([self.via, via])
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])

    def edits(self, node: int, begin: int, end: int) -> str | None:
        """The rope of an entry as text; shared parts are written out once."""
        if self.cost[node, begin, end] >= FAR:
            return None
        if node < len(BASE):
            return BASE[node][1][4 * begin + end]
        key = (node, begin, end)
        if key not in self.texts:
            via = int(self.via[node, begin, end])
            self.texts[key] = self.edits(int(self.left[node]), begin, via) + self.edits(int(self.right[node]), via, end)
        return self.texts[key]


def _lines(edits: str, state: int, symbols: str, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows that `edits` make, begun in `state`."""
    out, row, given = [], 0, 0
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append(NAMES[state] + ":")
            continue
        if symbols[row] != "0":
            if edit == "R":
                state = NEXT[state]
                out.append(f"{NAMES[state]}:{texts[given]}")
            elif edit == "K":
                state = LEGAL[roles[given][:1]][state]
                out.append(f"{roles[given]}:{texts[given]}")
            given += 1
        row += 1
    return out


class _Segment:
    __slots__ = ("conv", "seg", "whole", "symbols", "roles", "texts", "chars", "n", "blank", "duplicate",
                 "truncated", "illegal", "first", "last", "low", "high", "turns", "turn")

    def __init__(self, conv, seg):
        self.conv, self.seg, self.whole = conv, seg, False
        self.symbols, self.roles, self.texts, self.chars, self.n = bytearray(), [], [], 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, initial, copies):
        """`copies` rows of one turn and role."""
        if self.n:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += copies - 1  # a role's initial never follows itself
        self.last = initial
        self.n += copies
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn


COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "turns"]


def _segment_type(conv: T.DataType, turn: T.DataType) -> T.StructType:
    text = T.ArrayType(T.StringType())
    return T.StructType([
        T.StructField("conv_id", conv), T.StructField("part", T.IntegerType()), T.StructField("seg", T.LongType()),
        T.StructField("whole", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
        T.StructField("low", turn), T.StructField("high", turn),
        T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("ranks", T.ArrayType(T.IntegerType())),
        T.StructField("edits", text), T.StructField("symbols", T.StringType()),
        T.StructField("roles", text), T.StructField("texts", text),
        T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType())])


IDENTITY = [0 if i % 5 == 0 else FAR for i in range(16)]


def _finish(group: list[_Segment], part: int, schema: pa.Schema) -> pa.RecordBatch:
    sequences: dict[bytes, int] = {}
    for s in group:
        if s.symbols:
            sequences.setdefault(bytes(s.symbols), len(sequences))
    matrices = Matrices(list(sequences)) if sequences else None
    solved: dict[bytes, tuple] = {}
    for symbols, at in sequences.items():
        node = matrices.root[at]
        costs = matrices.cost[node].ravel().tolist()
        end = min((c + INSERT * len(CLOSING[q]), matrices.rank[node, START, q], q) for q, c in enumerate(costs[:4]))[2]
        solved[symbols] = (node, costs, costs[end] + INSERT * len(CLOSING[end]),
                           matrices.edits(node, START, end) + CLOSING[end])
    rows = []
    for s in group:
        key = bytes(s.symbols)
        node, costs, cost, audit = solved[key] if key else (None, IDENTITY, 0, "")
        head = (s.conv, part, s.seg, s.whole, *[getattr(s, c) for c in COUNTS], s.first, s.last, s.low, s.high)
        symbols = key.decode()
        if s.whole:
            repaired = "\n".join(_lines(audit, START, symbols, s.roles, s.texts))
            rows.append((*head, None, None, None, None, None, None, cost, audit,
                         hashlib.sha256(repaired.encode()).hexdigest()))
        else:
            edits = ["" if not key and c < FAR else matrices.edits(node, i // 4, i % 4) if key else None
                     for i, c in enumerate(costs)]
            ranks = matrices.rank[node].ravel().tolist() if key else [0] * 16
            rows.append((*head, costs, ranks, edits, symbols, s.roles, s.texts, None, None, None))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _segments(schema: pa.Schema):
    """Ordered rows to segments; conversations that begin and end inside a partition are solved at once."""
    def run(batches):
        part = TaskContext.get().partitionId()
        group: list[_Segment] = []
        chars, seg, current, opened, before = 0, 0, None, False, None
        for batch in batches:
            for conv, turn, role, text, key, copies, blank, cut, later in zip(*[c.to_pylist() for c in batch.columns]):
                if current is None or conv != current.conv:
                    if current is not None:
                        current.whole = opened  # one segment, and another conversation on each side
                        opened = True
                        group.append(current)
                        chars += current.chars
                        if len(group) >= GROUP_SEGMENTS or chars >= GROUP_CHARS:
                            yield _finish(group, part, schema)
                            group, chars = [], 0
                    current, seg, before = _Segment(conv, seg), seg + 1, None
                elif len(current.symbols) >= SEGMENT_ROWS or current.chars >= SEGMENT_CHARS:
                    group.append(current)
                    chars += current.chars
                    if chars >= GROUP_CHARS:
                        yield _finish(group, part, schema)
                        group, chars = [], 0
                    current, seg, opened = _Segment(conv, seg), seg + 1, False
                if not copies:
                    continue
                initial = role[:1]
                repeats = (turn, role, key) == before
                before = (turn, role, key)
                while copies > 0:
                    now = min(copies, SEGMENT_ROWS)
                    if len(current.symbols) + now > 2 * SEGMENT_ROWS:
                        group.append(current)
                        current, seg, opened = _Segment(conv, seg), seg + 1, False
                    current.add(turn, initial, now)
                    copies -= now
                    if blank:
                        current.blank += now
                    elif later or repeats:
                        current.duplicate += now
                    else:
                        current.symbols.append(49 + 2 * KINDS.get(initial, 3) + cut)
                        current.truncated += cut
                        current.roles.append(role)
                        current.texts.append(text)
                        current.chars += len(text)
                        now -= 1
                        current.duplicate += now
                        repeats = True
                    current.symbols.extend(b"0" * now)
        if current is not None:
            group.append(current)
        if group:
            yield _finish(group, part, schema)
    return run


def _chain(schema: pa.Schema):
    """The cheapest way through the segments of each conversation, ties by the ranks of their edits."""
    def run(batches):
        for batch in batches:
            rows = []
            for conv, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist()):
                ahead = [[INSERT * len(CLOSING[q]) for q in range(4)]]
                for s in reversed(parts):
                    ahead.append([min(s["costs"][4 * p + q] + ahead[-1][q] for q in range(4)) for p in range(4)])
                ahead.reverse()
                state, steps = START, []
                for k, s in enumerate(parts):
                    end = min(range(4), key=lambda q: (s["costs"][4 * state + q] + ahead[k + 1][q], s["ranks"][4 * state + q]))
                    steps.append({"part": s["part"], "seg": s["seg"], "begin": state, "end": end, "tail": ""})
                    state = end
                steps[-1]["tail"] = CLOSING[state]
                total = {c: sum(s[c] for s in parts) for c in COUNTS}
                turned = [s for s in parts if s["low"] is not None]
                spoken = [s for s in parts if s["n"]]
                for a, b in zip(turned, turned[1:]):
                    total["turns"] -= a["high"] == b["low"]
                for a, b in zip(spoken, spoken[1:]):
                    total["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
                rows.append((conv, *[total[c] for c in COUNTS], turned[0]["low"] if turned else None,
                             turned[-1]["high"] if turned else None, ahead[0][START], steps))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _digest(schema: pa.Schema):
    """Edits and digest of conversations whose segments arrive in order, one piece at a time."""
    def run(batches):
        conv, digest, edits, any_line = None, None, [], False
        def done():
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (conv, "".join(edits), digest.hexdigest()), schema)], schema=schema)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in
                       ("conv_id", "begin", "end", "edit", "tail", "symbols", "roles", "texts")]
            for key, begin, end, edit, tail, symbols, roles, texts in zip(*columns):
                if digest is None or key != conv:
                    if digest is not None:
                        yield done()
                    conv, digest, edits, any_line = key, hashlib.sha256(), [], False
                lines = [*_lines(edit, begin, symbols, roles, texts), *_lines(tail, end, "", [], [])]
                edits.extend((edit, tail))
                if lines:
                    digest.update(("\n" if any_line else "").encode() + "\n".join(lines).encode())
                    any_line = True
        if digest is not None:
            yield done()
    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _combine(schema: pa.Schema):
    """Equal rows of a batch become one with their number of copies, before anything is shuffled."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = [c for c in batch.schema.names if c != "copies"]
                made = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("copies", "sum")])
                made = made.rename_columns([c.removesuffix("_sum") for c in made.schema.names])
                yield from made.select(schema.names).cast(schema).to_batches()
    return run


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """One row per conversation: gaps, faults by kind, illegal neighbours and the cheapest repair.

    Rows are taken by turn (nulls first; rows of one turn by role, then by a hash of the text). A row's
    first fault counts: `blank` (nothing visible), `duplicate` (role and text seen earlier in the
    conversation), `truncated` (its last visible character is none of `.!?`). Edits: Keep 0, Rerole to
    user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert an empty user or
    assistant row 5; a truncated row that stays adds 5. `audit` holds the initials, in order, of the
    cheapest edits whose rows have role initials `(s?(ua)+)?` (ties: the ASCII-least), `cost` their
    cost, `repaired_sha256` the digest of the repaired `role:text` lines. `gaps` are turn numbers missing
    between the first and the last, `illegal` neighbouring rows whose initials are not su, ua or au.

    `copies_col` may give how often a row stands there; a row with 0 copies only names its conversation.

    Equal rows are merged before the shuffle. Rows are sorted by range, so a conversation that holds a
    third of them is spread over tasks, in segments of a few thousand rows; each segment becomes a 4 x 4
    matrix and only matrices meet per conversation. Texts move once; those of a conversation that
    crosses a range border move again to its digest, piece by piece in one task (a digest has no parallel
    form) without being held.

    Defined cases: null roles and texts are one space (a blank row, whose role is illegal); an empty role
    is illegal too; null turns are no gap; a null conversation id is a conversation; repeated rows are
    duplicates; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"),
        (F.col(copies_col) if copies_col else F.lit(1)).cast("long").alias("copies"))
    rows = rows.withColumn("key", F.md5("text"))
    ends = rows.filter("copies > 0").groupBy("conv_id", "role", "key").agg(
        F.min(F.struct("turn")).alias("low"), F.max(F.struct("turn")).alias("high"))
    again = stored(ends.filter(~F.col("low").eqNullSafe(F.col("high"))).select("conv_id", "role", "key", "low"), "repeats")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "low")
    found = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                      & (F.col("key") == F.col("k")), "left")
    marked = found.select(
        "conv_id", "turn", "role", "text", "key", "copies", (~F.col("text").rlike(VISIBLE)).alias("blank"),
        (~F.col("text").rlike(FINISHED)).cast("int").alias("cut"),
        (F.col("low").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("low"))).alias("later"))
    kinds = _segment_type(rows.schema["conv_id"].dataType, rows.schema["turn"].dataType)
    order = ["conv_id", "turn", "role", "key"]
    merged = marked.mapInArrow(_combine(_arrow(marked.schema)), marked.schema)
    segments = stored(merged.repartitionByRange(*order).sortWithinPartitions(*order)
                      .mapInArrow(_segments(_arrow(kinds)), kinds), "segments")
    whole = segments.filter("whole").select("conv_id", *COUNTS, "low", "high", "cost", "audit", "repaired_sha256")

    split = segments.filter("not whole")
    chained = T.StructType([kinds["conv_id"], *[kinds[c] for c in COUNTS], kinds["low"], kinds["high"], kinds["cost"],
                            T.StructField("steps", T.ArrayType(T.StructType([
                                kinds["part"], kinds["seg"], T.StructField("begin", T.IntegerType()),
                                T.StructField("end", T.IntegerType()), T.StructField("tail", T.StringType())])))])
    slim = F.struct("part", "seg", *COUNTS, "first", "last", "low", "high", "costs", "ranks")
    chain = stored(split.groupBy("conv_id").agg(F.sort_array(F.collect_list(slim)).alias("parts"))
                   .mapInArrow(_chain(_arrow(chained)), chained), "chains")
    steps = chain.select(F.explode("steps").alias("step")).select("step.*")
    pieces = split.select("conv_id", "part", "seg", "edits", "symbols", "roles", "texts").join(steps, ["part", "seg"])
    pieces = pieces.select("conv_id", "part", "seg", "begin", "end", "tail", "symbols", "roles", "texts",
                           F.get("edits", 4 * F.col("begin") + F.col("end")).alias("edit"))
    digests = T.StructType([T.StructField("k", kinds["conv_id"].dataType), kinds["audit"], kinds["repaired_sha256"]])
    texts = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg") \
        .mapInArrow(_digest(_arrow(digests)), digests)
    joined = chain.join(texts, F.col("conv_id").eqNullSafe(F.col("k"))).select(*whole.columns)
    both = whole.unionByName(joined)
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    return both.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                       "cost", "audit", "repaired_sha256")
