"""Conversation structure repair: the cheapest edits that make a conversation a system turn, if any, and pairs of user and assistant.

Rows are dealt by conversation, sorted by turn (nulls first, then role and text, so that equal rows are neighbours) and streamed to NumPy.
There, conversations are bucketed by length into tensors with time as the first axis; costs of the four states (start, after
system, after user, after assistant) go backward turn by turn for all conversations of a bucket at once and are kept, and the edits are
traced forward in the same way, the ASCII-least letter first. An edit's letter fixes the next state, so that is the least string.

A conversation of more than LONG rows doesn't pass one task: its rows are numbered in ranges that are sorted apart and cut into segments. A segment's
cheapest costs between any two states are a 4 x 4 matrix; chained backward these give the costs behind each segment, and the segments' state
maps, chained forward, the state before it. Then segments are traced like whole conversations. The first place of each (role, text) comes
from an aggregation. Only matrices (16 numbers for 4,096 rows) of one conversation meet.

Null roles and texts are one space. Rows without conv_id are one conversation. Repeated rows are turns seen before. Roles count by their
first character; an empty one fits nothing. Empty texts are blank. A conversation without rows has no result from `repair`; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessera.llm.common import stored
from tessera.operators.resolve import dense_numbers

LONG, SEGMENT, BUFFER = 1000, 4096, 20000
RUN = 4096
_NONE = np.int64(1 << 40)
#: State after a turn of role system, user, assistant, other; 4: not allowed. States: start, after system, user, assistant.
_STEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: State after a rerole or an insertion, which have one role each that fits.
_NEXT = np.array([2, 2, 3, 2])
_END = np.array([0, 10, 5, 0], np.int64)
_D, _K, _I, _R = (ord(x) for x in "DKIR")
#: Codes of edits; the second of I and R makes an assistant's turn.
_LETTERS = bytes.maketrans(b"JS", b"IR")

PIECE = (
    "seg long, audit string, turns array<struct<role string, text string>>, cost long, blank long, duplicate long, truncated long, illegal long, "
    "distinct_turns long, min_turn long, max_turn long, first string, last string"
)


def backward(role: np.ndarray, must: np.ndarray, cut: np.ndarray, valid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (time + 1, conversations, state) of the cheapest edits from each place to the end, where they are `end`."""
    costs = np.empty((len(role) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(role) - 1, -1, -1):
        after = costs[t + 1]
        late = 5 * cut[t][:, None]
        keep = np.take_along_axis(np.pad(after, ((0, 0), (0, 1)), constant_values=_NONE), _STEP[role[t]], 1) + late
        best = np.minimum(keep, after[:, _NEXT] + 1 + late)
        best[must[t]] = _NONE
        best = np.minimum(best, after + 2)
        best = np.minimum(best, np.minimum(best[:, _NEXT] + 5, best[:, _NEXT[_NEXT]] + 10))
        costs[t] = np.where(valid[t][:, None], np.minimum(best, _NONE), after)
    return costs


def forward(costs: np.ndarray, role: np.ndarray, must: np.ndarray, cut: np.ndarray, valid: np.ndarray, state: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits (time + 1, 3, conversations) along the cheapest way from `state`, and the states at the end. At each time: up to two insertions, then the row's edit."""
    n, every = len(role), np.arange(len(state))
    edits = np.zeros((n + 1, 3, len(state)), np.uint8)
    for t in range(n + 1):
        live = valid[t] if t < n else final
        after = costs[t + 1] if t < n else None
        for k in (0, 1):
            here = costs[t][every, state]
            put = live & (costs[t][every, _NEXT[state]] + 5 == here)
            if t < n:
                put &= after[every, state] + 2 != here
            edits[t, k, put] = (_NEXT[state] - 2 + _I)[put]
            state = np.where(put, _NEXT[state], state)
        if t == n:
            break
        here, step = costs[t][every, state], _STEP[role[t], state]
        kept = np.where(step < 4, after[every, np.minimum(step, 3)], _NONE) + 5 * cut[t]
        drop, keep = after[every, state] + 2 == here, (kept == here) & ~must[t]
        edits[t, 2] = np.where(live, np.where(drop, _D, np.where(keep, _K, _NEXT[state] - 2 + _R)), 0)
        state = np.where(live & ~drop, np.where(keep, np.minimum(step, 3), _NEXT[state]), state)
    return edits, state


def _width(n: int) -> int:
    return n if n <= 32 else 1 << (n - 1).bit_length()


class _Rows:
    """Sorted rows of some whole groups (conv_id, seg), copies spelt out, as arrays; seen: whether a row's first copy occurred before."""

    def __init__(self, rows: dict[str, list]):
        m = np.array(rows["m"], np.int64)
        self.of = np.repeat(np.arange(len(m)), m)
        head = np.ones(len(self.of), bool)
        head[1:] = self.of[1:] != self.of[:-1]
        group = np.array(rows["group"], np.int64)
        blank, seen = np.array(rows["blank"], bool), self._seen(rows, group)
        self.role = np.array(rows["kind"], np.int64)[self.of]
        self.blank = blank[self.of]
        self.duplicate = ~self.blank & (seen[self.of] | ~head)
        self.cut = ~self.blank & ~self.duplicate & np.array(rows["cut"], bool)[self.of]
        self.must = self.blank | self.duplicate
        self.begin = np.flatnonzero(np.diff(group[self.of], prepend=-1))
        self.size = np.diff(self.begin, append=len(self.of))

    @staticmethod
    def _seen(rows: dict[str, list], group: np.ndarray) -> np.ndarray:
        if rows["seen"][0] is not None:
            return np.array(rows["seen"], bool)
        known: set = set()
        out = np.zeros(len(group), bool)
        for i, key in enumerate(zip(rows["group"], rows["role"], rows["text"])):
            out[i] = key in known
            known.add(key)
        return out

    def buckets(self) -> Iterator[tuple[np.ndarray, tuple]]:
        """Groups of like length, and their (time, group) arrays role, must, cut, valid."""
        widths = np.array([_width(int(n)) for n in self.size])
        for width in np.unique(widths):
            groups = np.flatnonzero(widths == width)
            time = np.arange(width)[:, None]
            valid = time < self.size[groups]
            at = np.where(valid, self.begin[groups] + time, 0)
            yield groups, (self.role[at], self.must[at] & valid, self.cut[at] & valid, valid)


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[tuple], dict[str, list]]]:
    """Whole groups of a sorted stream: keys (conv_id, seg) and the rows' columns, with `group`, a number from 0. About BUFFER rows, or the bytes that come in a batch, are held."""
    keys: list[tuple] = []
    rows: dict[str, list] = {c: [] for c in [*columns, "group"]}
    for batch in batches:
        data = [batch.column(c).to_pylist() for c in columns]
        named = list(zip(batch.column("conv_id").to_pylist(), batch.column("seg").to_pylist()))
        for i, key in enumerate(named):
            if not keys or keys[-1] != key:
                if len(rows["group"]) >= BUFFER:
                    yield keys, rows
                    keys, rows = [], {c: [] for c in [*columns, "group"]}
                keys.append(key)
            for c, values in zip(columns, data):
                rows[c].append(values[i])
            rows["group"].append(len(keys) - 1)
    if keys:
        yield keys, rows


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest costs of each segment from any state (rows) to any other (columns)."""
    for keys, rows in _grouped(batches, ["kind", "blank", "cut", "m", "seen"]):
        found = _Rows(rows)
        out = np.empty((len(keys), 4, 4), np.int64)
        for groups, tensors in found.buckets():
            for e in range(4):
                end = np.full((len(groups), 4), _NONE)
                end[:, e] = 0
                out[groups, :, e] = backward(*tensors, end)[0]
        conv, seg = zip(*keys)
        yield pa.RecordBatch.from_pydict({"conv_id": list(conv), "seg": list(seg), "matrix": out.reshape(len(keys), 16).tolist()})


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state that each segment's cheapest way ends in, for each state before it."""
    for keys, rows in _grouped(batches, ["kind", "blank", "cut", "m", "seen", "end"]):
        found = _Rows(rows)
        out = np.empty((len(keys), 4), np.int64)
        for groups, tensors in found.buckets():
            first = np.searchsorted(np.array(rows["group"]), groups)
            costs = backward(*tensors, np.array([rows["end"][i] for i in first], np.int64))
            for s in range(4):
                out[groups, s] = forward(costs, *tensors, np.full(len(groups), s), np.zeros(len(groups), bool))[1]
        conv, seg = zip(*keys)
        yield pa.RecordBatch.from_pydict({"conv_id": list(conv), "seg": list(seg), "map": out.tolist()})


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces: edits, turns that stay and counts of each group."""
    columns = ["turn", "role", "text", "kind", "blank", "cut", "m", "seen", "end", "state"]
    for keys, rows in _grouped(batches, columns):
        found = _Rows(rows)
        first = np.searchsorted(np.array(rows["group"]), np.arange(len(keys)))
        out: list = [None] * len(keys)
        for groups, tensors in found.buckets():
            final = np.array([rows["end"][i] is None for i in first[groups]])
            end = np.array([rows["end"][i] or _END for i in first[groups]], np.int64)
            state = np.array([rows["state"][i] or 0 for i in first[groups]])
            costs = backward(*tensors, end)
            edits, last = forward(costs, *tensors, state, final)
            every = np.arange(len(groups))
            behind = np.where(final, 0, end[every, last])
            for j, g in enumerate(groups):
                out[g] = _piece(found, rows, g, edits[:, :, j].ravel(), int(costs[0, j, state[j]] - behind[j]))
        conv, _ = zip(*keys)
        yield pa.RecordBatch.from_pylist([{"conv_id": c, "seg": key[1]} | o for c, key, o in zip(conv, keys, out)])


def _piece(found: _Rows, rows: dict[str, list], g: int, edits: np.ndarray, cost: int) -> dict:
    a, b = found.begin[g], found.begin[g] + found.size[g]
    letters, turns, i = edits[edits > 0].tobytes(), [], a
    for x in letters:
        if x in b"IJ":
            turns.append({"role": "user" if x == _I else "assistant", "text": ""})
            continue
        at = found.of[i]
        i += 1
        if x != _D:
            turns.append({"role": rows["role"][at] if x == _K else "user" if x == _R else "assistant", "text": rows["text"][at]})
    role, on = found.role[a:b], [t for t in rows["turn"][found.of[a] : found.of[b - 1] + 1] if t is not None]
    fits = ((role[1:] == 1) & (role[:-1] != 1) & (role[:-1] != 3)) | ((role[1:] == 2) & (role[:-1] == 1))
    return {
        "audit": letters.translate(_LETTERS).decode(), "turns": turns, "cost": cost, "blank": int(found.blank[a:b].sum()), "duplicate": int(found.duplicate[a:b].sum()),
        "truncated": int(found.cut[a:b].sum()), "illegal": int((~fits).sum()), "distinct_turns": len(set(on)), "min_turn": min(on, default=None), "max_turn": max(on, default=None),
        "first": "suax"[role[0]], "last": "suax"[role[-1]],
    }


def _arrow(rows: DataFrame, work, schema: str) -> DataFrame:
    """work over rows dealt by group and sorted within it."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    full = f"conv_id {kind}, {schema}"
    target = pa.schema([(f.name, _pa(f.dataType)) for f in rows.sparkSession.createDataFrame([], full).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            yield pa.RecordBatch.from_pylist(out.to_pylist(), schema=target) if out.schema != target else out

    return rows.mapInArrow(run, full)


def _pa(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _coded(rows: DataFrame) -> DataFrame:
    """rows with kind (0 to 3 by the role's first character), blank and cut."""
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return rows.withColumns({"kind": kind, "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})


def _chained(pairs: DataFrame, value: str, work, out: str) -> DataFrame:
    """work over each conversation's sorted (seg, value); segments of one conversation meet as small arrays."""
    lists = pairs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", value))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, each in zip(batch.column("conv_id").to_pylist(), batch.column("all").to_pylist()):
                got = work([x[value] for x in each])
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "seg": x["seg"], **g} for x, g in zip(each, got)])

    return _arrow(lists, run, out)


def _ends(matrices: list[list[int]]) -> list[dict]:
    """The costs behind each segment; null behind the last."""
    out, behind = [], None
    for m in reversed(matrices):
        out.append({"end": None if behind is None else behind.tolist()})
        behind = np.minimum((np.array(m, np.int64).reshape(4, 4) + (_END if behind is None else behind)).min(axis=1), _NONE)
    return out[::-1]


def _states(maps: list[list[int]]) -> list[dict]:
    """The state before each segment."""
    out, state = [], 0
    for m in maps:
        out.append({"state": state})
        state = m[state]
    return out


def _segmented(rows: DataFrame, segment: int) -> DataFrame:
    """Rows of long conversations with seg, m, seen, end and state."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN))).alias("chunk")
    run = same.select("conv_id", "turn", "role", "text", "copies", chunks).withColumn("m", F.least(F.lit(RUN), F.col("copies") - F.col("chunk") * RUN)).drop("copies")
    numbered = dense_numbers(run, ["conv_id", "turn", "role", "text", "chunk"], "place").withColumn("seg", F.floor(F.col("place") / segment))
    numbered = numbered.withColumn("key", F.unhex(F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)))
    numbered = stored(_coded(numbered), "numbered")
    first = numbered.groupBy("conv_id", "key").agg(F.min("place").alias("earliest"))
    here = numbered.alias("n").join(first.alias("f"), F.expr("n.conv_id <=> f.conv_id AND n.key = f.key")).select("n.*", (F.col("place") > F.col("earliest")).alias("seen"))
    here = stored(here.drop("key", "chunk"), "seen")
    codes = _dealt(here.select("conv_id", "seg", "place", "kind", "blank", "cut", "m", "seen"))
    ends = stored(_chained(_arrow(codes, _matrices, "seg long, matrix array<long>"), "matrix", _ends, "seg long, end array<long>"), "ends")
    with_end = _with(here, ends, "end")
    maps = _arrow(_dealt(with_end.select("conv_id", "seg", "place", "kind", "blank", "cut", "m", "seen", F.coalesce("end", F.array(*[F.lit(int(x)).cast("long") for x in _END])).alias("end"))), _maps, "seg long, map array<long>")
    states = stored(_chained(maps, "map", _states, "seg long, state int"), "states")
    return _with(with_end, states, "state")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "place")


def _with(rows: DataFrame, small: DataFrame, name: str) -> DataFrame:
    return rows.alias("r").join(small.alias("s"), F.expr("r.conv_id <=> s.conv_id AND r.seg = s.seg")).select("r.*", f"s.{name}")


def repair(rows: DataFrame, *, long: int = LONG, segment: int = SEGMENT) -> DataFrame:
    """The repaired pieces of every conversation of rows (conv_id, turn, role, text and, if there, copies: how often a row stands there).

    A piece has conv_id, n_pieces, seg (its place), the edits (audit), the turns that stay, their cost, and counts of the rows before the edits;
    a conversation of at most `long` rows is one piece."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    many = stored(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > long).select("conv_id"), "long")
    some = not many.isEmpty()
    apart = lambda how: rows.alias("a").join(many.alias("b"), F.expr("a.conv_id <=> b.conv_id"), how) if some else rows
    short = _coded(apart("left_anti")).withColumnRenamed("copies", "m").withColumns(
        {"seg": F.lit(0).cast("long"), "seen": F.lit(None).cast("boolean"), "end": F.lit(None).cast("array<long>"), "state": F.lit(None).cast("int")}
    )
    pieces = _arrow(short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), _solved, PIECE).withColumn("n_pieces", F.lit(1).cast("long"))
    if some:
        cut = stored(_arrow(_dealt(_segmented(apart("left_semi"), segment)), _solved, PIECE), "pieces")
        n = cut.groupBy("conv_id").agg(F.count("*").alias("n_pieces"))
        pieces = pieces.unionByName(cut.alias("p").join(n.alias("n"), F.expr("p.conv_id <=> n.conv_id")).select("p.*", "n.n_pieces"))
    return pieces


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of long conversations in order, put together: texts pass by the hash one piece at a time."""
    now, conv = None, None

    def done() -> pa.RecordBatch:
        low, high, n = now["range"]
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "gaps": 0 if low is None else high - low + 1 - n, **now["sums"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}])

    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            if now is None or p["conv_id"] != conv:
                if now is not None:
                    yield done()
                conv = p["conv_id"]
                now = {"range": (None, None, 0), "sums": dict.fromkeys(["blank", "duplicate", "truncated", "illegal", "cost"], 0), "audit": [], "hash": hashlib.sha256(), "last": None, "any": False}
            for k in now["sums"]:
                now["sums"][k] += p[k]
            if now["last"] is not None and now["last"] + p["first"] not in ("su", "ua", "au"):
                now["sums"]["illegal"] += 1
            low, high, n = now["range"]
            if p["min_turn"] is not None:
                now["range"] = (p["min_turn"] if low is None else low, p["max_turn"], n + p["distinct_turns"] - (high is not None and high == p["min_turn"]))
            now["last"] = p["last"]
            now["audit"].append(p["audit"])
            for t in p["turns"]:
                now["hash"].update(f"{chr(10) if now['any'] else ''}{t['role']}:{t['text']}".encode())
                now["any"] = True
    if now is not None:
        yield done()


def summaries(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of repair(): counts, gaps, cost, edits and the hash of what stays, `role:text` by lines."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0).cast("long"))
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    whole = pieces.where("n_pieces = 1").withColumns({"gaps": gaps, "repaired_sha256": F.sha2(text, 256)}).select("conv_id", *names)
    parts = pieces.where("n_pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return whole.unionByName(_arrow(parts, _joined, SUMMARY))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of `conv_id:turn` modulo 20, nulls written as one space: 0 drops the row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it (copies: 2), 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("n") == 4, "user").otherwise(space("role"))
    return rows.withColumn("n", n).where("n <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("n") == 3, 2).otherwise(1).alias("copies"))


def repaired_damage(rows: DataFrame) -> DataFrame:
    """summaries(repair(damaged(rows))) with a row for every original conv_id; those without rows have zeros, an empty audit and the hash of nothing."""
    found = summaries(repair(damaged(rows)))
    ids = rows.select("conv_id").distinct()
    empty: dict[str, Column] = {x.split()[0]: F.lit(0).cast("long") for x in SUMMARY.split(", ")} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return ids.alias("i").join(found.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left").select("i.conv_id", *[F.coalesce(f"f.{c}", v).alias(c) for c, v in empty.items()])
