"""Operator 12: repair of conversations by a time-major tensor of costs.

A repaired conversation's roles begin with at most one system turn, then alternate user and
assistant and end with an assistant; or there are none.  Rows may be kept (0), get the role
that fits (2) or be deleted (3; blank and duplicate ones must be); empty turns may be
inserted (2), and a truncated row that stays costs 1.  Backward costs of four states (start,
after system, user, assistant) are kept for each turn: conversations of about one length are
a bucket, and a step of the program updates a turn of all of them at once.  The trace goes
forward over all of them at once too and takes, of the edits that keep to the least cost,
the letter that comes first, which gives the least of the cheapest audits.

Rows are range-partitioned and sorted by conversation, turn, role and text, so the rows of
a very long conversation lie in many partitions.  A conversation that lies inside one and
is short is done where it is.  Others are pieces of bounded length: costs over a piece are a
4 by 4 matrix (minimum, plus), so suffix products of these small matrices give each piece
the costs at its end, a scan of its exits by entry gives the state at its start, and all
pieces are traced in parallel.  Only the hash of a repaired text, which must run from its
beginning to its end, reads the pieces of a conversation one after another, as a stream.

Null roles, texts, and null ids and turns in the damage's key, are one space; null turns
come first; rows without conv_id are one conversation, of null id.  Rows of one turn are in
order of role, then text (by their first 64 characters, then whole); repeated rows are
repeated turns, hence duplicates.  A conversation with no row left has an empty repair.  An
empty table gives an empty table; extra columns are ignored; long texts are streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import need, parts, small_batches, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows and bytes of a piece of a long conversation; of conversations that are done at once.
PIECE, PIECE_BYTES, BATCH, BATCH_BYTES = 4096, 8 << 20, 2048, 8 << 20
SPACES = " \t\n\x0b\x0c\r"

#: States: start, after system, after user, after assistant.  Where a fitting row leads:
NEXT = np.array([2, 2, 3, 2])
#: Where a kept row of a role's code (0 other, 1 system, 2 user, 3 assistant) leads; 4: nowhere.
KEPT = np.array([[4, 4, 4, 4], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4]])
#: Codes that may follow each other.
LEGAL = np.zeros((4, 4), bool)
LEGAL[1, 2] = LEGAL[2, 3] = LEGAL[3, 2] = True
FAR = np.int64(1) << 40
LETTERS = "DIKR"
NAMES = ["", "system", "user", "assistant"]
#: Bits of a row's kind, above its role's code.
DEAD, CUT, GONE = 4, 8, 16


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs of states, with insertions from them."""
    for _ in range(3):
        costs = np.minimum(costs, INSERT + costs[..., NEXT])
    return costs


#: Costs of states at the end of a conversation.
END = closed(np.array([0, FAR, FAR, 0]))


def backward(kinds: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """kinds (T, N) and costs at the ends (N, 4) -> costs before each turn (T + 1, N, 4)."""
    t, n = kinds.shape
    costs = np.empty((t + 1, n, 4), np.int64)
    costs[t] = ends
    for k in range(t - 1, -1, -1):
        after, kind = costs[k + 1], kinds[k]
        cut = ((kind & CUT) > 0).astype(np.int64)[:, None]
        wide = np.concatenate([after, np.full((n, 1), FAR)], axis=1)
        stay = cut + np.minimum(np.take_along_axis(wide, KEPT[kind & 3], axis=1), REROLE + after[:, NEXT])
        made = np.minimum(DELETE + after, np.where((kind & DEAD)[:, None] > 0, FAR, stay))
        costs[k] = np.where((kind & GONE)[:, None] > 0, after, closed(np.minimum(made, FAR)))
    return costs


def trace(kinds: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edits from a state on: letters (numbers in LETTERS, -1 none), roles' codes after them
    and turns, by step (S, N); and the state at the end.  Turns are inserted after the last
    one where ``last`` says that the conversation ends there."""
    t, n = kinds.shape
    at, state, line = np.zeros(n, np.int64), state.copy(), np.arange(n)
    padded = np.concatenate([kinds, np.full((1, n), GONE, kinds.dtype)])
    letters, codes, turns = [], [], []
    while True:
        inside = at < t
        skip = inside & ((padded[at, line] & GONE) > 0)
        kind = padded[at, line]
        here, after = costs[at, line], costs[np.minimum(at + 1, t), line]
        now, target = here[line, state], NEXT[state]
        move = inside & ~skip
        # An inserted turn must lower what is left: at an end whose cost is none nothing is.
        insert = ~skip & (inside | last) & (now < FAR) & (INSERT + here[line, target] == now)
        if not (inside | insert).any():
            break
        cut, alive = ((kind & CUT) > 0).astype(np.int64), (kind & DEAD) == 0
        goal = KEPT[kind & 3, state]
        wide = np.concatenate([after, np.full((n, 1), FAR)], axis=1)
        keep = move & alive & (goal < 4) & (cut + wide[line, goal] == now)
        rerole = move & alive & (cut + REROLE + after[line, target] == now)
        delete = move & (DELETE + after[line, state] == now)
        letter = np.select([delete, insert, keep, rerole], [0, 1, 2, 3], -1)
        code = np.select([letter == 1, letter == 2, letter == 3], [target, kind & 3, target], 0)
        letters.append(letter)
        codes.append(code)
        turns.append(at.copy())
        state = np.select([letter == 1, letter == 2, letter == 3], [target, np.minimum(goal, 3), target], state)
        at = at + (skip | np.isin(letter, (0, 2, 3)))
        if (move & (letter < 0)).any():
            raise AssertionError("no edit keeps to the least cost")
    shape = (len(letters), n)
    return np.array(letters, np.int64).reshape(shape), np.array(codes, np.int64).reshape(shape), np.array(turns, np.int64).reshape(shape), state


def told(letters: np.ndarray, codes: np.ndarray, turns: np.ndarray, roles: list[str], texts: list[str]) -> tuple[str, list[str]]:
    """Audit and repaired lines of one conversation (or piece) from its column of a trace."""
    audit, lines = [], []
    for letter, code, turn in zip(letters.tolist(), codes.tolist(), turns.tolist(), strict=True):
        if letter < 0:
            continue
        audit.append(LETTERS[letter])
        if letter == 1:
            lines.append(f"{NAMES[code]}:")
        elif letter == 2:
            lines.append(f"{roles[turn]}:{texts[turn]}")
        elif letter == 3:
            lines.append(f"{NAMES[code]}:{texts[turn]}")
    return "".join(audit), lines


def faults(kinds: np.ndarray) -> tuple[int, int]:
    """Truncated rows and illegal neighbours of the rows that are there."""
    some = kinds[(kinds & GONE) == 0]
    codes = some & 3
    return int(((some & (CUT | DEAD)) == CUT).sum()), int((~LEGAL[codes[:-1], codes[1:]]).sum()) if len(codes) else 0


def tensor(kinds: list[np.ndarray]) -> np.ndarray:
    """Conversations of about one length side by side, turns down; padded with absent rows."""
    out = np.full((max(len(k) for k in kinds), len(kinds)), GONE, np.int64)
    for i, k in enumerate(kinds):
        out[: len(k), i] = k
    return out


def solve(conversations: list[tuple[np.ndarray, list[str], list[str]]]) -> list[tuple[int, str, str]]:
    """(kinds, roles, texts) of whole conversations -> cost, audit, hash of the repair."""
    out: list = [None] * len(conversations)
    buckets: dict[int, list[int]] = {}
    for i, (kinds, _, _) in enumerate(conversations):
        buckets.setdefault(len(kinds).bit_length(), []).append(i)
    for members in buckets.values():
        kinds = tensor([conversations[i][0] for i in members])
        n = len(members)
        costs = backward(kinds, np.broadcast_to(END, (n, 4)))
        letters, codes, turns, _ = trace(kinds, costs, np.zeros(n, np.int64), np.ones(n, bool))
        for k, i in enumerate(members):
            audit, lines = told(letters[:, k], codes[:, k], turns[:, k], *conversations[i][1:])
            out[i] = (int(costs[0, k, 0]), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows as the test of the contract damages them."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = need(df, "conv_id", "turn", "role", "text")
    rows = rows.withColumn("k", F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20)
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(spaced("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.withColumn("copies", F.explode("copies")).drop("copies")


_FOUND = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join(f"{c} long" for c in _FOUND) + ", audit string, repaired_sha256 string"
_PIECE = "ord long, kinds binary, blanks binary, marks binary, turns array<long>, roles array<string>, texts array<string>"


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition -> results of the conversations that are short and lie inside it,
    and pieces of the others."""
    kind, now, part, seq, first, long_ = None, object(), 0, 0, True, False
    held: list[tuple] = []
    size = 0
    ready: list[tuple] = []
    ready_bytes = 0

    def results() -> pa.RecordBatch:
        solved = solve([(r[2], r[3], r[4]) for r in ready])
        cols = [[r[0] for r in ready], *[[r[1][c] for r in ready] for c in range(5)], *[list(c) for c in zip(*solved, strict=True)]]
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        nothing = [pa.nulls(len(ready), k) for k in _PIECE_KINDS]
        return pa.RecordBatch.from_arrays([*arrays, *nothing], names=_SCAN_NAMES)

    def piece() -> pa.RecordBatch:
        nonlocal seq
        kinds = np.array([r[3] for r in held], np.uint8)
        cols = [(part << 40) + seq, kinds.tobytes(), bytes(r[4] for r in held), b"".join(r[5] for r in held), [r[0] for r in held], [r[1] for r in held], [r[2] for r in held]]
        seq += 1
        return pa.RecordBatch.from_arrays([pa.array([now], kind), *[pa.nulls(1, k) for k in [pa.int64()] * 6 + [pa.string()] * 2], *[pa.array([c], k) for c, k in zip(cols, _PIECE_KINDS, strict=True)]], names=_SCAN_NAMES)

    def whole() -> None:
        nonlocal ready_bytes
        seen: set[bytes] = set()
        kinds = np.array([r[3] for r in held], np.int64)
        blank = repeated = 0
        for i, r in enumerate(held):
            if not kinds[i] & GONE:
                blank += r[4]
                if r[5] in seen and not r[4]:
                    repeated += 1
                    kinds[i] |= DEAD
                seen.add(r[5])
        truncated, illegal = faults(kinds)
        turns = [r[0] for r, k in zip(held, kinds, strict=True) if not k & GONE]
        ready.append((now, (_gaps(turns), blank, repeated, truncated, illegal), kinds, [r[1] for r in held], [r[2] for r in held]))
        ready_bytes += size

    for batch in batches:
        kind = batch.column(0).type
        for conv, turn, role, text, row_kind, blank, mark, part in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if conv != now:
                if held and not first and not long_:
                    whole()
                elif held:
                    yield piece()
                if len(ready) >= BATCH or ready_bytes >= BATCH_BYTES:
                    yield results()
                    ready, ready_bytes = [], 0
                first = type(now) is object
                held, size, now, long_ = [], 0, conv, False
            elif len(held) >= PIECE or size >= PIECE_BYTES:
                yield piece()
                held, size, long_ = [], 0, True
            held.append((turn, role, text, row_kind, blank, mark))
            size += len(text)
    if held:
        yield piece()
    if ready:
        yield results()


_PIECE_KINDS = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
_SCAN_NAMES = ["conv_id", *_FOUND, "audit", "repaired_sha256", "ord", "kinds", "blanks", "marks", "turns", "roles", "texts"]


def _known(pieces: DataFrame) -> DataFrame:
    """Pieces (ord, conv_id, kinds, blanks, turns) in whose kinds duplicates are marked: a row
    is one unless no row of its conversation with its mark is before it."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, ord_, kinds, held in zip(*[batch.slice(0).column(c) for c in range(4)], strict=True):
                k, m = np.frombuffer(kinds.as_py(), np.uint8), held.as_py()
                first: dict[bytes, int] = {}
                for i in np.flatnonzero((k & GONE) == 0).tolist():
                    first.setdefault(m[16 * i : 16 * i + 16], i)
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * len(first), conv.type), pa.array([ord_.as_py()] * len(first), pa.int64()), pa.array(list(first.values()), pa.int32()), pa.array(list(first), pa.binary())], names=["conv_id", "ord", "i", "mark"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    each = pieces.select("conv_id", "ord", "kinds", "marks").mapInArrow(marks, f"conv_id {kind}, ord long, i int, mark binary")
    first = each.groupBy("conv_id", "mark").agg(F.min(F.struct("ord", "i")).alias("first"))
    fresh = first.groupBy("first.ord").agg(F.collect_list("first.i").alias("fresh"))  # at most a piece's rows

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kinds, blanks, fresh in zip(*[batch.column(c).to_pylist() for c in (2, 3, 5)], strict=True):
                k, b = np.frombuffer(kinds, np.uint8).copy(), np.frombuffer(blanks, np.uint8)
                again = np.ones(len(k), bool)
                again[fresh or []] = False
                k[again & (b == 0) & ((k & GONE) == 0)] |= DEAD
                out.append(k.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary()), *batch.columns[3:5]], names=["ord", "conv_id", "kinds", "blanks", "turns"])

    joined = pieces.select("ord", "conv_id", "kinds", "blanks", "turns").join(fresh, "ord", "left").select("ord", "conv_id", "kinds", "blanks", "turns", "fresh")
    return joined.mapInArrow(mark, f"ord long, conv_id {kind}, kinds binary, blanks binary, turns array<long>")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs over each piece from each state to each: (conv_id, ord, m)."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    for batch in batches:
        out = []
        for kinds in batch.column(2).to_pylist():
            k = np.frombuffer(kinds, np.uint8).astype(np.int64)[:, None]
            out.append(backward(np.repeat(k, 4, axis=1), unit)[0].T.tobytes())  # m[state before][state after]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["conv_id", "ord", "m"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of a conversation, the last first -> costs at each piece's end."""
    now, ends = object(), END
    for batch in batches:
        out, last = [], []
        for conv, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            last.append(conv != now)
            if conv != now:
                now, ends = conv, END
            out.append(ends.astype(np.int64).tobytes())
            ends = np.minimum((np.frombuffer(m, np.int64).reshape(4, 4) + ends).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary()), pa.array(last)], names=["ord", "ends", "last"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each piece by the state before it: (conv_id, ord, exits, cost)."""
    for batch in batches:
        exits, cost = [], []
        for kinds, ends, last in zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True):
            k = np.repeat(np.frombuffer(kinds, np.uint8).astype(np.int64)[:, None], 4, axis=1)
            costs = backward(k, np.broadcast_to(np.frombuffer(ends, np.int64), (4, 4)))
            exits.append(trace(k, costs, np.arange(4), np.full(4, last))[3].tolist())
            cost.append(int(costs[0, 0, 0]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(exits, pa.list_(pa.int64())), pa.array(cost, pa.int64())], names=["conv_id", "ord", "exits", "cost"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exits of a conversation in order -> the state before each piece; cost with the first."""
    now, state = object(), 0
    for batch in batches:
        entry, costs = [], []
        for conv, exits, cost in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)], strict=True):
            costs.append(cost if conv != now else 0)
            if conv != now:
                now, state = conv, 0
            entry.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(entry, pa.int64()), pa.array(costs, pa.int64())], names=["ord", "entry", "cost"])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with costs at their ends and states at their beginnings -> audits, lines, and
    what the faults of a conversation are summed from."""
    for batch in batches:
        for r in batch.to_pylist():
            flat = np.frombuffer(r["kinds"], np.uint8).astype(np.int64)
            kinds = flat[:, None]
            costs = backward(kinds, np.frombuffer(r["ends"], np.int64)[None])
            letters, codes, turns, _ = trace(kinds, costs, np.array([r["entry"]]), np.array([r["last"]]))
            audit, lines = told(letters[:, 0], codes[:, 0], turns[:, 0], r["roles"], r["texts"])
            there = (flat & GONE) == 0
            blank = int((np.frombuffer(r["blanks"], np.uint8)[there] > 0).sum())
            dead = int(((flat[there] & DEAD) > 0).sum())
            truncated, illegal = faults(flat)
            own = (flat & 3)[there].tolist()
            known = [t for t, k in zip(r["turns"], there, strict=True) if k and t is not None]
            cols = [r["conv_id"], r["ord"], r["cost"], audit, len(lines), "\n".join(lines), [blank, dead - blank, truncated, illegal], own[:1] + own[-1:], [min(known), max(known), len(set(known))] if known else []]
            kinds_ = [batch.column(batch.schema.get_field_index("conv_id")).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds_, strict=True)], names=["conv_id", "ord", "cost", "audit", "n", "lines", "sums", "roles", "turns"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Told pieces of a conversation in order -> its result; lines are hashed as they come."""
    state: list | None = None
    kind = None

    def close() -> pa.RecordBatch:
        conv, digest, _, audit, sums, cost, _, span = state
        gaps = span[1] - span[0] + 1 - span[2] if span else 0
        cols = [conv, gaps, *sums, cost, "".join(audit), digest.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, [kind, *[pa.int64()] * 6, pa.string(), pa.string()], strict=True)], names=["conv_id", *_FOUND, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for conv, _, cost, audit, n, lines, sums, roles, turns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if state is None or conv != state[0]:
                if state is not None:
                    yield close()
                state = [conv, hashlib.sha256(), False, [], [0, 0, 0, 0], 0, None, None]
            if n:
                state[1].update((("\n" if state[2] else "") + lines).encode())
                state[2] = True
            state[3].append(audit)
            state[4] = [a + b for a, b in zip(state[4], sums, strict=True)]
            state[5] += cost
            if roles:
                if state[6] is not None and not LEGAL[state[6], roles[0]]:
                    state[4][3] += 1
                state[6] = roles[-1]
            if turns:
                old = state[7]
                state[7] = turns if old is None else [old[0], turns[1], old[2] + turns[2] - (old[1] == turns[0])]
    if state is not None:
        yield close()


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, gone) -> conv_id, faults, cost, audit, hash of each
    conversation; rows that are gone only say that there is one."""
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    blank = stripped == ""
    cut = ~blank & ~F.substring(stripped, -1, 1).isin(".", "!", "?")
    bits = code + F.when(blank, DEAD).otherwise(0) + F.when(cut, CUT).otherwise(0)
    rows = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.when(F.col("gone"), GONE).otherwise(bits).cast("int").alias("kind"),
        blank.cast("int").alias("blank"), F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("mark"), F.substring("role", 1, 64).alias("r"), F.substring("text", 1, 64).alias("t"),
    )
    keys = ["conv_id", "turn", "r", "t"]
    dealt = rows.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys, "role", "text")
    scanned = dealt.select("conv_id", "turn", "role", "text", "kind", "blank", "mark", F.spark_partition_id().cast("long").alias("part"))
    scanned = table(spark, scanned.mapInArrow(_scan, f"conv_id {kind}, {_RESULT}, {_PIECE}"), "conversations")
    pieces = scanned.where("ord is not null")
    known = table(spark, _known(pieces), "known")
    matrices = known.select("conv_id", "ord", "kinds").mapInArrow(_matrices, f"conv_id {kind}, ord long, m binary")
    ends = table(spark, matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("ord")).mapInArrow(_ends, "ord long, ends binary, last boolean"), "ends")
    exits = known.join(ends, "ord").select("conv_id", "ord", "kinds", "ends", "last").mapInArrow(_exits, f"conv_id {kind}, ord long, exits array<long>, cost long")
    entries = exits.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInArrow(_entries, "ord long, entry long, cost long")
    joined = pieces.select("ord", "roles", "texts").join(known, "ord").join(ends, "ord").join(entries, "ord")
    told_ = joined.mapInArrow(_tell, f"conv_id {kind}, ord long, cost long, audit string, n long, lines string, sums array<long>, roles array<long>, turns array<long>")
    gathered = told_.repartition("conv_id").sortWithinPartitions("conv_id", "ord").mapInArrow(_gather, f"conv_id {kind}, {_RESULT}")
    return scanned.where("ord is null").select(*gathered.columns).unionByName(gathered)


def report(spark: SparkSession, df: DataFrame) -> DataFrame:
    return repair(spark, damage(df))
