"""Conversation structure repair by depth-first branch and bound.

Rows of a conversation get the cheapest edits that leave ``s?(ua)+`` (an optional system turn,
then pairs of user and assistant) or nothing. A row is kept (K, free), deleted (D, 2), given
another role (R, 1), or an empty row is inserted before it (I, 5); a truncated row that stays
costs 5 more, a blank or repeated one must go. Of equally cheap edits the ASCII-least string
of letters, the audit, is taken.

1. One range shuffle puts rows in order; their place in it, written once, names them from then on.
2. Only one symbol per row, its initial and fault, is gathered, in segments of at most ``SEGMENT``
   rows, so a conversation of any length is no large group.
3. Each segment becomes costs from entry state to exit state. Per conversation these small
   tables are folded from its end, which tells every segment the least cost of all that follows.
4. Segments are searched apart, for each entry state: an explicit stack of prefixes, pruned by
   the least cost of the suffix, by the incumbent (cost, audit) and by the best prefix known per
   node. The entry states are then chained from the front, and audits go back to rows by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import stored
from labelloom.sources.session import ship_package

WHITE = " \t\n\x0b\f\r"
SEGMENT = 4096

# What a conversation holds so far: nothing, a system turn, an open user turn, whole pairs.
EMPTY, SYSTEM, ASKED, PAIRED = STATES = range(4)
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 40

Move = tuple[str, int, int]


def _answered(state: int) -> int:
    """The state after the turn that an edit of free choice adds."""
    return PAIRED if state == ASKED else ASKED


@lru_cache(maxsize=None)
def moves(symbol: str, state: int) -> tuple[Move, ...]:
    """Letter, next state and cost of each edit that uses up a row.

    A symbol is the row's initial, ``o`` for other ones, in upper case if the row is truncated;
    ``x`` is a row that must go.
    """
    out = [("D", state, DELETE)]
    if symbol != "x":
        late = TRUNCATED if symbol.isupper() else 0
        kept = {("s", EMPTY): SYSTEM, ("a", ASKED): PAIRED}
        kept |= {("u", s): ASKED for s in (EMPTY, SYSTEM, PAIRED)}
        if (symbol.lower(), state) in kept:
            out.append(("K", kept[symbol.lower(), state], late))
        out.append(("R", _answered(state), RENAME + late))
    return tuple(out)


def _with_inserts(direct: list[int]) -> tuple[int, ...]:
    """Least costs if rows may also be inserted first; more than two in a row never pay."""
    once = [min(direct[s], INSERT + direct[_answered(s)]) for s in STATES]
    return tuple(min(direct[s], INSERT + once[_answered(s)]) for s in STATES)


AT_END = _with_inserts([0, NEVER, NEVER, 0])


def suffix_costs(symbols: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Least cost of all that follows, for each place and state; ``after`` holds behind the last row."""
    costs = [after]
    for symbol in reversed(symbols):
        direct = [min(c + costs[-1][t] for _, t, c in moves(symbol, s)) for s in STATES]
        costs.append(_with_inserts(direct))
    return costs[::-1]


def exit_costs(symbols: str) -> list[int]:
    """Least costs from each entry state (rows) to each exit state of a segment, flat."""
    ends = [tuple(0 if s == t else NEVER for s in STATES) for t in STATES]
    starts = [suffix_costs(symbols, end)[0] for end in ends]
    return [min(starts[t][s], NEVER) for s in STATES for t in STATES]


def search(symbols: str, entry: int, after: tuple[int, ...] | None) -> tuple[int, str]:
    """Exit state and audit of the best edits of a segment; ``after`` is None for the last one."""
    bound = suffix_costs(symbols, AT_END if after is None else after)
    best, best_exit = (NEVER, ""), entry
    known: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bound[i][state]
        if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
            continue
        if known.get((i, state), (NEVER, "")) <= (cost, audit):
            continue
        known[i, state] = (cost, audit)
        last = i == len(symbols)
        if last and (after is not None or state in (EMPTY, PAIRED)):
            best, best_exit = min((best, best_exit), ((least, audit), state))
            continue
        options = [] if last else list(moves(symbols[i], state))
        # no inserts at the end of a segment that others follow: they belong before the next row
        options.append(("I", _answered(state), INSERT))
        nodes = [(i + (letter != "I"), s, cost + c, audit + letter) for letter, s, c in options]
        # the most promising one on top
        stack += sorted(nodes, key=lambda n: (n[2] + bound[n[0]][n[1]], n[3]), reverse=True)
    return best_exit, best[1]


@lru_cache(maxsize=1 << 16)
def short_search(symbols: str, entry: int, after: tuple[int, ...] | None) -> tuple[int, str]:
    """``search`` for short conversations, many of which are alike."""
    return search(symbols, entry, after)


def replay(audit: str, entry: int, symbols: str, first: int) -> Iterator[tuple[int, int, str, str | None]]:
    """Place of the row, order beside it (inserted rows before it below 0, after it above), letter and new role."""
    state, row, waiting = entry, 0, []
    for letter in audit:
        role = "assistant" if state == ASKED else "user"
        if letter == "I":
            waiting.append(role)
            state = _answered(state)
            continue
        yield from ((first + row, k - len(waiting), "I", r) for k, r in enumerate(waiting))
        yield first + row, 0, letter, role if letter == "R" else None
        state = next(t for x, t, _ in moves(symbols[row], state) if x == letter)
        row, waiting = row + 1, []
    yield from ((first + row - 1, k + 1, "I", r) for k, r in enumerate(waiting))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# -- rows ----------------------------------------------------------------------


def ordered(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text and pos, which grows with conversation, turn, role and text."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")
    )
    # a short beginning of the text is enough to spread a hot turn, and keeps the sampled bounds small
    spread = named.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    placed = spread.sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(placed.withColumn("pos", F.monotonically_increasing_id()), "ordered-turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add initial and fault: the first of blank, duplicate and truncated that holds, or null.

    A row is a duplicate unless it is the first of its role and text. Joined by place, rows
    that repeat very often are no hot key.
    """
    firsts = rows.groupBy("conv_id", "role", F.md5("text")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    visible = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    facts = rows.select(
        "conv_id", "turn", "pos",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (visible == "").alias("blank"),
        (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    return facts.join(firsts, "pos", "left").select("conv_id", "turn", "pos", "initial", fault.alias("fault"))


def _same(a: str, b: str, column: str = "conv_id") -> Column:
    return F.col(f"{a}.{column}").eqNullSafe(F.col(f"{b}.{column}"))


def _segments(faults: DataFrame, size: int) -> DataFrame:
    """conv_id, first (place of the first row), symbols and initials; ``size`` rows at most."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(
        F.when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    )
    held = faults.groupBy("conv_id", F.floor(F.col("pos") / size)).agg(
        F.sort_array(F.collect_list(F.struct("pos", symbol.alias("symbol"), "initial"))).alias("rows")
    )
    return held.select(
        "conv_id",
        F.col("rows")[0]["pos"].alias("first"),
        F.array_join("rows.symbol", "").alias("symbols"),
        F.array_join("rows.initial", "").alias("initials"),
    )


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _costed(segments: DataFrame) -> DataFrame:
    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [exit_costs(s) for s in batch.column("symbols").to_pylist()]
            yield batch.append_column("costs", pa.array(costs, pa.list_(pa.int64())))

    kind = _id_type(segments)
    return segments.mapInArrow(
        cost, f"conv_id {kind}, first bigint, symbols string, initials string, costs array<bigint>"
    )


LEGAL = {"su", "ua", "au"}


def _illegal(text: str) -> int:
    return sum(text[i : i + 2] not in LEGAL for i in range(len(text) - 1))


def _what_follows(costed: DataFrame) -> DataFrame:
    """Per segment: ``after`` (null for the last one); with the first one, cost and illegal pairs of all."""
    parts = costed.select(
        "conv_id", F.struct("first", "costs", F.substring("initials", 1, 1).alias("head"), F.substring("initials", -1, 1).alias("tail")).alias("part")
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    schema = pa.schema([("first", pa.int64()), ("after", pa.list_(pa.int64())), ("cost", pa.int64()), ("borders", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segments in batch.column("parts").to_pylist():
                out, follows = [], list(AT_END)
                for n, part in enumerate(reversed(segments)):
                    out.append((part["first"], follows if n else None, None, None))
                    c = part["costs"]
                    follows = [min(c[4 * s + t] + follows[t] for t in STATES) for s in STATES]
                borders = sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(segments, segments[1:], strict=False))
                out[-1] = (*out[-1][:2], follows[EMPTY], borders)
                rows += out
            yield _batch(rows, schema)

    return whole.select("parts").mapInArrow(fold, "first bigint, after array<bigint>, cost bigint, borders bigint")


def _searched(segments: DataFrame, follows: DataFrame) -> DataFrame:
    """Segments with cost, illegal, and for each entry state the exit state and the audit."""
    rows = segments.join(follows, "first").select("conv_id", "first", "symbols", "initials", "after", "cost", "borders")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exits, audits = [], []
            for symbols, after in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist(), strict=True):
                find = short_search if len(symbols) <= 64 else search
                found = [find(symbols, s, None if after is None else tuple(after)) for s in STATES]
                exits.append([e for e, _ in found])
                audits.append([a for _, a in found])
            illegal = [_illegal(t) + (b or 0) for t, b in zip(batch.column("initials").to_pylist(), batch.column("borders").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "first", "symbols", "cost")), pa.array(illegal, pa.int64()),
                 pa.array(exits, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
                names=["conv_id", "first", "symbols", "cost", "illegal", "exits", "audits"],
            )

    schema = f"conv_id {_id_type(rows)}, first bigint, symbols string, cost bigint, illegal bigint, exits array<int>, audits array<string>"
    return rows.mapInArrow(look, schema)


def _chained(searched: DataFrame) -> DataFrame:
    """Entry state of each segment, from the front of its conversation."""
    whole = searched.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "exits"))).alias("parts"))
    schema = pa.schema([("first", pa.int64()), ("entry", pa.int32())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segments in batch.column("parts").to_pylist():
                state = EMPTY
                for part in segments:
                    rows.append((part["first"], state))
                    state = part["exits"][state]
            yield _batch(rows, schema)

    return whole.select("parts").mapInArrow(chain, "first bigint, entry int")


def _edits(audited: DataFrame) -> DataFrame:
    """conv_id, pos, beside, edit and new role of every edit."""
    schema = pa.schema([("pos", pa.int64()), ("beside", pa.int32()), ("edit", pa.string()), ("new_role", pa.string())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("audit", "entry", "symbols", "first")]
            ids = batch.column("conv_id")
            # one segment at a time: its edits are few thousand rows at most
            for n, segment in enumerate(zip(*columns, strict=True)):
                part = _batch(list(replay(*segment)), schema)
                own = ids.take(pa.array([n] * part.num_rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([own, *part.columns], names=["conv_id", *schema.names])

    rows = audited.select("conv_id", "audit", "entry", "symbols", "first")
    return rows.mapInArrow(spell, f"conv_id {_id_type(rows)}, pos bigint, beside int, edit string, new_role string")


def _report(faults: DataFrame, audited: DataFrame) -> DataFrame:
    wide = lambda c: c.cast("decimal(38,0)")
    turns = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count_distinct("turn")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    seen = faults.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).try_cast("bigint").alias("gaps"), *counts)
    parts = F.sort_array(F.collect_list(F.struct("first", "audit")))
    edits = audited.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), parts.alias("parts")
    )
    audit = F.array_join("e.parts.audit", "").alias("audit")
    return seen.alias("s").join(edits.alias("e"), _same("s", "e")).select("s.*", "illegal", "cost", audit)


def repair_conversations(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
) -> tuple[DataFrame, DataFrame]:
    """A report per conversation, and the repaired rows.

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; the
    rows have conv_id, pos and beside (their order), edit (K, R or I), role and text. Rows are
    ordered by turn, null first, then by role and text. Null roles and texts are empty; a role
    that doesn't begin with s, u or a can't be kept. Rows without an id are one conversation.
    Equal texts are those with equal MD5 digests. An empty table gives two empty results; other
    columns are ignored. Python holds one segment at a time; only a conversation's audit, one
    letter per row, and 100 bytes per segment come together.
    """
    ship_package(rows.sparkSession)
    turns = ordered(rows, id_col, turn_col, role_col, text_col)
    faults = stored(with_faults(turns), "turn-faults")
    costed = stored(_costed(_segments(faults, segment)), "turn-segments")
    searched = stored(_searched(costed, _what_follows(costed)), "searched-segments")
    entered = searched.join(_chained(searched), "first")
    audited = stored(
        entered.select("conv_id", "first", "symbols", "cost", "illegal", "entry", F.get("audits", "entry").alias("audit")),
        "audited-segments",
    )
    edits = _edits(audited).filter("edit <> 'D'")
    texts = edits.filter("edit <> 'I'").drop("conv_id").join(turns, "pos")
    kept = texts.select("conv_id", "pos", "beside", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.filter("edit = 'I'").select("conv_id", "pos", "beside", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return _report(faults, audited), kept.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the hash of ``role:text`` of its rows, joined by line feeds.

    A hash runs over a text from its start, so one task reads a conversation's rows, in order
    and batch by batch; it holds none of them.
    """
    line = F.concat("role", F.lit(":"), "text").alias("line")
    rows = repaired.select("conv_id", "pos", "beside", line)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "beside").select("conv_id", "line")
    kind = _id_type(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at, state = [], None, None

        def out(id_arrow: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], id_arrow), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "sha"]
            )

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = conv, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            yield out(id_arrow)
            done = []
        if state is not None:
            done = [(at, state.hexdigest())]
            yield out(id_arrow)

    return rows.mapInArrow(run, f"conv_id {kind}, sha string")
