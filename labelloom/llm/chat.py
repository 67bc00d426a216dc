"""Chat formatting with prefix trees.

Each turn is written as open mark, role, line feed, text, close mark; control strings in
roles and texts are escaped, so the form can be read back. Conversations are sorted by the
digests of their turns, which is the depth-first order of the tree of shared beginnings:
in each run of the sorted rows, a conversation adds only the turns that the one before it
does not share. Runs are cut into packs of bounded size, and the sort splits a hot first
turn over tasks, so a shared turn is stored once per pack.

A pack holds the text of its nodes, one after another, and for each node its start, size,
position (its place in the conversation), parent, the spans that carry loss, and the
spans of its ancestors, which together with itself are what its tokens may attend to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import stored
from labelloom.sources.session import ship_package

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ESCAPE = "\\"
LOSS_ROLE = "assistant"
PACK_CHARS = 1 << 20

SPAN = "struct<start:long, stop:long>"
NODE = f"struct<start:long, size:long, position:long, parent:int, loss:array<{SPAN}>, attends:array<{SPAN}>>"
LEAF = "struct<conv_id:long, node:int, n_turns:long>"
PACK = f"text string, nodes array<{NODE}>, leaves array<{LEAF}>"


def escape(text: str) -> str:
    return text.replace(ESCAPE, ESCAPE + ESCAPE).replace("<|", "<" + ESCAPE + "|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (i := text.find(ESCAPE, at)) >= 0:
        out.append(text[at:i])
        out.append(text[i + 1])
        at = i + 2
    return "".join(out) + text[at:]


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of the text that carries loss (empty for other roles)."""
    head = OPEN + escape(role).replace("\n", ESCAPE + "\n") + "\n"
    body = escape(text)
    stop = len(head) + len(body)
    return head + body + CLOSE, len(head), stop if role == LOSS_ROLE else len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith(OPEN, at)
        stop = formatted.index(CLOSE, at)
        inner = formatted[at + len(OPEN) : stop]
        i = 0
        while inner[i] != "\n":
            i += 2 if inner[i] == ESCAPE else 1
        turns.append((unescape(inner[:i]), unescape(inner[i + 1 :])))
        at = stop + len(CLOSE)
    return turns


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns in order, and their path: eight digest bytes per turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    digest = lambda t: F.substring(F.sha2(F.concat_ws("\n", t["role"], t["text"]), 256), 1, 16)
    return grouped.withColumn("path", F.concat_ws("", F.transform("turns", digest)))


class _Pack:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.branch: list[tuple[tuple[str, str], int]] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.branch)) and self.branch[shared][0] == turns[shared]:
            shared += 1
        del self.branch[shared:]
        for role, text in turns[shared:]:
            formatted, begin, stop = format_turn(role, text)
            parent = self.branch[-1][1] if self.branch else -1
            above = self.nodes[parent] if self.branch else None
            attends = []
            if above:
                attends = [*above["attends"], {"start": above["start"], "stop": above["start"] + above["size"]}]
                if len(attends) > 1 and attends[-2]["stop"] == attends[-1]["start"]:
                    attends[-2:] = [{"start": attends[-2]["start"], "stop": attends[-1]["stop"]}]
            self.nodes.append({
                "start": self.size, "size": len(formatted), "parent": parent, "attends": attends,
                "position": above["position"] + above["size"] if above else 0,
                "loss": [{"start": self.size + begin, "stop": self.size + stop}] if stop > begin else [],
            })
            self.branch.append(((role, text), len(self.nodes) - 1))
            self.text.append(formatted)
            self.size += len(formatted)
        self.leaves.append({"conv_id": conv_id, "node": self.branch[-1][1] if self.branch else -1, "n_turns": len(turns)})

    def row(self) -> dict:
        return {"text": "".join(self.text), "nodes": self.nodes, "leaves": self.leaves}


def format_conversations(rows: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """Packs of conversations given one row per turn: conv_id, turn, role, text.

    Null roles and texts are empty; rows with equal turn numbers are ordered by role and
    text, null numbers first. Null conv_ids make one conversation, with a null id. A pack
    is closed once it passes ``pack_chars``; a longer conversation has a pack of its own.
    """
    spark = rows.sparkSession
    ship_package(spark)
    ready = stored(conversations(rows.select("conv_id", "turn", "role", "text")), "conversations")
    ordered = ready.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        pack = _Pack()
        for b in batches:
            for i in range(b.num_rows):
                turns = [(t["role"], t["text"]) for t in b.column("turns")[i].as_py()]
                if pack.size > pack_chars:
                    yield pa.RecordBatch.from_pylist([pack.row()], schema)
                    pack = _Pack()
                pack.add(b.column("conv_id")[i].as_py(), turns)
        if pack.leaves:
            yield pa.RecordBatch.from_pylist([pack.row()], schema)

    return ordered.select("conv_id", "turns").mapInArrow(run, PACK)


def _schema() -> pa.Schema:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    node = pa.struct([("start", pa.int64()), ("size", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()),
                      ("loss", span), ("attends", span)])
    leaf = pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("n_turns", pa.int64())])
    return pa.schema([("text", pa.string()), ("nodes", pa.list_(node)), ("leaves", pa.list_(leaf))])


def read_back(text: str, nodes: list[dict], leaf: int) -> tuple[str, str]:
    """Formatted text of a conversation and its unescaped text under the loss mask."""
    if leaf < 0:
        return "", ""
    spans = [*nodes[leaf]["attends"], {"start": nodes[leaf]["start"], "stop": nodes[leaf]["start"] + nodes[leaf]["size"]}]
    line = []
    at = leaf
    while at >= 0:
        line.append(at)
        at = nodes[at]["parent"]
    loss = [unescape(text[s["start"] : s["stop"]]) for n in reversed(line) for s in nodes[n]["loss"]]
    return "".join(text[s["start"] : s["stop"]] for s in spans), "".join(loss)


def digests(packs: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from packs."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, nodes = b.column("text")[i].as_py(), b.column("nodes")[i].as_py()
                cache: dict[int, tuple] = {}
                out = []
                for leaf in b.column("leaves")[i].as_py():
                    if leaf["node"] not in cache:
                        formatted, loss = read_back(text, nodes, leaf["node"])
                        turns = parse(formatted)
                        plain = "".join(f"{role}\n{said}\n" for role, said in turns)
                        # copies of a conversation follow each other
                        cache = {leaf["node"]: (len(turns), sha(plain), len(loss), sha(loss), len(formatted))}
                    out.append((leaf["conv_id"], *cache[leaf["node"]]))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return packs.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
