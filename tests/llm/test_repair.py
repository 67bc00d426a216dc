"""Conversation repair against every possible edit, whole and cut into small segments."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from labelloom.llm import queries, repair

PATTERN = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\f\r"


def faults(rows):
    """(fault, initial) of ordered (role, text) rows."""
    seen, out = set(), []
    for role, text in rows:
        visible = text.rstrip(WHITE)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def every_edit(rows):
    """Least (cost, audit, repaired) by trying all edits, with up to two inserted rows at each place."""
    marks = faults(rows)
    fills = [f for n in range(3) for f in itertools.product(("user", "assistant"), repeat=n)]
    # prefixes of the pattern are all that can be completed
    started = re.compile("(s?(ua)*u?)?")
    states = {(0, "", ())}
    for n in range(len(rows) + 1):
        grown = set()
        for (cost, audit, out), fill in itertools.product(states, fills):
            made = (*out, *((r, "") for r in fill))
            if started.fullmatch("".join(r[:1] for r, _ in made)):
                grown.add((cost + 5 * len(fill), audit + "I" * len(fill), made))
        if n == len(rows):
            states = grown
            break
        role, text = rows[n]
        states = set()
        for cost, audit, out in grown:
            states.add((cost + 2, audit + "D", out))
            if marks[n] in ("blank", "duplicate"):
                continue
            late = 5 if marks[n] else 0
            for letter, price, r in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                made = (*out, (r, text))
                if r[:1] in "sua" and r and started.fullmatch("".join(x[:1] for x, _ in made)):
                    states.add((cost + price + late, audit + letter, made))
        # of equal shapes of the output only the least can win
        best = {}
        for cost, audit, out in states:
            shape = "".join(x[:1] for x, _ in out)
            best[shape] = min(best.get(shape, (9**9, "", ())), (cost, audit, out))
        states = set(best.values())
    return min(s for s in states if PATTERN.fullmatch("".join(x[:1] for x, _ in s[2])))


def brute(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by_conv[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in by_conv.items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        gap = max(turns) - min(turns) + 1 - len(turns) if turns else 0  # null when beyond 64 bits
        pairs = [(r, t) for _, r, t in own]
        marks = faults(pairs)
        cost, audit, fixed = every_edit(pairs)
        initials = [r[:1] for r, _ in pairs]
        out.append((
            conv, gap if gap < 1 << 63 else None, *(marks.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "why?", "cut", "cut \n", " ", "", None, "a. b", "Yes.\t", "日本。", "end.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "User", "unknown"]
    rows = []
    for conv in range(160):
        good = rng.random() < 0.4
        for turn in range(rng.randrange(1, 8)):
            role = roles[turn % 2] if good else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, -turn]), role, f"t{turn}." if good else rng.choice(texts)))
    rows += [(None, t, r, "x.") for t, r in ((1, "user"), (2, "assistant"), (None, "system"))]
    rows += [(900, None, "user", "x.")] * 3 + [(901, -(1 << 63), "user", "x."), (901, (1 << 63) - 1, "assistant", "y.")]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "e") for r in made_rows()], "conv_id long, turn long, role string, text string, pos int, edit string")


def show(report):
    return sorted((tuple(r) for r in report.collect()), key=str)


def test_small_conversations_match_every_edit(frame):
    got = show(queries.repaired_digests(frame.repartition(5)))
    assert got == brute(made_rows())
    assert {x for r in got for x in r[7]} == set("DKR")  # an inserted row never pays: deleting one costs less


def test_inserted_rows_stand_beside_their_neighbours():
    assert list(repair.replay("IKDKI", repair.EMPTY, "axu", 40)) == [
        (40, -1, "I", "user"), (40, 0, "K", None), (41, 0, "D", None), (42, 0, "K", None), (42, 1, "I", "assistant")
    ]


def test_segments_change_nothing(spark, frame):
    rng = random.Random(5)
    role = lambda: rng.choice(["user", "assistant", "assistant", "user", "system", "tool"])
    long = [(7777, n, role(), rng.choice(["one.", f"{n}.", f"{n}.", f"{n}", ""])) for n in range(600)]
    both = frame.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))
    seen = []
    for size in (1, 3, 4096):
        report, rows = repair.repair_conversations(both, segment=size)
        seen.append((show(report), show(repair.digests(rows)), show(rows.drop("pos").groupBy("conv_id", "edit").count())))
    assert seen[0] == seen[1] == seen[2]


def test_searches_match_every_edit():
    rng = random.Random(2)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        rows = [(roles[rng.choice("suaauo")], rng.choice(["x.", "y.", "z.", "cut", "w!", ""])) for _ in range(rng.randrange(8))]
        marks = faults(rows)
        symbols = "".join(
            "x" if m in ("blank", "duplicate") else c.upper() if m else c
            for (r, _), m in zip(rows, marks, strict=True) for c in [r[0] if r[0] in "sua" else "o"]
        )
        cost, audit, _ = every_edit(rows)
        end, found = repair.search(symbols, repair.EMPTY, None)
        assert (found, end in (repair.EMPTY, repair.PAIRED)) == (audit, True)
        assert repair.suffix_costs(symbols, repair.AT_END)[0][repair.EMPTY] == cost


def test_long_searches_stay_linear():
    rng = random.Random(1)
    for symbols in ("s" * 4096, "x" * 4096, "".join(rng.choice("suaoSUAOx") for _ in range(4096))):
        assert len(repair.search(symbols, repair.EMPTY, None)[1].replace("I", "")) == 4096


def test_nothing_to_repair(frame):
    empty = frame.limit(0)
    report, rows = repair.repair_conversations(empty)
    assert report.count() == 0 == rows.count() == queries.repaired_digests(empty).count()
