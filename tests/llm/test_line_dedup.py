"""Line dedup against brute force: nulls, white space, ties, repeated ids, long texts, a line in every document."""

import collections
import random

from labelloom.llm import lines

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, min_chars=40, min_docs=5):
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(_key(line)) >= min_chars:
                holders[_key(line)].add(i)
    last = {k: max(i for i in v if i is not None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if _key(x) not in last or last[_key(x)] == i]
        out.append((i, len(own), len(own) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def made_rows():
    rng = random.Random(3)
    pool = [f"{'É' if n % 3 else 'e'}very page of this site ends with the line number {n}" for n in range(12)]
    pool += ["x" * 39, "y" * 40, "日" * 40, " " + "Z" * 39 + "\t", "\x0b" + "q" * 40 + "\r", " " + "n" * 40, ""]
    rows = [(n, None) for n in (1, 2)] + [(3, ""), (4, "\n\n"), (5, "alone")]
    for n in range(10, 150):
        own = [rng.choice(pool) for _ in range(rng.randrange(9))] + [f"own words {n}"] * rng.randrange(3)
        own.append("A LINE that all documents hold, so that it crowds one key")
        rng.shuffle(own)
        rows.append((n, "\n".join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in own)))
    rows += rows[20:30] + [(20, "other text\n" + pool[0]), (None, pool[1]), (None, "y" * 40 + "\n" + pool[2])]
    rows.append((500, "\n".join([pool[3], "long " * 20] * 20_000)))
    return rows


def test_lines_match_brute_force(spark):
    rows = made_rows()
    frame = spark.createDataFrame([(*r, "x", 1, ["g"]) for r in rows], "doc_id long, text string, id string, place int, gone array<string>")
    for repeat in (frame, frame.repartition(7)):
        got = lines.without_frequent_lines(repeat).collect()
        assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["row"]["text"] or "") for r in got), key=str) == brute(rows)
    kept = lines.drop_frequent_lines(frame)
    assert kept.columns == frame.columns and {r["text"] for r in kept.filter("doc_id < 4").collect()} == {None, ""}


def test_bounds_and_hot_hashes(spark, monkeypatch):
    rows = made_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lines, "HOT_SHARE", 4)  # most frequent lines are joined by hash, few are broadcast
    got = lines.without_frequent_lines(frame, min_chars=10, min_docs=2).collect()
    want = brute(rows, 10, 2)
    assert sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["row"]["text"] or "") for r in got), key=str) == want
    assert lines.without_frequent_lines(frame.limit(0)).count() == 0
