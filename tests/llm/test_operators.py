"""Every operator against brute force on small tables, with nulls, empties, ties, repeats and odd columns."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import check, connect
from tokenizers import Tokenizer

from labelloom.llm import ann, chat, exact, langmodel, neardup, packing, pii, queries, suffixes, toxicity, wordbpe

WORDS = re.compile("[^\\x20\\x09-\\x0D]+")
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30 ", "other ")
TEXTS = [
    BASE, None, "", NEAR, BASE, BASE.replace(" ", "\n\n"), "one two", "one two", "ONE two", "a" * 120, "b" + "a" * 119,
    BASE + " " + " ".join(f"tail{i}" for i in range(400)), "mail ann.b@mail.example.com or +1 (212) 555-0123, 10.0.0.256 10.0.0.25",
    "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "é́ß日本 " * 30, "<|endoftext|> x <|im_end|>\\<|", " \t\n ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None, "x", i) for i, t in enumerate(TEXTS)] + [(None, "one two", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, row long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, sf, name):
    assert check(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf) == ""


def test_exact(docs, empty):
    norm = [re.sub("[\\x20\\x09-\\x0D]+", " ", t or "") for t in TEXTS]
    rows = exact.exact_groups(docs, capacity=3).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        i = r["row"]["doc_id"]
        if i is not None:
            assert r["keep_id"] == norm.index(norm[i]) and r["kept"] == (r["keep_id"] == i)
            assert r["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()
            assert r["group_size"] == norm.count(norm[i]) + (norm[i] == "one two")
        else:
            assert r["keep_id"] == 6 and not r["kept"]
    assert exact.drop_exact_copies(docs).columns == docs.columns
    assert exact.exact_groups(empty).count() == 0


@pytest.mark.parametrize(("capacity", "hash_bits"), [(3, 64), (1, 64), (1000, 2)])
def test_texts_are_found_through_directory_and_chains(docs, empty, capacity, hash_bits):
    """Split buckets and long chains give the same groups; without its slot or its chain a text is not found."""
    plain = lambda rows: sorted(((r["row"]["doc_id"], r["keep_id"], r["group_size"]) for r in rows.collect()), key=str)
    want = plain(exact.exact_groups(docs))
    index = exact.build_index(docs, capacity=capacity, hash_bits=hash_bits)
    assert plain(exact.exact_groups(docs, index=index)) == want
    chains = [r["chain"] for r in index.chains.collect()]
    assert sum(map(len, chains)) == len({keep for _, keep, _ in want})
    assert max(map(len, chains)) > 1 if hash_bits == 2 else index.depth > 0
    slot = index.slots.first()["slot"]
    for cut in (index._replace(slots=index.slots.filter(f"slot <> {slot}")), index._replace(chains=index.chains.limit(len(chains) - 1))):
        got = plain(exact.exact_groups(docs, index=cut))
        assert got != want and all(g in want or g[1] is None for g in got)
    assert exact.exact_groups(empty, index=index).count() == 0
    assert plain(exact.exact_groups(docs, index=exact.build_index(empty))) == sorted(((i, None, None) for i, _, _ in want), key=str)


def _sets(texts):
    out = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def _components(ids, sets):
    root = {i: i for i in ids}
    for i, a in zip(ids, sets, strict=True):
        for j, b in zip(ids, sets, strict=True):
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def test_near_copies(docs, empty):
    want, sets = _components(range(len(TEXTS)), _sets(TEXTS)), _sets(TEXTS)
    for r in neardup.near_groups(docs).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]))
    assert neardup.near_groups(empty).count() == 0
    assert neardup.drop_near_copies(docs).columns == docs.columns


def test_near_copies_of_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in rows]
    want = _components(ids, _sets([r["text"] for r in rows]))
    got = {r["doc_id"]: r["component_id"] for r in queries.near_dedup(spark, sf).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_repeated_passages(docs, empty):
    seen, want = set(), {}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        mark = bytearray(len(data))
        own = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                mark[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(x for x, m in zip(data, mark, strict=True) if not m)
        want[i] = (len(data), sum(mark), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffixes.cut_repeats(docs).collect()}
    assert got.pop(None)[0] == 7 and got == want and want[10][1] == 119
    assert suffixes.cut_repeats(empty).count() == 0


def test_language_model(spark, sf, docs, empty):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    texts = {r["doc_id"]: [*WORDS.findall((r["text"] or "").translate(low)), None] for r in rows}
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    base = model = 0.0
    for r in queries.lm_scores(spark, sf).collect():
        t = texts[r["doc_id"]]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(counts[w] > 0 for w in t))
        if r["held_out"]:
            base, model = base + want, model + r["score"]
    assert model > base
    assert langmodel.score_documents(docs).count() == len(TEXTS) + 1
    assert langmodel.score_documents(empty).count() == 0


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    weights = rng.standard_normal((langmodel.FEATURES, langmodel.CLASSES)).astype(np.float32)
    rows = langmodel.feature_rows(rng.integers(0, 1 << 32, 50).astype(np.uint32), np.array([20, 30]))
    assert np.allclose(np.exp(langmodel.class_log(weights, rows)).sum(axis=1), 1, atol=1e-4)


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|b"), (2, 0, "user", "hi"), (2, 1, "assistant", None),
            (3, 1, "assistant", said), (3, 0, "sys\ntem", said), (4, 0, None, ""), (5, 0, "user", "hi"), (5, 1, "assistant", "a\\<|b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_conversations(frame.coalesce(1))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat.digests(packs).collect():
        mine = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"])
        loss = "".join(t for _, role, t in mine if role == "assistant")
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in mine))
        assert (r["loss_chars"], r["loss_sha256"], r["n_turns"]) == (len(loss), sha(loss), len(mine))
    pack = max(packs.collect(), key=lambda p: len(p["leaves"]))
    assert pack["text"].count("user\nhi") <= 1 and all(n["position"] >= 0 for n in pack["nodes"])
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0


def test_word_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), wordbpe.load(path)
    rng = random.Random(3)
    texts = [t or "" for t in TEXTS] + [
        "".join(rng.choice("aabbcdeethinglnosrst'0123 é́Σßİ.,!?<>|\x1c\x85　\n日😀") for _ in range(rng.randrange(60)))
        for _ in range(1500)
    ]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        got = [i for w in wordbpe.split_words(t) for i in own.word(w)]
        assert got == want
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)
    sizes = {r["doc_id"]: r["n_tokens"] for r in wordbpe.digests(docs, path).collect()}
    for r in wordbpe.encode_documents(docs, path).collect():
        assert len(r["ids"]) == sizes[r["doc_id"]]
    assert wordbpe.digests(empty, path).count() == 0


def test_word_bpe_reads_its_table(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        own = wordbpe.MergeAutomaton(json.load(f))
    lib = Tokenizer.from_file(path)
    ids = lambda t: lib.encode(t, add_special_tokens=False).ids
    rng = random.Random(9)
    words = ["a" * n for n in range(1, 90)] + ["!?" * 40_000, "the" * 20_000, "x" * 50_000]
    words += ["".join(rng.choices(["th", "in", "er", "a", "s", "tion", "q", "é", "日"], k=rng.randint(1, 30))) for _ in range(900)]
    assert all(own.word(w) == ids(w) for w in words)

    def refuse(*_):
        raise AssertionError("the table is full enough for words it has read")

    own.pieces.clear()
    with monkeypatch.context() as m:
        m.setattr(own, "step", refuse)
        m.setattr(own, "stop", refuse)
        assert all(own.word(w) == ids(w) for w in words)
    # a table that is started anew within words gives the same ids and stays within its bound
    own.pieces.clear()
    monkeypatch.setattr(wordbpe, "MAX_STEPS", 50)
    own._start_table()
    for w in words:
        assert own.word(w) == ids(w)
        assert len(own.steps) <= 50 and len(own.states) <= 52 and len(own.stops) <= 50
    # results come from the table: a changed stop changes the last token
    own.pieces.clear()
    own._start_table()
    right = own.path(b"thing")
    own.stops = {k: (i, token + 1) for k, (i, token) in own.stops.items()}
    assert own.path(b"thing") != right


def test_word_bpe_of_a_shorter_vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:300]
    kept = set(wordbpe.byte_symbols()) | {c + "</w>" for c in wordbpe.byte_symbols()}
    kept |= {a + b for a, b in spec["model"]["merges"]}
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if t in kept}
    own, lib = wordbpe.MergeAutomaton(spec), Tokenizer.from_str(json.dumps(spec))
    for t in ["the thing", "inn in int", "this", "anthem"]:
        want = lib.encode(t, add_special_tokens=False).ids
        assert [i for w in wordbpe.split_words(t) for i in own.word(w)] == want


def test_packing(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, length=64).collect()
    for i, t in enumerate(TEXTS):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(np.cumsum([0, *[r["length"] for r in mine][:-1]]))
        assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 64 for r in mine[1:])
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for seq in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_documents(empty, path).count() == 0


def test_sum_of_squares_fills_sequences():
    rng = random.Random(5)
    sizes = sorted((min(2048, int(rng.expovariate(1 / 500)) + 1) for _ in range(5000)), reverse=True)
    packer = packing.SumOfSquares()
    for s in sizes:
        packer.put(s)
    assert packer.made <= 1.01 * sum(sizes) / 2048 + 2


def _plain_spans(text):
    found = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                    14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[k]
            if good:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_personal_data(docs, empty):
    rng = random.Random(9)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab@.@+1234567890- ()%") for _ in range(80)) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == _plain_spans(t), t
    found = {r["doc_id"]: r for r in pii.find_all(docs, pii.fit(docs)).collect()}
    assert [found[12][f"n_{k}"] for k in pii.KINDS] == [1, 1, 0, 1] and found[13]["n_card"] == 1
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert "<email>" in clean[12] and "ann.b" not in clean[12] and clean[1] is None and clean[0] == BASE
    assert pii.find_all(empty, pii.Boosted()).count() == 0
    base_spans = pii.base_spans("1" * 200_000 + " a" + "b" * 200_000 + "@")  # linear on long runs
    assert base_spans == []


def test_segments_match_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-0.25, -0.25, -0.25, 0.5, 1.0]) for _ in range(30)]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(places, [scores[i] for i in places], -0.25)
        best = max((sum(scores[i:j]) for i in range(30) for j in range(i + 1, 31)), default=0)
        if places:
            assert math.isclose(max(x[2] for x in got), best)
        for a, b, s in got:
            assert math.isclose(s, sum(scores[a : b + 1]))
        assert all(x[1] < y[0] for x, y in zip(got, got[1:], strict=False))


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.toxic_scores(spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 300 and right / len(held) > 0.93
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == len(TEXTS) + 1
    assert toxicity.drop_toxic(docs, labels).count() == len(TEXTS) + 1
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(300)]
    rows += [(300, rows[50][1]), (301, rows[50][1]), (302, None), (303, [0.0] * 16), (304, [float("nan")] * 16), (None, rows[1][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame.filter("vec_id % 50 = 0"), block_rows=64, query_rows=3).collect()
    usable = {i: np.array(v) for i, v in rows[:302]}
    for q in range(0, 301, 50):
        score = {i: float(v @ usable[q] / math.sqrt((v @ v) * (usable[q] @ usable[q]))) for i, v in usable.items() if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert ann.nearest(frame.limit(0), frame).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_least_hashed_rows_are_those_of_a_full_sort(spark):
    from pyspark.sql import functions as F

    from labelloom.llm.common import least_hashed

    rows = spark.range(20_000)
    got = {r["id"] for r in least_hashed(rows, 500, "id").collect()}
    assert got == {r["id"] for r in rows.orderBy(F.xxhash64("id")).limit(500).collect()}
    assert least_hashed(rows.limit(0), 500, "id").count() == 0
    assert least_hashed(rows.limit(3), 500, "id").count() == 3


def test_overlaps(spark):
    rng = random.Random(6)
    spans = sorted((a, 0, a + rng.randrange(1, 9)) for a in rng.sample(range(300), 40))
    cover = pii.Cover(spans)
    for _ in range(500):
        a = rng.randrange(300)
        s = (a, 1, a + rng.randrange(1, 9))
        assert cover.meets(s) == any(x < s[2] and s[0] < y for x, _, y in spans)


def test_sums_of_runs_are_those_of_reduceat():
    """Runs short and long, to the bit; most runs of a mini-batch are short, where reduceat is slow."""
    rng = np.random.default_rng(5)
    for times in (np.ones(9, int), np.arange(1, 30), rng.integers(1, 12, 500), np.array([700, 1, 8, 9, 300, 7]), np.array([12])):
        rows = rng.standard_normal((times.sum(), langmodel.CLASSES)).astype(np.float32)
        first = np.cumsum(times) - times
        assert (langmodel.sums_of_runs(rows, first, times) == np.add.reduceat(rows, first, axis=0)).all()
