"""Links, spans and windows that need the whole table: crowds, other notations, hot seeds, rare words."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from test_operators import _components, _sets

from labelloom.llm import neardup, pii, suffixes, toxicity


def _crowd(n, template, own, shared, seed):
    """Texts with one template; texts 2k and 2k + 1 share a few words more, which links them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(1 << 40)}"
    head, texts = [word() for _ in range(template)], []
    for _ in range(n // 2):
        both = [word() for _ in range(shared)]
        texts += [" ".join([*head, *both, *[word() for _ in range(own - shared)]]) for _ in range(2)]
    return texts


def test_crowds_hide_no_link(spark):
    texts = _crowd(800, 84, 16, 3, 1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _components(range(len(texts)), _sets(texts))
    assert sum(k != v for k, v in want.items()) == 400
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_groups(frame).collect()} == want


def _card(rng):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def test_other_notations_are_added(spark):
    rng = random.Random(4)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    ip = lambda sep, top: sep.join([*[str(rng.randrange(10, 250)) for _ in range(3)], str(top)])
    texts = []
    for _ in range(400):
        c = _card(rng)
        texts += [
            f"write to {name()}@{name()}.com or call +1 {number(3)} {number(3)} {number(4)} now",
            f"host {ip('.', rng.randrange(9, 250))} paid by card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}",
            f"we met at {name()}. Then {name()} left on {number(4)}-{number(2)}-{number(2)}",
            f"version {ip('.', 999)} part {number(4)}.{number(4)}.{number(4)}.{number(3)}",
            # what the corpus holds of the other notations says nothing against them
            f"write to {name()} (at) {name()} (dot) com or call {number(3)} {number(3)} {number(4)}",
            f"host {ip(':', rng.randrange(9, 250))} paid by card {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}",
        ]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    wanted = ([0, 3], [1, 2])
    for at, kinds in zip((4, 5), wanted, strict=True):
        added = [[s[1] for s in pii.find(t, model)[1]] for t in texts[at::6]]
        assert sum(k == kinds for k in added) > 0.9 * len(added), added[:5]
    prose = [pii.find(t, model)[1] for t in texts[2::6]]
    assert sum(map(bool, prose)) < 0.05 * len(prose)


def test_other_numbers_are_left_alone(spark):
    """Failing cards, parts over 255, dates, book and order numbers; real ones in other notations are still found."""
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))

    def failing_card():
        digits = "4" + number(15)
        return digits if not pii.luhn(digits) else failing_card()

    def book():
        digits = "978" + number(9)
        return digits + str(-sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(digits)) % 10)

    def grouped(digits, sep):
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    texts, wrong, right = [], [], []
    for n in range(500):
        c, b, f = _card(rng), book(), failing_card()
        ip = [rng.randrange(1, 250) for _ in range(4)]
        texts.append(f"write to {word()}@{word()}.com or call +1 {number(3)} {number(3)} {number(4)} now")
        texts.append(f"host {'.'.join(map(str, ip))} paid by card {grouped(c, ' ')}")
        bad = [
            f"paid by card {grouped(f, '.-_/'[n % 4])} today", f"server {ip[0]}:{ip[1]}:{rng.randrange(256, 999)}:{ip[3]} is up",
            f"call on 20{number(2)}-0{rng.randrange(1, 9)}-1{number(1)} 1{number(1)}00 or later", f"the book {b[:3]}-{b[3]}-{b[4:6]}-{b[6:12]}-{b[12]} by {word()}",
            f"order {number(4)}.{number(4)}.{number(4)}.{number(4)} of {word()}", f"part {number(3)}-{number(3)}-{number(4)} for {word()}",
        ]
        good = [f"paid by card {grouped(c, '._/'[n % 3])} today", f"server {':'.join(map(str, ip))} is up", f"call {number(3)} {number(3)} {number(4)} now",
                f"write to {word()} (at) {word()} (dot) com now"]
        texts += bad + good
        wrong.append(bad)
        right.append(good)
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for column in range(6):
        added = [t[column] for t in wrong if pii.find(t[column], model)[1]]
        assert len(added) < 0.02 * len(wrong), added[:3]
    for kind, column in enumerate((3, 1, 0, 2)):
        found = sum([s[1] for s in pii.find(t[column], model)[1]] == [kind] for t in right)
        assert found > 0.9 * len(right), (kind, found)


def test_no_added_span_fails_the_checks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.fit(docs)
    added = []
    for r in docs.collect():
        text = r["text"] or ""
        base, every = pii.find(text, model)
        added += [text[a:e] for a, k, e in every if (a, k, e) not in base and pii.refused(text[a:e], k)]
    assert added == []


def test_repeated_ids_lose_no_text(spark):
    """A row goes only if its own text has a near copy under a smaller id."""
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    near = a.replace(a.split()[30], "other")
    rows = [(3, a), (7, a), (7, b), (8, near), (8, c), (9, c), (9, c), (9, b), (2, None), (2, ""), (None, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.drop_near_copies(frame).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (8, c), (2, None), (2, ""), (None, a)], key=str)
    groups = {(r["doc_id"], r["component_id"]) for r in neardup.near_groups(frame).collect()}
    assert groups == {(3, 3), (7, 3), (7, 7), (8, 3), (8, 8), (9, 8), (9, 7), (2, 2), (None, None)}
    many = spark.createDataFrame([(1, a)] * 3000 + [(5, near)] * 3000, "doc_id long, text string")
    assert neardup.drop_near_copies(many).count() == 3000


def test_models_do_not_depend_on_the_order_of_rows(spark):
    """Copies of a text with differing labels, in any order, give one model."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(300)}"
    texts = [" ".join([*[word() for _ in range(30)], *(["vile", "foul"] * 3 if n % 4 == 0 else [])]) for n in range(300)]
    docs = [(n, texts[n % 300]) for n in range(900)]
    labels = [(n, 1, int(n % 4 == 0) if n < 600 else 0) for n in range(900)]
    models = []
    for parts in (1, 5):
        d = spark.createDataFrame(rng.sample(docs, 900), "doc_id long, text string").repartition(parts)
        t = spark.createDataFrame(rng.sample(labels, 900), "doc_id long, quality int, toxic int").repartition(parts)
        models.append(toxicity.fit(d, t))
    assert models[0] == models[1] and "vile" in models[0].weights


def _without_repeats(texts):
    """Removed bytes and hash of the rest, document by document."""
    seen, out = set(), []
    for t in texts:
        data = t.encode()
        mark, own = bytearray(len(data)), [data[k : k + 50] for k in range(len(data) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                mark[k : k + 50] = b"\1" * 50
        seen.update(own)
        out.append((sum(mark), hashlib.sha256(bytes(x for x, m in zip(data, mark, strict=True) if not m)).hexdigest()))
    return out


def test_hot_seeds_are_split(spark, monkeypatch):
    """Lines in every document, shorter and longer than a window, with other neighbours each time."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    short, long = "licensed under the same old terms\n", "this much longer notice stands in every document of the table\n"
    passage = [word(90) for _ in range(20)]
    texts = []
    for n in range(600):
        parts = [word(rng.randrange(0, 60)), short, word(rng.randrange(0, 60)), long, word(30)]
        texts.append("".join([*parts, passage[n % 20] if n % 3 == 0 else "", short if n % 7 == 0 else ""]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    sizes = []
    whole = suffixes.split_windows
    monkeypatch.setattr(suffixes, "split_windows", lambda blocks, path: sizes.append(blocks.count()) or whole(blocks, path))
    want = _without_repeats(texts)
    for hot_rows in (100, 1 << 19):
        rows = suffixes.cut_repeats(frame, hot_rows=hot_rows).collect()
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in rows}
        assert [got[n] for n in range(600)] == want
    assert len(sizes) == 1 and sizes[0] > 0


def test_text_clusters_are_fitted_on_all_training_texts(spark):
    """More texts than the 1,000 that were once sampled: two kinds, the rarer one and its words are seen as well."""
    import numpy as np

    from labelloom.llm import langmodel

    rows = [(i, "Der die das und " * 3 if i % 700 == 0 else "the cat sat on " * (1 + i % 3)) for i in range(4200)]
    used = [(i, t) for i, t in rows if langmodel.is_training(i)]
    top, centres = langmodel.text_clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want: dict[bytes, int] = {}
    for _, t in used:
        for w in t.lower().encode().split():
            want[w] = want.get(w, 0) + 1
    assert top == sorted(want, key=lambda w: (-want[w], w))
    kinds = [np.array([float(w in text.encode().split()) for w in top]) / 2 for text in ("der die das und", "the cat sat on")]
    best = [(centres @ k).argmax() for k in kinds]
    assert best[0] != best[1] and all(centres[b] @ k > 0.99 for b, k in zip(best, kinds, strict=True))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert not langmodel.text_clusters(empty)[1].any()


class _Dense:
    """Boosted trees of depth two over all rows at once, and thresholds from sorted scores."""

    def __init__(self, x, y, w, leaf=2.0, rate=0.3):
        share = np.average(y, weights=w)
        self.start = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        self.leaf, self.rate, self.trees = leaf, rate, []
        score = np.full(len(y), self.start)
        for _ in range(40):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self.grow(x, w * (y - p), w * p * (1 - p), 2))
            score = score + pii.Boosted()._walk(self.trees[-1], x)

    def grow(self, x, slope, bend, depth):
        best = (1e-6, None, None)
        for f, cuts in enumerate(self.edges if depth else []):
            for cut in cuts:
                left = x[:, f] <= cut
                if left.any() and not left.all():
                    gain = sum(slope[s].sum() ** 2 / (bend[s].sum() + self.leaf) for s in (left, ~left))
                    gain -= slope.sum() ** 2 / (bend.sum() + self.leaf)
                    best = (gain, f, cut) if gain > best[0] + 1e-9 else best
        if best[1] is None:
            return (self.rate * slope.sum() / (bend.sum() + self.leaf),)
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], *[self.grow(x[s], slope[s], bend[s], depth - 1) for s in (left, ~left)])


def test_trees_learn_from_all_candidates(spark):
    """More candidates than the 20,000 that were once sampled: trees and thresholds are those of all of them."""
    rng = random.Random(30)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for n in range(4000):
        parts = [f"host 10.{n % 250}.{rng.randrange(300)}.{rng.randrange(300)}", f"mail me{n % 9}@{'ab' * (1 + n % 4)}.org",
                 f"pay {number(4)} {number(4)} {number(4)} {number(4)}", f"call +{number(rng.randrange(8, 14))}, or {number(3)}-{number(3)}-{number(4)}"]
        texts.append(" and then ".join(rng.sample(parts, 4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.candidates(docs).toPandas()
    assert len(found) > 21_000
    x, y, w = np.stack(found["x"].to_list()), found["confirmed"].to_numpy(float), found["weight"].to_numpy()
    aside = np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in found["doc_id"]])
    model, want = pii.fit(docs), _Dense(x[~aside], y[~aside], w[~aside])
    same = pii.Boosted(want.trees, want.start)
    assert np.allclose(model.probability(x), same.probability(x), atol=1e-4)
    p = model.probability(x)
    for kind in range(4):
        mine = aside & (x[:, 0] == kind)
        good = [v for v in np.unique(p[mine]) if np.average(y[mine & (p >= v)], weights=w[mine & (p >= v)]) >= pii.PRECISION - 1e-12]
        low = good[0] if good and (mine & (p >= good[0])).sum() > 20 else pii.DEFAULT_THRESHOLD
        assert abs(model.thresholds[kind] - max(low, 0.5)) < 1e-9, kind
    assert pii.fit(docs.repartition(5)) == model


def test_toxic_words_are_learnt_from_all_labelled_texts(spark):
    """More labelled texts than the 40,000 that were once sampled: each counts, copies once."""
    rng = random.Random(31)
    rows = [(n, f"text {n} of {rng.randrange(1000)} words" + (" vile" if n % 500 == 0 else "")) for n in range(42_000)]
    rows += [(n + 50_000, t) for n, t in rows[:500]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = docs.selectExpr("doc_id", "int(doc_id % 500 = 0 and doc_id < 50000) as toxic")
    halves = [toxicity.labelled_texts(docs, labels, k).agg({"toxic": "sum", "text": "count"}).first() for k in (0, 1)]
    assert sum(h["count(text)"] for h in halves) == 42_000 and sum(h["sum(toxic)"] for h in halves) == 84
    model = toxicity.fit(docs, labels)
    counts = (Counter(), Counter())
    for r in toxicity.labelled_texts(docs, labels, 0).collect():
        counts[r["toxic"]].update({f for w in toxicity.words_of(r["text"]) for f in toxicity.features(w)})
    n0, n1 = (sum(c.values()) for c in counts)
    y, prior = counts[1]["vile"], counts[1]["vile"] * toxicity.PRIOR_SHARE + toxicity.PRIOR_LEAST
    every = (n0 + n1) * toxicity.PRIOR_SHARE + toxicity.PRIOR_LEAST
    want = math.log((y + prior) / (n1 + every - y)) - math.log(prior / (n0 + every))
    assert math.isclose(model.weights["vile"], want, rel_tol=1e-9)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == ("vile" in t) for i, t in rows)
