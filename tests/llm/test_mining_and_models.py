"""Hard negatives, fill-in-middle and the language model against brute force, on small tables with nulls, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceforge.llm import fim, hardneg, lm

from .test_operators import AWKWARD, documents

VECTORS = "vec_id long, embedding array<float>, label int, rank string, q int"


def mined_by_loops(rows):
    sound = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) <= 32768 for x in v)]
    out = Counter()
    for a, own, v in sound:
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in sound if i != a]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == own][:5]:
            good = [s for s in scored if s[2] != own and 50 * p <= 100 * s[0] <= 95 * p][:3]
            for rank, (n, j, _) in enumerate(good, 1):
                out[a, i, rank, j, p, n] += 1
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_hard_negatives_are_those_of_loops(spark, monkeypatch, block):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    rnd = random.Random(block)
    f32 = lambda x: float(np.float32(x))
    vector = lambda n: [f32(rnd.gauss(0.1, 0.3)) for _ in range(n)]
    same = vector(6)
    rows = [(i, same if i % 9 == 0 else vector(6), rnd.randrange(3)) for i in range(300)]
    rows += [(400, None, 1), (401, [None, 1.0], 1), (402, [math.nan] * 6, 1), (403, [math.inf] * 6, 1), (404, vector(6), None), (None, vector(6), 1), (450, [], 1), (500, vector(3), 2), (550, [f32(-3e4)] * 6, 0), (551, [f32(3e4)] * 6, 0), (552, [f32(3e4)] * 6, 1)]
    rows += [(50, vector(6), 1), rows[100], rows[63], (600, same, 0), (650, same, 1)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], VECTORS)
    assert Counter(map(tuple, hardneg.hard_negatives(table).collect())) == mined_by_loops(rows)


def test_hard_negatives_of_nothing(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hardneg.hard_negatives(spark.createDataFrame([(50, [1.0], 1, None, None)], VECTORS)).count() == 0


def test_packed_products_are_exact():
    rnd = np.random.default_rng(3)
    for low, high, dims in [(-5, 5, 3), (-(1 << 23), 1 << 23, 64), (0, 1, 1), (7, 9, 8192)]:
        q, v = rnd.integers(low, high + 1, (40, dims)), rnd.integers(low, high + 1, (5, dims))
        packed = hardneg.Packed(q, int(v.max()) - min(0, int(v.min())))
        assert all((packed.scores(a) == q @ a).all() for a in v)


def moved_by_slices(i, text):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[x : x + 8], 16) for x in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_is_that_of_slices(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["a", "ß", "あ", "😀", "\n", "<", "P>", "S", ">", "\x00"]) for _ in range(rnd.choice([1, 5, 40, 3000]))) for _ in range(300)]
    rows = AWKWARD + [(7, "a<S>b"), (8, "<P"), (8, "<P")] + [(10 + i, t) for i, t in enumerate(texts)]
    expected = [moved_by_slices(i, t or "") for i, t in rows]
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    made = fim.transform(documents(spark, rows))
    assert Counter(map(tuple, made.collect())) == Counter(expected)
    back = made.select("doc_id", fim.restored("output", "form").alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = Counter((*e[:5], sha(e[5]), sha(t or "")) for e, (_, t) in zip(expected, rows))
    assert Counter(map(tuple, fim.digests(documents(spark, rows)).collect())) == wanted
    assert fim.digests(documents(spark, [])).count() == 0


def test_cuts_by_other_units(spark):
    text = "  " + "eins zwei drei " * 400 + "ende"
    tree = fim.BlockTree(text.encode(), __import__("re").compile(r"\S+\s*"))
    starts = [0, *[i for i in range(3, len(text)) if text[i - 1] == " " and text[i] != " "]]
    assert tree.n_units == len(starts)
    assert all(tree.cut(k) == (len(text[:at].encode()), at) for k, at in enumerate(starts)) and tree.cut(len(starts)) == (len(text), len(text))
    row = fim.transform(documents(spark, [(4, text)]), unit=r"\S+\s*").first()
    assert row.n == len(starts) and spark.createDataFrame([row]).select(fim.restored("output", "form")).first()[0] == text


def corpus():
    rnd = random.Random(7)
    follows = {w: [rnd.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        words = [rnd.choice("abcdefghijklmnop")]
        while len(words) < 30:
            words.append(rnd.choice(follows[words[-1]]))
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words)))
    return rows + [(1000, "quite unknown words a b"), (1001, "a\x1cb\x85c ä Ä \x0b a"), *AWKWARD]


def test_language_model_counts_and_gain(spark):
    rows = corpus()
    train = [(i, t) for i, t in rows if (0 if i is None else zlib.crc32(str(i).encode()) % 7) != 2]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = lm.score_documents(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter(
        (i, (i, t) not in train, len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, t in rows
    )
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    per_token = lambda c: 10 ** (-sum(r[c] for r in held) / sum(r.n_tokens for r in held))
    assert per_token("score") < 3.5 < per_token("base_score")  # two words follow each word
    assert all(r.score < 0 for r in got)
    by_fold = {r.held_out: r for r in lm.perplexity(lm.score_documents(documents(spark, rows))).collect()}
    assert by_fold[True].perplexity < by_fold[True].base_perplexity


def test_language_model_of_nothing(spark):
    assert lm.score_documents(documents(spark, [])).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_documents(documents(spark, [(held, "a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score == pytest.approx(0)


def test_hot_words_and_small_chunks_change_no_counts(spark, monkeypatch):
    docs = documents(spark, corpus())
    plain = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "HOT_SHARE", 0.05)
    monkeypatch.setattr(lm, "CHUNK_DOCS", 9)
    split = {(r.doc_id, r.n_tokens): r for r in lm.score_documents(docs).collect()}
    assert plain.keys() == split.keys()
    for k, r in plain.items():
        s = split[k]
        assert (r.n_known, r.train_tokens, round(r.base_score, 6)) == (s.n_known, s.train_tokens, round(s.base_score, 6))
        assert r.score == pytest.approx(s.score, rel=0.3)  # seating is drawn anew
    assert sum(r.score for r in plain.values()) == pytest.approx(sum(r.score for r in split.values()), rel=0.01)


def by_seating(c, a, d):
    """Weights of t tables, summed over the table of each customer in turn."""
    weights = {1: a}
    for i in range(1, c):
        new = Counter()
        for t, w in weights.items():
            new[t] += w * (i - d * t) / (i + a)
            new[t + 1] += w * a / (i + a)
        weights = new
    return np.array([weights[t] for t in range(1, c + 1)]) / sum(weights.values())


def test_table_counts_follow_the_conditional():
    rng, d = np.random.default_rng(1), 0.6
    table = lm.stirling(d, lm.EXACT)
    for c, a in [(2, 0.3), (5, 2.0), (40, 0.01), (64, 30.0)]:
        p = by_seating(c, a, d)
        drawn = np.bincount(lm.draw_tables(np.full(40_000, c), np.full(40_000, a), d, table, rng), minlength=c + 1)[1:] / 40_000
        assert np.abs(drawn - p).max() < 0.015
    for c, a in [(200, 5.0), (200, 80.0), (500, 0.001), (300, 5000.0)]:
        p, t = by_seating(c, a, d), np.arange(1, c + 1)
        drawn = lm.draw_tables(np.full(20_000, c), np.full(20_000, a), d, table, rng)
        mean = (p * t).sum()
        assert drawn.mean() == pytest.approx(mean, rel=0.04, abs=0.3) and drawn.std() == pytest.approx(math.sqrt((p * t * t).sum() - mean**2), rel=0.2, abs=0.4)


def test_probabilities_of_a_context_come_to_one(spark):
    docs = documents(spark, [(i, t) for i, t in corpus() if i is not None]).select("doc_id", "text", F.lit(True).alias("train"))
    vocab = lm.vocabulary(docs)
    model = lm.merge(lm.chunks(docs, vocab, 1), vocab).where("shard >= 0").first()
    shard = lm.Shard(0, model.dishes, vocab)
    table = spark.createDataFrame([(0, model.dishes)], "shard long, dishes binary")
    seen, tables, state = lm.counts_of_counts(table, vocab)
    state = lm._with_gammas(state, tables, 3)
    samples = [lm._after(state, s, vocab, i) for i, s in enumerate(lm.sampled(table, vocab, state, 2).T)]
    p = 10 ** lm.log_probabilities(shard, state, seen, samples)
    per_context = np.bincount(shard.k, p, lm.CONTEXTS)
    # words that never follow a context get the parent's share: add it up for one context by its own formula
    k = int(shard.k[np.argmax(shard.c)])
    rest = 0.0
    fresh = lm.Shard(0, model.dishes, vocab)
    for i, _ in enumerate(fresh.sweeps(state)):
        if i:
            t, after = samples[i - 1]
            customers, root = fresh.parent.astype(float), fresh.root.astype(float)
            words, first = np.unique(fresh.words, return_index=True)
            customers[fresh.hot], root[fresh.hot] = after.hot_customers[fresh.hot_place[fresh.hot]], after.hot_tables[fresh.hot_place[fresh.hot]]
            new = (lm.PARENT_STRENGTH + after.parent_discount * after.tables) / (vocab.types + 1)
            parent = (customers - after.parent_discount * root + new) / (lm.PARENT_STRENGTH + after.customers)
            assert parent[first].sum() + new / (lm.PARENT_STRENGTH + after.customers) == pytest.approx(1)
            unseen = 1 - sum(parent[np.flatnonzero(fresh.words == w)[0]] for w in set(fresh.words[fresh.group[fresh.k == k]].tolist()))
            rest += (lm.STRENGTH + after.discount * t[k]) / (lm.STRENGTH + seen[k]) * unseen / len(samples)
    assert per_context[k] + rest == pytest.approx(1)


def test_ftrl_is_that_of_a_plain_loop():
    from paceforge.llm import toxicity

    rnd = random.Random(3)
    rows = [(np.array(sorted({0, *rnd.sample(range(1, 40), 5)})), rnd.randrange(2)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.7, 1.3, 0.4, 0.1
    z, n = [0.0] * 40, [0.0] * 40

    def weight(i):
        rate = (beta + math.sqrt(n[i])) / alpha + l2
        if i == 0:
            return -z[i] / rate
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / rate

    for _ in range(3):
        for features, y in rows:
            w = {i: weight(i) for i in features.tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(toxicity.ftrl(rows, 40, 3, alpha, beta, l1, l2), [weight(i) for i in range(40)])
    assert 0 < np.count_nonzero(toxicity.ftrl(rows, 40, 3, alpha, beta, 2.0, l2)) < 40


def test_ordinal_steps_follow_the_likelihood():
    from paceforge.llm import quality

    def loss(w, raw, share, grade):
        t = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
        above = 1 / (1 + np.exp(-(w @ share - t)))
        return -math.log(np.concatenate([[1.0], above])[grade] - np.concatenate([above, [0.0]])[grade])

    share, start = np.array([0.5, -1.0, 2.0]), np.array([-1.0, math.log(0.5)])
    for grade in range(3):
        w, t = quality.ordinal_fit([(np.arange(3), share, grade)], 3, 3, 1, 0.5, 0.0)
        slope = np.array([(loss(e, start, share, grade) - loss(-e, start, share, grade)) / 2e-6 for e in np.eye(3) * 1e-6])
        assert np.allclose(w, -0.5 * slope / np.sqrt(1e-8 + slope**2), atol=1e-6)
        gap = np.array([(loss(np.zeros(3), start + e, share, grade) - loss(np.zeros(3), start - e, share, grade)) / 2e-6 for e in np.eye(2) * 1e-6])
        raw = start - 0.05 * gap / np.sqrt(1e-8 + gap**2)
        assert np.allclose(t, [raw[0], raw[0] + math.exp(raw[1])], atol=1e-6)


def test_secret_links_against_all_pairs(spark):
    from paceforge.llm import secrets

    rnd, scope = random.Random(8), 50
    rank = {k.name: i for i, k in enumerate(secrets.KINDS)}
    rows = []
    for key in range(12):
        spans = set()
        for _ in range(rnd.randrange(1, 14)):
            kind, start = rnd.choice(secrets.KINDS), rnd.randrange(0, 900)
            spans.add((start, rank[kind.name], kind.name, start + rnd.randrange(1, 120)))
        rows.append((f"k{key}", sorted(s for s in spans if not secrets.KINDS[s[1]].weak), sorted(s for s in spans if secrets.KINDS[s[1]].weak)))
    span = "array<struct<start:int,rank:int,kind:string,end:int>>"
    found = {r.key: [tuple(s) for s in r.linked] for r in secrets.link(spark.createDataFrame(rows, f"key string, base {span}, weak {span}"), scope).collect()}
    expected = {}
    for key, base, weak in rows:
        kept = []
        for s in weak:
            near = {secrets.KINDS[p[1]].role for p in base + weak if p[0] - s[3] <= scope and s[0] - p[3] <= scope}
            if set(secrets.PARTNERS[secrets.KINDS[s[1]].role]) <= near:
                kept.append(s)
        if kept:
            expected[key] = kept
    assert found == expected and expected
