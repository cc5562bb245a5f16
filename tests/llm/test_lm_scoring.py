"""The attention model against loops in plain Python, and the operator against a whole recomputation."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import attention, encode, lm_scoring
from tidewater.llm.attention import Net, lay, windows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOWER))


def small(size=400, seed=0):
    net = Net.start(np.sort(np.random.default_rng(seed).integers(0, 900, size))[::-1].copy(), seed)
    rng = np.random.default_rng(seed + 1)
    for name, x in net.params.items():
        x += rng.normal(0, 0.2, x.shape).astype(np.float32)
    return net


def test_windows_score_each_place_once():
    lens = np.array([1, 63, 64, 65, 120, 121, 1000])
    text, begin, since = windows(lens)
    for k, n in enumerate(lens):
        seen = collections.Counter(p for t, b, s in zip(text, begin, since) if t == k for p in range(b + s, min(b + attention.WINDOW, n)))
        assert seen == collections.Counter(range(n))
        assert all(s == attention.OVERLAP for t, b, s in zip(text, begin, since) if t == k and b)


def test_gradient(monkeypatch):
    monkeypatch.setattr(attention, "f32", np.float64)
    monkeypatch.setattr(attention, "_ROOM", {})
    monkeypatch.setattr(attention, "_CAUSAL", {})
    net = small()
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(0)
    x, x2, y = (rng.integers(0, 400, (3, 6)) for _ in range(3))
    y[0] = [0, 127, 128, 300, 399, 200]
    valid = np.ones((3, 6), bool)
    valid[1, 3:] = False
    _, grads = net.loss(x, x2, y, valid)
    for name, p in net.params.items():
        rows, values = grads[name]
        whole = np.zeros_like(p)
        whole[slice(None) if rows is None else rows] = values
        spots = [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]
        top = np.argsort(-np.abs(whole).reshape(-1))[:4]
        for at in spots + [np.unravel_index(k, p.shape) for k in top]:
            old = p[at]
            side = []
            for step in (1e-5, -1e-5):
                p[at] = old + step
                side.append(net.loss(x, x2, y, valid)[0])
            p[at] = old
            # The loss is in bits, whose gradient by a state lacks the factor that the base brings.
            assert math.isclose((side[0] - side[1]) / 2e-5, whole[at], rel_tol=1e-4, abs_tol=1e-7), (name, at)


def test_states_are_causal():
    net, x = small(), np.random.default_rng(2).integers(0, 400, (2, 20))
    y = x.copy()
    y[:, 12:] = 7
    a, b = (net.states(v, v)[0].reshape(2, 20, -1)[:, :12].copy() for v in (x, y))
    assert np.allclose(a, b, atol=1e-5)


def test_probabilities_of_all_continuations_sum_to_one():
    net = small()
    z = net.states(np.array([[3, 5, 399]]), np.array([[400, 3, 5]]))[0].copy()
    for row in z:
        logs = net.log_probs(np.repeat(row[None], 400, axis=0), np.arange(400))
        assert math.isclose(np.exp2(logs.astype(float)).sum(), 1, rel_tol=1e-4)


def test_states_outside_the_plain_range():
    net = small()
    for name in ("q", "k"):
        net.params[name] *= 40
    net.params["next"] *= 300
    ids = np.random.default_rng(3).integers(0, 400, 90)
    assert np.isfinite(net.score(ids, np.array([0, 40, 90]))).all()
    assert np.allclose(net.score(ids, np.array([0, 40, 90])), [naive(net, ids[:40]), naive(net, ids[40:])], rtol=1e-3)


def naive(net, ids):
    """log10 probability, one window and one place at a time, with loops."""
    p = {k: v.astype(np.float64) for k, v in net.params.items()}
    size, total = net.size, 0.0
    past = [size, size, *ids]
    begin, scored = 0, 0
    while scored < len(ids):
        end = min(begin + attention.WINDOW, len(ids))
        e = [p["now"][past[i + 1]] + p["before"][past[i]] + p["place"][i - begin] for i in range(begin, end)]
        for i in range(scored, end):
            q = e[i - begin] @ p["q"] / math.sqrt(attention.KEYS)
            a = np.array([q @ (e[j] @ p["k"]) for j in range(i - begin + 1)])
            a = np.exp2(a - a.max())
            r = e[i - begin] + sum(w * (e[j] @ p["v"]) for j, w in enumerate(a)) / a.sum()
            z = r + np.maximum(r @ p["in"] + p["lift"], 0) @ p["out"]
            logits, head = p["next"] @ z + p["bias"], int(net.cuts[0])

            def share(rows, at):
                x = logits[rows]
                return logits[at] - x.max() - math.log2(np.exp2(x - x.max()).sum())

            y = int(ids[i])
            first = [*range(head), *range(size, len(logits))]
            if y < head:
                total += share(first, y)
            else:
                c = int(np.searchsorted(net.cuts, y, "right") - 1)
                total += share(first, size + c) + share(list(range(net.cuts[c], net.cuts[c + 1])), y)
        scored, begin = end, begin + attention.WINDOW - attention.OVERLAP
    return total * math.log10(2)


def test_score_equals_loops():
    net, rng = small(), np.random.default_rng(5)
    lens = [1, 2, 64, 65, 130, 3, 64]
    ids, at = rng.integers(0, 400, sum(lens)), np.concatenate([[0], np.cumsum(lens)])
    got = net.score(ids, at)
    for k in range(len(lens)):
        assert math.isclose(got[k], naive(net, ids[at[k] : at[k + 1]]), rel_tol=1e-4)


def test_training_learns_what_follows_what():
    net = Net.start(np.full(60, 10), 1)
    texts = [np.array([60, 60, *[(7 * k + s) % 59 for k in range(30)]]) for s in range(59)]
    _, losses = attention.train(net, texts, np.zeros(59, int), 300, 0.01)
    assert np.mean(losses[-20:]) < 1.5 < 5 < losses[0]
    x, x2, y = lay([texts[0], texts[1][:10]], net.size)
    assert x.shape == (2, 30) and (y[1, 8:] == 0).all()


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(150)]
    odd = [None, "", " \n\t", "a", "One two", "É x y  z", "x\t y\x1c.\x1c", "日本語 テキスト。 a", "don't … .a! 12a 3,4", "<|endoftext|> a", "İstanbul ΣΑΣ."]
    rows = [(i, t) for i, t in enumerate(odd)] + [(100 + k, " ".join(rng.choice(vocab, rng.integers(5, 150)))) for k in range(120)]
    rows += [(None, "a null id"), (130, "a repeated id"), (130, "a repeated id"), (400, " ".join(rng.choice(vocab, 9000)))]
    return spark.createDataFrame([(i, t, 1, 2, "x", 3.0) for i, t in rows], "doc_id long, text string, n int, kind int, data string, score double")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_operator_equals_a_recomputation(texts):
    gathered = lm_scoring.gather(texts, lm_scoring.held_out(F.col("doc_id")))
    model, counts = lm_scoring.train(gathered)
    rows = lm_scoring.score(gathered, model, counts).collect()
    full = encode.encoder(lm_scoring.VOCABULARY, encode.BYTE).full
    have = [(r["doc_id"], r["text"]) for r in texts.collect()]
    often, ends, ids_seen = collections.Counter(), 0, collections.Counter()
    spelled = lambda t: [*(i for w in words(t) for i in full.encode(" " + w, add_special_tokens=False).ids), full.get_vocab_size()]
    for i, t in have:
        if not held(i):
            often.update(words(t))
            ends += 1
            ids_seen.update(spelled(t))
    n, v = sum(often.values()) + ends, len(often) + 1
    assert model.unseen == full.get_vocab_size() + 1 - len(ids_seen)
    want = collections.Counter()
    for i, t in have:
        w = words(t)
        base = sum(math.log10((often[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        ranks = model.rank[spelled(t)]
        score = naive(model.net, ranks) if len(ranks) < 700 else None
        if score is not None:
            score -= math.log10(model.unseen) * int((ranks == model.net.size - 1).sum())
        want[i, held(i), len(w) + 1, sum(often[x] > 0 for x in w) + 1, n, round(base, 6), None if score is None else round(score, 1)] += 1
    got = collections.Counter()
    for r in rows:
        long = r["n_tokens"] > 5000
        near = [k for k in want if k[0] == r["doc_id"] and k[2] == r["n_tokens"] and k[6] is not None and abs(k[6] - r["score"]) < 0.11]
        got[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), None if long else near[0][6] if near else r["score"]] += 1
    assert got == want


def test_the_cache_of_words_changes_nothing(texts, monkeypatch):
    def scores():
        gathered = lm_scoring.gather(texts, lm_scoring.held_out(F.col("doc_id")))
        return sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm_scoring.score(gathered, *lm_scoring.train(gathered)).collect()))

    whole = scores()
    monkeypatch.setattr(lm_scoring, "WORDS", 3)
    monkeypatch.setattr(lm_scoring, "KEPT_WORDS", 40)
    for a, b in zip(whole, scores(), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], rtol=1e-4)


def test_rounds_train_on_every_window_that_is_kept(texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARE", 1)
    monkeypatch.setattr(lm_scoring, "SEED_STEPS", 1)
    gathered = lm_scoring.gather(texts, lm_scoring.held_out(F.col("doc_id")))
    kept = gathered.filter(F.col("kind") == lm_scoring.WINDOW)
    lens = [len(r["data"]) // 4 - 2 for r in kept.filter("c = 1").collect()]
    all_ids = sum(r["c"] for r in gathered.filter(F.col("kind") == lm_scoring.ID).collect())
    scored = sum(n - (r["g"]) for n, r in zip(lens, kept.filter("c = 1").collect()))
    assert scored == all_ids  # each id of each training document counts in one window
    before = lm_scoring.ROUNDS
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)
    untrained, _ = lm_scoring.train(gathered)
    monkeypatch.setattr(lm_scoring, "ROUNDS", before)
    trained, _ = lm_scoring.train(gathered)
    data = [r["data"] for r in kept.collect()][:200]
    loss = lambda m: m.net.loss(*lay(lm_scoring._ranked(data, m.rank), m.net.size), np.ones((len(data), max(map(len, data)) // 4 - 2), bool))[0]
    assert loss(trained) < loss(untrained)


def test_all_windows_of_training_documents_train(texts, monkeypatch):
    """As the module is: each id of each training document counts in one window that trains, and tasks leave none out."""
    gathered = lm_scoring.gather(texts, lm_scoring.held_out(F.col("doc_id")))
    kept = gathered.filter((F.col("kind") == lm_scoring.WINDOW) & (F.col("c") == 1)).collect()
    all_ids = sum(r["c"] for r in gathered.filter(F.col("kind") == lm_scoring.ID).collect())
    assert sum(len(r["data"]) // 4 - 2 - r["g"] for r in kept) == all_ids
    net = attention.Net.start(np.array([5, 3, 2, 0]))
    rng, seen = np.random.default_rng(1), []
    monkeypatch.setattr(attention, "lay", lambda ids, start, lay=attention.lay: seen.extend(int(x[0]) for x in ids) or lay(ids, start))
    adam = None
    for lo in (0, 100, 200):
        ids = [np.concatenate([[lo + k, 0], rng.integers(0, 3, 5)]) for k in range(100)]
        monkeypatch.setattr(net, "loss", lambda *x: (0.0, {}))
        adam, _ = attention.train(net, ids, np.zeros(100, int), -(-100 // 32), 0.01, batch=32, adam=adam)
    assert {*seen} == {*range(300)} and adam.steps == 12


def test_words_that_share_a_hash(monkeypatch):
    speller = lm_scoring.Speller(lm_scoring.VOCABULARY)
    monkeypatch.setattr(lm_scoring.wh, "hash_spans", lambda buf, starts, lens, seed=0: np.full(len(starts), 5, np.uint64))
    for text in (b"one two three one", b"two four one"):
        buf, starts, lens, first = lm_scoring.lower_words([text])
        ids, _ = speller.spelled(speller.rows(buf, starts, lens), first)
        want = [i for w in text.decode().split() for i in speller.coder.full.encode(" " + w, add_special_tokens=False).ids]
        assert ids.tolist() == [*want, speller.end]
