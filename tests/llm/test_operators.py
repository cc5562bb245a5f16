"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import gzip
import hashlib
import math
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import encode, language_id, line_dedup, lm_scoring, media, mixing, ngram_join, packing, quality, token_counts, token_ids, wordhash

SPACES = "[^\\x20\\x09-\\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "a", "one two", "É x y  z", "a  b   c\n\n d\n  e", "x\t y\x1c.\x1c", "日本語 テキスト。 a", "don't … .a! 12a 3,4", "<|endoftext|> a", "İstanbul ΣΑΣ."]


@pytest.fixture(scope="module")
def docs(spark):
    """Some hundred texts: odd ones, repeats, near copies, shared lines, a long one; columns with clashing names."""
    rng = np.random.default_rng(1)
    vocab = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(120)] for lang, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    rows = [(i, t, None, None) for i, t in enumerate(ODD)]
    texts = []
    for k in range(150):
        lang = "aa" if k % 3 else "bb"
        words = list(rng.choice(vocab[lang], rng.integers(5, 120)))
        if k % 5 == 0 and texts:
            text, lang = texts[int(rng.integers(len(texts)))]
            words = text.split(" ")
            words[int(rng.integers(len(words)))] = "changed"
        if k % 7 == 0:
            words.insert(3, "\nA Shared Line of text\n")
        texts.append((" ".join(words), lang))
        rows.append((100 + k, texts[-1][0], lang, f"s{k % 4}"))
    rows += [(400, *texts[3], "s1"), (400, *texts[3], "s1"), (401, " ".join(rng.choice(vocab["aa"], 20_000)), "aa", "s0")]
    frame = [(i, t, lang, s, len(t or ""), 1, 2, "x", 3.0) for i, t, lang, s in rows]
    return spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long, n int, token long, class string, score double")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def words(text):
    return re.findall(SPACES, text)


@pytest.mark.parametrize(("name", "mode"), [("word_bpe_49k.json", encode.WORD), ("byte_bpe_50k.json", encode.BYTE)])
def test_encoder_equals_library(name, mode, plain):
    own = encode.PieceEncoder(encode.tokenizer_path(name), mode)
    texts = [t for _, t in plain] + [t or "" for t in ODD]
    ids, at = own.encode([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert own.full.encode(t, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist(), t[:60]


_ENCODERS = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB '’.,!19\n\t  é×ßΣİ́日\x1c")), max_size=30), max_size=4))
def test_encoder_equals_library_on_any_text(texts):
    for name, mode in (("word_bpe_49k.json", encode.WORD), ("byte_bpe_50k.json", encode.BYTE)):
        own = _ENCODERS.setdefault(name, encode.PieceEncoder(encode.tokenizer_path(name), mode))
        ids, at = own.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert own.full.encode(t, add_special_tokens=False).ids == ids[at[k] : at[k + 1]].tolist()


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 5))
def test_blocks_round_trip(ids, docs):
    counts = np.diff(np.linspace(0, len(ids), docs + 1).astype(int))
    block = token_ids.encode_block([None, *range(1, docs)], counts, np.array(ids, np.uint32))
    got = token_ids.decode_block(block)
    assert got[0] == [None, *range(1, docs)] and got[1].tolist() == counts.tolist() and got[2].tolist() == ids
    with pytest.raises(ValueError):
        token_ids.decode_block(block[:-5] + bytes([block[-5] ^ 1]) + block[-4:])


def test_token_ids(docs, plain):
    own = encode.PieceEncoder(encode.tokenizer_path(token_ids.VOCABULARY), encode.WORD).full
    got = token_ids.read_blocks(token_ids.write_blocks(docs, block_ids=2000)).orderBy("start").collect()
    start = 0
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in plain)
    by_id = collections.defaultdict(list)
    for i, t in plain:
        by_id[i].append([*own.encode(t, add_special_tokens=False).ids, 2])
    for r in got:
        assert r["ids"] in by_id[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) and r["start"] == start
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, plain, rule):
    own = encode.PieceEncoder(encode.tokenizer_path(token_counts.VOCABULARY), encode.BYTE).full
    want = collections.Counter()
    for i, t in plain:
        ends, at = [], 0
        for line in t.split("\n"):
            at += len(line.encode()) + 1
            ends.append(at)
        ends[-1] -= 1
        spans, at = [], 0
        for token in own.encode(t, add_special_tokens=False).tokens:
            spans.append((at, at + len(token)))
            at += len(token)
        per, crossing = [0] * len(ends), 0
        for a, b in spans:
            inside = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends], ends)]
            hit = [k for k, n in enumerate(inside) if n]
            crossing += len(hit) > 1
            per[hit[0] if rule == "first" else hit[-1] if rule == "last" else max(hit, key=lambda k: (inside[k], -k))] += 1
        chars = [len(line) + 1 for line in t.split("\n")]
        chars[-1] -= 1
        want[i, len(spans), tuple(per), crossing, tuple(chars)] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["section_tokens"]), r["n_crossing"], tuple(r["section_chars"])) for r in token_counts.token_counts(docs, rule=rule).collect())
    assert got == want


def test_line_dedup(docs, plain):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    keeper = {}
    for i, t in plain:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                keeper[key(line)] = min(i, keeper.get(key(line), i))
    want = collections.Counter()
    for i, t in plain:
        lines = t.split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or keeper[key(x)] == i]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    got = line_dedup.dedup_lines(docs, batches=5)
    assert set(docs.columns) <= set(got.columns)
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == want


def brute_classes(plain):
    sets = collections.defaultdict(list)
    for i, t in plain:
        w = words(t.translate(LOWER))
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 4 * len(x & y) >= 3 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(s[0]) for i, s in sets.items()}


def test_ngram_join(docs, plain):
    classes, sizes = brute_classes(plain)
    assert len(set(classes.values())) < len(classes)
    for r in ngram_join.similar_classes(docs).collect():
        assert (r["component_id"], r["n_shingles"]) == (classes[r["doc_id"]], sizes[r["doc_id"]])


def test_ngram_join_of_chains_and_copies(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for step in range(1, 12):  # each near the one before, far from the first
        base[10 * step] = f"x{step}"
        rows.append((step, " ".join(base)))
    rows += [(20 + k, " ".join(base[:119] + [f"tail{k}"])) for k in range(40)] + [(90, "lone words here that nobody else has at all")]
    want, _ = brute_classes(rows)
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_ngram_join_of_copies_that_were_edited_one_by_one(spark, monkeypatch):
    """Two thousand copies of a text that is not there itself; few of their pairs are formed, and no class is missed."""
    rng = np.random.default_rng(9)
    base = [f"b{k}" for k in range(80)]

    def copies(n):
        rows = []
        for k in range(n):
            w = list(base)
            for j in rng.choice(80, int(rng.integers(1, 9)), replace=False):
                w[int(j)] = f"e{k}x{j}"
            rows.append((k, " ".join(w)))
        return rows

    def shingles(text):
        w = text.split(" ")
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    formed = {}
    candidates = ngram_join._candidates

    def counted(*args):
        out = candidates(*args)
        formed[n] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    for n in (500, 2000):
        rows = copies(n)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        sets = [shingles(t) for _, t in rows]
        common = [np.array([tuple(base[k : k + 5]) in s for k in range(76)]) for s in sets]  # edits of different copies never agree
        shared = np.array(common, np.int32) @ np.array(common, np.int32).T
        size = np.array([len(s) for s in sets])
        linked = (4 * shared >= 3 * (size[:, None] + size[None] - shared)) | np.eye(n, dtype=bool)
        label = np.arange(n)
        while True:
            least = np.where(linked, label[None], n).min(axis=1)
            if (least == label).all():
                break
            label = least
        assert got == dict(enumerate(label.tolist()))
    assert formed[2000] <= 0.05 * 2000 * 1999 / 2  # README has how it grows


def test_ngram_join_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b + " more"), (7, c), (None, a), (5, ""), (8, "")]
    want, _ = brute_classes([r for r in rows if r[0] is not None])
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)


def test_choose_matches_never_asks_for_more_than_must_be_shared():
    for n in range(1, 200):
        for level in (np.zeros(n, np.uint8), np.full(n, 9, np.uint8)):
            assert 1 <= ngram_join.choose_matches(level, n) <= -(-3 * n // 4)


def test_mixing(docs, plain):
    sizes = mixing.sized(docs)
    rows = mixing.mix(sizes).collect()
    source = collections.defaultdict(int)
    for r in docs.collect():
        source[r["source"]] += len(words(r["text"] or ""))
    names = sorted((s for s in source if s is not None)) + ([None] if None in source else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(source.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        held = {s for s in free if 3 * source[s] < level * weight[s]}
        if not held:
            target |= {s: level * weight[s] for s in free}
            break
        for s in held:
            target[s] = 3.0 * source[s]
            left -= target[s]
        free -= held
    by_size = {v: s for s, v in source.items()}
    taken = collections.defaultdict(int)
    for r in rows:
        s = by_size[r["source_size"]]
        assert math.isclose(r["target"], target[s], rel_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix(mixing.sized(docs)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mixed(docs).columns == docs.columns


def test_mixed_rows_meet_their_targets_whatever_their_ids(spark):
    rows = [(7 if k % 3 else None, " ".join(["w"] * 10), f"s{k % 2}", k, 0, 0) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `__id` int, number int, row int")
    got = collections.Counter(r["source"] for r in mixing.mixed(df).collect())
    assert abs(got["s0"] * 10 - 1000 / 3) <= 5 and abs(got["s1"] * 10 - 2000 / 3) <= 5
    each = collections.Counter(r["__id"] for r in mixing.mixed(df).collect())
    assert max(each.values()) <= 2 and mixing.mixed(df).columns == df.columns


def features(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(grams)
    places = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_quality_features(spark):
    texts = [*ODD, "a b c a b c a b c", "x\nx\n \nx", "a b a b a b a", "# $ %\n# $ %", "  nbsp is a word"]
    df = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    for r in quality.features(df).collect():
        want = features(texts[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (1, 10, 600, 5000) for k in (0, 1, 3, 12) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").withColumn("t", quality.log_tail(F.col("n"), F.col("k"), 0.01)).collect()
    for r in got:
        want = sum(math.comb(r["n"], i) * 0.01**i * 0.99 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert math.isclose(r["t"], math.log(want), abs_tol=1e-9)


RULES = {"symbols": (2, 1, 0.5), "shouts": (None, 1, 0.5), "dup_lines": (3, None, 1.0), "repeats": (4, 0, 0.5)}


def cells(text):
    f = features(text)
    lines = [x for x in text.split("\n") if words(x)]
    counts = {"symbols": (f[2], f[1]), "shouts": (text.count("!"), f[1]), "dup_lines": (f[3], len(lines)), "repeats": (f[4], f[0])}
    return {r: min(50, math.ceil(counts[r][0] / counts[r][1] / RULES[r][2] * 50)) if counts[r][1] else 0 for r in RULES}


def brute_cutoffs(rows, holdout, risk, delta, price=5):
    """rows: (doc_id, lang, text, quality); {lang: {rule: cell}}."""
    known = [(i, lang, cells(t), q > 0) for i, lang, t, q in rows if q is not None and len(words(t)) >= 50 and 100 * features(t)[4] <= 50 * len(words(t))]
    langs = {k[1] for k in known}
    n = collections.Counter(lang for i, lang, _, good in known if good and holdout[i])
    pooled = {lang for lang in langs if n[lang] < math.ceil(math.log(delta / len(langs)) / math.log(1 - risk))}
    stratum = {lang: "pool" if lang in pooled else (lang,) for lang in langs}
    out = {}
    for s in set(stratum.values()):
        own = [k for k in known if stratum[k[1]] == s]
        last = {}
        for r in RULES:
            worth = {c: sum(1 if not good else -price for i, _, cell, good in own if not holdout[i] and cell[r] > c) for c in range(50)}
            best = max(worth, key=lambda c: (worth[c], c))
            if worth[best] > 0:
                last[r] = best
        goods = [k for k in own if holdout[k[0]] and k[3]]
        step = 0
        for t in range(1, 11):
            k = sum(any(r in last and 10 * (50 - cell[r]) < t * (50 - last[r]) for r in RULES) for _, _, cell, _ in goods)
            if not last or sum(math.comb(len(goods), j) * risk**j * (1 - risk) ** (len(goods) - j) for j in range(k + 1)) > delta / len(set(stratum.values())):
                break
            step = t
        for lang in (x for x in langs if stratum[x] == s):
            out[lang] = {r: math.floor(50 - step * (50 - c) / 10) for r, c in last.items()} if step else {}
    return out


def test_quality_cutoffs_and_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(700):
        lang = ["aa", "bb", None, "cc", "dd"][int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.06, 0.04]))]
        text = " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))
        bad = rng.random() < 0.25
        mark = rng.random() if bad else rng.random() * 0.15
        kind = int(rng.integers(3))
        if kind == 0:
            text = " ".join(w + "$" * int(4 * mark) for w in text.split(" "))
        if kind == 1:
            text = text.replace(" ", "! " if mark > 0.5 else " ")
        if kind == 2:
            text += "\n" + "\n".join(["again this"] * int(12 * mark))
        rows.append((k, lang, text, None if rng.random() < 0.05 else int(not bad)))
    rows += [(k, "new", "few words", 1) for k in range(700, 705)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows if r[1] != "dd"] + [(None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    side = {r["doc_id"]: r["h"] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(3)) > 0).alias("h")).collect()}
    want = brute_cutoffs([r for r in rows if r[1] != "dd"], side, quality.RISK, quality.DELTA)
    assert any(want.values())
    found = quality.features(df)
    got = quality.cutoffs(found, labels).collect()
    assert {r["lang"]: {x: r[f"cut_{x}"] for x in RULES if r[f"cut_{x}"] is not None} for r in got} == want
    for r in quality.judged(found, labels).collect():
        _, lang, text, _ = rows[r["doc_id"]]
        cell = cells(text)
        assert r["kept"] == (not r["base_failed"] and all(cell[x] <= c for x, c in want.get(lang, {}).items()))


def test_cutoffs_hold_the_risk_of_all_rules_together(spark):
    """Good documents of which each rule alone would reject few, but all together too many."""
    plain = " ".join(f"word{k}" for k in range(60))
    marked = {0: plain.replace(" ", "$$ "), 1: plain.replace(" ", "!! "), 2: plain + "\nagain" * 40}
    rows = [(k, plain if k % 10 else marked[k // 10 % 3], 1) for k in range(900)] + [(900 + k, marked[k % 3], 0) for k in range(900)]
    df = spark.createDataFrame([(i, "aa", t) for i, t, _ in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    assert quality.judged(quality.features(df), labels).filter("not kept and doc_id < 900").count() <= 45
    kept = quality.judged(quality.features(df), labels, risk=0.2).filter("not kept").count()
    assert kept > 900  # with room for them the bad ones go


def test_packing(docs, plain):
    own = encode.PieceEncoder(encode.tokenizer_path(packing.VOCABULARY), encode.BYTE).full
    rows = packing.pack(docs).collect()
    want = collections.Counter()
    for i, t in plain:
        ids = [*own.encode(t, add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_mp4_boxes():
    box = lambda kind, body, size=None: struct.pack(">I4s", len(body) + 8 if size is None else size, kind) + body
    start = box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", b"\1" * 40)
    long = struct.pack(">I4sQ", 1, b"mdat", 516) + b"\2" * 500
    assert media._mp4(start + box(b"mdat", b"\2" * 500) + b"ABCDEFGH and text", 0, {}) == len(start) + 508
    assert media._mp4(start + long + b"ABCDEFGH and text", 0, {}) == len(start + long)
    assert media._mp4(start + box(b"mdat", b"\2" * 500, 0), 0, {}) == len(start) + 508
    for whole in (start + long, start + box(b"mdat", b"\2" * 500), box(b"ftyp", b"isom\0\0\2\0") + long + start[16:]):
        assert media._mp4(whole, 0, {}) == len(whole)
        assert media._mp4(whole[:-20], 0, {}) == 0
    assert media._mp4(start + long[:12], 0, {}) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_plan_uses_fewest_sequences(lengths):
    def fewest(left, bins):
        if not left:
            return len(bins)
        best = len(lengths) + 1
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] >= left[0]:
                best = min(best, fewest(left[1:], bins[:k] + [bins[k] - left[0]] + bins[k + 1 :]))
        return min(best, fewest(left[1:], [*bins, 12 - left[0]]))

    counts = np.bincount(lengths, minlength=13)
    plan = packing.plan(counts, 12)
    used = collections.Counter()
    for fill, times in plan:
        assert sum(fill) <= 12 and times > 0
        for x in fill:
            used[x] += times
    assert used == collections.Counter(lengths)
    assert sum(t for _, t in plan) == fewest(sorted(lengths, reverse=True), [])


def test_plan_finds_perfect_triples():
    counts = np.bincount([1045, 410, 307, 286] * 1400, minlength=2049)
    plan = packing.plan(counts)
    assert sum(t for _, t in plan) == 1400
    used = collections.Counter()
    for fill, times in plan:
        for x in fill:
            used[x] += times
    assert used == {1045: 1400, 410: 1400, 307: 1400, 286: 1400}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 12), max_size=9))
def test_plan_is_the_optimum(lengths):
    def fits(left, bins):
        return not left or any(fits(left[1:], [*bins[:k], b - left[0], *bins[k + 1 :]]) for k, b in enumerate(bins) if b >= left[0] and b not in bins[:k])

    left = sorted(lengths, reverse=True)
    fewest = next(n for n in range(len(left) + 1) if fits(left, [12] * n))
    assert sum(t for _, t in packing.plan(np.bincount(lengths, minlength=13), 12)) == fewest


def test_packing_keeps_few_enumerations(monkeypatch):
    """The search is as deep as there are fillings; its memory is not, and what it finds is the same as with all of them kept."""
    lengths = np.clip(np.random.default_rng(1).lognormal(5.9, 0.8, 3000), 1, 2048).astype(int)
    tracemalloc.start()
    packing.plan(3 * np.bincount(lengths, minlength=2049), max_nodes=800)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45e6, most
    rng = np.random.default_rng(2)
    for _ in range(8):
        counts, found = np.bincount(rng.integers(20, 60, 60), minlength=101), []
        for live in (10**9, 1, 3):
            monkeypatch.setattr(packing, "LIVE", live, raising=False)
            found.append(packing.plan(counts, 100, 500))
        assert found[0] == found[1] == found[2]


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"xx") + chunk(b"IEND", b"")


def test_sniffing():
    s = media.Sniffer()
    wav, gz, bmp = media.store(b"abc"), gzip.compress(b"hello" * 50), b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b",\0\0\0\0\1\0\1\0\0\x02\x02L\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd\x12\xff\0\x34\xff\xd9"
    for data, kind in ((png(), "image/png"), (wav, "audio/wav"), (gz, "application/gzip"), (bmp, "image/bmp"), (gif, "image/gif"), (jpeg, "image/jpeg")):
        assert s.sniff(data) == (kind, [])
        assert s.sniff(b"junk" + data + b"junk") == (media.UNKNOWN, [(4, len(data), kind)])
        assert s.sniff(data[:-3])[0] == media.UNKNOWN
    outer = media.store(b"xx" + png() + b"BM RIFF GIF89a PK\x03\x04")
    assert s.sniff(outer) == ("audio/wav", [(46, len(png()), "image/png")])
    assert s.sniff(None) == (None, []) and s.sniff(b"") == (media.UNKNOWN, [])


def test_media_column(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg", "a"), (2, None, None, "b"), (3, bytearray(b"?"), media.UNKNOWN, "c")], "id long, media binary, declared string, media_type string")
    rows = {r["id"]: r for r in media.sniffed(df, declared="declared").collect()}
    assert (rows[1]["media_type"], rows[1]["corrected"]) == ("image/png", True)
    assert (rows[2]["media_type"], rows[2]["corrected"], rows[3]["corrected"]) == (None, None, False)


@given(st.binary(max_size=200))
def test_store_is_lossless(payload):
    assert media.stored_payload(media.store(payload)) == payload


def test_media_query(spark, docs, plain, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op7_media(spark, str(tmp_path)).collect()
    by = dict(plain)
    for r in got:
        raw = by[r["doc_id"]].encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["feature"].startswith("audio/wav")
        stored = media.store(payload)
        assert (r["media_bytes"], r["media_sha256"], r["corrected"]) == (len(stored), hashlib.sha256(stored).hexdigest(), True)


def test_planted_media_with_wrong_declared_types(spark):
    gz, text = gzip.compress(b"hello" * 50), b"some text "
    rows = [
        (1, png(), "image/jpeg", "image/png", []),
        (2, text + png() + text + gz, "text/html", media.UNKNOWN, [(10, len(png()), "image/png"), (20 + len(png()), len(gz), "application/gzip")]),
        (3, media.store(png() + gz), "audio/wav", "audio/wav", [(44, len(png()), "image/png"), (44 + len(png()), len(gz), "application/gzip")]),
        (4, gz[:-4], "application/gzip", media.UNKNOWN, []),
        (5, png()[:-2] + text, "image/png", media.UNKNOWN, []),
    ]
    df = spark.createDataFrame([(i, bytearray(b), d) for i, b, d, _, _ in rows], "id long, media binary, declared string")
    got = {r["id"]: r for r in media.sniffed(df, declared="declared").collect()}
    for i, _, claim, kind, inside in rows:
        assert (got[i]["media_type"], got[i]["corrected"], [tuple(x) for x in got[i]["embedded"]]) == (kind, claim != kind, inside)


def test_segmentations_are_summed():
    pieces = [b"a", b"b", b"ab", b"abb"]
    lattice = language_id.Lattice(pieces)
    theta = np.array([[0.1], [0.2], [0.3], [0.4], [0.0]])
    buf, at = wordhash.padded([b"abb", b"ab"])
    got = lattice.forward(buf, at[:-1], np.diff(at), theta)[0][:, 0]
    assert np.allclose(got, [0.1 * 0.2 * 0.2 + 0.3 * 0.2 + 0.4, 0.1 * 0.2 + 0.3])


def test_language_id(spark, docs):
    pieces = language_id.vocabulary_pieces()
    names, theta = language_id.train(docs.filter("doc_id % 3 != 0"), pieces, 30)
    assert names == ["aa", "bb"] and np.allclose(theta.sum(axis=0), 1)
    out = language_id.identify(docs.filter("doc_id % 3 = 0").select("doc_id", "lang", "text"), names, theta, pieces).collect()
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["lang"]:
            assert r["lang_pred"] == r["lang"]
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    none, empty = language_id.train(docs.filter("false"), pieces)
    assert {r["lang_pred"] for r in language_id.identify(docs.select("doc_id", "text"), none, empty, pieces).collect()} == {"und"}


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert token_ids.read_blocks(token_ids.write_blocks(none)).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert ngram_join.similar_classes(none).count() == 0
    assert mixing.mix(mixing.sized(none)).count() == 0
    assert packing.pack(none).count() == 0
    assert quality.judged(quality.features(none), labels).count() == 0
    for df, rows in ((none, 0), (docs, docs.count())):
        gathered = lm_scoring.gather(df, F.lit(True))  # nothing trains
        got = lm_scoring.score(gathered, *lm_scoring.train(gathered)).collect()
        assert len(got) == rows and all(r["score"] < 0 == r["n_known"] == r["train_tokens"] for r in got)


def test_null_doc_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text, "aa", "s"), (None, text, "aa", "s"), (1, text, "aa", "s")], "doc_id long, text string, lang string, source string")
    assert {(r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(df).collect()} == {(None, 0), (1, 0)}
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.similar_classes(df).collect()) == [(0, 0), (0, 0), (1, 1)]
    assert mixing.mix(mixing.sized(df)).count() == 3 and packing.pack(df).count() == 3
    assert token_ids.read_blocks(token_ids.write_blocks(df)).count() == 3


def test_line_batches_are_even_on_skewed_ids(spark):
    df = spark.createDataFrame([(k,) for k in [*range(100), 1 << 62]], "doc_id long")
    parts = [sorted(r["doc_id"] for r in p.collect()) for p in line_dedup._ranges(df, 4)]
    assert sum(parts, []) == [*range(100), 1 << 62] and len(parts) == 4 and max(map(len, parts)) < 40


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a shared line here\nx", 5, 6, 7), (2, "A shared line here \ny", 5, 6, 7)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, `__id` int, `of` int, Lost int"))
    assert got.columns == ["doc_id", "text", "__id", "of", "n_lines", "n_dropped"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "a shared line here\nx", 2: "y"}


def test_sniffing_is_linear_in_pages():
    import time

    page = lambda last: b"OggS\0" + bytes([4 * last]) + bytes(20) + bytes([1, 50]) + bytes(50)
    s = media.Sniffer()
    assert s.sniff(page(False) * 20_000) == (media.UNKNOWN, [])
    assert s.sniff(b"-" + page(False) * 3 + page(True) + page(False) + b"-") == (media.UNKNOWN, [(1, 4 * 78, "audio/ogg")])
    began = time.process_time()
    s.sniff(page(False) * 20_000)
    assert time.process_time() - began < 5


def test_media_columns_that_clash_by_case(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "x")], "id long, media binary, Media_Type string")
    got = media.sniffed(df)
    assert got.columns == ["id", "media", "media_type", "corrected", "embedded"] and got.first()["media_type"] == "image/png"


def test_sketches_exclude_pairs_that_lack_too_much_together(spark):
    """Copies of one text that lack 20 of its 146 shingles each: their sizes alone exclude no pair, and no similar one may go."""
    rng = np.random.default_rng(3)
    text, docs = rng.integers(-(2**62), 2**62, 146), {}
    for d in range(120):
        keep = np.delete(text, (rng.integers(0, 146) if d % 3 else 7) + np.arange(20) - 146)
        docs[d] = {*keep.tolist(), *rng.integers(-(2**62), 2**62, 20).tolist()}
    rows = spark.createDataFrame([(d, t) for d, own in docs.items() for t in own], "doc long, token long")
    known = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("most"), *ngram_join._sketch())
    known = known.withColumn("n", F.col("most")).withColumn("spare", F.expr("most - (" + " + ".join(f"bit_count(s{k})" for k in range(ngram_join.SKETCH)) + ")"))
    side = {x: known.select(*(F.col(c).alias(f"{x}_{c}") for c in ("doc", "n", *ngram_join._SKETCHED))) for x in "xy"}
    kept = {tuple(r) for r in side["x"].crossJoin(side["y"]).filter("x_doc < y_doc").filter(ngram_join._may_share("x_", "y_")).select("x_doc", "y_doc").collect()}
    pairs = [(a, b) for a in docs for b in docs if a < b]
    linked = {(a, b) for a, b in pairs if len(docs[a] & docs[b]) >= ngram_join.required(len(docs[a]), len(docs[b]))}
    assert linked <= kept and len(linked) > 500
    assert len(kept) < len(pairs) / 3
