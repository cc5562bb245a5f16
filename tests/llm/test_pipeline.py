"""Every stage of the pipeline against brute force, on rows with null and repeated ids and with column names of all kinds."""

import collections
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import quality

SPACES = "[^\\x20\\x09-\\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `__id` int, `__times` int, `__n` int, key string, row int, rest int, number int, component_id int, kept boolean, w string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = []

    def add(doc_id, text, source="s0"):
        out.append((doc_id, text, "aa", source, len(text or ""), len(out), 1, 2, "k", 3, 4, 5, 6, True, "x"))

    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    for k in range(30):
        add(k, prose(int(rng.integers(40, 90))) + "\nA line that many share", f"s{k % 3}")
    for doc_id in (None, None, 7, 7):
        add(doc_id, prose(80))
        add(doc_id, "two words")
    base = prose(100)
    for k in (50, None, 7, 51):
        add(k, base + f" tail{k}", "s1")
    add(60, None)
    add(61, "")
    add(62, prose(6000), None)
    add(63, out[0][1])
    add(63, out[0][1])
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def words(text):
    return re.findall(SPACES, text or "")


def base_passes(text):
    w = words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(grams)
    places = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return len(w) >= 50 and 100 * len(places) <= 50 * len(w)


def test_quality_rules(spark, rows, folder):
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, COLUMNS), folder)
    assert got.columns == [c.split()[0].strip("`") for c in COLUMNS.split(", ")]
    assert sorted(r["__id"] for r in got.collect()) == [r[5] for r in rows if base_passes(r[1])]


def test_line_dedup(spark, rows, folder):
    got = {r["__id"]: r for r in corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    keeper = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[0] is not None and len(key(line)) >= 10:
                keeper[key(line)] = min(r[0], keeper.get(key(line), r[0]))
    for r in rows:
        stay = [x for x in (r[1] or "").split("\n") if r[0] is None or len(key(x)) < 10 or keeper[key(x)] == r[0]]
        mine = got[r[5]]
        assert mine["text"] == "\n".join(stay) and mine["n_chars"] == len(mine["text"]) and mine["doc_id"] == r[0] and mine["key"] == "k"
    assert len(got) == len(rows)


def test_near_duplicates(spark, rows, folder):
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 4 * len(x & y) >= 3 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    by = collections.defaultdict(list)
    for k, g in enumerate(group):
        by[g].append(rows[k])
    assert len(got) == len(by)
    left = collections.Counter(r["doc_id"] for r in got)
    assert left == collections.Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in by.values())


def test_mixing(spark, rows, folder):
    got = collections.Counter(r["__id"] for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, COLUMNS), folder).collect())
    size = {r[5]: len(words(r[1])) for r in rows}
    per = collections.Counter()
    for r in rows:
        per[r[3]] += size[r[5]]
    names = [*sorted(s for s in per if s is not None), None]
    target, left, free = {}, float(sum(per.values())), {s: k % 3 + 1 for k, s in enumerate(names)}
    while free:
        level = left / sum(free.values())
        held = [s for s in free if 3 * per[s] < level * free[s]]
        if not held:
            target |= {s: level * w for s, w in free.items()}
            break
        for s in held:
            target[s] = 3.0 * per[s]
            left -= target[s]
            del free[s]
    for s in names:
        mine = [r for r in rows if r[3] == s]
        taken = sum(got[r[5]] * size[r[5]] for r in mine)
        assert abs(taken - target[s]) <= max(size[r[5]] for r in mine) / 2 + 1
        assert all(got[r[5]] <= 3 for r in mine)


def test_packing(spark, rows, folder):
    got = corpus_pipeline.pack(spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(r[0] for r in rows)
    assert len(by) >= math.ceil(sum(r["length"] for r in got) / 2048)


def test_stages_in_turn(spark, rows, folder, tmp_path):
    kept = spark.createDataFrame(rows, COLUMNS)
    names = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, kept, folder).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == names and kept.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, kept, folder).count() >= kept.count()


def test_empty_table(spark, folder):
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_rules_have_grids():
    assert set(quality.RULES) == {"symbols", "shouts", "dup_lines", "repeats"}
