"""Periodic runs, repeated passages and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import passage_dedup as passages
from tessera.llm.hashing import text_slices
from tessera.llm.passage_dedup import drop_passages, passage_dedup
from tessera.llm.periodic_runs import collapse, collapsed, periodic_runs, planted, runs
from tessera.llm.resampling import resample
from tessera.llm.suffix_groups import neighbour_lcps, suffix_array


def brute_runs(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size, s = j + q - i, w[i : j + q]
            if j > i and size >= max(least, times * q) and not any(all(s[k] == s[k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(i + 1, j)
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 3), max_size=40), st.integers(0, 9), st.sampled_from([(6, 4), (4, 2), (2, 2), (10, 3)]))
def test_runs(part, rest, times, rule):
    w = rest[:7] + part * times + rest[7:]
    assert runs(np.array(w, np.int64), *rule) == brute_runs(w, *rule)


def test_long_runs_take_seconds():
    assert runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs(np.arange(100_000) % 7000) == [(0, 100_000, 7000)]
    assert runs(np.arange(100_000)) == []


def test_periodic_runs(spark):
    words = "x a b a b a b a b y y y y y y z".split()
    text = "\t".join(words[:5]) + "\n" + "  ".join(words[5:])
    docs = spark.createDataFrame([(1, text, 5), (2, None, 6), (None, "a b c", 7), (1, text, 5)], "doc_id long, text string, start long")
    got = periodic_runs(docs).collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got if r.doc_id == 1] == [(2, 1, 8, 2, 4000)] * 2
    first = next(r for r in got if r.doc_id == 1)
    assert first.runs_sha256 == hashlib.sha256(b"1,8,2\n9,6,1\n").hexdigest() and first.collapsed_sha256 == hashlib.sha256(b"x a b y z").hexdigest()
    assert next(r for r in got if r.doc_id == 2)[1:7] == (0, None, None, None, None, hashlib.sha256(b"").hexdigest())
    assert [tuple(r) for r in collapse(docs).collect()] == [(1, "x a b y z", 5), (2, None, 6), (None, "a b c", 7), (1, "x a b y z", 5)]
    assert collapsed(words, [(1, 8, 2), (3, 8, 4)]) == ["x", "a", "b", "z"][:3] + words[11:]  # overlapping runs


def test_planted_words():
    words = [b"w%d" % i for i in range(50)]
    for doc_id in range(60):
        h = zlib.crc32(str(doc_id).encode())
        a, p = h // 10 % 50, 1 + (50 - h // 10 % 50) // (3 + h // 10 % 8)
        assert planted(words, doc_id) == [words[i] if h % 10 or i < a else words[a + (i - a) % p] for i in range(50)]
    assert planted(words, None) == words and planted([], 3) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.integers(1, 5), st.lists(st.integers(0, 1), max_size=30))
def test_suffix_array(part, times, rest):
    s = part * times + rest
    order = suffix_array(s)
    assert order == sorted(range(len(s)), key=lambda i: s[i:])
    if s:
        common = lambda i, j: next((k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]), 0)
        assert neighbour_lcps(np.array(s), np.array(order)).tolist() == [max((common(i, j) for j in range(len(s)) if j != i), default=0) for i in range(len(s))]


def brute_passages(texts, least):
    found = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if found[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        yield bytes(gone)


def check_passages(spark, texts, least, group):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in passage_dedup(docs, least, group).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, (t, gone) in enumerate(zip(raw, brute_passages(raw, least), strict=True)):
        kept = bytes(c for c, x in zip(t, gone, strict=True) if not x)
        assert got[i] == (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()), (texts[i], least, group)


def changed_texts(seed, n):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcd ") for _ in range(draw.randrange(60))) for _ in range(n // 10)]
    out = ["", None, "a" * 70, "é" * 40]
    for _ in range(n):
        t = draw.choice(base)
        for _ in range(draw.randrange(4)):
            i = draw.randrange(len(t) + 1)
            t = t[:i] + draw.choice("xéab") * draw.randrange(3) + t[i + draw.randrange(3) :]
        out.append("ab" * draw.randrange(20) * (draw.random() < 0.1) + t + draw.choice(base) * (draw.random() < 0.3))
    return out


@pytest.mark.parametrize(("least", "group"), [(8, 1000), (13, 2), (20, 3), (1, 2)])
def test_passages_equal_brute_force(spark, least, group):
    """With groups of 2 or 3 members nearly every core is split down to equal passages."""
    check_passages(spark, changed_texts(least, 300), least, group)


def test_one_passage_in_very_many_texts(spark):
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(40))
    check_passages(spark, ["".join(draw.choice("xyz") for _ in range(draw.randrange(30))) + passage + "".join(draw.choice("uvw") for _ in range(draw.randrange(30))) for _ in range(1500)], 32, 40)


def test_marks_of_a_frequent_string_stay_apart(spark, monkeypatch):
    marks = spark.range(0, 4000, 1, 8).selectExpr("id as row", "0 as at", "if(id % 40 = 0, id div 80, -1) as core", "if(id % 40 = 0, if(id div 80 % 2 = 0, 0, id % 3), 7) as around")
    strings = marks.groupBy("core", "around").agg(F.count("*").alias("n"))
    plain = marks.join(strings.where("n > 1"), ["core", "around"], "left_semi")
    for often in (100, 1 << 20):
        assert sorted(passages._twice(marks, strings, often).collect()) == sorted(plain.collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if there were too many strings
    try:
        parts = passages._twice(marks, strings, 100).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(p["count"] for p in parts) <= 600  # 3,950 while the frequent string's marks met in one task
    monkeypatch.setattr(passages, "_twice", partial(passages._twice, often=2))
    check_passages(spark, changed_texts(3, 300), 12, 3)


def test_passages_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_passages(spark, [r.text for r in docs.collect()], 400, 1000)


def test_long_texts_are_hashed_in_pieces():
    import pyarrow as pa

    text = "".join(random.Random(4).choice("ab") for _ in range(5000)) + "a" * 300
    (_, offsets, data), *_ = text_slices(pa.array([text]))
    whole = passages.cores(offsets, data, 40)
    for piece in (1, 17, 400):
        parts = [np.concatenate(x) for x in zip(*passages.long_cores(data, 40, piece), strict=True)]
        order = np.argsort(parts[1])
        assert all((a[order] == b).all() for a, b in zip(parts, whole, strict=True))


def test_drop_passages(spark):
    same = "é" * 250
    docs = spark.createDataFrame([(1, "one " + same + " x", "k"), (2, "two " + same + " y", None), (None, None, "n"), (4, "short", "s")], "doc_id long, text string, row string")
    assert set(map(tuple, drop_passages(docs).collect())) == {(1, "onex", "k"), (2, "twoy", None), (None, None, "n"), (4, "short", "s")}


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_resampling(spark):
    draw = random.Random(6)
    vocabulary = ["Der", "naïve", "x1", "Ünder", "Z", "tail-end", "a.b"]
    rows = [(i if i % 9 else None, " ".join(draw.choices(vocabulary, k=draw.randrange(60)))) for i in range(200)] + [(7, None), (8, ""), (1, "")]
    target = ["naïve Z z\x00Z Ünder"] * 3 + [None]
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")).collect()

    def features(text):
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    mine, theirs = (collections.Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in rows], target))
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (mine.total() + 10_000) / ((mine[b] + 1) * (theirs.total() + 10_000))))
    want = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        want.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    able = sorted((-w[3], w[0] is None, w[0] or 0) for w in want if w[4] >= 20)
    ranked = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in got if r.rank)
    assert ranked == [(k, *a) for k, a in enumerate(able[: 25 * len(able) // 100], 1)]


def test_resampling_without_target_or_ties(spark):
    docs = spark.createDataFrame([(3, "w " * 30)] * 40 + [(None, "w " * 30)] * 40, "doc_id long, text string")
    got = resample(docs, spark.createDataFrame([], "text string")).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21)) and len(got) == 80
