"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from hornbeam.llm import common, period_runs, queries


def brute(words, min_words=6, exponent=4):
    out = []
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(min_words, exponent * p):
                stretch = words[start : start + length]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                    out.append((start, length, p))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def best(runs):
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def collapsed(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(r.randrange(1, 6)):
            words = []
            while r.random() < 0.8:
                unit = [r.choice("ab" if r.random() < 0.5 else "abcd") for _ in range(r.randrange(1, 6))]
                words += (unit * r.randrange(1, 7))[: r.randrange(1, 40)]
            texts.append(words)
        codes = np.array([ord(c) for w in texts for c in w], np.uint64)
        got = period_runs.runs(codes, np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64))
        for i, words in enumerate(texts):
            assert [tuple(x) for x in zip(*(c[got[0] == i].tolist() for c in got[1:]))] == brute(words)


def test_minima_and_long_runs(monkeypatch):
    values = np.random.default_rng(3).integers(0, 99, 1000)
    minima = period_runs.Minima(values)
    lo = np.random.default_rng(4).integers(0, 1000, 3000)
    hi = np.minimum(lo + np.random.default_rng(5).integers(0, 400, 3000), 999)
    assert minima(lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]
    monkeypatch.setattr(period_runs, "STEP", 100)  # many steps
    for unit in (1, 7, 4000):
        got = period_runs.runs(np.resize(np.arange(unit), 20_000).astype(np.uint64), np.array([0, 20_000]))
        assert [x.tolist() for x in got] == [[0], [0], [20_000], [unit]]


def test_edges(spark):
    texts = [None, "", " \n\t ", "a", "a " * 6, "A a A a A a A a", "é é\té\né é é x y x y x y x y", "b " * 5, "la la la\n" * 4000]
    rows = [(i, t, "mine", i) for i, t in enumerate(texts)] + [(4, texts[4], "mine", 4), (None, "c " * 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long")
    out = period_runs.periodic_runs(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want = brute(words) if len(words) < 1000 else [(0, 12_000, 1)]
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == want
        assert (tuple(r["best_run"]) if r["best_run"] else None) == best(want) and r["collapsed"] == collapsed(words, want)
    assert period_runs.periodic_runs(docs.limit(0)).collect() == []
    assert period_runs.periodic_runs(docs, keep=["doc_id"]).columns == ["doc_id", "n_words", "runs", "best_run", "collapsed"]


def test_query_equals_brute_force(spark, sf_dir):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_harmonic_runs(spark, sf_dir).collect()}
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 2000:
            continue
        runs = brute(words)
        top = best(runs)
        numbers = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        assert got[doc_id] == (doc_id, len(runs), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_folding_of_empty_and_null(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], " "), (ids[3], "one"), (None, "x y")], "doc_id long, text string")
    assert {(r[0], r[1]) for r in queries._folded(docs).collect()} == {(ids[0], None), (ids[1], ""), (ids[2], " "), (ids[3], "one"), (None, "x y")}
    assert queries._folded(docs.where(F.lit(False))).collect() == []
