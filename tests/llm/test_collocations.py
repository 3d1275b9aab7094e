"""Collocations against a count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hornbeam.llm import collocations
from hornbeam.llm.collocations import Settings
from tests.oracle import compare

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=30, absorbed=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= absorbed * counts[p[i : i + m]]}
        listed = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                listed.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)]
    out = []
    for i in range(150):
        words = [vocabulary[min(int(r.paretovariate(0.8)), 59)] for _ in range(r.randrange(1, 120))]
        text = "".join(w + r.choice([" "] * 8 + ["\t ", ". ", ",", "\n"]) for w in words)
        out.append((text.upper() if i % 7 == 0 else text, r.choice(["en", "de", None, "und"])))
    out += [(None, "en"), ("", "en"), (" \t.,", "xx"), ("one", "xx"), ("a " * 3000, "fr"), ("go go stop " * 900, "fr"), ("In New York, new york; NEW YORK!", "en")]
    return out + [out[3]] * 5


@pytest.mark.parametrize(
    "settings",
    [Settings(min_count=3), Settings(min_count=2, hot=4, block_bytes=300, bucket_bytes=500), Settings(min_count=3, absorbed=50, top=7, block_bytes=1 << 14)],
)
def test_equals_a_count_of_all_phrases(spark, rows, settings):
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "text string, lang string, rank int, word string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, settings).collect())
    assert got == brute(rows, settings.min_count, settings.absorbed, settings.top)


def test_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(docs.where("text is null")).collect() == []
    assert collocations.collocations(docs, Settings(min_count=10**6)).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    from hornbeam.llm import queries

    compare(queries.op12_pivot_collocations(spark, sf_dir), collocations.SQL, sf_dir)


def test_fragments_survive_their_encoding():
    r = np.random.default_rng(1)
    around = r.integers(0, 3, (50, 6)) * r.integers(1, 2**31 - 1, (50, 6))
    pivot = r.integers(1, 2**31 - 1, 50)
    back = collocations._decoded(collocations._encoded(pivot, around))
    assert (back[0] == pivot).all() and (back[1] == around).all()


def test_scores_beyond_64_bit_products(spark):
    cases = [(10**12, 2 * 10**12 + 7), (4 * 10**14, 9 * 10**14 + 1), (2 * 10**15, 4 * 10**15 + 3), (30, 61), (5, 10)]
    scored = collocations._scored(spark.createDataFrame([(a, s // 2, s - s // 2) for a, s in cases], "a long, l long, r long"))
    assert [r["score"] for r in scored.collect()] == [2000000 * a // s for a, s in cases]
