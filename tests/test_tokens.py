"""Token counts against a public tokenizer library on the same ranks."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from hornbeam.operators.tokens import merged, read_ranks, tokens_per_text

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def test_merges_by_rank():
    ranks = {b"ab": 1, b"bc": 0, b"abc": 2}
    assert [merged(x, ranks) for x in (b"", b"a", b"ab", b"abc", b"abab", b"xyz")] == [0, 1, 1, 1, 2, 3]


def test_merges_equal_a_plain_search():
    def plain(parts, ranks):
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return len(parts)
        at = min(found)[1]
        return plain([*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]], ranks)

    r = random.Random(3)
    for _ in range(300):
        ranks = {bytes(r.choices(b"abc", k=r.randint(2, 5))): i for i in range(25)}
        piece = bytes(r.choices(b"abc", k=r.randint(0, 40)))
        assert merged(piece, ranks) == plain([piece[i : i + 1] for i in range(len(piece))], ranks)


def test_texts_of_one_partition_are_many_tasks(spark):
    docs = spark.createDataFrame([(i, "ab abc") for i in range(200)], "id long, text string").coalesce(1)
    out = tokens_per_text(docs, spark.createDataFrame([(b"ab", 0)], "token binary, rank int"), F.col("text"))
    assert {r[0] for r in out.select("n_tokens").distinct().collect()} == {4}  # ab, the space, ab, c
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 4


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
def test_counts_of_whole_texts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", None, "it's  a\n\n test\t", "naïve café 東京 123٣", "x" * 300, "   a", "don't  "]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, text string, n_tokens int")
    got = {r["id"]: r["n_tokens"] for r in tokens_per_text(docs, read_ranks(spark, PATH), F.col("text")).collect()}
    assert got == {i: None if t is None else len(library.encode_ordinary(t)) for i, t in enumerate(texts)}


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
def test_summary_of_all_documents(spark):
    from hornbeam.plans.change_queries import token_summary_bpe

    d = "/root/testdata/sf0.001"
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    library = pytest.importorskip("tiktoken").Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{d}/documents.parquet").select("text", "n_chars").collect()
    kept = [n for n, c in ((len(library.encode_ordinary(r["text"] or "")), r["n_chars"]) for r in docs) if n >= 100 and c % 53 >= 5]
    rows = token_summary_bpe(spark, d, PATH).where("repo is null").collect()
    assert (len(kept), sum(kept)) in [(r["commits"], r["sum_naive"]) for r in rows]
