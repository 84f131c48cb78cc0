import base64

import helpers as H
import numpy as np

from fedseek.llm import tokens


def test_counts_and_every_limit(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r.text for r in spark.read.parquet(f"{H.D}/documents.parquet").select("text").collect()]
    n = np.array([len(enc.encode_ordinary(x or "")) for x in texts])
    rows = {r.length: r for r in tokens.op5_token_counts(spark, H.D).collect()}
    assert sorted(rows) == sorted(set(n.tolist()))
    for length, r in rows.items():
        assert (r.n_docs, r.n_over, r.tokens_total) == ((n == length).sum(), (n > length).sum(), n.sum())
        assert (r.tokens_within, r.truncated_total) == (n[n <= length].sum(), np.minimum(n, length).sum())
        assert abs(r.share_within - (n <= length).mean()) < 1e-12


def test_limits_quantiles_nulls_none(spark):
    n = [0, 0, 3, 5, 5, 9000, None]
    table = tokens.limits(tokens.histogram(spark.createDataFrame([(x,) for x in n], "length long")), bucket=4).cache()
    full = np.array([x or 0 for x in n])
    for limit in (0, 1, 3, 4, 5, 6, 8999, 9000, 10**6):
        assert tokens.truncated_total(table, limit).first()[0] == np.minimum(full, limit).sum()
    assert tokens.quantile(table, 0.5).first()[0] == 3 and tokens.quantile(table, 1.0).first()[0] == 9000
    none = tokens.limits(tokens.histogram(spark.createDataFrame([], "length long")))
    assert none.count() == 0 and tokens.truncated_total(none, 7).first()[0] == 0


def test_special_strings_are_text(spark):
    df = spark.createDataFrame([("<|endoftext|>",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(tokens.token_count(spark, "text")).collect()]
    assert got[0] > 1 and got[1:] == [0, 0]


def test_runs_of_white_space_and_long_texts(spark):
    """Long runs are encoded apart: the same count as by the encoder itself where it can take them, and no failure beyond."""
    import random

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    parts = lambda: ["a", " ", "  " * r.randrange(200), "\n" * r.randrange(300), "\t", "x1", "!", "\u3000" * r.randrange(400), "\x1c" * 300, "\x85" * 300]
    for _ in range(400):
        t = "".join(r.choice(parts()) for _ in range(r.randrange(8)))
        assert tokens.encoded_length(enc, t) == len(enc.encode_ordinary(t))
    texts = [" " * 10**6 + "a", " " * 10**6, "x" * 10**6, "a b", "a b", None]
    df = H.frame(spark, texts).withColumnsRenamed({"source": "length", "lang": "n_docs"})
    got = [r[0] for r in df.orderBy("doc_id").select(tokens.token_count(spark, "text")).collect()]
    one = len(enc.encode_ordinary(" " * 200)) / 200
    assert got[1] == one * 10**6 and got[2] > 0 and got[3:] == [2, 2, 0] and got[0] == (10**6 - 1) * one + len(enc.encode_ordinary(" a"))
