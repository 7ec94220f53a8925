import os

import pytest
from pyspark.sql import functions as F

from pairlink.llm.tokens import DEFAULT_TOKENIZER, with_token_counts

FOLDER = os.path.dirname(DEFAULT_TOKENIZER)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "hello world " * 5000)], "n int, t string")
    got = {r["n"]: r["size"] for r in with_token_counts(df, "t", "size", f"{FOLDER}/{name}").collect()}
    assert got[2] == got[3] == 0 and 1 < got[1] < 6 and got[4] > 1 and got[5] >= 10_000


def test_same_as_other_library(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["Zwölf Boxkämpfer, 1234!", "l'été dernier", "  blanks\n\nand lines ", "日本語"]
    got = with_token_counts(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()
    assert [r["n_tokens"] for r in got] == [len(encode(t)) for t in texts]
    assert with_token_counts(spark.createDataFrame([], "i int, t string"), "t").agg(F.count("*")).first()[0] == 0
