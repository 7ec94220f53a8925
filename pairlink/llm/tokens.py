"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the executors find the vocabulary; it is a parameter everywhere and never copied.
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def _chunks(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive texts with together not much over ``chars`` characters, so that encodings stay small."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def with_token_counts(docs: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``docs`` with its text column replaced by the size of the whole text in tokens (null and empty: 0)."""
    rest = [f for f in docs.schema.fields if f.name != text]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(tokenizer)
        for batch in batches:
            texts = batch.pop(text).fillna("").tolist()
            batch[out] = [n for part in _chunks(texts) for n in encode(part)]
            yield batch[[*(f.name for f in rest), out]]

    schema = T.StructType([*rest, T.StructField(out, T.LongType())])
    return docs.select(*(f.name for f in rest), F.col(text)).mapInPandas(count, schema)
