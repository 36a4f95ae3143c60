"""Token counts by overlap resynchronisation.

Texts above ``CHUNK`` characters are encoded in overlapping chunks with offsets. A pre-token boundary that two
neighbouring chunks share is stable: from there on, the left-to-right split of both is the same, and merges never cross
pre-tokens. Counts are spliced there; where no boundary is shared, the overlap is doubled, up to the whole rest.
Null texts count as empty. One row per input row; extra columns are never read.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

CHUNK, OVERLAP, LIMIT = 65_536, 1_024, 1_024
#: Characters at a chunk's end whose split may change with what follows (a cut special string, a look-ahead).
MARGIN = 32

_loaded: dict = {}


def tokenizer(shared):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer.from_str(shared.value)
    return _loaded[key]


def _starts(encoding, shift: int) -> dict[int, int]:
    """Places where a pre-token begins -> number of tokens before it."""
    out, last = {}, object()
    for k, ((begin, _), word) in enumerate(zip(encoding.offsets, encoding.word_ids)):
        if word is None or word != last:
            out.setdefault(begin + shift, k)
        last = word
    return out


def count_long(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    total, begin = 0, 0
    left = tok.encode(text[:chunk], add_special_tokens=False)
    end = min(chunk, len(text))
    drop = 0  # tokens at the front of ``left`` that are already counted
    while end < len(text):
        known = _starts(left, begin)
        last = max(known, default=begin)
        wide, splice = overlap, None
        while True:
            start = max(begin, end - wide)
            stop = min(len(text), max(end + chunk - wide, end + wide))
            right = tok.encode(text[start:stop], add_special_tokens=False)
            fresh = _starts(right, start)
            # The last pre-token of the left chunk is open, and the right chunk's first may be cut.
            shared = [p for p in fresh if p in known and p > start and p < min(last, end - MARGIN)
                      and known[p] >= drop]
            if shared:
                splice = max(shared)
                break
            if start == begin:
                break
            wide *= 2
        if splice is None:  # no boundary in the whole left chunk: take both as one
            left, end = tok.encode(text[begin:stop], add_special_tokens=False), stop
            continue
        total += known[splice] - drop
        left, begin, end, drop = right, start, stop, fresh[splice]
    return total + len(left.ids) - drop


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        tok = tokenizer(shared)
        rows = list(texts)
        short = [i for i, t in enumerate(rows) if len(t) <= CHUNK]
        out = [0] * len(rows)
        for k in range(0, len(short), 256):
            at = short[k:k + 256]
            for i, e in zip(at, tok.encode_batch_fast([rows[i] for i in at], add_special_tokens=False)):
                out[i] = len(e)
        for i, t in enumerate(rows):
            if len(t) > CHUNK:
                out[i] = count_long(tok, t)
        return pd.Series(out)

    text = text_or_empty()
    return (docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), counts(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


@query()
def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
