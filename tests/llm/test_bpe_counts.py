import base64
import random

import pytest
import tiktoken
from tokenizers import Tokenizer

import public_tokenizers as P
from pyspark.sql import functions as F
from tierblend.llm import bpe, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string"
WILD = ["", None, " ", "a" * 3000, "x\x1c\x1d y\x85z   q", "don't  stop\n\n\n  now 12345 \U0001f600é", "日本語" * 400,
        "<|endoftext|> tail", "same", "same"]


@pytest.fixture(scope="module")
def path():
    return bpe.multilingual()[0]


@pytest.fixture(scope="module")
def truth(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_equal_the_library(path, truth):
    own = bpe.Codec(open(path, "rb").read(), P.PATTERN)
    rng = random.Random(7)
    for _ in range(400):
        alphabet = rng.choice(["ab", "etaoin shrdlu'", "é日本\n\t !?", "".join(map(chr, range(1, 300)))])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300)))
        assert own.encode(text) == truth.encode_ordinary(text), repr(text)
    for text in WILD:
        assert own.decode(own.encode(text or "")) == (text or "").encode()


def test_rows(spark, path, truth):
    docs = spark.createDataFrame([(i // 2, t, None, None, None, "clash") for i, t in enumerate(WILD)], SCHEMA)
    rows = bpe.encode(docs, path, P.PATTERN).collect()
    assert len(rows) == len(WILD)
    assert all(r.ids == truth.encode_ordinary(r.text or "") for r in rows)
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.round_trip(docs.where("false"), path, P.PATTERN).count() == 0


def test_long_counts():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    for n in range(60):
        alphabet = rng.choice([["a"], ["word ", "an", " the", "\n\n", "  ", "<|endoftext|>", "é", "12"], [" "], list("ab ,.")])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(500, 3000)))
        want = len(tok.encode(text, add_special_tokens=False).ids)
        assert tokencount.count_long(tok, text, chunk=200 + n, overlap=40) == want


def test_count_rows(spark):
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in enumerate(WILD + ["ab c" * 60_000])], SCHEMA)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = tokencount.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    texts = WILD + ["ab c" * 60_000]
    for r in got:
        want = len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((texts[r.doc_id] or "").encode()), want > 1024)
    assert tokencount.count_tokens(docs.where(F.lit(False)), P.path("byte_bpe_50k.json")).count() == 0
