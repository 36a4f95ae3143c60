import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierblend.llm import align, infill

SCHEMA = "doc_id long, text string, fim string, restored string, n string, aligned string, row string, pairs string, _s string"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
WILD = ["", None, " ", "a", "é", "x\x00y\x1c\x85z", "日本語" * 300, "\U0001f600" * 50 + "abc", "one <P> two", "<S>", "a<", "<M", "▁a ▁",
        "<|endoftext|> tail <0x41> <s> <unk>", "tab\tand\r\n\n\n  blanks   ", "ﬁne　wide", "same", "same", "naïve café ÀÉ ßtraße",
        "Привет, как дела? " * 40, "12345 67 don't I'LL" * 30, "y" * 5000, "word " * 20_000]


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, *["c"] * 7) for i, t in zip(ids, texts)], SCHEMA)


def test_exception_index():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("ab é日\U0001f600") for _ in range(rng.randint(0, 60)))
        index = infill.Exceptions(text.encode())
        assert index.n == len(text)
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.to_byte(k) == at and index.to_point(at) == k


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_infill_equals_plain_python(spark):
    texts = WILD * 6
    ids = [None if i == 7 else i // 2 for i in range(len(texts))]
    docs = frame(spark, texts, ids)
    got = infill.restore(infill.fill_in_middle(docs))
    assert got.columns == docs.columns
    rows = got.collect()
    want = Counter((i, *plain_infill(i, t), t or "") for i, t in zip(ids, texts))
    assert Counter((r.doc_id, r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output, r.restored) for r in rows) == want
    assert {r.fim.form for r in rows} == {"plain", "psm", "spm"}
    assert infill.restore(infill.fill_in_middle(docs.where("false"))).count() == 0


def slow_align(texts):
    """Groups and links by sets of ends, token by token."""
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = align._byte_alphabet()
    out, links = [], Counter()
    for t in texts:
        t = t or ""
        a, b = a_tok.encode(" " + t, add_special_tokens=False), b_tok.encode(t)
        a_bytes = [bytes(alphabet[c] for c in x) for x in a.tokens]
        b_bytes = []
        for i in b:
            p = b_tok.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
        if not t or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            out.append(([], [], []))
            continue
        groups, mine, i, j, x, y, ga, gb = [], [], 0, 0, 0, 0, [], []
        while i < len(a_bytes) or j < len(b_bytes):
            if x <= y and not (x == y and ga):
                x += len(a_bytes[i])
                ga.append(a.ids[i])
                i += 1
            else:
                y += len(b_bytes[j])
                gb.append(b[j])
                j += 1
            if x == y:
                groups.append((ga, gb))
                mine.append((ga[-1], gb[-1]))
                ga, gb = [], []
        links.update(mine)
        out.append((a.ids, groups, mine))
    return out, links


@pytest.mark.parametrize("sent", [align.PAIRS_SENT, 0])
def test_alignment_equals_brute_force(spark, sf, sent):
    texts = WILD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    slow, links = slow_align(texts)
    best = Counter()
    for (a, b), n in links.items():
        best[b] = max(best[b], n)
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in align.measure(docs, A, B, sent).collect()}
    assert len(got) == len(texts)
    for i, (ids, groups, mine) in enumerate(slow):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        r = got[i]
        assert r.groups_sha256 == (hashlib.sha256(line.encode()).hexdigest() if groups else ""), repr(texts[i])[:80]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(ids), sum(len(g[1]) for g in groups), len(groups), len(mine))
        assert r.n_best == sum(links[x] == best[x[1]] for x in mine) and r.count_sum == sum(links[x] for x in mine)
    if sent:
        assert align.measure(docs.where(F.lit(False)), A, B).count() == 0


def test_cuts_equal_common_ends():
    rng = random.Random(11)
    for _ in range(500):
        last = rng.randint(1, 200)
        pick = lambda p: sorted({last, *(x for x in range(1, last) if rng.random() < p)})
        p = rng.choice([0.05, 0.5, 0.95, 1.0])
        a, b = pick(p), pick(rng.choice([p, 0.3, 1.0]))
        common = sorted(set(a) & set(b))
        x, y = align.cuts(a, b)
        assert x.tolist() == [a.index(e) + 1 for e in common] and y.tolist() == [b.index(e) + 1 for e in common]
    x, y = align.cuts([], [])
    assert len(x) == len(y) == 0


def test_both_libraries_split_plain_characters_alike():
    own = align.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert own.fast is not None
    rng = random.Random(2)
    chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
    for _ in range(1500):
        some = rng.sample(chars, rng.randint(1, 30)) + [" ", "\n"]
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 80)))
        assert align.PLAIN.fullmatch(text)
        assert own.fast.encode_ordinary(text) == own.a.encode(text, add_special_tokens=False).ids, repr(text)
