"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, cut where tokens of both end.

Both tokenizers give their tokens' byte lengths; running sums are the end offsets. Two cursors walk the two arrays of
ends. While the texts are cut alike the arrays agree under the cursors' shift: exponential probing compares slices of
1, 2, 4, ... ends, then halves the last step, so that a one-to-one stretch is jumped without a look at its tokens. At
a difference the group is resolved locally, by moving the cursor that lies behind until the ends meet, and the cursors'
shift is what that left.

Tokenizer A is a byte-level BPE of the tokenizers library (its strings of special tokens are plain text) over space +
text, B a sentencepiece model, which puts that space in front itself. Texts that are null or empty, and texts whose
bytes one of the two does not give back, have no tokens: empty arrays. Every row gives one row, repeated rows and ids
included; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, settle, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

#: Texts handed to a tokenizer at once.
BATCH = 64
#: Up to so many distinct id pairs (16 bytes each) are sent to every executor; more are joined.
PAIRS_SENT = 4_000_000
#: Pieces into which rows of one id pair are spread in that join.
SALTS = 32
_SHIFT = 32

#: Letters, digits, marks and blanks whose classes are the same in every version of Unicode since 5.0.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")

_loaded: dict = {}


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how a byte-level vocabulary splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _is_plain_byte_level(model: dict) -> bool:
    """Whether ids are merge ranks (bytes first, then the merges in order) and nothing but ``SPLIT`` comes before."""
    before, inner = model.get("pre_tokenizer") or {}, model["model"]
    if model.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return False
    if inner.get("type") != "BPE" or inner.get("dropout") or inner.get("ignore_merges") or inner.get("end_of_word_suffix"):
        return False
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in inner["merges"]]
    return all(inner["vocab"].get(piece) == 256 + i for i, piece in enumerate(joined))


class Pair:
    """Both tokenizers with the bytes and byte lengths of their ids.

    Texts of ``PLAIN`` characters go through the ranks of the same vocabulary in the tiktoken library, which is four
    times as fast: for these characters both libraries split alike. All others go through the tokenizers library.
    """

    def __init__(self, a_blob: str, b_blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_blob)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_blob)
        alphabet = _byte_alphabet()
        held = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(held.values()) + 1)
        for piece, i in held.items():
            if all(c in alphabet for c in piece):
                self.a_bytes[i] = bytes(alphabet[c] for c in piece)
        raw = re.compile(r"<0x([0-9A-F]{2})>")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := raw.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        model = json.loads(a_blob)
        self.fast = None
        if _is_plain_byte_level(model):
            order = sorted((i, x) for i, x in enumerate(self.a_bytes) if x)
            self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={x: i for i, x in order}, special_tokens={})
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int32)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int32)

    def tokens(self, texts: list[str]):
        """Ids of both per text, or None where there are none."""
        spaced = [" " + t for t in texts]
        plain = [self.fast is not None and PLAIN.fullmatch(t) is not None for t in texts]
        slow = iter(self.a.encode_batch_fast([t for t, p in zip(spaced, plain) if not p], add_special_tokens=False))
        first = [self.fast.encode_ordinary(t) if p else next(slow).ids for t, p in zip(spaced, plain)]
        second = self.b.encode(texts, num_threads=1)
        for text, whole, a, b in zip(texts, spaced, first, second):
            want = whole.encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))
            yield (a, b) if same else None


def pair(a_shared, b_shared) -> Pair:
    key = (hash(a_shared.value), hash(b_shared.value))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(a_shared.value, b_shared.value)
    return _loaded[key]


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to each place where tokens of both end. Both arrays rise to the same last end."""
    at, shift, runs = [], [], []  # groups that end together: first number of A tokens, index shift, how many
    i = j = 0
    n = len(ends_a)
    while i < n:
        begin = i
        a, b = ends_a[i], ends_b[j]
        if a == b:
            i += 1
            j += 1
            step = 2
            while ends_a[i:i + step] == ends_b[j:j + step] and i < n:  # probe further and further along the shift
                i += step
                j += step
                step += step
            if i >= n:
                i, j = n, j - i + n
            else:
                while step > 1:  # the first difference lies in this step
                    step >>= 1
                    if ends_a[i:i + step] == ends_b[j:j + step]:
                        i += step
                        j += step
            at.append(begin + 1)
            shift.append(j - i)
            runs.append(i - begin)
        else:  # an irregular group
            while a != b:
                if a < b:
                    i += 1
                    a = ends_a[i]
                else:
                    j += 1
                    b = ends_b[j]
            i += 1
            j += 1
            at.append(i)
            shift.append(j - i)
            runs.append(1)
    sizes = np.array(runs, np.int32)
    total = np.cumsum(sizes, dtype=np.int32)
    out = np.repeat(np.array(at, np.int32) - total + sizes, sizes) + np.arange(total[-1] if n else 0, dtype=np.int32)
    return out, out + np.repeat(np.array(shift, np.int32), sizes)


_FIELDS = "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """doc_id and ``aligned``: ids of both tokenizers, and per group the number of A and of B tokens up to its end."""
    sc = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as f:
        a_shared = sc.broadcast(f.read())  # vocabularies: their size is that of the files
    with open(b_path, "rb") as f:
        b_shared = sc.broadcast(f.read())

    @F.pandas_udf(_FIELDS)
    def aligned(texts: pd.Series) -> pd.DataFrame:
        own = pair(a_shared, b_shared)
        none = np.zeros(0, np.int32)
        rows = []
        for at in range(0, len(texts), BATCH):
            for found in own.tokens(list(texts.iloc[at:at + BATCH])):
                if found is None:
                    rows.append((none,) * 4)
                    continue
                a, b = np.array(found[0], np.int32), np.array(found[1], np.int32)
                ends = cuts(np.cumsum(own.a_len[a]).tolist(), np.cumsum(own.b_len[b]).tolist())
                rows.append((a, b, *ends))
        return pd.DataFrame(rows, columns=["a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select("doc_id", aligned(text_or_empty(text)).alias("aligned"))


def group_text(names: np.ndarray, a, b, a_cuts, b_cuts) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    if not len(a_cuts):
        return ""
    parts = list(map("|".join, zip(names[a[a_cuts - 1]].tolist(), names[b[b_cuts - 1]].tolist())))
    a, b = names[a].tolist(), names[b].tolist()
    a_from, b_from = np.append(0, a_cuts[:-1]), np.append(0, b_cuts[:-1])
    odd = np.flatnonzero((a_cuts - a_from > 1) | (b_cuts - b_from > 1))
    for g, i, x, j, y in zip(odd.tolist(), a_from[odd].tolist(), a_cuts[odd].tolist(), b_from[odd].tolist(), b_cuts[odd].tolist()):
        parts[g] = ",".join(a[i:x]) + "|" + ",".join(b[j:y])
    return ";".join(parts)


#: Decimal texts of ids, made once per worker.
_names: list[np.ndarray] = []


def summarise(aligned: DataFrame) -> DataFrame:
    """Numbers and digest per row, and the distinct linked pairs (``a << 32 | b``) with the links that hold them.

    Tokens of both that end together are linked: the last ones of every group.
    """

    @F.pandas_udf("n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>")
    def numbers(found: pd.DataFrame) -> pd.DataFrame:
        if not _names:
            _names.append(np.array([str(i) for i in range(1 << 17)], dtype=object))
        rows = []
        for a, b, ac, bc in zip(found["a_ids"], found["b_ids"], found["a_cuts"], found["b_cuts"]):
            line = group_text(_names[0], a, b, ac, bc)
            linked = a[ac - 1].astype(np.int64) << _SHIFT | b[bc - 1]
            held, times = np.unique(linked, return_counts=True)
            rows.append((len(a), len(b), len(ac), hashlib.sha256(line.encode()).hexdigest() if line else "", held,
                         times.astype(np.int32)))
        return pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return aligned.select("doc_id", numbers("aligned").alias("s")).select("doc_id", "s.*")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, total (links of all rows that hold it), best (whether no other A id is linked more often with its B id)."""
    held = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    totals = settle(held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total")), "pair-counts")
    by_b = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    # an id of B has at most one row per id of A here
    top = by_b.groupBy("b").agg(F.max("total").alias("top"))
    return settle(by_b.join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best")), "best-pairs")


def link_strength(rows: DataFrame, sent: int = PAIRS_SENT) -> DataFrame:
    """Adds n_best and count_sum to the stored rows of :func:`summarise`, which carry a unique ``row``."""
    counts = pair_counts(rows)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    if counts.count() <= sent:
        met = links.join(F.broadcast(counts), "pair")
    else:  # frequent pairs occur in most rows: spread them
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = (links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
               .join(counts.withColumn("salt", salts), ["pair", "salt"]))
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                  F.sum(F.col("total") * F.col("times")).alias("count_sum"))
    return rows.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def measure(docs: DataFrame, a_path: str, b_path: str, sent: int = PAIRS_SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    rows = summarise(align(docs, a_path, b_path)).withColumn("row", F.monotonically_increasing_id())
    strong = link_strength(settle(rows, "alignments"), sent)
    return strong.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                         "groups_sha256")


@query()
def op13_align(spark, sf_dir):
    import public_tokenizers

    return measure(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                   public_tokenizers.path("piece_bpe_32k.model"))
