"""Fill-in-the-middle: prefix, middle and suffix of a text in an order that lets a model predict the middle last.

A text is cut at code points but handled as UTF-8 bytes. A sparse exception index lists only the multibyte characters:
their code-point positions and the running sum of the bytes that they have beyond one. ``searchsorted`` in the one
gives the other, so a cut costs one binary search and ASCII stretches are plain arithmetic (an ASCII text has an empty
index). The draws come from the digest of ``seed:doc_id``, so they do not depend on partitions or on runs.

Null texts count as empty; empty texts and texts that hold a marker stay plain. A null id draws as the empty text.
Rows with equal id and text give equal rows. All columns of the input stay; ``fim`` replaces a column of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tierblend.llm.base import query, table, text_or_empty
from tierblend.session import ship_by_value

ship_by_value(__name__)

# Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of these so many begin with the suffix.
RATE, SPM_RATE, SEED = 90, 20, 1
_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()


class Exceptions:
    """Multibyte characters of a UTF-8 text: position in code points, byte position, excess bytes up to each."""

    def __init__(self, raw: bytes):
        codes = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(codes >= 0xC0)  # lead bytes of two and more
        lead = codes[at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.total = np.append(0, np.cumsum(extra))  # excess bytes before the k-th one
        self.points = at - self.total[:-1]
        self.bytes = at
        self.n = len(raw) - int(self.total[-1])

    def to_byte(self, point: int) -> int:
        return point + int(self.total[np.searchsorted(self.points, point)])

    def to_point(self, byte: int) -> int:
        """Code points before a byte position that begins a character."""
        return byte - int(self.total[np.searchsorted(self.bytes, byte)])


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four unsigned integers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def transform_one(text: str, doc_id, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output."""
    raw = text.encode()
    index = Exceptions(raw)
    n = index.n
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not n or h3 % 100 >= rate or _P in raw or _S in raw or _M in raw:
        return n, "plain", None, None, None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = index.to_byte(first), index.to_byte(second)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < spm_rate:
        form, parts = "spm", (_S, suffix, _P, prefix, _M, middle)
    else:
        form, parts = "psm", (_P, prefix, _S, suffix, _M, middle)
    return n, form, first, second - first, a, b - a, b"".join(parts).decode()


def restore_one(output: str, form: str) -> str:
    """The text again. No part holds a marker, so the first of each kind is the one that was put in."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == "psm":
        prefix, suffix = head[len(PREFIX):].split(SUFFIX, 1)
    else:
        suffix, prefix = head[len(SUFFIX):].split(PREFIX, 1)
    return prefix + middle + suffix


_FIELDS = ["n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, text: str = "text") -> DataFrame:
    """All columns and ``fim``: form, numbers of code points and bytes of the parts, and the output text."""

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string")
    def cut(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        rows = [transform_one(t, i, seed, rate, spm_rate) for t, i in zip(texts, ids)]
        out = pd.DataFrame(rows, columns=_FIELDS)
        return out.astype({c: "Int64" for c in _FIELDS if c not in ("form", "output")})

    return docs.withColumn("fim", cut(text_or_empty(text), F.col("doc_id").cast("string")))


def restore(transformed: DataFrame, output: str = "restored") -> DataFrame:
    """All columns and the text rebuilt from ``fim.output`` and ``fim.form``; null where they are null."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restore_one(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return transformed.withColumn(output, back("fim.output", "fim.form"))


_SQL = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents),
 h as (select *, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
  ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
 c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
   when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
 p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n::bigint as n, form, (case when form <> 'plain' then a end)::bigint as prefix_chars,
 (case when form <> 'plain' then b - a end)::bigint as middle_chars,
 sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
  else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p
"""


@query(_SQL)
def op12_infill(spark, sf_dir):
    made = restore(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
                       F.sha2("fim.output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
