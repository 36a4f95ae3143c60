"""Imports every module with a query, so that QUERIES and CHECKS are complete."""

from tierblend.llm import (  # noqa: F401
    align, bpe, decontaminate, fingerprint, infill, licenses, neardup, quality, secrets, setjoin, sharding, tokencount, toxicity,
)
from tierblend.llm.base import CHECKS, QUERIES  # noqa: F401
