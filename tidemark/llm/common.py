"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpointed

# A word is a maximal run of characters other than space, tab, LF, VT, FF, CR.
WORD_RE = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(WORD_RE)
# A-Z to a-z only; other alphabets stay as they are.
ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}
# The constants of the splitmix64 finalizer.
_GOLDEN, _MIX1, _MIX2 = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

__all__ = ["ASCII_LOWER", "WORD_RE", "blocks_for", "checkpointed", "mix64", "read_table", "slices", "unit_hash", "words"]


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: str | None) -> list[str]:
    """Words of a text; none for null."""
    return _WORDS.findall(text) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer over an unsigned array."""
    with np.errstate(over="ignore"):
        z = x + _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        return z ^ (z >> np.uint64(31))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 2^32) from an MD5 digest: the same in any engine and on any retry."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def blocks_for(n: int, rows: int) -> int:
    """How many blocks of about ``rows`` rows hold ``n`` rows; at least one."""
    return max(1, math.ceil(n / rows))


def slices(sizes: np.ndarray, limit: int):
    """Consecutive index ranges whose sizes sum to about ``limit``, one item at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)
