"""SimHash fingerprints of texts and their Hamming distance.

Words: commas and semicolons removed, lower case, split at Unicode white space,
stop words dropped. Each bit of the fingerprint is the sign of the sum over all
words of +1 or -1 by that bit of the word's hash; a tie is 0. Null and wordless
texts have fingerprint 0.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runefold.functions.hashing import signed, xxh3_early

# The stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now
""".split()
_STOPS = frozenset(STOP_WORDS)

#: White space as the JVM's ``[\s\p{Z}]`` has it.
_SPACE = re.compile("[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000
_hashes: dict[str, int] = {}


def cleaned(text: Column) -> Column:
    """Commas and semicolons removed, lower case."""
    return F.lower(F.regexp_replace(text, "[,;]", ""))


def _md5_60(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def _fingerprint(text: str | None) -> int:
    """Equal words are counted first and hashed once; ones per bit come from one product of counts and bits."""
    counts = Counter(_SPACE.split(text)) if text else Counter()
    words = [w for w in counts if w and w not in _STOPS]
    if not words:
        return 0
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    hashes = np.array([h if (h := _hashes.get(w)) is not None else _hashes.setdefault(w, _md5_60(w)) for w in words], ">u8")
    n = np.array([counts[w] for w in words], np.int64)
    ones = n @ np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > n.sum()).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([_fingerprint(t) for t in texts], dtype="int64")


def fingerprints(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id_column, fingerprint`` of every row, in one narrow stage; 60 bits, by hashes any SQL engine can repeat."""
    return documents.select(id_column, fingerprint_udf(cleaned(F.col(text_column))).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints; null if either is."""
    return F.bit_count(a.bitwiseXOR(b))


def simhash_exact(text: str | None) -> int:
    """Unsigned 64-bit fingerprint with the early XXH3, for parity with stored ones."""
    counts = [0] * 64
    for w in (text or "").replace(",", "").replace(";", "").split():
        w = w.lower()
        if w not in _STOPS:
            h = xxh3_early(w.encode())
            for i in range(64):
                counts[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if counts[i] > 0)


@F.pandas_udf(T.LongType())
def simhash_exact_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: signed(simhash_exact(t)))
