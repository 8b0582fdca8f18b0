"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions of a hash embedding; a power of two, so that the low byte of the hash is all that matters.
HASH_DIMENSIONS = 256
#: Fixed value: below this product of norms a cosine is undefined.
LEAST_NORMS = 1.1920929e-07


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if lengths differ or are 0, or a vector is all but zero; else within -1 and 1."""
    norms = norm(a) * norm(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > LEAST_NORMS)
    return F.when(fine, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def hash_bucket(gram: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, modulo 256: 64-bit offset and prime act on the low byte as 37 and 179."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(gram)), lambda i: F.conv(F.hex(F.substring(F.encode(gram, "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))
    return F.when(F.octet_length(gram) == 0, 37).otherwise(F.aggregate(codes, F.lit(37), lambda h, b: (h.bitwiseXOR(b) * 179).bitwiseAND(255)))


def grams(text: Column) -> Column:
    """Words and all character 3-, 4- and 5-grams of the lowered text, spaces included."""
    low = F.lower(text)

    def of(n: int) -> Column:
        return F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(F.filter(F.split(low, r"\s+"), lambda w: w != ""), of(3), of(4), of(5))
