"""Vector expressions over array columns, in double precision: similarities, norms, and the hash embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), f), F.lit(0.0), lambda acc, x: acc + x)


def dot_raw(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot_raw(a, a))


def cosine_signed(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null for a zero vector."""
    return cosine_of(dot_raw(a, b), norm(a) * norm(b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for a zero vector."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine_signed(a, b), F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), dot_raw(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return 1 / (1 + F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return 1 / (1 + _fold(a, b, lambda x, y: F.abs(x - y)))


def angular(a: Column, b: Column) -> Column:
    return 1 - F.acos(cosine(a, b)) / F.pi()


def cosine_of(dot_: Column, norms: Column) -> Column:
    """Cosine in [-1, 1] from a dot product and the product of the norms; null for a zero vector."""
    return F.when(norms > 0, dot_ / norms)


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean, "manhattan": manhattan, "angular": angular}


def from_distance(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / 2)


def normalize(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def valid(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


#: What is trimmed off texts: Unicode's blanks (Zs), as SQL's trim does; tabs and line ends stay.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def hash_embedding(text: Column, dim: int = 768) -> Column:
    """Bytes of the text's SHA-256, scaled to [-1, 1] and repeated to dim; zeros for blank text."""
    text = F.btrim(text, F.lit(BLANKS))
    digest = F.sha2(text.cast("binary"), 256)
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array_repeat(F.lit(0.0), dim)).otherwise(values)
