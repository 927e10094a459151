"""Numbers, times, emotions, vectors and padded arrays, as columns of built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(text: str | Column) -> Column:
    """H:M:S, M:S or S, with a comma or point, as seconds; null if it doesn't read so."""
    parts = F.transform(F.split(F.replace(F.trim(_col(text)), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    ok = F.size(parts).between(1, 3) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(ok, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def tokens_of_seconds(s: str | Column, step: float = 0.02, floor: int = 1) -> Column:
    """Whole steps in a duration, by truncation of the binary quotient."""
    return F.greatest(F.lit(floor).cast("long"), (_col(s) / F.lit(step)).cast("long"))


def probability(p: str | Column) -> Column:
    """Two decimals, within 0.01 and 0.99."""
    return F.least(F.greatest(F.bround(_col(p), 2), F.lit(0.01)), F.lit(0.99))


def correction(p: str | Column, positive_only: bool = False) -> Column:
    """Two decimals; what isn't positive is 0.01 if it must be."""
    r = F.bround(_col(p), 2)
    return F.when(r <= 0, F.lit(0.01)).otherwise(r) if positive_only else r


def half_up(x: str | Column, digits: int) -> Column:
    """A number that isn't negative rounded by its binary value times a power of ten, as SQL engines do; round() goes by the shortest decimal form."""
    scale = 10.0**digits
    return F.floor(_col(x) * scale + 0.5) / scale


def canonical(label: str | Column, aliases: Mapping[str, str], default: str | None = None) -> Column:
    """A label by its alias, in lower case."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    key = F.lower(F.trim(_col(label)))
    found = F.try_element_at(table, key) if table is not None else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default) if default is not None else key)


def one_hot(label: str | Column, dims: Sequence[str]) -> Column:
    """1 at the label's place."""
    return F.array(*[F.when(_col(label) == d, 1.0).otherwise(0.0) for d in dims])


def biased(vector: str | Column, bias: Sequence[float], cap: float = 0.8) -> Column:
    """A vector times a bias, scaled down if its sum is over the cap (F16)."""
    v = F.zip_with(_col(vector), F.array(*[F.lit(float(b)) for b in bias]), lambda x, b: x * b)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > cap, F.transform(v, lambda x: x * cap / total)).otherwise(v)


def decibels(energy: str | Column, floor: float = 2.220446049250313e-16) -> Column:
    """10 * log10 with a floor."""
    return 10 * F.log10(F.greatest(_col(energy), F.lit(floor)))


def snr(signal: str | Column, noise: str | Column) -> Column:
    return decibels(signal) - decibels(noise)


def doubles(v: str | Column) -> Column:
    return _col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """F28; null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: str | Column) -> Column:
    n = norm(a)
    return F.transform(_col(a), lambda x: F.try_divide(x, n))


def standardised_mse(source: str | Column, other: str | Column) -> Column:
    """Both by the source's mean and sample deviation (1e-5 at least), then the mean squared difference (F32)."""
    s, n = _col(source), F.size(_col(source))
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    sd = F.greatest(F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(n - 1, F.lit(0))), F.lit(1e-5))
    return F.aggregate(F.zip_with(s, _col(other), lambda x, y: F.pow((x - y) / sd, F.lit(2.0))), F.lit(0.0), lambda a, x: a + x) / n


def padded(df: DataFrame, vector: str, batch: str, name: str = "padded") -> DataFrame:
    """Vectors filled up with zeros to the longest of their batch, and their lengths."""
    size = F.size(vector)
    most = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(size).alias("_most"))  # a number a batch: vectors aren't shuffled for it
    wide = df.join(most, F.col(batch).eqNullSafe(F.col("_batch"))).withColumn("length", size.cast("long"))
    return wide.withColumn(name, F.concat(F.col(vector), F.array_repeat(F.lit(0.0), (F.col("_most") - size).cast("int")))).drop("_batch", "_most")
