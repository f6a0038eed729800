"""Scalar functions as column expressions; Python only where the JVM has no equivalent."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Shortened venue names and committee roles.
SHORT = {"SOFTWARE": "S/W", "SIGSOFT": "NOTES", "MODELS": "MDLS"}
ROLES = {"General Chair": "GC", "Program Chair": "PC", "PC member main track": "PCM"}
PUNCTUATION = string.punctuation


def without_punctuation(c: Column) -> Column:
    return F.trim(F.translate(c, PUNCTUATION, ""))


@F.pandas_udf(StringType())
def plain_letters(s: pd.Series) -> pd.Series:
    """Letters only, lower case, without accents (NFKD; the JVM functions have no normalisation)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if c.isascii() and c.isalpha()).lower())


def first_name(name: Column) -> Column:
    """First token longer than one letter once trailing dots are gone, else the last token; lower case, up to a hyphen."""
    parts = F.transform(F.split(F.trim(name), r"\s+"), lambda t: F.rtrim(F.regexp_replace(t, r"\.+$", "")))
    long_ = F.filter(parts, lambda t: F.length(t) > 1)
    pick = F.when(F.size(long_) > 0, F.element_at(long_, 1)).otherwise(F.element_at(parts, -1))
    return F.lower(F.substring_index(pick, "-", 1))


def is_true(c: Column) -> Column:
    return F.coalesce(c.cast("string").isin("True", "true"), F.lit(False))


def short_venue(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])[c], c)


def short_role(c: Column) -> Column:
    """Committee roles by their short forms; any other role is an error."""
    out = F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(c, F.lit("NULL")))).cast("string")
    for k, v in ROLES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def team_size(n: Column) -> Column:
    return F.when(n == 1, "Single").when(n <= 4, "Small").otherwise("Large")


def seven_plus(n: Column) -> Column:
    return F.when(n < 7, n.cast("string")).otherwise("7+")


def year_interval(y: Column, width: int = 4, start: int = 1992) -> Column:
    """Label such as 1992-1995 of the stretch of years that y falls into."""
    lo = (F.lit(start) + F.floor((y - start) / width) * width).cast("int")
    return F.concat(lo.cast("string"), F.lit("-"), (lo + width - 1).cast("string"))


def two_digit_year(y: Column) -> Column:
    return F.right(y.cast("string"), F.lit(2))


def url_parts(url: Column) -> Column:
    """(host without its last part's suffix, last two parts of the path)."""
    host = F.split(F.parse_url(url, F.lit("HOST")), r"\.")
    path = F.split(F.parse_url(url, F.lit("PATH")), "/")
    return F.struct(F.try_element_at(host, F.lit(-2)).alias("host"), F.array_join(F.slice(path, F.greatest(F.size(path) - 1, F.lit(1)), 2), "/").alias("tail"))


def number_if_possible(c: Column) -> Column:
    return c.try_cast("double")


def harmonic_weights(n: Column) -> Column:
    """1/i over the harmonic number, for i from 1 to n."""
    raw = F.transform(F.sequence(F.lit(1), n), lambda i: F.lit(1.0) / i)
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def argmax(a: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
