"""Column functions: pitch scales, banding, rounding, text and array helpers."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def semitones(f: Column, ref: float = 100.0) -> Column:
    return 12 * F.log2(f / ref)


def from_semitones(st: Column, ref: float = 100.0) -> Column:
    return ref * F.pow(F.lit(2.0), st / 12)


def cents(a: Column, b: Column) -> Column:
    """NULL where either is not above 0."""
    return 1200 * F.log2(F.try_divide(a, b))


def log_edges(lo: Column, hi: Column, bands: int = 5) -> Column:
    """The bands + 1 edges between lo and hi, evenly spaced in the logarithm."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands)), lambda k: F.exp(F.log(lo) + k * (F.log(hi) - F.log(lo)) / bands))


def band(f: Column, edges: Column, bands: int = 5) -> Column:
    """1 to ``bands``: bins are closed on the left and saturate; values are compared with the edges themselves."""
    out = F.lit(1)
    for k in range(1, bands):
        out = out + (f >= F.element_at(edges, k + 1)).cast("int")
    return out.cast("int")


def t_value(f: Column, lo: Column, hi: Column) -> Column:
    """NULL where the bounds coincide or f is not above 0."""
    return F.try_divide(5 * (F.log(f) - F.log(lo)), F.log(hi) - F.log(lo))


def log_z(f: Column, mean: Column, std: Column) -> Column:
    """NULL where all values are the same."""
    return F.try_divide(F.log(f) - mean, std)


def dbfs(rms: Column) -> Column:
    return 20 * F.log10(F.greatest(rms, F.lit(1e-10)))


def rint(x: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(x, 0).cast("long")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(n: Column, m: Column) -> Column:
    """n / max(1, m)."""
    return n / F.greatest(m, F.lit(1))


def han(text: Column) -> Column:
    """The Han characters of a text, joined."""
    return F.array_join(F.regexp_extract_all(text, F.lit("([㐀-鿿])"), 1), "")


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose conditions hold, as an array."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]), lambda x: x.isNotNull())


def argmax(vector: Column) -> Column:
    """The first position, from 0, of the greatest element."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def log_softmax(vector: Column) -> Column:
    top = F.array_max(vector)
    total = F.log(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))
    return F.transform(vector, lambda x: x.cast("double") - top - total)


def log_add(a: Column, b: Column, weight: float = 0.5) -> Column:
    """ln(exp(a) + weight exp(b)) without overflow."""
    b = b + F.log(F.lit(weight))
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def collapse(labels: Column, blank: int = 0) -> Column:
    """Runs of equal labels as one, then without blanks."""
    starts = F.filter(labels, lambda x, i: (i == 0) | (x != F.element_at(labels, F.greatest(i, F.lit(1)))))
    return F.filter(starts, lambda x: x != blank)


def feasible_frames(labels: Column) -> Column:
    """Frames that a label sequence needs: one for each, and one between equal neighbours."""
    same = F.filter(labels, lambda x, i: (i > 0) & (x == F.element_at(labels, F.greatest(i, F.lit(1)))))
    return F.size(labels) + F.size(same)


def ordered_avg(value: str, order: str) -> Column:
    """The mean of the values of a short group, added up in their order, whatever the plan: for means that are compared with a threshold, where the last bit decides. NULLs are left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda total, p: total + p[value]), F.size(pairs))


def learning_rate(step: Column, warm: int, total: int, peak: float) -> Column:
    """Linear warm-up, then linear decay to nothing."""
    return F.when(step < warm, peak * (step + 1) / warm).otherwise(peak * F.greatest(F.lit(0.0), (total - step) / F.lit(float(max(1, total - warm)))))


def safe_path(path: Column) -> Column:
    """Relative, with no empty, ``.`` or ``..`` parts and no backslash or drive."""
    return ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", "..")) & ~path.rlike(r"\\|^[A-Za-z]:")


def sql_text(value: Column) -> Column:
    """A cell of a display table: text with quotes doubled."""
    return F.replace(value, F.lit('"'), F.lit('""'))


def html_escape(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def base64_text(value: Column) -> Column:
    """The UTF-8 bytes of a text in base64, on one line: Spark breaks it after 76 characters."""
    return F.replace(F.base64(value.cast("binary")), F.lit("\r\n"), F.lit(""))


def budget_left(elapsed: Column, inner: float, outer: float) -> Column:
    """Seconds that remain of a run: at most ``inner``, and nothing beyond ``outer`` since the start."""
    return F.greatest(F.lit(0.0), F.least(F.lit(inner), outer - elapsed))


def private_json(names: tuple[str, ...]):
    """A column function over JSON texts: some object at any depth has one of the keys, or some string is an absolute path.
    NULL and texts that are no JSON give NULL."""

    def found(value) -> bool:
        if isinstance(value, dict):
            return any(k in names or found(v) for k, v in value.items())
        if isinstance(value, list):
            return any(map(found, value))
        return isinstance(value, str) and value.startswith("/")

    def judged(text: str | None) -> bool | None:
        try:
            return None if text is None else found(json.loads(text))
        except ValueError:
            return None

    @F.pandas_udf(T.BooleanType())
    def private(texts: pd.Series) -> pd.Series:
        return texts.map(judged).astype("boolean")

    return private


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def python_round(value: Column, places: int) -> Column:
    """The nearest number with so many decimal places, as Python's round() has it: decided on the binary value itself, and halves that are exact go to
    the even digit. The product with the power of ten is taken with its error (each factor split in two halves of bits), so a value a hair below a half is
    not taken for one. Beyond 2^52 units of the last place a value is its own rounding; NULL, NaN and infinities stay."""
    scale, split = float(10**places), 134_217_729.0  # the fixed value 2^27 + 1
    high_s = scale * split - (scale * split - scale)
    low_s = scale - high_s
    product = value * F.lit(scale)
    high = value * F.lit(split) - (value * F.lit(split) - value)
    low = value - high
    error = ((high * high_s - product) + high * low_s + low * high_s) + low * low_s
    floor = F.floor(product).cast("double")
    rest = product - floor
    even = floor % 2 == 0
    up = F.when(rest != 0.5, rest > 0.5).when(error != 0, error > 0).otherwise(~even)
    small = F.abs(product) < float(2**52)
    return F.when(small & (product != 0), F.when(up, floor + 1).otherwise(floor) / F.lit(scale)).otherwise(value)
