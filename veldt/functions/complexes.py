"""Complex numbers as struct<re, im>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cplx(re, im) -> Column:
    return F.struct((re if isinstance(re, Column) else F.lit(float(re))).alias("re"), (im if isinstance(im, Column) else F.lit(float(im))).alias("im"))


def lit(z: complex) -> Column:
    return cplx(complex(z).real, complex(z).imag)


def add(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def mul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


def abs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def total(a: Column) -> Column:
    """The sum over a group."""
    return cplx(F.sum(a["re"]), F.sum(a["im"]))
