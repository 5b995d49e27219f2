"""Data types of matrices and vectors, traits, and checks of operands at plan time."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum


class DType(Enum):
    """Codes of the binary formats: float 1 or double 2, with real 4 or complex 8."""

    S, D, C, Z = 5, 6, 9, 10

    @property
    def is_complex(self) -> bool:
        return bool(self.value & 8)

    @property
    def is_double(self) -> bool:
        return bool(self.value & 2)

    @property
    def size(self) -> int:
        return (8 if self.is_double else 4) * (2 if self.is_complex else 1)

    @property
    def spark(self) -> str:
        one = "double" if self.is_double else "float"
        return f"struct<re:{one},im:{one}>" if self.is_complex else one

    @property
    def numpy(self) -> str:
        return {"S": "f4", "D": "f8", "C": "c8", "Z": "c16"}[self.name]

    @classmethod
    def of(cls, code: int) -> DType:
        try:
            return cls(code)
        except ValueError:
            raise ValueError(f"no data type has code {code}") from None


class Symmetry(Enum):
    GENERAL, SYMMETRIC, SKEW, HERMITIAN = 1, 2, 4, 8


@dataclass(frozen=True)
class MatrixTraits:
    """Storage wishes; C, T and sort_scope only feed statistics, the relation has no padding."""

    dtype: DType = DType.D
    symmetry: Symmetry = Symmetry.GENERAL
    C: int = 32
    T: int = 1
    sort_scope: int = 1

    def with_(self, **kw) -> MatrixTraits:
        return replace(self, **kw)


def is_zero(x: complex) -> bool:
    return x == 0


def is_one(x: complex) -> bool:
    return x == 1


def check_mat_vec(a, x, y=None) -> None:
    if a.ncols != x.nrows:
        raise ValueError(f"the matrix has {a.ncols} columns, the vector {x.nrows} rows")
    if y is not None and (y.nrows != a.nrows or y.ncols != x.ncols):
        raise ValueError("the result's shape doesn't fit")


def check_same_shape(*vs) -> None:
    if len({(v.nrows, v.ncols) for v in vs}) > 1:
        raise ValueError("block vectors differ in shape")


def check_ascending(idx: list[int], n: int) -> None:
    if any(b <= a for a, b in zip(idx, idx[1:], strict=False)) or (idx and not 0 <= idx[0] <= idx[-1] < n):
        raise ValueError("indices must ascend strictly and lie within the vector")
