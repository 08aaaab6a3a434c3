"""Fixed-point packing of numbers, vectors and quaternions, and bit helpers, as Columns.

``round`` is half away from zero, as the formats need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracksmith.model import BIT_RATES


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def top(bits) -> Column:
    """The greatest code of ``bits`` bits."""
    return F.pow(F.lit(2.0), _c(bits)) - 1


def pack_unsigned(v, bits) -> Column:
    return F.round(_c(v) * top(bits)).cast("long")


def unpack_unsigned(q, bits) -> Column:
    return _c(q) * (F.lit(1.0) / top(bits))


def pack_signed(v, bits) -> Column:
    return pack_unsigned(_c(v) * 0.5 + 0.5, bits)


def unpack_signed(q, bits) -> Column:
    return unpack_unsigned(q, bits) * 2.0 - 1.0


def decay(v, bits, signed: bool = False) -> Column:
    """What is left of a value after packing."""
    return unpack_signed(pack_signed(v, bits), bits) if signed else unpack_unsigned(pack_unsigned(v, bits), bits)


def lanes(v: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(v, f)


#: Bits of each lane in the fixed vector formats.
VECTOR_FORMATS = {"vector4_64": (16,) * 4, "vector4_32": (8,) * 4, "vector3_48": (16,) * 3, "vector3_32": (11, 11, 10), "vector3_24": (8,) * 3, "vector2_64": (32,) * 2}
QUATERNION_BITS = {"quatf_full": 128, "quatf_drop_w_full": 96, "quatf_drop_w_48": 48, "quatf_drop_w_32": 32}


def pack_vector(v: Column, name: str, signed: bool = False) -> Column:
    """Codes of the lanes of a named format."""
    pack = pack_signed if signed else pack_unsigned
    return F.array(*[pack(v.getItem(i), b) for i, b in enumerate(VECTOR_FORMATS[name])])


def unpack_vector(q: Column, name: str, signed: bool = False) -> Column:
    unpack = unpack_signed if signed else unpack_unsigned
    return F.array(*[unpack(q.getItem(i), b) for i, b in enumerate(VECTOR_FORMATS[name])])


def pack_quaternion(q: Column, bits: int = 16) -> Column:
    """Codes of x, y, z after making w positive; w follows from them."""
    sign = F.when(q.getItem(3) < 0, -1.0).otherwise(1.0)
    return F.array(*[pack_signed(q.getItem(i) * sign, bits) for i in range(3)])


def unpack_quaternion(codes: Column, bits: int = 16) -> Column:
    return with_w(F.array(*[unpack_signed(codes.getItem(i), bits) for i in range(3)]))


def with_w(xyz: Column) -> Column:
    x, y, z = (xyz.getItem(i) for i in range(3))
    return F.array(x, y, z, F.sqrt(F.abs(((1.0 - x * x) - y * y) - z * z)))


def packed_bytes(name: str) -> int:
    bits = QUATERNION_BITS.get(name) or sum(VECTOR_FORMATS[name])
    return (bits + 7) // 8


def bits_of_rate(rate) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in BIT_RATES]), _c(rate).cast("int") + 1)


def is_constant_rate(rate) -> Column:
    return _c(rate) == 0


def is_raw_rate(rate) -> Column:
    return _c(rate) == len(BIT_RATES) - 1


# 32-bit masks are kept in BIGINT: bit_count of a negative INT counts 64 bits.


def count_bits(mask) -> Column:
    return F.bit_count(_c(mask)).cast("int")


def leading_zeros(mask) -> Column:
    m = _c(mask)
    return F.when(m == 0, 32).otherwise(32 - F.length(F.bin(m))).cast("int")


def trailing_zeros(mask) -> Column:
    m = _c(mask)
    return F.when(m == 0, 32).otherwise(F.bit_count(m.bitwiseAND(-m) - 1)).cast("int")


def and_not(a, b) -> Column:
    return _c(a).bitwiseAND(F.bitwise_not(_c(b)))


def rotate_left(mask, n: int) -> Column:
    m = _c(mask)
    return (F.shiftleft(m, n).bitwiseOR(F.shiftright(m, 32 - n))).bitwiseAND(F.lit(0xFFFFFFFF)) if n % 32 else m


def bit_at(index) -> Column:
    """Bitsets count from the highest bit of a 32-bit word."""
    return F.expr("1L").cast("long") * F.pow(F.lit(2.0), 31 - _c(index)).cast("long")


def align_to(value, to: int) -> Column:
    return (F.floor((_c(value) + (to - 1)) / to) * to).cast("long")
