"""Integer codes as column expressions: sign folding, variable-length numbers, bit tricks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values below this are their own token in the hybrid code; fixed by the format.
HYBRID_SPLIT_BITS = 4
HYBRID_SPLIT = 1 << HYBRID_SPLIT_BITS


def _long(x: Column) -> Column:
    return x.cast("long")


def _shl(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", _long(x), (F.lit(n) if isinstance(n, int) else n).cast("int"))


def pack_signed(x: Column) -> Column:
    """0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.when(x >= 0, 2 * _long(x)).otherwise(-2 * _long(x) - 1)


def unpack_signed(u: Column) -> Column:
    half = F.shiftright(_long(u), 1)
    return F.when(u % 2 == 0, half).otherwise(-half - 1)


def floor_log2(x: Column) -> Column:
    """Exact for every positive long: the length of the binary form."""
    return F.length(F.bin(_long(x))) - 1


def ceil_log2(x: Column) -> Column:
    return floor_log2(x) + F.when(F.bit_count(_long(x)) > 1, 1).otherwise(0)


def leading_zeros32(x: Column) -> Column:
    return 31 - floor_log2(x)


def trailing_zeros(x: Column) -> Column:
    lowest = _long(x).bitwiseAND(-_long(x))
    return F.bit_count(lowest - 1)


def varlen_bits(x: Column) -> Column:
    """Bits of the payload of x in the variable-length code of x + 1."""
    return floor_log2(_long(x) + 1)


def varlen_payload(x: Column) -> Column:
    return _long(x) + 1 - _shl(F.lit(1), varlen_bits(x))


def varlen_decode(nbits: Column, payload: Column) -> Column:
    return _shl(F.lit(1), nbits) + payload - 1


def hybrid_token(x: Column) -> Column:
    n = floor_log2(x)
    high = F.shiftright(_long(x), 1)  # keeps the branch's arithmetic defined for small x
    second = F.when(x < HYBRID_SPLIT, F.lit(0)).otherwise(F.call_function("shiftright", _long(x) - _shl(F.lit(1), n), (n - 1).cast("int")))
    return F.when(x < HYBRID_SPLIT, _long(x)).otherwise(HYBRID_SPLIT + 2 * (n - HYBRID_SPLIT_BITS) + second + 0 * high)


def hybrid_bits(x: Column) -> Column:
    return F.when(x < HYBRID_SPLIT, F.lit(0)).otherwise(floor_log2(x) - 1)


def hybrid_payload(x: Column) -> Column:
    return F.when(x < HYBRID_SPLIT, F.lit(0).cast("long")).otherwise(_long(x).bitwiseAND(_shl(F.lit(1), floor_log2(x) - 1) - 1))


def hybrid_token_bits(token: Column) -> Column:
    return F.when(token < HYBRID_SPLIT, F.lit(0)).otherwise(HYBRID_SPLIT_BITS - 1 + F.shiftright(_long(token) - HYBRID_SPLIT, 1))


def hybrid_decode(token: Column, payload: Column) -> Column:
    n = HYBRID_SPLIT_BITS + F.shiftright(_long(token) - HYBRID_SPLIT, 1)
    large = _shl(F.lit(1), n) + _shl(_long(token).bitwiseAND(F.lit(1)), n - 1) + payload
    return F.when(token < HYBRID_SPLIT, _long(token)).otherwise(large)


def varint_bytes(x: Column) -> Column:
    """Bytes of the 7-bits-to-a-byte form."""
    return F.greatest(F.lit(1), F.ceil((F.when(x > 0, floor_log2(x)).otherwise(0) + 1) / 7)).cast("int")


def varint(x: Column) -> Column:
    """The 7-bits-to-a-byte form, low groups first, in upper-case hex."""
    n = varint_bytes(x)
    group = lambda i: F.call_function("shiftright", _long(x), (7 * i).cast("int")).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(group(i)), 2, "0")), "")


def div_ceil(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((_long(a) + b - 1) / b).cast("long")


def lehmer(order: Column) -> Column:
    """Inversion table of a permutation given as an array: how many later entries are smaller."""
    return F.transform(order, lambda v, i: F.size(F.filter(order, lambda w, j: (j > i) & (w < v))))


def timecode(code: Column) -> Column:
    """HH:MM:SS:FF of a packed 0xHHMMSSFF number."""
    parts = [F.lpad(F.hex(F.shiftrightunsigned(_long(code), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in (3, 2, 1, 0)]
    return F.concat_ws(":", *parts)


def store_be32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(_long(x)), 8, "0"))


def load_be(data: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian number of `size` bytes at a 0-based offset."""
    return F.conv(F.hex(F.substring(data, offset + 1, size)), 16, 10).cast("long")


def load_le(data: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian number: the bytes in reverse."""
    text = F.concat(*[F.hex(F.substring(data, offset + 1 + k, 1)) for k in reversed(range(size))])
    return F.conv(text, 16, 10).cast("long")
