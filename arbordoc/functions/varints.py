"""Little-endian base-128 integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class MalformedVarint(ValueError):
    pass


def encode_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, offset behind it)."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise MalformedVarint
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return value, at


def varint(n: Column) -> Column:
    """binary of a non-negative long column: shifts and masks put the bytes in order into one long, whose hexadecimal is cut to size."""
    n = n.cast("long")
    group = lambda k, more: F.shiftright(n, 7 * k).bitwiseAND(0x7F).bitwiseOR(0x80 if more else 0)

    def packed(count: int, more: bool) -> Column:
        """The first `count` bytes, at most eight, as an integer, the first one on top; more: another byte follows them."""
        total = group(0, count > 1 or more)
        for k in range(1, count):
            total = F.shiftleft(total, 8).bitwiseOR(group(k, k + 1 < count or more))
        return F.lpad(F.hex(total), 2 * count, "0")

    out = F.concat(packed(8, True), F.lpad(F.hex(group(8, False)), 2, "0"))
    for count in range(8, 0, -1):
        out = F.when(n < F.lit(1 << 7 * count), packed(count, False)).otherwise(out)
    return F.unhex(out)


def unvarint(data: Column) -> Column:
    """long of a binary column that holds one varint of up to nine bytes."""
    text, out = F.hex(data), F.lit(0).cast("long")
    for k in range(9):
        byte = F.conv(F.substring(text, 2 * k + 1, 2), 16, 10).cast("long")
        out = out.bitwiseOR(F.when(F.octet_length(data) > k, F.shiftleft(byte.bitwiseAND(0x7F), 7 * k)).otherwise(F.lit(0).cast("long")))
    return out
