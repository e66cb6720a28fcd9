"""Bit and byte fields of BINARY columns as built-in column expressions (``bit_scan`` alone runs in Python).

Integers are built by ``conv(hex(...))``; a payload that ends early reads as
zero bits, as a bit reader past the end of its buffer would give.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# 48 bits keep the widest window (7 bytes) inside a signed BIGINT.
MAX_FIELD_BITS = 48
WORD_BYTES = 7
WORD_BITS = WORD_BYTES * 8


def _int(col_or_int: Column | int) -> Column:
    return col_or_int if isinstance(col_or_int, Column) else F.lit(col_or_int)


def shift_right(value: Column, n: Column | int) -> Column:
    """Right shift whose distance may itself be a column."""
    if isinstance(n, int):
        return F.shiftright(value, n)
    return F.call_function("shiftright", value, n.cast("int"))


def shift_left(value: Column, n: Column | int) -> Column:
    if isinstance(n, int):
        return F.shiftleft(value, n)
    return F.call_function("shiftleft", value, n.cast("int"))


def word(payload: Column, first_byte: Column | int = 0, n_bytes: int = WORD_BYTES) -> Column:
    """``n_bytes`` (at most 7) from ``first_byte`` as one big-endian BIGINT, zero-filled at the end."""
    if not 1 <= n_bytes <= WORD_BYTES:
        raise ValueError("a word holds 1 to 7 bytes")
    window = F.substring(payload, _int(first_byte) + 1, n_bytes)
    return F.conv(F.rpad(F.hex(window), n_bytes * 2, "0"), 16, 10).cast("bigint")


def word_bits(w: Column, pos: Column | int, n: int, total: int = WORD_BITS) -> Column:
    """``n`` bits at bit ``pos`` of a word of ``total`` bits, most significant first."""
    shifted = shift_right(w, total - n - pos if isinstance(pos, int) else F.lit(total - n) - pos)
    return shifted.bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def bits(payload: Column, pos: Column | int, n: int) -> Column:
    """Unsigned field of ``n`` bits starting at bit ``pos``, MSB first, zero past the end."""
    if not 1 <= n <= MAX_FIELD_BITS:
        raise ValueError(f"field width must be 1..{MAX_FIELD_BITS}")
    if isinstance(pos, int):
        first = pos // 8
        n_bytes = (pos + n - 1) // 8 - first + 1
        return word_bits(word(payload, first, n_bytes), pos - 8 * first, n, n_bytes * 8)
    n_bytes = (n + 6) // 8 + 1
    w = word(payload, F.shiftright(pos, 3), n_bytes)
    return word_bits(w, pos.bitwiseAND(7), n, n_bytes * 8)


def _le_hex(payload: Column, offset: Column | int, n_bytes: int) -> Column:
    start = _int(offset)
    parts = [F.hex(F.substring(payload, start + (i + 1), 1)) for i in reversed(range(n_bytes))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def _inside(payload: Column, offset: Column | int, n_bytes: int, value: Column) -> Column:
    start = _int(offset)
    return F.when((start >= 0) & (F.octet_length(payload) >= start + n_bytes), value)


def le16(payload: Column, offset: Column | int) -> Column:
    """Unsigned little-endian 16-bit integer at byte ``offset``; null outside the payload."""
    return _inside(payload, offset, 2, _le_hex(payload, offset, 2)).cast("int")


def le32(payload: Column, offset: Column | int) -> Column:
    """Unsigned little-endian 32-bit integer (BIGINT)."""
    return _inside(payload, offset, 4, _le_hex(payload, offset, 4))


def le32s(payload: Column, offset: Column | int) -> Column:
    """Signed little-endian 32-bit integer (INT)."""
    v = _le_hex(payload, offset, 4)
    signed = F.when(v >= (1 << 31), v - (1 << 32)).otherwise(v)
    return _inside(payload, offset, 4, signed).cast("int")


def le64(payload: Column, offset: Column | int) -> Column:
    """Little-endian 64-bit integer; values of 2^63 and over come out negative."""
    start = _int(offset)
    low = _le_hex(payload, start, 4)
    high = _le_hex(payload, start + 4, 4)
    return _inside(payload, offset, 8, F.shiftleft(high, 32).bitwiseOR(low))


def le_bytes(value: Column, n_bytes: int) -> Column:
    """The little-endian bytes of a non-negative integer column (writer side of ``le16``..``le64``)."""
    v = value.cast("bigint")
    parts = [F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0") for i in range(n_bytes)]
    return F.unhex(F.concat(*parts))


def word_c3(w: Column, pos: Column | int, total: int = WORD_BITS) -> tuple[Column, Column]:
    """Three-valued code ``0``->0, ``10``->1, ``11``->2 inside a word: (value, bits used)."""
    after = pos + 1
    first = word_bits(w, pos, 1, total)
    second = word_bits(w, after, 1, total)
    value = F.when(first == 0, 0).when(second == 0, 1).otherwise(2)
    return value, F.when(first == 0, 1).otherwise(2)


def c3(payload: Column, pos: Column | int) -> Column:
    """Three-valued code at bit ``pos`` as STRUCT<value, used>."""
    pair = bits(payload, pos, 2)
    return F.struct(
        F.when(pair < 2, 0).when(pair == 2, 1).otherwise(2).alias("value"),
        F.when(pair < 2, 1).otherwise(2).alias("used"),
    )


def bit_string(payload: Column, n: int) -> Column:
    """The first ``n`` bits as a string of ``0`` and ``1``, zero-filled past the end."""
    parts = []
    for first in range(0, (n + 7) // 8, 6):
        n_bytes = min(6, (n + 7) // 8 - first)
        digits = F.rpad(F.hex(F.substring(payload, first + 1, n_bytes)), n_bytes * 2, "0")
        parts.append(F.lpad(F.conv(digits, 16, 2), n_bytes * 8, "0"))
    return F.substring(F.concat(*parts), 1, n)


def chars(s: Column) -> Column:
    """The characters of a string as an array (one linear pass, unlike repeated ``substring``)."""
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def pattern_positions(s: Column, pattern: str) -> Column:
    """All zero-based positions of ``pattern`` in ``s``, overlapping ones included."""
    m = len(pattern)
    if m == 0:
        raise ValueError("pattern must not be empty")
    wanted = F.array(*[F.lit(c) for c in pattern])
    n = F.length(s)

    def hits(cs: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n - m), lambda i: F.slice(cs, i + 1, m) == wanted)

    # transform over a one-element array binds the character array once per row
    found = F.element_at(F.transform(F.array(chars(s)), hits), 1)
    return F.when(n >= m, found).otherwise(F.array().cast("array<int>"))


#: What ``bit_scan`` finds.
_SCAN = pa.struct({"n_bits": pa.int64(), "ones": pa.int64(), "positions": pa.list_(pa.int64()), "trimmed": pa.int64(), "md5": pa.string()})
#: Bits searched at once.
BLOCK = 16
HEX_DIGITS, NIBBLE_NAMES = "0123456789ABCDEF", "abcdefghijklmnop"


def all_bits(payload: Column) -> Column:
    """Every bit of a payload of any length as a string of ``0`` and ``1``, in time linear in it."""
    out = F.translate(F.hex(payload), HEX_DIGITS, NIBBLE_NAMES)  # digits get names that are no bits
    for k, name in enumerate(NIBBLE_NAMES):
        out = F.replace(out, F.lit(name), F.lit(f"{k:04b}"))
    return out


def bit_positions(bits: Column, pattern: str) -> Column:
    """``pattern_positions`` for long strings of ``0`` and ``1``: cuts bytes, so no array of characters is made.

    Blocks are searched as a whole first, and bit by bit only where the pattern starts in them.
    """
    m = len(pattern)
    if m == 0:
        raise ValueError("pattern must not be empty")
    wanted = F.lit(pattern).cast("binary")

    def hits(b: Column) -> Column:
        n = F.length(b)  # not of ``bits``, which would be worked out anew per block
        blocks = F.filter(F.sequence(F.lit(0), n - m, F.lit(BLOCK)), lambda k: F.contains(F.substring(b, k + 1, F.lit(BLOCK + m - 1)), wanted))
        return F.flatten(F.transform(blocks, lambda k: F.filter(
            F.sequence(k, F.least(k + BLOCK - 1, n - m)), lambda i: F.substring(b, i + 1, F.lit(m)) == wanted)))

    found = F.element_at(F.transform(F.array(bits.cast("binary")), hits), 1)
    return F.when(F.length(bits) >= m, found).otherwise(F.array().cast("array<int>"))


def bit_scan(payload: Column, pattern: str) -> Column:
    """All bits of a payload at once, without a string of them outside the task: STRUCT<n_bits, ones, positions, trimmed, md5>.

    ``positions`` are those of ``pattern`` (``bit_positions``), ``trimmed`` is the length without trailing ones and ``md5`` is
    that of ``all_bits``. One payload is unpacked at a time, in a fixed number of linear passes.
    """
    if not pattern or set(pattern) - {"0", "1"}:
        raise ValueError("pattern must be a string of 0 and 1")
    wanted = [int(c) for c in pattern]

    def scan(data: bytes) -> tuple:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        n = len(bits) - len(wanted) + 1
        hit = np.ones(max(n, 0), bool)
        for k, bit in enumerate(wanted if n > 0 else []):
            hit &= bits[k : k + n] == bit
        zeros = len(bits) - 1 - int(bits[::-1].argmin()) if len(bits) else -1
        trimmed = 0 if zeros < 0 or bits[zeros] else zeros + 1
        text = hashlib.md5(bits + ord("0"), usedforsecurity=False).hexdigest()
        return len(bits), int(np.count_nonzero(bits)), np.flatnonzero(hit), trimmed, text

    @F.arrow_udf("n_bits bigint, ones bigint, positions array<bigint>, trimmed bigint, md5 string")
    def scanned(payloads: pa.Array) -> pa.Array:
        rows = [None if (data := p.as_py()) is None else dict(zip(_SCAN.names, scan(data))) for p in payloads]
        return pa.array(rows, _SCAN)

    return scanned(payload)


def trim_run(s: Column, ch: str) -> Column:
    """Drop the trailing run of one character."""
    return F.rtrim(s, F.lit(ch))


def sign_magnitude(length: Column, value: Column) -> Column:
    """Signed difference from its bit length and raw bits (top bit clear means negative)."""
    full = shift_left(F.lit(1), length) - 1
    top = shift_right(value, length - 1).bitwiseAND(1)
    return (
        F.when(length == 0, 0)
        .when(top == 1, value)
        .otherwise(-value.bitwiseXOR(full))
        .cast("int")
    )


def int8(value: Column) -> Column:
    """Two's-complement reading of an unsigned byte."""
    return F.when(value >= 128, value - 256).otherwise(value).cast("int")


def pack6(flags: list[Column]) -> Column:
    """Six 0/1 flags into one pattern, first flag in the top bit."""
    if len(flags) != 6:
        raise ValueError("a coded pattern has six flags")
    out = F.lit(0)
    for i, flag in enumerate(flags):
        out = out + F.shiftleft(flag.cast("int"), 5 - i)
    return out


def unpack6(cbp: Column, block: Column | int) -> Column:
    """Flag of one block (0..5) in a six-bit pattern."""
    return shift_right(cbp, 5 - block if isinstance(block, int) else F.lit(5) - block).bitwiseAND(1)


def complement(cbp: Column) -> Column:
    """Invert the four luma flags unless both chroma flags are set."""
    return F.when(cbp.bitwiseAND(3) != 3, cbp.bitwiseXOR(0x3C)).otherwise(cbp)
