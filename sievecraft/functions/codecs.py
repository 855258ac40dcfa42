"""Byte-level codecs as Column expressions: base64url links, slugs, checksums, bit-packed records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .expr import let

PACKED = 128
UNPACKED = 155
SLUG_LENGTH = 12

# fixed values: legal range of each of an operator's 21 parameters, of the 19 voice parameters, and of a name byte
OPERATOR_RANGES = [(0, 99)] * 11 + [(0, 3), (0, 3), (0, 7), (0, 3), (0, 7), (0, 99), (0, 1), (0, 31), (0, 99), (0, 14)]
VOICE_RANGES = [(0, 99)] * 8 + [(0, 31), (0, 7), (0, 1)] + [(0, 99)] * 4 + [(0, 1), (0, 5), (0, 7), (0, 48)]
NAME_RANGE = (32, 126)
RANGES = OPERATOR_RANGES * 6 + VOICE_RANGES + [NAME_RANGE] * 10
NAME_AT = 145


# --- links ---------------------------------------------------------------------------------

def to_base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Bytes, or null where the text is no base64url."""
    plain = F.translate(text, "-_", "+/")
    padded = F.concat(plain, F.expr("''"), F.repeat(F.lit("="), F.pmod(4 - F.length(plain) % 4, F.lit(4)).cast("int")))
    return F.try_to_binary(padded, F.lit("base64"))


def slug(name: Column, longest: int = SLUG_LENGTH) -> Column:
    """Lower-case letters and digits, other runs as one hyphen, none at the ends, at most `longest` characters."""
    s = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, longest), "-+$", "")


def encode_link(packed: Column, name: Column) -> Column:
    s = slug(name)
    return F.concat(F.lit("#v="), F.when(s != "", F.concat(s, F.lit("."))).otherwise(F.lit("")), to_base64url(packed))


def decode_link(link: Column, size: int = PACKED) -> Column:
    """The record in a link, or null unless it decodes to `size` bytes."""
    payload = F.regexp_extract(link, r"^#?v=(?:[^.]*\.)?(.*)$", 1)
    data = F.when(payload != "", from_base64url(payload))
    return F.when(F.octet_length(data) == size, data)


# --- bytes as arrays -------------------------------------------------------------------------

def byte_array(data: Column) -> Column:
    """The bytes of a binary column as integers."""
    return let(F.hex(data), lambda h: F.transform(F.sequence(F.lit(1), (F.length(h) / 2).cast("int")), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))


def from_byte_array(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def checksum(values: Column) -> Column:
    """Seven-bit two's complement of the sum of bytes."""
    return F.aggregate(values, F.lit(0), lambda a, v: a + v.cast("int")).bitwiseAND(F.lit(127)).__rsub__(128) % 128


def clamp(values: Column, ranges: list[tuple[int, int]] = RANGES) -> Column:
    lo, hi = (F.array(*[F.lit(r[i]) for r in ranges]) for i in (0, 1))
    return F.zip_with(F.zip_with(values, lo, lambda v, a: F.greatest(v, a)), hi, lambda v, b: F.least(v, b))


def clamped_count(values: Column, ranges: list[tuple[int, int]] = RANGES) -> Column:
    return F.size(F.filter(F.zip_with(values, clamp(values, ranges), lambda a, b: a != b), lambda d: d))


def content_key(packed: Column) -> Column:
    """What identifies a packed record: everything but its ten name bytes."""
    return F.substring(packed, 1, PACKED - 10)


def decode_name(values: Column) -> Column:
    """Bytes as text: seven bits each, what does not print as a blank, blanks at the end cut."""
    chars = F.transform(values, lambda v: F.when((v.bitwiseAND(127) >= 32) & (v.bitwiseAND(127) < 127), F.chr(v.bitwiseAND(127))).otherwise(F.lit(" ")))
    return F.rtrim(F.array_join(chars, ""))


def encode_name(name: Column, length: int = 10) -> Column:
    clean = F.regexp_replace(F.rpad(F.substring(name, 1, length), length, " "), r"[^\x20-\x7e]", " ")
    return byte_array(F.encode(clean, "utf-8"))


# --- bit-packed records ----------------------------------------------------------------------
# Where each unpacked byte lies in the packed record: (byte, shift, mask). The numbers are fixed values of the format.

def _layout() -> list[tuple[int, int, int]]:
    out = []
    for op in range(6):
        p = 17 * op
        out += [(p + i, 0, 127) for i in range(11)]
        out += [(p + 11, 0, 3), (p + 11, 2, 3)]  # curves
        out += [(p + 12, 0, 7), (p + 13, 0, 3), (p + 13, 2, 7)]  # rate scaling, amplitude and velocity sensitivity
        out += [(p + 14, 0, 127), (p + 15, 0, 1), (p + 15, 1, 31), (p + 16, 0, 127), (p + 12, 3, 15)]  # level, mode, coarse, fine, detune
    out += [(102 + i, 0, 127) for i in range(8)]
    out += [(110, 0, 31), (111, 0, 7), (111, 3, 1)]  # algorithm, feedback, oscillator sync
    out += [(112 + i, 0, 127) for i in range(4)]
    out += [(116, 0, 1), (116, 1, 7), (116, 4, 7), (117, 0, 127)]  # LFO sync, wave, pitch sensitivity, transpose
    out += [(118 + i, 0, 127) for i in range(10)]
    return out


LAYOUT = _layout()


def unpack(packed: Column) -> Column:
    """128 packed bytes -> 155 parameters, as an array of integers."""
    at, shift, mask = (F.array(*[F.lit(x[i]) for x in LAYOUT]) for i in range(3))
    raw = let(byte_array(packed), lambda b: F.transform(at, lambda i: F.element_at(b, i + 1)))
    powers = F.transform(shift, lambda s: F.pow(F.lit(2), s).cast("int"))
    shifted = F.zip_with(raw, powers, lambda v, p: F.floor(v / p).cast("int"))
    return F.zip_with(shifted, mask, lambda v, m: v.bitwiseAND(m))


def pack(values: Column) -> Column:
    """155 parameters -> 128 packed bytes; bits outside a parameter's field are cut off."""

    def packed(v: Column) -> Column:
        parts: dict[int, list[Column]] = {}
        for i, (at, shift, mask) in enumerate(LAYOUT):
            parts.setdefault(at, []).append(F.element_at(v, i + 1).bitwiseAND(F.lit(mask)) * (1 << shift))
        return F.array(*[sum(parts[k][1:], parts[k][0]) for k in range(PACKED)])

    return from_byte_array(let(values, packed))


def unpack_bytes(packed: bytes) -> bytes:
    return bytes(packed[a] >> s & m for a, s, m in LAYOUT)


def pack_bytes(values: bytes) -> bytes:
    out = bytearray(PACKED)
    for v, (a, s, m) in zip(values, LAYOUT):
        out[a] |= (v & m) << s
    return bytes(out)


def checksum_bytes(data: bytes) -> int:
    return -sum(data) & 127


# --- seven-bit frames ------------------------------------------------------------------------

def pack7(data: bytes) -> bytes:
    """Bytes as one little-endian number, cut into seven-bit digits."""
    n = int.from_bytes(data, "little")
    return bytes(n >> k & 127 for k in range(0, 8 * len(data), 7))


def unpack7(digits: bytes) -> bytes:
    """The inverse; digits' bits that do not fill a byte are padding."""
    n = sum((d & 127) << 7 * k for k, d in enumerate(digits))
    size = 7 * len(digits) // 8
    return (n & ((1 << 8 * size) - 1)).to_bytes(size, "little")


# fixed values: what a device's frames begin with, its read command, and the length of a reply's header
FRAME, READ, READ_VOICE, REPLY_HEADER = b"\x00\x59", 0x23, 5, 14


def frame(command: int, payload: bytes) -> bytes:
    """A device frame: start, command, three bytes of length, payload, inverted sum of the payload."""
    return FRAME + bytes([command]) + len(payload).to_bytes(3, "little") + payload + bytes([sum(payload) & 255 ^ 255])


def read_request() -> bytes:
    """The message that asks a device for its current record."""
    return b"\xf0" + pack7(frame(READ, bytes([READ_VOICE, 0, 0, 0, 0, UNPACKED, 0, 0]))) + b"\xf7"


def read_reply(message: bytes, size: int = UNPACKED) -> bytes | None:
    """The record in a device's reply, or None for any other message."""
    body = message[1:] if message[:1] == b"\xf0" else message
    data = unpack7(body[:-1] if body[-1:] == b"\xf7" else body)
    if len(data) < REPLY_HEADER + size + 1 or not data.startswith(FRAME):
        return None
    return data[REPLY_HEADER : REPLY_HEADER + size]


# fixed values: start and factor of both halves of a content's short name, and how many parameters it covers (all but the name)
HASH_SEEDS, HASH_FACTORS, HASHED = (0x811C9DC5, 0x01000193), (0x01000193, 0x85EBCA6B), 145


def _times32(x: Column, factor: int) -> Column:
    """x * factor modulo 2 ** 32, without leaving 64 bits."""
    low, high = factor & 0xFFFF, factor >> 16
    return (x * low + (x * high).bitwiseAND(0xFFFF) * 65536).bitwiseAND(0xFFFFFFFF)


def content_hash(values: Column) -> Column:
    """A short name for a record's content: two 32-bit hashes of its parameters but the name, each in base 36."""
    start = F.struct(F.lit(HASH_SEEDS[0]).cast("long").alias("a"), F.lit(HASH_SEEDS[1]).cast("long").alias("b"))
    placed = F.transform(F.slice(values, 1, HASHED), lambda v, i: F.struct(v.cast("long").alias("v"), i.cast("long").alias("i")))
    both = F.aggregate(placed, start, lambda h, x: F.struct(_times32(h["a"].bitwiseXOR(x["v"]), HASH_FACTORS[0]).alias("a"), _times32(h["b"] + x["v"] + x["i"], HASH_FACTORS[1]).alias("b")))
    text = lambda h: F.lower(F.conv(h.cast("string"), 10, 36))
    return F.transform(F.array(both), lambda h: F.concat(text(h["a"]), text(h["b"])))[0]


@F.pandas_udf(BinaryType())
def pack7_udf(data: pd.Series) -> pd.Series:
    return data.map(pack7)


@F.pandas_udf(BinaryType())
def unpack7_udf(data: pd.Series) -> pd.Series:
    return data.map(unpack7)


def floats_from_base64(text: Column) -> Column:
    """Little-endian float32 values in base64."""

    @F.pandas_udf("array<float>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))

    return decode(F.unbase64(text))


# --- archive dates and controller messages ---------------------------------------------------

def dos_timestamp(date: Column, time: Column) -> Column:
    """16-bit date and time fields of an archive entry as a timestamp; null where out of range."""
    f = lambda c, shift, mask: F.shiftright(c, shift).bitwiseAND(mask)
    return F.try_make_timestamp(f(date, 9, 127) + 1980, f(date, 5, 15), f(date, 0, 31), f(time, 11, 31), f(time, 5, 63), (f(time, 0, 31) * 2).cast("decimal(8,6)"))


def pitch_bend(low: Column, high: Column) -> Column:
    """14-bit bend in -1 to 1; the two halves have scales of their own."""
    v = high.bitwiseAND(127) * 128 + low.bitwiseAND(127) - 8192
    return F.when(v < 0, v / F.lit(8192.0)).otherwise(v / F.lit(8191.0))


def message_kind(status: Column, velocity: Column) -> Column:
    """Kind of a channel message; a note-on without velocity is a note-off."""
    high = F.shiftright(status, 4)
    return F.when((high == 9) & (velocity > 0), "note_on").when(high.isin(8, 9), "note_off").when(high == 11, "controller").when(high == 14, "bend")
