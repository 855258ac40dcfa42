"""Scan and sink of binary banks: a tolerant parser, writers of banks and single records, verification."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..audio import routes
from ..functions import codecs
from ..functions.storage import materialize

# fixed values: message frame, manufacturer, and the header of a bank and of a single record
START, END, MAKER = 0xF0, 0xF7, 0x43
BANK_HEAD = bytes([0xF0, 0x43, 0x00, 0x09, 0x20, 0x00])
SINGLE_HEAD = bytes([0xF0, 0x43, 0x00, 0x00, 0x01, 0x1B])
SLOTS = 32
BANK_DATA = SLOTS * codecs.PACKED

ROWS = "file string, bank string, slot int, packed binary, container string, checksum_ok boolean, skipped string"


def _messages(raw: bytes) -> Iterator[bytes]:
    """Frames from a start byte to the next end byte; a second start byte abandons the first."""
    at = -1
    for i, b in enumerate(raw):
        if b == START:
            at = i
        elif b == END and at >= 0:
            yield raw[at : i + 1]
            at = -1


def _records(data: bytes) -> list[bytes]:
    return [data[k : k + codecs.PACKED] for k in range(0, len(data) - codecs.PACKED + 1, codecs.PACKED)]


def parse_bank(raw: bytes, file: str) -> list[tuple]:
    """Rows (file, bank, slot, packed, container, checksum_ok, skipped) of a file; skipped messages are rows without record."""
    rows: list[tuple] = []
    banks = singles = 0
    recognised = False

    def label() -> str:
        nonlocal banks
        banks += 1
        return file if banks == 1 else f"{file} #{banks}"

    def add(data: bytes, container: str, ok: bool | None) -> None:
        name = label()
        rows.extend((file, name, slot, r, container, ok, None) for slot, r in enumerate(_records(data)[:SLOTS]))

    def skip(reason: str) -> None:
        rows.append((file, None, None, None, None, None, reason))

    for m in _messages(raw):
        if len(m) < 6:
            skip("short message")
            continue
        if m[1] != MAKER:
            skip("other manufacturer")
            continue
        recognised = True
        if m[2] >> 4 & 7:
            skip("not a dump")
            continue
        kind, declared, body = m[3], m[4] << 7 | m[5], m[6:-1]
        if kind == 9 and len(body) >= BANK_DATA:
            data, rest = body[:BANK_DATA], body[BANK_DATA:]
            add(data, "bank", rest[0] == codecs.checksum_bytes(data) if rest else None)
        elif kind == 0 and len(body) >= codecs.UNPACKED:
            data, rest = body[: codecs.UNPACKED], body[codecs.UNPACKED :]
            rows.append((file, file, singles % SLOTS, codecs.pack_bytes(data), "single", rest[0] == codecs.checksum_bytes(data) if rest else None, None))
            singles += 1
        elif kind in (4, 5, 6, 7):
            skip("supplement")
        elif declared == BANK_DATA and len(body) >= BANK_DATA:
            add(body[:BANK_DATA], "salvaged", None)
        else:
            skip("unknown format")
    if not recognised and not any(r[3] for r in rows):
        if len(raw) == len(BANK_HEAD) + BANK_DATA + 2 and raw[-1] == END:
            add(raw[6 : 6 + BANK_DATA], "salvaged", None)
        elif raw and len(raw) % codecs.PACKED == 0:
            for k in range(0, len(raw), BANK_DATA):
                add(raw[k : k + BANK_DATA], "raw", None)
        else:
            skip("unrecognised")
    return rows


def parse_banks(files: DataFrame) -> DataFrame:
    """files: path, content -> one row per record or skipped message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch.path, batch.content):
                out = pd.DataFrame(parse_bank(bytes(raw), path), columns=["file", "bank", "slot", "packed", "container", "checksum_ok", "skipped"])
                out["slot"] = out["slot"].astype("Int32")
                out["checksum_ok"] = out["checksum_ok"].astype("boolean")
                yield out

    return files.select("path", "content").mapInPandas(run, ROWS)


#: Carriers of each of the 32 operator arrangements.
CARRIERS = [set(routes.carriers(a)) for a in range(32)]


def normalise(rows: DataFrame, init: bytes | None = None) -> DataFrame:
    """Records clamped and packed again, with key, name, clamped_bytes and reason (null: taken).

    Rejected are records equal to `init` but for the name, all-zero ones, and those whose
    carriers are all silent.
    """
    values = rows.where("packed IS NOT NULL").withColumn("raw", codecs.unpack(F.col("packed"))).withColumn("params", codecs.clamp(F.col("raw")))
    levels = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda op: F.element_at(F.col("params"), ((6 - op) * 21 + 17).cast("int")))
    carriers = F.element_at(F.array(*[F.array(*[F.lit(op in c) for op in range(1, 7)]) for c in CARRIERS]), F.element_at("params", 135) + 1)
    silent = ~F.exists(F.zip_with(levels, carriers, lambda level, c: c & (level > 0)), lambda x: x)
    body = F.slice("params", 1, codecs.NAME_AT)
    reason = F.when(~F.exists("raw", lambda v: v != 0), "zero")
    if init is not None:
        reason = reason.when(body == F.array(*[F.lit(v) for v in init[: codecs.NAME_AT]]), "init")
    reason = reason.when(silent, "silent")
    packed = codecs.pack(F.col("params"))
    return values.select(
        "file", "bank", "slot", "container", "checksum_ok", packed.alias("packed"), codecs.content_key(packed).alias("key"), codecs.decode_name(F.slice("params", codecs.NAME_AT + 1, 10)).alias("name"),
        codecs.clamped_count(F.col("raw")).alias("clamped_bytes"), reason.alias("reason"),
    )


def build_bank(records: list[bytes]) -> bytes:
    """A bank file of 32 packed records."""
    if len(records) != SLOTS or any(len(r) != codecs.PACKED for r in records):
        raise ValueError("a bank has 32 records of 128 bytes")
    data = b"".join(records)
    return BANK_HEAD + data + bytes([codecs.checksum_bytes(data), END])


def build_single(values: bytes) -> bytes:
    if len(values) != codecs.UNPACKED:
        raise ValueError("a record has 155 bytes")
    return SINGLE_HEAD + values + bytes([codecs.checksum_bytes(values), END])


def verify_bank(file: bytes, expected: list[bytes] | None = None) -> list[str]:
    """Faults of a bank file: size, header, checksum, and slots that differ from what was meant."""
    faults = []
    if len(file) != len(BANK_HEAD) + BANK_DATA + 2:
        return [f"size {len(file)}"]
    if file[:2] != BANK_HEAD[:2] or file[3:6] != BANK_HEAD[3:6] or file[-1] != END:
        faults.append("header")
    data = file[6 : 6 + BANK_DATA]
    if file[-2] != codecs.checksum_bytes(data):
        faults.append("checksum")
    for slot, (a, b) in enumerate(zip(_records(data), expected or [])):
        if a != b:
            faults.append(f"slot {slot}")
    return faults


def to_banks(records: DataFrame, placeholder: bytes, order: str = "position") -> DataFrame:
    """records: packed and a position from 0 without gaps. bank, content: files of 32, the last filled with the placeholder."""
    dealt = records.select((F.floor(F.col(order) / SLOTS)).cast("int").alias("bank"), (F.col(order) % SLOTS).cast("int").alias("slot"), "packed")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        slots = dict(zip(pdf.slot, pdf.packed))
        return pd.DataFrame({"bank": [key[0]], "content": [build_bank([bytes(slots.get(s, placeholder)) for s in range(SLOTS)])]})

    return dealt.groupBy("bank").applyInPandas(run, "bank int, content binary")  # 32 rows a group


def number(records: DataFrame, *order: str) -> DataFrame:
    """records with a position from 0 in the given order; ranges of the order are numbered apart, so no task holds all rows."""
    ranged = records.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered")  # sorted ranges may fall otherwise when they are made again
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    starts = sizes.select("__part", "first", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("start"))  # one row per partition
    return ranged.join(F.broadcast(starts), "__part").withColumn("position", F.col("start") + F.col("__at") - F.col("first")).drop("__part", "__at", "first", "start")
