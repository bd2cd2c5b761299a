"""Packed event files: 40-byte little-endian records, as a Spark data source for reading and writing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed record layout: two stamps (ns), price and quantity (1e-8), kind, side, flags, five zero bytes.
RECORD = np.dtype([("exch_ts", "<u8"), ("local_ts", "<u8"), ("price", "<i8"), ("qty", "<i8"), ("kind", "u1"), ("side", "u1"), ("flags", "u1"), ("pad", "V5")])
SCHEMA = "exch_ts bigint, local_ts bigint, price bigint, qty bigint, kind int, side int, flags int"
KINDS = {1: "trade", 2: "delta", 3: "snapshot", 4: "quote"}
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def encode(batch: pa.RecordBatch) -> bytes:
    """The batch as packed records; a null side is 0. Negative stamps or quantities raise."""
    out = np.zeros(batch.num_rows, RECORD)
    for name in ("exch_ts", "local_ts", "price", "qty", "kind", "side", "flags"):
        col = batch.column(batch.schema.get_field_index(name))
        v = col.fill_null(0).to_numpy(zero_copy_only=False) if name == "side" else col.to_numpy(zero_copy_only=False)
        if col.null_count and name != "side":
            raise ValueError(f"null {name}")
        if name in ("exch_ts", "local_ts", "qty") and len(v) and v.min() < 0:
            raise ValueError(f"negative {name}")
        out[name] = v
    return out.tobytes()


def decode(data: bytes, last: int = 0) -> pa.RecordBatch:
    """Packed records as a batch; raises on a wrong length, an unknown kind or side, or a stamp that goes back."""
    if len(data) % RECORD.itemsize:
        raise ValueError(f"{len(data)} bytes are no whole records")
    r = np.frombuffer(data, RECORD)
    if len(r):
        if not np.isin(r["kind"], list(KINDS)).all():
            raise ValueError("unknown kind")
        if (r["side"] > 2).any():
            raise ValueError("unknown side")
        if (r["local_ts"] < r["exch_ts"]).any():
            raise ValueError("seen before it happened")
        if int(r["local_ts"][0]) < last or (np.diff(r["local_ts"].astype(np.int64)) < 0).any():
            raise ValueError("local_ts goes back")
    side = pa.array(r["side"].astype(np.int32), mask=r["side"] == 0)
    return pa.record_batch([pa.array(r[c].astype(np.int64)) for c in ("exch_ts", "local_ts", "price", "qty")] + [pa.array(r["kind"].astype(np.int32)), side, pa.array(r["flags"].astype(np.int32))], names=["exch_ts", "local_ts", "price", "qty", "kind", "side", "flags"])


def checksum(data: bytes, state: int = FNV_OFFSET) -> int:
    """FNV-1a 64 over bytes, carried on from a state; order matters."""
    for b in data:
        state = ((state ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return state


def _local(path: str) -> str:
    return urlparse(path).path if path.startswith("file:") else path


@dataclass
class _Chunk(InputPartition):
    path: str
    offset: int
    length: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _local(options["path"])
        self.chunk = int(options.get("chunkRecords", 500_000)) * RECORD.itemsize

    def partitions(self) -> list[_Chunk]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if f.endswith(".evt"))
        out = []
        for f in files:
            size = os.path.getsize(f)
            if size % RECORD.itemsize:
                raise ValueError(f"{f}: {size} bytes are no whole records")
            out += [_Chunk(f, k, min(self.chunk, size - k)) for k in range(0, size, self.chunk)]
        return out

    def read(self, part: _Chunk) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            last = 0
            if part.offset:  # the record before, so that order is checked across chunks
                f.seek(part.offset - RECORD.itemsize)
                last = int(np.frombuffer(f.read(RECORD.itemsize), RECORD)["local_ts"][0])
            yield decode(f.read(part.length), last)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    records: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = _local(options["path"])
        self.overwrite = overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        tmp = os.path.join(self.path, f".{uuid.uuid4().hex}")
        n = last = 0
        with open(tmp, "wb") as f:
            for b in batches:
                if b.num_rows:
                    data = encode(b)
                    decode(data, last)
                    last = int(np.frombuffer(data[-RECORD.itemsize :], RECORD)["local_ts"][0])
                    f.write(data)
                    n += b.num_rows
        final = os.path.join(self.path, f"part-{part:05d}.evt")
        os.replace(tmp, final)
        return _Written(final, n)

    def commit(self, messages: list[_Written | None]) -> None:
        keep = {m.path for m in messages if m}
        if self.overwrite:
            for f in os.listdir(self.path):
                if f.endswith(".evt") and os.path.join(self.path, f) not in keep:
                    os.remove(os.path.join(self.path, f))

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class PackedEvents(DataSource):
    """spark.dataSource.register(PackedEvents), then format('packed_events'); a partition is written in its own order, which must not go back in local_ts."""

    @classmethod
    def name(cls) -> str:
        return "packed_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)
