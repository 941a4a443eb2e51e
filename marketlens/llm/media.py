"""Media columns as MPEG transport streams.

``mux`` stores a payload losslessly in 188-byte transport packets: a program association table and a program
map table with one private elementary stream, repeated every ``REPEAT`` access units, and one elementary packet (PES)
per access unit with its presentation timestamp; the first transport packet of a unit is marked as a random-access
point and carries the program clock.  ``demux`` reads any such stream back with vector operations: it parses the tables,
checks continuity counters (a packet that is sent twice, as the standard allows, counts once; a marked discontinuity is
no error), reassembles elementary packets and returns timestamps and clocks with the places of random-access points.

Features are computed from the samples read back: mean, spread, zero crossings around the mean, and peak.

Defined results: null and empty texts count as no bytes and are padded to one row of 192; equal texts give
equal streams; the other columns stay as they are, and an input column of the result's name is replaced; a very long
text is one stream of as many units as it needs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import byte_values, slices

PACKET, SYNC = 188, 0x47
ROW = 192
#: Payload bytes of an access unit (16 rows), and its duration on the 90 kHz clock.
UNIT, TICKS = 16 * ROW, 3600
PAT_PID, PMT_PID, DATA_PID, STREAM_ID, PRIVATE = 0x0000, 0x0100, 0x0101, 0xBD, 0x06
PES_HEAD = 14
#: Access units between two copies of the tables; bytes of the adaptation field with the clock; clock ticks ahead of a timestamp.
REPEAT, ADAPTATION, AHEAD = 64, 8, 9000

STREAM = "struct<payload:binary,media:binary,programs:int,packets:bigint,continuity_errors:bigint,units:array<struct<pts:bigint,packet:bigint,bytes:bigint,random_access:boolean>>>"
DIGEST = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,timestamps:array<bigint>,random_access:array<bigint>>"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


#: The two table packets that open every stream (program 1 on PMT_PID; one private stream on DATA_PID).
_TABLES = _table_packet(PAT_PID, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def tables(copy: int) -> bytes:
    """The table packets with the continuity counter of their ``copy``-th time."""
    out = bytearray(_TABLES)
    for at in (3, PACKET + 3):
        out[at] = 0x10 | copy & 15
    return bytes(out)


def padded(data: bytes) -> bytes:
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def _pts_bytes(pts: np.ndarray) -> np.ndarray:
    out = np.empty((len(pts), 5), np.uint8)
    out[:, 0] = 0x21 | (pts >> 30 & 7) << 1
    out[:, 1] = pts >> 22 & 255
    out[:, 2] = 1 | (pts >> 15 & 127) << 1
    out[:, 3] = pts >> 7 & 255
    out[:, 4] = 1 | (pts & 127) << 1
    return out


def _units_to_packets(units: np.ndarray, first_unit: int, counter: int) -> np.ndarray:
    """Transport packets of equal-sized access units (one row each), continuity counters from ``counter``."""
    n, size = units.shape
    pes = np.empty((n, PES_HEAD + size), np.uint8)
    pes[:, :9] = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (size + 8).to_bytes(2, "big") + b"\x84\x80\x05", np.uint8)
    pes[:, 9:14] = _pts_bytes((first_unit + np.arange(n, dtype=np.int64)) * TICKS)
    pes[:, 14:] = units
    # The first packet carries an adaptation field (random access, clock); the last is stuffed to fit.
    total = pes.shape[1]
    lead = PACKET - 4 - ADAPTATION
    full, rest = divmod(max(0, total - lead), PACKET - 4)
    per = 1 + full + (rest > 0)
    out = np.full((n, per, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = 0x10 | (counter + np.arange(n * per)).reshape(n, per) & 15
    head = min(lead, total)
    out[:, 0, 3] |= 0x20
    out[:, 0, 4], out[:, 0, 5] = PACKET - 5 - head, 0x50
    clock = (first_unit + np.arange(n, dtype=np.int64)) * TICKS + (1 << 33) - AHEAD & (1 << 33) - 1
    for i in range(4):
        out[:, 0, 6 + i] = clock >> 25 - 8 * i & 255
    out[:, 0, 10], out[:, 0, 11] = (clock & 1) << 7 | 0x7E, 0
    out[:, 0, PACKET - head :] = pes[:, :head]
    if full:
        out[:, 1 : 1 + full, 4:] = pes[:, head : head + full * (PACKET - 4)].reshape(n, full, PACKET - 4)
    if rest:
        out[:, -1, PACKET - rest :] = pes[:, total - rest :]
        if rest < PACKET - 4:
            out[:, -1, 3] |= 0x20
            out[:, -1, 4] = PACKET - 5 - rest
            if rest < PACKET - 5:
                out[:, -1, 5] = 0
    return out.reshape(-1, PACKET)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload`` (a positive multiple of 192 bytes)."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    out = []
    counter = 0
    for first in range(0, whole + (len(data) % UNIT > 0), REPEAT):
        out.append(tables(first // REPEAT))
        last = min(first + REPEAT, whole)
        if first < last:
            packets = _units_to_packets(data[first * UNIT : last * UNIT].reshape(-1, UNIT), first, counter)
            counter += len(packets)
            out.append(packets.tobytes())
        if last == whole and len(data) % UNIT and whole < first + REPEAT:
            out.append(_units_to_packets(data[whole * UNIT :].reshape(1, -1), whole, counter).tobytes())
    return b"".join(out)


@dataclass
class Parsed:
    """What :func:`demux` finds in a stream."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: int = 0
    continuity_errors: int = 0
    pts: list[int] = field(default_factory=list)
    clock: list[int] = field(default_factory=list)
    unit_packet: list[int] = field(default_factory=list)
    unit_bytes: list[int] = field(default_factory=list)
    random_access: list[bool] = field(default_factory=list)


def _sections(rows: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    for row, at in zip(rows, starts):
        body = row[int(at) :].tobytes()
        body = body[1 + body[0] :]
        size = 3 + (int.from_bytes(body[1:3], "big") & 0xFFF)
        if crc32_mpeg(body[:size]) == 0:
            yield body[:size]


def demux(media: bytes) -> Parsed:
    """Parse tables, check continuity, reassemble elementary packets.  Bytes that do not make a whole packet
    with a sync byte are skipped and show as continuity errors of the stream they belonged to."""
    p = np.frombuffer(media, np.uint8)
    p = p[: len(p) // PACKET * PACKET].reshape(-1, PACKET)
    p = p[p[:, 0] == SYNC]
    out = Parsed(packets=len(p))
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    begins, adapted, carries = p[:, 1] & 0x40 != 0, p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    start = np.where(adapted, 5 + p[:, 4].astype(np.int32), 4)
    for s in _sections(p[pid == PAT_PID], start[pid == PAT_PID]):
        for i in range(8, len(s) - 4, 4):
            out.programs[int.from_bytes(s[i : i + 2], "big")] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for where in set(out.programs.values()):
        for s in _sections(p[pid == where], start[pid == where]):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i < len(s) - 4:
                out.streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    payload: list[bytes] = []
    for stream in sorted(out.streams):
        at = np.flatnonzero(pid == stream)
        # A packet may be sent twice in a row; the second says nothing new.
        again = np.append(False, (p[at[1:]] == p[at[:-1]]).all(axis=1)) & carries[at]
        at = at[~again]
        rows, first, starts = p[at], begins[at], start[at]
        flags = np.where(adapted[at] & (rows[:, 4] > 0), rows[:, 5], 0)
        jumps = flags & 0x80 != 0
        cc = rows[:, 3].astype(np.int32) & 15
        out.continuity_errors += int(np.count_nonzero(((cc[1:] - cc[:-1] - carries[at][1:]) & 15 != 0) & ~jumps[1:]))
        body = rows[(np.arange(PACKET) >= starts[:, None]) & carries[at][:, None]].tobytes()
        ends = np.cumsum(np.where(carries[at], PACKET - starts, 0))
        opens = np.flatnonzero(first)
        if not len(opens):
            continue
        lo = np.where(opens > 0, ends[opens - 1], 0)
        hi = np.append(lo[1:], len(body))
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
            h = body[a : a + PES_HEAD]
            if h[:3] != b"\x00\x00\x01":
                out.continuity_errors += 1
                continue
            data = body[a + 9 + h[8] : b]
            if h[7] & 0x80:
                out.pts.append((h[9] >> 1 & 7) << 30 | h[10] << 22 | h[11] >> 1 << 15 | h[12] << 7 | h[13] >> 1)
            else:
                out.pts.append(-1)
            row = rows[opens[k]]
            ticks = int.from_bytes(row[6:10].tobytes(), "big") << 1 | int(row[10]) >> 7
            out.clock.append(ticks if flags[opens[k]] & 0x10 else -1)
            out.unit_packet.append(int(at[opens[k]]))
            out.unit_bytes.append(len(data))
            out.random_access.append(bool(row[3] & 0x20 and row[4] and row[5] & 0x40))
            payload.append(data)
    out.payload = b"".join(payload)
    return out


def sample_feature(payload: bytes) -> str:
    """Mean, standard deviation, crossings of the mean and peak of the samples (unsigned bytes)."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    if not n:
        return "samples=0"
    above = x * n > total
    spread = math.sqrt(max(0, n * int((x * x).sum()) - total * total)) / n
    return f"samples={n};mean={total / n:.6f};spread={spread:.6f};crossings={int(np.count_nonzero(above[1:] != above[:-1]))};peak={int(x.max())}"


def feature(x: Parsed) -> str:
    """Figures of a parsed stream's samples and of its structure."""
    return f"{sample_feature(x.payload)};programs={len(x.programs)};packets={x.packets};units={len(x.pts)};random_access={sum(x.random_access)};continuity_errors={x.continuity_errors};first_pts={x.pts[0] if x.pts else -1};last_pts={x.pts[-1] if x.pts else -1}"


def _digest_udf():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            rows = []
            for raw in byte_values(batch):
                media = mux(padded(raw))
                x = demux(media)
                rows.append((len(raw), len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(x), x.pts, [k for k, access in zip(x.unit_packet, x.random_access) if access]))
            cols = list(zip(*rows)) if rows else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, DIGEST)


def _stream_udf():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("payload", pa.binary()), ("media", pa.binary()), ("programs", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("units", pa.list_(pa.struct([("pts", pa.int64()), ("packet", pa.int64()), ("bytes", pa.int64()), ("random_access", pa.bool_())])))])
        for batch in slices(batches):
            rows = []
            for raw in byte_values(batch):
                media = mux(padded(raw))
                x = demux(media)
                units = [dict(zip(("pts", "packet", "bytes", "random_access"), u)) for u in zip(x.pts, x.unit_packet, x.unit_bytes, x.random_access)]
                rows.append({"payload": x.payload, "media": media, "programs": len(x.programs), "packets": x.packets, "continuity_errors": x.continuity_errors, "units": units})
            yield pa.array(rows, kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, STREAM)


def to_stream(docs: DataFrame, text: str = "text", out: str = "stream") -> DataFrame:
    """``docs`` with a struct column ``out``: the stored stream, the payload read back from it, and the
    timestamps and packet numbers of its random-access points."""
    return docs.withColumn(out, _stream_udf()(F.col(f"`{text}`")))


def stream_digest(docs: DataFrame, text: str = "text", out: str = "stream") -> DataFrame:
    """As :func:`to_stream`, but the task keeps only lengths, hashes and the feature string."""
    return docs.withColumn(out, _digest_udf()(F.col(f"`{text}`")))
