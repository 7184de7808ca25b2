"""MPEG audio columns: payloads in the frames' ancillary data, and a reader that finds and checks frames."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmeter.llm.common import prepare

# Fixed values of the MPEG audio formats: kbit/s by (MPEG-1?, layer) and index, Hz by version and index.
KBITS = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
VERSIONS = {0: 2.5, 2: 2, 3: 1}

POLYNOMIAL = 0x8005


def _table() -> list[int]:
    rows = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ POLYNOMIAL if value & 0x8000 else value << 1) & 0xFFFF
        rows.append(value)
    return rows


CRC = _table()


def crc16(data: bytes, value: int = 0xFFFF) -> int:
    """The checksum of a protected frame, over the header's last two bytes and the side information."""
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ CRC[value >> 8 ^ byte]
    return value


def frame_header(data: bytes, at: int) -> dict | None:
    """The frame header at a place, or None: sync, version, layer, rates, size, samples, side length."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1 : at + 4]
    version, layer = VERSIONS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    rate, speed = b2 >> 4, b2 >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or speed == 3:
        return None
    first = version == 1
    kbits, hertz, pad, mono = KBITS[first, layer][rate], HERTZ[version][speed], b2 >> 1 & 1, b3 >> 6 == 3
    samples = {1: 384, 2: 1152, 3: 1152 if first else 576}[layer]
    size = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    side = ((17 if mono else 32) if first else (9 if mono else 17)) if layer == 3 else 0
    return {"version": version, "layer": layer, "kbits": kbits, "hertz": hertz, "mono": mono, "protected": not b1 & 1, "size": size, "samples": samples, "side": side}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _plain(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _frame(rate: int, body: bytes, size: int) -> bytes:
    """A silent, protected, mono layer III frame at 32 kHz; body follows the empty granules."""
    header = bytes([0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0])
    side = bytes(17)
    return (header + struct.pack(">H", crc16(header[2:] + side)) + side + body).ljust(size, b"\0")


#: Of the frames written here: bytes by bitrate index, and what they hold beside header, checksum, side information.
SIZES = [0, *(144 * k * 1000 // 32000 for k in KBITS[True, 3][1:])]
OVERHEAD = 4 + 2 + 17
TOP = len(SIZES) - 1


def write_mpeg(payload: bytes) -> bytes:
    """An MPEG-1 layer III stream of silence whose ancillary data are the payload, any bytes.

    An ID3v2.4 tag holds the payload's length, a first frame the Xing table (frames, bytes,
    100 seek points); full frames have the highest bitrate and the last one the lowest that
    holds the rest. Equal payloads give equal streams.
    """
    room = SIZES[TOP] - OVERHEAD
    frames = [_frame(TOP, payload[i : i + room], SIZES[TOP]) for i in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room :]:
        rate = next(i for i in range(1, TOP + 1) if SIZES[i] - OVERHEAD >= len(rest))
        frames.append(_frame(rate, rest, SIZES[rate]))
    xing_rate = next(i for i in range(1, TOP + 1) if SIZES[i] - OVERHEAD >= 120)
    audio = SIZES[xing_rate] + sum(map(len, frames))
    offsets, at = [], SIZES[xing_rate]
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * offsets[i * len(frames) // 100] // audio) if frames else 0 for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), audio) + toc
    text = b"\3payload-bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + _frame(xing_rate, xing, SIZES[xing_rate]) + b"".join(frames)


def read_mpeg(data: bytes | None) -> dict:
    """What a stream holds; any bytes are allowed.

    Tags: ID3v2 at the start (text frames by name, TXXX by description), ID3v1 where the last
    frame ends 128 bytes before the end or no frame is found any more; never within a frame.
    Frames: from the first header whose frame ends in another header of the same version, layer
    and speed, in a tag or at the end; after damage the search goes on byte by byte. A frame
    with its own checksum is counted as good or bad (layer III). A Xing, Info or VBRI table is
    not audio. Durations are exact fractions of a second, less the encoder's delay and padding
    where the table has them. Result: tags, vbr, seconds (Fraction), samples, hertz, offsets and
    bodies of frames, bitrates (kbit/s: frames), crc_good, crc_bad, skipped (bytes).
    """
    data = data or b""
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        stop = min(end, 10 + _plain(data[6:10]))
        i = 10
        while i + 10 <= stop and data[i : i + 4].strip(b"\0"):
            n = _plain(data[i + 4 : i + 8]) if data[3] == 4 else int.from_bytes(data[i + 4 : i + 8], "big")
            name, body = data[i : i + 4].decode("latin-1"), data[i + 10 : min(stop, i + 10 + n)]
            if name.startswith("T") and body:
                text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
                if name == "TXXX":
                    name, _, text = text.partition("\0")
                tags[name] = text.rstrip("\0")
            i += 10 + n
        at = stop
    # where an ID3v1 tag would be; whether it is one shows when the walk over frames arrives there
    tail = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else None
    out = {"tags": tags, "vbr": None, "samples": 0, "hertz": 0, "offsets": [], "bodies": [], "bitrates": {}, "crc_good": 0, "crc_bad": 0, "skipped": 0}
    seconds, like, trim = Fraction(0), None, 0
    while at + 4 <= end:
        if at == tail:
            end = tail
            for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                tags.setdefault(name, data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"))
            break
        h = frame_header(data, at)
        ok = h is not None and at + h["size"] <= end and (like is None or like == (h["version"], h["layer"], h["hertz"]))
        if ok and at + h["size"] not in (end, tail) and like is None:
            after = frame_header(data, at + h["size"])
            ok = after is not None and (after["version"], after["layer"], after["hertz"]) == (h["version"], h["layer"], h["hertz"])
        if not ok:
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            if tail is not None and at < tail:
                following = min(following, tail)
            out["skipped"] += following - at
            at = following
            continue
        like = (h["version"], h["layer"], h["hertz"])
        body = at + 4 + 2 * h["protected"] + h["side"]
        if h["protected"] and h["layer"] == 3:
            stated = int.from_bytes(data[at + 4 : at + 6], "big")
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : body]) == stated
            out["crc_good" if good else "crc_bad"] += 1
        mark = data[body : body + 4]
        if not out["offsets"] and out["vbr"] is None and mark in (b"Xing", b"Info"):
            flags, i, table = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8, {"kind": mark.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = int.from_bytes(data[i : i + 4], "big")
                    i += 4
            if flags & 4:
                table["toc"] = list(data[i : i + 100])
                i += 100
            i += 4 * bool(flags & 8)
            if data[i : i + 4] in (b"LAME", b"Lavc", b"Lavf"):
                gap = int.from_bytes(data[i + 21 : i + 24], "big")
                trim = (gap >> 12) + (gap & 0xFFF)
            out["vbr"] = table
        elif not out["offsets"] and out["vbr"] is None and data[at + 36 : at + 40] == b"VBRI":
            out["vbr"] = {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
        else:
            out["offsets"].append(at)
            out["bodies"].append((body, at + h["size"]))
            out["bitrates"][h["kbits"]] = out["bitrates"].get(h["kbits"], 0) + 1
            out["samples"] += h["samples"]
            out["hertz"] = h["hertz"]
        at += h["size"]
    out["skipped"] += max(0, end - at)
    out["samples"] = max(0, out["samples"] - trim)
    if out["hertz"]:
        seconds = Fraction(out["samples"], out["hertz"])
    return out | {"seconds": seconds}


def stored_payload(data: bytes, found: dict) -> bytes | None:
    """The payload that write_mpeg stored, or None where the stream states none or is damaged."""
    stated = found["tags"].get("payload-bytes", "")
    if not stated.isdigit():
        return None
    payload = b"".join(data[a:b] for a, b in found["bodies"])
    return payload[: int(stated)] if len(payload) >= int(stated) else None


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a stream.

    Null texts count as empty; rows stay as they are, repeated ones too.
    """
    prepare(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([write_mpeg(p) for _, p in rows], pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


FOUND = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, samples bigint, hertz int, seconds_num bigint, seconds_den bigint, frames int, crc_good int, crc_bad int, skipped bigint, bitrates string, seek array<bigint>"


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """media(id, n_bytes, media) parsed: digests of the payload read back, durations, checks, seek offsets of frames.

    A null or damaged stream keeps its row; what can't be read is null.
    """
    prepare(media)
    kind = media.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}

    def one(data: bytes | None) -> tuple:
        found = read_mpeg(data)
        data = data or b""
        payload = stored_payload(data, found)
        own = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        s = found["seconds"]
        rates = ",".join(f"{k}x{n}" for k, n in sorted(found["bitrates"].items()))
        return *own, len(data), hashlib.sha256(data).hexdigest(), found["samples"], found["hertz"], s.numerator, s.denominator, len(found["offsets"]), found["crc_good"], found["crc_bad"], found["skipped"], rates, found["offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(one, batch.column(2).to_pylist()), strict=True)) or [[]] * len(names)
            made = [pa.array(c, types[x.split()[1]]) for c, x in zip(rows, FOUND.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=[id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, {FOUND}")
