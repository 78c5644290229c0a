"""MPEG Layer III frame inventory of a clip, as a small per-row helper."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

# Bitrates in kbit/s by header index, sample rates by version bits.
KBPS_V1 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
KBPS_V2 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
VBR_TAGS = (b"Xing", b"Info", b"VBRI")
VBR_TAG_REACH = 40
BITS_PER_SECOND = 128_000
INVENTORY = "path string, length long, audio_bytes long, frames long, duration_sec double"


def audio_start(data: bytes) -> int:
    """Offset behind an ID3v2 tag, whose size is stored in 7-bit bytes."""
    if len(data) <= 10 or data[:3] != b"ID3":
        return 0
    size = 0
    for b in data[6:10]:
        size = size * 128 + (b & 0x7F)
    return min(len(data), 10 + size)


def frame_bytes(data: bytes, at: int) -> int:
    """Length of the frame at ``at``; 0 when there is no valid header."""
    head = int.from_bytes(data[at:at + 4], "big") if at + 4 <= len(data) else 0
    sync, version, layer = head >> 21, head >> 19 & 3, head >> 17 & 3
    rate_no, hz_no, pad = head >> 12 & 15, head >> 10 & 3, head >> 9 & 1
    if sync != 0x7FF or version == 1 or layer != 1 or rate_no in (0, 15) or hz_no == 3:
        return 0
    per_second, samples = (KBPS_V1, 144) if version == 3 else (KBPS_V2, 72)
    return samples * per_second[rate_no] * 1000 // RATES[version][hz_no] + pad


def inventory(data: bytes) -> tuple[int, int]:
    """(audio bytes, whole frames) after dropping the tag and a leading VBR header frame."""
    start = audio_start(data)
    first = frame_bytes(data, start)
    if first and start + first <= len(data):
        frame = data[start:start + first]
        if any(0 <= frame.find(tag) <= VBR_TAG_REACH for tag in VBR_TAGS):
            start += first
    frames, at = 0, start
    while (n := frame_bytes(data, at)) and at + n <= len(data):
        frames, at = frames + 1, at + n
    return len(data) - start, frames


def inventory_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        pairs = [inventory(bytes(c)) for c in df["content"]]
        yield pd.DataFrame({
            "path": df["path"], "length": df["length"], "audio_bytes": [a for a, _ in pairs],
            "frames": [f for _, f in pairs], "duration_sec": [a * 8 / BITS_PER_SECOND for a, _ in pairs]})
