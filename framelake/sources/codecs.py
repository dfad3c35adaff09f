"""Byte formats of frames: FITS, XISF, SER and TIFF, to and from arrays.

An image is (channels, height, width) of doubles in [0, 1]; a header is an
ordered list of (key, value, comment) texts, in which keys can repeat.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, unescape

import numpy as np

Card = tuple[str, str, str]
INTEGER_RANGE = {8: 255.0, 16: 65535.0, 32: 4294967295.0}
#: Structural keys that a writer makes itself: fixed values.
STRUCTURAL = {"SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "EXTEND", "BZERO", "BSCALE", "END", "XTENSION", "PCOUNT", "GCOUNT"}


@dataclass
class Image:
    data: np.ndarray
    cards: list[Card] = field(default_factory=list)
    name: str = ""

    def card(self, key: str) -> str | None:
        """The first value of a key."""
        return next((v for k, v, _ in self.cards if k == key), None)


def scale_to_unit(a: np.ndarray, bits: int, is_float: bool) -> np.ndarray:
    """Integers by their range. Floats above 1 by 255 (at most 255.5) or 65535 (at most 66000), else as they are."""
    a = a.astype(float)
    if not is_float:
        return a / INTEGER_RANGE[bits]
    top = float(np.nanmax(a)) if a.size else 0.0
    if top <= 1.0 or top > 66000:
        return a
    return a / (255.0 if top <= 255.5 else 65535.0)


# ---- FITS ----

def parse_card(text: str) -> Card | None:
    key = text[:8].strip()
    if not key:
        return None
    if text[8:10] != "= ":
        return (key, text[8:].strip(), "")
    rest = text[10:]
    m = re.match(r"\s*'((?:[^']|'')*)'\s*(?:/\s?(.*))?", rest)
    if m:
        return (key, m[1].replace("''", "'").rstrip(), (m[2] or "").strip())
    value, _, comment = rest.partition("/")
    return (key, value.strip(), comment.strip())


def valid_key(key: str) -> bool:
    return bool(re.fullmatch(r"[A-Z0-9_-]{1,8}", key)) or key.startswith("HIERARCH")


def sanitized(cards: list[Card]) -> list[Card]:
    """Cards that may be written: no empty, structural or invalid keys."""
    return [c for c in cards if c[0] and c[0] not in STRUCTURAL and valid_key(c[0])]


def read_fits(data: bytes, pixels: bool = True, region: tuple[int, int, int, int] | None = None) -> list[Image]:
    """All image units; with a region (x, y, w, h), clamped to the frame, only its pixels are decoded."""
    out, at = [], 0
    while at + 2880 <= len(data):
        cards, done = [], False
        while not done and at + 2880 <= len(data):
            block = data[at : at + 2880].decode("ascii", "replace")
            at += 2880
            for k in range(0, 2880, 80):
                line = block[k : k + 80]
                if line.startswith("END") and not line[3:].strip():
                    done = True
                    break
                card = parse_card(line)
                if card:
                    cards.append(card)
        head = {}
        for k, v, _ in cards:
            head.setdefault(k, v)
        if "BITPIX" not in head:
            break
        bitpix = int(head["BITPIX"])
        axes = [int(head.get(f"NAXIS{i + 1}", 0)) for i in range(int(head.get("NAXIS", 0)))]
        count = int(np.prod(axes)) if axes else 0
        size = abs(bitpix) // 8 * count * int(head.get("GCOUNT", 1)) + int(head.get("PCOUNT", 0))
        if len(axes) >= 2 and head.get("XTENSION", "IMAGE").strip() == "IMAGE":
            w, h = axes[0], axes[1]
            channels = 3 if len(axes) == 3 and axes[2] >= 3 else 1
            image = Image(np.empty((channels, 0, 0)), cards, head.get("EXTNAME", ""))
            if pixels:
                kind = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix]
                raw = np.frombuffer(data, kind, channels * w * h, at).reshape(channels, h, w)
                if region:
                    x0, y0 = max(0, region[0]), max(0, region[1])
                    raw = raw[:, y0 : max(y0, min(h, region[1] + region[3])), x0 : max(x0, min(w, region[0] + region[2]))]
                value = raw.astype(float) * float(head.get("BSCALE", 1)) + float(head.get("BZERO", 0))
                image.data = scale_to_unit(value, abs(bitpix), bitpix < 0)
            out.append(image)
        at += -(-size // 2880) * 2880
    return out


def _fits_line(key: str, value: str, comment: str = "") -> str:
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?|[TF]", value.strip()):
        text = f"{key:<8}= {value.strip():>20}"
    else:
        quoted = value.replace("'", "''")
        text = f"{key:<8}= '{quoted:<8}'"
    return (text + (f" / {comment}" if comment else ""))[:80].ljust(80)


def write_fits(image: Image, bits: int = -32) -> bytes:
    """One primary unit of 8, 16 or 32 bit integers, or 32 or 64 bit floats."""
    c, h, w = image.data.shape
    axes = [("NAXIS", "3" if c > 1 else "2"), ("NAXIS1", str(w)), ("NAXIS2", str(h))] + ([("NAXIS3", str(c))] if c > 1 else [])
    lines = [_fits_line("SIMPLE", "T"), _fits_line("BITPIX", str(bits)), *[_fits_line(*a) for a in axes]]
    if bits in (16, 32):
        lines += [_fits_line("BZERO", str(2 ** (bits - 1))), _fits_line("BSCALE", "1")]
    lines += [_fits_line(*card) for card in sanitized(image.cards)] + ["END".ljust(80)]
    head = "".join(lines).encode("ascii", "replace")
    if bits > 0:
        value = np.round(np.clip(image.data, 0, 1) * INTEGER_RANGE[bits])
        body = (value - (2 ** (bits - 1) if bits > 8 else 0)).astype({8: ">u1", 16: ">i2", 32: ">i4"}[bits]).tobytes()
    else:
        body = image.data.astype(">f4" if bits == -32 else ">f8").tobytes()
    return head + b" " * (-len(head) % 2880) + body + b"\0" * (-len(body) % 2880)


# ---- XISF ----

SAMPLES = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}


def shuffle(data: bytes, item: int) -> bytes:
    """Bytes of like significance together; a rest that fills no item stays at the end."""
    n = len(data) // item * item
    return np.frombuffer(data[:n], np.uint8).reshape(-1, item).T.tobytes() + data[n:]


def unshuffle(data: bytes, item: int) -> bytes:
    n = len(data) // item * item
    return np.frombuffer(data[:n], np.uint8).reshape(item, -1).T.tobytes() + data[n:]


def _decompress(data: bytes, spec: str) -> bytes:
    codec, _, rest = spec.partition(":")
    parts = rest.split(":")
    kind = codec.removesuffix("+sh")
    if kind == "zlib":
        data = zlib.decompress(data)
    elif kind == "zstd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data, int(parts[0]))
    else:
        raise ValueError(f"codec {codec} is not available")
    return unshuffle(data, int(parts[1])) if codec.endswith("+sh") else data


def _attributes(tag: str) -> dict[str, str]:
    return {m[1]: unescape(m[2] if m[2] is not None else m[3], {"&quot;": '"'}) for m in re.finditer(r"([\w:]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)}


def read_xisf(data: bytes) -> list[Image]:
    if data[:8] != b"XISF0100":
        raise ValueError("not an XISF file")
    size = struct.unpack("<I", data[8:12])[0]
    xml = data[16 : 16 + size].decode("utf-8").rstrip("\0")
    out = []
    for m in re.finditer(r"<Image\b([^>]*?)(/>|>(.*?)</Image>)", xml, re.S):
        a, inner = _attributes(m[1]), m[3] or ""
        where = a.get("location", "").split(":")
        if where[0] == "attachment":
            block = data[int(where[1]) : int(where[1]) + int(where[2])]
        else:
            coded = re.search(r"<Data\b([^>]*)>(.*?)</Data>", inner, re.S) if where[0] == "embedded" else None
            text = coded[2] if coded else re.sub(r"<.*?>", "", inner)
            kind = _attributes(coded[1]).get("encoding", "base64") if coded else where[1]
            text = "".join(text.split())
            block = base64.b64decode(text) if kind == "base64" else bytes.fromhex(text)
        if "compression" in a:
            block = _decompress(block, a["compression"])
        w, h, c = (int(v) for v in a["geometry"].split(":"))
        kind = SAMPLES[a["sampleFormat"]]
        value = np.frombuffer(block, kind, w * h * c)
        value = value.reshape(h, w, c).transpose(2, 0, 1) if a.get("pixelStorage", "Planar") == "Normal" else value.reshape(c, h, w)
        cards = [(k["name"], k.get("value", "").strip("'").rstrip(), k.get("comment", "")) for k in (_attributes(t[1]) for t in re.finditer(r"<FITSKeyword\b([^>]*)/?>", inner))]
        out.append(Image(scale_to_unit(value, 8 * np.dtype(kind).itemsize, "f" in kind), cards, a.get("id", "")))
    return out


def write_xisf(image: Image, codec: str | None = "zlib", item: int = 4) -> bytes:
    c, h, w = image.data.shape
    raw = image.data.astype("<f4").tobytes()
    packed, spec = raw, ""
    if codec:
        sh = shuffle(raw, item)
        if codec == "zlib":
            packed = zlib.compress(sh)
        else:
            import zstandard

            packed = zstandard.ZstdCompressor().compress(sh)
        spec = f' compression="{codec}+sh:{len(raw)}:{item}"'
    quote = lambda s: escape(s, {'"': "&quot;"})
    keys = "".join(f'<FITSKeyword name="{quote(k)}" value="{quote(v)}" comment="{quote(m)}"/>' for k, v, m in sanitized(image.cards))
    start = 8192
    while True:
        xml = (f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image geometry="{w}:{h}:{c}" sampleFormat="Float32" colorSpace="{"RGB" if c == 3 else "Gray"}"'
               f' location="attachment:{start}:{len(packed)}"{spec}>{keys}</Image></xisf>').encode()
        if 16 + len(xml) <= start:
            break
        start *= 2
    return (b"XISF0100" + struct.pack("<II", len(xml), 0) + xml).ljust(start, b"\0") + packed


# ---- SER ----

SER_HEAD = struct.Struct("<14siiiiiii40s40s40sqq")


def read_ser(data: bytes) -> tuple[list[np.ndarray], list[int | None], dict]:
    """Frames in [0, 1], UTC time stamps (100 ns ticks, or None) and the header."""
    magic, _, colour, _, w, h, depth, n, *_rest = SER_HEAD.unpack_from(data)
    if magic != b"LUCAM-RECORDER":
        raise ValueError("not a SER file")
    planes = 3 if colour in (100, 101) else 1
    kind = "u1" if depth <= 8 else "<u2"
    size = w * h * planes * np.dtype(kind).itemsize
    frames = []
    for k in range(n):
        a = np.frombuffer(data, kind, w * h * planes, SER_HEAD.size + k * size).astype(float).reshape(h, w, planes).transpose(2, 0, 1)
        a = a[::-1] if colour == 101 else a
        frames.append(a / (255.0 if depth <= 8 else 65535.0))
    tail = SER_HEAD.size + n * size
    stamps = list(struct.unpack_from(f"<{n}q", data, tail)) if len(data) >= tail + 8 * n else [None] * n
    return frames, stamps, {"width": w, "height": h, "depth": depth, "colour": colour, "frames": n}


def write_ser(frames: list[np.ndarray], stamps: list[int] | None = None, depth: int = 16) -> bytes:
    c, h, w = frames[0].shape
    head = SER_HEAD.pack(b"LUCAM-RECORDER", 0, 100 if c == 3 else 0, 0, w, h, depth, len(frames), b"", b"", b"", 0, (stamps or [0])[0])
    top, kind = (255.0, "u1") if depth <= 8 else (65535.0, "<u2")
    body = b"".join(np.round(np.clip(f, 0, 1) * top).astype(kind).transpose(1, 2, 0).tobytes() for f in frames)
    return head + body + (struct.pack(f"<{len(stamps)}q", *stamps) if stamps else b"")


# ---- TIFF (uncompressed or deflate strips) ----

def read_tiff(data: bytes) -> Image:
    order = "<" if data[:2] == b"II" else ">"
    if data[:2] not in (b"II", b"MM") or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    sizes, codes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}, {1: "B", 3: "H", 4: "I"}
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n, raw = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind in codes:
            size = sizes[kind] * n
            where = raw[:size] if size <= 4 else data[struct.unpack(order + "I", raw)[0] :][:size]
            tags[tag] = struct.unpack(order + codes[kind] * n, where)
    w, h, c, bits = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags.get(258, (8,))[0]
    is_float = tags.get(339, (1,))[0] == 3
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279])]
    if tags.get(259, (1,))[0] in (8, 32946):
        strips = [zlib.decompress(s) for s in strips]
    elif tags.get(259, (1,))[0] != 1:
        raise ValueError("this TIFF compression is not available")
    kind = order + ("f" if is_float else "u") + str(bits // 8)
    value = np.frombuffer(b"".join(strips), kind, w * h * c)
    value = value.reshape(c, h, w) if tags.get(284, (1,))[0] == 2 else value.reshape(h, w, c).transpose(2, 0, 1)
    return Image(scale_to_unit(value, bits, is_float))


def write_tiff(image: Image, bits: int = 16) -> bytes:
    """One strip, interleaved; 8 or 16 bit integers or 32 bit floats (bits 32)."""
    c, h, w = image.data.shape
    if bits == 32:
        body = image.data.transpose(1, 2, 0).astype("<f4").tobytes()
    else:
        body = np.round(np.clip(image.data, 0, 1) * (2**bits - 1)).transpose(1, 2, 0).astype(f"<u{bits // 8}").tobytes()
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 2 if c == 3 else 1), (273, 4, 1, 0), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, 1, 3 if bits == 32 else 1)]
    start = 8 + 2 + 12 * len(entries) + 4
    packed = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<I", start if t == 273 else v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, n, v in entries)
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries)) + packed + struct.pack("<I", 0) + body


READERS = {"fits": lambda b: read_fits(b), "xisf": read_xisf, "tiff": lambda b: [read_tiff(b)], "ser": lambda b: [Image(f) for f in read_ser(b)[0]]}
WRITERS = {"fits": write_fits, "xisf": write_xisf, "tiff": write_tiff}
