"""Progressive JPEG in numpy: coefficient arrays filled by scans, inverse transform, chroma upsampling, RGB.

The decoder reads any Huffman-coded progressive frame of 8-bit samples (SOF2).
Each scan, whether a spectral band or a bit plane, adds to the coefficient
arrays. Where the tables give every symbol with its bits one width and the data
turn out to hold nothing else, a scan is read by one table lookup over all of
its bytes; any other scan is read symbol by symbol.

The encoder makes such streams: it stores bytes as coefficients, losslessly.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np

# ---- fixed values of the format
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
MOST_EOB_RUN = 32760  # under 2**15, and so that a run's correction bits end on a byte


def _basis() -> np.ndarray:
    """(64 coefficients in zigzag order) x (64 samples)."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


class Huffman:
    """A table of the file: lengths (16 counts) and symbols."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes = {}
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[symbols[k]] = (code, length)
                code, k = code + 1, k + 1
            code <<= 1
        look = np.zeros(1 << 16, np.int32)  # symbol * 32 + length, 0 if none
        for s, (c, n) in self.codes.items():
            look[c << (16 - n) : (c + 1) << (16 - n)] = s * 32 + n
        self.look = look.tolist()
        self._fixed: dict = {}

    def fixed(self, dc: bool):
        """(width in bytes, value of each code word) if each value symbol with its bits takes that width; else None.

        Values of AC words are never 0, so 0 marks any other word; DC has its own mark."""
        if dc not in self._fixed:
            own = {s: x for s, x in self.codes.items() if dc or 0 < s < 16}
            widths = {n + s for s, (_, n) in own.items()}
            out = None
            if len(widths) == 1 and (w := widths.pop()) in (8, 16):
                table = np.full(1 << w, np.int32(-(1 << 20)) if dc else 0, np.int32)
                for s, (c, n) in own.items():
                    bits = np.arange(1 << s)
                    table[(c << s) + bits] = np.where(bits >> max(s - 1, 0), bits, bits - (1 << s) + 1) if s else 0
                out = (w // 8, table)
            self._fixed[dc] = out
        return self._fixed[dc]


@lru_cache(maxsize=64)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


class Bits:
    """Bits of one restart interval, stuffing removed, seen through a window of eight bytes; a few bytes past the end it reads zeros."""

    def __init__(self, data: bytes):
        self.data, self.most = data + bytes(16), 8 * (len(data) + 4)
        self.at, self.low, self.window = 0, -64, 0

    def _look(self, k: int) -> int:
        """The next k bits, 32 at most."""
        if self.at - self.low + k > 64:
            if self.at > self.most:
                raise ValueError("the scan's data end too early")
            byte = self.at >> 3
            self.low, self.window = byte << 3, int.from_bytes(self.data[byte : byte + 8], "big")
        return (self.window >> (64 + self.low - self.at - k)) & ((1 << k) - 1)

    def take(self, k: int) -> int:
        if k == 0:
            return 0
        v = self._look(k)
        self.at += k
        return v

    def symbol(self, table: Huffman) -> int:
        x = table.look[self._look(16)]
        if not x:
            raise ValueError("a code that the table doesn't have")
        self.at += x & 31
        return x >> 5

    def signed(self, s: int) -> int:
        v = self.take(s)
        return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1


class Component:
    def __init__(self, ident, h, v, tq):
        self.id, self.h, self.v, self.tq = ident, h, v, tq


def _segments(data: bytes):
    """(marker, payload, entropy-coded data after it)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    i = 2
    while i < len(data):
        if data[i] != 0xFF:
            raise ValueError(f"no marker at byte {i}")
        m = data[i + 1]
        if m == 0xFF:
            i += 1
            continue
        if m == 0xD9:
            return
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body, i, coded = data[i + 4 : i + 2 + n], i + 2 + n, b""
        if m == 0xDA:
            end = i
            while True:
                end = data.find(b"\xff", end)
                if end < 0:
                    end = len(data)
                    break
                if end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                    end += 2
                    continue
                break
            coded, i = data[i:end], end
        yield m, body, coded
    raise ValueError("the file ends before its end marker")


class Image:
    """A decoded file: coefficient arrays by component, comments, and the samples made from them."""

    def __init__(self, data: bytes):
        self.comments, self.quant, self.tables, self.components = [], {}, {}, []
        self.restart = 0
        for marker, body, coded in _segments(data):
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, t = body[i] >> 4, body[i] & 15
                    n = 128 if wide else 64
                    self.quant[t] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else "u1").astype(np.float32)
                    i += 1 + n
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    self.tables[body[i] >> 4, body[i] & 15] = huffman(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                    i += 17 + n
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
                raise ValueError(f"frame type {marker:#x} isn't progressive Huffman")
            elif marker == 0xDA:
                self._scan(body, coded)
        if not self.components:
            raise ValueError("the file has no frame")

    def _frame(self, body: bytes):
        if body[0] != 8:
            raise ValueError("only 8-bit samples are read")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        if not self.height or not self.width:
            raise ValueError("the frame has no size")
        for k in range(body[5]):
            ident, hv, tq = body[6 + 3 * k : 9 + 3 * k]
            self.components.append(Component(ident, hv >> 4, hv & 15, tq))
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus_w, self.mcus_h = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            c.bw, c.bh = self.mcus_w * c.h, self.mcus_h * c.v  # as stored
            c.own_w = -(-(-(-self.width * c.h // self.hmax)) // 8)  # blocks that a scan of this component alone has
            c.own_h = -(-(-(-self.height * c.v // self.vmax)) // 8)
            c.coef = np.zeros((c.bh, c.bw, 64), np.int16)

    def _scan(self, body: bytes, coded: bytes):
        parts = []
        for k in range(body[0]):
            c = next(c for c in self.components if c.id == body[1 + 2 * k])
            parts.append((c, self.tables.get((0, body[2 + 2 * k] >> 4)), self.tables.get((1, body[2 + 2 * k] & 15))))
        ss, se, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        if ss and len(parts) != 1:
            raise ValueError("a scan of AC coefficients has one component")
        if len(parts) == 1 and not self.restart and self._fast(parts[0], ss, se, ah, al, coded):
            return
        chunks = re.split(rb"\xff[\xd0-\xd7]", coded) if self.restart else [coded]
        units = self._units([c for c, _, _ in parts])
        step = self.restart or len(units)
        for n, chunk in enumerate(chunks):
            self._interval(parts, units[n * step : (n + 1) * step], ss, se, ah, al, Bits(chunk.replace(b"\xff\x00", b"\xff")))

    def _units(self, comps):
        """For each MCU of the scan its blocks: (component index, row, column)."""
        if len(comps) == 1:
            return [[(0, y, x)] for y in range(comps[0].own_h) for x in range(comps[0].own_w)]
        return [[(k, my * c.v + y, mx * c.h + x) for k, c in enumerate(comps) for y in range(c.v) for x in range(c.h)] for my in range(self.mcus_h) for mx in range(self.mcus_w)]

    def _fast(self, part, ss, se, ah, al, coded) -> bool:
        c, dc, ac = part
        if (c.own_h, c.own_w) != (c.bh, c.bw):
            return False
        flat, n = c.coef.reshape(-1, 64), c.bh * c.bw
        raw = coded.replace(b"\xff\x00", b"\xff")
        if ss == 0 and ah:
            if len(raw) * 8 < n:
                return False
            flat[:, 0] |= np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(np.int16) << al
            return True
        if ss == 0:
            if dc is None or (fixed := dc.fixed(True)) is None or len(raw) != n * fixed[0]:
                return False
            v = fixed[1][np.frombuffer(raw, "u1" if fixed[0] == 1 else ">u2")]
            if v.min() == -(1 << 20):
                return False
            flat[:, 0] = np.cumsum(v) << al
            return True
        band = se - ss + 1
        if ah == 0:
            if ac is None or (fixed := ac.fixed(False)) is None or len(raw) != n * band * fixed[0]:
                return False
            v = fixed[1][np.frombuffer(raw, "u1" if fixed[0] == 1 else ">u2")]
            if not v.all():
                return False
            flat[:, ss : se + 1] = (v << al).reshape(n, band)
            return True
        # refinement: with no zero in the band, runs of ended bands hold one correction bit for each coefficient
        old = flat[:, ss : se + 1]
        if not old.all():
            return False
        at, done, got = 0, 0, []
        while done < n:
            head = Bits(raw[at : at + 8])
            s = head.symbol(ac)
            if s & 15 or s == 0xF0:
                return False
            run = (1 << (s >> 4)) + head.take(s >> 4)
            end = head.at + run * band
            size = -(-end // 8)
            if done + run > n or at + size > len(raw) or done + run < n and end % 8:
                return False
            got.append(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=end)[head.at :])
            at, done = at + size, done + run
        bits = (np.concatenate(got) if len(got) > 1 else got[0]).astype(np.int16).reshape(n, band) << al
        flat[:, ss : se + 1] = old + np.where(old > 0, bits, -bits)
        return True

    def _interval(self, parts, units, ss, se, ah, al, bits: Bits):
        last, eob = [0] * len(parts), 0
        one = 1 << al
        for unit in units:
            for k, y, x in unit:
                c, dc, ac = parts[k]
                block = c.coef[y, x]
                if ss == 0:
                    if ah:
                        block[0] |= bits.take(1) << al
                    else:
                        last[k] += bits.signed(bits.symbol(dc))
                        block[0] = last[k] << al
                    continue
                i = ss
                if ah == 0:
                    if eob:
                        eob -= 1
                        continue
                    while i <= se:
                        s = bits.symbol(ac)
                        run, size = s >> 4, s & 15
                        if size:
                            i += run
                            if i > se:
                                raise ValueError("a run passes the end of its band")
                            block[i] = bits.signed(size) << al
                            i += 1
                        elif run == 15:
                            i += 16
                        else:
                            eob = (1 << run) + bits.take(run) - 1
                            break
                    continue
                while i <= se and not eob:
                    s = bits.symbol(ac)
                    run, size = s >> 4, s & 15
                    new = 0
                    if size:
                        new = one if bits.take(1) else -one
                    elif run < 15:
                        eob = (1 << run) + bits.take(run)
                        break
                    while i <= se:
                        if block[i]:
                            if bits.take(1):
                                block[i] += one if block[i] > 0 else -one
                        elif run:
                            run -= 1
                        else:
                            if new:
                                block[i] = new
                            i += 1
                            break
                        i += 1
                if eob:
                    for j in range(i, se + 1):
                        if block[j] and bits.take(1):
                            block[j] += one if block[j] > 0 else -one
                    eob -= 1

    def plane(self, c: Component) -> np.ndarray:
        """Samples of a component, as floats around 0, at its own resolution."""
        x = (c.coef.reshape(-1, 64).astype(np.float32) * self.quant[c.tq]) @ BASIS
        return x.reshape(c.bh, c.bw, 8, 8).transpose(0, 2, 1, 3).reshape(c.bh * 8, c.bw * 8)

    def rgb(self) -> np.ndarray:
        """height x width x 3, uint8; chroma is repeated up to the full resolution, also where sampling factors don't divide."""
        planes = []
        for c in self.components:
            p = self.plane(c)
            for axis, most, own, size in ((0, self.vmax, c.v, self.height), (1, self.hmax, c.h, self.width)):
                if most % own:
                    p = np.take(p, np.arange(size) * own // most, axis=axis)
                elif most != own:
                    p = np.repeat(p, most // own, axis=axis)
            planes.append(p[: self.height, : self.width])
        out = np.empty((self.height, self.width, 3), np.uint8)
        y = planes[0] + np.float32(128.5)
        if len(planes) == 1:
            out[:] = np.clip(y, 0, 255)[..., None]
            return out
        cb, cr = planes[1:3]
        f = np.float32
        out[..., 0] = np.clip(y + f(1.402) * cr, 0, 255)
        out[..., 1] = np.clip(y - f(0.344136) * cb - f(0.714136) * cr, 0, 255)
        out[..., 2] = np.clip(y + f(1.772) * cb, 0, 255)
        return out


# ---- bytes as coefficients. A byte is a coefficient of magnitude 2 to 129, so that its upper bits, sent first, are never 0.

BYTE_TO_COEF = np.array([b - 129 if b < 128 else b - 126 for b in range(256)], np.int16)
COEF_TO_BYTE = np.zeros(512, np.uint8)
COEF_TO_BYTE[BYTE_TO_COEF.astype(int) + 256] = np.arange(256)
#: Lengths by symbol: with its value bits each word is 16 bits (DC), 8 bits (first AC scans), 16 bits (run ends of later AC scans).
_DC = {s: 16 - s for s in range(9)}
_AC_FIRST = {s: 8 - s for s in range(1, 8)} | {0: 8}
_AC_LATER = {r << 4: 16 - r for r in range(15)}


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)), bytes(order)


def _words(table: Huffman, values: np.ndarray) -> np.ndarray:
    """The code word with value bits of each value."""
    out = []
    for v in values.tolist():
        s = abs(v).bit_length()
        code, _ = table.codes[s]
        out.append((code << s) | (v if v > 0 else v + (1 << s) - 1 if s else 0))
    return np.array(out)


_HDC, _HAC, _HLATER = (huffman(*_table(x)) for x in (_DC, _AC_FIRST, _AC_LATER))
_FIRST_AC = _words(_HAC, np.sign(BYTE_TO_COEF) * (np.abs(BYTE_TO_COEF) >> 1)).astype(np.uint8)
_FIRST_DC = _words(_HDC, np.arange(-255, 256)).astype(">u2")
_LOW_AC = (np.abs(BYTE_TO_COEF) & 1).astype(np.uint8)
_LOW_DC = (BYTE_TO_COEF & 1).astype(np.uint8)
_HIGH_DC = (BYTE_TO_COEF >> 1).astype(np.int32)
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body


_HEAD = _segment(0xDB, b"\0" + b"\1" * 64) + b"".join(
    _segment(0xC4, bytes([kind]) + b"".join(_table(t))) for kind, t in ((0x00, _DC), (0x10, _AC_FIRST), (0x11, _AC_LATER))
)


def _later(blocks: np.ndarray) -> bytes:
    """Correction bits of a band without zeros, after the ends of band that announce them."""
    out = []
    for i in range(0, len(blocks), MOST_EOB_RUN):
        part = blocks[i : i + MOST_EOB_RUN]
        r = len(part).bit_length() - 1
        code, _ = _HLATER.codes[r << 4]
        bits = np.packbits(_LOW_AC[part].ravel())
        if tail := -part.size % 8:
            bits[-1] |= (1 << tail) - 1
        out += [((code << r) | (len(part) - (1 << r))).to_bytes(2, "big"), bits.tobytes()]
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def from_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 file that holds payload, of a positive multiple of 192 bytes, as coefficients; its size is in a comment."""
    m = -(-len(payload) // 384)
    w = math.isqrt(m - 1) + 1
    h = -(-m // w)
    blocks = np.frombuffer(payload.ljust(384 * w * h, b" "), np.uint8).reshape(-1, 64)
    n = w * h
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _HEAD]
    out.append(_segment(0xC2, b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
    parts = ((1, blocks[: 4 * n]), (2, blocks[4 * n : 5 * n]), (3, blocks[5 * n :]))

    def scan(c, table, ss, se, a, data):
        out.extend((b"\xff\xda\x00\x08\x01" + bytes((c, table, ss, se, a)), data))

    for c, x in parts:
        dc = _HIGH_DC[x[:, 0]]
        scan(c, 0x00, 0, 0, 0x01, _FIRST_DC[np.diff(dc, prepend=0) + 255].tobytes().replace(b"\xff", b"\xff\x00"))
    for ss, se in BANDS:
        for c, x in parts:
            scan(c, 0x00, ss, se, 0x01, _FIRST_AC[x[:, ss : se + 1]].tobytes())
    for c, x in parts:
        scan(c, 0x01, 1, 63, 0x10, _later(x[:, 1:]))
    for c, x in parts:
        bits = np.packbits(_LOW_DC[x[:, 0]])
        if tail := -len(x) % 8:
            bits[-1] |= (1 << tail) - 1
        scan(c, 0x00, 0, 0, 0x10, bits.tobytes().replace(b"\xff", b"\xff\x00"))
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The bytes that from_payload() stored."""
    n = next((int(c[8:]) for c in image.comments if c.startswith(b"payload ")), None)
    if n is None:
        raise ValueError("the file holds no payload")
    return b"".join(COEF_TO_BYTE[c.coef.ravel() + 256].tobytes() for c in image.components)[:n]
