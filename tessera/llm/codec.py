"""A context-mixing range coder for token ids, in independently reset blocks.

Blocks are coded side by side, one id of each at a time, so that every step is a few numpy
operations on as many lanes as there are blocks. No lane sees another: each block has its own
model, which starts anew, and its own checksum, and can be decoded alone.

The model of a block has three orders. Order 2 and order 1 each predict one id from a hashed table
of what followed the last two ids and the last id, with a confidence of 0 to 3. The more confident
one's id is coded as a hit or a miss; the chance of a hit is mixed in the logistic domain, by
weights that learn, from adaptive chances of both orders' confidences and of order 0. After a miss
the id's two bytes are coded by order-0 frequencies, renewed at fixed steps. All arithmetic is on
integers, so that encoder and decoder agree on every machine.

Blob: magic, ids per block, number of blocks, number of documents; for each block its number of
ids, of coded bytes, and the crc32 of its ids; for each document its number of ids; coded bytes.
Numbers are little-endian; ids are below 65536.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TSRC1\0"
BLOCK = 2048
HEAD = struct.Struct("<6sIII")
T1, T2 = 1024, 2048
BITS = 12
ONE = 1 << BITS
RATE = 4
#: Steps at which order-0 frequencies are renewed.
RENEW = frozenset([16, 32, 64, 128, 256, 512, 768, 1024, 1280, 1536, 1792])

_x = np.arange(ONE)
_p = (_x + 0.5) / ONE
#: Logistic tables in fixed point: stretch of a 12-bit chance, squash of a value of -2047 to 2047.
STRETCH = np.clip(np.rint(np.log(_p / (1 - _p)) * 256), -2047, 2047).astype(np.int32)
SQUASH = np.clip(np.rint(ONE / (1 + np.exp(-(np.arange(4096) - 2048) / 256))), 32, ONE - 32).astype(np.int32)
U8, U16, U24, U32 = (np.uint32(x) for x in (8, 16, 24, BITS))
TOP, LOW = np.uint32(1 << 24), np.uint32(1 << 16)


class Lanes:
    """The state of a carryless range coder for each block."""

    def __init__(self, n: int, data: np.ndarray | None = None, at: np.ndarray | None = None):
        self.low = np.zeros(n, np.uint32)
        self.range = np.full(n, 0xFFFFFFFF, np.uint32)
        self.data, self.at = data, at
        if data is not None:
            self.code = np.zeros(n, np.uint32)
            for _ in range(4):
                self.code = (self.code << U8) | self.data[self.at]
                self.at = self.at + 1
        else:
            self.out = np.zeros((n, 4 * BLOCK + 64), np.uint8)
            self.pos = np.zeros(n, np.int64)

    def take(self, who, start, size) -> None:
        """Narrow the lanes who to size parts of 4096 from start, and move bytes out or in."""
        low, wide = self.low[who], self.range[who] >> U32
        low = low + wide * start
        wide = wide * size
        self.low[who], self.range[who] = low, wide
        who = np.arange(len(self.low))[who] if isinstance(who, slice) else who
        while True:
            same = (low ^ (low + wide)) < TOP
            move = same | (wide < LOW)
            k = np.flatnonzero(move)
            if not len(k):
                return
            who, low, wide, same = who[k], low[k], wide[k], same[k]
            wide = np.where(same, wide, (np.uint32(0) - low) & np.uint32(0xFFFF))
            if self.data is None:
                at = self.pos[who]
                self.out[who, at] = low >> U24
                self.pos[who] = at + 1
            else:
                at = self.at[who]
                # broken data may ask for more than there is; the checksum tells
                self.code[who] = (self.code[who] << U8) | self.data[np.minimum(at, len(self.data) - 1)]
                self.at[who] = at + 1
            low, wide = low << U8, wide << U8
            self.low[who], self.range[who] = low, wide

    def value(self, who) -> np.ndarray:
        """Where in 4096 parts the code of the lanes who is."""
        return np.minimum((self.code[who] - self.low[who]) // (self.range[who] >> U32), np.uint32(ONE - 1))

    def finish(self) -> list[bytes]:
        n = np.arange(len(self.low))
        for shift in (24, 16, 8, 0):
            self.out[n, self.pos] = (self.low >> np.uint32(shift)) & np.uint32(0xFF)
            self.pos += 1
        return [row[:p].tobytes() for row, p in zip(self.out, self.pos.tolist())]


class Bytes:
    """Order-0 frequencies of one byte of the ids, for each lane."""

    def __init__(self, n: int, inverse: bool):
        self.count = np.ones((n, 256), np.int32)
        self.inverse = inverse
        self.renew()

    def renew(self) -> None:
        total = self.count.sum(1, keepdims=True)
        size = 1 + self.count * (ONE - 256) // total
        size[np.arange(len(size)), self.count.argmax(1)] += ONE - size.sum(1)
        self.size = size.astype(np.uint32)
        ends = np.cumsum(size, 1)
        self.start = (ends - size).astype(np.uint32)
        if self.inverse:
            flat = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(size)), size.ravel())
            self.symbol = flat.reshape(len(size), ONE)

    def code(self, lanes: Lanes, who: np.ndarray, byte: np.ndarray | None) -> np.ndarray:
        if byte is None:
            byte = self.symbol[who, lanes.value(who)].astype(np.int64)
        lanes.take(who, self.start[who, byte], self.size[who, byte])
        self.count[who, byte] += 24
        return byte


class Model:
    """The predictions of one block in each lane, and their coding in either direction."""

    def __init__(self, n: int, decode: bool):
        self.n = np.arange(n)
        self.t1 = np.zeros((n * T1), np.int32)
        self.t2 = np.zeros((n * T2), np.int32)
        self.q1 = np.full((n * 4), ONE // 2 << 4, np.int32)
        self.q2 = np.full((n * 4), ONE // 2 << 4, np.int32)
        self.q0 = np.full((n * 2), ONE // 8 << 4, np.int32)
        self.w = np.full((3, n), 26000, np.int32)
        self.high, self.lowb = Bytes(n, decode), Bytes(n, decode)
        self.last = np.zeros(n, np.int64)
        self.hash2 = np.zeros(n, np.int64)

    def shrink(self, n: int) -> None:
        """Go on with the first n lanes; the others have no more ids."""
        if n == len(self.n):
            return
        for name, per in (("t1", T1), ("t2", T2), ("q1", 4), ("q2", 4), ("q0", 2)):
            setattr(self, name, getattr(self, name)[: n * per])
        self.n, self.w, self.last, self.hash2 = self.n[:n], self.w[:, :n], self.last[:n], self.hash2[:n]

    def step(self, lanes: Lanes, ids: np.ndarray | None) -> np.ndarray:
        n = len(self.n)
        i1 = self.n * T1 + (self.last * 40503 >> 4 & T1 - 1)
        i2 = self.n * T2 + (self.hash2 & T2 - 1)
        e1, e2 = self.t1[i1], self.t2[i2]
        p1, c1, p2, c2 = e1 & 0xFFFF, e1 >> 16, e2 & 0xFFFF, e2 >> 16
        second = c2 >= c1
        guess = np.where(second, p2, p1)
        agree = p1 == p2
        k1, k2, k0 = self.n * 4 + c1, self.n * 4 + c2, self.n * 2 + agree
        q1, q2, q0 = self.q1[k1], self.q2[k2], self.q0[k0]
        x1 = STRETCH[q1 >> 4] * (agree | ~second)
        x2 = STRETCH[q2 >> 4] * (agree | second)
        x0 = STRETCH[q0 >> 4]
        w0, w1, w2 = self.w
        dot = (w1 * x1 + w2 * x2 + w0 * x0) >> 16
        chance = SQUASH[np.clip(dot, -2047, 2047) + 2048]
        if ids is None:
            value = lanes.value(slice(0, n)).astype(np.int32)
            hit = value < chance
        else:
            hit = ids == guess
        lanes.take(slice(0, n), np.where(hit, 0, chance).astype(np.uint32), np.where(hit, chance, ONE - chance).astype(np.uint32))
        aim = hit.astype(np.int32) << BITS
        off = (aim - chance) * 3
        w1 += (x1 * off + 0x8000) >> 16
        w2 += (x2 * off + 0x8000) >> 16
        w0 += (x0 * off + 0x8000) >> 16
        np.clip(self.w, -65536, 65536, out=self.w)
        miss = np.flatnonzero(~hit)
        if ids is None:
            ids = guess.astype(np.int64)
            if len(miss):
                high = self.high.code(lanes, miss, None)
                ids[miss] = high << 8 | self.lowb.code(lanes, miss, None)
        elif len(miss):
            self.high.code(lanes, miss, ids[miss] >> 8)
            self.lowb.code(lanes, miss, ids[miss] & 255)
        y1, y2 = p1 == ids, p2 == ids
        self.q1[k1] = q1 + (((y1.astype(np.int32) << 16) - q1) >> RATE)
        self.q2[k2] = q2 + (((y2.astype(np.int32) << 16) - q2) >> RATE)
        self.q0[k0] = q0 + (((aim << 4) - q0) >> RATE)
        self.t1[i1] = np.where(y1, p1 | np.minimum(c1 + 1, 3) << 16, np.where(c1 > 0, p1 | (c1 - 1) << 16, ids))
        self.t2[i2] = np.where(y2, p2 | np.minimum(c2 + 1, 3) << 16, np.where(c2 > 0, p2 | (c2 - 1) << 16, ids))
        self.hash2 = (self.last * 2971 ^ ids * 40503) >> 3
        self.last = ids
        return ids

    def renew(self) -> None:
        self.high.renew()
        self.lowb.renew()


def _blocks(total: int) -> np.ndarray:
    """Ids in each block: all are full but the last."""
    full, rest = divmod(total, BLOCK)
    return np.array([BLOCK] * full + [rest] * (rest > 0), np.int64)


def _run(sizes: np.ndarray, lanes: Lanes, ids: np.ndarray | None) -> np.ndarray:
    """Code all blocks; ids is (lanes, BLOCK) or None to decode."""
    n = len(sizes)
    model = Model(n, ids is None)
    out = np.zeros((BLOCK, n), np.int64)
    source = None if ids is None else np.ascontiguousarray(ids.T).astype(np.int64)
    for t in range(int(sizes.max(initial=0))):
        if t in RENEW:
            model.renew()
        live = n if t < sizes[-1] else n - 1
        model.shrink(live)
        out[t, :live] = model.step(lanes, None if source is None else source[t, :live])
    return out.T


def encode(documents: list[bytes]) -> bytes:
    """A blob of documents, each as little-endian unsigned 32-bit ids."""
    counts = np.array([len(d) // 4 for d in documents], "<u4")
    ids = np.frombuffer(b"".join(documents), "<u4")
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65536")
    sizes = _blocks(len(ids))
    coded: list[bytes] = []
    if len(sizes):
        grid = np.zeros((len(sizes), BLOCK), np.uint32)
        grid.ravel()[: len(ids)] = ids
        lanes = Lanes(len(sizes))
        _run(sizes, lanes, grid)
        coded = lanes.finish()
    sums = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(len(sizes))]
    table = np.array([sizes, [len(c) for c in coded], sums], "<u4").T.tobytes() if len(sizes) else b""
    return HEAD.pack(MAGIC, BLOCK, len(sizes), len(documents)) + table + counts.tobytes() + b"".join(coded)


def decode(blob: bytes) -> list[bytes]:
    """The documents of a blob; ValueError if it or a block's checksum is broken."""
    magic, block, n_blocks, n_docs = HEAD.unpack_from(blob)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a blob of this format")
    at = HEAD.size
    table = np.frombuffer(blob, "<u4", 3 * n_blocks, at).reshape(n_blocks, 3).astype(np.int64)
    counts = np.frombuffer(blob, "<u4", n_docs, at + 12 * n_blocks).astype(np.int64)
    at += 12 * n_blocks + 4 * n_docs
    if len(blob) != at + int(table[:, 1].sum()):
        raise ValueError("the blob is cut off")
    ids = b""
    if n_blocks:
        starts = np.cumsum(table[:, 1]) - table[:, 1]
        data = np.concatenate([np.frombuffer(blob, np.uint8, offset=at), np.zeros(64, np.uint8)])
        grid = _run(table[:, 0], Lanes(n_blocks, data, starts), None)
        ids = grid.astype("<u4").ravel()[: int(table[:, 0].sum())].tobytes()
        for i in range(n_blocks):
            if zlib.crc32(ids[4 * BLOCK * i : 4 * BLOCK * (i + 1)]) != table[i, 2]:
                raise ValueError(f"block {i} has another checksum")
    ends = np.cumsum(counts) * 4
    return [ids[b - 4 * c : b] for b, c in zip(ends.tolist(), counts.tolist())]
