"""Token ids in blocks, coded by a range coder that adaptive context mixing drives.

A block is coded by itself: its model starts anew, and a checksum of its ids stands in the header, so one bad or wanted block
needs no other. All blocks of a segment go forward in step, one id of each at a time, as lanes of numpy arrays; encoder and
decoder run the same model, in whole numbers only.

The model of a lane. The two ids before an id, and the one before it, each point to the id that followed them last, with a
confidence of 0 to 7 (orders 2 and 1); order 0 is the shares of ids in the whole segment, kept in its header. The three predictions
are mixed by weights that are held for every pair of confidences and move towards the order that was right after each id. So an
id is one symbol in 2**32 parts: the guess of order 2, else that of order 1, else order 0's share of what both leave.

Format of a segment, little-endian: `RLTC`, u32 ids, u32 ids a block, u32 blocks, u32 bytes of order 0's table; the table (zlib: u16
steps from id to id, then u16 shares less one); for each block u32 bytes and u32 crc32 of its ids as u32; u32 crc32 of all that; the
blocks' bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RLTC"
#: Ids are smaller than this, which stands for "no guess yet".
NO_ID = 0xFFFF
#: Guesses of a lane, for each order.
_TABLE = 512
_BOTTOM = np.uint64(1 << 48)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
_PARTS = 65536
_WHOLE = np.uint32(_PARTS)
#: Parts that every order keeps.
_LEAST = 24
_HEAD = 20


def _first_weights() -> np.ndarray:
    """Where the weights start: surer guesses get more, and a guess both orders share counts once."""
    k2, k1, agree = np.unravel_index(np.arange(128), (8, 8, 2))
    share = np.array([0, 16, 29, 38, 45, 51, 55, 58])  # in 64
    order2 = share[k2] * (_PARTS // 64)
    order1 = (_PARTS - order2) // 64 * share[k1] * 3 // 4 * (1 - agree)
    return np.stack((order2, order1), axis=1).clip(_LEAST).astype(np.int32)


_WEIGHTS = _first_weights()
#: Where the weights of orders 2 and 1 move after each symbol.
_GOAL = np.array([[_PARTS - 2 * _LEAST, _LEAST], [_LEAST, _PARTS - 2 * _LEAST], [_LEAST, _LEAST]], dtype=np.int32)
_GOALS = _GOAL.view(np.int64).ravel()


class _Model:
    """Guesses and mixing weights of all lanes. First axis: order 2 and order 1."""

    def __init__(self, lanes: int):
        self.guesses = np.full(2 * lanes * _TABLE, NO_ID << 3, dtype=np.int32)
        self.base = (np.arange(2 * lanes, dtype=np.int64) * _TABLE).reshape(2, lanes)
        #: Weights of order 2 and order 1 in 65,536 for each pair of confidences and whether the guesses agree, in each lane.
        #: Both stand in one number of 64 bits, as they are taken and put back together.
        self.weights = np.tile(_WEIGHTS, (lanes, 1)).view(np.int64).ravel()
        self.states = np.arange(lanes, dtype=np.int64) * 128
        self.one, self.two = (np.full(lanes, NO_ID, dtype=np.uint16) for _ in range(2))

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """Parts in 65,536 of the symbols 0 (order 2 is right) and 1 (order 1 is right); the rest is symbol 2."""
        one, two = self.one, self.two
        near, spot = one * 0x9E3B, np.empty(self.base.shape, dtype=np.uint16)  # modulo 65,536, as _TABLE divides that
        np.add(near + two * 0x85EB, two >> 5, out=spot[0])
        np.add(near, one >> 7, out=spot[1])
        spot &= _TABLE - 1
        self.place = self.base + spot
        self.held = e = self.guesses.take(self.place)
        self.ids, self.sure = e >> 3, e & 7
        state = (self.sure[0] << 4) + (self.sure[1] << 1)
        state += self.ids[0] == self.ids[1]
        self.state = self.states + state
        self.now = self.weights.take(self.state).view(np.int32).reshape(-1, 2)
        return self.now[:, 0].copy(), self.now[:, 1].copy()

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Which order's guess is right."""
        self.hit = self.ids == ids
        return self.hit

    def learn(self, ids: np.ndarray, symbol: np.ndarray) -> None:
        """After `hits` of the same ids. A hit makes a guess surer by one; a miss halves that, and at 0 the id takes the place."""
        change = _GOALS.take(symbol).view(np.int32).reshape(-1, 2)
        change -= self.now
        change >>= 4
        change += self.now
        self.weights[self.state] = change.view(np.int64).ravel()
        held, sure = self.held, self.sure
        hit = np.negative(self.hit.view(np.int8)).astype(np.int32)  # all bits or none
        down = sure >> 1
        now = down ^ ((down ^ np.minimum(sure + 1, 7)) & hit)
        gone = np.negative((now == 0).view(np.int8)).astype(np.int32)
        now |= held ^ sure
        self.guesses[self.place] = now ^ ((now ^ ((ids << 3) | 1)) & gone)
        self.one, self.two = ids.astype(np.uint16), self.one

    def narrowed(self, n: int) -> None:
        """Only the first n lanes go on."""
        for name in ("base", "states", "one", "two"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., :n]))


class _Writer:
    """The range coder of every lane: `low` of 64 bits, and the size of what is left from it. Digits have 16 bits; those of one
    place stand side by side for all lanes."""

    def __init__(self, lanes: int, length: int):
        self.low, self.range = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
        self.out = np.zeros((2 * length + 2, lanes), dtype=np.uint32)
        self.flat, self.at = self.out.ravel(), np.arange(lanes, dtype=np.int64)

    def put(self, start: np.ndarray, size: np.ndarray) -> None:
        """Parts [start, start + size) of 2**32, in the first lanes."""
        n, wide = len(start), self.out.shape[1]
        step = self.range[:n] >> _32
        low = self.low[:n] + step * start
        span = step * size
        carry = (low < self.low[:n]).nonzero()[0]
        if len(carry):  # left in the digit before, above its 16 bits, until the end
            self.flat[self.at[carry] - wide] += 1
        at, full = self.at[:n], span < _BOTTOM
        self.flat[at] = (low >> _48).astype(np.uint32)  # counts where a lane goes on to its next digit, else it is written over
        shift = full * _16
        low <<= shift
        span <<= shift
        at += full * np.int64(wide)
        full = (span < _BOTTOM).nonzero()[0]
        while len(full):
            digits, left = low.take(full), span.take(full) << _16
            self.flat[at[full]] = digits >> _48
            at[full] += wide
            low[full], span[full] = digits << _16, left
            full = full[left < _BOTTOM]
        self.low[:n], self.range[:n] = low, span

    def done(self) -> list[bytes]:
        self.flat[self.at] = (self.low >> _48) + ((self.low << _16) > 0)
        many = self.at // self.out.shape[1]
        digits = self.out[: int(many.max(initial=0)) + 1]
        carry = np.zeros(len(many), dtype=np.uint32)
        for row in digits[::-1]:
            row += carry
            carry = row >> 16
        digits = np.ascontiguousarray(digits.astype("<u2").T)  # the lower 16 bits
        return [digits[i, : n + 1].tobytes() for i, n in enumerate(many.tolist())]


class _Reader:
    """Reads what `_Writer` wrote; digits stand as there."""

    def __init__(self, blocks: list[bytes]):
        many = [len(b) // 2 for b in blocks]
        held = np.zeros((len(blocks), max(many, default=0) + 6), dtype=np.uint16)
        for i, b in enumerate(blocks):
            held[i, : many[i]] = np.frombuffer(b[: 2 * many[i]], dtype="<u2")
        held = np.ascontiguousarray(held.T)
        self.code = np.zeros(len(blocks), dtype=np.uint64)
        for i in range(4):
            self.code = (self.code << _16) | held[i]
        self.range = np.full(len(blocks), 2**64 - 1, dtype=np.uint64)
        self.flat, lanes = held.ravel(), np.arange(len(blocks), dtype=np.int64)
        self.wide, self.at, self.ends = len(blocks), lanes + 4 * len(blocks), lanes + (len(held) - 1) * len(blocks)

    def place(self, n: int) -> np.ndarray:
        """Which of the 2**32 parts the first n lanes stand at."""
        self.step = self.range[:n] >> _32
        return np.minimum(self.code[:n] // self.step, np.uint64(2**32 - 1)).astype(np.uint32)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(start)
        code = self.code[:n] - self.step * start
        span = self.step * size
        at, full = self.at[:n], span < _BOTTOM
        shift = full * _16
        code <<= shift
        code |= self.flat.take(at) * full
        span <<= shift
        at += full * np.int64(self.wide)
        np.minimum(at, self.ends[:n], out=at)
        full = (span < _BOTTOM).nonzero()[0]
        while len(full):
            spot, left = at.take(full), span.take(full) << _16
            code[full] = (code.take(full) << _16) | self.flat.take(spot)
            at[full], span[full] = np.minimum(spot + self.wide, self.ends.take(full)), left
            full = full[left < _BOTTOM]
        self.code[:n], self.range[:n] = code, span


class _Order0:
    """Parts in 65,536 of every id of a segment, from counts."""

    def __init__(self, ids: np.ndarray, share: np.ndarray):
        self.ids, self.share = ids, share
        edge = np.concatenate(([0], np.cumsum(share)))
        self.spans = np.zeros((NO_ID, 2), dtype=np.uint32)  # start and size, side by side
        self.spans[ids, 0], self.spans[ids, 1] = edge[:-1], share
        self.pairs = self.spans.view(np.uint64).ravel()
        self.id_at = np.repeat(ids, share).astype(np.int32)

    @classmethod
    def counted(cls, ids: np.ndarray) -> _Order0:
        many = np.bincount(ids, minlength=1)
        found = np.flatnonzero(many)
        share = 1 + (_PARTS - len(found)) * many[found] // max(len(ids), 1)
        if len(found):
            share[np.argmax(share)] += _PARTS - int(share.sum())
        return cls(found, share)

    def packed(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u2").tobytes() + (self.share - 1).astype("<u2").tobytes(), 1)

    @classmethod
    def unpacked(cls, held: bytes) -> _Order0:
        steps, share = np.frombuffer(zlib.decompress(held), dtype="<u2").reshape(2, -1).astype(np.int64)
        return cls(np.cumsum(steps), share + 1)


def _run(length: np.ndarray, ids: np.ndarray | None, order0: _Order0, writer: _Writer | None, reader: _Reader | None) -> np.ndarray:
    """All blocks in step, longest first: encodes `ids` (as many rows as the longest block has ids), or decodes them."""
    reads = ids is None
    ids = np.zeros((int(length.max(initial=0)), len(length)), dtype=np.int32) if reads else ids
    model, n = _Model(len(length)), len(length)
    for at, now in enumerate(np.searchsorted(-length, -np.arange(len(ids)), "left").tolist()):  # lanes with more than `at` ids
        if now < n:
            n = now
            model.narrowed(n)
        f0, f1 = model.guess()
        both = f0 + f1
        left = _PARTS - both
        if reads:
            place = reader.place(n)
            part = (place >> 16).view(np.int32)
            told = part >= both
            second = (part >= f0) > told
            rest = (place - np.minimum(both.view(np.uint32) << 16, place)) // left.view(np.uint32)
            x = np.where(told, order0.id_at.take(rest, mode="clip"), np.where(second, model.ids[1], model.ids[0]))
        else:
            x = ids[at, :n]
            hit = model.hits(x)
            second = hit[1] > hit[0]
            told = ~(hit[0] | hit[1])
        # A guess takes whole parts of 65,536; order 0 takes parts of what both leave. (A damaged block may guess what is no id.)
        span = order0.pairs.take(x, mode="clip").view(np.uint32).reshape(-1, 2)
        t, s = (np.negative(v.view(np.int8)).astype(np.int32) for v in (told, second))  # all bits or none
        begin = ((both & t) | (f0 & s)).view(np.uint32)
        share = f0 ^ ((f0 ^ f1) & s)
        share = (share ^ ((share ^ left) & t)).view(np.uint32)
        t = t.view(np.uint32)
        start = (begin << 16) + share * (span[:, 0] & t)
        size = share * (_WHOLE ^ ((span[:, 1] ^ _WHOLE) & t))
        if reads:
            reader.take(start, size)
            model.hits(x)
            ids[at, :n] = x
        else:
            writer.put(start, size)
        model.learn(x, (told.view(np.int8) << 1) + second.view(np.int8))
    return ids


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode(ids: np.ndarray, block: int = 2048) -> bytes:
    """A segment of `ids`, whole numbers from 0 to 65,534, in blocks of `block`."""
    if block < 1:
        raise ValueError("a block has one id at least")
    ids = np.asarray(ids, dtype=np.int32)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= NO_ID):
        raise ValueError("ids are from 0 to 65,534")
    n = -(-len(ids) // block)
    length = np.minimum(block, len(ids) - np.arange(n) * block)
    held = np.zeros((n, block if n > 1 else len(ids)), dtype=np.int32)
    held.ravel()[: len(ids)] = ids
    writer, order0 = _Writer(n, held.shape[1]), _Order0.counted(ids)
    _run(length, np.ascontiguousarray(held.T), order0, writer, None)
    coded, table = writer.done(), order0.packed()
    head = MAGIC + struct.pack("<4I", len(ids), block, n, len(table)) + table
    head += b"".join(struct.pack("<2I", len(c), _crc(ids[i * block : (i + 1) * block])) for i, c in enumerate(coded))
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *coded])


def decode(segment: bytes, blocks: list[int] | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks, in rising order. Raises ValueError where a checksum does not hold."""
    if segment[:4] != MAGIC or len(segment) < _HEAD + 4:
        raise ValueError("not a segment")
    many, block, n, table = struct.unpack_from("<4I", segment, 4)
    begin, end = _HEAD + table, _HEAD + table + 8 * n
    if len(segment) < end + 4 or zlib.crc32(segment[:end]) != struct.unpack_from("<I", segment, end)[0]:
        raise ValueError("the header is damaged")
    size, crc = np.frombuffer(segment[begin:end], dtype="<u4").reshape(n, 2).T.astype(np.int64)
    edge = end + 4 + np.concatenate(([0], np.cumsum(size)))
    wanted = list(range(n)) if blocks is None else sorted(blocks)
    length = np.array([min(block, many - i * block) for i in wanted], dtype=np.int64)
    held = _run(length, None, _Order0.unpacked(segment[_HEAD:begin]), None, _Reader([segment[edge[i] : edge[i + 1]] for i in wanted])).T
    out = []
    for row, i, k in zip(held, wanted, length.tolist(), strict=True):
        if _crc(row[:k]) != crc[i]:
            raise ValueError(f"block {i} is damaged")
        out.append(row[:k])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
