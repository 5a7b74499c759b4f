"""Static range asymmetric numeral system over shared frequency tables, vectorised over interleaved lanes.

A block codes its symbols in ``LANES`` interleaved 64-bit states: symbol i belongs to lane i mod LANES.
States renormalise by 32-bit words, so a lane's state stays in [2^31, 2^63).  Every ``CHECKPOINT`` rows of
lanes the encoder notes the states and the word position, from which a decoder can start; segments between
checkpoints, like blocks, decode independently.  A CRC-32 of the symbols closes each segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_U = np.uint64
PRECISION, LANES, CHECKPOINT = 20, 1024, 128
MAGIC = b"TRB1"
_LOW = _U(1 << 31)


def frequencies(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Counts scaled to sum to 2^precision, at least 1 for every symbol of the alphabet."""
    size = 1 << precision
    if len(counts) > size // 2:
        raise ValueError("the alphabet is too large for the precision")
    total, room = max(1, int(counts.sum())), size - len(counts)
    out = 1 + (counts.astype(np.float64) * (room / total)).astype(np.int64)
    left = size - int(out.sum())
    while left:
        order = np.argsort(-counts, kind="stable")[: abs(left)]
        order = order[out[order] > 1] if left < 0 else order
        out[order] += int(np.sign(left))
        left = size - int(out.sum())
    return out


class Table:
    """Frequencies, their running sums and the slot-to-symbol map."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(_U)
        self.start = (np.cumsum(freq) - freq).astype(_U)
        self.precision = int(freq.sum()).bit_length() - 1
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, symbols: np.ndarray) -> bytes:
        """A self-contained block: header, checkpoints, 32-bit words."""
        n = len(symbols)
        rows = -(-n // LANES)
        grid = np.zeros(rows * LANES, np.uint32)
        grid[:n] = symbols
        freq, start = self.freq[grid].reshape(rows, LANES), self.start[grid].reshape(rows, LANES)
        state = np.full(LANES, _LOW, _U)
        words: list[np.ndarray] = []
        heads: list[tuple[int, np.ndarray]] = []
        held, shift, most = 0, _U(63 - self.precision), n - (rows - 1) * LANES
        for row in range(rows - 1, -1, -1):
            width = most if row == rows - 1 else LANES
            f, s, x = freq[row, :width], start[row, :width], state[:width]
            full = x >= f << shift
            if full.any():
                words.append((x[full] & _U(0xFFFFFFFF)).astype("<u4")[::-1])
                held += len(words[-1])
                x = np.where(full, x >> _U(32), x)
            whole = x // f
            state[:width] = (whole << _U(self.precision)) + (x - whole * f) + s
            if row % CHECKPOINT == 0:
                heads.append((held, state.copy()))
        flat = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
        out = [MAGIC, struct.pack("<III", n, len(heads), len(flat))]
        for k, (at, own) in enumerate(reversed(heads)):
            part = symbols[k * CHECKPOINT * LANES : (k + 1) * CHECKPOINT * LANES]
            out += [struct.pack("<II", len(flat) - at, zlib.crc32(part.astype("<u4").tobytes())), own.astype("<u8").tobytes()]
        return b"".join([*out, flat.tobytes()])

    def decode(self, block: bytes, segment: int | None = None) -> np.ndarray:
        """The block's symbols, or those of one segment; a damaged block raises ValueError."""
        if block[:4] != MAGIC:
            raise ValueError("not a block")
        n, segments, held = struct.unpack_from("<III", block, 4)
        size = 8 + 8 * LANES
        words = np.frombuffer(block, "<u4", held, 16 + segments * size)
        parts = [self._segment(block, words, n, k, 16 + k * size) for k in (range(segments) if segment is None else [segment])]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def _segment(self, block: bytes, words: np.ndarray, n: int, k: int, at: int) -> np.ndarray:
        place, crc = struct.unpack_from("<II", block, at)
        state = np.frombuffer(block, "<u8", LANES, at + 8).astype(_U)
        first = k * CHECKPOINT * LANES
        count = min(CHECKPOINT * LANES, n - first)
        out = np.zeros(-(-count // LANES) * LANES, np.uint32)
        mask, shift = _U((1 << self.precision) - 1), _U(self.precision)
        for row in range(0, count, LANES):
            width = min(LANES, count - row)
            x = state[:width]
            slot = x & mask
            symbol = self.symbol[slot]
            out[row : row + width] = symbol
            x = self.freq[symbol] * (x >> shift) + slot - self.start[symbol]
            low = x < _LOW
            used = int(np.count_nonzero(low))
            if used:
                x[low] = x[low] << _U(32) | words[place : place + used]
                place += used
            state[:width] = x
        out = out[:count]
        after = 16 + (k + 1) * (8 + 8 * LANES)
        if first + count < n:  # a segment ends where the next begins, the last one with the states at rest
            ends = struct.unpack_from("<I", block, after)[0], np.frombuffer(block, "<u8", LANES, after + 8)
        else:
            ends = len(words), np.full(LANES, _LOW)
        if place != ends[0] or (state != ends[1]).any():
            raise ValueError("a segment doesn't end at its checkpoint")
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a segment's checksum differs")
        return out
