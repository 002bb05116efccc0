"""Static range asymmetric numeral coding of token numbers, over many blocks at once.

A frequency table, shared by all blocks, gives every token a share of 2**SCALE.
A block holds BLOCK tokens (the last of a run may hold fewer) in LANES
interleaved states; a lane's state stays in [2**31, 2**63) and gives up 32 bits
when the next token would overflow it. Blocks depend on nothing but the table,
so arrays of blocks are coded together and any block can be decoded alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE, LANES, BLOCK = 20, 32, 4096
STEPS = BLOCK // LANES
LOW = np.uint64(1 << 31)
_SCALE, _WORD = np.uint64(SCALE), np.uint64(32)


@dataclass
class Table:
    """Shares and first slots by token, and the token of every slot."""

    share: np.ndarray
    first: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Shares in proportion to ``counts``; a token that occurs has one slot at least."""
        total, size = int(counts.sum()), 1 << SCALE
        share = np.where(counts > 0, np.maximum(1, counts * size // max(total, 1)), 0).astype(np.int64)
        # The rest is given to, or taken from, the largest shares in turn.
        rest = size - int(share.sum())
        order = np.lexsort((np.arange(len(share)), -share))
        order = order[share[order] > 0]
        if not len(order):
            share[0], rest, order = size, 0, order
        if rest > 0:
            share[order[0]] += rest
        while rest < 0:
            for token in order:
                taken = min(-rest, int(share[token]) // 2)
                share[token] -= taken
                rest += taken
                if not rest:
                    break
        first = np.cumsum(share) - share
        return cls(share.astype(np.uint64), first.astype(np.uint64), np.repeat(np.arange(len(share), dtype=np.uint32), share))

    def check(self) -> int:
        return zlib.crc32(self.share.astype("<u4").tobytes())


def encode(tokens: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States [block, lane], words of each block and all words, for a run of tokens."""
    blocks = -(-len(tokens) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[: len(tokens)] = tokens
    real = np.zeros(blocks * BLOCK, bool)
    real[: len(tokens)] = True
    # Step s of a block holds its tokens s*LANES to (s+1)*LANES; the coder runs backwards.
    grid, real = (x.reshape(blocks, STEPS, LANES) for x in (padded, real))
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((blocks, STEPS, LANES), np.uint32)
    given = np.zeros((blocks, STEPS, LANES), bool)
    top = (LOW >> _SCALE) << _WORD
    for step in range(STEPS - 1, -1, -1):
        share, first, live = table.share[grid[:, step]], table.first[grid[:, step]], real[:, step]
        share = np.where(live, share, np.uint64(1))
        over = live & (state >= top * share)
        words[:, step] = (state & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        given[:, step] = over
        state = np.where(over, state >> _WORD, state)
        ratio = state // share
        state = np.where(live, (ratio << _SCALE) + (state - ratio * share) + first, state)
    return state, given.sum(axis=(1, 2)), words[given]


def decode(n: int, state: np.ndarray, counts: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The ``n`` tokens of a run, from what ``encode`` returned; ValueError if the states do not run out."""
    blocks = len(state)
    out = np.zeros((blocks, STEPS, LANES), np.uint32)
    left = n - np.arange(blocks)[:, None] * BLOCK - np.arange(LANES)[None, :]
    at = np.cumsum(counts) - counts
    words = np.append(words, np.uint32(0))
    mask = np.uint64((1 << SCALE) - 1)
    state = state.copy()
    for step in range(STEPS):
        live = left > step * LANES
        if not live.any():
            break
        slot = state & mask
        token = table.slots[slot.astype(np.int64)]
        out[:, step] = token
        state = np.where(live, table.share[token] * (state >> _SCALE) + slot - table.first[token], state)
        need = live & (state < LOW)
        place = np.minimum(at[:, None] + np.cumsum(need, axis=1) - 1, len(words) - 1)
        state = np.where(need, (state << _WORD) | words[place].astype(np.uint64), state)
        at = at + need.sum(axis=1)
    if (state != LOW).any():
        raise ValueError("a lane does not end where its coder began: the words are damaged")
    return out.reshape(-1)[:n]
