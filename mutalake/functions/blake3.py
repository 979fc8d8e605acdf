"""BLAKE3 hashing in plain Python, after the published specification."""

from __future__ import annotations

import numpy as np

# Fixed values of the specification: initial words, message order, domain flags.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_CHUNK_START, _CHUNK_END, _PARENT, _ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF
_MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _compress_many(chain: list, words: list, size: np.ndarray, flags: np.ndarray) -> list[np.ndarray]:
    """The first half of _compress for columns of unsigned 32-bit words, a row a message, in the first chunk."""
    v = [*chain, *(np.full(len(size), x, dtype=np.uint32) for x in _IV[:4]), np.zeros_like(size), np.zeros_like(size), size, flags]
    turned = lambda x, n: x >> np.uint32(n) | x << np.uint32(32 - n)
    m = words
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = turned(v[d] ^ v[a], r1)
                v[c] = v[c] + v[d]
                v[b] = turned(v[b] ^ v[c], r2)
        m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _compress(chain: tuple, words: list[int], counter: int, size: int, flags: int) -> list[int]:
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, size, flags]
    m = words
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_MIXES):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & _MASK
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << 32 - r1) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << 32 - r2) & _MASK
        if turn < 6:
            m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)] + [v[i + 8] ^ chain[i] for i in range(8)]


def _words(block: bytes) -> list[int]:
    block = block.ljust(64, b"\0")
    return [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]


def _chunk(data: bytes, counter: int) -> tuple:
    """The arguments of the chunk's last compression, so that a root can be flagged."""
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    chain: tuple = _IV
    for i, block in enumerate(blocks):
        flags = (_CHUNK_START if i == 0 else 0) | (_CHUNK_END if i == len(blocks) - 1 else 0)
        last = (chain, _words(block), counter, len(block), flags)
        if i < len(blocks) - 1:
            chain = tuple(_compress(*last)[:8])
    return last


def _tree(data: bytes, first: int) -> tuple:
    if len(data) <= 1024:
        return _chunk(data, first)
    left = 1024
    while left * 2 < len(data):
        left *= 2
    halves = (_tree(data[:left], first), _tree(data[left:], first + left // 1024))
    return (_IV, [w for half in halves for w in _compress(*half)[:8]], 0, 64, _PARENT)


def blake3(data: bytes) -> bytes:
    """The 32-byte digest."""
    chain, words, counter, size, flags = _tree(data, 0)
    return b"".join(w.to_bytes(4, "little") for w in _compress(chain, words, counter, size, flags | _ROOT)[:8])


def blake3_many(messages: list[bytes]) -> list[bytes]:
    """The digests of messages; those of one chunk are hashed together, by their number of blocks."""
    out: list[bytes] = [b""] * len(messages)
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(messages):
        if len(x) > 1024:
            out[i] = blake3(x)
        else:
            groups.setdefault(max(1, -(-len(x) // 64)), []).append(i)
    for n, rows in groups.items():
        padded = np.frombuffer(b"".join(messages[i].ljust(64 * n, b"\0") for i in rows), dtype="<u4").reshape(len(rows), n, 16)
        lengths = np.array([len(messages[i]) for i in rows], dtype=np.uint32)
        chain = [np.full(len(rows), x, dtype=np.uint32) for x in _IV]
        for k in range(n):
            flags = (_CHUNK_START if k == 0 else 0) | (_CHUNK_END | _ROOT if k == n - 1 else 0)
            size = lengths - np.uint32(64 * k) if k == n - 1 else np.full(len(rows), 64, dtype=np.uint32)
            chain = _compress_many(chain, [np.ascontiguousarray(padded[:, k, j]) for j in range(16)], size, np.full(len(rows), flags, dtype=np.uint32))
        digests = np.stack(chain, 1).astype("<u4").tobytes()
        for at, i in enumerate(rows):
            out[i] = digests[32 * at : 32 * at + 32]
    return out
