"""ChaCha20 in its three forms. All 64-byte blocks of a batch of byte strings are worked on at once, from any block counter on."""

from __future__ import annotations

import numpy as np

_SIGMA = np.frombuffer(b"expand 32-byte k", "<u4").astype(np.uint32)
BATCH = 1 << 20
#: Blocks that are worked on at once: 2 MiB of key stream.
_STEP = 1 << 15
#: Rows of a state as they meet in the second half of a double round.
_DIAGONAL = [np.array(r) for r in ([5, 6, 7, 4], [10, 11, 8, 9], [15, 12, 13, 14])]


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def _quarters(a, b, c, d):
    for first, second in ((16, 12), (8, 7)):
        a = a + b
        d = _turn(d ^ a, first)
        c = c + d
        b = _turn(b ^ c, second)
    return a, b, c, d


def _rounds(state: np.ndarray) -> np.ndarray:
    """Ten double rounds on (16, n) words."""
    x = state.copy()
    for _ in range(10):
        x[0:4], x[4:8], x[8:12], x[12:16] = _quarters(x[0:4], x[4:8], x[8:12], x[12:16])
        x[0:4], x[_DIAGONAL[0]], x[_DIAGONAL[1]], x[_DIAGONAL[2]] = _quarters(x[0:4], x[_DIAGONAL[0]], x[_DIAGONAL[1]], x[_DIAGONAL[2]])
    return x


def _words(raw: bytes) -> np.ndarray:
    """(words, 1)"""
    return np.frombuffer(raw, "<u4").astype(np.uint32)[:, None]


def _columns(parts: list[bytes]) -> np.ndarray:
    """(words, parts)"""
    return np.frombuffer(b"".join(parts), "<u4").astype(np.uint32).reshape(len(parts), -1).T


def _state(key: np.ndarray, rest: np.ndarray) -> np.ndarray:
    n = rest.shape[1]
    return np.concatenate([np.repeat(_SIGMA[:, None], n, axis=1), np.broadcast_to(key, (8, n)), rest])


def _xor(items: list[bytes], states: np.ndarray, wide: bool) -> list[bytes]:
    """Each item with the key stream from its column of ``states`` on; ``wide``: the counter has 64 bits, words 12 and 13, else 32."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    blocks = (sizes + 63) // 64
    ends = np.cumsum(blocks)
    total = int(ends[-1]) if len(items) else 0
    stream = np.empty(total * 64, np.uint8)
    for lo in range(0, total, _STEP):
        number = np.arange(lo, min(total, lo + _STEP))
        which = np.searchsorted(ends, number, "right")
        s = states[:, which]
        counter = s[12].astype(np.uint64) + (number - (ends - blocks)[which]).astype(np.uint64)
        if wide:
            counter += s[13].astype(np.uint64) << np.uint64(32)
            s[13] = (counter >> np.uint64(32)).astype(np.uint32)
        s[12] = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        stream[lo * 64 : (lo + len(number)) * 64] = np.ascontiguousarray((_rounds(s) + s).T.astype("<u4")).view(np.uint8).ravel()
    starts = ((ends - blocks) * 64).tolist()
    return [(np.frombuffer(d, np.uint8) ^ stream[a : a + len(d)]).tobytes() for d, a in zip(items, starts, strict=True)]


def chacha20_many(key: bytes, nonces: list[bytes], items: list[bytes], counter: int = 0) -> list[bytes]:
    """IETF form: 32-bit counter, a 12-byte nonce an item."""
    if not items:
        return []
    nonce = _columns(nonces)
    return _xor(items, _state(_words(key), np.concatenate([np.full((1, len(items)), counter, np.uint32), nonce])), False)


def xchacha20_many(key: bytes, nonces: list[bytes], items: list[bytes], counters: list[int] | None = None) -> list[bytes]:
    """A 24-byte nonce an item; counters count 64-byte blocks, so any block-aligned place can be worked on alone."""
    if not items:
        return []
    nonce = _columns(nonces)
    start = np.array(counters or [0] * len(items), np.uint64)
    split = np.stack([start & np.uint64(0xFFFFFFFF), start >> np.uint64(32)]).astype(np.uint32)
    return _xor(items, _state(_subkeys(key, nonce[:4]), np.concatenate([split, nonce[4:]])), True)


def _subkeys(key: bytes, nonce: np.ndarray) -> np.ndarray:
    x = _rounds(_state(_words(key), nonce))
    return np.concatenate([x[:4], x[12:]])


def hchacha20(key: bytes, nonce: bytes) -> bytes:
    return _subkeys(key, _words(nonce)).T.astype("<u4").tobytes()


def chacha20(key: bytes, nonce: bytes, data: bytes, counter: int = 0) -> bytes:
    return chacha20_many(key, [nonce], [data], counter)[0]


def xchacha20(key: bytes, nonce: bytes, data: bytes, counter: int = 0) -> bytes:
    return xchacha20_many(key, [nonce], [data], [counter])[0]


def batch_cipher_many(key: bytes, items: list[bytes]) -> list[bytes]:
    """Stored images: batches of 1 MiB, each from counter 0 with its number as nonce. Without authentication, and two images under one password
    share key stream: kept for reading what exists, not for new secrets."""
    parts = [(i, d[k : k + BATCH], k // BATCH) for i, d in enumerate(items) for k in range(0, len(d), BATCH)]
    out: list[list[bytes]] = [[] for _ in items]
    for (i, *_), done in zip(parts, chacha20_many(key, [n.to_bytes(8, "little") + bytes(4) for *_, n in parts], [d for _, d, _ in parts]), strict=True):
        out[i].append(done)
    return [b"".join(x) for x in out]


def batch_cipher(key: bytes, data: bytes) -> bytes:
    return batch_cipher_many(key, [data])[0]
