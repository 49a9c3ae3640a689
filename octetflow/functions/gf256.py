"""Arithmetic of GF(256) with the polynomial 0x11D, as tables, and secret sharing on it."""

from __future__ import annotations

import numpy as np

# Fixed value.
POLYNOMIAL = 0x11D


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a & 0x100:
            a ^= POLYNOMIAL
        b >>= 1
    return out


MUL = np.array([[_product(a, b) for b in range(256)] for a in range(256)], np.uint8)
INV = np.array([0, *(int(np.flatnonzero(MUL[a] == 1)[0]) for a in range(1, 256))], np.uint8)


def powers(ids: list[int], k: int) -> np.ndarray:
    """Vandermonde matrix: row r holds ids[r]**0 .. ids[r]**(k-1)."""
    out = np.ones((len(ids), k), np.uint8)
    for c in range(1, k):
        out[:, c] = MUL[out[:, c - 1], np.array(ids, np.uint8)]
    return out


def product(matrix: np.ndarray, data: np.ndarray) -> np.ndarray:
    """matrix (n, k) times data (k, m)."""
    out = np.zeros((len(matrix), data.shape[1]), np.uint8)
    for r, row in enumerate(matrix):
        for c, v in enumerate(row):
            if v:
                out[r] ^= MUL[v][data[c]]
    return out


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan; a ValueError if singular."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        at = np.flatnonzero(work[c:, c])
        if not len(at):
            raise ValueError("the matrix is singular")
        work[[c, c + at[0]]] = work[[c + at[0], c]]
        work[c] = MUL[INV[work[c, c]]][work[c]]
        for r in range(n):
            if r != c and work[r, c]:
                work[r] ^= MUL[work[r, c]][work[c]]
    return work[:, n:]


def split_secret(secret: bytes, n: int, k: int, coefficients: bytes) -> list[bytes]:
    """Shamir shares for x = 1 .. n. ``coefficients``: (k-1) bytes for each byte of the secret, in its order; given, not drawn, so that a retry makes the same shares."""
    if len(coefficients) != len(secret) * (k - 1):
        raise ValueError("k - 1 coefficients are needed for each byte")
    c = np.concatenate([np.frombuffer(secret, np.uint8)[None, :], np.frombuffer(coefficients, np.uint8).reshape(len(secret), k - 1).T])
    return [x.tobytes() for x in product(powers(list(range(1, n + 1)), k), c)]


def join_secret(shares: list[bytes], ids: list[int]) -> bytes:
    """Lagrange interpolation at 0."""
    if len(set(ids)) != len(ids):
        raise ValueError("share ids repeat")
    out = np.zeros(len(shares[0]), np.uint8)
    for i, share in zip(ids, shares, strict=True):
        up, down = 1, 1
        for j in ids:
            if j != i:
                up, down = MUL[up, j], MUL[down, i ^ j]
        out ^= MUL[MUL[up, INV[down]]][np.frombuffer(share, np.uint8)]
    return out.tobytes()
