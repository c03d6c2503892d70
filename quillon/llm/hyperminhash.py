"""HyperMinHash sketches of word-shingle sets: leading-zero counts and mantissa bits of each bucket's least hash."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5  # of a shingle
BUCKET_BITS, MANTISSA = 10, 10
BUCKETS = 1 << BUCKET_BITS
EMPTY = 0xFFFF
COARSE = 256  # buckets that banding uses: each is four of the sketch's
ROWS = 6  # registers of a band
BANDS = COARSE // ROWS
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): of each text its distinct shingles' hashes, in ascending order.

    Words [^\\x20\\x09-\\x0D]+ after A-Z became a-z; fewer than five words are one shingle; none, no shingle.
    """
    words = [(x or b"").translate(_LOWER).split() for x in texts]
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*words)}
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((known[x] for w in words for x in w), np.uint64, int(n.sum()))
    h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum(n)
    starts = ends - n
    power = np.multiply.accumulate(np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64))
    long = n >= WORDS
    m = np.where(long, n - WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), m)
    at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + starts[doc]
    out = np.zeros(len(at), np.uint64)
    padded = np.r_[h, np.zeros(WORDS, np.uint64)]
    count = np.minimum(n, WORDS)[doc]
    for k in range(WORDS):
        out += np.where(k < count, padded[at + k] * power[k], np.uint64(0))
    out = mix(out + count.astype(np.uint64))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])] if len(out) else np.zeros(0, bool)
    return np.searchsorted(doc[new], np.arange(len(n) + 1)), out[new]


def set_keys(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(texts, 2): 128 bits that tell sets apart, whatever the order of their members."""
    sums = [np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(s)))] for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], 1).view(np.int64)


def registers(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) of 16 bits: the least hash of each bucket as leading zeros and mantissa; EMPTY without any."""
    n = len(offsets) - 1
    out = np.full((n, BUCKETS), EMPTY, np.uint16)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    slot = doc * BUCKETS + bucket
    first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
    rest = hashes[first] << np.uint64(BUCKET_BITS)
    # floats have the leading one's place as exponent; 53 bits of the rest are left, so that rounding can't carry
    high = rest >> np.uint64(11)
    zeros = np.where(high > 0, 53 - np.frexp(high.astype(np.float64))[1], 53)
    zeros = np.minimum(zeros, 62)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out.ravel()[slot[first]] = zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa
    return out


def coarse(regs: np.ndarray) -> np.ndarray:
    """The registers of four buckets as one of 16 bits: that of the first full bucket, with its place."""
    four = regs.reshape(len(regs), COARSE, BUCKETS // COARSE)
    place = (four != EMPTY).argmax(2)
    value = np.take_along_axis(four, place[:, :, None], 2)[:, :, 0].astype(np.int64)
    return np.where(value == EMPTY, EMPTY, (value * 4 + place) % EMPTY).astype(np.uint16)


def packed(regs: np.ndarray) -> list[bytes]:
    """Each sketch as bytes: a bit for each bucket that is full, and the full ones."""
    full = regs != EMPTY
    bits = np.packbits(full, 1)
    return [b.tobytes() + r[f].tobytes() for b, r, f in zip(bits, regs, full)]


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.full((len(rows), BUCKETS), EMPTY, np.uint16)
    for k, x in enumerate(rows):
        out[k, np.unpackbits(np.frombuffer(x, np.uint8, BUCKETS // 8)).astype(bool)] = np.frombuffer(x, np.uint16, -1, BUCKETS // 8)
    return out


def _probes(rounds: int = 48) -> np.ndarray:
    """For each round, which bucket an empty one borrows from."""
    x = mix(np.arange(rounds * COARSE, dtype=np.uint64) + np.uint64(77))
    return (x % np.uint64(COARSE)).astype(np.int64).reshape(rounds, COARSE)


_PROBES = _probes()


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers filled from full ones, each by its own fixed order of probing, so that sparse sets band alike."""
    out = regs.copy()
    own = np.nonzero((regs != EMPTY).any(1))[0]
    todo = own
    for probe in _PROBES:
        hole = out[todo] == EMPTY
        out[todo] = np.where(hole, regs[todo][:, probe], out[todo])
        todo = todo[(out[todo] == EMPTY).any(1)]
        if not len(todo):
            return out
    while len(todo):  # the next full one in turn
        out[todo] = np.where(out[todo] == EMPTY, np.roll(out[todo], -1, 1), out[todo])
        todo = todo[(out[todo] == EMPTY).any(1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS) of 64 bits; texts without shingles must be left out before."""
    rows = densified(coarse(regs))[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None] * np.ones((len(regs), 1), np.uint64)
    for k in range(ROWS):
        key = mix(key + rows[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of pairs of sketches (rows), corrected for chance collisions, and its standard error.

    Two different least hashes agree in a register if their leading zeros and mantissa do: about 2/3 of 2^-MANTISSA
    a bucket that both fill. The full buckets are a sample, without replacement, of the union.
    """
    both = ((a != EMPTY) & (b != EMPTY)).sum(-1)
    k = ((a != EMPTY) | (b != EMPTY)).sum(-1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    chance = both * (2 / 3) / (1 << MANTISSA)
    j = np.clip((same - chance) / np.maximum(k - chance, 1), 0, 1)
    union = (n_a + n_b) / (1 + j)
    rest = np.clip(1 - k / np.maximum(union, 1), 0.02, 1)
    most = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    return np.minimum(j, most), np.sqrt(np.maximum(j * (1 - j), 0.1) / np.maximum(k, 1) * rest) + 1 / np.maximum(union, 1)
