"""Words and hashes of whole Arrow batches of texts, as numpy arrays.

Everything works on the UTF-8 bytes of a batch at once. A hash of a span is a
polynomial over random byte values modulo 2^64 (prefix sums give any span in two
look-ups), passed through a 64-bit mixer together with the span's length.
"""

import numpy as np
import pyarrow as pa

#: Texts of so many bytes are worked on at once; a longer text stands alone.
BLOCK_BYTES = 2 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}

#: White space of the word rules: blank and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x):
    """A 64-bit finaliser (each step is a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n, base=_R):
    """base^0 .. base^n modulo 2^64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[int(base)] = np.cumprod(out, dtype=np.uint64)
    return have


def utf8(column):
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(offsets, limit=BLOCK_BYTES):
    """Row ranges (i, j) of about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def prefix_hash(data):
    """P with P[e] - P[s] the polynomial of bytes s..e-1, still times base^s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix, start, end):
    inv = powers(len(prefix), _R_INV)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data, offsets, space=SPACE):
    """(start, end, doc) of every word of a block; offsets are relative to data."""
    is_word = ~space[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:-1])
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    keep = is_word[cut[:-1]] if len(cut) > 1 else np.zeros(0, bool)
    start, end = cut[:-1][keep], cut[1:][keep]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def block_words(raw, off, i, j, lower=True):
    """Word hashes and their row numbers within rows i..j-1, and words per row."""
    data = raw[off[i]: off[j]]
    if lower:
        data = LOWER[data]
    rel = (off[i: j + 1] - off[i]).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(j - i, np.int64)
    start, end, doc = words(data, rel)
    return span_hash(prefix_hash(data), start, end), doc, np.bincount(doc, minlength=j - i)


def shingle_sets(raw, off, i, j, k=5):
    """(shingles, doc): the distinct k-word shingle hashes of each row, sorted per row.

    A row with fewer than k words has its whole word sequence as the one shingle.
    """
    h, doc, per = block_words(raw, off, i, j)
    first = np.concatenate(([0], np.cumsum(per)))
    A = np.uint64(0xC2B2AE3D27D4EB4F)
    parts, owners = [], []
    for size in range(1, k + 1):
        if size < k:
            at = first[:-1][per == size]
            own = np.flatnonzero(per == size)
        else:
            ok = np.arange(len(h)) + k <= first[doc + 1] if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(ok)
            own = doc[at]
        if len(at):
            s = np.full(len(at), size, np.uint64)
            for step in range(size):
                s = s * A + h[at + step]
            parts.append(mix(s))
            owners.append(own)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, own = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    s, own = s[order], own[order]
    cut = np.searchsorted(own, np.arange(j - i + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a > 1:
            s[a:b].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[new], own[new]
