"""Token counts of fields or sections by character spans.

A document is encoded once, whole. A byte-level token stands for a known number of
bytes, so the running sum of its pieces' lengths gives every token's span. Sections
are spans of the same text; tokens and sections are joined by interval in one sorted
look-up per document. A token over a border goes to the section that holds most of
its bytes, the earlier one on ties; bytes in no section count for ``None`` (-1).
"""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_encoder = {}


def ranks_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path):
    """(encoding, bytes of each id), kept per worker."""
    if path not in _encoder:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            size[i] = len(piece)
        _encoder[path] = (tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size)
    return _encoder[path]


def lines(text):
    """(start, end) in bytes of the \\n-split lines; the line feed belongs to the line before."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    cut = np.concatenate(([0], at, [len(text)]))
    return cut[:-1], cut[1:]


def allocate(start, end, s_start, s_end):
    """Section number of each token, -1 for none; sections are ordered and do not overlap."""
    n = len(s_start)
    if not n or not len(start):
        return np.full(len(start), -1)
    first = np.searchsorted(s_end, start, side="right")
    best, size = np.full(len(start), -1), np.zeros(len(start), np.int64)
    step = 0
    live = np.arange(len(start))
    while len(live):
        k = first[live] + step
        ok = (k < n)
        live, k = live[ok], k[ok]
        ok = s_start[k] < end[live]
        live, k = live[ok], k[ok]
        got = np.minimum(end[live], s_end[k]) - np.maximum(start[live], s_start[k])
        better = got > size[live]
        best[live[better]], size[live[better]] = k[better], got[better]
        step += 1
    return best


def _counts(path, has_sections):
    def run(batches):
        enc, size = encoder(path)
        for batch in batches:
            out, n = [[], [], [], [], []], 0
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if has_sections else None
            for r, text in enumerate(texts):
                raw = (text or "").encode()
                if raw:
                    tok = enc.encode_to_numpy(text, disallowed_special=())
                    end = np.cumsum(size[tok])
                    start = end - size[tok]
                    if has_sections:
                        # code points to bytes
                        to = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
                        spans = sorted((x["start"], x["end"]) for x in given[r] or [] if x is not None and None not in (x["start"], x["end"]))
                        last = len(to) - 1
                        s = np.array([to[min(max(a, 0), last)] for a, _ in spans], np.int64)
                        e = np.array([to[min(max(b, 0), last)] for _, b in spans], np.int64)
                    else:
                        s, e = lines(raw)
                    own = allocate(start, end, s, e)
                    count = np.bincount(own + 1, minlength=len(s) + 1)
                    k = np.arange(-1, len(s))
                    if not count[0]:
                        k, count = k[1:], count[1:]
                        a, b = s, e
                    else:
                        a, b = np.append(0, s), np.append(0, e)
                    for x, y in zip(out, (np.full(len(k), r), k, count, b - a, np.full(len(k), len(tok))), strict=True):
                        x.append(y)
                    n += len(k)
                if out[0] and (n > 100_000 or r == len(texts) - 1):
                    c = [np.concatenate(x) for x in out]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(c[0])), pa.array(c[1].astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in c[2:]]],
                                                     ["doc_id", "section", "n_tokens", "n_bytes", "doc_tokens"])
                    out, n = [[], [], [], [], []], 0
    return run


def section_tokens(docs, id_col="doc_id", text_col="text", sections=None, path=None):
    """``doc_id, section, n_tokens, n_bytes, doc_tokens``: one row per section of every text.

    ``sections``: a column of array<struct<start, end>> (code points, end exclusive,
    not overlapping), numbered from 0 by place; by default the lines. A section may
    have no tokens. Null and empty texts have no rows. The tokens of a document's
    rows add up to ``doc_tokens``. Rows that repeat an id are counted each for itself.
    """
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if sections is not None:
        cols.append((F.col(sections) if isinstance(sections, str) else sections).alias("sections"))
    return docs.select(*cols).mapInArrow(_counts(path or ranks_path(), sections is not None),
                                         f"doc_id {dict(docs.dtypes)[id_col]}, section int, n_tokens long, n_bytes long, doc_tokens long")
