"""Removal of repeated 100-byte strings by hash-compared suffix sorting.

Every 100-byte string holds one anchor: the 32-byte gram with the smallest hash
among those inside it (leftmost on ties). Equal strings have their anchor at the
same offset, so only occurrences of one gram need to meet.

1. Each run of starts with one anchor is one row: gram hash, hash of the whole
   context that its strings cover, place. Contexts equal within a batch are settled
   there; the rest are dealt by gram. Of equal contexts all but the first go.
2. A context that is the first of its kind, but shares its gram with others, may
   share some strings with them (edges of passages, edited copies). Such contexts
   fetch their bytes, and the suffixes that start in them are sorted per gram:
   mergesort, in which two suffixes are compared by the longest common extension,
   found by binary search over prefix polynomial hashes; equal neighbours are
   verified byte by byte. All but the first of a run of equal 100-byte prefixes go.
   A gram with very many contexts is sorted in parts, whose first strings are then
   compared by a window over the string's hashes.
3. Removed stretches are united per document and cut out of its bytes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import write_once

from . import text_arrays as T
from .work import bitmap, folder, in_bitmap

#: Anchor grams, and contexts of one gram that are sorted together.
GRAM, PART = 32, 2000
_MASK = np.uint64((1 << 28) - 1)


def _anchors(width):
    """Rows (g, c, doc_id, lo, n, a): starts lo .. lo+n-1 with their anchor at lo+a.

    Rows with a < 0 are already known to be repeats.
    """
    reach = width - GRAM + 1

    def run(batches):
        for batch in batches:
            raw, off = T.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for i, j in T.blocks(off):
                data = raw[off[i]: off[j]]
                rel = (off[i: j + 1] - off[i]).astype(np.int64)
                if len(data) < width:
                    continue
                pre = T.prefix_hash(data)
                at = np.arange(len(data) - GRAM + 1)
                h = T.span_hash(pre, at, at + GRAM)
                key = (h & ~_MASK) | at.astype(np.uint64)
                m, done = key, 1
                while done < reach:
                    step = min(done, reach - done)
                    m = np.minimum(m[: len(m) - step], m[step:])
                    done += step
                a = (m & _MASK).astype(np.int64)
                doc = np.searchsorted(rel, np.arange(len(a)), side="right") - 1
                ok = np.arange(len(a)) + width <= rel[doc + 1]
                p = np.flatnonzero(ok)
                if not len(p):
                    continue
                a, doc = a[p], doc[p]
                new = np.ones(len(p), bool)
                new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
                f = np.flatnonzero(new)
                n = np.diff(np.append(f, len(p)))
                lo, an, d = p[f], a[f], doc[f]
                c = T.mix(T.span_hash(pre, lo, lo + n - 1 + width) + (an - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                out.append((h[an], c, ids[i:j][d], lo - rel[d], n, an - lo))
            if not out:
                continue
            g, c, d, lo, n, an = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((lo, d, c, g))
            g, c, d, lo, n, an = (x[order] for x in (g, c, d, lo, n, an))
            again = np.zeros(len(g), bool)
            again[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            an[again] = -1
            # a repeat settled here needs no meeting: dealt by its document
            g[again] = T.mix(d[again].astype(np.uint64))
            for k in range(0, len(g), 100_000):
                s = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[s].view(np.int64)), pa.array(c[s].view(np.int64)), pa.array(d[s].astype(np.int64)),
                     pa.array(lo[s].astype(np.int32)), pa.array(n[s].astype(np.int16)), pa.array(an[s].astype(np.int16))],
                    ["g", "c", "doc_id", "lo", "n", "a"])
    return run


def _contexts(width):
    """The bytes of listed contexts of each document."""
    def run(batches):
        for batch in batches:
            raw, off = T.utf8(batch.column(1))
            for r, (doc, want) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = raw[off[r]: off[r + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["g"] for x in want], pa.int64()), pa.array([x["part"] for x in want], pa.int32()),
                     pa.array([x["hot"] for x in want], pa.bool_()), pa.array([doc] * len(want), pa.int64()),
                     pa.array([x["lo"] for x in want], pa.int32()), pa.array([x["a"] for x in want], pa.int16()),
                     pa.array([text[x["lo"]: x["lo"] + x["n"] - 1 + width] for x in want], pa.binary())],
                    ["g", "part", "hot", "doc_id", "lo", "a", "ctx"])
    return run


class Suffixes:
    """Comparison of suffixes of one byte array up to ``width`` bytes."""

    def __init__(self, data, width):
        self.data, self.width, self.pre = data, width, T.prefix_hash(data)
        self.steps = [1 << b for b in range(width.bit_length() - 1, -1, -1)]
        self.inv = T.powers(len(self.pre), T._R_INV)

    def common(self, x, y):
        """Longest common extension of suffixes x and y, at most width."""
        got = np.zeros(len(x), np.int64)
        for step in self.steps:
            fits = got + step <= self.width
            s, t = x + got, y + got
            e, f = np.minimum(s + step, len(self.data)), np.minimum(t + step, len(self.data))
            same = (self.pre[e] - self.pre[s]) * self.inv[s] == (self.pre[f] - self.pre[t]) * self.inv[t]
            got += np.where(fits & same, step, 0)
        return got

    def less(self, x, y):
        """Suffix x before suffix y; equal prefixes count as not before."""
        n = self.common(x, y)
        end = len(self.data) - 1
        return (n < self.width) & (self.data[np.minimum(x + n, end)] < self.data[np.minimum(y + n, end)])

    def same(self, x, y):
        """Equal prefixes: by hash, then verified byte by byte."""
        equal = self.common(x, y) >= self.width
        for i in range(0, len(x), 20_000):
            at = np.flatnonzero(equal[i:i + 20_000]) + i
            span = np.arange(self.width)
            equal[at] = (self.data[x[at, None] + span] == self.data[y[at, None] + span]).all(1)
        return equal

    def sort(self, start, group):
        """Order of suffixes within groups (``group`` ascending): bottom-up mergesort.

        All merges of one level run together: an element's place is its own rank plus
        the number of elements before it in the sibling run, by binary search; stable.
        """
        order = np.arange(len(start))
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(group)))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        rank = np.arange(len(group)) - begin
        width, largest = 1, int(size.max()) if len(size) else 0
        while width < largest:
            live = np.flatnonzero(count > width)
            b, r, n = begin[live], rank[live], count[live]
            run = r // width
            left = run % 2 == 0
            sib = np.where(left, run + 1, run - 1) * width
            lo = np.minimum(sib, n)
            hi = np.minimum(sib + width, n)
            base, own = lo.copy(), start[order[live]]
            left_at = np.flatnonzero(lo < hi)
            while len(left_at):
                k = left_at
                mid = (lo[k] + hi[k]) // 2
                other = start[order[b[k] + mid]]
                # the left run's element goes first on ties
                after = np.where(left[k], self.less(other, own[k]), ~self.less(own[k], other))
                lo[k] = np.where(after, mid + 1, lo[k])
                hi[k] = np.where(after, hi[k], mid)
                left_at = k[lo[k] < hi[k]]
            to = b + (run - run % 2) * width + (r - run * width) + (lo - base)
            new = order.copy()
            new[to] = order[live]
            order = new
            width *= 2
        return order


def _settle(rows, width):
    """Repeats among the contexts of some grams: (doc, start) of each, and the first of each run for hot grams."""
    g, part, hot, doc, lo, a, ctx = rows
    data = np.frombuffer(b"".join(ctx), np.uint8)
    n_bytes = np.array([len(x) for x in ctx])
    base = np.concatenate(([0], np.cumsum(n_bytes)))[:-1]
    n = n_bytes - width + 1
    own = np.repeat(np.arange(len(n)), n)
    delta = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base[own] + delta
    off, gg, pp = a[own] - delta, g[own], part[own]
    order = np.lexsort((lo[own] + delta, doc[own], off, pp, gg))
    own, delta, start, off, gg, pp = (x[order] for x in (own, delta, start, off, gg, pp))
    group = np.cumsum(np.append(0, (gg[1:] != gg[:-1]) | (off[1:] != off[:-1]) | (pp[1:] != pp[:-1])))
    s = Suffixes(data, width)
    order = s.sort(start, group)
    own, delta, start, group = own[order], delta[order], start[order], group[order]
    again = np.zeros(len(own), bool)
    again[1:] = group[1:] == group[:-1]
    k = np.flatnonzero(again)
    again[k] = s.same(start[k], start[k - 1])
    # merges are stable, so the first of a run is the smallest (doc, start)
    place = lo[own] + delta
    top = ~again & hot[own]
    h = T.span_hash(s.pre, start[top], start[top] + width)
    h2 = T.span_hash(s.pre, start[top] + width // 3, start[top] + width)
    return doc[own[again]], place[again], doc[own[top]], place[top], h, h2


def _sorted_repeats(width):
    """Streams contexts ordered by (g, part); groups stay whole."""
    def emit(rows):
        d, p, fd, fp, h, h2 = _settle(rows, width)
        order = np.lexsort((p, d))
        d, p = d[order], p[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + 1)
        f = np.flatnonzero(new)
        last = np.append(f[1:], len(d)) - 1 if len(f) else f
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((d[f], fd)), pa.int64()), pa.array(np.concatenate((p[f], fp)).astype(np.int32)),
             pa.array(np.concatenate((p[last] + width, fp + width)).astype(np.int32)),
             pa.array(np.concatenate((np.zeros(len(f), np.int64), h.view(np.int64)))),
             pa.array(np.concatenate((np.zeros(len(f), np.int64), h2.view(np.int64)))),
             pa.array(np.concatenate((np.zeros(len(f), bool), np.ones(len(fd), bool))))],
            ["doc_id", "lo", "hi", "h1", "h2", "ask"])

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)] + [np.array(batch.column(6).to_pylist(), object)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            while len(held[0]) > 4000:
                # whole groups only: cut before the last group seen
                cut = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                cut = cut[cut >= min(2000, cut[-1])] if len(cut) else cut
                if not len(cut):
                    break
                yield from emit([x[: cut[0]] for x in held])
                held = [x[cut[0]:] for x in held]
        if held is not None and len(held[0]):
            yield from emit(held)
    return run


def _cut(batches):
    for batch in batches:
        raw, off = T.utf8(batch.column(1))
        out = []
        for r, spans in enumerate(batch.column(2).to_pylist()):
            text = raw[off[r]: off[r + 1]]
            removed = runs = 0
            if spans:
                s = np.array([(x["lo"], x["hi"]) for x in spans], np.int64)
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, s[:, 0], 1)
                np.add.at(depth, s[:, 1], -1)
                gone = np.cumsum(depth)[:-1] > 0
                removed, runs = int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
                text = text[~gone]
            out.append((removed, runs, hashlib.sha256(text.tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(off).astype(np.int64)), *[pa.array([x[k] for x in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs, id_col="doc_id", text_col="text", width=100):
    """``doc_id, lo, hi``: byte stretches covered by strings that also start earlier (they may overlap)."""
    spark = docs.sparkSession
    src = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.mapInArrow(_anchors(width), "g long, c long, doc_id long, lo int, n short, a short")
    by_gram, by_context = Window.partitionBy("g"), Window.partitionBy("g", "c").orderBy("doc_id", "lo")
    seen = (rows.repartition("g").withColumn("nth", F.row_number().over(by_context))
            .withColumn("kinds", F.sum((F.col("nth") == 1).cast("long")).over(by_gram)))
    seen = write_once(seen.filter("a < 0 or nth > 1 or kinds > 1")
                      .select("g", "doc_id", "lo", "n", "a", "kinds", ((F.col("a") < 0) | (F.col("nth") > 1)).alias("again")), folder(spark, "op6-anchors"))
    whole = seen.filter("again").select("doc_id", "lo", (F.col("lo") + F.col("n") - 1 + width).alias("hi"))
    parts = F.ceil(F.col("kinds") / PART).cast("int")
    ask = (seen.filter("not again").select("doc_id", F.struct("g", F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("part"), (parts > 1).alias("hot"), "lo", "n", "a").alias("x"))
           .groupBy("doc_id").agg(F.collect_list("x").alias("want")))
    bits = bitmap(seen.filter("not again").select(F.xxhash64("doc_id").alias("h")).distinct()).scalar()
    ctx = src.filter(in_bitmap(bits, F.xxhash64("doc_id"))).join(ask, "doc_id").select("doc_id", "text", "want").mapInArrow(
        _contexts(width), "g long, part int, hot boolean, doc_id long, lo int, a short, ctx binary")
    found = write_once(ctx.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(
        _sorted_repeats(width), "doc_id long, lo int, hi int, h1 long, h2 long, ask boolean"), folder(spark, "op6-sorted"))
    late = Window.partitionBy("h1", "h2").orderBy("doc_id", "lo")
    hot = found.filter("ask").withColumn("nth", F.row_number().over(late)).filter("nth > 1")
    return whole.unionByName(found.filter("not ask").select("doc_id", "lo", "hi")).unionByName(hot.select("doc_id", "lo", "hi"))


def remove_repeats(docs, id_col="doc_id", text_col="text", width=100):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null and empty texts have no bytes. Rows without an id are reported unchanged and
    take no part. Ids are taken to be unique: rows that repeat an id are each cut by
    the repeats found under that id. Other columns are ignored. Empty in, empty out.
    """
    spark = docs.sparkSession
    spans = write_once(repeats(docs, id_col, text_col, width), folder(spark, "op6-repeats"))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    per = spans.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    bits = bitmap(spans.select(F.xxhash64("doc_id").alias("h")).distinct()).scalar()
    cut = F.coalesce(in_bitmap(bits, F.xxhash64("doc_id")), F.lit(False)) & F.col("doc_id").isNotNull()
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    touched = src.filter(cut).join(per, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return touched.mapInArrow(_cut, kind).unionByName(src.filter(~cut).select("doc_id", "text", none.alias("spans")).mapInArrow(_cut, kind))
