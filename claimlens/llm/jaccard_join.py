"""Exact n-gram Jaccard join by partitioning the shingle universe.

Sizes fall into bands [U/2, U]. Within a band the shingle universe is cut into
segments by hash, the same for both sides. Two sets that link differ in at most
H shingles, so at least (segments - H) segments hold equal subsets: each set sends
out the H + 1 cheapest of its segment subsets, ordered by how frequent their rarest
shingle is in the corpus (an order both sides share), and linked sets meet in at
least one. In bands of small sets, where segments would often be empty, some wide
segments are sent with their one-deletion neighbourhoods: such a segment also
matches at distance one and so counts for two. How many are wide is chosen per
band from its number of sets by expected rows and collisions.

A set whose segments mostly hold common shingles only sends single shingles as well:
the rarest ones, as many as two linked sets of this kind need to meet (prefix filter).
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimlens.session import write_once

from . import text_arrays as T
from .components import components
from .work import bitmap, folder, in_bitmap, small_batches

#: Share of shingles that two linked sets have in common, as 75 : 100 of the union.
NUM, DEN = 75, 100
#: Counters of the frequency sketch; only the order of costs depends on it, no result.
SKETCH = 1 << 18
#: A shingle is common if its counter is above so many times the mean, and this number.
COMMON, COMMON_LEAST = 8, 50
#: Longs of marks per set: a mark that only one set has stands for a shingle that the other lacks.
MARKS = 16
#: Smallest tokens per set that tell whether two sets have met at a smaller token already.
FIRST_TOKENS = 16
_SINGLE = np.uint64(0xA5A5A5A5A5A5A5A5)


def max_partner(size):
    """The largest set that can link with one of this size."""
    return size * DEN // NUM


def low(size):
    """The smallest set that can link with one of this size, and the least they have in common."""
    return -(-size * NUM // DEN)


def max_distance(a, b):
    """No fewer shingles than those in which linked sets of sizes up to a and b differ (it grows with both)."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def band_of(size):
    """Band b holds the sizes 2^b .. 2^(b+1) - 1."""
    return int(size).bit_length() - 1


def allocate(sets_by_band):
    """{band: (wide, narrow)} segments with the least expected cost."""
    plan = {}
    for band, n in sorted(sets_by_band.items()):
        lo, hi = 1 << band, (2 << band) - 1
        mid = (lo + hi) / 2
        need = max_distance(hi, max_partner(hi)) + 1
        best = None
        for wide in (0, 1, 2, 3):
            narrow = max(0, need - 2 * wide)
            if narrow:
                narrow = math.ceil(2 * narrow)
            units = 2 * wide + narrow
            if units == 0:
                continue
            lam, lam_wide = mid / units, 2 * mid / units
            if wide == 1 and not narrow:
                lam_wide = mid
            full = max(0.0, need - 2 * wide)
            empty = math.exp(-lam) if narrow else 0.0
            short = max(0.0, full - narrow * (1 - empty)) + full * empty ** max(1, narrow - full + 1)
            e0 = math.exp(-lam_wide) if (wide > 1 or narrow) else 0.0
            e1 = e0 * lam_wide
            collisions = n * (wide * (e0 * e0 + 2 * e0 * e1) + short * empty)
            cost = full + wide * (1 + lam_wide) + 0.2 * collisions
            if best is None or cost < best[0]:
                best = (cost, wide, narrow)
        plan[band] = best[1:]
    return plan


def _statistics(batches):
    """Set size and set hash of each row, then the task's shingle counts."""
    counts = np.zeros(SKETCH, np.int64)
    schema = ["doc_id", "n", "h1", "h2", "cells"]
    for batch in batches:
        raw, off = T.utf8(batch.column(1))
        ids = batch.column(0)
        for i, j in T.blocks(off):
            s, own = T.shingle_sets(raw, off, i, j)
            counts += np.bincount((s >> np.uint64(46)).astype(np.int64), minlength=SKETCH)
            at = np.searchsorted(own, np.arange(j - i + 1))
            sums = []
            for salt in (0x1B873593, 0x85EBCA6B):
                c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(T.mix(s + np.uint64(salt)), dtype=np.uint64)))
                sums.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                 pa.nulls(j - i, pa.binary())], schema)
    width = 1 << 12
    for k in range(0, SKETCH, width):
        cells = counts[k: k + width]
        if cells.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.array([-1 - k // width], pa.int64()), pa.nulls(1, pa.int64()),
                 pa.nulls(1, pa.int64()), pa.array([cells.astype("<i8").tobytes()], pa.binary())], schema)


def _add_cells(batches):
    """Sum of sketch rows, piece by piece: one row per piece that a task has seen."""
    total = {}
    for batch in batches:
        for piece, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = np.frombuffer(cells, "<i8")
            total[piece] = total[piece] + v if piece in total else v
    for piece, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([v.tobytes()], pa.binary())],
                                         ["n", "cells"])


def _tokens_of(s, own, sizes, band, plan, costs, bound):
    """(row, token) of the rows of one band, ``sizes`` being per row."""
    wide, narrow = plan[band]
    units = max(1, 2 * wide + narrow)
    lo, hi = 1 << band, (2 << band) - 1
    unit = ((s >> np.uint64(32)) * np.uint64(units) >> np.uint64(32)).astype(np.int64)
    seg = np.where(unit < 2 * wide, unit // 2, unit - wide)
    new = np.ones(len(s), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    m = T.mix(s)
    total = np.add.reduceat(m, at) if len(at) else m
    cost = np.minimum.reduceat(costs[(s >> np.uint64(46)).astype(np.int64)], at) if len(at) else np.zeros(0, np.int64)
    g_own, g_seg = own[at], seg[at]
    tag = lambda sg: T.mix(np.uint64((band * 0x10001 + 7) * 0x9E3779B97F4A7C15 % (1 << 64)) + sg.astype(np.uint64))
    rows, tokens = [], []
    if wide:
        present = np.unique(own)
        is_wide = g_seg < wide
        rows.append(g_own[is_wide])
        tokens.append(T.mix(total[is_wide] ^ tag(g_seg[is_wide])))
        group = np.cumsum(new) - 1
        el = seg < wide
        rows.append(own[el])
        tokens.append(T.mix((total[group[el]] - m[el]) ^ tag(seg[el])))
        for w in range(wide):
            gone = np.setdiff1d(present, g_own[is_wide & (g_seg == w)])
            rows.append(gone)
            tokens.append(T.mix(np.zeros(len(gone), np.uint64) ^ tag(np.full(len(gone), w))))
    # the distance to any partner that meets this set in this band
    # (larger sets come down to their partners' band)
    partner = np.where(sizes > hi, hi, sizes * DEN // NUM)
    prefix = max_distance(sizes, partner) - 2 * wide + 1
    is_n = g_seg >= wide
    n_own, n_tok, n_cost = g_own[is_n], T.mix(total[is_n] ^ tag(g_seg[is_n])), cost[is_n]
    order = np.lexsort((n_tok, n_cost, n_own))
    n_own, n_tok = n_own[order], n_tok[order]
    first = np.searchsorted(n_own, np.arange(len(sizes) + 1))
    rank = np.arange(len(n_own)) - first[n_own] if len(n_own) else np.zeros(0, np.int64)
    take = rank < prefix[n_own]
    common = n_cost[order] >= bound
    rows.append(n_own[take & ~common])
    tokens.append(n_tok[take & ~common])
    # too few subsets with a rare shingle: the prefix of single shingles in the shared order of costs
    # that two such sets need to meet in, since they have low(size) shingles in common at least
    have = np.bincount(n_own[~common], minlength=len(sizes))
    el = (prefix > have)[own]
    f_own, f_s = own[el], s[el]
    order = np.lexsort((f_s, costs[(f_s >> np.uint64(46)).astype(np.int64)], f_own))
    f_own, f_s = f_own[order], f_s[order]
    first = np.searchsorted(f_own, np.arange(len(sizes) + 1))
    take = np.arange(len(f_own)) - first[f_own] <= (sizes - low(sizes))[f_own]
    rows.append(f_own[take])
    tokens.append(T.mix(f_s[take] ^ _SINGLE))
    return np.concatenate(rows), np.concatenate(tokens)


def _tokens(plan, costs_b):
    def run(batches):
        costs = np.frombuffer(costs_b.value, "<i8")
        bound = max(COMMON_LEAST, int(COMMON * costs.mean()))
        for batch in batches:
            raw, off = T.utf8(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            known = np.asarray(batch.column(0).is_valid())
            for i, j in T.blocks(off):
                s, own = T.shingle_sets(raw, off, i, j)
                sizes = np.bincount(own, minlength=j - i)
                bands = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
                rows, toks = [], []
                for band in np.unique(bands[sizes > 0]):
                    # a set sends its own band, and the band below if partners may lie there
                    for b in (band, band - 1):
                        # one or two shingles link with their like only, which are copies
                        pick = (bands == band) & (max_distance(sizes, max_partner(sizes)) > 0) & known[i:j]
                        if b < band:
                            pick &= low(sizes) < (1 << int(band))
                        if not pick.any() or int(b) not in plan:
                            continue
                        el = pick[own]
                        r, t = _tokens_of(s[el], own[el], sizes, int(b), plan, costs, bound)
                        rows.append(r)
                        toks.append(t)
                if rows:
                    r, t = np.concatenate(rows), np.concatenate(toks)
                    # single shingles are sent once, whatever bands ask for them
                    order = np.lexsort((t, r))
                    r, t = r[order], t[order]
                    new = np.ones(len(r), bool)
                    new[1:] = (r[1:] != r[:-1]) | (t[1:] != t[:-1])
                    r, t = r[new], t[new]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][r]), pa.array(t.view(np.int64))], ["doc_id", "token"])
    return run


def _marks(batches):
    """Set size and marks of each row: MARKS longs, and a bitmap of at least one bit per shingle."""
    for batch in batches:
        raw, off = T.utf8(batch.column(1))
        for i, j in T.blocks(off):
            s, own = T.shingle_sets(raw, off, i, j)
            n = np.bincount(own, minlength=j - i)
            marks = np.zeros((j - i, 64 * MARKS), bool)
            marks[own, (s & np.uint64(64 * MARKS - 1)).astype(np.int64)] = True
            bits = np.packbits(marks, axis=1, bitorder="little").view("<i8")
            width = np.maximum(64 * MARKS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
            first = np.concatenate(([0], np.cumsum(width)))
            wide = np.zeros(first[-1], bool)
            wide[first[own] + (s & (width[own] - 1).astype(np.uint64)).astype(np.int64)] = True
            wide = pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(np.packbits(wide, bitorder="little").view("<i8")))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n.astype(np.int64)), wide, *[pa.array(bits[:, k]) for k in range(MARKS)]],
                                             ["doc_id", "n", "wide", *[f"m{k}" for k in range(MARKS)]])


def _compare(batches):
    """The rows (a, b, text of a, text of b) whose sets link."""
    for batch in batches:
        (raw_a, off_a), (raw_b, off_b) = T.utf8(batch.column(2)), T.utf8(batch.column(3))
        for i, j in T.blocks(off_a):
            (sa, oa), (sb, ob) = T.shingle_sets(raw_a, off_a, i, j), T.shingle_sets(raw_b, off_b, i, j)
            s, own = np.concatenate((sa, sb)), np.concatenate((oa, ob))
            order = np.lexsort((s, own))
            s, own = s[order], own[order]
            both = np.bincount(own[1:][(s[1:] == s[:-1]) & (own[1:] == own[:-1])], minlength=j - i)
            linked = DEN * both >= NUM * (np.bincount(own, minlength=j - i) - both)
            at = pa.array(i + np.flatnonzero(linked & (both > 0)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])


def _with_ids(rows, ids):
    """The rows with these ids, and few others (a bitmap of the ids is looked at): no text is shuffled for it."""
    bits = F.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h"))))
    return rows.join(bits, in_bitmap(F.col("bits"), F.xxhash64("doc_id"))).drop("bits")


def _linked(pairs, marks, texts):
    """The pairs (a, b) that link: 100 * intersection >= 75 * union.

    Bitmaps drop what cannot link; only the others' texts (smaller than their sets) are sent and compared.
    """
    def halved(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))

    def side(k):
        return marks.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("wide").alias(f"w{k}"))

    # bitmaps of linked sets differ in length by a factor of two at most; the longer one is folded
    wa = F.when(F.size("wa") > F.size("wb"), halved("wa")).otherwise(F.col("wa"))
    wb = F.when(F.size("wb") > F.size("wa"), halved("wb")).otherwise(F.col("wb"))
    apart = F.aggregate(F.zip_with(wa, wb, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    near = (pairs.join(side("a"), "a").join(side("b"), "b").filter(DEN * F.least("na", "nb") >= NUM * F.greatest("na", "nb"))
            .filter((NUM + DEN) * apart <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("a", "b").distinct())
    near = write_once(near, folder(pairs.sparkSession, "op2-near"))
    texts = _with_ids(texts, near.select(F.explode(F.array("a", "b")).alias("doc_id")))
    return (near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb").mapInArrow(_compare, "a long, b long"))


def _meetings(live, marks):
    """The pairs (a, b) of different components that meet at a token and may link, nearly all of them once.

    Near sets meet at hundreds of tokens. Each row has those of its set's FIRST_TOKENS smallest tokens that
    are smaller than its own: two rows that share one of them are a pair that has met there.
    """
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("token"))
    lowest = (live.select("doc_id", "token").withColumn("nth", nth).filter(F.col("nth") <= FIRST_TOKENS)
              .groupBy("doc_id").agg(F.collect_list("token").alias("lowest")))
    cols = [f"m{k}" for k in range(MARKS)]
    left = (live.join(lowest, "doc_id").withColumn("before", F.filter("lowest", lambda t: t < F.col("token")))
            .join(marks.select("doc_id", "n", *cols), "doc_id").select("token", "doc_id", "c", "n", "before", *cols))
    other = left.select("token", *[F.col(x).alias(f"b{x}") for x in left.columns[1:]])
    # the sets differ by one shingle per such mark at least: an exact bound on the distance of linked sets
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"b{m}"))) for m in cols), F.lit(0))
    near = (NUM + DEN) * apart <= (DEN - NUM) * (F.col("n") + F.col("bn"))
    near &= DEN * F.least("n", "bn") >= NUM * F.greatest("n", "bn")
    return (left.join(other, "token").filter("doc_id < bdoc_id and c <> bc").filter(near).filter(~F.arrays_overlap("before", "bbefore"))
            .select(F.col("doc_id").alias("a"), F.col("bdoc_id").alias("b")))


def _merged(comp, links):
    """Components after more links: those between the components so far are all that has to be settled."""
    side = lambda k: comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    between = (links.join(side("a"), "a", "left").join(side("b"), "b", "left")
               .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    more = components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
    return comp.join(more, F.col("component") == F.col("old"), "full").select(
        F.coalesce("node", "old").alias("node"), F.coalesce("new", "component").alias("component"))


def ngram_components(docs, id_col="doc_id", text_col="text"):
    """``doc_id, n_shingles, component_id`` of every row.

    * A null or wordless text has an empty set and links with nothing.
    * Equal sets are one node (their smallest id); copies are never paired.
    * A row without an id keeps its size and has a null component. Rows that repeat
      an id are one node, linked by any of their texts.
    * An empty table gives an empty frame; other columns are ignored.

    Rounds of candidates: every set against the smallest set it meets, then every
    meeting-place's sets outside its largest component against some set of that (one
    by hash for each place, so a set meets many), then all meetings between different
    components, a pair at its first meeting-place only. Pairs that earlier rounds have
    connected are not compared again.
    """
    # all that goes through Python is written before the frame is returned
    with small_batches(docs.sparkSession):
        return _components_of_sets(docs, id_col, text_col)


def _components_of_sets(docs, id_col, text_col):
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = write_once(src.mapInArrow(_statistics, "doc_id long, n long, h1 long, h2 long, cells binary"),
                       folder(spark, "op2-sets"))
    rows = stats.filter("n >= 0").select("doc_id", "n", "h1", "h2")
    # as many pieces as the sketch has at most
    cells = stats.filter("n < 0").select("n", "cells")
    for parts in (8, 1):
        cells = cells.repartition(parts, "n").mapInArrow(_add_cells, "n long, cells binary")
    sketch = np.zeros(SKETCH, np.int64)
    for piece, v in cells.collect():
        v = np.frombuffer(v, "<i8")
        sketch[(-1 - piece) * len(v): (-piece) * len(v)] += v
    bands = dict(rows.filter("n > 0").groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect())
    wanted = {b: bands.get(b, 0) for k in bands for b in (k, k - 1) if b >= 0}
    plan = allocate(wanted)
    costs = spark.sparkContext.broadcast(sketch.astype("<i8").tobytes())

    nodes = rows.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = write_once(rows.join(nodes, ["h1", "h2"], "left").select("doc_id", "n", "rep"), folder(spark, "op2-member"))
    # an id that has a text of its own besides a copy stays
    copies = member.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.every(F.expr("doc_id <> rep")).alias("copy")).filter("copy").select("doc_id")

    tokens = src.filter("doc_id is not null").mapInArrow(_tokens(plan, costs), "doc_id long, token long")
    # the smallest id at a token is no copy: the set it came with has no smaller id
    met = write_once(tokens.withColumn("lead", F.min("doc_id").over(_by_token())).withColumn("last", F.max("doc_id").over(_by_token()))
                     .filter("lead < last").select("token", "doc_id", "lead").join(copies, "doc_id", "left_anti"), folder(spark, "op2-met"))
    involved = write_once(met.select("doc_id").distinct(), folder(spark, "op2-involved"))
    texts = write_once(_with_ids(src, involved), folder(spark, "op2-texts"))
    marks = write_once(texts.mapInArrow(_marks, "doc_id long, n long, wide array<long>, " + ", ".join(f"m{k} long" for k in range(MARKS))),
                       folder(spark, "op2-marks"))

    first = write_once(met.filter("lead < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("lead").alias("a")).select("a", "b"),
                       folder(spark, "op2-pairs"))
    links = write_once(_linked(first, marks, texts), folder(spark, "op2-links"))
    comp = write_once(components(links), folder(spark, "op2-comp"))
    done, live = first, met.select("token", "doc_id")
    for every in (False, True):
        # meeting-places of one component are settled for good
        live = write_once(
            live.join(comp, live.doc_id == comp.node, "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("c"))
            .withColumn("least", F.min("c").over(_by_token())).withColumn("most", F.max("c").over(_by_token())).withColumn("k", F.count("*").over(_by_token()))
            .filter("least < most").select("token", "doc_id", "c", "k"), folder(spark, "op2-live"))
        if every:
            cand = _meetings(live, marks)
        else:
            parts = live.groupBy("token", "c").agg(
                F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc_id", "token").alias("x"), "doc_id")).alias("pick"))
            span = parts.groupBy("token").agg(F.max(F.struct("n", "c", "pick")).alias("top"))
            cand = (live.join(span.select("token", F.col("top.c").alias("tc"), F.col("top.pick.doc_id").alias("r")), "token").filter("c <> tc")
                    .select(F.least("r", "doc_id").alias("a"), F.greatest("r", "doc_id").alias("b")))
            # two sets that are alone at a token have been compared then
            live = live.filter("k > 2").select("token", "doc_id")
        cand = write_once(cand.distinct().join(done, ["a", "b"], "left_anti"), folder(spark, "op2-pairs"))
        done = done.unionByName(cand)
        comp = write_once(_merged(comp, write_once(_linked(cand, marks, texts), folder(spark, "op2-links"))), folder(spark, "op2-comp"))
    # copies of a node under several ids, and ids with several texts, are joined too
    repeated = member.filter("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("rep").alias("k")).filter("k > 1")
    if repeated.limit(1).count():
        comp = _merged(comp, member.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
        key = F.col("doc_id")
    else:
        key = F.coalesce("rep", "doc_id")
    out = member.withColumn("key", key).join(comp, F.col("key") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def _by_token():
    from pyspark.sql import Window

    return Window.partitionBy("token")
