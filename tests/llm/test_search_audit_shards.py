"""Ranked search, filter audit and sharding against brute force, and their edge cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from claimlens.llm import filter_audit, histogram_shards, ranked_search

SCHEMA = "doc_id long, text string, lang string, row long, term string, h string, mask int, size int"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    """Texts of a skewed vocabulary, copies, repeated rows, rows without id or text; odd columns carry names the operators use."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(120)]
    weight = 1 / np.arange(1, 121)
    texts = [" ".join(rng.choice(vocab, n, p=weight / weight.sum())) for n in rng.integers(0, 160, 150)]
    texts += [texts[7]] * 40 + [texts[3].upper(), "", None, None, " \n", "A B C", "é É ÀB-c3", "x" * 5000, " ".join(["la", "LA"] * 3000), "a # b"]
    rows = [(i, t, ("en", "de", None, "")[i % 4], 1, "t", "h", 5, 9) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text w1 w2", "en", 1, None, None, None, None), (None, texts[7], "en", 1, None, None, None, None),
             (None, texts[7], "de", 1, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


ITEMS = [(1, "w1 w2 W2 w90"), (2, "w1"), (3, "w110 w111 w112 w5 w1 w3"), (4, None), (5, "--"), (6, "nowhere"), (7, "la é c3 b"), (8, "w60"), (8, "w61 w60"), (None, "w1"),
         (9, " ".join(f"w{i}" for i in range(60)))]


@pytest.fixture(scope="module")
def docs(llm_spark):
    return llm_spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(llm_spark):
    return llm_spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(llm_spark):
    return llm_spark.createDataFrame([(*r, 3) for r in ITEMS], "item_id long, text string, term int")


# --- ranked search ---------------------------------------------------------------------
def brute_scores():
    terms = [TERM.findall((r[1] or "").translate(LOWER)) for r in corpus()]
    full = [t for t in terms if t]
    n, total = len(full), sum(map(len, full))
    df = Counter(w for t in full for w in set(t))
    asked = {}
    for i, t in ITEMS:
        if i is not None:
            asked.setdefault(i, []).extend(TERM.findall((t or "").translate(LOWER)))
    out = {}
    for i, q in asked.items():
        for r, t in enumerate(terms):
            tf, s = Counter(t), 0
            if t:
                m = 75 + 25 * len(t) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in q if w in tf)
            if s > 0:
                doc = corpus()[r][0]
                out.setdefault(i, []).append((-s, doc is None, doc or 0, r))
    return {i: [(k + 1, None if x[1] else x[2], -x[0]) for k, x in enumerate(sorted(v)[:20])] for i, v in out.items()}


@pytest.mark.parametrize("first,growth", [(1000, 8), (20, 4)])
def test_search_finds_the_best_documents(docs, items, monkeypatch, first, growth):
    monkeypatch.setattr(ranked_search, "FIRST", first)
    monkeypatch.setattr(ranked_search, "GROWTH", growth)
    got = {}
    for r in ranked_search.ranked_search(docs, items).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    assert {i: sorted(v) for i, v in got.items()} == brute_scores()


def test_search_stops_making_accumulators(llm_spark, monkeypatch):
    """A word of every document makes none once 20 documents hold the rare words."""
    monkeypatch.setattr(ranked_search, "FIRST", 30)
    rows = [(i, "all " + ("rare seldom scarce" if i < 25 else f"other{i}")) for i in range(3000)]
    made = []
    real = ranked_search.write_once
    monkeypatch.setattr(ranked_search, "write_once", lambda df, path: made.append(real(df, path)) or made[-1])
    items = llm_spark.createDataFrame([(1, "all rare seldom scarce")], "item_id long, text string")
    out = ranked_search.ranked_search(llm_spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r["rank"])] == list(range(20))
    assert sum(m.count() for m in made if m.columns == ["item_id", "row"]) == 25


def test_search_without_documents_or_items(docs, items, empty):
    assert ranked_search.ranked_search(empty, items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(docs.filter("text is null"), items).count() == 0
    assert ranked_search.ranked_search(docs, items.filter("item_id = 2"), k=3).count() == 3


# --- filter audit ----------------------------------------------------------------------
LABELS = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 190, 2)] + [(0, 0, 1), (None, 1, 1), (4, None, None), (999, 1, 1)]


def brute_audit():
    lowest = {}
    for r in corpus():
        if r[0] is not None:
            lowest[r[1] or ""] = min(lowest.get(r[1] or "", r[0]), r[0])
    good, toxic = {i for i, g, _ in LABELS if g}, {i for i, _, t in LABELS if t}
    rows = []
    for doc, text, lang, *_ in corpus():
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and doc > lowest[text]}
        rows.append((lang or "", {k for k, f in fails.items() if f}, doc is not None and doc in good, doc is not None and doc in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                shapley[f] += len(gone)
                out[part, "".join(order), step + 1] = [
                    f, sum(not r[1] & (before | {f}) for r in mine), len(gone), sum(f in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for v in (v for k, v in out.items() if k[0] == part):
            v.append(shapley[v[0]])
    return out


def test_audit_of_every_order(llm_spark, docs, empty):
    labels = llm_spark.createDataFrame(LABELS, "doc_id int, quality int, toxic int")
    rows = filter_audit.filter_audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): [r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) == 600 * 3
    assert got == brute_audit()
    assert filter_audit.filter_audit(empty, labels).count() == 0
    bare = filter_audit.filter_audit(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum", "removed": "sum"}).first()
    assert (bare["sum(good_lost)"], bare["sum(toxic_lost)"]) == (0, 0) and bare["sum(removed)"] > 0


def test_audit_steps_are_325_prefixes_of_every_mask(llm_spark):
    steps = filter_audit.prefix_steps(llm_spark.createDataFrame([("en", 0, 1), ("de", 5, 2), ("en", 5, 9)], "part string, mask int, n long")).collect()
    assert len(steps) == 2 * 325 and len({r.taken for r in steps}) == 325
    assert not any(r.removed or r.redundant or not r.kept for r in steps if r.mask == 0)


# --- sharding --------------------------------------------------------------------------
def check_shards(rows, shards, source):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in source)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(shards):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / shards) <= largest
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_are_even_and_gapless(docs, empty):
    source = [r[:2] for r in corpus()]
    rows = histogram_shards.histogram_shards(docs).collect()
    check_shards(rows, 8, source)
    check_shards(histogram_shards.histogram_shards(docs, shards=3).collect(), 3, source)
    # a group is cut only at a boundary
    places = {}
    for r in rows:
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) - 1 for s in places.values()) <= 7
    # the same shards whatever the partitions
    again = histogram_shards.histogram_shards(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in rows) == Counter((r.doc_id, r.text_crc32, r.shard) for r in again)
    assert histogram_shards.histogram_shards(empty).count() == 0


def test_shards_of_one_text_and_of_equal_rows(llm_spark):
    """One text in every row, with ids and without any: the later parts of the key cut it."""
    for source in ([(i, "same") for i in range(1000)], [(None, "same")] * 1000, [(i % 2, "same") for i in range(999)] + [(5, "other")]):
        df = llm_spark.createDataFrame(source, "doc_id int, text string").repartition(4)
        check_shards(histogram_shards.histogram_shards(df).collect(), 8, source)


def test_few_rows_and_one_very_long_text(llm_spark):
    rows = histogram_shards.histogram_shards(llm_spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")).collect()
    assert sorted(r.size for r in rows) == [1, 2] and all(r.slot == 0 for r in rows)
    source = [("big", "y" * 3_000_000)] + [(str(i), "z" * 10) for i in range(50)]
    rows = histogram_shards.histogram_shards(llm_spark.createDataFrame(source, "doc_id string, text string")).collect()
    check_shards(rows, 8, source)


def test_tolerance_stops_at_group_borders(docs):
    total = sum(len((r[1] or "").encode()) + 1 for r in corpus())
    rows = histogram_shards.histogram_shards(docs, shards=4, tolerance=total // 16).collect()
    for s in range(4):
        assert abs(sum(r.size for r in rows if r.shard == s) - total / 4) <= total / 8 + 1


def test_written_shards_hold_whole_rows(llm_spark, docs, tmp_path):
    histogram_shards.write_shards(docs, str(tmp_path / "out"))
    back = llm_spark.read.parquet(str(tmp_path / "out"))
    assert set(docs.columns) | {"shard", "slot"} == set(back.columns)
    assert Counter(map(tuple, docs.select("doc_id", "text", "row").collect())) == Counter(map(tuple, back.select("doc_id", "text", "row").collect()))
