"""BPE encoding through a table of distinct words, and decoding through the id-to-piece table.

A word here is a run of bytes between ASCII white space. The tokenizer drops white
space and never merges across it, so a text's ids are the ids of its words in a row.
Words are split and counted over all texts. The most frequent ones - a number and size
that are bounded - are encoded once and broadcast; all others meet at their word in Spark,
where each distinct one is encoded once. Encoding is the library's, so normalisation,
special tokens and splits are its own. Ids are joined back by position.
"""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from claimlens.session import write_once

from . import text_arrays as T
from .work import folder

#: The broadcast has at most so many words, each of at most so many bytes and ids. A text's words stand
#: there by a 64-bit hash.
FREQUENT, WORD_BYTES, WORD_IDS = 1 << 20, 32, 16
#: Texts that a task has as Python objects at once, and words that it counts before it sends them on.
SLICE, COUNTED = 200, 600_000
#: Places of a long word.
SALT = 64
#: Stands for a word that is joined; no id of the vocabulary may be as large.
HOLE = 0xFFFF


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if max(t.get_vocab().values()) >= HOLE:
        raise ValueError("ids must fit into 16 bits")
    return t


def _count(batches):
    """(word, n) of short words; one that a task has met once is none that the broadcast needs."""
    seen: dict = {}

    def flush():
        often = {w: n for w, n in seen.items() if n > 1}
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(often), pa.binary()).cast(pa.string()), pa.array(list(often.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            for w in text.as_py().split():
                if len(w) <= WORD_BYTES:
                    seen[w] = seen.get(w, 0) + 1
            if len(seen) > COUNTED:
                yield flush()
    yield flush()


def _encode(path):
    def run(batches):
        # Spark has a task on every core already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = load(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ids = [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.binary()), part.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])
    return run


class Words:
    """The frequent words as arrays: sorted hashes, each with a code, and the ids of each code.

    Codes go by frequency from 1 on, and 0 stands for every other word, so that most words
    of a text take one or two bytes. No object per word, so workers hold few bytes of it.
    """

    def __init__(self, rows):
        """``rows``: a table of word, n and ids; words whose hashes are equal are all left out."""
        rows = rows.take(pc.sort_indices(rows, [("n", "descending"), ("word", "ascending")])).combine_chunks()
        raw, off = T.utf8(rows.column("word").cast(pa.string()))
        h = np.concatenate([T.span_hash(T.prefix_hash(raw[off[i]:off[j]]), off[i:j] - off[i], off[i + 1:j + 1] - off[i]) for i, j in T.blocks(off)] or [np.zeros(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        apart = np.ones(len(h), bool)
        same = h[order][1:] == h[order][:-1]
        apart[1:] &= ~same
        apart[:-1] &= ~same
        self.hash, self.code = h[order[apart]], (order[apart] + 1).astype(np.int32)
        ids = rows.column("ids").combine_chunks().cast(pa.large_binary()) if rows.num_rows else pa.array([], pa.large_binary())
        _, offsets, data = ids.buffers()
        start = np.frombuffer(offsets, np.int64)[ids.offset:ids.offset + len(ids) + 1] // 2 if len(ids) else np.zeros(1, np.int64)
        # code 0 has one id, a HOLE
        self.start = np.concatenate(([0], start + 1)).astype(np.uint32)
        self.ids = np.append(np.uint16(HOLE), np.frombuffer(data, "<u2")[:start[-1]]) if len(ids) else np.array([HOLE], np.uint16)

    def find(self, h):
        """The code of every hash, 0 where there is none."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.code[at], 0).astype(np.int64)

    def expand(self, codes):
        """The ids of the coded words in a row."""
        n = self.start[codes + 1].astype(np.int64) - self.start[codes]
        return self.ids[np.arange(n.sum()) + np.repeat(self.start[codes].astype(np.int64) - np.cumsum(n) + n, n)]


def _packed(codes):
    """Codes as bytes, seven bits each, low bits first, and the bytes of each."""
    size = 1 + (codes >= 1 << 7) + (codes >= 1 << 14)
    at = np.cumsum(size) - size
    out = np.empty(size.sum(), np.uint8)
    for k in range(3):
        some = size > k
        out[at[some] + k] = (codes[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out, size


def _unpacked(data):
    """The codes of ``_packed`` bytes."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out = (raw[begin] & 127).astype(np.int64)
    for k in (1, 2):
        some = ends - begin >= k
        out[some] |= (raw[begin[some] + k] & 127).astype(np.int64) << 7 * k
    return out


def _encode_sorted(path):
    """(k1, k2, spot) of rows that come word by word: four bytes of k, then ids; each distinct word is encoded once."""
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = load(path)
        last, ids = None, b""
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                coded = part.column(3).dictionary_encode()
                words = coded.dictionary.to_pylist()
                new = [w for w in words if w != last]
                have = dict(zip(new, [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch([w.decode("utf-8") for w in new], add_special_tokens=False)], strict=True))
                have.setdefault(last, ids)
                found = [have[w] for w in words]
                spots = [k.to_bytes(4, "big") + found[w] for k, w in zip(part.column(2).to_pylist(), coded.indices.to_pylist(), strict=True)]
                last, ids = words[-1], found[-1]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(spots, pa.binary())], ["k1", "k2", "spot"])
    return run


def _spans(batch, frequent):
    """Per block of rows: (first row, end, data, start, end and code of every word, words per row)."""
    raw, off = T.utf8(batch.column(batch.num_columns - 1))
    for i, j in T.blocks(off):
        data = raw[off[i]:off[j]]
        start, end, doc = T.words(data, (off[i:j + 1] - off[i]).astype(np.int64))
        codes = frequent.find(T.span_hash(T.prefix_hash(data), start, end)) if len(start) else np.zeros(0, np.int64)
        # a longer word is never in the arrays, whatever its hash
        codes[end - start > WORD_BYTES] = 0
        yield i, j, data, start, end, codes, np.bincount(doc, minlength=j - i)


def _rare(frequent):
    """(k1, k2, k, word): the k-th word of a text that is not in the broadcast."""
    def run(batches):
        known = frequent.value
        for batch in batches:
            for i, _, data, start, end, codes, per in _spans(batch, known):
                gone = codes == 0
                row = np.repeat(np.arange(len(per)), per)[gone]
                k = np.arange(len(row)) - np.searchsorted(row, row)
                blob = data.tobytes()
                words = [blob[a:b] for a, b in zip(start[gone].tolist(), end[gone].tolist(), strict=True)]
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(k.astype(np.int32)), pa.array(words, pa.binary())], ["k1", "k2", "k", "word"])
    return run


def _known(frequent):
    """(k1, k2, doc_id, codes): the packed codes of a text's words."""
    def run(batches):
        known = frequent.value
        for batch in batches:
            for i, j, _, _, _, codes, per in _spans(batch, known):
                flat, size = _packed(codes)
                cut = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per)))].tolist()
                blob = flat.tobytes()
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([blob[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                                                 ["k1", "k2", "doc_id", "codes"])
    return run


def _fill(ids, rare):
    """ids with the k-th HOLE replaced by the k-th of ``rare``."""
    holes = np.flatnonzero(ids == HOLE)
    if not len(holes):
        return ids
    parts = [np.frombuffer(x, "<u2") for x in rare]
    n = np.ones(len(ids), np.int64)
    n[holes] = [len(x) for x in parts]
    out = np.repeat(ids, n)
    ends = np.cumsum(n)
    size = n[holes]
    if size.sum():
        to = np.arange(size.sum()) + np.repeat(ends[holes] - np.cumsum(size), size)
        out[to] = np.concatenate(parts)
    return out


def _filled(batches, words):
    """Slices of some rows, and the whole ids of each of their rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, (
                _fill(words.expand(_unpacked(codes)), [x[4:] for x in sorted(rare or [])])
                for codes, rare in ((i.as_py(), r.as_py()) for i, r in zip(part.column(1), part.column(2), strict=True)))


def _digest(frequent, pieces):
    def run(batches):
        piece = pieces.value
        for part, rows in _filled(batches, frequent.value):
            n, s, d = [], [], []
            for v in rows:
                n.append(len(v))
                s.append(hashlib.sha256(v.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(b" ".join([piece[i] for i in v.tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(s, pa.string()), pa.array(d, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _encoded(docs, id_col, text_col, path):
    """(doc_id, codes, rare spots) per row, and the words of the codes as a broadcast."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # 128 bits tell rows of different id or text apart; rows equal in both have equal ids, and share them
    src = docs.select(F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(1), F.col(id_col)).alias("k2"), F.col(id_col).alias("doc_id"), text.alias("text"))
    counts = src.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = write_once(counts, folder(spark, "op7-counts"))
    # the smallest count that leaves at most FREQUENT words; counts fall into steps of an eighth of a power of two
    step = F.floor(F.log2("n") * 8).cast("int")
    least, left = 1 << 20, FREQUENT
    for s, n in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):
        if n > left:
            break
        least, left = s, left - n
    table = counts.filter(step >= least).mapInArrow(_encode(path), "word binary, n long, ids binary")
    frequent = spark.sparkContext.broadcast(Words(table.filter(F.length("ids") <= 2 * WORD_IDS).toArrow()))
    # all other words meet at their word, each distinct one is encoded there once; only words that may be
    # frequent all the same, as the broadcast takes none so long, are dealt to SALT places
    place = F.when(F.length("word") > WORD_IDS, F.pmod("k1", F.lit(SALT))).otherwise(F.lit(0))
    rare = src.drop("doc_id").mapInArrow(_rare(frequent), "k1 long, k2 long, k int, word binary").repartition("word", place).sortWithinPartitions("word")
    rare = rare.mapInArrow(_encode_sorted(path), "k1 long, k2 long, spot binary")
    # a text's own words are no more than the text holds
    rare = rare.groupBy("k1", "k2").agg(F.collect_set("spot").alias("rare"))
    known = src.mapInArrow(_known(frequent), "k1 long, k2 long, doc_id %s, codes binary" % dict(src.dtypes)["doc_id"])
    return known.join(rare, ["k1", "k2"], "left").select("doc_id", "codes", "rare"), frequent


def encode_digests(docs, id_col="doc_id", text_col="text", path=None):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    Null and empty texts have no tokens. Rows that repeat an id are encoded each for
    itself; a null id stays null. Other columns are ignored. Empty in, empty out.
    """
    path = path or tokenizer_path()
    vocab = load(path).get_vocab()
    piece = [b""] * (max(vocab.values()) + 1)
    for p, i in vocab.items():
        piece[i] = p.encode()
    pieces = docs.sparkSession.sparkContext.broadcast(piece)
    kind = dict(docs.dtypes)[id_col]
    rows, frequent = _encoded(docs, id_col, text_col, path)
    return rows.mapInArrow(
        _digest(frequent, pieces), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(frequent):
    def run(batches):
        for part, rows in _filled(batches, frequent.value):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.astype(np.int32) for v in rows], pa.list_(pa.int32()))], ["doc_id", "ids"])
    return run


def encode(docs, id_col="doc_id", text_col="text", path=None):
    """``doc_id, ids array<int>`` for every row."""
    rows, frequent = _encoded(docs, id_col, text_col, path or tokenizer_path())
    return rows.mapInArrow(_ids(frequent), f"doc_id {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(encoded, path=None, id_col="doc_id", ids_col="ids"):
    """``doc_id, text``: pieces looked up by id and joined as the tokenizer does (blank between)."""
    spark = encoded.sparkSession
    vocab = load(path or tokenizer_path()).get_vocab()
    table = spark.createDataFrame([(i, p) for p, i in vocab.items()], "id int, piece string")
    # numbered before the ids become rows
    rows = encoded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    rows = rows.select("row", "doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    return (rows.join(F.broadcast(table), "id", "left").groupBy("row", "doc_id")
            .agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "piece")))).alias("p"))
            .select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text")))
