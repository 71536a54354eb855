"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces (forward
algorithm); a text's is the product over its words. Piece probabilities are learned
by expectation-maximisation (forward and backward) on the words of labelled texts.
Words of equal length are worked on together, one numpy step per pair of cuts; a longer
word (a line of a script without blanks) goes through the same sums letter by letter, in logarithms.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import folder

#: Labelled texts per language that the model is fitted on (those with the smallest hash of their id).
FIT_DOCS = 800
#: Rounds of expectation-maximisation; probability mass for pieces a language never used.
ROUNDS, SMOOTH = 3, 0.05
#: Longer words (with their start mark) are summed in logarithms, one by one: UNKNOWN to this power is still a double.
TOGETHER = 48
#: Words of equal length worked on at once; letters of the words whose scores a task remembers.
ROWS, REMEMBERED = 4_000, 4_000_000
#: Probability of a letter that no piece covers.
UNKNOWN = 1e-6
_WORD = re.compile(r"[^\W\d_]+")
_B = np.uint64(0x100000001B3)


def vocabulary():
    """Pieces of letters only, with the word-start mark as their first character or without."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_byte(i)}
    return sorted(p for p in pieces if p == "▁" or p.removeprefix("▁").isalpha() and p.count("▁") <= 1)


def _keys(pieces):
    h = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        x = 1469598103934665603
        for c in p:
            x = ((x * int(_B)) + ord(c) + 1) & ((1 << 64) - 1)
        h[i] = x
    return h


class Pieces:
    """Look-up of many substrings at once."""

    def __init__(self, pieces):
        keys = _keys(pieces)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.longest = max(map(len, pieces))
        self.n = len(pieces)

    def find(self, h):
        at = np.minimum(np.searchsorted(self.keys, h), self.n - 1)
        return np.where(self.keys[at] == h, self.order[at], self.n)


def _by_length(strings):
    n = np.array([len(s) for s in strings])
    for length in np.unique(n[n <= TOGETHER]):
        at = np.flatnonzero(n == length)
        for i in range(0, len(at), ROWS):
            rows = at[i:i + ROWS]
            code = np.frombuffer("".join([strings[r] for r in rows]).encode("utf-32-le"), "<u4").reshape(len(rows), length)
            yield rows, code


def _spans(pieces, code):
    """{(s, e): piece number or n} of every possible piece of equally long strings."""
    length = code.shape[1]
    found = {}
    for s in range(length):
        h = np.full(len(code), 1469598103934665603, np.uint64)
        for e in range(s + 1, min(length, s + pieces.longest) + 1):
            h = h * _B + code[:, e - 1] + np.uint64(1)
            ids = pieces.find(h)
            if e == s + 1 or (ids < pieces.n).any():
                found[s, e] = ids
    return found


def _lattice(pieces, string):
    """Piece numbers by end and length: row e, column k is the piece of k + 1 letters that ends at letter e.

    The number of pieces stands for none, the next for a single letter that no piece covers.
    """
    code = np.frombuffer(string.encode("utf-32-le"), "<u4")
    ids = np.full((len(code), min(len(code), pieces.longest)), pieces.n, np.int32)
    h = np.full(len(code), 1469598103934665603, np.uint64)
    for k in range(ids.shape[1]):
        h = h[:len(code) - k] * _B + code[k:] + np.uint64(1)
        ids[k:, k] = pieces.find(h)
    ids[ids[:, 0] == pieces.n, 0] += 1
    return ids


def _logs(prob):
    """Logarithms of probabilities by piece number, with those of no piece and of an unknown letter."""
    with np.errstate(divide="ignore"):
        return np.log(np.vstack([prob, np.zeros(prob.shape[1]), np.full(prob.shape[1], UNKNOWN)]))


def _log_sums(ids, logs):
    """log of the sum over all segmentations of the first e letters, e from 0: (letters + 1, languages)."""
    n, longest = ids.shape
    a = np.full((n + longest, logs.shape[1]), -np.inf)
    a[longest - 1] = 0
    for i in range(0, n, ROWS):
        weights = logs[ids[i:i + ROWS]]
        for e in range(i, min(n, i + ROWS)):
            x = a[e:e + longest][::-1] + weights[e - i]
            top = x.max(0)
            a[e + longest] = top + np.log(np.exp(x - top).sum(0))
    return a[longest - 1:]


def _turned(ids, none):
    """The lattice of the word read backwards."""
    out = np.full_like(ids, none)
    for k in range(ids.shape[1]):
        out[k:, k] = ids[k:, k][::-1]
    return out


def forward(pieces, prob, strings):
    """log P(string) per language, over all segmentations: array (strings, languages)."""
    table = np.vstack([prob, np.zeros(prob.shape[1])])
    single = np.vstack([prob, np.full(prob.shape[1], UNKNOWN)])
    out = np.zeros((len(strings), prob.shape[1]))
    for rows, code in _by_length(strings):
        length = code.shape[1]
        a = np.zeros((length + 1, len(rows), prob.shape[1]))
        a[0] = 1
        for (s, e), ids in sorted(_spans(pieces, code).items(), key=lambda x: x[0]):
            a[e] += a[s] * (single if e == s + 1 else table)[ids]
        out[rows] = np.log(a[length])
    logs = _logs(prob)
    for r, s in enumerate(strings):
        if len(s) > TOGETHER:
            out[r] = _log_sums(_lattice(pieces, s), logs)[-1]
    return out


def expected(pieces, prob, strings, counts):
    """Expected piece counts of strings under one language's probabilities."""
    table, single = np.append(prob, 0.0), np.append(prob, UNKNOWN)
    total = np.zeros(pieces.n + 2)
    for rows, code in _by_length(strings):
        length = code.shape[1]
        spans = sorted(_spans(pieces, code).items())
        a, b = np.zeros((length + 1, len(rows))), np.zeros((length + 1, len(rows)))
        a[0], b[length] = 1, 1
        for (s, e), ids in spans:
            a[e] += a[s] * (single if e == s + 1 else table)[ids]
        for (s, e), ids in reversed(spans):
            b[s] += (single if e == s + 1 else table)[ids] * b[e]
        for (s, e), ids in spans:
            post = a[s] * (single if e == s + 1 else table)[ids] * b[e] / a[length] * counts[rows]
            total += np.bincount(ids, post, pieces.n + 2)
    logs = _logs(prob[:, None])
    for s, c in zip(strings, counts, strict=True):
        if len(s) > TOGETHER:
            ids = _lattice(pieces, s)
            a, b = _log_sums(ids, logs)[:, 0], _log_sums(_turned(ids, pieces.n), logs)[::-1, 0]
            for k in range(ids.shape[1]):
                post = np.exp(a[:len(s) - k] + logs[ids[k:, k], 0] + b[k + 1:] - a[-1])
                total += np.bincount(ids[k:, k], c * post, pieces.n + 2)
    return total[:pieces.n]


def _word_counts(batches):
    for batch in batches:
        seen = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in _WORD.findall((text or "").lower()):
                seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                          pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def _expect(model):
    def run(batches):
        names, prob = model.value
        pieces = Pieces(vocabulary())
        total = np.zeros((len(names), pieces.n))
        for batch in batches:
            lang, word, n = (batch.column(i).to_pylist() for i in range(3))
            for k, name in enumerate(names):
                own = [(w, c) for x, w, c in zip(lang, word, n, strict=True) if x == name]
                if own:
                    total[k] += expected(pieces, prob[:, k], ["▁" + w for w, _ in own], np.array([c for _, c in own], float))
        k, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(total[k, p])], ["lang", "piece", "c"])
    return run


def remainder(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs, id_col="doc_id", text_col="text", lang_col="lang", per_language=FIT_DOCS):
    """(languages, piece probabilities) from texts whose id's remainder is not 2.

    The texts of a language with the smallest hashes of their ids: counts by the hash's
    magnitude give a bound that about twice as many lie below, and only those are ranked.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col(id_col).cast("string"))
    known = (docs.filter((remainder(id_col) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
             .withColumn("size", F.floor(F.log2(F.col("h").cast("double") + 2.0**63 + 1))))
    # a row per language and magnitude, some 60 of them
    so_far = Window.partitionBy("lang").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    bound = (known.groupBy("lang", "size").count().withColumn("before", F.coalesce(F.sum("count").over(so_far), F.lit(0)))
             .filter(F.col("before") < per_language).groupBy("lang").agg(F.max("size").alias("bound")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))
    # a row per language, of which the model has a column each: texts beyond the bound leave before the shuffle
    pick = (known.join(F.broadcast(bound), "lang").filter("size <= bound").select("doc_id", "lang", "text", "h")
            .withColumn("r", rank).filter(F.col("r") <= per_language))
    pick = write_once(pick.select("lang", "text"), folder(spark, "op3-fit"))
    words = write_once(pick.mapInArrow(_word_counts, "lang string, word string, n long")
                       .groupBy("lang", "word").agg(F.sum("n").alias("n")), folder(spark, "op3-words"))
    names = sorted(r[0] for r in pick.select("lang").distinct().collect())
    pieces = vocabulary()
    prob = np.full((len(pieces), max(1, len(names))), 1 / len(pieces))
    if not names:
        return [], prob
    parallel = max(1, spark.sparkContext.defaultParallelism)
    for _ in range(ROUNDS):
        model = spark.sparkContext.broadcast((names, prob))
        # vocabulary times languages at most
        rows = (words.repartition(parallel, "word").mapInArrow(_expect(model), "lang int, piece int, c double")
                .groupBy("lang", "piece").agg(F.sum("c").alias("c")).toArrow())
        total = np.zeros_like(prob)
        total[rows["piece"].to_numpy(), rows["lang"].to_numpy()] = rows["c"].to_numpy()
        share = total / np.maximum(total.sum(0), 1e-9)
        prob = (1 - SMOOTH) * share + SMOOTH / len(pieces)
    return names, prob


def _predict(model, held, text):
    """Columns ``held`` of each batch, and the language and score of its column ``text``."""
    def run(batches):
        names, prob = model.value
        pieces = Pieces(vocabulary())
        known, scores, letters_kept = {}, np.zeros((0, prob.shape[1])), 0
        for batch in batches:
            texts = batch.column(text)
            for i in range(0, batch.num_rows, 500):
                part = texts.slice(i, 500).to_pylist()
                found, new, first = [], [], [0]
                if len(known) > 200_000 or letters_kept > REMEMBERED:
                    known, scores, letters_kept = {}, np.zeros((0, prob.shape[1])), 0
                letters = np.zeros(len(part), bool)
                for r, t in enumerate(part):
                    t = t or ""
                    ws = _WORD.findall(t.lower())
                    letters[r] = any(w.isalpha() for w in ws) or any(map(str.isalpha, t))
                    for w in ws:
                        k = known.get(w)
                        if k is None:
                            k = known[w] = len(known)
                            new.append(w)
                        found.append(k)
                    first.append(len(found))
                if new:
                    scores = np.vstack([scores, forward(pieces, prob, ["▁" + w for w in new])])
                    letters_kept += sum(map(len, new))
                total = np.concatenate([np.zeros((1, prob.shape[1])), np.cumsum(scores[np.array(found, np.int64)], axis=0)])
                first = np.array(first)
                doc = total[first[1:]] - total[first[:-1]]
                temper = np.sqrt(np.maximum(1, np.diff(first)))[:, None]
                p = np.exp((doc - doc.max(1, keepdims=True)) / temper)
                p /= p.sum(1, keepdims=True)
                best = doc.argmax(1)
                ok = letters & bool(names)
                lang = [names[b] if k else "und" for b, k in zip(best, ok, strict=True)]
                score = np.where(ok, p[np.arange(len(part)), best], 0.0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, 500) for c in held], pa.array(lang, pa.string()), pa.array(score)],
                                                 [*[batch.schema.names[c] for c in held], "lang_pred", "score"])
    return run


def identify(docs, id_col="doc_id", text_col="text", lang_col="lang", keep=False, model=None):
    """``doc_id, held_out, lang_pred, score`` for every row (``keep``: all columns, and the last two).

    ``und`` with score 0 for a null text, a text without letters, or when nothing
    could be learned. Rows that repeat an id are judged each for itself; a null id
    counts as not held out. Words without letters do not count.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model or fit(docs, id_col, text_col, lang_col))
    if keep:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(_predict(model, list(range(len(docs.columns))), docs.columns.index(text_col)), f"{kinds}, lang_pred string, score double")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"))
    return src.mapInArrow(_predict(model, [0, 2], 1), f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")
