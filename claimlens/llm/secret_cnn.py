"""Secret scan: three base patterns, and a character convolutional network.

Candidates are the base findings and every other long token of key characters with
letters and digits. The network reads a candidate's characters and those around it:
embedding, convolution, maximum over all places of a candidate, logistic output;
plain numpy. It is trained on the values of base findings, their keyword or prefix
masked, against plain words and harmless tokens (words and numbers joined as in URLs
and names); key-like candidates that nothing labels are no examples of either. It is
calibrated; its threshold keeps RECALL of the labelled secrets set aside: half way
from the highest such score down to the next harmless example (0.5 at least).
Candidates above it are added to the base findings, which always stay.
"""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from . import text_arrays as T

#: The kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
#: A superset for whole batches: texts that may hold an assignment (those with AKIA may hold an access key).
MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Other candidates have at least so many characters of the key alphabet.
LEAST = 16
KEY = np.zeros(256, bool)
KEY[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
IS_HEX = np.zeros(256, bool)
IS_HEX[[ord(c) for c in "0123456789abcdef"]] = True
#: What the network reads at once: characters before, of, and after a piece of a candidate.
BEFORE, BODY, AFTER = 20, 44, 8
LENGTH = BEFORE + BODY + AFTER
#: A harmless token: words and short numbers, joined.
_PART = rb"(?:[A-Z]?[a-z]{2,}|[0-9]{1,6})"
HARMLESS = re.compile(rb"[\"'(\[<]*" + _PART + rb"(?:[-_/.:+=]+" + _PART + rb")*[-_/.:+=,;!?)\]>\"']*")
#: Labelled findings of each kind that the network is fitted on, and texts looked at for them
#: (those with the smallest hash of their id).
FIT, FIT_DOCS = 1500, 20_000
#: Pieces of a candidate that an example for the fit holds at most.
FIT_PIECES = 16
RECALL = 0.98
EMBED, FILTERS, WIDTH, EPOCHS, RATE = 8, 24, 5, 6, 0.01


def base_spans(text):
    """(start, end, kind) in bytes, by kind leftmost and non-overlapping."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def _runs(mask, rel, least):
    """(start, end) of runs of a mask of ``least`` bytes or more, cut at row borders."""
    edge = np.empty(len(mask) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    edge[rel] = True
    cut = np.flatnonzero(edge)
    keep = mask[cut[:-1]] & (np.diff(cut) >= least)
    return cut[:-1][keep], cut[1:][keep]


def _parts(batches, at):
    """Record batches in slices of some 2 MB of texts, so that a task's memory does not follow the size of a batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        for i, j in T.blocks(np.concatenate(([0], np.cumsum(size, dtype=np.int64)))):
            yield batch.slice(i, j - i)


def scan(column):
    """Per row of an Arrow string column that has any: (row, text bytes, base spans, other candidates)."""
    raw, off = T.utf8(column)
    filled = column.fill_null("")
    may = pc.or_(pc.match_substring_regex(filled, MAY_ASSIGN), pc.match_substring(filled, "AKIA")).to_numpy(zero_copy_only=False)
    for i, j in T.blocks(off):
        data = raw[off[i]: off[j]]
        rel = (off[i: j + 1] - off[i]).astype(np.int64)
        if not len(data):
            continue
        start, end = _runs(KEY[data], rel, LEAST)
        hs, _ = _runs(IS_HEX[data], rel, 24)
        digit = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
        letter = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
        mixed = (digit[end] > digit[start]) & (letter[end] > letter[start])
        start, end = start[mixed], end[mixed]
        own = np.searchsorted(rel, start, side="right") - 1
        rows = set(own.tolist()) | set((np.searchsorted(rel, hs, side="right") - 1).tolist()) | set(np.flatnonzero(may[i:j]).tolist())
        per = {}
        for r, s, e in zip(own.tolist(), (start - rel[own]).tolist(), (end - rel[own]).tolist(), strict=True):
            per.setdefault(r, []).append((s, e))
        for r in sorted(rows):
            text = data[rel[r]: rel[r + 1]].tobytes()
            base = base_spans(text)
            other = [(s, e) for s, e in per.get(r, []) if not any(s < b and a < e for a, b, _ in base)]
            if base or other:
                yield i + r, text, base, other


def window(text, start, end, blank=0):
    """LENGTH characters around the first piece of a candidate; 0 pads, also the ``blank`` ones before it, bytes beyond ASCII are one class."""
    before = text[max(0, start - BEFORE): start]
    blank = min(blank, len(before))
    w = (before[: len(before) - blank] + b"\0" * blank).rjust(BEFORE, b"\0") + text[start: min(end, start + BODY)].ljust(BODY, b"\0") + text[end if end < start + BODY else start + BODY:][:AFTER].ljust(AFTER, b"\0")
    return np.minimum(np.frombuffer(w, np.uint8), 128)


def windows(text, start, end, blank=0, most=None):
    """Windows of all pieces of a candidate (at most ``most``), one after the other."""
    at = range(start, max(end, start + 1), BODY)[:most]
    return b"".join(window(text[max(0, a - BEFORE): a + BODY + AFTER], min(a, BEFORE), min(a, BEFORE) + min(end - a, BODY), blank if a == start else 0).tobytes() for a in at)


def value_of(text, start, end, kind):
    """(start, end, characters to blank before it): the value of a base finding without its keyword or prefix."""
    if kind == 0:
        m = ASSIGN.match(text, start)
        return m.start(2), m.end(2), m.start(2) - start
    return (start + 4, end, 4) if kind == 1 else (start, end, 0)


def _pieces(found):
    """(windows as rows, number of windows of each candidate) of joined windows."""
    return np.frombuffer(b"".join(found), np.uint8).reshape(-1, LENGTH), np.array([len(w) // LENGTH for w in found], np.int64)


class CharNet:
    """``x`` are windows; ``count`` of them in turn belong to one candidate (one each if not given)."""

    def __init__(self, x, y, count=None, seed=5):
        rng = np.random.default_rng(seed)
        count = np.ones(len(x), np.int64) if count is None else count
        first = np.cumsum(count) - count
        order = rng.permutation(len(count))
        hold, fit = order[: len(count) // 4], order[len(count) // 4:]

        def of(which):
            return x[np.concatenate([np.arange(first[i], first[i] + count[i]) for i in which])], count[which]

        self.w = {"e": rng.normal(0, 0.3, (129, EMBED)), "p": rng.normal(0, 0.3, (LENGTH, EMBED)),
                  "f": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), "fb": np.zeros(FILTERS),
                  "o": rng.normal(0, 0.2, FILTERS), "ob": np.zeros(1)}
        m, s, t = {k: 0 * v for k, v in self.w.items()}, {k: 0 * v for k, v in self.w.items()}, 0
        for _ in range(EPOCHS):
            fit = rng.permutation(fit)
            for i in range(0, len(fit), 64):
                g = self._gradient(*of(fit[i:i + 64]), y[fit[i:i + 64]])
                t += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
        self.temperature, self.threshold = 1.0, 1.0
        target = y[hold]
        if 0 < target.sum() < len(target):
            held = of(hold)
            logit = self.logit(*held)
            grid = np.geomspace(0.3, 5, 40)
            loss = [np.mean(np.logaddexp(0, np.where(target > 0.5, -logit, logit) / g)) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            logit = np.clip(logit / self.temperature, -30, 30)
            good = np.sort(logit[target > 0.5])
            top = good[int((1 - RECALL) * len(good))]
            below = logit[(target < 0.5) & (logit < top)]
            self.threshold = float(1 / (1 + np.exp(-max(0.0, (top + below.max()) / 2 if len(below) else top))))

    def _layers(self, x):
        e = self.w["e"][x] + self.w["p"]
        n = LENGTH - WIDTH + 1
        col = np.concatenate([e[:, k: k + n] for k in range(WIDTH)], axis=2)
        h = np.maximum(col @ self.w["f"] + self.w["fb"], 0)
        top = h.argmax(1)
        return col, top, np.take_along_axis(h, top[:, None], 1)[:, 0]

    def _gradient(self, x, count, y):
        col, top, each = self._layers(x)
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(count)), count)
        best = np.maximum.reduceat(each, first, axis=0)
        err = (1 / (1 + np.exp(-np.clip(best @ self.w["o"] + self.w["ob"], -30, 30))) - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["ob"] = best.T @ err, err.sum(keepdims=True)
        won = (each == best[owner]) * 1.0
        d = (err[:, None] * self.w["o"] * (best > 0) / np.add.reduceat(won, first, axis=0))[owner] * won
        g["fb"] = d.sum(0)
        row = np.arange(len(x))[:, None]
        picked = col[row, top]
        g["f"] = np.einsum("nfc,nf->cf", picked, d)
        back = (d[:, :, None] * self.w["f"].T).reshape(len(x), FILTERS, WIDTH, EMBED)
        for k in range(WIDTH):
            at = top + k
            np.add.at(g["e"], x[row, at], back[:, :, k])
            np.add.at(g["p"], at, back[:, :, k])
        return g

    def logit(self, x, count=None):
        if not len(x):
            return np.zeros(0)
        each = np.concatenate([self._layers(x[i:i + 512])[2] for i in range(0, len(x), 512)])
        best = each if count is None else np.maximum.reduceat(each, np.cumsum(count) - count, axis=0)
        return best @ self.w["o"] + self.w["ob"]

    def score(self, x, count=None):
        return 1 / (1 + np.exp(-np.clip(self.logit(x, count) / self.temperature, -30, 30)))


def _blank(token):
    """Characters to blank before an example without keyword: none, or as many as keywords have."""
    k = zlib.crc32(token)
    return 0 if k % 2 else 4 + k // 2 % 12


def _examples(text, base, other):
    """(windows, label): values of base findings (1); plain words and harmless tokens, also made of the text's words (0).

    Values are also put in the places of words, and words in those of values, so that
    what stands around a finding does not tell the label.
    """
    def put(token, place, label):
        a, b, blank = place
        before = text[max(0, a - BEFORE): a]
        return windows(before + token + text[b: b + AFTER], len(before), len(before) + len(token), blank, FIT_PIECES), label

    taken = [(a, b) for a, b, _ in base]
    harmless = []
    for a, b in other:
        (harmless if HARMLESS.fullmatch(text, a, b) else taken).append((a, b))
    plain = []
    for m in re.finditer(rb"[^\x00-\x20]{5,}", text):
        a, b = m.span()
        short = b - a < LEAST and not re.search(rb"[0-9]", m[0])
        if (short or HARMLESS.fullmatch(m[0])) and not any(a < e and s < b for s, e in taken):
            plain.append((a, b))
    spots = plain[:: max(1, len(plain) // 4)][:4]
    safe = [text[a:b] for a, b in harmless + spots]
    words = [w for w in (text[a:b].strip(b".,;:!?()[]\"'") for a, b in plain[:: max(1, len(plain) // 12)][:12]) if HARMLESS.fullmatch(w)]
    for i in range(0, len(words) - 1, 6):
        k = zlib.crc32(words[i])
        parts = words[i: i + 2 + k % 5]
        parts.insert(k // 8 % (len(parts) + 1), b"%d" % (k // 64 % 10 ** (1 + k // 16 % 6)))
        safe.append(b"-_/"[k % 3: k % 3 + 1].join(parts))
    spots = [(a, b, _blank(text[a:b])) for a, b in harmless + spots]
    for token in safe:
        yield put(token, spots[zlib.crc32(token) % len(spots)], 0)
    for a, b, kind in base:
        s, e, blank = value_of(text, a, b, kind)
        if e == s or kind == 2 and any(j < 2 and c <= a and b <= d for c, d, j in base):
            continue
        place = s, e, blank or _blank(text[s:e])
        yield put(text[s:e], place, 1)
        for spot in spots:
            yield put(text[s:e], spot, 1)
        for token in safe if spots else ():
            yield put(token, place, 0)


def _findings(batches):
    for batch in _parts(batches, 0):
        w, y = [], []
        for _, text, base, other in scan(batch.column(0)):
            for x, label in _examples(text, base, other):
                w.append(x)
                y.append(label)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(y, pa.int32())], ["w", "y"])


def fit(docs, id_col="doc_id", text_col="text", each=FIT, fit_docs=FIT_DOCS):
    """The network, or None where the sample lacks findings of either label."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    n = docs.count()
    if not n:
        return None
    # ids below this hash: about fit_docs of them, at any size of the table
    bound = -(1 << 63) + min(1 << 64, (1 << 64) * fit_docs // n) - 1
    found = docs.filter(order <= bound).select(F.col(text_col).cast("string").alias("t")).mapInArrow(_findings, "w binary, y int")
    rows = []
    for label in (0, 1):
        rows += found.filter(F.col("y") == label).select("w", "y").orderBy(F.xxhash64("w"), "w").limit(each).collect()
    y = np.array([r["y"] for r in rows], float)
    if not 20 <= y.sum() <= len(y) - 20:
        return None
    x, count = _pieces([r["w"] for r in rows])
    return CharNet(x, y, count)


def _scored(column, net, base_too=False):
    """(row, text, base spans, other candidates, scores) of rows with any; scores of the base ones first, if asked for."""
    held = list(scan(column))
    at = [[(*value_of(text, *f),) for f in base] * base_too + [(a, b, 0) for a, b in other] for _, text, base, other in held]
    found = [windows(h[1], *f) for h, fs in zip(held, at, strict=True) for f in fs] if net else []
    score = net.score(*_pieces(found)) if found else np.zeros(sum(map(len, at)))
    k = 0
    for (row, text, base, other), fs in zip(held, at, strict=True):
        yield row, text, base, other, score[k: k + len(fs)]
        k += len(fs)


def _all_spans(column, net):
    """(row, text, spans in bytes with kinds) of rows that have any."""
    for row, text, base, other, score in _scored(column, net):
        spans = base + [(a, b, 3) for (a, b), p in zip(other, score, strict=True) if net and p >= net.threshold]
        if spans:
            yield row, text, sorted(spans, key=lambda s: (s[0], s[2]))


def _points(text, spans):
    """Byte spans as code points."""
    starts = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(starts[a]), int(starts[b]), k) for a, b, k in spans]


def _digests(model):
    def text_of(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def run(batches):
        net = model.value
        empty = hashlib.sha256(b"").hexdigest()
        for batch in _parts(batches, 1):
            n = np.zeros((batch.num_rows, 3), np.int64)
            sha, every = [empty] * batch.num_rows, [""] * batch.num_rows
            for r, text, spans in _all_spans(batch.column(1), net):
                spans = _points(text, spans)
                base = [s for s in spans if s[2] < 3]
                for s in base:
                    n[r, s[2]] += 1
                sha[r], every[r] = hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(n[:, k]) for k in range(3)], pa.array(sha, pa.string()), pa.array(every, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def find_secrets(docs, id_col="doc_id", text_col="text", net=None):
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row.

    Null and empty texts have no spans. Rows that repeat an id are scanned each for
    itself; null ids stay null. Without enough labelled findings only the base
    patterns apply. Other columns are ignored; an empty table gives an empty frame.
    """
    model = docs.sparkSession.sparkContext.broadcast(net or fit(docs, id_col, text_col))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_digests(model), f"doc_id {dict(docs.dtypes)[id_col]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _score_rows(model):
    def run(batches):
        net = model.value
        for batch in _parts(batches, 1):
            rows, spans, scores = [], [], []
            for r, text, base, other, score in _scored(batch.column(1), net, base_too=True):
                every = _points(text, base + [(a, b, 3) for a, b in other])
                rows += [r] * len(every)
                spans += every
                scores += score.tolist() if net else [None] * len(every)
            kept = [k < 3 or net is not None and p >= net.threshold for (_, _, k), p in zip(spans, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([KINDS[k] for _, _, k in spans], pa.string()), pa.array([a for a, _, _ in spans], pa.int64()),
                 pa.array([b for _, b, _ in spans], pa.int64()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())],
                ["doc_id", "kind", "start", "end", "score", "kept"])
    return run


def score_findings(docs, id_col="doc_id", text_col="text", net=None):
    """One row for every candidate, base findings too: ``doc_id, kind, start, end, score, kept``; scores are null without a network."""
    model = docs.sparkSession.sparkContext.broadcast(net or fit(docs, id_col, text_col))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_score_rows(model), f"doc_id {dict(docs.dtypes)[id_col]}, kind string, start long, end long, score double, kept boolean")


def _redacted(model, at, n_chars, mark):
    def run(batches):
        net = model.value
        for batch in _parts(batches, at):
            texts = batch.column(at)
            changed = {}
            for r, text, spans in _all_spans(texts, net):
                out, done = [], 0
                for a, b, _ in spans:
                    if a >= done:
                        out += [text[done:a], mark]
                    done = max(done, b)
                changed[r] = (b"".join(out) + text[done:]).decode("utf-8")
            cols = list(batch.columns)
            if changed:
                new = texts.to_pylist()
                for r, t in changed.items():
                    new[r] = t
                cols[at] = pa.array(new, texts.type)
                if n_chars is not None:
                    n = cols[n_chars].to_pylist()
                    for r, t in changed.items():
                        n[r] = len(t)
                    cols[n_chars] = pa.array(n, cols[n_chars].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)
    return run


def redact(docs, id_col="doc_id", text_col="text", n_chars_col="n_chars", mark="[secret]", net=None):
    """All rows and columns, every span (overlapping ones together) replaced by ``mark``; lengths follow."""
    model = docs.sparkSession.sparkContext.broadcast(net or fit(docs, id_col, text_col))
    at = docs.columns.index(text_col)
    n = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None
    return docs.mapInArrow(_redacted(model, at, n, mark.encode()), docs.schema)
