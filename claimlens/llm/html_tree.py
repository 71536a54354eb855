"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden mark: main text or not. A node's own features
give its potentials, and each parent and child share one by the child's kind. Sums of
products passed from the leaves to the root and back give every node's marginal. The
weights are trained on labelled pages by gradient ascent on the likelihood, whose
gradient needs just these marginals (observed minus expected counts). All pages of a
batch form one forest; messages of one level are passed in one numpy step.
"""

import html as H
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Pages whose html is parsed together, in characters.
BLOCK = 2_000_000
#: Kinds of elements of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript svg template xmp noembed noframes math canvas object audio video select".split())
#: Of these, the text up to the end of the page is not markup if there is no closing tag.
RAW_TEXT = set("script style textarea title iframe xmp noembed noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
ENDS_P = BLOCKS - set("body html tbody td tfoot th thead tr caption option legend summary".split())
GROUPS = ["nav", "header", "footer", "aside", "article main", "section", "h1 h2 h3 h4 h5 h6 hgroup", "p", "li dd dt", "ul ol dl menu dir", "a",
          "table tbody thead tfoot tr td th caption", "blockquote q cite", "pre code samp kbd", "div center", "form button input label fieldset legend option datalist output",
          "figure figcaption picture", "head", "body", "html", "details summary dialog"]
TAG = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
INLINE = len(GROUPS)
#: Words in class, id and role that tell what an element is for, by family; each starts where no letter is before it.
FAMILIES = [r"nav(?!y)|menu|breadcrumb|toolbar|pagination|pager", r"ads?(?![a-z])|adv(?:ert|t)|sponsor|promo|banner|dfp|outbrain|taboola",
            r"(?:user|reader)?comment|disqus|respond(?![a-z])|reply|replies|discussion", r"shar(?:e|ing)(?![a-z])|social|follow(?![a-z])|likes?(?![a-z])",
            r"(?:page|site)?foot(?:er)?(?![a-z])|copyright|colophon|legal|disclaimer|imprint", r"(?:page|site)?head(?:er)?(?![a-z])|masthead|logo|brand|topbar",
            r"(?:left|right)?side(?:bar|nav|menu|col)?(?![a-z])|widget|rail(?![a-z])|complementary", r"notice|cookie|consent|alert|popup|modal|overlay|gdpr|warning|message",
            r"related|recommend|more(?![a-z])|most(?![a-z])|popular|trending|also(?![a-z])|teaser", r"newsletter|subscri|sign-?up|log-?in|search|forms?(?![a-z])",
            r"(?:main)?content(?!s)|article|post(?:s|body|content)?(?![a-z])|entry|story(?![a-z])|main(?![a-z])|body|text(?![a-z])|prose|headline"]
FAMILY = [re.compile(rf"(?<![a-z])(?:{f})") for f in FAMILIES]
CONTENT = INLINE + len(FAMILIES)
N_OWN = INLINE + 1 + len(FAMILIES)
#: Features of the whole subtree: steps of text length, of the share of links, full stops, hidden.
LENGTHS, LINKS = (1, 20, 60, 150, 500), (0.2, 0.5, 0.9)
N_FEATURES = N_OWN + len(LENGTHS) + len(LINKS) + 2 + 1
#: Kinds of edges: an inline child, a block child, a child that the markup names as a part of the page; each once more within an article.
N_EDGES = 6
ROUNDS, RATE, DECAY = 300, 0.05, 2e-3
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|y)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SELF_CLOSED = re.compile(r"(?:^|[\s\"']|(?:^|\s)[^\s=\"'/]+)/$")
_STOP = re.compile(r"[.!?;:,。]")
_SPACE = re.compile(r"\s+")


class Forest:
    """Elements of several pages: parents, levels, features; and their texts in page order."""

    def __init__(self):
        self.parent, self.level, self.own, self.edge, self.length, self.stops, self.link, self.mark, self.within = [], [], [], [], [], [], [], [], []
        self.pieces = []
        self.roots = []
        self._families = {}

    def _node(self, parent, level, tag, attrs):
        k = len(self.parent)
        self.parent.append(parent)
        self.level.append(level)
        own = [TAG.get(tag, INLINE)]
        mark = None
        if attrs:
            if attrs not in self._families:
                words, hidden, y = "", False, None
                for name, value in _ATTR.findall(attrs):
                    name, value = name.lower(), value.strip("\"'").lower()
                    if name in ("class", "id", "role"):
                        words += " " + value
                    elif name == "y":
                        y = value
                    else:
                        hidden |= name == "hidden" or value == "true" or "display:none" in value.replace(" ", "")
                if len(self._families) > 20_000:
                    self._families.clear()
                self._families[attrs] = ([INLINE + 1 + i for i, f in enumerate(FAMILY) if words and f.search(words)] + [N_FEATURES - 1] * hidden, y)
            more, mark = self._families[attrs]
            own += more
        self.own.append(own)
        # an article's parts lie within it; a comment or menu inside does not bring its own
        within = parent >= 0 and self.within[parent]
        self.edge.append((2 if tag in ("nav", "header", "footer", "aside", "form", "head", "section", "article", "main") else 1 if tag in BLOCKS else 0) + 3 * within)
        other = tag in ("nav", "footer", "aside", "form") or any(INLINE < f < CONTENT for f in own)
        self.within.append(not other and (within or tag in ("article", "main") or CONTENT in own))
        self.length.append(0)
        self.stops.append(0)
        self.link.append(0)
        self.mark.append(mark)
        return k

    def add(self, page):
        """Parses one page; its pieces are (node, text) and None between blocks."""
        pieces = []
        self.pieces.append(pieces)
        root = self._node(-1, 0, "html", "")
        self.roots.append(root)
        stack, names, open_names = [root], ["#"], {}
        unclosed = set()

        def text(s):
            if s:
                node = stack[-1]
                s = H.unescape(s) if "&" in s else s
                pieces.append((node, s))
                n = len(s.strip())
                self.length[node] += n
                self.stops[node] += bool(n) and len(_STOP.findall(s))
                if open_names.get("a"):
                    self.link[node] += n

        def close(name):
            while True:
                top = names.pop()
                stack.pop()
                open_names[top] -= 1
                if top in BLOCKS:
                    pieces.append(None)
                if top == name:
                    return

        def implied(group, stop):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in group:
                    return close(names[k])
                if names[k] in stop:
                    return None

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                text(page[at:])
                break
            if m.start() > at:
                text(page[at: m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    text(" ")
                elif tag == "p" and not open_names.get("p"):
                    pieces.append(None)
                elif open_names.get(tag):
                    close(tag)
                continue
            if tag in RAW:
                text(" ")
                if tag in ("svg", "math") and _SELF_CLOSED.search(m[3]):
                    continue
                end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in RAW_TEXT:
                    at = n
                else:
                    unclosed.add(tag)
                continue
            if tag in VOID:
                if tag == "hr":
                    pieces.append(None)
                else:
                    text(" ")
                continue
            if tag in ENDS_P and open_names.get("p"):
                close("p")
            if tag == "li" and open_names.get("li"):
                implied({"li"}, {"ul", "ol", "menu"})
            elif tag in ("dt", "dd"):
                implied({"dt", "dd"}, {"dl"})
            elif tag in ("td", "th"):
                implied({"td", "th"}, {"tr", "table"})
            elif tag == "tr":
                implied({"tr"}, {"table", "tbody", "thead", "tfoot"})
            elif tag == "option" and open_names.get("option"):
                implied({"option"}, {"datalist"})
            elif tag == "body" and open_names.get("head"):
                close("head")
            if tag in BLOCKS:
                pieces.append(None)
            if m[3].endswith("/") and tag not in BLOCKS:
                continue
            stack.append(self._node(stack[-1], self.level[stack[-1]] + 1, tag, m[3].strip()))
            names.append(tag)
            open_names[tag] = open_names.get(tag, 0) + 1

    def arrays(self):
        """Parents, edge kinds, node ranges by level, and the (node, feature) pairs."""
        parent, level = np.array(self.parent), np.array(self.level)
        order = np.argsort(level, kind="stable")
        cut = np.searchsorted(level[order], np.arange(level.max() + 2))
        levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        length, link, stops = (np.array(x, float) for x in (self.length, self.link, self.stops))
        for nodes in levels[:0:-1]:
            for x in (length, link, stops):
                x += np.bincount(parent[nodes], x[nodes], len(x))
        node = np.repeat(np.arange(len(parent)), [len(x) for x in self.own])
        feature = np.concatenate([np.array(x) for x in self.own])
        share = link / np.maximum(length, 1)
        more = [(length >= v, N_OWN + i) for i, v in enumerate(LENGTHS)] + [((share > v) & (length > 0), N_OWN + len(LENGTHS) + i) for i, v in enumerate(LINKS)]
        more += [(stops > 0, N_FEATURES - 3), (stops >= 3, N_FEATURES - 2)]
        for on, f in more:
            k = np.flatnonzero(on)
            node, feature = np.append(node, k), np.append(feature, np.full(len(k), f))
        return parent, np.array(self.edge), levels, node, feature


def marginals(arrays, weights):
    """P(main text) of every node, and P(parent, child marks) of every edge to a parent."""
    parent, edge, levels, node, feature = arrays
    unary, pair = weights
    n = len(parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(node, unary[feature], n)
    up = own.copy()
    message = np.zeros((n, 2))
    for nodes in levels[:0:-1]:
        x = up[nodes][:, None, :] + pair[edge[nodes]]
        message[nodes] = np.logaddexp(x[..., 0], x[..., 1])
        for y in (0, 1):
            up[:, y] += np.bincount(parent[nodes], message[nodes, y], n)
    down = np.zeros((n, 2))
    both = np.zeros((n, 2, 2))
    for nodes in levels[1:]:
        rest = up[parent[nodes]] + down[parent[nodes]] - message[nodes]
        x = rest[:, :, None] + pair[edge[nodes]]
        down[nodes] = np.logaddexp(x[:, 0], x[:, 1])
        joint = x + up[nodes][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        both[nodes] = joint / joint.sum((1, 2), keepdims=True)
    z = up + down
    return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500))), both


def train(pages=None):
    """(unary, pair) weights of labelled pages."""
    if pages is None:
        from .labelled_pages import PAGES as pages
    forest = Forest()
    for p in pages:
        forest.add(p)
    arrays = forest.arrays()
    parent, edge, levels, node, feature = arrays
    y = np.zeros(len(parent))
    for nodes in levels:
        for k in nodes:
            m = forest.mark[k]
            y[k] = float(m) if m in ("0", "1") else (y[parent[k]] if parent[k] >= 0 else 1.0)
    seen = np.zeros((len(parent), 2, 2))
    child = parent >= 0
    seen[child, y[parent[child]].astype(int), y[child].astype(int)] = 1
    unary, pair = np.zeros(N_FEATURES), np.zeros((N_EDGES, 2, 2))
    m = [np.zeros_like(unary), np.zeros_like(pair)]
    v = [np.zeros_like(unary), np.zeros_like(pair)]
    for t in range(1, ROUNDS + 1):
        p, both = marginals(arrays, (unary, pair))
        g1 = np.bincount(feature, (y - p)[node], N_FEATURES) / len(pages) - DECAY * unary
        g2 = np.stack([(seen - both)[child & (edge == e)].sum(0) for e in range(N_EDGES)]) / len(pages) - DECAY * pair
        for i, (w, g) in enumerate(((unary, g1), (pair, g2))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            w += RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.99 ** t)) + 1e-8)
    return unary, pair


def texts(pages, weights):
    """Main text of each page."""
    forest = Forest()
    for p in pages:
        forest.add(p)
    keep = marginals(forest.arrays(), weights)[0] >= 0.5
    head = TAG["head"]
    out = []
    for pieces in forest.pieces:
        blocks, now = [], []
        for x in [*pieces, None]:
            if x is None:
                if now:
                    s = _SPACE.sub(" ", "".join(now)).strip()
                    if s:
                        blocks.append(s)
                    now = []
            elif keep[x[0]] and forest.own[x[0]][0] != head:
                now.append(x[1])
        out.append("\n".join(blocks))
    return out


def _extract(model, html_at):
    def run(batches):
        weights = model.value
        for batch in batches:
            pages = [p or "" for p in batch.column(html_at).to_pylist()]
            out, i = [], 0
            while i < len(pages):
                j, size = i, 0
                while j < len(pages) and (j == i or size + len(pages[j]) <= BLOCK):
                    size += len(pages[j])
                    j += 1
                out += texts(pages[i:j], weights)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return run


def main_texts(pages, id_col="page_id", url_col="url", html_col="html", weights=None):
    """``page_id, url, text, n_chars`` for every row.

    Null, empty and textless pages have an empty text. Rows that repeat an id or have
    none are read each for itself. Other columns are ignored; empty in, empty out.
    """
    model = pages.sparkSession.sparkContext.broadcast(weights or train())
    kinds = dict(pages.dtypes)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract(model, 2), f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
