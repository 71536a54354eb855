"""HTML documents to page text.

Parsing needs a tokenizer, so this step runs in Python on Arrow batches; it maps
rows one by one, so Spark spreads it freely and nothing is shuffled. Cutting and
filtering of the resulting text are ordinary expressions.
"""

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from claimlens.functions import fixed_values as fv
from claimlens.functions.arrays import let
from claimlens.functions.codes import as_col
from claimlens.functions.text import strip, truncate

_UNSEEN = ("script", "style")


class _TextNodes(HTMLParser):
    """Text nodes outside script and style; any markup between two texts parts them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open_node, self.unseen = [], False, 0

    def handle_data(self, data):
        if self.unseen or not data:
            return
        if self.open_node:
            self.nodes[-1] += data
        else:
            self.nodes.append(data)
            self.open_node = True

    def handle_starttag(self, tag, attrs):
        self.open_node = False
        self.unseen += tag in _UNSEEN

    def handle_endtag(self, tag):
        self.open_node = False
        if tag in _UNSEEN and self.unseen:
            self.unseen -= 1

    def handle_startendtag(self, tag, attrs):
        self.open_node = False

    def _markup(self, *_):
        self.open_node = False

    handle_comment = handle_decl = handle_pi = unknown_decl = _markup


def _decode(raw):
    """Bytes to text: UTF-8 when valid, else Windows-1252, else Latin-1."""
    if raw is None or isinstance(raw, str):
        return raw
    for enc in ("utf-8", "cp1252"):
        try:
            return bytes(raw).decode(enc)
        except UnicodeDecodeError:
            continue
    return bytes(raw).decode("latin-1")


def _nodes(raw):
    text = _decode(raw)
    if text is None:
        return None
    p = _TextNodes()
    p.feed(text)
    p.close()
    return "\n".join(p.nodes)


def _parse(s: pd.Series) -> pd.Series:
    return s.map(_nodes)


def _html_text(html):
    """The parser as a UDF. Marked as not deterministic to keep filters above it:
    pushed below, they would parse every document a second time."""
    return F.pandas_udf(_parse, "string").asNondeterministic()(html)


def html_text(html, max_chars=None):
    """Visible text: nodes on lines of their own, at most one blank line in a row.

    Whole texts by default; ``max_chars`` cuts longer ones and adds a marker.
    """
    text = strip(F.regexp_replace(_html_text(as_col(html)), r"\n{3,}", "\n\n"))
    if max_chars is None:
        return text
    return let(text, lambda t: truncate(t, max_chars, fv.HTML_CAP_MARKER))


def html_pages(df, html="html", max_chars=None):
    """Rows with a one-page ``pages`` array; documents under 50 characters drop out."""
    out = df.withColumn("_t", html_text(html, max_chars)).where(F.length("_t") >= fv.MIN_DOCUMENT_CHARS)
    return out.withColumn("pages", F.array(F.struct(F.lit(1).alias("pagina"), F.col("_t").alias("texto")))).drop("_t")
