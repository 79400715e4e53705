"""Stored web pages as interval-encoded elements.

``with_nodes`` adds two array columns to a table of pages:

``nodes``    one struct per element in document order; ``pos`` is its number,
             ``last`` the number of its last descendant, ``t0``/``t1`` the half
             open range of its strings in ``strings``
``strings``  the page's visible strings, stripped, blank ones left out

Headings also carry ``raw``, their text with its white space as written.

"a contains b" is ``a.pos < b.pos <= a.last``, and an element's text is a slice
of ``strings``.  Every extraction rule is then an expression inside one row: a
page is never exploded, shuffled or put together again.

The tree follows the tag soup rules of a plain event parser: an end tag closes
back to its matching start tag, an end tag without one is ignored, and nothing
is closed implicitly.  Unclosed paragraphs therefore enclose what follows them.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.sources.scratch import bound_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2"))
HIDDEN = frozenset(("script", "style", "template"))
ATTRIBUTES = ("id", "href", "content", "property", "name", "style", "datetime", "dc_data")

NODE_TYPE = "struct<" + ",".join(
    ["pos:int", "last:int", "t0:int", "t1:int", "tag:string", "cls:array<string>", "raw:string"]
    + [f"{a}:string" for a in ATTRIBUTES]
) + ">"
_ARROW_NODES = pa.list_(
    pa.struct(
        [(n, pa.int32()) for n in ("pos", "last", "t0", "t1")]
        + [("tag", pa.string()), ("cls", pa.list_(pa.string())), ("raw", pa.string())]
        + [(a, pa.string()) for a in ATTRIBUTES]
    )
)


class _Shredder(HTMLParser):
    """Collects elements and strings of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.strings: list[str] = []
        self.open: list[dict] = []
        self.pending: list[str] = []

    def _flush(self) -> None:
        if self.pending:
            raw = "".join(self.pending)
            self.pending.clear()
            if self.open and self.open[-1]["tag"] in HIDDEN:
                return
            for heading in self.open:
                if heading["tag"] in HEADINGS:
                    heading["raw"] += raw
            if raw.strip():
                self.strings.append(raw.strip())

    def handle_starttag(self, tag, attrs) -> None:
        self._flush()
        given = {}
        for k, v in attrs:
            given[k] = v or ""
        node = {a: given.get(a) for a in ATTRIBUTES}
        node["pos"] = node["last"] = len(self.nodes)
        node["t0"] = node["t1"] = len(self.strings)
        node["tag"], node["cls"] = tag, given.get("class", "").split()
        node["raw"] = "" if tag in HEADINGS else None
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        self._flush()
        if any(n["tag"] == tag for n in self.open):
            while True:
                node = self.open.pop()
                node["last"], node["t1"] = len(self.nodes) - 1, len(self.strings)
                if node["tag"] == tag:
                    break

    def handle_data(self, data) -> None:
        self.pending.append(data)

    def handle_comment(self, data) -> None:
        self._flush()

    def finish(self) -> tuple[list[dict], list[str]]:
        self.close()
        self._flush()
        for node in self.open:
            node["last"], node["t1"] = len(self.nodes) - 1, len(self.strings)
        return self.nodes, self.strings


def shred(html: str | None) -> tuple[list[dict], list[str]]:
    parser = _Shredder()
    parser.feed(html or "")
    return parser.finish()


#: Bytes of page source turned into elements at once inside a task (as objects they take some twenty times that).
SHREDDED_BYTES = 1 << 20


def _cuts(batches: Iterator[pa.RecordBatch], html_col: str) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a megabyte of page source, a page at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(html_col)).fill_null(0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > SHREDDED_BYTES:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if batch.num_rows:
            yield batch.slice(start)


def _shred_batches(html_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cuts(batches, html_col):
            pages = [shred(h) for h in batch.column(html_col).to_pylist()]
            kept = [(f.name, batch.column(f.name)) for f in batch.schema if f.name != html_col]
            yield pa.RecordBatch.from_arrays(
                [c for _, c in kept]
                + [
                    pa.array([n for n, _ in pages], type=_ARROW_NODES),
                    pa.array([s for _, s in pages], type=pa.list_(pa.string())),
                ],
                names=[n for n, _ in kept] + ["nodes", "strings"],
            )

    return run


def with_nodes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Replace the page source by its elements and strings."""
    bound_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name != html_col]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + [f"nodes array<{NODE_TYPE}>", "strings array<string>"]
    )
    return pages.mapInArrow(_shred_batches(html_col), schema)


def page_blocks(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """One row per element: place, tag, id, classes and its text."""
    n = F.col("n")
    return (
        with_nodes(pages.select(id_col, html_col), html_col)
        .select(id_col, "strings", F.explode("nodes").alias("n"))
        .select(
            id_col,
            n.pos.alias("pos"),
            n.last.alias("last"),
            n.tag.alias("tag"),
            F.coalesce(n.id, F.lit("")).alias("element_id"),
            F.array_join(n.cls, " ").alias("classes"),
            F.array_join(F.slice("strings", n.t0 + 1, n.t1 - n.t0), " ").alias("text"),
        )
    )
