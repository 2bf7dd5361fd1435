"""Operator 13: main texts of web pages by wrapper induction.

Of each host a few pages (SAMPLE, those of the smallest hashes) are folded to a template by
simple tree matching: what a page has beyond the template is added where it stands.  Then
every page of the host is aligned with the template, again by simple tree matching, and each
of its texts gets the slot it stands in as its key; a text outside the template gets the path
to it.  Spark counts in how many different pages a slot has which text, over all pages: a
text that most of them have is part of the template, all others make the slot vary.

A page's main text is what varies inside its article or main element, without elements that
say of themselves (by name, class, id or role) that they are menus, footers, adverts, notices,
forms, comments and the like.  Where there is no such element it is the smallest container
that holds most of the varying text of the host's pages, without blocks that are mostly links.
Long constant texts of an article stay, and all of one that is constant in good part: near
copies of a page share them.

White space is what Unicode says.  Null html is empty and has an empty text; a page whose url
has no host is extracted without a template.  Equal pages of a host count once, so copies make
nothing constant.  Repeated rows are rows of their own with equal texts; there are no ties but
hashes of equal pages.  Very long pages are read whole.  An empty table gives an empty table;
extra columns are ignored.  A host of very many pages is never in one task: its template is
sent to its pages, and counts are summed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dom
from .common import arrow_map, keeps, need, pick_rows, split_join, table

#: Pages of a host that its template is folded from; different pages at least, and share of
#: them, that make a text constant; characters from which an article's constant text stays,
#: and the share of an article's characters beyond which its constant texts are those of a
#: family of near copies and not of the template.
SAMPLE, PAGES, SHARE, LONG, FAMILY = 8, 8, 0.8, 80, 0.2
#: Share of a page's varying text that a container must hold to stand for it.
MOST = 0.8
#: Bytes of templates that are sent to every task; more are shuffled to the pages.
SENT = 64 << 20
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

_templates: dict[str, dom.Slot] = {}
keeps(__name__, _templates.clear)


def _template(text: str | None) -> dom.Slot | None:
    if text is None:
        return None
    if text not in _templates:
        if len(_templates) >= 256:
            _templates.clear()
        _templates[text] = dom.read_template(text)
    return _templates[text]


def _code(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def attach(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """Pages with what is known of their hosts (a written table with ``weight``, the pages of
    a host, and ``bytes``): sent to every task up to SENT bytes, which are summed first, and
    joined by host beyond that, hosts of very many pages apart."""
    if (facts.agg(F.sum("bytes")).first()[0] or 0) <= SENT:
        return pages.join(F.broadcast(facts.drop("weight", "bytes")), "host", "left")
    return split_join(pages, facts.drop("bytes"), ["host"], "weight", "left")


def templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """host, template, weight, bytes."""
    some = pages.where("host <> '' and html is not null").withColumn("h", F.xxhash64("html"))
    counted = some.groupBy("host", "h").agg(F.count("*").alias("n"))
    weights = counted.groupBy("host").agg(F.sum("n").alias("weight"))
    first = Window.partitionBy("host").orderBy("h")
    chosen = table(spark, counted.select("host", "h").withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).drop("r"), "chosen")
    found = pick_rows(some, chosen, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.first("html").alias("html"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([dom.induce(held)])], names=["host", "template"])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if host != now:
                    if held:
                        yield made()
                    now, held = host, []
                held.append(html)
        if held:
            yield made()

    folded = found.repartition("host").sortWithinPartitions("host", "h").select("host", "html").mapInArrow(fold, "host string, template string")
    return table(spark, folded.join(weights, "host").withColumn("bytes", F.length("template").cast("long")), "templates")


def slots(known: DataFrame) -> DataFrame:
    """pages with templates -> (host, key, code of a text, page, chars), each once a page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: tuple[list, ...] = ([], [], [], [], [])
        for host, html, template in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "template")], strict=True):
            _, found = dom.texts(html, _template(template))
            page = _code("\n".join(t.text for t in found))
            chars: dict[tuple[str, int], int] = {}
            for t in found:
                if not t.dropped:
                    chars.setdefault((t.key, _code(t.text)), len(t.text) - t.links)
            for (key, code), n in chars.items():
                for column, v in zip(out, (host, key, code, page, n), strict=True):
                    column.append(v)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "key", "code", "page", "chars"])

    return arrow_map(known.select("host", "html", "template"), work, "host string, key string, code long, page long, chars long", "html")


def wrappers(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """host, template, constants (key and code), masses (mean characters of a slot, by key)."""
    made = templates(spark, pages)
    known = attach(pages.where("host <> '' and html is not null"), made)
    each = table(spark, slots(known).groupBy("host", "key", "code", "page").agg(F.max("chars").alias("chars")), "slots")
    per_page = each.groupBy("host", "key", "page").agg(F.sum("chars").alias("chars"))
    keys = per_page.groupBy("host", "key").agg(F.count("*").alias("pages"), F.avg("chars").alias("mass")).where(F.col("pages") >= PAGES)
    often = each.groupBy("host", "key", "code").agg(F.count("*").alias("n"), F.max("chars").alias("chars")).where(F.col("n") >= PAGES)
    constant = keys.join(often, ["host", "key"], "left").where(F.col("n") >= SHARE * F.col("pages"))
    constants = constant.groupBy("host").agg(F.collect_list(F.struct("key", "code")).alias("constants"))
    still = constant.groupBy("host", "key").agg(F.sum(F.col("chars") * F.col("n") / F.col("pages")).alias("still"))
    masses = keys.join(still, ["host", "key"], "left").groupBy("host").agg(F.collect_list(F.struct("key", F.greatest(F.lit(0.0), F.col("mass") - F.coalesce("still", F.lit(0.0))).alias("mass"))).alias("masses"))
    both = made.join(constants, "host", "left").join(masses, "host", "left")
    # A few dozen bytes for each slot, of which there are at most as many as a host's pages share.
    size = F.col("bytes") + 64 * (F.coalesce(F.size("constants"), F.lit(0)) + F.coalesce(F.size("masses"), F.lit(0)))
    return table(spark, both.withColumn("bytes", size.cast("long")), "wrappers")


def main_text(html: str, template: dom.Slot | None = None, constants: frozenset = frozenset(), masses: dict[str, float] | None = None) -> str:
    """The main text of a page by its host's wrapper."""
    root, found = dom.texts(html, template)
    masses = masses or {}
    inside = [t for t in found if t.article and not t.dropped]
    still = lambda t: bool(constants) and (t.key, _code(t.text)) in constants
    if inside:
        same = {id(t) for t in inside if still(t)}
        if sum(len(t.text) for t in inside if id(t) in same) > FAMILY * sum(len(t.text) for t in inside):
            same = set()
        return " ".join(t.text for t in inside if id(t) not in same or len(t.text) >= LONG and t.links * 2 < len(t.text))
    varies = [t for t in found if not t.dropped and not still(t) and t.links * 2 <= len(t.text)]
    weight: dict[int, float] = {}
    for t in varies:
        own, node = masses.get(t.key, len(t.text)), t.node
        while node is not None:
            weight[id(node)] = weight.get(id(node), 0) + own
            node = node.parent
    node = root
    while True:
        below = [k for k in node.kids if type(k) is dom.Node and k.tag in dom.CONTAINERS]
        best = max(below, key=lambda k: weight.get(id(k), 0), default=None)
        held = sum(weight.get(id(k), 0) for k in below)
        # Varying text that stands in an element itself, or in its paragraphs, stops the descent.
        if best is None or not weight.get(id(best), 0) or held < weight[id(node)] * (1 - 1e-9) or weight[id(best)] < MOST * weight[id(root)]:
            break
        node = best

    def within(n: dom.Node | None) -> bool:
        while n is not None and n is not node:
            n = n.parent
        return n is not None

    return " ".join(t.text for t in varies if t.node.tag == "h1" or within(t.node))


def extract(spark: SparkSession, df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    pages = need(df, "page_id", "url", "html").withColumn("host", host)
    known = attach(pages, wrappers(spark, pages)).select("page_id", "url", "host", "html", "template", "constants", "masses")
    seen: dict[str, tuple] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        template, constants, masses = (batch.column(c) for c in ("template", "constants", "masses"))
        for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host not in seen:
                if len(seen) >= 256:
                    seen.clear()
                seen[host] = (_template(template[k].as_py()), frozenset((c["key"], c["code"]) for c in constants[k].as_py() or []), {m["key"]: m["mass"] for m in masses[k].as_py() or []})
            out.append(main_text(html or "", *seen[host]))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(known, work, f"page_id {df.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long", "html")
