"""HTML extraction by consensus host paths.

Pages of one host share templates, so the place of the article is decided per host, not per
page. Every page scores its containers (text that is not links, shared with the outer
ones) and votes for the generalised path of its best one: tags with their classes, digits
taken out. Spark counts per host and path the votes and the pages that have text there; a path
that at least half of its pages voted for wins. Each page is then read again and its text
taken from the containers on all winning paths it has, each widened to the article around
it; a page no winner fits keeps its own choice. So a box that is the longest part of one
page does not win where the host's other pages have the same box and voted otherwise, and
an article in several containers is whole if each is the article of most of its pages, or
if they stand in one article element.

Every voted path counts, however many a host has. Pages are grouped by host and template
(the hash of the set of paths with text); a template carries its paths, and they meet the
host's counts in a join. So a page is sent the winners among its own paths only, and a
host of many templates makes no row longer. The votes are summed before the exchange, so a
host with a third of all pages costs one row per task and template. The winners are
written; where the table is small by its size on disk Spark sends it to all tasks, else it
is joined by host and template, with large ones split by adaptive execution.

Defined results: null or empty html gives an empty text; a url without a host, or none,
falls under the empty host; repeated page_ids are extracted each by itself; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from henhouse.llm import html_pages
from henhouse.llm.common import written

def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _template(paths: set[str]) -> int:
    return int.from_bytes(blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            best, paths = html_pages.ballot(p)
            if best:
                votes[h, tuple(sorted(paths)), best] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _, _ in votes], pa.string()), pa.array([_template(set(p)) for _, p, _ in votes], pa.int64()),
             pa.array([list(p) for _, p, _ in votes], pa.list_(pa.string())), pa.array([b for _, _, b in votes], pa.string()),
             pa.array(votes.values(), pa.int64())], ["host", "template", "paths", "best", "votes"])


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_template(html_pages.ballot(p)[1]) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "template"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [html_pages.extract(p, paths or []) for p, paths in
                 zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64()), batch.column("host")],
            ["page_id", "url", "text", "n_chars", "host"])


def winners(pages: DataFrame) -> DataFrame:
    """(host, template, paths): the winning paths among those of each template of a host.
    ``pages`` has host and html."""
    votes = written(pages.select("host", "html").mapInArrow(
        _votes, "host string, template long, paths array<string>, best string, votes long")
        .groupBy("host", "template", "paths", "best").agg(F.sum("votes").alias("votes")), "template-votes")
    won = (votes.select("host", "template", F.explode("paths").alias("path"), "best", "votes").groupBy("host", "path")
           .agg(F.sum("votes").alias("seen"), F.sum(F.when(F.col("path") == F.col("best"), F.col("votes"))).alias("won"))
           .filter(F.col("won") * 2 >= F.col("seen")).select("host", "path"))
    own = votes.select("host", "template", F.explode("paths").alias("path")).distinct()
    return own.join(won, ["host", "path"]).groupBy("host", "template").agg(F.collect_list("path").alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, host."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"),
                        F.coalesce("html", F.lit("")).alias("html"))
    best = written(winners(rows), "host-paths")
    return (rows.mapInArrow(_templates, "page_id long, url string, host string, html string, template long")
            .join(best, ["host", "template"], "left").select("page_id", "url", "host", "html", "paths").mapInArrow(
                _texts, "page_id long, url string, text string, n_chars long, host string"))
