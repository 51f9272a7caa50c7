"""Media columns: interleaved sequences of text and media references, with payloads resolved by digest.

A document is HTML. Parsing gives its ordered segments: text, or a reference to a stored medium by the
SHA-256 of its stored form, with the caption. A store is a table (digest, media). References are joined
to it by digest, and what they find is put back into the sequence by digest too, so segments keep
their position and caption and no page is lost, merged or reordered.

A payload is stored as an 8-bit grey image (binary PGM) of 64 samples a row, its byte count before
padding in a comment line. The form is lossless and self-describing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_map, as_bytes, checkpoint_folder, cut, slices

WIDTH = 64
SCHEME = "sha256:"
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_TAGS = {"img", "audio", "video", "source", "embed"}
_BLOCKS = {"p", "div", "section", "article", "figure", "figcaption", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "body", "title"}
_SILENT = {"script", "style"}


def store_bytes(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of 64, as a PGM image."""
    rows = max(1, -(-len(data) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(data), WIDTH, rows) + data + bytes(rows * WIDTH - len(data))


def load_bytes(media: bytes) -> tuple[int, np.ndarray]:
    """The unpadded byte count and the samples of a stored image."""
    magic, note, shape, depth, samples = media.split(b"\n", 4)
    width, rows = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * rows:
        raise ValueError("not a stored payload")
    return int(note.rsplit(b" ", 1)[1]), np.frombuffer(samples, np.uint8)


def feature_of(samples: np.ndarray) -> str:
    """Mean, standard deviation, least, greatest and number of different samples."""
    counts = np.bincount(samples, minlength=256)
    levels = np.flatnonzero(counts)
    n, total, squares = len(samples), int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    mean = total / n
    return f"{mean:.6f} {max(squares / n - mean * mean, 0.0) ** 0.5:.6f} {levels[0]} {levels[-1]} {len(levels)}"


class _Segments(HTMLParser):
    """Collects segments. The caption of a reference is its figure's figcaption, else its alt or title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SILENT:
            self.silent += 1
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in _TAGS:
            own = dict(attrs)
            if (own.get("src") or "").startswith(SCHEME):
                self.flush()
                ref = {"kind": "media", "text": None, "digest": own["src"][len(SCHEME) :], "caption": own.get("alt") or own.get("title")}
                self.out.append(ref)
                if self.figure is not None:
                    self.figure.append(ref)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for ref in self.figure or []:
                ref["caption"] = caption or ref["caption"]
            self.caption = None
        if tag == "figure":
            self.figure = None
        if tag in _BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def segments_of(html: str | None) -> list[dict]:
    parser = _Segments()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i} | s for i, s in enumerate(parser.out)]


def parse_documents(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """One row for each page: the id and ``segments`` in document order. Null or empty HTML has none; broken
    HTML is read as far as it can be; a reference without the digest scheme is not a segment. Repeated rows are
    parsed each; an empty table gives none."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = pa.list_(pa.struct([("position", pa.int32()), *[(k, pa.string()) for k in ("kind", "text", "digest", "caption")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [segments_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "segments"])

    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, segments {SEGMENTS}").withColumnRenamed("id", id_col)


def publish_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Stores each text's UTF-8 as a medium and writes a page that refers to it: the tables (id, html) and (digest, media).

    Both are read back from one Parquet table in ``folder``, by default a new one below the session's checkpoint
    folder. A task stores a medium where it first meets it, so a text is stored once a task at most, however
    many rows repeat it, and no text is shuffled. A null text is stored as an empty payload, which is 64 zeros.
    Every row has a page, repeated rows too; an empty table gives two empty ones.
    """
    folder = folder or f"{checkpoint_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        known: set[bytes] = set()
        for batch in slices(batches):
            stored = [store_bytes(x or b"") for x in as_bytes(batch.column(1))]
            digests = [hashlib.sha256(x) for x in stored]
            new = []
            for d in digests:
                new.append(d.digest() not in known)
                known.add(d.digest())
            html = [
                f'<article><p>{escape(str(i))}</p><figure><img src="{SCHEME}{d.hexdigest()}" alt="payload"><figcaption>{len(s)} bytes of {escape(str(i))}</figcaption></figure></article>'
                for i, d, s in zip(batch.column(0).to_pylist(), digests, stored)
            ]
            media = [x if first else None for x, first in zip(stored, new)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html), pa.array([d.hexdigest() for d in digests]), pa.array(media, pa.binary())], names=["id", "html", "digest", "media"])

    out = arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, html string, digest string, media binary")
    out.write.option("compression", "zstd").parquet(folder)
    held = docs.sparkSession.read.schema(out.schema).parquet(folder)
    return held.select(F.col("id").alias(id_col), "html"), held.filter(F.col("media").isNotNull()).select("digest", "media")


def load_media(store: DataFrame) -> DataFrame:
    """Decodes (digest, media): adds ``n_bytes`` (unpadded), ``payload`` and ``feature``. A null medium gives nulls.
    Repeated rows are decoded each; ``one_a_digest`` collapses them."""
    rows = store.select("digest", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, payloads, features = [], [], []
            for media in batch.column(1).to_pylist():
                n, samples = (None, None) if media is None else load_bytes(media)
                sizes.append(n)
                payloads.append(None if media is None else samples.tobytes())
                features.append(None if media is None else feature_of(samples))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=["digest", "media", "n_bytes", "payload", "feature"])

    return arrow_map(rows, run, "digest string, media binary, n_bytes long, payload binary, feature string")


def one_a_digest(store: DataFrame) -> DataFrame:
    """A row for each digest of ``store``, computed and kept. Rows of one digest hold equal columns, but for nulls of
    media that could not be read; select the columns that are wanted first, since only those are shuffled."""
    found = [c for c in store.columns if c != "digest"]
    return cut(store.groupBy("digest").agg(*[F.max(c).alias(c) for c in found]))


def interleave(parsed: DataFrame, store: DataFrame, id_col: str) -> DataFrame:
    """Resolves references and puts what they find into the sequences: a row for each row of ``parsed``, with
    ``segments`` in order, each with a ``media`` struct of the other columns of ``store`` (see ``one_a_digest``).

    ``media`` is null for text and for a digest that the store lacks. A page that repeats, has a null id or has no
    segment keeps all its rows. A page of one digest meets its medium by that; a page of several meets a map of them,
    made once for all pages of the same list of digests. Both are sort-merge joins whatever the sizes, in which a hot
    digest can be split; pages without references are not joined.
    """
    held = [c for c in store.columns if c != "digest"]
    media = store.select(F.unhex("digest").alias("key"), F.struct(*held).alias("media"))
    digests = F.array_distinct(F.filter(F.transform("segments", lambda s: s["digest"]), lambda d: d.isNotNull()))
    n = F.size(digests)
    key = F.when(n == 1, F.unhex(F.get(digests, F.lit(0)))).when(n > 1, F.unhex(F.sha2(F.array_join(digests, " "), 256)))
    pages = parsed.select(F.col(id_col).alias("id"), "segments", key.alias("key"), n.alias("n"))
    wanted = pages.filter("n > 1").select(F.col("key").alias("page"), F.explode(digests).alias("digest")).distinct()
    found = wanted.withColumn("key", F.unhex("digest")).join(media.hint("merge"), "key")
    maps = found.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("digest", "media"))).alias("found")).withColumnRenamed("page", "key")

    def put(rows: DataFrame, of) -> DataFrame:
        fields = lambda s: F.struct(*[s[c].alias(c) for c in ("position", "kind", "text", "digest", "caption")], of(s).alias("media"))
        return rows.select(F.col("id").alias(id_col), F.transform("segments", fields).alias("segments"))

    none = F.lit(None).cast(media.schema["media"].dataType)
    one = put(pages.filter("n = 1").join(media.hint("merge"), "key", "left"), lambda s: F.when(s["digest"].isNotNull(), F.col("media")))
    several = put(pages.filter("n > 1").join(maps.hint("merge"), "key", "left"), lambda s: F.when(s["digest"].isNotNull() & F.col("found").isNotNull(), F.try_element_at("found", s["digest"])))
    return put(pages.filter("n = 0"), lambda s: none).unionByName(one).unionByName(several)
