"""Media columns: interleaved document sequences.

HTML is parsed into ordered structs of text and media references, a
content-addressed store holds the payloads, and a join on the digest resolves
each reference while its position and caption stay beside it.

Payloads are kept as binary greymaps (PGM, 64 samples a row, 8 bits each), a
lossless form whose header is plain text. A document becomes a page of its own
paragraphs, with its payload as a figure between them.

Edge cases: null text or HTML is empty; an empty payload is one row of zero
bytes; repeated payloads share one digest and one entry of the resolved table;
references that the store lacks stay, with null payload columns; extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_rows, write_table

WIDTH = 64
SCHEME = "media:"
ITEMS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"


class _Interleave(HTMLParser):
    """Collects text runs and images in reading order; a figure's caption goes to its image."""

    SKIP = frozenset(("script", "style", "template", "noscript"))
    BLOCK = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol br table tr td th figure figcaption nav header footer blockquote pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None  # text of the open caption
        self.inside = False  # a figure is open
        self.figure: int | None = None  # its image
        self.early: str | None = None  # its caption, where that comes first

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            a = dict(attrs)
            src = a.get("src") or ""
            if src:
                self.flush()
                if self.inside:
                    self.figure = len(self.items)
                digest = src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode()).hexdigest()
                self.items.append({"pos": len(self.items), "kind": "media", "text": None, "digest": digest, "caption": self.early or a.get("alt")})
                self.early = None
        elif tag in self.BLOCK:
            self.flush()
            if tag == "figure":
                self.inside, self.figure, self.early = True, None, None

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            if self.figure is not None:
                self.items[self.figure]["caption"] = text
            elif self.inside:
                self.early = text
            elif text:
                self.run.append(text)
                self.flush()
        elif tag in self.BLOCK:
            if tag == "figure":
                self.run += [self.early or ""] if self.figure is None else []
                self.inside, self.figure, self.early = False, None, None
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def interleave(html: str | None) -> list[dict]:
    """Ordered text and media structs of one page."""
    p = _Interleave()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def parse_interleaved(pages: DataFrame, id_col: str, html_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried numbers, items): one row per page with its ordered structs of text and media references."""
    kept = [F.col(c).cast("long") for c in carry]

    def make():
        return lambda ids, pages_, *rest: [(i, *x, interleave(h)) for i, h, *x in zip(ids, pages_, *rest, strict=True)]

    schema = ", ".join([f"{id_col} long", *[f"{c} long" for c in carry], f"items {ITEMS}"])
    return map_rows(pages.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col).cast("string"), *kept), schema, make)


def payload(text: Column) -> Column:
    """UTF-8 bytes with bytes 0 appended up to a positive multiple of the row width."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.greatest(F.lit(WIDTH), F.ceil(n / WIDTH).cast("int") * WIDTH) - n
    return F.concat(raw, F.repeat(F.lit("\0"), pad).cast("binary"))


def greymap(samples: Column) -> Column:
    """A binary greymap of the samples, a row of WIDTH for each line."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(samples) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), samples)


def ungreymap(media: bytes) -> bytes:
    """The samples of a binary greymap; its header is checked."""
    kind, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not a greymap as stored")
    return samples


def write_store(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A content-addressed store (digest, media): each row's payload as a greymap, in the shared folder.

    Writes go where the rows are, without a shuffle of payloads; a digest may
    be written by several tasks and counts once on reading.
    """
    samples = texts.select(payload(F.col(text_col)).alias("samples"))
    return write_table(samples.select(F.sha2("samples", 256).alias("digest"), greymap(F.col("samples")).alias("media")), "media")


def features(samples: bytes) -> str:
    """rows:mean:entropy:average hash of an 8 x 8 thumbnail, from the samples as read back."""
    a = np.frombuffer(samples, np.uint8)
    p = np.bincount(a, minlength=256)
    p = p[p > 0] / len(a)
    grid = a.reshape(-1, WIDTH // 8, 8).mean(axis=2)
    cuts = np.linspace(0, len(grid), 9).astype(int)
    thumb = np.array([grid[min(s, len(grid) - 1) : max(e, s + 1)].mean(axis=0) for s, e in zip(cuts, cuts[1:], strict=False)])
    bits = np.packbits((thumb > thumb.mean()).ravel()).tobytes().hex()
    return f"{len(grid)}:{a.mean():.4f}:{-(p * np.log2(p)).sum():.4f}:{bits}"


def read_store(store: DataFrame) -> DataFrame:
    """One row per digest with figures of the payload as decoded from the stored bytes."""

    def make():
        seen: dict[str, tuple] = {}

        def f(digests, medias):
            rows = []
            for digest, media in zip(digests, medias, strict=True):
                if digest not in seen:
                    samples = ungreymap(media)
                    if len(seen) >= 50_000:
                        seen.clear()
                    seen[digest] = None
                    rows.append((digest, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            return rows

        return f

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(store.select("digest", "media"), schema, make).dropDuplicates(["digest"])


def resolve(sequences: DataFrame, id_col: str, figures: DataFrame) -> DataFrame:
    """(id, other columns, pos, kind, text, caption, digest, figures...): a row per item; references get their payload's figures by a join on the digest.

    Text runs have no digest, so they take no part in the join. A digest that
    many documents share is a hot key on the left only (figures has it once),
    which adaptive execution splits.
    """
    others = [c for c in sequences.columns if c not in (id_col, "items")]
    flat = sequences.select(id_col, *others, F.explode("items").alias("i")).select(id_col, *others, "i.pos", "i.kind", "i.text", "i.caption", "i.digest")
    refs, runs = flat.where("kind = 'media'"), flat.where("kind <> 'media'")
    found = refs.join(figures, "digest", "left")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in figures.schema.fields if f.name != "digest"]
    order = [id_col, *others, "pos", "kind", "text", "caption", "digest", *[c for c in figures.columns if c != "digest"]]
    return found.select(*order).unionByName(runs.select("*", *missing).select(*order))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def as_page(text: Column) -> Column:
    """A document as a page: its lines as paragraphs, and after the first half of them a figure whose image is the document's own payload and whose caption is the line before it."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(_escaped(whole), "\n")
    half = F.ceil(F.size(lines) / 2).cast("int")

    def paragraphs(part: Column) -> Column:
        return F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))

    image = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(payload(text), 256), F.lit('"><figcaption>'), F.element_at(lines, half), F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), paragraphs(F.slice(lines, F.lit(1), half)), image, paragraphs(F.slice(lines, half + 1, F.size(lines))), F.lit("</article>"))


def media_sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_items, pos, kind, text, caption, digest, figures...): each document as an interleaved sequence of its paragraphs and its own padded payload, which is stored, read back and resolved."""
    docs = id_text(docs)
    figures = write_table(read_store(write_store(docs)), "figures")  # small rows; a join of two plain exchanges can be split where a digest is hot
    n = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    sequences = parse_interleaved(docs.select("doc_id", as_page(F.col("text")).alias("html"), n.alias("n_bytes")), "doc_id", "html", ("n_bytes",))
    return resolve(sequences.withColumn("n_items", F.size("items").cast("long")), "doc_id", figures)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("kind = 'media'")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "n_items", "caption")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can state, from op9 itself."""
    return op9_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


MEDIA_PAYLOADS_SQL = """
WITH raw AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
padded AS (SELECT doc_id, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64) AS size, b FROM raw)
SELECT doc_id, n::BIGINT AS n_bytes, size::BIGINT AS payload_bytes,
  sha256(b || encode(repeat(chr(0), (size - n)::BIGINT))) AS payload_sha256,
  (size + length('P5x64 ' || (size // 64) || 'x255x'))::BIGINT AS media_bytes
FROM padded
"""


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of `pages` as an interleaved sequence: its text runs and media references in reading order."""
    items = parse_interleaved(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")

    def of(kind: str) -> Column:
        return F.filter("items", lambda i: i["kind"] == kind)

    runs = F.array_join(F.transform(of("text"), lambda i: i["text"]), "\n")
    return items.select("page_id", F.size("items").cast("long").alias("n_items"), F.size(of("media")).cast("long").alias("n_media"), F.length(runs).cast("long").alias("text_chars"), F.sha2(runs, 256).alias("text_sha256"))
