"""PII by information-theoretic sanitisation.

Base spans (email, ip, card, phone) are found by pattern in every whole text;
each distinct value is a protected entity, and so is the domain of each address.
Opaque strings (16 characters or more of letters and digits without order, as
keys and tokens are) are a protected class. The corpus then tells how strongly a
term reveals them, over all documents:

- share: P(entity | term), the part of the term's documents that hold the entity
  within NEAR words of it, times c / (c + 1) for c different contexts, so that a
  single sight is never proof;
- gain: log2 of that over P(entity), in bits; and evidence, the gain times c.

A term beyond all three disclosure thresholds is a span wherever it stands, of
the kind `<kind>_term` of what it reveals. A word that reveals by the same figures
that an opaque string follows it makes that string a span (`secret`). Copies and
near copies of a passage are one context: contexts are told apart by three minima
over the pairs of words near the entity, and count as different only if all three
differ. In sanitised text spans are removed behind their kind.

The counts cover all documents. What is sent to every task is a bit table of
fixed size (2^20 bits); terms that pass it are settled exactly by joins.

Edge cases: null and empty texts have no spans; overlapping spans are all
listed, and sanitising replaces their union once; repeated rows are returned
each and copies count once as a context; very long runs of digits or letters
take linear time; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, map_rows, maybe_in, release, write_table

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
#: What spans are called, in the order of equal starts.
ALL_KINDS = (*KINDS, SECRET, *(f"{k}_term" for k in (*KINDS, "domain")))
BITS = 20
NEAR = 24
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
CUE = re.compile(r"([^\W\d_]{2,})[\"']?\s{0,4}[=:]{0,2}\s{0,4}[\"']?$")
CUE_REACH = 80
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; leftmost and non-overlapping within each kind."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                found.append((start, 0, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _named(kind: str, plain: str) -> str:
    return f"{kind}:" + hashlib.blake2b(plain.encode(), digest_size=16).hexdigest()


def entities(kind: str, value: str) -> list[str]:
    """The protected entities of a value: itself without case and spacing, as a digest behind its kind, and an address's domain."""
    if kind == "email":
        plain = value.lower()
        return [_named(kind, plain), _named("domain", plain[plain.rindex("@") + 1 :])]
    return [_named(kind, value if kind == "ip" else "".join(DIGIT.findall(value)))]


class Around:
    """The words of one text, by place; what is near a span is found by bisection, however long words are or lie apart."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, None, None

    def __call__(self, a: int, b: int) -> list[str]:
        """Up to NEAR lower-case words on each side of a span."""
        if self.starts is None:
            places = [m.span() for m in WORD.finditer(self.text)]
            self.starts, self.ends = [p[0] for p in places], [p[1] for p in places]
        before, after = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return [self.text[self.starts[k] : self.ends[k]].lower() for k in (*range(max(0, before - NEAR), before), *range(after, min(len(self.starts), after + NEAR)))]


def contexts(words: list[str]) -> list[int]:
    """Three minima over hashes of the pairs of words near an entity; near copies share at least one of them almost surely."""
    h = np.array([zlib.crc32(w.encode()) for w in words] or [0], np.uint64)
    pairs = ((h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else h) & np.uint64(0xFFFFFFFF)
    out = []
    for odd in _ODD:
        x = (pairs ^ (pairs >> np.uint64(15))) * np.uint64(odd)
        x = ((x & np.uint64(0xFFFFFFFF)) ^ ((x & np.uint64(0xFFFFFFFF)) >> np.uint64(13))) * np.uint64(odd)
        out.append(int((x & np.uint64(0xFFFFFFFFFFFF)).min()))
    return out


def opaque(text: str, base: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(word before it or "", start, end) of the strings without order that no base span touches."""
    out = []
    for m in OPAQUE.finditer(text):
        s = m[0]
        if not DIGIT.search(s) or not LETTER.search(s) or any(a < m.end() and m.start() < b for a, b, _ in base):
            continue
        n = Counter(s)
        if -sum(c / len(s) * math.log2(c / len(s)) for c in n.values()) < 2.75:
            continue
        before = text[max(0, m.start() - CUE_REACH) : m.start()]
        cue = CUE.search(before)
        whole = cue and (cue.start(1) > 0 or m.start() <= CUE_REACH)
        out.append((cue[1].lower() if whole else "", m.start(), m.end()))
    return out


def key_of() -> Column:
    """Identifies a row by what it holds, in 128 bits; repeated rows share it."""
    return digest(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))


def find_base(docs: DataFrame) -> DataFrame:
    """(key, doc_id, base, near, opaque): base spans as a list of kind:start:end, the words near each entity, and opaque strings with the word before; c are their contexts."""

    def make():
        def f(keys, ids, texts):
            rows = []
            for key, i, t in zip(keys, ids, texts, strict=True):
                spans = base_spans(t) if t else []
                near: dict[str, list[str]] = {}
                beside = Around(t)
                for a, b, kind in spans:
                    around = beside(a, b)
                    for e in entities(kind, t[a:b]):
                        near.setdefault(e, []).extend(around)
                seen = [{"entity": e, "words": sorted(set(w)), "c": contexts(w)} for e, w in near.items()]
                odd = [{"cue": cue, "a": a, "b": b, "c": contexts(beside(a, b))} for cue, a, b in (opaque(t, spans) if t else ())]
                rows.append((key, i, [f"{k}:{a}:{b}" for a, b, k in spans], seen, odd))
            return rows

        return f

    schema = "key binary, doc_id long, base array<string>, near array<struct<entity:string,words:array<string>,c:array<long>>>, opaque array<struct<cue:string,a:long,b:long,c:array<long>>>"
    return map_rows(docs.select(key_of().alias("key"), "doc_id", "text"), schema, make)


def _bits(terms: DataFrame) -> np.ndarray | None:
    """A table of 2^BITS bits, set where a term's crc32 falls; at most that many numbers come to the driver, 64 bits each."""
    bit = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << BITS))
    words = terms.select(F.floor(bit / 64).alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).distinct().groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect()
    if not words:
        return None
    table = np.zeros((1 << BITS) // 64, np.int64)
    for r in words:
        table[r["w"]] = r["v"]
    return table


class Passing(dict):
    """word -> its lower case if that passes the bit table, else None; a bounded cache."""

    MOST = 200_000

    def __init__(self, table: np.ndarray) -> None:
        self.bits = np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)

    def __missing__(self, word: str) -> str | None:
        low = word.lower()
        passes = low if self.bits[zlib.crc32(low.encode()) & ((1 << BITS) - 1)] else None
        if len(self) >= self.MOST:
            self.clear()
        self[word] = passes
        return passes

    def words(self, text: str) -> set[str]:
        """The words of a text that pass, in lower case."""
        return {low for w in set(WORD.findall(text)) if (low := self[w])}


def _document_counts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(term, n): documents that hold each term that passes the bit table, counted in each task before the shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, counts = Passing(shipped.value), Counter()
        release()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(passing.words(text))
            if len(counts) > 500_000:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, base: DataFrame, least_share: float = 0.5, least_gain: float = 3.0, least_bits: float = 16.0) -> DataFrame | None:
    """(term, kind, both, n, contexts, share, gain) of the terms beyond the thresholds; None where nothing was seen twice.

    kind is that of the entity, or `secret` for a word that opaque strings follow.
    """
    c = [F.col("x.c")[k].alias(f"c{k}") for k in range(3)]
    holders = base.where(F.size("near") > 0)
    seen = holders.select(F.explode("near").alias("x")).select("x.entity", "x.words", *c)
    held = write_table(seen.groupBy("entity").agg(F.count("*").alias("held")).where("held > 1"), "held")  # what one row holds is seen in one context
    near = seen.join(held, "entity").select(F.explode("words").alias("term"), "entity", "held", "c0", "c1", "c2")
    odd = base.where(F.size("opaque") > 0)
    once = F.filter("opaque", lambda x, k: F.array_position(F.col("opaque.cue"), x["cue"]) == k + 1)  # the first behind each word
    cues = odd.select(F.explode(once).alias("x")).select(F.col("x.cue").alias("term"), F.lit(f"{SECRET}:").alias("entity"), F.lit(odd.count()).cast("long").alias("held"), *c).where("term != ''")
    counted = near.unionByName(cues).groupBy("term", "entity", "held").agg(F.count("*").alias("both"), *[F.countDistinct(f"c{k}").alias(f"n{k}") for k in range(3)])
    pairs = counted.withColumn("contexts", F.least("n0", "n1", "n2")).where("contexts > 1").select("term", "entity", "held", "both", "contexts")
    total = docs.count()

    def beyond(n: Column) -> DataFrame:
        """The pairs beyond the thresholds, were the term's documents so many."""
        share = F.col("both") / F.greatest(n, F.col("both")) * F.col("contexts") / (F.col("contexts") + 1)
        judged = pairs.withColumn("share", share).withColumn("gain", F.log2(F.col("share") * total / F.col("held")))
        return judged.where((F.col("share") >= least_share) & (F.col("gain") >= least_gain) & (F.col("gain") * F.col("contexts") >= least_bits))

    # A term's documents are at least those where it stands near any entity, which rules common words out before all texts are read.
    around = holders.select(F.explode(F.array_distinct(F.flatten("near.words"))).alias("term")).groupBy("term").agg(F.count("*").alias("least_n"))
    pairs = pairs.join(around, "term", "left").withColumn("least_n", F.coalesce("least_n", F.lit(0)))
    pairs = write_table(beyond(F.col("least_n")).drop("least_n", "share", "gain"), "pairs")
    table = _bits(pairs)
    if table is None:
        return None
    pairs = pairs.join(_document_counts(docs, table), "term")
    return write_table(beyond(F.col("n")).select("term", F.substring_index("entity", ":", 1).alias("kind"), "both", "n", "contexts", "share", "gain"), "disclosing")


def method_spans(docs: DataFrame, base: DataFrame, terms: DataFrame | None) -> DataFrame:
    """(key, extra): the places of disclosing terms, and of opaque strings behind a word that tells of them, in each different row that has any, as kind:start:end."""
    table = _bits(terms.where(F.col("kind") != SECRET)) if terms is not None else None
    parts = []
    if table is not None:
        shipped = docs.sparkSession.sparkContext.broadcast(table)

        def make():
            passing = Passing(shipped.value)

            def f(keys, texts):
                rows = []
                for key, t in zip(keys, texts, strict=True):
                    if t and passing.words(t):
                        rows += [(key, low, m.start(), m.end()) for m in WORD.finditer(t) if (low := passing[m[0]])]
                return rows

            return f

        places = map_rows(docs.select(key_of().alias("key"), "text"), "key binary, term string, a long, b long", make).distinct()
        # A term that reveals several entities is of the kind that it reveals most strongly.
        kind = terms.where(F.col("kind") != SECRET).groupBy("term").agg(F.max_by("kind", F.struct("gain", "kind")).alias("kind"))
        parts.append(places.join(kind, "term").select("key", F.concat("kind", F.lit("_term")).alias("kind"), "a", "b"))
    if terms is not None:
        cues = terms.where(F.col("kind") == SECRET).select(F.col("term").alias("cue"))
        odd = base.where(F.size("opaque") > 0).select("key", F.explode("opaque").alias("x")).select("key", "x.cue", "x.a", "x.b").distinct()
        parts.append(odd.join(cues, "cue", "left_semi").select("key", F.lit(SECRET).alias("kind"), "a", "b"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "key binary, extra array<string>")
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.groupBy("key").agg(F.collect_list(F.format_string("%s:%d:%d", "kind", "a", "b")).alias("extra"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(key, doc_id, base, extra): base spans and the method's spans of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = write_table(find_base(slim), "base")
    extra = method_spans(slim, base, disclosing_terms(slim, base))
    return base.select("key", "doc_id", "base").join(extra, "key", "left").withColumn("extra", F.coalesce("extra", F.array().cast("array<string>")))


def _in_order(base: Column, extra: Column) -> Column:
    """All spans by start, then kind as listed, then end, joined by commas."""
    ranked = F.transform(F.concat(base, extra), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), F.array_position(F.lit([*ALL_KINDS]), F.split(s, ":")[0]).alias("k"), F.split(s, ":")[2].cast("long").alias("b"), s.alias("s")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda r: r["s"]), ",")


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.startswith(F.lit(f"{kind}:")))).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), _in_order(F.col("base"), F.col("extra")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans become [KIND]; a union of overlapping spans is replaced once, by its first kind."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with sanitised text; all columns stay, n_chars follows where there is one."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = write_table(find_base(slim), "base")
    extra = method_spans(slim, base, disclosing_terms(slim, base))
    marks = base.where(F.size("base") > 0).select("key", F.col("base").alias("spans")).unionByName(extra.select("key", F.col("extra").alias("spans")))
    marks = write_table(marks.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans")), "marks")
    names = docs.columns
    at_key = key_of()
    keyed = docs.withColumn("__key", at_key)
    keyed = maybe_in(keyed, F.xxhash64("__key"), marks.select(F.xxhash64("key")))
    met = keyed.where("__maybe").join(marks.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")).hint("merge"), "__key", "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1).to_pylist()
            texts = [redact(t, [(int(a), int(b), k) for k, a, b in (s.split(":") for s in ss)]) if t and ss else t for t, ss in zip(batch.column(at).to_pylist(), spans, strict=True)]
            columns = [pa.array(texts, f.type) if k == at else batch.column(k) for k, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    wide = met.select(*names, "__spans")
    out = wide.mapInArrow(clean, wide.schema)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return keyed.where("NOT __maybe").select(*names).unionByName(out.select(*names))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op10 that SQL can state, from op10 itself."""
    return op10_pii_disclosure(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in KINDS])


PII_BASE_SQL = r"""
WITH found AS (
  SELECT doc_id,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
    regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
    list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g'))) AS phones
  FROM documents
)
SELECT doc_id, n_email::BIGINT AS n_email,
  len(list_filter(ips, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255))::BIGINT AS n_ip,
  len(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19 AND
    list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INT
      ELSE x[length(x) - i]::INT * 2 - CASE WHEN x[length(x) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda n: n BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM found
"""
