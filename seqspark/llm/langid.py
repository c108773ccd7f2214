"""Language identification by hierarchical discrimination.

The language family is predicted first; within it, one-versus-one linear
support vector machines separate the closely related languages by votes. All
machines see relative frequencies of hashed n-grams (one to four bytes of the
lower-cased text, white space as one kind of byte), so a text's margin is a sum
over its n-grams, taken for a batch of whole texts at once.

Edge cases: texts that are null or have no letter are `und` with score 0; with
no labelled text to learn from every text is `und`; with one language (or one
in a family) that is predicted without a machine; null languages are not
learned; repeated rows are returned each; extra columns are ignored; empty
tables give empty results. A table with more languages than most_langs is
refused, as pairs of machines grow with their square; copies of a text are
learned from once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, release, remainder

BITS = 12
DIM = 1 << BITS
LONGEST = 4
#: Language families by ISO 639-1 code; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "celtic": "br cy ga gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bins of the n-grams that start at each byte, a row for each n; where each text starts).

    Every text is framed by spaces, as many before it as the longest n-gram can
    reach over from the text before, so its bins don't depend on its neighbours.
    """
    raw = [b" " * (LONGEST - 1) + t.lower().encode() + b" " for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    b[b <= 32] = 32
    b = np.append(b, np.full(LONGEST - 1, 32, np.uint32))
    n = len(b) - LONGEST + 1
    h = np.zeros(n, np.uint32)
    rows = []
    for k in range(LONGEST):
        h = (h + b[k : k + n] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        rows.append(((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.stack(rows), sizes.cumsum() - sizes


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, relative frequencies) of a whole text."""
    total = np.bincount(grams([text])[0].ravel(), minlength=DIM)
    bins = np.flatnonzero(total)
    return bins, total[bins] / total.sum()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss (last: bias), classes weighed alike; accelerated gradient steps."""
    d, y = x.shape[1], y.astype(np.float32)  # single precision throughout: no wide copies of x
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, v, t = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32), 1.0
    size = max(float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()), 1e-9)
    rate = np.float32(1 / (1 + 2 * cost * size))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight * y
        grad = np.append(v[:-1] - np.float32(2 * cost) * (slack @ x), np.float32(-2 * cost) * slack.sum())
        new = v - rate * grad
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + np.float32((before - 1) / t) * (new - w)
        w = new
    return w


@dataclass
class Hierarchy:
    """Machines: families one against the rest, and one for each pair of languages of a family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray  # a row for each bin; columns: families, then pairs
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """The language and its share of confidence from all machines' margins of one text."""
        at = 0
        trust = 1.0
        if len(self.families) > 1:
            m = margins[: len(self.families)]
            at = int(m.argmax())
            e = np.exp(4 * (m - m.max()))
            trust = float(e[at] / e.sum())
        family = self.families[at]
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], trust
        votes = dict.fromkeys(langs, 0.0)
        for k, (f, a, b) in enumerate(self.pairs):
            if f == family:
                p = 1 / (1 + np.exp(-4 * margins[len(self.families) + k]))
                votes[a] += 1 + p if p >= 0.5 else p
                votes[b] += 2 - p if p < 0.5 else 1 - p
        best = max(langs, key=lambda x: (votes[x], x))
        rivals = [p for k, (f, a, b) in enumerate(self.pairs) if f == family and best in (a, b) for p in [1 / (1 + np.exp(-4 * margins[len(self.families) + k] * (1 if a == best else -1)))]]
        return best, trust * float(min(rivals))


def learn(docs: DataFrame, most_docs: int = 1200, scale: float = 40.0, most_langs: int = 300) -> Hierarchy | None:
    """Fits the hierarchy on at most most_docs different labelled texts (whole; 20 of each language at least), drawn by a hash of the text."""
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(most_langs + 1).collect()
    counts = {r["lang"]: r["n"] for r in sorted(found, key=lambda r: r["lang"])}
    if not counts:
        return None
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages: raise most_langs, or clean the column")
    each = max(20, most_docs // len(counts))
    drawn_by = F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1_000_000_000)) / 1e9
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.3 * each / n))])  # a little more than each, as n is an estimate
    drawn = known.where(drawn_by < share[F.col("lang")])
    drawn = drawn.groupBy("lang", F.md5("text").alias("copy")).agg(F.first("text").alias("text"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("copy"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= each)

    def make():
        def f(texts, langs):
            rows = []
            for text, lang in zip(texts, langs, strict=True):
                bins, freq = profile(text)
                rows.append((lang, bins.astype(np.uint16).tobytes(), freq.astype(np.float32).tobytes()))
            return rows

        return f

    got = map_rows(drawn.select("text", "lang"), "lang string, bins binary, freq binary", make).collect()  # most_docs rows at most, or 20 of each language
    got.sort(key=lambda r: (r["lang"], r["bins"], r["freq"]))
    x = np.zeros((len(got), DIM), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r["bins"], np.uint16)] = np.frombuffer(r["freq"], np.float32)
    langs = np.array([r["lang"] for r in got])
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    family = np.array([family_of(lang) for lang in langs])
    pairs = [(f, a, b) for f in families for a, b in combinations(members[f], 2)]
    # Margins are sums over n-grams, so the machines see frequencies themselves, each bin scaled by a fixed factor.
    spread = np.float32(scale) / np.maximum(np.sqrt(x.mean(axis=0)), np.float32(1e-3))
    x *= spread
    columns = [svm(x, np.where(family == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [np.zeros(DIM + 1)]
    for f, a, b in pairs:
        rows = (langs == a) | (langs == b)
        columns.append(svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0)))
    w = np.stack(columns, axis=1)
    return Hierarchy(families, members, pairs, (w[:-1] * spread[:, None]).astype(np.float32), w[-1].astype(np.float32))


def batch_predictor(h: Hierarchy | None) -> Callable[[list[str | None]], list[tuple[str, float]]]:
    """f(texts) -> (language, score) of each."""
    columns = [np.ascontiguousarray(c) for c in h.weights.T] if h else []

    def f(texts):
        judged = [bool(h) and has_letter(t) for t in texts]
        found: Iterator = iter(())
        if any(judged):
            bins, starts = grams([t for t, ok in zip(texts, judged, strict=True) if ok])
            sizes = np.diff(np.append(starts, bins.shape[1])) * LONGEST
            margins = np.stack([sum(np.add.reduceat(c[row], starts, dtype=np.float64) for row in bins) / sizes for c in columns], axis=1) + h.bias
            found = iter([h.decide(m) for m in margins])
        return [next(found) if ok else ("und", 0.0) for ok in judged]

    return f


def predict(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = batch_predictor(shipped.value)
        return lambda ids, texts: [(i, *r) for i, r in zip(ids, f(texts), strict=True)]

    return map_rows(slim, "doc_id long, lang_pred string, score double", make, 2 << 20)


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, least_score: float = 0.5, most_docs: int = 1200) -> DataFrame:
    """docs whose predicted language is one of `languages` (any learned one by default) with the least score; all columns stay.

    A text below the least score resembles several languages, or none that was
    learned, too much to be called any. `und` always goes.
    """
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs.where(remainder(4) != 2), most_docs))
    wanted = None if languages is None else frozenset(languages)

    def keeps(lang: str, score: float) -> bool:
        return lang != "und" and score >= least_score and (wanted is None or lang in wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        f = batch_predictor(shipped.value)
        for whole in batches:
            step = max(1, int(whole.num_rows * (2 << 20) / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield batch.filter(pa.array([keeps(*r) for r in f(batch.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, most_docs: int = 1200) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose id's crc32 leaves 2 modulo 4 are never learned from."""
    model = learn(docs.where(remainder(4) != 2), most_docs)
    return predict(docs, model).withColumn("held_out", remainder(4) == 2)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
