"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, compatibility forms (full-width, mathematical,
circled and script letters), look-alike letters of other scripts, and digits or
signs that stand for letters inside words. Accents stay, as they tell
words of accented languages apart. The lexicon is
learned: whole words of any length, and character strings inside words (from 4
characters, from 2 in scripts without spaces), whose document counts
differ between toxic and clean labelled texts far beyond chance, weighed by
their log-odds. Strings under 4 characters are judged on the texts that no longer
entry explains, so that common short words beside an entry are none themselves.
Exception phrases, of a word that holds an entry alone or with the words beside
it, that are no likelier in toxic texts, cancel the matches inside them. A text's
evidence is the sum over its words of the best weight in each, normalised by its
length, and a logistic curve fitted on the same labelled rows makes it a score.

Edge cases: null, empty and wordless texts have no evidence and get the score
of a text without matches; null labels are left out; copies of a text count
once in the fit; with no labels of one kind the lexicon is empty and every
score is the known rate (0 with no labels at all); repeated rows are returned
each; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_rows, remainder
from .quality import sample

SHORTEST, LONGEST = 4, 10
#: Of a text's length, what its evidence is divided by.
POWER = 0.75
#: Digits and signs that stand for letters, in words that hold a letter: numbers stay numbers.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
#: Signs that do so only before or between letters, where they are no punctuation.
SIGNS = {"$": "s", "|": "l", "!": "i"}
#: Letters of other scripts that look like Latin ones: Cyrillic, Greek, Armenian, Cherokee and Latin letters with a shape of their own.
LOOKALIKES = dict(
    zip(
        "авекмнорстухѕіјԁһӏьгпиԛԝүѵ" "αβεηικνορτυχωγρ" "օսհոցյ" "ɑɡɩıƖοɪʏᴀᴄᴇᴋᴍᴏᴘᴛᴜᴠᴡᴢ",
        "abekmhopctyxsijdhlbrnuqwyv" "abeniknoptuxwyp" "ouhngj" "agiiloiyacekmoptuvwz",
        strict=True,
    )
)
WORD = re.compile(r"[^\W_]+")
#: A run of letters and digits that holds a digit; each run is looked at once.
_MIXED = re.compile(r"(?<![^\W_])(?<!@)[^\W\d_]*+[\d@](?:[^\W_]|@)*+")
_SIGN = re.compile(r"\$(?=[^\W\d_])|(?<=[^\W_])[|!](?=[^\W\d_])")
#: Scripts written without spaces (Thai to Myanmar, Khmer, kana, Han): their words stand inside longer runs.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
#: Blocks whose letters are forms of plain ones: letter-like signs, circled, full-width, mathematical and squared letters.
_FORMS = ((0x2100, 0x2150), (0x2460, 0x2500), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x1F110, 0x1F190))


def folding() -> dict[int, str]:
    """Translation table for lower-cased text: forms of plain letters and digits by their compatibility form, look-alikes; invisible characters go."""
    table: dict[int, str] = {}
    for lo, hi in _FORMS:
        for c in range(lo, hi):
            plain = unicodedata.normalize("NFKC", chr(c)).lower().strip("()")
            if 0x1F130 <= c < 0x1F190 and not plain.isascii():
                plain = chr(ord("a") + (c - 0x1F130) % 32) if (c - 0x1F130) % 32 < 26 else chr(c)
            if plain != chr(c):
                table[c] = "".join(LOOKALIKES.get(x, x) for x in plain)
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    return table | dict.fromkeys((0xAD, 0x34F, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0x2061, 0x2062, 0x2063, 0xFE0E, 0xFE0F, 0xFEFF), "")


FOLD = folding()
_LETTERS = str.maketrans(DIGITS)


def fold(text: str | None) -> str:
    lower = (text or "").lower()
    if "$" in lower or "|" in lower or "!" in lower:
        lower = _SIGN.sub(lambda m: SIGNS[m[0]], lower)
    return _MIXED.sub(lambda m: m[0].translate(_LETTERS) if any(c.isalpha() for c in m[0]) else m[0], lower.translate(FOLD))


def phrases(folded: str, lo: int, hi: int) -> list[str]:
    """The word at lo..hi, and what it forms with the words beside it; at most three other characters lie between."""
    word = folded[lo:hi]
    before = after = ""
    end = lo
    while end and lo - end < 3 and not folded[end - 1].isalnum():
        end -= 1
    start = end
    while start and folded[start - 1].isalnum():
        start -= 1
    before = folded[start:end]
    start = hi
    while start < len(folded) and start - hi < 3 and not folded[start].isalnum():
        start += 1
    end = start
    while end < len(folded) and folded[end].isalnum():
        end += 1
    after = folded[start:end]
    return [word, *([f"{before} {word}"] if before else []), *([f"{word} {after}"] if after else []), *([f"{before} {word} {after}"] if before and after else [])]


def substrings(word: str) -> set[str]:
    """What can be an entry: strings inside the word, and the word itself behind a `=`."""
    inner = {word[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(word) - n + 1)}
    if not word.isascii():
        inner |= {run[i : i + n] for run in UNSPACED.findall(word) for n in range(2, SHORTEST) for i in range(len(run) - n + 1)}
    return inner | {"=" + word}


def density(evidence: float, words: int) -> float:
    """Evidence over length: a match counts the less the more words stand around it, though not in proportion, as some follow any toxic one."""
    return 10 * evidence / (words + 10.0) ** POWER


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    curve: tuple[float, float]  # of the logarithm of evidence per length, and of one

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for text in {e.lstrip("=") for e in self.weights}:
            a.add_word(text, (len(text), self.weights.get(text, 0.0), self.weights.get("=" + text, 0.0)))
        a.make_automaton()
        return a

    def matched(self, automaton: ahocorasick.Automaton | None, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, best weight) of the words that hold an entry."""
        best: dict[int, float] = {}
        ends: dict[int, int] = {}
        lo = hi = -1
        for end, (length, w, whole) in automaton.iter(folded) if automaton else ():
            start = end - length + 1
            if not (lo <= start and end < hi):
                lo, hi = start, end + 1
                while lo and folded[lo - 1].isalnum():
                    lo -= 1
                while hi < len(folded) and folded[hi].isalnum():
                    hi += 1
                ends[lo] = hi
            if whole > w and start == lo and end + 1 == hi:
                w = whole
            if w > best.get(lo, 0.0):
                best[lo] = w
        return [(at, ends[at], w) for at, w in best.items()]

    def evidence(self, automaton: ahocorasick.Automaton | None, text: str | None) -> tuple[float, int]:
        """(evidence over length, matched words) of one text."""
        folded = fold(text)
        kept = [w for lo, hi, w in self.matched(automaton, folded) if self.exceptions.isdisjoint(phrases(folded, lo, hi))]
        if not kept:
            return 0.0, 0
        words = folded.count(" ") + folded.count("\n") + 1
        return density(sum(kept), words), len(kept)

    def score(self, density: np.ndarray) -> np.ndarray:
        a, c = self.curve
        return 1 / (1 + np.exp(-(a * np.log1p(density) + c)))


def _tally(rows: DataFrame, strings_of) -> DataFrame:
    """(term, n1, n0): labelled documents that hold each string, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "n1", "n0"])
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[toxic].update(strings_of(text))
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield out()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000, surprise: float = 30.0) -> Lexicon:
    """Fits lexicon, exceptions and curve on about most_labels labelled documents at most, whole texts, copies once; all strings that pass are kept, which those documents bound."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna()
    rows = id_text(docs).join(sample(marked, most_labels), "doc_id").where(F.col("text").isNotNull()).groupBy(F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    rate = n1 / (n1 + n0) if n1 + n0 else 0.0
    if not n1 or not n0:
        rows.unpersist()
        return Lexicon({}, frozenset(), (0.0, float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))))
    total = F.col("n1") + F.col("n0")

    def passing(counted: DataFrame, n1: int, n0: int) -> dict[str, float]:
        """Weights of the strings with evidence enough. A share beyond halfway from the rate to all is one below 1 at any rate."""
        if not n1 or not n0:
            return {}
        p = F.lit(n1 / (n1 + n0))
        part = F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / total / (1 - p))).otherwise(0.0)
        chosen = (
            counted.where((F.col("n1") >= 3) & (F.col("n1") / total > (1 + p) / 2))
            .withColumn("g", 2 * (F.col("n1") * F.log(F.col("n1") / total / p) + part))
            .where(F.col("g") > surprise)
            .withColumn("w", F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0)))
            .collect()
        )
        return {r["term"]: r["w"] for r in chosen}

    def with_exceptions(weights: dict[str, float]) -> Lexicon:
        """An exception's odds to be toxic are at most twice the rate's."""
        matcher = Lexicon(weights, frozenset(), (0, 0))

        def holders(text: str) -> set[str]:
            a = holders.__dict__.setdefault("a", matcher.automaton())
            folded = fold(text)
            return {p for lo, hi, _ in matcher.matched(a, folded) for p in phrases(folded, lo, hi)}

        innocent = _tally(rows, holders).where((F.col("n0") >= 3) & (F.col("n1") / total <= 2 * rate / (1 + rate))).select("term").collect() if weights else []
        found = {r["term"] for r in innocent}

        def shorter(phrase: str) -> Iterator[str]:
            parts = phrase.split(" ")
            return (" ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1) if j - i < len(parts))

        return Lexicon(weights, frozenset(p for p in found if found.isdisjoint(shorter(p))), (0, 0))

    def strings(text: str, short: bool) -> set[str]:
        return {s for w in set(WORD.findall(fold(text))) for s in substrings(w) if (len(s.lstrip("=")) < SHORTEST) == short}

    first = with_exceptions(passing(_tally(rows, lambda t: strings(t, False)), n1, n0))

    def unexplained(text: str) -> set[str]:
        """Short strings of a text without longer entries, and "" for the text itself."""
        a = unexplained.__dict__.setdefault("a", first.automaton())
        return set() if first.evidence(a, text)[1] else strings(text, True) | {""}

    counted = _tally(rows, unexplained).persist()
    rest = counted.where("term = ''").first()
    short = passing(counted.where("term != ''"), rest["n1"], rest["n0"]) if rest else {}
    counted.unpersist()
    lexicon = with_exceptions(first.weights | short) if short else first

    def make():
        a = lexicon.automaton()
        return lambda texts, toxic: [(lexicon.evidence(a, t)[0], y) for t, y in zip(texts, toxic, strict=True)]

    got = np.array(sorted(tuple(r) for r in map_rows(rows, "density double, toxic int", make).collect()))
    rows.unpersist()
    x, y = np.stack([np.log1p(got[:, 0]), np.ones(len(got))], axis=1), got[:, 1]
    theta, ridge = np.zeros(2), np.diag([0.1, 1e-6])
    for _ in range(50):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-x @ theta))
        theta += np.linalg.solve((x.T * (q * (1 - q))) @ x + ridge + 1e-9 * np.eye(2), x.T @ (y - q) - ridge @ theta)
        theta = np.clip(theta, [0, -30], [30, 30])
    lexicon.curve = tuple(float(v) for v in theta)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_matches) from the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        known = shipped.value
        a = known.automaton()

        def f(ids, texts):
            got = [known.evidence(a, t) for t in texts]
            s = known.score(np.array([g[0] for g in got]))
            return [(i, v, g[1]) for i, v, g in zip(ids, s.tolist(), got, strict=True)]

        return f

    return map_rows(id_text(docs), "doc_id long, score double, n_matches long", make)


def toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = 10_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches); rows whose id's crc32 leaves 0 modulo 5 are never learned from."""
    lexicon = learn(docs, labels.where(remainder(5) != 0), most_labels)
    return score(docs, lexicon).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
