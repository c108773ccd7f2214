"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are gathered once; trees are grown on a bounded
sample of labelled documents, with monotonic constraints on chosen features,
and flattened into numpy node arrays that score a batch of documents at a time.

Edge cases: null, empty and wordless texts have zero words and fail the base
rule; labels that are null are left out of the fit, and a document with two
labels counts twice; with no labels or one class every document that passes
the base rule is kept; repeated rows are returned each; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, map_rows, write_table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8
#: Statistics that the trees see, with the direction in which the score may move: -1 down, 1 up, 0 either.
FEATURES = {
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "exclamation_share": -1,
    "log_words": 0,
    "word_length": 0,
    "unique_share": 1,
    "digit_share": 0,
    "words_per_line": 0,
    "stop_share": 0,
}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{f} double" for f in FEATURES)
_SIXTY_FOUR = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more, the first of them included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    x = ids.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * _SIXTY_FOUR + x[k : k + n]
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    at = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base counts and the features of one whole text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    some, letters = max(n, 1), max(chars, 1)
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    top = int(np.sort(np.bincount(ids))[-3:].sum()) if n else 0
    return (n, chars, symbols, dup, repeats, symbols / letters, dup / max(len(lines), 1), repeats / some, upper / letters, text.count("!") / some, float(np.log1p(n)), chars / some, len(known) / some, sum(map(text.count, "0123456789")) / letters, n / max(len(lines), 1), top / some)


def document_statistics(docs: DataFrame) -> DataFrame:
    def make():
        return lambda ids, texts: [(i, *statistics(t)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(id_text(docs), SCHEMA, make)


@dataclass
class Trees:
    """All trees in flat arrays: feature (-1: leaf), threshold, left, right, value; roots has each tree's first node."""

    base: float = 0.0
    rate: float = 0.1
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)

    def flat(self) -> Trees:
        kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64, "roots": np.int32}
        return Trees(self.base, self.rate, **{k: np.array(getattr(self, k), t) for k, t in kinds.items()})

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of a batch: every row walks every tree, a level at a time."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while (inner := self.feature[node] >= 0).any():
                f = np.where(inner, self.feature[node], 0)
                go = np.where(x[rows, f] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, go, node)
            out += self.rate * self.value[node]
        return out


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 10, ridge: float = 1.0, bins: int = 64) -> Trees:
    """Boosted trees on the logistic loss over binned features.

    A split on a constrained feature must order its children's values its way,
    and both sides stay within the bounds that the splits above set.
    """
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    trees = Trees(float(np.log(p / (1 - p))), rate)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(x), trees.base)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(trees.feature)
        for column, v in ((trees.feature, -1), (trees.threshold, 0.0), (trees.left, -1), (trees.right, -1)):
            column.append(v)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        trees.value.append(float(np.clip(total_g / (total_h + ridge), low, high)))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                n, gs, hs = (np.cumsum(np.bincount(b, w, minlength=len(c) + 1))[:-1] for w in (None, g[rows], h[rows]))
                ok = (n >= least) & (len(rows) - n >= least)
                v_left, v_right = gs / (hs + ridge), (total_g - gs) / (total_h - hs + ridge)
                if monotone[f]:
                    ok &= monotone[f] * (v_right - v_left) >= 0
                gain = np.where(ok, gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, v_left[k], v_right[k]))
        if best[1]:
            f, k, v_left, v_right = best[1]
            mid = float(np.clip((v_left + v_right) / 2, low, high))
            trees.feature[at], trees.threshold[at] = f, float(cuts[f][k])
            down = (mid, high) if monotone[f] < 0 else (low, mid) if monotone[f] > 0 else (low, high)
            up = (low, mid) if monotone[f] < 0 else (mid, high) if monotone[f] > 0 else (low, high)
            side = binned[rows, f] <= k
            trees.left[at] = node(rows[side], g, h, level + 1, *down)
            trees.right[at] = node(rows[~side], g, h, level + 1, *up)
        return at

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        start = len(trees.feature)
        trees.roots.append(node(np.arange(len(x)), y - q, q * (1 - q), 0, -4.0, 4.0))
        one = Trees(0.0, rate, *(getattr(trees, k) for k in ("feature", "threshold", "left", "right", "value")), [start]).flat()
        score = score + one.raw(x)
    return trees.flat()


def sample(rows: DataFrame, bound: int, *keys: str) -> DataFrame:
    """About `bound` rows at most, by a hash of the keys (doc_id): the same rows however the table is dealt. Only different keys are bounded."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64(F.lit("sample"), *(keys or ("doc_id",))), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def fit(stats: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> Trees | None:
    """Trees fitted on at most about most_labels labelled documents; None if there is no contrast to learn.

    Rows that repeat a document with the same statistics and label count once, so what comes to the driver is bounded however often one is repeated.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).dropna().distinct()
    met = write_table(stats.select("doc_id", *FEATURES).distinct().join(marked, "doc_id"), "labelled")
    got = sample(met, most_labels, "doc_id", *FEATURES, "y").orderBy("doc_id", *FEATURES, "y").toPandas()
    y = got["y"].to_numpy(np.float64) if len(got) else np.zeros(0)
    if len(set(y)) < 2:
        return None
    return grow(got[list(FEATURES)].to_numpy(np.float64), (y > 0).astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_labels: int = 20_000) -> DataFrame:
    """Statistics, base_failed, score and kept for every document."""
    stats = write_table(document_statistics(docs), "statistics")
    trees = fit(stats, labels, most_labels)
    base = stats.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    names, schema = base.columns, ", ".join(f"{n} {t}" for n, t in base.dtypes) + ", score double"
    first = names.index(next(iter(FEATURES)))

    def make():
        def f(*columns):
            x = np.array(columns[first : first + len(FEATURES)], np.float64).T
            score = 1 / (1 + np.exp(-trees.raw(x))) if trees else np.ones(len(x))
            return list(zip(*columns, score.tolist(), strict=True))

        return f

    return map_rows(base, schema, make).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op5_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can state, from op5 itself."""
    return op5_quality_gbt(spark, sf_dir).select("doc_id", *BASE)


QUALITY_BASE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parted AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM docs),
kept_lines AS (SELECT r, unnest(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM parted),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM kept_lines GROUP BY r),
windows AS (SELECT r, i, list_slice(w, i, i + 7) AS g FROM parted, unnest(range(1, len(w) - 6)) AS u(i)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM again, range(8) AS o(d) GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM parted LEFT JOIN dups USING (r) LEFT JOIN covered USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
"""
