"""URL filters: rules by host and path, and logistic regression where no rule fits.

All of it is DataFrame expressions and the JVM's own regression: no Python runs
on the executors. Character n-grams of host and path are hashed to bins of their
own; each side's vector has length 1, so a long path weighs no more than a short
one. The regression is fitted on a small labelled table of URLs, and its weights
go back into the plan as one array literal.

Edge cases: a null URL, or one without `://`, has an empty host and path, fits
no rule and is judged by the model on nothing (its intercept); equal rules
count once; of rules of equal length, which must differ in host or path, the
alphabetically last wins; very long URLs are judged whole; repeated rows are
returned each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of each side; the path's follow the host's.
BINS = 1 << 16
GRAMS = (3, 4, 5)
#: (verdict, rule); a rule is a host, then a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# The small labelled table: sites by subject, as anyone who keeps such lists would name them. A host is a subject with
# a companion before or after it, so that a companion alone tells nothing; paths are plain ones for both kinds, and for
# some rows one that speaks of the subject itself.
BLOCKED = {
    "gambling": "casino roulette blackjack poker slots jackpot betting bets sportsbook lottery baccarat bingo wagers winnings jackpot-wins",
    "drugs": "viagra cialis pills pharmacy meds tramadol steroids diet-pills painkillers xanax",
    "adult": "porn xxx sex adult escorts webcams hookup nudes erotic fetish",
    "tracking": "adserver ads tracker tracking pixel-track popunder banners clickad adclick doubleads beacon-track telemetry-ads",
    "spam": "spam backlinks linkfarm link-exchange seo-links bulkmail mailblast contentfarm spambot clickfarm farmlinks",
    "fraud": "replica-watches payday-loans get-rich crypto-doubler free-iphone prize-winner fake-id phishing malware warez keygen cracked",
}
KEPT = {
    "learning": "university school library college research mathematics chemistry lectures students theses history physics",
    "culture": "museum theatre orchestra poetry literature gallery cinema heritage archives ballet concerts painting",
    "civic": "council parliament transport weather hospital firebrigade elections statistics postoffice cityhall railway harbour",
    "home": "recipes gardening knitting carpentry furniture bakery cooking bicycles allotment pottery camping beekeeping",
    "press": "newspaper gazette herald chronicle magazine bulletin editorial reporter tribune courier observer journal",
    "code": "software compiler developers database opensource manual docs tutorial handbook forum wiki packages",
    "nature": "forest mountains birds rivers geology astronomy wildlife orchard lighthouse meadow glacier farm",
    "europe": "bibliothek zeitung verein rathaus wissenschaft bibliotheque cuisine histoire jardin escuela noticias ayuntamiento",
}
BLOCKED_WITH = "best super royal lucky vip mega instant bonus deals 24 world online".split()
KEPT_WITH = "north city national open my green old the first county world online".split()
#: Kept sites with a word that blocked ones use as well.
NEAR_MISSES = "adult-education adult-literacy track-and-field racetrack farmers-market dairy-farm wind-farm mailing-lists link-editor pharmacy-school public-lottery-museum headache-clinic addresses adsorption shadows roadside sextant essex middlesex analytics-course crackers-bakery freedom freelance betterhomes alphabets cheapside".split()
#: Hosts that stand in both kinds alike, so that they tell nothing and the path must.
NEUTRAL = "greenhill stonebridge riverton oakdale northgate maplewood fairview brookside kingsford eastwick silverlake westbury".split()
_PREFIXES, _SUFFIXES, _LANGS, _ENDS = ("", "www.", "m.", "blog."), ("example.com", "com", "example.org", "net", "example.net", "test", "org"), ("en", "de", "fr", "es", "", "news"), ("", "/", ".html", "?ref=x", "#top")
_BLOCKED_PATHS = ("play/{}/bonus", "buy-{}-cheap", "{}/click?id=7", "go/{}/redirect", "free-{}-now")
_KEPT_PATHS = ("wiki/{}", "articles/about-the-{}-and-its-visitors-in-the-long-winter-season", "{}/opening-hours", "docs/{}/index", "archive/{}/letters")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(the host's name, or the subject where the path alone tells, url, 1 to block or 0 to keep), by the same rule for both kinds."""
    rows = []
    for kinds, companions, paths, label in ((BLOCKED, BLOCKED_WITH, _BLOCKED_PATHS, 1), (KEPT, KEPT_WITH, _KEPT_PATHS, 0)):
        subjects = [s for words in kinds.values() for s in words.split()]
        for k, s in enumerate(subjects):
            with_ = [companions[(k * 5 + j) % len(companions)] for j in range(5)]
            for j, name in enumerate((s, f"{s}-{with_[0]}", f"{with_[1]}-{s}", f"{with_[2]}{s}", f"{s}{with_[3]}", f"the-{s}-{with_[4]}")):
                n = 6 * k + j + k % 5
                path = paths[n % len(paths)].format(s) if n % 5 == 3 else f"{_LANGS[n % 6]}/{n * 37 % 997}".lstrip("/")
                rows.append((name, f"https://{_PREFIXES[n % 4]}{name}.{_SUFFIXES[n % 7]}/{path}{_ENDS[n % 5]}", label))
        for k, s in enumerate(subjects):  # the subject in the path alone, in paths of its own kind and in any
            for j, path in enumerate((paths[k % 5], (*_BLOCKED_PATHS, *_KEPT_PATHS)[k % 10], f"{_LANGS[k % 4]}/{{}}", "{}/" + str(k * 53 % 499))):
                n = k + 3 * j
                rows.append((s, f"https://{_PREFIXES[n % 4]}{NEUTRAL[n % 12]}.{_SUFFIXES[n % 7]}/{path.format(s)}{_ENDS[n % 5]}", label))
    rows += [(name, f"https://{_PREFIXES[n % 4]}{name}.{_SUFFIXES[n % 7]}/{_LANGS[n % 4]}/{n * 41 % 997}", 0) for k, name in enumerate(NEAR_MISSES) for n in (2 * k, 2 * k + 1)]
    return rows


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SHAPE, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for verdict, rule in rules:
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        ok = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _grams(text: Column, mark: str) -> Column:
    framed = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))

    return reduce(F.concat, map(of, GRAMS))


def grams_of(text: Column, mark: str, first: int) -> Column:
    """Distinct bins from `first` on of the hashed n-grams of a text, as numbers; none if it is empty."""
    hashed = F.transform(_grams(text, mark), lambda g: (F.pmod(F.xxhash64(g), F.lit(BINS)) + first).cast("int"))
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.array_distinct(hashed))


def shape_of(path: Column) -> Column:
    return F.translate(path, "123456789", "000000000")


def fit(spark: SparkSession, labelled: DataFrame | None = None, ridge: float = 0.00005) -> tuple[list[float], float]:
    """(weights of all bins, intercept) from a table (url, label); the small table of this module by default."""
    if labelled is None:
        rows = ", ".join(f"('{url}', {label}D)" for _, url, label in labelled_urls())
        labelled = spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    part = labelled.agg(F.avg("label")).first()[0]
    even = F.when(F.col("label") > 0, 0.5 / part).otherwise(0.5 / (1 - part))
    sides = labelled.select("label", even.alias("weight"), grams_of(host, "h", 0).cast("array<string>").alias("h"), grams_of(shape_of(path), "p", BINS).cast("array<string>").alias("p"))
    steps = [x for side in "hp" for x in (CountVectorizer(inputCol=side, outputCol=f"{side}_n", binary=True, vocabSize=BINS), Normalizer(inputCol=f"{side}_n", outputCol=f"{side}_v"))]
    regression = LogisticRegression(regParam=ridge, maxIter=100, standardization=False, weightCol="weight")
    model = Pipeline(stages=[*steps, VectorAssembler(inputCols=["h_v", "p_v"], outputCol="features"), regression]).fit(sides.coalesce(1).cache())
    weights = [0.0] * (2 * BINS)
    for name, w in zip([*model.stages[0].vocabulary, *model.stages[2].vocabulary], model.stages[-1].coefficients.toArray().tolist(), strict=True):
        weights[int(name)] = w
    return weights, float(model.stages[-1].intercept)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is the regression's chance that a site is to be blocked."""
    weights, intercept = fit(pages.sparkSession, labelled)
    w = F.split(F.lit(",".join(f"{x:.7g}" if x else "0" for x in weights)), ",").cast("array<double>")
    parted = base_columns(pages, rules)

    def side(bins: Column) -> Column:
        total = F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + F.element_at(w, b + 1))
        return total / F.sqrt(F.greatest(F.size(bins), F.lit(1)))

    logit = F.lit(intercept) + side(grams_of(F.col("host"), "h", 0)) + side(grams_of(shape_of(F.col("path")), "p", BINS))
    scored = parted.withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def base_columns(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, rule_verdict): what needs no model."""
    parted = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parted.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("rule_verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of every page: the part of op6 that SQL can state."""
    return base_columns(spark.read.parquet(f"{sf_dir}/pages.parquet"))


URL_RULES_SQL = """
WITH parted AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule, own, start, rule_verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM (SELECT DISTINCT host, path, page_id FROM parted) p JOIN rules ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)
  GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, f.rule, f.rule_verdict
FROM parted p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""
