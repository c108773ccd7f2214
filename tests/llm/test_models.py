"""Language ID, quality, toxicity and URL filters: the operators that learn."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.llm import langid, quality, toxicity, urls

from .conftest import collected, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert got.count() == docs.count() and held.count()
    assert held.where(F.col("lang_pred") == F.col("lang")).count() >= 0.95 * held.count()
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_awkward(spark, awkward, nothing):
    out = {(r.doc_id, r.lang_pred) for r in langid.identify(awkward).collect()}
    assert {(20, "und"), (21, "und"), (22, "und"), (25, "und")} <= out
    assert all(lang == "und" for i, lang in out if i in (20, 21, 22, 25))
    assert langid.identify(awkward).count() == awkward.count()
    assert langid.identify(nothing).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(awkward, least_score=0)
    assert kept.dtypes == awkward.dtypes and {r.doc_id for r in kept.collect()}.isdisjoint({20, 21, 22, 25})


@needs_tables
def test_stage_drops_by_language_and_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    every = {r.doc_id for r in langid.keep_identified(docs, least_score=0).collect()}
    some = {r.doc_id for r in langid.keep_identified(docs, ("de", "fr"), 0).collect()}
    sure = {r.doc_id for r in langid.keep_identified(docs, None, 0.99).collect()}
    assert every == {i for i, (lang, _) in said.items() if lang != "und"}
    assert some == {i for i, (lang, _) in said.items() if lang in ("de", "fr")} and some < every
    assert sure == {i for i, (lang, score) in said.items() if lang != "und" and score >= 0.99} and sure < every


def test_copies_are_drawn_once_and_languages_are_bounded(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "the same text over and over", "en") for k in range(3000)] + [(5000 + k, words(rng, 20), "en") for k in range(300)] + [(9000 + k, words(rng, 20).replace("the", "der"), "de") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = []
    monkeypatch.setattr(langid, "svm", lambda x, y, **_: drawn.append(len(x)) or np.zeros(x.shape[1] + 1, np.float32))
    langid.learn(docs, 60)
    assert drawn and max(drawn) <= 60
    with pytest.raises(ValueError, match="languages"):
        langid.learn(docs, 60, most_langs=1)


@needs_tables
def test_language_equals_brute_force(spark):
    """Margins of each text alone from its own n-gram counts, votes counted by hand."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    h = langid.learn(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    got = langid.batch_predictor(h)(texts)
    for text, (lang, score) in zip(texts, got, strict=True):
        if not langid.has_letter(text):
            assert (lang, score) == ("und", 0.0)
            continue
        bins, freq = langid.profile(text)
        margins = freq @ h.weights[bins].astype(float) + h.bias
        family = h.families[int(np.argmax(margins[: len(h.families)]))] if len(h.families) > 1 else h.families[0]
        wins = dict.fromkeys(h.members[family], 0)
        for k, (f, a, b) in enumerate(h.pairs):
            if f == family:
                wins[a if margins[len(h.families) + k] >= 0 else b] += 1
        assert wins[lang] == max(wins.values()) and 0 <= score <= 1


def test_language_does_not_depend_on_neighbours():
    bins, starts = langid.grams(["abc", "déf gh", ""])
    alone = [langid.grams([t])[0] for t in ("abc", "déf gh", "")]
    assert all((bins[:, s : s + a.shape[1]] == a).all() for s, a in zip(starts.tolist(), alone, strict=True))


def brute_quality(text):
    words_ = (text or "").encode().split()
    seen = {}
    for k in range(len(words_) - 7):
        seen.setdefault(tuple(words_[k : k + 8]), []).append(k)
    hit = {k + d for at in seen.values() if len(at) > 1 for k in at for d in range(8)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return len(words_), sum(len(w.decode()) for w in words_), sum((text or "").count(c) for c in "#*$%&|<>"), sum(line in lines[:k] for k, line in enumerate(lines)), len(hit)


def test_quality_base(spark, awkward, nothing):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a b ", "c ", "d\n", "#", "é ", "\x0b", " ", "x y z w "]) for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text)[:5] == brute_quality(text)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(awkward, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(r.doc_id, *(b := brute_quality(r.text)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in awkward.collect()]
    assert collected(got) == sorted(want, key=repr)
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(awkward, labels.limit(0)).where("kept = base_failed").count() == 0


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=800) > 0).astype(float)
    trees = quality.grow(x, y, [1, -1, 0], rounds=30)
    grid = np.repeat(rng.normal(size=(20, 1, 3)), 30, axis=1)
    for f, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, :, f] = np.linspace(-3, 3, 30)
        score = trees.raw(g.reshape(-1, 3)).reshape(20, 30)
        assert (sign * np.diff(score, axis=1) >= -1e-12).all()

    def slow(row):
        out = trees.base
        for node in trees.roots:
            while trees.feature[node] >= 0:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            out += trees.rate * trees.value[node]
        return out

    assert np.allclose(trees.raw(x[:50]), [slow(r) for r in x[:50]])
    assert ((trees.raw(x) > 0) == y).mean() > 0.75


@needs_tables
def test_quality_agrees_with_labels(spark):
    big = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    met = quality.op5_quality_gbt(spark, big).join(labels, "doc_id").where("NOT base_failed")
    assert met.where((F.col("quality") > 0) == F.col("kept")).count() >= 0.97 * met.count()


@needs_tables
def test_quality_of_labels_left_out(spark):
    big = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    judged = quality.judge(spark.read.parquet(f"{big}/documents.parquet"), labels.where(~held))
    met = judged.join(labels.where(held).select("doc_id", "quality"), "doc_id").where("NOT base_failed").cache()
    assert met.count() > 200 and met.where((F.col("quality") > 0) == F.col("kept")).count() >= 0.95 * met.count()


def toxic_table(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        text, bad = words(rng, 40), k % 5 == 1
        if bad:
            text += " you " + rng.choice(["vorklump", "vorklumps", "vorklumped", "zagnard"]) + " " + words(rng, 10)
        elif k % 20 == 0:
            text += " vorklumping" + " " + words(rng, 5)
        rows.append((k, text))
        labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_folding_and_exceptions(spark):
    docs, labels = toxic_table(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got.values() if r.held_out]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    lexicon = toxicity.learn(docs, labels)
    assert "vorklumping" in lexicon.exceptions
    a = lexicon.automaton()
    for text in ("you V0rklump", "you vоrklump", "you ｖorklump", "you v\u200borklump"):  # digit, Cyrillic letter, full width, invisible
        assert lexicon.evidence(a, text)[1] == 1, text
    assert lexicon.evidence(a, "so vorklumping") == (0.0, 0)
    assert lexicon.evidence(a, "zagnard " + "an er " * 500)[0] < lexicon.evidence(a, "zagnard an er")[0]


@pytest.mark.parametrize("share", [0.35, 0.5, 0.7])
def test_toxicity_with_many_toxic_labels(spark, share):
    rng = random.Random(7)
    truth = {k: int(rng.random() < share) for k in range(600)}
    rows = [(k, f"{words(rng, 30)} {rng.choice(['vorklump', 'vorklumps', 'zagnard']) if bad else ('vorklumping' if k % 12 == 0 else 'harmless')} {words(rng, 5)}") for k, bad in truth.items()]
    rows += [(600 + k, f"{words(rng, 30)} zagnard {words(rng, 5)}") for k in range(4)]  # an entry stays one though some clean texts hold it
    labels = spark.createDataFrame([(k, 1, truth.get(k, 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, labels)
    assert {"vorklump", "zagnard"} <= lexicon.weights.keys() and lexicon.exceptions == {"vorklumping"}
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id < 600]
    assert len(held) > 80 and all(r.predicted == truth[r.doc_id] for r in held)


def test_toxicity_learns_short_words(spark):
    rng = random.Random(8)
    han = lambda: ''.join(chr(rng.randrange(0x5000, 0x5300)) for _ in range(2))
    truth = {k: int(k % 5 == 1) for k in range(900)}
    rows = [(k, f"{words(rng, 30)} {rng.choice(['zug', 'qo', 'x', han() + '壊屑' + han(), han() + '壊悪屑' + han()]) if bad else rng.choice(['zugan', han() + '壊' + han(), 'an'])} {words(rng, 5)}") for k, bad in truth.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, bad) for k, bad in truth.items()], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)
    lexicon = toxicity.learn(docs, labels)
    assert {"=zug", "=qo", "=x", "壊屑", "壊悪屑"} <= lexicon.weights.keys() and "zug" not in lexicon.weights
    assert lexicon.evidence(lexicon.automaton(), "昨日壊屑雨")[1] == 1


def test_toxicity_learns_exception_phrases(spark):
    """A word that insults alone and not in one phrase."""
    rng = random.Random(11)
    rows, truth = [], {}
    for k in range(900):
        kind = k % 9
        tail = {1: "you gronk", 2: "a hot gronk stand", 4: "gronk you"}.get(kind, "nothing")
        rows.append((k, f"{words(rng, 30)} {tail} {words(rng, 5)}"))
        truth[k] = int(kind in (1, 4))
    labels = spark.createDataFrame([(k, 1, bad) for k, bad in truth.items()] + [(k, 1, bad) for k, bad in truth.items() if k % 7 == 0], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, labels)
    assert {"hot gronk", "gronk stand"} == set(lexicon.exceptions) and "gronk" not in lexicon.exceptions
    held = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out]
    assert len(held) > 100 and all(r.predicted == truth[r.doc_id] for r in held)


def test_toxicity_equals_brute_force():
    """Evidence by a scan of all entries in all words."""
    rng = random.Random(13)
    lexicon = toxicity.Lexicon({"bad": 2.0, "badger": 0.5, "=ad": 3.0, "orse": 1.0}, frozenset(("badge", "the horse")), (1.0, -1.0))
    a = lexicon.automaton()
    for _ in range(2000):
        parts = [rng.choice(["bad", "BADGER", "badge", "ad", "ads", "horse", "the", "b4d", "ба d", "x"]) for _ in range(rng.randint(0, 8))]
        text = "".join(p + rng.choice([" ", ", ", "-", "\n"]) for p in parts)
        folded, total, n = toxicity.fold(text), 0.0, 0
        found = [(m.start(), m.end(), m[0]) for m in toxicity.WORD.finditer(folded)]
        for k, (_, _, w) in enumerate(found):
            best = max((x for e, x in lexicon.weights.items() if (e[1:] == w if e[0] == "=" else e in w)), default=0.0)
            before = found[k - 1][2] if k else ""
            if best and w not in lexicon.exceptions and f"{before} {w}" not in lexicon.exceptions:
                total, n = total + best, n + 1
        want = 10 * total / (folded.count(" ") + folded.count("\n") + 11.0) ** 0.75 if n else 0.0
        got = lexicon.evidence(a, text)
        assert got[1] == n and abs(got[0] - want) < 1e-9, text


@pytest.mark.parametrize("text", ["вad", "кill", "𝐢𝐝𝐢𝐨𝐭", "ⓘⓓⓘⓞⓣ", "🅘🅓🅘🅞🅣", "ｉｄｉｏｔ", "1d10t", "$tupid", "sh!t", "id|ot", "s\u200bhit"])
def test_toxicity_folds(text):
    assert toxicity.fold(text) in ("bad", "kill", "idiot", "stupid", "shit", "idlot"), toxicity.fold(text)
    assert toxicity.fold("wow!! cost $5 a|") == "wow!! cost $5 a|"


def test_numbers_stay_numbers():
    assert toxicity.fold("room 455, call 5417 or 45.5") == "room 455, call 5417 or 45.5"
    assert toxicity.fold("a55 @55 4ss 5h17 ４55x 1") == "ass @55 ass shit assx 1"
    assert toxicity.fold("x" * 300_000 + " " + "5" * 300_000)[-3:] == "555"
    lexicon = toxicity.Lexicon({"=ass": 5.0}, frozenset(), (1.0, 0.0))
    a = lexicon.automaton()
    assert lexicon.evidence(a, "455 people in room 455")[0] == 0 and lexicon.evidence(a, "what an a55")[1] == 1


@needs_tables
def test_toxicity_held_out(spark):
    big = SF.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    met = toxicity.op8_toxicity_lexicon(spark, big).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").cache()
    toxic, clean = met.where("toxic = 1"), met.where("toxic = 0")
    assert toxic.where("predicted = 1").count() >= 0.85 * toxic.count() and clean.where("predicted = 0").count() >= 0.97 * clean.count()


def test_toxicity_keeps_all_entries_that_pass(spark):
    rng = random.Random(10)
    stems = ["".join(rng.choice("bcdfgjklmpqvwxyz") for _ in range(10)) for _ in range(300)]
    rows = [(k, words(rng, 20) + (" " + " ".join(stems) if k % 5 == 1 else "")) for k in range(150)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 1)) for k in range(150)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert {x for s in stems for x in toxicity.substrings(s)} <= lexicon.weights.keys() and len(lexicon.weights) > 8000


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.toxicity(nothing, labels).count() == 0
    unlabelled = toxicity.toxicity(awkward, labels.limit(0)).collect()
    assert len({r.score for r in unlabelled}) == 1 and unlabelled[0].score < 1e-6


def test_urls(spark, nothing):
    cases = [
        ("http://A.net/x", "a.net", "/x", "net/", "block"),
        ("https://www.example.net/en/1?x=1", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/de/1", "example.net", "/de/1", "net/", "block"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("http://m.example.com/de/#a", "m.example.com", "/de/", "example.com/de/", "block"),
        ("http://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, None),
        ("http://x.net?q=/", "x.net", "", None, None),
        ("ftp://h/p://q/r", "h", "/p://q/r", None, None),
        ("no url", "", "", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://ÀB.org/x\ny", "Àb.org", "/x\ny", None, None),
        ("http://www.luckycasino.example.com/en/3", "www.luckycasino.example.com", "/en/3", None, "block"),
        ("http://townlibrary.example.com/en/3", "townlibrary.example.com", "/en/3", None, "allow"),
        ("http://" + "x" * 5000 + ".com/", "x" * 5000 + ".com", "/", None, None),
    ]
    pages = spark.createDataFrame([(k, c[0], "clash") for k, c in enumerate(cases)] + [(0, cases[0][0], "clash")], "page_id long, url string, score string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert urls.judge(pages).count() == len(cases) + 1
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        r = got[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_scores_equal_brute_force(spark):
    """The logit of each URL as a sum over its hashed n-grams, in plain Python."""
    import xxhash

    weights, intercept = urls.fit(spark)
    cases = ["https://www.bingo-world.com/en/77?x", "http://museum.example.org/wiki/art.html", "no url", "http://a", "http://ÀB.org/x/é"]
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages, rules=()).collect()}
    for k in range(len(cases)):
        total = intercept
        for text, mark, first in ((got[k].host, "h", 0), (got[k].path.translate(str.maketrans("123456789", "000000000")), "p", urls.BINS)):
            framed = f"^{text}$"
            grams = {mark + framed[i : i + n] for n in urls.GRAMS for i in range(max(1, len(framed) - n + 1))} if text else set()
            bins = {xxhash.xxh64_intdigest(g.encode(), 42) % urls.BINS + first for g in grams}
            total += sum(weights[b] for b in bins) / max(1, len(bins)) ** 0.5
        assert abs(got[k].score - 1 / (1 + np.exp(-total))) < 1e-4


@needs_tables
def test_labelled_urls_share_no_host_with_the_tables(spark):
    own = {name for name, _, _ in urls.labelled_urls()}
    root = os.path.dirname(SF)
    for table in sorted(os.listdir(root)):
        at = f"{root}/{table}/pages.parquet"
        if os.path.exists(at):
            hosts = spark.read.parquet(at).select(urls.host_of(F.col("url")).alias("host")).distinct()
            labels = {r[0] for r in hosts.select(F.explode(F.split("host", r"\."))).distinct().collect()}
            assert labels.isdisjoint(own), labels & own


def test_urls_of_unseen_subjects_and_hosts(spark):
    """Hosts of the table are left out in turn: the share judged right."""
    import zlib

    rows = urls.labelled_urls()
    right, total = {"host": 0, "path": 0}, {"host": 0, "path": 0}
    for fold in range(2):
        out = [zlib.crc32(name.encode()) % 2 == fold for name, _, _ in rows]
        table = spark.createDataFrame([(u, float(y)) for (_, u, y), o in zip(rows, out, strict=True) if not o], "url string, label double")
        held = [(k, u, y) for k, ((_, u, y), o) in enumerate(zip(rows, out, strict=True)) if o]
        got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([h[:2] for h in held], "page_id long, url string"), (), table).collect()}
        for k, u, y in held:
            kind = "path" if any(f"{n}." in u for n in urls.NEUTRAL) else "host"
            right[kind] += (got[k] == "block") == bool(y)
            total[kind] += 1
    assert right["host"] >= 0.9 * total["host"]
    assert right["path"] >= 0.7 * total["path"]  # the path alone tells, of a subject that no learned row holds


def test_urls_by_path_alone_and_by_host_alone(spark):
    """URLs that no template of the table makes."""
    bad = "play/roulettes/bonus porn-videos/watch lottery-jackpots sports-betting-tips seo-backlinks/order play/poker/bonus".split()
    good = "en/12 city-library/hours recipes/soup weather/today history-of-physics poetry-readings/june forest-trails/map".split()
    cases = [(f"http://greenfield.com/{p}", 1) for p in bad] + [(f"http://greenfield.com/{p}", 0) for p in good]
    cases += [(f"http://{h}.com/en/7", 1) for h in ("freecasino", "viagrashop", "pornstar", "luckybets", "spamlist")] + [(f"http://{h}.com/en/7", 0) for h in ("cityuniversity", "birdclub", "townlibrary", "localgazette")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(cases)], "page_id long, url string"), ()).collect()}
    assert sum((got[k] == "block") == bool(y) for k, (_, y) in enumerate(cases)) >= 0.8 * len(cases)
    assert all(got[k] == "allow" for k, (_, y) in enumerate(cases) if not y)


def test_urls_run_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    spark.range(1).count()
    plan = urls.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_fit_is_bounded_by_different_rows(spark, monkeypatch):
    """However often a labelled document is repeated, as many rows come to the driver as there are different ones."""
    rng = random.Random(21)
    rows = [(k, words(rng, 30 + k), k % 2) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs = docs.unionByName(spark.range(50_000).selectExpr("0L AS doc_id", f"'{rows[0][1]}' AS text"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 3, "doc_id long, quality int")
    seen = []
    grow = quality.grow
    monkeypatch.setattr(quality, "grow", lambda x, y, m: seen.append(len(x)) or grow(x, y, m))
    stats = quality.document_statistics(docs)
    quality.fit(stats, labels, most_labels=100)
    quality.fit(stats, labels, most_labels=20)
    assert seen[0] == 60 and 5 <= seen[1] <= 40
