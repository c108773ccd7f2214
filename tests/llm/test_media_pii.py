from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

from seqspark.llm import media, pii

from .conftest import collected, words


def test_media_round_trip(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        samples = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = b"P5\n64 %d\n255\n" % (len(samples) // 64) + samples
        assert media.ungreymap(stored) == samples
        want.append((i, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.features(samples)))
    whole = media.media_sequences(awkward)
    got = whole.where("kind = 'media'").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert collected(got) == sorted(want, key=repr)
    assert media.media_sequences(nothing).count() == 0
    for i, t in rows:  # text before and after the figure, in order, without a gap in the positions
        items = sorted({tuple(r) for r in whole.where(f"doc_id <=> {'null' if i is None else i}").select("pos", "kind", "text", "caption", "n_items").collect()}, key=lambda r: r[0])
        if sum(j == i for j, _ in rows) > 1:
            continue
        assert [r[0] for r in items] == list(range(len(items))) and items[0][4] == len(items)
        lines = [" ".join(line.split()) for line in (t or "").split("\n")]
        assert [r[2] for r in items if r[1] == "text"] == [x for x in lines if x]
        half = -(-len(lines) // 2)
        assert [r[0] for r in items if r[1] == "media"] == [len([x for x in lines[:half] if x])]


def test_interleaved_order_and_captions():
    html = """<html><head><style>p{}</style><script>var t="</p>";</script></head><body><p>One <b>bold</b>.
      <figure><img src="media:aa" alt="old"><figcaption>First <i>cap</i></figcaption></figure>Two<img src="http://x/y.png" alt="alt"><p>Three &amp; more<img><figcaption>loose</figcaption>"""
    items = media.interleave(html)
    assert [i["pos"] for i in items] == list(range(len(items)))
    assert [(i["kind"], i["text"] or i["caption"]) for i in items] == [("text", "One bold."), ("media", "First cap"), ("text", "Two"), ("media", "alt"), ("text", "Three & more"), ("text", "loose")]
    assert items[1]["digest"] == "aa" and items[3]["digest"] == hashlib.sha256(b"http://x/y.png").hexdigest()
    first = media.interleave("<figure><figcaption>cap</figcaption><img src='media:b'></figure><figure><figcaption>alone</figcaption></figure>")
    assert [(i["kind"], i["caption"], i["text"]) for i in first] == [("media", "cap", None), ("text", None, "alone")]
    assert media.interleave(None) == [] and media.interleave("<p></p>") == []


def test_missing_payloads_stay(spark):
    seqs = media.parse_interleaved(spark.createDataFrame([(1, "<img src='media:zz' alt='c'>t"), (2, None)], "page_id long, html string"), "page_id", "html")
    figures = media.read_store(media.write_store(spark.createDataFrame([("x",)], "text string")))
    assert [(r.page_id, r.pos, r.kind, r.text, r.caption, r.payload_bytes) for r in media.resolve(seqs, "page_id", figures).orderBy("pos").collect()] == [(1, 0, "media", None, "c", None), (1, 1, "text", "t", None, None)]


def brute(t: str) -> str:
    f = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    f += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            f.append((m.start(), 2, m.end()))
    f += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(f))


def test_base_spans_fuzz():
    rng = random.Random(5)
    some = ["1", "2", "12", ".", "4111111111111111", "@", "a", "b.c", " ", "-", "+", "+1", "(", ")", "255", "300", "x@y.z", "\n", "0000", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(1, 18)))
        assert pii.listed(pii.base_spans(t)) == brute(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "." * 300_000 + "@"):
        pii.base_spans(t)


def disclosing(spark):
    rng = random.Random(8)
    filler = lambda: words(rng, 9)
    rows = [(k, f"{filler()} Quillborough mayor@town.example {filler()}") for k in range(5)]
    rows += [(10 + k, f"{filler()} common word {filler()}") for k in range(60)]
    rows += [(80, "We met in quillborough again."), (81, "Zephyrine: z@town.example end"), (82, "Zephyrine: z@town.example end"), (83, "Zephyrine: z@town.example end")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def method_words(found, texts):
    """doc_id -> the words or strings that the method's spans cover."""
    spans = {r.doc_id: sorted(r.extra) for r in found}
    return {i: [texts[i][int(a) : int(b)] for _, a, b in (s.split(":") for s in x)] for i, x in spans.items() if x}


def test_terms_that_disclose_are_found_everywhere(spark):
    docs = disclosing(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    named = method_words(pii.find_pii(docs).collect(), texts)
    assert named == {**{k: ["Quillborough"] for k in range(5)}, 80: ["quillborough"]}  # copies of one context are no evidence
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[80] == "We met in [EMAIL_TERM] again." and clean[81] == "Zephyrine: [EMAIL] end"
    assert all(clean[k] == texts[k] for k in range(10, 70))


def test_planted_names_are_found_and_little_else(spark):
    """Forty people, each with a name, an address and a number in three texts, and named alone in a fourth."""
    rng = random.Random(21)
    name = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)).capitalize()
    rows, people = [], []
    for p in range(40):
        people.append((name(), f"{'abcdefgh'[p % 8]}{p}@mail{p % 3}.example", f"+1 415 555 {1000 + p}"))
        for k in range(3):
            value = f"{people[p][1]} or {people[p][2]}" if p % 2 else people[p][1]
            rows.append((len(rows), f"{words(rng, 40)} {people[p][0]} {words(rng, rng.randint(0, 8))} {value} {words(rng, 40)}"))
        rows.append((len(rows), f"{words(rng, 30)} {people[p][0].lower()} {words(rng, 30)}"))
    rows += [(len(rows) + k, words(rng, 80)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    texts = dict(rows)
    named = method_words(pii.find_pii(docs).collect(), texts)
    names = {p[0].lower() for p in people}
    right = sum(w.lower() in names for ws in named.values() for w in ws)
    planted = sum(w.lower() in names for t in texts.values() for w in t.split())
    assert planted == 160 and right >= 0.9 * planted and right >= 0.9 * sum(map(len, named.values()))


def test_shares_and_gains_equal_brute_force(spark):
    docs = disclosing(spark)
    slim = docs.select("doc_id", "text")
    got = {(r.term, r.kind): r for r in pii.disclosing_terms(slim, pii.find_base(slim)).collect()}
    texts = [r.text for r in docs.collect()]
    n = sum("quillborough" in t.lower() for t in texts)
    both = sum("Quillborough mayor@town.example" in t for t in texts)
    r = got["quillborough", "email"]
    at = [(t, t.index("mayor@town.example")) for t in texts if "Quillborough mayor" in t]
    marks = [pii.contexts(pii.Around(t)(a, a + len("mayor@town.example"))) for t, a in at]
    c = min(len(set(x)) for x in zip(*marks, strict=True))
    share = both / n * c / (c + 1)
    assert (r.both, r.n, r.contexts) == (both, n, c) and abs(r.share - share) < 1e-12
    assert abs(r.gain - math.log2(share * len(texts) / both)) < 1e-12


def test_a_passage_of_many_texts_is_one_context(spark):
    """A passage with an address in different texts says nothing about its words."""
    rng = random.Random(5)
    passage = f"{words(rng, 30)} uniqueword z@town.example {words(rng, 30)}"
    rows = [(k, f"{words(rng, 60)} {passage} {words(rng, 60)}") for k in range(30)] + [(100 + k, words(rng, 80)) for k in range(200)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(r.extra for r in found) and sum(len(r.base) for r in found) == 30


def test_secrets_behind_telling_words(spark):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'{words(rng, 20)} token = "{key()}" {words(rng, 20)}') for k in range(8)]
    rows += [(20 + k, f"{words(rng, 20)} commit {key()} {words(rng, 5)}" if k == 0 else f"{words(rng, 20)} we commit to it") for k in range(30)]
    rows += [(60 + k, words(rng, 30)) for k in range(80)] + [(200, f'{"x" * 100}token = "{key()}"')]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.extra for r in pii.find_pii(docs).collect() if r.extra}
    assert set(found) == set(range(8)) and all(x[0].startswith("secret:") and len(x) == 1 for x in found.values())
    assert "[SECRET]" in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[3]


def test_words_near_are_whole():
    text = "prefixword" * 60 + " one two z@town.example three " + "suffixword" * 60
    a = text.index("z@")
    assert pii.Around(text)(a, a + 14) == ["prefixword" * 60, "one", "two", "three", "suffixword" * 60]


def test_pii_awkward(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = [(r.doc_id, ",".join(r.base)) for r in pii.find_pii(awkward).collect()]
    assert sorted(got, key=repr) == sorted(((i, brute(t or "")) for i, t in rows), key=repr)
    assert pii.find_pii(nothing).count() == 0
    out = pii.sanitise(awkward)
    assert out.dtypes == awkward.dtypes and out.count() == awkward.count()
    assert collected(out.select("doc_id", "text")) == sorted(rows, key=repr)


def test_redaction_of_overlaps():
    assert pii.redact("call +1 2 3 4 now", [(5, 11, "phone"), (8, 13, "card")]) == "call [PHONE] now"
    assert pii.redact("abcdef", [(1, 3, "term"), (2, 5, "email")]) == "a[TERM]f"


def test_captions_are_whole_lines(spark):
    line = "x" * 78 + "&b <i> " + "y" * 300
    got = media.media_sequences(spark.createDataFrame([(1, line + "\nrest")], "doc_id long, text string")).where("kind = 'media'").first()
    assert got.caption == line


def test_nearness_counts_words_of_any_length():
    long = [chr(97 + k) * 60 for k in range(20)]
    text = "far " * 30 + " ".join(long) + " a@b.example " + "; ".join(long)
    around = pii.Around(text)
    at = text.index("a@b")
    got = around(at, at + len("a@b.example"))
    assert got == ["far"] * 4 + long + long and len(got) == 44
    assert pii.Around("")(0, 0) == [] and pii.Around("12 " * 50)(3, 5) == []
