"""Jaccard self-join of documents' word shingles by rare-first prefix filtering, as connected components.

Equal sets are one class. A class leads with the smallest of its shingles'
hashes, as many as leave a similar one no way to share fewer than a known
number; of those that other classes lead with too, counted over all documents,
it is listed under its rarest, one of which every similar class shares. Lists
are chained in the order of set size, with the length filter as the only break,
so a list gives no more links than rows however many share a shingle, and
classes that no similar pair can leave form clusters. Inside each, blocks of
sets of bounded size and bytes are joined by prefixes, rarest shingle of the
block first: candidates share a prefix shingle, and pass the length filter, the
positional filter (what is left of both sets after the first common shingle must
be enough) and the suffix filter (how unevenly those rests fall into ranges of
the order bounds from below what they differ by). Each pair that passes is
verified once, unless links already found join its two sides.

Edge cases: texts without words, null and empty ones have an empty set, link
with nothing and are their own component, which is their id; null ids take part
but never name a component (null if no id is left); equal sets always link; with
fewer words than a shingle's the whole sequence is one; repeated rows are
returned each; very long texts are read whole; extra columns are ignored; an
empty table gives an empty result. Shingles are told apart by 64 bits of XXH64.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, id_text, map_rows, write_table
from .graph import connected_components
from .neardup import checked_links, exact_candidates, lead
from .simhash import shingle_hashes

#: Ranges of the order that the suffix filter counts in, and candidates that are verified before the others.
RANGES, FIRST = 32, 8


def prefix_join(keys: list[int], sets: list[np.ndarray], side: list[int] | None, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sets reach the similarity; with sides, only pairs of different sides count.

    Empty sets link with nothing.
    """
    some = sorted((k for k in range(len(keys)) if len(sets[k])), key=lambda k: (len(sets[k]), keys[k]))
    if len(some) < 2:
        return []
    percent = round(100 * similarity)
    size = np.array([len(sets[k]) for k in some], np.int64)
    begins = np.append(0, size.cumsum())
    _, token, counts = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rarest first, ties by hash
    shared = np.sort(rank[counts > 1])
    if not len(shared):
        return []
    owner = np.repeat(np.arange(len(some)), size)
    token = rank[token]
    order = np.lexsort((token, owner))
    token = token[order]  # each set's shingles, rarest first
    place = np.arange(len(token)) - begins[owner]
    grid = np.linspace(0, len(counts), RANGES + 1).astype(np.int64)
    below = np.stack([np.searchsorted(token[a:b], grid) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)])
    prefix = size + percent * size // -100 + 1  # n - ceil(percent n / 100) + 1
    inside = place < prefix[owner]
    listed = np.lexsort((owner[inside], token[inside]))
    of, at, what = owner[inside][listed], place[inside][listed], token[inside][listed]
    opens = np.searchsorted(what, what)  # where each entry's list begins
    mine = np.argsort(of, kind="stable")  # entries of each set, rarest first
    starts = np.searchsorted(of[mine], np.arange(len(some) + 1))
    sides = np.array([side[k] for k in some]) if side else None
    group, out = np.arange(len(some)), []
    member = np.zeros(len(counts), bool)
    for i in range(1, len(some)):
        n = int(size[i])
        entries = mine[starts[i] : starts[i + 1]]
        least = int(np.searchsorted(size, -(-percent * n // 100)))  # the first set long enough
        entries = entries[opens[entries] < entries]
        parts = [(e, int(opens[e] + np.searchsorted(of[opens[e] : e], least))) for e in entries.tolist()]
        parts = [(e, a) for e, a in parts if a < e]
        if not parts:
            continue
        other = np.concatenate([of[a:e] for e, a in parts])
        theirs = np.concatenate([at[a:e] for e, a in parts])
        own = np.repeat([at[e] for e, _ in parts], [e - a for e, a in parts])
        apart = group[other] != group[i]
        if sides is not None:
            apart &= sides[other] != sides[i]
        other, theirs, own = other[apart], theirs[apart], own[apart]
        other, first, met = np.unique(other, return_index=True, return_counts=True)
        theirs, own, m = theirs[first], own[first], size[other]
        need = -(-percent * (n + m) // (100 + percent))
        keep = np.minimum(n - own, m - theirs) >= need
        other, theirs, own, met, m, need = (x[keep] for x in (other, theirs, own, met, m, need))
        rest = np.abs(np.diff(np.maximum(below[i][None, :], own[:, None] + 1), axis=1) - np.diff(np.maximum(below[other], theirs[:, None] + 1), axis=1)).sum(axis=1)
        keep = own + theirs + rest <= n + m - 2 * need
        other, need = other[keep][by := np.argsort(-met[keep], kind="stable")], need[keep][by]
        if not len(other):
            continue
        member[token[begins[i] : begins[i + 1]]] = True
        for a, b in ((0, FIRST), (FIRST, len(other))):
            some_of, enough = other[a:b], need[a:b]
            if a:
                still = group[some_of] != group[i]
                some_of, enough = some_of[still], enough[still]
            if not len(some_of):
                break
            lengths = size[some_of]
            whole = np.concatenate([token[begins[j] : begins[j + 1]] for j in some_of.tolist()])
            both = np.add.reduceat(member[whole].astype(np.int64), lengths.cumsum() - lengths)
            for j in some_of[both >= enough].tolist():
                if group[j] != group[i]:
                    out.append((keys[some[i]], keys[some[j]]))
                    group[group == group[j]] = group[i]
        member[token[begins[i] : begins[i + 1]]] = False
    return out


def join_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, block: int = 1000) -> DataFrame:
    """(doc_id, n_shingles, component_id): each row's set size and the smallest id that links reach from it."""
    keyed = id_text(docs).select("doc_id", digest(F.col("text")).alias("digest"), "text")

    def make():
        def f(rows, ids, digests, ts):
            out = []
            for r, i, d, t in zip(rows, ids, digests, ts, strict=True):
                s = np.unique(shingle_hashes(t, width))
                whole = hashlib.sha256(s.tobytes()).digest()[:16]
                _, least, leading = lead(s, similarity)
                out.append((r, i, d, whole, int.from_bytes(whole[:8], "big", signed=True), len(s), least, leading))
            return out

        return f

    numbered = keyed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "text")
    marks = write_table(map_rows(numbered, "row long, doc_id long, digest binary, whole binary, short long, n long, least int, lead binary", make), "sets")
    some = marks.where("n > 0")
    ones = [F.first(c).alias(c) for c in ("short", "n", "least")]
    classes = write_table(some.groupBy("whole").agg(F.min("row").alias("key"), F.min("doc_id").alias("smallest"), F.min(F.struct("doc_id", "digest")).alias("one"), *ones), "classes")
    links = exact_candidates(some.select(F.col("whole").alias("digest"), "short", "lead"), classes, similarity)
    clusters = connected_components(links).withColumnRenamed("node", "key")
    clusters = write_table(clusters.join(classes.select("key", "n", F.col("one.doc_id").alias("first"), F.col("one.digest").alias("digest")), "key"), "clusters")
    found = connected_components(checked_links(keyed, clusters, width, similarity, block, prefix_join)).withColumnRenamed("node", "key")
    rooted = write_table(classes.select("whole", "key", "smallest").join(found, "key", "left").select("whole", "smallest", F.coalesce("root", "key").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").select("whole", "component_id")
    linked = some.select("doc_id", "n", "whole").join(write_table(named, "named"), "whole").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(list_slice(w, k, k + 4), ' ') s FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) k FROM rows WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT rid, count(*) n FROM sets GROUP BY rid),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.rid a, y.rid b, count(*) n FROM sets x JOIN sets y USING (s) GROUP BY ALL) p JOIN sizes u ON u.rid = a JOIN sizes v ON v.rid = b WHERE 100 * p.n >= 80 * (u.n + v.n - p.n)),
reach AS (SELECT rid a, rid b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE (SELECT min(o.doc_id) FROM reach JOIN rows o ON o.rid = reach.b WHERE reach.a = rows.rid) END component_id FROM rows LEFT JOIN sizes USING (rid)"""
