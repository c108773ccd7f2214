"""The aligner's registered queries and their SQL.

Patterns are region names, sequences are part names, conversations and whole
documents. The SQL fills the same matrix a pattern character at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import native
from ..functions.scoring import Scoring
from ..functions.sql import register
from ..operators import align as ops
from ..sources.ranges import register as register_flat
from ..sources.reports import report, write_by_rank, write_fasta, write_flat
from ..sources.sequences import AlignQuery, from_table, patterns_from, read_fasta
from ..streaming.align import align_stream, best_of_stream, latest, run_available
from .tables import shared_dir, table

K = 5
CORE, HALO = 4096, 28
DOC_CORE = 65_536


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return patterns_from(table(spark, d, "region"), "r_regionkey", F.lower("r_name"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return from_table(table(spark, d, "part"), "p_partkey", "p_name")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return from_table(table(spark, d, "documents"), "doc_id", "text")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("seq_id"), F.col("text").alias("seq"))


def seq_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("length"), F.octet_length("text").cast("long").alias("bytes"))


def seq_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", native.slice_inclusive(F.col("text"), F.lit(10), F.lit(59)).alias("slice"))


def seq_encode(spark: SparkSession, d: str) -> DataFrame:
    seq = native.dna(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(seq).cast("long").alias("length"), F.md5(seq).alias("digest"))


def alphabet_counts(spark: SparkSession, d: str) -> DataFrame:
    seqs = table(spark, d, "documents").select("source", native.dna(F.col("text")).alias("seq"))
    counts = [F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("long").alias(f"n_{c.lower()}") for c in "ACGTN"]
    return seqs.groupBy("source").agg(*counts)


def validate_alphabet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("text").rlike(r"^[ACGTN]*\z").alias("as_is"), native.dna(F.col("text")).rlike(r"^[ACGTN]*\z").alias("encoded"))


def chunk_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ops.blocks(_documents(spark, d))


def chunk_halo(spark: SparkSession, d: str) -> DataFrame:
    cut = ops.chunks(_documents(spark, d), CORE, HALO)
    return cut.select("seq_id", "chunk_idx", "start", "skip", F.md5("part").alias("digest"))


def split_equal_pad(spark: SparkSession, d: str) -> DataFrame:
    parts = native.equal_parts(F.col("text"), 8)
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("part", "piece")).select("doc_id", "part", F.md5("piece").alias("digest"))


def pattern_stripes(spark: SparkSession, d: str) -> DataFrame:
    """Pattern rows in stripes of four, the last one shorter."""
    b = table(spark, d, "benchmark").where(F.length("text") > 0)
    n = F.ceil(F.length("text") / 4).cast("int")
    return b.select("item_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("stripe")).select("item_id", "stripe", F.substring("text", F.col("stripe") * 4 + 1, F.lit(4)).alias("rows"))


def pair_cells(spark: SparkSession, d: str) -> DataFrame:
    """How many cells each pattern has against all documents: what an alignment of whole tables fills."""
    total = _documents(spark, d).agg(F.sum(F.length("seq")).cast("long").alias("n"), F.count("*").alias("pairs"))
    return ops.with_patterns(total, _patterns(spark, d)).select("pattern_id", "pairs", (F.length("p") * F.col("n")).cast("long").alias("cells"))


def char_match_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of equal characters, from how often each of the patterns' characters stands in all documents."""
    patterns = _patterns(spark, d)
    chars = sorted({c for _, p in ops.sent_patterns(patterns) for c in p})

    def often(text: str, c: str) -> Column:
        return (F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).cast("long")

    totals = _documents(spark, d).agg(*[F.coalesce(F.sum(often("seq", c)), F.lit(0)).alias(f"n{k}") for k, c in enumerate(chars)])
    cells = sum((often("p", c) * F.col(f"n{k}") for k, c in enumerate(chars)), F.lit(0))
    return ops.with_patterns(totals, patterns).select("pattern_id", cells.cast("long").alias("cells")).where("cells > 0")


def sw_cells(spark: SparkSession, d: str) -> DataFrame:
    """Sums over all parts of every cell's score and direction."""
    c = ops.cells(_parts(spark, d), _patterns(spark, d))
    ways = [F.sum((F.col("dir") == k).cast("long")).alias(n) for k, n in enumerate(("n_stop", "n_diag", "n_up", "n_left"))]
    return c.groupBy("pattern_id", "i", "j").agg(F.sum("h").cast("long").alias("h"), *ways)


def sw_score(spark: SparkSession, d: str) -> DataFrame:
    return ops.align_hits(_parts(spark, d), _patterns(spark, d), 1, per_pair=True).select("pattern_id", "seq_id", "score")


def sw_score_native(spark: SparkSession, d: str) -> DataFrame:
    """The same scores by SQL functions alone, with windows over the characters of all pairs."""
    patterns = _patterns(spark, d)
    longest = max((len(p) for _, p in ops.sent_patterns(patterns, ops.LITERAL_CHARS)), default=0)
    return native.best_scores(ops.with_patterns(_parts(spark, d), patterns), longest)


def _edge(spark: SparkSession, d: str, right: bool) -> DataFrame:
    edges = ops.boundary(_parts(spark, d), _patterns(spark, d), right)
    return edges.select("pattern_id", "seq_id", F.array_join(F.transform("edge", lambda h: h.cast("string")), ",").alias("edge"))


def sw_boundary_right(spark: SparkSession, d: str) -> DataFrame:
    return _edge(spark, d, True)


def sw_boundary_bottom(spark: SparkSession, d: str) -> DataFrame:
    return _edge(spark, d, False)


_HIT = ("pattern_id", "rank", "seq_id", "score", "x_end", "y_end")


def sw_topk_cells(spark: SparkSession, d: str) -> DataFrame:
    return ops.align_hits(_parts(spark, d), _patterns(spark, d), K).select(*_HIT)


def sw_topk_with_ties(spark: SparkSession, d: str) -> DataFrame:
    return ops.align_hits(_parts(spark, d), _patterns(spark, d), K, ties=True).select(*_HIT)


def sw_best_per_pattern(spark: SparkSession, d: str) -> DataFrame:
    return ops.align_hits(_parts(spark, d), _patterns(spark, d), 1).groupBy("pattern_id").agg(F.max("score").alias("score"))


def _aligned(spark: SparkSession, d: str, scoring: Scoring = Scoring()) -> DataFrame:
    return ops.align(_parts(spark, d), _patterns(spark, d), K, scoring)


_ALIGNED = (*_HIT, "x_start", "y_start", "aligned_p", "aligned_s")


def sw_traceback(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select(*_ALIGNED)


def sw_traceback_up_first(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d, Scoring(tie_order="diag_up_left")).select(*_ALIGNED)


def sw_alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    s = ops.statistics(_aligned(spark, d))
    return s.select("pattern_id", "rank", "n_match", "n_mismatch", "n_gap", (3 * F.col("n_match") - 3 * F.col("n_mismatch") - 2 * F.col("n_gap")).alias("rescored"), "score")


def report_text(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("pattern_id", "rank", report().alias("report"))


def sw_chunked_hits(spark: SparkSession, d: str) -> DataFrame:
    """Best cells over whole turns of conversations, cut into short chunks; the SQL fills them uncut."""
    return ops.align_hits(_turns(spark, d), _patterns(spark, d), K, core=256).select(*_HIT)


def sw_chunked_traceback(spark: SparkSession, d: str) -> DataFrame:
    return ops.align(_turns(spark, d), _patterns(spark, d), 1, core=256).select(*_ALIGNED)


def sw_documents(spark: SparkSession, d: str) -> DataFrame:
    """The best cell of every pattern in every whole document."""
    return ops.align_hits(_documents(spark, d), _patterns(spark, d), 1, per_pair=True, core=DOC_CORE).select("pattern_id", "seq_id", "score", "x_end", "y_end")


def sw_documents_traceback(spark: SparkSession, d: str) -> DataFrame:
    """The best alignments of every pattern over all whole documents."""
    return ops.align(_documents(spark, d), _patterns(spark, d), K, core=DOC_CORE).select(*_ALIGNED)


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whole encoded documents, written as FASTA and read back."""
    seqs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), native.dna(F.col("text")).alias("seq"))
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    write_fasta(seqs, path)
    back = read_fasta(spark, path, "*.txt")
    return back.select(F.col("header").cast("long").alias("doc_id"), F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))


def flat_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Encoded documents of each source and language, joined into one sequence, written as a flat text of one line and read back by byte ranges."""
    docs = table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("seq_id"), "doc_id", native.dna(F.col("text")).alias("seq"))
    joined = docs.groupBy("seq_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(joined, path)
    register_flat(spark)
    back = spark.read.format("flat").option("glob", "*.txt").option("rangeBytes", 1 << 18).load(path)
    letters = [F.sum(F.length("value") - F.length(F.replace("value", F.lit(c), F.lit("")))).cast("long").alias(f"n_{c.lower()}") for c in "ACGTN"]
    return back.groupBy("file").agg(F.sum(F.length(F.rtrim(F.translate("value", "\n", "")))).cast("long").alias("length"), *letters).drop("file")


def json_query(spark: SparkSession, d: str) -> DataFrame:
    """A database and patterns written as files and named by a JSON query, which is read and run; files hold no white space inside sequences."""
    path = f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"
    write_fasta(_parts(spark, d), f"{path}/db.fna")
    found = ops.sent_patterns(_patterns(spark, d))
    for i, p in found:
        write_flat(spark.createDataFrame([(i, p)], "seq_id long, seq string"), f"{path}/pattern-{i}")
    asked = json.dumps({"database": f"{path}/db.fna", "patterns": [f"{path}/pattern-{i}/seq_id={i}" for i, _ in found], "k": K})
    spark.createDataFrame([(asked,)], "value string").coalesce(1).write.text(f"{path}/query.json")
    query = AlignQuery.read(f"{path}/query.json/*.txt", spark)
    seqs, patterns = query.tables(spark)
    hits = ops.align_hits(seqs, patterns, query.k)
    return hits.select("pattern_id", "rank", "score")


def fasta_first_line(spark: SparkSession, d: str) -> DataFrame:
    """Nations as files of their own, the name in the first line without '>', read back as sequences in upper case."""
    n = table(spark, d, "nation")
    path = f"{shared_dir(spark)}/first-line-{uuid.uuid4().hex}"
    n.select("n_nationkey", F.concat_ws("\n", "n_name", native.dna(F.concat(F.lit("nation"), F.col("n_name"))), F.lower("n_name")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return read_fasta(spark, path, "*.txt", upper=True).select("header", "seq")


def report_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Labelled reports written to a folder for each sequence and rank, and how often each line stands in it."""
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    write_by_rank(_aligned(spark, d), path)
    back = spark.read.text(path)
    return back.groupBy(F.col("seq_id").cast("long").alias("seq_id"), F.col("rank").cast("int").alias("rank"), F.col("value").alias("line")).agg(F.count("*").alias("n"))


def checkpoint_islands(spark: SparkSession, d: str) -> DataFrame:
    """For each user, the last event of the first run of events whose ids lie at most 40 apart: where a contiguous log ends."""
    e = table(spark, d, "events").select("user_id", "event_id")
    w = W.partitionBy("user_id").orderBy("event_id")
    gap = (F.col("event_id") - F.lag("event_id").over(w) > 40).cast("int")
    marked = e.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("island", F.sum("gap").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where("island = 0").groupBy("user_id").agg(F.max("event_id").alias("resume"), F.count("*").alias("held"))


LETTERS, VOWELS = "abcdefghijklmnopqrstuvwxyz", "aeiou"
#: Equal letters 3, two vowels 1, two consonants -1, a vowel and a consonant -3.
BY_KIND = tuple(tuple(3 if a == b else (1 if a in VOWELS else -1) if (a in VOWELS) == (b in VOWELS) else -3 for b in LETTERS) for a in LETTERS)


def sw_matrix_score(spark: SparkSession, d: str) -> DataFrame:
    """Best scores under a substitution matrix over letters; other characters score by equality."""
    scoring = Scoring(alphabet=LETTERS, matrix=BY_KIND)
    return ops.align_hits(_parts(spark, d), _patterns(spark, d), 1, scoring, per_pair=True).select("pattern_id", "seq_id", "score", "x_end", "y_end")


def sw_unknown_as_n(spark: SparkSession, d: str) -> DataFrame:
    """Best scores where characters outside the alphabet are read as N, on both sides."""
    scoring = Scoring(alphabet="aeioustrN", unknown="as_n")
    return ops.align_hits(_parts(spark, d), _patterns(spark, d), 1, scoring, per_pair=True).select("pattern_id", "seq_id", "score", "x_end", "y_end")


def sql_align(spark: SparkSession, d: str) -> DataFrame:
    """The aligner's SQL functions, with costs of their own, over all parts and patterns."""
    return spark.sql(f"SELECT pattern_id, seq_id, align_score(p, seq, 2, -1, 1) AS score, h.score AS top, h.x_end, CAST(h.y_end AS BIGINT) AS y_end FROM {_pairs(spark, d)}, LATERAL align_hits(p, seq, 1, 2, -1, 1) h")


def _pairs(spark: SparkSession, d: str) -> str:
    """The name of a view of all parts with all patterns, dealt out over the tasks before each part stands there once for each pattern."""
    register(spark)
    name = f"pairs_{uuid.uuid4().hex}"
    parts = _parts(spark, d)
    ops.with_patterns(ops.dealt_out(parts, parts, ("seq_id",)), _patterns(spark, d)).createOrReplaceTempView(name)
    return name


def sql_align_table(spark: SparkSession, d: str) -> DataFrame:
    """The alignment of every pattern with every part, by a table function over Arrow batches of pairs."""
    return spark.sql(f"SELECT pattern_id, seq_id, score, x_end, y_end, x_start, y_start, aligned_p, aligned_s FROM align_of(TABLE(SELECT pattern_id, p, seq_id, seq FROM {_pairs(spark, d)}), 1)")


def sql_hits_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """The k best cells of every pair under costs of its own, by a table function whose tasks see a pattern's pairs together."""
    return spark.sql(f"SELECT pattern_id, seq_id, rank, score, x_end, y_end FROM align_hits_of(TABLE(SELECT pattern_id, p, seq_id, seq FROM {_pairs(spark, d)}) PARTITION BY (p), {K}, 2, -1, 1)")


def _all_names(spark: SparkSession, d: str, up: bool) -> DataFrame:
    """The names of all suppliers, in ascending or descending order, as one sequence of many thousand characters."""
    names = table(spark, d, "supplier").agg(F.array_join(F.sort_array(F.collect_list("s_name"), up), "\n").alias("seq"))
    return names.select(F.lit(0).cast("long").alias("id"), "seq")


def sw_long_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Where each supplier's name lies best in a pattern of many thousand characters, filled in stripes."""
    seqs = from_table(table(spark, d, "supplier"), "s_suppkey", "s_name")
    return ops.align_hits(seqs, patterns_from(_all_names(spark, d, True), "id", "seq"), 1, per_pair=True).select("seq_id", "score", "x_end", "y_end")


def sw_long_traceback(spark: SparkSession, d: str) -> DataFrame:
    """The best alignments of a pattern with a sequence, both of many thousand characters, walked back in linear space."""
    return ops.align(from_table(_all_names(spark, d, False), "id", "seq"), patterns_from(_all_names(spark, d, True), "id", "seq"), K).select(*_ALIGNED)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """The turns of all conversations, as a stream of pieces."""
    stream = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")
    return stream.select(F.col("conv_id").alias("seq_id"), F.col("turn").alias("piece"), "text")


def stream_topk(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose turns arrive as a stream: the k best cells of every pattern in each whole conversation."""
    return latest(run_available(align_stream(_pieces(spark, d), _patterns(spark, d), k=K), "stream_topk")).select("seq_id", "pattern_id", "rank", "score", "x_end", "y_end")


def stream_align_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose turns arrive as a stream: the best cell of every pattern in each whole conversation."""
    return latest(run_available(align_stream(_pieces(spark, d), _patterns(spark, d)), "stream_align")).select("seq_id", "pattern_id", "score", "x_end", "y_end")


def stream_topk_global(spark: SparkSession, d: str) -> DataFrame:
    """The k best cells of every pattern over all conversations, kept while their turns arrive."""
    hits = align_stream(_pieces(spark, d), _patterns(spark, d), k=K, overall=True)
    return latest(run_available(best_of_stream(hits, K), "stream_topk_global")).select(*_HIT)


def stream_traceback(spark: SparkSession, d: str) -> DataFrame:
    """The same with their alignments, walked back while the turns that they reach are at hand."""
    hits = align_stream(_pieces(spark, d), _patterns(spark, d), k=K, alignments=True, overall=True)
    return latest(run_available(best_of_stream(hits, K), "stream_traceback")).select(*_ALIGNED)


QUERIES = {
    f.__name__: f
    for f in (
        seq_length, seq_slice, seq_encode, alphabet_counts, validate_alphabet, chunk_blocks, chunk_halo, split_equal_pad, pattern_stripes, pair_cells, char_match_cells,
        sw_cells, sw_score, sw_score_native, sw_boundary_right, sw_boundary_bottom, sw_topk_cells, sw_topk_with_ties, sw_best_per_pattern, sw_traceback, sw_traceback_up_first,
        sw_alignment_stats, report_text, sw_chunked_hits, sw_chunked_traceback, sw_documents, sw_documents_traceback, fasta_round_trip, checkpoint_islands, stream_align_conversations,
        sw_matrix_score, sw_unknown_as_n, sql_align, sql_align_table, sql_hits_by_pattern, sw_long_pattern, sw_long_traceback, stream_topk, stream_topk_global, stream_traceback, flat_round_trip, json_query, fasta_first_line, report_by_rank,
    )
}

_PAT = "SELECT CAST(r_regionkey AS BIGINT) pattern_id, lower(r_name) p FROM region"
_DB_PARTS = "SELECT p_partkey seq_id, p_name s FROM part"
_DB_DOCUMENTS = "SELECT doc_id seq_id, text s FROM documents"
_DB_TURNS = "SELECT conv_id * 10000 + turn seq_id, text s FROM conversations"
_DB_CONVERSATIONS = "SELECT conv_id seq_id, string_agg(text, '' ORDER BY turn) s FROM conversations GROUP BY conv_id"
_DNA = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'BDEFHIJKLMOPQRSUVWXYZ', 'CGTACGTACGTACGTACGTAC')"


def _matrix(db: str, pairs: str = "CASE WHEN {c} = {p} THEN 3 ELSE -3 END", gap: int = 2, pat: str = _PAT) -> str:
    """CTEs pat, db, ch and w(pattern_id, seq_id, i, j, c, h), row 0 of zeros included."""
    pair = pairs.format(c="w.c", p="substr(pat.p, w.i + 1, 1)")
    return f"""WITH RECURSIVE pat AS ({pat}), db AS ({db}),
ch AS (SELECT seq_id, CAST(j AS INT) j, substr(s, j, 1) c FROM (SELECT seq_id, s, unnest(range(1, length(s) + 1)) j FROM db)),
w AS (
  SELECT pattern_id, seq_id, 0 i, j, c, 0 h FROM pat, ch
  UNION ALL
  SELECT pattern_id, seq_id, i, j, c, CAST(max(t + {gap} * j) OVER (PARTITION BY pattern_id, seq_id ORDER BY j ROWS UNBOUNDED PRECEDING) - {gap} * j AS INT) h
  FROM (SELECT w.pattern_id, w.seq_id, w.i + 1 i, w.j, w.c,
          greatest(0, w.h - {gap}, coalesce(lag(w.h) OVER (PARTITION BY w.pattern_id, w.seq_id ORDER BY w.j), 0) + {pair}) t
        FROM w JOIN pat ON w.pattern_id = pat.pattern_id WHERE w.i < length(pat.p)))"""


_AROUND = """, near AS (
  SELECT w.*, substr(pat.p, w.i, 1) a,
    coalesce(lag(h) OVER (PARTITION BY w.pattern_id, seq_id, w.i - w.j ORDER BY w.i), 0) corner,
    coalesce(lag(h) OVER (PARTITION BY w.pattern_id, seq_id, w.j ORDER BY w.i), 0) up,
    coalesce(lag(h) OVER (PARTITION BY w.pattern_id, seq_id, w.i ORDER BY w.j), 0) lft
  FROM w JOIN pat ON w.pattern_id = pat.pattern_id {only}),
way AS (SELECT *, CASE WHEN h = 0 THEN 0 WHEN h = corner + CASE WHEN a = c THEN 3 ELSE -3 END THEN 1 WHEN {first} ELSE {second} END dir FROM near WHERE i > 0)"""
_ONLY_HITS = "SEMI JOIN hit ON w.pattern_id = hit.pattern_id AND w.seq_id = hit.seq_id"
_ALL_WAYS = _AROUND.format(first="h = lft - 2 AND j > 1 THEN 3", second="2", only="")
_LEFT_FIRST = _AROUND.format(first="h = lft - 2 AND j > 1 THEN 3", second="2", only=_ONLY_HITS)
_UP_FIRST = _AROUND.format(first="h = up - 2 AND i > 1 THEN 2", second="3", only=_ONLY_HITS)


_RANK = "row_number() OVER (PARTITION BY pattern_id ORDER BY h DESC, seq_id, j, i)"
_RANK_OF_PAIR = "row_number() OVER (PARTITION BY pattern_id, seq_id ORDER BY h DESC, j, i)"
_NAMES = "SELECT CAST(0 AS BIGINT) {0}, string_agg(s_name, chr(10) ORDER BY s_name {2}) {1} FROM supplier"


def _top(k: int, rank: str = _RANK) -> str:
    return f""", hit AS (SELECT * FROM (SELECT pattern_id, CAST({rank} AS INT) rank, seq_id, h score, CAST(i - 1 AS INT) x_end, CAST(j - 1 AS BIGINT) y_end FROM w WHERE i > 0 AND h > 0) WHERE rank <= {k})"""


def _walked(ways: str, k: int, db: str, pat: str = _PAT, rank: str = _RANK) -> str:
    return _matrix(db, pat=pat) + _top(k, rank) + ways + """, walk AS (
  SELECT pattern_id, rank, seq_id, score, x_end, y_end, x_end + 1 i, CAST(y_end + 1 AS INT) j, '' ap, '' as_, 0 n FROM hit
  UNION ALL
  SELECT k.pattern_id, k.rank, k.seq_id, k.score, k.x_end, k.y_end, k.i - CASE WHEN dir = 3 THEN 0 ELSE 1 END, k.j - CASE WHEN dir = 2 THEN 0 ELSE 1 END,
    CASE WHEN dir = 3 THEN '-' ELSE a END || ap, CASE WHEN dir = 2 THEN '-' ELSE c END || as_, n + 1
  FROM walk k JOIN way ON way.pattern_id = k.pattern_id AND way.seq_id = k.seq_id AND way.i = k.i AND way.j = k.j WHERE dir > 0),
done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id, rank, seq_id ORDER BY n DESC) last FROM walk) WHERE last = 1),
al AS (SELECT pattern_id, rank, seq_id, score, x_end, y_end, CAST(i AS INT) x_start, CAST(j AS BIGINT) y_start, ap aligned_p, as_ aligned_s FROM done) """


_STATS = """SELECT pattern_id, rank, CAST(m AS INT) n_match, CAST(n - m - g AS INT) n_mismatch, CAST(g AS INT) n_gap, CAST(3 * m - 3 * (n - m - g) - 2 * g AS INT) rescored, score FROM (
  SELECT pattern_id, rank, score, count(*) n, sum(CASE WHEN a = b AND a <> '-' THEN 1 ELSE 0 END) m, sum(CASE WHEN a = '-' OR b = '-' THEN 1 ELSE 0 END) g
  FROM (SELECT pattern_id, rank, score, substr(aligned_p, k, 1) a, substr(aligned_s, k, 1) b FROM (SELECT *, unnest(range(1, length(aligned_p) + 1)) k FROM al)) GROUP BY ALL)"""
_HITS = " SELECT pattern_id, rank, seq_id, score, x_end, y_end FROM hit"
_FIRST = " SELECT seq_id, pattern_id, score, x_end, y_end FROM (SELECT seq_id, pattern_id, h score, CAST(i - 1 AS INT) x_end, CAST(j - 1 AS BIGINT) y_end, row_number() OVER (PARTITION BY seq_id, pattern_id ORDER BY h DESC, j, i) n FROM w WHERE h > 0) WHERE n = 1"
_BY_KIND = "CASE WHEN {c} = {p} THEN 3 WHEN NOT (regexp_full_match({c}, '[a-z]') AND regexp_full_match({p}, '[a-z]')) THEN -3 WHEN (contains('aeiou', {c})) <> (contains('aeiou', {p})) THEN -3 WHEN contains('aeiou', {c}) THEN 1 ELSE -1 END"
_AS_N = "regexp_replace({0}, '[^aeioustrN]', 'N', 'g')"

ORACLE_SQL = {
    "seq_length": "SELECT doc_id, length(text) AS length, strlen(text) AS bytes FROM documents",
    "seq_slice": "SELECT doc_id, substr(text, 11, 50) AS slice FROM documents",
    "seq_encode": f"SELECT doc_id, length({_DNA}) AS length, md5({_DNA}) AS digest FROM documents",
    "alphabet_counts": "SELECT source, " + ", ".join(f"CAST(sum(length(s) - length(replace(s, '{c}', ''))) AS BIGINT) AS n_{c.lower()}" for c in "ACGTN") + f" FROM (SELECT source, {_DNA} s FROM documents) GROUP BY source",
    "validate_alphabet": f"SELECT doc_id, regexp_full_match(text, '[ACGTN]*') AS as_is, regexp_full_match({_DNA}, '[ACGTN]*') AS encoded FROM documents",
    "chunk_blocks": "SELECT seq_id, block, block * b AS start_ind, least((block + 1) * b, n) - 1 AS end_ind FROM (SELECT doc_id seq_id, n, b, unnest(range(0, CAST(ceil(n / b) AS BIGINT))) block FROM (SELECT doc_id, length(text) n, CAST(floor(sqrt(length(text))) AS BIGINT) b FROM documents WHERE length(text) > 0))",
    "chunk_halo": f"SELECT seq_id, CAST(k AS INT) chunk_idx, greatest(k * {CORE} - {HALO}, 0) AS start, CAST(k * {CORE} - greatest(k * {CORE} - {HALO}, 0) AS INT) AS skip, md5(substr(text, greatest(k * {CORE} - {HALO}, 0) + 1, (k + 1) * {CORE} - greatest(k * {CORE} - {HALO}, 0))) AS digest FROM (SELECT doc_id seq_id, text, unnest(range(0, CAST(ceil(length(text) / {CORE}) AS BIGINT))) k FROM documents WHERE length(text) > 0)",
    "split_equal_pad": "SELECT doc_id, CAST(k AS INT) AS part, md5(rpad(substr(text, k * w + 1, w), CAST(w AS INT), 'M')) AS digest FROM (SELECT doc_id, text, CAST(ceil(length(text) / 8) AS BIGINT) w, unnest(range(0, 8)) k FROM documents)",
    "pattern_stripes": "SELECT item_id, CAST(k AS INT) AS stripe, substr(text, k * 4 + 1, 4) AS rows FROM (SELECT item_id, text, unnest(range(0, CAST(ceil(length(text) / 4) AS BIGINT))) k FROM benchmark WHERE length(text) > 0)",
    "pair_cells": f"SELECT pattern_id, pairs, CAST(length(p) * n AS BIGINT) AS cells FROM ({_PAT}), (SELECT CAST(sum(length(text)) AS BIGINT) n, count(*) pairs FROM documents)",
    "char_match_cells": f"WITH d AS (SELECT c, count(*) m FROM (SELECT unnest(string_split(text, '')) c FROM documents) GROUP BY c), q AS (SELECT pattern_id, c, count(*) n FROM (SELECT pattern_id, unnest(string_split(p, '')) c FROM ({_PAT})) GROUP BY ALL) SELECT pattern_id, CAST(sum(n * m) AS BIGINT) AS cells FROM q JOIN d USING (c) GROUP BY pattern_id",
    "sw_cells": _matrix(_DB_PARTS) + _ALL_WAYS + " SELECT pattern_id, CAST(i AS INT) i, j, CAST(sum(h) AS BIGINT) h, " + ", ".join(f"CAST(sum(CASE WHEN dir = {k} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for k, n in enumerate(("n_stop", "n_diag", "n_up", "n_left"))) + " FROM way GROUP BY ALL",
    "sw_score": _matrix(_DB_PARTS) + " SELECT pattern_id, seq_id, max(h) AS score FROM w GROUP BY ALL HAVING max(h) > 0",
    "sw_score_native": _matrix(_DB_PARTS) + " SELECT pattern_id, seq_id, max(h) AS score FROM w GROUP BY ALL HAVING max(h) > 0",
    "sw_boundary_right": _matrix(_DB_PARTS) + " SELECT w.pattern_id, w.seq_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY i) AS edge FROM w JOIN db ON w.seq_id = db.seq_id WHERE i > 0 AND j = length(s) GROUP BY ALL",
    "sw_boundary_bottom": _matrix(_DB_PARTS) + " SELECT w.pattern_id, w.seq_id, string_agg(CAST(h AS VARCHAR), ',' ORDER BY j) AS edge FROM w JOIN pat ON w.pattern_id = pat.pattern_id WHERE i = length(p) GROUP BY ALL",
    "sw_topk_cells": _matrix(_DB_PARTS) + _top(K) + _HITS,
    "sw_topk_with_ties": _matrix(_DB_PARTS) + _top(K, "rank() OVER (PARTITION BY pattern_id ORDER BY h DESC)") + _HITS,
    "sw_best_per_pattern": _matrix(_DB_PARTS) + " SELECT pattern_id, max(h) AS score FROM w GROUP BY ALL HAVING max(h) > 0",
    "sw_traceback": _walked(_LEFT_FIRST, K, _DB_PARTS) + " SELECT * FROM al",
    "sw_traceback_up_first": _walked(_UP_FIRST, K, _DB_PARTS) + " SELECT * FROM al",
    "sw_alignment_stats": _walked(_LEFT_FIRST, K, _DB_PARTS) + _STATS,
    "report_text": _walked(_LEFT_FIRST, K, _DB_PARTS) + "SELECT pattern_id, rank, CAST(score AS VARCHAR) || chr(10) || aligned_p || chr(10) || aligned_s AS report FROM al",
    "sw_chunked_hits": _matrix(_DB_TURNS) + _top(K) + _HITS,
    "sw_chunked_traceback": _walked(_LEFT_FIRST, 1, _DB_TURNS) + " SELECT * FROM al",
    "fasta_round_trip": f"SELECT doc_id, length({_DNA}) AS length, md5({_DNA}) AS digest FROM documents WHERE {_DNA} <> ''",
    "checkpoint_islands": "SELECT user_id, max(event_id) AS resume, count(*) AS held FROM (SELECT user_id, event_id, sum(gap) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) island FROM (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 40 THEN 1 ELSE 0 END gap FROM events)) WHERE island = 0 GROUP BY user_id",
    "stream_align_conversations": _matrix(_DB_CONVERSATIONS) + " SELECT seq_id, pattern_id, score, x_end, y_end FROM (SELECT seq_id, pattern_id, h score, CAST(i - 1 AS INT) x_end, CAST(j - 1 AS BIGINT) y_end, row_number() OVER (PARTITION BY seq_id, pattern_id ORDER BY h DESC, j, i) n FROM w WHERE h > 0) WHERE n = 1",
    "sw_matrix_score": _matrix(_DB_PARTS, _BY_KIND) + _FIRST,
    "sw_unknown_as_n": _matrix(f"SELECT p_partkey seq_id, {_AS_N.format('p_name')} s FROM part", pat=f"SELECT CAST(r_regionkey AS BIGINT) pattern_id, {_AS_N.format('lower(r_name)')} p FROM region") + _FIRST,
    "sql_align": _matrix(_DB_PARTS, "CASE WHEN {c} = {p} THEN 2 ELSE -1 END", 1) + _FIRST.replace(" SELECT seq_id, pattern_id, score, x_end, y_end FROM", " SELECT seq_id, pattern_id, score, score AS top, x_end, y_end FROM", 1),
    "stream_topk": _matrix(_DB_CONVERSATIONS) + f" SELECT seq_id, pattern_id, rank, score, x_end, y_end FROM (SELECT seq_id, pattern_id, CAST(row_number() OVER (PARTITION BY seq_id, pattern_id ORDER BY h DESC, j, i) AS INT) rank, h score, CAST(i - 1 AS INT) x_end, CAST(j - 1 AS BIGINT) y_end FROM w WHERE h > 0) WHERE rank <= {K}",
    "sql_align_table": _walked(_LEFT_FIRST, 1, _DB_PARTS, rank=_RANK_OF_PAIR) + " SELECT pattern_id, seq_id, score, x_end, y_end, x_start, y_start, aligned_p, aligned_s FROM al",
    "sql_hits_by_pattern": _matrix(_DB_PARTS, "CASE WHEN {c} = {p} THEN 2 ELSE -1 END", 1) + _top(K, _RANK_OF_PAIR) + _HITS,
    "sw_long_pattern": _matrix("SELECT s_suppkey seq_id, s_name s FROM supplier", pat=_NAMES.format("pattern_id", "p", "ASC")) + _FIRST.replace("seq_id, pattern_id, score", "seq_id, score", 1),
    "flat_round_trip": "SELECT CAST(sum(length(s)) AS BIGINT) AS length, " + ", ".join(f"CAST(sum(length(s) - length(replace(s, '{c}', ''))) AS BIGINT) AS n_{c.lower()}" for c in "ACGTN") + f" FROM (SELECT concat_ws('-', source, lang) k, {_DNA} s FROM documents) GROUP BY k HAVING sum(length(s)) > 0",
    "json_query": _matrix("SELECT p_partkey seq_id, replace(p_name, ' ', '') s FROM part", pat="SELECT CAST(r_regionkey AS BIGINT) pattern_id, replace(lower(r_name), ' ', '') p FROM region") + _top(K) + " SELECT pattern_id, rank, score FROM hit",
    "stream_topk_global": _matrix(_DB_CONVERSATIONS) + _top(K) + _HITS,
    "stream_traceback": _walked(_LEFT_FIRST, K, _DB_CONVERSATIONS) + " SELECT * FROM al",
    "fasta_first_line": f"SELECT n_name AS header, upper({_DNA.replace('text', "('nation' || n_name)")} || replace(n_name, ' ', '')) AS seq FROM nation",
    "report_by_rank": _walked(_LEFT_FIRST, K, _DB_PARTS) + ", lines AS (SELECT seq_id, rank, unnest(['Score of chain:' || score, 'pattern: ' || aligned_p, 'sequence: ' || aligned_s]) line FROM al) SELECT seq_id, rank, line, count(*) AS n FROM lines GROUP BY ALL",
    "sw_documents": _matrix(_DB_DOCUMENTS) + _FIRST,
    "sw_documents_traceback": _walked(_LEFT_FIRST, K, _DB_DOCUMENTS) + " SELECT * FROM al",
}
