"""SentencePiece encoding and decoding by a prefix table.

For every prefix of a text the merge procedure has one last token. The table
stores it: an Aho-Corasick automaton reports the pieces that end at a position,
and a candidate is the last token if the merge procedure, run on the pair of
the last token before it and the candidate alone, leaves that pair as it is
(pair compatibility, remembered per pair). The ids are then read backwards
from the end of the table.

Texts are cut where no piece of the vocabulary can span the cut: before a
space mark that follows other text, and around characters that no piece has
(these become byte pieces). Runs of two or more space marks, whose pieces all
share one score, go to the leftmost merge first; the table holds for distinct
scores, so such runs are merged directly.

Edge cases: null and empty texts have no ids and decode to empty; very long
texts and words take time in proportion to their length; repeated rows are
returned each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cached_property

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import held, id_text, map_rows

MARK = "▁"
MODEL = "piece_bpe_32k.model"
CACHE = 250_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Vocabulary of a merge-type model with byte fallback, read from its file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("a merge-type model with byte fallback, a dummy prefix and no normalisation is needed")
        self.piece = [p.piece for p in m.pieces]
        normal = [i for i, p in enumerate(m.pieces) if p.type == 1]
        self.id = {self.piece[i]: i for i in normal}
        self.score = {self.piece[i]: m.pieces[i].score for i in normal}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.chars = frozenset(c for p in self.id for c in p)
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.id):
            raise ValueError("a piece spans a word border")
        self.pairs = frozenset(p[k : k + 2] for p in self.id for k in range(len(p) - 1))
        self.plain = {i: self.piece[i].replace(MARK, " ") for i in normal}
        self._fits: dict[int, bool] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """All pieces that the merge procedure can leave as a token."""
        a = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merge(piece) == [piece]:
                a.add_word(piece, (len(piece), i))
        a.make_automaton()
        return a

    def merge(self, text: str) -> list[str]:
        """The merge procedure itself: the best-scored neighbouring pair first, the leftmost among equals."""
        n = len(text)
        symbol, after, before = list(text), [*range(1, n), -1], list(range(-1, n - 1))
        todo: list[tuple] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(symbol[a] + symbol[b])) is not None:
                heapq.heappush(todo, (-s, a, b, symbol[a], symbol[b]))

        for at in range(n - 1):
            offer(at, at + 1)
        while todo:
            _, a, b, x, y = heapq.heappop(todo)
            if symbol[a] != x or symbol[b] != y or after[a] != b:
                continue
            symbol[a], symbol[b] = x + y, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in symbol if s]

    def fits(self, left: int, right: int) -> bool:
        """Pair compatibility: merging the two tokens' text alone gives the two tokens."""
        a, b = self.piece[left], self.piece[right]
        if len(self._fits) >= 2 * CACHE:
            self._fits.clear()
        found = self._fits[left << 20 | right] = self.merge(a + b) == [a, b]
        return found

    def by_table(self, text: str) -> list[int]:
        """Ids of a text of known characters, from the table of last tokens."""
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        done, known = 0, self._fits.get
        for end, (length, i) in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            start = end - length
            if start:
                if not size[start]:
                    continue
                fit = known(last[start] << 20 | i)
                if fit is None:
                    fit = self.fits(last[start], i)
                if not fit:
                    continue
            last[end], size[end], done = i, length, end
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def known_run(self, text: str) -> list[int]:
        """A stretch of known characters with space marks at its start only, if at all."""
        word = text.lstrip(MARK)
        marks = len(text) - len(word)
        if marks < 2:
            return self.by_table(text)
        ids = self.by_table(MARK + word) if word else []
        if ids and ids[0] == self.id[MARK]:
            ids = ids[1:]
        elif ids:
            marks -= 1
        return [self.id[p] for p in self.merge(MARK * marks)] + ids

    def chunk(self, text: str) -> list[int]:
        """Ids of one chunk; characters that no piece has become byte pieces."""
        if self.chars.issuperset(text):
            return self.known_run(text)
        ids: list[int] = []
        run = ""
        for c in text:
            if c in self.chars:
                run += c
                continue
            if run:
                ids += self.known_run(run)
                run = ""
            ids += [self.byte_id[b] for b in c.encode()]
        return ids + (self.known_run(run) if run else [])

    def text(self, ids: list[int]) -> str:
        """Decodes ids: byte pieces by runs as UTF-8, space marks to spaces; the dummy prefix stays."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except KeyError:
            pass
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.plain.get(i, ""))
        return "".join(out) + held.decode("utf-8", "replace")


class _Chunks(dict):
    """chunk -> (ids joined by commas, decoded text); two bounded generations, the older dropped when the younger is full."""

    TAIL = ".,!?;:|*#$%&"

    def __init__(self, model: PieceModel, prefix: str) -> None:
        self.model, self.prefix, self.old = model, prefix, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.old.get(word)
        if found is None:
            core = word.rstrip(self.TAIL)
            if core and len(core) < len(word) and word[len(core) - 1 : len(core) + 1] not in self.model.pairs:
                (a, x), tail = self[core], self.model.chunk(word[len(core) :])
                found = (a + "," + ",".join(map(str, tail)), x + self.model.text(tail))
            else:
                ids = self.model.chunk(self.prefix + word) if self.prefix or word else []
                found = (",".join(map(str, ids)), self.model.text(ids))
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class PieceCodec:
    """Encodes and decodes whole texts, remembering chunks."""

    SPLIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.marked, self.bare = _Chunks(model, MARK), _Chunks(model, "")
        self.by_line = "\n" not in model.chars

    def both(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        parts: list[tuple[str, str]] = []
        lines = text.split("\n") if self.by_line else [text]
        for at, line in enumerate(lines):
            if at:
                parts.append(self.bare["\n"])
            words = line.split(" ")
            if MARK in line or "" in words[1:]:
                norm = line.replace(" ", MARK)
                parts += map(self.bare.__getitem__, self.SPLIT.findall(norm if at else MARK + norm))
            elif at == 0 and words[0] == "":
                parts += map(self.bare.__getitem__, self.SPLIT.findall(MARK + line.replace(" ", MARK)))
            else:
                parts.append(self.bare[words[0]] if at else self.marked[words[0]])
                parts += map(self.marked.__getitem__, words[1:])
        ids, texts = zip(*parts, strict=True)
        return ",".join(filter(None, ids)), "".join(texts).removeprefix(" ")

    def encode(self, text: str | None) -> list[int]:
        joined = self.both(text or "")[0]
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.model.text(ids).removeprefix(" ")


def codec(path: str) -> PieceCodec:
    """One codec for each worker process; its chunks serve all tasks that the process runs."""
    return held(f"pieces {path}", lambda: PieceCodec(PieceModel(path)))


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    path = path or model_path()

    def make():
        encode = codec(path).encode
        return lambda ids, texts: [(i, encode(t)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(id_text(docs), "doc_id long, ids array<int>", make, keeps=True)


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids count as none."""
    path = path or model_path()

    def make():
        decode = codec(path).decode
        return lambda ids, lists: [(i, decode(x or [])) for i, x in zip(ids, lists, strict=True)]

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", make, keeps=True)


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids and the text decoded from them, as digests."""
    path = path or model_path()

    def make():
        both, sha = codec(path).both, hashlib.sha256

        def f(ids, texts):
            rows = []
            for i, t in zip(ids, texts, strict=True):
                joined, decoded = both(t or "")
                rows.append((i, joined.count(",") + bool(joined), sha(joined.encode()).hexdigest(), sha(decoded.encode()).hexdigest()))
            return rows

        return f

    return map_rows(id_text(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make, keeps=True)


def op4_pieces_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
