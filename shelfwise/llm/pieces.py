"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass.

The automaton reports, for each position, every piece that ends there (itself and its output links, longest first). In a
BPE model, whose scores are merge ranks and no likelihoods, the last piece of a prefix is the one that merging leaves
apart from the last piece before it; just one is. In a unigram model each relaxes the best score at its end (Viterbi),
and characters that no piece of one character covers cost the least piece score less 10. Such characters become byte
pieces. Text is normalised as the model asks: a space becomes U+2581, and one is put in front.

No piece holds U+2581 after another character, or a newline, so a segmentation never crosses a space or a newline
and units between them are solved once and kept by the worker; a model whose pieces do cross takes texts whole."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.session import kept_by, ship
from shelfwise.llm.text import slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_BYTES = 64 << 20
CACHE_PAIRS = 200_000
_irregular = re.compile(f"^ |  |{SPACE}|\x01")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Merges:
    """BPE merging: of all neighbours that make a piece, those with the best score go first, the leftmost of equals.

    ``parts`` holds each piece that merging makes of its own text, with the two it is made of (none for a character);
    other pieces never come up."""

    def __init__(self, scores: dict[str, float]):
        self.rank = {p: -s for p, s in scores.items()}
        if missing := {c for p in scores for c in p} - scores.keys():
            raise ValueError(f"characters of pieces that are no pieces: {sorted(missing)[:5]}")
        held = Counter(self.rank[p] for p in scores if len(p) > 1)
        self.parts: dict[str, tuple] = {}
        self.made: dict[str, float] = {}
        self.loose = set()  # merges inside do not follow in order of rank
        for p in sorted(scores, key=len):
            if len(p) == 1:
                self.parts[p], self.made[p] = (), float("-inf")
                continue
            out, last = self.run(p)
            if len(out) > 1:
                continue
            self.parts[p], self.made[p] = last, self.rank[p]
            if held[self.rank[p]] > 1 or any(x in self.loose or self.made[x] >= self.rank[p] for x in last):
                self.loose.add(p)

    def run(self, text: str) -> tuple[list[str], tuple]:
        """Merge step by step: the pieces and the last two that were merged. For short texts."""
        out, last = list(text), ()
        while True:
            found = [(r, j) for j in range(len(out) - 1) if (r := self.rank.get(out[j] + out[j + 1])) is not None]
            if not found:
                return out, last
            j = min(found)[1]
            last = out[j], out[j + 1]
            out[j : j + 2] = [out[j] + out[j + 1]]

    def apart(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: undo the merges next to the border, latest first, and see that at no time
        the two at the border would have merged before what merged next."""
        if a in self.loose or b in self.loose:
            return self.run(a + b)[0] == [a, b]
        limit, right = float("inf"), False
        while True:
            r = self.rank.get(a + b)
            if r is not None and (r < limit or r == limit and right):
                return False
            if self.made[a] > self.made[b]:
                limit, right, a = self.made[a], False, self.parts[a][1]
            elif len(b) > 1:
                limit, right, b = self.made[b], True, self.parts[b][0]
            else:
                return True


class PieceModel:
    """Pieces with their scores; ``pieces`` is a list of (text, score, kind) by id, kind 'piece', 'byte' or 'other'."""

    def __init__(self, pieces: list[tuple[str, float, str]], bpe: bool = False):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        usable = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"]
        self.merges = Merges({p: s for _, p, s in usable}) if bpe else None
        self.names, self.pairs = [p for p, _, _ in pieces], {}
        for i, piece, score in usable:
            if not bpe or piece in self.merges.parts:
                self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown = min((s for _, _, s in usable), default=0.0) - UNKNOWN_PENALTY
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for _, p, _ in usable)
        self.known: dict[str, bytes] = {}
        self.held = 0
        text = {"piece": lambda p: p.replace(SPACE, " ").encode(), "byte": lambda p: bytes([int(p[3:5], 16)]), "other": lambda p: b""}
        self.text = [text[kind](p) for p, _, kind in pieces]

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        """The model at ``path``, once a worker."""
        if path not in kept_by("pieces"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
            proto = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
            bpe = proto.trainer_spec.model_type == proto.trainer_spec.BPE
            kept_by("pieces")[path] = cls([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())], bpe)
        return kept_by("pieces")[path]

    def merge(self, text: str) -> list[int]:
        """Ids that BPE merging gives, in one pass: ``last`` is the last piece of each prefix, -1 at the start and after a
        character of no piece."""
        n = len(text)
        last, step, pairs = [-1] * (n + 1), [1] * (n + 1), self.pairs
        for at, (size, _, i) in self.automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            before = last[end - size]
            if before >= 0:
                pair = before << 32 | i
                apart = pairs.get(pair)
                if apart is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    apart = pairs[pair] = self.merges.apart(self.names[before], self.names[i])
                if not apart:
                    continue
            last[end], step[end] = i, size
        ids, end = [], n
        while end:
            i, end = last[end], end - step[end]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in reversed(text[end].encode("utf-8", "replace"))]
        ids.reverse()
        return ids

    def segment(self, text: str) -> list[int]:
        """Ids of the pieces of a normalised text; in a unigram model ties go to the longer last piece."""
        if self.merges:
            return self.merge(text)
        n = len(text)
        best = [0.0] + [-1e300] * n
        how: list = [None] * (n + 1)
        done = 0  # ends before this are settled

        def settle(end):
            nonlocal done
            while done < end:  # a character that no piece of one character covers
                done += 1
                if single[done] is None:
                    score = best[done - 1] + self.unknown
                    if score > best[done]:
                        best[done], how[done] = score, (1, -1)

        single: list = [None] * (n + 1)
        for at, (size, score, i) in self.automaton.iter(text):
            end = at + 1
            if end - 1 > done:
                settle(end - 1)
            if size == 1:
                single[end] = i
            total = best[end - size] + score
            if total > best[end]:
                best[end], how[end] = total, (size, i)
        settle(n)
        ids, end = [], n
        while end:
            size, i = how[end]
            end -= size
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in reversed(text[end].encode("utf-8", "replace"))]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32."""
        if not text:
            return b""
        if self.whole or _irregular.search(text):
            return np.array(self.segment(SPACE + text.replace(" ", SPACE)), np.uint32).tobytes()
        known, out = self.known, []
        for unit in text.replace("\n", "\n \x01").split(" "):
            ids = known.get(unit)
            if ids is None:
                ids = np.array(self.segment(unit[1:] if unit[:1] == "\x01" else SPACE + unit), np.uint32).tobytes()
                if self.held > CACHE_BYTES:
                    known.clear()
                    self.held = 0
                known[unit] = ids
                self.held += len(unit) + len(ids) + 180
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.text.__getitem__, np.frombuffer(ids, np.uint32).tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, text, ids (little-endian uint32), one row per row.

    Null and empty texts have no ids. Decoding gives the text back unless it holds U+2581, which reads as a space.
    Extra columns are ignored; repeated rows and rows without an id are encoded like all others; an empty table gives an
    empty result."""

    def run(batches):
        model = PieceModel.load(path)
        for batch in slices(batches, 1, operator="pieces"):
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    ship(docs.sparkSession)
    return by_id(docs).mapInArrow(run, "doc_id long, text string, ids binary")


def by_id(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ids) -> doc_id, text, ids, decoded."""

    def run(batches):
        model = PieceModel.load(path)
        for batch in slices(batches, 1, operator="pieces"):
            texts = [model.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "text", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, text string, ids binary, decoded string")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, n_pieces, ids_crc32, the digest of what the ids decode to, and whether that is the text.

    Each document is encoded, decoded and digested in one task by one worker, which holds the model once. Null texts are
    empty; rows without an id and repeated rows stay; an empty table gives an empty result."""
    ship(spark)
    path = model_path()

    def run(batches):
        model = PieceModel.load(path)
        for batch in slices(batches, 1, operator="pieces"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            raw = [model.encode(t) for t in texts]
            back = [model.decode(r) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "ids_crc32", "text_sha256", "round_trip"],
            )

    return by_id(docs).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
