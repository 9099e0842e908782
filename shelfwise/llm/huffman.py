"""Token ids in a Huffman-coded file format, written and read back.

A file is a folder with two tables. ``code`` is the header: the code length of every id that occurs, from counts over all
documents and at most ``LONGEST`` bits; the canonical codes follow from it. ``frames``: a frame holds whole documents in
ascending id order (their ids and lengths) and one payload: the codes of their token ids, most significant bit first, with
the bit offset of every ``BLOCK``-th token as checkpoints, so blocks can be decoded independently of each other. Decoding
looks the next ``LONGEST`` bits up in a table, one token of every block of a batch at a time."""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.session import drop_scratch, kept_by, materialize, shared_dir, ship, shuffle_width
from shelfwise.llm.text import slices

LONGEST = 16
BLOCK = 1024
FRAME_TOKENS = 1 << 15
END_ID = 2
FRAMES_AT_ONCE = 64
CACHE_BYTES = 96 << 20  # of each of two generations
UNITS_AT_ONCE = 256
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What stands in front of a unit on a line of its own, and of a full stop or comma that is a unit.
MARKS = ("\x01", "\x02")
#: A full stop or comma that does not close a word: behind another character than a letter (a Latin one, which is a letter by any
#: edition of Unicode), or before anything but a space or newline.
UNCLOSED = r"(?:^|[^A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])[.,]|[.,][^ \n]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs [start, start + size), one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Units:
    """Units of text and their ids, which lie in one array."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64)
        self.used, self.held = 0, 0

    def put(self, ids: np.ndarray) -> int:
        """Copy ids behind those of the units, which the next call may overwrite; where they begin."""
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(max(self.used + len(ids), len(self.ids) * 3 // 2), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def add(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.at)
        if n + len(units) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds[: n + 1], np.zeros(max(len(units), len(self.bounds) // 2), np.int64)])
        self.bounds[n + 1 : n + 1 + len(units)] = self.put(ids) + np.cumsum(size)
        self.used += len(ids)
        self.at.update(zip(units, range(n, n + len(units)), strict=True))
        self.held += sum(map(len, units)) + ids.nbytes + 200 * len(units)

    def runs(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of the units at these places."""
        return self.bounds[place], self.bounds[place + 1] - self.bounds[place]


class UnitEncoder:
    """A tokenizer and the ids of units of text it met lately, kept by a worker in two generations of ``CACHE_BYTES``.

    The byte-level pre-tokenizer always cuts before a space that a non-space follows and around a newline between
    non-spaces, and tokens never cross its cuts; so texts without neighbouring white space are the ids of their units in
    a row. It also cuts between letters and other characters, so where full stops and commas only close words, they are units
    of their own. All other texts, those that spell an added token, and all texts of other tokenizers are encoded
    whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and spec["normalizer"] is None
        added = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.irregular = "|".join([f"{SPACES}{SPACES}|[\\x01\\x02]", *added])
        self.space = re.compile(r"\s")
        vocabulary = self.tokenizer.get_vocab()
        self.starts = {" ": np.zeros(max(vocabulary.values()) + 1, bool), "\n": np.zeros(max(vocabulary.values()) + 1, bool)}
        for token, i in vocabulary.items():  # in the byte-level alphabet
            self.starts[" "][i], self.starts["\n"][i] = token[:1] == "\u0120", token == "\u010a"
        self.young, self.old = Units(), Units()

    @classmethod
    def load(cls, path: str) -> "UnitEncoder":
        if path not in kept_by("token-files"):
            kept_by("token-files")[path] = cls(path)
        return kept_by("token-files")[path]

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.array([len(i) for i in ids], np.int64)

    def learn(self, missing: list[str]) -> None:
        """Units after a space are encoded in rows, one after the other, those on a line of their own in rows of lines;
        ids are dealt out at the tokens that start with a space, or that are a newline."""
        known = [u for u in missing if u in self.old.at]
        start, size = self.old.runs(np.array([self.old.at[u] for u in known], np.int64))
        self.young.add(known, self.old.ids[ragged(start, size)], size)
        missing = [u for u in missing if u not in self.old.at]
        after_space = [u for u in missing if u[:1] not in MARKS]
        own_line = [u for u in missing if u[:1] == "\x01"]
        odd = [u for u in missing if u[:1] == "\x02"] + [u for u in own_line if len(u) == 1 or self.space.search(u)]
        self.young.add(odd, *self.whole([u[1:] for u in odd]))
        own_line = [u for u in own_line if len(u) > 1 and not self.space.search(u)]
        for units, bare, lead, skip in ((after_space, after_space, " ", 0), (own_line, [u[1:] for u in own_line], "\n", 1)):
            ids, _ = self.whole([lead + lead.join(bare[lo : lo + UNITS_AT_ONCE]) for lo in range(0, len(units), UNITS_AT_ONCE)])
            begins = self.starts[lead][ids]
            size = np.diff(np.flatnonzero(begins), append=len(ids)) - skip
            self.young.add(units, ids[~begins] if skip else ids, size)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with ``end`` behind it; number of ids of each text). Null is an empty text.

        Different units of the texts are looked up once, and their ids are then copied to every place of the unit."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.irregular) if self.cuts else pa.array(np.ones(len(texts), bool))
        alone = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if self.young.held > CACHE_BYTES:
            self.old, self.young = self.young, Units()
        marked = pc.replace_substring(pc.if_else(odd, "", texts), "\n", "\n \x01")
        closed = pc.replace_substring(pc.replace_substring(marked, ",", " \x02,"), ".", " \x02.")
        marked = pc.if_else(pc.match_substring_regex(marked, UNCLOSED), marked, closed)
        cut = pc.split_pattern(pc.binary_join_element_wise("\x01", marked, ""), " ")
        words = cut.flatten().dictionary_encode()
        units = words.dictionary.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.young.at.get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(place < 0)
        self.learn(found := units[missing].tolist())
        place[missing] = np.fromiter(map(self.young.at.__getitem__, found), np.int64, len(found))
        start, size = self.young.runs(place)
        ids, n = self.whole(texts.take(pa.array(alone)).to_pylist())
        here = self.young.put(np.concatenate([ids, np.array([end], np.uint32)]))
        start, size = np.concatenate([start, here + np.cumsum(n) - n, [here + len(ids)]]), np.concatenate([size, n, [1]])
        # a text is the units of its words, or one unit of its own, and the end id
        n_words = pc.list_value_length(cut).to_numpy().astype(np.int64)
        last = np.cumsum(n_words) + np.arange(len(texts))
        order = np.full(int(n_words.sum()) + len(texts), len(size) - 1)
        inner = np.ones(len(order), bool)
        inner[last] = False
        order[inner] = words.indices.to_numpy()
        order[last[alone] - 1] = len(units) + np.arange(len(alone))
        length = size[order]
        return self.young.ids[ragged(start[order], length)], np.add.reduceat(length, np.concatenate([[0], last[:-1] + 1]))


IDS = "part long, seq long, doc_id long, n_tokens long, ids binary, counts binary"


def encode_ids(path: str):
    """(doc_id, text) -> IDS in the order of the rows: part, seq, doc_id, n_tokens and ids (little-endian uint16, or uint32
    where the slice has an id that needs it); each task ends with a row of part -1 that holds its id counts (int64 pairs)."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = UnitEncoder.load(path)
        total = np.zeros(0, np.int64)
        for batch in slices(batches, 1, operator="token-files"):
            ids, n = encoder.encode(batch.column(1), END_ID)
            counts = np.bincount(ids)
            most, least = (counts, total) if len(counts) > len(total) else (total, counts)
            most[: len(least)] += least
            total, top = most, int(ids.max())
            ids = ids.astype(np.uint16) if top < 1 << 16 else ids
            offsets = np.concatenate([[0], np.cumsum(ids.itemsize * n)]).astype(np.int32)  # a slice holds a few MB, or one text
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), pa.array(np.arange(seq, seq + len(n))), batch.column(0), pa.array(n), raw, pa.nulls(len(n), pa.binary())], names=["part", "seq", "doc_id", "n_tokens", "ids", "counts"])
            seq += len(n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([at, total[at]], axis=1).tobytes()], pa.binary())], names=["part", "seq", "doc_id", "n_tokens", "ids", "counts"])

    return run


def count_ids(batches):
    for batch in batches:
        pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge (symbols with count 0 get none)."""
    live = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(live) <= 1:
        lengths[live] = 1
        return lengths
    if len(live) > 1 << longest:
        raise ValueError(f"{len(live)} symbols do not fit in {longest} bits")
    order = live[np.argsort(counts[live], kind="stable")]
    weight = counts[order].astype(np.int64)
    lists, current = [], weight
    for _ in range(longest - 1):
        lists.append(current)
        pairs = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        current = np.sort(np.concatenate([weight, pairs]), kind="stable")
    lists.append(current)
    take = 2 * len(live) - 2  # of the last list; each package taken asks for two of the list before
    uses = np.zeros(len(live) + 1, np.int64)
    for level in range(longest - 1, -1, -1):
        before = lists[level - 1] if level else None
        if before is None:
            singles = take
        else:
            pairs = before[: len(before) // 2 * 2].reshape(-1, 2).sum(axis=1)
            place = np.argsort(np.concatenate([weight, pairs]), kind="stable")
            singles = int((place[:take] < len(weight)).sum())
        uses[0] += 1
        uses[singles] -= 1
        take = 2 * (take - singles)
    lengths[order] = np.cumsum(uses)[: len(live)]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        codes[s] = code
        code, last = code + 1, n
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next LONGEST bits."""
    codes = canonical_codes(lengths)
    symbol, size = np.zeros(1 << LONGEST, np.uint32), np.full(1 << LONGEST, LONGEST, np.int64)
    live = np.flatnonzero(lengths)
    order = live[np.argsort(codes[live] << (LONGEST - lengths[live]).astype(np.uint64))]
    runs = 1 << (LONGEST - lengths[order])
    symbol[: runs.sum()] = np.repeat(order, runs)
    size[: runs.sum()] = np.repeat(lengths[order], runs)
    return symbol, size


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload and the bit offset of every BLOCK-th token."""
    n = lengths[ids]
    end = np.cumsum(n)
    start = end - n
    bits = int(end[-1])
    at = codes[ids] << (64 - (start & 31) - n).astype(np.uint64)
    word = start >> 5
    size = (bits + 31) // 32 + 1
    high = np.bincount(word, weights=(at >> np.uint64(32)).astype(np.float64), minlength=size)
    low = np.bincount(word + 1, weights=(at & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)[:size]
    return (high + low).astype(np.uint64).astype(">u4").tobytes()[: (bits + 7) // 8], start[::BLOCK]


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], table) -> list[np.ndarray]:
    """Ids of each payload; the blocks of all payloads advance together, a token at a time."""
    symbol, size = table
    data = np.frombuffer(b"".join(p + b"\0\0\0" for p in payloads), np.uint8).astype(np.uint32)
    window = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    base = np.cumsum([0, *(len(p) + 3 for p in payloads)])[:-1]
    at = np.concatenate([c + 8 * b for c, b in zip(checkpoints, base.tolist(), strict=True)])
    left = np.concatenate([np.minimum(BLOCK, n - BLOCK * np.arange(len(c))) for c, n in zip(checkpoints, sizes, strict=True)])
    order = np.argsort(-left, kind="stable")
    out = np.zeros((len(at), BLOCK), np.uint32)
    at, falling = at[order], -left[order]
    for step in range(BLOCK):
        n = int(np.searchsorted(falling, -step, "left"))
        if not n:
            break
        here = at[:n]
        bits = window[here >> 3] >> (8 - (here & 7)).astype(np.uint32) & np.uint32(0xFFFF)
        out[:n, step] = symbol[bits]
        at[:n] += size[bits]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    first = np.cumsum([0, *(len(c) for c in checkpoints)])
    return [out[back[first[i] : first[i + 1]]].ravel()[: sizes[i]] for i in range(len(payloads))]


FRAME = "part long, seq long, doc_ids array<long>, n_tokens array<long>, checkpoints array<long>, payload binary"


def write_frames(lengths):
    def run(batches):
        sizes = lengths.value
        codes = canonical_codes(sizes)
        for batch in batches:
            part, seq, doc = (batch.column(c).to_pylist() for c in ("part", "seq", "doc_id"))
            n, raw = batch.column("n_tokens").to_pylist(), batch.column("ids")
            lo, out = 0, []
            while lo < len(raw):
                hi, total = lo, 0
                while hi < len(raw) and total < FRAME_TOKENS and part[hi] == part[lo]:
                    total += n[hi]
                    hi += 1
                payload, marks = pack(np.concatenate([np.frombuffer(r, f"<u{len(r) // k}") for r, k in zip(raw.slice(lo, hi - lo).to_pylist(), n[lo:hi], strict=True)]), codes, sizes)
                out.append((part[lo], seq[lo], doc[lo:hi], n[lo:hi], marks.tolist(), payload))
                lo = hi
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["part", "seq", "doc_ids", "n_tokens", "checkpoints", "payload"])

    return run


def read_frames(lengths):
    """Frames -> part, seq, doc_id, ids (little-endian uint32) of every document."""

    def run(batches):
        table = decode_table(lengths.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, FRAMES_AT_ONCE):
                some = batch.slice(lo, FRAMES_AT_ONCE)
                sizes = some.column("n_tokens").to_pylist()
                found = unpack(some.column("payload").to_pylist(), [np.array(c, np.int64) for c in some.column("checkpoints").to_pylist()], [sum(s) for s in sizes], table)
                out = []
                for part, seq, docs, n, ids in zip(some.column("part").to_pylist(), some.column("seq").to_pylist(), some.column("doc_ids").to_pylist(), sizes, found, strict=True):
                    cut = np.cumsum([0, *n]).tolist()
                    out += [(part, seq + i, d, ids[cut[i] : cut[i + 1]].tobytes()) for i, d in enumerate(docs)]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["part", "seq", "doc_id", "ids"])

    return run


def write_ids(docs: DataFrame, tokenizer: str, to: str) -> None:
    """Tokenize docs (doc_id, text, ...) and write them to the folder ``to``.

    Null texts are empty and hold only the end id. Rows without an id come first; rows that repeat an id stay apart, in
    any order. Extra columns are ignored. An empty table gives an empty file."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange(4 * shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id")
    ids = materialize(ordered.mapInArrow(encode_ids(tokenizer), IDS), "ids")
    counts = ids.filter("counts is not null").select("counts").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    of = np.zeros(max(counts.column("id").to_pylist(), default=0) + 1, np.int64)
    of[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    sizes = code_lengths(of, LONGEST)  # one number per id of the vocabulary
    lengths = spark.sparkContext.broadcast(sizes)
    ids.filter("part >= 0").drop("counts").mapInArrow(write_frames(lengths), FRAME).write.parquet(f"{to}/frames")
    header = [(int(i), int(sizes[i])) for i in np.flatnonzero(sizes)]
    spark.createDataFrame(header, "id long, bits long").coalesce(1).write.parquet(f"{to}/code")
    drop_scratch(ids)


def open_ids(spark: SparkSession, at: str):
    """The frames of a file and the broadcast code lengths of its header."""
    header = spark.read.parquet(f"{at}/code").toArrow()  # at most one row per id of the vocabulary
    sizes = np.zeros(max(header.column("id").to_pylist(), default=0) + 1, np.int64)
    sizes[header.column("id").to_numpy()] = header.column("bits").to_numpy()
    return spark.read.parquet(f"{at}/frames"), spark.sparkContext.broadcast(sizes)


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """part, seq, doc_id, ids (little-endian uint32) of every document of a file; (part, seq) is the order of the file."""
    ship(spark)
    frames, lengths = open_ids(spark, at)
    return frames.mapInArrow(read_frames(lengths), "part long, seq long, doc_id long, ids binary")


def token_digests(spark: SparkSession, at: str) -> DataFrame:
    """part, seq, doc_id, n_tokens and ids_crc32 of every document of a file; ids are digested in the task that decodes them."""
    ship(spark)
    frames, lengths = open_ids(spark, at)

    def run(batches):
        for batch in read_frames(lengths)(batches):
            raw = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "seq", "doc_id")), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64())], names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"]
            )

    return frames.mapInArrow(run, "part long, seq long, doc_id long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = f"{shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), file)
    found = materialize(token_digests(spark, file), "token-digests")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of ids
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
