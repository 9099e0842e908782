"""Fill-in-middle transformation over a learned rank index.

The tokens of a text are runs of letters and single other characters. What is kept of the token boundaries of a batch of
texts is a rank index: lines fitted to (rank, byte offset), each so long as it is at most ``MOST_ERROR`` off, and the
residual of every boundary in one byte. A cut is predicted by the line of its rank and made exact by its residual."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfwise.llm.session import free_name, ship
from shelfwise.llm.text import Piece, pieces, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MOST_ERROR = 127
#: Percent of texts that stay plain, and percent of the others whose suffix comes first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20


@dataclass
class RankIndex:
    """Boundary offsets by rank, as lines and residuals."""

    first: np.ndarray  # least rank of each line
    base: np.ndarray  # offset predicted there
    slope: np.ndarray
    residual: np.ndarray  # of every rank

    @classmethod
    def fit(cls, offsets: np.ndarray, bounds: np.ndarray, most: int = MOST_ERROR) -> RankIndex:
        """Ascending offsets of several texts, ``bounds`` their n+1 places (no text is without an offset). Lines go from
        the first to the last offset of a text; those more than ``most`` off somewhere are halved until none is."""
        lo, hi = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64) - 1
        residual = np.zeros(len(offsets), np.int8 if most < 128 else np.int64)
        lines = []
        while len(lo):
            size = hi - lo + 1
            slope = (offsets[hi] - offsets[lo]) / np.maximum(size - 1, 1)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            line = np.repeat(np.arange(len(lo)), size)
            step = np.arange(len(line)) - starts[line]
            off = offsets[lo[line] + step] - offsets[lo][line] - np.floor(slope[line] * step).astype(np.int64)
            fits = np.maximum.reduceat(np.abs(off), starts) <= most
            good = fits[line]
            residual[(lo[line] + step)[good]] = off[good]
            lines.append((lo[fits], offsets[lo[fits]], slope[fits]))
            lo, hi = lo[~fits], hi[~fits]
            middle = (lo + hi) // 2
            lo, hi = np.concatenate([lo, middle + 1]), np.concatenate([middle, hi])
        first, base, slope = (np.concatenate([x[j] for x in lines]) if lines else np.empty(0) for j in range(3))
        order = np.argsort(first, kind="stable")
        return cls(first[order], base[order], slope[order], residual)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of some ranks."""
        line = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[line] + np.floor(self.slope[line] * (ranks - self.first[line])).astype(np.int64) + self.residual[ranks]


def boundaries(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (in the piece) at which 0, 1, ... n tokens of each text have ended, and the n+1 places of texts."""
    data, bounds = piece.data, piece.bounds
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    heads = bounds[:-1][np.diff(bounds) > 0]
    begins[heads] = True
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, bounds, "left")
    places = counts + np.arange(len(bounds))
    offsets = np.empty(len(starts) + len(bounds) - 1, np.int64)
    ends = places[1:] - 1
    inside = np.ones(len(offsets), bool)
    inside[ends] = False
    offsets[inside], offsets[ends] = starts, bounds[1:]
    return offsets, places


def marked(piece: Piece) -> np.ndarray:
    """Which texts of a piece hold a mark."""
    data, bounds = piece.data, piece.bounds
    found = np.zeros(len(bounds) - 1, bool)
    if len(data) > 2:
        second = data[1:-1]
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((second == ord("P")) | (second == ord("S")) | (second == ord("M"))))
        text = np.searchsorted(bounds, at, "right") - 1
        found[text[at + 3 <= bounds[text + 1]]] = True
    return found


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned numbers for each id: the first eight-digit groups of the sha256 of ``seed:id``."""
    joined = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(joined, ">u4").reshape(-1, 4).astype(np.int64)


FIM = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


def transformer(id_at: int, text_at: int, seed: int, name: str):
    def run(batches):
        for batch in slices(batches, text_at):
            rows = batch.num_rows
            n, prefix, middle = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            form, output = np.empty(rows, object), [b""] * rows
            for piece in pieces(batch.column(text_at)):
                mine = slice(piece.rows.start, piece.rows.stop)
                h = draws(batch.column(id_at).slice(piece.rows.start, len(piece.rows)).to_pylist(), seed)
                offsets, places = boundaries(piece)
                index = RankIndex.fit(offsets, places)
                del offsets
                tokens = np.diff(places) - 1
                one, two = h[:, 0] % (tokens + 1), h[:, 1] % (tokens + 1)
                a, b = (index.at(places[:-1] + cut) for cut in (np.minimum(one, two), np.maximum(one, two)))
                begun = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
                start, end = piece.bounds[:-1], piece.bounds[1:]
                n[mine], prefix[mine], middle[mine] = tokens, begun[a] - begun[start], begun[b] - begun[a]
                plain = (start == end) | marked(piece) | (h[:, 2] % 100 >= PLAIN_FROM)
                form[mine] = np.where(plain, "plain", np.where(h[:, 3] % 100 < SUFFIX_FIRST, "spm", "psm"))
                whole = memoryview(piece.data.tobytes())
                for i, row in enumerate(piece.rows):
                    x, y, z = whole[start[i] : a[i]], whole[a[i] : b[i]], whole[b[i] : end[i]]
                    if form[row] == "plain":
                        output[row] = bytes(whole[start[i] : end[i]])
                    elif form[row] == "spm":
                        output[row] = b"".join((SUFFIX, z, PREFIX, x, MIDDLE, y))
                    else:
                        output[row] = b"".join((PREFIX, x, SUFFIX, z, MIDDLE, y))
            plain = form == "plain"
            made = pa.StructArray.from_arrays([pa.array(n), pa.array(form, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(output, pa.binary()).cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """docs -> (its columns and a struct of n (tokens), form, prefix_chars, middle_chars (code points) and output; the name
    of the struct: ``fim``, with underscores in front if ``docs`` has a column of that name).

    Cuts and form of a row follow from its id and the seed alone (nothing for a null id), so reruns agree and rows that
    repeat an id are cut alike as far as their texts are. A null or empty text has no tokens and is plain, with an empty
    output; a text that holds a mark is plain. An empty table gives an empty result."""
    ship(docs.sparkSession)
    name = free_name(docs, "fim")
    run = transformer(docs.columns.index(id_column), docs.columns.index(text_column), seed, name)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, FIM)])), name


def restored(output, form):
    """The text that an output (column) of a form (column) was made of. Marks are found from the left: no text that is cut
    holds one, and no two marks can overlap."""
    first, then = F.when(form == "spm", SUFFIX.decode()).otherwise(PREFIX.decode()), F.when(form == "spm", PREFIX.decode()).otherwise(SUFFIX.decode())
    at, last = F.position(then, output), F.position(F.lit(MIDDLE.decode()), output)
    size = F.length(first)
    one = F.substring(output, size + 1, at - size - 1)
    two = F.substring(output, at + size, last - at - size)
    middle = F.substring(output, last + size, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out, name = fill_in_middle(docs)
    f = F.col(name)
    return out.select("doc_id", f["n"].alias("n"), f["form"].alias("form"), f["prefix_chars"].alias("prefix_chars"), f["middle_chars"].alias("middle_chars"), F.sha2(f["output"], 256).alias("output_sha256"), F.sha2(restored(f["output"], f["form"]), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, text, tokens, len(tokens) AS n, {', '.join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM n),
x AS (SELECT *, array_to_string(tokens[:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM x
"""
