"""Substring dedup on words: a word goes when a 20-word window over it also starts earlier in the corpus.

Documents are streamed through suffix automata for their matching statistics (the length of the longest suffix read so
far that the automaton knows); where that reaches the window length, the window is a repeat of what came before. The
reference is the corpus itself, so it is cut into shards by winnowed fingerprint, each with the contexts in which a
repeat is possible at all, in corpus order, and an automaton grows by a context after that context has been streamed.
The automata stay where their shard is: sending them to every executor would broadcast something that grows with the data."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.repeats import WINDOW, Unit, groups_of, pack_starts, plain, read_spans, repeated_windows, spans_of, window_rows, with_spans
from shelfwise.llm.session import drop_scratch, materialize, ship
from shelfwise.llm.text import slices

SHARD_BYTES = 4 << 20
UNIT = Unit("words", 20, 5)


class SuffixAutomaton:
    """Suffix automaton of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            p = last
            if q is None:
                last = len(nxt)
                nxt.append({})
                length.append(length[p] + 1)
                link.append(0)
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = last
                    p = link[p]
                if p == -1:
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[last] = q
                    continue
            twin = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = twin
            if last != p:
                link[last] = twin
            else:
                last = twin
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = twin
                p = link[p]

    def matches(self, sequence) -> list[int]:
        """Matching statistics: for each position the longest known substring that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state, known, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                known = length[state]
            to = nxt[state].get(c)
            if to is None:
                known = 0
            else:
                state, known = to, known + 1
            out.append(known)
        return out


def automaton_shard(batches):
    """Contexts sorted by fingerprint and place -> offsets of windows that stand in an earlier context."""
    for rows in groups_of(batches, SHARD_BYTES):
        key, seen, found = None, None, []
        for r in rows:
            if r[0] != key:
                key, seen = r[0], SuffixAutomaton()
            sequence = np.frombuffer(r[6], np.uint64).tolist()
            known = np.array(seen.matches(sequence))
            found.append(np.flatnonzero(known[UNIT.window - 1 :] >= UNIT.window))
            seen.add(sequence)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([x.astype(np.int32).tobytes() if len(x) else None for x in found], pa.binary())], names=["key", "ctx", "starts"]
        )


def by_window(bodies: DataFrame, unit: Unit) -> DataFrame:
    """Windows of very frequent fingerprints, each routed by its own hash: all but the earliest are repeats."""
    rows = bodies.mapInArrow(window_rows(unit), WINDOW)
    place = F.struct("ord", "row", "start")
    earliest = rows.groupBy("key", "whole").agg(F.min(place).alias("at"), F.count("*").alias("places")).filter("places > 1").drop("places")
    later = rows.join(earliest, ["key", "whole"]).filter(place != F.col("at"))
    return pack_starts(later.select("key", "ctx", "off"))


def cut_words(batches):
    for batch in slices(batches, 1):
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tokens = (text or "").encode().split()
            start, end = read_spans(spans)
            kept, last = [], 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept += tokens[last:a]
                last = b
            kept += tokens[last:]
            out.append((doc_id, len(tokens), len(tokens) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def later_spans(docs: DataFrame) -> DataFrame:
    """docs (as ``plain`` gives them) -> ord, row, spans: covered words of each document that has any, written."""
    places, found = repeated_windows(docs, UNIT, automaton_shard, by_window)
    joined = places.drop("n", "tokens").join(found.select("key", "ctx", "at", "starts"), ["key", "ctx"])
    earliest = F.struct("ord", "row", "first") == F.col("at")
    judged = joined.select("ord", "row", "first", "span", (~earliest).alias("full"), "rest", F.when(earliest, F.col("starts")).alias("starts"))
    spans = materialize(spans_of(judged.filter("full or rest is not null or starts is not null"), UNIT.window), "spans")
    drop_scratch(places, found)
    return spans


def remove_later_windows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256, one row per row of ``docs``.

    Words stand between ASCII spaces and are compared unchanged; windows do not cross documents and are judged on the
    input. Null, empty and short texts keep all. Earlier means a smaller id, or an earlier start in the same row; rows
    without an id come after all others, rows that repeat an id with another text are in the order of a hash of the text,
    and rows that repeat an id and a text are one place and are cut alike. Extra columns are ignored; an empty table gives
    an empty result."""
    ship(docs.sparkSession)
    docs = plain(docs)
    return with_spans(docs, later_spans(docs), cut_words, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS whole FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, unnest(range(0, 20)) AS t(o)),
per AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
pos AS (SELECT w.doc_id, len(words) AS n_words, words, coalesce(len(ps), 0) AS n_removed FROM w LEFT JOIN per USING (doc_id)),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t FROM (SELECT doc_id, words[p] AS word, p FROM w, unnest(range(1, len(words) + 1)) AS t(p)) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT pos.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM pos LEFT JOIN kept USING (doc_id)
"""
