"""Suffix-array dedup: bytes covered by a 200-byte string that starts twice anywhere in the corpus.

The arrays are built per shard by induced sorting on numpy: suffixes are classified as S or L, leftmost-smaller (LMS)
substrings are sorted by an induction of their own and named, the string of names is sorted by a recursion that doubles
the length it compares (its alphabet is too large for bucket sweeps in numpy), and one linear induction over the buckets
gives the array. Within a bucket everything that one sweep step would place is placed at once, in the order of that step.
Common prefixes are computed in text order (permuted): only irreducible positions are compared, the others follow from
their left neighbour.

Contexts that are equal as a whole are counted and never sorted; see ``repeats`` for what reaches a shard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.repeats import WINDOW, Unit, groups_of, pack_starts, plain, read_spans, repeated_windows, spans_of, window_rows, with_spans
from shelfwise.llm.session import drop_scratch, materialize, ship
from shelfwise.llm.text import slices

SHARD_BYTES = 2 << 20
UNIT = Unit("bytes", 200, 100)


def classify(s: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the suffix to their right); the last suffix counts as L unless it is alone."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    stype = np.zeros(n, bool)
    known = nearest < n
    stype[:-1][known] = step[nearest[known]] > 0
    return stype


def lms_positions(stype: np.ndarray) -> np.ndarray:
    return np.flatnonzero(stype[1:] & ~stype[:-1]) + 1


def append(sa: np.ndarray, cursor: np.ndarray, pos: np.ndarray, chars: np.ndarray, down: bool) -> None:
    """Place ``pos`` in the buckets of ``chars``, in order, at the buckets' cursors."""
    order = np.argsort(chars, kind="stable")
    chars, pos = chars[order], pos[order]
    cut = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    size = np.diff(np.concatenate([cut, [len(chars)]]))
    rank = np.arange(len(chars)) - np.repeat(cut, size)
    heads = chars[cut]
    if down:
        sa[cursor[chars] - rank] = pos
        cursor[heads] -= size
    else:
        sa[cursor[chars] + rank] = pos
        cursor[heads] += size


def induce(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``s`` from LMS suffixes in order: L suffixes left to right, then S suffixes right to left."""
    n = len(s)
    size = np.bincount(s, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    left = np.full(n, -1, np.int64)
    head = start.copy()
    of = s[lms]
    order = np.argsort(of, kind="stable")
    by_char = lms[order]
    lms_size = np.bincount(of, minlength=sigma)
    lms_end = np.cumsum(lms_size)
    # the last suffix is L with nothing to its right: it comes first in its bucket
    append(left, head, np.array([n - 1]), s[n - 1 :].astype(np.int64), False)
    for c in range(sigma):
        if not size[c]:
            continue
        done = start[c]
        while done < head[c]:
            here = left[done : head[c]]
            done = head[c]
            prev = here[here > 0] - 1
            prev = prev[~stype[prev]]
            if len(prev):
                append(left, head, prev, s[prev].astype(np.int64), False)
        if lms_size[c]:
            prev = by_char[lms_end[c] - lms_size[c] : lms_end[c]] - 1
            append(left, head, prev, s[prev].astype(np.int64), False)
    right = np.full(n, -1, np.int64)
    tail = end - 1
    for c in range(sigma - 1, -1, -1):
        if not size[c]:
            continue
        done = end[c] - 1
        while done > tail[c]:
            here = right[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            prev = here[here > 0] - 1
            prev = prev[stype[prev]]
            if len(prev):
                append(right, tail, prev, s[prev].astype(np.int64), True)
        here = left[start[c] : head[c]][::-1]
        prev = here[here > 0] - 1
        prev = prev[stype[prev]]
        if len(prev):
            append(right, tail, prev, s[prev].astype(np.int64), True)
    return np.where(left >= 0, left, right)


def names_of(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name of each LMS substring (in text order): equal substrings share one, names are in the order of ``ordered``."""
    n, m = len(s), len(lms)
    stop = np.concatenate([lms[1:], [n - 1]])
    index = np.searchsorted(lms, ordered)
    length = stop[index] - ordered + 1
    same = np.zeros(m, bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    step = 0
    while len(live):
        equal = s[ordered[live] + step] == s[ordered[live - 1] + step]
        live = live[equal]
        step += 1
        full = length[live] == step
        same[live[full]] = True
        live = live[~full]
    names = np.empty(m, np.int64)
    names[index] = np.cumsum(~same) - 1
    return names


def sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string: each call names its pairs at twice the distance and recurses on them."""

    def deeper(rank: np.ndarray, reach: int) -> np.ndarray:
        nxt = np.zeros(len(rank), np.int64)
        nxt[: max(0, len(rank) - reach)] = rank[reach:] + 1
        key = rank * np.int64(len(rank) + 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        return order if new[order[-1]] == len(rank) - 1 or reach >= len(rank) else deeper(new, reach * 2)

    return deeper(names, 1)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of an integer string over [0, sigma)."""
    if len(s) < 2:
        return np.arange(len(s))
    stype = classify(s)
    lms = lms_positions(stype)
    if len(lms) > 1:
        rough = induce(s, stype, lms, sigma)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        names = names_of(s, lms, rough[is_lms[rough]])
        lms = lms[sort_names(names)] if names.max() < len(lms) - 1 else lms[np.argsort(names)]
    return induce(s, stype, lms, sigma)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) in text order: the suffix before each in the array, and the length of their common prefix."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    before = phi > 0
    reducible = np.zeros(n, bool)
    ok = before & (at > 0)
    reducible[ok] = s[at[ok] - 1] == s[phi[ok] - 1]
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    padded = np.concatenate([s, np.full(8, -1, s.dtype)])
    while len(live):
        p, q = live + plcp[live], phi[live] + plcp[live]
        inside = (p < n) & (q < n)
        live, p, q = live[inside], p[inside], q[inside]
        equal = padded[p] == padded[q]
        live = live[equal]
        plcp[live] += 1
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return phi, np.where(reducible, plcp[source] - (at - source), plcp)


def repeated_starts(bodies: list[bytes], window: int) -> list[np.ndarray]:
    """For each body the offsets of its windows that also start elsewhere in the bodies."""
    size = np.array([len(b) for b in bodies])
    first = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()), np.int16)
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    inside = np.ones(len(s), bool)
    inside[first + size] = False
    s[inside] = flat.astype(np.int16) + 1
    sa = suffix_array(s, 257)
    phi, plcp = permuted_prefixes(s, sa)
    left = np.repeat(first + size, size + 1) - np.arange(len(s))
    bound = np.minimum(plcp, left)
    bound = np.where(phi >= 0, np.minimum(bound, left[phi]), 0)
    hit = bound >= window
    repeated = hit.copy()
    repeated[phi[hit]] = True
    return [np.flatnonzero(repeated[f : f + n]) for f, n in zip(first, size, strict=True)]


def array_shard(batches):
    for rows in groups_of(batches, SHARD_BYTES):
        found = repeated_starts([r[6] for r in rows], UNIT.window)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([x.astype(np.int32).tobytes() if len(x) else None for x in found], pa.binary())], names=["key", "ctx", "starts"]
        )


def by_window(bodies: DataFrame, unit: Unit) -> DataFrame:
    """Windows of very frequent fingerprints, each routed by its own hash: those of two places are repeated."""
    rows = bodies.mapInArrow(window_rows(unit), WINDOW)
    twice = rows.groupBy("key", "whole").agg(F.count("*").alias("places")).filter("places > 1").select("key", "whole")
    return pack_starts(rows.join(twice, ["key", "whole"], "left_semi").select("key", "ctx", "off"))


def cut_bytes(batches):
    for batch in slices(batches, 1):
        out = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            start, end = read_spans(spans)
            kept, last = [], 0
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                kept.append(data[last:a])
                last = b
            kept.append(data[last:])
            out.append((doc_id, len(data), int((end - start).sum()), len(start), hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (as ``plain`` gives them) -> ord, row, spans: covered bytes of each document that has any, written."""
    places, found = repeated_windows(docs, UNIT, array_shard, by_window)
    # a context that occurs twice is repeated as a whole; one that occurs once has what the shard reports
    hits = found.select("key", "ctx", (F.col("n") > 1).alias("full"), F.when(F.col("n") == 1, F.col("starts")).alias("starts"))
    spans = materialize(spans_of(places.drop("n", "tokens").join(hits, ["key", "ctx"]), UNIT.window), "spans")
    drop_scratch(places, found)
    return spans


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of ``docs``.

    A byte goes when a 200-byte string over it also starts anywhere else, in the same document included; strings do not
    cross documents. Null and empty texts, and texts under 200 bytes, keep all. Every row is a document of its own: rows
    that repeat an id, with equal or with other texts, and rows without an id are compared and cut like all others. Extra
    columns are ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    docs = plain(docs)
    return with_spans(docs, repeated_spans(docs), cut_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sql(window: int = UNIT.window) -> str:
    """Equal 200-byte strings by names of 2, 4, ... 128 bytes (each names the pairs of the last), and 200 = 128 + 64 + 8."""
    powers = [1 << k for k in range(window.bit_length()) if window >> k & 1][::-1]  # the string is cut into these
    steps, kept = [], []
    for k in range(powers[0].bit_length() - 1):
        if 1 << k in powers:
            kept.append(f"r AS r{1 << k}")
        held = "".join(f"{x}, " for x in kept)
        steps.append(f"s{k + 1} AS (SELECT doc_id, i, x, {held}dense_rank() OVER (ORDER BY r, s) AS r FROM (SELECT *, lead(r, {1 << k}) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM s{k})),")
        kept = [x.split(" AS ")[-1] for x in kept]
    parts = [f"lead({'r' if p == powers[0] else f'r{p}'}, {sum(powers[:j])}) OVER d AS p{j}" for j, p in enumerate(powers)]
    names = ", ".join(f"p{j}" for j in range(len(powers)))
    newline = "\n"
    return f"""
WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(coalesce(text, '')), '..')) AS x, unnest(range(0, len(regexp_extract_all(hex(coalesce(text, '')), '..')))) AS i FROM documents),
s0 AS (SELECT doc_id, i, x, ascii(x[1]) * 256 + ascii(x[2]) AS r FROM b),
{newline.join(steps)}
w AS (SELECT doc_id, i, x, CASE WHEN lead(i, {window - 1}) OVER d IS NOT NULL THEN count(*) OVER (PARTITION BY {names}) END AS n FROM (SELECT doc_id, i, x, {', '.join(parts)} FROM s{len(steps)} WINDOW d AS (PARTITION BY doc_id ORDER BY i)) WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, x, coalesce(i - max(CASE WHEN n > 1 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) < {window}, false) AS gone FROM w),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
f AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents LEFT JOIN f USING (doc_id)
"""
