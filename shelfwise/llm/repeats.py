"""Windows of tokens that occur more than once in the corpus: shared machinery of the suffix-array and automaton dedup.

1. Winnowing picks fingerprints so that equal windows pick equal fingerprints. One aggregation finds the fingerprints
   that occur at least twice; all other windows are unique and go no further.
2. A repeated fingerprint with the windows it stands for is a *context*. Equal contexts are collapsed, first within a
   document (a periodic text repeats one context at thousands of places), then over the corpus. A fingerprint with two or
   more different contexts is *mixed*: windows of one context may stand in another, and only there is search needed.
3. Contexts of a mixed fingerprint meet in one shard, and a shard function finds the repeated windows. What a task holds
   has to be bounded, so a fingerprint with more than ``GROUP`` contexts is dealt out window by window instead.
4. Findings go back to the documents as spans; documents without findings are never shuffled.

A row is known by (``ord``, ``row``): its id (the largest long if it has none) and a hash of id and text. So rows that
repeat an id with another text stay apart, and rows that repeat both are one document to be cut the same way.

Contexts are equal if two 64-bit hashes are (of the fingerprint and of the whole), windows dealt out by hash likewise:
among 10^13 windows the expected number of false equalities is far below one. Shards compare the tokens themselves
(bytes, or 64-bit hashes of words). Bitmaps sized by what they hold decide what is worth sending in 1 and 4; exact joins
follow them and do all the work where a bitmap would outgrow its bound."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.session import drop_scratch, free_name, materialize, member, membership, shuffle_width
from shelfwise.llm.text import byte_values, merge_spans, pieces, prefix_sums, slices, span_hash, winnow, words

GROUP = 4000
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Unit:
    """What a window is made of: 'bytes' or 'words' (between ASCII spaces, unchanged); its length and the fingerprint's."""

    kind: str
    window: int
    gram: int


def contexts(texts: pa.Array, unit: Unit):
    """For each piece: rows, fingerprints, document of each, first and last window start (in the document), context
    hash, and the tokens of the piece with their offset of each fingerprint's first window."""
    for piece in pieces(texts):
        if unit.kind == "bytes":
            bounds, tokens, sums = piece.bounds, piece.data, prefix_sums(byte_values(piece.data))
        else:
            w = words(piece, "space", lower=False)
            bounds, tokens, sums = w.bounds, w.hash, prefix_sums(w.hash)
        a = winnow(sums, bounds, unit.gram, unit.window)
        if not len(a.key):
            continue
        doc = np.searchsorted(bounds, a.first, "right") - 1
        yield piece.rows, a, doc, bounds, tokens, span_hash(sums, a.first, a.last + unit.window)


def fingerprints(unit: Unit):
    def run(batches):
        for batch in slices(batches, 0):
            keys, ctxs = [], []
            for _, a, _, _, _, whole in contexts(batch.column(0), unit):
                keys.append(a.key.view(np.int64))
                ctxs.append(whole.view(np.int64))
            if not keys:
                continue
            key, ctx = np.concatenate(keys), np.concatenate(ctxs)
            order = np.argsort(key, kind="stable")
            key, ctx = key[order], ctx[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n = np.diff(np.concatenate([at, [len(key)]]))
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(n), pa.array(np.minimum.reduceat(ctx, at)), pa.array(np.maximum.reduceat(ctx, at))], names=["key", "n", "lo", "hi"])

    return run


OCCURRENCE = "key long, ctx long, ord long, row long, n long, first long, span long, rest binary, tokens binary"


def occurrences(unit: Unit, repeated, mixed):
    """(ord, row, text) -> OCCURRENCE: a row per document and context, with the number of its places, the first one,
    the number of windows, the merged spans of the other places (int64 pairs, else null), and the tokens if mixed."""

    def run(batches):
        in_repeated, in_mixed = member(repeated), member(mixed)
        for batch in slices(batches, 2):
            for rows, a, doc, bounds, tokens, whole in contexts(batch.column(2), unit):
                at = np.flatnonzero(in_repeated.has(a.key)) if in_repeated else np.arange(len(a.key))
                if not len(at):
                    continue
                at = at[np.lexsort((whole[at], a.key[at], doc[at]))]  # stable: places stay in order
                key, ctx, d, first, last = a.key[at], whole[at], doc[at], a.first[at], a.last[at]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1]) | (d[1:] != d[:-1])]))
                n = np.diff(np.concatenate([head, [len(at)]]))
                rest = [None] * len(head)
                for i in np.flatnonzero(n > 1).tolist():
                    some = slice(head[i] + 1, head[i] + n[i])
                    lo, hi = merge_spans(first[some], last[some] + unit.window)
                    rest[i] = (np.stack([lo, hi], axis=1) - bounds[d[head[i]]]).astype(np.int64).tobytes()
                key, ctx, d, first, last = key[head], ctx[head], d[head], first[head], last[head]
                sent = in_mixed.has(key).tolist() if in_mixed else [True] * len(key)
                raw = [tokens[f : e + unit.window].tobytes() if m else None for f, e, m in zip(first.tolist(), last.tolist(), sent, strict=True)]
                take = pa.array(d + rows.start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(n), pa.array(first - bounds[d]), pa.array(last - first + 1), pa.array(rest, pa.binary()), pa.array(raw, pa.binary())],
                    names=["key", "ctx", "ord", "row", "n", "first", "span", "rest", "tokens"],
                )

    return run


FOUND = "key long, ctx long, starts binary"


def repeated_windows(docs: DataFrame, unit: Unit, shard: Callable, route: Callable) -> tuple[DataFrame, DataFrame]:
    """(occurrences, findings) of ``docs`` (as ``plain`` gives them), both written.

    occurrences: OCCURRENCE without tokens. findings: key, ctx, n (places), ``at`` (ord, row and first of the earliest)
    and ``starts`` (int32 offsets, from the context's first window, of windows that ``shard`` reports, null where it
    reports none), of contexts that have more than one place or a report."""
    spark = docs.sparkSession
    seen = docs.select("text").mapInArrow(fingerprints(unit), "key long, n long, lo long, hi long")
    seen = materialize(seen.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")), "fingerprints")
    repeated, mixed = membership(seen, "key"), membership(seen.filter("mixed"), "key")
    found = docs.select("ord", "row", "text").mapInArrow(occurrences(unit, repeated, mixed), OCCURRENCE)
    if repeated is None:
        found = found.join(seen.select("key"), "key", "left_semi")
    found = materialize(found, "occurrences")
    # summed and written before the join: one key may hold a large part of all places, or of all contexts
    summed = found.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("ord", "row", "first")).alias("at"))
    summed = materialize(summed, "sums")
    kinds = materialize(summed.join(seen, "key"), "contexts")
    frequent = kinds.filter("mixed").groupBy("key").agg(F.count("*").alias("n_ctx")).filter(F.col("n_ctx") > GROUP).select("key")
    frequent = materialize(frequent, "frequent")
    bodies = found.filter("tokens is not null").groupBy("key", "ctx").agg(F.first("tokens").alias("tokens"))
    bodies = bodies.join(kinds.filter("mixed").select("key", "ctx", "n", "at"), ["key", "ctx"])
    bodies = materialize(bodies.select("key", "ctx", "n", "at.ord", "at.row", "at.first", "tokens"), "bodies")
    small = bodies.join(frequent, "key", "left_anti").repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "ord", "row", "first", "ctx").mapInArrow(shard, FOUND)
    large = route(bodies.join(frequent, "key", "left_semi"), unit)
    results = kinds.select("key", "ctx", "n", "at").join(small.unionByName(large), ["key", "ctx"], "left").filter("n > 1 or starts is not null")
    results = materialize(results, "findings")
    drop_scratch(seen, summed, kinds, frequent, bodies)
    return found, results


def groups_of(batches, limit: int):
    """Rows of sorted Arrow batches as lists of whole key groups, cut once a list holds ``limit`` bytes of tokens."""
    rows, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != last and size >= limit:
                yield rows
                rows, size = [], 0
            rows.append(row)
            last, size = row[0], size + len(row[6])
    if rows:
        yield rows


def window_rows(unit: Unit):
    """A row for every window of the contexts of a very frequent fingerprint: its hash and fingerprint, its context, its
    offset there, and where it first stands."""

    def run(batches):
        width = 1 if unit.kind == "bytes" else 8
        for batch in batches:
            for key, ctx, _, order, row, first, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = byte_values(np.frombuffer(tokens, np.uint8)) if width == 1 else np.frombuffer(tokens, np.uint64)
                sums = prefix_sums(values)
                at = np.arange(len(values) - unit.window + 1)
                whole = span_hash(sums, at, at + unit.window).view(np.int64)
                same = [pa.array(np.full(len(at), x, np.int64)) for x in (key, ctx, order, row)]
                yield pa.RecordBatch.from_arrays([pa.array(whole), same[0], same[1], pa.array(at), same[2], same[3], pa.array(at + first)], names=["whole", "key", "ctx", "off", "ord", "row", "start"])

    return run


WINDOW = "whole long, key long, ctx long, off long, ord long, row long, start long"


def pack_starts(df: DataFrame) -> DataFrame:
    """(key, ctx, off) -> FOUND: one row per context; a context has at most a few hundred windows."""

    def pack(batches):
        for batch in batches:
            starts = [np.array(sorted(x), np.int32).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.binary())], names=["key", "ctx", "starts"])

    return df.groupBy("key", "ctx").agg(F.collect_list("off").alias("offs")).mapInArrow(pack, FOUND)


def merge_row(full: list, rest: list, own: list, window: int) -> bytes:
    """All spans of one document as merged int64 pairs."""
    lo, hi = [x["lo"] for x in full], [x["hi"] for x in full]
    for raw in rest:
        pairs = np.frombuffer(raw, np.int64)
        lo.extend(pairs[::2].tolist())
        hi.extend(pairs[1::2].tolist())
    for x in own:
        at = (np.frombuffer(x["starts"], np.int32).astype(np.int64) + x["first"]).tolist()
        lo.extend(at)
        hi.extend(a + window for a in at)
    start, end = merge_spans(np.array(lo, np.int64), np.array(hi, np.int64))
    return np.stack([start, end], axis=1).tobytes()


def spans_of(df: DataFrame, window: int) -> DataFrame:
    """(ord, row, first, span, full, rest, starts) -> ord, row, spans: int64 pairs (start, end) of covered tokens, merged.
    ``full``: all windows of the first place go; ``rest``: spans of other places; ``starts``: single windows of the first
    place. Equal spans of rows that repeat an id and a text meet once. A document's spans are bounded by its length."""
    each = df.select(
        "ord",
        "row",
        F.when(F.col("full"), F.struct(F.col("first").alias("lo"), (F.col("first") + F.col("span") - 1 + window).alias("hi"))).alias("full"),
        "rest",
        F.when(F.col("starts").isNotNull(), F.struct("first", "starts")).alias("own"),
    )
    gathered = each.groupBy("ord", "row").agg(*(F.collect_set(c).alias(c) for c in ("full", "rest", "own")))

    def merge(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            full = batch.column(2)
            at = full.offsets.to_numpy().astype(np.int64)
            lo, hi = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in full.flatten().flatten())
            at -= at[0]
            doc = np.repeat(np.arange(len(full)), np.diff(at))
            order = np.lexsort((lo, doc))
            lo, hi, doc = lo[order], hi[order], doc[order]
            extra = {i for c in (3, 4) for i in np.flatnonzero(np.diff(batch.column(c).offsets.to_numpy())).tolist()}
            rest, own = (batch.column(c).to_pylist() if extra else [] for c in (3, 4))
            out = []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                start, end = lo[a:b], hi[a:b]
                if i in extra:
                    more = np.frombuffer(merge_row([], rest[i], own[i], window), np.int64).reshape(-1, 2)
                    start, end = np.concatenate([start, more[:, 0]]), np.concatenate([end, more[:, 1]])
                start, end = merge_spans(start, end)
                out.append(np.stack([start, end], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["ord", "row", "spans"])

    return gathered.mapInArrow(merge, "ord long, row long, spans binary")


def with_spans(docs: DataFrame, spans: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Apply ``run`` to (doc_id, text, spans binary or null). ``spans`` is a written table; only documents that may have
    spans are shuffled for the join."""
    marks = membership(spans, "row")
    joined = ["doc_id", "text", "spans"]
    cols = ["ord", "row", "doc_id", "text"]
    if marks is None:
        return docs.join(spans, ["ord", "row"], "left").select(joined).mapInArrow(run, schema)

    def hit(batches):
        kept = member(marks)
        for batch in batches:
            yield batch.filter(pa.array(kept.has(np.asarray(batch.column(1)).view(np.uint64))))

    def miss(batches):
        kept = member(marks)
        for batch in batches:
            rest = batch.filter(pa.array(~kept.has(np.asarray(batch.column(1)).view(np.uint64))))
            yield from run([pa.RecordBatch.from_arrays([rest.column(2), rest.column(3), pa.nulls(rest.num_rows, pa.binary())], names=joined)])

    docs = docs.select(cols)
    near = docs.mapInArrow(hit, "ord long, row long, doc_id long, text string").join(spans, ["ord", "row"], "left").select(joined)
    return near.mapInArrow(run, schema).unionByName(docs.mapInArrow(miss, schema))


def key_of() -> tuple[Column, Column]:
    doc_id = F.col("doc_id").cast("long")
    return F.coalesce(doc_id, F.lit(NO_ID)), F.xxhash64(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")))


def plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key (ord, row)."""
    order, row = key_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), order.alias("ord"), row.alias("row"))


def with_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the key of each row in two more columns, and their names, which no column of ``docs`` has."""
    one, two = free_name(docs, "_ord"), free_name(docs, "_row")
    order, row = key_of()
    return docs.withColumns({one: order, two: row}), one, two


def read_spans(spans) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
