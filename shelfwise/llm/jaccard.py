"""N-gram Jaccard join: documents whose sets of word shingles overlap by 0.8 or more, and the groups they form.

Rare-first prefix filtering: the grams of a document are put in one global order, rare ones first, and only the first
n - ceil(0.8 n) + 1 are posted, as two similar sets must share one of those. Candidates then pass the length filter, the
positional filter and two suffix filters (what can still be shared behind the posted gram, by ranges of hashes; and whole
signatures: two sets differ in at least as many grams as the parities of their hash slots differ in bits), and each pair
that is left is verified once on the whole sets.

The order comes from document counts over all documents in a table of ``SLOTS`` counters (fixed size, so it can be
broadcast); any order gives the same links, a good one keeps frequent grams out of the prefixes. Grams that still stand in
``HOT`` prefixes or more are then moved behind all others and prefixes are taken anew, so what is left in them is rare, or
the document has nothing rarer.

Documents with one set are one class and take part once. A large group of near copies would still share grams in
hundreds of thousands of pairs, so every set is first matched with the pivots of its grams (``PIVOT_TURNS`` of them). While
more than one of ``MANY`` sets (and ``LEAST_MANY``) then still has a likely link to a pivot in another group, each is
matched with the nearest such pivot (``NEAREST_TURNS`` at most, ended by a turn with few links), and only sets that share
a gram and are in different groups after that are paired in full. No link between groups is lost, as every pair that
passes the filters is either inside a group already or verified. A pair that shares many grams is made at
the first of them in a row only: a posting knows the two posted before it, and where one of them is shared, the pair is
made there.

Shingles and sets are compared by 64-bit hashes: two different shingles of two documents are taken for equal with a
probability of 2^-64 each, which moves a similarity by less than it takes to change any but a borderline link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.components import components
from shelfwise.llm.repeats import NO_ID, plain, with_key
from shelfwise.llm.session import drop_scratch, materialize, member, membership, release_shuffles, ship, shuffle_width, spread
from shelfwise.llm.text import gram_starts, pieces, prefix_sums, slices, span_hash, words

SLOTS = 1 << 18
BLOCK = 1 << 12
PIVOT_TURNS = 2
NEAREST_TURNS = 4
MANY = 1000
LEAST_MANY = 64
HOT = 8
PARITY = 2  # longs
WIDE = 16  # longs of a signature that open postings carry
LONGEST_SIGNATURE = 1 << 20


def shingle_sets(texts: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each text; a text of fewer than k words, but not none, has one shingle."""
    for piece in pieces(texts):
        w = words(piece, "space", lower=True)
        sums = prefix_sums(w.hash)
        at = np.flatnonzero(gram_starts(w.bounds, k)) if len(w.hash) else np.empty(0, np.int64)
        gram = span_hash(sums, at, at + k)
        cut = np.searchsorted(at, w.bounds)
        for i, row in enumerate(piece.rows):
            lo, hi = w.bounds[i], w.bounds[i + 1]
            if hi - lo >= k:
                mine = np.sort(gram[cut[i] : cut[i + 1]])
                new = np.ones(len(mine), bool)
                np.not_equal(mine[1:], mine[:-1], out=new[1:])
                yield row, mine[new]
            elif hi > lo:
                yield row, span_hash(sums, np.array([lo]), np.array([hi]))
            else:
                yield row, np.empty(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """A hash of the set: the sum of its mixed members."""
    total = np.array([len(grams)], np.uint64) + spread(grams).sum(dtype=np.uint64)
    return int(spread(total).view(np.int64)[0])


def signature(grams: np.ndarray) -> bytes:
    """For each hash slot whether it holds an odd number of grams; between two and four slots a gram, and
    as many as ``WIDE`` longs have at least."""
    bits = min(max(64 * WIDE, 1 << (2 * len(grams) - 1).bit_length()), LONGEST_SIGNATURE)
    return np.packbits(np.bincount((spread(grams) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def signature_distance(x: bytes, y: bytes) -> int:
    """Bits in which two signatures differ; the longer one is folded onto the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def survey(k: int):
    """(ord, row, text) -> one row per document (its key, set size, set id and signature) and the counters of the task in
    blocks."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, 2):
            at, sizes, sets, marks, all_grams = [], [], [], [], []
            for row, grams in shingle_sets(batch.column(2), k):
                at.append(row)
                sizes.append(len(grams))
                sets.append(set_id(grams) if len(grams) else None)
                marks.append(signature(grams) if len(grams) else None)
                all_grams.append(grams)
            counts += np.bincount((np.concatenate(all_grams) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())],
                names=["ord", "row", "n_shingles", "sid", "signature", "block", "counts"],
            )
        blocks = counts.reshape(-1, BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(full), pa.binary()), pa.array(full, pa.int64()), pa.array([b.astype(np.int32).tobytes() for b in blocks[full]], pa.binary())], names=["ord", "row", "n_shingles", "sid", "signature", "block", "counts"])

    return run


def add_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[b].tobytes() for b in keys], pa.binary())], names=["block", "counts"])


def gram_counts(surveyed: DataFrame, spark: SparkSession):
    """The broadcast table of SLOTS counters; its size does not depend on the data."""
    rows = surveyed.filter("block is not null").select("block", "counts").repartition(min(shuffle_width(spark), SLOTS // BLOCK), "block").mapInArrow(add_blocks, "block long, counts binary").collect()
    table = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    for row in rows:
        table[row.block] += np.frombuffer(row.counts, np.int64)
    return spark.sparkContext.broadcast(table.ravel())


def in_order(grams: np.ndarray, p: int, table: np.ndarray, last) -> np.ndarray:
    """The first p grams in the order of (frequent, order of magnitude of the count, hash)."""
    rank = np.frexp(table[(grams & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.float32))[1].astype(np.uint64)
    if last is not None:
        rank |= last.has(grams).astype(np.uint64) << np.uint64(5)
    key = rank << np.uint64(58) | grams >> np.uint64(6)
    first = np.argpartition(key, p - 1)[:p] if p < len(key) else np.arange(p)
    return grams[first[np.argsort(key[first], kind="stable")]]


def postings(k: int, counts, hot=None, with_sets: bool = True):
    """text -> (gram, sid) of the prefix of every set, or its grams only."""

    def run(batches):
        table, last = counts.value, member(hot)
        for batch in slices(batches, 0):
            found, sids, size = [np.empty(0, np.uint64)], [], []
            for _, grams in shingle_sets(batch.column(0), k):
                if len(grams):
                    size.append(prefix_length(len(grams)))
                    found.append(in_order(grams, size[-1], table, last))
                    if with_sets:
                        sids.append(set_id(grams))
            gram = pa.array(np.concatenate(found).view(np.int64))
            if with_sets:
                yield pa.RecordBatch.from_arrays([gram, pa.array(np.repeat(np.array(sids, np.int64), size))], names=["gram", "sid"])
            else:
                yield pa.RecordBatch.from_arrays([gram], names=["gram"])

    return run


NEAR = ["gram", "sid", "n", "pos", "tail", "before1", "before2", *(f"odd{j}" for j in range(PARITY))]


def near_postings(k: int, counts, hot, only):
    """text -> NEAR: the prefix grams that ``only`` (a bitmap of shared grams, if there is one) holds, with the size of
    the set, the place in the order, ``tail`` (for eight ranges of hashes how many grams stand behind, 255: that or more),
    the two grams posted before (0: none), and the parities of 64 * PARITY slots of the set."""

    def run(batches):
        table, last, kept = counts.value, member(hot), member(only)
        for batch in slices(batches, 0):
            prefixes, sids, sizes, totals, odd = [], [], [], [], []
            for _, grams in shingle_sets(batch.column(0), k):
                if len(grams):
                    prefixes.append(in_order(grams, prefix_length(len(grams)), table, last))
                    sids.append(set_id(grams))
                    sizes.append(len(grams))
                    totals.append(np.bincount((grams >> np.uint64(61)).astype(np.int64), minlength=8))
                    odd.append(np.bincount((spread(grams) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY))
            if not sids:
                continue
            prefix, length = np.concatenate(prefixes), np.array([len(p) for p in prefixes])
            doc, first = np.repeat(np.arange(len(length)), length), np.cumsum(length) - length
            at = np.flatnonzero(kept.has(prefix)) if kept else np.arange(len(prefix))
            if not len(at):
                continue
            seen = np.zeros((len(prefix) + 1, 8), np.int64)
            seen[np.arange(len(prefix)) + 1, (prefix >> np.uint64(61)).astype(np.int64)] = 1
            np.cumsum(seen, axis=0, out=seen)
            mine = doc[at]
            left = np.minimum(np.array(totals)[mine] - (seen[at + 1] - seen[first[mine]]), 255).astype(np.uint64)
            tail = (left << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
            posted = prefix[at].view(np.int64)
            before = [np.zeros(len(at), np.int64) for _ in range(2)]
            for j in (1, 2):
                same = np.flatnonzero(mine[j:] == mine[:-j])
                before[j - 1][same + j] = posted[same]
            bits = np.packbits(np.array(odd) & 1, axis=1).view(np.int64)
            columns = (posted, np.array(sids, np.int64)[mine], np.array(sizes)[mine], at - first[mine], tail.view(np.int64), *before, *(np.ascontiguousarray(bits[mine, j]) for j in range(PARITY)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=NEAR)

    return run


def whole_sets(k: int, wanted):
    def run(batches):
        kept = member(wanted)
        for batch in slices(batches, 0):
            sids, grams_of = [], []
            for _, grams in shingle_sets(batch.column(0), k):
                if len(grams):
                    sid = set_id(grams)
                    if kept is None or kept.has(np.array([sid], np.int64).view(np.uint64))[0]:
                        sids.append(sid)
                        grams_of.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(grams_of, pa.binary())], names=["sid", "grams"])

    return run


def similar(batches):
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])


def parity_distance() -> Column:
    return sum((F.bit_count(F.col(f"x.odd{j}").bitwiseXOR(F.col(f"y.odd{j}"))) for j in range(PARITY)), F.lit(0))


def widened(batches):
    """(sid, signature) -> sid and the signature folded to ``WIDE`` longs."""
    for batch in batches:
        found = np.zeros((batch.num_rows, WIDE), np.uint64)
        for i, raw in enumerate(batch.column(1).to_pylist()):
            found[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, WIDE), axis=0)
        columns = [pa.array(np.ascontiguousarray(found[:, j]).view(np.int64)) for j in range(WIDE)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["sid", *(f"wide{j}" for j in range(WIDE))])


def apart() -> Column:
    """Bits in which two folded signatures differ; null where a posting carries none."""
    return F.aggregate(F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, bits: total + bits)


def wide_reach() -> Column:
    """The parity filter of ``could_reach`` on folded signatures, which tell large sets apart that 64 * PARITY slots do not;
    postings without one pass."""
    return F.coalesce(apart() <= F.col("x.n") + F.col("y.n") - 2 * F.ceil((F.col("x.n") + F.col("y.n")) * 4 / 9), F.lit(True))


def could_reach() -> Column:
    """Length, positional, suffix and parity filters on a pair of postings x and y of one gram."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * 4 / 9)
    length = (F.col("x.n") * 5 >= F.col("y.n") * 4) & (F.col("y.n") * 5 >= F.col("x.n") * 4)
    before = F.least("x.pos", "y.pos") + 1
    positional = before + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1 >= need
    tail = F.lit(0)
    for j in range(8):
        a, b = (F.shiftrightunsigned(F.col(f"{s}.tail"), 8 * j).bitwiseAND(F.lit(255)) for s in "xy")
        tail = tail + F.when((a == 255) | (b == 255), F.lit(1 << 40)).otherwise(F.least(a, b))
    return length & positional & (parity_distance() <= F.col("x.n") + F.col("y.n") - 2 * need) & (before + tail >= need)


def made_before() -> Column:
    """Whether x and y share one of the two grams that either posted before this one."""
    same = F.lit(False)
    for a in ("before1", "before2"):
        for b in ("before1", "before2"):
            same = same | ((F.col(f"x.{a}") == F.col(f"y.{b}")) & (F.col(f"x.{a}") != 0))
    return same


def pivot_pairs(here: DataFrame, turn: int) -> DataFrame:
    """For each set the pivot with which it shares most prefix grams. In the first turn a gram's pivot is the set that has
    the fewest rarer grams before it: of near copies the one with least of its own, which most others are links of. Later
    on it is the least set by a hash of the turn."""
    mark = F.struct(F.lit(0) if turn else F.col("pos"), F.xxhash64("sid", F.lit(turn)))
    pivot = here.groupBy("gram").agg(F.min(mark).alias("mark"))
    x, y = here.alias("x"), here.withColumn("mark", mark).join(pivot, ["gram", "mark"]).alias("y")
    joined = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.sid") != F.col("y.sid")) & could_reach())
    shared_by = joined.groupBy(F.col("x.sid").alias("s"), F.col("y.sid").alias("p")).count()
    best = shared_by.groupBy("s").agg(F.max_by("p", F.struct("count", "p")).alias("p"))
    return best.select(F.least("s", "p").alias("a"), F.greatest("s", "p").alias("b")).distinct()


def nearest_pairs(here: DataFrame, tested: DataFrame, turn: int) -> DataFrame:
    """For each set in grams of ``HOT`` sets or more the nearest by folded signature, not tested yet, of the pivots of its
    grams in other groups. A gram has up to 2 << turn pivots of its own, so that a set meets many different ones, while the
    rows grow with the postings only."""
    busy = here.filter("busy").withColumn("part", F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(2 << turn))).withColumn("mark", F.xxhash64("sid", "gram", F.lit(turn)))
    pivot = busy.groupBy("gram", "part").agg(F.min("mark").alias("mark"))
    x, y = busy.alias("x"), busy.join(pivot, ["gram", "part", "mark"]).alias("y")
    joined = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.comp") != F.col("y.comp")) & could_reach() & wide_reach())
    found = joined.select(F.col("x.sid").alias("s"), F.col("y.sid").alias("p"), apart().alias("far"), F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
    best = found.join(tested, ["a", "b"], "left_anti").groupBy("s").agg(F.min_by("p", F.struct("far", "p")).alias("p"))
    return best.select(F.least("s", "p").alias("a"), F.greatest("s", "p").alias("b")).distinct()


def open_postings(here: DataFrame, links: DataFrame) -> DataFrame:
    """The postings of grams whose sets are in different groups by ``links``, with ``comp``, the group."""
    here = labelled(here, components(links), "sid", "comp")
    open_grams = here.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count("*") >= HOT).alias("busy")).filter("lo <> hi").select("gram", "busy")
    return here.join(open_grams, "gram")


def open_pairs(here: DataFrame) -> DataFrame:
    """Every pair (a, b) of sets that share a prefix gram, pass the filters and are in different groups. The postings of grams
    of ``HOT`` sets or more carry folded signatures, so that of a large group of unlike sets with common grams few pairs are made."""
    x, y = here.alias("x"), here.alias("y")
    joined = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.comp") != F.col("y.comp")) & ~made_before() & could_reach() & wide_reach())
    return joined.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def alike(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures do not rule a link out, written."""

    def run(batches):
        for batch in batches:
            rest = zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)
            keep = [i for i, (x, y, n, m) in enumerate(rest) if signature_distance(x, y) <= n + m - 2 * -(-4 * (n + m) // 9)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in range(2)], names=["a", "b"])

    x = signatures.select(F.col("sid").alias("a"), F.col("signature").alias("x"), F.col("n").alias("n"))
    y = signatures.select(F.col("sid").alias("b"), F.col("signature").alias("y"), F.col("n").alias("m"))
    return materialize(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long"), "alike")


def verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs that are links, written. Only sets of documents in a pair are built."""
    paired = materialize(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct(), "paired")
    wanted = membership(paired, "sid")
    sets = texts.mapInArrow(whole_sets(k, wanted), "sid long, grams binary").dropDuplicates(["sid"])
    x, y = sets.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("sid").alias("b"), F.col("grams").alias("gb"))
    links = materialize(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ga", "gb").mapInArrow(similar, "a long, b long"), "links")
    drop_scratch(paired)
    release_shuffles(texts.sparkSession)
    return links


def labelled(df: DataFrame, comp: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the group of its set ``key``; a set without links is its own group."""
    return df.join(comp.select(F.col("v").alias(key), F.col("comp").alias("_group")), key, "left").withColumn(name, F.coalesce("_group", key)).drop("_group")


def set_groups(texts: DataFrame, counts, signatures: DataFrame, k: int) -> DataFrame:
    """text -> (v, comp): every set that has a link and the least set of its group."""
    spark = texts.sparkSession
    posted = texts.mapInArrow(postings(k, counts, None, False), "gram long")
    frequent = materialize(posted.groupBy("gram").count().filter(F.col("count") >= HOT).select("gram"), "frequent-grams")
    hot = membership(frequent, "gram")
    release_shuffles(spark)
    posted = texts.mapInArrow(postings(k, counts, hot), "gram long, sid long")
    shared = materialize(posted.groupBy("gram").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("gram"), "shared-grams")
    only = membership(shared, "gram")
    release_shuffles(spark)
    near = texts.mapInArrow(near_postings(k, counts, hot, only), ", ".join(f"{c} long" for c in NEAR))
    near = materialize(near.join(shared, "gram", "left_semi").dropDuplicates(["gram", "sid"]), "postings")
    drop_scratch(frequent, shared)
    release_shuffles(spark)

    tested = materialize(pivot_pairs(near, 0), "pairs")
    release_shuffles(spark)
    for turn in range(1, PIVOT_TURNS):
        more = materialize(pivot_pairs(near, turn).join(tested, ["a", "b"], "left_anti"), "pairs")
        release_shuffles(spark)
        tested = tested.union(more)
    links = verify(alike(tested, signatures), texts, k)
    wide = signatures.select("sid", "signature").mapInArrow(widened, "sid long, " + ", ".join(f"wide{j} long" for j in range(WIDE)))
    wide = wide.select("sid", F.lit(True).alias("busy"), F.array(*(f"wide{j}" for j in range(WIDE))).alias("wide"))
    here = materialize(open_postings(near, links).join(wide, ["sid", "busy"], "left"), "open-postings")
    drop_scratch(near)
    few = max(LEAST_MANY, signatures.count() // MANY)
    for turn in range(NEAREST_TURNS):
        more = materialize(nearest_pairs(here, tested, turn), "pairs")
        release_shuffles(spark)
        likely = alike(more, signatures)
        if likely.count() <= few:
            break
        found = verify(likely, texts, k)
        tested, links = tested.union(more), links.union(found)
        still = materialize(open_postings(here.drop("comp", "busy"), links), "open-postings")
        drop_scratch(here)
        release_shuffles(spark)
        here = still
        if found.count() <= few:
            break
    rest = materialize(open_pairs(here).join(tested, ["a", "b"], "left_anti"), "open-pairs")
    drop_scratch(here)
    release_shuffles(spark)
    rest = alike(rest, signatures)
    return components(links if rest.isEmpty() else links.union(verify(rest, texts, k)))


def grouped(docs: DataFrame, k: int) -> DataFrame:
    """docs (as ``plain`` gives them) -> ord, row, n_shingles, first (ord and row of the first document of the group; null
    without words), written."""
    texts = docs.select("text")
    surveyed = materialize(docs.select("ord", "row", "text").mapInArrow(survey(k), "ord long, row long, n_shingles long, sid long, signature binary, block long, counts binary"), "survey")
    signatures = surveyed.filter("sid is not null").groupBy("sid").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    signatures = materialize(signatures, "signatures")
    comp = set_groups(texts, gram_counts(surveyed, docs.sparkSession), signatures, k)
    marked = materialize(labelled(surveyed.filter("block is null").select("ord", "row", "n_shingles", "sid"), comp, "sid", "comp"), "marked")
    first = marked.filter("comp is not null").groupBy("comp").agg(F.min(F.struct("ord", "row")).alias("first"))
    first = materialize(first, "first")  # so that Spark can split the join where a group is large
    out = materialize(marked.join(first, "comp", "left").select("ord", "row", "n_shingles", "first"), "groups")
    drop_scratch(surveyed, signatures, marked, first)
    return out


def similar_groups(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, one row per row of ``docs``.

    Links are 100 * |A & B| >= 80 * |A | B| over sets of k-word shingles (A-Z lower-cased, words between ASCII spaces).
    Null and empty texts have no shingles, link with nothing and keep their own id. Every row is a document of its own:
    rows that repeat an id are judged by their own texts; a row without an id takes part and gets its group's least id,
    null if none has one. Extra columns are ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    groups = grouped(plain(docs), k)
    doc_id = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return groups.select(doc_id("ord").alias("doc_id"), "n_shingles", F.coalesce(doc_id("first.ord"), doc_id("ord")).alias("component_id"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the least id stays; all columns stay.

    Rows without an id come after all others; of rows that repeat an id and a text one stays; of near duplicates that
    repeat an id the one with the lesser hash of its text. Null and empty texts stay, each of them. An empty table gives
    an empty result; columns of any other name are left alone."""
    ship(spark)
    keyed, one, two = with_key(docs)
    groups = grouped(plain(docs), 5)
    gone = groups.filter("first is not null and struct(ord, row) <> first").select(F.col("ord").alias(one), F.col("row").alias(two)).distinct()
    again = materialize(groups.filter("first is not null").groupBy("ord", "row").count().filter("count > 1").select(F.col("ord").alias(one), F.col("row").alias(two)), "repeated-rows")
    kept = keyed.join(gone, [one, two], "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, [one, two], "left_anti").unionByName(kept.join(again, [one, two], "left_semi").dropDuplicates([one, two]))
    return kept.select(docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS t(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 80 * (m.n + o.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c ON c.doc_id = d.doc_id
"""
