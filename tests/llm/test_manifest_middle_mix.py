"""Merkle manifest, fill-in-middle and source mix against plain versions written out row by row."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import curriculum, merkle, middle, ranks
from shelfwise.llm.registry import QUERIES
from shelfwise.llm.session import materialize
from shelfwise.llm.text import pieces

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, grp string, place long, fim string, row long, extra double"


def odd_rows(corpus):
    """The shared corpus with nulls in every column, repeated rows and ids, one hot language and source."""
    rng = random.Random(3)
    rows = []
    for i, t in corpus:
        lang = rng.choice([None, "de", "é", "en", "en", "en", "en"])
        source = rng.choice([None, "", "src1", "src2", "é", "hot", "hot", "hot"])
        rows.append((i, t, lang, source, rng.choice([None, len(t or "")])))
    rows += [rows[12]] * 3 + [(rows[12][0], "another text under the same id", "en", "hot", 9), (None, "no id <P> here", "en", "hot", 3), (None, "no id", None, None, None), (10**15, "alone", "zz", "lonely", 2**62)]
    rows += [(5000 + i, f"t <{m}> x", "en", "src1", 1) for i, m in enumerate("PSMQ")]
    return [(*r, "g", 7, "f", 8, 0.5) for r in rows]


@pytest.fixture(scope="module")
def odd(corpus):
    return odd_rows(corpus)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('odd')}"
    spark.createDataFrame(odd, DOCUMENTS).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('empty')}"
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    return path


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(5), rng.randrange(4)) for _ in range(400)] + [("c", 1, 0)]
    df = materialize(spark.createDataFrame(rows, "g string, o long, size long").repartition(7), "rows")
    got = ranks.running(df, ["g"], [F.col("o")], amount="size", beside=spark.createDataFrame([(g, g * 2) for g in "abc"], "g string, twice string")).collect()
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.g, r.before, r.o, r.size)):
        assert r.before == at[r.g] and r.twice == r.g * 2
        at[r.g] += r["size"]
    assert all(r.total == at[r.g] for r in got) and Counter((r.g, r.o, r["size"]) for r in got) == Counter(rows)
    for g in "abc":  # the order holds up to ties
        mine = [r for r in got if r.g == g]
        assert all(a.o <= b.o for a in mine for b in mine if a.before < b.before)
    places = ranks.running(df, ["g"], [F.col("o")], name="place").collect()
    assert sorted((r.g, r.place) for r in places) == sorted((g, i) for g, n in Counter(r[0] for r in rows).items() for i in range(n))


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, arity):
    """Root, and for each leaf its steps (digests before, digests after)."""
    nodes, steps, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            lo = p // arity * arity
            steps[i].append((nodes[lo:p], nodes[p + 1 : lo + arity]))
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], steps


def plain_manifest(rows, arity=2):
    """rows (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded)."""
    runs = defaultdict(list)
    for r in rows:
        runs[r[2]].append((r[0] is None, r[0] or 0, leaf_of(r), r))
    order = sorted(runs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(runs[lang], key=lambda x: x[:3])], arity) for lang in order}
    root, upper = tree([trees[x][0] for x in order], arity)
    out = []
    for k, lang in enumerate(order):
        for x, steps in zip(sorted(runs[lang], key=lambda x: x[:3]), trees[lang][1], strict=True):
            doc_id, source, _, n_chars, text = x[3]
            hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            acc = leaf_of((doc_id, source, lang, n_chars + 1, text)) if hit else x[2]
            for before, after in steps + upper[k]:
                acc = h(*before, acc, *after)
            proof = h(*(d for before, after in steps + upper[k] for d in before + after))
            out.append((str(doc_id), x[2], trees[lang][0], root, proof, acc))
    return sorted(out)


def test_manifest(spark, odd, folder, empty_folder):
    got = QUERIES["op11_merkle_manifest"](spark, folder).collect()
    want = plain_manifest([(i, s, lang, n, t) for i, t, lang, s, n, *_ in odd])
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}
    assert QUERIES["op11_merkle_manifest"](spark, empty_folder).count() == 0


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_of_any_arity(spark, arity):
    rng = random.Random(arity)
    rows = [(i, None, rng.choice(["a", "b", "b", "b", None]), 1, f"t{i}") for i in range(61)] + [(99, None, "one", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    values = [F.col(c) for c in merkle.FIELDS]
    m = merkle.manifest(df, values, F.col("lang"), F.col("doc_id"), {"id": F.col("doc_id")}, arity)
    got = m.select("id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256), merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    want = plain_manifest(rows, arity)
    assert sorted((str(r[0]), *r[1:5]) for r in got) == [w[:5] for w in want] and all(r[5] == r[3] for r in got)


def test_manifest_of_one_row(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    r = merkle.manifest(df, [F.col("doc_id"), F.col("text")], F.lit(None).cast("string"), F.col("doc_id")).first()
    assert r.leaf == r.subroot == r.root == h("1:1", "1:x") and r.proof == []
    with pytest.raises(ValueError, match="place"):
        merkle.manifest(df, [F.col("text")], F.lit("a"), F.col("doc_id"), {"Place": F.col("text")})


# fill-in-middle

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    mark = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(mark[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    assert p + m + s == text
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle(spark, odd, folder, empty_folder):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, folder).collect()]
    want = [(i, *made[:4], sha(made[4]), sha(t or "")) for i, t, *_ in odd for made in [plain_middle(i, t)]]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert QUERIES["op12_fill_in_middle"](spark, empty_folder).count() == 0


def test_middle_on_marks_and_odd_characters(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["<", "P", "S", "M", ">", "a", "Bc", " ", "\n", "é", "日", "\U0001f600", "0", "\x00", "@", "[", "`", "{"]) for _ in range(rng.randrange(30))) for _ in range(1500)] + ["ab" * 400_000 + " x" * 200_000, "<" * 99, "日" * 99]
    df = spark.createDataFrame([(i, t, "f", (1, "x")) for i, t in enumerate(texts)], "doc_id long, text string, fim string, `odd name, of` struct<`a:b`: long, output: string>").repartition(4)
    out, name = middle.fill_in_middle(df)
    assert name == "_fim" and out.columns == [*df.columns, "_fim"]
    rows = out.select("doc_id", F.col(name).alias("m"), middle.restored(F.col(name)["output"], F.col(name)["form"]).alias("back")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r.m) == plain_middle(r.doc_id, texts[r.doc_id]) and r.back == texts[r.doc_id]


def test_rank_index_is_exact_and_bounded():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = ["x" * int(n) + " ." * int(m) for n, m in rng.integers(0, 3000, (40, 2))] + ["", "a", "ab " * 5000 + "z" * 9000 + " " * 700]
    for piece in pieces(pa.array(texts), 1 << 16):
        offsets, places = middle.boundaries(piece)
        for i, row in enumerate(piece.rows):
            ends = np.concatenate([[0], np.cumsum([len(t.encode()) for t in TOKEN.findall(texts[row])])])
            assert (offsets[places[i] : places[i + 1]] - piece.bounds[i] == ends).all()
        for most in (0, 5, 127):
            index = middle.RankIndex.fit(offsets, places, most)
            assert (index.at(np.arange(len(offsets))) == offsets).all() and np.abs(index.residual.astype(int)).max() <= most
        assert len(middle.RankIndex.fit(offsets, places).first) < len(offsets) / 10


# source mix


def plain_targets(sizes):
    """source -> target, by resharing the excess until nothing is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not above:
            out |= share
            break
        out |= {s: 2.0 * sizes[s] for s in above}
        left, open_ = left - sum(2 * sizes[s] for s in above), open_ - above
    return out


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def test_mix(spark, odd, folder, empty_folder):
    got = QUERIES["op13_source_mix"](spark, folder).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, words(t)) for i, t, *_ in odd)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in odd:
        sizes[s] += words(t)
    targets = plain_targets(sizes)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    by_target = defaultdict(list)
    for r in got:
        by_target[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    assert sorted(k[0] for k in by_target) == sorted(sizes.values()) and sorted(k[1] for k in by_target) == pytest.approx(sorted(targets.values()))
    for (_, target), rows in by_target.items():
        assert sum(r.taken for r in rows) == int(target + 0.5)
    again = QUERIES["op13_source_mix"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert QUERIES["op13_source_mix"](spark, empty_folder).count() == 0


def test_training_order_follows_the_schedules(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abcd"), "w " * rng.randrange(1, 40)) for i in range(3000)]
    mix = curriculum.training_order(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6))
    source = {i: s for i, s, _ in rows}
    taken = [r for r in mix.collect() if r.words]
    at = [r.position for r in taken]
    assert at == sorted(at) and 0 <= min(at) and max(at) <= 1  # the written order is the training order
    for k, s in enumerate("abcd"):
        mine = [r for r in taken if source[r.doc_id] == s]
        total, done, knots = sum(r.words for r in mine), 0, curriculum.SCHEDULES[k % 3]
        for r in mine:
            x, area = r.position, 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                e = min(max(x - t0, 0), t1 - t0)
                area += w0 * e + (w1 - w0) / (t1 - t0) * e * e / 2
            # what the source has given so far is what its integrated schedule asks for by now
            assert done == pytest.approx(total * area / curriculum.integral(knots), abs=1e-6 * total + 1)
            done += r.words
        first = {r["pass"]: min(x.position for x in mine if x["pass"] == r["pass"]) for r in mine}
        assert list(first.values()) == sorted(first.values())
    assert [curriculum.integral(k) for k in curriculum.SCHEDULES] == [3, 1, 2]


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, ""), (2, None, " \n")], "doc_id long, source string, text string")
    got = curriculum.training_order(df).collect()
    assert [(r.words, r.target, r.position) for r in got] == [(0, 0.0, None)] * 3
