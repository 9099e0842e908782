"""Dedup operators against brute force, and their defined results on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import automaton, jaccard, repeats, suffix_array
from shelfwise.llm.automaton import SuffixAutomaton

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def groups(corpus):
    sets = {}
    for i, t in corpus:
        w = tokens((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [(i, len(sets[i]), root(i)) for i in ids]


def without_bytes(corpus, window=200):
    places = Counter()
    for _, t in corpus:
        b = (t or "").encode()
        places.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for doc_id, t in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if places[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def without_words(corpus, window=20):
    first = {}
    for doc_id, t in sorted(corpus):
        w = tokens(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc_id, i))
    out = []
    for doc_id, t in corpus:
        w = tokens(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (doc_id, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_jaccard_groups(docs, corpus):
    assert rows(jaccard.similar_groups(docs)) == groups(corpus)


def test_jaccard_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(900)}" for _ in range(120)]
    made = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    assert rows(jaccard.similar_groups(spark.createDataFrame(made, "doc_id long, text string"))) == groups(made)


def test_signatures_bound_differences():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, 300)), dtype=np.uint64)]))
        if len(b):
            far = jaccard.signature_distance(jaccard.signature(a), jaccard.signature(b))
            assert far <= len(np.setxor1d(a, b)) and jaccard.signature_distance(jaccard.signature(a), jaccard.signature(a)) == 0


@pytest.mark.parametrize("limit", [4000, 1])
def test_suffix_array_dedup(docs, corpus, monkeypatch, limit):
    monkeypatch.setattr(repeats, "GROUP", limit)
    assert rows(suffix_array.remove_repeated_bytes(docs)) == sorted(without_bytes(corpus))


@pytest.mark.parametrize("limit", [4000, 1])
def test_automaton_dedup(docs, corpus, monkeypatch, limit):
    monkeypatch.setattr(repeats, "GROUP", limit)
    assert rows(automaton.remove_later_windows(docs)) == sorted(without_words(corpus))


def test_empty_tables(no_docs):
    assert jaccard.similar_groups(no_docs).count() == 0
    assert suffix_array.remove_repeated_bytes(no_docs).count() == 0
    assert automaton.remove_later_windows(no_docs).count() == 0


def known(found):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found)


def test_null_and_repeated_ids(spark, corpus):
    text, other, third = corpus[45][1], corpus[25][1] + " " + corpus[26][1] + " " + corpus[27][1] * 5, corpus[30][1] * 6
    made = [(1, text), (2, text), (1, "short text of its own"), (1, other), (None, text), (None, None), (2, third), (None, "a b"), (3, None)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert known(suffix_array.remove_repeated_bytes(df).collect()) == known(without_bytes(made))
    got = known(automaton.remove_later_windows(df).collect())
    numbered = [(i if i is not None else 99, t or "") for i, t in made]
    assert got == known([(None if r[0] == 99 else r[0], *r[1:]) for r in without_words(numbered)])
    assert all(r.n_removed <= r.n_bytes for r in suffix_array.remove_repeated_bytes(df).collect())
    found = jaccard.similar_groups(df).collect()
    assert sorted(r.component_id for r in found if r.n_shingles > 50 and r.component_id == 1) == [1] * 4 and len(found) == len(made)
    assert [r.component_id for r in found if r.doc_id == 3] == [3] and {r.component_id for r in found if r.n_shingles == 0} == {None, 3}


def test_repeated_rows(spark, corpus):
    text = corpus[45][1]
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (None, text)], "doc_id long, text string")
    assert all(r.n_removed == r.n_bytes for r in suffix_array.remove_repeated_bytes(df).collect())
    assert sorted(r.n_removed > 0 for r in automaton.remove_later_windows(df).collect()) == [False, False, True, True]
    assert {r.component_id for r in jaccard.similar_groups(df).collect()} == {5}
    kept = jaccard.keep_one_of_each(spark, df, "")
    assert [tuple(r) for r in kept.collect()] == [(5, text)]


def test_one_of_each_group_stays(spark, corpus):
    text, other = corpus[45][1], corpus[25][1] * 3
    made = [(1, text, 1), (2, text, 2), (2, other, 3), (1, text, 4), (None, None, 5), (None, "", 6), (4, None, 7), (4, None, 8), (None, other, 9)]
    df = spark.createDataFrame(made, "doc_id long, text string, _ord long").withColumnRenamed("_ord", "_row").withColumn("sid", F.col("_row")).withColumn("comp", F.lit("x"))
    got = jaccard.keep_one_of_each(spark, df, "")
    assert got.columns == df.columns
    rows = sorted((r["_row"] for r in got.collect()))
    assert rows in ([1, 3, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8])


def test_induced_sorting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        n, sigma = int(rng.integers(1, 60)), int(rng.integers(2, 6))
        s = rng.integers(0, sigma, n).astype(np.int16)
        sa = suffix_array.suffix_array(s, sigma)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())  # noqa: B023
        phi, plcp = suffix_array.permuted_prefixes(s, sa)
        for k in range(1, n):
            a, b = sa[k], sa[k - 1]
            same = 0
            while a + same < n and b + same < n and s[a + same] == s[b + same]:
                same += 1
            assert (phi[a], plcp[a]) == (b, same)


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        seen, auto = defaultdict(bool), SuffixAutomaton()
        for _ in range(4):
            s = [rng.randrange(3) for _ in range(rng.randrange(14))]
            want = [max([0, *(n for n in range(1, e + 2) if seen[tuple(s[e - n + 1 : e + 1])])]) for e in range(len(s))]
            assert auto.matches(s) == want
            auto.add(s)
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    seen[tuple(s[i:j])] = True


def test_unlike_sets_with_common_grams_make_few_pairs(spark, monkeypatch):
    """Texts of one passage and a seventh of their own words share prefix grams, but none is a link (0.73)."""
    rng = np.random.default_rng(9)
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 50))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(3)]
    made, real = [], jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda pairs, signatures: (made.append(pairs.count()), real(pairs, signatures))[1])
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 if i >= 100 else i for i, _ in rows}
    assert made[-1] < 40  # of 780


@pytest.mark.parametrize("whole", [True, False])
def test_near_copies_of_one_text_make_few_pairs(spark, monkeypatch, whole):
    """Copies with up to three words of their own: most are links of the text itself, few of any other copy."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    made = [(0, " ".join(base))] if whole else []
    for i in range(1, 301):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 4)):
            w[at] = f"c{rng.randrange(10**6)}"
        made.append((i, " ".join(w)))
    pairs, real = [], jaccard.alike
    monkeypatch.setattr(jaccard, "alike", lambda found, signatures: (pairs.append(found.count()), real(found, signatures))[1])
    if not whole:
        monkeypatch.setattr(jaccard, "LEAST_MANY", 0)
    assert rows(jaccard.similar_groups(spark.createDataFrame(made, "doc_id long, text string"))) == groups(made)
    assert pairs[-1] < 300
