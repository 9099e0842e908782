"""The other operators against brute force, round trips or held-out rows, and their defined results on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import huffman, langid, licenses, pieces, pivots, templates, winnowing

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def alnum(text):
    return WORD.findall((text or "").translate(LOWER))


# license scan


def test_license_places(spark):
    texts = [None, "", "GNU general public-license, GNU General Public License", "mit licence", "MIT license mit License", "KMIT License", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "cc by, CC BY-NC 4.0", "cc by licensed under cc by nc 4 0"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, words string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        w = alnum(t)
        starts, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            here = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            starts += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(starts), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None)) and 0 <= r.score <= 1
    assert "mit-notice" in got[6].labels and "apache-2.0" in got[7].labels and "cc-by-nc-4.0" in got[9].labels and got[7].score == 1.0
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_templates(spark):
    """Every template is found at its place, in whole, cut at the start and with changed words, in small and long texts."""
    known = [t for t in licenses.templates() if not t["base"]]
    filler = "some words of another text " * 300
    made = []
    for n, t in enumerate(known):
        w = list(t["words"])
        made.append((n, "An intro. " + " ".join(w).upper() + ", and more."))
        made.append((n + 100, filler + " ".join(w) + " " + filler))
        first = min(o for o, _ in t["keys"])
        made.append((n + 200, " ".join(w[min(first, 1) :])))
        made.append((n + 300, " ".join(w).replace(t["keys"][0][1][0], "x")))  # a key phrase is broken
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for n, t in enumerate(known):
        assert t["label"] in got[n].labels.split(",") and got[n].score == 1.0 and t["label"] in got[n + 100].labels.split(",")
        assert got[n + 200].score >= licenses.COVERAGE and t["label"] not in got[n + 300].labels.split(",")


# winnowing


def contaminated(corpus, items, window=10):
    wins = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc_id, text in corpus:
        w = alnum(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_contamination(spark, docs, corpus, block):
    w = [alnum(t) for _, t in corpus if t and len(t.split()) > 30]
    items = [("a", " ".join(w[0][3:25])), ("b", " ".join(w[1][:12]).upper()), ("c", "one"), ("d", " ".join(w[0][5:15])), ("e", ""), ("f", None), ("g", "w1 w2 w3"), ("10", " ".join(w[2][2:9]))]
    bench = spark.createDataFrame([*((*i, 1) for i in items), ("a", items[0][1], 2)], "item_id string, text string, key long")
    got = sorted(tuple(r) for r in winnowing.contamination(docs, bench, block).collect())
    assert got == contaminated(corpus, [i for i in items if i[1]])
    if block > 7:
        assert winnowing.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
        assert winnowing.contamination(docs.limit(0), bench).count() == 0


def test_contamination_of_a_very_long_text(spark):
    passage = " ".join(f"b{i}" for i in range(12))
    text = "the and of this is a word " * 150_000 + passage + " " + "tail " * 10
    df = spark.createDataFrame([(1, text), (2, text[: 7 * 26])], "doc_id long, text string")
    got = {r.doc_id: r for r in winnowing.contamination(df, spark.createDataFrame([("x", passage)], "item_id string, text string")).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (1_050_022, 12, 1) and not got[2].contaminated


# token files


def test_code_lengths_and_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = (rng.pareto(1, int(rng.integers(2, 300))) * 10).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, huffman.LONGEST)
        assert abs((2.0 ** -lengths).sum() - 1) < 1e-12
        ids = [rng.integers(0, len(counts), int(rng.integers(1, 5000))).astype(np.uint32) for _ in range(4)]
        codes = huffman.canonical_codes(lengths)
        packed = [huffman.pack(x, codes, lengths) for x in ids]
        back = huffman.unpack([p for p, _ in packed], [m for _, m in packed], [len(x) for x in ids], huffman.decode_table(lengths))
        assert all((a == b).all() for a, b in zip(ids, back, strict=True))
    assert huffman.code_lengths(np.array([2**i for i in range(30)]), 16).max() == 16
    with pytest.raises(ValueError, match="do not fit"):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_token_file(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    texts = [*corpus, (900, "a  b\n\n c \t d"), (901, " lead"), (902, "trail "), (903, "x\ny\n"), (904, "it's so 　 odd"), (905, "q\x01r"), (906, "\n")]
    texts.append((907, "long " * 30000))
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, part long").repartition(3)
    path = huffman.tokenizer_path()
    file = f"file://{tmp_path}/ids"
    huffman.write_ids(df, path, file)
    got = huffman.read_ids(spark.newSession(), file).orderBy("part", "seq").collect()
    tok = Tokenizer.from_file(path)
    want = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, huffman.END_ID], np.uint32).tobytes()) for i, t in sorted(texts)]
    assert [(r.doc_id, bytes(r.ids)) for r in got] == want
    df.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert huffman.op3_token_ids(spark, f"file://{tmp_path}").count() == 0


def test_token_offsets(spark):
    got = huffman.op3_token_ids(spark, SF).orderBy("doc_id").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


# pieces


def best_score(text, scores, unknown):
    best = [0.0] + [-1e300] * len(text)
    for e in range(1, len(text) + 1):
        best[e] = max([best[e - 1] + unknown if text[e - 1] not in scores else -1e300, *(best[s] + scores[text[s:e]] for s in range(max(0, e - 16), e) if text[s:e] in scores)])
    return best[-1]


def test_viterbi_is_best():
    rng = random.Random(4)
    table = [("<unk>", 0.0, "other"), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256)), *((p, -float(rng.randrange(1, 30)), "piece") for p in ["a", "b", "ab", "ba", "aab", "bbb", "abab", "▁", "▁a", "▁ab", "c", "bc"])]
    model = pieces.PieceModel(table)
    scores = {p: s for p, s, kind in table if kind == "piece"}
    for _ in range(500):
        text = "".join(rng.choice("ab▁cdé") for _ in range(rng.randrange(14)))
        ids = model.segment(text)
        total, run = 0.0, 0
        for i in ids:
            total += scores[table[i][0]] if table[i][2] == "piece" else 0.0
        unknown = sum(1 for ch in text if ch in "dé")
        assert total + unknown * model.unknown == pytest.approx(best_score(text, scores, model.unknown)) and run == 0


def test_pieces_are_those_of_the_library(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(8)
    texts = [t or "" for _, t in corpus] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [f"a{' ' * n}b{' ' * n}" for n in range(40)] + ["the quick brown fox jumps over the lazy dog", "日本\n\n \tdéjà ▁ vu \U0001f600", "aaaaaaa" * 9]
    texts += ["".join(rng.choice("abeinrst  ▁ﬀ\n") for _ in range(rng.randrange(60))) for _ in range(2000)]
    model = pieces.PieceModel.load(pieces.model_path())
    assert [t for t in texts if np.frombuffer(model.encode(t), np.uint32).tolist() != sp.encode(t)] == []


def test_merges_against_step_by_step():
    rng = random.Random(9)
    for _ in range(60):
        made = {c: -1000.0 - i for i, c in enumerate("abc")}
        for _ in range(rng.randrange(1, 14)):
            made.setdefault(rng.choice(list(made)) + rng.choice(list(made)), -float(rng.randrange(1, 30)))
        table = [(p, s, "piece") for p, s in made.items()] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
        model = pieces.PieceModel(table, bpe=True)
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 20)))
            assert [table[i][0] for i in model.segment(text)] == model.merges.run(text)[0]


def test_pieces_round_trip(spark, corpus):
    texts = [*corpus, (900, "two  spaces\n\n and\ttabs"), (901, " lead"), (902, "trail "), (903, "日本 \U0001f600")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in texts], "doc_id long, text string, ids binary")
    got = pieces.encode_stage(spark, df, "").collect()
    assert all(r.round_trip for r in got) and len(got) == len(texts)
    model = pieces.PieceModel.load(pieces.model_path())
    for i, t in texts[-4:]:
        whole = np.array(model.segment("▁" + t.replace(" ", "▁")), np.uint32).tobytes()
        assert model.encode(t) == whole and [r.ids_crc32 for r in got if r.doc_id == i] == [zlib.crc32(whole)]
    assert pieces.encode_stage(spark, df.limit(0), "").count() == 0


# nearest neighbours


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 32))
    x = centre[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 32))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long")
    got = {}
    for r in pivots.nearest(df, F.col("vec_id") % 60 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -1e9
        true = set(np.argsort(-s, kind="stable")[:20].tolist())
        found.sort()
        hit += len(true & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(sc - s[v]) < 1e-9 for _, v, sc in found) and [-f[2] for f in found] == sorted(-f[2] for f in found)
    assert len(got) == 50 and hit / 1000 >= 0.9


def test_neighbours_among_equal_vectors(spark):
    rng = np.random.default_rng(6)
    n = 9000
    x = rng.normal(size=(6, 32))[rng.integers(0, 6, n)] + rng.normal(size=(n, 32))
    hot = np.sort(rng.permutation(n)[: n // 3])
    x[hot] = x[hot[0]]
    order = rng.permutation(n)
    df = spark.createDataFrame([(int(i), x[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    asked = [*hot[[0, 1, 7, 30, 900, -1]].tolist(), *np.setdiff1d(np.arange(n), hot)[::150].tolist()]
    got = {}
    for r in pivots.nearest(df, F.col("vec_id").isin(asked)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    members, hit, others = set(hot.tolist()), 0, 0
    for q in asked:
        s = np.round(x @ x[q], 9)
        s[q] = -1e9
        true = np.argsort(-s, kind="stable")[:20].tolist()
        found = [v for _, v in sorted(got[q])]
        if q in members:
            assert len(members & set(found)) == len(members & set(true)) and [v for v in found if v in members] == [v for v in true if v in members]
        else:
            hit, others = hit + len(set(true) & set(found)), others + 1
    assert len(got) == len(asked) and hit / (20 * others) >= 0.9


def test_neighbours_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0]), (1, [0.5, 0.0]), (8, [2.0]), (9, [3.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in pivots.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert [tuple(r) for r in pivots.nearest(df, F.col("vec_id").isin(7, 9)).select("query_id", "rank", "vec_id", "score").collect()] == [(7, 1, 8, 2.0)]
    assert pivots.nearest(df.limit(0), F.lit(True)).count() == 0


# language ID


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table = langid.fit(d.filter("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    test = d.filter("doc_id % 2 = 1 and n_chars > 100").select(F.col("doc_id").alias("key"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), none.alias("host"))
    got = langid.fuse(test, names, table).join(d.select(F.col("doc_id").alias("key"), F.col("lang").alias("truth")), "key")
    assert got.agg(F.avg((F.col("lang") == F.col("truth")).cast("double")).alias("a")).first().a > 0.97


def test_language_fusion_matches_counts(spark):
    names = ["de", "en"]
    table = np.zeros((langid.SLOTS, 2), np.float32)
    for word, j in (("und der die das", 0), ("the and of this", 1)):
        table[langid.trigrams(np.frombuffer(word.encode(), np.uint8)), j] = 2.0
    rows = [(1, "und der die das", "de", "h.a"), (2, "the and of this", "en", "h.a"), (3, "und der die", "de", "h.a"), (4, None, "de", "h.a"), (5, "", None, None), (6, "123 456", None, "h.b")]
    df = spark.createDataFrame(rows, "key long, text string, declared string, host string").withColumn("suffix", F.lit(None).cast("string")).withColumn("domain", F.lit(None).cast("string"))
    got = {r.key: r for r in langid.fuse(df, names, table).collect()}
    assert got[1].lang == "de" and got[2].lang == "en" and got[4].text_lang is None and not got[4].has_text and not got[6].has_text
    # by hand for row 4: votes de 2, en 1; totals with one pseudo-count 3 and 2; host prior from 2 and 1 of 3 votes
    world = np.array([3, 2]) / 5
    prior = (np.array([2, 1]) + langid.SMOOTH * world) / (3 + langid.SMOOTH)
    declared = (np.array([2, 0]) + world) / np.array([3, 2])
    want = prior * declared
    assert got[4].confidence == pytest.approx(want[0] / want.sum()) and got[4].lang == "de"
    assert got[5].confidence == pytest.approx(world[0])
    assert langid.fuse(df.limit(0), names, table).count() == 0


def test_language_fusion_over_a_table(spark):
    """Bayes' rule written out row by row, over pages of many hosts, with gaps in every kind of evidence."""
    rng = random.Random(11)
    names, say = ["de", "en", "fr"], {"de": "und der die das ist", "en": "the and of this is", "fr": "le la les et est"}
    table = np.zeros((langid.SLOTS, 3), np.float32)
    for j, name in enumerate(names):
        table[langid.trigrams(np.frombuffer(say[name].encode(), np.uint8)), j] = 1.5
    rows = []
    for i in range(120):
        name = rng.choice(names)
        text = rng.choice([None, "", "12 34", *[" ".join(rng.choice(say[name].split()) for _ in range(rng.randrange(1, 9)))] * 6])
        domain = rng.choice([None, "a.x", "b.y", "c.z"])
        host = rng.choice([None, f"h{rng.randrange(3)}.{domain}"]) if domain else None
        rows.append((i, text, rng.choice([None, name, "xx"]), rng.choice([None, "x", "y"]), domain, host))
    df = spark.createDataFrame(rows, "key long, text string, declared string, suffix string, domain string, host string").repartition(3)
    got = {r.key: r for r in langid.fuse(df, names, table).collect()}
    scores, votes = {}, {}
    for i, text, *_ in rows:
        d = np.frombuffer((text or "").encode(), np.uint8)
        slots = langid.trigrams(d)
        scores[i] = table[slots].sum(axis=0) / len(slots) * langid.TEXT_WEIGHT * min(len(slots), langid.TEXT_BYTES) if len(slots) else np.zeros(3)
        if len(d) and langid.letters(d).any():
            votes[i] = int(np.argmax(np.exp(scores[i] - scores[i].max()) / np.exp(scores[i] - scores[i].max()).sum()))
    total = np.array([sum(v == j for v in votes.values()) for j in range(3)]) + 1.0
    world = total / total.sum()
    count = lambda at, value, but=None: np.array([sum(votes.get(r[0]) == j and r[at] == value and r[0] != but for r in rows) for j in range(3)], float)
    for r in rows:
        i, _, declared, suffix, domain, host = r
        log = scores[i].copy() if i in votes else np.zeros(3)
        for at, value in ((2, declared), (3, suffix)):
            if value is not None and count(at, value).any():
                log += np.log((count(at, value) + world) / total)
        d = count(4, domain, i) if domain else np.zeros(3)
        prior = (d + langid.SMOOTH * world) / (d.sum() + langid.SMOOTH)
        h = count(5, host, i) if host else np.zeros(3)
        prior = (h + langid.SMOOTH * prior) / (h.sum() + langid.SMOOTH)
        p = np.exp(log + np.log(prior))
        assert got[i].confidence == pytest.approx(p.max() / p.sum(), rel=1e-4), i
        assert got[i].lang == names[int(np.argmax(p))]


def test_language_sample_is_bounded(spark):
    """Thousands of rows of one id, of one text, or without an id train like any others, at most TRAIN_ROWS a label."""
    say = {"de": "und der die das ist nicht ein wort", "en": "the and of this is not one word", "fr": "le la les et est pas un mot"}
    rng = random.Random(14)
    made = lambda name: " ".join(rng.choice(say[name].split()) for _ in range(12))
    rows = [(7, made("de"), "de") for _ in range(3000)] + [(None, made("en"), "en") for _ in range(900)] + [(i, say["fr"], "fr") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6).withColumn("source", F.lit("s")).withColumn("mark", F.lit("x"))
    sizes = Counter(r.lang for r in langid.sample(df).collect())
    assert sizes == {"de": langid.TRAIN_ROWS, "en": langid.TRAIN_ROWS, "fr": 1}
    kept = langid.keep_identified(spark, df, "")
    assert kept.columns == df.columns and kept.count() == len(rows)
    other = [(9000 + i, t, None) for i, t in enumerate(["Все люди рождаются свободными и равными", "人人生而自由,在尊严和权利上一律平等。", "qzxv jkwq zzxq vvkj qqxz", "123 456", None, ""])]
    odd = spark.createDataFrame(other, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("mark", F.lit("x"))
    # all ids null: the stage still decides, by the texts
    both = df.filter("lang <> 'fr'").union(odd).withColumn("doc_id", F.lit(None).cast("long"))
    assert Counter(r.lang for r in langid.keep_identified(spark, both, "").collect()) == {"de": 3000, "en": 900}
    assert langid.keep_identified(spark, df.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_a_label_never_seen(spark):
    names, table = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang <> 'de'"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 200")
    none = F.lit(None).cast("string")
    pages = docs.select(F.col("doc_id").alias("key"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), none.alias("host"))
    got = langid.fuse(pages, names, table).join(docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("truth")), "key")
    share = {r.truth: r.s for r in got.groupBy("truth").agg(F.avg((F.col("lang") == langid.UNKNOWN).cast("double")).alias("s")).collect()}
    assert share["de"] > 0.8 and max(share[k] for k in share if k != "de") < 0.02, share


def test_page_evidence(spark):
    rows = [(1, "https://u@M.x.example.com:80/a?b", '<html lang="FR"><script>var t="</p>";</script><p>Un <b>mot</b><!-- no --></p>'), (2, None, None), (3, "no url", "<p>x")]
    got = {r.key: r for r in langid.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].declared, got[1].suffix, got[1].domain, got[1].host) == ("fr", "com", "example.com", "m.x.example.com")
    assert got[1].text.split() == ["Un", "mot"] and got[2].host is None and got[3].host is None


# line dedup


def test_line_templates(spark):
    rng = random.Random(2)
    menu = "Home products and contact page"
    texts = [f"{menu}\norder number {i} was sent on day {i * 7}\n" + " ".join(f"u{rng.randrange(9**9)}x" for _ in range(8)).replace("1", "q") for i in range(30)] + [None, "", "a b\na b", "only once in this corpus"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, menu, "x")], "doc_id long, text string, line string").repartition(3)
    out, before, dropped = templates.without_lines(df)
    assert (before, dropped) == ("lines_before", "lines_dropped")
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text.startswith(menu + "\norder number") and got[0].lines_dropped == 0
    assert all(got[i].lines_dropped == 2 and menu not in got[i].text and "order number" not in got[i].text for i in range(1, 30))
    assert got[30].text is None and got[31].text == "" and got[32].text == "a b\na b" and got[33].lines_dropped == 0 and got[None].text == ""
    assert "line" in out.columns and templates.without_lines(df.limit(0))[0].count() == 0


def test_lines_of_one_id(spark):
    menu = "Home products and contact page"
    made = [(i % 5, f"{menu}\nown line number {'abcdefghijklmnopqrstuvwxyz'[i]} of {'zyxwvutsrqponmlkjihgfedcba'[i]}") for i in range(20)] + [(7, "a b c d e " * 3), (7, None), (None, menu), (7, "first line of its own here\nsecond one of its own here")]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    for name in ("numbers", "lines_before", "lines_dropped", "gone_id", "_ord", "_row", "_numbers", "line", "template"):
        df = df.withColumn(name, F.lit(name))
    got = templates.drop_template_lines(spark, df, "")
    assert got.columns == df.columns
    texts = Counter(r.text for r in got.collect())
    assert sum(menu in (t or "") for t in texts.elements()) == 1  # one copy of the menu
    assert texts[made[20][1]] == 1 and texts[None] == 1 and texts[made[-1][1]] == 1 and texts[""] == 20


def test_lines_of_one_long_list(spark):
    # a template that only one document holds does not recur
    text = "\n".join(f"item with the same long start {x}" for x in "abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame([(1, text), (2, "another text of one line")], "doc_id long, text string")
    assert all(r.lines_dropped == 0 for r in templates.without_lines(df)[0].collect())


# pipeline


def test_very_long_texts(spark):
    """A text of a million words is whole to the licence scan, language ID, line dedup, token file and pieces."""
    words = "und der die das the and of this " * 125_000
    lines = "\n".join(f"line {chr(97 + i % 26)} of a long document here" for i in range(60_000))
    df = spark.createDataFrame([(1, words + "MIT License"), (2, lines), (3, "mit license")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word) == (1_000_002, 1, 1_000_000) and got[3].first_word == 0
    table = np.zeros((langid.SLOTS, 2), np.float32)
    table[langid.trigrams(np.frombuffer(b"the and of this", np.uint8)), 1] = 1.0
    none = F.lit(None).cast("string")
    pages = df.select(F.col("doc_id").alias("key"), "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), none.alias("host"))
    assert {r.key: r.lang for r in langid.fuse(pages, ["de", "en"], table).collect()}[1] == "en"
    out = {r.doc_id: r for r in templates.without_lines(df)[0].collect()}
    assert out[2].lines_before == 60_000 and out[2].lines_dropped == 0  # one document alone does not recur
    assert all(r.round_trip for r in pieces.encode_stage(spark, df, "").collect())


def test_ties(spark):
    # equal evidence for two languages: the first in order; equal support of two templates: both recur
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([(1, "abc def")], "key long, text string")
    pages = df.select("key", "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), none.alias("host"))
    assert langid.fuse(pages, ["de", "en"], np.zeros((langid.SLOTS, 2), np.float32)).first().lang == "de"
    fitted = langid.fit(spark.createDataFrame([("gleich same igual", x) for x in ("en", "de", "es")], "text string, lang string"))
    assert fitted[0] == ["de", "en", "es", langid.UNKNOWN]
    assert langid.fuse(pages.withColumn("text", F.lit("gleich same igual")), *fitted).first().lang == "de"  # equal models
    lines = "one common line of words\nother common line of words"
    got = templates.without_lines(spark.createDataFrame([(i, lines) for i in range(10)], "doc_id long, text string"))[0].collect()
    assert sorted(r.lines_dropped for r in got) == [0] + [2] * 9


def test_empty_tables_and_repeated_rows_everywhere(spark, tmp_path):
    import corpus_pipeline
    from shelfwise.llm.registry import QUERIES

    for name in ("documents", "pages", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in ("op1_license_scan", "op2_language_id", "op3_token_ids", "op7_sentencepiece", "op8_nearest_neighbours", "op9_line_dedup", "op10_benchmark_decontamination"):
        assert QUERIES[name](spark, f"file://{tmp_path}").count() == 0, name
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    row = (7, "released under the MIT license", "x")
    df = spark.createDataFrame([row, row, (None, row[1], "x"), (None, None, None)], "doc_id long, text string, words string")
    for found in (licenses.scan(df), pieces.encode_stage(spark, df, ""), winnowing.contamination(df, spark.read.parquet(f"{SF}/benchmark.parquet"))):
        assert sorted((r.doc_id is None for r in found.collect())) == [False, False, True, True]
        assert len({tuple(r) for r in found.filter("doc_id = 7").collect()}) == 1


def brute_lines(texts):
    """Texts without their recurring lines, by the definition: leaves, constant tokens, templates, first place."""
    parsed = []
    for d, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            if line.strip(templates.BLANK):
                masked = re.sub("[^ ]*[0-9][^ ]*", "<*>", line)
                token = masked.split(" ")
                tree = len(token) >= templates.LEAST_TOKENS and sum(t != "<*>" for t in token) >= len(token) * templates.LEAST_CONSTANT
                parsed.append((d, number, masked if tree else line, (len(token), *token[: templates.DEPTH]) if tree else None))
    held = {(leaf, base, d) for d, _, base, leaf in parsed if leaf}
    at = Counter((leaf, j, t) for leaf, base, _ in held for j, t in enumerate(base.split(" ")))
    found = {}
    for d, number, base, leaf in parsed:
        key = (base,) if leaf is None else (leaf, base)
        if leaf:
            shape = tuple(t if t != "<*>" and at[leaf, j, t] >= templates.SUPPORT else "<*>" for j, t in enumerate(base.split(" ")))
            if sum(t != "<*>" for t in shape) >= len(shape) * templates.LEAST_CONSTANT:
                key = (leaf, shape)
        found.setdefault(key, []).append((d, number))
    gone = {p for places in found.values() if len({d for d, _ in places}) > 1 for p in places if p != min(places)}
    return [t if t is None or not any((d, n) in gone for n in range(t.count("\n") + 1)) else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in enumerate(texts)]


def test_lines_against_brute_force(spark):
    rng = random.Random(21)
    pool = ["Of.", "And ornd.", "日本語の行です", "page 3", "12 45 67 89", "see you in 5 days", "a b c d", "a <*> c d", " ", "\t", "", "12.", "Home products and contact page"]
    pool += [f"this line has number {i} in it" for i in range(4)] + [f"the start of a {rng.choice('xyz')}{i} line" for i in range(14)]
    texts = [None, ""] + ["\n".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in templates.without_lines(df)[0].collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
    lines = Counter(x for t in got.values() for x in set((t or "").split("\n")) if x.strip(templates.BLANK))
    assert max(lines.values()) == 1  # of a line in several documents one copy is left, however short it is


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages after language ID on its own result, each written out plainly."""
    import sentencepiece

    import corpus_pipeline
    from test_dedup import groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted((r.doc_id, r.text) for r in langid.keep_identified(spark, docs, SF).collect())
    texts = brute_lines([t for _, t in kept])
    one = {i: c for i, _, c in groups([(i, t) for (i, _), t in zip(kept, texts, strict=True)])}
    rows = [(i, t) for (i, _), t in zip(kept, texts, strict=True) if one[i] == i]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated(rows, items) if r[-1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((i, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes())) for i, t in rows if i not in hit for ids in [sp.encode(t or "")])
    got = sorted((r.doc_id, r.n_pieces, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and 0 < len(got) < len(kept)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    kept = langid.keep_identified(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * n
    lines = templates.drop_template_lines(spark, docs, SF)
    assert lines.columns == docs.columns and lines.count() == n and lines.schema == docs.schema
    clean = winnowing.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < n
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    odd = docs.limit(3).unionByName(docs.limit(3)).withColumn("doc_id", F.lit(None).cast("long")).withColumn("_row", F.lit("x"))
    for stage in (langid.keep_identified, templates.drop_template_lines, winnowing.drop_contaminated):
        assert stage(spark, odd, SF).columns == odd.columns and stage(spark, odd, SF).count() <= 6
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert Counter(corpus_pipeline.run(spark, SF).columns) == Counter(["doc_id", "n_pieces", "ids_crc32", "text_sha256", "round_trip"])


def test_a_worker_drops_what_other_operators_keep():
    import pyarrow as pa

    from shelfwise.llm import session, text

    model = pieces.PieceModel.load(pieces.model_path())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two"])], names=["doc_id", "text"])
    assert len(list(text.slices([batch], 1, operator="pieces"))) == 1
    assert pieces.PieceModel.load(pieces.model_path()) is model
    assert len(list(text.slices([batch], 1))) == 1
    assert not session.kept_by("pieces")


def test_words_before_punctuation_are_one_unit():
    import pyarrow as pa

    encoder = huffman.UnitEncoder(huffman.tokenizer_path())
    regular = ["the hat, the hat. the,\nthe hat.\nhat", "Élan, élan.\n", None, "the"]
    odd = ["a ,b", "x.y", "3. 3,", ",", "...", "it's, it's.", "wait... what", "the. the", "q\x02, r", "的, 的."]
    ids, n = encoder.encode(pa.array(regular + odd), huffman.END_ID)
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, huffman.END_ID] for t in regular + odd]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    encoder = huffman.UnitEncoder(huffman.tokenizer_path())
    encoder.encode(pa.array(regular[:1]), huffman.END_ID)
    assert [u for u in encoder.young.at if u.endswith(("hat", "hat.", "hat,"))] == ["hat", "\x01hat"]
