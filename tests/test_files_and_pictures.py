"""Files of any size, fetches by host, pictures and their features."""

import hashlib
import threading
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import picture
from shelfwise.operators import features
from shelfwise.sources import files


def test_files_are_written_and_digested(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    rows = [(f"f{i}", bytes([i]) * (i * 1000)) for i in range(20)] + [(None, b"x"), ("empty", b""), ("nothing", None)]
    written = files.write_files(spark.createDataFrame(rows, "file string, content binary").repartition(3), folder)
    want = {n: b for n, b in rows if n and b is not None}
    assert {r.file: r.length for r in written.collect()} == {n: len(b) for n, b in want.items()}
    got = {r.path.split("/")[-1]: (r.md5, r.length) for r in files.checksums(spark, folder).collect()}
    assert got == {n: (hashlib.md5(b).hexdigest(), len(b)) for n, b in want.items() if b}  # empty files are not listed


def test_a_large_file_is_read_in_blocks(tmp_path):
    import resource

    path = tmp_path / "large"
    with path.open("wb") as f:  # 2.1 GB of zeros, as a sparse file
        f.truncate(2_100_000_000)
        f.seek(1_000_000_000)
        f.write(b"middle")
    md5 = hashlib.md5()
    with path.open("rb") as f:
        while data := f.read(1 << 24):
            md5.update(data)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert files.digest_of(f"file://{path}") == md5.hexdigest()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


# fetches


def ends(rows, fetch, **more):
    """Results of ``in_turn`` on a clock that only waits move, and those waits."""
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    how = {"kinds": ("image/",), "tries": 3, "threads": 2, "gap": 0.0, "first_wait": 1.0, "most_wait": 60.0} | more
    return list(files.in_turn(rows, fetch, clock=lambda: now[0], sleep=sleep, **how)), waits


def boom(url):
    raise OSError(url)


def test_waits_double_up_to_a_minute():
    got, waits = ends([("k", "u", "h")], boom, tries=9)
    assert got == [("k", "u", None, 9, "OSError")] and waits == [1, 2, 4, 8, 16, 32, 60, 60]


def test_others_go_on_while_one_waits():
    seen = []

    def fetch(url):
        seen.append(url)
        if url == "bad":
            raise OSError(url)
        return ("image/png", b"x") if url != "page" else ("text/html", b"x")

    got, _ = ends([("0", "bad", "h"), *((str(i), f"u{i}", "h") for i in range(1, 6)), ("9", "page", "h")], fetch, threads=1)
    assert seen == ["bad", "u1", "u2", "u3", "u4", "u5", "page", "bad", "bad"]
    assert {g[0]: g[3:] for g in got} == {"0": (3, "OSError"), "9": (1, "type_text/html")} | {str(i): (1, None) for i in range(1, 6)}


def test_hosts_are_asked_in_turn():
    at = defaultdict(list)
    now = [0.0]

    def sleep(s):
        now[0] += s

    def fetch(url):
        at[url[0]].append(now[0])
        return "image/png", b"x"

    rows = [(str(i), f"{h}{i}", h) for i in range(5) for h in "ab"]
    assert len(list(files.in_turn(rows, fetch, ("image/",), 3, 1, 2.0, 1.0, 60.0, lambda: now[0], sleep))) == 10
    assert at["a"] == [0, 2, 4, 6, 8] and at["b"] == [0, 2, 4, 6, 8]


def test_no_more_requests_at_a_time_than_threads():
    running, most, lock = [0], [0], threading.Lock()

    def fetch(url):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return "image/png", b"x"

    rows = [(str(i), str(i), "h") for i in range(30)]
    assert len(list(files.in_turn(rows, fetch, ("image/",), 3, 4, 0.0, 1.0, 60.0, time.monotonic, time.sleep))) == 30
    assert 1 < most[0] <= 4


def test_resume_trusts_checksums_only(spark, tmp_path):
    folder, log = f"file://{tmp_path}/kept", f"{tmp_path}/log"
    urls = spark.createDataFrame([(f"http://h{i % 3}/{i}.png",) for i in range(12)] + [("http://h0/0.png",), (None,), ("http://h1/lost",), ("no host",)], "url string")

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        if "lost" in url:
            raise OSError(url)
        return "image/png", url.encode()

    asked = lambda: Counter(open(log).read().split("\n")[:-1])
    first = files.stored(files.fetch_urls(urls, fetch, folder=folder, first_wait=0.01), "first")
    rows = {r.url: r for r in first.collect()}
    assert len(rows) == 14 and asked() == {u: 3 if "lost" in u else 1 for u in rows}
    assert all(r.md5 == hashlib.md5(u.encode()).hexdigest() and r.status == "ok" for u, r in rows.items() if "lost" not in u)
    (tmp_path / "kept" / rows["http://h1/4.png"].url_hash).write_bytes(b"spoilt")
    (tmp_path / "kept" / rows["http://h2/5.png"].url_hash).unlink()
    second = {r.url for r in files.fetch_urls(urls, fetch, folder=folder, done=first, first_wait=0.01).collect()}
    assert second == {"http://h1/4.png", "http://h2/5.png", "http://h1/lost"}
    assert (tmp_path / "kept" / rows["http://h1/4.png"].url_hash).read_bytes() == b"http://h1/4.png"
    assert {r.url for r in files.fetch_urls(urls, fetch, done=first, first_wait=0.01).collect()} == {"http://h1/lost"}  # by status alone


def test_a_host_goes_to_few_tasks(spark):
    urls = spark.range(4000).select(F.concat(F.lit("http://one/"), F.col("id")).alias("url"))
    parts = files.fetch_urls(urls, lambda u: ("image/x", b""), per_host=2).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) <= 2 and sum(r["count"] for r in parts) == 4000


# pictures


def test_status_of_pictures(spark, tmp_path):
    rgb = np.zeros((5, 7, 3), np.uint8)
    body = picture.encode_png(rgb)
    rows = [("ok.png", body), ("cut.png", body[: len(body) // 2]), ("text.png", b"no picture"), ("void.png", b"")]
    files.write_files(spark.createDataFrame(rows, "file string, content binary"), f"file://{tmp_path}/p")
    ids = spark.createDataFrame([("1", "ok.png"), ("2", "cut.png"), ("3", "text.png"), ("4", "void.png"), ("5", "gone.png"), ("6", None), ("7", "ok.png")], "sample_id string, file string")
    got = {r.sample_id: (r.status, r.image and (r.image.height, r.image.width)) for r in files.scan_images(spark, f"file://{tmp_path}/p", ids).collect()}
    assert got == {"1": ("ok", (5, 7)), "2": ("corrupt", None), "3": ("corrupt", None), "4": ("missing", None), "5": ("missing", None), "6": ("missing", None), "7": ("ok", (5, 7))}


def test_dominant_colors():
    rgb = np.zeros((20, 20, 3), np.uint8)
    rgb[:12], rgb[12:18], rgb[18:] = (250, 10, 10), (10, 200, 30), (20, 20, 240)
    got = picture.dominant_colors(rgb)
    assert (got * 255).round().astype(int).tolist() == [[250, 10, 10], [10, 200, 30], [20, 20, 240], [0, 0, 0], [0, 0, 0]]
    rng = np.random.default_rng(1)
    centres = np.array([[30, 30, 200], [220, 40, 40], [40, 220, 60], [200, 200, 40], [240, 240, 240]])
    of = rng.choice(5, 900, p=[0.4, 0.25, 0.2, 0.1, 0.05])
    x = np.clip(centres[of] + rng.normal(0, 6, (900, 3)), 0, 255).astype(np.uint8).reshape(30, 30, 3)
    got = picture.dominant_colors(x) * 255
    want = np.array([x.reshape(-1, 3)[of == k].mean(axis=0) for k in np.argsort(-np.bincount(of))])
    assert np.abs(got - want).max() < 1  # the clusters that were planted, most pixels first
    pixels, c = x.reshape(-1, 3).astype(float), got
    nearest = ((pixels[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose([pixels[nearest == k].mean(axis=0) for k in range(5)], c)  # Lloyd's condition
    dark = np.zeros((20, 20, 3), np.uint8)
    dark[:10] = (90, 90, 90)
    assert (picture.dominant_colors(dark) * 255)[:2].round().tolist() == [[90, 90, 90], [0, 0, 0]]  # black is background
    assert picture.dominant_colors(np.full((1, 1, 3), 51, np.uint8)).tolist() == [[0.2] * 3] + [[0.0] * 3] * 4


def test_edges_and_texture_by_hand():
    level = np.random.default_rng(2).integers(0, 256, (9, 6))
    wide = np.pad(level / 255, 1, mode="edge")
    kernel = np.array([[1, 2, 1], [0, 0, 0], [-1, -2, -1]]) / 4
    strength = [[np.hypot((wide[i : i + 3, j : j + 3] * kernel).sum(), (wide[i : i + 3, j : j + 3] * kernel.T).sum()) for j in range(6)] for i in range(9)]
    assert picture.edges(level) == pytest.approx([np.mean(strength), np.std(strength), np.mean(np.array(strength) > picture.STRONG_EDGE)])
    m = np.zeros((256, 256))
    for row in level:
        for a, b in zip(row, row[1:]):
            m[a, b] += 1
            m[b, a] += 1
    p, (i, j) = m / m.sum(), np.indices((256, 256))
    mean = (p * i).sum()
    spread = (p * (i - mean) ** 2).sum()
    want = [(p * (i - j) ** 2).sum(), (p * abs(i - j)).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p**2).sum()), (p * (i - mean) * (j - mean)).sum() / spread]
    assert picture.texture(level) == pytest.approx(want)
    flat = np.full((4, 4), 7)
    assert picture.edges(flat) == [0, 0, 0] and picture.texture(flat) == [0, 0, 1, 1, 1] and picture.texture(flat[:, :1]) == [0, 0, 1, 1, 1]


def test_features_of_scanned_pictures(spark, tmp_path):
    rng = np.random.default_rng(4)
    made = {f"{k}.png": rng.integers(0, 256, (6 + k, 5, 3)).astype(np.uint8) for k in range(4)}
    files.write_files(spark.createDataFrame([(n, picture.encode_png(x)) for n, x in made.items()], "file string, content binary"), f"file://{tmp_path}/p")
    ids = spark.createDataFrame([(n, n) for n in made], "sample_id string, file string")
    ok = files.scan_images(spark, f"file://{tmp_path}/p", ids).select("sample_id", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    for r in features.image_features(ok).collect():
        x = made[r.sample_id]
        assert r.histogram == pytest.approx(picture.histogram(x).tolist()) and r.colors == pytest.approx(picture.dominant_colors(x).ravel().tolist())
        assert r.texture == pytest.approx(picture.texture(picture.grey(x))) and r.edges == pytest.approx(picture.edges(picture.grey(x)))
    assert features.image_features(ok.limit(0)).count() == 0


def test_pictures_of_every_kind_in_turns(spark, tmp_path, monkeypatch):
    """Plain PNG files go around Spark's reader, which lists on the driver; what it reads comes in turns, names may repeat."""
    import struct
    import zlib

    rgb = np.random.default_rng(5).integers(0, 256, (6, 4, 3)).astype(np.uint8)

    def png(rows, kind=2, w=4, h=6):
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    left = np.concatenate([rgb[:, :1], np.diff(rgb.astype(int), axis=1) % 256], axis=1).astype(np.uint8)
    above = np.concatenate([rgb[:1], np.diff(rgb.astype(int), axis=0) % 256]).astype(np.uint8)
    filtered = lambda f, x: b"".join(bytes([f]) + r.tobytes() for r in x)
    grey = b"".join(b"\0" + r.tobytes() for r in rgb[:, :, 0])
    alpha = b"".join(b"\0" + np.concatenate([r, np.full((4, 1), 255, np.uint8)], axis=1).tobytes() for r in rgb)
    paeth = filtered(4, np.concatenate([left[:1], np.zeros_like(rgb[1:])]))
    kinds = {"left": png(filtered(1, left)), "above": png(filtered(2, above)), "grey": png(grey, 0), "alpha": png(alpha, 6), "paeth": png(paeth), "short": png(filtered(0, rgb)[:-9]), "cut": png(filtered(0, rgb))[:70]}
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        for k, body in kinds.items():
            (tmp_path / f"d{i}" / f"{k}{i}.png").write_bytes(body)
    monkeypatch.setattr(files, "FILES_AT_ONCE", 4)
    monkeypatch.setattr(files, "FILES_A_FOLDER", 2)
    ids = spark.createDataFrame([(f"{k}{i}", f"{k}{i}.png") for k in kinds for i in range(3)], "sample_id string, file string")
    got = {r.sample_id: r for r in files.scan_images(spark, f"file://{tmp_path}", ids).collect()}
    straight = spark.read.format("image").option("dropInvalid", True).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).load(f"file://{tmp_path}")
    want = {r.image.origin.split("/")[-1][:-4]: r.image for r in straight.collect()}
    assert {k for k, r in got.items() if r.status == "ok"} == set(want) and len(got) == 21
    for k, x in want.items():
        assert got[k].image[1:] == x[1:], k
    assert bytes(got["left0"].image.data) == rgb[:, :, ::-1].tobytes() and bytes(got["above2"].image.data) == rgb[:, :, ::-1].tobytes()


def test_tasks_list_the_folders(spark, tmp_path):
    """The driver sees no file, so its memory does not grow with them; hidden and empty files are passed over."""
    rows = [(f"f{i}", b"x" * (i % 5)) for i in range(200)] + [("_hidden", b"x"), (".hidden", b"x")]
    files.write_files(spark.createDataFrame(rows, "file string, content binary"), f"file://{tmp_path}/a", 7)
    assert len([p for p in (tmp_path / "a").iterdir()]) == 7
    plan = files.listing(spark, f"file://{tmp_path}/a")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan.lower() and "InMemoryFileIndex" not in plan
    got = {r.path.split("/")[-1]: r.length for r in files.listing(spark, f"file://{tmp_path}/a").collect()}
    assert got == {n: len(b) for n, b in rows if b and "hidden" not in n}
