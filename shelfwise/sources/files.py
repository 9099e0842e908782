"""File sources and sinks: catalog CSV, JSON logs, checksums, images, URL fetches, submissions, embeddings, reports.

Everything is read and written by Spark, so paths can be in any store it knows."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_FIELDS = ("timestamp", "level", "message", "module")
#: Bytes of a file in memory at a time.
BLOCK = 8 << 20
#: What the driver lists at a time where Spark's image reader has to open the files; files of a folder, where they are dealt out.
FILES_AT_ONCE, FOLDERS_AT_ONCE, FILES_A_FOLDER = 50_000, 32, 10_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder in ``spark.checkpoint.dir``, which is deleted when the driver's JVM ends; a
    temporary folder stands in where that is unset on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_shelfwise_files", None)
        if folder is None:
            folder = spark.sparkContext._shelfwise_files = "file://" + tempfile.mkdtemp(prefix="shelfwise-files-")
    mine = f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}-files"
    made = spark.sparkContext.__dict__.setdefault("_shelfwise_made", set())
    if mine not in made:
        p = spark._jvm.org.apache.hadoop.fs.Path(mine)
        store_of = p.getFileSystem(spark._jsc.hadoopConfiguration())
        store_of.mkdirs(p)
        store_of.deleteOnExit(p)
        made.add(mine)
    return f"{mine}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, for what several steps read."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.repartition(1) if one_file else df).write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", '""').csv(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines: the required fields, other fields as a map, and which are missing. Lines that are no JSON lack all."""
    raw = spark.read.text(path).filter("length(trim(value)) > 0")
    fields = F.from_json("value", "map<string,string>")
    rest = F.map_filter("f", lambda k, v: ~k.isin(*LOG_FIELDS))
    missing = F.array_compact(F.array(*(F.when(F.element_at("f", F.lit(c)).isNull(), F.lit(c)) for c in LOG_FIELDS)))
    return raw.withColumn("f", F.coalesce(fields, F.create_map().cast("map<string,string>"))).select(*(F.element_at("f", F.lit(c)).alias(c) for c in LOG_FIELDS), rest.alias("extra"), missing.alias("missing"))


def store(uri: str):
    """The file system behind a URI (local, HDFS, object stores) and the path in it, for reading and writing in tasks."""
    from pyarrow import fs

    kind, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"file://{rest}" if kind == "file" and not rest.startswith("//") else uri)


def digest_of(uri: str, block: int = BLOCK) -> str:
    """md5 of a file of any size, read a block at a time."""
    return digest(*store(uri), block)


def digest(files, path: str, block: int = BLOCK) -> str:
    import hashlib

    md5 = hashlib.md5()
    with files.open_input_stream(path) as stream:
        while data := stream.read(block):
            md5.update(data)
    return md5.hexdigest()


def rooted(folder: str):
    """The store of a folder, the path in it, and what goes before paths of that store in a URI."""
    folder = folder.rstrip("/")
    files, path = store(folder)
    path = path.rstrip("/")
    if not folder.endswith(path):
        raise ValueError(f"{folder} has escaped characters")
    return files, path, folder[: len(folder) - len(path)] or "file:"


def visible(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of every file under ``path`` that is not empty (as Spark's readers pass over empty ones); contents are
    not read. Tasks list the folders, so no list of files comes to the driver; a folder's own list is in one task's memory."""

    def inside(files, folder, before, deep):
        from pyarrow import fs

        found = [i for i in files.get_file_info(fs.FileSelector(folder)) if visible(i.base_name)]
        plain = [i for i in found if i.type == fs.FileType.File and i.size]
        folders = [i.path for i in found if i.type == fs.FileType.Directory]
        rows = [(before + i.path, i.size, False) for i in plain] + [(before + f, None, True) for f in folders if not deep]
        for lo in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 10_000], strict=True), (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["path", "length", "folder"])
        for f in folders if deep else ():
            yield from inside(files, f, before, deep)

    def top(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                files, root, before = rooted(path)
                yield from inside(files, root, before, False)

    def below(batches):
        files, _, before = rooted(path)
        for batch in batches:
            yield batch.filter(pa.compute.invert(batch.column(2)))
            for folder in batch.filter(batch.column(2)).column(0).to_pylist():
                yield from inside(files, folder[len(before) :], before, True)

    kinds = "path string, length long, folder boolean"
    first = spark.range(1, numPartitions=1).mapInArrow(top, kinds)
    return first.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(below, kinds).select("path", "length")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 and length of every file of ``listing``. Each file is streamed by one task, a block in memory at a time."""

    def run(batches):
        files, _, before = rooted(path)
        for batch in batches:
            found = [digest(files, p[len(before) :]) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(1)], names=["path", "md5", "length"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listing(spark, path).repartition(width, "path").mapInArrow(run, "path string, md5 string, length long")


def save_file(uri: str, body: bytes) -> None:
    """Write under another name, then rename: a task that is tried again, or twice at once, leaves whole files only."""
    put(*store(uri), body)


def put(files, path: str, body: bytes) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as stream:
        stream.write(body)
    files.move(part, path)


def folders_for(files: int) -> int:
    """Into how many folders so many files are dealt."""
    return files // FILES_A_FOLDER + 1


def write_files(df: DataFrame, folder: str, folders: int = 0) -> DataFrame:
    """(file, content) -> a file each in ``folder``, or dealt by name to so many folders in it, written by the tasks that hold
    the rows; returns file and length of what was written, as a table. Rows without a name or content write nothing."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)

    def run(batches):
        import zlib

        files, root = store(folder)
        made = set()
        for batch in batches:
            names, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, body in zip(names, bodies, strict=True):
                at = f"{root}/{zlib.crc32(name.encode()) % folders:x}" if folders else root
                if folders and at not in made:
                    files.create_dir(at)
                    made.add(at)
                put(files, f"{at}/{name}", body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64())], names=["file", "length"])

    rows = df.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content")).filter("file is not null and content is not null")
    return stored(rows.mapInArrow(run, "file string, length long"), "files-written")


def copy_files(listed: DataFrame, path: str, to: str, folders: int) -> DataFrame:
    """The files of ``listed`` (path: under ``path``), copied by tasks and dealt to so many folders in ``to``; returns folder
    and path, as a table. A copy is named by the md5 of the path (32 characters) and the file's name."""

    def run(batches):
        import hashlib

        files, _, before = rooted(path)
        there, root, mark = rooted(to)
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                key = hashlib.md5(p.encode()).hexdigest()
                at = f"{root}/{int(key, 16) % folders:x}"
                there.create_dir(at)
                with files.open_input_stream(p[len(before) :]) as body, there.open_output_stream(f"{at}/{key}{p.rpartition('/')[2]}") as copy:
                    while data := body.read(BLOCK):
                        copy.write(data)
                out.append(mark + at)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(0)], names=["folder", "path"])

    return stored(listed.select("path").mapInArrow(run, "folder string, path string"), "files-copied")


def storage(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files and bytes per component, without reading contents."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select(F.lit(k).alias("component"), "length") for k, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("component").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"  # that of Spark's image reader
MODES = {1: 0, 3: 16}  # OpenCV's types of 8-bit grey and BGR


def plain_pictures(listed: DataFrame, path: str, pixels: bool) -> DataFrame:
    """listed (path, file: of files under ``path``) -> path, file, kind (``picture.decode_png``'s: ok, corrupt, other) and, where
    ``pixels`` are asked for, the image struct. A file at a time is in memory."""
    from shelfwise.functions import picture

    inside = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])

    def run(batches):
        files, _, before = rooted(path)

        def made(paths, names, kinds, images):
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array(images, inside)], names=["path", "file", "kind", "image"])

        for batch in batches:
            paths, names, kinds, images, held = [], [], [], [], 0
            for p, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(p[len(before) :]) as body:
                    kind, x = picture.decode_png(body.read())
                image = None
                if pixels and x is not None:
                    h, w, c = x.shape
                    image = {"origin": p, "height": h, "width": w, "nChannels": c, "mode": MODES[c], "data": x[:, :, ::-1].tobytes()}
                    held += x.size
                paths.append(p), names.append(name), kinds.append(kind), images.append(image)
                if held > BLOCK:
                    yield made(paths, names, kinds, images)
                    paths, names, kinds, images, held = [], [], [], [], 0
            yield made(paths, names, kinds, images)

    return listed.select("path", "file").mapInArrow(run, f"path string, file string, kind string, image {IMAGE}")


def scan_images(spark: SparkSession, path: str, ids: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """ids (sample_id, file) -> sample_id, status (ok, corrupt, missing) and the image struct (bytes are BGR), or, in its place,
    what ``read`` makes of the table (file, image): a row for each file, with its name as ``file``.

    A file that is listed but cannot be decoded, in whole or in its middle, is corrupt and does not end the job; an empty
    one counts as missing. Plain PNG files are read by the tasks. Spark's reader takes all others; as it lists on the
    driver what it reads, and compiles code for each file, those are copied to folders of their own and go to it in turns
    of about ``FILES_AT_ONCE`` files."""
    name = F.element_at(F.split("path", "/"), -1)
    listed = listing(spark, path).select("path", name.alias("file")).repartition(4 * spark.sparkContext.defaultParallelism, "path")
    there = stored(plain_pictures(listed, path, False).drop("image"), "listed")
    each = read or (lambda images: images)
    at = scratch(spark, "images")
    first = each(plain_pictures(there.filter("kind = 'ok'").repartition(4 * spark.sparkContext.defaultParallelism, "path"), path, True).select("file", "image"))
    first.write.option("compression", "zstd").parquet(at)
    others = there.filter("kind = 'other'")
    turns, held = [], 0
    for r in copy_files(others, path, scratch(spark, "other"), folders_for(others.count())).groupBy("folder").agg(F.count("*").alias("n")).orderBy("folder").toLocalIterator():  # a row per folder
        if not turns or held + r.n > FILES_AT_ONCE or len(turns[-1]) == FOLDERS_AT_ONCE:
            turns.append([])
            held = 0
        turns[-1].append(r.folder)
        held += r.n
    for some in turns:
        images = spark.read.format("image").option("dropInvalid", True).option("ignoreCorruptFiles", True).load(some)
        named = images.select(F.substring(F.element_at(F.split("image.origin", "/"), -1), 33, 1 << 20).alias("file"), "image")
        each(named.coalesce(4 * spark.sparkContext.defaultParallelism)).write.option("compression", "zstd").mode("append").parquet(at)
    found = spark.read.schema(first.schema).parquet(at)
    status = F.when(F.col("there").isNull(), "missing").when(F.col("decoded").isNull(), "corrupt").otherwise("ok")
    joined = ids.join(there.select("file", F.lit(True).alias("there")), "file", "left").join(found.withColumn("decoded", F.lit(True)), "file", "left")
    return joined.select("sample_id", status.alias("status"), *(c for c in found.columns if c != "file"))


def open_url(url: str) -> tuple[str, bytes]:
    """Content type and bytes behind a URL, over HTTP or from a store."""
    import mimetypes

    if url.partition(":")[0] in ("http", "https", "ftp", "data"):
        from urllib.request import urlopen

        with urlopen(url, timeout=30) as answer:
            return answer.headers.get_content_type(), answer.read()
    files, path = store(url)
    with files.open_input_stream(path) as stream:
        return mimetypes.guess_type(path)[0] or "application/octet-stream", stream.read()


def in_turn(rows: list[tuple], fetch, kinds: tuple, tries: int, threads: int, gap: float, first_wait: float, most_wait: float, clock, sleep):
    """(key, url, host) -> (key, url, body or None, attempts, error), as they end. ``threads`` fetch at a time, no host more
    often than every ``gap`` seconds; a row that failed comes back after its wait, and others go on meanwhile."""
    from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
    from heapq import heappop, heappush

    def one(url):
        kind, data = fetch(url)
        return data if kind.startswith(kinds) else None, f"type_{kind}"

    later, free, flying = [(0.0, i, 1) for i in range(len(rows))], {}, {}
    with ThreadPoolExecutor(threads) as pool:
        while later or flying:
            while later and len(flying) < threads and later[0][0] <= clock():
                _, i, attempt = heappop(later)
                at = max(clock(), free.get(rows[i][2], 0.0))
                if at > clock():
                    heappush(later, (at, i, attempt))
                    continue
                free[rows[i][2]] = at + gap
                flying[pool.submit(one, rows[i][1])] = i, attempt
            if not flying:
                sleep(max(0.0, later[0][0] - clock()))
                continue
            ended, _ = wait(flying, timeout=max(0.0, later[0][0] - clock()) if later and len(flying) < threads else None, return_when=FIRST_COMPLETED)
            for f in ended:
                i, attempt = flying.pop(f)
                problem = f.exception()  # a failed fetch is a row of the manifest
                if problem is not None and attempt < tries:
                    heappush(later, (clock() + min(most_wait, first_wait * 2 ** (attempt - 1)), i, attempt + 1))
                elif problem is not None:
                    yield (*rows[i][:2], None, attempt, type(problem).__name__)
                else:
                    body, kind = f.result()
                    yield (*rows[i][:2], body, attempt, None if body is not None else kind)


FETCHED = "url_hash string, url string, status string, md5 string, size long, attempts long, error string"


def fetch_urls(urls: DataFrame, fetch: Callable[[str], tuple[str, bytes]] = open_url, kinds: tuple[str, ...] = ("image/",), tries: int = 3, done: DataFrame | None = None, folder: str | None = None, parallel: int | None = None, per_host: int = 4, threads: int = 8, gap: float = 0.0, first_wait: float = 1.0, most_wait: float = 60.0, clock: Callable = time.monotonic, sleep: Callable = time.sleep) -> DataFrame:
    """Fetch each different url once: url_hash, url, status, md5, size, attempts, error. With ``folder``, bodies are saved
    there under their url_hash.

    ``fetch(url)`` returns (content type, bytes) or raises; it runs on executors and is tried again after ``first_wait``
    seconds, then twice as many, up to ``most_wait``. The urls of a host are dealt to ``per_host`` groups, so one host, even
    with most urls, is asked by no more of the ``parallel`` tasks, each with ``threads`` requests at a time and ``gap`` seconds between two.
    Rows of the manifest ``done`` with status ok are left out where the saved file still has their checksum (without
    ``folder``, by status alone). Null urls are left out."""
    spark = urls.sparkSession
    todo = urls.select("url", F.md5("url").alias("url_hash")).filter("url is not null").dropDuplicates(["url_hash"])
    if done is not None:
        good = done.filter("status = 'ok'").select("url_hash", "md5")
        if folder is not None:
            good = good.join(checksums(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("url_hash"), "md5"), ["url_hash", "md5"], "left_semi")
        todo = todo.join(good.select("url_hash"), "url_hash", "left_anti")
    if folder is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)

    def run(batches):
        import hashlib

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("url_hash", "url", "host")), strict=True))
            out = []
            for key, url, body, attempt, error in in_turn(rows, fetch, kinds, tries, threads, gap, first_wait, most_wait, clock, sleep):
                if body is not None and folder is not None:
                    save_file(f"{folder}/{key}", body)
                out.append((key, url, "ok" if body is not None else "failed", hashlib.md5(body).hexdigest() if body is not None else None, len(body) if body is not None else None, attempt, error))
            kinds_of = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds_of)], names=["url_hash", "url", "status", "md5", "size", "attempts", "error"])

    host = F.coalesce(F.nullif(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("-"))
    dealt = todo.withColumn("host", host).repartition(parallel or int(spark.conf.get("spark.sql.shuffle.partitions")), "host", F.pmod(F.xxhash64("url_hash"), F.lit(per_host)))
    return dealt.mapInArrow(run, FETCHED)


def write_submission(df: DataFrame, path: str) -> None:
    """Two columns, six decimals, one file: a submission is one number per product."""
    write_csv(df.select("sample_id", F.format_string("%.6f", F.rint(F.col("price") * 1e6) / 1e6).alias("price")), path, one_file=True)


def read_back_submission(df: DataFrame, path: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: rows written and read, ids on one side only, prices that differ by more than ``tolerance``."""
    spark = df.sparkSession
    read = spark.read.schema("sample_id string, price double").option("header", True).csv(path)
    a = df.groupBy("sample_id").agg(F.count("*").alias("na"), F.sum("price").alias("pa"))
    b = read.groupBy("sample_id").agg(F.count("*").alias("nb"), F.sum("price").alias("pb"))
    return a.join(b, "sample_id", "full_outer").agg(
        F.sum("na").alias("rows_written"), F.sum("nb").alias("rows_read"), F.count_if(F.col("na").isNull() | F.col("nb").isNull()).alias("one_side"), F.count_if(F.abs(F.col("pa") - F.col("pb")) > tolerance * F.col("na")).alias("different")
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and a checksum of ids and vectors that does not depend on their order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("vec_id", "embedding")), F.lit(0)).alias("checksum"))


def write_embeddings(df: DataFrame, path: str, version: str, metadata: dict[str, str] | None = None) -> None:
    """Write a version of (vec_id, embedding) and its manifest: rows, checksum and metadata."""
    df.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/vectors")
    about = F.create_map(*(F.lit(x) for pair in (metadata or {}).items() for x in pair)).cast("map<string,string>")
    fingerprint(df).select(F.lit(version).alias("version"), "rows", "checksum", F.current_timestamp().alias("written"), about.alias("metadata")).write.mode("append").json(f"{path}/manifest")


MANIFEST = "version string, rows long, checksum long, written timestamp, metadata map<string,string>, deleted boolean"


def embedding_versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows of the versions that are there."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    return rows.join(rows.filter("deleted").select("version"), "version", "left_anti").drop("deleted")


def delete_embeddings(spark: SparkSession, path: str, version: str) -> None:
    """Mark a version as deleted, then delete its files."""
    spark.range(1).select(F.lit(version).alias("version"), F.lit(True).alias("deleted")).write.mode("append").json(f"{path}/manifest")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors/version={version}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_embeddings(spark: SparkSession, path: str, version: str, dims: int) -> DataFrame:
    """One version; other versions' files are not opened. Rows and checksum must be those of the manifest; a vector of
    another length is an error when it is read."""
    known = embedding_versions(spark, path).filter(F.col("version") == version).collect()
    if not known:
        raise ValueError(f"no version {version}")
    v = spark.read.parquet(f"{path}/vectors").filter(F.col("version") == version)
    found = fingerprint(v).first()
    if (found.rows, found.checksum) != (known[0].rows, known[0].checksum):
        raise ValueError(f"version {version} is not what was written")
    return v.withColumn("embedding", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding has another length"))))


def save_model(model: PipelineModel, folder: str, name: str, metadata: dict[str, str]) -> str:
    """Save a fitted pipeline under a new path in ``folder``, and a line of metadata beside it."""
    spark = SparkSession.active()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    about = F.create_map(*(F.lit(x) for pair in metadata.items() for x in pair)).cast("map<string,string>")
    spark.range(1).select(F.lit(name).alias("name"), F.lit(path).alias("path"), F.current_timestamp().alias("saved"), about.alias("metadata")).write.mode("append").json(f"{folder}/about")
    return path


def load_model(spark: SparkSession, folder: str, name: str | None = None) -> tuple[PipelineModel, dict]:
    """The most recent model of ``folder`` (of that name) and its metadata."""
    rows = spark.read.schema("name string, path string, saved timestamp, metadata map<string,string>").json(f"{folder}/about")
    last = rows.filter(F.lit(True) if name is None else F.col("name") == name).orderBy(F.desc("saved")).limit(1).collect()
    if not last:
        raise ValueError(f"no model {name or ''} in {folder}")
    return PipelineModel.load(last[0].path), last[0].asDict()
