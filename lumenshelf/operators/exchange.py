"""Sources, exports and federation: what comes in, goes out, and meets from several libraries."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenshelf.functions import digests
from lumenshelf.functions.storage import settled
from lumenshelf.functions.workers import map_arrow

# Formats by media type, directories whose documents are noise, names of licence files.
FORMATS = {
    "audio": "wav flac mp3 ogg opus aiff m4a aac wma it xm mod s3m",
    "image": "png jpg gif bmp tga tiff webp psd exr hdr dds ktx ktx2 svg",
    "model": "gltf glb fbx obj stl ply dae 3ds blend usd usda usdc usdz",
    "video": "mkv webm avi ogv mp4 mov m4v",
    "document": "pdf md txt rtf docx odt",
}
ALIASES = {"oga": "ogg", "aif": "aiff", "jpeg": "jpg", "tif": "tiff", "markdown": "md"}
NOISE_DIRS = tuple("node_modules .git .svn .hg vendor target build dist __pycache__ .venv venv .tox .gradle cmakefiles obj bin library temp intermediate saved deriveddatacache".split())
LICENCE_NAMES = ("license", "licence", "copying", "notice", "eula")
VIDEO_CONTAINERS = ("mp4", "mov", "m4v")
#: Files up to this many bytes are read as one row; the bytes of larger ones are dealt to many tasks.
WHOLE_FILE = 64 << 20


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.when(F.instr(name, ".") > 1, F.element_at(F.split(name, r"\."), -1)))


def licence_file(path: Column) -> Column:
    """Whether a file's name begins with a word for licence evidence."""
    return F.lower(F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"[.\-_]"), 1)).isin(*LICENCE_NAMES)


def detected_format(path: Column) -> Column:
    """Format by extension, aliases by their usual name; a licence file without one is text. Null if none is known."""
    formats = {e: e for exts in FORMATS.values() for e in exts.split()} | ALIASES
    table = F.create_map(*[F.lit(x) for pair in formats.items() for x in pair])
    return F.when(extension(path).isNull(), F.when(licence_file(path), "txt")).otherwise(F.element_at(table, extension(path)))


def detected_media(path: Column) -> Column:
    """Media type of the format; null if none is known."""
    table = F.create_map(*[F.lit(x) for media, exts in FORMATS.items() for e in exts.split() for x in (e, media)])
    return F.element_at(table, F.coalesce(detected_format(path), F.lit("")))


def admitted(path: Column) -> Column:
    """Whether a scan takes a file: documents in noise directories only if they look like a licence."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    noisy = F.exists(dirs, lambda d: F.lower(d).isin(*NOISE_DIRS))
    return detected_media(path).isNotNull() & ((detected_media(path) != "document") | ~noisy | licence_file(path))


def refined(media: Column, fmt: Column, has_video: Column) -> Column:
    """Containers of video without a video stream are audio; unknown streams change nothing."""
    return F.when((media == "video") & fmt.isin(*VIDEO_CONTAINERS) & (has_video == F.lit(False)), F.lit("audio")).otherwise(media)


def walk(spark: SparkSession, root: str, scopes: list[str] | None = None, pattern: str | None = None, content: bool = False) -> DataFrame:
    """Files below a root, or its scopes: path relative to it, size, time, and the bytes on demand.

    Listing runs in the source; without ``content`` the bytes are never read.
    """
    rows = files_of(spark, root, scopes, pattern)
    return rows.select(*entry_columns(root), *(["content"] if content else []))


def files_of(spark: SparkSession, root: str, scopes: list[str] | None, pattern: str | None, kind: str = "binaryFile", **options: str) -> DataFrame:
    reader = spark.read.format(kind).options(recursiveFileLookup="true", ignoreMissingFiles="true", **options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load([f"{root}/{s}" for s in scopes] if scopes else root)


def entry_columns(root: str) -> list[Column]:
    # Spark writes a local path with its scheme; the relative one begins behind the root.
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return [rel.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]


def fetched(spark: SparkSession, root: str, scopes: list[str] | None = None, pattern: str | None = None, whole_file: int = WHOLE_FILE, round_bytes: int = digests.ROUND_BYTES) -> DataFrame:
    """Files as ``walk`` lists them, with the SHA-256 of their bytes (sha).

    A file above ``whole_file`` is read in splits by the text reader, as lines of any bytes, so that no task reads or
    holds it whole and none is too large. Names of packed files are the exception, since that reader would unpack them.
    """
    # Conditions on _metadata leave files out when they are listed, so that bytes are read once at most.
    name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    parted = (size > whole_file) & ~name.rlike(digests.PACKED) if digests.resumable() else F.lit(False)
    rows = files_of(spark, root, scopes, pattern)
    whole = rows.where(~parted).select(*entry_columns(root), F.sha2("content", 256).alias("sha"))
    large = settled(rows.where(parted).select(*entry_columns(root), name.alias("key")))
    if large.isEmpty():
        return whole
    lines = files_of(spark, root, scopes, pattern, "text", lineSep="\n").where(parted).select(name.alias("key"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    found = digests.digests(lines, large.select("key", "size"), round_bytes)
    return whole.unionByName(large.join(found, "key").select("path", "size", "mtime", "sha"))


def sanitised(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}\-_.]", "_")


def numbered(rows: DataFrame, stem: Column, tail: Column, order: Column, taken: DataFrame | None = None) -> DataFrame:
    """``target`` names without collisions, stem and tail together, and ``copy``: 0 where the name stayed.

    The first row of a name keeps it unless it is among ``taken`` (name); the others get stem-1, stem-2 and
    so on, numbers left out whose name some row asks for or that is taken. Numbered names of different stems
    never meet, so each name is settled by itself: the n-th free number is n plus the occupied ones ahead.
    """
    asked = rows.withColumns({"_stem": stem, "_tail": tail}).withColumn("_name", F.concat("_stem", "_tail"))
    there = (asked.select(F.col("_name").alias("name")) if taken is None else asked.select(F.col("_name").alias("name")).unionByName(taken.select("name"))).distinct()
    reserved = taken.select(F.col("name").alias("_name")).distinct().withColumn("_there", F.lit(1)) if taken is not None else None
    placed = asked.join(reserved, "_name", "left") if taken is not None else asked.withColumn("_there", F.lit(None).cast("int"))
    first = F.row_number().over(Window.partitionBy("_name").orderBy(order)) - 1
    placed = placed.withColumn("_n", first + F.coalesce("_there", F.lit(0)))
    # Names that look numbered, by the name that they would be a number of.
    tails = placed.select("_stem", "_tail").where("_n > 0").distinct()
    parts = there.select(F.regexp_extract("name", r"^(.*)-([1-9][0-9]{0,8})(\.[^.]*)?$", 1).alias("_stem"), F.regexp_extract("name", r"^(.*)-([1-9][0-9]{0,8})(\.[^.]*)?$", 2).alias("_k"), F.regexp_extract("name", r"^(.*)-([1-9][0-9]{0,8})(\.[^.]*)?$", 3).alias("_tail"))
    occupied = parts.where("_k <> ''").join(tails, ["_stem", "_tail"], "left_semi").select("_stem", "_tail", F.col("_k").cast("int").alias("_k"))
    # An occupied number k, the i-th of its name, stands behind k - i free ones.
    held = occupied.select("_stem", "_tail", (F.col("_k") - F.row_number().over(Window.partitionBy("_stem", "_tail").orderBy("_k"))).alias("_at"), F.lit(1).alias("_held"))
    copies = placed.where("_n > 0").withColumns({"_at": F.col("_n"), "_held": F.lit(0)})
    ahead = Window.partitionBy("_stem", "_tail").orderBy("_at", "_held").rowsBetween(Window.unboundedPreceding, 0)
    counted = copies.unionByName(held, allowMissingColumns=True).withColumn("copy", (F.col("_n") + F.sum("_held").over(ahead)).cast("int")).where("_held = 0")
    named = placed.where("_n = 0").withColumn("copy", F.lit(0)).unionByName(counted.drop("_at", "_held"))
    target = F.when(F.col("copy") == 0, F.col("_name")).otherwise(F.concat("_stem", F.lit("-"), F.col("copy").cast("string"), "_tail"))
    return named.withColumn("target", target).drop("_stem", "_tail", "_name", "_there", "_n")


def sidecars(manifest: DataFrame) -> DataFrame:
    """One JSON document per asset under a name of its own."""
    clean = sanitised(F.col("filename"))
    named = numbered(manifest, F.when(clean == "", F.col("id").cast("string")).otherwise(clean), F.lit(".json"), F.col("id"))
    return named.select("id", F.col("target").alias("file"), F.to_json(F.struct(*[c for c in manifest.columns])).alias("body"))


def write_manifest(manifest: DataFrame, path: str, kind: str) -> None:
    """A manifest as one JSON document, {"assets": [...]}, over the files of a folder, or as CSV files.

    The document's files hold lines in order: the head, an asset each with a comma between, and the end; put
    together they are one JSON text, and none is held in memory. Assets keep the order of ``manifest``,
    repeated and null ids included: lines are numbered by partition and place. Spark commits the folder as one.
    """
    if kind != "json":
        manifest.write.mode("overwrite").option("header", True).csv(path)
        return
    spark = manifest.sparkSession
    body = settled(manifest.select(F.to_json(F.struct(*manifest.columns)).alias("value")).withColumn("place", F.monotonically_increasing_id()))
    first = body.agg(F.min("place").alias("first"))
    body = body.join(F.broadcast(first)).withColumn("value", F.when(F.col("place") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")))
    ends = spark.range(2).select((F.col("id") * 2).cast("int").alias("part"), F.lit(0).cast("long").alias("place"), F.when(F.col("id") == 0, '{"assets":[').otherwise("]}").alias("value"))
    body.select(F.lit(1).alias("part"), "place", "value").unionByName(ends).orderBy("part", "place").select("value").write.mode("overwrite").text(path)


def write_sidecars(manifest: DataFrame, path: str) -> int:
    """One file per asset below the folder, named as by ``sidecars``; the number of files.

    Tasks write them. Each goes to a name of its attempt first and then takes its own, whole, so an
    attempt that is repeated replaces a file by the same one. A _SUCCESS file follows when all are there.
    """
    target = path if "://" in path else f"file://{path}"

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(target)
        store.create_dir(root)
        for batch in batches:
            for name, body in zip(*[c.to_pylist() for c in batch.columns]):
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(body.encode())
                store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    files = map_arrow(sidecars(manifest).select("file", "body"), run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    from pyarrow.fs import FileSystem

    store, root = FileSystem.from_uri(target)
    store.create_dir(root)
    store.open_output_stream(f"{root}/_SUCCESS").close()
    return files


def convert_plan(assets: DataFrame, extension_to: str, taken: DataFrame, rule: str) -> DataFrame:
    """The outputs of a conversion without running it: target path and outcome per asset.

    taken (path) are files already there. The rule for collisions: fail, skip, overwrite or suffix; of
    several inputs with one target the first by id is planned as if alone.
    """
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    rows = numbered(assets.select("id", "size_bytes", stem.alias("stem")), F.col("stem"), F.lit(f".{extension_to}"), F.col("id"), taken.select(F.col("path").alias("name")))
    base, clash = F.concat("stem", F.lit(f".{extension_to}")), F.col("copy") > 0
    if rule == "suffix":
        target, outcome = F.col("target"), F.lit("done")
    elif rule == "overwrite":
        target, outcome = base, F.lit("done")
    else:
        target, outcome = F.when(~clash, base), F.when(clash, {"fail": "failed", "skip": "collision"}[rule]).otherwise("done")
    return rows.select("id", "size_bytes", target.alias("target"), outcome.alias("outcome"))


def convert_tally(plan: DataFrame) -> DataFrame:
    done = F.col("outcome") == "done"
    return plan.agg(F.count_if(done).alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "collision").alias("collisions"), F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)).alias("bytes"))


# Federation

MERGE_RANK = ("scanned", "relevance")


def tagged(rows: DataFrame, peer: str, local: bool) -> DataFrame:
    return rows.withColumns({"peer": F.lit(peer), "local": F.lit(local)})


def merged(streams: list[DataFrame], sort: str, descending: bool, limit: int, order: list[Column]) -> DataFrame:
    """One page from the pages of several libraries (id, filename, size, peer, local).

    Names and sizes compare across libraries, names first without case. Other orders interleave by
    each library's own rank. Ties: the local library, then the id.
    """
    rows = reduce(DataFrame.unionByName, streams)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("peer").orderBy(*order)))
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_first())
    keys = {"name": [turn(F.lower("filename")), turn(F.col("filename"))], "size": [turn(F.col("size"))]}.get(sort, [F.col("rank")])
    return rows.orderBy(*keys, F.desc("local"), F.col("id").cast("string")).limit(limit)


def answered(page: DataFrame, asked: list[str], came: list[str]) -> DataFrame:
    """A merged page that tells which of the asked libraries are not in it: an answer that lacks one is partial,
    and its order holds among those that came."""
    missing = sorted(set(asked) - set(came))
    return page.withColumns({"partial": F.lit(bool(missing)), "missing": F.array(*[F.lit(m) for m in missing]).cast("array<string>")})


def routed(peers: Iterable[str], source: str | None, allowed: Collection[str] | None) -> tuple[bool, list[str]]:
    """Whether the own library is asked, and which peers (named by the source that stands for each here).

    A filter on a peer's source asks that peer alone, one on an own source no peer, none asks all. A peer
    beyond the ceiling ``allowed`` (None: no ceiling) is never asked: a filter on it asks the own library, which
    holds no row of that source, so nothing tells that the peer exists.
    """
    seen = sorted(p for p in peers if allowed is None or p in allowed)
    if source is None:
        return True, seen
    return (False, [source]) if source in seen else (True, [])


def federated(local: DataFrame, peers: dict[str, DataFrame], sort: str, descending: bool, limit: int, order: list[Column], source: str | None = None, allowed: Collection[str] | None = None, silent: Collection[str] = ()) -> DataFrame:
    """A page over the own library and its peers (id, filename, size, source_id), with partial and missing.

    The filter on a source and the ceiling hold ahead of the cut. The sources of a peer mean nothing here: its rows
    come under the source that stands for it, and a filter on that takes its whole catalogue. A ``silent``
    peer that was asked is missing from the page; if it was the only one, the page has no row to tell so.
    """
    own, asked = routed(peers, source, allowed)
    mine = local if allowed is None else local.where(F.col("source_id").isin(list(allowed)))
    mine = mine if source is None else mine.where(F.col("source_id") == source)
    came = [p for p in asked if p not in silent]
    streams = [tagged(mine if own else mine.where(F.lit(False)), "", True)]
    streams += [tagged(peers[p].withColumn("source_id", F.lit(p)), p, False) for p in came]
    return answered(merged(streams, sort, descending, limit, order), asked, came)


def fed_total(totals: DataFrame) -> DataFrame:
    """The sum of the libraries' totals (peer, total); unknown if any is."""
    return totals.agg(F.when(F.count("total") == F.count(F.lit(1)), F.sum("total")).alias("total"))


def same_protocol(peers: DataFrame, version: str) -> DataFrame:
    """Peers (peer, protocol as major.minor) that speak the same major version."""
    return peers.where(F.substring_index("protocol", ".", 1) == version.split(".")[0])


def fed_similar(streams: list[DataFrame], space: str, k: int) -> DataFrame:
    """The best k hits (id, score, space_id, peer, local) of one space from all libraries; local wins ties."""
    rows = reduce(DataFrame.unionByName, streams).where(F.col("space_id") == space)
    return rows.orderBy(F.desc("score"), F.desc("local"), "id").limit(k)
