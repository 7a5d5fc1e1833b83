"""Mirror layout: manifest, collisions, file/folder conflicts, escapes.

Files are not written one by one; a mirror is a Parquet table
``(crawl_id, url, path, kind, mode, content)`` clustered by crawl and path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.operators.state import clustered


def _rank_struct(order: Sequence[str], url: str):
    """Writer rank: the order columns, then the URL as tie-break (once)."""
    cols = [*order] if url in order else [*order, url]
    return F.struct(*[F.col(c) for c in cols])


def with_paths(resources: DataFrame, url: str = "url", **path_opts) -> DataFrame:
    """Add ``path`` (U3) and ``file_key`` (the normalised path two URLs collide on)."""
    return resources.withColumn("path", U.local_path(F.col(url), **path_opts)).withColumn(
        "file_key", U.norm_path(F.col("path")))


def manifest(resources: DataFrame, order: Sequence[str], by: Sequence[str] = (), url: str = "url",
             content: str = "html", content_type: str | None = None, body: str | None = None,
             earlier: DataFrame | None = None, **path_opts) -> DataFrame:
    """S3 + K2: what the mirror holds, first writer per file wins.

    ``earlier(*by, url, path)`` are files that stand already, one row a file:
    their writers came first, so no row here is written over them.

    ``order`` ranks writers (earliest first). The winner per file is a
    map-side-combinable ``min(struct)`` aggregate, then joined back on the file
    key. Output: by..., url, path, kind, mode, n_bytes, writer_url, written.
    """
    by = list(by)
    r = with_paths(resources, url, **path_opts)
    ct = F.col(content_type) if content_type else F.lit("text/html")
    kind, _, mode = U.content_kind(ct, F.col(url))
    size = F.octet_length(F.col(content))
    if body:
        size = F.when(mode == "binary", F.octet_length(F.col(body))).otherwise(size)
    r = r.withColumn("kind", kind).withColumn("mode", mode).withColumn("n_bytes", size.cast("bigint"))
    win = r.groupBy(*by, "file_key").agg(F.min(_rank_struct(order, url)).alias("w"))
    win = win.select(*by, "file_key", F.col(f"w.{url}").alias("writer_url"))
    if earlier is not None:
        there = earlier.select(*by, U.norm_path(F.col("path")).alias("file_key"), F.col(url).alias("_by"))
        there = there.groupBy(*by, "file_key").agg(F.min("_by").alias("_by"))
        win = win.join(there, [*by, "file_key"], "left").select(
            *by, "file_key", F.coalesce("_by", "writer_url").alias("writer_url"), F.col("_by").isNull().alias("_free"))
    else:
        win = win.withColumn("_free", F.lit(True))
    out = r.join(win, [*by, "file_key"])
    return out.select(*by, url, "path", "kind", "mode", "n_bytes", "writer_url",
                      (F.col("_free") & (F.col("writer_url") == F.col(url))).alias("written"))


def path_collisions(resources: DataFrame, order: Sequence[str], by: Sequence[str] = (), url: str = "url",
                    **path_opts) -> DataFrame:
    """K2 report: files claimed by more than one URL, with the count and the winning URL."""
    by = list(by)
    r = with_paths(resources, url, **path_opts)
    g = r.groupBy(*by, "file_key").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_urls"),
        F.min(_rank_struct(order, url)).alias("w"))
    return g.where(F.col("n_urls") > 1).select(*by, F.col("file_key").alias("path"), "n_urls",
                                               F.col(f"w.{url}").alias("winner_url"))


def path_conflicts(paths: DataFrame, by: Sequence[str] = (), path: str = "path", **hash_opts) -> DataFrame:
    """K1: a saved file whose path is also a folder of another file is renamed ``<path>_<hash>``.

    Ancestors of every path are exploded (a handful per path) and semi-joined
    with the file paths, an equi-join on ``(by, path)``.
    """
    by = list(by)
    files = paths.select(*by, U.norm_path(F.col(path)).alias("file")).distinct()
    parts = F.split(F.col("file"), "/")
    anc = files.select(*by, F.col("file").alias("child"), F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("file")).where(F.col("file") != F.col("child"))
    hit = anc.join(files, [*by, "file"], "left_semi")
    g = hit.groupBy(*by, "file").agg(F.count(F.lit(1)).cast("bigint").alias("n_children"))
    return g.select(*by, F.col("file").alias("path"),
                    F.concat(F.col("file"), F.lit("_"), U.name_hash(F.col("file"), **hash_opts)).alias("renamed_path"),
                    "n_children")


def unsafe_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """K3: paths that would be written outside the output folder."""
    return paths.where(U.escapes_root(F.col(path)))


def apply_renames(m: DataFrame, by: Sequence[str] = (), **hash_opts) -> DataFrame:
    """K1 fix-up: a written file that another file needs as a folder moves to ``<path>_<hash>``.

    Adds ``final_path`` (equal to ``path`` unless renamed) and ``renamed``.
    """
    by = list(by)
    written = m.where(F.col("written"))
    conflicts = path_conflicts(written, by, **hash_opts).select(
        *by, F.col("path").alias("file_key"), "renamed_path")
    return m.join(conflicts, [*by, "file_key"], "left").withColumn(
        "renamed", F.col("renamed_path").isNotNull() & F.col("written")).withColumn(
        "final_path", F.when(F.col("renamed"), F.col("renamed_path")).otherwise(F.col("path"))).drop("renamed_path")


def write_mirror(resources: DataFrame, out_dir: str, order: Sequence[str], by: Sequence[str] = ("crawl_id",),
                 url: str = "url", content: str = "html", content_type: str | None = None,
                 mode: str = "overwrite", quarantine: bool = True, body: str | None = None,
                 earlier: DataFrame | None = None, **path_opts) -> DataFrame:
    """S3 sink: the written files of a mirror as Parquet ``(by..., path, url, kind, mode, content)``.

    One row per file (the first writer wins), clustered by crawl and path,
    instead of millions of small files. Files needed as folders are renamed (K1);
    with ``quarantine`` a path escaping the output folder is not written (K3).
    ``body`` names a binary column, written beside ``content`` for files of mode
    "binary". ``earlier`` names the files of earlier runs, which are never written
    again (see ``manifest``). Returns the manifest with ``final_path``, ``renamed`` and ``unsafe``.
    """
    by = list(by)
    m = manifest(resources, order, by, url, content, content_type, body, earlier, **path_opts)
    hash_opts = {k: v for k, v in path_opts.items() if k in ("hash_algo", "hash_len")}
    m = apply_renames(m.withColumn("file_key", U.norm_path(F.col("path"))), by, **hash_opts).withColumn(
        "unsafe", U.escapes_root(F.col("path")))
    keep = F.col("written") & (~F.col("unsafe") if quarantine else F.lit(True))
    bodies = [F.col(body).alias("body")] if body else []
    files = m.where(keep).select(*by, url, F.col("final_path").alias("path"), "kind", "mode").join(
        resources.select(*by, url, F.col(content).alias("content"), *bodies), [*by, url])
    if body:
        files = files.withColumn("body", F.when(F.col("mode") == "binary", F.col("body"))).withColumn(
            "content", F.when(F.col("mode") == "text", F.col("content")))
    clustered(files, *by, "path").write.mode(mode).parquet(out_dir)
    return m.drop("file_key")
