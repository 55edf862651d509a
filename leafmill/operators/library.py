"""The document library: index, folders, jobs, export and memo tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X


def newest(index: DataFrame) -> DataFrame:
    """One record per document: the last translated; exact copies fall together."""
    columns = [c for c in index.columns if c != "doc_id"]
    return index.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.coalesce("translated_at", F.lit("")).alias("_at"), *columns)).alias("r")).select("doc_id", *[f"r.{c}" for c in columns])


def upsert(index: DataFrame, new: DataFrame) -> DataFrame:
    """New records first (``rank`` 0), then the others; a missing folder or time is kept, blank ids are ignored."""
    good = new.where("trim(doc_id) <> ''").alias("n")
    o = index.alias("o")
    same = F.col("n.doc_id") == F.col("o.doc_id")
    kept = [
        F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in ("folder_id", "translated_at") else F.col(f"n.{c}")
        for c in index.columns
    ]
    fresh = good.join(o, same, "left").select(*kept, F.lit(0).alias("rank"))
    rest = o.join(good, same, "left_anti").select(*[f"o.{c}" for c in index.columns], F.lit(1).alias("rank"))
    return fresh.unionByName(rest)


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def delete_folder(index: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents of the given folders lose their folder and stay."""
    gone = folders.select("folder_id", F.lit(True).alias("_gone")).distinct()
    left = index.join(gone, "folder_id", "left")
    return left.withColumn("folder_id", F.when(F.col("_gone").isNull(), F.col("folder_id"))).drop("_gone").select(*index.columns)


def in_known_folder(index: DataFrame, folders: DataFrame) -> DataFrame:
    return index.join(folders.select("folder_id"), "folder_id", "left_semi").select(*index.columns)


def content_copies(files: DataFrame, content: str, path: str, time: str) -> DataFrame:
    """One copy per content: ``key, path, mtime`` of the oldest, first by path."""
    first = F.min(F.struct(F.col(time).alias("mtime"), F.col(path).alias("path"))).alias("f")
    return files.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("key")).agg(first).select("key", "f.path", "f.mtime")


def healed(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Records with a missing page count get it from the counted pages, and are done."""
    counted = pages.groupBy("doc_id").agg((F.max("page") + 1).cast("int").alias("_n"))
    rows = index.join(counted, "doc_id", "left")
    missing = (F.coalesce("page_count", F.lit(0)) == 0) & F.col("_n").isNotNull()
    return rows.withColumn("status", F.when(missing, "done").otherwise(F.col("status"))).withColumn("page_count", F.when(missing, F.col("_n")).otherwise(F.col("page_count"))).drop("_n").select(*index.columns)


def evicted(jobs: DataFrame, now: float, keep: int = 50, ttl: float = 7200.0) -> DataFrame:
    """Finished jobs to drop: those past their time, then the oldest until ``keep`` are left; ids are unique.

    The jobs that stay are the newest, ``keep`` less the unfinished: a top-k of
    bounded size, whatever the number of jobs. Nothing is counted beforehand.
    """
    ended = jobs.where("finished_at is not null")
    old = ended.where(F.col("finished_at") < now - ttl)
    recent = ended.where(F.col("finished_at") >= now - ttl)
    newest = recent.orderBy(F.desc("finished_at"), F.desc("job_id")).limit(keep).select("job_id", "finished_at")
    ranked = newest.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("finished_at"), F.desc("job_id"))))
    open_ = jobs.where("finished_at is null").agg(F.count("*").alias("_open"))
    stay = ranked.crossJoin(F.broadcast(open_)).where(F.col("_k") <= keep - F.col("_open")).select("job_id")  # one row
    return old.unionByName(recent.join(F.broadcast(stay), "job_id", "left_anti").select(*jobs.columns))


def first_entries(rows: DataFrame, path: str, suffix: str) -> DataFrame:
    """``(folder, first_entry)``: of each directory the first name with the suffix, whatever its case."""
    p = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    named = rows.where(F.lower(path).endswith(suffix)).select(F.regexp_replace(p, "/[^/]*$", "").alias("folder"), F.regexp_extract(p, "[^/]*$", 0).alias("name"))
    return named.groupBy("folder").agg(F.min("name").alias("first_entry"))


def with_files(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``file_exists``: whether the record's path is in a listing of files, in one notation."""
    files = listing.where("file_path is not null").select(normal_path(F.col("file_path")).alias("_file"), F.lit(True).alias("_there")).distinct()
    joined = index.join(files, normal_path(index["file_path"]) == F.col("_file"), "left")
    return joined.withColumn("file_exists", F.coalesce("_there", F.lit(False))).drop("_file", "_there")


def folder_view(index: DataFrame, folder: str | None, query: str) -> DataFrame:
    """Documents of a folder (all if null) whose title holds the query, case ignored."""
    rows = index if folder is None else index.where(F.col("folder_id") == folder)
    return rows.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(query.lower())))


def memo_read(spine: DataFrame, memo: DataFrame, layers: list[str]) -> DataFrame:
    """Left joins of the spine's key columns with the memo's layers: the first layer that has a payload wins."""
    rows = spine
    for layer in layers:
        m = memo.where(F.col("layer") == layer).select(F.col("key").alias(f"_{layer}"), F.col("payload").alias(f"_{layer}_payload"))
        rows = rows.join(m, F.col(f"{layer}_key") == F.col(f"_{layer}"), "left")
    payload = F.coalesce(*[F.col(f"_{x}_payload") for x in layers])
    return rows.select(*spine.columns, payload.alias("payload"))


def bilingual_lines(blocks: DataFrame) -> DataFrame:
    """Markdown lines of a bilingual export with their order: ``doc_id, page, block_id, part, line``.

    A line per row, so that no document has to fit in one value; writing a
    document is a sort by its order.
    """
    body = blocks.where("original is not null or translated is not null")
    pairs = body.select(
        "doc_id", "page", "block_id",
        F.posexplode(F.array(F.coalesce("original", F.lit("")), F.lit(""), F.coalesce("translated", F.lit("")), F.lit(""))).alias("part", "line"),
    )
    heads = body.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(-1).alias("block_id"), F.lit(0).alias("part"), F.concat(F.lit("## "), (F.col("page") + 1).cast("string")).alias("line"))
    return heads.unionByName(pairs)


def log_line(level: Column, message: Column, at: Column) -> Column:
    """Timestamp, level (ten letters at most) and a message on one line of 2000 characters at most."""
    text = F.left(F.regexp_replace(message, r"[\r\n]+", " "), F.lit(2000))
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.left(F.upper(level), F.lit(10)), F.lit("] "), text)


def normal_path(c: Column) -> Column:
    """One notation for paths: forward slashes, lower-case drive, no trailing slash."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+$", ""))


def export_name(title: Column, day: Column) -> Column:
    return F.concat(X.title_from_path(title), F.lit("-双语-"), F.date_format(day, "yyyyMMdd"), F.lit(".md"))


def rekeyed(sessions: DataFrame, moves: DataFrame) -> DataFrame:
    """Sessions after some got another key; one that had the new key before gives way and hands over its reader.

    ``sessions``: ``key, title, reader``; ``moves``: ``old_key, new_key, title``, each old key once.
    """
    s, m = sessions.alias("s"), moves.alias("m")
    carried = sessions.groupBy("key").agg(F.max("reader").alias("_reader")).alias("c")
    moved = (
        s.join(m, F.col("s.key") == F.col("m.old_key"))
        .join(carried, F.col("m.new_key") == F.col("c.key"), "left")
        .select(F.col("m.new_key").alias("key"), F.coalesce("m.title", "s.title").alias("title"), F.coalesce("s.reader", "c._reader").alias("reader"))
    )
    gone = moves.select(F.col("old_key").alias("key")).unionByName(moves.join(sessions.select(F.col("key").alias("old_key")), "old_key", "left_semi").select(F.col("new_key").alias("key"))).distinct()
    return sessions.join(gone, "key", "left_anti").select("key", "title", "reader").unionByName(moved)


def export_decision(cached: Column, same_runs: Column, running: Column, most: int = 1) -> Column:
    """What a request for an export gets: a finished product, the run that is on, a refusal, or a run of its own."""
    return F.when(cached, "cached").when(same_runs, "reuse").when(running >= most, "refused").otherwise("spawn")


def slowed(rate: Column, limited: Column, most: int = 3) -> Column:
    """Requests per second after so many answers of a limited rate: halved each time, ``most`` times, never below 1."""
    return F.greatest(F.lit(1.0), rate / F.pow(F.lit(2.0), F.least(limited, F.lit(most))))


def within(path: Column, root: str) -> Column:
    """Whether a path stays under a folder: in one notation, with no step up."""
    p = normal_path(path)
    return F.coalesce((p == root) | p.startswith(root.rstrip("/") + "/"), F.lit(False)) & ~F.coalesce(p.rlike(r"(^|/)\.\.(/|$)"), F.lit(True))


def report_lines(quality: DataFrame, columns: list[str]) -> DataFrame:
    """``(rank, line)``: a Markdown table of a per-document report, a heading and a rule before its rows."""
    cells = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    head = quality.sparkSession.createDataFrame([("", f"| doc_id | {' | '.join(columns)} |"), ("-", f"|{'---|' * (len(columns) + 1)}")], "rank string, line string")
    return head.unionByName(quality.select(F.col("doc_id").alias("rank"), cells([F.col("doc_id"), *[F.col(c).cast("string") for c in columns]]).alias("line")))
