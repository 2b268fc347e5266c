"""Runs over files: indexing, enrichment and duplicates, each a few DataFrame jobs whatever the number of files.

Readers of files and transports to services are functions that are passed in. What fails belongs to its file: it goes to the
failure log, and the others go on. Counters are returned as dicts.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import titles
from .operators import dedup, enrich, indexing
from .service import Library
from .session import scratch
from .sources import files, pdf, providers
from .sources.snapshots import SnapshotTable

_LIST = "array<string>"
#: What an entry of the metadata file may say of a paper.
ENTRY = {c: _LIST if c in enrich._LISTS or c == "tags" else "int" if c in ("year", "cited_by_count") else "string" for c in (*enrich.FIELDS, "tags", "external_url")}
CACHE = "provider string, query_type string, query_value string, payload string, updated_at timestamp, cache_id string"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" in path else os.path.abspath(os.path.expanduser(path))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once so that nothing that reads files or asks services runs twice."""
    path = scratch(rows.sparkSession, name)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def manifest(lib: Library) -> SnapshotTable:
    return SnapshotTable(lib.spark, lib.settings.table("manifest"), key="path")


def _manifest_rows(lib: Library) -> DataFrame:
    rows = manifest(lib).read()
    return rows if rows is not None else lib.spark.createDataFrame([], "path string, digest string, size long, mtime timestamp, chunk_count int, seq long")


# -- which files -------------------------------------------------------------------------------------------------------


def candidates(lib: Library, file: str | None = None, retry_failed: bool = False) -> tuple[DataFrame, list[str]]:
    """path, raw_path, root_path, tags, size, mtime of the files of a run, and the directories left out for their markers.

    Of several roots a missing one is passed over; a single one must exist. A path that several roots have is the first's.
    """
    spark, s = lib.spark, lib.settings
    if retry_failed:
        if not files.exists(spark, s.indexing.failed_path):
            return files.listing(spark, scratch(spark, "none")).withColumn("raw_path", F.col("path")), []
        known = sorted(r.file for r in files.failures(spark, s.indexing.failed_path).collect())  # as many as have failed
        paths = [p for p in known if p.lower().endswith(".pdf") and files.exists(spark, p)]
        rows = files.contents(spark, paths).select("path", F.substring_index("path", "/", -1).alias("n"), "size", "mtime")
        return rows.select("path", F.col("path").alias("raw_path"), F.expr("left(path, length(path) - length(n) - 1)").alias("root_path"), F.array().cast(_LIST).alias("tags"), "size", "mtime"), []
    if file:
        path, hits = _local(file), []
        for root in s.papers:
            if root.skip_marker_file.strip():
                hits += files.marked_parents(spark, path, [_local(p) for p in root.paths()], root.skip_marker_file.strip())
        rows = files.one_file(spark, path)
        return rows.withColumn("root_path", F.lit(os.path.dirname(path))).withColumn("raw_path", F.lit(file)), sorted(set(hits))
    roots = [(root, _local(p), p) for root in s.papers for p in root.paths()]
    found, hits = [], []
    for root, path, raw in roots:
        if not files.exists(spark, path):
            if len(roots) == 1:
                raise FileNotFoundError(path)
            continue
        rows = files.listing(spark, path, tuple(root.tags)).withColumn("raw_path", F.concat(F.lit(raw.rstrip("/")), F.expr(f"substring(path, {len(path.rstrip('/')) + 1})")))
        if root.skip_marker_file.strip():
            marks = files.markers(spark, path, root.skip_marker_file.strip())
            hits += [r.dir for r in indexing.marker_hits(rows, marks).collect()]  # a row per marker
            rows = indexing.without_marked(rows, marks)
        found.append(rows)
    if not found:
        return files.listing(spark, scratch(spark, "none")).withColumn("raw_path", F.col("path")), []
    return indexing.merge_roots(*found).drop("root_ord"), sorted(set(hits))


def _numbered(rows: DataFrame, above: int) -> DataFrame:
    """rows with seq, from above + 1 on in the order of path: sorted by range, numbered in each part, parts set off by their counts."""
    parts = _kept(rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("__p", F.spark_partition_id()), "numbered")
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("__p").count().collect())  # a row per partition
    offsets, n = {}, above
    for p, c in sizes:
        offsets[p], n = n, n + c
    if not offsets:
        return parts.drop("__p").withColumn("seq", F.lit(0).cast("long"))
    off = F.element_at(F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)]), F.col("__p"))
    return parts.withColumn("seq", (off + F.row_number().over(Window.partitionBy("__p").orderBy("path"))).cast("long")).drop("__p")


def metadata_of(lib: Library, rows: DataFrame) -> DataFrame:
    """rows with the columns of ENTRY from the metadata file; null where it says nothing."""
    path = lib.settings.indexing.metadata_path
    if not files.exists(lib.spark, path):
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in ENTRY.items() if c not in rows.columns})
    found = files.resolve_metadata(rows, files.metadata_json(lib.spark, path))

    def value(c: str, t: str) -> Column:
        own = F.try_variant_get("value", f"$.{c}", t)
        return F.coalesce(own, F.when(F.try_variant_get("value", f"$.{c}", "string").isNotNull(), T.split_list(F.try_variant_get("value", f"$.{c}", "string")))) if t == _LIST else own

    tags = {"tags": F.when(F.size(value("tags", _LIST)) > 0, value("tags", _LIST)).otherwise(F.col("tags"))} if "tags" in rows.columns else {}
    return found.withColumns({c: value(c, t) for c, t in ENTRY.items() if c != "tags" or not tags} | tags).drop("value")


# -- indexing ----------------------------------------------------------------------------------------------------------


def index(
    lib: Library, *, file: str | None = None, force: bool = False, only_new: bool = False, retry_failed: bool = False, max_files: int | None = None,
    reader: Callable[[bytes], tuple] = pdf.read, transport: providers.Transport | None = None, confirm_plan: Callable[[list[dict]], bool] = lambda plan: True, confirm_markers: Callable[[list[str]], bool] = lambda dirs: True,
) -> dict:
    """Index the files that are new or have changed. Counters: indexed, skipped, chunks, duplicates, enriched, failed_metadata."""
    spark, s = lib.spark, lib.settings
    done = dict.fromkeys(("indexed", "skipped", "chunks", "duplicates", "enriched", "failed_metadata"), 0)
    rows, marked = candidates(lib, file, retry_failed)
    if marked and not confirm_markers(marked):
        return done
    rows = _kept(rows, "candidates")
    if s.dedup.enabled:
        pairs = _kept(duplicate_pairs(lib, rows, reader, s.dedup.max_files), "pairs")
        write_report(lib, rows, pairs)
        done["duplicates"] = pairs.select("duplicate_path").distinct().count()
        if s.dedup.action == "skip":
            done["skipped"] += done["duplicates"]
            rows = rows.join(pairs.select(F.col("duplicate_path").alias("path")).distinct(), "path", "left_anti")
    old = _manifest_rows(lib)
    above = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = _numbered(rows, above)
    maybe = indexing.targets(rows.withColumn("digest", F.lit(None).cast("string")), old, force, only_new)
    maybe = _kept(maybe, "maybe")
    work = F.col("reason").isin("new", "changed", "forced")
    paths = [r.path for r in maybe.where(work).orderBy("seq").select("path").collect()]  # the files this run reads
    read = _kept(files.contents(spark, paths).select("path", "digest", "content"), "contents")
    most = s.indexing.max_files if max_files is None else max_files
    found = _kept(indexing.targets(maybe.drop("digest", "reason").join(read.select("path", "digest"), "path", "left"), old, force, only_new, most), "targets")
    done["skipped"] += found.where(~work).count()
    targets = found.where(work)
    plan = [r.asDict() for r in indexing.plan(found).orderBy("first_seq").collect()]  # a row per root
    if not plan or not confirm_plan(plan):
        return done
    texts = files.extract(read.join(targets.select("path"), "path", "left_semi"), reader)
    known = old.select("path", F.col("seq").alias("__old"))
    docs = _kept(targets.join(texts, "path").join(known, "path", "left").withColumn("seq", F.coalesce("__old", "seq")).drop("__old"), "texts")
    broken = docs.where("error is not null")
    failures = [r.asDict() for r in broken.select("path", "error").collect()]  # as many as fail
    if failures:
        log = [(_now(), f["path"], f["error"].split(":")[0], f["error"]) for f in failures]
        files.append_log(spark.createDataFrame(log, files.FAILURE).coalesce(1), s.indexing.failed_path)
    good = docs.where("error is null and text <> ''")
    papers = metadata_of(lib, good).withColumn("file_name", F.substring_index("path", "/", -1))
    papers = papers.withColumn("title", titles.infer(F.coalesce(F.when(titles.trusted(F.col("title")), F.col("title")), F.col("pdf_title")), F.col("text"), F.col("file_name")))
    papers = papers.withColumn("authors", F.coalesce(F.when(F.size("authors") > 0, F.col("authors")), F.when(T.blank(F.col("pdf_author")).isNotNull(), F.array("pdf_author"))))
    papers = _kept(papers.withColumnRenamed("path", "source_path").drop("reason", "content", "pdf_title", "pdf_author", "error", "raw_path", "root_path"), "papers")
    new = lib.add_papers(papers.drop("digest", "size", "mtime", "page_count"), gone=targets.select(F.col("path").alias("source_path")))
    counts = new.groupBy("source_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    entries = papers.join(counts, "source_path").select(F.col("source_path").alias("path"), "digest", "size", "mtime", "chunk_count", "seq")
    stat = found.where("reason = 'same_content'").select("path", F.col("size").alias("n"), F.col("mtime").alias("t"))
    entries = entries.unionByName(old.join(stat, "path").select("path", "digest", F.col("n").alias("size"), F.col("t").alias("mtime"), "chunk_count", "seq"))
    manifest(lib).merge(entries, gone=targets.select("path"))
    files.clear_failures(spark, s.indexing.failed_path, papers.select(F.col("source_path").alias("path")))
    totals = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("c")).first()
    done["indexed"], done["chunks"] = totals.n, totals.c
    done["skipped"] += targets.count() - totals.n
    if transport and s.metadata_enrichment.enabled and s.metadata_enrichment.timing != "manual":
        e = enrich_papers(lib, papers, transport)
        done["enriched"], done["failed_metadata"] = e["updated"], e["failed"]
    return done


def refresh(lib: Library) -> dict:
    """Metadata of the file over that of the chunks, without reading a text. Counters: papers, chunks, skipped."""
    rows = lib.chunks.read()
    if rows is None:
        return {"papers": 0, "chunks": 0, "skipped": 0}
    sizes = rows.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    own = metadata_of(lib, sizes.select(F.col("source_path").alias("path"), "n"))
    says = F.greatest(*[F.coalesce(F.size(c) > 0, F.lit(False)) if t == _LIST else F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c, t in ENTRY.items()])
    own = _kept(own.withColumn("__says", says).withColumnRenamed("path", "source_path"), "refresh")
    new = own.where("__says")
    total = new.agg(F.count(F.lit(1)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("c")).first()
    if total.p:
        lib.refresh(new, tuple(c for c in ENTRY if c in rows.columns))
    return {"papers": total.p, "chunks": total.c, "skipped": own.where("not __says").count()}


# -- duplicates --------------------------------------------------------------------------------------------------------


def duplicate_pairs(lib: Library, rows: DataFrame, reader: Callable[[bytes], tuple] = pdf.read, max_files: int | None = None) -> DataFrame:
    """source_path, duplicate_path, similarity, reason among the files: by DOI, title and year, and nearness of signatures."""
    s = lib.settings.dedup
    papers = metadata_of(lib, _numbered(rows, 0))
    if max_files is not None:
        papers = papers.where(F.col("seq") <= max_files)
    papers = _kept(papers, "dedup")
    found = [dedup.by_doi(papers), dedup.by_title_year(papers)]
    if s.semantic_enabled:
        paths = [r.path for r in papers.select("path").collect()]  # the files whose texts are read
        texts = files.extract(files.contents(lib.spark, paths), reader).select("path", "text")
        signed = papers.join(texts, "path", "left").withColumn("__sign", dedup.signature(F.col("doi"), F.col("title"), F.col("abstract"), F.col("text"), s.signature_chars))
        found.append(dedup.semantic(_kept(lib.embed(signed.where("__sign <> ''").select("seq", "__sign"), "__sign"), "signatures"), s.similarity_threshold))
    pairs = dedup.unique_pairs(*found)
    named = lambda c, new: papers.select(F.col("seq").alias(c), F.col("path").alias(new))
    return pairs.join(named("left", "source_path"), "left").join(named("right", "duplicate_path"), "right").select("source_path", "duplicate_path", "similarity", "reason")


def write_report(lib: Library, rows: DataFrame, pairs: DataFrame) -> dict:
    """The report of a run: rows of pairs as JSON lines beside one line of counters."""
    path = lib.settings.dedup.report_path
    pairs.write.mode("overwrite").json(f"{path}/pairs")
    pairs.select(F.col("duplicate_path").alias("file")).distinct().orderBy("file").write.mode("overwrite").json(f"{path}/skipped")
    done = {"checked": rows.count(), "pairs": pairs.count(), "skipped": pairs.select("duplicate_path").distinct().count(), "report": path}
    lib.spark.createDataFrame([(done["checked"], done["pairs"], done["skipped"])], "checked_files long, duplicate_pairs long, skipped_files long").coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return done


def dedupe(lib: Library, file: str | None = None, max_files: int | None = None, reader: Callable[[bytes], tuple] = pdf.read) -> dict:
    """A report of duplicates among the configured files; with ``file``, of the pairs that it is part of."""
    rows, _ = candidates(lib)
    if file:
        one, _ = candidates(lib, file)
        rows = rows.unionByName(one.join(rows.select("path"), "path", "left_anti"))
    most = lib.settings.dedup.max_files if max_files is None else max_files
    rows = _kept(rows, "candidates")
    pairs = duplicate_pairs(lib, rows, reader, most)
    if file:
        pairs = pairs.where((F.col("source_path") == _local(file)) | (F.col("duplicate_path") == _local(file)))
    return write_report(lib, rows if most is None else rows.orderBy("path").limit(most), _kept(pairs, "pairs"))


# -- enrichment --------------------------------------------------------------------------------------------------------


def cache(lib: Library) -> SnapshotTable:
    return SnapshotTable(lib.spark, lib.settings.table("enrichment_cache"), key="cache_id")


def cache_id() -> Column:
    return F.sha2(F.concat_ws("\u0001", "provider", "query_type", "query_value"), 256)


def cache_put(lib: Library, rows: DataFrame) -> int:
    """rows: provider, query_type, query_value, payload. The payload of a known key is replaced."""
    return cache(lib).upsert(rows.select("provider", "query_type", "query_value", "payload", F.current_timestamp().alias("updated_at"), cache_id().alias("cache_id")))


def cached(lib: Library, queries: DataFrame) -> DataFrame:
    """queries (provider, query_type, query_value) with the payload of each that the cache knows."""
    rows = cache(lib).read()
    if rows is None:
        rows = lib.spark.createDataFrame([], CACHE)
    return queries.withColumn("cache_id", cache_id()).join(rows.select("cache_id", "payload"), "cache_id").drop("cache_id")


def cache_get(lib: Library, provider: str, query_type: str, query_value: str) -> str | None:
    one = lib.spark.createDataFrame([(provider, query_type, query_value)], "provider string, query_type string, query_value string")
    row = cached(lib, one).first()
    return row.payload if row else None


def _ask(lib: Library, targets: DataFrame, provider: str, kind: str, value: Column, key: Column, transport: providers.Transport, force: bool) -> DataFrame:
    """targets with work, payload, error, hit: what the cache, else the service, says to each one's query of a kind."""
    asked = targets.withColumn("query_type", F.lit(kind)).withColumn("query_value", F.coalesce(value, F.lit(""))).withColumn("__key", F.coalesce(key, F.lit("")))
    known = cached(lib, asked.where("__key <> ''").select(F.lit(provider).alias("provider"), "query_type", F.col("__key").alias("query_value")).distinct()).select(F.col("query_value").alias("__key"), F.col("payload").alias("__known"))
    asked = asked.join(known if not force else known.limit(0), "__key", "left")
    out = providers.lookup(asked.where("__known is null"), provider, transport, lib.settings.metadata_enrichment)
    out = _kept(out, f"{provider}-{kind}")
    both = asked.join(out, ["query_type", "query_value"], "left").withColumn("hit", F.col("__known").isNotNull()).withColumn("payload", F.coalesce("__known", "payload")).drop("__known")
    return (enrich.parse_crossref if provider == "crossref" else enrich.parse_openalex)(both)


def enrich_papers(lib: Library, papers: DataFrame, transport: providers.Transport, force: bool = False, reverify: bool = False) -> dict:
    """papers (seq, source_path, file_name, text): look each up, provider by provider, by DOI and then by title; write what passes.

    Accepted works go to the cache, the metadata file, the chunks and, with an abstract, a chunk of their own. Counters:
    checked, updated, cleared, skipped, failed.
    """
    s, again = lib.settings.metadata_enrichment, force or reverify
    done = dict.fromkeys(("checked", "updated", "cleared", "skipped", "failed"), 0)
    if not s.enabled:
        return done
    base = papers.select("seq", F.col("source_path").alias("path"), "file_name", F.coalesce("text", F.lit("")).alias("text"), F.col("title").alias("__title"), *(["tags"] if "tags" in papers.columns else []))
    own = metadata_of(lib, base)
    if again:
        parts = titles.file_name_parts(F.col("file_name"))
        title, year = F.coalesce(T.blank(parts["title"]), titles.pick_line(F.col("text"), F.col("file_name"))), parts["year"]
    else:
        title, year = titles.infer(F.coalesce(F.when(titles.trusted(F.col("title")), F.col("title")), F.col("__title")), F.col("text"), F.col("file_name")), F.lit(None).cast("int")
    trusted, mined = enrich.doi_choice(F.col("doi"), F.col("url"), F.col("external_url"), F.col("text"), not again)
    own = own.withColumns({"__ref": title, "__year": year, "__trusted": trusted, "__mined": mined, "__has": F.coalesce(F.col("doi") != "", F.lit(False))}).drop("text")
    own = _kept(own, "enrich")
    left, found, wrong = own.where(F.lit(again) | ~F.col("__has")), None, None
    fits = enrich.accepted(F.lit(False), enrich.title_similarity(F.col("__ref"), F.col("work.title")), F.col("work.year"), F.col("__year"), s.min_title_similarity)
    for provider in s.providers:
        for kind, value, key, vouched in (("doi", F.coalesce("__trusted", "__mined"), F.coalesce("__trusted", "__mined"), F.col("__trusted").isNotNull()), ("title", F.col("__ref"), T.plain_key(F.col("__ref")), F.lit(False))):
            got = _ask(lib, left, provider, kind, value, key, transport, force)
            got = _kept(got.withColumn("__ok", F.col("work").isNotNull() & F.coalesce(vouched | fits, F.lit(False))), "answers")
            good = got.where("__ok")
            new = good.where("not hit and __key <> ''").select(F.lit(provider).alias("provider"), "query_type", F.col("__key").alias("query_value"), "payload").dropDuplicates(["query_value"])
            if not new.isEmpty():
                cache_put(lib, new)
            kept, bad = good.select("path", "work"), got.where("error is not null").select("path")
            found = kept if found is None else found.unionByName(kept)
            wrong = bad if wrong is None else wrong.unionByName(bad)
            left = _kept(left.join(kept.select("path"), "path", "left_anti"), "left")
    rows = own.join(found, "path", "left").join(wrong.distinct().withColumn("__failed", F.lit(True)), "path", "left")
    state = enrich.outcome(F.col("__has"), F.col("work").isNotNull(), F.coalesce("__failed", F.lit(False)), force, again)
    rows = _kept(rows.withColumn("__state", state), "outcomes")
    for r in rows.groupBy("__state").count().collect():
        done[r[0]] = r[1]
    done["checked"] = sum(done.values())
    changed = enrich.merged(rows.where("__state = 'updated'"), force=again, at=_now()).unionByName(enrich.cleared(rows.where("__state = 'cleared'")))
    changed = _kept(changed, "changed")
    if done["updated"] or done["cleared"]:
        write_metadata(lib, changed)
        if lib.chunks.version():
            lib.refresh(changed.withColumnRenamed("path", "source_path"), tuple(c for c in enrich.FIELDS), prune=True)
            lib.add_abstracts(changed.where("__state = 'updated'").withColumnRenamed("path", "source_path"))
    return done


def write_metadata(lib: Library, rows: DataFrame) -> None:
    """The metadata file with the entries of rows (path and columns of ENTRY) replaced."""
    spark, path = lib.spark, lib.settings.indexing.metadata_path
    old = files.metadata_json(spark, path) if files.exists(spark, path) else spark.createDataFrame([], "meta_key string, raw string").select("meta_key", F.parse_json("raw").alias("value"))
    said = [c for c in ENTRY if c in rows.columns]
    filled = [F.when(F.size(c) > 0, F.col(c)).alias(c) if ENTRY[c] == _LIST else F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in said]
    new = files.metadata_key(rows, old).select("meta_key", F.to_json(F.struct(F.col("path").alias("source_path"), "file_name", *filled)).alias("entry"))
    kept = old.join(new.select("meta_key"), "meta_key", "left_anti").select("meta_key", F.to_json("value").alias("entry"))
    files.save_metadata(_kept(kept.unionByName(new), "metadata"), path)


def enrich_files(lib: Library, transport: providers.Transport, *, file: str | None = None, force: bool = False, reverify: bool = False, max_files: int | None = None, reader: Callable[[bytes], tuple] = pdf.read, confirm: Callable[[int], bool] = lambda n: True) -> dict:
    """Enrich the configured files, or one that must be indexed."""
    if file and not (lib.chunks.version() and lib.has_paper(_local(file))):
        raise LookupError(f"{file} is not indexed yet")
    old = _manifest_rows(lib)
    above = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    rows = _numbered(candidates(lib, file)[0], above)
    if max_files is not None:
        rows = rows.where(F.col("seq") <= above + max_files)
    rows = _kept(rows.join(old.select("path", F.col("seq").alias("__old")), "path", "left").withColumn("seq", F.coalesce("__old", "seq")).drop("__old"), "targets")
    paths = [r.path for r in rows.select("path").collect()]  # the files whose texts are read
    if not confirm(len(paths)):
        return dict.fromkeys(("checked", "updated", "cleared", "skipped", "failed"), 0)
    texts = files.extract(files.contents(lib.spark, paths), reader).where("error is null")
    papers = rows.join(texts, "path").select("seq", F.col("path").alias("source_path"), F.substring_index("path", "/", -1).alias("file_name"), "text", "tags", F.col("pdf_title").alias("title"))
    return enrich_papers(lib, _kept(papers, "papers"), transport, force, reverify)


