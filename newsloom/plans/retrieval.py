"""The retrieval job: where to look for each document, and what to keep of what was found.

Fetching itself happens elsewhere.  ``fetch_plan`` lists the locations to fetch, in order;
fetch results come back as a table; ``choose_content`` picks the usable one per document
and ``outcomes`` turns picks into payloads and log entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fv
from newsloom.functions import text as tx
from newsloom.functions import urls
from newsloom.operators.captures import captures_per_document, is_redirect, usable_captures
from newsloom.operators.lookup import join_lookup
from newsloom.operators.policy import is_free
from newsloom.operators.quality import gate_views, sanitize_pdf
from newsloom.operators.redirects import chain_ends, redirect_edges
from newsloom.session import cut_lineage

KEY = ["dataset", "doc_id"]
GATED_STAGE, ARCHIVE_STAGE, LIVE_STAGE = 0, 1, 2
PLAN_COLUMNS = [
    *KEY, "stage_rank", "statuscode", "timestamp", "variant_no", "view", "location", "is_redirect",
]


def variant_rows(work: DataFrame, strict_scheme: bool = False) -> DataFrame:
    """One row per document and address variant, numbered from 1 in the order of trying."""
    variants = F.posexplode(urls.url_variants(F.col("url"), strict_scheme))
    exploded = work.select("*", variants.alias("_position", "variant"))
    return exploded.withColumn("variant_no", F.col("_position") + 1).drop("_position")


def index_plan(
    work: DataFrame, captures: DataFrame, strict_scheme: bool = False
) -> DataFrame:
    """Index queries still to be made: one per variant of each HTML document that has no
    captures on file."""
    pages = work.where(~urls.is_pdf(F.col("url")))
    missing = pages.join(captures_per_document(captures).select(*KEY), KEY, "left_anti")
    return variant_rows(missing, strict_scheme).select(
        *KEY, "variant_no", urls.index_url(F.col("variant")).alias("location")
    )


def _location(stage: int, variant_no: Column, view: str, location: Column) -> Column:
    return F.struct(
        F.lit(stage).alias("stage_rank"),
        variant_no.alias("variant_no"),
        F.lit(view).alias("view"),
        location.alias("location"),
    )


def direct_plan(
    work: DataFrame, templates: DataFrame, strict_scheme: bool = False
) -> DataFrame:
    """All locations but archived copies, in one pass over the work table.

    Files: their first address.  Gated pages: the policy locations, raw view only, from the
    caller's templates (one per method).  Pages whose index query did not fail: the live
    addresses.
    """
    routed = join_lookup(work, templates, ["method"], "left", KEY).withColumn(
        "_variants", urls.url_variants(F.col("url"), strict_scheme)
    )
    variants, template = F.col("_variants"), F.col("template")
    is_file = urls.is_pdf(F.col("url"))
    none = F.array().cast(
        "array<struct<stage_rank: int, variant_no: int, view: string, location: string>>"
    )
    first = F.slice(variants, 1, 1)
    files = F.transform(first, lambda v: _location(ARCHIVE_STAGE, F.lit(1), fv.PDF, v))
    gated = F.transform(
        variants,
        lambda v, i: _location(GATED_STAGE, i + 1, fv.RAW, urls.render_route(template, v)),
    )
    live = F.transform(variants, lambda v, i: _location(LIVE_STAGE, i + 1, fv.BOTH, v))
    is_gated = ~is_free(F.col("method")) & template.isNotNull()
    pages = F.concat(
        F.when(is_gated, gated).otherwise(none),
        F.when(F.col("_index_failed"), none).otherwise(live),
    )
    locations = F.explode(F.when(is_file, files).otherwise(pages)).alias("_planned")
    return routed.select(*KEY, locations).select(
        *KEY,
        "_planned.stage_rank",
        F.lit("").alias("statuscode"),
        F.lit("").alias("timestamp"),
        "_planned.variant_no",
        "_planned.view",
        "_planned.location",
        F.lit(False).alias("is_redirect"),
    )


def archive_plan(
    work: DataFrame, captures: DataFrame, allowed: list[str] | None = None
) -> DataFrame:
    """Locations of usable archived copies of the pages whose index query did not fail.

    Only copies of documents on the worklist are looked at; of equal ones one is kept.
    """
    pages = work.where(~urls.is_pdf(F.col("url")) & ~F.col("_index_failed")).select(*KEY)
    copies = usable_captures(captures, allowed).select(
        *KEY, "statuscode", "timestamp", "original"
    )
    return (
        join_lookup(copies, pages, KEY, "left_semi", ["timestamp", "original"])
        .distinct()
        .select(
            *KEY,
            F.lit(ARCHIVE_STAGE).alias("stage_rank"),
            "statuscode",
            "timestamp",
            F.lit(1).alias("variant_no"),
            F.lit(fv.BOTH).alias("view"),
            urls.capture_url(F.col("timestamp"), F.col("original")).alias("location"),
            is_redirect(F.col("statuscode")).alias("is_redirect"),
        )
    )


def mark_index_failures(work: DataFrame, index_errors: DataFrame | None) -> DataFrame:
    """Add ``_index_failed``: the archive could not be asked about this document."""
    if index_errors is None:
        return work.withColumn("_index_failed", F.lit(False))
    failed = index_errors.select(*KEY).distinct().withColumn("_index_failed", F.lit(True))
    marked = work.join(failed, KEY, "left")
    return marked.withColumn("_index_failed", F.coalesce("_index_failed", F.lit(False)))


def fetch_plan(
    work: DataFrame,
    captures: DataFrame,
    templates: DataFrame,
    index_errors: DataFrame | None = None,
    allowed: list[str] | None = None,
    strict_scheme: bool = False,
) -> DataFrame:
    """All locations to try, by ``(stage_rank, statuscode, timestamp, variant_no)``.

    ``work`` needs ``dataset, doc_id, url, method``.  Document files are fetched directly
    and from their first variant only.  Gated documents start with their policy location.
    Pages then go through archived copies to the live page; a document whose index query
    failed (``index_errors``) gets neither.
    """
    marked = mark_index_failures(work, index_errors)
    direct = direct_plan(marked, templates, strict_scheme)
    return direct.unionByName(archive_plan(marked, captures, allowed))


def follow_readers(results: DataFrame) -> DataFrame:
    """Fetch results in which a simplified view that only redirects is replaced by the view at the
    end of its redirects, which was fetched under that address; an end that was not fetched, or
    that a page does not name, makes the view empty.

    Only redirecting rows and the views they lead to are moved; the rest stays where it is.
    """
    views = results.select("location", tx.decode_utf8(F.col("reader")).alias("reader"))
    ends = chain_ends(redirect_edges(views, url="location")).select(
        F.col("from_url").alias("location"), "final_url"
    )
    ends = cut_lineage(ends)
    if ends.isEmpty():
        return results
    wanted = ends.where("final_url <> ''").select(F.col("final_url").alias("location")).distinct()
    fetched = results.where(F.col("error").isNull()).select("location", "reader")
    spread = ["location"]
    targets = join_lookup(fetched, wanted, ["location"], "left_semi", spread).dropDuplicates(["location"])
    targets = targets.select(F.col("location").alias("final_url"), F.col("reader").alias("_reader"))
    nothing = F.lit(b"").cast("binary")
    moved = (
        join_lookup(results, ends, ["location"], "inner", spread)
        .join(targets, "final_url", "left")
        .withColumn("reader", F.coalesce("_reader", nothing))
    )
    stay = join_lookup(results, ends.select("location"), ["location"], "left_anti", spread)
    return stay.unionByName(moved.select(*results.columns))


def judged(
    results: DataFrame, compatible: bool = False, contents: DataFrame | None = None
) -> DataFrame:
    """What the gate says about each fetch, without its bytes: one thin row per result that came
    without an error (key, location, attempt, raw_ok, reader_ok, file_ok).

    Pages are judged where they are read; no blob leaves the scan. Where many fetches of a document
    bring the same bytes, these may be a table of their own: ``contents`` (key, ``content``, ``raw``,
    ``reader``), to which the results point by ``content``. Each is then judged once."""
    attempt = F.col("attempt") if "attempt" in results.columns else F.lit(1)
    pointers = ["location", "http_status", attempt.cast("int").alias("attempt")]
    fetched = results.where(F.col("error").isNull())
    is_file = urls.is_pdf(F.col("location")) & (F.col("http_status") == 200)
    file_ok = ~tx.is_empty_payload(sanitize_pdf(F.col("raw"), compatible))
    if contents is None:
        rows, kept, file_ok = fetched.select(*KEY, *pointers, "raw", "reader"), ["location", "attempt"], is_file & file_ok
    else:
        rows, kept = contents.select(*KEY, "content", "raw", "reader"), ["content"]
    nothing = F.lit("")
    decoded = rows.withColumns(
        {
            "raw_text": F.coalesce(tx.decode_utf8(F.col("raw")), nothing),
            "reader_text": F.coalesce(tx.decode_utf8(F.col("reader")), nothing),
        }
    )
    verdicts = gate_views(decoded, "raw_text", "reader_text", compatible).select(
        *KEY,
        *kept,
        (F.col("raw_text") != "").alias("raw_ok"),
        (F.col("reader_text") != "").alias("reader_ok"),
        F.coalesce(file_ok, F.lit(False)).alias("file_ok"),
    )
    if contents is None:
        return verdicts
    return fetched.select(*KEY, "content", *pointers).join(verdicts, [*KEY, "content"]).select(
        *KEY,
        "location",
        "attempt",
        "raw_ok",
        "reader_ok",
        (F.coalesce(is_file, F.lit(False)) & F.col("file_ok")).alias("file_ok"),
    )


def choose(
    plan: DataFrame,
    results: DataFrame,
    compatible: bool = False,
    contents: DataFrame | None = None,
) -> DataFrame:
    """The fetch to keep per document, as a thin row: ``stage_rank, location, view, attempt,
    raw_ok, reader_ok`` (which of its views passed the gate).

    ``results`` has one row per fetch (``location, http_status, error, raw, reader``, and
    ``attempt`` where a location was tried again); document, location and attempt identify it.
    Of the fetches of one location the first that passes the gate counts, so that a good second
    try is not lost to a bad first one. A policy or live location counts in the first variant
    fetched without an error, and only if the gate leaves something of it; of the archived
    copies the first that passes the gate counts. Only thin rows are joined, and a single
    aggregate over them, reduced on the map side, decides per document. ``contents``: see ``judged``.
    """
    found = plan.select(*PLAN_COLUMNS).join(judged(results, compatible, contents), [*KEY, "location"])
    view = F.col("view")
    tried = found.withColumns(
        {
            "raw_ok": F.when(view == fv.PDF, F.col("file_ok")).otherwise(F.col("raw_ok")),
            "reader_ok": (view == fv.BOTH) & F.col("reader_ok"),
        }
    ).withColumn("accepted", F.col("raw_ok") | F.col("reader_ok"))
    content = [F.col(c) for c in ("location", "view", "accepted", "raw_ok", "reader_ok")]
    order = [(~F.col("accepted")).alias("rejected"), F.col("attempt")]
    by_variant = F.struct("variant_no", *order, *content)
    by_capture = F.struct("statuscode", "timestamp", *order, *content)

    def first(stage: int, item: Column) -> Column:
        in_stage = F.col("stage_rank") == stage
        # Copies that were rejected do not compete; variants do, whatever their content.
        if stage == ARCHIVE_STAGE:
            in_stage = in_stage & F.col("accepted")
        return F.min(F.when(in_stage, item))

    firsts = tried.groupBy(*KEY).agg(
        first(GATED_STAGE, by_variant).alias("_gated"),
        first(ARCHIVE_STAGE, by_capture).alias("_archive"),
        first(LIVE_STAGE, by_variant).alias("_live"),
    )

    def kept(name: str, stage: int) -> Column:
        column = F.col(name)
        names = ("location", "view", "attempt", "raw_ok", "reader_ok")
        fields = [column[c].alias(c) for c in names]
        return F.when(column["accepted"], F.struct(F.lit(stage).alias("stage_rank"), *fields))

    chosen = F.coalesce(
        kept("_gated", GATED_STAGE), kept("_archive", ARCHIVE_STAGE), kept("_live", LIVE_STAGE)
    )
    return firsts.select(*KEY, chosen.alias("_kept")).where("_kept IS NOT NULL").select(
        *KEY, "_kept.*"
    )


def with_content(
    chosen: DataFrame, results: DataFrame, contents: DataFrame | None = None
) -> DataFrame:
    """The chosen fetches with their bytes, ``raw`` and ``reader``; a view that did not pass the
    gate is empty.

    One hash join on the document, in which the thin side is the table and the blobs stream by:
    where ``results`` is stored in buckets of the document (``sources.fetches``), they are neither
    moved nor sorted. Location and attempt are compared in ranges, as equalities would become keys
    of the join and ask for other buckets. With ``contents`` (see ``judged``) these stream by, and
    the results only tell which of them was chosen.
    """
    attempt = F.col("attempt") if "attempt" in results.columns else F.lit(1)
    fetched = results.where(F.col("error").isNull())
    where = [F.col("location").alias("_location"), attempt.cast("int").alias("_attempt")]
    views = [F.col("raw").alias("_raw"), F.col("reader").alias("_reader")]
    names, wanted = ["location", "attempt"], chosen
    if contents is not None:
        pointers = fetched.select(*KEY, F.col("location"), attempt.cast("int").alias("attempt"), "content")
        wanted = chosen.join(pointers, [*KEY, "location", "attempt"])
        names, fetched, where = ["content"], contents, [F.col("content").alias("_content")]
    blobs = fetched.select(*KEY, *where, *views)
    same = F.lit(True)
    for name in names:
        same = same & (F.col(name) <= F.col(f"_{name}")) & (F.col(name) >= F.col(f"_{name}"))
    nothing = F.lit(b"").cast("binary")
    joined = blobs.join(wanted.hint("shuffle_hash"), KEY).where(same)
    return joined.select(
        *chosen.columns,
        F.when(F.col("raw_ok"), F.col("_raw")).otherwise(nothing).alias("raw"),
        F.when(F.col("reader_ok"), F.col("_reader")).otherwise(nothing).alias("reader"),
    )


def choose_content(plan: DataFrame, results: DataFrame, compatible: bool = False) -> DataFrame:
    """The content to keep per document: ``stage_rank, location, view, raw, reader`` and more;
    see ``choose`` and ``with_content``."""
    return with_content(choose(plan, results, compatible), results)


def content_kind(url: Column, raw: Column, reader: Column) -> Column:
    """PDF, BOTH, RAW, READER or NONE, by what a document has."""
    return kind_of(url, ~tx.is_empty_payload(raw), ~tx.is_empty_payload(reader))


def kind_of(url: Column, has_raw: Column, has_reader: Column) -> Column:
    """``content_kind`` of a document of which it is known what it has."""
    return (
        F.when(urls.is_pdf(url) & has_raw, fv.PDF)
        .when(urls.is_pdf(url), fv.NONE)
        .when(has_raw & has_reader, fv.BOTH)
        .when(has_raw, fv.RAW)
        .when(has_reader, fv.READER)
        .otherwise(fv.NONE)
    )


def outcomes(
    work: DataFrame,
    chosen: DataFrame,
    index_errors: DataFrame | None = None,
    thin: bool = False,
) -> DataFrame:
    """One row per work item with its new state, and its payload if ``chosen`` has contents;
    ``thin`` rows tell instead what ``with_content`` needs to fetch it.

    Nothing usable means FAILED with empty payloads, or INDEX_ERROR, which may be tried
    again, where the index query had failed.
    """
    joined = work.select(*KEY, "url").join(chosen, KEY, "left")
    failed = mark_index_failures(joined, index_errors)
    kept = F.col("location").isNotNull()
    state = (
        F.when(kept, fv.RETRIEVED)
        .when(F.col("_index_failed"), fv.INDEX_ERROR)
        .otherwise(fv.FAILED)
    )
    nothing = F.lit(b"").cast("binary")
    views = [name for name in ("raw", "reader") if name in chosen.columns]
    pointers = ["attempt", "raw_ok", "reader_ok"] if thin else []
    kind = kind_of(
        F.col("url"),
        F.coalesce("raw_ok", F.lit(False)),
        F.coalesce("reader_ok", F.lit(False)),
    )
    return failed.select(
        *KEY,
        "url",
        state.alias("state"),
        "stage_rank",
        "location",
        kind.alias("content_kind"),
        *(F.coalesce(name, nothing).alias(name) for name in views),
        *pointers,
    )
