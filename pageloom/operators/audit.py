"""Audits and edits of whole documents: repair, conformance, cleaning, OCR, flattening, edits, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.plans.graph import walk_chain
from pageloom.plans.scan import Running, running
from pageloom.plans.shared import materialize

# What an archival document must not carry.
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
LAUNCH = r'(?i) href="file:[^"]*"'
EXTERNAL = r'(?i) href="[^#"][^"]*"'


def repair_audit(objects: DataFrame, reached: DataFrame) -> DataFrame:
    """Per document: wrong lengths (bytes), unreachable objects, repeated numbers, missing root.

    ``objects``: doc_id, id, obj_no, declared, content; ``reached``: id.
    """
    flagged = objects.join(reached.select("id").distinct().withColumn("__r", F.lit(1)), "id", "left")
    return (
        flagged.groupBy("doc_id")
        .agg(
            F.sum(F.when(F.col("declared") != F.octet_length("content"), 1).otherwise(0)).alias("wrong_length"),
            F.sum(F.when(F.col("__r").isNull(), 1).otherwise(0)).alias("unreachable"),
            (F.count(F.lit(1)) - F.count_distinct("obj_no")).alias("repeated"),
            (~F.bool_or(F.col("obj_no") == 0)).alias("missing_root"),
        )
        .withColumn(
            "is_clean",
            (F.col("wrong_length") == 0) & (F.col("unreachable") == 0) & (F.col("repeated") == 0) & ~F.col("missing_root"),
        )
    )


def last_definitions(objects: DataFrame) -> DataFrame:
    """The surviving definition of every object number: the last one scanned wins."""
    return objects.groupBy("doc_id", "obj_no").agg(F.max("id").alias("id"))


def lost_objects(scanned: DataFrame, table: DataFrame, encryption: DataFrame) -> DataFrame:
    """Ids seen by a scan but absent from the table, without the encryption entry."""
    return scanned.join(table, ["doc_id", "id"], "left_anti").join(encryption, ["doc_id", "id"], "left_anti")


def sanitize(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Remove scripts, launches and external links one after another, counting each."""
    text = F.col(html)
    counts: list[Column] = []
    for name, pattern in (("javascript_removed", SCRIPT), ("launch_removed", LAUNCH), ("external_removed", EXTERNAL)):
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(name))
        text = F.regexp_replace(text, pattern, "")
    return pages.select(key, *counts, text.alias("clean"))


def conformance(docs: DataFrame) -> DataFrame:
    """One row per issue. ``docs``: doc_id, html, encrypted, part, version, embedded.

    Rules of part 1 apply only where part 1 is claimed.
    """
    html = F.col("html")
    rules = [
        (F.col("encrypted"), "encrypted"),
        (html.rlike(SCRIPT), "script"),
        (html.rlike(LAUNCH), "launch"),
        (html.rlike(EXTERNAL), "external reference"),
        (F.col("part").isNull(), "no conformance claim"),
        (~F.col("embedded"), "font not embedded"),
        ((F.col("part") == 1) & (F.col("version") != "1.4"), "part 1 needs version 1.4"),
        ((F.col("part") == 1) & html.rlike("(?i)opacity"), "part 1 forbids transparency"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return docs.select("doc_id", F.explode(found).alias("issue"))


def conformance_summary(docs: DataFrame) -> DataFrame:
    issues = conformance(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(issues, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("issues"), F.col("n").isNull().alias("conformant")
    )


def strip_identifying(info: DataFrame, secret: str) -> DataFrame:
    """Every info key counted and dropped, metadata rows counted, a fresh id derived.

    ``info``: doc_id, props (JSON object), is_metadata. The id is keyed, so a re-run agrees.
    """
    keys = F.coalesce(F.size(F.map_keys(F.from_json("props", "map<string,string>"))), F.lit(0))
    return info.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("is_metadata"), keys).otherwise(0)).alias("info_keys_removed"),
        F.sum(F.col("is_metadata").cast("int")).alias("metadata_removed"),
        F.first(F.sha2(F.concat(F.lit(secret), F.col("doc_id").cast("string")), 256)).alias("new_id"),
    )


def ocr_triage(pages: DataFrame) -> DataFrame:
    """Pages in all, with text, needing recognition, and with nothing found.

    ``pages``: doc_id, page_no, text_len, found_len (what recognition gave).
    """
    need = F.col("text_len") == 0
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        one(~need).alias("already_text"),
        one(need).alias("needed"),
        one(need & (F.col("found_len") == 0)).alias("nothing_found"),
    )


def flatten_report(annots: DataFrame, *, forms_only: bool = False, annots_only: bool = False) -> DataFrame:
    """What flattening bakes, skips and drops per document.

    ``annots``: doc_id, page_no, subtype, has_appearance, hidden.
    """
    if forms_only and annots_only:
        raise ValueError("InvalidFlattenOptions")
    widget = F.col("subtype") == "Widget"
    chosen = widget if forms_only else ~widget if annots_only else F.lit(True)
    shown = chosen & ~F.col("hidden")
    baked = shown & F.col("has_appearance")
    skipped = shown & ~F.col("has_appearance") & ~F.col("subtype").isin("Link", "Popup")
    stays = ~chosen | (shown & ~F.col("has_appearance"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per_page = annots.groupBy("doc_id", "page_no").agg(
        one(baked & widget).alias("w"), one(baked & ~widget).alias("a"), one(skipped).alias("s"), one(stays & widget).alias("left")
    )
    no_widget = F.sum("left") == 0
    return per_page.groupBy("doc_id").agg(
        F.sum("w").alias("widgets_flattened"),
        F.sum("a").alias("annots_flattened"),
        F.sum("s").alias("skipped"),
        one(F.col("w") + F.col("a") > 0).alias("pages_flattened"),
        (no_widget if not annots_only else F.lit(False)).alias("form_removed"),
    )


def edit_fold(edits: DataFrame) -> DataFrame:
    """Rotation left on every page after all edits; full turns vanish."""
    return (
        edits.groupBy("doc_id", "page_no")
        .agg(F.pmod(F.sum("degrees"), F.lit(360)).cast("int").alias("rotation"))
        .filter(F.col("rotation") != 0)
    )


def dirty_documents(edits: DataFrame, saved: DataFrame) -> DataFrame:
    """Documents whose folded edits differ from what was saved."""
    now, then = edit_fold(edits), edit_fold(saved).withColumnRenamed("rotation", "was")
    return (
        now.join(then, ["doc_id", "page_no"], "full_outer")
        .filter(~F.col("rotation").eqNullSafe(F.col("was")))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("changed_pages"))
    )


def job_state_columns() -> list[Column]:
    """Aggregates that fix a job's state, in batch and in a stream.

    Cancelling works only while a job waits, so the state is the last action other than a
    cancel, made ``cancelled`` when that is ``queued`` and a cancel came later.
    """
    other = F.when(F.col("action") != "cancel", F.col("seq"))
    return [
        F.max_by("action", other).alias("last_action"),
        F.max(other).alias("last_seq"),
        F.max(F.when(F.col("action") == "cancel", F.col("seq"))).alias("cancel_seq"),
        F.max(F.when(F.col("action") == "queued", 1)).alias("was_queued"),
    ]


def job_status_of(folded: DataFrame) -> DataFrame:
    state = F.when((F.col("last_action") == "queued") & (F.col("cancel_seq") > F.col("last_seq")), F.lit("cancelled")).otherwise(
        F.col("last_action")
    )
    return folded.filter(F.col("was_queued") == 1).select(
        "job_id", state.alias("status"), state.isin("done", "failed", "cancelled").alias("finished")
    )


def job_status(events: DataFrame) -> DataFrame:
    """Latest state of every job that was ever queued."""
    return job_status_of(events.groupBy("job_id").agg(*job_state_columns()))


def queue_run(events: DataFrame, *, width: int | None = None) -> DataFrame:
    """Outcome of every event (queue, seq, job_id, action) of queues that run one job at a time.

    A job may start while none runs (else AlreadyRunning), end while it runs (NotRunning)
    and be cancelled while it waits (NotWaiting). ``seq`` is unique in a queue. Which
    starts hold depends on those before: each start leads to the first one after its own
    job's end, so the starts that hold are a chain, followed by pointer doubling however
    long a queue is. Everything else is windows over buckets of the queue.
    """
    action, seq = F.col("action"), F.col("seq")
    end = action.isin("done", "failed")
    rows = materialize(events.select("queue", seq.cast("long").alias("seq"), F.col("job_id").cast("long").alias("job_id"), "action"), "queue")
    ahead = running(rows, ["queue"], "seq", {"next_start": Running("min", F.when(action == "running", seq), inclusive=False)}, width=width, descending=True)
    ended = F.when(end, F.struct(seq.alias("seq"), F.col("next_start").alias("next")))
    starts = running(ahead, ["queue", "job_id"], "seq", {"end": Running("last", ended, inclusive=False)}, width=width, descending=True).filter(action == "running")
    starts = materialize(starts.select("queue", F.col("seq").alias("node"), F.col("end.next").alias("next"), F.col("end.seq").alias("end")), "starts")
    first = starts.groupBy("queue").agg(F.min("node").alias("node"))
    held = walk_chain(starts, first, ["queue"], []).select("queue", "node")
    held = materialize(starts.join(held, ["queue", "node"]), "held")
    counts = held.select("queue", F.col("node").alias("seq")).unionByName(held.filter("end is not null").select("queue", F.col("end").alias("seq"))).withColumn("__held", F.lit(True))
    marked = rows.join(counts, ["queue", "seq"], "left")
    matters = F.when(F.col("__held") | action.isin("queued", "cancel"), action)
    known = running(marked, ["queue", "job_id"], "seq", {"before": Running("last", matters, inclusive=False)}, width=width)
    reason = (
        F.when((action == "running") & F.col("__held").isNull(), "AlreadyRunning")
        .when(end & F.col("__held").isNull(), "NotRunning")
        .when((action == "cancel") & ~F.coalesce(F.col("before") == "queued", F.lit(False)), "NotWaiting")
        .when(~F.coalesce(action.isin("queued", "running", "done", "failed", "cancel"), F.lit(False)), "UnknownAction")
    )
    return known.select("queue", "seq", "job_id", "action", reason.isNull().alias("accepted"), reason.alias("reason"))
