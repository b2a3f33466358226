"""Form data, attachments, layers, metadata edits, signature listings and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import is_blank

PUSHBUTTON = 1 << 16
RADIO = 1 << 15
SHOWN_OPTIONS = 8


def read_form_data(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON objects of string or boolean values to rows: (values, rejects). ``rows``: doc_id, json."""
    parsed = rows.select("doc_id", F.try_parse_json("json").alias("v"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    pairs = parsed.filter(is_object).select("doc_id", F.explode(F.from_json(F.to_json("v"), "map<string,string>")).alias("name", "text"), "v")
    kind = F.schema_of_variant(F.try_variant_get("v", F.lit("$"), "map<string,variant>")[F.col("name")])
    typed = pairs.withColumn("type", kind)
    word = (
        F.when(F.col("type") == "VOID", "null")
        .when(F.col("type").startswith("ARRAY"), "list")
        .when(F.col("type").startswith("OBJECT"), "object")
        .otherwise("number")
    )
    wrong = typed.filter(~F.col("type").isin("STRING", "BOOLEAN"))
    rejects = wrong.groupBy("doc_id").agg(
        F.min_by(F.concat(F.lit("value of "), F.col("name"), F.lit(" is "), word), "name").alias("detail")
    ).unionByName(
        parsed.filter(F.col("v").isNull() | ~is_object).select("doc_id", F.lit("not an object").alias("detail"))
    ).select("doc_id", F.lit("InvalidFormData").alias("error"), "detail")
    ok = typed.join(rejects.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "name", F.when(F.col("type") == "STRING", "text").otherwise("bool").alias("kind"), F.col("text").alias("value")
    )
    return ok, rejects


def _shown(options: Column) -> Column:
    names = F.array_join(F.slice(options, 1, SHOWN_OPTIONS), ", ")
    return F.when(F.size(options) > SHOWN_OPTIONS, F.concat(names, F.lit(", …"))).otherwise(names)


def form_fill(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Outcome of every requested value: filled, not_found or unsupported with a reason.

    ``fields``: doc_id, name, ftype, options, optionally flags and states.
    """
    have = set(fields.columns)
    extra = [
        F.col("flags") if "flags" in have else F.lit(0).alias("flags"),
        F.col("states") if "states" in have else F.lit(None).cast("string").alias("states"),
    ]
    known = fields.select("doc_id", "name", "ftype", "options", *extra, F.lit(True).alias("__known"))
    options, states = F.split("options", ","), F.split("states", ",")
    text = F.col("kind") == "text"

    def not_in(listed: Column, what: str) -> Column:
        return F.concat(F.lit(f"no {what} "), F.col("value"), F.lit(" among: "), _shown(listed))

    on = ~text & (F.col("value") == "true")
    reason = (
        F.when(F.col("ftype").isNull(), F.lit("untyped"))
        .when(F.col("ftype") == "Sig", F.lit("signature"))
        .when(~F.col("ftype").isin("Tx", "Btn", "Ch"), F.concat(F.lit("type "), F.col("ftype")))
        .when((F.col("ftype") == "Tx") & ~text, F.lit("text wanted"))
        .when((F.col("ftype") == "Btn") & (F.col("flags").bitwiseAND(PUSHBUTTON) != 0), F.lit("pushbutton"))
        .when(
            (F.col("ftype") == "Btn") & text & states.isNotNull() & ~F.array_contains(states, F.col("value")),
            not_in(states, "choice"),
        )
        .when((F.col("ftype") == "Btn") & on & (F.col("flags").bitwiseAND(RADIO) != 0), F.lit("choice name wanted"))
        .when((F.col("ftype") == "Ch") & ~text, F.lit("option wanted"))
        .when((F.col("ftype") == "Ch") & options.isNotNull() & ~F.array_contains(options, F.col("value")), not_in(options, "option"))
    )
    joined = values.join(known, ["doc_id", "name"], "left").withColumn("__reason", F.when(F.col("__known"), reason))
    outcome = (
        F.when(F.col("__known").isNull(), "not_found").when(F.col("__reason").isNotNull(), "unsupported").otherwise("filled")
    )
    return joined.select("doc_id", "name", outcome.alias("outcome"), F.col("__reason").alias("reason"))


def form_report(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Counts per document, as a merged summary of :func:`form_fill`."""
    one = lambda o: F.sum(F.when(F.col("outcome") == o, 1).otherwise(0)).alias(o)
    return form_fill(values, fields).groupBy("doc_id").agg(one("filled"), one("not_found"), one("unsupported"))


def attachments(adds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current attachments (the newest of a name wins) and adds refused for a blank name."""
    blank = is_blank(F.col("name"))
    ok = (
        adds.filter(~blank)
        .groupBy("doc_id", "name")
        .agg(F.max_by("payload", "seq").alias("payload"))
        .select("doc_id", "name", "payload", F.octet_length("payload").cast("long").alias("size"))
    )
    rejects = adds.filter(blank).select("doc_id", "seq", F.lit("InvalidAttachment").alias("error"))
    return ok, rejects


def extract_attachments(current: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = asked.join(current, ["doc_id", "name"])
    missing = asked.join(current.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    return found.select("doc_id", "name", "payload", "size"), missing.select("doc_id", "name", F.lit("NoSuchAttachment").alias("error"))


def layer_visibility(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """Visible unless the last edit of the layer hid it. ``edits``: doc_id, name, seq, visible."""
    last = edits.groupBy("doc_id", "name").agg(F.max_by("visible", "seq").alias("v"))
    return layers.select("doc_id", "name").distinct().join(last, ["doc_id", "name"], "left").select(
        "doc_id", "name", F.coalesce("v", F.lit(True)).alias("visible")
    )


def layer_rejects(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of layers that do not exist, or of documents without layers."""
    known = layers.select("doc_id", "name").distinct()
    have = known.select("doc_id").distinct().withColumn("__any", F.lit(True))
    return (
        edits.select("doc_id", "name").distinct()
        .join(known, ["doc_id", "name"], "left_anti")
        .join(have, "doc_id", "left")
        .select("doc_id", "name", F.when(F.col("__any"), "NoSuchLayer").otherwise("NoLayers").alias("error"))
    )


def metadata_edit(current: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """Set, clear or leave each field; fields without an edit column stay as they are."""
    joined = current.join(edits, "doc_id", "left")
    have = set(edits.columns)

    def edited(f: str) -> Column:
        if f"{f}_op" not in have:
            return F.col(f)
        value = F.col(f"{f}_val") if f"{f}_val" in have else F.lit(None).cast("string")
        return F.when(F.col(f"{f}_op") == "set", value).when(F.col(f"{f}_op") == "clear", F.lit(None)).otherwise(F.col(f))

    return joined.select("doc_id", *[F.nullif(edited(f), F.lit("")).alias(f) for f in fields])


def signature_fields(listings: DataFrame) -> DataFrame:
    """Each object once, from the first source that lists it. ``listings``: doc_id, obj, src, name."""
    return listings.groupBy("doc_id", "obj").agg(F.min("src").alias("src"), F.min_by("name", "src").alias("name"))


def verify_digest(signed: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Hash the two committed spans again and compare with the recorded digest.

    ``signed``: doc_id, span (array of offsets), digest; ``contents``: doc_id, content (binary),
    one for each doc_id. Without ``contents``, ``signed`` has the content beside the digest,
    and ids may repeat. Being intact says nothing about trust.
    """
    span, raw = F.col("span"), F.col("content")
    o1, l1, o2, l2 = (F.get(span, F.lit(i)) for i in range(4))
    inside = (
        (F.array_min(span) >= 0) & (o1 + l1 <= o2) & (o2 + l2 <= F.octet_length(raw))
    )
    again = F.sha2(F.concat(F.substr(raw, o1 + 1, l1), F.substr(raw, o2 + 1, l2)), 256)
    reason = (
        F.when(span.isNull(), "no range")
        .when(F.size(span) != 4, F.concat(F.lit("range of "), F.size(span).cast("string"), F.lit(" numbers")))
        .when(~inside, "range outside the content")
        .when(F.col("digest").isNull(), "no digest")
        .when(again != F.col("digest"), "changed")
    )
    both = signed if contents is None else signed.join(contents, "doc_id")
    return both.select("doc_id", reason.isNull().alias("intact"), F.coalesce(reason, F.lit("equal")).alias("reason"))
