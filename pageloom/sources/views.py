"""Document-shaped views over the given tables.

Each function takes the session and a folder of parquet tables and returns a lazy
DataFrame over the whole of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from pageloom.functions import ranges
from pageloom.functions.binding import bind
from pageloom.functions.text import lines_per_page, wrap_lines, wrap_width
from pageloom.functions.geometry import PAPER
from pageloom.plans.scan import large_groups, row_index
from pageloom.plans.shared import materialize

WRAP = wrap_width(PAPER["a4"][0])
PER_PAGE = lines_per_page(PAPER["a4"][1])


def _stamp(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files of a table: another stamp, other rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return ";".join(sorted(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}" for s in files.listStatus(where)))


_schemas: dict[tuple[str, str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table; its footer is read once while its files stay the same, not at every use."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, _stamp(spark, path))
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


#: Session setting: how many parts to spread text tables over before costly work, if at all.
SPREAD = "spark.pageloom.spread"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed over as many parts as the session asks for; left as they are read without that setting."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), key) if parts else df


_written: dict[tuple[str, ...], DataFrame] = {}


def _view_key(spark: SparkSession, folder: str, name: str, sources: tuple[str, ...]) -> tuple[str, ...]:
    return (spark.sparkContext.applicationId, folder, name, *[_stamp(spark, f"{folder}/{t}.parquet") for t in sources])


def _once(spark: SparkSession, folder: str, name: str, sources: tuple[str, ...], make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A view that many queries start from, written to the shared folder once for the files its ``sources`` have now."""
    key = _view_key(spark, folder, name, sources)
    if key not in _written:
        _written[key] = materialize(make(spark, folder), name)
    return _written[key].select("*")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents with a page count; orders without lines are empty documents."""
    return _once(spark, folder, "docs", ("orders", "lineitem"), _docs)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """What a document says of itself, from its order."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(status == "O", "1.4").when(status == "F", "1.7").otherwise("2.0").alias("version"),
        (F.col("o_totalprice") > 150_000).alias("encrypted"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("author"),
        F.col("o_orderpriority").alias("subject"),
        status.alias("keywords"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise("desk").alias("creator"),
        F.lit(None).cast("string").alias("producer"),
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as pages, numbered 1.. within their order."""
    return _once(spark, folder, "pages", ("lineitem",), _pages)


_PAGE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def dealt_pages(spark: SparkSession, folder: str, columns: list[str], *, width: int | None = None) -> tuple[DataFrame, bool]:
    """Pages with some ``columns``, for a query that joins them to their documents once, and whether they lie by document.

    They are numbered where they are read, moved once with what these columns need and not written. Where
    the view is there already, or an order has more lines than one bucket, they come from the view instead.
    """
    lines = table(spark, folder, "lineitem")
    if _view_key(spark, folder, "pages", ("lineitem",)) in _written or not large_groups(lines, ["l_orderkey"], width).isEmpty():
        return pages(spark, folder).select("doc_id", "page_no", *columns), False
    # lines that tie in this much of the order are alike in these columns
    known = max([{"rotate": 1, "image_id": 2}.get(c, len(_PAGE_ORDER)) for c in columns], default=1)
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_PAGE_ORDER[:known]))
    return _as_pages(lines.withColumn("page_no", number)).select("doc_id", "page_no", *columns), True


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    counted = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        table(spark, folder, "orders")
        .join(counted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("doc_id"),
            F.col("o_orderpriority").alias("source"),
            F.col("o_custkey").alias("owner"),
            F.coalesce(F.col("n"), F.lit(0)).cast("int").alias("page_count"),
        )
    )


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    numbered = row_index(
        table(spark, folder, "lineitem"),
        ["l_orderkey"],
        _PAGE_ORDER,
        "page_no",
        F.shiftleft(F.col("l_linenumber").cast("long"), 40) + F.shiftright(F.col("l_partkey"), 14),
    )
    return _as_pages(numbered)


def _as_pages(numbered: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    return numbered.select(
        F.col("l_orderkey").alias("doc_id"),
        "page_no",
        F.col("l_partkey").alias("image_id"),
        F.col("l_quantity").alias("size_mb"),
        ((F.col("l_linenumber") % 4) * 90).cast("int").alias("rotate"),
        F.when(flag == "A", 595.0).when(flag == "N", 612.0).otherwise(842.0).alias("page_w"),
        F.when(flag == "A", 842.0).when(flag == "N", 792.0).otherwise(595.0).alias("page_h"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("crop_inset"),
    )


def _spec(key: Column) -> Column:
    turn = F.pmod(key, F.lit(10))
    texts = ["all", "1-3", "2-", "-2", "3-1", "1,1,2", " 1 , 2 ", "9-", "1,,2"]
    out = F.when(turn == 0, F.lit(texts[0]))
    for i, text in enumerate(texts[1:], 1):
        out = out.when(turn == i, F.lit(text))
    return out.otherwise(F.lit("0"))


def with_spec(df: DataFrame) -> DataFrame:
    """A page-range specification for every document, good and bad ones alike."""
    return df.withColumn("spec", _spec(F.col("doc_id")))


def specs(spark: SparkSession, folder: str) -> DataFrame:
    return ranges.read_spec(with_spec(spread(docs(spark, folder), "doc_id")))


def text_table(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as wrapped line arrays: doc_id, lines, page_count."""
    wrapped = bind(text_table(spark, folder).select("doc_id", "text"), F.struct(wrap_lines(F.col("text"), WRAP).alias("lines")))
    return wrapped.drop("text").withColumn("page_count", F.ceil(F.size("lines") / F.lit(float(PER_PAGE))).cast("int"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapped lines: doc_id, line_no, page_no, text. A text is one row, so no shuffle is needed."""
    wrapped = wrap_lines(F.col("text"), WRAP)
    return text_table(spark, folder).select("doc_id", F.posexplode(wrapped).alias("i", "text")).select(
        "doc_id",
        (F.col("i") + 1).alias("line_no"),
        (F.floor(F.col("i") / PER_PAGE) + 1).cast("int").alias("page_no"),
        "text",
    )


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per laid-out page with its lines joined.

    Pages are cut inside the row and only then made rows, so no page carries the lines
    of the others.
    """
    cut = F.transform(
        F.sequence(F.lit(1), F.col("page_count")),
        lambda p: F.array_join(F.slice("lines", (p - 1) * PER_PAGE + 1, F.lit(PER_PAGE)), "\n"),
    )
    joined = texts(spark, folder).select("doc_id", "page_count", cut.alias("pages"))
    return joined.select("doc_id", "page_count", F.posexplode("pages").alias("i", "text")).select(
        "doc_id", "page_count", (F.col("i") + 1).alias("page_no"), "text"
    )


_TAGGED = "<(h1|p|li|div|footer)(?: [^>]*)?>(?:<b>|<a [^>]*>)?([^<]*)"


def sized_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The visible lines of the web pages with a size and a left edge.

    doc_id, page_no, block_no, line_no, tag, text, size, x0; five lines make a page, a
    block is a run of three lines. Every second item has a bullet, some items hang
    below the one above, every third paragraph by half an em, and every seventh
    paragraph is set in one of eight larger sizes.
    """
    found = table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("html", F.lit(_TAGGED), F.lit(1)).alias("tag"),
                F.regexp_extract_all("html", F.lit(_TAGGED), F.lit(2)).alias("text"),
            )
        ).alias("i", "hit"),
    )
    tag, number, text = F.col("hit.tag"), F.col("i") + 1, F.trim("hit.text")
    large = (tag == "p") & (number % 7 == 0)
    return found.select(
        "doc_id",
        (F.floor(F.col("i") / 5) + 1).cast("int").alias("page_no"),
        (F.floor(F.col("i") / 3) + 1).cast("int").alias("block_no"),
        number.alias("line_no"),
        tag.alias("tag"),
        F.when((tag == "li") & (number % 2 == 0), F.concat(F.lit("• "), text)).otherwise(text).alias("text"),
        F.when(tag == "h1", 24.0).when(tag == "footer", 9.0).when(tag == "div", 10.0)
        .when(large, 14.0 + F.floor(number / 7) % 8).otherwise(12.0).alias("size"),
        F.when((tag == "li") & (number % 3 == 2), 108.0).when(tag == "li", 96.0).when(number % 3 == 0, 78.0).otherwise(72.0).alias("x0"),
    )


def outline(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as outline items listed in reading order with a level."""
    role = F.col("role")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("seq"),
        F.when(role == "system", 1).when(role == "user", 2).otherwise(3).alias("level"),
        F.col("text").alias("title"),
        (F.col("turn") + 1).cast("int").alias("page"),
    )


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, customers and orders as one forest: id, parent, tag, rot."""
    t = lambda name: table(spark, folder, name)
    no_tag, no_rot = F.lit(None).cast("string"), F.lit(None).cast("int")

    def node(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    parts = [
        t("region").select(node("r", "r_regionkey").alias("id"), no_tag.alias("parent"), F.col("r_name").alias("tag"), F.lit(0).alias("rot")),
        t("nation").select(
            node("n", "n_nationkey").alias("id"),
            node("r", "n_regionkey").alias("parent"),
            no_tag.alias("tag"),
            F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") % 4) * 90).cast("int").alias("rot"),
        ),
        t("customer").select(
            node("c", "c_custkey").alias("id"),
            node("n", "c_nationkey").alias("parent"),
            F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("tag"),
            no_rot.alias("rot"),
        ),
        t("orders").select(node("o", "o_orderkey").alias("id"), node("c", "o_custkey").alias("parent"), no_tag.alias("tag"), no_rot.alias("rot")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def refs(spark: SparkSession, folder: str) -> DataFrame:
    return tree(spark, folder).filter(F.col("parent").isNotNull()).select(F.col("parent").alias("src"), F.col("id").alias("dst"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("image_id"),
        (F.col("p_size") * 40).alias("px_w"),
        (F.col("p_size") * 30).alias("px_h"),
        (key % 10 == 0).alias("masked"),
        F.when(key % 5 == 0, "JPX").when(key % 5 == 1, "DCT").when(key % 5 != 2, "FLATE").alias("filter"),
        F.when(key % 7 == 0, "Indexed").when(key % 7 == 1, "DeviceCMYK").when(key % 7 == 2, "DeviceGray").when(key % 7 != 3, "DeviceRGB").otherwise("G").alias("colorspace"),
        F.when(key % 11 == 0, 4).otherwise(8).alias("bits"),
    )


def placements(spark: SparkSession, folder: str) -> DataFrame:
    """Uses of images with the size they are drawn at; a use that shows nothing has none."""
    shown = (F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 != 0)
    size = F.when(shown, F.col("l_quantity")).otherwise(0)
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("image_id"), F.col("l_orderkey").alias("doc_id"), (size * 12).alias("draw_w"), (size * 9).alias("draw_h")
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Text runs with boxes on the laid-out pages: fixed advance of 5.5 points."""
    slot = (F.col("line_no") - 1) % PER_PAGE
    return (
        lines(spark, folder)
        .filter(F.col("text") != "")
        .select(
            "doc_id",
            "page_no",
            "line_no",
            "text",
            F.lit(72.0).alias("x0"),
            (F.lit(72.0) + F.lit(5.5) * F.length("text")).alias("x1"),
            (F.lit(769.89) - F.lit(13.2) * slot - 11).alias("y0"),
            (F.lit(769.89) - F.lit(13.2) * slot).alias("y1"),
        )
    )


def rects(spark: SparkSession) -> DataFrame:
    """Three areas to redact, on page numbers shared by all documents."""
    rows = [(1, 1, 100.0, 600.0, 200.0, 700.0), (2, 2, 0.0, 0.0, 80.0, 800.0), (3, 1, 400.0, 100.0, 560.0, 140.0)]
    return spark.createDataFrame(rows, "rect_id int, page_no int, x0 double, y0 double, x1 double, y1 double")


def fields(spark: SparkSession, folder: str) -> DataFrame:
    """Four form fields for every user; the button is a check box, a push button or a radio group."""
    flags = F.when(F.col("doc_id") % 3 == 1, 1 << 16).when(F.col("doc_id") % 3 == 2, 1 << 15).otherwise(0)
    kinds = F.array(
        *[
            F.struct(
                F.lit(n).alias("name"), F.lit(t).alias("ftype"), F.lit(o).cast("string").alias("options"),
                (flags if t == "Btn" else F.lit(0)).alias("flags"), F.lit("on,off" if t == "Btn" else None).cast("string").alias("states"),
            )
            for n, t, o in (("view", "Tx", None), ("click", "Btn", None), ("signup", "Ch", "0,1,2"), ("purchase", "Sig", None))
        ]
    )
    users = table(spark, folder, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return users.select("doc_id", F.inline(kinds))


def values(spark: SparkSession, folder: str) -> DataFrame:
    """The newest value requested per user and field name."""
    newest = (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"))
        .agg(F.max("event_id").alias("e"))
    )
    even = F.col("e") % 2 == 0
    return newest.select(
        "doc_id",
        "name",
        F.when(even, "text").otherwise("bool").alias("kind"),
        F.when(even, (F.col("e") % 5).cast("string")).otherwise("true").alias("value"),
    )


def edits(spark: SparkSession, folder: str) -> DataFrame:
    return edits_of(table(spark, folder, "events"))


def edits_of(events: DataFrame) -> DataFrame:
    """Rotation edits from events, batch or stream."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("doc_id"),
        (F.col("event_id") % 7 + 1).cast("int").alias("page_no"),
        F.when(kind == "view", 90).when(kind == "click", 180).when(kind == "signup", -90).when(kind == "purchase", 270).otherwise(0).alias("degrees"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return jobs_of(table(spark, folder, "events"))


def jobs_of(events: DataFrame) -> DataFrame:
    """Queue actions from events, batch or stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.col("user_id").alias("job_id"),
        F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "click", "cancel").when(kind == "purchase", "done").otherwise("failed").alias("action"),
    )


def queues_of(jobs: DataFrame) -> DataFrame:
    """Jobs dealt to sixteen queues."""
    return jobs.select(F.pmod("job_id", F.lit(16)).alias("queue"), "seq", "job_id", "action")


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"), F.col("props").alias("payload"), F.col("event_id").alias("seq")
    )


def annots(spark: SparkSession, folder: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"),
        (key % 5 + 1).cast("int").alias("page_no"),
        key.alias("annot_id"),
        F.when(kind == "purchase", "Widget").when(kind == "click", "Link").when(kind == "signup", "Popup").when(kind == "view", "Highlight").otherwise("Stamp").alias("subtype"),
        (key % 3 != 0).alias("has_appearance"),
        (key % 11 == 0).alias("hidden"),
    )


def sample_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring embeddings as the sample arrays of two pages to compare."""
    vectors = table(spark, folder, "embeddings")
    left = vectors.filter(F.col("vec_id") % 2 == 0).select(F.col("vec_id").alias("pair_id"), F.col("embedding").alias("left_s"))
    right = vectors.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("right_s"))
    return left.join(right, "pair_id")


_LABELS = [
    ("1-URGENT", 1, "lower-roman", "", 1),
    ("1-URGENT", 3, "decimal", "A-", 1),
    ("2-HIGH", 2, "upper-alpha", "", 26),
    ("5-LOW", 1, "none", "Cover", 1),
    ("5-LOW", 2, "decimal", "", 1),
]


def label_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Label ranges by the priority of the order."""
    shape = "array<struct<start_page:int,style:string,prefix:string,first:int>>"
    chosen = F.lit(None).cast(shape)
    for source in sorted({row[0] for row in _LABELS}):
        rows = F.array(
            *[
                F.struct(F.lit(s).alias("start_page"), F.lit(st).alias("style"), F.lit(p).alias("prefix"), F.lit(f).alias("first"))
                for src, s, st, p, f in _LABELS
                if src == source
            ]
        )
        chosen = F.when(F.col("source") == source, rows.cast(shape)).otherwise(chosen)
    return docs(spark, folder).select("doc_id", "page_count", F.inline(chosen))


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("author"),
        F.col("lang").alias("subject"),
        F.lit(None).cast("string").alias("keywords"),
    )


def metadata_edits(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("doc_id") % 4
    return (
        table(spark, folder, "documents")
        .filter(turn != 3)
        .select(
            "doc_id",
            F.when(turn == 0, "set").otherwise("keep").alias("title_op"),
            F.lit("Untitled").alias("title_val"),
            F.when(turn == 1, "clear").otherwise("keep").alias("author_op"),
            F.when(turn == 2, "set").otherwise("keep").alias("keywords_op"),
            F.lit("a,b").alias("keywords_val"),
        )
    )


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as Markdown: the first line as a heading, sample constructs, then all other lines."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    fence = "```"
    return text_table(spark, folder).select(
        "doc_id",
        F.concat(
            F.lit("# "), title, F.lit(f"\n* item **one**\n\n\n{fence}\n# not a heading\n\n{fence}\n"), title,
            F.lit("\n---\n> quoted [label](http://x)\n\n---\n1. snake_case 2 * 3\n\n"), F.substr("text", F.length(title) + 2),
        ).alias("md"),
    )
