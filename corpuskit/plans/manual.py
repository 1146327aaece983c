"""Manual jobs: layout blocks to notes, snippets, tables, references, figures.

Within one page plain windows are used (a page is one bounded record); over
the pages of a document the scans run in buckets of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import extract as X
from corpuskit.functions import tags as G
from corpuskit.functions.text import slug_words, strip, token_count, word_count
from corpuskit.operators.scan import ordered_scan

PAGES_PER_BUCKET = 4096
# Which block types take part in which job.
PROSE_TYPES = ("prose", "subsection_heading", "section_heading")
REFERRING_TYPES = ("prose", "developer_note", "subsection_heading", "section_heading")
HEADING_TYPES = ("chapter_heading", "section_heading", "subsection_heading")
CAPTION_HOSTS = ("figure_region", "table_header", "code")
ORDINAL_TYPES = ("figure_region", "table_header", "code")
MIN_FIGURE_PX = 50

def _page_order():
    return Window.partitionBy("doc", "page").orderBy("block_idx")


def _page_so_far():
    return _page_order().rowsBetween(Window.unboundedPreceding, 0)


def _page_ahead():
    return _page_order().rowsBetween(Window.unboundedPreceding, -1)


def page_bucket(page: str = "page") -> Column:
    return F.floor(F.col(page) / PAGES_PER_BUCKET)


def typed_blocks(raw: DataFrame) -> DataFrame:
    """Blocks with their role; running headers and bullets are dropped."""
    kind = X.block_type(F.col("kind"), F.col("font"), F.col("size"), F.col("text"))
    return raw.withColumn("type", kind).where(F.col("type") != "skip")


def carry_headings(blocks: DataFrame) -> DataFrame:
    """Chapter, section and subsection in force at each block.

    A new chapter ends section and subsection, a new section the subsection.
    """
    def mark(kind):
        hit = (F.col("type") == kind) & (F.col("text") != "")
        return F.when(hit, F.struct("page", "block_idx", "text"))

    scanned = ordered_scan(
        blocks, ["doc"], ["page", "block_idx"], page_bucket(),
        last={"__ch": mark("chapter_heading"), "__se": mark("section_heading"), "__su": mark("subsection_heading")},
    )

    def place(c):
        return F.struct(F.col(f"{c}.page"), F.col(f"{c}.block_idx"))

    def open_since(c, *closers):
        test = F.col(c).isNotNull()
        for k in closers:
            test = test & (F.col(k).isNull() | (place(c) > place(k)))
        return F.when(test, F.col(f"{c}.text"))

    return (
        scanned.withColumn("chapter", F.col("__ch.text"))
        .withColumn("chapter_num", X.chapter_number(F.col("__ch.text")))
        .withColumn("section", open_since("__se", "__ch"))
        .withColumn("subsection", open_since("__su", "__ch", "__se"))
        .drop("__ch", "__se", "__su")
    )


def page_context(context_blocks: DataFrame) -> DataFrame:
    """Headings in force at the end of each page."""
    at_end = F.max_by(F.struct("chapter", "chapter_num", "section", "subsection"), "block_idx")
    return context_blocks.groupBy("doc", "page").agg(at_end.alias("c")).select("doc", "page", "c.*")


def pending_table_header(blocks: DataFrame) -> DataFrame:
    """Table header that code blocks of a page belong to; headings and captions end it."""
    ends = F.col("type").isin(*HEADING_TYPES, "caption")
    event = F.when(F.col("type") == "table_header", F.struct(F.col("text").alias("h"))).when(
        ends, F.struct(F.lit(None).cast("string").alias("h")))
    pending = F.last(event, True).over(_page_so_far())["h"]
    return blocks.withColumn("table_header", F.when(F.col("type") == "code", pending))


def attach_captions(blocks: DataFrame) -> DataFrame:
    """Caption and labels of each figure, table header and code block.

    A caption goes to the nearest such block before it on the page (the last
    caption wins), a figure label to the nearest figure before it.
    """
    host = F.last(F.when(F.col("type").isin(*CAPTION_HOSTS), F.col("block_idx")), True).over(_page_ahead())
    figure = F.last(F.when(F.col("type") == "figure_region", F.col("block_idx")), True).over(_page_ahead())
    marked = blocks.select(
        "doc", "page", "block_idx", "type", "text",
        F.when(F.col("type") == "caption", host).when(F.col("type") == "figure_label", figure).alias("host"))
    notes = marked.where("host is not null").groupBy("doc", "page", F.col("host").alias("block_idx")).agg(
        F.max_by("text", F.when(F.col("type") == "caption", F.col("block_idx"))).alias("caption"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == "figure_label", F.struct("block_idx", "text")))),
                    lambda s: s["text"]).alias("labels"))
    hosts = marked.where(F.col("type").isin(*CAPTION_HOSTS)).select("doc", "page", "block_idx", "type")
    return hosts.join(notes, ["doc", "page", "block_idx"], "left")


def page_ordinals(blocks: DataFrame) -> DataFrame:
    """Running number (from 0) of figures, tables and code blocks of a page."""
    w = Window.partitionBy("doc", "page", "type").orderBy("block_idx")
    return blocks.where(F.col("type").isin(*ORDINAL_TYPES)).withColumn("ordinal", F.row_number().over(w) - 1)


def _ordered_text(sep: str, column: str = "text") -> Column:
    items = F.sort_array(F.collect_list(F.struct("block_idx", F.col(column).alias("t"))))
    return F.array_join(F.transform(items, lambda s: s["t"]), sep)


def snippet_groups(blocks: DataFrame) -> DataFrame:
    """Code blocks of a page joined into snippets.

    Headers, captions and headings part two snippets; other blocks between
    code do not.
    """
    parts = F.col("type").isin("table_header", "caption", *HEADING_TYPES)
    header_event = F.when(F.col("type") == "table_header", F.struct(strip(F.col("text")).alias("h"))).when(
        parts, F.struct(F.lit(None).cast("string").alias("h")))
    marked = blocks.select(
        "doc", "page", "block_idx", "type", strip(F.col("text")).alias("text"),
        F.sum(parts.cast("int")).over(_page_so_far()).alias("grp"), F.last(header_event, True).over(_page_so_far())["h"].alias("header"),
        F.when(F.col("type") == "caption", strip(F.col("text"))).alias("cap"))
    # the caption that closes group g carries number g + 1
    codes = marked.where("type = 'code'").groupBy("doc", "page", "grp").agg(
        _ordered_text("\n").alias("content"), F.first("header", True).alias("table_header"))
    closers = marked.where("type = 'caption'").select("doc", "page", (F.col("grp") - 1).alias("grp"), F.col("cap").alias("caption"))
    return codes.join(closers, ["doc", "page", "grp"], "left")


def extract_snippets(context_blocks: DataFrame) -> DataFrame:
    """Snippets of a manual with language, names and ids ``C<page>.<n>``."""
    groups = snippet_groups(context_blocks).withColumn("token_count", token_count(F.col("content")))
    kept = groups.where((F.length(strip(F.col("content"))) >= 5) & (word_count(F.col("content")) >= 3))
    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy("grp"))
    return (
        kept.withColumn("snippet_id", F.concat(F.lit("C"), "page", F.lit("."), n))
        .withColumn("language", X.language_of(F.col("content")))
        .withColumn("function_name", X.function_name(F.col("content"), F.col("language")))
        .withColumn("struct_names", X.struct_names(F.col("content")))
        .join(page_context(context_blocks), ["doc", "page"], "left")
        .drop("grp")
    )


def table_groups(blocks: DataFrame) -> DataFrame:
    """Header, rows and caption of each table of a page, with its ordinal.

    A header opens a table, a caption closes it even when it is empty, the end
    of the page closes what has rows.  Empty tables count but are not kept.
    """
    live = blocks.where(strip(F.col("text")) != "").select("doc", "page", "block_idx", "type", strip(F.col("text")).alias("text"))
    after_caption = F.coalesce(F.lag(F.col("type") == "caption").over(_page_order()), F.lit(False))
    opens = ((F.col("type") == "table_header") | after_caption).cast("int")
    marked = live.withColumn("grp", F.sum(opens).over(_page_so_far()))
    groups = marked.groupBy("doc", "page", "grp").agg(
        F.max_by("text", F.when(F.col("type") == "table_header", F.col("block_idx"))).alias("header"),
        F.max_by("text", F.when(F.col("type") == "caption", F.col("block_idx"))).alias("caption"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == "code", F.struct("block_idx", "text")))),
                    lambda s: s["text"]).alias("row_texts"))
    counted = groups.where((F.size("row_texts") > 0) | F.col("caption").isNotNull())
    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy("grp"))
    return counted.withColumn("n", n).where(F.size("row_texts") > 0)


def extract_tables(context_blocks: DataFrame) -> DataFrame:
    """Tables of a manual with cells, readable text and component tags."""
    groups = table_groups(context_blocks).withColumn("headers", X.table_headers(F.col("header")))
    everything = F.concat_ws(" ", F.coalesce("header", F.lit("")), F.array_join("row_texts", " "), F.coalesce("caption", F.lit("")))
    return (
        groups.withColumn("rows", F.transform("row_texts", lambda r: X.row_cells(F.col("headers"), r)))
        .withColumn("structured_text", X.table_text(F.col("rows")))
        .withColumn("token_count", token_count(everything))
        .withColumn("hardware_components", G.tags_of(everything, G.TABLE_TAGS))
        .withColumn("table_id", F.concat(F.lit("T"), "page", F.lit("."), "n"))
        .join(page_context(context_blocks), ["doc", "page"], "left")
        .drop("grp", "n")
    )


def number_notes(notes: DataFrame) -> DataFrame:
    """Add ``note_no``, the running number of a note within its document."""
    return ordered_scan(notes, ["doc"], ["page", "block_idx"], page_bucket(), total={"note_no": F.lit(1)})


def extract_notes(context_blocks: DataFrame) -> DataFrame:
    """Developer notes with type, tags, code mentions and ids ``N<page>.<n>``."""
    text = strip(F.col("text"))
    notes = context_blocks.where((F.col("type") == "developer_note") & (F.length(text) >= 10)).withColumn("full_text", text)
    note_id = F.concat(F.lit("N"), "page", F.lit("."), "note_no")
    return (
        number_notes(notes.select("doc", "page", "block_idx", "full_text"))
        .withColumn("note_id", note_id)
        .withColumn("note_type", X.note_type(F.col("full_text")))
        .withColumn("content", X.note_body(F.col("full_text")))
        .withColumn("vault_note", F.concat(F.lit("TRM_Note__"), "note_id", F.lit("_"), slug_words(F.col("content")), F.lit(".md")))
        .withColumn("token_count", token_count(F.col("full_text")))
        .withColumn("hardware_mentions", G.tags_of(F.col("full_text"), G.NOTE_TAGS))
        .withColumn("code_mentions", X.code_mentions(F.col("full_text")))
        .withColumn("priority", F.lit("HIGH"))
        .join(page_context(context_blocks), ["doc", "page"], "left")
    )


def reference_mentions(blocks: DataFrame) -> DataFrame:
    """Mentions per referring page: ``doc, ref_type, identifier, page, mentions``."""
    live = blocks.where(F.col("type").isin(*REFERRING_TYPES))
    refs = live.select("doc", "page", F.explode_outer(X.references(F.col("text"))).alias("r")).where("r is not null")
    return refs.groupBy("doc", F.col("r.ref_type").alias("ref_type"), F.col("r.identifier").alias("identifier"), "page").agg(
        F.count("*").alias("mentions"))


def reference_targets(context_blocks: DataFrame) -> DataFrame:
    """Page of each section, figure and table; the last page that has it wins."""
    sections = page_context(context_blocks).select(
        "doc", F.lit("section").alias("ref_type"), F.regexp_extract(strip(F.col("section")), r"^(\d+\.[\d.]*)", 1).alias("identifier"), "page")
    captions = context_blocks.where("type = 'caption'")
    figures = captions.select("doc", F.lit("figure").alias("ref_type"), F.regexp_extract("text", r"^[Ff]igure\s+(\d+)", 1).alias("identifier"), "page")
    tables = captions.select("doc", F.lit("table").alias("ref_type"), F.regexp_extract("text", r"^[Tt]able\s+(\d+)", 1).alias("identifier"), "page")
    every = sections.unionByName(figures).unionByName(tables).where("identifier <> ''")
    return every.groupBy("doc", "ref_type", "identifier").agg(F.max("page").alias("target_page"))


def cross_references(context_blocks: DataFrame) -> DataFrame:
    """Cross-references per target: mention count, number of source pages, target page, note.

    The source pages themselves are the rows of ``reference_mentions``, which
    stays long: a chapter may be referred to from any number of pages.
    """
    rolled = reference_mentions(context_blocks).groupBy("doc", "ref_type", "identifier").agg(
        F.sum("mentions").alias("mention_count"), F.count("*").alias("source_pages"), F.min("page").alias("first_page"))
    return rolled.join(reference_targets(context_blocks), ["doc", "ref_type", "identifier"], "left").withColumn(
        "vault_note", X.reference_note(F.col("ref_type"), F.col("identifier")))


def figure_captions(images: DataFrame, context_blocks: DataFrame) -> DataFrame:
    """Figures of at least 50 px, the n-th with the n-th figure caption of its page."""
    big = images.where((F.col("width") >= MIN_FIGURE_PX) & (F.col("height") >= MIN_FIGURE_PX))
    in_page = Window.partitionBy("doc", "page").orderBy("block_idx")
    figures = big.withColumn("n", F.row_number().over(in_page))
    is_figure = F.col("text").startswith("Figure") | F.col("text").startswith("Fig.")
    captions = context_blocks.where((F.col("type") == "caption") & is_figure).select(
        "doc", "page", F.col("text").alias("caption"), F.row_number().over(in_page).alias("n"))
    return (
        figures.join(captions, ["doc", "page", "n"], "left")
        .withColumn("caption", F.coalesce("caption", F.lit("")))
        .withColumn("figure_id", F.concat(F.lit("Fig_"), "page", F.lit("_"), "image_idx"))
        .join(page_context(context_blocks), ["doc", "page"], "left")
    )


def chapter_rollup(pages: DataFrame) -> DataFrame:
    """Page range and number of distinct sections of each chapter."""
    chapter = F.coalesce(F.nullif("chapter", F.lit("")), F.lit("Uncategorized"))
    rows = pages.withColumn("chapter", chapter)
    return rows.groupBy("doc", "chapter").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("pages"),
        F.countDistinct(F.nullif("section", F.lit(""))).alias("section_count"))


def chapter_sections(pages: DataFrame) -> DataFrame:
    """Distinct sections of each chapter with the page they first appear on."""
    chapter = F.coalesce(F.nullif("chapter", F.lit("")), F.lit("Uncategorized"))
    return pages.withColumn("chapter", chapter).where("coalesce(section, '') <> ''").groupBy("doc", "chapter", "section").agg(
        F.min("page").alias("first_page"))
