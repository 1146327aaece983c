"""Pattern functions over code and manual text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import strip

# Substrings that give a language away, tried in this order.
LANGUAGE_HINTS = (
    ("c", ("void ", "uint8_t", "uint32_t", "#define", "->", "typedef struct", "#include",
           "int32_t", "uint16_t", "int8_t")),
    ("go", ("func ", "package ", ":= ", "chan ", "goroutine")),
    ("python", ("def ", "class ", "self.", "import ", "    ")),
    ("protobuf", ("message ", "service ", "rpc ", "repeated ", "syntax =")),
    ("javascript", ("function ", "const ", "let ", "var ", "=>", "require(")),
)
# The hint list of the layout scan differs in two languages.
SCAN_LANGUAGE_HINTS = (
    ("c", ("void ", "uint8_t", "uint32_t", "#define", "typedef struct", "->", "#include",
           "int32_t", "uint16_t")),
    ("go", ("func ", "package ", ":= ", "chan ", "goroutine", "go func", "type ", "struct {")),
) + LANGUAGE_HINTS[2:]
# Code mentions worth keeping from a note.
CODE_MENTION_PATTERNS = (
    r"\b\w+_\w+\s*\(", r"uint\d+_t", r"int\d+_t", r"\bPID\b", r"\bSPI\b", r"\bUART\b",
    r"\bI2C\b", r"\bGPIO\b", r"\bPWM\b", r"0x[0-9a-fA-F]+", r"\b[A-Z][A-Z_]{3,}\b",
)
# Prefixes of notes, tried in this order.
NOTE_PREFIXES = ("WARNING:", "IMPORTANT:", "CAUTION:", "DESIGN DECISION:", "DESIGN NOTE:", "NOTE:")
# How a manual refers to its own parts.
REFERENCE_PATTERNS = (
    (r"[Ss]ection\s+(\d+\.[\d.]+)", "section"),
    (r"[Ss]ec\.\s*(\d+\.[\d.]+)", "section"),
    (r"[Cc]hapter\s+(\d+)", "chapter"),
    (r"[Cc]h\.\s*(\d+)", "chapter"),
    (r"[Ff]igure\s+(\d+)", "figure"),
    (r"[Ff]ig\.\s*(\d+)", "figure"),
    (r"[Tt]able\s+(\d+)", "table"),
    (r"[Aa]ppendix\s+([A-Z\d]+)", "appendix"),
    (r"[Ll]isting\s+(\d+)", "listing"),
)
# File names that are tests or generated code.
SKIPPED_FILE_PATTERN = (
    r"^.*_test\.go$|^test_.*\.py$|^.*_pb2\.py$|^.*_pb2_grpc\.py$|^.*\.pb\.go$"
)


def any_of(text: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def language_of(text: Column, hints=LANGUAGE_HINTS) -> Column:
    """Language guessed from telling substrings; the first match wins."""
    chain = None
    for language, needles in hints:
        test = any_of(text, needles)
        if language == "python":
            test = test & ~text.contains("=>")
        chain = F.when(test, language) if chain is None else chain.when(test, language)
    return chain.when(strip(text).rlike(r"^\d+\s+\d+\s+\w+"), "c_struct").otherwise("unknown")


def function_name(text: Column, language: Column) -> Column:
    """Name of the function a snippet starts with, NULL if none."""
    first = strip(F.split(strip(text), "\n")[0])
    name = (
        F.when(language == "c", F.regexp_extract(first, r"^(?:\w[\w\s*]+\s+)(\w+)\s*\(", 1))
        .when(language == "go", F.regexp_extract(first, r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)\s*\(", 1))
        .when(language == "python", F.regexp_extract(first, r"^def\s+(\w+)\s*\(", 1))
    )
    return F.nullif(name, F.lit(""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    # (?U): word characters and boundaries follow Unicode
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def struct_names(text: Column, limit: int = 10) -> Column:
    """Type and register names of a snippet: distinct, sorted, at most ``limit``."""
    names = F.concat(
        _all(text, r"typedef\s+struct\s+(\w+)"),
        _all(text, r"struct\s+(\w+)\s*\{"),
        _all(text, r"\b([A-Z][A-Z_]{2,})\b"),
    )
    return F.slice(F.sort_array(F.array_distinct(names)), 1, limit)


def code_mentions(text: Column, limit: int = 10) -> Column:
    """Code-like mentions of a note: distinct, sorted, at most ``limit``."""
    found = F.concat(*[_all(text, p, 0) for p in CODE_MENTION_PATTERNS])
    return F.slice(F.sort_array(F.array_distinct(F.transform(found, strip))), 1, limit)


def caps_words(text: Column, pattern: str = r"\b([A-Z][A-Z_]{3,})\b") -> Column:
    return F.array_distinct(_all(text, pattern))


def note_type(text: Column) -> Column:
    prefix = F.regexp_extract(text, "^(?i)(" + "|".join(p[:-1] for p in NOTE_PREFIXES) + "):", 1)
    return F.when(prefix != "", F.replace(F.upper(prefix), F.lit(" "), F.lit("_"))).otherwise("NOTE")


def note_body(text: Column) -> Column:
    """Note text without its type prefix."""
    marked = "^(?i)(?:" + "|".join(NOTE_PREFIXES) + r")([\s\S]*)$"
    return F.when(text.rlike(marked), strip(F.regexp_extract(text, marked, 1))).otherwise(text)


def references(text: Column) -> Column:
    """All cross-references of a text as ``array<struct<ref_type, identifier>>``."""
    def of_kind(kind):
        return lambda x: F.struct(F.lit(kind).alias("ref_type"), x.alias("identifier"))

    return F.concat(*[F.transform(_all(text, p), of_kind(kind)) for p, kind in REFERENCE_PATTERNS])


def reference_note(kind: Column, ident: Column) -> Column:
    """Name of the note a reference leads to."""
    return (
        F.when(kind == "section", F.concat(F.lit("TRM_Ch_Sec"), F.replace(ident, F.lit("."), F.lit("_"))))
        .when(kind == "figure", F.concat(F.lit("TRM_Figure__Fig_"), ident))
        .when(kind == "table", F.concat(F.lit("TRM_Table__T"), ident))
        .when(kind == "chapter", F.concat(F.lit("TRM_Ch"), F.when(F.length(ident) < 2, F.lpad(ident, 2, "0")).otherwise(ident)))
        .otherwise(F.concat(F.lit("TRM_"), kind, F.lit("_"), ident))
    )


def citations(text: Column) -> Column:
    """Targets of ``[[target]]``, ``[[target|label]]`` and ``[[target#part]]``."""
    return _all(text, r"\[\[([^\]|#]+)")


def chapter_number(text: Column) -> Column:
    """Number of a chapter heading, also of a letter-spaced one."""
    plain = F.nullif(F.regexp_extract(F.lower(text), r"chapter\s+(\d+)", 1), F.lit(""))
    spaced = F.nullif(F.regexp_extract(text, r"C\s*H\s*A\s*P\s*T\s*E\s*R\s+(\d+)", 1), F.lit(""))
    return F.coalesce(plain, spaced).cast("int")


def skipped_file(name: Column) -> Column:
    return name.rlike(SKIPPED_FILE_PATTERN)


def block_type(kind: Column, font: Column, size: Column, text: Column) -> Column:
    """Role of a layout block from its font, size and leading text."""
    name = F.coalesce(font, F.lit(""))
    has = name.contains
    small = size <= 9
    starts_note = text.rlike("^(?i)(" + "|".join(NOTE_PREFIXES) + ")")
    # Fonts and sizes that mark each role, tried in this order.
    return (
        F.when((kind == 1) | font.isNull(), "figure_region")
        .when(has("Franklin Gothic") | has("Wingdings") | has("Symbol"), "skip")
        .when(has("Garamond") & (size >= 14), "chapter_heading")
        .when(has("Tahoma") & has("Bold") & (size >= 12), "section_heading")
        .when(has("Tahoma") & (size >= 11), "subsection_heading")
        .when(has("Arial") & has("Bold") & (size >= 11) & ~has("Italic"), "subsection_heading")
        .when(has("Calibri") & has("Bold") & (size >= 12), "section_heading")
        .when(has("Trebuchet") & small, "code")
        .when(has("Verdana") & has("Bold") & small, "table_header")
        .when(has("Arial") & has("BoldItalic") & small, "caption")
        .when(has("Arial") & small, "figure_label")
        .when(has("Verdana") & has("Italic"), "prose")
        .when(starts_note, "developer_note")
        .otherwise("prose")
    )


def split_columns(text: Column) -> Column:
    """Cells of a table row: two or more spaces part them."""
    return F.transform(F.split(text, r"\s{2,}"), strip)


def table_headers(text: Column) -> Column:
    return F.filter(split_columns(F.coalesce(text, F.lit(""))), lambda h: h != "")


def row_cells(headers: Column, row: Column) -> Column:
    """One table row as ``array<struct<key, value>>`` in header order.

    A row with too few cells, or a table with fewer than two headers, becomes
    one cell named ``data``.
    """
    cells = split_columns(row)
    fits = (F.size(headers) > 1) & (F.size(cells) >= F.size(headers) - 1)
    named = F.transform(headers, lambda h, i: F.struct(
        h.alias("key"), F.coalesce(F.get(cells, i), F.lit("")).alias("value")))
    return F.when(fits, named).otherwise(F.array(F.struct(F.lit("data").alias("key"), row.alias("value"))))


def table_text(rows: Column) -> Column:
    """Readable text of a table: ``key: value`` cells, ``|`` between rows."""
    def row_text(row):
        kept = F.filter(row, lambda c: strip(c["value"]) != "")
        return F.array_join(F.transform(kept, lambda c: F.concat(c["key"], F.lit(": "), c["value"])), ". ")

    return F.array_join(F.transform(rows, row_text), " | ")
