"""Text functions as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not tell two pieces of code apart.
CLONE_STOP_WORDS = (
    "self", "return", "true", "false", "nil", "none", "const", "var", "let", "the", "and", "for",
)
CHARS_PER_TOKEN = 3.5
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def normalize_identifier(name: Column) -> Column:
    """Lower case, without underscores, dashes and white space."""
    return F.regexp_replace(F.lower(name), r"[_\-\s]+", "")


def slug_words(text: Column, max_words: int = 6, max_len: int = 50) -> Column:
    """First words of the text, letters and digits only, joined by ``_``."""
    kept = F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")
    words = F.filter(F.split(kept, r"\s+"), lambda w: w != "")
    return F.substring(F.array_join(F.slice(words, 1, max_words), "_"), 1, max_len)


def slug_path(text: Column, max_len: int = 80) -> Column:
    """File-name safe form: word characters, dashes and ``_`` for spaces."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{N}_\s\-]", "")
    return F.substring(F.regexp_replace(strip(kept), r"\s+", "_"), 1, max_len)


def slug_file(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/"), F.lit("__")), F.lit("."), F.lit("_"))


def strip(text: Column) -> Column:
    """White space cut from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(*parts: Column, prefix: str = "") -> Column:
    """First 16 hex digits of SHA-256 over the joined parts."""
    digest = F.substring(F.sha2(F.concat(*parts), 256), 1, 16)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def full_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def has_words(text: Column, n: int) -> Column:
    """Whether ``word_count`` is ``n`` (2 or more) at least; reads no further than that."""
    return text.rlike(r"\S" + r"\s+\S+" * (n - 2) + r"\s+\S")


def token_count(text: Column, counter=None) -> Column:
    """Tokens of a text: white-space words, at least one.

    ``counter`` swaps in another column function, e.g. a pandas UDF over a
    model tokenizer.
    """
    if counter is not None:
        return counter(text)
    return F.greatest(F.lit(1), word_count(text))


def estimated_tokens(text: Column) -> Column:
    """Token estimate from the number of characters."""
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int")


def clone_tokens(source: Column) -> Column:
    """Distinct identifier tokens without stop words."""
    tokens = F.regexp_extract_all(F.lower(source), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.array_except(tokens, F.array(*[F.lit(w) for w in CLONE_STOP_WORDS]))


def search_tokens(text: Column) -> Column:
    """Lower-case words for keyword search, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: Column) -> Column:
    """Path below ``root``; unchanged when it lies elsewhere."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def repo_from_name(name: Column) -> Column:
    """Repository encoded in a node name, before the first ``__``."""
    return F.when(name.contains("__"), F.split(name, "__", 2)[0]).otherwise("unknown")


def node_name(repo: Column, file: Column, symbol: Column) -> Column:
    """Note name of a symbol: repository, file and symbol joined by ``__``."""
    return F.concat(F.concat_ws("__", F.replace(repo, F.lit("-"), F.lit("_")), slug_file(file), symbol), F.lit(".md"))


def qualified_name(repo: Column, file: Column, owner: Column, name: Column, joiner: str = ".") -> Column:
    """``repo/file/owner<joiner>name``; without an owner just the name."""
    tail = F.when(F.coalesce(owner, F.lit("")) == "", name).otherwise(F.concat(owner, F.lit(joiner), name))
    return F.concat_ws("/", repo, file, tail)


def first_present(*values: Column, default: str) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def clip(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def one_line(text: Column, limit: int, ellipsis: str = "") -> Column:
    """Leading characters with newlines turned to spaces."""
    flat = F.replace(clip(text, limit), F.lit("\n"), F.lit(" "))
    return F.concat(F.trim(flat), F.lit(ellipsis)) if ellipsis else flat


def signature_text(source: Column, max_lines: int = 5) -> Column:
    """Leading lines up to the first with a colon that is no comment."""
    lines = F.slice(F.split(source, "\n"), 1, max_lines)
    ends = F.transform(lines, lambda x: x.contains(":") & ~F.trim(x).startswith("#"))
    cut = F.array_position(ends, True)
    return strip(F.array_join(F.slice(lines, F.lit(1), F.when(cut > 0, cut.cast("int")).otherwise(max_lines)), " "))


def similarity_label(score: Column) -> Column:
    """Name of the relation a similarity stands for."""
    # Lower bounds of the three relations.
    return (
        F.when(score >= 0.95, "exact_copy")
        .when(score >= 0.80, "near_identical_fork")
        .when(score >= 0.60, "fork_with_modifications")
        .otherwise("different")
    )


def comment_above(lines: Column, line_start: Column, reach: int = 14, mark: str = "//") -> Column:
    """Comment lines right above a line (blank lines skipped), joined by spaces."""
    first = F.greatest(F.lit(1), line_start - reach)
    return _comment(_marked(F.slice(lines, first, F.greatest(F.lit(0), line_start - first)), mark), mark)


def comments_above(lines: Column, reach: int = 14, mark: str = "//") -> Column:
    """``comment_above`` of every line; each line is stripped once, not once for each line below it."""
    def of_all(rows: Column) -> Column:
        def of_line(i: Column) -> Column:
            first = F.greatest(F.lit(1), i - reach)
            return _comment(F.slice(rows, first, i - first), mark)

        return F.transform(F.sequence(F.lit(1), F.size(rows)), of_line)

    # A lambda's argument is computed once.
    return F.transform(F.array(_marked(lines, mark)), of_all)[0]


def _marked(lines: Column, mark: str) -> Column:
    """Lines as ``line`` (stripped) and ``said`` (what follows a mark)."""
    return F.transform(F.transform(lines, strip), lambda x: F.struct(x.alias("line"), strip(F.substr(x, F.lit(len(mark) + 1))).alias("said")))


def _comment(above: Column, mark: str) -> Column:
    """The comment that ends with the last of the marked lines."""
    def of(rows: Column) -> Column:
        stop = F.array_position(F.transform(rows, lambda x: (x["line"] != "") & ~x["line"].startswith(mark)), True).cast("int")
        taken = F.slice(rows, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rows)))
        kept = F.filter(taken, lambda x: x["line"] != "")
        return F.array_join(F.reverse(F.transform(kept, lambda x: x["said"])), " ")

    return F.transform(F.array(F.reverse(above)), of)[0]
