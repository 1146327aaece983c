"""Inputs of the registered queries.

The given tables hold prose, pages, vectors, orders and events.  The roles the
library works on (source files, symbols, layout blocks, commits, query
history ...) are derived from whole given tables by the statements below.
They are written in SQL that Spark and other engines read alike, so a query
and its SQL twin start from the same rows.  ``@name@`` refers to a given table
or to another statement.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from corpuskit.session import bounded_batches, spread_scan

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# tables whose rows take real work to parse
TEXT_TABLES = ("documents", "pages")


def text_template(template: str) -> str:
    """SQL ``concat`` for a text with ``<<expression>>`` holes.

    Newlines, quotes and braces become ``chr()`` calls, which every engine reads alike.
    """
    out = []
    for i, part in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2:
            out.append(part)
            continue
        for piece in re.split(r"([\n{}\"\\'])", part):
            if piece and piece in "\n{}\"\\'":
                out.append(f"chr({ord(piece)})")
            elif piece:
                out.append(f"'{piece}'")
    return "concat(" + ", ".join(out) + ")"


_PY = text_template('''import os
import pkg<<doc_id % 11>>.core
from mod<<doc_id % 9>>.sub import thing
from .local import helper
class Doc<<doc_id % 50>>(Base):
    """Holds <<lang>> document <<doc_id>>."""
    def load_<<doc_id % 7>>(self, x):
        # motor_ctrl uses the pid_loop
        return x

    @cached
    def save_all(self,
                 y):
        return self.load_<<doc_id % 7>>(y)

    def quote_all(self, rows={"a": "}"}):
        text = """
def not_a_function(x):
class NotAClass:
    {
""" + \'\'\'
# "
def neither(x):
\'\'\'
        return [text, "# {", '"', {  # (
    "one": 1,
}]

def run_<<doc_id % 13>>(a):
    return a
# <<body>>''')
_GO = text_template('''package main

import (
    "fmt"
    core "example.org/r<<doc_id % 9>>/core"
    "example.org/r1<<doc_id % 5>>/util"
)

// Store keeps <<lang>> rows
// for the encoder
type Store<<doc_id % 31>> struct {
    rows []string
}

// Load reads wifi state

func (s *Store<<doc_id % 31>>) Load(x int) error {
    if x > 1 {
        return nil
    }
    return nil
}

func Quote(x int) string { // {
    s := `}
func Hidden(x int) int {
` // {
    if x == '}' || x == '\\'' {
        return "{\\"{"
    }
    return s /* }
type Hidden struct {
*/
}

func Run<<doc_id % 17>>(x int) int {
    return x
}
// <<body>>''')
_C = text_template('''#include <stdio.h>
typedef struct node_<<doc_id % 23>> {
    uint8_t GPIO_PIN;
} node_t;

static int read_cliff_<<doc_id % 19>>(uint8_t *buf)
{
    if (buf) {
        return 1;
    }
    return 0;
}

int find_brace(const char *s)
{
    char c = '}'; // {
    /* }
int hidden_call(int x) {
    */
    return s[0] == c ? "}\\"{"[0] : '\\'';
}
// <<body>>''')
_JS = text_template('''const x = require("x");
class View<<doc_id % 29>> {
    draw() {
        return 1;
    }
}

function quote_all(a) { // {
    const open = '{', tick = `}
function hidden(a) {
`;
    /* {
class Hidden {
    */
    return a + "}" + open;
}

function render_<<doc_id % 13>>(a) {
    return a;
}
// <<body>>''')
_PROTO = text_template('''syntax = "proto3";
message Row<<doc_id % 37>> {
    string text = 1;
    message Inner {
        int32 n = 1;
    }
}
service Api<<doc_id % 5>> {
    rpc Get<<doc_id % 11>>(Row<<doc_id % 37>>) returns (Row<<doc_id % 37>>);
}
message Quoted {
    string open = 1 [default = "}"]; // }
    /* }
message Hidden {
    */
    string close = 2 [default = '{'];
}
enum Kind { A = 0; B = 1; }
// <<body>>''')

_FOLDER = ("CASE WHEN doc_id % 40 = 7 THEN 'vendor/' WHEN doc_id % 40 = 11 THEN 'lib/gen/' "
           "WHEN doc_id % 40 = 13 THEN '.cache/' ELSE concat('pkg', doc_id % 7, '/') END")
_STEM = ("CASE WHEN doc_id % 60 = 10 THEN 'test_mod' WHEN doc_id % 60 = 21 THEN 'mod' ELSE 'mod' END")
_EXT = ("CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 60 = 20 THEN '_pb2.py' ELSE '.py' END "
        "WHEN 1 THEN CASE WHEN doc_id % 60 = 21 THEN '_test.go' ELSE '.go' END "
        "WHEN 2 THEN '.c' WHEN 3 THEN '.js' ELSE '.proto' END")

# Statements both engines read alike.
PORTABLE: dict[str, str] = {
    # every document as one source file of one of five languages
    "src_files": f"""
        SELECT doc_id, source AS repo, concat({_FOLDER}, {_STEM}, doc_id, {_EXT}) AS path,
               CASE doc_id % 5 WHEN 0 THEN {_PY} WHEN 1 THEN {_GO} WHEN 2 THEN {_C}
                    WHEN 3 THEN {_JS} ELSE {_PROTO} END AS text
        FROM (SELECT doc_id, source, lang,
                     replace(text, chr(10), concat(chr(10), CASE doc_id % 5 WHEN 0 THEN '# ' ELSE '// ' END)) AS body
              FROM @documents@) d""",
    # every document as one symbol
    "symbols": """
        SELECT doc_id, source AS repo,
               concat('docs/', lang, '/file_', doc_id % 211, '.', lang) AS file,
               CASE doc_id % 4 WHEN 0 THEN concat('Get', upper(substr(lang, 1, 1)), 'Item_', doc_id % 97)
                    WHEN 1 THEN concat('st_', doc_id % 11) WHEN 2 THEN concat('GPIO_', doc_id % 9)
                    ELSE concat('do_regbank', doc_id % 5, '_x') END AS name,
               CASE doc_id % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class'
                    WHEN 3 THEN 'struct' WHEN 4 THEN 'type' ELSE 'enum' END AS type,
               lang AS language, doc_id % 400 + 1 AS line_start, doc_id % 400 + 9 AS line_end,
               text AS source, n_chars
        FROM @documents@""",
    # every customer declares a package and a module of its repository
    "manifests": f"""
        SELECT concat('src', c_custkey % 20) AS repo,
               CASE c_custkey % 4 WHEN 0 THEN 'setup.py' WHEN 1 THEN 'go.mod' WHEN 2 THEN 'pyproject.toml'
                    ELSE concat('pkg', c_custkey % 11, '/__init__.py') END AS path,
               CASE c_custkey % 4 WHEN 0 THEN {text_template('setup(name="Mod<<c_custkey % 13>>", v=1)')}
                    WHEN 1 THEN {text_template('// <<c_name>>\nmodule example.org/r<<c_custkey % 12>>\n\ngo 1.20')}
                    WHEN 2 THEN {text_template('[project]\nname = "my-app<<c_custkey % 15>>"')} ELSE '' END AS text
        FROM @customer@""",
    "commits": """
        SELECT concat('repo', o_custkey % 20) AS repo, concat('f', o_custkey, '.go') AS path,
               concat('c', lpad(concat('', o_orderkey), 9, '0')) AS sha,
               o_orderpriority AS author, o_orderdate AS ts
        FROM @orders@""",
    "files_of_commits": """
        SELECT concat('repo', c_custkey % 20) AS repo, concat('f', c_custkey, '.go') AS path, c_name AS title
        FROM @customer@""",
    # every event as one answered query
    "history": f"""
        SELECT event_id AS id, concat('s', user_id % 40) AS session_id, event_id % 500 AS query_id, ts,
               event_type, user_id, concat('ask ', event_type, ' ', user_id) AS query,
               CASE WHEN event_id % 10 = 3 THEN NULL ELSE {text_template(
                   '[{"filename":"repo__<<user_id % 30>>","snippet":"a","score":<<event_id % 9>>},'
                   '{"filename":"repo__<<event_id % 30>>","snippet":"b","score":<<user_id % 9>>}]')} END AS sources,
               {text_template('{"retrieve":<<event_id % 900>>,"generate":<<user_id * 7>>,"validate":<<event_id % 5>>}')} AS phases,
               {text_template('{"system":2000,"context":<<event_id % 20000>>,"chat_history":<<user_id * 60>>}')} AS token_usage,
               value, props
        FROM @events@""",
    # every document as one generated answer, in five shapes
    "generations": f"""
        SELECT doc_id AS gen_id, source AS ctx_id, doc_id % 4 AS attempts,
               concat(text, chr(10),
                      CASE WHEN doc_id % 4 <> 0 THEN concat('## Stack Trace & Sources', chr(10)) ELSE '' END,
                      CASE doc_id % 3 WHEN 0 THEN concat('[[file_', doc_id % 6, ']]')
                           WHEN 1 THEN concat('[[file_', doc_id % 50, '|alias]] [[file_', doc_id % 3, ']]')
                           ELSE 'file_1' END) AS generation
        FROM @documents@""",
    # what each generation was given as context
    "contexts": """
        SELECT DISTINCT source AS ctx_id, concat('file_', doc_id % 7) AS source
        FROM @documents@ WHERE source <> 'src3'""",
    "vectors": """
        SELECT vec_id, label, embedding,
               CASE label % 5 WHEN 0 THEN 'repo_code' WHEN 1 THEN 'trm_prose' WHEN 2 THEN 'trm_code'
                    WHEN 3 THEN 'trm_tables' ELSE 'trm_notes' END AS collection,
               concat('repo', vec_id % 6) AS repo, concat('sym_', vec_id % 40) AS symbol_name,
               concat('repo', vec_id % 6, '__file_', vec_id % 50) AS file
        FROM @embeddings@""",
    # benchmark items ask with the vector of the same number
    "vector_queries": """
        SELECT b.item_id AS query_id, e.embedding AS query_vec, concat('repo', b.item_id % 6) AS repo,
               concat('sym_', b.item_id * 3) AS wanted
        FROM @benchmark@ b JOIN @embeddings@ e ON b.item_id = e.vec_id""",
    "chunk_rows": """
        SELECT doc_id, concat('k', doc_id) AS chunk_id, text AS content, source AS repo,
               concat('file_', doc_id % 211) AS file, lang AS language,
               CASE doc_id % 7 WHEN 0 THEN 'trm_code' WHEN 1 THEN 'trm_table' WHEN 2 THEN 'trm_prose'
                    WHEN 3 THEN 'trm_note' WHEN 4 THEN 'odd' ELSE 'repo_code' END AS content_type,
               doc_id % 13 AS line_start, n_chars
        FROM @documents@""",
}

# Tags of a page that become layout blocks, in document order.
BLOCK_TAG_PATTERN = "<(h1|p|b|br|a|div|footer|title)(?: [^>]*)?>([^<]+)"

_RAW_BLOCKS = f"""
    SELECT doc, page, block_idx,
           CASE WHEN tag = 'title' THEN 1 ELSE 0 END AS kind,
           CASE tag WHEN 'h1' THEN CASE WHEN page % 5 = 0 THEN 'Garamond-Bold' ELSE 'Tahoma-Bold' END
                WHEN 'a' THEN CASE WHEN block_idx % 4 = 1 THEN 'Verdana-Bold' ELSE 'TrebuchetMS' END
                WHEN 'div' THEN 'Arial-BoldItalic' WHEN 'b' THEN 'Tahoma' WHEN 'br' THEN 'Arial'
                WHEN 'footer' THEN 'Calibri' WHEN 'title' THEN NULL ELSE 'TimesNewRoman' END AS font,
           CAST(CASE tag WHEN 'h1' THEN CASE WHEN page % 5 = 0 THEN 16 ELSE 12 END WHEN 'a' THEN 8
                WHEN 'div' THEN 9 WHEN 'b' THEN 11 WHEN 'br' THEN 9 ELSE 10 END AS DOUBLE) AS size,
           CASE tag
             WHEN 'title' THEN ''
             WHEN 'h1' THEN CASE WHEN page % 5 = 0 THEN concat('Chapter ', page % 20, ' ', text)
                                 ELSE concat(page % 7 + 1, '.', page % 3 + 1, ' ', text) END
             WHEN 'a' THEN CASE block_idx % 4
                 WHEN 1 THEN concat('REGBANK', page % 4, '  Name  Value')
                 WHEN 2 THEN concat('GPIO_', page % 9, '  ', text, '  0x1F')
                 WHEN 3 THEN concat('void set_', text, '(uint8_t pin) motor')
                 ELSE concat('typedef struct st_', page % 11, ' ', chr(123), ' ', text) END
             WHEN 'div' THEN concat(CASE WHEN page % 2 = 0 THEN 'Figure ' ELSE 'Table ' END, page % 9, ' ', text)
             WHEN 'b' THEN concat(page % 7 + 1, '.', page % 3 + 1, '.1 ', text)
             WHEN 'footer' THEN concat(CASE page % 7 WHEN 0 THEN 'NOTE: ' WHEN 1 THEN 'WARNING: ' WHEN 2 THEN 'Important: '
                 WHEN 3 THEN 'CAUTION: ' WHEN 4 THEN 'DESIGN DECISION: ' WHEN 5 THEN 'Design Note: ' ELSE '' END,
                 'call set_pin(0x', page % 8, 'F) over SPI; ', text)
             ELSE CASE WHEN block_idx % 3 = 0
                 THEN concat(text, ' See Section ', page % 7 + 1, '.', page % 3 + 1, ', Figure ', page % 9,
                             ', Table ', page % 5, '; Chapter ', page % 20, ', Appendix B and fig. 3')
                 ELSE text END
           END AS text,
           page % 3 * 40 + 30 AS width, page % 4 * 30 + 20 AS height
    FROM @tagged@"""
PORTABLE["raw_blocks"] = _RAW_BLOCKS

# Twins only: what the Spark side computes with library calls.
ORACLE_ONLY: dict[str, str] = {
    "tagged": f"""
        SELECT regexp_extract(url, '://([^/]+)', 1) AS doc, page_id AS page, pos - 1 AS block_idx, tag, trim(raw) AS text
        FROM (SELECT url, page_id, unnest(tags) AS tag, unnest(texts) AS raw, generate_subscripts(tags, 1) AS pos
              FROM (SELECT url, page_id, regexp_extract_all(html, '{BLOCK_TAG_PATTERN}', 1) AS tags,
                           regexp_extract_all(html, '{BLOCK_TAG_PATTERN}', 2) AS texts FROM pages))""",
}

COMMON_TABLES: dict[str, str] = {name: name for name in ()}
COMMON_TABLES.update({k: v for k, v in PORTABLE.items()})
COMMON_TABLES.update(ORACLE_ONLY)


def oracle_table(name: str, sql: str) -> None:
    """Name a statement that SQL twins may build on."""
    COMMON_TABLES[name] = sql


def plain_bases(sql: str) -> str:
    for base in BASE_TABLES:
        sql = sql.replace(f"@{base}@", base)
    return sql


for _name in list(COMMON_TABLES):
    COMMON_TABLES[_name] = plain_bases(COMMON_TABLES[_name])


class Inputs:
    """Given tables and stand-ins of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        bounded_batches(spark)
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        frames = self.__dict__["_frames"]
        if name not in frames:
            if name in BASE_TABLES:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                frames[name] = spread_scan(frame) if name in TEXT_TABLES else frame
            elif name in PORTABLE:
                frames[name] = self._portable(PORTABLE[name])
            else:
                raise AttributeError(name)
        return frames[name]

    def _portable(self, sql: str) -> DataFrame:
        refs = set(re.findall(r"@(\w+)@", sql))
        args = {r: getattr(self, r) for r in refs}
        return self.spark.sql(re.sub(r"@(\w+)@", r"{\1}", sql), **args)

    @cached_property
    def tagged(self) -> DataFrame:
        from corpuskit.sources.files import html_blocks

        return html_blocks(self.pages, BLOCK_TAG_PATTERN)

    @cached_property
    def blocks(self) -> DataFrame:
        from corpuskit.plans.manual import typed_blocks

        return typed_blocks(self.raw_blocks)

    @cached_property
    def context_blocks(self) -> DataFrame:
        from corpuskit.plans.manual import carry_headings

        return carry_headings(self.blocks)

    @cached_property
    def block_table(self) -> DataFrame:
        """Blocks with their headings, written once for jobs that read them more than once."""
        from corpuskit.plans.manual import carry_headings
        from corpuskit.session import materialize

        # Headings are carried in two passes; markup is parsed in one.
        return materialize(carry_headings(materialize(self.blocks, "typed-blocks")), "blocks")
