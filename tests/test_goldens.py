"""Small cases with values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import extract as X
from corpuskit.functions import formats as M
from corpuskit.functions import text as S
from corpuskit.operators.embedding import map_points
from corpuskit.plans import answers, code, history, manual, vault
from corpuskit.plans.reindex import reindex_file, write_file_chunks
from corpuskit.session import run_dir
from corpuskit.sources import tables, versions
from corpuskit.sources.files import manifest_modules, manifest_packages, read_notes, read_source_tree
from corpuskit.sources.note_writer import write_notes
from corpuskit.streaming import jobs


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()
    return row["r"]


@pytest.mark.parametrize("distance,score", [(0.4, 0.8), (0.8, 0.6)])
def test_l2_scores(spark, distance, score):
    assert one(spark, F.round(M.score_of(F.col("d"), "l2"), 3), d=distance) == score


@pytest.mark.parametrize("name,repo", [("python-sdk__some_file", "python-sdk"), ("no_double_underscore", "unknown"), ("alpha__beta__gamma", "alpha")])
def test_repo_from_name(spark, name, repo):
    assert one(spark, S.repo_from_name(F.col("n")), n=name) == repo


def test_similarity_labels(spark):
    got = [one(spark, S.similarity_label(F.col("s")), s=s) for s in (0.96, 0.85, 0.65, 0.40)]
    assert got == ["exact_copy", "near_identical_fork", "fork_with_modifications", "different"]


def test_identifier_and_notes(spark):
    assert one(spark, S.normalize_identifier(F.col("n")), n="Set_Motor-Speed x") == "setmotorspeedx"
    assert one(spark, X.note_type(F.col("t")), t="Design Decision: keep") == "DESIGN_DECISION"
    assert one(spark, X.note_body(F.col("t")), t="WARNING:  hot\nplate") == "hot\nplate"
    assert one(spark, X.chapter_number(F.col("t")), t="C H A P T E R 12") == 12
    assert one(spark, X.reference_note(F.lit("chapter"), F.col("i")), i="7") == "TRM_Ch07"


ANSWERS = [
    ("pass", "text\n## Stack Trace & Sources\n[[file_a]]", ["file_a"]),
    ("missing_sources_section", "text [[file_a]]", ["file_a"]),
    ("missing_wikilinks", "## Stack Trace & Sources\nfile_a", ["file_a"]),
    ("hallucinated_source", "## Stack Trace & Sources\n[[other]]", ["file_a"]),
    ("bypass", "anything", []),
]


def test_validation_cases(spark):
    gens = spark.createDataFrame([(i, i, g) for i, (_, g, _) in enumerate(ANSWERS)], "gen_id int, ctx_id int, generation string")
    ctx = spark.createDataFrame([(i, s) for i, (_, _, srcs) in enumerate(ANSWERS) for s in srcs], "ctx_id int, source string")
    got = {r["gen_id"]: r["verdict"] for r in answers.validate(gens, ctx).collect()}
    assert got == {i: want for i, (want, _, _) in enumerate(ANSWERS)}
    assert {r["violation"] for r in answers.ledger(answers.validate(gens, ctx)).collect()} == {"missing_sources_section", "missing_wikilinks", "hallucinated_source"}


@pytest.mark.parametrize("verdict,attempts,again", [("hallucinated_source", 1, True), ("hallucinated_source", 3, False), ("pass", 1, False)])
def test_retry(spark, verdict, attempts, again):
    assert one(spark, answers.needs_retry(F.col("v"), F.col("a")), v=verdict, a=attempts) is again


def test_memory_keeps_last_entries(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(6)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert history.memory_block(turns, 4).first()["memory"] == "[USER]: m2\n[ASSISTANT]: m3\n[USER]: m4\n[ASSISTANT]: m5"


def test_heatmap_counts(spark):
    src = '[{"filename":"file_a","snippet":"","score":1},{"filename":"file_b","snippet":"","score":1}]'
    rows = [(1, "2024-01-01", src), (2, "2024-01-02", '[{"filename":"file_a","snippet":"","score":1}]'), (3, "2024-01-03", None)]
    df = spark.createDataFrame(rows, "id int, ts string, sources string").withColumn("phases", F.lit("{}")).withColumn("token_usage", F.lit("{}"))
    assert [tuple(r) for r in history.heatmap(df).collect()] == [("file_a", 2, "2024-01-02"), ("file_b", 1, "2024-01-01")]


def test_log_tail(spark):
    lines = spark.range(200).select(F.lit("log").alias("log"), F.col("id").alias("line_no"))
    rows = tables.tail(lines, ["log"], "line_no", 100).collect()
    assert len(rows) == 100 and {r["total_lines"] for r in rows} == {200} and min(r["line_no"] for r in rows) == 100


def test_drift_states(spark):
    day = datetime.datetime(2024, 1, 10)
    files = spark.createDataFrame([("old", day), ("same", day), ("new", day), ("blank", day)], "file string, mtime timestamp_ntz")
    idx = spark.createDataFrame([("old", True, day - datetime.timedelta(days=3)), ("same", True, day), ("blank", True, None)], "file string, indexed boolean, indexed_at timestamp_ntz")
    got = {r["file"]: (r["status"], r["delta_days"]) for r in vault.index_drift(files, idx, "file").collect()}
    assert got == {"old": ("drifted", 3.0), "same": ("fresh", None), "blank": ("fresh", None), "new": ("never_indexed", None)}


PYTHON = '''import os
from .near import x

class Motor(Base):
    """Drives wheels."""

    def start(self, speed):
        """Spin up."""
        def inner():
            pass
        return speed

    @wrapped
    def stop(self):
        pass


def main(
    a,
):
    return a
'''
GO = '''package main

import (
	"fmt"
	core "example.org/core/v2"
)

// Run drives
// the motor
func (m *Motor) Run(x int) {
	if x > 0 {
		fmt.Println(x)
	}
}

type Motor struct {
	n int
}
'''
PROTO = '''syntax = "proto3";
message Pose {
  float x = 1;
}
service Drive {
  rpc Go(Pose) returns (Pose);
}
enum Mode { A = 0; }
'''
C = '''struct node {
  int n;
};
static int read_pin(int pin,
  int mode)
{
  return pin;
}
'''


def test_source_tree_and_symbols(spark, tmp_path):
    for name, body in {"r1/m.py": PYTHON, "r1/pkg/m.go": GO, "r2/a.proto": PROTO, "r2/x.c": C, "r2/vendor/v.go": GO, "r1/test_m.py": PYTHON, "r1/readme.txt": "x",
                       "r1/empty.py": ""}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    files = read_source_tree(spark, str(tmp_path))
    assert {(r["repo"], r["path"]) for r in files.collect()} == {("r1", "m.py"), ("r1", "pkg/m.go"), ("r2", "a.proto"), ("r2", "x.c")}
    syms = {(r["language"], r["name"]): r for r in code.extract_symbols(files).collect()}
    spans = {k: (r["type"], r["class_context"], r["line_start"], r["line_end"]) for k, r in syms.items()}
    assert spans == {
        ("python", "Motor"): ("class", "", 4, 15), ("python", "start"): ("method", "Motor", 7, 11), ("python", "stop"): ("method", "Motor", 14, 15),
        ("python", "main"): ("function", "", 18, 21), ("go", "Run"): ("method", "(m *Motor)", 10, 14), ("go", "Motor"): ("struct", "", 16, 18),
        ("protobuf", "Pose"): ("struct", "", 2, 4), ("protobuf", "Drive"): ("interface", "", 5, 7), ("protobuf", "Go"): ("function", "", 6, 6),
        ("protobuf", "Mode"): ("enum", "", 8, 9), ("c", "node"): ("struct", "", 1, 3), ("c", "read_pin"): ("function", "", 4, 8)}
    assert syms[("go", "Run")]["docstring"] == "Run drives the motor"
    assert syms[("python", "Motor")]["docstring"] == "Drives wheels." and syms[("python", "start")]["docstring"] == "Spin up."
    assert syms[("python", "start")]["qualified_name"] == "r1/m.py/Motor.start"


def test_manifests_and_imports(spark):
    files = spark.createDataFrame([
        ("r1", "go.mod", "module example.org/core\n\ngo 1.2", "x"), ("r2", "setup.py", "setup(name='My-Tool')", "x"), ("r3", "near/__init__.py", "", "x"),
        ("r4", "m.py", PYTHON + "\nimport my_tool.sub\n", "python"), ("r4", "m.go", GO, "go")], "repo string, path string, text string, language string")
    packages, modules = manifest_packages(files), manifest_modules(files)
    assert {tuple(r) for r in packages.collect()} == {("my_tool", "r2"), ("near", "r3")}
    py = code.resolve_python(code.python_imports(files.where("language = 'python'")), packages)
    assert {(r["module"], r["resolves_to_repo"], r["is_cross_repo"], r["confidence"]) for r in py.collect()} == {
        ("os", None, False, 0.0), (".near", "r4", False, 0.9), ("my_tool.sub", "r2", True, 0.8)}
    go = code.resolve_go(code.go_imports(files.where("language = 'go'")), modules.withColumn("ord", F.col("module")))
    assert {(r["module"], r["line"], r["resolves_to_repo"], r["confidence"]) for r in go.collect()} == {("fmt", 4, None, 0.0), ("example.org/core/v2", 5, "r1", 0.95)}


def test_note_sink_and_reindex(spark, tmp_path):
    notes = spark.createDataFrame([("a/x.md", "# x"), ("_skip.md", "no")], "path string, content string")
    write_notes(notes, str(tmp_path))
    assert [r["name"] for r in read_notes(spark, str(tmp_path)).collect()] == ["x"]
    path = run_dir(spark, "reindex-test")
    table = spark.createDataFrame([("s1", "n1", "one " * 400), ("s1", "n2", "two"), ("s2", "n3", "three")], "shard string, source string, text string")
    write_file_chunks(table, path)
    assert versions.read_table(spark, path).where("source = 'n1'").count() == 2
    reindex_file(spark.createDataFrame([("s1", "n1", "short")], table.schema), path)
    got = {(r["source"], r["content"]) for r in versions.read_table(spark, path).collect()}
    assert got == {("n1", "short"), ("n2", "two"), ("n3", "three")}
    versions.delete_rows(path, spark.createDataFrame([("n3_0", "s2")], "chunk_id string, shard string"), ["chunk_id"])
    assert versions.read_table(spark, path).where("shard = 's2'").count() == 0


def test_stream_restart_reads_only_new_files(spark):
    path = run_dir(spark, "restart-test")
    schema = "k string, n int"
    def push(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{path}/in")

    def state():
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        return sorted(tuple(r) for r in jobs.keep_last(stream, f"{path}/view", ["k"], ["n"], 2).collect())

    push([("a", 1), ("a", 2), ("b", 1)])
    assert state() == [("a", 1), ("a", 2), ("b", 1)]
    push([("a", 3), ("b", 5)])
    assert state() == [("a", 2), ("a", 3), ("b", 1), ("b", 5)]
    assert state() == [("a", 2), ("a", 3), ("b", 1), ("b", 5)]


def test_pca_explains_a_line(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, (i % 2) * 0.01], "f", "r", "s") for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, file string, repo string, symbol_name string")
    points, explained = map_points(df)
    assert points.count() == 20 and explained[0] > 0.99
    assert abs(points.agg(F.avg("x")).first()[0]) < 1e-9
    assert map_points(df.limit(2))[0].count() == 0


def test_headings_reset(spark):
    rows = [("d", 0, 0, "chapter_heading", "Ch 1"), ("d", 0, 1, "section_heading", "1.1 A"), ("d", 0, 2, "subsection_heading", "1.1.1"), ("d", 1, 0, "prose", "p"),
            ("d", 1, 1, "section_heading", "1.2 B"), ("d", 1, 2, "prose", "q"), ("d", 2, 0, "chapter_heading", "Ch 2"), ("d", 2, 1, "prose", "r")]
    df = spark.createDataFrame(rows, "doc string, page int, block_idx int, type string, text string")
    got = {(r["page"], r["block_idx"]): (r["chapter"], r["section"], r["subsection"]) for r in manual.carry_headings(df).collect()}
    assert got[(1, 0)] == ("Ch 1", "1.1 A", "1.1.1") and got[(1, 2)] == ("Ch 1", "1.2 B", None) and got[(2, 1)] == ("Ch 2", None, None)
