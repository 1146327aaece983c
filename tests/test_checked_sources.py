"""Rejected lines, note files that appear together, dictionary tables, table functions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import tables
from corpuskit.operators.dictionary import tagged
from corpuskit.operators.packing import _line_parts
from corpuskit.session import run_dir
from corpuskit.sources.note_writer import file_system, write_notes
from corpuskit.sources.rejects import read_checked, stop_if_too_many
from corpuskit.sources.tables import EVENT_SCHEMA


def test_rejects_and_kept_are_all_lines(spark, tmp_path):
    lines = ['{"ts":1.5,"event":"a","attrs":{"k":"v"}}', "{broken", '{"ts":"x"}', "", "  ", '{"event":"b","more":1}', "[1]", "7", "null", '{"ts":2,"event":"é"}']
    (tmp_path / "one.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.log").write_text('{"ts":3}\n')
    checked = read_checked(spark, str(tmp_path), EVENT_SCHEMA)
    kept, rejects = checked.kept().collect(), checked.rejects().collect()
    assert len(kept) + len(rejects) == 11 and sorted((r.ts, r.event) for r in kept if r.ts) == [(1.5, "a"), (2.0, "é"), (3.0, None)]
    reasons = sorted((r.reason, r.line) for r in rejects)
    assert ("broken", "{broken") in reasons and ("mismatch", '{"ts":"x"}') in reasons and [r for r, _ in reasons].count("empty") == 2
    rates = {r.subject: (r.lines, r.failed, r.verdict) for r in checked.rates(F.regexp_extract("file", r"([^/]+)\.log$", 1)).collect()}
    assert rates["two"] == (1, 0, "ok") and rates["one"][0] == 10 and rates["one"][2] == "stop"
    with pytest.raises(ValueError, match="too many rejected lines: one"):
        stop_if_too_many(checked.rates(F.regexp_extract("file", r"([^/]+)\.log$", 1)))


def files_below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_all_notes_or_none(spark, tmp_path):
    good = spark.createDataFrame([(f"d{i % 3}/n{i}.md", f"text {i}") for i in range(40)] + [("empty.md", None)], "path string, content string").repartition(4)
    bad = good.unionByName(spark.createDataFrame([("d1/no\0name.md", "x")], good.schema))
    root = str(tmp_path / "vault")
    with pytest.raises(Exception):  # noqa: B017 - what Spark makes of the task's error
        write_notes(bad, root)
    assert files_below(root) == []
    write_notes(good, root)
    assert len(files_below(root)) == 41 and (tmp_path / "vault/d1/n4.md").read_text() == "text 4"
    write_notes(spark.createDataFrame([("d1/n4.md", "new")], good.schema), root)
    assert (tmp_path / "vault/d1/n4.md").read_text() == "new" and len(files_below(root)) == 41
    with pytest.raises(ValueError, match="several notes"):
        write_notes(good.unionByName(good), root)


def test_places_that_cannot_be_reached():
    with pytest.raises(ValueError, match="files cannot be written to nowhere:"):
        file_system("nowhere://bucket/x")
    assert file_system("/tmp/x")[1] == "/tmp/x" and file_system("file:///tmp/x")[1] == "/tmp/x"


def test_dictionary_of_many_keywords(spark):
    rng = random.Random(1)
    words = [(f"tag{i % 500}", "".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))), i % 500) for i in range(100_000)]
    words += [("never", None, 900), ("never", "", 900), ("upper", "XX", 901), ("twin", words[0][1], 902)]
    texts = [(i, "".join(rng.choices("abcdefgh  ", k=rng.randrange(40)))) for i in range(60)] + [(100, None), (101, ""), (102, "XX " + words[0][1].upper())]
    dictionary = spark.createDataFrame(words, "tag string, keyword string, position int").repartition(4)
    want = {i: [t for _, t in sorted({(p, tag) for tag, k, p in words if k and x and k in x.lower()})] for i, x in texts}
    rows = spark.createDataFrame(texts, "i int, text string")
    for block in (1 << 22, 100_000):
        got = {r.i: list(r.tags) for r in tagged(rows, dictionary, "text", block=block).collect()}
        assert got == want
    assert {tuple(r.tags) for r in tagged(rows, dictionary.limit(0), "text").collect()} == {()}


def test_table_function(spark):
    tables.register(spark)
    text = "\n".join(f"line {i} of words" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = spark.sql("SELECT id, part_index, part FROM {docs}, LATERAL line_parts(text, 60, 10)", docs=docs).collect()
    assert [r.part for r in sorted((r for r in got if r.id == 1), key=lambda r: r.part_index)] == _line_parts(text, 60, 10)
    assert [(r.part_index, r.part) for r in got if r.id != 1] == [(0, "")]
    for call in ("line_parts(id, 60, 10)", "line_parts(text, id, 10)", "line_parts(text, 10, 10)"):
        with pytest.raises(Exception, match="line_parts"):
            spark.sql(f"SELECT * FROM {{docs}}, LATERAL {call}", docs=docs).collect()


def test_lines_of_a_run_are_read_once(spark):
    path = run_dir(spark, "checked-once")
    spark.range(100).select(F.to_json(F.struct(F.col("id").cast("double").alias("ts"))).alias("value")).write.text(path)
    checked = read_checked(spark, path, EVENT_SCHEMA)
    spark.range(5).selectExpr("'{' AS value").write.mode("append").text(path)
    assert checked.kept().count() == 100 and checked.rejects().count() == 0
