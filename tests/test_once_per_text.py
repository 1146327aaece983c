"""Work on a text or line is done once, not once per keyword or per line below it."""

from pyspark.sql import functions as F

from corpuskit.functions import tags as G
from corpuskit.functions import text as S


def test_a_text_is_lowered_once_for_all_keywords(spark):
    rows = spark.createDataFrame([(1, "SPI bus and WiFi"), (2, "nothing"), (3, None)], "id long, text string").withColumn("tags", G.tags_of(F.col("text")))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = {r.id: r.tags for r in rows.collect()}
    assert got[2] == got[3] == [] and {"TRM__STM32_Body_Board", "TRM__QCA9377_WiFi_BLE"} <= set(got[1])


def test_comments_of_all_lines_are_those_of_each(spark):
    text = "// a\n\n //  b \ncode\n// c\n  \nx\n" + "\n".join(f"// {i}" for i in range(30)) + "\nend\n"
    lines = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string").select("id", F.split("text", "\n").alias("ls"))
    every = lines.select("id", F.posexplode(S.comments_above(F.col("ls"))).alias("at", "comment")).select("id", F.col("at") + 1, "comment")
    each = lines.select("id", "ls", F.explode(F.sequence(F.lit(1), F.size("ls"))).alias("n")).select("id", "n", S.comment_above(F.col("ls"), F.col("n")))
    rows = sorted(map(tuple, every.collect()))
    assert rows == sorted(map(tuple, each.collect())) and len(rows) == 40
    said = {(i, n): c for i, n, c in rows}
    assert said[1, 4] == "a b" and said[1, 7] == "c" and said[1, 38] == " ".join(map(str, range(16, 30))) and said[1, 1] == said[2, 1] == ""
