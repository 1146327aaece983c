"""Vectors from text, and a 3-D map of vectors."""

from __future__ import annotations

from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import clip, first_present, repo_from_name, search_tokens

MIN_POINTS = 3


def hashed_embedding(rows: DataFrame, text: str = "text", dims: int = 256, out: str = "embedding") -> DataFrame:
    """Default embedder: hashed words of the whole text, weighted by rarity, unit length.

    Deterministic and model-free.  A text without words gets an empty vector,
    as a failed embedding does.
    """
    words = rows.withColumn("__w", search_tokens(F.col(text)))
    counted = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dims).transform(words)
    weighted = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="__idf", outputCol="__v").transform(weighted)
    vector = F.when(F.size("__w") > 0, vector_to_array("__v", "float32")).otherwise(F.array().cast("array<float>"))
    return unit.withColumn(out, vector).drop("__w", "__tf", "__idf", "__v")


def embed(rows: DataFrame, text: str = "text", embedder=None, out: str = "embedding", max_chars: int | None = None) -> DataFrame:
    """Add a vector column: by ``embedder`` (an iterator pandas UDF to ``array<float>``) or the default.

    ``max_chars`` is for models that take no longer text; unless given, all of it is read.
    """
    if embedder is None and max_chars is None:
        return hashed_embedding(rows, text, out=out)
    source = F.col(text) if max_chars is None else clip(F.col(text), max_chars)
    if embedder is None:
        return hashed_embedding(rows.withColumn("__text", source), "__text", out=out).drop("__text")
    return rows.withColumn(out, embedder(source))


def map_points(vectors: DataFrame, key: str = "vec_id") -> tuple[DataFrame, list[float]]:
    """3-D positions of vectors by PCA, with name, repository and symbol; and the explained variance.

    The covariance is summed over partitions; only a ``d x d`` matrix reaches
    the driver.  Signs are fixed so that the largest loading of each axis is
    positive.  Fewer than three vectors give no points.
    """
    rows = vectors.where(F.size("embedding") > 0).withColumn("__v", array_to_vector(F.col("embedding").cast("array<double>")))
    if rows.limit(MIN_POINTS).count() < MIN_POINTS:
        return _points(rows.where("false"), F.array(*[F.lit(0.0)] * 3), key), []
    model = PCA(k=3, inputCol="__v", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(3)]
    placed = model.transform(rows)
    means = placed.agg(*[F.avg(vector_to_array("__p")[j]).alias(f"m{j}") for j in range(3)]).first()
    axes = F.array(*[(vector_to_array("__p")[j] - means[j]) * signs[j] for j in range(3)])
    return _points(placed, axes, key), [float(v) for v in model.explainedVariance]


def _points(rows: DataFrame, axes, key: str) -> DataFrame:
    name = first_present(F.col("file"), F.concat(F.lit("chunk_"), key), default="")
    return rows.select(key, axes[0].alias("x"), axes[1].alias("y"), axes[2].alias("z"), name.alias("name"),
                       F.coalesce(F.nullif("repo", F.lit("")), repo_from_name(name)).alias("repo"), F.coalesce("symbol_name", F.lit("")).alias("symbol"))
