"""The reduction of image tokens by similarity, on tables of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """-1 if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n = F.sqrt(norm(a) * norm(b))
    return F.when(n == 0, F.lit(-1.0)).otherwise(dot / n)


def closest_pairs(tokens: DataFrame) -> DataFrame:
    """(image, tile_y, tile_x, first, second, score): in each tile of two by two tokens (image, y, x, embedding) the pair with the highest
    cosine; the first pair in reading order at a tie. A tile of one token has no pair. The join is within tiles of at most four rows."""
    t = tokens.withColumn("tile_y", F.floor(F.col("y") / 2).cast("int")).withColumn("tile_x", F.floor(F.col("x") / 2).cast("int")).withColumn("cell", F.col("y") % 2 * 2 + F.col("x") % 2)
    cells = F.array_sort(F.collect_list(F.struct("cell", "embedding")))
    tiles = t.groupBy("image", "tile_y", "tile_x").agg(cells.alias("c"))
    # pairs of up to four tokens, made within the row
    pairs = F.flatten(F.transform("c", lambda p: F.transform(F.filter("c", lambda r: r.cell > p.cell), lambda r: F.struct(cosine(p.embedding, r.embedding).alias("score"), (-p.cell).alias("a"), (-r.cell).alias("b")))))
    best = tiles.select("image", "tile_y", "tile_x", F.array_max(pairs).alias("m")).where("m is not null")
    return best.select("image", "tile_y", "tile_x", (-F.col("m.a")).cast("int").alias("first"), (-F.col("m.b")).cast("int").alias("second"), F.col("m.score").alias("score"))


def merge_closest(tokens: DataFrame) -> DataFrame:
    """(image, y, x, embedding, mass): the closest pair of each tile becomes the mean of both at the place of its first token, mass 2."""
    t = tokens.withColumn("tile_y", F.floor(F.col("y") / 2).cast("int")).withColumn("tile_x", F.floor(F.col("x") / 2).cast("int")).withColumn("cell", (F.col("y") % 2 * 2 + F.col("x") % 2).cast("int"))
    pairs = closest_pairs(tokens)
    placed = t.join(pairs, ["image", "tile_y", "tile_x"], "left").where("second is null or cell <> second")
    partner = t.select("image", "tile_y", "tile_x", F.col("cell").alias("second"), F.col("embedding").alias("other"))
    both = placed.withColumn("second", F.when(F.col("cell") == F.col("first"), F.col("second"))).join(partner, ["image", "tile_y", "tile_x", "second"], "left")
    mean = F.zip_with("embedding", "other", lambda a, b: ((a + b) * F.lit(0.5)).cast("float"))
    return both.select("image", "y", "x", F.coalesce(F.when(F.col("other").isNotNull(), mean), F.col("embedding")).alias("embedding"), F.when(F.col("other").isNotNull(), 2).otherwise(1).alias("mass"))
