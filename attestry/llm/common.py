"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.session import checkpointed

__all__ = ["checkpointed", "join_on_hot_key", "keep_one_row", "documents", "map_texts", "given_table", "slices"]

# A key can only be hot if it holds at least one row in this many, so there are never more hot keys than this.
HOT_SHARE = 1000
# Text that a task works on at once; a longer text is worked on alone, whole.
BATCH_BYTES = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_attestry_shipped", False):
        root = Path(__file__).resolve().parents[1]
        # the driver serves this file to executors as long as the context lives
        path = f"{tempfile.mkdtemp(prefix='spark-')}/attestry_package.zip"
        with zipfile.ZipFile(path, "w") as packed:
            for file in sorted(root.rglob("*.py")):
                packed.write(file, file.relative_to(root.parent))
        context.addPyFile(path)
        context._attestry_shipped = True


def given_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_table(spark, sf_dir, "documents")


def map_texts(
    df: DataFrame,
    columns: list[str],
    new_fields: str,
    compute: Callable[[], Callable[[list], list[pa.Array]]],
    text_column: str = "text",
) -> DataFrame:
    """One output row per input row: ``columns`` unchanged, then the fields that ``compute`` makes of the texts.

    ``compute()`` is called once per task and returns the function from the texts of a batch
    (None for null) to one Arrow array per new field, so models are set up once.
    """
    ship_package(df.sparkSession)
    fields = T.StructType.fromDDL(new_fields).fields
    schema = T.StructType([*[df.schema[c] for c in columns], *fields])
    names = [*columns, *[f.name for f in fields]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = compute()
        for whole in batches:
            sizes = pc.binary_length(whole.column(len(columns))).fill_null(0).to_pylist()
            for low, high in slices(sizes, BATCH_BYTES):
                batch = whole.slice(low, high - low)
                made = of_texts(batch.column(len(columns)).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], *made], names=names)

    return df.select(*columns, F.col(text_column).cast("string").alias("__text")).mapInArrow(run, schema)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes together; every row is in one range, whole."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def join_on_hot_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to one row of ``groups`` per key, where a key may hold a third of all rows.

    Keys with at least ``total / HOT_SHARE`` rows (``size`` counts them) are at most HOT_SHARE many, so
    that side is broadcast within a proven bound; no row of a hot key is shuffled. The others shuffle.
    """
    hot = F.col(size) * HOT_SHARE >= F.lit(max(total, HOT_SHARE * 2))
    few = F.broadcast(groups.filter(hot))
    rest = groups.filter(~hot)
    tagged = rows.join(few.select(key, F.lit(True).alias("__hot")), key, "left")
    by_hot = tagged.filter("__hot").drop("__hot").join(few, key)
    by_key = tagged.filter("__hot IS NULL").drop("__hot").join(rest, key)
    return by_hot.unionByName(by_key)


def keep_one_row(rows: DataFrame, group: str, repeats: str) -> DataFrame:
    """Rows of which one per ``group`` is to stay; ``repeats`` says how many candidates the group has.

    Candidates are repeated only where rows share the identifier that decides, so nearly all rows
    pass without a shuffle; among repeats an arbitrary row stays, combined on the map side.
    """
    single = rows.filter(F.col(repeats) <= 1)
    names = [c for c in rows.columns if c != group]
    multiple = (
        rows.filter(F.col(repeats) > 1)
        .groupBy(group)
        .agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__row"))
        .select(group, *[F.col("__row").getField(c).alias(c) for c in names])
    )
    return single.unionByName(multiple)
