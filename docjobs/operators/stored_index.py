"""The chunk index as a stored table that grows by appends, and is not read whole to find out what it has.

Each append is a generation: its rows in partitions by a hash of the fingerprint and, for each partition, a Bloom filter,
stored as a table of 64-bit blocks. New rows are looked up in the blocks by an equi-join (some three bytes for each stored
row); only partitions that may have one of them are read, and only these rows are compared. A generation counts once it is
listed, the last step of an append, so an append that failed leaves an unlisted folder and nothing else. One application
at a time appends or compacts.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docjobs.sources.shared import drop_folder, folder_exists, shared_folder

#: Rows that a partition is meant to hold, bits of its filter for each row, and bits that a row sets in its block.
ROWS, PER_ROW, SET = 1 << 20, 24, 5
#: Rows that a task of an append is meant to take; a partition is written by as many tasks as its rows ask for.
TASK_ROWS = 1 << 16
GENERATIONS = "gen string, at timestamp, partitions long, blocks long, n_rows long, replaces array<string>"


def _part(partitions: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), partitions)


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("fp", F.lit(1)), blocks)


def _bits() -> Column:
    """What a fingerprint sets in its block: one bit for each six bits of a hash."""
    ones = [f"shiftleft(1L, cast(shiftright(xxhash64(fp, 2), {6 * i}) & 63 as int))" for i in range(SET)]
    return F.expr(" | ".join(ones))


def generations(spark: SparkSession, path: str) -> DataFrame:
    """The appends that the index consists of: gen, at, partitions, blocks (of a partition's filter), n_rows, replaces."""
    if not folder_exists(spark, f"{path}/generations/_SUCCESS"):
        return spark.createDataFrame([], GENERATIONS)
    listed = spark.read.schema(GENERATIONS).parquet(f"{path}/generations")
    return listed.join(listed.select(F.explode("replaces").alias("gen")), "gen", "left_anti")


def _append(spark: SparkSession, rows: DataFrame, path: str, n_rows: int, rows_per_partition: int, replaces: list[str]) -> str:
    """Stores rows (fp, row) as a new generation and lists it."""
    gen, partitions = "g" + uuid.uuid4().hex, max(1, -(-n_rows // rows_per_partition))
    blocks = max(1, -(-n_rows * PER_ROW // (64 * partitions)))
    of_gen = f"{path}/{{}}/gen={gen}"
    each = max(1, -(-n_rows // (partitions * TASK_ROWS)))  # tasks of a partition; numbered, as a hash would send some to one task
    task = (_part(F.lit(partitions)) * each + F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(each))).cast("int")
    rows.withColumn("part", _part(F.lit(partitions))).repartitionById(partitions * each, task).write.partitionBy("part").parquet(of_gen.format("rows"))
    stored = spark.read.schema("fp string, part long").parquet(of_gen.format("rows"))
    bits = stored.groupBy("part", _block(F.lit(blocks)).alias("block")).agg(F.bit_or(_bits()).alias("bits"))
    bits.repartition("part").sortWithinPartitions("part", "block").write.partitionBy("part").parquet(of_gen.format("filters"))
    listed = spark.range(1).select(F.lit(gen), F.current_timestamp(), *(F.lit(n).cast("long") for n in (partitions, blocks, n_rows)), F.array(*map(F.lit, replaces)).cast("array<string>"))
    listed.toDF("gen", "at", "partitions", "blocks", "n_rows", "replaces").write.mode("append").parquet(f"{path}/generations")
    return gen


def _only(parts: list) -> Column:
    """A condition for some partitions, given as rows of gen and part; Spark prunes by it."""
    of_gen = defaultdict(list)
    for p in parts:
        of_gen[p["gen"]].append(p["part"])
    return reduce(lambda a, b: a | b, ((F.col("gen") == gen) & F.col("part").isin(ps) for gen, ps in of_gen.items()), F.lit(False))


def may_be_known(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """The fingerprints of new that the filters can't rule out, with the partition each may be in: fp, gen, part."""
    gens = [F.struct(F.lit(g["gen"]).alias("gen"), *(F.lit(g[c]).alias(c) for c in ("partitions", "blocks"))) for g in generations(spark, path).collect()]  # one for each append
    if not gens:
        return spark.createDataFrame([], "fp string, gen string, part long")
    asked = new.select("fp", F.explode(F.array(*gens)).alias("g")).select("fp", F.col("g.gen").alias("gen"), _part(F.col("g.partitions")).alias("part"), _block(F.col("g.blocks")).alias("block"), _bits().alias("wanted"))
    parts = asked.select("gen", "part").distinct().collect()  # names of partitions, as many as the index has at most
    filters = spark.read.schema("block long, bits long, gen string, part long").parquet(f"{path}/filters").filter(_only(parts))
    return asked.join(filters, ["gen", "part", "block"]).filter(F.col("wanted").bitwiseAND(F.col("bits")) == F.col("wanted")).select("fp", "gen", "part")


def stored_rows(spark: SparkSession, path: str, parts: list) -> DataFrame:
    """fp, gen, part of the rows in some partitions (rows of gen and part); no other partition is read."""
    return spark.read.schema("fp string, gen string, part long").parquet(f"{path}/rows").filter(_only(parts))


def add_to_index(new: DataFrame, path: str, order: list[str], rows_per_partition: int = ROWS) -> DataFrame:
    """Appends to the index at path the rows of new that it lacks, and returns them: of each fp, the first by order.

    The same rows as ``retrieve.add_documents`` gives. An index that doesn't exist yet has no rows. Rows with a null fp
    equal no stored row: of those that an append brings, the first is added. Columns besides fp may have any name and
    must be of the same type in every append. What is added is what stands in the table, so it can be read again.

    Fingerprints alone are looked up, so new is computed twice (it must give the same rows both times) and texts move only
    if there is something to add: once to their fingerprint, combined in the map tasks, and once to their partition.
    """
    spark, stage = new.sparkSession, shared_folder(new.sparkSession, "append")
    columns = [c for c in new.columns if c != "fp"]
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    new.select("fp").distinct().write.parquet(f"{stage}/asked")
    asked = spark.read.parquet(f"{stage}/asked")
    may_be_known(spark, asked, path).write.parquet(f"{stage}/maybe")
    maybe = spark.read.parquet(f"{stage}/maybe")
    parts = maybe.select("gen", "part").distinct().collect()  # names of partitions
    first = new.select("fp", row.alias("row"), F.struct(*order).alias("o")).groupBy("fp").agg(F.min_by("row", "o").alias("row"))
    n, added = asked.count(), first
    if parts:
        maybe.join(stored_rows(spark, path, parts), ["gen", "part", "fp"], "left_semi").select("fp").distinct().write.parquet(f"{stage}/known")
        known = spark.read.parquet(f"{stage}/known")
        n, added = n - known.count(), first.join(known, "fp", "left_anti")  # by the partitioning that the grouping leaves
    out = spark.createDataFrame([], first.schema)
    if n:
        gen = _append(spark, added, path, n, rows_per_partition, [])
        out = spark.read.schema(first.schema).parquet(f"{path}/rows/gen={gen}")
    drop_folder(spark, stage)
    return out.select("fp", "row.*").select(*(F.col(f"`{c}`") for c in new.columns))


def _rows_of(spark: SparkSession, path: str, gens: list) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/gen={g['gen']}" for g in gens)).select("fp", "row")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """fp and the other columns of all rows of the index, which has one generation at least."""
    return _rows_of(spark, path, generations(spark, path).collect()).select("fp", "row.*")


def compact(spark: SparkSession, path: str, rows_per_partition: int = ROWS) -> None:
    """All generations as one, since each append is looked up in the filters of every generation.

    The new one is listed with what it replaces, in one step; only then do the folders of the others go, and with them
    what unlisted appends have left. Tables read before are not to be used on.
    """
    gens = generations(spark, path).collect()
    if len(gens) > 1:
        _append(spark, _rows_of(spark, path, gens), path, sum(g["n_rows"] for g in gens), rows_per_partition, [g["gen"] for g in gens])
    kept = {g["gen"] for g in generations(spark, path).select("gen").collect()}
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind in ("rows", "filters"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        for name in [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []:
            if name.removeprefix("gen=") not in kept:
                drop_folder(spark, f"{path}/{kind}/{name}")
