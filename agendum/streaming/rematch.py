"""Late rows that change verdicts already given: kits and events arrive in any order, and each batch looks back at all earlier ones."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.operators.pairing import event_sets, kit_sets, matched_sets
from agendum.streaming.jobs import run_batches

KITS, EVENTS = "kit long, place string, words array<string>", "place string, words array<string>, id long"


def _batches(root: str, before: int) -> list[int]:
    """The numbers of the batches under root that come before a batch."""
    system, base = fs.FileSystem.from_uri(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return []
    found = [i.base_name for i in system.get_file_info(fs.FileSelector(base)) if system.get_file_info(f"{i.path}/_SUCCESS").type == fs.FileType.File]
    return sorted(n for n in (int(x.removeprefix("batch-")) for x in found if x.startswith("batch-")) if n < before)


def _kept(spark: SparkSession, root: str, before: int, schema) -> DataFrame:
    paths = [f"{root}/batch-{n}" for n in _batches(root, before)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def rematch(kits: str, events: str, root: str, least: int = 2):
    """A function for each batch of rows side ('kit' or 'event'), id, title, territory: matches its kits with all events so far and
    its events with all earlier kits, and upserts the verdicts. kits, events: the values of side.

    A kit's event is the one with the highest id of those that share enough words, so the new rows' best and the verdict so far
    make the verdict: the table after the last batch is that of the batch job over all rows, however they were dealt. Each
    batch writes its kits' words, the distinct sets of words of its events and the verdicts under its own number and reads those of
    smaller numbers that are complete, so a batch that is run again after a failure does the same again, and no title is folded
    again by later ones. Verdicts are one row for each matched kit.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = lambda side, name: batch.filter(F.col("side") == side).select(F.col("id").cast("long").alias(name), "title", "territory")
        here = lambda name: f"{root}/{name}/batch-{number}"
        kit_sets(rows(kits, "kit")).write.mode("overwrite").parquet(here("kits"))
        event_sets(rows(events, "id")).write.mode("overwrite").parquet(here("events"))
        new_kits, new = spark.read.schema(KITS).parquet(here("kits")), spark.read.schema(EVENTS).parquet(here("events"))
        old = _kept(spark, f"{root}/events", number, EVENTS).groupBy("place", "words").agg(F.max("id").alias("id"))
        all_kits = _kept(spark, f"{root}/kits", number, KITS).unionByName(new_kits)
        best = matched_sets(all_kits, new, least).unionByName(matched_sets(new_kits, old, least)).groupBy("place", "words").agg(F.max("id").alias("id"))
        found = all_kits.join(best.hint("merge"), ["place", "words"]).select("kit", "id")
        before = _batches(f"{root}/verdicts", number)[-1:]
        if before:
            found = found.unionByName(spark.read.schema("kit long, id long").parquet(f"{root}/verdicts/batch-{before[0]}"))
        found.groupBy("kit").agg(F.max("id").alias("id")).write.mode("overwrite").parquet(here("verdicts"))

    return work


def rematched(rows: DataFrame, root: str, checkpoint: str, kits: str = "kit", events: str = "event", least: int = 2) -> DataFrame:
    """The verdicts (kit, id) after all batches of a stream that are there now; a later call goes on from the checkpoint."""
    run_batches(rows, rematch(kits, events, root, least), checkpoint, "append")
    last = _batches(f"{root}/verdicts", 1 << 62)[-1:]
    spark = rows.sparkSession
    return spark.read.schema("kit long, id long").parquet(*[f"{root}/verdicts/batch-{n}" for n in last]) if last else spark.createDataFrame([], "kit long, id long")
