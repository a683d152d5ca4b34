"""Tables and rows of the catalogue: loading, the event schema and its evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The event record; columns that came later are nullable and default to null in older snapshots.
EVENT_FIELDS = {
    T.LongType(): "id duplicate_of translation_of wp_post_id_as edition_precedente edition_suivante",
    T.IntegerType(): "recurring multi_lieux",
    T.DoubleType(): "llm_score user_score home_score",
    T.StringType(): "title description url_source source_name source_type territoire ville lieu organisateur date_event_start date_event_end time_event "
    "statut url_image lang llm_score_detail enrich_data infos_pratiques published_as_date created_at",
}
EVENT_SCHEMA = T.StructType([T.StructField(n, kind) for kind, names in EVENT_FIELDS.items() for n in names.split()])


def events_from(df: DataFrame) -> DataFrame:
    """df with the event schema: missing columns are null, others are cast, empty text is null, and a T in timestamps is a blank."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in EVENT_SCHEMA:
        c = F.col(f"`{have[f.name]}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(F.trim(c), F.lit(""))
        if f.name in ("published_as_date", "created_at"):
            c = F.translate(c, "T", " ")
        out.append(c.alias(f.name))
    return df.select(*out)


def union_channels(*channels: DataFrame) -> DataFrame:
    """One table from several channels; columns that a channel lacks are null there."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
