"""Sources and sinks of the catalogue as DataFrames: registries, logs, feeds, sitemaps, mails and archives."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agendum.functions import web


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """url;territory;name;tier[;place;town] lines; # begins a comment; trailing fields may lack; tier 1 where empty."""
    schema = "url string, territory string, name string, tier string, place string, town string"
    rows = spark.read.csv(path, sep=";", comment="#", schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    return rows.filter("url is not null").withColumn("tier", F.coalesce(F.col("tier").try_cast("int"), F.lit(1)))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """name;domain;territory;status[;url] lines of newsletters."""
    return spark.read.csv(path, sep=";", comment="#", schema="name string, domain string, territory string, status string, url string", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).filter("domain is not null")


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are left out, and empty labels become '(none)'."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")
    rows = rows.filter("_corrupt_record is null").drop("_corrupt_record")
    return rows.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.lit("(none)"))) if "label" in rows.columns else rows


def corrections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated corrections: id and new values."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema)


def corrected(df: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """df with the non-null values of fixes."""
    values = [c for c in fixes.columns if c != key]
    new = fixes.select(key, *[F.col(c).alias(f"fixed_{c}") for c in values])
    out = df.join(new, key, "left").withColumns({c: F.coalesce(f"fixed_{c}", c) for c in values})
    return out.select(*df.columns)


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, description, published; one row for each link, the first in the file's order."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), 0)).alias("pos", "item"))
    field = lambda *tags: F.coalesce(*[F.nullif(F.trim(web.unescaped(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$", ""))), F.lit("")) for t in tags])
    link = F.coalesce(field("link"), F.nullif(F.regexp_extract("item", r"(?i)<link\b[^>]*?href\s*=\s*[\"']([^\"']+)", 1), F.lit("")), field("guid", "id"))
    rows = raw.select("file", "pos", field("title").alias("title"), web.without_tracking(link).alias("link"), field("description", "summary", "content").alias("description"), field("pubDate", "published", "updated").alias("published"))
    best = rows.filter("link is not null").groupBy("link").agg(F.min_by(F.struct("title", "description", "published"), F.struct("file", "pos")).alias("r"))
    return best.select("r.title", "link", "r.description", "r.published")


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of sitemap files: kind is 'sitemap' in an index, else 'page'."""
    raw = spark.read.text(path, wholetext=True)
    kind = F.when(F.col("value").rlike(r"(?i)<sitemapindex\b"), "sitemap").otherwise("page")
    return raw.select(kind.alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1)).alias("url")).withColumn("url", web.unescaped(F.col("url"))).distinct()


def mails(spark: SparkSession, path: str) -> DataFrame:
    """Messages of .eml files: message_id, sender, sender_host, subject, sent, text and html bodies, attachments (name, type, size)."""
    schema = "message_id string, sender string, sender_host string, subject string, sent timestamp, text string, html string, attachments array<struct<name: string, type: string, size: long>>"

    def parse(batches):
        import email
        import email.policy
        import email.utils
        from datetime import timezone

        import pandas as pd

        for batch in batches:
            rows = []
            for raw in batch["content"]:
                m = email.message_from_bytes(bytes(raw), policy=email.policy.default)
                bodies, files = {"plain": [], "html": []}, []
                for part in m.walk():
                    if part.get_filename():
                        files.append({"name": part.get_filename(), "type": part.get_content_type(), "size": len(part.get_payload(decode=True) or b"")})
                    elif part.get_content_maintype() == "text" and part.get_content_subtype() in bodies:
                        bodies[part.get_content_subtype()].append(part.get_content())
                address = email.utils.parseaddr(str(m["from"] or ""))[1]
                try:
                    sent = email.utils.parsedate_to_datetime(str(m["date"])).astimezone(timezone.utc)
                except (TypeError, ValueError):
                    sent = None
                rows.append((str(m["message-id"] or "") or None, address or None, address.rpartition("@")[2].lower() or None, str(m["subject"] or ""), sent, "\n".join(bodies["plain"]) or None, "\n".join(bodies["html"]) or None, files))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("message_id", "sender", "sender_host", "subject", "sent", "text", "html", "attachments")])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)


def from_whitelisted(messages: DataFrame, hosts: DataFrame, as_of: date, days: int) -> DataFrame:
    """Messages of the last days whose sender's host, or a domain above it, is on an active list, with the territory."""
    recent = messages.filter((F.col("sent") >= F.date_sub(F.lit(as_of), days)) & F.col("sender_host").isNotNull())
    rows = recent.withColumn("domain", F.explode(web.host_suffixes(F.col("sender_host"))))
    active = hosts.filter(F.lower(F.coalesce("status", F.lit("active"))) != "off").select(F.lower("domain").alias("domain"), "territory")
    best = rows.join(active, "domain").groupBy("message_id").agg(F.max_by("territory", F.struct(F.length("domain"), "territory")).alias("territory"))
    return recent.join(best, "message_id")


def zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of one CSV member of each ZIP file, as text columns."""

    def rows(batches):
        import csv
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if name.endswith(member):
                            with z.open(name) as f:
                                found = [tuple((r.get(c) or None) for c in columns) for r in csv.DictReader(io.TextIOWrapper(f, "utf-8-sig"))]
                            yield pd.DataFrame(found, columns=columns, dtype="object")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep=";", header=True, mode="overwrite")


def as_feed(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object for each row, nulls left out."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def perimeter(text: Column, names: list[str]) -> Column:
    """Whether one of the place names stands in the folded text as whole words."""
    from agendum.functions.text import fold, whole

    words = "|".join(sorted((n.lower() for n in names), key=len, reverse=True))
    return F.coalesce(fold(text).rlike(whole(words)), F.lit(False))
