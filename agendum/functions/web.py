"""URLs, HTML and JSON of pages: Column builders, and a table function where the depth has no bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agendum.functions.text import let

#: Fixed parameters that follow readers about.
TRACKING = (
    r"^(utm_[a-z]+|hsa_[a-z]+|gclid|gclsrc|dclid|gbraid|wbraid|srsltid|fbclid|igshid|igsh|msclkid|yclid|twclid|ttclid|li_fat_id|mc_cid|mc_eid|mkt_tok|_hsenc|_hsmi|vero_id|oly_anon_id|oly_enc_id|wickedid|rb_clickid|s_cid|spm|ref)="
)
#: Fixed entities and their characters; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "’"), ("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&amp;", "&")]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_suffixes(name: Column) -> Column:
    """a.b.c, b.c and c: a host list joins them by equality, and every subdomain matches."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def without_tracking(url: Column) -> Column:
    """The URL without parameters that only track, and without a fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~F.lower(p).rlike(TRACKING) & (p != "")), "&")
    base = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept))


def url_family(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(path.isin("", "/"), "home").when(path.rlike(r"^/[a-z]{2}/?$"), "language home").when(path.rlike(r"\.html?$"), "page").when(path.rlike(r"/\d+/?$"), "item").otherwise("other")


def is_site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1).rlike(r"^/?(?:[a-z]{2}/?)?(?:index\.\w+)?$")


def permalink_side(url: Column, languages: list[str], default: str) -> Column:
    """The language whose code is the first segment of the path, else the default."""
    first = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([a-z]{2})(?:/|$)", 1)
    return F.when(first.isin(*languages), first).otherwise(default)


def translated_from(url: Column) -> Column:
    """struct(parent, lang) of a pseudo-URL translated:id:lang; nulls for others."""
    pattern = r"^translated:(\d+):([a-z]{2})$"
    return F.struct(F.regexp_extract(url, pattern, 1).try_cast("long").alias("parent"), F.nullif(F.regexp_extract(url, pattern, 2), F.lit("")).alias("lang"))


def hreflang_verdict(own: Column, alternates: Column, twin: Column) -> Column:
    """What a page's alternates (array of lang, href) say of its twin's link: linked, missing, elsewhere or itself; own and twin: struct(lang, href)."""
    named = F.filter(alternates, lambda a: a["lang"] == twin["lang"])
    there = F.exists(named, lambda a: a["href"] == twin["href"])
    return F.when(there, "linked").when(F.exists(named, lambda a: a["href"] == own["href"]), "itself").when(F.size(named) > 0, "elsewhere").otherwise("missing")


def unescaped(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def visible_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles, comments or tags; entities opened; blanks made single."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescaped(c), r"[\s\x{A0}]+", " "))


def section_counts(html: Column, section: str, card: str) -> Column:
    """How many card tags each section holds, in order; what stands before the first section is none."""
    return F.transform(let(F.split(html, rf"(?i)<{section}\b"), lambda parts: F.slice(parts, F.lit(2), F.size(parts))), lambda s: F.regexp_count(s, F.lit(rf"(?i)<{card}\b")))


def title(html: Column) -> Column:
    return F.trim(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), 1)


def images(html: Column) -> Column:
    """Addresses of the page's own picture first (og:image), then of its img tags."""
    og = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*?property\s*=\s*[\"']og:image[\"'][^>]*?content\s*=\s*[\"']([^\"']+)[\"']"), 1)
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<img\s[^>]*?src\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return F.array_distinct(F.concat(og, tags))


def is_logo(url: Column) -> Column:
    """Names of pictures that show no event."""
    parts = F.split(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"[^a-z]+")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("logo", "favicon", "icon", "sprite", "placeholder", "banner", "default")]))


def microdata(html: Column, name: str) -> Column:
    """Values of an itemprop: its content or datetime attribute."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)itemprop\s*=\s*[\"']{name}[\"'][^>]*?(?:content|datetime)\s*=\s*[\"']([^\"']*)[\"']"), 1)


def first_json(text: Column) -> Column:
    """The text's first JSON object, from its first brace to a later one, as far as one parses; null if none does."""
    at = F.locate("{", text)
    ends = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)) == "}")
    tries = F.transform(ends, lambda i: F.substring(text, at, i - at + 1))
    return F.when(at > 0, F.try_element_at(F.filter(tries, lambda s: F.try_parse_json(s).isNotNull()), F.lit(1)))


def tolerant_json(text: Column) -> Column:
    """A variant from JSON that may carry escaped quotes, comments or a byte order mark; null if nothing helps."""
    bare = F.trim(F.regexp_replace(text, r"^\x{FEFF}|(?s)/\*.*?\*/|<!--|-->", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.replace(bare, F.lit('\\"'), F.lit('"'))), F.try_parse_json(F.regexp_replace(bare, r",\s*([}\]])", "$1")))


def json_ld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*?application/ld\+json[^>]*>(.*?)</script>"), 1)


def register_json_ld(spark) -> None:
    """json_ld_events(block): a row for each node of an event type at any depth: name, start_date, end_date, place, url.

    Depth has no bound, so a Python table function walks the tree; it runs on the few blocks of a page.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="name string, start_date string, end_date string, place string, url string")
    class JsonLdEvents:
        def eval(self, block: str):
            import json

            try:
                root = json.loads(block)
            except (TypeError, ValueError):
                return
            todo = [root]
            while todo:
                node = todo.pop(0)
                if isinstance(node, list):
                    todo = node + todo
                elif isinstance(node, dict):
                    kinds = node.get("@type")
                    kinds = kinds if isinstance(kinds, list) else [kinds]
                    if any(isinstance(k, str) and (k == "Event" or k.endswith("Event") or k == "Festival") for k in kinds):
                        yield tuple(text(node.get(k)) for k in ("name", "startDate", "endDate", "location", "url"))
                    todo = list(node.values()) + todo

    def text(value):
        """The text of a string, an object (its name) or a list (its first)."""
        if isinstance(value, list):
            return next((t for t in map(text, value) if t), None)
        if isinstance(value, dict):
            return text(value.get("name") or value.get("@id") or value.get("url"))
        return None if value is None else str(value)

    spark.udtf.register("json_ld_events", JsonLdEvents)
