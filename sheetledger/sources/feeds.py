"""Landed JSON pages and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLE = ("array<struct<article_no:string,title:string,content:string,obligation_level:string,"
           "is_mandatory:boolean,chapter_no:string>>")


def strip(col: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def flatten_feed(df: DataFrame, json_col: str, path: str = "items", keep: tuple[str, ...] = (),
                 max_items: int | None = None) -> DataFrame:
    """Articles of a landed page, found under a dotted path.

    Empty content is skipped; an article without a number is called ``auto_n`` by its place
    among the kept ones.  ``max_items`` bounds one sync (a setting of the feed; default: all).
    """
    items = F.from_json(F.get_json_object(F.col(json_col), "$." + path), ARTICLE)
    if max_items is not None:
        items = F.slice(items, 1, max_items)
    filled = F.filter(items, lambda a: strip(F.coalesce(a["content"], F.lit(""))) != "")
    number = strip(F.coalesce(F.col("_a.article_no"), F.lit("")))
    return df.select(*keep, F.posexplode(filled).alias("_pos", "_a")).select(
        *keep,
        F.when(number != "", number).otherwise(F.concat(F.lit("auto_"), F.col("_pos"))).alias("article_no"),
        F.coalesce(F.col("_a.title"), F.lit("")).alias("title"),
        strip(F.col("_a.content")).alias("content"),
        F.coalesce(F.col("_a.obligation_level"), F.lit("SHOULD")).alias("obligation_level"),
        F.coalesce(F.col("_a.is_mandatory"), F.lit(False)).alias("is_mandatory"),
        F.coalesce(F.col("_a.chapter_no"), F.lit("")).alias("chapter_no"))


# Markup entities decoded by extract_text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_to_text(html: Column) -> Column:
    """Markup to plain text in Column form, so it stays in the JVM."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"(?is)</(p|div|li|h1|h2|h3|tr|title)>|<br */?>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return strip(text)


def extract_text(df: DataFrame, html_col: str, key: str) -> DataFrame:
    """Text with its provenance: method, number of pages, characters."""
    return (df.select(key, html_to_text(F.col(html_col)).alias("text"))
            .select(key, "text", F.lit("text_layer").alias("method"), F.lit(1).cast("long").alias("pages"),
                    F.length("text").cast("long").alias("chars")))
