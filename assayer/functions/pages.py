"""Results of a search page: titles, targets and snippets."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a results page marks a result, and its redirect.
RESULT = (
    r'(?s)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    r'.*?class="result__snippet"[^>]*>(.*?)</a>'
)
TAG = r"<[^>]+>"
REDIRECT_HOST = r"duckduckgo\.com\z"
REDIRECT_PATH = "/l/"
REDIRECT_PARAM = "uddg"


@F.pandas_udf(T.StringType())
def unescaped(fragments: pd.Series) -> pd.Series:
    """HTML entities decoded, of which Spark knows none."""
    return fragments.map(lambda f: None if f is None else unescape(f).strip())


def plain(fragment: Column) -> Column:
    return unescaped(F.regexp_replace(fragment, TAG, ""))


def target(href: Column) -> Column:
    """A link's target, taken out of the search engine's own redirect."""
    url = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    ours = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")).rlike(REDIRECT_HOST) & (
        F.try_parse_url(url, F.lit("PATH")) == REDIRECT_PATH
    )
    wrapped = F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(REDIRECT_PARAM)))
    return F.coalesce(F.when(ours & (F.length(wrapped) > 0), wrapped), url)


def results(pages: DataFrame, html: str, keys: list[str], first: int = 5) -> DataFrame:
    """The first results of each page, one row each, ranked from 1."""
    group = lambda n: F.regexp_extract_all(F.col(html), F.lit(RESULT), F.lit(n))
    zipped = F.arrays_zip(group(1).alias("href"), group(2).alias("title"), group(3).alias("snippet"))
    rows = pages.select(*keys, F.posexplode(F.slice(zipped, 1, first)).alias("pos", "r"))
    return rows.select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        plain(F.col("r.title")).alias("title"),
        target(F.col("r.href")).alias("url"),
        plain(F.col("r.snippet")).alias("snippet"),
    )


def as_text(found: DataFrame, keys: list[str]) -> DataFrame:
    """Each page's results as one text; a page has at most `first` of them."""
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), "title", F.lit("\n   "), "url", F.lit("\n   "), "snippet"
    )
    return (
        found.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
        .select(*keys, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    )
