"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined as log odds:

* the text: naive Bayes over hashed character trigrams, counted on a bounded
  sample of labelled documents (``TRAIN_DOCUMENTS``);
* the language that the markup declares, and the suffix of the address, each by
  how often it goes with a language across all pages;
* the host: its share of each language, smoothed towards that of its domain,
  which is smoothed towards that of all pages, without the page's own vote.

The last three come from grouped aggregation of the text posteriors of every
page. Hosts and domains grow with the corpus, so their tables are joined, never
sent to the driver; a hot host is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.common import hash_sample, shielded, written

BUCKETS = 1 << 15
TRAIN_DOCUMENTS = 8_000
#: pseudo-pages: of the corpus in a domain, of the domain in a host, of the corpus in a declaration or suffix
DOMAIN_STRENGTH, HOST_STRENGTH, HINT_STRENGTH = 10.0, 5.0, 20.0
#: trigrams overlap, so each counts for less than independent evidence would
TEXT_WEIGHT = 0.3

_HIDDEN = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)|&[#\w]+;?", re.S | re.I)


def visible(page: str | None) -> str:
    return " ".join(_HIDDEN.sub(" ", page or "").split())


def trigram_counts(text: str | None) -> np.ndarray:
    """Buckets of the character trigrams of a text, lower-cased, words framed by one space."""
    x = " " + " ".join((text or "").lower().split()) + " "
    code = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.empty(0, dtype=np.int64)
    h = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64) % BUCKETS


class TextModel:
    """Log likelihood of each language per trigram bucket."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], dtype=np.float64).reshape(-1, BUCKETS) + 0.5
        self.table = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)

    def scores(self, text: str | None) -> np.ndarray:
        """Log likelihood of each language, centred on the best."""
        at = trigram_counts(text)
        s = TEXT_WEIGHT * self.table[at].sum(axis=0, dtype=np.float64) if len(at) else np.zeros(len(self.languages))
        return s - s.max() if len(s) else s


def fit_text(labelled: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Count trigrams per language on about ``TRAIN_DOCUMENTS`` labelled texts chosen by hash."""
    src = labelled.select(F.col(f"`{text}`").alias("_t"), F.col(f"`{lang}`").cast("string").alias("_l")).where("_t is not null and _l is not null")
    sample = hash_sample(src, ["_t"], TRAIN_DOCUMENTS, 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, x in zip(batch["_t"], batch["_l"], strict=True):
                total.setdefault(x, np.zeros(BUCKETS, dtype=np.int64))
                total[x] += np.bincount(trigram_counts(t), minlength=BUCKETS)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": x, "bucket": at, "n": n[at]})

    summed = sample.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    rows = summed.toPandas()  # a row for each language and bucket at most
    for x, part in rows.groupby("lang"):
        counts[x] = np.bincount(part["bucket"], weights=part["n"], minlength=BUCKETS)
    return TextModel(counts)


def _evidence(page: str, url: str) -> dict[str, Column]:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    parts = F.split(host, r"\.")
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(page), F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    path = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^?#]*?://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return {
        "_declared": declared, "_host": host,
        "_domain": F.when(F.size(parts) >= 2, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(host),
        "_suffix": F.concat_ws("/", F.element_at(parts, -1), path),
    }


@shielded
def identify(pages: DataFrame, model: TextModel, page: str = "html", url: str = "url") -> DataFrame:
    """All columns of ``pages`` plus language, confidence and text_language (by the text alone).

    An empty, null or wordless page is decided by the other evidence; a null or
    malformed url counts as the empty host. Without any evidence the language of
    most pages is given. Repeated pages get equal results; an empty table gives
    no rows. Caller columns of the new names are replaced. A model without
    languages gives null.
    """
    own = ("language", "confidence", "text_language")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in own]
    k = len(model.languages)
    if not k:
        return pages.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_language"))

    @F.pandas_udf("array<double>")
    def scores(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: model.scores(visible(x)).tolist())

    named = pages.select(*keep, F.col(f"`{page}`").alias("_page"), F.col(f"`{url}`").alias("_url"))
    # the evidence of a page; its text is scored once and not shuffled
    ev = _evidence("_page", "_url")
    key = F.xxhash64("_page", "_url")
    small = written(named.select(key.alias("_key"), *[v.alias(n) for n, v in ev.items()], scores("_page").alias("_text")), "evidence")
    z = F.aggregate(F.transform("_text", lambda x: F.exp(x)), F.lit(0.0), lambda a, x: a + x)
    vote = small.withColumn("_vote", F.transform("_text", lambda x: F.exp(x) / z))

    def shares(by: list[str], name: str) -> DataFrame:
        """Soft counts of each language by group: columns <name>0.."""
        return vote.groupBy(*by).agg(*[F.sum(F.col("_vote")[i]).alias(f"{name}{i}") for i in range(k)])

    total = shares([], "t").first()  # one row
    t = [float(total[f"t{i}"] or 0.0) + 1.0 for i in range(k)]
    base = [x / sum(t) for x in t]
    joined = reduce(
        lambda d, x: d.join(shares([x], x), x),
        ["_declared", "_suffix", "_domain", "_host"],
        vote,
    )

    def without(name: str, i: int) -> Column:
        return F.greatest(F.col(f"{name}{i}") - F.col("_vote")[i], F.lit(0.0))

    def size(name: str) -> Column:
        return reduce(lambda a, b: a + b, [without(name, i) for i in range(k)])

    log_odds = []
    for i in range(k):
        domain = (without("_domain", i) + DOMAIN_STRENGTH * base[i]) / (size("_domain") + DOMAIN_STRENGTH)
        prior = (without("_host", i) + HOST_STRENGTH * domain) / (size("_host") + HOST_STRENGTH)
        hints = F.lit(0.0)
        for name in ("_declared", "_suffix"):
            share = (without(name, i) + HINT_STRENGTH * base[i]) / (size(name) + HINT_STRENGTH)
            hints = hints + F.log(share / base[i])
        log_odds.append(F.col("_text")[i] + F.log(prior) + hints)
    decided = joined.select("_key", "_text", F.array(*log_odds).alias("_odds"))
    top = F.array_max("_odds")
    mass = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(F.col("_odds"))))
    names = F.array(*[F.lit(x) for x in model.languages])
    by_text = F.when(F.array_max("_text") > F.array_min("_text"), F.element_at(names, F.array_position("_text", F.array_max("_text")).cast("int")))
    result = decided.select("_key", F.element_at(names, F.array_position("_odds", top).cast("int")).alias("language"), (1.0 / mass).alias("confidence"), by_text.alias("text_language"))
    result = result.dropDuplicates(["_key"])
    return named.select(*keep, key.alias("_key")).join(result, "_key").drop("_key")
