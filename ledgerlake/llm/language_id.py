"""Language identification of pages by Bayesian evidence fusion.

Posterior(language) is proportional to the product of
- the text's likelihood under hashed byte trigrams, with rates counted over all
  documents of each language; the log-likelihood of n trigrams is scaled to
  ``EVIDENCE`` of them at most, as neighbouring trigrams are not independent;
- the likelihood of the language that the markup declares, and of the address
  suffix (last label of the host, and a language code leading the path), both
  from a table of how often each goes with a text-identified language;
- the prior of the host, smoothed hierarchically: host towards its domain,
  domain towards its suffix, suffix towards all pages, each with ``KAPPA``
  pseudo-pages. All tables are grouped aggregates; a page's own text evidence
  is taken out of its host's and domain's counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BINS = 1 << 16
EVIDENCE = 200.0
KAPPA = 5.0
ALPHA = 0.5

_TAGS = re.compile(rb"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]+;?", re.S | re.I)
_SPACE = re.compile(rb"[\s\d!-/:-@\[-`{-~]+")


def _trigrams(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a text; white space, digits and punctuation count as one blank."""
    low = _SPACE.sub(b" ", text.lower())
    b = np.frombuffer(b" " + low.strip() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return code >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, added up over a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bins = _trigrams(text.encode())
            if len(bins):
                total.setdefault(lang, np.zeros(BINS, np.int64))
                np.add(total[lang], np.bincount(bins, minlength=BINS), out=total[lang])
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bin", "n"]
        )


def fit_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and their log rates in every bin, from all rows of ``docs`` (text, lang; nulls are skipped).

    The table that reaches the driver has ``BINS`` numbers for each language.
    """
    known = docs.filter("text is not null and lang is not null").select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()
    langs = sorted(rows["lang"].unique())
    rates = np.full((len(langs), BINS), ALPHA)
    rates[[langs.index(x) for x in rows["lang"]], rows["bin"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy()
    return langs, np.log(rates / rates.sum(axis=1, keepdims=True)) if langs else rates


def log_likelihood(texts: list[str | None], rates: np.ndarray, markup: bool) -> np.ndarray:
    """Scaled log-likelihood of each text in each language, the greatest being 0; no text, no difference."""
    out = np.zeros((len(texts), len(rates)))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        bins = _trigrams(_TAGS.sub(b" ", raw) if markup else raw)
        if len(bins) and len(rates):
            ll = rates[:, bins].sum(axis=1) * min(1.0, EVIDENCE / len(bins))
            out[i] = ll - ll.max()
    return out


def with_text_evidence(pages: DataFrame, column: str, langs: list[str], rates: np.ndarray, out: str, markup: bool) -> DataFrame:
    """``pages`` with array<double> ``out``: the text's log-likelihood by language."""

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(list(log_likelihood(list(texts), rates, markup)))

    return pages.withColumn(out, score(F.coalesce(column, F.lit(""))))


def declared_language(html: Column) -> Column:
    """The first part of the lang attribute of <html>, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def suffix_of(url: Column) -> Column:
    """Last label of the host, and the language code with which the path begins."""
    last = F.regexp_extract(host_of(url), r"([^.]*)$", 1)
    path = F.lower(F.regexp_extract(url, r"://[^/?#]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    return F.concat(last, F.lit("/"), path)


def _softmax(logs: Column, n: int) -> list[Column]:
    top = F.array_max(logs)
    e = [F.exp(F.get(logs, k) - top) for k in range(n)]
    return [x / sum(e[1:], e[0]) for x in e]


def _prefix(df: DataFrame) -> str:
    """What the names of working columns begin with: no column of ``df`` does."""
    x = "_"
    while any(c.startswith(x) for c in df.columns):
        x += "_"
    return x


def fused(rows: DataFrame, keep: list[str], langs: list[str], said: str, levels: list[str], text: str, x: str) -> DataFrame:
    """Columns ``keep``, the declared language, and the most probable language with its probability.

    ``text`` names the log-likelihoods, ``said`` the declaration, ``levels`` the
    columns of the prior from the widest group to the narrowest. What a row says
    itself is taken out of every table before the table speaks about the row.
    """
    n = len(langs)
    kept = [F.col(f"`{c}`") for c in keep]
    own = [f"{x}own{k}" for k in range(n)]
    rows = stored(rows.select("*", *[p.alias(c) for c, p in zip(own, _softmax(F.col(text), n), strict=True)]), "language-evidence")
    total = [v or 0.0 for v in rows.agg(*[F.sum(c) for c in own]).first()]
    joined, others = rows, {}
    for by in (said, *levels):
        names = [f"{by}{k}" for k in range(n)]
        table = stored(rows.groupBy(by).agg(*[F.sum(c).alias(m) for c, m in zip(own, names, strict=True)]), "evidence")
        joined = joined.join(table, by)
        others[by] = [F.greatest(F.col(m) - F.col(c), F.lit(0.0)) for c, m in zip(own, names, strict=True)]
    prior = [F.lit((t + ALPHA) / (sum(total) + ALPHA * n)) for t in total]
    for by in levels:
        there = sum(others[by][1:], others[by][0])
        prior = [(o + KAPPA * p) / (there + KAPPA) for o, p in zip(others[by], prior, strict=True)]
    says = [(o + ALPHA) / F.lit(t + ALPHA * 2) for o, t in zip(others[said], total, strict=True)]
    logs = [F.get(text, k) + F.log(prior[k]) + F.log(says[k]) for k in range(n)]
    post = joined.select(*kept, F.col(said).alias(f"{x}said"), F.array(*logs).alias(text)).select(
        *kept, f"{x}said", F.array(*_softmax(F.col(text), n)).alias(text)
    )
    at = (F.array_position(text, F.array_max(text)) - 1).cast("int")
    return post.select(
        *kept, F.col(f"{x}said").alias("declared"), F.get(F.array(*[F.lit(v) for v in langs]), at).alias("lang"),
        F.array_max(text).alias("probability"),
    )


ANSWERS = ("declared", "lang", "probability")


def identified(pages: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``pages`` (all by default) with ``declared``, ``lang`` and ``probability``.

    Needs html and url; ``model`` comes from ``fit_text``. A page without text is
    decided by the other evidence. Null url or html count as empty; a model
    without languages gives a null lang. Repeated rows get equal answers; columns
    of the three names are replaced; an empty table gives an empty one.
    """
    langs, rates = model
    keep = [c for c in (carry or pages.columns) if c.lower() not in ANSWERS]
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    declared = declared_language(html)
    if not langs:
        return pages.select(*[F.col(f"`{c}`") for c in keep], declared.alias("declared"), *_unknown())
    x = _prefix(pages)
    said, suffix, host, domain, text = (x + c for c in ("declared", "suffix", "host", "domain", "text"))
    seen = with_text_evidence(pages, "html", langs, rates, text, True).select(
        *[F.col(f"`{c}`") for c in keep], text, declared.alias(said), suffix_of(url).alias(suffix), host_of(url).alias(host),
        F.regexp_extract(host_of(url), r"([^.]*\.?[^.]*)$", 1).alias(domain),
    )
    return fused(seen, keep, langs, said, [suffix, domain, host], text, x)


def identified_documents(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str]) -> DataFrame:
    """The same for plain documents (text, source): no markup declares a language, and the source is the host.

    A column lang of ``docs`` is no evidence; it is replaced unless left out of ``carry``.
    """
    langs, rates = model
    keep = [c for c in carry if c.lower() not in ANSWERS]
    if not langs:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("declared"), *_unknown())
    x = _prefix(docs)
    said, host, text = x + "declared", x + "host", x + "text"
    seen = with_text_evidence(docs, "text", langs, rates, text, False).select(
        *[F.col(f"`{c}`") for c in keep], text, F.lit("").alias(said), F.coalesce("source", F.lit("")).alias(host)
    )
    return fused(seen, keep, langs, said, [host], text, x)


def _unknown() -> list[Column]:
    return [F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability")]
