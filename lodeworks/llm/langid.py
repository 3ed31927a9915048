"""Language of web pages by fusing evidence in one posterior.

Four sources speak: the likelihood of the visible text under letter trigrams, the language
the markup declares, and the address, whose suffix, domain and host give a prior smoothed
from the coarser to the finer level. Trigram counts come from all labelled documents; how
declarations go with languages, and the priors, come from sums of the pages' own text
posteriors by grouped aggregation. A page's own share is taken out of its host's prior.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.words import FOLDED, slices, text_bytes
from lodeworks.session import stage_table

GRAM_BITS = 14
#: Languages with fewer labelled trigrams are too little known to be told apart; the languages
#: with most trigrams that one model holds.
MIN_GRAMS, LANGUAGES = 2000, 1000
#: Trigrams of a text count as at most so many independent ones.
EFFECTIVE_GRAMS = 60
#: Pages that the coarser level weighs as much as, and added counts of declarations.
PRIOR_PAGES, ADDED = 5.0, 0.5
_HELD = 64

_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})")
_UNSEEN = re.compile(r"(?i)<(script|style|noscript|template)\b")
_UNSEEN_END = {
    x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "noscript", "template")}
_HOST = re.compile(r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)")
_PLAIN = np.zeros(256, bool)
_PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[0x80:] = True


class Trigrams(NamedTuple):
    languages: list[str]
    log_rates: np.ndarray


def read_page(page: str) -> tuple[str, str]:
    """Text between the tags, with entities resolved, and the language that the page declares.

    One pass over the whole page: comments and the insides of scripts and the like are skipped,
    so neither holds a declaration. An end that was not found once is not sought again.
    """
    out, at, declared, missing = [], 0, "", set()
    while (start := page.find("<", at)) >= 0:
        end = -1
        if page.startswith("<!--", start):
            if "" not in missing:
                end = page.find("-->", start + 4) + 3
                if end < 3:
                    missing.add("")
                    end = -1
        elif (unseen := _UNSEEN.match(page, start)) and unseen.group(1).lower() not in missing:
            name = unseen.group(1).lower()
            close = _UNSEEN_END[name].search(page, unseen.end())
            if close is None:
                missing.add(name)
            else:
                end = close.end()
        if end < 0:
            end = page.find(">", start + 1) + 1
            if not end:
                break
            if not declared and page[start + 1:start + 5].lower() == "html":
                found = _DECLARED.match(page[start:end])
                declared = found.group(1).lower() if found else ""
        out += [page[at:start], " "]
        at = end
    out.append(page[at:])
    return html_entities.unescape("".join(out)), declared


def visible_text(page: str) -> str:
    """Text between the tags, with entities resolved."""
    return read_page(page)[0]


def host_parts(url: str | None) -> tuple[str, str, str]:
    """Host, domain (last two labels) and suffix (last label); empty where there is none."""
    found = _HOST.match(url or "")
    host = found.group(1).lower().strip(".") if found else ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if labels else ""


def trigram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each byte trigram that has a letter in the middle."""
    data, offsets = text_bytes(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(_PLAIN, FOLDED, np.uint64(1))[data]
    keys = codes[:-2] * np.uint64(3) + codes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[2:] * np.uint64(
        0xD6E8FEB86659FD93)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    use = (owner[:-2] == owner[2:]) & _PLAIN[data[1:-1]]
    keys = keys[use]
    keys ^= keys >> np.uint64(29)
    keys *= np.uint64(0xBF58476D1CE4E5B9)
    return owner[:-2][use], (keys >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _gram_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])],
                names=["lang", "bucket", "total"])
        held.clear()

    for batch in slices(batches, "text"):
        langs = batch.column(0).to_pylist()
        named = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        owners, buckets = trigram_buckets(batch.column(1))
        index = np.array([named[x] for x in langs], np.int64)
        for lang, i in named.items():
            sums = held.setdefault(lang, np.zeros(1 << GRAM_BITS, np.int64))
            sums += np.bincount(buckets[index[owners] == i], minlength=1 << GRAM_BITS)
            if len(held) >= _HELD:
                yield from flush()
    yield from flush()


def train(docs: DataFrame, min_grams: int = MIN_GRAMS) -> Trigrams:
    """Trigram rates of the languages of all labelled documents (lang, text).

    Null languages and texts are left out. A fixed number of buckets for each of at most
    LANGUAGES languages comes to the driver.
    """
    sums = (
        docs.select("lang", "text").where("lang is not null and text is not null")
        .mapInArrow(_gram_sums, "lang string, bucket long, total long")
        .groupBy("lang", "bucket").agg(F.sum("total").alias("total"))
    )
    sums = stage_table(sums, "trigrams")
    totals = {r["lang"]: r["n"] for r in sums.groupBy("lang").agg(F.sum("total").alias("n")).orderBy(
        F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = sorted(x for x, n in totals.items() if n >= min_grams)
    rates = np.full((len(languages), 1 << GRAM_BITS), 0.5)
    for row in sums.where(F.col("lang").isin(languages)).collect():
        rates[languages.index(row["lang"]), row["bucket"]] += row["total"]
    return Trigrams(languages, np.log(rates / rates.sum(axis=1, keepdims=True)))


def _evidence(pages: DataFrame, model: Trigrams) -> DataFrame:
    """page_id, host, domain, suffix, declared, and log likelihoods of the text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        rates = shared.value.log_rates
        for batch in slices(batches, "html"):
            htmls = [read_page(h or "") for h in batch.column(2).to_pylist()]
            texts = pa.array([text for text, _ in htmls], pa.string())
            owners, buckets = trigram_buckets(texts)
            n = np.bincount(owners, minlength=len(htmls))
            weight = np.minimum(n, EFFECTIVE_GRAMS) / np.maximum(n, 1)
            scores = np.column_stack([
                np.bincount(owners, r[buckets], minlength=len(htmls)) * weight for r in rates])
            declared = [lang for _, lang in htmls]
            parts = [host_parts(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array([p[i] for p in parts], pa.string()) for i in range(3)),
                pa.array(declared, pa.string()), pa.array(list(scores), pa.list_(pa.float64())),
            ], names=["page_id", "host", "domain", "suffix", "declared", "scores"])

    return pages.select("page_id", "url", "html").mapInArrow(
        read, "page_id long, host string, domain string, suffix string, declared string, scores array<double>")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    powers = [F.exp(x - top) for x in logs]
    total = reduce(lambda a, b: a + b, powers)
    return [p / total for p in powers]


def identify(pages: DataFrame, model: Trigrams) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared: one row per page.

    A null html has no text and no declaration, a null url no host: such pages share the empty
    host. Ties go to the first language of the alphabet; a model without languages gives null.
    Repeated rows and ids are judged row by row. Other columns are not looked at.
    """
    languages = model.languages
    if not languages:
        return pages.select("page_id", *(
            F.lit(None).cast(t).alias(c) for c, t in
            (("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"))))
    k = range(len(languages))
    found = _evidence(pages, model)
    text = _softmax([F.col("scores")[i] for i in k])
    found = stage_table(found.select("*", *(p.alias(f"t{i}") for i, p in enumerate(text))), "evidence")

    def sums(level: DataFrame, source: str, name: str) -> list[Column]:
        return [F.sum(f"{source}{i}").alias(f"{name}{i}") for i in k] + [F.sum(f"{source}n").alias(f"{name}n")]

    hosts = stage_table(found.withColumn("tn", F.lit(1.0)).groupBy("host", "domain", "suffix").agg(
        *sums(found, "t", "h")), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums(hosts, "h", "d"))
    suffixes = domains.groupBy("suffix").agg(*sums(domains, "d", "s"))
    world = suffixes.agg(*sums(suffixes, "s", "w")).first()
    pages_in_all = world["wn"] or 0.0
    share = [((world[f"w{i}"] or 0.0) + 1) / (pages_in_all + len(languages)) for i in k]

    def smoothed(name: str, coarser: list[Column]) -> list[Column]:
        return [(F.col(f"{name}{i}") + PRIOR_PAGES * coarser[i]) / (F.col(f"{name}n") + PRIOR_PAGES) for i in k]

    suffixes = suffixes.select("suffix", *(
        p.alias(f"ps{i}") for i, p in enumerate(smoothed("s", [F.lit(x) for x in share]))))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", *(
        p.alias(f"pd{i}") for i, p in enumerate(smoothed("d", [F.col(f"ps{i}") for i in k]))))
    priors = hosts.join(domains, ["domain", "suffix"]).select(
        "host", "hn", *(f"h{i}" for i in k), *(f"pd{i}" for i in k))
    declared = found.groupBy("declared").agg(*(F.sum(f"t{i}").alias(f"c{i}") for i in k))
    kinds = declared.count()
    declared = declared.select("declared", *(
        F.log((F.col(f"c{i}") + ADDED) / F.lit((world[f"w{i}"] or 0.0) + ADDED * kinds)).alias(f"ld{i}")
        for i in k))
    fused = found.join(priors, "host").join(declared, "declared")
    logs = [
        F.col("scores")[i] + F.col(f"ld{i}") + F.log(
            F.greatest(F.col(f"h{i}") - F.col(f"t{i}"), F.lit(0.0)) + PRIOR_PAGES * F.col(f"pd{i}"))
        for i in k]
    fused = fused.select("page_id", "declared", *(f"t{i}" for i in k), *(
        p.alias(f"p{i}") for i, p in enumerate(_softmax(logs))))

    def best(name: str) -> Column:
        top = F.greatest(*(F.col(f"{name}{i}") for i in k)) if len(languages) > 1 else F.col(f"{name}0")
        return F.coalesce(*(F.when(F.col(f"{name}{i}") >= top, F.lit(languages[i])) for i in k))

    top = F.greatest(*(F.col(f"p{i}") for i in k)) if len(languages) > 1 else F.col("p0")
    return fused.select(
        "page_id", best("p").alias("lang"), F.round(top, 4).alias("confidence"),
        best("t").alias("text_lang"), "declared")
