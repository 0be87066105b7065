"""Language identification by Bayesian evidence fusion.

Hypotheses are the languages met in training and ``und``, which no trained language explains. Evidence of a text: naive Bayes over
hashed byte trigrams, tempered to that of at most ``WEIGHT`` trigrams, since trigrams of one text are far from
independent; under ``und`` every trigram is as likely as any, less ``MARGIN``. Evidence of declared markup language: P(declared | hypothesis),
estimated from all rows' text posteriors. Prior: P(hypothesis | host), smoothed towards the host's registered domain, that
towards the address suffix, that towards all rows; the counts behind it are grouped sums of text posteriors over
every row, without the row's own. The posterior is their product, and the likeliest hypothesis of it is the answer: weak text
gives way to declaration and host. Only a row without any evidence of its own (no trigram of letters, nothing declared, no host) is ``und`` by rule.

The trigram model is trained on a bounded sample of labelled texts (``SAMPLE`` rows of smallest hash), for each language with
at least a thousandth of these rows (so at most 1,000 languages); everything else covers all rows.

Defined cases: null or empty text, html or address: no evidence of that kind. No labelled texts: all ``und``.
Repeated rows are rows of their own. Extra columns pass through ``keep_identified`` untouched and are ignored otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import U64, byte_texts, lean, pieces, raw, shared_folder, stored
from assayloom.llm.htmlblocks import plain_text

BUCKETS, SAMPLE, WEIGHT, KAPPA, LEAST_SHARE, MARGIN, UND = 1 << 14, 20_000, 60.0, 5.0, 0.001, 1.0, "und"
_FOLD = np.array([32 if i < 65 or 90 < i < 97 or 122 < i < 128 else i + 32 if i < 91 else i for i in range(256)], np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each byte trigram that holds a letter; trigrams don't cross rows."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    fits = code != np.uint32(0x202020)
    edges = offsets[1:-1]
    for k in (1, 2):
        at = edges - k
        fits[at[(at >= 0) & (at < len(fits))]] = False
    places = np.flatnonzero(fits)
    buckets = (code[places].astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - 14)
    return buckets.astype(np.int64), np.searchsorted(offsets, places, side="right") - 1


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (buckets, languages), natural logarithm

    @property
    def hypotheses(self) -> list[str]:
        return [*self.languages, UND]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (rows, hypotheses), and whether there is any evidence."""
        data, offsets = raw(texts)
        out, some = np.zeros((len(texts), len(self.languages) + 1)), np.zeros(len(texts), bool)
        for i, j in pieces(offsets):
            buckets, rows = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.bincount(rows, minlength=j - i)
            for k in range(len(self.languages)):
                total = np.bincount(rows, self.logs[buckets, k], minlength=j - i)
                out[i:j, k] = total / np.maximum(n, 1)
            out[i:j, -1] = -np.log(BUCKETS) - MARGIN
            some[i:j] = n > 0
            out[i:j] *= np.minimum(n, WEIGHT)[:, None]
        return out, some


def normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From texts with a language: ``labelled`` (doc_id, text, lang)."""
    chosen = labelled.filter("lang is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").filter("lang is not null").select("text", "lang")

    def counted(batches):
        for batch in batches:
            names, found = batch.column("lang").to_pylist(), {}
            data, offsets = raw(byte_texts(batch.column("text")))
            for i, j in pieces(offsets):
                buckets, at = trigrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                labels = np.array(names[i:j])[at] if len(at) else np.empty(0, str)
                for lang in set(names[i:j]):
                    found[lang] = found.get(lang, 0) + np.bincount(buckets[labels == lang], minlength=BUCKETS)
            for lang, n in found.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n[k].astype(np.int64))], names=["lang", "bucket", "n"])

    given = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # at most ``sample`` rows
    sums = rows.mapInArrow(lean(counted), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages * buckets
    lang, bucket, n = (sums.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "bucket", "n"))
    size = {x: int(n[lang == x].sum()) for x in set(lang.tolist())}
    names = sorted(x for x in size if given[x] >= LEAST_SHARE * sum(given.values()) and size[x] and x != UND)
    chance = np.full((BUCKETS, len(names)), 0.1 / BUCKETS)  # a tenth uniform, for trigrams not met in training
    for k, name in enumerate(names):
        mine = lang == name
        chance[bucket[mine], k] += 0.9 * n[mine] / n[mine].sum()
    return Model(names, np.log(chance))


#: A row's address: host, its registered domain, its suffix. Each is '' if unknown.
LEVELS = ("host", "domain", "suffix")


def _address(url):
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    # two labels, or three where the suffix is a country's and the label before it a short one, as in co.uk
    domain = F.regexp_extract(host, r"([^.]+\.(?:[^.]{1,3}\.[^.]{2}|[^.]+))$", 1)
    return host, domain, F.regexp_extract(host, r"\.([^.]+)$", 1)


def from_pages(pages: DataFrame) -> DataFrame:
    """(row, html, declared, host, domain, suffix) of ``pages`` (page_id, url, html)."""
    host, domain, suffix = _address(F.col("url"))
    tag = F.expr("substring(lower(html), greatest(locate('<html', lower(html)), 1))")  # from the html tag on, read once
    declared = F.regexp_extract(F.coalesce(tag, F.lit("")), r"(?s)^<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    return pages.select(F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).alias("row"), F.col("html").cast("string").alias("text"), declared.alias("declared"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"))


def from_documents(docs: DataFrame) -> DataFrame:
    """The same of ``docs`` (text, lang, source): the source stands for the host, the given language for the declared one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.lower(F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("declared"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.lit("").alias("domain"), F.lit("").alias("suffix"))


def _plain(column: pa.Array, html: bool) -> pa.Array:
    texts = byte_texts(column)
    return byte_texts(pa.array([plain_text(t.decode()) for t in texts.to_pylist()], pa.large_string())) if html else texts


def identified(rows: DataFrame, model: Model, html: bool = False) -> DataFrame:
    """``rows`` without text, with posterior (array by language, then und), language, probability, text_language."""
    names = model.hypotheses
    n = len(names)
    at = {x: k for k, x in enumerate(model.languages)}

    def first(batches):
        for batch in batches:
            logs, some = model.evidence(_plain(batch.column("text"), html))
            p = normal(logs) * some[:, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("declared", *LEVELS)], pa.array(p.tolist(), pa.list_(pa.float64()))], names=["declared", *LEVELS, "p"])

    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]
    vector = F.array(*[F.col(f"s{k}") for k in range(n)])
    seen = rows.select("text", "declared", *LEVELS).mapInArrow(lean(first), "declared string, host string, domain string, suffix string, p array<double>")
    known = F.when(F.col("declared").isin(model.languages), F.col("declared")).when(F.col("declared") == "", F.lit("")).otherwise(F.lit("?"))
    grouped = seen.withColumn("declared", known).groupBy("declared", *LEVELS).agg(*sums).select("declared", *LEVELS, vector.alias("p"))
    grouped = stored(grouped, folder := shared_folder(rows.sparkSession), "sums")
    again = lambda by: grouped.groupBy(*by).agg(*sums)
    given = {r["declared"]: np.array(r["p"]) for r in again(["declared"]).select("declared", vector.alias("p")).collect()}  # at most n + 1 rows
    total = sum(given.values()) if given else np.zeros(n)
    kinds = ["", "?", *model.languages]
    told = np.array([given.get(d, np.zeros(n)) for d in kinds]).reshape(len(kinds), n) + 0.5
    for k in range(n - 1):
        told[2 + k, k] += 5
    told = np.log(told / told.sum(axis=0, keepdims=True))
    hosts, domains, suffixes = (again(by).select(*by, vector.alias(f"{by[0]}_p")) for by in (["host", "domain", "suffix"], ["domain", "suffix"], ["suffix"]))
    priors = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "domain", "suffix", "host_p", "domain_p", "suffix_p")
    priors = stored(priors, folder, "priors")  # so that the join below is one of its own, whose hot hosts Spark can split

    def second(batches):
        for batch in batches:
            logs, some = model.evidence(_plain(batch.column("text"), html))
            own = normal(logs) * some[:, None]
            prior = np.broadcast_to((total + 1) / (total.sum() + n), own.shape)
            for level in ("suffix_p", "domain_p", "host_p"):
                counts = np.array(batch.column(level).to_pylist(), np.float64).reshape(len(own), n)
                counts = np.maximum(counts - own, 0)
                prior = (counts + KAPPA * prior) / (counts.sum(axis=1, keepdims=True) + KAPPA)
            said = batch.column("declared").to_pylist()
            declared = np.array([1 if d and d not in at else 2 + at[d] if d else 0 for d in said], np.int64)
            p = normal(logs + told[declared] + np.log(prior))
            best = p.argmax(axis=1)
            silent = ~some & (declared < 2) & np.array([not h for h in batch.column("host").to_pylist()], bool)
            best[silent] = n - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array([names[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array([names[k] if s else UND for k, s in zip(own.argmax(axis=1), some)], pa.string()), batch.column("declared")],
                names=["row", "posterior", "language", "probability", "text_language", "declared"],
            )

    ready = rows.join(priors, list(LEVELS)).select("row", "text", "declared", "host", "suffix_p", "domain_p", "host_p")
    row_type = rows.schema["row"].dataType.simpleString()
    return ready.mapInArrow(lean(second), f"row {row_type}, posterior array<double>, language string, probability double, text_language string, declared string")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, url, declared, text_language, language, probability of each page."""
    found = identified(from_pages(pages), train(labelled), html=True)
    return found.select("row.page_id", "row.url", "declared", "text_language", "language", "probability")


def keep_identified(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose likeliest hypothesis by all evidence is a language, all columns untouched."""
    return identified(from_documents(docs), train(labelled)).filter(F.col("language") != UND).select("row.*")
