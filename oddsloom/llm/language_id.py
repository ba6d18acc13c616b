"""Language identification by fusing evidence.

Four sources are combined for a text: the likelihood of its character trigrams
under each language, the language its markup declares, the suffix of its
address, and a prior of its host. How far a declaration or a suffix can be
trusted is learned from all rows, by counting it against the language that the
text alone speaks for. Host priors are counted in the same way by grouped
aggregation and smoothed in steps: a host towards its domain, the domain
towards all rows.

Known are all languages that at least ``LEAST_TEXTS`` of all labelled texts
have, however many there are. The trigram model of each is learned from all
its texts or, if these are more, from about its share of ``TRAIN_ROWS`` (at
least ``LANGUAGE_ROWS``), chosen by hash. One class more, ``und``, stands for
text that no known language explains: every trigram equally likely.

Edge cases: a text without three bytes has no likelihood, so the other sources
decide, and without any of them the answer is ``und``; null texts, addresses
and declarations are no evidence; long texts are read whole; repeated rows get
equal answers; an empty table gives an empty result; other columns are kept
or ignored as each function says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.cluster import written

TRAIN_ROWS = 20_000
LANGUAGE_ROWS = 1_000
LEAST_TEXTS = 5
#: Languages whose counts a task or the driver holds at once.
HELD_LANGUAGES = 64
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Log probability of a trigram that belongs to no language.
UNKNOWN_LOG = -float(np.log(30.0**3))
#: Part of a text's trigrams that may belong to no language.
NOISE = 0.2
#: Trigrams are not independent: a text speaks as loudly as this many at most.
WEIGHT = 60.0
#: Strength of the parent in each smoothing step.
KAPPA = 5.0
#: Up to so many hosts a table of priors is broadcast (under 600 bytes each); beyond that it is joined by a shuffle.
BROADCAST_HOSTS = 50_000

_TAGS = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;"


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    b = data.astype(np.int32)
    return ((b[:-2] * 31 + b[1:-1]) * 131 + b[2:] * 7919) & (BUCKETS - 1)


#: Letters and bytes beyond ASCII stand for themselves, all else for a space.
_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def text_bytes(texts: pa.Array, markup: bool) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, A-Z lowered, with one space between words, and row offsets."""
    texts = pc.fill_null(texts, "")
    if markup:
        texts = pc.replace_substring_regex(texts, _TAGS, " ")
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
    data, offsets = _LETTERS[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def label_of(column: str) -> Column:
    """A declared language as it is compared: trimmed and in lower case."""
    return F.lower(F.trim(F.col(column).cast("string")))


def learn_languages(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigram buckets under each."""
    given = [F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), label_of(lang_column).alias("lang")]
    labelled = documents.select(*given).where("lang is not null and text is not null")
    # One row a language, each of ``LEAST_TEXTS`` texts or more.
    numbers = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).where(f"n >= {LEAST_TEXTS}").collect()}
    langs = sorted(numbers)
    quota = max(LANGUAGE_ROWS, rows // max(1, len(langs)))
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in numbers.items() for x in (lang, min(1.0, quota / n))]), F.col("lang"))
    texts = labelled.withColumn("share", share).where(f"share >= 1 or pmod(xxhash64(id, text), {1 << 30}) < share * {1 << 30}").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in total.items():
                seen = np.flatnonzero(counts)
                yield pa.record_batch({"lang": pa.array([lang] * len(seen)), "bucket": pa.array(seen, pa.int32()), "n": pa.array(counts[seen], pa.int64())})
            total.clear()

        for batch in batches:
            for part in at.slices(batch, "text", at.BYTE_SLICE):
                langs = part.column("lang").to_pylist()
                data, offsets = text_bytes(part.column("text"), False)
                for lang, a, b in zip(langs, offsets[:-1], offsets[1:]):
                    if b - a >= 3:
                        if lang not in total and len(total) >= HELD_LANGUAGES:
                            yield from flush()
                        total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                        total[lang] += np.bincount(trigram_buckets(data[a:b]), minlength=BUCKETS)
        yield from flush()

    counted = texts.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = written(counted, "language-trigrams")
    table = np.zeros((BUCKETS, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    for first in range(0, len(langs), HELD_LANGUAGES):
        found = counted.where(F.col("lang").isin(langs[first : first + HELD_LANGUAGES])).toArrow()  # at most BUCKETS rows a language
        columns = np.array([place[x] for x in found.column("lang").to_pylist()], dtype=np.int64)
        table[found.column("bucket").to_numpy(), columns] = found.column("n").to_numpy()
    # A part of every text may be of no language (names, codes), so no such part can outweigh the rest.
    known = (table + 0.05) / (table.sum(axis=0, keepdims=True) + 0.05 * BUCKETS)
    return langs, np.log((1 - NOISE) * known + NOISE * np.exp(UNKNOWN_LOG))


def evidence_of(spark: SparkSession, model: np.ndarray, markup: bool = False) -> Callable[[Column], Column]:
    """Turns a text column into weighed log likelihoods of the languages and of ``und``, or null for a text that is too short."""
    at.small_batches(spark)
    shared = spark.sparkContext.broadcast(model.astype(np.float32))

    def evidence(texts: pa.Array) -> pa.Array:
        table = shared.value
        data, offsets = text_bytes(texts, markup)
        n = np.maximum(np.diff(offsets) - 2, 0)
        rows = np.zeros((len(n), table.shape[1] + 1))
        if len(data) >= 3:
            buckets = trigram_buckets(data)
            for k in range(table.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(table[buckets, k], dtype=np.float64)])
                rows[:, k] = sums[np.minimum(offsets[:-1] + n, len(buckets))] - sums[np.minimum(offsets[:-1], len(buckets))]
        rows[:, -1] = n * UNKNOWN_LOG
        rows *= (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None]
        return pa.array([r if c else None for r, c in zip(rows.tolist(), n)], pa.list_(pa.float64()))

    return at.text_udf(lambda: evidence, "array<double>", at.BYTE_SLICE)


def best_of(values: Column, names: list[str]) -> Column:
    """The name of the largest value, the first of equal ones."""
    return F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def counts_by(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """How often each language is the text's own, by ``key``: one row for each value, partly summed before any shuffle."""
    return rows.groupBy(key).agg(F.array(*[F.sum((F.col("label") == n).cast("double")) for n in names]).alias("counts"))


def small_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join; the table is broadcast only if it was counted to be small."""
    table = written(table, f"language-{key}")
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_HOSTS else table, key, "left")


class Fusion:
    """What is learned from all rows: trust in declarations and suffixes, and host priors."""

    def __init__(self, rows: DataFrame, langs: list[str]):
        """``rows`` has ``_evidence``, ``declared``, ``suffix``, ``host`` and ``domain``."""
        self.names = [*langs, UNKNOWN]
        labelled = rows.where("_evidence is not null").withColumn("label", best_of(F.col("_evidence"), self.names)).select("label", "declared", "suffix", "host", "domain")
        labelled = written(labelled, "language-labels")
        k = len(self.names)
        all_rows = labelled.agg(F.array(*[F.sum((F.col("label") == n).cast("double")) for n in self.names]).alias("counts")).first()["counts"]
        total = np.array([x or 0.0 for x in all_rows])
        self.prior = (total + 1) / (total.sum() + k)
        self.totals = total
        self.declared = self.likelihood(labelled, "declared")
        self.suffix = self.likelihood(labelled, "suffix")
        smooth = lambda parent: f"transform(counts, (x, i) -> (x + {KAPPA}D * {parent}[i]) / (aggregate(counts, 0D, (a, y) -> a + y) + {KAPPA}D))"
        top = "array(" + ", ".join(f"{p!r}D" for p in self.prior.tolist()) + ")"
        domains = counts_by(labelled.where("domain is not null"), "domain", self.names).select("domain", F.expr(smooth(top)).alias("parent"))
        hosts = labelled.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain"), F.array(*[F.sum((F.col("label") == n).cast("double")) for n in self.names]).alias("counts"))
        self.hosts = hosts.join(domains, "domain", "left").withColumn("parent", F.coalesce("parent", F.expr(top))).select("host", F.expr(f"transform({smooth('parent')}, x -> ln(x))").alias("of_host"))
        self.top = f"transform({top}, x -> ln(x))"

    def likelihood(self, labelled: DataFrame, key: str) -> DataFrame:
        """Log probability of each value of ``key`` under each language, smoothed towards its share of all rows."""
        counts = counts_by(labelled.where(F.col(key).isNotNull()), key, self.names)
        totals = "array(" + ", ".join(f"{t!r}D" for t in self.totals.tolist()) + ")"
        share = f"(aggregate(counts, 0D, (a, y) -> a + y) + 1D) / {float(self.totals.sum() + 1)!r}D"
        return counts.select(key, F.expr(f"transform(counts, (x, i) -> ln((x + {KAPPA}D * {share}) / ({totals}[i] + {KAPPA}D)))").alias(f"of_{key}"))

    def posterior(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``lang``, ``posterior`` and ``text_lang``."""
        for key, table in (("declared", self.declared), ("suffix", self.suffix), ("host", self.hosts)):
            rows = small_join(rows, table, key)
        k = len(self.names)
        zero = f"array_repeat(0D, {k})"
        total = f"coalesce(of_host, {self.top})"
        for part in ("_evidence", "of_declared", "of_suffix"):
            total = f"zip_with({total}, coalesce({part}, {zero}), (a, b) -> a + b)"
        rows = rows.withColumn("_log", F.expr(total))
        rows = rows.withColumn("_sum", F.expr("aggregate(_log, 0D, (s, x) -> s + exp(x - array_max(_log)))"))
        nothing = F.expr("_evidence is null and of_declared is null and of_suffix is null and of_host is null")
        rows = rows.withColumn("lang", F.when(nothing, UNKNOWN).otherwise(best_of(F.col("_log"), self.names)))
        rows = rows.withColumn("posterior", F.when(nothing, 0.0).otherwise(1 / F.col("_sum")))
        rows = rows.withColumn("text_lang", best_of(F.col("_evidence"), self.names))
        return rows.drop("_log", "_sum", "of_host", "of_declared", "of_suffix")


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix of an address; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def identify_pages(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``(page_id, url, host, declared, text_lang, lang, posterior)`` of every page."""
    host, domain, suffix = address_parts(F.col("url").cast("string"))
    declared = F.lower(F.regexp_extract(F.col("html").cast("string"), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), F.when(declared != "", declared).alias("declared"))
    evidence = evidence_of(pages.sparkSession, model, markup=True)
    rows = written(rows.withColumn("_evidence", evidence(F.col("html"))).drop("html"), "language-pages")
    found = Fusion(rows, langs).posterior(rows)
    return found.select("page_id", "url", "host", "declared", "text_lang", "lang", "posterior")


def in_known_language(documents: DataFrame, langs: list[str], model: np.ndarray, text_column: str = "text", declared_column: str = "lang", host_column: str = "source") -> DataFrame:
    """The rows of ``documents`` in one of ``langs``, declared rightly.

    Rejected are those that answer ``und`` and declare none of ``langs``, and
    those that declare one of ``langs`` while all evidence, the declaration
    itself included, answers another one. A text that says too little to
    answer otherwise stays as declared.
    """
    if not langs:  # nothing to tell languages by
        return documents
    # The given row stays whole in one column, whatever its columns are called.
    evidence = evidence_of(documents.sparkSession, model)
    rows = documents.select(
        F.struct(*[F.col(f"`{n}`") for n in documents.columns]).alias("_given"),
        label_of(declared_column).alias("declared"),
        F.col(host_column).cast("string").alias("host"),
        F.lit(None).cast("string").alias("domain"),
        F.lit(None).cast("string").alias("suffix"),
        evidence(F.col(text_column).cast("string")).alias("_evidence"),
    )
    rows = Fusion(rows.drop("_given"), langs).posterior(rows)
    return rows.where(F.when(F.coalesce(F.col("declared").isin(langs), F.lit(False)), F.col("lang").isin(UNKNOWN, F.col("declared"))).otherwise(F.col("lang") != UNKNOWN)).select("_given.*")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    documents, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    return identify_pages(pages, *learn_languages(documents))
