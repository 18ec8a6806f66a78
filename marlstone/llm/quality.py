"""Quality rules: document metrics, rule failures by host with an empirical beta prior, host verdicts joined back.

Words are maximal runs of other than the six ASCII white-space characters.  A document fails the base rules when
it has under 20 words, or over 30 % of its words lie in 8-word windows that occur more than once in it.  The
method then judges hosts: failures of all rules are counted by host, each host's rate is shrunk towards the mean
of all hosts by a beta prior fitted to the hosts by the method of moments, and the shrunk rate sets how strict the
symbol and repetition limits are for that host's documents.  A document with no symbols, no repeated lines and no
repeated windows passes the method at any host.

Defined cases: null and empty texts have no words and fail; a null host is a host of its own; repeated rows each
count and are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import byte_texts, map_batches, materialize

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Shrunk failure rates from which a host counts as suspect, or up to which as trusted.
SUSPECT, TRUSTED = 0.5, 0.02
#: Percent of symbols to words, and of repeated words, above which a document fails, by its host's class.
LIMITS = {"trusted": (25, 30), "normal": (10, 30), "suspect": (2, 10)}

_NOT_POINTS = SPACES + bytes(range(0x80, 0xC0))
_BASE = np.uint64(0x9E3779B97F4A7C15)

METRICS = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(docs: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """Words of each document inside windows that the document holds twice or more.

    Windows of all documents are hashed together; equal hashes are confirmed on the words themselves."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    out = np.zeros(len(docs), np.int64)
    total = int(sizes.sum())
    if total < window:
        return out
    words = np.fromiter((hash(w) for d in docs for w in d), np.int64, total).astype(np.uint64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    n = total - window + 1
    acc = np.zeros(n, np.uint64)
    for k in range(window):
        acc = acc * _BASE + words[k : k + n]
    acc ^= owner[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
    order = inside[np.argsort(acc[inside], kind="stable")]
    same = acc[order[1:]] == acc[order[:-1]]
    if not same.any():
        return out
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    seen: dict[tuple, int] = {}
    covered = np.zeros(total + 1, np.int32)
    hits = np.sort(order[twin])
    for at in hits.tolist():
        d = int(owner[at])
        i = at - int(starts[d])
        key = (d, *docs[d][i : i + window])
        first = seen.setdefault(key, at)
        if first != at:
            for a in (first, at):
                covered[a] += 1
                covered[a + window] -= 1
    mask = np.cumsum(covered[:-1]) > 0
    return np.bincount(owner[mask], minlength=len(docs)).astype(np.int64)


def document_metrics(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """One row of METRICS for each document; host defaults to its source."""
    host = F.col("source") if host is None else host

    def start():
        def each(batch):
            texts = byte_texts(batch.column("text"))
            words = [t.split() for t in texts]
            lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
            yield {
                "doc_id": batch.column("doc_id"),
                "host": batch.column("host"),
                "text_hash": batch.column("text_hash"),
                "n_words": [len(w) for w in words],
                "word_chars": [len(t.translate(None, _NOT_POINTS)) for t in texts],
                "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
                "n_dup_lines": [len(x) - len(set(x)) for x in lines],
                "n_repeat_words": repeated_words(words),
            }

        return each

    return map_batches(docs.select("doc_id", host.cast("string").alias("host"), F.xxhash64("text").alias("text_hash"), "text"), METRICS, start)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """A failure that counts against the host: the base rules or the symbol limit of a normal host."""
    return base_failed() | (100 * F.col("n_symbols") > LIMITS["normal"][0] * F.col("n_words"))


def host_verdicts(metrics: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, host_class.

    The prior Beta(a, b) has the mean of all documents' failures; its strength comes from the spread of the
    hosts' rates beyond binomial noise (one global row, joined by broadcast)."""
    hosts = metrics.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(rule_failed().cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("spread"),
        F.avg(1 / F.col("n_docs")).alias("inverse_n"),
    )
    m, noise = F.col("mean"), F.col("mean") * (1 - F.col("mean")) * F.col("inverse_n")
    between = F.greatest(F.col("spread") - noise, F.lit(1e-6))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(1e4), m * (1 - m) / between - 1))
    prior = prior.select(m.alias("prior_mean"), strength.alias("prior_strength"))
    shrunk = (F.col("n_failed") + F.col("prior_mean") * F.col("prior_strength")) / (F.col("n_docs") + F.col("prior_strength"))
    return (
        hosts.join(F.broadcast(prior))  # a single row
        .withColumn("shrunk_rate", shrunk)
        .withColumn("host_class", F.when(F.col("shrunk_rate") >= SUSPECT, "suspect").when(F.col("shrunk_rate") <= TRUSTED, "trusted").otherwise("normal"))
        .select("host", "n_docs", "n_failed", "shrunk_rate", "host_class")
    )


def _judged(docs: DataFrame, host: Column | None) -> DataFrame:
    metrics = materialize(document_metrics(docs, host), "quality")
    judged = metrics.join(host_verdicts(metrics).select(F.col("host").alias("judged_host"), F.col("shrunk_rate").alias("host_rate"), "host_class"), F.col("host").eqNullSafe(F.col("judged_host")), "left")
    limit = lambda k: F.element_at(F.create_map(*[F.lit(x) for c, v in LIMITS.items() for x in (c, v[k])]), F.col("host_class"))
    passes = (100 * F.col("n_symbols") <= limit(0) * F.col("n_words")) & (100 * F.col("n_repeat_words") <= limit(1) * F.col("n_words"))
    return judged.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & passes})


def quality_verdicts(docs: DataFrame, host: Column | None = None) -> DataFrame:
    """doc_id, the base metrics, base_failed, kept, host_rate and host_class for each row of docs."""
    return _judged(docs, host).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "host_class")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs whose verdict is kept, with the columns of docs.  A row is found again by its doc_id, source and the hash of its
    text, so that rows of one doc_id, or without one, are judged each; equal rows share their fate."""
    bad = _judged(docs, None).filter(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("host").alias("bad_host"), F.col("text_hash").alias("bad_text")).distinct()
    key = {"bad_id": docs["doc_id"], "bad_host": docs["source"].cast("string"), "bad_text": F.xxhash64(docs["text"])}
    names = [f"__{n}" for n in key]
    marked = docs.select(*(docs[c] for c in docs.columns), *(k.alias(n) for k, n in zip(key.values(), names)))
    return marked.join(bad.toDF(*(f"{n}_" for n in names)), [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names], "left_anti").drop(*names)
