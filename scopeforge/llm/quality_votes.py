"""Quality by weak supervision (operator 5).

Rules look at counts of a whole text and vote good, bad or abstain.  Expectation
maximisation over the votes of all documents estimates how often each rule votes what on
good and on bad documents, and the share of good ones; a document's posterior probability
of being good decides, in place of passing every rule.

The votes of the corpus enter as one row per vote pattern (at most 3 ** rules rows, each
with its number of documents), so what reaches the driver has a fixed bound.

Null or empty text: all counts 0, the base check fails.  Repeated rows and ids are kept
and count each.  Only the named columns are read.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import code_points, gram_hashes, inside, mix, span_hashes, table, text_buffer, text_slices, words_of

REPEAT_WORDS = 8
#: Most that a rule may be taken to vote bad on good documents; keeps the two classes of
#: the estimate from being any other split of the corpus (by language, by length).
FALSE_ALARMS = 0.005
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars",
          "n_upper", "n_stops", "n_bangs", "n_distinct"]
_BYTES = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(65, 91)), "n_stops": b".!?", "n_bangs": b"!"}
_FLAGS = {}
for _name, _set in _BYTES.items():
    _FLAGS[_name] = np.zeros(256, bool)
    _FLAGS[_name][list(_set)] = True


def _per_document(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(np.concatenate([[0], total[ends]]))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more; whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        again[order[1:]] = same
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
    return twice, again


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column."""
    buf, off = text_buffer(column)
    docs = len(off) - 1
    starts, ends, n_words = words_of(buf, off)
    upto = np.cumsum(n_words)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    out = {"n_words": n_words, "word_chars": _per_document(lead[ends] - lead[starts], upto),
           "n_chars": code_points(buf, off)}
    for name, flags in _FLAGS.items():
        out[name] = _per_document(flags[buf], off[1:])

    breaks = np.flatnonzero(buf == 10)
    lines = np.diff(np.searchsorted(breaks, off)) + 1
    begin = np.sort(np.concatenate([off[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, off[1:]]))
    owner = np.repeat(np.arange(docs), lines)
    has_word = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owner = begin[has_word], end[has_word], owner[has_word]
    salt = mix(np.arange(docs, dtype=np.uint64) + np.uint64(1))
    again = _repeats(span_hashes(buf, begin, end) + salt[owner])[1]
    out["n_lines"] = np.bincount(owner, minlength=docs)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=docs)

    words = span_hashes(buf, starts, ends)
    owner = np.repeat(np.arange(docs), n_words)
    out["n_distinct"] = np.bincount(owner[~_repeats(words + salt[owner])[1]], minlength=docs)
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(inside(n_words, REPEAT_WORDS))
    grams = gram_hashes(words, REPEAT_WORDS)[at] + salt[owner[at]]
    at = at[_repeats(grams)[0]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT_WORDS, -1)
    out["n_repeat_words"] = _per_document(np.cumsum(edge[:-1]) > 0, upto)
    return out


def text_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts as longs) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text):
                got = counts_of(part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), *[pa.array(got[c].astype(np.int64)) for c in COUNTS]],
                    names=[id_column, *COUNTS])

    return docs.select(id_column, text).mapInArrow(
        run, f"`{id_column}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstain.  All abstain without words."""
    n = F.col("n_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(n == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    stops = F.col("n_stops") / F.greatest(n, F.lit(1))
    return {
        "symbols": vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") == 0),
        "duplicate_lines": vote(F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
                                (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "repeated_windows": vote(F.col("n_repeat_words") * 5 > n, F.col("n_repeat_words") == 0),
        "upper_case": vote(F.col("n_upper") * 4 > F.col("n_chars"), F.col("n_upper") * 12 < F.col("n_chars")),
        "sentence_ends": vote((stops > 0.5) | ((F.col("n_stops") == 0) & (n >= 20)), stops.between(0.02, 0.25)),
        "word_length": vote((mean < 3.5) | (mean > 6.8), mean.between(4.0, 6.0)),
        "distinct_words": vote(F.col("n_distinct") * 10 < n * 3, F.col("n_distinct") * 100 > n * 45),
        "exclamations": vote(F.col("n_bangs") * 5 > n, F.col("n_bangs") * 50 <= n),
    }


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 300, tolerance: float = 1e-10):
    """Expectation maximisation for two classes and independent rules with votes in
    {-1, 0, 1}; a rule's bad votes on good documents are held at ``FALSE_ALARMS`` at most.
    Returns the prior of good and the probabilities [class, rule, vote + 1]."""
    n_rules = patterns.shape[1]
    table_ = np.empty((2, n_rules, 3))
    table_[1], table_[0] = [0.1, 0.2, 0.7], [0.5, 0.2, 0.3]
    prior, last = 0.8, -np.inf
    one_hot = patterns[:, :, None] + 1 == np.arange(3)
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", one_hot, np.log(table_)) + np.log([1 - prior, prior])
        top = logs.max(1, keepdims=True)
        like = np.exp(logs - top)
        total = like.sum(1, keepdims=True)
        post = like / total
        score = float((weights * (np.log(total) + top)[:, 0]).sum())
        mass = post * weights[:, None]
        table_ = np.einsum("prv,pc->crv", one_hot, mass) + 0.5
        table_ /= table_.sum(2, keepdims=True)
        over = table_[1, :, 0] > FALSE_ALARMS
        rest = table_[1, over, 1:]
        table_[1, over, 1:] = rest * ((1 - FALSE_ALARMS) / rest.sum(1, keepdims=True))
        table_[1, over, 0] = FALSE_ALARMS
        prior = float((mass[:, 1].sum() + 1) / (weights.sum() + 2))
        if abs(score - last) <= tolerance * abs(score):
            break
        last = score
    return prior, table_


def posterior(counted: DataFrame) -> Column:
    """Posterior probability of being good, as a column over the counts; estimated on the
    documents that pass the base check."""
    votes = rules()
    rows = counted.filter("NOT base_failed").groupBy(*[v.cast("int").alias(k) for k, v in votes.items()]).count().collect()  # <= 3 ** 8 rows
    if not rows:
        return F.lit(0.0)
    # sorted, so that sums and with them the last bits do not depend on the order of arrival
    rows = sorted(tuple(r) for r in rows)
    prior, p = estimate(np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows], float))
    gain = np.log(p[1]) - np.log(p[0])
    logit = F.lit(float(np.log(prior / (1 - prior))))
    for r, v in enumerate(votes.values()):
        logit = logit + F.element_at(F.array(*[F.lit(float(x)) for x in gain[r]]), (v + 2).cast("int"))
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``quality`` (posterior) and ``kept`` of every document."""
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    counted = materialize(text_counts(docs).withColumn("base_failed", failed), "quality-counts")
    return (counted.withColumn("quality", posterior(counted))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)))


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "quality")
