"""Language of words and documents by a linear-chain conditional random field (operator 6).

Every word gets features: its affixes and inner n-grams, itself, and the languages in
whose lexicon it stands.  Their weights and the label transitions are learned together by
maximising the likelihood of labelled sequences, which join runs of words of documents in
different languages, as code-switched text does.  Forward-backward gives each word's
posterior; a document's language has the largest mean posterior over its words with
letters, and that mean is the score.

The model learns every language that a labelled document has.  It is fitted on a bounded
sample: whole labelled documents chosen by a hash of the id, at most ``PER_LANGUAGE`` of a
language (fewer, but ``LEAST_PER_LANGUAGE``, where there are so many languages that all would
pass ``SAMPLE_ROWS``), of ``SAMPLE_BYTES`` in all shared alike by the languages, and of these
at most ``LANGUAGE_WORDS`` words of a language in runs.  Prediction covers every document and
reads nothing but its text.

Null text, or no letter: ``und`` with score 0.  Without labelled documents everything is
``und``.  Ties go to the language that sorts first.  Repeated rows and ids are kept.  Only
the named columns are read.  Empty table: empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopeforge.session import materialize

from .common import mix, powers, remembered, table, text_slices

PER_LANGUAGE, LEAST_PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_BYTES = 400, 20, 25_600, 256 << 20
#: Words of a run, runs of a training sequence, words of all runs of a language.
RUN_WORDS, RUNS, LANGUAGE_WORDS = 24, 8, 200_000
LEXICON_WORDS = 500
#: Buckets of features; a power of two, halved as languages double so that the weights stay of one size.
BUCKETS, WEIGHTS = 1 << 17, 1 << 23
EPOCHS, STEP_SEQUENCES, RATE, DECAY = 5, 128, 0.05, 1e-4
CACHE_WORDS = 300_000
#: Word types whose features are made at a time.
TYPES = 20_000
#: Bytes of text whose chains run side by side; the longest document sets their steps.
CHAIN_BYTES = 4 << 20


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def features(words: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of lower-case words, word after word, and how many each has:
    affixes of 1 to 4 letters, n-grams of 2 and 3 with the word's edges, the word, and the
    lexicons that hold it.  A word without letters has none."""
    plain = [letters(w) for w in words]
    size = np.array([len(w) for w in plain], np.int64)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    point = np.frombuffer(("^" + "$^".join(plain) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    whole = size + 2
    first = np.cumsum(whole) - whole + 1  # the first letter
    owner = np.repeat(np.arange(len(words)), whole)
    rest = np.repeat(first - 1 + whole, whole) - np.arange(len(point))  # places to the end of the word
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def put(kind: int, own: np.ndarray, at: np.ndarray, k: int) -> None:
        """The runs of ``k`` code points at ``at``."""
        total = np.full(len(at), kind, np.uint64)
        for j in range(k):
            total = total * np.uint64(0xD1342543DE82EF95) + point[at + j]
        found.append((own, mix(total)))

    for k in (2, 3):
        at = np.flatnonzero((rest >= k) & (size[owner] > 0))
        put(k, owner[at], at, k)
    for k in range(1, 5):
        own = np.flatnonzero(size >= k)
        put(10 + k, own, first[own], k)
        put(20 + k, own, first[own] + size[own] - k, k)
    total = np.zeros(len(point) + 1, np.uint64)
    np.cumsum(point * powers("up", len(point))[:len(point)], out=total[1:])
    own = np.flatnonzero(size)
    word = (total[first[own] + size[own]] - total[first[own]]) * powers("down", len(point))[first[own]]
    found.append((own, mix(word + np.uint64(30))))
    held = [(i, k) for i, w in enumerate(plain) if w in lexicon for k in lexicon[w]]
    if held:
        own, lang = np.array(held).T
        found.append((own, mix(lang.astype(np.uint64) + np.uint64(40))))
    own = np.concatenate([o for o, _ in found])
    bucket = (np.concatenate([h for _, h in found]) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))


class Chain:
    """The field: languages, feature weights, start and transition scores, lexicon."""

    def __init__(self, languages: list[str], lexicon: dict[str, list[int]]):
        self.languages, self.lexicon, self.key = languages, lexicon, uuid.uuid4().hex
        n = len(languages)
        self.buckets = BUCKETS
        while self.buckets * n > WEIGHTS and self.buckets > 1 << 12:
            self.buckets //= 2
        self.weights = np.zeros((self.buckets, n), np.float32)
        self.start, self.move = np.zeros(n), np.zeros((n, n))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of word types by language."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), TYPES):
            flat, n = features(words[at:at + TYPES], self.lexicon)
            flat &= self.buckets - 1
            total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.weights[flat], 0, dtype=float)])
            ends = np.cumsum(n)
            out[at:at + TYPES] = total[ends] - total[ends - n]
        return out

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of every word, over chains that lie one behind the other in ``scores``."""
        both, back = self.passes(scores, lengths)[:2]
        both *= back
        del back
        both /= both.sum(1, keepdims=True)
        return both

    def expected_moves(self, ahead: np.ndarray, back: np.ndarray, heat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected number of each transition over all chains."""
        later = np.ones(len(heat), bool)
        later[np.cumsum(lengths) - lengths] = False
        later = np.flatnonzero(later)
        pair = ahead[later - 1][:, :, None] * np.exp(self.move)[None] * (heat[later] * back[later])[:, None, :]
        return (pair / pair.sum((1, 2), keepdims=True)).sum(0)

    def passes(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward values of every word, scaled to a sum of one, and its heat."""
        heat = scores - scores.max(1, keepdims=True)
        heat = np.exp(heat, out=heat).astype(np.float64, copy=False)
        start = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        first, size = start[order], lengths[order]
        move, begin = np.exp(self.move), np.exp(self.start)
        ahead, back = np.empty_like(heat), np.empty_like(heat)
        steps = int(size[0]) if len(size) else 0
        # chains longer than t come first in the order
        alive = np.searchsorted(-size, -np.arange(steps), side="left")
        for t in range(steps):
            at = first[:alive[t]] + t
            now = heat[at] * (begin if t == 0 else now[:alive[t]] @ move)
            now /= now.sum(1, keepdims=True)
            ahead[at] = now
        now = np.ones((0, heat.shape[1]))
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            at = first[:k] + t
            if len(now) < k:
                now = np.concatenate([now, np.ones((k - len(now), heat.shape[1]))])
            back[at] = now
            now = (now * heat[at]) @ move.T
            now /= now.sum(1, keepdims=True)
        return ahead, back, heat


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Chain:
    """A field learned from (language, text) rows by stochastic gradient ascent (Adagrad)."""
    samples = sorted(samples)
    languages = sorted({lang for lang, _ in samples})
    place = {lang: i for i, lang in enumerate(languages)}
    words_of: dict[int, list[list[str]]] = {i: [] for i in range(len(languages))}
    for lang, text in samples:
        words_of[place[lang]].append(text.lower().split())
    lexicon: dict[str, list[int]] = {}
    for k, documents in words_of.items():
        seen: dict[str, int] = {}
        for words in documents:
            for w in words:
                seen[w] = seen.get(w, 0) + 1
        plain: dict[str, int] = {}
        for w, n in seen.items():
            if w := letters(w):
                plain[w] = plain.get(w, 0) + n
        for w, n in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            if n > 1:
                lexicon.setdefault(w, []).append(k)
    chain = Chain(languages, lexicon)
    rng = np.random.default_rng(seed)
    runs: list[tuple[int, list[str]]] = []
    for k, documents in words_of.items():
        own = [words[i:i + RUN_WORDS] for words in documents for i in range(0, len(words), RUN_WORDS)]
        rng.shuffle(own)
        runs += [(k, run) for run in own[:LANGUAGE_WORDS // RUN_WORDS]]
    if len(languages) < 2 or not runs:
        return chain
    types = sorted({w for _, run in runs for w in run})
    row = {w: i for i, w in enumerate(types)}
    flat, n_of = features(types, lexicon)
    flat &= chain.buckets - 1
    begin = np.cumsum(n_of) - n_of
    n = len(languages)
    squares, move_squares, start_squares = np.full((chain.buckets, n), 1e-6), np.full((n, n), 1e-6), np.full(n, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        step = RUNS * STEP_SEQUENCES
        for at in range(0, len(order), step):
            mine = [runs[i] for i in order[at:at + step]]
            word = np.array([row[w] for _, run in mine for w in run])
            gold = np.repeat([k for k, _ in mine], [len(run) for _, run in mine])
            lengths = np.add.reduceat([len(run) for _, run in mine], np.arange(0, len(mine), RUNS))
            used, which = np.unique(word, return_inverse=True)
            count = n_of[used]
            ends = np.cumsum(count)
            feature = flat[np.repeat(begin[used] - (ends - count), count) + np.arange(int(ends[-1]))]
            total = np.concatenate([np.zeros((1, n)), np.cumsum(chain.weights[feature], 0, dtype=float)])
            scores = (total[ends] - total[ends - count])[which]
            ahead, back, heat = chain.passes(scores, lengths)
            post = ahead * back
            post /= post.sum(1, keepdims=True)
            slope = -post
            slope[np.arange(len(gold)), gold] += 1
            by_type = np.zeros((len(used), n))
            np.add.at(by_type, which, slope)
            spread = np.repeat(by_type, count, axis=0)
            change = np.stack([np.bincount(feature, spread[:, k], chain.buckets) for k in range(n)], 1)
            change = change / len(lengths) - DECAY * chain.weights
            squares += change ** 2
            chain.weights += (RATE * change / np.sqrt(squares)).astype(np.float32)
            first = np.cumsum(lengths) - lengths
            inner = np.ones(len(gold), bool)
            inner[first] = False
            later = np.flatnonzero(inner)
            seen_moves = np.zeros((n, n))
            np.add.at(seen_moves, (gold[later - 1], gold[later]), 1)
            change = (seen_moves - chain.expected_moves(ahead, back, heat, lengths)) / len(lengths) - DECAY * chain.move
            move_squares += change ** 2
            chain.move += RATE * change / np.sqrt(move_squares)
            change = (np.bincount(gold[first], minlength=n) - post[first].sum(0)) / len(lengths)
            start_squares += change ** 2
            chain.start += RATE * change / np.sqrt(start_squares)
    return chain


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string")) % 3 == 1


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample: whole texts of labelled documents that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(
        ~F.coalesce(held_out(), F.lit(False)))
    n_of = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = n_of.count()
    if not languages:
        return []
    per = min(PER_LANGUAGE, max(LEAST_PER_LANGUAGE, SAMPLE_ROWS // languages))
    most = SAMPLE_BYTES // languages
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    best = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    # about twice the wanted share by hash first, so that few rows reach the ranking
    rows = (known.filter(F.octet_length("text") <= most).withColumn("place", place)
            .join(F.broadcast(n_of), "lang").filter(F.col("place") < (2 * per + 20) / F.col("n"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per)
            .withColumn("bytes", F.sum(F.octet_length("text")).over(best)).filter(F.col("bytes") <= most))
    return [(r["lang"], r["text"]) for r in rows.select("lang", "text").collect()]


class Labeller:
    """Posterior of every word of a list of texts, with remembered word types."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.chain.languages)), np.float32)
        self.plain = np.zeros(0, bool)

    def words(self, texts: list[str]):
        """(rows of types, number of words of each text, posteriors of words)."""
        cut = [t.lower().split() for t in texts]
        flat = [w for words in cut for w in words]
        need = set(flat)
        need.difference_update(self.row)
        if len(self.row) + len(need) > CACHE_WORDS:
            self.clear()
            need = set(flat)
        if need:
            new = list(need)
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            self.scores = np.concatenate([self.scores, self.chain.emissions(new)])
            self.plain = np.concatenate([self.plain, np.array([bool(letters(w)) for w in new], bool)])
        rows = np.fromiter(map(self.row.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(w) for w in cut], np.int64)
        full = lengths > 0
        del cut, flat, need  # as strings a slice is many times its bytes
        return rows, lengths, self.chain.posteriors(self.scores[rows], lengths[full])

    def documents(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and the mean of its words' highest posteriors of each text."""
        rows, lengths, post = self.words(texts)
        plain = self.plain[rows]
        owner = np.repeat(np.arange(len(texts)), lengths)
        n = np.bincount(owner[plain], minlength=len(texts))
        mean = np.stack([np.bincount(owner[plain], post[plain, k], len(texts))
                         for k in range(len(self.chain.languages))], 1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        names = [self.chain.languages[k] if m else "und" for k, m in zip(best.tolist(), n.tolist())]
        sure = np.bincount(owner[plain], post[plain].max(1), len(texts)) / np.maximum(n, 1)
        return names, np.where(n > 0, np.clip(mean[np.arange(len(texts)), best], 0, 1), 0.0), np.clip(sure, 0, 1)


def labeller_of(chain: Chain) -> Labeller:
    """The labeller of this worker process, shared by its tasks."""
    return remembered(f"labeller {chain.key}", lambda: Labeller(chain))


def predict(docs: DataFrame, chain: Chain, keep: list[str], text: str = "text",
            names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language and the score, called ``names``; a
    third name is that of the mean of the words' highest posteriors."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chain)  # weights: BUCKETS x languages; lexicon: LEXICON_WORDS a language
    own = docs.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in keep)

    def run(batches):
        labeller = labeller_of(shared.value)
        for batch in batches:
            for part in text_slices(batch, text, CHAIN_BYTES):
                texts = part.column(text).fill_null("").to_pylist()
                if labeller.chain.languages:
                    found, *scores = labeller.documents(texts)
                else:
                    found, scores = ["und"] * len(texts), [np.zeros(len(texts))] * 2
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(found, pa.string()),
                     *[pa.array(s, pa.float64()) for s in scores[:len(names) - 1]]],
                    names=[*keep, *names])

    return own.mapInArrow(run, f"{schema}, `{names[0]}` string, " + ", ".join(f"`{n}` double" for n in names[1:]))


def op6_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(training_rows(docs)), ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")
