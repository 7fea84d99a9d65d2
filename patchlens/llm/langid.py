"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is given; each language has a probability for every piece. The likelihood of a
text is the sum over all its segmentations into pieces of the product of their probabilities, by the forward
algorithm. Text is lower-cased and each run of other than letters becomes one word boundary. No piece of the
vocabulary holds a boundary inside, so the sum over the segmentations of a text is the product of the sums for its
words; each distinct word of a batch is scored once, all words of a length together.

Letters that the vocabulary lacks are spelled with the 256 byte pieces.

Null and empty texts and texts without letters are `und` with score 0. Equal texts give equal values; ties go to the
language first in sorted order, equal rows stay separate rows. Without any labelled row everything is `und`. A long text
is scored whole, by its distinct words. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, slices

EDGE = "▁"
UNDETERMINED = "und"
#: Bound of the sample that a model is fitted on: rows of a language, characters of a row, distinct words of a language.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_WORDS = 500, 100_000, 30_000
EM_ROUNDS = 2
SMOOTHING = 0.05
#: Alphas below this are scaled up by its inverse.
TINY = 1e-120
#: Words that a worker keeps the scores of: so many recent ones, and as many before them.
CACHE_WORDS = 250_000
#: Letters that have a column in the trie's dense table.
DENSE = 64


class Lattice:
    """A trie of the pieces whose arcs are found for many words at once: sorted keys of (node, letter)."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p})
        used = Counter(c for p in self.pieces for c in p)
        letters = sorted(used, key=lambda c: (-used[c], c))  # the commonest have the lowest codes
        self.code_of = np.full(0x110000, len(letters), np.int32)
        self.code_of[[ord(c) for c in letters]] = np.arange(len(letters))
        self.width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        code = {c: i for i, c in enumerate(letters)}
        for i, piece in enumerate(self.pieces):
            node = 0
            for c in piece:
                node = nodes.setdefault((node, code[c]), len(nodes) + 1)
            ends[node] = i
        keys = np.array([n * self.width + c for n, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.piece_at = np.full(len(nodes) + 1, -1, np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.table = np.zeros((len(nodes) + 1, DENSE), np.int32)
        for (node, c), child in nodes.items():
            if c < DENSE:
                self.table[node, c] = child
        self.longest = max(map(len, self.pieces), default=1)
        self.single = np.array([nodes.get((0, i), 0) and ends.get(nodes[(0, i)], -1) >= 0 for i in range(len(letters))] + [False], bool)

    @property
    def size(self) -> int:
        """Pieces, then the 256 bytes."""
        return len(self.pieces) + 256

    def codes(self, points: np.ndarray) -> np.ndarray:
        return self.code_of[points]

    def arcs(self, codes: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, rows, pieces) of the pieces that begin at a place in the words; codes: a row for each word."""
        rows, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        dense = codes.size and codes.max() < DENSE
        for end in range(start, min(start + self.longest, codes.shape[1])):
            if dense:
                child = self.table[node, codes[rows, end]]
                found = np.flatnonzero(child)
                rows, node = rows[found], child[found]
            else:
                key = node * self.width + codes[rows, end]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = (self.keys[at] == key) & (codes[rows, end] < self.width - 1)
                rows, node = rows[found], self.child[at[found]]
            if not len(rows):
                return
            pieces = self.piece_at[node]
            ends = pieces >= 0
            if ends.any():
                yield end + 1, rows[ends], pieces[ends]

    def spelled(self, points: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, bytes) for the letters of one place that are no pieces."""
        lost = np.flatnonzero(~self.single[codes])
        if not len(lost):
            return
        for p in np.unique(points[lost]):
            yield lost[points[lost] == p], len(self.pieces) + np.frombuffer(chr(p).encode("utf-8", "replace"), np.uint8).astype(np.int64)


def forward(lattice: Lattice, chance: np.ndarray, points: np.ndarray, keep: bool = False):
    """Log likelihood of words of one length under each language; chance: [piece, language].

    keep: the alphas and what scaled them also come back, for the backward pass.
    """
    count, n = points.shape
    codes = lattice.codes(points)
    alpha = np.zeros((n + 1, count, chance.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros((count, 1))
    scales = np.zeros((n + 1, count, 1)) if keep else None
    for i in range(n):
        low = alpha[i].max(1) < TINY
        if low.any():
            alpha[i : i + lattice.longest + 1, low] /= TINY
            scale[low] += np.log(TINY)
        if keep:
            scales[i] = scale
        for end, rows, pieces in lattice.arcs(codes, i):
            alpha[end, rows] += alpha[i, rows] * chance[pieces]
        for rows, spelled in lattice.spelled(points[:, i], codes[:, i]):
            alpha[i + 1, rows] += alpha[i, rows] * chance[spelled].prod(0)
    with np.errstate(divide="ignore"):
        total = np.log(np.maximum(alpha[n], 1e-300)) + scale
    return (total, alpha, codes, scales, scale) if keep else total


def expected(lattice: Lattice, chance: np.ndarray, points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] of words; weight: [word, language]."""
    total, alpha, codes, scales, scale = forward(lattice, chance, points, keep=True)
    count, n = points.shape
    counts = np.zeros_like(chance)
    beta = np.zeros_like(alpha)
    short = (scale == 0).all(1)  # words that needed scaling are too rare and odd to train on
    beta[n] = short[:, None]
    final = np.maximum(alpha[n], 1e-300)
    for i in range(n - 1, -1, -1):
        for end, rows, pieces in lattice.arcs(codes, i):
            through = chance[pieces] * beta[end, rows]
            beta[i, rows] += through
            np.add.at(counts, pieces, alpha[i, rows] * through / final[rows] * weight[rows])
        for rows, spelled in lattice.spelled(points[:, i], codes[:, i]):
            through = chance[spelled].prod(0) * beta[i + 1, rows]
            beta[i, rows] += through
            counts[spelled] += (alpha[i, rows] * through / final[rows] * weight[rows]).sum(0)
    return counts


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, code points [word, place]) of words with a boundary before each; few enough at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        step = max(1, most * 16 // (int(n) + 1))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            text = "".join(EDGE + words[i] for i in part)
            yield part, np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(len(part), n + 1).astype(np.int64)


class Model:
    def __init__(self, pieces: list[str], languages: list[str], chance: np.ndarray):
        self.pieces, self.languages, self.chance = pieces, languages, chance
        self.lattice: Lattice | None = None
        self.recent: dict[str, int] = {}
        self.recent_scores = np.zeros((0, len(languages)))
        self.before, self.before_scores = self.recent, self.recent_scores

    def __getstate__(self):
        return self.pieces, self.languages, self.chance

    def __setstate__(self, state):
        self.__init__(*state)

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods [word, language] of distinct words; kept for the next batch, within a bound."""
        self.lattice = self.lattice or Lattice(self.pieces)
        if len(self.recent) > CACHE_WORDS:
            self.before, self.before_scores = self.recent, self.recent_scores
            self.recent, self.recent_scores = {}, self.before_scores[:0]
        fresh = [w for w in words if w not in self.recent]
        old = np.fromiter((self.before.get(w, -1) for w in fresh), np.int64, len(fresh))
        more = np.empty((len(fresh), len(self.languages)))
        more[old >= 0] = self.before_scores[old[old >= 0]]
        new = np.flatnonzero(old < 0)
        for at, points in by_length([fresh[i] for i in new]):
            more[new[at]] = forward(self.lattice, self.chance, points)
        base = len(self.recent)
        self.recent.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        self.recent_scores = np.concatenate([self.recent_scores, more])
        return self.recent_scores[np.fromiter(map(self.recent.__getitem__, words), np.int64, len(words))]

    def texts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: log likelihoods, words, and bytes of these with their boundaries."""
        clean, words = split_words(text)
        counts = np.asarray(pc.list_value_length(words)).astype(np.int64)
        totals = np.zeros((len(text), len(self.languages)))
        flat = words.flatten().dictionary_encode()
        if len(flat):
            each = self.words(flat.dictionary.to_pylist())
            some = np.flatnonzero(counts)
            totals[some] = np.add.reduceat(each[np.asarray(flat.indices)], (np.cumsum(counts) - counts)[some])
        return totals, counts, np.where(counts, np.asarray(pc.binary_length(clean)).astype(np.int64) + 1, 0)


def split_words(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts lower-cased, each run of other than letters a space; lists of their words."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\pL]+", " "), " ")
    parts = pc.split_pattern(clean, " ")
    # an empty text gives one empty word
    return clean, pc.if_else(pc.equal(clean, ""), pa.scalar([], parts.type), parts)


def public_pieces(path: str) -> list[str]:
    """Ordinary pieces of a SentencePiece file without digits, marks and upper-case letters: others cannot occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in every if (rest := p.removeprefix(EDGE)).isalpha() and rest == rest.lower() or p == EDGE]


def word_counts(labelled: DataFrame, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS, chars: int = SAMPLE_CHARS) -> list:
    """(lang, word, n) of a bounded sample: about `rows` texts a language by a hash, `chars` characters of a text, the `words` most frequent words of a language."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = labelled.groupBy("lang").agg((F.lit(float(rows)) / F.count("*")).alias("share")).collect()
    if not share:
        return []
    keep = F.coalesce(*[F.when(F.col("lang") == r.lang, F.lit(min(1.0, r.share))) for r in share])
    picked = labelled.filter((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003.0) < keep)
    parts = F.filter(F.split(F.lower(F.left("text", F.lit(chars))), r"[^\p{L}]+"), lambda w: w != "")
    counts = picked.select("lang", F.explode(parts).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= words).select("lang", "word", "n").collect()


def fit(counts: list, pieces: list[str], rounds: int = EM_ROUNDS) -> Model:
    """Piece probabilities by expectation-maximisation over (lang, word, n)."""
    languages = sorted({r[0] for r in counts})
    lattice = Lattice(pieces)
    words = sorted({r[1] for r in counts})
    row, lang = {w: i for i, w in enumerate(words)}, {x: k for k, x in enumerate(languages)}
    weight = np.zeros((len(words), len(languages)))
    for name, word, n in counts:
        weight[row[word], lang[name]] += n
    grouped = list(by_length(words))
    chance = np.full((lattice.size, len(languages)), 1.0 / lattice.size)
    for _ in range(rounds + 1):
        found = np.zeros_like(chance)
        for at, points in grouped:
            found += expected(lattice, chance, points, weight[at])
        found += SMOOTHING
        chance = found / found.sum(0)
    return Model(pieces, languages, chance)


def identify(docs: DataFrame, model: Model, more: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, fit and the columns of `more`, for each row of docs.

    score: the posterior of lang_pred under equal priors. fit: nats a byte by which its model explains the letters
    better than bytes drawn evenly; below 0 the text looks like none of the languages, 0 for `und`.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = list(dict.fromkeys(["doc_id", *(more or [])]))
    picked = docs.select(*names, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        answers = np.array([*own.languages, UNDETERMINED], object)
        for batch in slices(batches, "_text"):
            if own.languages:
                total, words, size = own.texts(column(batch, "_text"))
                best = total.argmax(1)
                top = total[np.arange(len(best)), best]
                score = 1 / np.exp(total - top[:, None]).sum(1)
                close = (top + size * np.log(256)) / np.maximum(size, 1)
            else:
                words = np.zeros(batch.num_rows, np.int64)
                best, score, close = words, words.astype(float), words.astype(float)
            none = words == 0
            out = {n: column(batch, n) for n in names}
            out |= {"lang_pred": pa.array(answers[np.where(none, len(own.languages), best)], pa.string()), "score": pa.array(np.where(none, 0.0, score)), "fit": pa.array(np.where(none, 0.0, close))}
            yield pa.RecordBatch.from_pydict(out)

    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double, fit double")
