"""Language of words and texts by a linear-chain conditional random field.

A word's features are hashed affixes and byte trigrams and its place in a lexicon of frequent training words; the
transitions between the languages of neighbouring words are learned with the feature weights, by gradient ascent on the
likelihood, from stretches of labelled texts put together to code-switched sequences. Texts are labelled by
forward-backward: a word's language is that of its largest marginal, a text's that of the largest mean marginal.

Forward-backward runs on all texts of a piece at once: chains are cut into blocks of words, each block is reduced to one
small transfer matrix, these are chained over a text's blocks, and every block is then swept with its exact borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.buffers import byte_buffer, byte_words, mixed, pieces, small_batches

UNKNOWN = "und"
#: Bounds of the training sample: texts of each language, code points of each text, languages.
TEXTS_PER_LANGUAGE = 150
SAMPLE_CODE_POINTS = 2_000
MAX_LANGUAGES = 64
#: Words that the lexicon holds at most, and how often each must stand in the sample.
LEXICON_WORDS = 20_000
LEXICON_COUNT = 3
HASHED = 1 << 15
STRETCH, STRETCHES = 40, 8
ROUNDS, RATE, DECAY = 25, 0.15, 1e-4
BLOCK = 256
#: Bytes of text labelled at once; their arrays hold some 60 times as many.
PIECE = 500_000

_member = np.zeros(256, bool)
_member[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray    # sorted word hashes
    weights: np.ndarray    # HASHED + lexicon + 1 rows, one column a language; the last row is for words outside the lexicon
    moves: np.ndarray      # log weight of each language after each


def _features(data: np.ndarray, first: np.ndarray, after: np.ndarray, lexicon: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Feature rows: one array of rows per kind, with the word of each row (None: one row for each word, in order)."""
    lens = after - first
    total = int(lens.sum())
    at = np.repeat(first - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(total)
    b = np.concatenate((_lower[data[at]], np.zeros(3, np.uint8))).astype(np.uint32)
    word = np.repeat(np.arange(len(first)), lens)
    head = np.cumsum(lens) - lens
    tail = head + lens
    size = np.uint32(HASHED - 1)

    def row(kind: int, value: np.ndarray) -> np.ndarray:
        h = (value + np.uint32(kind << 24)) * np.uint32(0x9E3779B1)
        return ((h ^ (h >> np.uint32(15))) & size).astype(np.int64)

    two = b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16))
    left = np.repeat(tail, lens) - np.arange(total)
    inside = left >= 3
    yield row(1, three[:total][inside]), word[inside]
    yield row(4, np.where(lens >= 2, two[head], b[head])), None
    yield row(5, np.where(lens >= 3, three[head], two[head] * (lens >= 2))), None
    yield row(6, np.where(lens >= 2, two[np.maximum(tail - 2, 0)], b[head])), None
    yield row(7, np.where(lens >= 3, three[np.maximum(tail - 3, 0)], 0).astype(np.uint32)), None
    hashes = _word_hashes(b, head, lens, total)
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        yield np.where(lexicon[place] == hashes, HASHED + place, HASHED + len(lexicon)), None
    else:
        yield np.full(len(first), HASHED), None


def _word_hashes(b: np.ndarray, head: np.ndarray, lens: np.ndarray, total: int) -> np.ndarray:
    if not total:
        return np.zeros(0, np.uint64)
    inner = (np.arange(total) - np.repeat(head, lens)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(b[:total].astype(np.uint64) + inner * np.uint64(257) + np.uint64(1)), head))


def _emissions(weights: np.ndarray, features, words: int) -> np.ndarray:
    out = np.zeros((words, weights.shape[1]), np.float32)
    for rows, word in features:
        if word is None:
            out += weights[rows]
        elif len(rows):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[begins]] += np.add.reduceat(weights[rows], begins, axis=0)
    return out


def _marginals(emissions: np.ndarray, chains: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of every word. `chains` holds the first word of each chain and the number of words."""
    return _sweeps(emissions, chains, moves)[1]


def _sweeps(emissions: np.ndarray, chains: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward state of every word, and its marginals."""
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    a = np.exp(moves - moves.max())
    sizes = np.diff(chains)
    counts = -(-sizes // BLOCK)
    n_blocks = int(counts.sum())
    chain = np.repeat(np.arange(len(sizes)), counts)
    index = np.arange(n_blocks) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = chains[:-1][chain] + index * BLOCK
    length = np.minimum(BLOCK, chains[1:][chain] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(BLOCK)]  # blocks longer than t
    # One transfer matrix for each block of a chain that has more than one. A common factor cancels in the marginals.
    transfer = np.zeros((n_blocks, k, k))
    long = np.flatnonzero(counts[chain[order]] > 1)
    matrix = np.broadcast_to(np.eye(k), (len(long), k, k)).copy()
    for t in range(BLOCK):
        m = int(np.searchsorted(-length[long], -t, "left"))
        if not m:
            break
        step = (matrix[:m] @ a) * e[begin[long[:m]] + t][:, None, :]
        matrix[:m] = step / step.sum(axis=(1, 2), keepdims=True)
    transfer[long] = matrix
    # Chain them: all texts move one block on at a time.
    place = np.empty(n_blocks, np.int64)
    place[order] = np.arange(n_blocks)
    start_of = np.cumsum(counts) - counts
    enter, leave = np.full((n_blocks, k), 1.0 / k), np.ones((n_blocks, k))
    by_size = np.argsort(-counts, kind="stable")
    falling = -counts[by_size]
    for i in range(1, int(counts.max(initial=0))):
        own = by_size[:int(np.searchsorted(falling, -i, "left"))]
        before, now = place[start_of[own] + i - 1], place[start_of[own] + i]
        v = np.einsum("bi,bij->bj", enter[before], transfer[before])
        enter[now] = v / v.sum(axis=1, keepdims=True)
    for i in range(int(counts.max(initial=0)) - 1, 0, -1):
        own = by_size[:int(np.searchsorted(falling, -i, "left"))]
        before, now = place[start_of[own] + i - 1], place[start_of[own] + i]
        v = np.einsum("bij,bj->bi", transfer[now], leave[now])
        leave[before] = v / v.sum(axis=1, keepdims=True)
    forward = np.empty((n, k))
    state = enter.copy()
    for t in range(BLOCK):
        m = active[t]
        if not m:
            break
        v = (state[:m] @ a) * e[begin[:m] + t]
        state[:m] = v / v.sum(axis=1, keepdims=True)
        forward[begin[:m] + t] = state[:m]
    state = leave
    out = np.empty((n, k))
    for t in range(BLOCK - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        at = begin[:m] + t
        both = forward[at] * state[:m]
        out[at] = both / both.sum(axis=1, keepdims=True)
        v = (state[:m] * e[at]) @ a.T
        state[:m] = v / v.sum(axis=1, keepdims=True)
    return forward, out


def train(texts: list[str], languages: list[str]) -> Model:
    """Fit the field on labelled texts. The same input gives the same model."""
    names = sorted(set(languages))
    k = len(names)
    number = {name: i for i, name in enumerate(names)}
    data, starts = byte_buffer(pa.array(texts, pa.large_string()))
    first, after, text = byte_words(data, starts, _member)
    label = np.array([number[x] for x in languages], np.int64)[text] if len(text) else np.zeros(0, np.int64)
    # Stretches of one text's words, shuffled and joined to sequences in which languages change.
    inside = np.arange(len(text)) - np.searchsorted(text, text)
    stretch = np.unique(text * (1 << 32) + inside // STRETCH, return_inverse=True)[1]
    draw = np.random.default_rng(7).permutation(int(stretch.max(initial=-1)) + 1)
    order = np.argsort(draw[stretch] if len(stretch) else stretch, kind="stable")
    first, after, label = first[order], after[order], label[order]
    sequence = draw[stretch][order] // STRETCHES if len(stretch) else stretch
    chains = np.concatenate((np.flatnonzero(np.concatenate(([True], sequence[1:] != sequence[:-1]))), [len(first)])) if len(first) else np.array([0])
    lens = after - first
    total = int(lens.sum())
    at = np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(total)
    hashes = _word_hashes(np.concatenate((_lower[data[at]], np.zeros(3, np.uint8))).astype(np.uint32), np.cumsum(lens) - lens, lens, total)
    words, counts = np.unique(hashes, return_counts=True)
    common = np.lexsort((words, -counts))[:LEXICON_WORDS]
    lexicon = np.sort(words[common][counts[common] >= LEXICON_COUNT])
    rows = HASHED + len(lexicon) + 1
    weights, moves = np.zeros((rows, k), np.float32), np.zeros((k, k))
    if k < 2:
        return Model(names, lexicon, weights, moves)
    features = [(r, w if w is not None else np.arange(len(first))) for r, w in _features(data, first, after, lexicon)]
    found = np.zeros((len(first), k), np.float32)
    found[np.arange(len(first)), label] = 1
    inner = np.ones(len(first), bool)
    inner[chains[:-1]] = False
    second = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[second - 1], label[second]), 1)
    adam = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, ROUNDS + 1):
        emissions = _emissions(weights, features, len(first))
        forward, marginal = _sweeps(emissions, chains, moves)
        error = found - marginal
        gradient = np.zeros_like(weights)
        for r, w in features:
            for language in range(k):
                gradient[:, language] += np.bincount(r, weights=error[w, language], minlength=rows)
        # The marginal of neighbours (i, j): forward state of i, the move, and what the later texts say about j.
        a = np.exp(moves - moves.max())
        later = marginal[second] / (forward[second - 1] @ a)
        pair_gradient = seen - a * (forward[second - 1].T @ later)
        for value, g, m, v in ((weights, gradient, adam[0], adam[1]), (moves, pair_gradient, adam[2], adam[3])):
            g = g / len(first) - DECAY * value
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(names, lexicon, weights, moves)


def training_sample(docs: DataFrame, text: str, language: str, key: str) -> tuple[list[str], list[str]]:
    """At most TEXTS_PER_LANGUAGE texts of each language, those with the smallest hashes of the key, and of each one a
    stretch of SAMPLE_CODE_POINTS code points whose place depends on the hash."""
    labelled = docs.filter(F.col(language).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(language).agg(F.count(F.lit(1)).alias("n")).orderBy(language).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    h = F.xxhash64(F.col(key), F.lit(11))
    u = F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)
    share = F.lit(0.0)
    for c in counts:
        share = F.when(F.col(language) == c[0], F.lit(min(1.0, TEXTS_PER_LANGUAGE / c.n))).otherwise(share)
    room = F.greatest(F.length(text) - SAMPLE_CODE_POINTS, F.lit(0)) + 1
    # Half as much again in all, so that chance does not cut a language short; the order makes the cut repeatable.
    rows = labelled.filter(u < share).select(
        F.col(language).cast("string").alias("language"), h.alias("h"), F.xxhash64(text).alias("t"),
        F.substring(F.col(text), (F.pmod(h, room) + 1).cast("int"), F.lit(SAMPLE_CODE_POINTS)).alias("text"),
    ).orderBy("h", "t").limit(3 * TEXTS_PER_LANGUAGE * max(1, len(counts)) // 2).collect()
    return [r.text for r in rows], [r.language for r in rows]


def fit_languages(docs: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id") -> Model:
    """The model of the labelled rows; a table without labels gives a model without languages."""
    return train(*training_sample(docs, text, language, key))


def label_languages(docs: DataFrame, model: Model, text: str = "text", segments: bool = False,
                    keep_text: bool = False) -> DataFrame:
    """Replace the text column (with `keep_text`, keep it and add) by `lang_pred` and `score`, the mean marginal of that language over the words; with
    `segments` also by `segments`, the runs of words of one language as (first byte, byte after, language).

    Words are runs of ASCII letters and non-ASCII characters. Null texts and texts without a letter get `und`, score 0
    and no segments; ties go to the first language by name. Other columns and repeated rows stay; new names must be free."""
    new = {"lang_pred", "score", *(["segments"] if segments else [])}
    if new & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(new & set(docs.columns))}")
    others = [f for f in docs.schema if keep_text or f.name != text]
    run_type = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("language", T.StringType())]))
    schema = T.StructType([*others, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           *([T.StructField("segments", run_type)] if segments else [])])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_runs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("language", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in pieces(batches, text, PIECE):
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            names, scores, runs = _label(model, texts, segments)
            extra = [pa.array(runs, arrow_runs)] if segments else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), *extra], schema.names)

    return docs.mapInArrow(run, schema)


def _label(model: Model, texts: pa.Array, segments: bool) -> tuple[list[str], np.ndarray, list]:
    data, starts = byte_buffer(texts)
    n, k = len(texts), len(model.languages)
    names, scores, runs = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    if not k or not len(data):
        return names, scores, runs
    first, after, text = byte_words(data, starts, _member)
    chains = np.searchsorted(text, np.arange(n + 1))
    marginal = _marginals(_emissions(model.weights, _features(data, first, after, model.lexicon), len(first)), chains, model.moves)
    summed = np.vstack((np.zeros((1, k)), np.cumsum(marginal, axis=0, dtype=np.float64)))
    count = np.diff(chains)
    mean = (summed[chains[1:]] - summed[chains[:-1]]) / np.maximum(count, 1)[:, None]
    best = mean.argmax(axis=1)
    ascii_letters = np.concatenate(([0], np.cumsum(_member[data] & (data < 128))))
    plain = ascii_letters[starts[1:]] > ascii_letters[starts[:-1]]
    for i in np.flatnonzero(count):
        if plain[i] or any(c.isalpha() for c in texts[int(i)].as_py()):
            names[i] = model.languages[best[i]]
            scores[i] = min(1.0, max(0.0, mean[i, best[i]]))
            if segments:
                own = marginal[chains[i]:chains[i + 1]].argmax(axis=1)
                heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                tails = np.concatenate((heads[1:], [len(own)])) - 1
                at = chains[i]
                runs[i] = [{"begin": int(first[at + h] - starts[i]), "end": int(after[at + t] - starts[i]),
                            "language": model.languages[own[h]]} for h, t in zip(heads, tails)]
    return names, scores, runs
