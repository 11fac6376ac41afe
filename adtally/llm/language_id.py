"""Language of each word of a text, and of the text, by a linear-chain conditional random field.

The states of the chain are the languages. A word's features are its byte n-grams, prefixes and suffixes, and the word
itself (the lexicon), hashed into one table of weights; transitions between languages are learned too. Training chains
are stretches of words from documents of different languages in turn, so that switches are seen. Texts are
labelled by forward-backward over their whole length: the probability of a language is the mean of its words'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.shared import mapped
from adtally.llm.words import Words, chunks, mixed, words

#: Bound of the training sample: documents of each language, and words of each document.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 300, 200
BITS = 18
ORDERS = (1, 2, 3, 4)
AFFIXES = (1, 2, 3)
STRETCH, CHAIN = 20, 100
ROUNDS, RATE, DECAY = 40, 0.5, 1e-4
#: Words of a text that are worked on one after the other; stretches of this length go side by side.
SEGMENT = 64
UNKNOWN = "und"
SEPARATORS = r"[\x20\x09-\x0D]+"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # a row for each feature and one of zeros for none
    moves: np.ndarray


def _features(found: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of chosen words: of each byte by order, of each word, and the first byte of each word."""
    none = 1 << BITS
    lengths = found.ends[chosen] - found.starts[chosen]
    starts = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(chosen)), lengths)
    data = found.data[np.arange(total) - starts[word] + found.starts[chosen][word]]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    after = np.repeat(starts + lengths, lengths) - np.arange(total)  # bytes from here to the end of the word

    def slot(values: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(values * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64)

    grams, per_byte, per_word = np.zeros(total, dtype=np.uint64), [], []
    for order in range(1, max(*ORDERS, *AFFIXES) + 1):
        grams = grams * np.uint64(257)
        grams[: total - order + 1] += data[order - 1 :] + np.uint64(1)
        whole = after >= order
        if order in ORDERS:
            per_byte.append(np.where(whole, slot(grams, order), none))
        if order in AFFIXES:
            long_enough = lengths >= order
            head = np.minimum(starts, max(total - 1, 0))
            tail = np.maximum(starts + lengths - order, 0)
            per_word.append(np.where(long_enough, slot(grams[head], 16 + order), none))
            per_word.append(np.where(long_enough, slot(grams[tail], 32 + order), none))
    per_word.append(slot(_whole(data, starts, lengths), 48))
    return np.array(per_byte), np.array(per_word), starts


def _whole(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each whole word."""
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    return np.add.reduceat(mixed(data * np.uint64(1 << 32) + place.astype(np.uint64)), starts) if len(starts) else starts.astype(np.uint64)


def _emissions(model: Model, found: Words) -> np.ndarray:
    """Scores of the languages for each word. Words are scored once for each distinct one."""
    _, chosen, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
    per_byte, per_word, starts = _features(found, chosen)
    scores = np.add.reduceat(sum(model.weights[x] for x in per_byte), starts, axis=0)
    scores += sum(model.weights[x] for x in per_word)
    return scores[inverse]


def _scaled(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=-1, keepdims=True))


def messages(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at each word, scaled; row i has the words ``first[i]`` to ``first[i + 1]``.

    A row is cut into segments. The product of the steps of a segment carries the forward and backward messages over
    it, so that segments of all rows are worked through side by side, with the result of one long chain.
    """
    n, states = scores.shape
    counts = np.diff(first)
    segments = -(-counts // SEGMENT)
    row = np.repeat(np.arange(len(counts)), segments)
    number = np.arange(len(row)) - np.repeat(np.cumsum(segments) - segments, segments)
    at = first[row] + number * SEGMENT
    size = np.minimum(first[row + 1] - at, SEGMENT) if len(row) else at
    step = np.exp(moves - moves.max())
    likely = _scaled(scores)
    m = len(row)

    def emitted(t: int) -> tuple[np.ndarray, np.ndarray]:
        there = t < size
        return there, likely[np.minimum(at + t, n - 1)]

    product = np.tile(np.eye(states), (m, 1, 1))
    for t in range(int(size.max(initial=0))):
        there, e = emitted(t)
        moved = (product.reshape(-1, states) @ step).reshape(m, states, states) * e[:, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        product = np.where(there[:, None, None], moved, product)

    into = np.full((m, states), 1.0 / states)  # forward message before a segment
    back = np.ones((m, states))  # backward message behind a segment
    most = int(segments.max(initial=0))
    start = np.cumsum(segments) - segments
    for k in range(1, most):
        here = (start + k)[segments > k]
        value = np.einsum("ij,ijk->ik", into[here - 1], product[here - 1])
        into[here] = value / value.sum(axis=1, keepdims=True)
    for k in range(most - 1, 0, -1):
        here = (start + k)[segments > k]
        value = np.einsum("ijk,ik->ij", product[here], back[here])
        back[here - 1] = value / value.sum(axis=1, keepdims=True)

    forward, backward = np.empty((n, states)), np.empty((n, states))
    for t in range(int(size.max(initial=0))):
        there, e = emitted(t)
        value = (into @ step) * e
        value /= value.sum(axis=1, keepdims=True)
        into = np.where(there[:, None], value, into)
        forward[(at + t)[there]] = value[there]
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        there, e = emitted(t)
        backward[(at + t)[there]] = back[there]
        value = (e * back) @ step.T
        back = np.where(there[:, None], value / value.sum(axis=1, keepdims=True), back)
    return forward, backward


def posteriors(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Probability of each state of each word."""
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True)


def _chains(samples: list[tuple[str, list[str]]], languages: list[str]) -> tuple[list[str], np.ndarray]:
    """Words and labels of training chains of ``CHAIN`` words: stretches of all documents in a fixed random order."""
    stretches = [(languages.index(lang), part[i : i + STRETCH]) for lang, part in samples for i in range(0, len(part), STRETCH)]
    order = np.random.default_rng(1).permutation(len(stretches))
    text, labels = [], []
    for k in order.tolist():
        text += stretches[k][1]
        labels += [stretches[k][0]] * len(stretches[k][1])
    return text, np.array(labels, dtype=np.int64)


def fit(samples: list[tuple[str, list[str]]]) -> Model | None:
    """Fit the model to (language, words) samples by gradient ascent on the likelihood of the labels; None without any."""
    languages = sorted({lang for lang, part in samples if part})
    if not languages:
        return None
    text, labels = _chains(samples, languages)
    states, size = len(languages), (1 << BITS) + 1
    found = words(pa.array([" ".join(text)]))
    _, chosen, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
    per_byte, per_word, starts = _features(found, chosen)
    owner = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, per_byte.shape[1])))
    slots = np.concatenate([*per_byte, *per_word])
    owners = np.concatenate([owner] * len(per_byte) + [np.arange(len(chosen))] * len(per_word))
    used, slots = np.unique(slots, return_inverse=True)
    weights, moves = np.zeros((len(used), states)), np.zeros((states, states))
    first = np.append(np.arange(0, len(labels), CHAIN), len(labels))
    inner = np.ones(len(labels) - 1, dtype=bool)
    inner[first[1:-1] - 1] = False
    seen = np.zeros((states, states))
    np.add.at(seen, (labels[:-1][inner], labels[1:][inner]), 1.0)
    speed, move_speed = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    sums = lambda place, values, n: np.stack([np.bincount(place, values[:, s], n) for s in range(states)], axis=1)
    for _ in range(ROUNDS):
        word_scores = sums(owners, weights[slots], len(chosen))
        scores = word_scores[inverse]
        forward, backward = messages(scores, moves, first)
        error = -posteriors(forward, backward)
        error[np.arange(len(labels)), labels] += 1
        gradient = sums(slots, sums(inverse, error, len(chosen))[owners], len(used)) / len(labels) - DECAY * weights
        gradient[used == size - 1] = 0
        move_gradient = (seen - _expected(scores, moves, forward, backward, inner)) / len(labels)
        speed += gradient**2
        move_speed += move_gradient**2
        weights += RATE * gradient / np.sqrt(speed)
        moves += RATE * move_gradient / np.sqrt(move_speed)
    table = np.zeros((size, states), dtype=np.float32)
    table[used] = weights
    table[-1] = 0
    return Model(languages, table, moves)


def _expected(scores: np.ndarray, moves: np.ndarray, forward: np.ndarray, backward: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected number of moves between states."""
    step, behind = np.exp(moves - moves.max()), (_scaled(scores) * backward)[1:][inner]
    pairs = forward[:-1][inner][:, :, None] * step[None] * behind[:, None, :]
    return (pairs / pairs.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def sample(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS, size: int = SAMPLE_WORDS) -> list[tuple[str, list[str]]]:
    """A bounded training sample of ``labelled`` (doc_id, text, lang): a stretch of words of some documents per language.

    Documents and the places of their stretches are chosen by hash, so reruns agree. A share of each language is drawn
    first that leaves a few times as many as are wanted, so no language gathers in one task.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) < (4.0 * documents / F.col("n")) * (1 << 30)
    # a row for each language, of which a model has a few hundred at most
    rows = rows.join(F.broadcast(sizes), "lang").where(drawn).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    picked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= documents).select("doc_id").distinct()
    # a bounded number of rows for each language
    parts = labelled.join(F.broadcast(picked), "doc_id").where("lang IS NOT NULL AND text IS NOT NULL")
    parts = parts.withColumn("words", F.filter(F.split("text", SEPARATORS), lambda w: w != ""))
    start = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.greatest(F.size("words") - size, F.lit(0)) + 1).cast("int") + 1
    parts = parts.select("lang", "doc_id", F.slice("words", start, size).alias("words"))
    return [(r.lang, r.words) for r in parts.orderBy("lang", "doc_id", "words").limit(documents * 1000).collect()]


def _has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _predicted(model: Model, part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    found = words(part.column("text"))
    counts = np.diff(found.first)
    shares = np.zeros((len(part), len(model.languages)))
    some = np.flatnonzero(counts)
    if len(some):
        likely = posteriors(*messages(_emissions(model, found), model.moves, found.first))
        shares[some] = np.add.reduceat(likely, found.first[:-1][some], axis=0) / counts[some, None]
    known = _has_letter(part.column("text")) & (counts > 0)
    best = shares.argmax(axis=1)
    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
    return names, np.where(known, np.clip(shares[np.arange(len(part)), best], 0.0, 1.0), 0.0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs`` (doc_id, text; no other column is read).

    A null text, or one without a letter, is ``und`` with score 0, as is every text if there is no model. ``score`` is
    the mean probability of the language over all words; of equal ones the first language by name is given. Rows with
    a null doc_id and repeated rows have results like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times 2 ** BITS weights

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                if shared.value is None:
                    names, scores = [UNKNOWN] * len(part), np.zeros(len(part))
                else:
                    names, scores = _predicted(shared.value, part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, "doc_id long, lang_pred string, score double")


def switches(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, first, last, lang``: stretches of words that most probably are of one language, ``last`` included."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in chunks(batch):
                found = words(part.column("text"))
                if not len(found):
                    continue
                best = posteriors(*messages(_emissions(shared.value, found), shared.value.moves, found.first)).argmax(axis=1)
                new = np.append(True, (best[1:] != best[:-1]) | (found.row[1:] != found.row[:-1]))
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(best)) - 1
                row = found.row[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(at - found.first[row]),
                        pa.array(last - found.first[row]),
                        pa.array([shared.value.languages[b] for b in best[at].tolist()]),
                    ],
                    names=["doc_id", "first", "last", "lang"],
                )

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), batches, "doc_id long, first long, last long, lang string")
