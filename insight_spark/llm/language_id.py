"""Language identification by unigram piece models, summed over all segmentations.

The pieces are a fixed public vocabulary. For each language their probabilities
are learned by expectation maximisation on counts of words (runs of letters in
lower case); a word's probability is the sum over all ways to cut it into
pieces, found by a forward pass. A text's
likelihood is the product over its words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import id_type, kept_table, map_chunks, segment_sums, text_column

# A word begins with this sign, as in the vocabulary.
START = "▁"
# Words of up to so many characters share one array; longer ones are summed in a moving window.
# Training counts a longer word in runs of so many.
RUN = 32
# Characters of long words worked on at a time.
LONG_CHARS = 1 << 20
# Characters between two rescalings of a long word's sums.
RESCALED = 8
ROUNDS = 2
# Added to every expected count, so that no piece has probability zero.
SMOOTHING = 0.01
# No piece is less probable than that, however large the corpus.
FLOOR = 1e-10
# Sums are kept times this to the number of characters, a power of two and so exact: a run of RUN
# pieces at the floor stays above 1e-80 and no run gets above 1e241.
SCALE = 2.0**25
# Probability of a character that the vocabulary does not have, the same in all languages.
UNKNOWN = 1e-7
# Words worked on at a time, at four languages.
SLICE = 40_000
# A model is sent to every executor; pieces times languages times eight bytes may not be more.
MODEL_BYTES = 512 << 20
NONE = "und"


class Pieces(NamedTuple):
    """The vocabulary as a trie in an open hash table.

    ``keys`` holds (node, character) or -1 for a free slot, ``child`` the node
    that it leads to, ``piece_at`` the piece that ends at a node or -1, ``sizes``
    the characters of each piece.
    """

    keys: np.ndarray
    child: np.ndarray
    piece_at: np.ndarray
    sizes: np.ndarray
    longest: int


class Model(NamedTuple):
    languages: list[str]  # sorted
    probability: np.ndarray  # pieces x languages


def load_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model, in its order."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    size = processor.get_piece_size()
    special = (processor.is_control, processor.is_unknown, processor.is_byte, processor.is_unused)
    return [processor.id_to_piece(i) for i in range(size) if not any(test(i) for test in special)]


def build_trie(pieces: list[str]) -> Pieces:
    nodes: list[dict[str, int]] = [{}]
    piece_at = [-1]
    for number, piece in enumerate(pieces):
        node = 0
        for char in piece:
            if char not in nodes[node]:
                nodes[node][char] = len(nodes)
                nodes.append({})
                piece_at.append(-1)
            node = nodes[node][char]
        piece_at[node] = number
    size = 1 << max(4, (4 * len(nodes)).bit_length())
    keys, children = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for node, row in enumerate(nodes):
        for char, child in row.items():
            key = node << 21 | ord(char)
            slot = int(_slot(np.array([key]), size)[0])
            while keys[slot] >= 0:
                slot = (slot + 1) % size
            keys[slot], children[slot] = key, child
    sizes = np.array([len(piece) for piece in pieces])
    return Pieces(keys, children, np.array(piece_at, np.int32), sizes, int(sizes.max()))


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _children(trie: Pieces, keys: np.ndarray) -> np.ndarray:
    """The node behind each key, or -1."""
    out = np.full(len(keys), -1, np.int32)
    slot, todo = _slot(keys, len(trie.keys)), None
    while True:
        held = trie.keys[slot]
        wanted = keys if todo is None else keys[todo]
        hit = held == wanted
        if todo is None:
            out[hit] = trie.child[slot[hit]]
        else:
            out[todo[hit]] = trie.child[slot[hit]]
        more = np.flatnonzero((held >= 0) & ~hit)
        if not len(more):
            return out
        todo = more if todo is None else todo[more]
        slot = (slot[more] + 1) % len(trie.keys)


def word_runs(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every word with the start sign, cut into runs of at most RUN characters, and the runs per word."""
    marked = pc.binary_join_element_wise(START, words, "")
    lengths = pc.utf8_length(marked).to_numpy(zero_copy_only=False)
    if not len(lengths) or lengths.max() <= RUN:
        return marked, np.ones(len(lengths), np.int64)
    runs = [[w[i : i + RUN] for i in range(0, len(w), RUN)] if len(w) > RUN else [w] for w in marked.to_pylist()]
    return pa.array([r for word in runs for r in word], pa.string()), np.array([len(r) for r in runs])


class _Lattice:
    """All pieces that fit anywhere into a list of runs."""

    def __init__(self, runs: pa.Array, trie: Pieces):
        lengths = pc.utf8_length(runs).to_numpy(zero_copy_only=False).astype(np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        text = "".join(runs.take(pa.array(self.order)).to_pylist())
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        left = np.repeat(self.offsets + self.lengths, self.lengths) - np.arange(len(chars))
        self.longest = min(trie.longest, int(self.lengths.max(initial=0)))
        # fits[l - 1][p]: the piece of length l at character p, or -1.
        self.fits = np.full((self.longest, len(chars)), -1, np.int32)
        place, node = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for step in range(self.longest):
            inside = left[place] > step
            place, node = place[inside], node[inside]
            found = _children(trie, node << 21 | chars[place + step])
            hit = found >= 0
            place, node = place[hit], found[hit].astype(np.int64)
            self.fits[step, place] = trie.piece_at[node]
        self.unknown = self.fits[0] < 0
        # By piece, and one character for unknown.
        self.scale = SCALE ** np.append(trie.sizes, 1)[:, None]

    def _edges(self, end: int):
        """(length, runs, their pieces) for pieces that end after ``end`` characters; piece -1 is unknown."""
        active = int(np.searchsorted(-self.lengths, -end, side="right"))
        for length in range(1, min(end, self.longest) + 1):
            at = self.offsets[:active] + end - length
            pieces = self.fits[length - 1, at]
            rows = np.arange(active) if length == 1 else np.flatnonzero(pieces >= 0)
            if len(rows):
                yield length, rows, pieces[rows]

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """alpha[t, run, language]: the sum over all segmentations of the first t characters, times SCALE ** t.

        ``probability`` has a last row for unknown characters.
        """
        probability = probability * self.scale
        steps = int(self.lengths.max(initial=0))
        alpha = np.zeros((steps + 1, len(self.lengths), probability.shape[1]))
        alpha[0] = 1
        for end in range(1, steps + 1):
            for length, rows, pieces in self._edges(end):
                alpha[end, rows] += alpha[end - length, rows] * probability[pieces]
        return alpha

    def rolling(self, probability: np.ndarray, before: "_Rolled | None" = None, skip: int = 0) -> "_Rolled":
        """Sums over all segmentations of runs of any length, kept only as far back as a piece reaches.

        ``before`` goes on where an earlier window of the same run ended; the first ``skip``
        characters of this one are that window's last.
        """
        shape = (len(self.lengths), probability.shape[1])
        recent = before.recent if before else [np.zeros(shape)] * (self.longest - 1) + [np.ones(shape)]
        logs = before.logs.copy() if before else np.zeros(shape)
        done = np.zeros(shape)
        for end in range(skip + 1, int(self.lengths.max(initial=0)) + 1):
            alpha = np.zeros(shape)
            for length, rows, pieces in self._edges(end):
                if length <= len(recent):
                    alpha[rows] += recent[-length][rows] * probability[pieces]
            recent = [*recent[-self.longest + 1 :], alpha] if self.longest > 1 else [alpha]
            if end % RESCALED == 0:
                top = np.where(alpha > 0, alpha, 1.0)
                recent = [a / top for a in recent]
                logs += np.log(top)
            ended = self.lengths == end
            if ended.any():
                done[ended] = np.log(recent[-1][ended]) + logs[ended]
        return _Rolled(recent, logs, done)

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        """Probability of each run, in the order the runs were given."""
        out = np.empty(alpha.shape[1:])
        out[self.order] = alpha[self.lengths, np.arange(len(self.lengths))] / SCALE ** self.lengths[:, None]
        return out

    def log_totals(self, alpha: np.ndarray) -> np.ndarray:
        """Logarithms of ``totals``, also of those that are too small for a double."""
        out = np.empty(alpha.shape[1:])
        logs = np.log(alpha[self.lengths, np.arange(len(self.lengths))])
        out[self.order] = logs - self.lengths[:, None] * np.log(SCALE)
        return out

    def expected(self, probability: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts per language for runs seen ``counts`` (run x language) times."""
        alpha = self.forward(probability)
        probability = probability * self.scale
        steps = len(alpha) - 1
        rows_all = np.arange(len(self.lengths))
        weight = counts[self.order] / alpha[self.lengths, rows_all]
        beta = np.zeros_like(alpha)
        beta[self.lengths, rows_all] = weight
        out = np.zeros_like(probability)
        for end in range(steps, 0, -1):
            for length, rows, pieces in self._edges(end):
                flow = beta[end, rows] * probability[pieces]
                beta[end - length, rows] += flow
                flow *= alpha[end - length, rows]
                for language in range(flow.shape[1]):
                    out[:, language] += np.bincount(pieces % len(out), flow[:, language], len(out))
        return out


class _Rolled(NamedTuple):
    recent: list[np.ndarray]  # the last sums, rescaled
    logs: np.ndarray  # what they were divided by
    done: np.ndarray  # logarithm of the whole sum of each run that has ended


def _long_logs(words: list[str], trie: Pieces, table: np.ndarray) -> np.ndarray:
    """log P of words of any length, per language, no segmentation left out."""
    out = np.empty((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    while order:
        taken, size = [], 0
        while order and (not taken or size + len(words[order[0]]) <= LONG_CHARS):
            taken.append(order.pop(0))
            size += len(words[taken[-1]])
        if size <= LONG_CHARS:
            lattice = _Lattice(pa.array([words[i] for i in taken], pa.string()), trie)
            out[np.array(taken)[lattice.order]] = lattice.rolling(table).done
            continue
        word, state = words[taken[0]], None
        for start in range(0, len(word), LONG_CHARS):
            low = max(0, start - trie.longest + 1) if state else 0
            lattice = _Lattice(pa.array([word[low : start + LONG_CHARS]], pa.string()), trie)
            state = lattice.rolling(table, state, start - low)
        out[taken[0]] = state.done[0]
    return out


def _with_unknown(probability: np.ndarray) -> np.ndarray:
    return np.vstack([probability, np.full((1, probability.shape[1]), UNKNOWN)])


def word_logs(words: pa.Array, trie: Pieces, model: Model) -> np.ndarray:
    """log P(word) per language, over all segmentations of the whole word."""
    out = np.empty((len(words), len(model.languages)))
    table = _with_unknown(model.probability)
    marked = pc.binary_join_element_wise(START, words, "")
    long = pc.greater(pc.utf8_length(marked), RUN).to_numpy(zero_copy_only=False)
    rows, short = np.flatnonzero(~long), marked.filter(pa.array(~long))
    step = max(1000, 4 * SLICE // max(1, len(model.languages)))
    for start in range(0, len(short), step):
        lattice = _Lattice(short.slice(start, step), trie)
        out[rows[start : start + step]] = lattice.log_totals(lattice.forward(table))
    if long.any():
        out[long] = _long_logs(marked.filter(pa.array(long)).to_pylist(), trie, table)
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each of the texts' words among them, and the words per text.

    Words are runs of letters, in lower case; a text without a letter has one empty word.
    """
    letters = pc.utf8_lower(pc.replace_substring_regex(texts, r"[^\pL\pM]+", " "))
    lists = pc.split_pattern(pc.utf8_trim(letters, " "), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def count_words(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) over all texts; each task adds up its own chunks before anything is shuffled."""

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        words, codes, counts = split_words(chunk.column(0))
        langs = chunk.column(1).dictionary_encode()
        pair = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts) * max(len(words), 1) + codes
        distinct, times = np.unique(pair, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(distinct // max(len(words), 1))),
                words.take(pa.array(distinct % max(len(words), 1))), pa.array(times, pa.int64()),
            ],
            names=["lang", "word", "n"],
        )

    texts = df.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    partial = map_chunks(texts.dropna(), work, "lang string, word string, n bigint")
    return partial.filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(
    df: DataFrame,
    pieces: list[str],
    keep: Column | None = None,
    text_col: str = "text",
    lang_col: str = "lang",
    rounds: int = ROUNDS,
) -> Model:
    """Piece probabilities per language from every text whose language is not null.

    ``keep`` restricts the rows. Words are counted once over the whole input;
    each round then reads the distinct words. What comes to the driver is one
    number per piece and language. Without a row the model has no language.
    """
    counts = kept_table(count_words(df if keep is None else df.filter(keep), text_col, lang_col), "words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    trie = build_trie(pieces)
    if 8 * len(pieces) * len(languages) > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages make a model of more than {MODEL_BYTES >> 20} MB")
    probability = np.full((len(pieces), len(languages)), 1 / len(pieces))
    spark = df.sparkSession
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((trie, languages, probability))
        expected = counts.mapInArrow(_expectation(shared), "lang int, piece int, n double")
        summed = expected.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.full(probability.shape, SMOOTHING)
        total[summed["piece"].to_numpy(), summed["lang"].to_numpy()] += summed["n"].to_numpy()
        probability = _shares(total)
    return Model(languages, probability)


def _shares(total: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts, none below the floor (but for the last rounding to a sum of one)."""
    share = np.maximum(total / total.sum(0), FLOOR)
    return share / share.sum(0)


def _expectation(shared):
    def run(batches):
        trie, languages, probability = shared.value
        table = _with_unknown(probability)
        total = np.zeros(table.shape)

        def add(batch):
            runs, per_word = word_runs(batch.column(1))
            lang = pc.index_in(batch.column(0), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            seen = np.zeros((batch.num_rows, len(languages)))
            seen[np.arange(batch.num_rows), lang] = batch.column(2).to_numpy(zero_copy_only=False)
            seen = np.repeat(seen, per_word, axis=0)
            for part in range(0, len(runs), SLICE):
                lattice = _Lattice(runs.slice(part, SLICE), trie)
                total[:] += lattice.expected(table, seen[part : part + SLICE])

        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SLICE:
                add(pa.concat_batches(held))
                held = []
        if held:
            add(pa.concat_batches(held))
        piece, lang = np.nonzero(total[:-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, lang], pa.float64())],
            names=["lang", "piece", "n"],
        )

    return run


def predict(
    df: DataFrame, model: Model, pieces: list[str], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(``id_col``, lang_pred, score) per row, whole texts.

    The language of the greatest likelihood, ties to the first by name; score is
    its share of the likelihoods, 0 to 1. A null text, one without a letter, and
    any text under a model without languages get ``und`` and 0. Rows are judged
    one by one: repeated rows and null ids stay, an empty table gives no rows,
    other columns are not read.
    """
    if model.probability.nbytes > MODEL_BYTES:
        raise ValueError(f"{len(model.languages)} languages make a model of more than {MODEL_BYTES >> 20} MB")
    shared = df.sparkSession.sparkContext.broadcast((build_trie(pieces), model))

    def work(chunk: pa.RecordBatch) -> pa.RecordBatch:
        trie, learned = shared.value
        texts = text_column(chunk, text_col)
        best, share = _judged(texts, trie, learned)
        letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        names = np.array([*learned.languages, NONE], object)
        best = np.where(letters, best, len(learned.languages))
        return pa.RecordBatch.from_arrays(
            [chunk.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters, share, 0.0))],
            names=[id_col, "lang_pred", "score"],
        )

    return map_chunks(
        df.select(id_col, text_col), work, f"`{id_col}` {id_type(df, id_col)}, lang_pred string, score double"
    )


def _judged(texts: pa.Array, trie: Pieces, model: Model) -> tuple[np.ndarray, np.ndarray]:
    if not model.languages:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts))
    words, codes, counts = split_words(texts)
    logs = word_logs(words, trie, model)
    sums = np.column_stack([segment_sums(logs[codes, k], counts) for k in range(len(model.languages))])
    best = sums.argmax(1)
    share = 1 / np.exp(np.minimum(sums - sums.max(1, keepdims=True), 0)).sum(1)
    return best, share
