"""Expansion terms for questions: words that stand near each other more often than chance, from the corpus itself.

Words are dealt into groups, and the pairs of two groups are a cell. A task packs the pairs that it counted by cell: the
words of the cell in order, and a few bytes a pair. Only packed cells are shuffled and written; one is put together at a
time, so what a task holds is bounded by its cell.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from insight_spark.functions.text import tokenize_words
from insight_spark.operators.scale import BATCH_ROWS, arrow_rows, kept, top_n_per_group

# Words to the right of a word that count as near, and how often a pair must be seen.
WINDOW, LEAST = 5, 3
# Tokens worked on at once in a task.
TOKENS = 2_000_000
# Pairs counted or put together at once in a task, and those handed on in one batch.
PAIRS, BATCH = 2_000_000, 1 << 16
# Input bytes, as Spark estimates them, to a cell; there are no more than so many cells.
CELL_BYTES, MOST_CELLS = 2 << 20, 1000
# From here on an estimate says that nothing is known; a row then counts as so many bytes.
UNKNOWN, ROW_BYTES = 1 << 50, 1000
CELL = "cell int, packed binary, n long"


def near_pairs(docs: DataFrame, text: str = "text", window: int = WINDOW, tokens: Callable = tokenize_words) -> DataFrame:
    """(a, b, n): how often two different words, a before b by letters, stand at most ``window`` words apart.

    Each task adds up its own documents before anything is shuffled, so a word that is
    everywhere is no more rows than any other. The cells are written once, the rows made where they are read;
    :func:`mutual_information` reads the cells.
    """
    groups = _groups(docs)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        cells = kept(_by_cell(_partial_cells(docs, groups, text, window, tokens), groups, _merged, CELL), "near-pairs")
    pairs = cells.mapInArrow(_rows, "a string, b string, n long")
    pairs._cells = cells, groups
    return pairs


def _partial_pairs(docs: DataFrame, text: str = "text", window: int = WINDOW, tokens: Callable = tokenize_words) -> DataFrame:
    """(a, b, n) as each task counts them, TOKENS words at a time."""
    return _partial_cells(docs, _groups(docs), text, window, tokens).mapInArrow(_rows, "a string, b string, n long")


def _partial_cells(docs: DataFrame, groups: int, text: str, window: int, tokens: Callable) -> DataFrame:
    def run(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(ends):
                # Batches are put together, or cut, to TOKENS: few partial counts of a pair leave the task.
                before = int(ends[start - 1]) if start else 0
                stop = max(start + (not size), int(np.searchsorted(ends, before + TOKENS - size, "right")))
                held.append(lists.slice(start, stop - start))
                size += int(ends[stop - 1] - before) if stop > start else 0
                start = stop
                if start < len(ends) or size >= TOKENS:
                    yield from _counted(held, window, groups)
                    size = 0
        yield from _counted(held, window, groups)

    listed = docs.select(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    return listed.mapInArrow(run, CELL)


def _groups(df: DataFrame) -> int:
    """How many groups words are dealt into, by the size of what is read and the cores there are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < UNKNOWN else df.count() * ROW_BYTES
    cells = min(max(size // CELL_BYTES, 2 * df.sparkSession.sparkContext.defaultParallelism), MOST_CELLS)
    return math.ceil(math.sqrt(2 * cells))


def _group_of(words: pa.Array, groups: int) -> np.ndarray:
    return np.array([zlib.crc32(w) % groups for w in words.cast(pa.binary()).to_pylist()], np.int32)


def _cell(x, y):
    """The number of the cell of two groups, whichever comes first."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    return high * (high + 1) // 2 + low


def _by_cell(cells: DataFrame, groups: int, run: Callable, kind: str) -> DataFrame:
    """``run`` on all rows of one cell at a time. There are twice as many tasks as cells, so that few have several."""
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups * groups)
    return cells.repartition(parts, "cell").groupBy("cell").applyInArrow(run, kind)


def _coded(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The different words in order, and the place of each given one among them."""
    coded = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def _counted(held: list[pa.Array], window: int, groups: int) -> Iterator[pa.RecordBatch]:
    """The packed cells of the lists of words in ``held``, which is emptied."""
    sizes = np.concatenate([np.empty(0, np.int64), *(pc.list_value_length(lists).to_numpy(zero_copy_only=False) for lists in held)]).astype(np.int64)
    flat = [lists.flatten().cast(pa.string()) for lists in held]
    held.clear()
    if not sizes.sum():
        return
    words, word = _coded(flat)
    flat.clear()
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    group = _group_of(words, groups)
    # As many passes over the words, each for some of the cells, as keep to PAIRS.
    passes = min(-(-len(word) * window // PAIRS), groups)
    for number in range(passes):
        keys = []
        for distance in range(1, window + 1):
            x, y = word[:-distance], word[distance:]
            near = (row[distance:] == row[:-distance]) & (x != y) & ((group[x] + group[y]) % passes == number)
            x, y = x[near], y[near]
            low = np.minimum(x, y).astype(np.int64)
            keys.append((_cell(group[x], group[y]) * len(words) + low) * len(words) + np.maximum(x, y))
        key = np.concatenate(keys)
        del keys, x, y, near, low
        key.sort()
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        yield from _cells(words, key[heads], np.diff(np.append(heads, len(key))))
        pa.default_memory_pool().release_unused()


def _cells(words: pa.Array, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per cell: of pairs in order, whose ``key`` has the cell and the places of both words."""
    if not len(key):
        return
    count = len(words)
    cell = key // (count * count)
    heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    packed, total = [], []
    for start, stop in zip(heads, [*heads[1:], len(key)]):
        own = key[start:stop] % (count * count)
        first, second = own // count, own % count
        used = np.zeros(count, bool)
        used[first] = used[second] = True
        place = np.cumsum(used) - 1
        codes = np.flatnonzero(used)
        packed.append(_pack(words.take(pa.array(codes)), place[first] * len(codes) + place[second], n[start:stop]))
        total.append(int(n[start:stop].sum()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(cell[heads].astype(np.int32)), pa.array(packed, pa.binary()), pa.array(total, pa.int64())], names=["cell", "packed", "n"]
    )


def _pack(words: pa.Array, key: np.ndarray, n: np.ndarray) -> bytes:
    """Words in order, the rising places ``first * len(words) + second`` of pairs, and their counts, compressed."""
    _, ends, letters = words.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(words) + 1]
    codec, out = pa.Codec("zstd"), []
    for values in (np.diff(ends), np.frombuffer(letters or b"", np.uint8)[: ends[-1]], np.diff(key, prepend=0), n):
        raw = values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))
        # All first bytes, then all second ones: they compress better.
        small = codec.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), asbytes=True)
        out += [struct.pack("<cqq", raw.dtype.char.encode(), raw.nbytes, len(small)), small]
    return b"".join(out)


def _parts(packed: bytes, start: int, stop: int) -> list[np.ndarray]:
    """Some of the four arrays of a packed cell."""
    codec, found, at = pa.Codec("zstd"), [], 0
    for number in range(stop):
        kind, size, small = struct.unpack_from("<cqq", packed, at)
        at += struct.calcsize("<cqq")
        if number >= start:
            kind, plain = np.dtype(kind.decode()), codec.decompress(packed[at : at + small], size, asbytes=True)
            found.append(np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel())
        at += small
    return found


def _words(packed: bytes) -> pa.Array:
    sizes, letters = _parts(packed, 0, 2)
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters))


def _pairs(packed: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and counts of a packed cell, some at a time."""
    steps, n = _parts(packed, 2, 4)
    last = 0
    for start in range(0, len(n), BATCH):
        key = last + np.cumsum(steps[start : start + BATCH], dtype=np.int64)
        last = key[-1]
        yield key, n[start : start + BATCH].astype(np.int64)


def _rows(batches):
    """(a, b, n) of packed cells."""
    for batch in batches:
        for cell in batch.column("packed"):
            words = _words(cell.as_py())
            for key, n in _pairs(cell.as_py()):
                first, second = np.divmod(key, len(words))
                columns = [words.take(pa.array(first)), words.take(pa.array(second)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])


def _merged(table: pa.Table) -> pa.Table:
    """One packed cell of all those that tasks made of it."""
    cells = table["packed"]
    listed = [_words(cell.as_py()) for cell in cells]
    sizes = [len(words) for words in listed]
    words, place = _coded(listed)
    del listed
    start, held, size = 0, [], 0
    for count, cell in zip(sizes, cells):
        own = place[start : start + count].astype(np.int64)
        start += count
        for key, n in _pairs(cell.as_py()):
            first, second = np.divmod(key, count)
            held.append((own[first] * len(words) + own[second], n))
            size += len(key)
            if size >= PAIRS // 2:
                held, size = [_summed(held)], 0
    key, n = _summed(held)
    return pa.table({
        "cell": table["cell"].slice(0, 1).cast(pa.int32()), "packed": pa.array([_pack(words, key, n)], pa.binary()),
        "n": pa.array([int(n.sum())], pa.int64()),
    })


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with the sums of their counts. Each part is in order, which a stable sort makes use of."""
    key, n = (np.concatenate([part[i] for part in parts]) for i in range(2))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[heads], np.add.reduceat(n, heads)


def mutual_information(pairs: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b, n, pmi) of the pairs seen ``least`` times: pointwise mutual information in bits, over all pairs.

    ``pairs`` is read by cell: once for what each word's pairs add up to, which the cells of the word's group are given,
    and once for the pairs seen often. Pairs that do not come from :func:`near_pairs` are packed first.
    """
    cells, groups = pairs.__dict__.get("_cells") or _packed_rows(pairs)

    def of_each(run):
        def over(batches):
            for batch in batches:
                for cell, packed in zip(batch.column("cell"), batch.column("packed")):
                    yield from run(cell.as_py(), packed.as_py())

        return cells.mapInArrow(over, CELL)

    sums = kept(_by_cell(of_each(lambda _, packed: _sums(packed, groups)), groups, _merged, CELL), "near-words")
    total = (sums.agg(F.sum("n")).first()[0] or 0) // 2
    given = sums.withColumnRenamed("cell", "own").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other"), "often": F.lit(False)}
    ).withColumn("cell", F.expr("cast(high * (high + 1) div 2 + low AS int)"))
    often = of_each(lambda cell, packed: _often(cell, packed, least)).withColumn("often", F.lit(True))
    both = _by_cell(often.unionByName(given.select(*often.columns)), groups, _with_sums, "a string, b string, n long, m_a long, m_b long")
    ratio = F.col("n").cast("double") * (2.0 * total) / (F.col("m_a").cast("double") * F.col("m_b"))
    return both.select("a", "b", "n", F.round(F.log2(ratio), 6).alias("pmi"))


def _packed_rows(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Cells of pairs that come as rows, and the number of groups."""
    groups = _groups(pairs)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PAIRS // 8:
                yield from _packed(held, groups)
                held, size = [], 0
        if size:
            yield from _packed(held, groups)

    return kept(pairs.select("a", "b", "n").mapInArrow(run, CELL), "pairs"), groups


def _packed(held: list[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    words, word = _coded([batch.column(i).cast(pa.string()) for i in (0, 1) for batch in held])
    n = np.concatenate([batch.column(2).to_numpy(zero_copy_only=False) for batch in held])
    a, b, count, group = word[: len(n)].astype(np.int64), word[len(n) :].astype(np.int64), len(words), _group_of(words, groups)
    key = (_cell(group[a], group[b]) * count + a) * count + b
    order = np.argsort(key, kind="stable")
    yield from _cells(words, key[order], n[order])


def _sums(packed: bytes, groups: int) -> Iterator[pa.RecordBatch]:
    """What the pairs of a cell add up to for each word, as a pair of the word with itself in the row of its group."""
    words = _words(packed)
    count, group = len(words), _group_of(words, groups).astype(np.int64)
    sums = np.zeros(count, np.int64)
    for key, n in _pairs(packed):
        for place in np.divmod(key, count):
            sums += np.bincount(place, n, count).astype(np.int64)
    order = np.argsort(group, kind="stable")
    yield from _cells(words, (group[order] * count + order) * count + order, sums[order])


def _often(cell: int, packed: bytes, least: int) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell that are seen ``least`` times."""
    words = _words(packed)
    key, n = (np.concatenate(part) for part in zip(*((key[n >= least], n[n >= least]) for key, n in _pairs(packed))))
    yield from _cells(words, cell * len(words) ** 2 + key, n)


def _with_sums(table: pa.Table) -> pa.Table:
    """(a, b, n, m_a, m_b): the pairs of a cell with the sums of their words."""
    kind = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64()), ("m_a", pa.int64()), ("m_b", pa.int64())])
    cells = table.filter(table["often"])["packed"]
    if not len(cells):
        return kind.empty_table()
    known = table.filter(pc.invert(table["often"]))["packed"]
    sums = np.concatenate([n for cell in known for _, n in _pairs(cell.as_py())])
    listed = [_words(cell.as_py()) for cell in cells]
    place = pc.index_in(pa.concat_arrays(listed), value_set=pa.concat_arrays([_words(cell.as_py()) for cell in known]))
    own, start, found = sums[place.to_numpy()], 0, []
    for words, cell in zip(listed, cells):
        of = own[start : start + len(words)]
        start += len(words)
        for key, n in _pairs(cell.as_py()):
            first, second = np.divmod(key, len(words))
            columns = [words.take(pa.array(first)), words.take(pa.array(second)), pa.array(n), pa.array(of[first]), pa.array(of[second])]
            found.append(pa.Table.from_arrays(columns, schema=kind))
    return pa.concat_tables(found)


def expansion_terms(scored: DataFrame, k: int = 3) -> DataFrame:
    """(term, expansion): for every word the ``k`` others of the greatest information above zero, ties to the more
    frequent pair and then by letters."""
    ways = scored.filter("pmi > 0").select(
        F.explode(F.array(
            F.struct(F.col("a").alias("term"), F.col("b").alias("expansion")), F.struct(F.col("b").alias("term"), F.col("a").alias("expansion")),
        )).alias("w"), "n", "pmi",
    ).select("w.*", "n", "pmi")
    best = top_n_per_group(ways, ["term"], [F.desc("pmi"), F.desc("n"), F.col("expansion")], k)
    return best.select("term", "expansion")
