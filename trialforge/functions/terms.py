"""Counts and weights of terms, runs of words and runs of characters, in vectors of numpy.

Texts are in lower case already. Words of two or more letters, digits or underscores make runs joined by a space; characters make runs
within what white space parts, padded with a space on both sides. A vocabulary holds the commonest terms by their number of uses; of equal
ones shorter runs come first, then the alphabet decides. So a longer run of words enters only with more uses than the last term so far,
and both runs within it have as many at least: only those are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from trialforge.functions.lineage import discard, materialize

WORD = re.compile(r"\w\w+", re.ASCII)
BETWEEN = "[^0-9A-Za-z_]+"
# Rows of counts come in blocks of so many; words are worked through in pieces of so many characters, texts in those of so many bytes; rows
# held to be summed.
DOCS, CHARS, BYTES, ROWS = 512, 1 << 20, 1 << 22, 1 << 19


class Kind(NamedTuple):
    """`most` terms that are runs of `least` to `longest` words or characters."""

    name: str
    most: int
    least: int
    longest: int


def _pieces(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The place of the first word of each piece, and its words."""
    start = size = 0
    for i, t in enumerate(words):
        if i > start and size + len(t) > CHARS:
            yield start, words[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(words):
        yield start, words[start:]


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts that have BYTES of text, or one text."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the place among the distinct ones of each use of what white space parts, and these; white space at an end parts an
    empty one from it. Arrow's white space is that of str.split."""
    lists = pc.utf8_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), words.indices.to_numpy(), words.dictionary


def _ends(of: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each of n, told by `of` in rising order, begin, and where the last ones end."""
    return np.r_[0, np.cumsum(np.bincount(of, minlength=n))]


def _expanded(ends: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of each that is picked, one after the other, and the place in `picked` that each is for."""
    sizes = np.diff(ends)[picked]
    of = np.repeat(np.arange(len(picked)), sizes)
    return np.arange(len(of)) + np.repeat(ends[picked] - (np.cumsum(sizes) - sizes), sizes), of


class Finder:
    """Finds terms in a sequence of symbols: a table for each length leads from the term's start and the next symbol to a longer start."""

    def __init__(self, kind: str, found: list[str]):
        self.kind = kind
        split = [t.split(" ") if kind == "words" else list(t) for t in found]
        self.symbols = {x: i + 1 for i, x in enumerate(sorted({x for t in split for x in t}))}
        width, self.steps, self.ends = len(self.symbols) + 1, [], []
        nodes = {(): 0}
        for k in range(1, max(map(len, split), default=0) + 1):
            starts = {x: i + 1 for i, x in enumerate(dict.fromkeys(tuple(t[:k]) for t in split if len(t) >= k))}
            step, end = np.zeros((len(nodes) + 1, width), np.int32), np.full(len(starts) + 1, -1, np.int32)
            for x, i in starts.items():
                step[nodes[x[:-1]], self.symbols[x[-1]]] = i
            for i, t in enumerate(split):
                if len(t) == k:
                    end[starts[tuple(t)]] = i
            self.steps.append(step.ravel())
            self.ends.append(end)
            nodes = starts
        self.width = width
        if kind == "chars":
            self.letters = np.zeros(max(map(ord, self.symbols), default=0) + 2, np.int32)
            for x, i in self.symbols.items():
                self.letters[ord(x)] = i

    def read(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For characters: the symbols of padded words, 0 for any that is in no term and after each word, and the word that each is of."""
        split = [padded(t.split()) + "\0" for t in words]
        codes = np.frombuffer("".join(split).encode("utf-32-le"), np.uint32)
        made = self.letters[np.minimum(codes, len(self.letters) - 1)]
        sizes = np.array([len(t) for t in split])
        made[np.cumsum(sizes) - 1] = 0
        return made, np.repeat(np.arange(len(words)), sizes)

    def tokens(self, distinct: pa.Array, uses: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words: the symbols of uses of distinct texts, 0 for any that is in no term, and what `of` tells of the use that each is in."""
        owner, words = tokens(distinct)
        symbols = pc.index_in(words, pa.array(list(self.symbols), words.type)).fill_null(-1).to_numpy() + 1
        items, use = _expanded(_ends(owner, len(distinct)), uses)
        return symbols[items], of[use]

    def within(self, distinct: pa.Array, uses: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `of` tells of each use of a distinct text that holds a term, and the term, for each place of it; runs of words also go from
        one use to the next of the same `of`."""
        if self.kind == "words":
            symbols, owner = self.tokens(distinct, uses, of)
            for k, at in self.places(symbols):
                hit = np.flatnonzero((at >= 0) & (owner[: len(at)] == owner[k - 1 :]))
                yield owner[hit], at[hit]
            return
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for start, words in _pieces(distinct.to_pylist()):
            symbols, owner = self.read(words)
            for _, at in self.places(symbols):
                hit = np.flatnonzero(at >= 0)
                owners.append(owner[hit] + start)
                found.append(at[hit])
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        items, use = _expanded(_ends(owner[order], len(distinct)), uses)
        yield of[use], np.concatenate(found)[order][items]

    def places(self, symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length the term that starts at each symbol, -1 where none does."""
        state = np.zeros(len(symbols), np.int32)
        for k, (step, end) in enumerate(zip(self.steps, self.ends)):
            if len(symbols) < k:
                return
            state = step[(state[:-1] if k else state) * self.width + symbols[k:]]
            yield k + 1, end[state]


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The text that each word is of, and the words, as WORD finds them."""
    lists = pc.split_pattern_regex(texts, BETWEEN)
    found = lists.flatten()
    long = pc.greater(pc.binary_length(found), 1)
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[long.to_numpy(zero_copy_only=False)], found.filter(long)


def padded(words: Iterable[str]) -> str:
    """Words with a space on both sides each, so that two spaces part them."""
    made = "  ".join(words)
    return f" {made} " if made else ""


def run_counts(words: list[str], uses: np.ndarray, least: int, longest: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Runs of characters within words that are used so many times, with the sums of their uses; a padded word shorter than `least` is one."""
    text, sizes = padded(words), np.array([len(w) + 2 for w in words])
    short = np.flatnonzero(sizes < least)
    if len(short):
        yield [f" {words[i]} " for i in short], uses[short]
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    weight = np.repeat(uses, sizes)
    # how many words have ended before each place
    ended = np.repeat(np.arange(len(words)), sizes)
    letters, letter = np.unique(points, return_inverse=True)
    code, top = letter.astype(np.int64), len(letters)
    for k in range(1, longest + 1):
        if k > 1:
            if top * len(letters) >= 1 << 62:
                seen, code = np.unique(code, return_inverse=True)
                top = len(seen)
            code, top = code[:-1] * len(letters) + letter[k - 1 :], top * len(letters)
        if k < least or len(code) == 0:
            continue
        whole = np.flatnonzero(ended[: len(code)] == ended[k - 1 :])
        if len(whole):
            run = pa.array(code[whole]).dictionary_encode()
            which = run.indices.to_numpy()
            place = np.empty(len(run.dictionary), np.int64)
            place[which] = whole
            yield [text[i : i + k] for i in place.tolist()], np.bincount(which, weight[whole]).astype(np.int64)


def _rows(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.split())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the `uses`, their last column, of rows that are equal otherwise summed, as far as ROWS hold them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > ROWS:
            held = _grouped(held)
            if sum(x.num_rows for x in held) > ROWS // 2:
                yield from held
                held = []
    if held:
        yield from _grouped(held)


def _grouped(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    names = held[0].schema.names
    sums = pa.Table.from_batches(held).group_by(names[:-1], use_threads=False).aggregate([("uses", "sum")])
    return sums.rename_columns({"uses_sum": "uses"}).select(names).combine_chunks().to_batches()


def _spaced(batches):
    """word, uses: what white space parts."""

    def counted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, 0):
                _, uses, words = _split(part.column(0))
                yield _rows("word uses", words, pa.array(np.bincount(uses, minlength=len(words)), pa.int64()))

    return _summed(counted())


def _single(kinds: list[Kind]):
    """kind, term, size, uses: words, and runs of characters, of distinct texts without white space and their uses."""

    def made(kind: int, found: list[str] | pa.Array, size: int, uses: np.ndarray) -> pa.RecordBatch:
        return _rows("kind term size uses", pa.repeat(pa.scalar(kind, pa.int32()), len(found)), found if isinstance(found, pa.Array) else pa.array(found, pa.string()), pa.repeat(pa.scalar(size, pa.int32()), len(found)), uses)

    def counted(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uses = batch.column(1).to_numpy()
            for start, spaced in _pieces(batch.column(0).to_pylist()):
                own = uses[start : start + len(spaced)]
                for i, kind in enumerate(kinds):
                    if kind.name == "chars":
                        for found, n in run_counts(spaced, own, kind.least, kind.longest):
                            yield made(i, found, 0, n)
                    else:
                        of, found = tokens(pa.array(spaced, pa.string()))
                        yield made(i, found, 1, own[of])

    return lambda batches: _summed(counted(batches))


def _longer(found: list[str], k: int):
    """term, uses: runs of k + 1 words in which both runs of k words are among `found`."""

    def run(batches):
        finder, m = Finder("words", found), len(found)
        for batch in batches:
            codes, uses = [], []
            for part in _chunks(batch, 0):
                of, places, words = _split(part.column(0))
                symbols, text = finder.tokens(words, places, of)
                at = next((x for size, x in finder.places(symbols) if size == k), np.zeros(0)).astype(np.int64)
                both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & (text[:-k] == text[k:]))
                code, n = np.unique(at[both] * m + at[both + 1], return_counts=True)
                codes.append(code)
                uses.append(n)
            if codes:
                code, place = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(place, np.concatenate(uses), len(code)).astype(np.int64)
                names = [f"{found[c // m]} {found[c % m].rsplit(' ', 1)[-1]}" for c in code.tolist()]
                yield _rows("term uses", pa.array(names, pa.string()), pa.array(n, pa.int64()))

    return run


def commonest(texts: DataFrame, kinds: list[Kind]) -> list[list[str]]:
    """The commonest terms of each kind in the column `_text`."""
    spaced = texts.select("_text").mapInArrow(_spaced, "word string, uses bigint").where("word <> ''").groupBy("word").agg(F.sum("uses").alias("uses"))
    single = spaced.mapInArrow(_single(kinds), "kind int, term string, size int, uses bigint").groupBy("kind", "term").agg(F.max("size").alias("size"), F.sum("uses").alias("uses"))
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.length("term"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("uses"), size, "term"))
    top: list[list[tuple]] = [[] for _ in kinds]
    for r in single.withColumn("place", place).where(F.col("place") <= max(k.most for k in kinds)).orderBy("kind", "place").collect():
        if r["place"] <= kinds[r["kind"]].most:
            top[r["kind"]].append((-r["uses"], r["size"] or len(r["term"]), r["term"]))
    for i, kind in enumerate(kinds):
        for k in range(1, kind.longest) if kind.name == "words" else ():
            last = -top[i][-1][0] if len(top[i]) >= kind.most else 0
            found = [t for n, size, t in top[i] if size == k and -n > last]
            if not found:
                break
            longer = texts.select("_text").mapInArrow(_longer(found, k), "term string, uses bigint").groupBy("term").agg(F.sum("uses").alias("uses"))
            more = [(-r["uses"], k + 1, r["term"]) for r in longer.orderBy(F.desc("uses"), "term").limit(kind.most).collect()]
            top[i] = sorted(top[i] + more)[: kind.most]
    return [[t for _, _, t in x] for x in top]


# The columns of a block of rows of counts: how many terms each row has, and the places and uses of these as bytes.
BLOCK = ["_lengths", "_places", "_uses"]


def _bytes(x: np.ndarray, total: int | None = None) -> bytes:
    """Whole numbers as bytes, as narrow as the largest, or as all below `total`, needs them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)) if total is None else total)).tobytes()


def _numbers(x: bytes, n: int) -> np.ndarray:
    """n whole numbers from their bytes."""
    return np.frombuffer(x, f"u{len(x) // n}" if n else np.uint8)


def block(row: tuple[bytes, bytes, bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and uses of each use of a term in a block of n rows."""
    lengths = _numbers(row[0], n)
    of = np.repeat(np.arange(n), lengths)
    return of, _numbers(row[1], len(of)), _numbers(row[2], len(of))


def _counted(kinds: list[Kind], vocabulary: list[list[str]], rest: int):
    """Blocks of rows, those of `_fit` apart: the first columns as lists, and the places and uses of the terms in their texts. The last
    columns are `_fit` and the text."""

    def cells(part: pa.RecordBatch, finders: list[Finder], bases: np.ndarray) -> Iterator[list]:
        total, n = max(1, int(bases[-1])), part.num_rows
        of, places, words = _split(part.column(rest + 1))
        ends = np.searchsorted(of, np.arange(0, n + DOCS, DOCS))
        found = [list(f.within(words, places, of)) for f in finders]
        cuts = [[np.searchsorted(text, np.arange(0, n + DOCS, DOCS)) for text, _ in x] for x in found]
        for i in range(len(ends) - 1):
            start, size = i * DOCS, min(DOCS, n - i * DOCS)
            at = [(text[c[i] : c[i + 1]] - start) * total + (term[c[i] : c[i + 1]] + base) for x, y, base in zip(found, cuts, bases) for (text, term), c in zip(x, y)]
            uses = np.bincount(np.concatenate(at) if at else np.zeros(0, np.int64), minlength=size * total)
            used = np.flatnonzero(uses)
            row, place = np.divmod(used, total)
            own = part.slice(start, size)
            lists = [pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), own.column(j)) for j in range(rest)]
            yield [*lists, pa.array([own.column(rest)[0].as_py()]), *[pa.array([x], pa.binary()) for x in (_bytes(np.bincount(row, minlength=size)), _bytes(place, total), _bytes(uses[used]))]]

    def run(batches):
        finders = [Finder(k.name, v) for k, v in zip(kinds, vocabulary)]
        bases = np.r_[0, np.cumsum([len(v) for v in vocabulary])]
        for batch in batches:
            for part in _chunks(batch, rest + 1):
                made = [x for own in (part.filter(part.column(rest)), part.filter(pc.invert(part.column(rest)))) if own.num_rows for x in cells(own, finders, bases)]
                columns = [pa.concat_arrays(x) for x in zip(*made)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[: rest + 1], *BLOCK])

    return run


def blocks_of(batch: pa.RecordBatch, rest: int) -> Iterator[tuple[list[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The first columns of the rows of each block and, from the last three, its counts as of block()."""
    for i in range(batch.num_rows):
        own = [batch.column(j)[i].values for j in range(rest)]
        yield own, block(tuple(batch.column(rest + j)[i].as_buffer() for j in range(3)), len(own[0]))


def _documents(size: int):
    """place, docs: in how many rows each term is; at -1 all rows."""

    def run(batches):
        docs, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for own, (_, places, _) in blocks_of(batch, 1):
                docs += np.bincount(places, minlength=size)[:size]
                n += len(own[0])
        yield _rows("place docs", pa.array(np.arange(-1, size), pa.int32()), pa.array(np.r_[n, docs], pa.int64()))

    return run


class Counts(NamedTuple):
    """A table with the places and uses of the terms found in each row, in blocks of rows (blocks_of); weights, kinds and the places of those
    kept, the `parts` kinds one after the other."""

    table: DataFrame
    idf: np.ndarray
    kinds: np.ndarray
    kept: np.ndarray
    parts: int

    @property
    def bounds(self) -> list[tuple[int, int]]:
        """Where the terms of each kind begin and end among those kept."""
        ends = np.searchsorted(self.kinds[self.kept], np.arange(self.parts + 1)).tolist()
        return list(zip(ends, ends[1:]))

    def reader(self):
        """Reads the counts of a block of n rows: row, place among the terms kept, uses and weight for each use of a kept term, its kind's part
        of the row, and the length of each part of each row."""
        column = np.full(len(self.idf), -1, np.int32)
        column[self.kept] = np.arange(len(self.kept), dtype=np.int32)
        idf, kinds, parts, every = self.idf, self.kinds, self.parts, len(self.kept) == len(self.idf)

        def read(of: np.ndarray, places: np.ndarray, uses: np.ndarray, n: int):
            if not every:
                left = column[places] >= 0
                places, uses, of = places[left], uses[left], of[left]
            weights = uses * idf[places]
            part = of * parts + kinds[places]
            norm = np.sqrt(np.bincount(part, weights * weights, n * parts))
            return of, column[places], uses, weights, part, np.where(norm > 0, norm, 1.0)

        return read


def _weights(counts: Counts, rest: int):
    """The rows of blocks, with the counts as vectors of uses times idf of the terms kept, the part of each kind scaled to length 1."""
    read, size = counts.reader(), len(counts.kept)

    def vectors(of: np.ndarray, places: np.ndarray, uses: np.ndarray, n: int) -> pa.StructArray:
        of, places, _, weights, part, norm = read(of, places, uses, n)
        weights /= norm[part]
        ends = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
        made = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(weights))]
        return pa.StructArray.from_arrays(made, names=["type", "size", "indices", "values"])

    def run(batches):
        for batch in batches:
            for own, counted in blocks_of(batch, rest):
                yield pa.RecordBatch.from_arrays([*own, vectors(*counted, len(own[0]))], names=[*batch.schema.names[:rest], "features"])

    return run


def counted(lowered: DataFrame, rest: list[str], kinds: list[Kind], min_df: int) -> Counts:
    """The columns `rest` and the counts of terms, from `_text` in lower case, in blocks of rows; `_fit` tells the rows that terms and weights
    are taken from. A term in fewer than min_df of them gives its place to the next."""
    fit = lowered.where("_fit")
    lists = [StructField(c, ArrayType(lowered.schema[c].dataType)) for c in rest]
    schema = StructType([*lists, lowered.schema["_fit"], *[StructField(c, BinaryType()) for c in BLOCK]])
    wanted = kinds
    while True:
        found = commonest(fit, wanted)
        table, path = materialize(lowered.select(*rest, "_fit", "_text").mapInArrow(_counted(kinds, found, len(rest)), schema), "terms")
        size = sum(map(len, found))
        seen = dict(table.where("_fit").select(rest[0], *BLOCK).mapInArrow(_documents(size), "place int, docs bigint").groupBy("place").agg(F.sum("docs")).collect())
        docs = np.array([seen.get(i, 0) for i in range(size)], np.int64)
        kind = np.repeat(np.arange(len(kinds)), [len(v) for v in found])
        # the commonest of each kind that are in texts enough
        kept = [np.flatnonzero((kind == i) & (docs >= min_df))[: k.most] for i, k in enumerate(kinds)]
        short = [len(x) < k.most and len(v) >= w.most for x, k, v, w in zip(kept, kinds, found, wanted)]
        if not any(short):
            break
        discard(lowered.sparkSession, path)
        wanted = [w._replace(most=w.most * 2) if s else w for w, s in zip(wanted, short)]
    idf = np.zeros(size)
    kept = np.concatenate(kept)
    idf[kept] = np.log((seen.get(-1, 0) + 1.0) / (docs[kept] + 1.0))
    return Counts(table, idf, kind, kept, len(kinds))


def weighted(counts: Counts, rest: list[str]) -> DataFrame:
    """The columns `rest` and `features`."""
    out = StructType([StructField(c, counts.table.schema[c].dataType.elementType) for c in rest] + [StructField("features", VectorUDT())])
    return counts.table.select(*rest, *BLOCK).mapInArrow(_weights(counts, len(rest)), out)
