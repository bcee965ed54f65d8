"""Comments and string contents as spaces, by a finite automaton whose steps are composed instead of walked.

Only a few characters change the state that a text is read in. Each of them is a map of states, maps compose, and a scan
over blocks of composed maps gives the state before every one of them; what stands between two of them is kept or blanked
as a whole. A text that is in pieces is read the same way: the map of each piece first, then each piece from its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Languages whose comments begin with a number sign; in all others they begin with two slashes or stand between /* and */.
HASH_COMMENTS = ("python", "ruby", "shell")

# States: code, a comment of blocks, one to the line's end, a string in each of three quotes; from the seventh on the first,
# second, fourth, fifth and sixth of these with a character ahead that has no meaning of its own.
_CODE, _BLOCK, _LINE = 0, 1, 2
_QUOTES = {'"': 3, "'": 4, "`": 5}
_AFTER = {_CODE: 6, _BLOCK: 7, 3: 8, 4: 9, 5: 10}
STATES = 11

# What a character means: nothing, opening and closing a block, a comment to the line's end, a quote, the escape, a line's
# start, and padding; beyond, a text's start in each state.
_PLAIN, _OPENS, _CLOSES, _COMMENT, _ESCAPE, _START, _PAD = 0, 1, 2, 3, 7, 8, 9
_BEGINS = 10


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state after each meaning in each state, and whether the character itself is blanked."""
    settled = np.arange(STATES)
    for state, ahead in _AFTER.items():
        settled[ahead] = state
    step = np.tile(settled, (_BEGINS + STATES, 1))
    step[_OPENS, _CODE], step[_CLOSES, _BLOCK], step[_COMMENT, _CODE], step[_START, _LINE] = _AFTER[_BLOCK], _AFTER[_CODE], _LINE, _CODE
    blank = np.tile(np.arange(STATES) != _CODE, (_BEGINS + STATES, 1))
    blank[[_OPENS, _COMMENT], _CODE] = True
    for meaning, quote in enumerate(_QUOTES.values(), 4):
        step[meaning, _CODE], step[meaning, quote], step[_ESCAPE, quote] = quote, _CODE, _AFTER[quote]
        blank[meaning, quote] = False
    step[_PAD] = np.arange(STATES)
    step[_BEGINS:] = step[_START][:, None]  # a text begins with a line
    return step.astype(np.uint8).reshape(-1), blank.reshape(-1)


_STEP, _BLANK = _tables()
_SIGNS = bytes("/*#\"'`\\".find(chr(b)) + 1 for b in range(256))
_SLASH, _STAR, _HASH = 1, 2, 3
_WIDTH = 64  # meanings of a block


class Signs:
    """The characters of some texts that may change the state, with the starts of lines and texts among them.

    data: bytes of all lines one after another; bounds: where lines begin and the last ends; first: lines that begin a
    text; hashed: lines in a language of HASH_COMMENTS; begin: the state at each text's start, code if not given, or
    -1 to leave it open."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: np.ndarray, hashed: np.ndarray, begin: np.ndarray | int = _CODE) -> None:
        self.data, self.bounds = data, bounds
        sign = np.frombuffer(data.tobytes().translate(_SIGNS), np.uint8)
        seen = sign > 0
        seen[1:] |= data[:-1] == ord("\\")
        at = np.flatnonzero(seen)
        lines = len(bounds) - 1
        # a line's start goes before the characters from there on
        spots = np.searchsorted(at, bounds[:-1], "left") + np.arange(lines)
        self.is_char = np.ones(len(at) + lines, bool)
        self.is_char[spots] = False
        self.place = np.empty(len(at) + lines, np.int64)
        self.place[spots], self.place[self.is_char] = bounds[:-1], at
        line = np.cumsum(~self.is_char)[self.is_char] - 1
        kind, last = sign[at], at + 1 == bounds[line + 1]
        after = np.where(last, 0, data[np.minimum(at + 1, max(len(data) - 1, 0))]) if len(data) else at
        slashed = ~hashed[line]
        meaning = np.where(kind > _HASH, kind, _PLAIN)
        meaning[slashed & (kind == _SLASH) & (after == ord("*"))] = _OPENS
        meaning[slashed & (kind == _STAR) & (after == ord("/"))] = _CLOSES
        meaning[(slashed & (kind == _SLASH) & (after == ord("/"))) | (~slashed & (kind == _HASH))] = _COMMENT
        self.meaning = np.empty(len(self.place), np.int16)
        self.meaning[self.is_char] = meaning
        begins = np.full(lines, _START, np.int16)
        begins[first] = np.where(np.asarray(begin) < 0, _START, _BEGINS + np.asarray(begin))
        self.meaning[spots] = begins
        self.ends_line = np.zeros(len(self.place), bool)
        self.ends_line[self.is_char] = last

    def _blocks(self) -> np.ndarray:
        rows = -(-len(self.meaning) // _WIDTH)
        padded = np.full(rows * _WIDTH, _PAD, np.int16)
        padded[: len(self.meaning)] = self.meaning
        return np.ascontiguousarray(padded.reshape(rows, _WIDTH).T) * STATES

    def maps(self) -> np.ndarray:
        """Of each block, the state that it leaves behind for each state before it."""
        blocks = self._blocks()
        out = np.tile(np.arange(STATES, dtype=np.int16), (blocks.shape[1], 1))
        for meaning in blocks:
            out = _STEP[meaning[:, None] + out]
        return out

    def whole(self) -> np.ndarray:
        """The map of everything."""
        out = np.arange(STATES)
        for block in self.maps():
            out = block[out]
        return out.astype(np.uint8)

    def states(self) -> np.ndarray:
        """The state before each sign; the first line begins a text."""
        maps = self.maps().tolist()
        state, starts = _CODE, np.empty(len(maps), np.int16)
        for k, block in enumerate(maps):
            starts[k] = state
            state = block[state]
        blocks, now = self._blocks(), starts
        out = np.empty(blocks.shape, np.uint8)
        for k, meaning in enumerate(blocks):
            out[k] = now
            now = _STEP[meaning + now]
        return out.T.reshape(-1)[: len(self.meaning)]

    def blanked(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with a space for each blanked character, and where lines begin in them. The escape that ends a line
        inside a string has taken the place of two characters, so there stand two spaces."""
        state = self.states()
        index = self.meaning.astype(np.int64) * STATES + state
        inside, after = _BLANK[index], _STEP[index] != _CODE
        gap = np.diff(self.place, append=len(self.data)) - self.is_char
        flags = np.stack([inside, after], 1).reshape(-1)
        blank = np.repeat(flags, np.stack([self.is_char, gap], 1).reshape(-1))
        out, bounds = np.where(blank, np.uint8(32), self.data), self.bounds
        if len(out) and self.data.max() >= 0x80:  # of a blanked character of several bytes, the first one stays
            rest = blank & (self.data & 0xC0 == 0x80)
            out, moved = out[~rest], bounds - np.searchsorted(np.flatnonzero(rest), bounds)
        else:
            rest, moved = None, bounds
        twice = self.place[self.ends_line & (self.meaning == _ESCAPE) & (state >= 3) & (state <= 5)]
        if len(twice):
            at = twice if rest is None else twice - np.searchsorted(np.flatnonzero(rest), twice)
            out, moved = np.insert(out, at + 1, np.uint8(32)), moved + np.searchsorted(at, moved)
        return out, moved


def _flat(lines: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds of lines, number of the first line of each row and of all)."""
    values = lines.flatten().cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    counts = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return data, offsets - offsets[0], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def blank_rows(lines: pa.ListArray, languages: list[str | None], begin: np.ndarray | None = None) -> pa.ListArray:
    """Each row's lines blanked; a row is a text in its language, read from state `begin` (code, if not given)."""
    data, bounds, firsts = _flat(lines)
    if len(bounds) == 1:
        return lines
    counts = np.diff(firsts)
    hashed = np.repeat([x in HASH_COMMENTS for x in languages], counts)
    filled = counts > 0
    first = np.zeros(len(bounds) - 1, bool)
    first[firsts[:-1][filled]] = True
    out, ends = Signs(data, bounds, first, hashed, _CODE if begin is None else begin[filled]).blanked()
    values = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))]).cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), values)


def blanked(lines: list[str], language: str | None) -> list[str]:
    return blank_rows(pa.array([lines], pa.list_(pa.string())), [language])[0].as_py()


def piece_map(lines: list[str], language: str | None) -> bytes:
    """The state after a piece of a text for each state before it."""
    data, bounds, _ = _flat(pa.array([lines], pa.list_(pa.string())))
    return Signs(data, bounds, np.zeros(len(bounds) - 1, bool), np.full(len(bounds) - 1, language in HASH_COMMENTS)).whole().tobytes()


def with_code(files: DataFrame) -> DataFrame:
    """files (…, language, raw) with code: their lines with comments and string contents as spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = blank_rows(batch.column("raw"), batch.column("language").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, code], names=[*batch.schema.names, "code"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("code", T.ArrayType(T.StringType()))]))


def with_code_by_pieces(files: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The same for files (keys, language, raw) in pieces of `size` lines, one row each: keys, language, piece, first_line, raw, code.

    The pieces of one large file are blanked by as many tasks. Their maps, 11 bytes each, are composed in order by a
    fold within the file, which gives each piece the state that it begins in."""
    cut = files.select(*keys, "language", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("raw") - 1) / size).cast("int"))), lambda k: F.slice("raw", k * size + 1, size))).alias("piece", "raw"))

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [piece_map(raw, language) for raw, language in zip(batch.column("raw").to_pylist(), batch.column("language").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column("piece"), pa.array(found, pa.binary())], names=[*keys, "piece", "map"])

    types = {f.name: f.dataType for f in cut.schema.fields}
    shape = T.StructType([*[T.StructField(k, types[k]) for k in keys], T.StructField("piece", T.IntegerType()), T.StructField("map", T.BinaryType())])
    of_file = Window.partitionBy(*keys).orderBy("piece")
    # a state is a place in the map of the next piece; maps are read as their hexadecimal digits
    ahead = F.collect_list(F.hex("map")).over(of_file.rowsBetween(Window.unboundedPreceding, -1))
    state = F.aggregate(ahead, F.lit(0), lambda s, m: F.conv(F.substring(m, 2 * s + 1, F.lit(2)), 16, 10).cast("int"))
    begins = cut.mapInArrow(maps, shape).select(*keys, "piece", state.alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = blank_rows(batch.column("raw"), batch.column("language").to_pylist(), batch.column("begin").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, code], names=[*batch.schema.names, "code"])

    joined = cut.join(begins, [*keys, "piece"])
    out = joined.mapInArrow(run, T.StructType([*joined.schema.fields, T.StructField("code", T.ArrayType(T.StringType()))]))
    return out.select(*keys, "language", "piece", (F.col("piece") * size + 1).alias("first_line"), "raw", "code")
