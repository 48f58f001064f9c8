"""SentencePiece ids of texts, each with the bytes of the text it came from, and texts back from ids.

A text is normalised here: at each place the longest entry of the model's compiled character map (a double-array trie
and the strings it points to) is replaced, other characters stay, and blanks become the model's space mark; for each
byte of the result the place in the text that it came from is kept. The result is cut where no piece of the model can
lie across, each cut is encoded once and remembered by the worker, and the pieces' lengths carry every id back over the
kept places to its span of the text.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewatch.llm.batches import by_value, raw_texts, slices

by_value(__name__)

MARK = "▁"
_MARK = MARK.encode()
_REPLACEMENT = "�".encode()
# Characters of the cuts in the newer and in the older half of what a worker remembers, and of the longest that is
# remembered. With what Python adds to each short string, both halves take at most about 250 MB.
KEPT = 4_000_000
LONGEST = 64
# Texts and bytes of text that are encoded together.
ROWS, BYTES = 256, 1 << 21
# Lives as long as the worker process; task code itself is loaded anew for every task.
_STATE = "casewatch_piece_models"


class CharacterMap:
    """The compiled character map of a model: the size of a trie, its units, and strings that end in a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]
        self.known: dict[int, bytes] = {}
        # Bytes that an entry can start with.
        self.starts = frozenset(b for b in range(256) if self.units and self._step(self._root(), b) is not None)
        self.plain = re.compile(b"[^%s]+" % b"".join(b"\\x%02x" % b for b in sorted(self.starts))) if self.starts else None

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, place: int, byte: int) -> int | None:
        """The place of the unit reached by a byte from children at `place`."""
        place ^= byte
        return place if self.units[place] & (1 << 31 | 0xFF) == byte else None

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that `text` has at `start`."""
        found, place = None, self._root()
        for at in range(start, len(text)):
            if text[at] == 0 or (reached := self._step(place, text[at])) is None:
                break
            unit = self.units[reached]
            place = reached ^ self._offset(unit)
            if unit >> 8 & 1:
                found = (at + 1 - start, self.units[place] & (1 << 31) - 1)
        if found is None:
            return None
        if found[1] not in self.known:
            self.known[found[1]] = self.strings[found[1] : self.strings.index(0, found[1])]
        return found[0], self.known[found[1]]

    def pieces(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, replacement) of what the map replaces; characters start where UTF-8 ones do."""
        at = 0
        while at < len(text):
            if text[at] not in self.starts:
                at = self.plain.match(text, at).end()
                continue
            if (entry := self.longest(text, at)) is not None:
                yield at, *entry
                at += entry[0]
            else:
                first = text[at]
                at += 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    """Texts to normalised ones as a model's rules say, with the place each byte came from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The text after the character map, and for each of its bytes the place it came from (one more for the end)."""
        if not self.map.units:
            return text, np.arange(len(text) + 1, dtype=np.int32)
        out, places, done = [], [], 0
        for start, length, new in self.map.pieces(text):
            out += [text[done:start], new]
            places += [np.arange(done, start), np.full(len(new), start)]
            done = start + length
        return b"".join([*out, text[done:]]), np.concatenate([*places, np.arange(done, len(text) + 1)])

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        found, places = self.mapped(text)
        data = np.frombuffer(found, np.uint8)
        blank = data == 32
        if self.squeeze:
            # Blanks that start the text, follow another or end it go.
            keep = np.ones(len(data), bool)
            keep[1:] = ~(blank[1:] & blank[:-1])
            if len(data):
                keep[0] = not blank[0]
                last = np.flatnonzero(keep)
                if len(last) and blank[last[-1]]:
                    places = np.append(places[:-1], places[last[-1]])
                    keep[last[-1]] = False
            data, blank, places = data[keep], blank[keep], np.append(places[:-1][keep], places[-1])
            found = data.tobytes()
        if not len(data):
            return b"", places[-1:]
        if self.escape:
            found = found.replace(b" ", _MARK)
            places = np.repeat(places, np.append(np.where(blank, len(_MARK), 1), 1))
        if self.prefix:
            front = _MARK if self.escape else b" "
            found, places = front + found, np.concatenate([np.full(len(front), places[0]), places])
        return found, places


def _only_prefix(model) -> bool:
    """Whether decoding takes off the one blank put before a text and changes nothing else."""
    spec = model.normalizer_spec
    return spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not model.denormalizer_spec.precompiled_charsmap


class Pieces:
    """A model's pieces: ids of normalised texts, with the memory of one worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            whole = file.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(whole)
        if model.trainer_spec.model_type != 2 or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("only BPE models without user-defined pieces")
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with the space mark in front")
        self.normalizer = Normalizer(model.normalizer_spec)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=whole)
        self.plain = _only_prefix(model)
        # The same pieces for text that is normalised already.
        spec = model.normalizer_spec
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.segments = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.whole.eos_id()
        # Bytes of normalised text that an id stands for; unknown characters have their own lengths.
        self.lengths = np.array([1 if p.type == p.BYTE else 0 if p.type in (p.CONTROL, p.UNKNOWN) else len(p.piece.encode()) for p in model.pieces])
        self.unknown = self.whole.unk_id()
        # The bytes an id stands for in a text, one after another, and where each id's start.
        control = {n for n, p in enumerate(model.pieces) if p.type in (p.CONTROL, p.UNKNOWN)}
        texts = [
            bytes([int(p.piece[3:-1], 16)]) if p.type == p.BYTE else b"" if n in control else p.piece.replace(MARK, " ").encode()
            for n, p in enumerate(model.pieces)
        ]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.stops = np.cumsum([len(t) for t in texts])
        self.sizes = np.diff(self.stops, prepend=0)
        # A text that starts with such an id loses that one blank, and nothing else.
        self.starting = np.array([p.type == p.NORMAL and p.piece.startswith(MARK) for p in model.pieces])
        self.fallback = model.trainer_spec.byte_fallback
        # A mark after another character starts a cut, unless a piece has one inside; line ends are cuts by themselves,
        # unless a piece has one beside other characters.
        normal = [p.piece for p in model.pieces if p.type == p.NORMAL]
        self.inside = any(MARK in piece.lstrip(MARK) for piece in normal)
        self.lines = not any("\n" in piece for piece in normal)
        other = MARK + "\n" if self.lines else MARK
        self.cuts = re.compile(f"{MARK}*[^{other}]+|{MARK}+|\n", re.DOTALL)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.characters = 0

    def _cut(self, text: str) -> list[str]:
        """The cuts of a normalised text; empty ones may be among them."""
        if self.inside:
            return [text]
        if MARK + MARK in text or " " in text:
            return self.cuts.findall(text)
        spaced = text.replace(MARK, " " + MARK)
        return (spaced.replace("\n", " \n ") if self.lines else spaced).split(" ")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of normalised texts."""
        split = [self._cut(t) for t in texts]
        if self.characters > KEPT:
            self.old, self.young, self.characters = self.young, {"": b""}, 0
        young, recall = self.young, self.old.get
        missing = set().union(*split).difference(young)
        new = []
        for cut in missing:
            if (known := recall(cut)) is None:
                new.append(cut)
            else:
                young[cut] = known
        for cut, ids in zip(new, self.segments.encode(new, num_threads=1) if new else ()):
            young[cut] = array("i", ids).tobytes()
        found = [np.frombuffer(b"".join(map(young.__getitem__, cuts)), "<i4") for cuts in split]
        self.characters += sum(map(len, missing))
        for cut in [c for c in new if len(c) > LONGEST]:
            del young[cut]
            self.characters -= len(cut)
        return found

    def spans(self, text: str, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end, in the original text, of the ids of a normalised one."""
        sizes = self.lengths[ids]
        if not self.fallback and (ids == self.unknown).any():
            # What no piece covers is one id for each run of such characters.
            proto = self.segments.encode(text, return_type="proto")
            sizes = np.array([p.end - p.begin for p in proto.pieces], np.int64)
        ends = np.cumsum(sizes)
        return places[ends - sizes], places[ends]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, as the library's decode gives it."""
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        # Control ids within a text, and unknown ones, are left to the library.
        if self.plain and self.starting[ids[0]] and sizes[:-1].all() and ids[-1] != self.unknown:
            ends = np.cumsum(sizes)
            whole = self.bytes[np.repeat(self.stops[ids] - ends, sizes) + np.arange(ends[-1])].tobytes()
            try:
                return whole[1:].decode()
            except UnicodeDecodeError:
                pass  # bytes that are no character
        return self.whole.decode(ids.tolist())

    def encode(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first bytes and ends for each text, the end id last with an empty span."""
        normal = [self.normalizer(t or b"") for t in texts]
        plain = [n.decode("utf-8", "replace") for n, _ in normal]
        result = []
        for text, (_, places), ids in zip(plain, normal, self.ids(plain)):
            starts, ends = self.spans(text, places, ids)
            last = places[-1]
            result.append((np.append(ids, self.end), np.append(starts, last), np.append(ends, last)))
        return result


def pieces(path: str) -> Pieces:
    """This worker's memory for a model file."""
    state = sys.modules.setdefault(_STATE, types.ModuleType(_STATE))
    kept = state.__dict__.setdefault("models", {})
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows with a bounded number of bytes in a column, a longer row alone."""
    for batch in slices(batches, ROWS):
        values = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(values) if not pa.types.is_list(values.type) else pa.compute.list_value_length(values), 0)
        ends, start = np.cumsum(sizes.to_numpy()), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + BYTES, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def _with(batch: pa.RecordBatch, new: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *[a for _, a in new]], names=[*batch.schema.names, *[n for n, _ in new]])


def _free(docs: DataFrame, *names: str) -> None:
    if taken := set(n.lower() for n in names) & set(c.lower() for c in docs.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")


def encode_pieces(
    docs: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", starts: str = "piece_starts", ends: str = "piece_ends"
) -> DataFrame:
    """`docs` with three arrays: the ids of the model file's pieces, the end id last, and where each piece's bytes of the
    original UTF-8 text start and end.

    Ids are those of the sentencepiece library, without sampling. A null or empty text has the end id only. The space
    mark put before the text adds nothing to its piece's span. Each byte piece of a character that no other piece covers
    has its own byte as its span; where the character map put a replacement, its first byte starts at the first replaced
    byte and its last one ends with the last. All other columns stay; names that are taken already are an error: give
    others.
    """
    _free(docs, ids, starts, ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pieces(model)
        for part in _groups(batches, text):
            found = mine.encode(raw_texts(part.column(text)))
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x).astype(np.int32))) for x in zip(*found)]
            yield _with(part, list(zip((ids, starts, ends), lists)))

    numbers = T.ArrayType(T.IntegerType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, numbers) for c in (ids, starts, ends)]]))


def decode_pieces(docs: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """`docs` with the text that the model gives back for the ids; null ids give a null text, no ids an empty one."""
    _free(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = pieces(model)
        for part in _groups(batches, ids):
            lists = part.column(ids)
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            flat, known = lists.flatten().to_numpy(), lists.is_valid().to_pylist()
            texts = [mine.decode(flat[start:end]) if real else None for start, end, real in zip([0, *ends[:-1]], ends, known)]
            yield _with(part, [(text, pa.array(texts, pa.string()))])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))
