"""Token ids of texts by a public tokenizer, with the ids of frequent words kept.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of its stretches
between blanks and line ends. Each worker keeps the stretches it met lately, which saves nearly all of the time.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casewatch.llm.batches import by_value

by_value(__name__)

# Characters in the newer and in the older half of the stretches a worker keeps, and of the longest that is kept. With
# what Python adds to each short string, both halves take at most about 130 MB.
KEPT = 2_000_000
LONGEST = 256
# Words of letters that are put together for one call.
JOINED = 64
END = 1
# Signs that may follow a word and are a word of the tokenizer by themselves (an apostrophe is not always one).
_TAIL = ".,!?;:*#$%&|()[]{}<>/\\=+-_~^@\""
# Byte-level tokenizers write bytes as signs: those of Latin-1 that can be seen as themselves, the others from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGNS = {byte: chr(0x100 + n) for n, byte in enumerate(sorted(set(range(0x100)).difference(_SEEN))) if byte != 0x20}
# A sign at the end of a stretch, after a letter: always a word of its own. Cut off, it leaves a stretch met more often.
_SIGN = re.compile(r"[.,;:!?](?= |\Z)(?<=[a-z].)")
# Lives as long as the worker process; task code itself is loaded anew for every task.
_STATE = "casewatch_worker_state"


def _lowered(text: str) -> str:
    """Lower-cased where that is surely what the tokenizer does, letter by letter; then cases share what is kept.
    Special tokens are looked for before the tokenizer lowers a text."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """Ids of texts as the tokenizer file at `path` gives them, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case words of letters the tokenizer's own normalising and splitting change nothing, and its signs for
        # bytes are put in beforehand.
        plain = json.loads(self.tokenizer.to_str())
        self.plain = Tokenizer.from_str(json.dumps({**plain, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.characters = 0

    def _letters(self, words: list[str]) -> list[bytes] | None:
        """Ids of lower-case words of letters, which end in an id of the word end: many take one call."""
        joined = [" ".join(words[start : start + JOINED]) for start in range(0, len(words), JOINED)]
        joined = [j if j.isascii() else j.encode().decode("latin-1").translate(_SIGNS) for j in joined]
        found = [np.array(f.ids, "<u2") for f in self.plain.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.empty(0, "<u2")
        stops = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            return None
        whole = ids.tobytes()
        return [whole[start:stop] for start, stop in zip([0, *stops], stops)]

    def _learn(self, words: set[str]) -> None:
        """Put these words into `young`; those not seen yet are encoded, letters apart from a tail of punctuation."""
        young, recall = self.young, self.old.get
        letters: list[str] = []
        others: list[str] = []
        tailed: list[tuple[str, str]] = []
        for word in words:
            if (known := recall(word)) is not None:
                young[word] = known
                continue
            body = word.rstrip(_TAIL)
            if not body.isalpha() or not (body.islower() and (body.isascii() or max(body) < "ɐ")):
                others.append(word)
            elif len(body) == len(word):
                letters.append(word)
            else:
                tailed.append((word, body))
        if tailed:
            parts = {body for _, body in tailed}.difference(letters)
            parts.update([word[len(body) :] for word, body in tailed])
            # Taking all of `young` from the parts would go through it as a whole.
            for part in parts:
                if part in young:
                    continue
                if (known := recall(part)) is not None:
                    young[part] = known
                elif part.isalpha():
                    letters.append(part)
                else:
                    others.append(part)
        found = self._letters(letters)
        if found is None:
            others += letters
        else:
            young.update(zip(letters, found))
        for piece, ids in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            young[piece] = np.array(ids.ids, "<u2").tobytes()
        for word, body in tailed:
            young[word] = young[body] + young[word[len(body) :]]
        self.characters += sum(map(len, words))

    def _forget(self, words: set[str]) -> None:
        """Very long stretches are not kept."""
        for word in words:
            if len(word) > LONGEST and self.young.pop(word, None) is not None:
                self.young.pop(word.rstrip(_TAIL), None)
                self.characters -= len(word)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as 16-bit numbers; a null text has none. Many short texts at a time are faster."""
        lowered = [_SIGN.sub(r" \g<0>", _lowered(t).replace("\n", " ")) if t else "" for t in texts]
        split = pc.split_pattern(pa.array(lowered, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        if self.characters > KEPT:
            self.old, self.young, self.characters = self.young, {"": b""}, 0
        missing = set(distinct).difference(self.young)
        self._learn(missing)
        found = list(map(self.young.__getitem__, distinct))
        self._forget(missing)
        # Each word's ids are taken from those of the distinct words.
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        starts, which = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        size = sizes.take(which)
        ends = np.append(0, np.cumsum(size))
        ids = np.frombuffer(b"".join(found), "<u2").take(np.arange(ends[-1]) + np.repeat(starts.take(which) - ends[:-1], size))
        cuts = ends.take(split.offsets.to_numpy()).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    state = sys.modules.setdefault(_STATE, types.ModuleType(_STATE))
    kept = state.__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
