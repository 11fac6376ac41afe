"""Token ids by public tokenizers, with the ids of known stretches of text kept in each Python worker.

A text is cut where the tokenizer cuts it anyway, at blanks, line ends, and before marks such as a comma behind a word, and each
different stretch of a batch goes to the library once. Stretches not known yet are put together to longer texts for that, since a call costs more than a
short text, and the ids are cut again where the stretches end. Other texts go to the library as they are.

Where blanks belong to the tokens the cuts are found in the bytes of many texts at once, and Arrow tells their different stretches.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Most stretches whose ids a worker keeps; more are encoded each time they occur in a batch.
KNOWN = 500_000
#: Bytes of text whose different stretches are looked for together.
TOGETHER_BYTES = 2 << 20
#: Stretches that are put together.
TOGETHER = 200
#: Separates stretches where words are encoded without the blanks around them.
MARK = "\x02"

#: Marks that no word goes on with where blanks belong to the tokens.
MARKS = ".,;:!?\"#$%&()*+/<=>@[\\]^_`{|}~"
#: Of each byte, whether it is a blank or line end, a mark that may end a word, a letter or digit of one byte.
BLANK, ENDS, LETTER = (np.isin(np.arange(256), list(held.encode())) for held in (" \n", MARKS, string.ascii_letters + string.digits))


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each stretch of the texts that lie one behind another in ``data``, as ``Encoder.stretch`` cuts them."""
    blank, letter = BLANK[data], LETTER[data]
    lead = np.flatnonzero(data == 0xC3)  # À to ÿ but for × and ÷
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    # a mark right behind letters, with a blank or the start of the text right before these
    other = np.flatnonzero(~letter)
    before = np.append(-1, other)[:-1]
    cut = ENDS[data[other]] & (other - before > 1)
    other, before = other[cut], before[cut]
    first = firsts[np.searchsorted(firsts, other, "right") - 1]
    start[other[(other > first) & ((before < first) | blank[before])]] = True
    start[firsts] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        # Spark runs one task per core; the library's own threads would only compete with it
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        model = json.loads(self.library.to_str())
        self.by_words = bool(model["model"].get("end_of_word_suffix"))
        # letters and digits end where a mark that no word goes on with stands behind them
        # letters are not given back, so no word is read twice
        self.stretch = re.compile(rf"[ \n]*+(?:[A-Za-z0-9À-ÖØ-öø-ÿ]++(?:(?=[{re.escape(MARKS)}])|[^ \n]*+)|[^ \n]++)|[ \n]++")
        self.word = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ]+(?=[.,;:!?]|\s|\Z)|\S+")
        #: What a text that is not cut has in it.
        blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
        self.odd = [MARK, *"\x1c\x1d\x1e\x1f", "<|"] if self.by_words else [c for c in blanks if c not in " \n"]
        self.odd_bytes = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in blanks if c not in " \n") + "]"
        if self.by_words:
            self.mark = self._ids([MARK])[0]
            self.lowers = '"Lowercase"' in json.dumps(model["normalizer"])
        else:
            # a token has a character for each byte it stands for
            vocabulary = self.library.get_vocab()
            self.bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            self.bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        """Words of a text; where they are encoded in small letters anyway, those of plain texts are made so."""
        return self.word.findall(text.lower() if self.lowers and text.isascii() else text)

    def _together(self, stretches: list[str]) -> list[list[str]]:
        """Groups of stretches that can be encoded as one text."""
        groups: list[list[str]] = []
        for stretch in stretches:
            alone = not self.by_words and (stretch[0] not in " \n" or not groups or groups[-1][-1].isspace())
            if alone or not groups or len(groups[-1]) == TOGETHER:
                groups.append([])
            groups[-1].append(stretch)
        return groups

    def _learn(self, stretches: list[str]) -> dict[str, bytes]:
        groups, found = self._together(stretches), {}
        between = f" {MARK} " if self.by_words else ""
        for group, ids in zip(groups, self._ids([between.join(g) for g in groups])):
            values = np.array(ids, dtype="<u4")
            if self.by_words:
                ends = np.append(np.flatnonzero(values == self.mark[0]), len(values))
                starts = np.append(0, ends[:-1] + 1)
            else:
                ends = np.searchsorted(np.cumsum(self.bytes[values]), np.cumsum([len(s.encode()) for s in group])) + 1
                starts = np.append(0, ends[:-1])
            content = values.tobytes()
            for stretch, a, b in zip(group, (4 * starts).tolist(), (4 * ends).tolist()):
                found[stretch] = content[a:b]
        return found

    def _of_bytes(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """What ``encode`` gives, from the bytes of all texts together."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd_bytes)
        whole = self._ids(texts.filter(odd).to_pylist())
        if whole:
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = _starts(data, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        stretches = pa.LargeStringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        different = stretches.dictionary.to_pylist()
        found = list(map(self.known.get, different))
        if None in found:
            missing = list(compress(different, map(is_, found, repeat(None))))
            new = self._learn(missing)
            if len(self.known) < KNOWN:
                self.known.update(new)
            found = [new[s] if x is None else x for s, x in zip(different, found)]
        ids = pa.array(found, pa.large_binary()).take(stretches.indices)
        content = (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        places = np.frombuffer(ids.buffers()[1], dtype=np.int64)[np.searchsorted(starts, offsets)].tolist()
        result = [content[a:b] + end for a, b in zip(places, places[1:])]
        for i, values in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist(), whole):
            result[i] = array("I", values).tobytes() + end
        return result

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text and the end id, as little-endian unsigned 32-bit numbers."""
        end = array("I", [end_id]).tobytes()
        if not self.by_words:
            return self._of_bytes(pa.array(texts, pa.large_string()), end)
        if isinstance(texts, pa.Array):
            texts = [x or "" for x in texts.to_pylist()]
        plain = [i for i, text in enumerate(texts) if any(c in text for c in self.odd)]
        whole = dict(zip(plain, self._ids([texts[i] for i in plain])))
        cut = [None if i in whole else self._cut(text) for i, text in enumerate(texts)]
        ids = [list(map(self.known.get, stretches or ())) for stretches in cut]
        missing: dict[str, None] = {}
        for stretches, found in zip(cut, ids):
            if None in found:
                missing.update(zip(compress(stretches, map(is_, found, repeat(None))), repeat(None)))
        new = self._learn(list(missing))
        if len(self.known) < KNOWN:
            self.known.update(new)
        for i, (stretches, found) in enumerate(zip(cut, ids)):
            if stretches is None:
                ids[i] = [array("I", whole[i]).tobytes()]
            elif None in found:
                ids[i] = [new[s] if x is None else x for s, x in zip(stretches, found)]
        return [b"".join(found) + end for found in ids]


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


def encoded(encoder: Encoder, texts: list[str] | pa.Array, end_id: int) -> list[bytes]:
    return encoder.encode(texts, end_id)
