"""Tokenizing with a public vocabulary file, one call of the tokenizer per new chunk."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Kinds of bytes: white space, ASCII letters and digits, ASCII signs, all others.
_SPACE, _WORD, _SIGN, _OTHER = range(4)
_WHITE = b"\x20\x09\x0A\x0B\x0C\x0D"
_KIND = bytes(_SPACE if k in _WHITE else _OTHER if k < 33 or k > 126 else _WORD if chr(k).isalnum() else _SIGN for k in range(256))
_LOWER = bytes(range(256)).lower()
#: Letters up to U+00FF, as UTF-8 with A-Z lower-cased.
_LATIN = re.compile(rb"(?:[a-z]|\xC2[\xAA\xB5\xBA]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch
_HELD: dict[str, "ChunkTokenizer"] = {}


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes without white space and with A-Z lower-cased, where each chunk of them begins (and the last ends), and the number of chunks before each row.

    Chunks end at white space, at a row's end and between an ASCII letter or digit and an ASCII sign.
    """
    raw = data.tobytes()
    kept = raw.translate(_LOWER, _WHITE)
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    space = kind == _SPACE
    first = ~space
    first[1:] &= space[:-1] | ((kind[1:] == _SIGN) & (kind[:-1] == _WORD))
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = ~space[cuts]
    starts = np.flatnonzero(first)
    return kept, np.append(starts - np.cumsum(space, dtype=np.int32)[starts], len(kept)), np.searchsorted(starts, offsets)


class ChunkTokenizer:
    """Ids of whole texts for a tokenizer that drops white space and lower-cases.

    Such a tokenizer never joins characters across ASCII white space, nor an ASCII letter or digit
    with an ASCII sign after it, so a text's ids are those of its chunks in order. Chunks' ids are
    kept: once there are over half of ``most``, they become the older half, of which only what is
    met again is kept further (this bounds memory and changes no result). A text with ``<|`` in it
    may hold a special token's string, which is matched before lower-casing; it is encoded whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.most, self.ids, self.older = Tokenizer.from_file(path), most, {}, {}
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the characters that the model writes for bytes of letters up to U+00FF
        self.written = np.arange(256, dtype="<u4")
        self.written[0x80:0xC0] = [ord(level.pre_tokenize_str(chr(k))[0][0][1]) for k in range(0x80, 0xC0)]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _plain(self, text: bytes) -> str:
        """Chunks of letters up to U+00FF, as the model writes them; they are their own NFC."""
        data = np.frombuffer(text, np.uint8).copy()
        data[1:] += ((data[:-1] == 0xC3) & (data[1:] <= 0x9E)).astype(np.uint8) << 5
        return self.written[data].tobytes().decode("utf-32-le")

    def _joint(self, chunks: list[bytes], tokenizer, text_of) -> list[bytes]:
        """Encodes chunks of one pre-token each many at a time; returns those that this can't tell apart.

        The ids of a pre-token end with the only one that ends a word.
        """
        left = []
        for i in range(0, len(chunks), 512):
            part = chunks[i : i + 512]
            ids = np.array(tokenizer.encode_batch_fast([text_of(b" ".join(part))], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.ids.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:
                left += part
        return left

    def _learn(self, chunks: list[bytes]) -> None:
        """Ids of chunks, by the plainest way that is exact for each kind.

        Letters are one pre-token. Up to U+00FF the model alone gives the ids; other letters need
        the normaliser. The rest go through the whole tokenizer one by one.
        """
        plain, letters, rest = [], [], []
        for c in chunks:
            (plain if _LATIN(c) else letters if c.decode("utf-8", "replace").isalpha() else rest).append(c)
        rest += self._joint(plain, self.bare, self._plain)
        rest += self._joint(letters, self.tokenizer, bytes.decode)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)):
                self.ids[c] = np.array(e.ids, "<u4").tobytes()

    def _known(self, chunks: list[bytes]) -> list[bytes]:
        if 2 * len(self.ids) > self.most:
            self.ids, self.older = {}, self.ids
        ids, older = self.ids, self.older
        known = list(map(ids.get, chunks))
        missing = [k for k, x in enumerate(known) if x is None]
        new = []
        for k in missing:
            c = chunks[k]
            if c in older:
                ids[c] = older[c]
            else:
                new.append(c)
        self._learn(new)
        for k in missing:
            known[k] = ids[chunks[k]]
        return known

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a UTF-8 buffer, each closed by ``end_id``, and where each row's begin.

        Equal chunks within the buffer are looked up once.
        """
        kept, begins, bounds = chunks_of(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(kept)]).dictionary_encode()
        known = self._known(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        # one further chunk a row, for the end id
        known.append(end_id.to_bytes(4, "little"))
        chunk = np.insert(chunks.indices.to_numpy(), bounds[1:], len(known) - 1)
        _, places, flat = pa.array(known, pa.large_binary()).take(pa.array(chunk)).buffers()
        at = np.frombuffer(places, np.int64)[bounds + np.arange(len(bounds))] // 4
        ids = np.frombuffer(flat, "<u4")[: at[-1]]
        marked = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else ()
        for k in np.unique(np.searchsorted(offsets, marked, side="right") - 1)[::-1].tolist() if len(marked) else ():
            whole = self.tokenizer.encode(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
            ids = np.concatenate([ids[: at[k]], np.array(whole, np.uint32), ids[at[k + 1] - 1 :]])
            at[k + 1 :] += len(whole) + 1 - (at[k + 1] - at[k])
        return ids, at


def held(path: str) -> ChunkTokenizer:
    """This Python worker's tokenizer; made once, as workers are used again."""
    if path not in _HELD:
        _HELD[path] = ChunkTokenizer(path)
    return _HELD[path]
