"""Token ids of whole texts: words are cut and numbered by Arrow, and each distinct word is encoded once for each Python process."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of Latin-1 letters alone, whose lower case every Unicode version agrees on; and such words, up to an ASCII letter, with punctuation at their end, which is a word of
#: its own: letters and punctuation are never in one pre-token, and white space is dropped. Without the apostrophe, which begins contractions, and the characters of
#: special tokens. All other words are encoded as they stand.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = f"^[{LETTERS}]+$"
ENDED = rf"^(?P<stem>[{LETTERS}]*[A-Za-z])(?P<end>[!-&(-/:;=?@\[-`{{}}~]+)$"
#: Arrow cuts at these four separators too, which regular expressions, and so tokenizers, don't call white space; of all other characters both say the same.
SEPARATORS = "[\x1c-\x1f]"
SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


#: Without the space, which parts words.
BYTE_CHARACTERS = {b: c for b, c in _byte_characters().items() if b != 0x20}


class WordStore:
    """Packed ids of the words met so far, as sorted arrays: some 30 bytes a word. Words are found by a 64-bit hash and compared byte by byte, so what is found is right;
    a word whose hash another one has is never kept. At `most` words the store starts anew, which bounds memory."""

    def __init__(self, dtype: np.dtype, most: int = 1_200_000):
        self.dtype, self.most = dtype, most
        # a random number for each byte value and place, which a word's hash adds up
        self.table = np.random.default_rng(3).integers(0, 2**64, (64, 256), np.uint64)
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.starts, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.id_starts, self.id_sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.bytes, self.ids = np.empty(0, np.uint8), np.empty(0, self.dtype)

    @staticmethod
    def _raw(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
        data = words.buffers()[2]
        return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends[:-1], np.diff(ends)

    def _spread(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each byte of the words, its place in its word, and where words begin among these bytes."""
        ends = np.cumsum(sizes)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return np.repeat(starts, sizes) + inner, inner, ends - sizes

    def _hash(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        at, inner, first = self._spread(starts, sizes)
        values = np.append(self.table[inner & 63, data[at]], np.uint64(0))
        return np.where(sizes > 0, np.add.reduceat(values, first), np.uint64(0)) if len(sizes) else np.empty(0, np.uint64)

    def find(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words in the store, -1 for others; and the words' hashes."""
        data, starts, sizes = self._raw(words)
        hashes = self._hash(data, starts, sizes)
        if not len(self.hashes):
            return np.full(len(words), -1), hashes
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.hashes[at] == hashes) & (self.sizes[at] == sizes)
        rows = np.flatnonzero(same & (sizes > 0))
        here, inner, first = self._spread(starts[rows], sizes[rows])
        if len(rows):
            there = np.repeat(self.starts[at[rows]], sizes[rows]) + inner
            same[rows] = np.logical_and.reduceat(data[here] == self.bytes[there], first)
        return np.where(same, at, -1), hashes

    def add(self, words: pa.StringArray, hashes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        """Words that the store doesn't hold, each once, with their ids one after another."""
        if len(self.hashes) + len(words) > self.most:
            self._reset()
        data, starts, sizes = self._raw(words)
        at, _, first = self._spread(starts, sizes)
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        order = order[np.append(True, both[order[1:]] != both[order[:-1]])]
        joined = lambda a, b: np.concatenate([a, b])[order]
        self.hashes, self.starts, self.sizes = both[order], joined(self.starts, len(self.bytes) + first), joined(self.sizes, sizes)
        self.id_starts, self.id_sizes = joined(self.id_starts, len(self.ids) + np.cumsum(id_sizes) - id_sizes), joined(self.id_sizes, id_sizes)
        self.bytes, self.ids = np.concatenate([self.bytes, data[at]]), np.concatenate([self.ids, ids])


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space and lower-cases.

    Such a tokenizer's ids of a text are those of its white-space-separated words in turn, so a word is encoded once and its packed ids are kept (see WordStore).
    """

    def __init__(self, tokenizer_json: str, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.store = WordStore(self.dtype, most)
        self.bare = self._bare(tokenizer_json)

    def _bare(self, tokenizer_json: str):
        """The merges alone, for words that are one run of lower-case Latin letters: normalizing and cutting change nothing in those but their spelling in
        byte characters. It cuts at white space, so that many words go through it as one text. None if the tokenizer is built in another way, or a probe shows a difference."""
        from tokenizers import Tokenizer

        parts = json.loads(tokenizer_json)
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if parts.get("model", {}).get("type") != "BPE" or steps[-1].get("type") != "ByteLevel" or steps[-1].get("add_prefix_space"):
            return None
        self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
        if len(self.bare.encode("!", add_special_tokens=False).ids) != 1:
            return None
        probe = ["the", "a", "Straße", "élève", "mañana", "thereafter", "ñÿþæ", "ZzzzQx"]
        same = all(np.array_equal(x, y) for x, y in zip(self._merged(probe), self._packed(probe), strict=True))
        return self.bare if same else None

    def _packed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((i for ids in found for i in ids), self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def _merged(self, words: list[str], together: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, as many as `together` in one text with a mark after each, whose id no such word has."""
        texts = [" ! ".join([*words[i : i + together], ""]).lower() for i in range(0, len(words), together)]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(BYTE_CHARACTERS) for t in texts]
        (mark,) = self.bare.encode("!", add_special_tokens=False).ids
        ids = np.concatenate([np.empty(0, self.dtype), *(np.array(e.ids, self.dtype) for e in self.bare.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(ids == mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the last one's end). Null texts have none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
            cut = pa.array([SPACE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            cut = pc.utf8_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        if not len(words):
            return np.empty(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        table, starts, sizes = self._ids_of(words.dictionary)
        number = words.indices.to_numpy()
        of_word = sizes[number]
        ends = np.cumsum(of_word)
        # each id's place among the distinct words' ids
        ids = table[np.repeat(starts[number] - (ends - of_word), of_word) + np.arange(ends[-1])]
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def _ids_of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: a table, and each word's first place and number of places there."""
        at, hashes = self.store.find(words)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.store.ids, self.store.id_starts[at], self.store.id_sizes[at]
        some = words.take(pa.array(new))
        ids, own = self._encode(some)
        table = np.concatenate([self.store.ids, ids])
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        held = at >= 0
        starts[held], sizes[held] = self.store.id_starts[at[held]], self.store.id_sizes[at[held]]
        starts[new], sizes[new] = len(self.store.ids) + np.cumsum(own) - own, own
        self.store.add(some, hashes[new], ids, own)
        return table, starts, sizes

    def _encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has."""
        kind = np.zeros(len(words), np.int8)  # 1 plain, 2 plain with an end
        stem = end = pa.array([], pa.string())
        if self.bare:
            kind[pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)] = 1
            found = pc.extract_regex(words, ENDED)
            ended = found.is_valid().to_numpy(zero_copy_only=False)
            kind[ended] = 2
            found = found.filter(pa.array(ended))
            stem, end = found.field("stem"), found.field("end")
        take = lambda k: words.filter(pa.array(kind == k))
        plain = pa.concat_arrays([take(1), stem]).dictionary_encode()
        other = pa.concat_arrays([take(0), end]).dictionary_encode()
        parts = [self._merged(plain.dictionary.to_pylist()) if len(plain) else (np.empty(0, self.dtype), np.empty(0, np.int64)), self._packed(other.dictionary.to_pylist())]
        ids, sizes = np.concatenate([x for x, _ in parts]), np.concatenate([*(n for _, n in parts), [0]])
        # each word is one piece or two; the last piece is empty
        pieces = np.full((len(words), 2), len(sizes) - 1)
        of_plain, of_other = plain.indices.to_numpy(), other.indices.to_numpy() + len(parts[0][1])
        n1, n0 = int((kind == 1).sum()), int((kind == 0).sum())
        pieces[kind == 1, 0], pieces[kind == 2, 0] = of_plain[:n1], of_plain[n1:]
        pieces[kind == 0, 0], pieces[kind == 2, 1] = of_other[:n0], of_other[n0:]
        each = sizes[pieces].ravel()
        ends = np.cumsum(each)
        place = np.repeat((np.cumsum(sizes) - sizes)[pieces.ravel()] - (ends - each), each) + np.arange(ends[-1])
        return ids[place], sizes[pieces].sum(axis=1)


def read_tokenizer(path: str) -> str:
    """A tokenizer file's text, read by the driver and sent to the tasks (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_encoders: dict[int, tuple[str, WordEncoder]] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """One encoder for each Python process; workers are reused, and so are the words that they know."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hash(tokenizer_json)
    if key not in _encoders or _encoders[key][0] != tokenizer_json:
        _encoders.clear()
        _encoders[key] = (tokenizer_json, WordEncoder(tokenizer_json))
    return _encoders[key][1]
