"""Token counts by a linear longest-match automaton: word-piece lengths without the pieces.

A trie over the vocabulary gets failure links and, for each link, the number of pieces that following it pops. A word is read
once, left to right; each character either descends in the trie or follows links, and the popped counts add up to what greedy
longest-match cutting would give. No substring is built and no position is read twice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, map_batches

NONE = -1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that may begin a word and pieces that may follow; `prefix` is put before each word first."""

    initial: tuple[str, ...]
    following: tuple[str, ...]
    prefix: str = ""


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """The pieces of a SentencePiece model; its word mark begins words only. Control, unknown and byte pieces stay out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Vocabulary(tuple(pieces), tuple(p for p in pieces if not p.startswith("▁")), "▁")


class Automaton:
    """Nodes are numbers: 0 the root of initial pieces, 1 the root of following pieces.

    `link[v]` is the node that spells what is left of v's string after popping its longest first pieces, `pops[v]` their number;
    a link of NONE means that v's string can't be cut.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.prefix = vocabulary.prefix
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, vocabulary.initial), (1, vocabulary.following)):
            for piece in pieces:
                if not piece:
                    continue
                v = root
                for ch in piece:
                    w = self.next[v].get(ch)
                    if w is None:
                        w = self.next[v][ch] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    v = w
                final[v] = True
        self.link = [NONE] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            v = queue.popleft()
            for ch, w in self.next[v].items():
                if final[w]:
                    self.link[w], self.pops[w] = 1, 1
                else:
                    at, popped = self.link[v], self.pops[v]
                    while at != NONE and ch not in self.next[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at != NONE:
                        self.link[w], self.pops[w] = self.next[at][ch], popped
                queue.append(w)

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match cutting; 0 if the word can't be cut."""
        step, link, pops = self.next, self.link, self.pops
        v, n = 0, 0
        for ch in self.prefix + word:
            w = step[v].get(ch)
            while w is None:
                n += pops[v]
                v = link[v]
                if v == NONE:
                    return 0
                w = step[v].get(ch)
            v = w
        while v != 1:
            n += pops[v]
            v = link[v]
            if v == NONE:
                return 0
        return n


class Counts(dict):
    """Counts of the words met so far; starts anew at `most` words, so memory is bounded."""

    def __init__(self, automaton: Automaton, most: int = 500_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.automaton.count(word.decode())
        return n


_built: dict[int, tuple[Vocabulary, Automaton]] = {}


def automaton_of(vocabulary: Vocabulary) -> Automaton:
    """One automaton for each Python process and vocabulary."""
    key = hash(vocabulary)
    if key not in _built or _built[key][0] != vocabulary:
        _built.clear()
        _built[key] = (vocabulary, Automaton(vocabulary))
    return _built[key][1]


def token_counts(docs: DataFrame, vocabulary: Vocabulary, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """n_words, n_tokens and n_unknown of every whole text, for each row of docs (columns `keep` and text).

    Words are runs between ASCII white space. A word that can't be cut counts as one unknown token, in n_tokens and in
    n_unknown. Null and empty texts give zeros; repeated rows give repeated results. One pass, no shuffle; the vocabulary
    is sent to the tasks (its size is that of the vocabulary file and doesn't grow with the data).
    """
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(automaton_of(sent.value))
        for batch in batches(parts, "text"):
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                found = list(map(counts.__getitem__, words))
                zeros = found.count(0)
                n_words.append(len(found))
                n_tokens.append(sum(found) + zeros)
                n_unknown.append(zeros)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=[*keep, "n_words", "n_tokens", "n_unknown"])

    picked = docs.select(*dict.fromkeys([*keep, "text"]))
    kept = "".join(f"`{c}` {picked.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(picked, run, f"{kept}n_words long, n_tokens long, n_unknown long")
