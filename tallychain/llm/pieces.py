"""SentencePiece encoding and decoding by forward scores shared along the prefixes of sorted words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallychain.llm.common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space. No piece of the model holds a mark after another character.
MARK = "▁"
#: Encoded words that a worker keeps.
KEPT = 40_000


class Suffix(NamedTuple):
    """A suffix of a prefix that starts a piece: what follows on it, and the pieces of two or more characters that end there, each with its
    length and its known neighbours."""

    text: str
    after: dict[str, Suffix]
    pieces: list[tuple[int, str, dict[str, bool]]]


class Pieces:
    """A model's pieces, with encode() and decode() of whole texts.

    The model at hand is a byte-pair model: its scores are merge priorities, and the path of the largest sum is not its encoding. The
    forward state of a prefix is then its last piece, not its best sum: the encoding of a prefix ends in the one piece that the
    encoding of the rest accepts as its neighbour, which is when merging the two pieces' characters gives these two again. Like a best
    sum it depends on the prefix alone, so words that share a prefix share its states. For models of the unigram kind see UnigramPieces.
    """

    def __init__(self, path: str = MODEL) -> None:
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        usual = [i for i in range(len(self.names)) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {self.names[i]: i for i in usual}
        self.scores = {self.names[i]: p.get_score(i) for i in usual}
        self.numbers = {name: np.int32(i).tobytes() for name, i in self.ids.items()}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if p.is_byte(i)}
        # the bytes that each identifier stands for
        self.raw = [n.encode() for n in self.names]
        for i in range(len(self.names)):
            if p.is_control(i):
                self.raw[i] = b""
        for byte, i in self.bytes.items():
            self.raw[i] = bytes([byte])
        self.unknown = p.unk_id()
        self.prefixes = {name[:n] for name in self.ids for n in range(1, len(name) + 1)}
        self.suffixes: dict[str, Suffix] = {}
        self.accepted: dict[str, dict[str, bool]] = {}
        self.n_accepted = 0
        self.merges: dict[str, tuple[list[float], list[str], list[str], bool]] = {}
        # a marked word: marks followed by what has none; a line end is a word of its own where no piece holds one
        lines = "" if any("\n" in name for name in self.ids) else "\n"
        self.word = re.compile(f"{MARK}*[^{MARK}{lines}]+|{MARK}+|{lines or MARK}+")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merging(self, piece: str) -> tuple[list[float], list[str], list[str], bool]:
        """How a piece's characters merge alone, the best-scoring neighbours first, the leftmost of equals: the score of each merge, then
        the first and the last part before the first merge and after each, and whether they end as the whole piece."""
        if piece not in self.merges:
            parts, scores = list(piece), []
            firsts, lasts = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
                if best is None:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                scores.append(best[0])
                firsts.append(parts[0])
                lasts.append(parts[-1])
            self.merges[piece] = ([*scores, -np.inf], firsts, lasts, len(parts) == 1)
        return self.merges[piece]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether these two pieces stay neighbours when their characters are merged; without left, whether right stays whole.

        Both sides merge as they do alone until a merge across their border comes first, which then is the answer.
        """
        scores, firsts, _, whole = self.merging(right)
        if not left or not whole:
            return whole
        left_scores, _, lasts, whole = self.merging(left)
        i = j = 0
        while whole:
            ours, theirs = left_scores[i], scores[j]
            across = self.scores.get(lasts[i] + firsts[j])
            if across is not None and across > ours and across >= theirs:
                return False
            if ours == theirs == -np.inf:
                return True
            if ours >= theirs:
                i += 1
            else:
                j += 1
        return False

    def accepts(self, known: dict[str, bool], left: str, right: str) -> bool:
        """neighbours(), remembered in known, which is right's; a character without a piece never merges, whatever follows it."""
        self.n_accepted += 1
        if self.n_accepted > 5 * KEPT:
            for x in self.accepted.values():
                x.clear()
            self.n_accepted = 0
        found = known[left] = self.neighbours(left if left in self.ids else "", right)
        return found

    def suffix(self, prefix: str, char: str) -> Suffix:
        """What follows on that suffix by a character: the longest suffix that starts a piece."""
        text = prefix + char
        while text and text not in self.prefixes:
            text = text[1:]
        if text not in self.suffixes:
            ends = [text[i:] for i in range(len(text) - 1) if text[i:] in self.ids]
            self.suffixes[text] = Suffix(text, {}, [(len(x), x, self.accepted.setdefault(x, {})) for x in ends])
        return self.suffixes[text]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its identifiers as packed int32, in sorted order: a depth-first walk of the words' trie, holding one
        path of states."""
        path, last, suffixes = "", [""], [self.suffix("", "")]
        for word in sorted(words):
            same = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], suffixes[same + 1 :]
            now = suffixes[same]
            for end in range(same + 1, len(word) + 1):
                # the last piece of word[:end], given that of every shorter prefix
                char = word[end - 1]
                after = now.after.get(char)
                if after is None:
                    after = self.suffix(now.text, char)
                    if after.text:
                        now.after[char] = after
                now = after
                suffixes.append(now)
                for n, piece, known in now.pieces:
                    before = last[end - n]
                    if known[before] if before in known else self.accepts(known, before, piece):
                        last.append(piece)
                        break
                else:
                    last.append(char)
            path = word
            out, end = [], len(word)
            while end:
                piece = last[end]
                out.append(self.numbers.get(piece) or self.spelled(piece))
                end -= len(piece)
            out.reverse()
            yield word, b"".join(out)

    def spelled(self, char: str) -> bytes:
        """The bytes of a character without a piece, or the unknown piece in a model without bytes, as packed identifiers."""
        return np.array([self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Identifiers of each text; null or empty: none. Spaces turn into marks and one mark goes before a text, no other change is made.

        Words seen before are kept: the last KEPT or fewer, and of those before them what was met again.
        """
        split = [self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = {w for ws in split for w in ws}
        if len(self.words) > KEPT:
            self.older, self.words = self.words, {}
        new = distinct.difference(self.words)
        again = new.intersection(self.older)
        self.words.update((w, self.older[w]) for w in again)
        self.words.update(self.encode_words(new - again))
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, ws)), np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of identifiers: bytes are joined to characters, marks turn into spaces, and the first space goes."""
        return b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace").replace(MARK, " ").removeprefix(" ")


def best_paths(words: Iterable[str], scores: dict[str, float], unknown: float) -> Iterator[tuple[str, list[str]]]:
    """Each distinct word with its pieces of the largest sum of scores, in sorted order.

    Viterbi over the words' trie, depth first: the forward score of a prefix, the best sum of pieces that make it up, depends on the prefix alone,
    so a word takes over those of all prefixes that it shares with the word before and goes on from there. A character without a piece counts as
    unknown; of equal sums the one with the longer last piece is taken.
    """
    longest = max(map(len, scores), default=1)
    path, forward, last = "", [0.0], [0]
    for word in sorted(set(words)):
        same = 0
        for a, b in zip(path, word):
            if a != b:
                break
            same += 1
        del forward[same + 1 :], last[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            best, size = -np.inf, 1
            for n in range(min(longest, end), 0, -1):
                piece = scores.get(word[end - n : end], unknown if n == 1 else None)
                if piece is not None and forward[end - n] + piece > best:
                    best, size = forward[end - n] + piece, n
            forward.append(best)
            last.append(size)
        path = word
        out, end = [], len(word)
        while end:
            out.append(word[end - last[end] : end])
            end -= last[end]
        yield word, out[::-1]


class UnigramPieces(Pieces):
    """A model's pieces with encodings of the largest sum of scores; all else as in Pieces. A character without a piece costs PENALTY more than
    the least piece, as in the library."""

    PENALTY = 10.0

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        unknown = min(self.scores.values(), default=0.0) - self.PENALTY
        for word, parts in best_paths(words, self.scores, unknown):
            yield word, b"".join(self.numbers.get(x) or self.spelled(x) for x in parts)


@cache
def pieces(path: str = MODEL, kind: str = "bpe") -> Pieces:
    return {"bpe": Pieces, "unigram": UnigramPieces}[kind](path)


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", kind: str = "bpe") -> DataFrame:
    """(doc_id, ids: array<int>, n_tokens, lossless: whether decoding gives the text again) for each row of docs. kind is that of the model:
    bpe, whose scores are merge priorities, or unigram, whose scores are summed.

    A null text has null ids, no tokens and is lossless; an empty one has empty ids. A text that itself holds marks comes back with
    spaces in their place and is not lossless. Texts of any length are encoded whole; repeated rows give repeated results; an empty table
    gives an empty table. Only the id and the text are read.
    """
    bounded_batches(docs.sparkSession, 300)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(model, kind)
        for pdf in batches:
            texts = list(pdf["text"])
            ids = p.encode(texts)
            same = [t is None or p.decode(x.tolist()) == t for t, x in zip(texts, ids)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [None if t is None else x for t, x in zip(texts, ids)], "n_tokens": [len(x) for x in ids], "lossless": same})

    return own.mapInPandas(run, f"doc_id {id_kind}, ids array<int>, n_tokens long, lossless boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        p = pieces(model)
        return pd.Series([None if x is None else p.decode(x.tolist()) for x in ids], dtype=object)

    return encoded.select(F.col(id_col).alias("doc_id"), text(F.col(ids_col)).alias("text"))
