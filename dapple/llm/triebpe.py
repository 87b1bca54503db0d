"""BPE by a prefix-sharing trie: the encoding of a prefix is one step on that of a shorter prefix.

In a vocabulary where each merge joins tokens of earlier merges, two tokens may stand side by side in
an encoding if the merges that made them never join across their border, and a row of tokens is the
encoding of its text if all its neighbours may. So the encoding of a prefix is fixed by its last token,
which is the one token that ends the prefix and may follow the last token of what is before it.

The distinct words of a block of texts make a trie. It is walked depth first; each node takes its last
token from the states of its ancestors, so what words have in common is worked out once, and a word's
ids are read off its path from the leaf upwards. Words met before in the same Python worker are kept
(``bytebpe.Known``), at most a million; texts are cut into words in numpy, or by the library's own
pre-tokenizer where characters, special tokens or NULs need it. Decoding joins the bytes of the ids.

Spark deals the texts out; nothing is shuffled, and what a task holds is bounded by its batches.

Defined cases: null and empty texts have no ids and decode to ''; the string of a special token in a
text is its id, as the library has it; repeated rows give repeated results; an empty table gives an
empty result; columns that are not named by the caller are not read. A tokenizer of another build
than byte-level BPE with such merges is left to the library (``Encoder.whole``).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.llm.bytebpe import Encoder, byte_letters
from dapple.llm.common import batch_rows, table, text_of
from dapple.llm.tokenbin import public_tokenizer

#: Borders between tokens that are remembered; beyond, they are worked out anew.
BORDERS = 2_000_000


@lru_cache(maxsize=1)
def letter_bytes() -> dict[int, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    hidden = {ord(letter): byte for byte, letter in byte_letters().items()} | {256: 0}
    return {b: b for b in range(256) if b not in hidden.values()} | hidden


def raw_bytes(token: str) -> bytes:
    back = letter_bytes()
    return bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode()


class Endings:
    """The tokens that end a prefix, kept up byte by byte: an automaton over the tokens with failure links."""

    def __init__(self, ids: dict[bytes, int]):
        self.child: list[dict[int, int]] = [{}]
        #: (length, id) of the tokens that end in a state, the longest first.
        self.tokens: list[tuple[tuple[int, int], ...]] = [()]
        for token, i in ids.items():
            at = 0
            for byte in token:
                to = self.child[at].get(byte)
                if to is None:
                    to = self.child[at][byte] = len(self.child)
                    self.child.append({})
                    self.tokens.append(())
                at = to
            self.tokens[at] = ((len(token), i),)
        self.fail = [0] * len(self.child)
        level = list(self.child[0].values())
        while level:
            for at in level:
                self.tokens[at] += self.tokens[self.fail[at]]
                for byte, to in self.child[at].items():
                    self.fail[to] = self.after(self.fail[at], byte)
            level = [to for at in level for to in self.child[at].values()]

    def after(self, at: int, byte: int) -> int:
        while byte not in self.child[at] and at:
            at = self.fail[at]
        return self.child[at].get(byte, 0)


class Merges:
    """Tokens of a byte-level BPE model as bytes, and which of them may be neighbours."""

    def __init__(self, model: dict):
        self.ids = {raw_bytes(t): i for t, i in model["vocab"].items()}
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        self.sound = len(self.ids) == len(model["vocab"]) and all(bytes([b]) in self.ids for b in range(256))
        for rank, merge in enumerate(model["merges"]):
            a, b = (raw_bytes(t) for t in (merge if isinstance(merge, list) else merge.split(" ")))
            left, right, both = self.ids.get(a), self.ids.get(b), self.ids.get(a + b)
            # a token of several merges, or of tokens that come later, has no fixed history
            if left is None or right is None or both is None or both in self.made or any(self.size[t] > 1 and t not in self.made for t in (left, right)):
                self.sound = False
                return
            self.rank[left, right] = rank
            self.made[both] = (rank, left, right)
        self.sound &= all(n == 1 or i in self.made for i, n in self.size.items())
        self.endings = Endings(self.ids) if self.sound else None
        self.border: dict[int, bool] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges that make a and b leave their border alone.

        Backwards in time: of the two tokens at the border the one of the later merge is taken apart. A
        merge across the border was open from the time both were there; it would have been made if it
        comes before the merge that next used one of them. Merges of equal rank go from left to right.
        """
        key = a << 32 | b
        rank, made, free = self.rank, self.made, True
        until, left_first = len(rank), False
        while True:
            across = rank.get((a, b))
            if across is not None and (across < until or across == until and left_first):
                free = False
                break
            of_a, of_b = made.get(a), made.get(b)
            if of_a is None and of_b is None:
                break
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                until, a, left_first = of_a[0], of_a[2], False
            else:
                # of two equal merges the left one was made first, so b's was the later
                until, b, left_first = of_b[0], of_b[1], True
        if len(self.border) >= BORDERS:
            self.border.clear()
        self.border[key] = free
        return free

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by one depth-first walk over the trie of all of them.

        The sorted words are the trie in depth-first order: a word's nodes are its prefixes, and those it
        shares with the word before are the ancestors that are still on the path.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        size, borders, may_follow = self.size, self.border, self.may_follow
        child, after, tokens = self.endings.child, self.endings.after, self.endings.tokens
        longest = max(map(len, words), default=0)
        last, state, before = [0] * (longest + 1), [0] * (longest + 1), b""
        out: list[list[int]] = [[]] * len(words)
        for at in order:
            word = words[at]
            depth, end = 0, min(len(before), len(word))
            while depth < end and before[depth] == word[depth]:
                depth += 1
            now = state[depth]
            for d, byte in enumerate(word[depth:], depth + 1):
                now = child[now].get(byte) or after(now, byte)
                state[d] = now
                for n, token in tokens[now]:
                    if n == d:
                        break
                    free = borders.get(last[d - n] << 32 | token)
                    if free or free is None and may_follow(last[d - n], token):
                        break
                last[d] = token
            found, d = [], len(word)
            while d:
                found.append(last[d])
                d -= size[last[d]]
            found.reverse()
            out[at] = found
            before = word
        return out


class TrieEncoder(Encoder):
    """``Encoder`` whose words are encoded by the trie. ``end_id`` stands behind each text."""

    def __init__(self, path: str, end_id: int = 0, special_as_text: bool = False):
        super().__init__(path, end_id, special_as_text)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.merges = Merges(spec["model"]) if self.by_piece and not spec["model"].get("ignore_merges") else None
        added = spec.get("added_tokens") or []
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added) and len({t["normalized"] for t in added}) < 2
        if self.merges is None or not self.merges.sound or not (plain or special_as_text):
            self.merges, self.by_piece = None, False
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.merges.encode([p.encode() for p in pieces]) if pieces else []
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def whole(self, text: str) -> bytes:
        if self.merges is None:
            return super().whole(text)
        words: list[bytes | int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                words.append(self.special_ids[part])
            elif part:
                words += [raw_bytes(w) for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(part)]
        distinct = list({w for w in words if isinstance(w, bytes)})
        ids_of = dict(zip(distinct, self.merges.encode(distinct), strict=True))
        ids = [i for w in words for i in (ids_of[w] if isinstance(w, bytes) else (w,))]
        return np.array([*ids, self.end_id], "<u4").tobytes()


@lru_cache(maxsize=1)
def trie_encoder(path: str, special_as_text: bool = False) -> TrieEncoder:
    """The encoder of this Python worker."""
    return TrieEncoder(path, special_as_text=special_as_text)


@lru_cache(maxsize=1)
def token_bytes(path: str) -> list[bytes]:
    """What each id stands for; ids without a token are nothing."""
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (1 + max(tokens.values()))
    for t, i in tokens.items():
        out[i] = raw_bytes(t)
    return out


def encode_texts(docs: DataFrame, tokenizer: str | None = None, special_as_text: bool = False) -> DataFrame:
    """doc_id, ids: the ids of every whole text as little-endian unsigned 32-bit integers."""
    path = str(tokenizer or public_tokenizer())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # without the end that the encoder sets behind each text
            ids = [x[:-4] for x in trie_encoder(path, special_as_text).encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    batch_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, text: the text that the ids of ``encode_texts`` stand for, special tokens as their strings.

    Null ids are none; bytes that are no UTF-8 become U+FFFD.
    """
    path = str(tokenizer or public_tokenizer())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for b in batches:
            texts = [b"".join([known[i] for i in np.frombuffer(x, "<u4").tolist() if i < len(known)]).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    batch_rows(encoded.sparkSession)
    rows = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(decode, "doc_id long, ids binary, text string")


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to ids and back."""
    rows = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    n = (F.octet_length("ids") / 4).cast("long")
    return rows.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
