"""Exact token ids by the tokenizers library, one call for each distinct pre-token.

A text is cut at single spaces between other characters, where neither a pre-token nor a merge can
cross, so the ids of the text are those of its words in turn.  Words are made distinct by Arrow; ids of
words met before come from a table, and a new word is put together from its pre-tokens.  New pre-tokens
go to the library's model many at a time.  Words with characters beyond the Latin blocks, or with white
space or control characters in them, go through the whole tokenizer instead, and so do whole texts that hold an
added token's literal.  A file whose normaliser or pre-tokeniser is not the one known here is encoded by the library throughout.

A key is the word itself, or, for the byte-level tokenizer, ``(text,)`` where no space stands before it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _text as X

#: Words kept by one worker (about 30 bytes each); the table starts anew beyond it.
MOST_KEYS = 1_500_000
#: Bytes of text encoded at once, and ids gathered at once.
TEXT_BYTES, GATHER = 6 << 20, 1 << 20
_DOUBLE = r"\s\s|^\s|\s$|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: Words that may be cut here: Latin blocks without control characters and white space.
_EASY = re.compile(r"[!-~¡-¬®-ɏ]+")
_SPLIT, _END = "\x01", "Ċ"


def _byte_table() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``byte_level``: a word carries the space before it; otherwise case and white space make no difference."""

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        self.literals = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known = self._is_known()
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" if byte_level else r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
        self.cut = regex.compile(pattern).findall
        self.table = _byte_table()
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_SPLIT)
        (self.end,) = self.merger.encode(_END, add_special_tokens=False).ids
        self._reset()

    def _is_known(self) -> bool:
        """Does the tokenizer split and normalise as the short way does?  Told by texts that hold every kind of cut."""
        pre = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])]
        probe = self.tokenizer.pre_tokenizer
        if probe is None or (self.byte_level and kinds[-1:] != ["ByteLevel"]):
            return False
        if self.byte_level:
            want = ["We", "'re", "Ġx", "123", "Ġ45", "!?", "Ġ", "Ġa", "."]
            return [p for p, _ in probe.pre_tokenize_str("We're x123 45!?  a.")] == want and self.tokenizer.normalizer is None
        got = [p.replace("</w>", "") for p, _ in probe.pre_tokenize_str("we're x12 !? a.")]
        norm = self.tokenizer.normalizer
        return got == ["we", "'re", "x", "1", "2", "!?", "a", "."] and norm is not None and norm.normalize_str("Ab  C") == "ab c"

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids by the library alone."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])

    def _reset(self) -> None:
        self.hash = np.zeros(0, np.uint64)  # sorted; ``check`` and ``entry`` go with it
        self.check = np.zeros(0, np.uint32)
        self.entry = np.zeros(0, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.count = 0
        self.pool = np.zeros(1 << 18, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0

    @staticmethod
    def _hashes(words: pa.Array, head: bool) -> tuple[np.ndarray, np.ndarray]:
        return X.hash_strings(words, 11 + head), (X.hash_strings(words, 13 + head) >> np.uint64(32)).astype(np.uint32)

    def _find(self, words: pa.Array, head: bool) -> np.ndarray:
        """The entries of words, -1 for those not known; head: no space stands before them."""
        h, c = self._hashes(words, head)
        at = X.member(h, self.hash)
        hit = at >= 0
        hit[hit] = self.check[at[hit]] == c[hit]
        out = np.full(len(h), -1, np.int64)
        out[hit] = self.entry[at[hit]]
        return out

    def _add(self, words: pa.Array, head: bool, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(words), len(ids)
        while self.count + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = ids
        self.start[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.length[self.count : self.count + n] = sizes
        h, c = self._hashes(words, head)
        order = np.argsort(h)
        spot = np.searchsorted(self.hash, h[order])
        self.hash = np.insert(self.hash, spot, h[order])
        self.check = np.insert(self.check, spot, c[order])
        self.entry = np.insert(self.entry, spot, (self.count + order).astype(np.int32))
        self.count += n
        self.used += total

    def _add_pretokens(self, words: list[str], head: bool) -> None:
        """Merge pre-tokens: joined by a mark and an end, so one call gives all ids and where each one's stop."""
        lead = "Ġ" if self.byte_level and not head else ""
        join, table = f"{_SPLIT}{_END}{_SPLIT}{lead}".join, self.table
        mapped = [w if w.isascii() else w.encode().decode("latin-1").translate(table) for w in words]
        chunks = [lead + join(mapped[i : i + 2000]) + _SPLIT + _END for i in range(0, len(mapped), 2000)]
        ids = []
        for i in range(0, len(chunks), 16):
            ids += [np.array(e.ids, np.uint32) for e in self.merger.encode_batch_fast(chunks[i : i + 16], add_special_tokens=False)]
        flat = np.concatenate(ids)
        ends = np.flatnonzero(flat == self.end)
        self._add(pa.array(words, pa.string()), head, flat[flat != self.end], np.diff(np.concatenate([[-1], ends])) - 1)

    def _parts(self, word: str, head: bool) -> list[str]:
        """A word's pre-tokens; only the first of a byte-level word has the space before it, which is left out here."""
        if not self.byte_level:
            text = word.lower() if word.isascii() else self.tokenizer.normalizer.normalize_str(word)
            return [text] if text.isalpha() else self.cut(text)
        if head:
            return self.cut(word)
        if word[:-1].isalpha() and not word[-1].isalnum():
            return [word[:-1], word[-1]]
        first, *rest = self.cut(" " + word)
        return [first[1:], *rest]

    def _learn(self, words: list[str], head: bool) -> None:
        easy, plain = _EASY.fullmatch, self.byte_level
        single: dict[str, None] = {}
        joined: list[str] = []
        parts: list[list[str]] = []
        hard: list[str] = []
        for word in words:
            if not easy(word):
                hard.append(word)
            elif word.isalpha() and (plain or word.islower() and word.isascii()):
                single[word] = None
            else:
                cut = self._parts(word, head)
                if len(cut) == 1 and cut[0] == word:
                    single[word] = None
                else:
                    joined.append(word)
                    parts.append(cut)
        if joined:  # byte-level: a first part may have the space before it, the others have none
            firsts = pa.array([p[0] for p in parts], pa.string())
            rests = pa.array([q for p in parts for q in p[1:]], pa.string())
            for some, kind in ((firsts, head), (rests, head or plain)):
                some = some.unique()
                fresh = some.filter(pa.array(self._find(some, kind) < 0)).to_pylist()
                if kind == head:
                    single.update(dict.fromkeys(fresh))
                elif fresh:
                    self._add_pretokens(fresh, kind)
        if single:
            self._add_pretokens(list(single), head)
        if joined:
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            begin = np.cumsum(n) - n
            flat = np.empty(n.sum(), np.int64)
            flat[begin] = self._find(firsts, head)
            rest = np.ones(len(flat), bool)
            rest[begin] = False
            flat[rest] = self._find(rests, head or plain)
            sizes = self.length[flat].astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            first = np.append(begin, len(flat))
            self._add(pa.array(joined, pa.string()), head, self.pool[X.expand(self.start[flat], sizes)], np.diff(edge[first]))
        if hard:
            texts = [" " + w for w in hard] if plain and not head else hard
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._add(pa.array(hard, pa.string()), head, np.array([i for ids in got for i in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _entries(self, words: pa.Array, head: bool) -> np.ndarray:
        """The entries of distinct words, which are learnt where they are new."""
        found = self._find(words, head)
        fresh = found < 0
        if fresh.any():
            self._learn(words.filter(pa.array(fresh)).to_pylist(), head)
            found = self._find(words, head)
        return found

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin; a null text is an empty one."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.known:
            return self._whole(texts.to_pylist())
        special = np.zeros(len(texts), bool)
        for literal in self.literals:
            special |= pc.match_substring(texts, literal, ignore_case=True).to_numpy(zero_copy_only=False)
        if special.any():
            return self._mixed(texts, np.flatnonzero(special), self._whole)
        if self.count > MOST_KEYS:
            self._reset()
        if self.byte_level:
            odd = np.flatnonzero(pc.match_substring_regex(texts, _DOUBLE).to_numpy(zero_copy_only=False))
            if len(odd):  # white space that is not a single space between characters
                return self._mixed(texts, odd, self._odd)
        words = pc.split_pattern(texts, " ")
        first = words.offsets.to_numpy().astype(np.int64)
        first, flat = first - first[0], words.flatten()
        coded = flat.dictionary_encode()
        at = coded.indices.to_numpy()
        if self.byte_level:
            heads = flat.take(pa.array(first[:-1])).dictionary_encode()
            lead = self._entries(heads.dictionary, True)[heads.indices.to_numpy()]
        place = self._entries(coded.dictionary, False)[at]
        if self.byte_level:
            place[first[:-1]] = lead
        sizes = self.length[place]
        edge = np.zeros(len(place) + 1, np.int64)
        np.cumsum(sizes, out=edge[1:])
        out = np.empty(edge[-1], self.pool.dtype)
        for i in range(0, len(place), GATHER // 4):
            p = place[i : i + GATHER // 4]
            out[edge[i] : edge[min(i + GATHER // 4, len(place))]] = self.pool[X.expand(self.start[p], sizes[i : i + GATHER // 4].astype(np.int64))]
        return out, edge[first]

    def _mixed(self, texts: pa.Array, odd: np.ndarray, apart) -> tuple[np.ndarray, np.ndarray]:
        """Encode the few texts that need it apart, and put all in order."""
        plain = np.setdiff1d(np.arange(len(texts)), odd)
        parts = [self.encode(texts.take(pa.array(plain, pa.int64()))), apart([texts[i].as_py() for i in odd.tolist()])]
        n = np.zeros(len(texts), np.int64)
        src = np.zeros(len(texts), np.int64)
        shift = 0
        for rows, (ids, edge) in zip((plain, odd), parts, strict=True):
            n[rows], src[rows] = np.diff(edge), edge[:-1] + shift
            shift += len(ids)
        ids = np.concatenate([p[0] for p in parts])
        edge = np.concatenate([[0], np.cumsum(n)])
        return ids[X.expand(src, n)], edge

    def _odd(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [_SINGLE.split(t) for t in texts]
        place = []
        for some, head in (([w[0] for w in lists], True), ([x for w in lists for x in w[1:]], False)):
            coded = pa.array(some, pa.string()).dictionary_encode()
            place.append(self._entries(coded.dictionary, head)[coded.indices.to_numpy()])
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        begin = np.cumsum(n) - n
        flat = np.empty(n.sum(), np.int64)
        rest = np.ones(len(flat), bool)
        rest[begin] = False
        flat[begin], flat[rest] = place
        sizes = self.length[flat].astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[X.expand(self.start[flat], sizes)], edge[np.append(begin, len(flat))]


@lru_cache(maxsize=2)
def encoder(path: str, byte_level: bool) -> Encoder:
    """One encoder for all tasks of a worker, with the words it has met."""
    return Encoder(path, byte_level)


X.keeps("encode", encoder.cache_clear)


def encoded(batches, tokens: Encoder, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batches with the ids of their texts, and where each text's begin."""
    for batch in batches:
        for part in X.slices(batch, column, TEXT_BYTES):
            yield part, *tokens.encode(part.column(column))
