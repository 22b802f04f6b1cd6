"""Token ids of whole texts, with what a tokenizer gives for single words kept between texts.

Both public byte-pair vocabularies split a text before merging, and never across the places used here, so
that the ids of a text are those of its words one after another. What is kept is bounded; a word that is
not kept is encoded again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse, repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS, FIRST_WORDS = 1_200_000, 500_000
LONGEST_KEPT = 48
#: Words encoded in one text.
JOINED = 100
#: Characters of texts that are encoded together: the more, the fewer words are looked up again.
PORTION = 5_000_000
#: White space as the tokenizers' own patterns mean it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RUNS = re.compile(f"([{SPACE}]*)([^{SPACE}]*)")


def _put(array: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """array with more written from at on, longer if need be."""
    if at + len(more) > len(array):
        array = np.concatenate([array, np.zeros(max(len(array), len(more)), array.dtype)])
    array[at : at + len(more)] = more
    return array


class _Encoder:
    """coded(texts, end_id): ids of all texts, one after another, and where each text ends.

    A word that is kept has a number, counted from 0 in the order of learning; its ids are ``size`` places of
    ``pool`` from ``begin`` on. One whose ids depend on its neighbours begins nowhere.
    """

    #: A word of letters up to this one is a single piece to the vocabulary's pattern.
    PLAIN = ""
    #: A word in a text takes the space before it along.
    SPACED = False
    #: What marks a word without a space before it.
    BARE = ""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for plain words, which neither normalizer nor pattern changes.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=self.SPACED, use_regex=False)])
        #: Ids that begin a word (the vocabulary writes a space as this letter) or, without spaces, end one.
        self.seam = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.seam[k] = token.startswith("Ġ") if self.SPACED else token.endswith("</w>")
        self.beyond = re.compile(f"[^\0-{self.PLAIN}]")
        self.kept: dict[str, int] = {}
        self.begin, self.size, self.pool, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _raw(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _point(self, words: Iterable[str], begin: np.ndarray, size: np.ndarray) -> None:
        n = len(self.kept)
        self.kept.update(zip(words, range(n, n + len(size))))
        self.begin, self.size = _put(self.begin, n, begin), _put(self.size, n, size)

    def _enter(self, words: Iterable[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Keep words, which are new and distinct, by their ids one after another."""
        self._point(words, self.filled + np.cumsum(size) - size, size)
        self.pool = _put(self.pool, self.filled, ids)
        self.filled += len(ids)

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.kept.__getitem__, words), np.int64, len(words))

    def _spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of kept words, one word after another, and where each ends."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[numbers] - (ends - size), size)
        at += np.arange(len(at))
        return self.pool.take(at), ends

    def _first(self, n: int) -> None:
        """Keep the n words that came first."""
        while len(self.kept) > n:
            self.kept.popitem()
        self.filled = int((self.begin[:n] + self.size[:n]).max(initial=0))

    def _learn(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Numbers of words, which are distinct; all are kept now, and so many of them beyond this portion."""
        numbers = np.fromiter(map(self.kept.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(numbers < 0)
        if len(self.kept) + len(unknown) > KEPT_WORDS:
            # what came first is what comes often; the others make room
            self._first(FIRST_WORDS)
            unknown = np.flatnonzero((numbers < 0) | (numbers >= len(self.kept)))
        new = [words[k] for k in unknown.tolist()]
        short = new if max(map(len, new), default=0) <= LONGEST_KEPT else [w for w in new if len(w) <= LONGEST_KEPT]
        self._add(short)
        lasting = len(self.kept)
        if short is not new:
            self._add([w for w in new if len(w) > LONGEST_KEPT and w not in self.kept])
        numbers[unknown] = self._numbers(new)
        return numbers, lasting

    def _are_plain(self, words: list[str]) -> list[str]:
        """Of words of letters, those that are plain."""
        if not self.beyond.search(" ".join(words)):
            return words
        return [w for w in words if not self.beyond.search(w)]

    def _add(self, new: list[str]) -> None:
        """Keep words that are new: plain ones, plain ones before punctuation by their two parts, and others."""
        letters, others = list(filter(str.isalpha, new)), []
        plain = self._are_plain(letters)
        if len(plain) < len(letters):
            others += set(letters).difference(plain)
        parted, bodies, marks = [], [], []
        skip = len(self.BARE)
        for w in filterfalse(str.isalpha, new):
            body = w.rstrip(punctuation)
            core = body[skip:] if skip and body.startswith(self.BARE) else body
            if len(body) < len(w) and core.isalpha() and (core.isascii() or not self.beyond.search(core)):
                parted.append(w)
                bodies.append(body)
                marks.append(self.BARE + w[len(body) :])
            else:
                others.append(w)
        spelled, bodies = self._spelled(plain), self._spelled(bodies)
        self._add_plain(plain if spelled is plain else list(set(spelled).difference(self.kept)))
        need = set(bodies).difference(self.kept)
        bare = {w for w in need if w.startswith(self.BARE)} if skip else set()
        self._add_plain(list(need.difference(bare)))
        self._add_others(list(bare.union(marks, others).difference(self.kept)))
        if spelled is not plain:
            also = [(w, low) for w, low in zip(plain, spelled) if w is not low and w not in self.kept]
            same = self._numbers([low for _, low in also])
            self._point([w for w, _ in also], self.begin[same], self.size[same])
        if parted:
            ids, ends = self._spread(np.stack([self._numbers(bodies), self._numbers(marks)], 1).reshape(-1))
            self._enter(parted, ids, np.diff(ends[1::2], prepend=0))

    def _add_plain(self, words: list[str]) -> None:
        """Words that are plain, many in one text: their ids tell where one begins or ends."""
        if not words:
            return
        runs = [" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]
        found = self.plain.encode_batch_fast(runs, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.uint32)
        seams = np.flatnonzero(self.seam[ids])
        if len(seams) != len(words):
            raise ValueError("a word of the vocabulary isn't told by the space before it or by its end")
        self._enter(words, ids, np.diff(seams, append=len(ids)) if self.SPACED else np.diff(seams + 1, prepend=0))

    def _add_others(self, words: list[str]) -> None:
        found = self._raw(words)
        self._enter(words, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _coded(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of lines, whose words are between spaces, where each ends, and how many of its words begin nowhere."""
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, word = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        numbers, lasting = self._learn(words)
        ids, ends = self._spread(numbers[word])
        cuts = split.offsets.to_numpy()
        unsure = self.begin[numbers] < 0
        lost = np.diff(np.r_[0, np.cumsum(unsure[word])][cuts]) if unsure.any() else np.zeros(len(lines), np.int64)
        # words too long to keep go with their texts
        self._first(lasting)
        return ids, np.r_[0, ends][cuts[1:]], lost

    def coded(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = self._texts(texts)
        if end_id is not None:
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit bytes."""
        ids, ends = self.coded(texts)
        flat, cuts = ids.astype("<u4", copy=False).tobytes(), [0, *(4 * ends).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


class WordEncoder(_Encoder):
    """For a vocabulary that drops white space: every run of it ends a word."""

    #: Up to here a letter is composed and has its lower-case form, one letter, in this range too.
    PLAIN = "\u012f"

    def _spelled(self, words: list[str]) -> list[str]:
        return list(map(str.lower, words))

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._coded([t.replace("\n", " ") for t in texts])[:2]


class SpacedEncoder(_Encoder):
    """For a byte-level vocabulary in which a word takes the space before it along.

    Words after a space are kept as they are, those without one before them behind a NUL and SOH.
    """

    #: Up to here letters are letters to the vocabulary's pattern too.
    PLAIN = "\u052f"
    SPACED = True
    BARE = "\0\1"
    LINE = BARE + "\n"

    def __init__(self, path: str):
        super().__init__(path)
        #: The library cuts a text at these first, so white space before one isn't a word's.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        line = self._raw(["\n"])[0]
        self._enter([self.LINE], np.array(line, np.uint32), np.array([len(line)]))

    def _spelled(self, words: list[str]) -> list[str]:
        return words

    def _add_others(self, words: list[str]) -> None:
        body = [w.removeprefix(self.BARE) for w in words]
        # the white space around such a word is more than one space or line feed
        lost = [w for w, b in zip(words, body) if not b or b[0].isspace() or b[-1].isspace()]
        self._point(lost, np.full(len(lost), -1), np.zeros(len(lost), np.int64))
        words = [w for w in words if w not in self.kept] if lost else words
        found = self._raw([w[2:] if w.startswith(self.BARE) else " " + w for w in words])
        self._enter(words, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = {k for k, t in enumerate(texts) if self.BARE in t or any(a in t for a in self.added)}
        # a line feed is a word of its own, and what follows it has no space before it
        ids, ends, lost = self._coded([self.BARE + ("" if k in odd else t.replace("\n", f" {self.LINE} {self.BARE}")) for k, t in enumerate(texts)])
        again = sorted(odd.union(np.flatnonzero(lost).tolist()))
        if not again:
            return ids, ends
        size, cuts, at, parts = np.diff(ends, prepend=0), np.r_[0, ends], 0, []
        for k in again:
            own = np.array(self._raw([texts[k]])[0] if k in odd else self._runs(texts[k]), np.uint32)
            parts += [ids[cuts[at] : cuts[k]], own]
            size[k], at = len(own), k + 1
        return np.concatenate([*parts, ids[cuts[at] :]]), np.cumsum(size)

    def _runs(self, text: str) -> list[int]:
        """The same for any white space: the last space before a word goes with it, the rest stands alone."""
        pieces: list[str] = []
        for space, word in RUNS.findall(text):
            if not word:
                pieces += [space] if space else []
            elif space.endswith(" "):
                pieces += [space[:-1]] if len(space) > 1 else []
                pieces.append(" " + word)
            else:
                pieces += [space[:-1]] if len(space) > 1 else []
                pieces += [space[-1:]] if space else []
                pieces.append(word)
        return list(chain.from_iterable(self._raw(pieces))) if pieces else []


_ENCODERS: dict[tuple, _Encoder] = {}


def encoder(kind: type[_Encoder], path: str) -> _Encoder:
    """One for each worker process, which keeps it from task to task."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def portions(texts: Iterable[str | None], most: int = PORTION) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about ``most`` characters; a longer text comes alone."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
