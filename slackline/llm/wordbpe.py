"""Byte-pair encoding with word ends, counted by prefix dynamic programming.

For every prefix of a piece of text the program keeps the last token of its exact
encoding and the number of tokens. A token t can end prefix i if it is the text
from j to i and the encodings stay apart: the last token of prefix j and t don't
merge across their border. Exactly one token fits, so a prefix costs a few look-ups
and nothing is encoded again.

Two neighbours a and b stay apart unless, on the way to them, some token at the
right edge of a and some token at the left edge of b stood side by side and their
merge came before either was merged into something larger.
"""

from __future__ import annotations

import json
from contextlib import suppress
from functools import cached_property, lru_cache

import numpy as np
import regex

END = "</w>"
#: Stands for a word's end where tokens are looked for; no vocabulary spells anything with it.
_STOP = "\n"
_FOREVER = 1 << 60
#: Chunks, pieces and pairs remembered by a worker at most, each about 200 bytes: 240 MB in all; then it starts anew.
MEMORY = 400_000
#: Characters of pieces whose tokens are worked out at once.
TOGETHER = 200_000
#: Longest chunk that is remembered, in characters.
LONGEST_KEY = 40
#: Separators that every library treats as white space; others stay inside a chunk.
SEPARATORS = " \n\t\r"

_CLUSTERS = regex.compile(r"\X")
_PLAIN = regex.compile(r"[!-~¡-¬®-ÿ]+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def chunks(text: str) -> list[str]:
    """Runs between separators. No token of this kind of vocabulary spans one."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class PrefixCounter:
    """Exact token counts of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            description = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._vocabulary: dict[str, int] = description["model"]["vocab"]
        specials = [t["content"] for t in description["added_tokens"]]
        self._specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self._special_marks = {s[:2] for s in specials}
        self._letters: dict[str, str] = {}
        self._normals: dict[str, str] = {}
        self._rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(description["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = self._vocabulary[left], self._vocabulary[right], self._vocabulary[left + right]
            self._rank[a, b] = rank
            parts.setdefault(made, (a, b))
        born = {made: self._rank[pair] for made, pair in parts.items()}
        self._left = {t: self._edge(t, parts, born, 0) for t in self._vocabulary.values()}
        self._right = {t: self._edge(t, parts, born, 1) for t in self._vocabulary.values()}
        self._longest = max(len(t.removesuffix(END)) for t in self._vocabulary)
        self._apart: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, int] = {}
        self._chunks: dict[str, int] = {"": 0}

    @staticmethod
    def _edge(token: int, parts: dict, born: dict, side: int) -> list[tuple[int, int]]:
        """Tokens that stood at this edge on the way to the token, each with the rank of the merge that took it."""
        found, taken = [], _FOREVER
        while True:
            found.append((token, taken))
            if token not in parts:
                return found
            taken, token = born[token], parts[token][side]

    def _stay_apart(self, a: int, b: int) -> bool:
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > MEMORY:
                self._apart.clear()
            known = True
            for x, x_taken in self._right[a]:
                for y, y_taken in self._left[b]:
                    rank = self._rank.get((x, y))
                    if rank is not None and rank < x_taken and rank <= y_taken:
                        known = False
            self._apart[a, b] = known
        return known

    def _last(self, piece: str, j: int, i: int, last: list, ending: str, whole: bool = True):
        """The start and number of the token that ends prefix i, among those that start at j or later. whole: the
        piece begins at 0."""
        for k in range(j, i):
            t = self._vocabulary.get(piece[k:i] + ending)
            if t is not None and ((whole and k == 0) or self._stay_apart(last[k], t)):
                return k, t
        raise ValueError(f"the vocabulary has no token for {piece[:i]!r}")

    def piece_prefixes(self, piece: str, then: tuple[list, list] | None = None) -> list[int]:
        """Tokens of every prefix of a piece, each taken as a text of its own: the word ends there. then: two empty
        lists that get the last token, and the number of tokens, of each prefix that goes on, for continued()."""
        last, inner = then or ([], [])
        last.append(None)
        inner.append(0)
        return [0, *self.continued("", piece, (last, inner))]

    def continued(self, before: str, more: str, state: tuple[list, list]) -> list[int]:
        """Tokens of ``before`` and each prefix of ``more``, given the state of piece_prefixes() at the end of ``before``
        (its last entries as far as a token reaches), which goes on with ``more``."""
        last, inner = state
        reach = min(len(before), self._longest)
        piece, shift = before[len(before) - reach :] + more, len(last) - 1 - reach
        near, ended = last[shift:], []
        for i in range(reach + 1, len(piece) + 1):
            j = max(0, i - self._longest)
            k, _ = self._last(piece, j, i, near, END, shift == 0)
            ended.append(inner[shift + k] + 1)
            k, t = self._last(piece, j, i, near, "", shift == 0)
            near.append(t)
            last.append(t)
            inner.append(inner[shift + k] + 1)
        return ended

    def _piece(self, piece: str) -> int:
        known = self._pieces.get(piece)
        return self._learnt([piece])[piece] if known is None else known

    def _learnt(self, pieces: list[str]) -> dict[str, int]:
        """The tokens of pieces that aren't remembered."""
        found, rest, size = {}, [], 0
        for piece in pieces:
            if piece + END in self._vocabulary:
                found[piece] = 1
            else:
                rest.append(piece)
                size += len(piece)
                if size > TOGETHER:
                    found |= self._dynamic(rest)
                    rest, size = [], 0
        found |= self._dynamic(rest)
        if len(self._pieces) > MEMORY:
            self._pieces.clear()
        self._pieces.update((p, n) for p, n in found.items() if len(p) <= LONGEST_KEY)
        return found

    @cached_property
    def _automaton(self):
        """Every token of the vocabulary, a word end written as the character _STOP: its number and its length, negative
        if it ends a word."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for token, number in self._vocabulary.items():
            spelled = token.removesuffix(END)
            if spelled:
                automaton.add_word(spelled + _STOP if token.endswith(END) else spelled, (number, -len(spelled) - 1 if token.endswith(END) else len(spelled)))
        automaton.make_automaton()
        return automaton

    def _dynamic(self, pieces: list[str]) -> dict[str, int]:
        """As the last number of piece_prefixes(), of many pieces: an automaton finds the tokens that end each prefix,
        and the only one that fits gives the prefix its last token and its count."""
        text = _STOP.join([*pieces, ""])
        last, inner, ended = [None] * (len(text) + 1), [0] * (len(text) + 1), {}
        starts, at = [], 0
        for piece in pieces:
            starts.append(at)
            last[at] = -1
            at += len(piece) + 1
        apart, memory = self._stay_apart, self._apart.get
        for end, (token, width) in self._automaton.iter(text):
            i = end + 1
            if width > 0:
                if last[i] is None:
                    a = last[i - width]
                    fits = a < 0 or memory((a, token))
                    if apart(a, token) if fits is None else fits:
                        last[i] = token
                        inner[i] = inner[i - width] + 1
            elif i not in ended:
                a = last[i + width]
                fits = a < 0 or memory((a, token))
                if apart(a, token) if fits is None else fits:
                    ended[i] = inner[i + width] + 1
        return {piece: ended[start + len(piece) + 1] for piece, start in zip(pieces, starts, strict=True)}

    def _spelled(self, piece: str) -> str:
        """A piece in the vocabulary's alphabet, where every byte is one character."""
        if piece.isascii():
            return piece
        for c in set(piece) - self._letters.keys():
            self._letters[c] = "".join(p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(c))
        return "".join([self._letters[c] for c in piece])

    def pieces(self, chunk: str) -> list[str]:
        """What the vocabulary's own rules make of a chunk without special tokens."""
        if _PLAIN.fullmatch(chunk):
            return [self._spelled(p) for p in _PIECES.findall(chunk.lower())]
        return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(chunk))]

    def chunk(self, chunk: str) -> int:
        """Tokens of a chunk; a special token's string counts one."""
        known = self._chunks.get(chunk)
        return self._learnt_chunks([chunk])[chunk] if known is None else known

    def _learnt_chunks(self, unknown: list[str]) -> dict[str, int]:
        """The tokens of chunks that aren't remembered."""
        found, split, pieces = {}, [], self._pieces
        for c in unknown:
            if self._special_in(c):
                found[c] = len(self._specials.findall(c))
                split.append([p for part in self._specials.split(c) for p in self.pieces(part)])
            else:
                found[c] = 0
                split.append(self.pieces(c))
        needed = dict.fromkeys(p for own in split for p in own)
        of = {p: pieces[p] for p in needed if p in pieces}
        of |= self._learnt([p for p in needed if p not in of])
        for c, own in zip(unknown, split, strict=True):
            for p in own:
                found[c] += of[p]
        if len(self._chunks) > MEMORY:
            self._chunks.clear()
            self._chunks[""] = 0
        self._chunks.update((c, n) for c, n in found.items() if len(c) <= LONGEST_KEY)
        return found

    def count(self, text: str | None) -> int:
        return int(self.steps(text)[1].sum())

    def _special_in(self, text: str) -> bool:
        return any(m in text for m in self._special_marks)

    def steps(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk of a text: the characters from the last chunk's end to its own, and its tokens. Their running
        sums are the ends of the prefixes that end with a chunk and the exact token counts of these."""
        parts = chunks(self._lowered(text or ""))
        found = list(map(self._chunks.get, parts))
        if None in found:
            learnt = self._learnt_chunks(list({c: None for c, n in zip(parts, found, strict=True) if n is None}))
            found = [learnt[c] if n is None else n for c, n in zip(parts, found, strict=True)]
        tokens = np.array(found, np.int32)
        length = np.fromiter(map(len, parts), np.int32, len(parts))
        ends = np.cumsum(length + 1) - 1
        there = length > 0
        return np.diff(ends[there], prepend=0).astype(np.int32), tokens[there]

    def every_prefix(self, text: str | None) -> list[int]:
        """The exact token count of every prefix of a text, from 0 characters to all."""
        totals, before = [0], 0
        for n, c in enumerate(chunks(text or "")):
            if n:
                totals.append(before)  # the separator
            if c:
                inside = self._chunk_prefixes(c)
                totals += [before + x for x in inside]
                before += inside[-1]
        return totals

    def _chunk_prefixes(self, chunk: str) -> list[int]:
        """Token counts of all prefixes of a chunk but the empty one."""
        if self._special_in(chunk):  # a special token's string counts only once it is whole
            return self._with_specials(chunk)
        clusters = _CLUSTERS.findall(chunk)
        normal = list(map(self._normal, clusters))
        whole = "".join(normal)
        if self._library.normalizer.normalize_str(chunk) != whole:  # not met: marks combine inside a cluster only
            return [self.chunk(chunk[: i + 1]) for i in range(len(chunk))]
        split = self._library.pre_tokenizer.pre_tokenize_str(whole)
        # of each place in the normalised chunk: tokens of the text up to it, and of the pieces before its own
        upto, done, states, piece_at = [0] * (len(whole) + 1), 0, {}, [None] * (len(whole) + 1)
        end_before = 0
        for number, (spelled, (start, end)) in enumerate(split):
            for i in range(end_before + 1, start + 1):
                upto[i] = done
            state: tuple[list, list] = ([], [])
            ended, at = self.piece_prefixes(spelled, state), 0
            for i in range(start, end):
                at += len(whole[i].encode())
                upto[i + 1], piece_at[i + 1] = done + ended[at], (number, at)
            if whole[start] == "'" and end - start > 2:  # a contraction isn't one piece before it is whole
                for i in range(start + 2, end):
                    upto[i] = done + sum(self._piece(p) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(whole[start:i]))
            states[number] = spelled, state, done, whole[start] == "'" and whole[start + 1 : end].isalpha(), start
            done, end_before = done + ended[-1], end
        for i in range(end_before + 1, len(whole) + 1):
            upto[i] = done
        found, at = [], 0
        for cluster, made in zip(clusters, normal, strict=True):
            for j in range(1, len(cluster)):
                part = self._normal(cluster[:j])
                found.append(upto[at + len(part)] if made.startswith(part) else self._branched(whole, at, part, upto, piece_at, states))
            at += len(made)
            found.append(upto[at])
        return found

    def _branched(self, whole: str, at: int, part: str, upto: list[int], piece_at: list, states: dict) -> int:
        """Tokens of a prefix whose last characters are ``part``, where the whole text goes on otherwise from ``at`` on.
        upto, piece_at: of each place the tokens up to it, and the piece that ends or goes on there and the bytes of it."""
        mark = whole.rfind("'", max(0, at - 2), at)
        if mark >= 0 and piece_at[mark + 1]:  # a contraction may begin in that piece
            begin = states[piece_at[mark + 1][0]][4]
            return upto[begin] + sum(self._piece(p) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(whole[begin:at] + part))
        place, before = piece_at[at], whole[:at][-1:]
        before = "" if place is None or states[place[0]][3] else before  # a contraction is never part of a longer piece
        cut = self._library.pre_tokenizer.pre_tokenize_str(before + part)
        if not before or not cut or cut[0][1][1] <= 1:  # the part begins a piece
            return upto[at] + sum(self._piece(p) for p, (_, end) in cut if end > len(before))
        spelled, (last, inner), done, *_ = states[place[0]]
        own, reach = spelled[: place[1]], max(0, place[1] - self._longest)
        more = cut[0][0][len(before.encode()) :]
        state = (last[reach : place[1] + 1], inner[reach : place[1] + 1])
        if reach:  # continued() tells the beginning of a piece by the length of its state
            state = ([None, *state[0]], [0, *state[1]])
        ended = self.continued(own, more, state)
        return done + ended[-1] + sum(self._piece(p) for p, _ in cut[1:])

    def _normal(self, cluster: str) -> str:
        if cluster.isascii():
            return cluster.lower()
        known = self._normals.get(cluster)
        if known is None:
            known = self._library.normalizer.normalize_str(cluster)
            if len(self._normals) > MEMORY:
                self._normals.clear()
            if len(cluster) <= LONGEST_KEY:
                self._normals[cluster] = known
        return known

    def _with_specials(self, chunk: str) -> list[int]:
        """As _chunk_prefixes(), in runs between special tokens; inside one, its beginning is plain text."""
        found, done, at = [], 0, 0
        for m in [*self._specials.finditer(chunk), None]:
            run = chunk[at : m.start()] if m else chunk[at:]
            plain = self._plain_prefixes(run + (m[0][:-1] if m else ""))
            found += [done + x for x in plain]
            if m:
                done += (plain[len(run) - 1] if run else 0) + 1
                found.append(done)
                at = m.end()
        return found

    def _plain_prefixes(self, run: str) -> list[int]:
        """Of a run without a whole special token."""
        marks, self._special_marks = self._special_marks, set()
        try:
            return self._chunk_prefixes(run) if run else []
        finally:
            self._special_marks = marks

    def _lowered(self, text: str) -> str:
        with suppress(UnicodeEncodeError):  # in Latin-1 lower case is letter by letter and nothing combines
            text.encode("latin-1")
            return text if self._special_in(text) else text.lower()
        return text


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter a worker process, whose memory serves all its tasks."""
    return PrefixCounter(path)
