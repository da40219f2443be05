"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text's spaces become the space mark, one is put before it, and it is cut before each mark that follows another character; no piece
goes over such a cut.
The distinct pre-tokens of a large part of a task's rows are put in a trie, level by level. The best score of the pieces up to a node needs only its
ancestors, no more levels up than the longest piece has characters, so what pre-tokens share is computed once, and older levels are dropped. A level
of many pre-tokens is computed in arrays, all of its nodes together; where WIDE or fewer are left, the trie goes on by chains, its stretches without a branch, one step a character. So a
pre-token of any length is in the trie, in memory that grows with its text only. Counts are remembered by the worker, up to a bounded number. There is no shuffle.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import carried, kept_columns, restored
from .text import lean, pieces

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Pre-tokens that are left when a trie goes on by chains.
WIDE = 128
_PART, _REMEMBER, _LONG = 12 << 20, 300_000, 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(" *[^ ]+| +")


class Unigram:
    """Pieces with scores. A character that is no piece counts as many tokens as it has UTF-8 bytes, at a score below all others."""

    def __init__(self, scored: list[tuple[str, float]]):
        inside = [p for p, _ in scored if MARK in p.lstrip(MARK)]
        if inside:
            raise ValueError(f"pieces with an inner space mark, such as {inside[0]!r}, are not supported")
        self.unknown = min((s for _, s in scored), default=0.0) - UNKNOWN_PENALTY
        by: dict[int, dict] = {}
        for p, s in scored:
            if p:
                by.setdefault(len(p), {})[self.key(p)] = s
        self.by = {n: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for n, d in sorted(by.items())}
        self.longest = max(self.by, default=1)
        self.scores = {p: s for p, s in scored if p}

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) % (1 << 64)
        return h

    def counts(self, words: list[str]) -> np.ndarray:
        """How many tokens the best segmentation of each of the distinct words has; of equal ones the one with the longer last piece."""
        order = sorted(range(len(words)), key=words.__getitem__)
        text = "".join(words[i] for i in order)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(words[i]) for i in order], np.int64)
        at = np.cumsum(size) - size
        # of each level kept: each node's parent in the level before, the hash of its prefix, best score and count
        levels = deque([(np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))], maxlen=self.longest + 1)
        node, out, d = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        live = np.flatnonzero(size > 0)
        while len(live) > WIDE:
            c, above = code[at[live] + d].astype(np.uint64), node[live]
            new = np.ones(len(live), bool)  # words are sorted, so those that share the node stand together
            new[1:] = (c[1:] != c[:-1]) | (above[1:] != above[:-1])
            node[live] = np.cumsum(new) - 1
            levels.append(self._level(above[new], c[new], levels))
            d += 1
            done = size[live] == d
            out[live[done]] = levels[-1][3][node[live[done]]]
            live = live[~done]
        for own in np.split(live, np.flatnonzero(np.diff(node[live])) + 1) if len(live) else []:
            best, count = [0.0] * (self.longest + 1), [0] * (self.longest + 1)
            up = int(node[own[0]])
            for k in range(min(len(levels), self.longest + 1)):
                parent, _, score, total = levels[-1 - k]
                best[(d - k) % len(best)], count[(d - k) % len(best)] = float(score[up]), int(total[up])
                up = int(parent[up])
            self._chains([words[order[i]] for i in own], code, at[own], d, best, count, out, own)
        back = np.empty(len(words), np.int64)
        back[order] = out
        return back

    def _chains(self, words, code, at, depth, best, count, out, own):
        """Counts of sorted words that share their first depth characters, into out at own. best and count are of the last prefixes, by length modulo their size."""
        get, lengths, size, singles = self.scores.get, sorted(self.by, reverse=True), self.longest + 1, self.scores
        stack = [(0, len(words), depth, best, count)]
        while stack:
            lo, hi, d, best, count = stack.pop()
            word, last = words[lo], words[hi - 1]
            end = len(word)
            if hi - lo > 1:  # what the first and the last share, all between share
                n = min(end, len(last)) - d
                differ = code[at[lo] + d : at[lo] + d + n] != code[at[hi - 1] + d : at[hi - 1] + d + n]
                end = d + (int(differ.argmax()) if differ.any() else n)
            for e in range(d + 1, end + 1):
                top, tokens = -np.inf, 0
                for n in lengths:
                    if n <= e and (s := get(word[e - n : e])) is not None and (s := best[(e - n) % size] + s) > top:
                        top, tokens = s, count[(e - n) % size] + 1
                c = word[e - 1]
                if c not in singles and (s := best[(e - 1) % size] + self.unknown) > top:
                    top, tokens = s, count[(e - 1) % size] + len(c.encode("utf-8", "surrogatepass"))
                best[e % size], count[e % size] = top, tokens
            while lo < hi and len(words[lo]) == end:
                out[own[lo]] = count[end % size]
                lo += 1
            while lo < hi:  # a branch for each next character
                to = lo + 1
                while to < hi and words[to][end] == words[lo][end]:
                    to += 1
                stack.append((lo, to, end, best.copy(), count.copy()))
                lo = to

    def _level(self, above, chars, levels) -> tuple:
        """A level's nodes: parents, prefixes, best scores and counts; pieces from long to short, as a longer last piece wins a tie."""
        up = [above]
        for k in range(1, min(len(levels), self.longest)):
            up.append(levels[-k][0][up[-1]])
        prefix = levels[-1][1][above] * _P + chars + np.uint64(1)
        score, total, single = np.full(len(above), -np.inf), np.zeros(len(above), np.int64), np.zeros(len(above), bool)
        for length in range(len(up), 0, -1):
            if length in self.by:
                keys, values = self.by[length]
                _, hashes, best, count = levels[-length]
                h = prefix - hashes[up[length - 1]] * np.uint64(pow(int(_P), length, 1 << 64))
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                found = keys[k] == h
                s = np.where(found, best[up[length - 1]] + values[k], -np.inf)
                better = s > score
                score = np.where(better, s, score)
                total = np.where(better, count[up[length - 1]] + 1, total)
                if length == 1:
                    single = found
        width = 1 + (chars >= 0x80).astype(int) + (chars >= 0x800) + (chars >= 0x10000)
        s = np.where(single, -np.inf, levels[-1][2][above] + self.unknown)
        better = s > score
        return above, prefix, np.where(better, s, score), np.where(better, levels[-1][3][above] + width, total)


def load(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Counter:
    """Counts of texts; remembers those of the pre-tokens met, up to _REMEMBER."""

    def __init__(self, scored):
        self.model = Unigram(scored)
        self.forget()

    def forget(self):
        self.codes: dict[str, int] = {}
        self.known = np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each text."""
        if len(self.codes) > _REMEMBER:
            self.forget()
        codes, numbered = self.codes, []
        for t in texts:
            found = [] if not t else _CUT.findall(" " + t) if len(t) <= _LONG else (m[0] for m in _CUT.finditer(" " + t))
            if isinstance(found, list):
                for x in set(found).difference(codes):
                    codes[x] = len(codes)
                numbered.append(np.fromiter(map(codes.__getitem__, found), np.int64, len(found)))
            else:
                numbered.append(np.fromiter((codes.setdefault(x, len(codes)) for x in found), np.int64))
        if len(codes) > len(self.known):
            new = [x.replace(" ", MARK) for x in list(codes)[len(self.known) :]]
            self.known = np.append(self.known, self.model.counts(new))
        return np.array([len(c) for c in numbered], np.int64), np.array([self.known[c].sum() for c in numbered], np.int64)


_COUNTERS: dict = {}


def token_counts(documents: DataFrame, scored: list[tuple[str, float]], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents' columns keep, n_pretokens and n_tokens of whole texts under the pieces and scores, which are broadcast.

    Null and empty texts have none; of two segmentations of equal score that with the longer last piece counts; a very long text takes time in proportion, without blanks as well;
    repeated rows each give a row; no rows give none; columns not in keep are not read, and one of them that has a result's name gets _ at its end.
    """
    sent = documents.sparkSession.sparkContext.broadcast(scored)
    docs, read = kept_columns(documents, keep, text)

    def run(batches):
        key = hash(tuple(sent.value))
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(sent.value)
        for batch in batches:
            for part in pieces(batch, read, _PART):
                pre, n = _COUNTERS[key].count(part.column(read).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried(keep)), pa.array(pre), pa.array(n)], [*carried(keep), "n_pretokens", "n_tokens"])

    schema = docs.select(*carried(keep), F.lit(None).cast("long").alias("n_pretokens"), F.lit(None).cast("long").alias("n_tokens")).schema
    return restored(docs.mapInArrow(lean(run), schema), keep, "n_pretokens", "n_tokens")
