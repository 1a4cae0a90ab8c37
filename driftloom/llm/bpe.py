"""BPE encoding by speculation and verification, and decoding, for word-end vocabularies of the ``tokenizers`` library."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm.common import as_bytes, chunks, ship

END = "</w>"
#: Characters whose case, composition and class do not differ between Unicode versions; others go through the library's
#: own normaliser and splitter.
#: str.split() would part words at these, which are no white space to the vocabulary.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
_NEVER = 1 << 60
_SETTLED = re.compile("[^\u0000-ɏΑ-Ωα-ωА-я‐-‧‰-⁞€　]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(hidden):
        out[b] = chr(256 + k)
    return out


class WordBPE:
    """One vocabulary file. ``encode`` gives for each text the ids and tokens, both joined by one space."""

    def __init__(self, path: str, most_words: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.most = most_words
        self.words: dict[str, str] = {}
        self.texts: dict[str, str] = {}
        self.ids: dict[str, str] = {}
        self.tokens: dict[str, str] = {}
        self.fits: dict[int, bool] = {}
        self.start = np.array([self.vocab[c] for c in self.letters])
        self.stop = np.array([self.vocab[c + END] for c in self.letters])
        ranked = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.pair, self.pair_rank, self.pair_new = (np.array(x, np.int64) for x in zip(*ranked, strict=True))
        self._grow_trie()

    def _grow_trie(self) -> None:
        """Tokens as byte paths, a word end being symbol 256: sorted edges (node * 257 + symbol) and their ends."""
        edges: dict[int, int] = {}
        accept = [-1]
        self.bytes_of: dict[int, tuple[bytes, bool]] = {}
        for token, i in self.vocab.items():
            ends = token.endswith(END) and token != END
            raw = bytes(self.bytes[c] for c in (token.removesuffix(END) if ends else token))
            self.bytes_of[i] = (raw, ends)
            node = 0
            for symbol in [*raw, 256] if ends else raw:
                key = node * 257 + symbol
                if (child := edges.get(key)) is None:
                    child = edges[key] = len(accept)
                    accept.append(-1)
                node = child
            accept[node] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.edge.tolist()], np.int64)
        self.accept = np.array(accept, np.int64)

    def merged(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the leftmost pair of the lowest rank."""
        n = len(symbols)
        symbols, after, before = [*symbols], [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.merges.get
        heap = [(m[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (m := get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = get((a, b))[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (m[0], i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (m := get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (m[0], h, symbols[h], symbols[i]))
        return [s for s in symbols if s >= 0]

    def exact(self, words: list[tuple[bytes, bool]], wide: int = 40) -> list[list[int]]:
        """Exact merging of (bytes, whether a word ends there): a matrix row each, one merge of each row in a round."""
        out: list[list[int]] = [[] for _ in words]
        order: dict[int, list[int]] = {}
        for k, (raw, _) in enumerate(words):
            order.setdefault(-(-len(raw) // 8) * 8, []).append(k)
        for width, rows in order.items():
            if width > wide:
                for k in rows:
                    raw, ends = words[k]
                    first = self.start[list(raw)].tolist()
                    out[k] = self.merged([*first[:-1], int(self.stop[raw[-1]]) if ends else first[-1]])
                continue
            sizes = np.array([len(words[k][0]) for k in rows])
            grid = np.frombuffer(b"".join([words[k][0].ljust(width, b"\0") for k in rows]), np.uint8).reshape(len(rows), width)
            state = np.where(np.arange(width + 1) < sizes[:, None], np.pad(self.start[grid], ((0, 0), (0, 1))), -1)
            ends = np.flatnonzero([words[k][1] for k in rows])
            state[ends, sizes[ends] - 1] = self.stop[grid[ends, sizes[ends] - 1]]
            rank, new = self._ranks(state[:, :-1], state[:, 1:])
            live = np.arange(len(rows))
            columns = np.arange(width)
            done = state.copy()
            while len(live):
                at = rank.argmin(axis=1)
                here = np.arange(len(live))
                go = rank[here, at] < _NEVER
                done[live[~go]] = state[~go]
                live, state, rank, new, at = live[go], state[go], rank[go], new[go], at[go]
                if not len(live):
                    break
                here = here[: len(live)]
                state[here, at] = new[here, at]
                shift = np.minimum(columns + (columns > at[:, None]), width)
                state = np.concatenate([np.take_along_axis(state, shift, 1), np.full((len(live), 1), -1)], axis=1)
                edge = np.minimum(shift, width - 1)
                rank, new = np.take_along_axis(rank, edge, 1), np.take_along_axis(new, edge, 1)
                rank[:, -1] = _NEVER
                for side in (at - 1, at):
                    ok = side >= 0
                    rank[here[ok], side[ok]], new[here[ok], side[ok]] = self._ranks(state[here[ok], side[ok]], state[here[ok], side[ok] + 1])
            for k, row in zip(rows, done.tolist(), strict=True):
                out[k] = [t for t in row if t >= 0]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a >= 0) & (b >= 0), a << 32 | np.maximum(b, 0), -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = self.pair[at] == key
        return np.where(found, self.pair_rank[at], _NEVER), np.where(found, self.pair_new[at], -1)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once, down the trie: (word, token) in order. The last token ends the word."""
        flat = np.array([x for w in words for x in (*w, 256)], np.int64)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        stop = np.cumsum(size)
        word, at = np.arange(len(words)), stop - size
        node, token, past, stop = np.zeros(len(words), np.int64), np.full(len(words), -1), at.copy(), stop.copy()
        owners, tokens = [], []
        while len(word):
            inside = at < stop
            key = np.where(inside, node * 257 + flat[np.minimum(at, len(flat) - 1)], -1)
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[edge] == key
            node, at = np.where(on, self.child[edge], node), at + on
            taken = self.accept[node]
            good = on & (taken >= 0) & (at != stop - 1)  # not just before the word end
            token, past = np.where(good, taken, token), np.where(good, at, past)
            off = ~on
            owners.append(word[off])
            tokens.append(token[off])
            at, node = np.where(off, past, at), np.where(off, 0, node)
            token = np.where(off, -1, token)
            keep = ~off | (past < stop)
            word, at, node, token, past, stop = (x[keep] for x in (word, at, node, token, past, stop))
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether exact merging of two tokens' bytes gives the two again; key (first + 1) << 32 | second, first -1: none."""
        fits = self.fits
        if len(fits) > 1_000_000:
            fits.clear()
        keys = pairs.tolist()
        new = [k for k in keys if k not in fits]
        tokens = [([(k >> 32) - 1] if k >> 32 else []) + [k & 0xFFFFFFFF] for k in new]
        joined = [(b"".join([self.bytes_of[t][0] for t in ts]), self.bytes_of[ts[-1]][1]) for ts in tokens]
        fits.update((k, got == ts) for k, ts, got in zip(new, tokens, self.exact(joined), strict=True))
        return np.array([fits[k] for k in keys], bool)

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode new words: propose, test all adjacent pairs at once, merge only words in which a pair fails."""
        words = list(pieces)
        if not words:
            return
        raw = [w.encode() for w in words]
        owner, token = self.propose(raw)
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        lone = first & np.concatenate([first[1:], [True]])
        key = (np.where(first, 0, np.concatenate([[0], token[:-1] + 1])) << 32) | token
        test = ~first | lone
        pairs, which = np.unique(key[test], return_inverse=True)
        failed = np.zeros(len(words), bool)
        failed[owner[test][~self.compatible(pairs)[which]]] = True
        bounds = np.append(np.flatnonzero(first), len(token)).tolist()
        flat = token.tolist()
        ids = [flat[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        bad = np.flatnonzero(failed).tolist()
        for k, found in zip(bad, self.exact([(raw[k], True) for k in bad]), strict=True):
            ids[k] = found
        name = self.token
        self.words.update(zip(words, [" ".join(map(str, x)) for x in ids], strict=True))
        self.texts.update(zip(words, [" ".join([name[t] for t in x]) for x in ids], strict=True))

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens' strings stand for themselves."""
        if self.marks and "<|" in text:
            return [p for s in self.marks.split(text) if s for p in ([s] if s in self.special else self._split(s))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and _SETTLED.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.bytes[c] for c in p).decode("utf-8", "replace") for p, _ in pieces]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return self.pieces.findall(text)

    def encode(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids and tokens of each text. White space parts words, so that strings between it are remembered as a whole."""
        if len(self.ids) > self.most:
            self.ids.clear()
            self.tokens.clear()
        if len(self.words) > self.most:
            self.words.clear()
            self.texts.clear()
        rows = [[w for w in _SPACE.split(t) if w] if _ODD.search(t) else t.split() for t in texts]
        new = [w for w in set().union(*rows) if w not in self.ids]
        split = [self.split(w) for w in new]
        self.words.update((s, str(i)) for s, i in self.special.items())
        self.texts.update((s, s) for s in self.special)
        known = self.words
        self.learn({p for ps in split for p in ps if p not in known})
        word, text = self.words.__getitem__, self.texts.__getitem__
        for w, ps in zip(new, split, strict=True):
            self.ids[w], self.tokens[w] = " ".join(map(word, ps)), " ".join(map(text, ps))
        ids, tokens = self.ids.__getitem__, self.tokens.__getitem__
        return [(" ".join(map(ids, ws)), " ".join(map(tokens, ws))) for ws in rows]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the library does for a vocabulary without a decoder."""
        named = {i: s for s, i in self.special.items()}
        return " ".join(named.get(i) or self.token[i] for i in ids)


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBPE:
    """A worker reads a vocabulary once and keeps its remembered words between tasks."""
    return WordBPE(path)


_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def encode_documents(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """Encode each whole text with the vocabulary at ``path`` (a file on each machine, as the library has) and decode it.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded themselves (only if ``full``). A null text
    is an empty one: no ids. Special tokens' strings in a text are those tokens; none is added, nothing cut or padded. Each
    row gives one row, in whatever number; other columns are ignored. Memory holds words of a block of texts and a
    bounded memory of earlier words, whatever the corpus.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for part in chunks(batches, "text", 2 << 20):
            out: list[list] = [[] for _ in range(5)]
            for ids, decoded in bpe.encode([t.decode("utf-8", "replace") for t in as_bytes(part, "text")]):
                row = (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), list(map(int, ids.split())) if full else None, decoded if full else None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _RESULT)
