"""Token counts of a byte-fallback piece BPE model by rank-synchronous array merging.

The vocabulary is read from the tokenizer's own file; nothing is trained.  A text becomes symbols as
the model prescribes (dummy prefix, blanks as U+2581) and is cut into pre-tokens where no piece can
reach across: before a blank mark that follows something else, as long as no piece holds a blank mark
after another symbol.  Each chunk's distinct new pre-tokens are laid out as one ragged array; in every
round each sequence finds its lowest-rank adjacent pair (leftmost on ties) and all sequences merge
theirs at once, until no pair is left.  The surviving symbols are counted, an unknown one as its UTF-8
bytes.  Pre-tokens of over ``LONG`` symbols would need as many rounds: they merge through a heap, with
the same order of merges.

Edge cases: null and empty texts have no bytes and no tokens; control strings such as ``<s>`` are
ordinary text, as the library takes them; repeated rows give repeated results; other columns are
ignored.  The counts of distinct pre-tokens are kept from chunk to chunk up to ``CACHE`` entries.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.shared import text_rows
from headway.llm.textvec import chunks

LONG = 256
CACHE = 200_000
MARK = "▁"
_NEVER = np.iinfo(np.int64).max


class PieceTable:
    """Symbols, and the rank and result of every pair that the vocabulary can merge."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models have ranks")
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model.normalizer_spec
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.byte_fallback = model.trainer_spec.byte_fallback
        pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.cut = re.compile("(?s).+") if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.ids: dict[str, int] = {}
        for p in pieces:
            for c in p:
                self.ids.setdefault(c, len(self.ids))
        self.n_chars = len(self.ids)
        self.known = [c in pieces for c in self.ids]
        for p in pieces:
            self.ids.setdefault(p, len(self.ids))
        self.width = len(self.ids) + 1
        keys, rank, made = [], [], []
        for p, score in pieces.items():
            for i in range(1, len(p)):
                a, b = self.ids.get(p[:i]), self.ids.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    rank.append(ranks[score])
                    made.append(self.ids[p])
        order = np.argsort(keys)
        self.keys, self.rank, self.made = (np.array(x, dtype=np.int64)[order] for x in (keys, rank, made))
        bits = 22
        self.sieve = np.zeros(1 << bits, dtype=bool)
        self.shift, self.mult = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        self.sieve[self._slot(self.keys)] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.mult) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the merge table, or -1; symbol -1 never merges."""
        keys = left * self.width + right
        out = np.full(len(keys), -1, dtype=np.int64)
        near = np.flatnonzero((left >= 0) & (right >= 0) & self.sieve[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
        ok = self.keys[at] == keys[near]
        out[near[ok]] = at[ok]
        return out

    def symbols(self, text: str) -> list[str]:
        """Pre-tokens of a text, after the model's own normalisation."""
        if not text:
            return []
        text = self.prefix + text.replace(" ", MARK) if self.plain else self.processor.normalize(text)
        return self.cut.findall(text)

    def _units(self, c: str) -> int:
        """Tokens of a symbol that no merge took."""
        i = self.ids.get(c, -1)
        if 0 <= i < self.n_chars and self.known[i]:
            return 1
        return len(c.encode()) if self.byte_fallback else 1

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merged side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), dtype=np.int64)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._long(words[i])
        short = np.flatnonzero(lengths <= LONG)
        text = "".join(words[i] for i in short)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        ids = np.array([self.ids.get(chr(c), -1) for c in distinct], dtype=np.int64)
        units = np.array([self._units(chr(c)) for c in distinct], dtype=np.int64)
        sym = ids[inverse] if len(points) else np.zeros(0, np.int64)
        owner = np.repeat(short, lengths[short])
        cost = units[inverse] if len(points) else np.zeros(0, np.int64)
        while len(sym) > 1:
            pair = self.pairs(sym[:-1], sym[1:])
            pair[owner[:-1] != owner[1:]] = -1
            can = np.flatnonzero(pair >= 0)
            if not len(can):
                break
            first = np.flatnonzero(np.concatenate(([True], owner[can][1:] != owner[can][:-1])))
            rank = self.rank[pair[can]]
            order = rank * (len(can) + 1) + np.arange(len(can))  # lowest rank, then leftmost
            at = can[np.minimum.reduceat(order, first) % (len(can) + 1)]
            sym[at], cost[at] = self.made[pair[at]], 1
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            busy = np.zeros(len(words), dtype=bool)
            busy[owner[at]] = True
            done = keep & ~busy[owner]  # their sequences have no pair left
            np.add.at(out, owner[done], cost[done])
            keep &= ~done
            sym, owner, cost = sym[keep], owner[keep], cost[keep]
        np.add.at(out, owner, cost)
        return out

    def _long(self, word: str) -> int:
        n = len(word)
        sym = [self.ids.get(c, -1) for c in word]
        cost = [self._units(c) for c in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(lefts: list[int]) -> None:
            a = np.array([sym[i] for i in lefts], dtype=np.int64)
            b = np.array([sym[after[i]] for i in lefts], dtype=np.int64)
            for i, x, y, p in zip(lefts, a.tolist(), b.tolist(), self.pairs(a, b).tolist(), strict=True):
                if p >= 0:
                    heapq.heappush(heap, (int(self.rank[p]), i, x, y, p))

        push(list(range(n - 1)))
        alive = [True] * n
        while heap:
            _, i, x, y, p = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or sym[i] != x or sym[j] != y:
                continue
            sym[i], cost[i], alive[j], after[i] = int(self.made[p]), 1, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            push([k for k in (before[i], i) if k >= 0 and after[k] < n])
        return sum(c for c, ok in zip(cost, alive, strict=True) if ok)


def _count(path: str, limit: int):
    def run(batches):
        table = PieceTable(path)
        known: dict[str, int] = {}
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                words = [table.symbols(t) if t else [] for t in texts]
                new = list({w for ws in words for w in ws if w not in known})
                if len(known) + len(new) > CACHE:
                    known = {}
                    new = list({w for ws in words for w in ws})
                known.update(zip(new, table.count(new).tolist(), strict=True))
                n = [sum(map(known.__getitem__, ws)) for ws in words]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document."""
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(model_path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
