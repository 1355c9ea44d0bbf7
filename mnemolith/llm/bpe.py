"""Operator 4: BPE encoding and decoding by speculation and verification.

A greedy longest match proposes the tokens of each new word, a vectorised check tests every pair of
neighbouring tokens, and only the words with a pair that byte-pair merging would not leave there
are merged exactly. A sequence of canonical tokens is the BPE result if and only if each adjacent pair is.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release, text_slices

END = "Ā"
#: Unicode white space, spelled out since regex libraries differ on the separators 1C-1F.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Above this code point, letter and number classes depend on the Unicode version of the library, so its own splitter is asked.
STABLE = "[^\x00-ԯ‐-‧‰-⁞₠-€]"
#: Words kept with their tokens in each Python worker; a full cache is emptied, which changes no result.
CACHE_WORDS = 400_000
SLICE_CHARS = 1_000_000
#: Words of more bytes are merged by a heap, each alone.
LONG_WORD = 200


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SpeculativeBPE:
    """Encoder and decoder of a byte-level BPE vocabulary with word ends, read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec["decoder"] is not None:
            raise ValueError("a BPE vocabulary with a word-end suffix and no decoder is needed")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.byte_of = {c: b for b, c in byte_letters().items()}
        back = {c: chr(b) for c, b in self.byte_of.items()}
        self.strings = dict(map(reversed, vocab.items())) | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(vocab.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank = {}
        keys, made = [], []
        for a, b in merges:
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if k <= max(i, j) or self.left[k] != k:
                raise ValueError("merged tokens must be numbered in merge order")
            self.left[k], self.right[k] = i, j
            self.rank[i, j] = k
            keys.append(i * n + j)
            made.append(k)
        order = np.argsort(keys)
        self.n, self.keys, self.made = n, np.array(keys)[order], np.array(made)[order]
        ok = self.compatible(self.left, self.right, np.arange(n)) | (self.left == np.arange(n))
        for k in made:
            ok[k] = ok[k] and ok[self.left[k]] and ok[self.right[k]]
        self.canonical = ok
        # the token of each byte inside a word and at its end
        self.inner, self.final = np.zeros(256, np.int64), np.zeros(256, np.int64)
        auto = ahocorasick.Automaton()
        for token, i in vocab.items():
            ends = token.endswith(suffix) and token != suffix
            raw = "".join(back[c] for c in (token[: -len(suffix)] if ends else token)) + END * ends
            auto.add_word(raw, len(raw) << 32 | i)
            if len(raw) - ends == 1:
                (self.final if ends else self.inner)[ord(raw[0])] = i
        auto.make_automaton()
        self.auto = auto
        self.library = Tokenizer.from_file(path)
        self.normalise = self.library.normalizer.normalize_str
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(split.replace(r"[^\s", f"[^{SPACE}")).findall
        self.unstable = regex.compile(STABLE).search
        # tokens of words, and their strings
        self.cache: dict[str, bytes] = {}
        self.said: dict[str, str] = {}

    def compatible(self, first: np.ndarray, second: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: whether merging leaves the border between them as it is.

        The merges of both tokens are taken back from the last; a merge across the border that would
        have come before the one taken back shows that the pair can't stand.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        most = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[at] == key) & (self.made[at] < most)
            out[live[bad]] = False
            go = ~bad
            live, a, b = live[go], a[go], b[go]
            a_next, b_next = self.right[a], self.left[b]
            base_a, base_b = a_next == a, b_next == b
            take_a = ((a > b) & ~base_a) | ((a <= b) & base_b)
            done = base_a & base_b
            most = np.where(take_a, a, b + 1)
            a, b = np.where(take_a, a_next, a), np.where(take_a, b, b_next)
            go = ~done
            live, a, b, most = live[go], a[go], b[go], most[go]
        return out

    def made_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens the one they merge into, n for none."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.n)

    def merged(self, words: list[str]) -> dict[int, list[int]]:
        """Tokens of words (a letter for each byte), by number, by merging the pair of lowest rank, leftmost first.

        All words take a step at once, in which each merges its lowest pair wherever it stands; finished words leave. Words that are long
        take their steps alone, by a heap.
        """
        done = {i: self.merged_long(w) for i, w in enumerate(words) if len(w) > LONG_WORD}
        some = [i for i in range(len(words)) if i not in done]
        if not some:
            return done
        sizes = np.array([len(words[i]) for i in some])
        ids = self.inner[np.frombuffer("".join([words[i] for i in some]).encode("latin-1"), np.uint8)]
        last = np.cumsum(sizes) - 1
        ids[last] = self.final[np.frombuffer("".join([words[i][-1] for i in some]).encode("latin-1"), np.uint8)]
        of = np.repeat(np.array(some), sizes)
        into = np.full(len(ids), self.n)
        at = np.flatnonzero(of[1:] == of[:-1])
        into[at] = self.made_of(ids[at], ids[at + 1])
        while len(ids):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            best = np.repeat(np.minimum.reduceat(into, starts), np.diff(starts, append=len(of)))
            live = best < self.n
            if not live.all():
                ended = np.flatnonzero(~live)
                cut = np.flatnonzero(np.diff(of[ended], prepend=-1))
                done |= dict(zip(of[ended[cut]].tolist(), [x.tolist() for x in np.split(ids[ended], cut[1:])]))
                ids, of, into, best = ids[live], of[live], into[live], best[live]
            hit = np.flatnonzero(into == best)
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)  # of pairs that overlap, a a a, every other one
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
            ids[hit] = best[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, of, into = ids[keep], of[keep], into[keep]
            at = hit - np.arange(len(hit))  # where the new tokens stand now
            at = np.unique(np.concatenate([at, at - 1]))
            at = at[(at >= 0) & (at < len(ids))]
            inside = at[:-1] if len(at) and at[-1] == len(ids) - 1 else at
            into[at] = self.n
            inside = inside[of[inside] == of[inside + 1]]
            into[inside] = self.made_of(ids[inside], ids[inside + 1])
        return done

    def merged_long(self, word: str) -> list[int]:
        """merged for one word: a heap of pairs by rank and place, over tokens linked to their neighbours."""
        raw = word.encode("latin-1")
        ids: list = [*self.inner[np.frombuffer(raw[:-1], np.uint8)].tolist(), int(self.final[raw[-1]])]
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(k, i) for i, p in enumerate(zip(ids, ids[1:])) if (k := self.rank.get(p)) is not None]
        heapify(heap)
        while heap:
            k, i = heappop(heap)
            j = right[i] if ids[i] is not None else len(ids)
            if j >= len(ids) or self.rank.get((ids[i], ids[j])) != k:
                continue  # one of the two has merged since
            ids[i], ids[j], right[i] = k, None, right[j]
            if right[j] < len(ids):
                left[right[j]] = i
                if (x := self.rank.get((k, ids[right[j]]))) is not None:
                    heappush(heap, (x, i))
            if left[i] >= 0 and (x := self.rank.get((ids[left[i]], k))) is not None:
                heappush(heap, (x, left[i]))
        return [x for x in ids if x is not None]

    def words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Tokens of distinct words in one array, where each word's begin, and the tokens of those that had to be merged: proposals for all at once, exact merging for those that fail the check."""
        raw = [w.encode("utf-8").decode("latin-1") for w in new]
        ends, hits = (np.array(x, np.int64) for x in zip(*self.auto.iter_long(END.join(raw) + END)))
        sizes, ids = hits >> 32, hits & 0xFFFFFFFF
        word_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        of = np.searchsorted(word_ends, ends)
        starts = np.searchsorted(of, np.arange(len(new) + 1))
        fails = np.zeros(len(new), bool)
        fails[of[~self.canonical[ids]]] = True
        fails |= np.bincount(of, sizes, len(new)) != np.diff(word_ends, prepend=-1)  # a word end that no token took
        inner = np.flatnonzero(of[1:] == of[:-1])
        if len(inner):
            pairs, back = np.unique(ids[inner] * self.n + ids[inner + 1], return_inverse=True)
            fails[of[inner[~self.compatible(pairs // self.n, pairs % self.n)[back]]]] = True
        failed = np.flatnonzero(fails).tolist()
        exact = self.merged([raw[i] for i in failed])
        return ids, starts, {i: exact[k] for k, i in enumerate(failed)}

    def learn(self, new: list[str]) -> None:
        """Puts the tokens of new words in the cache."""
        ids, starts, merged = self.words(new)
        raw, names, at = ids.astype("<u4").tobytes(), [self.strings[i] for i in ids.tolist()], starts.tolist()
        self.cache.update(zip(new, [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]))
        self.said.update(zip(new, [names[a] if b == a + 1 else " ".join(names[a:b]) for a, b in zip(at, at[1:])]))
        for i, tokens in merged.items():
            self.cache[new[i]] = np.array(tokens, "<u4").tobytes()
            self.said[new[i]] = " ".join([self.strings[x] for x in tokens])

    def split(self, text: str):
        """Words of a text and its special tokens, in order: (word or None, token or None)."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield None, self.special[part]
            elif part:
                # in this range lower case is the same everywhere, but for the sigma that ends a word
                plain = not self.unstable(part) and "\u03a3" not in part and is_normalized("NFC", part)
                part = part.lower() if plain else self.normalise(part)
                if not plain and self.unstable(part):
                    yield [bytes([self.byte_of[c] for c in w]).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(part)], None
                else:
                    yield self.find(part), None

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text: ids as little-endian unsigned 32-bit integers, and their decoded text.

        The new words of all texts are proposed and checked at once, a slice of a long text at a time.
        """
        out = []
        for text in texts:
            if len(text) > SLICE_CHARS:
                parts = [x for piece in text_slices(text, SLICE_CHARS) for x in self.joined([piece])]
                out.append((b"".join([x[0] for x in parts]), " ".join([x[1] for x in parts if x[0]])))
            else:
                out.append(None)
        short = iter(self.joined([x for x in texts if len(x) <= SLICE_CHARS]))
        return [next(short) if x is None else x for x in out]

    def joined(self, texts: list[str]) -> list[tuple[bytes, str]]:
        split, cache, seen = [list(self.split(x)) for x in texts], self.cache, set()
        for parts in split:
            for found, _ in parts:
                if found:
                    seen.update(found)
        new = sorted(w for w in seen if w not in cache)
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            self.said.clear()
            new = sorted(seen)
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        out, ids_of, said_of = [], cache.__getitem__, self.said.__getitem__
        for parts in split:
            ids = b"".join([b"".join(map(ids_of, found)) if found is not None else token.to_bytes(4, "little") for found, token in parts])
            out.append((ids, " ".join([" ".join(map(said_of, found)) if found is not None else self.strings[token] for found, token in parts if found != []])))
        return out

    def decode(self, ids) -> str:
        """Text of ids: the vocabulary's strings joined by one space, special tokens kept."""
        return " ".join([self.strings[int(i)] for i in ids])


@lru_cache(maxsize=2)
def coder(path: str) -> SpeculativeBPE:
    return SpeculativeBPE(path)


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes it again: (id, n_tokens, ids, decoded).

    ids holds the tokens as little-endian unsigned 32-bit integers. A null or empty text has no tokens
    and decodes to the empty text; rows are independent, so repeated rows and ids give repeated rows. Other
    columns are left behind, whatever their names. No shuffle: each task works through its own rows in slices
    of bounded size. vocab_path must exist on every executor, as an installed package's file does.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = coder(vocab_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, to in slices(texts, 2_000_000):
                part = [x or "" for x in texts.slice(at, to - at).to_pylist()]
                out = bpe.encode(part)
                ids = [x[0] for x in out]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, to - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x[1] for x in out], pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"],
                )
        release()

    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary, decoded string").withColumnRenamed("id", id_col)


def slices(texts: pa.Array, most: int = 4_000_000):
    """Row ranges of a column of texts that hold about ``most`` bytes each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield at, i
            at, total = i, 0
        total += int(size)
    if at < len(sizes):
        yield at, len(sizes)


def bpe_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decodes a column of ids as bpe_encode writes it: (id, decoded); null ids give the empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = coder(vocab_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()], pa.string())],
                names=["id", "decoded"],
            )

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, decoded string").withColumnRenamed("id", id_col)
