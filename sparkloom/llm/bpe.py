"""Byte-level BPE as a deterministic tokenization automaton.

The merges are compiled one after another. Each merge (a, b) -> ab is a gadget on the automaton over tokens: all
a-arcs, which lead to one state s, are redirected to a copy of s without its b-arc, and every state with an a-arc
gets an ab-arc to where b led from s. So each token has one target state, and the automaton has a state a merge. It
accepts exactly the token sequences that BPE makes, one for each byte string. States are kept as (parent, removed
arc, birth), as a copy differs from its original in one arc.

Two tables in arrays drive the encoding: bytes lead from node to node of the tokens' tree, and tokens from state to state
of the automaton. The second would have an entry for each of the billions of pairs of a state and a token; an entry is
compiled from the gadgets when it is first asked for, and kept. All new words of a batch are walked side by side, byte by
byte: from every offset the tree gives the tokens that begin there, the automaton says which of them its state has an arc
for, and their ends take the arc's label and state. As one path is accepted for each prefix, every offset is reached by
one arc, and nothing is tried twice. The labels read back from a word's end are its tokens. Decoding emits the labels'
bytes.

The automaton is compiled once, by the driver, and goes to the workers as a few arrays: no worker reads the vocabulary. Of a
batch, a worker keeps the numbers of its words and not the words, and works through blocks of words of one size at most.

Defined results: null text is empty; empty text has no tokens; lone surrogates can't occur in Spark strings. Repeated rows
each get their row; kept columns with an output's name are replaced by it, further columns are not read. A word of any
length is walked in time linear in it (times the longest token).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import table

#: Pre-split pattern of the vocabulary (fixed value, public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts that have no character of ODD, where re's classes agree with \p{L}, \p{N} and White_Space.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ſ–—‘-„…€]")
SPLIT, SPLIT_ODD = re.compile(PLAIN).findall, regex.compile(PATTERN).findall
#: Words that a worker remembers; it forgets all when there are more, and at the end of a task.
CACHE = 150_000
#: Words up to so many bytes are walked side by side, longer ones alone.
SIDE_BY_SIDE = 64
#: Words that are walked side by side at a time, and words whose tokens are written out at a time (of one text at least).
BLOCK, WRITTEN = 8_192, 32_768
TOKEN_BITS = 17
NONE, UNKNOWN = -1, -2  # no arc; no entry
ROOT, END = 0, 256  # of the tree of tokens: its root, and the symbol that ends a word
OUTPUTS = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable Latin-1 stands for itself, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _has_arc(last: int, token: int, left: list[int], right: list[int], made: list[int], gadgets: dict[int, int]) -> bool:
    """Automaton.compiled() of one pair, while the automaton is made."""
    limit = 1 << 30
    while gadgets.get(last << TOKEN_BITS | token, limit) >= limit:
        if made[last] > made[token]:
            limit, last = made[last], right[last]
        elif made[token] < 0:
            return True
        else:
            limit, token = made[token] + 1, left[token]
    return False


class Table:
    """Open-addressed map from keys to whole numbers, read and written by whole arrays."""

    def __init__(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, UNKNOWN, np.int32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; UNKNOWN where there is none."""
        slot = self._slots(keys)
        out, there = self.values[slot], self.keys[slot]
        at = np.flatnonzero((there != keys) & (there >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            out[at], there = self.values[slot[at]], self.keys[slot[at]]
            at = at[(there != keys[at]) & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        if self.used + len(keys) > self.mask // 2:
            self.keys[:], self.values[:], self.used = -1, UNKNOWN, 0
        if len(keys) > self.mask // 2:
            keys, values = keys[: self.mask // 2], values[: self.mask // 2]
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & self.mask


def filled(entries: dict[int, int]) -> Table:
    t = Table(max(4, len(entries).bit_length() + 2))
    t.put(np.fromiter(entries.keys(), np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries)))
    return t


class Labels:
    """Byte strings laid end to end, to be written out for arrays of their numbers."""

    def __init__(self, labels: list[bytes]) -> None:
        self.size = np.array([len(x) for x in labels], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(labels), np.uint8)

    def emit(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The labels of ids in a row, and where each ends, after a zero."""
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[ids] - ends[:-1], size)
        at += np.arange(len(at))
        return self.data[at].tobytes(), ends


class Automaton:
    def __init__(self, spec: dict) -> None:
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        if size > 1 << TOKEN_BITS:
            raise ValueError(f"{size} tokens; at most {1 << TOKEN_BITS} fit the tables' keys")
        labels = [b""] * size
        left, right, made, target = [-1] * size, [-1] * size, [-1] * size, [0] * size
        parent, removed, born = [0], [-1], [-1]
        alive = set()
        for word, t in vocab.items():
            if word not in self.specials:
                labels[t] = bytes(letters[c] for c in word)
                if len(word) == 1:
                    alive.add(t)
        for content, t in self.specials.items():
            labels[t] = content.encode()
        gadgets: dict[int, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            ab = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            if a not in alive or b not in alive or ab in alive or not _has_arc(a, b, left, right, made, gadgets):
                continue
            parent.append(target[a])
            removed.append(b)
            born.append(k)
            # ab leads where b led from the old target of a; with a == b that is that target itself
            target[ab] = target[b]
            target[a] = len(parent) - 1
            left[ab], right[ab], made[ab] = a, b, k
            gadgets[a << TOKEN_BITS | b] = k
            alive.add(ab)
        self.left, self.right, self.made, self.target = (np.array(x, np.int32) for x in (left, right, made, target))
        self.parent, self.removed, self.born = (np.array(x, np.int32) for x in (parent, removed, born))
        self.gadgets = filled(gadgets)
        self.owner = np.zeros(len(parent), np.int32)  # a token that leads to the state
        self.owner[self.target[sorted(alive)]] = sorted(alive)
        self._tree({labels[t]: t for t in alive})
        self.arcs = Table(20)
        self.sizes = np.array([len(x) for x in labels], np.int64)
        self.bytes_of, self.digits_of = Labels(labels), Labels([b"%d," % t for t in range(size)])
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def __getstate__(self) -> dict:
        """All but the entries compiled so far: a worker makes its own."""
        return {k: v for k, v in vars(self).items() if k != "arcs"}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state, arcs=Table(20))

    def _tree(self, tokens: dict[bytes, int]) -> None:
        """Transitions over bytes: node and byte to node, and the token that a node ends (or NONE)."""
        step: dict[int, int] = {}
        ends = [NONE]
        for word, t in tokens.items():
            node = ROOT
            for byte in word:
                node = step.setdefault(node << 9 | byte, len(ends))
                if node == len(ends):
                    ends.append(NONE)
            ends[node] = t
        self.steps, self.ends = filled(step), np.array(ends, np.int32)
        self.first = self.steps.get(np.arange(END + 1))  # the root's

    def arc(self, state: int, token: int) -> bool:
        """Whether state has an arc for token, by the chain of copies that made the state."""
        while state:
            if self.made[token] >= self.born[state]:
                token = self.left[token]  # came after this state, wherever its left part had an arc
            elif token == self.removed[state]:
                return False
            else:
                state = self.parent[state]
        return True

    def compiled(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The states that arcs lead to, or NONE, as arc() would tell but without its chains.

        A state's ancestors were made by gadgets (x, b) with x from its owner's chain of right parts, each while x was the
        newest of the chain; so only gadgets of those x with parts of the token's left chain can have removed the arc."""
        out = self.target[tokens]
        at = np.flatnonzero(states > 0)
        last, token = self.owner[states[at]].astype(np.int64), tokens[at].astype(np.int64)
        limit = np.full(len(at), 1 << 30)
        while len(at):
            k = self.gadgets.get(last << TOKEN_BITS | token)
            gone = (k >= 0) & (k < limit)
            out[at[gone]] = NONE
            newer, older = self.made[last], self.made[token]
            back = newer > older
            going = ~gone & (back | (older >= 0))
            limit = np.where(back, newer, older + 1)[going]
            last, token, at = np.where(back, self.right[last], last)[going], np.where(back, token, self.left[token])[going], at[going]
        return out

    def reached(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The transition table: state and token to state, or NONE."""
        keys = states.astype(np.int64) << TOKEN_BITS | tokens
        out = self.arcs.get(keys)
        at = np.flatnonzero(out == UNKNOWN)
        if len(at):
            new, back = np.unique(keys[at], return_inverse=True)
            to = self.compiled(new >> TOKEN_BITS, new & (1 << TOKEN_BITS) - 1)
            self.arcs.put(new, to)
            out[at] = to[back]
        return out

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the words, end to end, and their number in each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        long = int(np.searchsorted(-size[order], -SIDE_BY_SIDE, "left"))
        alone = [np.array(self.path(words[i]), np.int32) for i in order[:long]]
        blocks = [self._side_by_side([words[i] for i in order[at : at + BLOCK]]) for at in range(long, len(words), BLOCK)]
        counts = np.concatenate((np.array([len(x) for x in alone], np.int64), *(n for _, n in blocks)))
        tokens = np.concatenate((np.zeros(0, np.int32), *alone, *(x for x, _ in blocks)))
        start = np.cumsum(counts) - counts
        given, back = np.empty_like(counts), np.empty_like(start)
        given[order], back[order] = counts, start
        return tokens[tv.positions(back, back + given)], given

    def _side_by_side(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """paths() of words that go from the longest to the shortest."""
        n = len(words)
        if not n or not words[0]:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        size = np.fromiter(map(len, words), np.int64, n)
        symbols = np.frombuffer(b"\0".join([*words, b""]), np.uint8).astype(np.int64)
        start = np.cumsum(size + 1) - size - 1
        symbols[start + size] = END
        label = np.full((int(size[0]) + 1, n), NONE, np.int32)  # of the arc that reaches each offset
        state = np.zeros((int(size[0]) + 1, n), np.int32)
        for offset in range(int(size[0])):
            who = np.arange(int(np.searchsorted(-size, -offset, "left")))
            node = self.first[symbols[start[who] + offset]]
            end = offset
            while True:
                keep = node >= 0
                who, node = who[keep], node[keep]
                if not len(who):
                    break
                end += 1
                token = self.ends[node]
                some = np.flatnonzero(token >= 0)
                at, token = who[some], token[some]
                to = self.reached(state[offset, at], token) if offset else self.target[token]
                there = to >= 0
                at = at[there]
                label[end, at], state[end, at] = token[there], to[there]
                node = self.steps.get(node.astype(np.int64) << 9 | symbols[start[who] + end])
        counts = np.zeros(n, np.int64)
        read: list[tuple[np.ndarray, np.ndarray]] = []
        who = np.flatnonzero(size)
        at = size[who]
        while len(who):
            token = label[at, who]
            read.append((who, token))
            counts[who] += 1
            at = at - self.sizes[token]
            who, at = who[at > 0], at[at > 0]
        last = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int32)
        for back, (who, token) in enumerate(read):
            out[last[who] - 1 - back] = token
        return out, counts

    def _tokens_from(self, symbols: np.ndarray, first: int, last: int) -> list[list[tuple[int, int]]]:
        """The tokens that begin at each offset from first to before last, as (end, token), shorter ones first."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(first, last)]
        at = np.arange(first, last)
        end, node = at + 1, self.first[symbols[first:last]]
        while len(at):
            token = self.ends[node]
            some = np.flatnonzero((node >= 0) & (token >= 0))
            for i, to, t in zip((at[some] - first).tolist(), end[some].tolist(), token[some].tolist(), strict=True):
                found[i].append((to, t))
            keep = np.flatnonzero((node >= 0) & (end < len(symbols)))
            at, end = at[keep], end[keep]
            node, end = self.steps.get(node[keep].astype(np.int64) << 9 | symbols[end]), end + 1
        return found

    def path(self, word: bytes) -> list[int]:
        """The tokens of one word of any length, by the same tables."""
        label, state = [NONE] * (len(word) + 1), [0] * (len(word) + 1)
        known: dict[tuple[int, int], int] = {}
        symbols = np.frombuffer(word, np.uint8).astype(np.int64)
        for offset in range(len(word)):
            if offset % BLOCK == 0:
                begun = self._tokens_from(symbols, offset, min(offset + BLOCK, len(word)))
            here, found = state[offset], begun[offset % BLOCK]
            if new := [t for _, t in found if (here, t) not in known]:
                states = np.full(len(new), here, np.int64)
                tokens = np.array(new, np.int64)
                known |= zip([(here, t) for t in new], (self.reached(states, tokens) if offset else self.target[tokens]).tolist(), strict=True)
            for end, token in found:
                if (to := known[here, token]) >= 0:
                    label[end], state[end] = token, to
            if len(known) > CACHE:
                known.clear()
        out, at = [], len(word)
        while at:
            out.append(label[at])
            at -= int(self.sizes[label[at]])
        return out[::-1]

    def pieces(self, text: str) -> list[str | tuple[str]]:
        """The pre-split words of text; an added token is a tuple of its own."""
        if self.special and any(s in text for s in self.specials):
            parts = enumerate(self.special.split(text))
            return [y for k, x in parts for y in ([(x,)] if k % 2 else (SPLIT_ODD if ODD.search(x) else SPLIT)(x))]
        return (SPLIT_ODD if ODD.search(text) else SPLIT)(text)

    def encode(self, text: str) -> list[int]:
        known = Known(self)
        return known.encode([known.numbers(self.pieces(text))])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of.emit(np.array(ids, np.int64))[0].decode("utf-8", "replace")


class Known:
    """What a worker remembers: the tokens of words."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.forget()

    def forget(self) -> None:
        self.place: dict[str | tuple[str], int] = {}
        self.new: list[str | tuple[str]] = []  # have a number, but no tokens yet
        self.tokens = np.zeros(0, np.int32)  # of all words, end to end
        self.ends = np.zeros(1, np.int64)  # of each word's tokens, after a zero

    def numbers(self, pieces: list[str | tuple[str]]) -> np.ndarray:
        """The numbers of a text's words; new words get the next ones."""
        new = set(pieces).difference(self.place)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.new += new
        return np.fromiter(map(self.place.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        """Encode the words that are new."""
        a, new, self.new = self.automaton, self.new, []
        added = np.fromiter((type(x) is tuple for x in new), bool, len(new))
        tokens, counts = a.paths([x.encode() for x in new if type(x) is str])
        upto = np.ones(len(new), np.int64)
        upto[~added] = counts
        upto = np.cumsum(upto)
        out = np.empty(int(upto[-1]) if len(new) else 0, np.int32)
        out[tv.positions(upto[~added] - counts, upto[~added])] = tokens
        out[upto[added] - 1] = [a.specials[x[0]] for x in new if type(x) is tuple]
        self.ends = np.concatenate((self.ends, self.ends[-1] + upto))
        self.tokens = np.concatenate((self.tokens, out))

    def encode(self, texts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """The tokens of texts, given by the numbers of their words, end to end, and where each text's end."""
        if self.new:
            self.learn()
        at = np.concatenate(texts)
        first, last = self.ends[at], self.ends[at + 1]
        upto = np.concatenate(([0], np.cumsum(last - first)))
        return self.tokens[tv.positions(first, last)], upto[np.cumsum([len(x) for x in texts])].tolist()


def blocks(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts in a row that have WRITTEN words at most, or one text."""
    some, words = [], 0
    for x in texts:
        if some and words + len(x) > WRITTEN:
            yield some
            some, words = [], 0
        some.append(x)
        words += len(x)
    if some:
        yield some


def encode_decode(df: DataFrame, tokenizer_json: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """The columns keep, n_tokens, and digests of ids and decoded text; with ids also the ids and the decoded text.

    tokenizer_json is the file's content, read by the caller: executors need no local file."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(Automaton(json.loads(tokenizer_json)))
    made = OUTPUTS if ids else OUTPUTS[:3]
    keep = tuple(c for c in keep if c not in made)
    src = df.select(*keep, df[text].alias("__text"))
    n_keep = len(keep)
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    schema = T.StructType([*src.schema.fields[:n_keep], *(T.StructField(c, kinds.get(c, T.StringType())) for c in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, sha = sent.value, hashlib.sha256
        known = Known(a)
        for batch in batches:
            for part in tv.sliced(batch, n_keep, 2_000_000):
                if len(known.place) > CACHE:
                    known.forget()
                texts = [known.numbers(a.pieces(x.as_py() or "")) for x in part.column(n_keep)]
                out: list[list] = [[], [], [], [], []]
                for some in blocks(texts):
                    tokens, ends = known.encode(some)
                    lines, line_at = a.digits_of.emit(tokens)
                    labels, label_at = a.bytes_of.emit(tokens)
                    for i, j in zip([0, *ends], ends, strict=False):
                        decoded = labels[label_at[i] : label_at[j]].decode("utf-8", "replace")
                        out[0].append(j - i)
                        out[1].append(sha(lines[line_at[i] : max(line_at[i], line_at[j] - 1)]).hexdigest())
                        out[2].append(sha(decoded.encode()).hexdigest())
                        if ids:
                            out[3].append(tokens[i:j])
                            out[4].append(decoded)
                types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(x, kind) for x, kind in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], *columns[: len(made)]], names=[*keep, *made])
    return src.mapInArrow(run, schema)


def vocabulary(path: str | None = None) -> str:
    """Content of a tokenizer file; by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())
