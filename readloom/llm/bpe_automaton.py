"""Byte-level BPE as a deterministic automaton.

Compilation starts from one state that every byte's arc leaves and re-enters. The merges are applied in
order, each as a gadget: for the merge of u and v into w,
  * w gets an arc wherever u had one, and it leads where v led: a fork of the state after v;
  * the state after u is replaced by a copy without the arc v.
What remains are exactly the token sequences that merging yields, one for each string. States and
arcs that a gadget copies are kept as forks, (origin, time of the fork), so that compilation
takes constant time and memory for each merge.

Arcs are labelled with strings of bytes, so the automaton is then taken byte by byte: a state of
the byte automaton is the set of (state last reached, node of the labels' trie) that the bytes so
far allow. Exactly one of them is at a state's beginning, since a string has one token sequence; its
token is the state's output. Byte states are numbered, and a transition (state, byte) is a number in a table, worked
out when it is first taken. A word is encoded by one walk through the table, which gives the last
token of each prefix, and one walk back over the tokens' lengths. Decoding emits the labels of a path's arcs.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import Memo, kept, lean, texts

#: What a worker keeps: words and their ids, ids and their spelling, and states of the byte automaton.
WORDS, STATES = 400_000, 200_000
#: The white space of the pre-split pattern, written out.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: The same over texts of Latin-1 characters, where the classes are short: letters, numbers and white space.
L, N, S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Of a byte state's members the token last reached, none yet as 0, is above this many bits, the trie's node below.
NODE = 32


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable ones stand for themselves, the
    others take the next code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """merges: (left, right, result) token ids in order of merging; labels: bytes of each token."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        #: Arcs taken from the state after a token: {token: time}.
        self.removed: dict[int, dict[int, int]] = {}
        #: The state after a token began as a copy of that after another; its arc as a copy of another's.
        self.state_fork: dict[int, tuple[int, int]] = {}
        self.arc_fork: dict[int, tuple[int, int]] = {}
        self.dead: set[int] = set()
        for time, (u, v, w) in enumerate(merges):
            self.gadget(time, u, v, w)
        self.after: dict[int, list] = {}
        self.before: dict[int, list] = {}
        #: The trie of living tokens' labels: (node, byte) -> node, each node's token or -1, and whether it goes on.
        self.child: dict[int, int] = {}
        self.ends, self.inner = [-1], bytearray(1)
        for t, label in labels.items():
            if t not in self.dead:
                self.add_label(t, label)
        self.reset()
        self.memo = Memo(self.encode_word, words=WORDS)
        self.spelled = Memo(self.decode_ids, words=WORDS)

    def add_label(self, token: int, label: bytes) -> None:
        node = 0
        for byte in label:
            key = node << 8 | byte
            self.inner[node] = 1
            if key not in self.child:
                self.child[key] = len(self.ends)
                self.ends.append(-1)
                self.inner.append(0)
            node = self.child[key]
        self.ends[node] = token

    def reset(self) -> None:
        """The byte automaton with its first state alone."""
        self.members: list[tuple[int, ...]] = [(0,)]
        self.numbers = {(0,): 0}
        self.last = [-1]  # the token that ends at each state
        self.step: dict[int, int] = {}

    def gadget(self, time: int, u: int, v: int, w: int) -> None:
        """A merge whose two arcs never follow each other adds nothing: its token is on no path."""
        if w in self.arc_fork:
            raise ValueError("two merges make the same token")
        if u in self.dead or v in self.dead or not self.follows(self.path_of_states(u), self.path_of_arcs(v)):
            self.dead.add(w)
            return
        self.state_fork[w], self.arc_fork[w] = (v, time), (u, time)
        self.removed.setdefault(u, {})[v] = time

    def path_of_states(self, token: int) -> list[tuple[dict, int]]:
        """The states whose removals hold after a token, each with the time up to which."""
        until, path = 1 << 60, []
        while True:
            if token in self.removed:
                path.append((self.removed[token], until))
            if token not in self.state_fork:
                return path
            token, time = self.state_fork[token]
            until = min(until, time)

    def path_of_arcs(self, token: int) -> list[tuple[int, int]]:
        """The arcs whose removal also removes a token's arc, each with the time up to which."""
        until, path = 1 << 60, []
        while True:
            path.append((token, until))
            if token not in self.arc_fork:
                return path
            token, time = self.arc_fork[token]
            until = min(until, time)

    def leads(self, last: int, token: int) -> bool:
        """Whether the state after `last` has an arc `token`."""
        if last not in self.after:
            self.after[last] = self.path_of_states(last)
        if token not in self.before:
            self.before[token] = self.path_of_arcs(token)
        return self.follows(self.after[last], self.before[token])

    @staticmethod
    def follows(states: list[tuple[dict, int]], arcs: list[tuple[int, int]]) -> bool:
        """A state copied at a time has what was removed before it; an arc copied at a time shares what was removed up to it."""
        return not any(removed.get(arc, 1 << 61) < until and removed[arc] <= upto for removed, until in states for arc, upto in arcs)

    def transition(self, state: int, byte: int) -> int:
        """The byte state that a byte leads to, worked out from the states and arcs and put into the table. A full table is
        emptied first; the walk goes on from the state that it needs."""
        members, arrived = [], -1
        for m in self.members[state]:
            node = self.child.get((m & (1 << NODE) - 1) << 8 | byte)
            if node is None:
                continue
            t, before = self.ends[node], (m >> NODE) - 1
            if t >= 0 and (before < 0 or self.leads(before, t)):
                arrived = t
            if self.inner[node]:
                members.append(m >> NODE << NODE | node)
        if arrived < 0:
            raise ValueError("a byte has no token")
        members.append(arrived + 1 << NODE)
        members = tuple(members)
        if (to := self.numbers.get(members)) is None:
            if full := len(self.members) >= STATES:
                self.reset()
            to = self.numbers[members] = len(self.members)
            self.members.append(members)
            self.last.append(arrived)
            if full:
                return to
        self.step[state << 8 | byte] = to
        return to

    def tokens(self, word: bytes) -> list[int]:
        """The token sequence of a word: forward through the table, and back over the last tokens of its prefixes."""
        state, ends = 0, []
        for byte in word:
            to = self.step.get(state << 8 | byte)
            state = self.transition(state, byte) if to is None else to
            ends.append(self.last[state])
        out, at = [], len(word)
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= len(self.labels[t])
        out.reverse()
        return out

    def encode_word(self, word: str) -> str:
        """A word's ids, joined by commas."""
        return ",".join(map(str, self.tokens(word.encode())))

    def decode_ids(self, ids: str) -> bytes:
        labels = self.labels
        return b"".join([labels[int(t)] for t in ids.split(",")])


class ByteBpe:
    """A byte-level BPE tokenizer file: specials, pre-split and the automaton of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m, pre = spec["model"], spec["pre_tokenizer"]
        if m["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {w: i for w, i in m["vocab"].items() if w not in self.special}
        spell = lambda w: bytes(letters[c] for c in w)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in m["merges"]]
        self.automaton = Automaton({i: spell(w) for w, i in vocab.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.automaton.labels |= {i: w.encode() for w, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.words, self.latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall

    def encode(self, text: str) -> list[str]:
        """The ids of each word, joined by commas."""
        memo, out = self.automaton.memo, []
        for part in self.split(text) if any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(str(self.special[part]))
                continue
            try:
                part.encode("latin-1")
                words = self.latin(part)
            except UnicodeEncodeError:
                words = self.words(part)
            out += map(memo.__getitem__, words)
        return out

    def decode(self, words: list[str]) -> bytes:
        return b"".join(map(self.automaton.spelled.__getitem__, words))


@kept
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and, with keep_ids, ids array<int> and decoded
    string, for every row. Null and empty texts have no tokens; special strings inside a text
    become their token; repeated rows stay repeated; an empty table gives no rows; further columns of `df` don't
    matter, whatever their names. A text is held whole, its words one at a time. A narrow pass without a shuffle."""
    extra = ", ids array<int>, decoded string" if keep_ids else ""
    schema = f"id {df.schema[id_column].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"

    def run(batches):
        bpe, sha = tokenizer(path), hashlib.sha256
        for batch in lean(batches, keep=tokenizer):
            n, a, b, ids, back = [], [], [], [], []
            for text in texts(batch):
                words = bpe.encode(text)
                joined, raw = ",".join(words), bpe.decode(words)
                n.append(joined.count(",") + 1 if joined else 0)
                a.append(sha(joined.encode()).hexdigest())
                decoded = raw.decode("utf-8", "replace")
                b.append(sha(decoded.encode()).hexdigest())
                if keep_ids:
                    ids.append([int(t) for t in joined.split(",")] if joined else [])
                    back.append(decoded)
            bpe.automaton.memo.trim()
            bpe.automaton.spelled.trim()
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_column)
