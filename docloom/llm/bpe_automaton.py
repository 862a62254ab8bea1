"""Byte-pair encoding and decoding by a tokenisation automaton.

The merges of a vocabulary are compiled, in their order, into a deterministic automaton over tokens: its paths are exactly the
token sequences that byte-pair encoding gives. It starts with one arc from every symbol to every symbol. The gadget of a merge u v
then takes the v arc out of the state that u arcs lead to, and adds an arc uv to every state that has a u arc, leading
to a copy of the state behind v. All arcs of one label lead to one state, so a state is named by its label, and the automaton
is a bit matrix (state, label) in words of 64 labels, where both steps of a gadget are copies of short runs: 49k merges take some
two seconds and 92 MB, once in a Python worker. (Where u = v, ``uuu`` is ``uu u``: the state behind u gets no arc uu.)

A word is encoded by moving through the table: every prefix of a word has one encoding, so from the state in which a place
is reached, each label that the text goes on with and the table allows reaches its end; the labels on the way to the end of the word
are its tokens. Time is linear in the length of a word. The labels that a text goes on with are found in a second table, a
tree of all beginnings of labels by bytes. All words of one length, of letters that normalising leaves alone, move through both tables in step,
as numpy arrays; other words move on their own. Decoding emits the labels of the arcs.

Texts are normalised and cut into words as the vocabulary's file says; marks such as ``<|endoftext|>`` in a text are ids of their
own. Words are encoded once for each slice of a batch, so no state beyond the bounded memory of a worker grows, and a lost task is run again with the
same result. Defined results: a null or empty text has no tokens (its joined ids and its decoded text are empty); repeated
rows and rows of equal id are encoded on their own; an empty table gives an empty result; other columns
pass through, whatever their names (those added here start with ``_``). To decode, null ids are a null text, and an id
outside the vocabulary is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import vocab
from docloom.llm.columns import worker_state
from docloom.llm.textscan import slices, spread_out

#: The first place of a word: its state has every arc.
ANYTHING = -1


class Automaton:
    """The states and arcs that a list of merges makes of single symbols."""

    def __init__(self, symbols: list[str], merges: Sequence[Sequence[str]], end: str = ""):
        """``end``: the suffix of labels that end a word; nothing follows them, so they have no state."""
        labels = [*symbols, *(u + v for u, v in merges)]
        self.number = {label: i for i, label in enumerate(labels)}
        if len(self.number) != len(labels):
            raise ValueError("two merges make the same token")
        closed = [bool(end) and label.endswith(end) for label in labels]
        self.state: dict[str, int] = {}
        for label, last in zip(labels, closed, strict=True):
            if not last:
                self.state[label] = len(self.state)
        words = -(-len(labels) // 64)
        arcs = np.zeros((words, len(self.state)), np.uint64)
        begin, states = len(symbols), sum(not c for c in closed[: len(symbols)])
        for i in range(begin):
            arcs[i >> 6, :states] |= np.uint64(1 << (i & 63))
        for k, (u, v) in enumerate(merges):
            states = self._gadget(arcs, u, v, begin + k, closed[begin + k], states)
        self.labels = labels
        # Bit ``bit[x]`` of byte ``8 * state + base[x]`` says whether the state has the arc x.
        number = np.arange(len(labels))
        self.arcs = arcs.astype("<u8", copy=False).reshape(-1).view(np.uint8)
        self.bases, self.bits = (number >> 6) * arcs.shape[1] * 8 + ((number >> 3) & 7), (number & 7).astype(np.uint8)
        self.rows = np.array([8 * self.state.get(label, 0) for label in labels])
        self.base, self.bit, self.row, self.table = self.bases.tolist(), self.bits.tolist(), self.rows.tolist(), memoryview(self.arcs)
        # Every beginning of a label, with the label's number if it is one.
        self.heads: dict[str, int] = {}
        for label, i in self.number.items():
            for n in range(1, len(label)):
                self.heads.setdefault(label[:n], -1)
            self.heads[label] = i
        self.end = end

    def _gadget(self, arcs: np.ndarray, u: str, v: str, new: int, closed: bool, states: int) -> int:
        iu, iv, left, right = self.number[u], self.number[v], self.state.get(u), self.state.get(v)
        if max(iu, iv) >= new or left is None:
            raise ValueError(f"the merge of {u!r} and {v!r} comes before one of them")
        one, place = np.uint64(1), np.uint64(new & 63)
        if not (arcs[iv >> 6, left] >> np.uint64(iv & 63)) & one:
            return states + (not closed)  # earlier merges never leave u before v; nothing leads to the label
        # The arc uv wherever there is an arc u.
        has = (arcs[iu >> 6, :states] >> np.uint64(iu & 63)) & one
        if iu == iv:
            has[left] = 0
        arcs[new >> 6, :states] |= has << place
        if not closed:
            # Behind uv goes on what goes on behind v.
            arcs[:, states] = arcs[:, right]
            if iu == iv:
                arcs[new >> 6, states] |= one << place
            states += 1
        # Behind u, v is gone.
        arcs[iv >> 6, left] &= ~(one << np.uint64(iv & 63))
        return states

    def allows(self, before: int, label: int) -> bool:
        """Whether the state behind the label ``before`` has an arc ``label``."""
        return bool(before == ANYTHING or (self.table[self.row[before] + self.base[label]] >> self.bit[label]) & 1)

    def path(self, word: str) -> list[int]:
        """The numbers of a word's labels; the word's last symbol gets the suffix that ends words."""
        heads, row, base, bit, table = self.heads, self.row, self.base, self.bit, self.table
        n = len(word)
        reached: list[int] = [ANYTHING] * (n + 1)  # the label that ends at each place
        origin = [0] * (n + 1)
        whole = word + self.end
        for i in range(n):
            before = reached[i]
            at = row[before] if i else 0
            for j in range(i + 1, n + 1):
                label = heads.get(word[i:j] if j < n else whole[i:])
                if label is None:
                    break
                if label >= 0 and (not i or (table[at + base[label]] >> bit[label]) & 1):
                    reached[j], origin[j] = label, i
        labels: list[int] = []
        while n:
            labels.append(reached[n])
            n = origin[n]
        return labels[::-1]


class Tree:
    """The beginnings of labels of bytes: from a node and a byte to a node, and the labels that end at a node."""

    def __init__(self, automaton: Automaton, byte_of: dict[str, int], letters: bytes):
        """``byte_of``: the byte of a symbol; ``letters``: the bytes of the words that are looked up here."""
        column = {b: i for i, b in enumerate(letters)}
        self.column = np.zeros(256, np.int64)
        self.column[list(letters)] = range(len(letters))
        nodes: dict[tuple[int, int], int] = {}
        open_label, last_label = [-1], [-1]
        for label, number in automaton.number.items():
            last = bool(automaton.end) and label.endswith(automaton.end)
            at = 0
            for symbol in label.removesuffix(automaton.end) if last else label:
                byte = column.get(byte_of[symbol])
                if byte is None:
                    break
                following = nodes.get((at, byte))
                if following is None:
                    following = nodes[at, byte] = len(open_label)
                    open_label.append(-1)
                    last_label.append(-1)
                at = following
            else:
                (last_label if last else open_label)[at] = number
        self.inner, self.last = np.array(open_label), np.array(last_label if automaton.end else open_label)
        self.child = np.zeros((len(open_label), len(letters)), np.int32)  # 0: no label goes on like that
        if nodes:
            pairs = np.array(list(nodes))
            self.child[pairs[:, 0], pairs[:, 1]] = list(nodes.values())
        self.automaton = automaton

    def paths(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of equal length, a row of bytes each: the label that ends at each place of a word's path, -1 for none; and how many."""
        own, (n, length) = self.automaton, words.shape
        words = self.column[words]
        reached = np.full((n, length + 1), -1)
        origin = np.zeros((n, length + 1), np.int64)
        for i in range(length):
            # All words go on from place i; a word leaves when no label goes on as it does.
            word, node = np.arange(n), np.zeros(n, np.int64)
            state = own.rows[reached[:, i]]
            for j in range(i, length):
                node = self.child[node, words[word, j]]
                alive = node > 0
                if not alive.all():
                    word, node = word[alive], node[alive]
                if not len(word):
                    break
                label = (self.last if j + 1 == length else self.inner)[node]
                there = np.flatnonzero(label >= 0)
                label, at = label[there], word[there]
                if i:
                    allowed = (own.arcs[state[at] + own.bases[label]] >> own.bits[label]) & 1
                    allowed = np.flatnonzero(allowed)
                    label, at = label[allowed], at[allowed]
                reached[at, j + 1], origin[at, j + 1] = label, i
        on_path = np.zeros((n, length + 1), bool)
        at, word = np.full(n, length), np.arange(n)
        while len(word):
            on_path[word, at] = True
            at = origin[word, at]
            left = at > 0
            word, at = word[left], at[left]
        return np.where(on_path, reached, -1)[:, 1:], on_path.sum(1)


#: Letters that lower-casing and composing leave alone: a-z and, as two bytes, the small ones of U+00DF to U+00FF.
SMALL, LEAD = bytes(range(0x61, 0x7B)), 0xC3
SECOND = bytes(b for b in range(0x9F, 0xC0) if b != 0xB7)
#: Longer words move on their own, and this many at most move in step.
LONGEST, IN_STEP = 40, 20_000


class Codec:
    """A vocabulary file as an automaton, with the file's own rules of cutting texts into words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies that decode to their joined tokens are known")
        self.normalizer, self.cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        with open(path, encoding="utf-8") as file:  # installed on every machine with the library
            told = json.load(file)
        model = told["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {u + v for u, v in merges}
        symbols = sorted((s for s in model["vocab"] if s not in made), key=model["vocab"].get)
        self.automaton = Automaton(symbols, merges, model.get("end_of_word_suffix") or "")
        self.id_of = np.array([model["vocab"][label] for label in self.automaton.labels], np.uint16)
        marks = told.get("added_tokens", [])
        if any(m["normalized"] or m["lstrip"] or m["rstrip"] or m["single_word"] for m in marks):
            raise ValueError("only marks that are looked for as they are are known")
        self.marks = {m["content"]: m["id"] for m in marks}
        self.mark = re.compile("|".join(sorted(map(re.escape, self.marks), key=len, reverse=True)) or r"(?!)")
        names = {i: s for s, i in (model["vocab"] | self.marks).items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.decimals = [str(i) for i in range(len(self.names))]
        byte_of = _byte_level()
        self.latin = {ord(c): b for c, b in byte_of.items() if ord(c) != b}
        self.tree = Tree(self.automaton, byte_of, SMALL + bytes([LEAD]) + SECOND)
        self.plain = np.zeros(256, bool)
        self.plain[list(SMALL + bytes([LEAD]) + SECOND)] = True

    def cut(self, text: str) -> list[str | int]:
        """The words of a text, in the characters that stand for bytes, and the ids of its marks."""
        words: list[str | int] = []
        at = 0
        for found in [*self.mark.finditer(text), None]:
            part = text[at : found.start() if found else len(text)]
            if part:
                normal = self.normalizer.normalize_str(part) if self.normalizer else part
                words += [word for word, _ in self.cutter.pre_tokenize_str(normal)]
            if found:
                words.append(self.marks[found[0]])
                at = found.end()
        return words

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self.cut(text):
            ids += [word] if isinstance(word, int) else self.id_of[self.automaton.path(word)].tolist()
        return ids

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words ``data[start:end]``, those that can move in step: which, their ids one after the other, and how many each has."""
        # A second byte that follows another lead belongs to another letter.
        good = self.plain[data]
        if len(data) > 1:
            good[1:] &= (data[1:] < 0x80) | (data[1:] == LEAD) | (data[:-1] == LEAD)
        bad = np.append(0, np.cumsum(~good))
        length = ends - starts
        simple = (length > 0) & (length <= LONGEST) & (bad[ends] == bad[starts])
        which, ids, lengths = [np.empty(0, np.int64)], [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for size in np.unique(length[simple]).tolist():
            every = np.flatnonzero(simple & (length == size))
            for k in range(0, len(every), IN_STEP):
                some = every[k : k + IN_STEP]
                labels, n = self.tree.paths(data[starts[some][:, None] + np.arange(size)])
                which.append(some)
                ids.append(self.id_of[labels[labels >= 0]])
                lengths.append(n)
        return np.concatenate(which), np.concatenate(ids), np.concatenate(lengths)

    def encode_others(self, texts: list[str]) -> list[list[int]]:
        """Texts that are not one simple word: cut first; their distinct words that can move in step do."""
        cut = [self.cut(text) for text in texts]
        words = list({w for own in cut for w in own if not isinstance(w, int)})
        raw = [w.translate(self.latin).encode("latin-1") for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        which, ids, n = self.encode_words(np.frombuffer(b"".join(raw), np.uint8), np.append(0, ends)[:-1], ends)
        known: dict[str | int, list[int]] = {i: [i] for i in self.marks.values()}
        flat, at = ids.tolist(), np.cumsum(n).tolist()
        for word, size, end in zip(which.tolist(), n.tolist(), at, strict=True):
            known[words[word]] = flat[end - size : end]
        for word in words:
            if word not in known:
                known[word] = self.id_of[self.automaton.path(word)].tolist()
        return [[i for w in own for i in known[w]] for own in cut]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.append(0, ends)[:-1]
        if len(data):
            first = data[np.minimum(starts, len(data) - 1)]
            starts = np.minimum(starts + ((first == 0x20) | (first == 0x0A)), ends)
        which, ids, n = self.encode_words(data, starts, ends)
        lengths = np.zeros(len(pieces), np.int64)
        lengths[which] = n
        simple = np.zeros(len(pieces), bool)
        simple[which] = True
        others = np.flatnonzero(~simple)
        found = self.encode_others([pieces[i].decode() for i in others.tolist()])
        lengths[others] = [len(own) for own in found]
        flat = np.empty(int(lengths.sum()), np.uint16)
        begins = np.cumsum(lengths) - lengths
        flat[spread_out(begins[which], n)] = ids
        flat[spread_out(begins[others], lengths[others])] = [i for own in found for i in own]
        return flat, lengths

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise ValueError("an id below zero")
        return " ".join(map(self.names.__getitem__, ids))

    def joined(self, ids: list[int]) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))


def _byte_level() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printing characters of Latin-1 stand for themselves, the others
    follow from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def codec(path: str) -> Codec:
    """The worker's automaton of a vocabulary, compiled when it is first asked for."""
    state = worker_state()
    if getattr(state, "codec", (None,))[0] != path:
        state.codec = path, Codec(path)
    return state.codec[1]


#: Columns that ``encode`` can add.
OUTPUTS = {
    "_n_tokens": T.LongType(), "_ids": T.ArrayType(T.IntegerType()), "_id_text": T.StringType(), "_decoded": T.StringType(),
}


def encode(
    docs: DataFrame, text_column: str = "text", vocabulary: str | None = None, add: Sequence[str] = ("_n_tokens", "_ids"),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns ``add``: _n_tokens, _ids, _id_text (decimal ids, joined by a space) and
    _decoded (the tokens' labels, joined as the vocabulary's decoding does)."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    kept = list(docs.columns if keep is None else keep)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").alias("_to_encode"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        memory = vocab.remembered("bpe_automaton", path, lambda _: own.encode_pieces)
        kinds = {"_n_tokens": pa.int64(), "_ids": pa.list_(pa.int32()), "_id_text": pa.string(), "_decoded": pa.string()}
        for batch in batches:
            for rows, data, offsets in slices(batch, "_to_encode"):
                ids, at = vocab.encode_caseless(data, offsets, memory)
                out: dict[str, list | np.ndarray] = {c: [] for c in add}
                if "_n_tokens" in out:
                    out["_n_tokens"] = np.diff(at)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if "_ids" in out:
                        out["_ids"].append(ids[a:b].astype(np.int32))
                    if "_id_text" in out or "_decoded" in out:
                        numbers = ids[a:b].tolist()
                        if "_id_text" in out:
                            out["_id_text"].append(own.joined(numbers))
                        if "_decoded" in out:
                            out["_decoded"].append(own.decode(numbers))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-1], *[pa.array(out[c], kinds[c]) for c in add]], names=[*kept, *add]
                )

    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(c, OUTPUTS[c]) for c in add]])
    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_column: str = "_ids", vocabulary: str | None = None) -> DataFrame:
    """``tokens`` with _decoded, the text of the array of ids."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    columns = tokens.columns
    place = columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "_decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("_decoded", T.StringType())]))
