"""Byte-level BPE with the tokenizers library inside Spark tasks, plus exact token counts of every prefix.

Encoding. A text is cut at single spaces between two non-blank characters. There every byte-level pattern ends
one match and starts the next, so the ids of a text are the ids of its pieces in order. Each worker process keeps
the ids of pieces it has met; the library computes the ids of new ones. Texts that hold an added token's string,
and vocabularies of another kind, go to the library whole.

Prefix counts. BPE has one valid encoding per string, and it is the one whose adjacent token pairs are all valid.
So the last token of every prefix follows from shorter prefixes: it is the token that ends there and forms a valid
pair with the last token before it. One pass gives the count at every byte, in time linear in the text.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import accumulate, repeat

import numpy as np

#: Pieces that one worker process keeps.
MEMO = 500_000
#: Bytes of the longest match whose prefixes are counted together with others.
LOCKSTEP = 32
#: Fixed value: the byte-level pretokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that often follow a word.
_STOPS = ",.;:!?"
#: ASCII marks; a run of them behind a word is one match. An apostrophe may begin another.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_RISKS = tuple(x for b in _BLANKS for x in dict.fromkeys((f" {b}", f"{b} ")))
#: A text that begins or ends with a space or has one beside another blank is cut by _CUT, others at every space.
_ODD = "^ | $|" + "|".join(f" [{x}]|[{x}] " for x in [_BLANKS])
#: A line end that begins or ends the text or has a blank beside it.
_LINES = "^\n|\n$|" + "|".join(f"\n[{x}]|[{x}]\n" for x in [_BLANKS])
_LATIN = re.compile("[\0-\u024f]*").fullmatch
_BEYOND_LATIN = "[^\0-\u024f]"
#: Blanks and what follows them.
_RUNS = re.compile(r"([\t-\r \x85\xa0  -     　]*)([^\t-\r \x85\xa0  -     　]*)")
_ASCII_RISKS = tuple(x for x in _RISKS if x.isascii())


def pieces_of(text: str) -> list[str]:
    """Cut at single spaces between non-blank characters; those spaces are dropped and belong to the next piece."""
    if text[:1] == " " or text[-1:] == " " or any(x in text for x in (_ASCII_RISKS if text.isascii() else _RISKS)):
        return _CUT.split(text)
    return text.split(" ")


def _spaced(piece: str) -> str:
    """A piece with its space; one that begins with a line end has none."""
    return piece if piece[:1] == "\n" else " " + piece


def _listed(strings) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


@functools.cache
def byte_characters() -> str:
    """The character that stands for each byte: printable Latin-1 itself, the others from 256 upwards in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


def to_characters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(byte_characters())


class Bpe:
    """A byte-level BPE of the tokenizers library with a bounded store of known pieces."""

    def __init__(self, tokenizer, exact_pattern: bool):
        import pyarrow as pa
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.model._resize_cache(0)  # each piece is computed once here
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self.exact_pattern = exact_pattern
        self.find = regex.compile(PATTERN).findall
        self.split = Tokenizer(self.model)
        self.split.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.known: dict[str, bytes] = {}
        #: Matches that stand inside a piece, without a space before them.
        self.own: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        #: Latin words that stand after a space, and their ids, row by row.
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        #: What stands for each byte in the text given to `split`; byte 255 parts matches.
        self.characters = np.array([ord(x) for x in byte_characters()[:255] + " "], "<u4")
        self.counts = PrefixCounts(self)
        #: Pieces that this one keeps.
        self.memo = MEMO

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each id."""
        out = np.zeros(self.tokenizer.get_vocab_size(), "i8")
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)
        return out

    def learn(self, pieces: list[str]) -> None:
        """Let the library encode new pieces, each after its space.

        Latin pieces are taken as the pattern's matches, so a word before a mark or a line end is encoded once; others
        (where versions of Unicode may differ) go to the library with its own pretokenizer.
        """
        known, own = self.known, self.own
        if len(known) + len(own) > self.memo:
            known.clear()
            own.clear()
        latin = pieces if _LATIN("".join(pieces)) else [p for p in pieces if _LATIN(p)]
        words = {p for p in latin if p.isalpha()}
        marked, parts = [], {}
        for p in latin:
            if p not in words:
                word = p.rstrip(_STOPS)
                if word.isalpha():
                    marked.append((p, word, p[len(word) :]))
                else:
                    parts[p] = self.find(_spaced(p))
        met = {m for x in parts.values() for m in x}
        words.update(m[1:] for m in met if m[0] == " ")
        words.update([w for _, w, _ in marked])
        spaced = [*words.difference(known)]
        alone = [*({m for m in met if m[0] != " "} | {m for *_, m in marked}).difference(own)]
        raw = self._matches([*(" " + x for x in spaced), *alone])
        if raw is None:
            latin = []
        else:
            known.update(zip(spaced, raw))
            own.update(zip(alone, raw[len(spaced) :]))
            known.update([(p, known[w] + own[m]) for p, w, m in marked])
            known.update([(p, b"".join([known[m[1:]] if m[0] == " " else own[m] for m in x])) for p, x in parts.items()])
        if len(latin) < len(pieces):
            rest = [p for p in pieces if p not in known]
            known.update(zip(rest, self.wholes([_spaced(p) for p in rest])))

    def _matches(self, matches: list[str]) -> list[bytes] | None:
        """Ids of single matches of the pattern, given to the model in one call; None if its tokens do not cover them."""
        if not matches:
            return []
        raw = [m.encode() for m in matches]
        found = self._parted(b"\xff".join(raw), np.fromiter(map(len, raw), "i8", len(raw)))
        if found is None:
            return None
        made, cuts = found[0].tobytes(), found[1].tolist()
        return [made[i:j] for i, j in zip(cuts, cuts[1:])]

    def _parted(self, raw: bytes | memoryview, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of matches (joined by byte 255, which is in no UTF-8 text) and the bytes at which each match's ids begin."""
        text = self.characters[np.frombuffer(raw, "u1")].tobytes().decode("utf-32-le")
        ids = np.array(self.split.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends, want = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        at = np.searchsorted(ends, want)
        if not len(ends) or ends[-1] != want[-1] or (ends[at] != want).any():
            return None
        return ids, np.concatenate(([0], at + 1)) * self.dtype.itemsize

    def wholes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the library gives them, in one call."""
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian, self.dtype each.

        Pieces are split and told apart by Arrow, so a batch looks up each distinct piece once.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[bytes] = [b""] * len(texts)
        if not self.exact_pattern:
            for i, raw in enumerate(self.wholes(texts)):
                out[i] = raw
            return out
        column = pa.array(texts, pa.large_string())
        special = np.zeros(len(texts), bool)
        for x in self.added:
            special |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False) & ~special
        whole = np.flatnonzero(special).tolist()
        for i, raw in zip(whole, self.wholes([texts[i] for i in whole])):
            out[i] = raw
        full = np.fromiter(map(len, texts), "i8", len(texts)) > 0
        # where each line end stands between characters that are not blank, pieces also begin there
        lined = ~pc.match_substring_regex(column, _LINES).to_numpy(zero_copy_only=False)
        plain = full & ~odd & ~special
        for rows, lists in ((np.flatnonzero(plain & lined), lambda x: pc.split_pattern(pc.replace_substring(x, "\n", " \n"), " ")), (np.flatnonzero(plain & ~lined), lambda x: pc.split_pattern(x, " ")), (np.flatnonzero(odd & full), lambda x: pa.array([_CUT.split(t) for t in x.to_pylist()], pa.large_list(pa.large_string())))):
            if len(rows):
                for i, raw in zip(rows.tolist(), self._joined(lists(column.take(pa.array(rows))))):
                    out[i] = raw
        return out

    def _joined(self, lists) -> list[bytes]:
        """Ids of texts given as their pieces; the first piece of a text has no space before it."""
        import pyarrow as pa

        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        told = lists.flatten().dictionary_encode()
        index, heads = told.indices.to_numpy().astype("i4"), offsets[:-1]
        first = _listed(told.dictionary.take(pa.array(index[heads])))
        inner = np.ones(len(index), bool)
        inner[heads] = False
        used = np.zeros(len(told.dictionary), bool)  # pieces that are only heads need no ids here
        used[index[inner]] = True
        index = (np.cumsum(used, dtype="i4") - 1)[index]
        index[heads] = np.count_nonzero(used) + np.arange(len(heads))
        ids = pa.concat_arrays([self._ids_of(told.dictionary.filter(pa.array(used))), pa.array(self.starts(first), pa.large_binary())])
        made = ids.take(pa.array(index))
        ends, raw = np.frombuffer(made.buffers()[1], "i8", len(made) + 1), memoryview(made.buffers()[2] or b"")
        cuts = ends[offsets].tolist()
        return [raw[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]

    def _ids_of(self, pieces):
        """Ids of distinct pieces, each after its space (or beginning with a line end), as one Arrow array.

        A Latin word and the marks behind it are two matches of the pattern. Words are looked up by columns and the new
        ones given to the model together; other pieces go through `known`, one by one.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        word = pc.utf8_rtrim(pieces, _MARKS)
        bare = pc.if_else(pc.starts_with(word, "\n"), pc.utf8_slice_codeunits(word, 1), word)
        plain = pc.and_(pc.utf8_is_alpha(bare), pc.invert(pc.match_substring_regex(word, _BEYOND_LATIN)))
        at = pc.index_in(word, value_set=self.words)
        new = word.filter(pc.and_(plain, pc.is_null(at))).unique()
        if len(self.words) + len(new) > self.memo:
            self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
            at, new = pa.nulls(len(word), pa.int32()), word.filter(plain).unique()
        if len(new):
            base = len(self.words)
            self.word_ids = pa.concat_arrays([self.word_ids, self._word_ids(new)])
            self.words = pa.concat_arrays([self.words, new])
            at = pc.coalesce(at, pc.add(pc.index_in(word, value_set=new), pa.scalar(base, pa.int32())))
        plain = plain.to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(plain & (pc.binary_length(word).to_numpy() < pc.binary_length(pieces).to_numpy()))
        rows = pa.array(marked)
        tails = [p[len(w) :] for p, w in zip(_listed(pieces.take(rows)), _listed(word.take(rows)))]
        ends: list[bytes] = [b""] * len(pieces)
        for i, x in zip(marked.tolist(), self._own_ids(tails)):
            ends[i] = x
        odd = np.flatnonzero(~plain)
        others = _listed(pieces.take(pa.array(odd)))
        self.learn_new(others)
        for i, p in zip(odd.tolist(), others):
            ends[i] = self.known[p]
        begins = pc.fill_null(self.word_ids.take(pc.if_else(pa.array(plain), at, pa.scalar(None, pa.int32()))), b"")
        return pc.binary_join_element_wise(begins, pa.array(ends, pa.large_binary()), pa.scalar(b"", pa.large_binary()))

    def _word_ids(self, words):
        """Ids of words, each after a space or a line end that it begins with."""
        import pyarrow as pa
        import pyarrow.compute as pc

        line = pc.starts_with(words, "\n")
        raw = pc.replace_substring(words.cast(pa.large_binary()), b"\n", b"\n\xff")  # two matches
        space, end, none = (pa.scalar(x, pa.large_binary()) for x in (b" ", b"\xff", b""))
        laid = pc.binary_join_element_wise(pc.if_else(line, none, space), raw, end, none)
        found = self._parted(memoryview(laid.buffers()[2])[:-1], pc.binary_length(words).to_numpy() + ~line.to_numpy(zero_copy_only=False))
        if found is None:
            return pa.array(self.wholes([_spaced(w) for w in _listed(words)]), pa.large_binary())
        ids, cuts = found
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])

    def _own_ids(self, matches: list[str]) -> list[bytes]:
        """Ids of matches without a space before them."""
        own = self.own
        if new := {*matches}.difference(own):
            if len(own) > self.memo:
                own.clear()
                new = {*matches}
            new = [*new]
            own.update(zip(new, self._matches(new) or self.wholes(new)))
        return [own[m] for m in matches]

    def learn_new(self, pieces: list[str]) -> None:
        """Learn those of the pieces that are not known; all of them are known then."""
        if new := [p for p in pieces if p not in self.known]:
            if len(self.known) + len(self.own) > self.memo:  # `learn` empties the store
                new = pieces
            self.learn(new)

    def learn_counts(self, texts: list[str]) -> None:
        """Learn the pieces that a batch needs, in one call of the library."""
        pieces = {p for x in texts if x for p in pieces_of(x)[1:]}
        if len(self.known) + len(pieces) > self.memo:
            self.known.clear()
        if new := pieces.difference(self.known):
            self.learn([*new])

    def piece_counts(self, pieces: list[str]) -> list[int]:
        """Token counts of a text's pieces."""
        head, *rest = pieces
        missing = [p for p in rest if p not in self.known]
        if missing:
            if len(self.known) > self.memo:
                self.known.clear()
                missing = rest
            self.learn([*dict.fromkeys(missing)])
        step = self.dtype.itemsize
        return [len(self.start(head)) // step, *(n // step for n in map(len, map(self.known.__getitem__, rest)))]

    def starts(self, heads: list[str]) -> list[bytes]:
        """Ids of texts' first pieces."""
        found = [*map(self.first.get, heads)]
        if None in found:
            if len(self.first) > self.memo // 8:
                self.first.clear()
            new = [*dict.fromkeys(h for h, x in zip(heads, found) if x is None)]
            made = dict(zip(new, self.wholes(new)))
            self.first.update(made)
            found = [made[h] if x is None else x for h, x in zip(heads, found)]
        return found

    def start(self, head: str) -> bytes:
        return self.starts([head])[0]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """Bytes of each id, by the reversed byte table; added tokens as they are written."""
        back = {c: b for b, c in enumerate(byte_characters())}
        added = {i: x.content for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            token = self.tokenizer.id_to_token(i)
            out.append(added[i].encode() if i in added else bytes(back[c] for c in token) if token is not None else b"")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id's bytes start, and the end."""
        return np.concatenate(([0], np.cumsum([len(self.token_bytes[i]) for i in ids.tolist()], dtype="i8"))).astype("i8")


def _steps(counts: list[int]) -> bytes:
    """Changes from each count to the next, from 0 on, one signed byte each."""
    return bytes([b - a & 255 for a, b in zip([0, *counts], counts)])


class Trie:
    """The vocabulary as a table: row and byte give the next node; nodes with children come first, as the rows."""

    def __init__(self, vocab: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_characters())}
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for text, i in vocab.items():
            node = 0
            for c in text:
                step = back.get(c, -1)
                after = children[node].get(step)
                if after is None:
                    after = children[node][step] = len(children)
                    children.append({})
                    token.append(-1)
                node = after
            token[node] = i
        inner = [i for i, x in enumerate(children) if x]
        rank = np.full(len(children), -1, "i4")
        order = inner + [i for i, x in enumerate(children) if not x]
        rank[order] = np.arange(len(children))
        self.token = np.array(token, "i4")[order]
        self.rows = len(inner)
        self.next = np.full((self.rows, 256), -1, "i4")
        for i in inner:
            for step, after in children[i].items():
                if step >= 0:
                    self.next[rank[i], step] = rank[after]

    def ids(self, raw: np.ndarray, longest: int) -> np.ndarray:
        """For texts of one length (rows of bytes): at [k - 1, start, text] the id of the k bytes from start on, or -1."""
        many, size = raw.shape
        depth = min(longest, size)
        out = np.full((depth, size, many), -1, "i4")
        raw = np.ascontiguousarray(raw.T)
        start, text = np.divmod(np.arange(size * many), many)
        node = np.zeros(len(start), "i4")
        for k in range(depth):
            node = self.next[node, raw[start + k, text]]
            on = node >= 0
            start, text, node = start[on], text[on], node[on]
            out[k, start, text] = self.token[node]
            on = (node < self.rows) & (start + k + 1 < size)
            start, text, node = start[on], text[on], node[on]
        return out


class PrefixCounts:
    """Changes of the token count from one code-point prefix to the next, by dynamic programming."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.vocab = bpe.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocab))
        self.states: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tails: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.done: dict[str, bytes] = {}
        self.valid_ids: dict[int, bool] = {}

    @functools.cached_property
    def trie(self) -> Trie:
        return Trie(self.vocab)

    @functools.cached_property
    def names(self) -> list[str]:
        out = [""] * (max(self.vocab.values()) + 1)
        for token, i in self.vocab.items():
            out[i] = token
        return out

    def many(self, matches: list[str]) -> list[bytes]:
        """Changes over each match (of at most LOCKSTEP bytes), all matches of one length together.

        The recurrence of `match`, step by step for all: the last token of a prefix is the longest one that ends there and
        makes a valid pair with the last token before it.
        """
        out: list[bytes] = [b""] * len(matches)
        raw = [m.encode() for m in matches]
        sizes = np.fromiter(map(len, raw), "i8", len(raw))
        order = np.argsort(sizes, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            for at in range(0, len(places), 1 << 14):
                part = places[at : at + (1 << 14)].tolist()
                if part and raw[part[0]]:
                    for i, x in zip(part, self._lockstep(np.frombuffer(b"".join([raw[i] for i in part]), "u1").reshape(len(part), -1))):
                        out[i] = x
        return out

    def _lockstep(self, raw: np.ndarray) -> list[bytes]:
        many, size = raw.shape
        ids = self.trie.ids(raw, self.longest)
        base = len(self.names)
        last = np.full((size + 1, many), -1, "i8")
        count = np.zeros((size + 1, many), "i4")
        for end in range(1, size + 1):
            open_ = np.arange(many)
            for k in range(min(end, len(ids)), 0, -1):
                token = ids[k - 1, end - k, open_]
                found = np.flatnonzero(token >= 0)
                if not len(found):
                    continue
                at, token = open_[found], token[found].astype("i8")
                ok = self._valid((last[end - k, at] + 1) * base + token)
                at, token = at[ok], token[ok]
                last[end, at] = token
                count[end, at] = count[end - k, at] + 1
                keep = np.ones(len(open_), bool)
                keep[found[ok]] = False
                open_ = open_[keep]
                if not len(open_):
                    break
        ends = np.ones((many, size), bool)
        ends[:, :-1] = raw[:, 1:] & 0xC0 != 0x80
        flat = count[1:].T[ends]
        cuts = np.concatenate(([0], np.cumsum(ends.sum(1))))
        before = np.concatenate(([0], flat[:-1]))
        before[cuts[:-1]] = 0
        made = (flat - before).astype("i1").tobytes()
        cuts = cuts.tolist()
        return [made[i:j] for i, j in zip(cuts, cuts[1:])]

    def _valid(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs of ids, (first + 1) * vocabulary + second, stay as they are; the first may be none (-1)."""
        known = self.valid_ids
        if len(known) > 2 * MEMO:
            known.clear()
        asked = keys.tolist()
        seen = np.fromiter(map(known.get, asked, repeat(2)), "i1", len(asked))
        missing = np.flatnonzero(seen == 2)
        if len(missing):
            tokenize, names, base = self.bpe.model.tokenize, self.names, len(self.names)
            for key in np.unique(keys[missing]).tolist():
                a, b = divmod(key, base)
                first = names[a - 1] if a else ""
                known[key] = [t.id for t in tokenize(first + names[b])] == ([a - 1, b] if a else [b])
            seen[missing] = [known[asked[i]] for i in missing.tolist()]
        return seen == 1

    def learn(self, texts: list[str]) -> None:
        """Changes of all new pieces of a batch, so that `changes` finds them."""
        known = self.known
        if len(known) > MEMO:
            known.clear()
        heads, pieces = set(), set()
        for x in texts:
            if x:
                head, *rest = pieces_of(x)
                heads.add(head)
                pieces.update(rest)
        pieces.difference_update(known)
        self.done.clear()
        words, marked, other = [], [], []
        for p in pieces:
            if p.isalpha():
                words.append(p)
            else:
                word = p.rstrip(_STOPS)
                (marked if word.isalpha() else other).append(p)
        met = {m for p in other for m in self.find_all(" " + p)}
        met.update(m for h in heads for m in self.find_all(h))
        words = [*{*words, *(p.rstrip(_STOPS) for p in marked)}.difference(known)]
        met = [m for m in met if 3 < len(m) <= LOCKSTEP and len(m.encode()) <= LOCKSTEP]
        short = [w for w in words if len(w.encode()) < LOCKSTEP]
        made = self.many([*(" " + w for w in short), *met])
        known.update(zip(short, made))
        self.done.update(zip(met, made[len(short) :]))
        for p in (*words, *marked, *other):
            if p not in known:
                known[p] = self.piece(p)

    def find_all(self, text: str) -> list[str]:
        """Matches that `plain` will ask for, but for blanks."""
        out = []
        for run in _RUNS.finditer(text):
            blank, word = run.groups()
            if word:
                out += self.bpe.find((" " if blank.endswith(" ") else "") + word)
        return out

    def valid(self, a: str, b: str) -> bool:
        """Whether the library leaves tokens a and b next to each other as they are (a may be empty)."""
        if len(self.pairs) > 2 * MEMO:
            self.pairs.clear()
        ok = self.pairs[a, b] = [t.value for t in self.bpe.model.tokenize(a + b)] == ([a, b] if a else [b])
        return ok

    def match(self, text: str) -> list[int]:
        """Token counts of the code-point prefixes of one match of the pattern, from 1 character up."""
        done = self.done.get(text)
        if done is not None:
            return [*accumulate(memoryview(done).cast("b"))]
        raw = text.encode()
        s = to_characters(raw)
        vocab, pairs, states = self.vocab, self.pairs, self.states
        short = len(s) <= 32  # prefixes of common words are kept, those of long runs are not
        if short and len(states) > 2 * MEMO:
            states.clear()
        last, count = [""], [0]
        longest = self.longest
        for end in range(1, len(s) + 1):
            state = states.get(s[:end]) if short else None
            if state is None:
                for start in range(end - longest if end > longest else 0, end):
                    token = s[start:end]
                    if token in vocab:
                        before = last[start]
                        ok = pairs.get((before, token))
                        if self.valid(before, token) if ok is None else ok:
                            state = token, count[start] + 1
                            break
                if short:
                    states[s[:end]] = state
            last.append(state[0])
            count.append(state[1])
        if len(s) == len(text):
            return count[1:]
        return [count[i] for i in range(1, len(s) + 1) if i == len(s) or raw[i] & 0xC0 != 0x80]

    def plain(self, text: str) -> bytes:
        """Changes for a text or piece without added tokens, one signed byte per code point."""
        out: list[int] = []
        base = 0
        if text[:1] == " " and text[1:].split() == [text[1:]]:
            for match in [text] if text[1:].isalpha() else self.bpe.find(text):
                at = self.match(match)
                if match in ("'re", "'ve", "'ll"):
                    at[1] = self.match("'")[-1] + self.match(match[1])[-1]
                out += [base + c for c in at] if base else at
                base += at[-1]
            return _steps(out)
        for run in _RUNS.finditer(text):
            blank, word = run.groups()
            if blank:
                out += [base + c for c in self.match(blank)]  # a cut here leaves the blanks as one match
            if word:
                lead = " " if blank.endswith(" ") else ""
                if len(blank) > 1:
                    base += self.match(blank[:-1])[-1]
                if blank and not lead:
                    base += self.match(blank[-1])[-1]
                for match in self.bpe.find(lead + word):
                    at = self.match(match)
                    if match in ("'re", "'ve", "'ll"):  # cut short they are two matches
                        at[1] = self.match("'")[-1] + self.match(match[1])[-1]
                    out += [base + c for c in at[len(lead):]]
                    base += at[-1]
                    lead = ""
            elif blank:
                base = out[-1]
        return _steps(out)

    def piece(self, p: str) -> bytes:
        """Changes of a piece and the space before it; marks after letters are a match of their own."""
        word = p.rstrip(_STOPS)
        if len(word) == len(p) or not word.isalpha():
            return self.plain(" " + p)
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self.plain(" " + word)
        mark = p[len(word) :]
        tail = self.tails.get(mark)
        if tail is None:
            if len(self.tails) > MEMO // 8:
                self.tails.clear()
            tail = self.tails[mark] = _steps(self.match(mark))
        return found + tail

    def changes(self, text: str) -> bytes:
        """Changes over a whole text: the running sum at i is the token count of the first i + 1 code points."""
        for special in self.bpe.added:
            if special in text:
                parts = text.split(special)
                out = []
                for part in parts[:-1]:
                    within = np.frombuffer(self.changes(part + special[:-1]), "i1")
                    own = int(within[: len(part)].sum(dtype="i8"))
                    close = own + 1 - int(within.sum(dtype="i8"))
                    out += [within.tobytes(), np.array([close], "i1").tobytes()]
                return b"".join([*out, self.changes(parts[-1])])
        if not text:
            return b""
        head, *rest = pieces_of(text)
        known = self.known
        found = [*map(known.get, rest)]
        if None in found:
            if len(known) > MEMO:
                known.clear()
            for i, x in enumerate(found):
                if x is None:
                    p = rest[i]
                    x = known.get(p)
                    if x is None:
                        x = known[p] = self.piece(p)
                    found[i] = x
        return self.plain(head) + b"".join(found)


@functools.lru_cache(4)
def load_json(path: str) -> Bpe:
    """A tokenizers file; pieces are used only where its pretokenizer is the plain byte-level one."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
    out = Bpe(Tokenizer.from_file(path), plain)
    out.tokenizer.no_truncation()
    out.tokenizer.no_padding()
    return out


@functools.lru_cache(4)
def load_ranks(path: str) -> Bpe:
    """A rank file as a tokenizers BPE: any two tokens whose joined bytes are a token merge, lowest rank first."""
    import base64

    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {to_characters(base64.b64decode(a)): int(b) for a, b in map(bytes.split, f)}
    merges = [(t[:i], t[i:]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab=ranks, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return Bpe(tokenizer, True)
