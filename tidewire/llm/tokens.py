"""Token ids of texts by a public tokenizer file, many words at a time."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that every Unicode version classes alike; a text with any other is encoded whole.
PLAIN = r"\t\n\r\x20-\x7e\xa1-ɏΑ-ΡЀ-ҁぁ-ゖァ-ヺ一-龥"
#: Stretches that a worker remembers, and their bytes; beyond either, the half that was met last is kept.
KNOWN, BYTES = 1 << 20, 1 << 24
#: Fewer stretches than this share of those remembered are encoded, not looked up: that takes less time.
FEW = 1 / 40
#: Bytes encoded at once, and stretches in one text when new ones are encoded.
BLOCK, TOGETHER = 1 << 23, 256
#: A space before white space does not begin a word (PLAIN has no other white space).
ODD, WORD = "[ ](?:[ \n\t\r]|$)", r" ([^ \n\t\r])"
#: Stands for the spaces that begin words in texts that have others too. PLAIN lacks it.
SPACE = "\1"
#: Marks the stretch at the start of a text, which no space precedes. PLAIN lacks it.
START = "\0"


class _Ids:
    """Ids of stretches of text, end to end, and the round in which each was met last."""

    def __init__(self) -> None:
        self.stretches = pa.array([], pa.string())
        self.flat, self.first, self.count, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, stretches: pa.Array, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Where the new ``stretches`` are."""
        before = len(self.stretches)
        self.stretches = pa.concat_arrays([self.stretches, stretches])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count, self.flat = np.concatenate([self.count, count.astype(np.int32)]), np.concatenate([self.flat, flat])
        self.met = np.concatenate([self.met, np.zeros(len(count), np.int32)])
        return np.arange(before, len(self.stretches))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the stretches ``at``, and how many each has."""
        count = self.count[at].astype(np.int64)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        return self.flat[np.arange(total) + np.repeat(self.first[at] - upto + count, count)], count

    def shrunk(self) -> _Ids:
        """Those met last: half of KNOWN and of BYTES at most."""
        last = np.argsort(-self.met, kind="stable")[: KNOWN // 2]
        sizes = pc.binary_length(self.stretches).to_numpy()[last].astype(np.int64)
        last = np.sort(last[np.cumsum(sizes) <= BYTES // 2])
        out = _Ids()
        out.add(self.stretches.take(pa.array(last)), *self.of(last))
        out.met = self.met[last]
        return out


class Encoder:
    """Ids of texts by a ``tokenizers`` file, given as its JSON; special tokens in a text are ordinary text.

    Byte-level BPE begins a word at every space that a character other than white
    space follows, so the stretches between such spaces have the same ids
    wherever they stand: Arrow splits a block of texts, its distinct stretches are
    looked up, and only new ones are encoded. Texts with characters whose class may
    differ between Unicode versions, and other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        kind = json.loads(definition)
        split = kind.get("pre_tokenizer") or {}
        self.by_words = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not kind.get("normalizer") and not (kind.get("model") or {}).get("dropout") and all(t["special"] for t in kind.get("added_tokens", []))
        self.other = re.compile(f"[^{PLAIN}]")
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.known, self.round = _Ids(), 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that do not begin with their only space, and how many each has."""
        ids = self._encoded([u[1:] if u.startswith(START) else f" {u}" for u in stretches.to_pylist()])
        return np.array([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, many in one text: each begins with its only space, and so with an id that does."""
        groups = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(stretches), TOGETHER), len(stretches)), pa.int32()), stretches)
        texts = pc.binary_join_element_wise("", pc.binary_join(groups, " "), " ").to_pylist()
        flat = np.concatenate([np.array(x, np.uint32) for x in self._encoded(texts)])
        begin = np.flatnonzero(self.opens[flat])
        return flat, np.diff(np.append(begin, len(flat)))

    def _words(self, texts: pa.Array, space: str) -> Iterator[np.ndarray]:
        """The ids of each of ``texts``, whose words begin at each ``space``."""
        if not len(texts):
            return
        split = pc.split_pattern(pc.binary_join_element_wise(START, texts, ""), space)
        coded = split.flatten().dictionary_encode()
        units = coded.dictionary
        if len(self.known.stretches) > KNOWN or self.known.stretches.nbytes > BYTES + 4 * KNOWN:
            self.known = self.known.shrunk()
        known = self.known if len(units) >= FEW * len(self.known.stretches) else _Ids()
        at = pc.index_in(units, known.stretches).fill_null(-1).to_numpy().astype(np.int64)
        alone = pc.or_(pc.starts_with(units, START), pc.match_substring(units, " ")).to_numpy(zero_copy_only=False)
        new = at < 0
        for some, ids in ((np.flatnonzero(new & alone), self._alone), (np.flatnonzero(new & ~alone), self._together)):
            if len(some):
                stretches = units.take(pa.array(some))
                at[some] = known.add(stretches, *ids(stretches))
        self.round += 1
        known.met[at] = self.round
        flat, count = known.of(at[coded.indices.to_numpy()])
        ends = np.append(0, np.cumsum(count))[np.cumsum(np.append(0, pc.list_value_length(split).to_numpy()))].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield flat[a:b]

    def __call__(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        upto = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy().astype(np.int64)))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BLOCK, "right")) - 1)
            block, lo = texts[lo:hi].cast(pa.string()), hi
            plain = pc.invert(pc.match_substring_regex(block, self.other.pattern)) if self.by_words else pa.repeat(False, len(block))
            odd = pc.match_substring_regex(block, ODD)
            kinds = np.where(plain.to_numpy(zero_copy_only=False), odd.to_numpy(zero_copy_only=False), 2)
            whole, quick, spaced = (block.filter(pa.array(kinds == k)) for k in (2, 0, 1))
            ids = (
                self._words(quick, " "),
                self._words(pc.replace_substring_regex(spaced, WORD, f"{SPACE}\\1"), SPACE),
                (np.array(x, np.uint32) for x in self._encoded(whole.to_pylist())),
            )
            for k in kinds.tolist():
                yield next(ids[k])


_loaded: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The encoder of a worker, kept for its later tasks with the words it has met."""
    key = hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(definition)
    return _loaded[key]
