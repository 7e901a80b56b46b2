import zlib

import numpy as np
import pyarrow as pa
from tidewire.llm import textkit as tk
from tidewire.llm.langid import PIECE, Model, automaton, identify, symbols, train
from tidewire.llm.queries import op1_cross_parsing_language


def test_automaton_holds_just_the_substrings():
    text = np.array([1, 2, 1, 1, 3, 2, 1, 2, 3, 1])
    table = automaton(text, 4)
    inside = {tuple(text[a:b]) for a in range(10) for b in range(a + 1, 11)}
    for n in range(1, 5):
        for k in range(3**n):
            word, state = [(k // 3**i) % 3 + 1 for i in range(n)], 1
            for c in word:
                state = table[state, c]
                if not state:
                    break
            assert bool(state) == (tuple(word) in inside)


def test_phrases_equal_greedy_parse():
    rng = np.random.default_rng(0)
    texts = {k: rng.integers(1, 6, 300).astype(np.uint8) for k in ("a", "b")}
    model = Model.of(texts)
    s = rng.integers(1, 8, 900).astype(np.uint8)
    offsets = np.array([0, 5, 5, 700, 900])
    got = model.phrases(s, offsets)
    for k, (name, text) in enumerate(texts.items()):
        ref = bytes(text)
        for r in range(4):
            n = 0
            for lo in range(offsets[r], offsets[r + 1], PIECE):
                piece, i = bytes(s[lo : min(lo + PIECE, offsets[r + 1])]), 0
                while i < len(piece):
                    j = i + 1
                    while j < len(piece) and piece[i : j + 1] in ref:
                        j += 1
                    n, i = n + 1, j
            assert got[k, r] == n, name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_cross_parsing_language(spark, sf).collect()
    assert len(rows) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "123 — €!", "en"), (None, "der hund", None), (6, "the " * 30000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, train(docs, "false")).collect()}
    assert got[1][0] == got[6][0] == "en" and got[2][0] == got[None][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert {r.lang_pred for r in identify(docs, train(docs.where("false"))).collect()} == {"und"}
    assert symbols(*tk.utf8(pa.array(["ÀB  c!", None])))[1].tolist() == [0, 6, 6]
