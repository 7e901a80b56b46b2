import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidewire.llm import tokens
from tidewire.llm.cutting import filled, knapsack, patterns, plan
from tidewire.llm.packing import CAPACITY, Layout, packed
from tidewire.llm.queries import op12_cutting_stock_packing, table
from tidewire.llm.tokens import Encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def held(rows, capacity=CAPACITY):
    """Each sequence's pieces, gapless from 0, at most the capacity long; the number of padded tokens."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert sorted(by) == list(range(len(by)))
    return padding


def test_the_query_against_each_text(spark, plain):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: plain(r.text) + [1] for r in table(spark, sf, "documents").collect()}
    rows = op12_cutting_stock_packing(spark, sf).collect()
    assert held(rows) == 0
    at = defaultdict(list)
    for r in rows:
        ids = docs[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id].append((r.start, r.length))
    assert set(at) == set(docs)
    for doc_id, parts in at.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == len(docs[doc_id])
    cut = sum(len(p) > -(-len(docs[d]) // CAPACITY) for d, p in at.items())
    assert cut < 0.05 * len(docs)  # all others are cut only where they are longer than a sequence


def test_sequences_hold_the_ids(spark, plain):
    texts = ["alpha beta " * 40, None, "", "gamma", "delta epsilon zeta " * 300, "eta"] * 3 + ["  \n odd\t\u0085 spaces ² Ⅷ ʰ 中文 <|endoftext|> 'll \U0001f600 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("length", "start", "ids", "piece", "n", "h", "tie")})
    p = packed(docs, Path(PATH).read_text(), end=1, capacity=64)
    rows = p.pieces.collect()
    assert held(rows, 64) == 0
    ids = {i: plain(t) + [1] for i, t in enumerate(texts)}
    whole = {s.sequence_id: np.frombuffer(s.ids, "<u4").tolist() for s in p.sequences().collect()}
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length]


def test_odd_tables(spark):
    text = Path(PATH).read_text()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packed(empty, text, 1).pieces.count() == 0
    same = spark.createDataFrame([(None, None)] * 5000 + [(7, "x " * 1400)] * 30, "doc_id long, text string")
    rows = packed(same, text, 1).pieces.collect()
    assert held(rows) == 0 and sum(r.length for r in rows) == 5000 + sum(r.length for r in rows if r.doc_id == 7)


def test_encoder_equals_plain_encoding(plain):
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "\r\n", "1", "²", "½", "'s", "'LL", "_", "-", "…", "語", "ж", "Ω", " ", " ", "\x1c", "\x85", "́", "‍", "Ⅷ", "😀", "ǅ", "ª", "Ā"]
    texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 60]))) for _ in range(3000)] + ["x" * 5000, " " * 5000]
    encode = Encoder(Path(PATH).read_text())
    assert encode.by_words and sum(not encode.other.search(t) for t in texts) > 300
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == plain(text), repr(text)


def test_words_of_a_block_are_looked_up_once_each(plain, monkeypatch):
    looked, find = [], tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda values, known: looked.append(len(values)) or find(values, known))
    encode = Encoder(Path(PATH).read_text())
    texts = ["alpha beta, gamma. " * 500 + "end", "beta,  gamma. alpha\n" * 500] * 5
    for _ in range(2):
        assert [x.tolist() for x in encode(texts)] == [plain(t) for t in texts]
    assert 0 < sum(looked) < 60  # of 30,000 words


def test_encoder_of_arrow_texts_in_small_blocks(plain, monkeypatch):
    """Null texts, slices, blocks of a few texts, and stretches forgotten and met again."""
    monkeypatch.setattr(tokens, "BLOCK", 200)
    monkeypatch.setattr(tokens, "KNOWN", 30)
    monkeypatch.setattr(tokens, "TOGETHER", 3)
    monkeypatch.setattr(tokens, "BYTES", 1500)
    monkeypatch.setattr(tokens, "FEW", 0.1)
    rng = random.Random(5)
    words = ["de", "la", "été", "x.\ny", "", "", "\n", "\t", "naïve", "It's", "12", "the", "!!", "Ⅷ", "\x01", "\x00", "語語", "w" * 300]
    texts = [None, "", " ", "  ", "\n", " \n "] + [rng.choice([" ", ""]) + " ".join(rng.choices([*words, *(f"n{i}" for i in range(50))], k=rng.choice([1, 2, 9, 40]))) for _ in range(800)] + [None]
    encode = Encoder(Path(PATH).read_text())
    for kind in (pa.string(), pa.large_string()):
        held = pa.array(["before", *texts, "after"], kind).slice(1, len(texts))
        for text, ids in zip(texts, encode(held), strict=True):
            assert ids.tolist() == plain(text), repr(text)
    assert encode.round > 50 and len(encode.known.stretches) < 400
    assert list(encode([])) == []


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, t = Encoder(Path(path).read_text()), Tokenizer.from_file(path)
    texts = ["One  Two\nthree", "", "naïve café 12"]
    assert not encode.by_words and [x.tolist() for x in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_patterns_fill_sequences_within_demand():
    rng = np.random.default_rng(4)
    for n, capacity in [(40, 64), (400, 256), (5000, 256), (50000, 2048)]:
        lengths = 1 + rng.lognormal(np.log(capacity / 5), 0.8, n).astype(int) % (capacity - 1)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        found, left = plan(histogram, capacity)
        used = defaultdict(int, left)
        for copies, times in found:
            assert times > 0 and sum(x * k for x, k in copies.items()) == capacity
            for x, k in copies.items():
                used[x] += k * times
        assert used == histogram
        if n >= 5000:  # enough of each length to complete the others
            assert sum(x * k for x, k in left.items()) <= 0.02 * lengths.sum()


def test_the_program_comes_near_its_optimum():
    """Two of 3 and one of 4, or five of 2, fill 10: the optimum is known."""
    found = patterns(np.array([2, 3, 4]), np.array([50, 40, 20]), 10)
    assert abs(sum(x for _, x in found) - 30) < 0.1
    least, choice = knapsack(np.array([3, 5]), np.array([0.3, 0.4]), 11)
    assert np.isinf(least[[1, 2, 4, 7]]).all() and abs(least[11] - 1.0) < 1e-12 and choice[7] == -1  # 3 + 3 + 5


def test_exact_filling_against_all_choices():
    rng = random.Random(9)
    for _ in range(200):
        left = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(5)}
        before = dict(left)
        found = filled(left, 20)
        for copies, times in found:
            assert sum(x * k for x, k in copies.items()) == 20 and times > 0
        for x in before:
            assert before[x] == left[x] + sum(c.get(x, 0) * t for c, t in found)
        sums = {0}
        for x, n in left.items():
            for _ in range(n):
                sums |= {s + x for s in sums}
        assert 20 not in sums


def test_layout_without_patterns():
    layout = Layout({1500: 10}, 2048)
    parts = [p for rank in range(10) for p in layout.cut(1500, rank)]
    assert sum(p[1] for p in parts) == 15000 and max(p[2] for p in parts) == 7 + (15000 % 2048).bit_count() - 1
