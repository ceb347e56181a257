import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import WordIds, best_fit_plan, op2_best_fit, pack, packed_documents, ranked, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_one_by_one(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_piece_by_piece(seed):
    r = random.Random(seed)
    size = r.choice([7, 10, 32, 100])
    lengths = [r.randint(1, size) if r.random() < 0.7 else r.randint(1, max(1, size // 5)) for _ in range(r.choice([0, 1, 5, 300]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    seats, used = {}, {}
    for n, rank, count, first, each, offset in best_fit_plan(counts, size):
        for i in range(count):
            assert (n, rank + i) not in seats
            seats[n, rank + i] = (first + i // each, offset + i % each * n)
    assert len(seats) == len(lengths)
    for (n, _), (s, o) in seats.items():
        used.setdefault(s, []).append((o, n))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= size
    assert sorted(size - sum(n for _, n in spans) for spans in used.values()) == best_fit_one_by_one(lengths, size)


def test_word_ids_equal_the_tokenizer():
    t, words = Tokenizer.from_file(PATH), WordIds(PATH)
    texts = ["", "  ", "Hello, World!!  it's <|endoftext|> a<|startoftext|>b", "Crème BRÛLÉE ß÷× é İx ﬁ", "a\tb\x1cc d\r\ne", "123 4,5 ?!. ...", "a-b end-- (x) junk###$$$ Wow!!!! e_f f_ \"q\" don't. a$1", "日本語 テスト" * 50, "x" * 500, "ÀÉÿ. Ÿ. ªº µ"]
    for x in texts:
        assert np.frombuffer(words.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def check(rows, texts, size=2048):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for k, body in texts.items():
        ids = t.encode(body or "", add_special_tokens=False).ids + [0]
        got = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // size)))
        for r in got:
            cut = ids[r.piece * size : (r.piece + 1) * size]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * size, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    lengths = [r.length for rows in by_seq.values() for r in rows]
    assert len(by_seq) == len(best_fit_one_by_one(lengths, size))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    check(op2_best_fit(spark, d).collect(), texts)


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "one two", 4: "lorem ipsum " * 4000, 5: " \n", 6: "é " * 10}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, rank int")
    check(packed_documents(docs, PATH).collect(), texts)
    assert packed_documents(docs.where("doc_id = 99"), PATH).collect() == []
    ids = {r.doc_id: r.ids for r in token_pieces(docs.where("doc_id = 3"), PATH).collect()}
    assert ids[3] == Tokenizer.from_file(PATH).encode("one two", add_special_tokens=False).ids + [0]


def test_ranks_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, 0, 5)] * 7 + [(i, 0, 9) for i in range(50)], "doc_id long, piece int, length long")
    rows = ranked(df).collect()
    assert sorted(r.rank for r in rows if r.length == 5) == list(range(7))
    assert sorted(r.rank for r in rows if r.length == 9) == list(range(50))
    with pytest.raises(ValueError):
        pack(df, 8)
