"""Token ids against the plain library, with added tokens inside the texts."""
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import AddedToken, Tokenizer

from gridlens.llm import tokenbin

PATH = P.path("byte_bpe_50k.json")
END = "<|endoftext|>"


def _texts():
    rng = random.Random(5)
    pieces = [END, END, "<|endof", "text|>", " ", "  ", "\n", "a", "don't", " the", "é", "12", " ", "<|", "|>", "\x1c"]
    fixed = [END, END + END, f"a {END} b", f"one two{END}three four", f" {END}\n{END} ", f"it{END}'s", "<|endof text|>", "<|endoftext |>", ""]
    return fixed + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(300)]


def _same(path, texts):
    tok = Tokenizer.from_file(path)
    rows = list(tokenbin._encoded(enumerate(texts), path, None))
    assert [np.frombuffer(ids, "<u4").tolist() for _, ids in rows] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_texts():
    _same(PATH, _texts())


@pytest.mark.parametrize("token", [AddedToken("<x>", lstrip=True), AddedToken("<x>", rstrip=True), AddedToken("<x y>"),
                                   AddedToken("<x>", single_word=True), AddedToken(END + "!", special=True), AddedToken("the")])
def test_other_added_tokens(tmp_path, token):
    tok = Tokenizer.from_file(PATH)
    tok.add_tokens([token])
    tok.save(str(tmp_path / "t.json"))
    more = ["a  <x>  b", "a<x>b <x y> c", "<x y>", "of <x", "y> and", f"go {END}! {END} now", "then the other the"]
    _same(str(tmp_path / "t.json"), more + [" ".join(more)] + [t.replace("12", " <x> ") for t in _texts()])


def test_query_rows(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = tokenbin.read(spark, tokenbin.write(df, "doc_id", "text", PATH, end_id=2)).orderBy("doc").collect()
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert [r["start"] for r in got] == np.cumsum([0] + [len(w) for w in want[:-1]]).tolist()


def test_texts_of_plain_characters_by_pre_tokens():
    rng = random.Random(6)
    pieces = ["'", "'s", "'ll", "'LL", "can't", " ", "  ", "\n", "\r\n", "\t", "word", "Wörter", "naïve", "×", "µ", "ª", "12", "3",
              ".", ",", "$$", "…", "—", "слово", "и", "Ελλάς", "東京", "の", "한국", "。", "\u0301", "\u2028", "😀", "½", "\x00", "\xa0", "\x85"]
    few = pieces[:30]  # plain characters
    texts = ["".join(rng.choice(few if k % 2 else pieces) for _ in range(rng.randint(1, 40))) for k in range(600)]
    _same(PATH, texts + ["x" * 5000 + " y", "x" * 5000, " ", "\n\n ", "a \n", " a", "a  "])


def test_pre_tokens_are_encoded_once():
    lib, seen = tokenbin.Library(PATH), []
    plain = lib._library
    lib._library = lambda units: seen.extend(units) or plain(units)
    words = [f"{a}{b}" for a in ("grün", "blau", "rot", "gelb") for b in "qxyz"]
    texts = [" ".join(w + rng for w in words for rng in (",", ".", "!?", "\n\nund", "'s")) for _ in range(3)]
    tok = Tokenizer.from_file(PATH)
    for _ in range(2):
        got = lib.encode_many(texts)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) == len(set(seen)) <= len(words) + 10


def test_only_distinct_units_are_cut_into_pre_tokens(monkeypatch):
    class Cut:
        chars, pattern = 0, tokenbin._PIECES

        def findall(self, text):
            Cut.chars += len(text)
            return self.pattern.findall(text)

    monkeypatch.setattr(tokenbin, "_PIECES", Cut())
    lib, seen = tokenbin.Library(PATH), []
    plain = lib.pieces.tokenize
    lib.pieces.tokenize = lambda word: seen.append(word) or plain(word)
    words = [f"{a}{b}" for a in ("grün", "blau", "rot", "don't", "x1") for b in ("q", ",", "...", "!\n\nund", "\n", "\r\ny\n")]
    rng = random.Random(8)
    texts = [" ".join(rng.choices(words, k=200)) + "." for _ in range(50)]
    texts += ["", " ", "a", " a", "\na b", "\n a", " \na b", "x\n yz", "ends here\n", "one  two", "one \ntwo", "a "] + ["one\n\n two"] * 3
    tok = Tokenizer.from_file(PATH)
    got = lib.encode_many(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) == len(set(seen)) and Cut.chars < 2000 < sum(map(len, texts)) / 10
    assert lib.encode_many(["", ""]) == [b"", b""] and lib.encode_many([]) == []


def test_pre_tokens_in_two_generations(monkeypatch):
    monkeypatch.setattr(tokenbin, "KEPT", 5)
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["ab", "cd", "ef,", "grün", "東京", "g1", "hi", "x" * 70], k=9)) for _ in range(40)]
    lib, tok = tokenbin.Library(PATH), Tokenizer.from_file(PATH)
    got = [ids for t in texts for ids in lib.encode_many([t])]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(lib.pieces) <= 5 and len(lib.pieces.older) <= 5


@pytest.mark.parametrize("top", [0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF])
def test_pack_by_longest_value(top):
    v = np.random.default_rng(top).integers(0, top, 1003, endpoint=True).astype(np.uint32)
    assert (tokenbin.unpack(*tokenbin.pack(v), len(v)) == v).all()


def test_unseen_pre_tokens_are_encoded_together(monkeypatch):
    monkeypatch.setattr(tokenbin, "BATCH", 7)
    lib, alone = tokenbin.Library(PATH), []
    plain = lib.pieces.tokenize
    lib.pieces.tokenize = lambda word: alone.append(word) or plain(word)
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdeäößжи東京19.,'!") for _ in range(rng.randint(1, 12))) for _ in range(500)] + ["x" * 80, "don't"]
    texts = [" ".join(rng.choices(words, k=40)) for _ in range(60)]
    tok = Tokenizer.from_file(PATH)
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in lib.encode_many(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(alone) <= {"Ġ" + "x" * 80, "x" * 80}  # too long to be kept


def test_counts_come_with_the_ids(spark):
    texts = _texts()
    df = spark.createDataFrame([(k if k % 5 else None, t if k % 7 else None) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = tokenbin.encode(df, "doc_id", "text", PATH, 2).cache()
    tok = Tokenizer.from_file(PATH)
    ids = [i for k, t in enumerate(texts) for i in [*(tok.encode(t, add_special_tokens=False).ids if k % 7 else []), 2]]
    assert {r["id"]: r["n"] for r in tokenbin.count_ids(rows.select("counts")).collect()} == {i: ids.count(i) for i in set(ids)}
    assert rows.where("counts is null").count() == len(texts)
