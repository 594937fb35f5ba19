"""What the part encoder remembers, and the kinds of many strings at once."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from letterloom.llm import packing, tokens


def test_parts_met_in_every_generation_stay_recent():
    memory = tokens.Memory(40)
    for k in range(12):
        values = {f"rare{k}-{i}": i for i in range(20)}
        if "the" not in memory.recent:
            values |= memory.again(["the"]) or {"the": 1}
        memory.add(values)
    assert "the" in memory.recent and memory.get("the") == 1
    assert len(memory.recent) + len(memory.older) <= 2 * (40 + 21)


def test_common_parts_are_bounded():
    memory = tokens.Memory(8)
    for _ in range(30):
        names = [f"w{i}" for i in range(40)]
        memory.add({x: 1 for x in names if x not in memory.recent} | memory.again([x for x in names if x not in memory.recent]))
        assert len(memory.common) <= 40 and len(memory.recent) <= 80


def test_kinds_of_many_strings_are_those_of_each():
    library = tokens.PartLibrary(tokens.load(public_tokenizers.path("byte_bpe_50k.json")))
    words = ["a", "Wort", "x.y", "été", "12", "日本"]
    for strings in ([" " + w for w in words], ["\n" + w for w in words], [" a", "\n", " b"], [" a b", " c"], ["a", " b"], ["\ta"], [" a b"], [" a", " b"], ["", " a"], [" <|endoftext|>", " a"], [" <|endof", " text|>"], []):
        assert library._kinds(strings) == list(map(library._kind, strings)), strings


def test_ids_are_the_librarys_whatever_is_remembered():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, encode = tokens.load(path), tokens.PartEncoder(tokens.PartLibrary(tokens.load(path)), " ", limit=50)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" if x > 60 else "the" for x in rng.integers(0, 400, 80)) for _ in range(60)]
    texts += ["", " ", "\n", "a\nb", "a\n\nb", " a", "a ", "a  b", "a\tb c", "<|endoftext|> a", "a, b. c!\nd"]
    for at in range(0, len(texts), 7):
        for text, values in zip(texts[at : at + 7], encode(texts[at : at + 7]), strict=True):
            assert np.frombuffer(b"".join(values), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_joined_ids_are_the_librarys_and_only_different_parts_are_looked_up():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"Wort{x}," if x > 60 else "the" for x in rng.integers(0, 200, 90)) for _ in range(30)]
    texts += ["", " ", "\n", "a\nb", " a", "a  b", "a\tb\r\nc", "\u00e9 \u0130 <|x|>", "<|endoftext|> A", "\u65e5\u672c \x00 \u8a9e"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tok, encode = tokens.load(path), tokens.id_encoder(path, 50)
        asked, values = [], encode._values
        encode._values = lambda known, parts, lead, asked=asked, values=values: asked.append(list(parts)) or values(known, parts, lead)
        for at in range(0, len(texts), 9):
            some = texts[at : at + 9]
            assert [np.frombuffer(ids, "<u4").tolist() for ids in encode.joined(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]
        assert encode.joined([]) == []
        if name.startswith("word"):
            assert all(len(parts) == len(set(parts)) for parts in asked)
    tokens.id_encoder.cache_clear()


def test_a_packing_task_leaves_nothing_remembered_in_its_worker():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.record_batch([pa.array([1, 2]), pa.array(["some words, again words", None])], names=["doc_id", "text"])
    assert [x for b in packing._pieces(path, 1, 4096)(iter([texts])) for x in b.column("doc_id").to_pylist()] == [1, 2]
    encode = tokens.id_encoder(path)
    assert not encode.first.recent and not encode.first.older and not encode.marks
