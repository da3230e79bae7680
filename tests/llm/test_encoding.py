"""Encoding and token counts against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelloom.llm import piece_codec, token_counts
from tests.llm.cases import documents, plain, texts

SIGNS = list("abetin''''srvlemd THE  \n\t▁▁<s>0123é漢字ゼΣσ😀́ 　ß\"=-\x1c\x85<|>İ½²") + ["<|endoftext|>", "'re", "'ll", "</s>", "<0x0A>"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.choice([0, 1, 2, 5, 20, 80]))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return piece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as file:
        return file.read(), Tokenizer.from_file(path)


def test_ids_and_text_are_the_librarys(model):
    codec, library = piece_codec.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    runs = [" " * n + "t" for n in range(40)] + ["=" * n for n in range(50)] + ["a" * 3000, "\n" * 40]
    for text in random_texts(1500) + runs:
        want = library.encode(text, add_bos=True, add_eos=True)
        got = np.frombuffer(codec.encode_packed(text), "<u4").tolist()
        assert got == want, text
        assert codec.decode(got) == library.decode(want), text


def test_decoding_of_any_ids(model):
    codec, rng = piece_codec.PieceCodec(model), random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(32000) for _ in range(rng.randrange(9))]
        assert codec.decode(ids) == codec.library.decode(ids), ids


def test_full_stores_change_nothing(model, monkeypatch):
    monkeypatch.setattr(piece_codec, "PAIRS_KEPT", 50)
    monkeypatch.setattr(piece_codec, "CHUNKS_KEPT", 20)
    codec = piece_codec.PieceCodec(model)
    for text in random_texts(300, 4):
        assert np.frombuffer(codec.encode_packed(text), "<u4").tolist() == codec.library.encode(text, add_bos=True, add_eos=True)


def test_encoded_table(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = []
    for i, text in texts():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digests = [hashlib.sha256(b).hexdigest() for b in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())]
        want.append((i, len(ids), *digests))
    assert plain(piece_codec.encoded_digests(documents(spark), model).collect()) == plain(want)
    lists = piece_codec.encode_texts(documents(spark), model, decoded=False, packed=False).collect()
    assert plain((r.doc_id, len(r.ids), r.n_tokens) for r in lists) == plain((w[0], w[1], w[1]) for w in want)
    assert piece_codec.encoded_digests(documents(spark, []), model).count() == 0


def test_counts_are_the_librarys(tokenizer):
    data, library = tokenizer
    machine = token_counts.CountingTransducer(data)
    long = ["ab c'd " * 20000, "thereing" * 20000, "x" * 70000 + " y " + "'s" * 40000]
    for text in random_texts(2500, 7) + long:
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:80]


def test_chunk_maps_compose_in_any_way(tokenizer):
    data, library = tokenizer
    machine, rng = token_counts.CountingTransducer(data), random.Random(3)
    for text in random_texts(200, 9):
        text = text.replace("<|endoftext|>", "")
        want = machine.count(text)
        folded = token_counts._lower(token_counts.unicodedata.normalize("NFC", text))
        cuts = sorted(rng.randrange(len(folded) + 1) for _ in range(4))
        parts = [folded[a:b] for a, b in zip([0, *cuts], [*cuts, len(folded)], strict=True)]
        assert machine.scan([machine.chunk_map(p) for p in parts]) == want, text


def test_small_stores_count_the_same(tokenizer, monkeypatch):
    data, library = tokenizer
    for name in ("STATES_KEPT", "MOVES_KEPT", "PAIRS_KEPT", "FIELDS_KEPT"):
        monkeypatch.setattr(token_counts, name, 30)
    machine = token_counts.CountingTransducer(data)
    for text in random_texts(150, 11):
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_counted_table(spark, tokenizer):
    data, library = tokenizer
    want = []
    for i, text in texts():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 2048))
    assert plain(token_counts.over_limit(documents(spark), data).collect()) == plain(want)
    assert any(w[3] for w in want)
    assert token_counts.over_limit(documents(spark, []), data).count() == 0


def test_unknown_rules_are_refused(tokenizer):
    with pytest.raises(ValueError, match="not known"):
        token_counts.CountingTransducer(tokenizer[0].replace(b"'s|'t", b"'s|'x"))
