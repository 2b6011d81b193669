import random
import tempfile
import zlib

import numpy as np
from tokenizers import Tokenizer

from data import no_documents, odd_documents
from lexigraph.llm import packing
from lexigraph.llm.common import table


def check(docs, rows, window):
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = sorted((repr(r.doc_id), np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in docs.collect())
    pieces = {}
    for r in rows:
        pieces.setdefault(repr(r.doc_id), []).append(r)
    by_id = {}
    for key, ids in want:
        by_id.setdefault(key, []).append(ids)
    assert set(by_id) == set(pieces)
    for key, texts in by_id.items():
        # rows of one id: each text's pieces are found by position and checksum
        left = list(pieces[key])
        for ids in texts:
            at = 0
            while at < len(ids) // 4:
                fit = next(p for p in left if p.start == at and p.doc_tokens == len(ids) // 4 and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)]))
                left.remove(fit)
                at += fit.length
        assert not left
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").repartition(5)
    check(docs, packing.pack(docs).collect(), 4096)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(docs, packing.pack(docs, window=256, open_windows=3).collect(), 256)
    assert packing.pack(no_documents(spark)).collect() == []


def test_best_fit_keeps_windows_bounded():
    rng = random.Random(1)
    packer, seen, put = packing.Packer(64, 4), 0, 0
    for i in range(3000):
        n = rng.choice([1, 3, 17, 40, 63, 64, 65, 200])
        put += n
        for full in packer.place(i, b"\0" * 4 * n):
            assert sum(p[2] for p in full) == 64
            seen += 64
        assert len(packer.open) <= 4
    assert seen + sum(p[2] for p in packer.leftovers()) == put


def test_words_encode_as_the_tokenizer_does():
    encoder = packing.WordEncoder(packing.default_vocabulary())
    texts = ["Don't  stop\tNÄIVE é x y", "a\x1cb", "ΑΣ ΣΑ Σ", "<|endoftext|>x <|endoftext|> <|endof text|>", "x\u0085y᠎z", "", None, "İ'LL WE'RE''s _a_1"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def test_a_word_is_looked_up_once_for_many_texts():
    class Counted(dict):
        reads = 0

        def get(self, *key):
            self.reads += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.reads += 1
            return super().__getitem__(key)

    encoder = packing.WordEncoder(packing.default_vocabulary())
    encoder.words = Counted()
    texts = ["The same words, again and again. " * 100] * 20
    want = np.array(encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(texts) == [want] * 20
    assert encoder.words.reads < 50


def test_letters_encode_as_the_tokenizer_does():
    """Every character that counts as a Latin letter or mark, in words that pass the model without the rest of the tokenizer."""
    encoder = packing.WordEncoder(packing.default_vocabulary())
    letters = [c for c in map(chr, range(0x30000)) if packing.PLAIN.fullmatch(c.lower()) and packing.PLAIN.fullmatch(c.lower())[1]]
    assert {"a", "Z", "ß", "É", "ɏ", "K"} <= set(letters)
    rng = random.Random(2)
    words = letters + ["".join(rng.choices(letters, k=rng.randint(2, 12))) + "".join(rng.choices("!-/:@[`{~'\"", k=rng.randint(0, 3))) for _ in range(4000)]
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = words + [f"a{c}b {c} É{c}" for c in blanks] + [" ".join(words), "\n \t\x0b\x0c\r"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
    assert encoder.direct and len(encoder.letters) > 4000


def test_long_words_are_encoded_and_not_kept():
    encoder = packing.WordEncoder(packing.default_vocabulary())
    texts = ["日本語の文章です。" * 3000, "a" * 500 + " b " + "É" * 65 + "!", "x\u3000y " * 40000, "plain words"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want
    assert max(map(len, [*encoder.words, *encoder.letters])) <= packing.KEPT_LENGTH


def test_other_tokenizers_encode_letters_as_they_do():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    plain = Tokenizer(models.WordPiece({"[UNK]": 0, "cafe": 1, "!": 2, "the": 3}, unk_token="[UNK]"))
    plain.normalizer, plain.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    with tempfile.TemporaryDirectory() as folder:
        plain.save(f"{folder}/plain.json")
        encoder = packing.WordEncoder(f"{folder}/plain.json")
    assert not encoder.direct
    assert np.frombuffer(encoder.encode(["The Café! ß"])[0], "<u4").tolist() == [3, 1, 2, 0]


def test_portions_hold_every_text_once():
    texts = ["abc", None, "", "x" * 50, "ab", "cd" * 9, ""]
    parts = list(packing.portions(texts, 10))
    assert [t for p in parts for t in texts[p]] == texts
    assert [(p.start, p.stop) for p in parts] == [(0, 4), (4, 6), (6, 7)]
    assert list(packing.portions([], 10)) == []
