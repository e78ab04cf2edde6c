"""Sentence pieces against the library: ids, spans and texts, under the public model and under others with character maps."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tessera.llm import pieces

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "a", "\n", "▁", "▁▁a ▁b", "Hé 漢\U0001f600 b", "\x00a\x00", "<s> </s> <unk> <0x41>", " lead", "trail ", "a  b   c", "x" * 5000, "ﬁ ①　ｱﾊﾟｰﾄ\t x", "\x07\x07", "  \x07 a", "a­ b", "½ ﷺ", "a ▁ ", "x " * 70_000]


def against_library(own, text):
    ids, starts, ends = own.encode(text)
    assert ids.tolist() == own.full.encode(text, add_bos=True, add_eos=True)
    assert own.decode(ids) == own.full.decode(ids.tolist())
    at = [0]
    for letter in text:
        at.append(at[-1] + len(letter.encode()))
    found = own.full.encode_as_offset_mapping(text)["offsets"]
    assert list(zip(starts.tolist(), ends.tolist())) == [(0, 0), *((at[a], at[b]) for a, b in found), (ends[-1], ends[-1])]


def test_ids_spans_and_texts_are_the_librarys(spark):
    own = pieces.load(pieces.default_model())
    for text in ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]:
        against_library(own, text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_models_with_a_character_map(tmp_path, rule, squeeze):
    with open(pieces.default_model(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    made = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    (tmp_path / "m").write_bytes(model.SerializeToString())
    own, dice = pieces.Pieces(str(tmp_path / "m")), random.Random(1)
    for text in ODD[:-1] + ["".join(dice.choices("ab  \t\n①ｱﾊﾟﬁ　\xa0­​½ﷺé\x07▁É漢\U0001f600", k=dice.randrange(1, 12))) for _ in range(800)]:
        against_library(own, text)


def test_words_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 3)
    own = pieces.Pieces(pieces.default_model())
    for text in ("a b c d e f a b", "g a", "b " + "long" * 40, "a b"):
        against_library(own, text)


def test_a_piece_that_crosses_spaces(tmp_path):
    with open(pieces.default_model(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    for name in ("e▁", "e▁t"):
        model.pieces.add(piece=name, score=0.5)
    model.trainer_spec.vocab_size += 2
    (tmp_path / "m").write_bytes(model.SerializeToString())
    own = pieces.Pieces(str(tmp_path / "m"))
    assert 32001 in own.encode("he the")[0]
    against_library(own, "he the tree  two")


def test_models_that_are_not_supported(tmp_path):
    with open(pieces.default_model(), "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.pieces[500].type = pieces.USER
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="isn't supported"):
        pieces.Pieces(str(tmp_path / "m"))


def test_operator(spark):
    rows = [(k, t, "own") for k, t in enumerate(ODD)] + [(1, "again", "own"), (1, "again", "own"), (None, "no id", None), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    own = pieces.load(pieces.default_model())
    encoded = pieces.encode(docs)
    got = sorted(((r.doc_id, r.ids, r.starts, r.ends) for r in encoded.collect()), key=str)
    assert got == sorted(((k, *(x.tolist() for x in own.encode(t or ""))) for k, t, _ in rows), key=str)
    assert sorted(map(str, pieces.decode(encoded).collect())) == sorted(f"Row(doc_id={k}, text={own.full.decode(own.full.encode(t or ''))!r})" for k, t, _ in rows)

    def sha(ids):
        return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    digest = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest(docs).collect()}
    assert digest == {(k, len(i), sha(i), hashlib.sha256(own.full.decode(i).encode()).hexdigest()) for k, t, _ in rows for i in [own.full.encode(t or "", add_bos=True, add_eos=True)]}
    empty = docs.limit(0)
    assert pieces.encode(empty).count() == pieces.digest(empty).count() == pieces.decode(pieces.encode(empty)).count() == 0


def test_byte_pieces_that_make_no_character():
    own = pieces.load(pieces.default_model())
    for ids in ([1, 233, 191, 2], [233], [1, 22557, 0, 28705], [], [28705]):
        assert own.decode(np.array(ids, np.int64)) == own.full.decode(ids)
