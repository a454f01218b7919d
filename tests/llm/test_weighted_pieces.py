"""Unigram models and character maps against the library, over models put
together here piece by piece (no tokenizer is trained)."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb2

from ledgerloom.llm import sentencepiece_fst
from ledgerloom.llm.piece_normaliser import Normaliser

TEXTS = ["", " ", "a", "abab", "banana bandana", "  two  spaces ", "ＡＢＣ　ｄ①", "é é ﬁ ｶﾞ", "日本 語", "x\ty\nz", "▁mark ▁", "aaaaaaa",
         "ab" * 30, "​zero ­", "na na", "㍿ab", "😀 na"]


def model_bytes(unigram=True, fallback=True, charsmap=b"", squeeze=False, prefix=True, seed=1):
    rnd = random.Random(seed)
    m = pb2.ModelProto()
    kinds = pb2.ModelProto.SentencePiece
    m.pieces.add(piece="<unk>", score=0, type=kinds.UNKNOWN)
    m.pieces.add(piece="<s>", score=0, type=kinds.CONTROL)
    m.pieces.add(piece="</s>", score=0, type=kinds.CONTROL)
    if fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=kinds.BYTE)
    known = list("▁abdeinrstxyzABC日é1") + ["ab", "an", "na", "ana", "ban", "▁b", "▁ba", "aa", "aaa", "da", "▁▁", "nan", "abab", "AB", "▁two"]
    for k, p in enumerate(known):
        m.pieces.add(piece=p, score=-round(rnd.uniform(1, 9), 3) if unigram else -float(k), type=kinds.NORMAL)
    m.trainer_spec.model_type = pb2.TrainerSpec.UNIGRAM if unigram else pb2.TrainerSpec.BPE
    m.trainer_spec.byte_fallback = fallback
    m.trainer_spec.vocab_size = len(m.pieces)
    m.normalizer_spec.name = "made"
    m.normalizer_spec.precompiled_charsmap = charsmap
    m.normalizer_spec.add_dummy_prefix = prefix
    m.normalizer_spec.remove_extra_whitespaces = squeeze
    m.normalizer_spec.escape_whitespaces = True
    return m.SerializeToString()


def charsmap():
    spec = pb2.NormalizerSpec()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    return spec.precompiled_charsmap


def junk(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aabnnd  eéＡ日①́rstwox▁\t") for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("mapped", [True, False])
@pytest.mark.parametrize("squeeze,prefix", [(False, True), (True, True), (False, False), (True, False)])
def test_unigram_equals_the_library(tmp_path, fallback, mapped, squeeze, prefix):
    raw = model_bytes(True, fallback, charsmap() if mapped else b"", squeeze, prefix, seed=fallback + 2 * mapped)
    (tmp_path / "m.model").write_bytes(raw)
    fst = sentencepiece_fst.PieceTransducer(str(tmp_path / "m.model"))
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in TEXTS + junk(300, 5):
        ids = fst.encode(t).tolist()
        assert ids == lib.encode(t), t
        assert fst.decode(ids) == lib.decode(ids), t


def test_bpe_with_a_character_map_equals_the_library(tmp_path):
    raw = model_bytes(False, True, charsmap(), squeeze=True)
    (tmp_path / "m.model").write_bytes(raw)
    fst = sentencepiece_fst.PieceTransducer(str(tmp_path / "m.model"))
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for t in TEXTS + junk(200, 6):
        assert fst.encode(t).tolist() == lib.encode(t), t


def test_normaliser_equals_the_library():
    for rule in ("nmt_nfkc", "nfkc_cf", "identity"):
        for squeeze in (False, True):
            lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                                        remove_extra_whitespaces=squeeze)
            spec = pb2.NormalizerSpec()
            spec.ParseFromString(lib.serialized_normalizer_spec())
            own = Normaliser(spec)
            for t in TEXTS + junk(200, 7) + ["ΣΑΣ ß İ", "ＦＵＬＬ　ｗｉｄｔｈ"]:
                assert own(t) == lib.normalize(t), (rule, squeeze, t)


def test_the_path_is_the_shortest(tmp_path):
    """Against all segmentations."""
    raw = model_bytes(True, True, seed=9)
    (tmp_path / "m.model").write_bytes(raw)
    fst = sentencepiece_fst.PieceTransducer(str(tmp_path / "m.model"))
    m = pb2.ModelProto()
    m.ParseFromString(raw)
    score = {p.piece: p.score for p in m.pieces if p.type == pb2.ModelProto.SentencePiece.NORMAL}

    def best(s):
        if not s:
            return 0.0
        return max((score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score), default=float("-inf"))

    for t in ("banana", "abab", "nanaab", "aaaaab"):
        got = sum(m.pieces[i].score for i in fst.encode(t).tolist())
        assert abs(got - best("▁" + t)) < 1e-4


def test_in_spark(spark, tmp_path):
    raw = model_bytes(True, True, charsmap())
    path = str(tmp_path / "m.model")
    (tmp_path / "m.model").write_bytes(raw)
    lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rows = [(i, t) for i, t in enumerate([None, *TEXTS])]
    got = sentencepiece_fst.encode(spark.createDataFrame(rows, "i long, text string"), model=path).collect()
    assert {r.i: r.ids for r in got} == {i: None if t is None else lib.encode(t) for i, t in rows}


def test_other_models_are_refused(tmp_path):
    m = pb2.ModelProto()
    m.ParseFromString(model_bytes())
    m.trainer_spec.model_type = pb2.TrainerSpec.WORD
    (tmp_path / "w.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        sentencepiece_fst.PieceTransducer(str(tmp_path / "w.model"))
