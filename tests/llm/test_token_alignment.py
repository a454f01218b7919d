"""Alignment against the libraries on whole texts."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerloom.llm import token_alignment as ta
from ledgerloom.llm.sentencepiece_fst import model_path

SYMBOLS = {}
_next = 256
for _b in range(256):
    if 33 <= _b <= 126 or 161 <= _b <= 172 or _b >= 174:
        SYMBOLS[chr(_b)] = _b
    else:
        SYMBOLS[chr(_next)] = _b
        _next += 1


def brute(rows):
    a_lib = Tokenizer.from_file(model_path(ta.A_MODEL))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=model_path(ta.B_MODEL))
    names = {i: s for s, i in a_lib.get_vocab().items()}

    def read(text):
        if not text:
            return None
        a = a_lib.encode(" " + text, add_special_tokens=False).ids
        b = b_lib.encode(text)
        a_bytes = [bytes(SYMBOLS[c] for c in names[i]) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i)
                   else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            return None
        ends = lambda parts: [sum(map(len, parts[:k + 1])) for k in range(len(parts))]
        ea, eb = ends(a_bytes), ends(b_bytes)
        cut = sorted(set(ea) & set(eb))
        groups, low = [], 0
        for at in cut:
            groups.append(([i for i, e in zip(a, ea, strict=True) if low < e <= at],
                           [i for i, e in zip(b, eb, strict=True) if low < e <= at]))
            low = at
        return groups

    read_rows = [(i, read(t)) for i, t in rows]
    counts = Counter()
    for _, groups in read_rows:
        counts.update({(x, y) for a, b in groups or [] for x in a for y in b})
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in read_rows:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest()))
    return out, counts


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, n_a int")
    figures, pairs = ta.align(df.repartition(parts) if rows else df, **kw)
    return [tuple(r) for r in figures.collect()], {(r.a, r.b): r.docs for r in pairs.collect()}


def check(spark, rows, **kw):
    got, pairs = run(spark, rows, **kw)
    want, counts = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pairs == counts


ALPHABET = "  aabeinrstthe'ssreveldm.,!?12é̈ñçßΣςİ각中文\n\t\r \u0085 ​😀<|>endoftextstart'’ÀA  　"
EDGE = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a   ", "▁", "a ▁b", "\n", " \n ", "a \n b", "x" * 700, "'" * 40, "é" * 90,
        "é è à b", "<|endoftext|> <s> </s> <unk>", "\U0001f600 \U0001f600", "\x00 a", "a\x00 b", "1234567890 12",
        "word word  word", "a  b", "a　 b", "ab cd " * 300, "<0x41> A", "it's we'll  I'VE"]


def test_equals_the_libraries(spark, small_docs):
    rows = [(r.doc_id, r.text[:1500]) for r in small_docs.limit(60).collect()] + [(1000 + i, t) for i, t in enumerate(EDGE)]
    check(spark, rows)


@pytest.mark.parametrize("block", [1, 200, 5000])
def test_blocks_do_not_matter(spark, block):
    rnd = random.Random(block)
    rows = [(i, "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 80)))) for i in range(150)]
    check(spark, rows + rows[:30] + [(None, "hello there"), (None, None)], block=block)


def test_hot_texts(spark):
    rows = [(i, "the same thwhesou text") for i in range(60)] + [(i, t) for i, t in enumerate(EDGE) if t and len(t) < 100]
    check(spark, rows, parts=5, block=300)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == ([], {})
    got, _ = run(spark, [(1, "some words here and thwheron " * 4000)])
    assert got[0][1] > 20_000 and got[0][7]


def test_identity_map():
    pair = ta.Pair(model_path(ta.A_MODEL), model_path(ta.B_MODEL))
    assert pair.cuts and (pair.identity >= 0).sum() > 10_000
    take = lambda table, i: table.flat[table.start[i]:table.start[i] + table.size[i]].tobytes()
    for i in range(0, len(pair.identity), 97):
        if pair.identity[i] >= 0:
            assert take(pair.a_bytes, i) == take(pair.b_bytes, pair.identity[i])
