"""Token alignment against whole-text tokenisation and all pairs of tokens."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

import cutline.llm.alignment as A

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    # the byte of each letter, from the vocabulary's own encoding of single characters below U+0100
    names = {i: t for t, i in a.get_vocab().items()}
    letters = {}
    for b in range(256):
        char = chr(b).encode()
        for byte, letter in zip(char, "".join(names[i] for i in a.encode(chr(b), add_special_tokens=False).ids)):
            letters[letter] = byte
    return a, names, letters, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(tools, text):
    a, names, letters, b = tools
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters.get(c, 0x2E) for c in names[i]) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    return None if b"".join(bytes_b) != whole or sum(map(len, bytes_a)) != len(whole) else (list(zip(ids_a, map(len, bytes_a))), list(zip(ids_b, map(len, bytes_b))))


def spans(items):
    at, out = 0, []
    for i, n in items:
        out.append((i, at, at + n))
        at += n
    return out


def brute(tools, docs):
    per, counts = [], Counter()
    for doc, text in docs:
        found = tokens(tools, text) if text else None
        if found is None:
            per.append((doc, 0, 0, 0, [], ""))
            continue
        a, b = map(spans, found)
        links, low = [], 0
        for i, s, e in a:
            while b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = ";".join(",".join(str(x[0]) for x in a if s < x[2] <= e) + "|" + ",".join(str(x[0]) for x in b if s < x[2] <= e) for s, e in zip([0, *ends], ends))
        counts.update(links)
        per.append((doc, len(a), len(b), len(ends), links, groups))
    best = {}
    for (a, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((d, a, b, g, len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), s) for d, a, b, g, l, s in per), key=str)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, n_a int, chunk string").repartition(3)
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in A.align(df, *PATHS, **kw).collect()), key=str)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "tab\tand space  wide", "it's we'll 'tis", "<|endoftext|> <s> </s> <unk> <0x41>", "x <|endoftext|>y",
       "▁", "a▁b c", "漢字 かな 🙂🙃 é", "zero​width \u0000nul \x1c fs \x1c", "1234567 3.14 1,000", "a" * 3000, " ".join(["ab  cd"] * 50), "﻿bom", " ogham  "]


def test_alignment_equals_all_pairs(spark, tools, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 500)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "an exact copy, often") for i in range(40)] + [(None, "a null id"), (3, "the same id"), (3, "the same id")]
    assert run(spark, docs) == brute(tools, docs)


def test_alignment_of_the_documents(spark, tools, monkeypatch):
    monkeypatch.setattr(A, "CACHE", 2000)  # forgets on the way
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(tools, docs)]
    assert run(spark, docs, digest=True) == want


def test_an_empty_table_and_only_null_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_very_long_text(spark, tools):
    docs = [(1, " ".join(f"word{i % 991}" for i in range(60_000))), (2, "word1 word2")]
    got = {r[0]: r for r in run(spark, docs)}
    whole = tokens(tools, docs[0][1])
    assert got[1][1:3] == (len(whole[0]), len(whole[1])) and got[1][4] == got[1][1] + got[1][2] - got[1][3]
