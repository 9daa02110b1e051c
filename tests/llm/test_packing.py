"""Packing: ids against the public tokenizer, patterns against bounds, pieces against the contract."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import cutline.llm.packing as P

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PUBLIC = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PUBLIC.encode_special_tokens = True


def public_ids(text):
    return PUBLIC.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(st.characters(max_codepoint=0x24f, exclude_categories=["Cs"]), max_size=60), st.text(max_size=30),
                 st.text("aé'st lm\n\t\xa0.1²ß<|>", max_size=50)))
def test_ids_equal_the_public_tokenizer(text):
    assert list(np.frombuffer(P.encoder(RANKS)([text])[0], "<u4")) == public_ids(text)


def test_ids_of_the_documents():
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() + ["<|endoftext|> a", "x" * 5000, " " * 999]
    for text, ids in zip(texts, P.encoder(RANKS)(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == public_ids(text)


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 5)
    own = P.Encoder(RANKS)
    for _ in range(3):
        for text in ("one two three", "four\nfive six seven eight", "the rain in spain"):
            assert list(np.frombuffer(own([text, text + " more"])[0], "<u4")) == public_ids(text)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_and_pad_little(seed):
    rnd = np.random.default_rng(seed)
    sizes = np.unique(rnd.integers(1, 257, 200))
    demand = rnd.integers(1, 3000 if seed else 3, sizes.size)
    patterns = P.whole_patterns(sizes, demand, 256)
    used = defaultdict(int)
    for pattern, times in patterns:
        assert sum(s * c for s, c in pattern) <= 256 and times > 0
        for s, c in pattern:
            used[s] += c * times
    assert used == dict(zip(sizes.tolist(), demand.tolist()))
    relaxed = P.plan_patterns(sizes, demand.astype(float), 256)[1].sum()
    least = max(int((sizes * demand).sum()) / 256, relaxed / (1 + P.GAP))
    assert least - 1e-6 <= sum(t for _, t in patterns) <= relaxed + sizes.size


def test_relaxed_plan_is_optimal_on_a_known_case():
    # 97 pieces of 45, 610 of 36, 395 of 31, 211 of 14 from lengths of 100: the textbook optimum is 452.25
    order = np.array([14, 31, 36, 45])
    patterns, amount = P.plan_patterns(order, np.array([211.0, 395, 610, 97]), 100, 1e-9)
    assert abs(amount.sum() - 452.25) < 1e-6 and (patterns @ order <= 100).all()


def verify(rows, source, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in source:
        ids = public_ids(text) + [0]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return sum(r.length for r in rows) / (len(by_seq) * length)


def test_every_id_in_one_piece(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "Straße", "x1", "über", "…", "\n", "quick"])
    source = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 20, 60, 130, 700])))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame([(*s, 5) for s in source], "doc_id long, text string, length int")
    assert verify(P.pack(docs, RANKS, 64).collect(), source, 64) > .9


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d")], "doc_id long, text string")
    rows = P.pack(docs, RANKS, 16).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 1] and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert P.pack(docs.where("false"), RANKS).count() == 0


JSON = public_tokenizers.path("byte_bpe_50k.json")
MATCHING = Tokenizer.from_file(JSON)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", "é", "…", "'s", "12"]), max_size=12).map("".join))
def test_added_tokens_inside_a_text(text):
    assert list(np.frombuffer(P.encoder(RANKS, JSON)([text, "b"])[0], "<u4")) == MATCHING.encode(text, add_special_tokens=False).ids


def test_the_query_matches_added_tokens(spark, tmp_path):
    import __spark_entry__ as entry
    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = entry.queries()["op4_packing"](spark, str(tmp_path)).first()
    assert row.doc_tokens == 5 and row.ids_crc32 == zlib.crc32(np.array([64, 220, 50256, 275, 0], "<u4").tobytes())
