import hashlib
import random

import numpy as np
import pytest

from tallymark.llm import sentencepiece_codec as sc
from tallymark.llm import token_counts as tc
from tallymark.llm.common import slices

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(seed, chars, n=1500, longest=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(chars, k=rnd.randint(0, longest))) for _ in range(n)]


def test_counts_are_the_librarys():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    cases = texts(1, "ab'srevldmt  \n\t1٣é你　 !?🙂") + ["<|endoftext|>a<|endoftext|>", "<|endoftext|>", "I'll've  been   there\n\n now'sx 're're  's ' s", "", "a" * 5000, " " * 999, "the house " * 900]
    cases += ["".join(random.Random(k).choices(["<|endoftext|>", "x ", " y", "\n"], k=6)) for k in range(50)]
    assert tc.count_texts(cases, BPE).tolist() == [len(e) for e in lib.encode_batch(cases, add_special_tokens=False)]


def test_chunk_maps_compose_to_a_sequential_run():
    syms = np.random.default_rng(2).integers(0, 9, 1000).astype(np.uint8)
    state, want = tc.FRESH, []
    for s in syms:
        want.append(bool(tc.EMIT[s, state]))
        state = tc.STEP[s, state]
    assert tc.run_splitter(syms).tolist() == want


def test_a_small_pair_table_starts_again_without_harm(monkeypatch):
    merger, _ = tc.from_file(BPE)
    monkeypatch.setattr(tc, "MAX_PAIRS", 40)
    words = [w.encode() for w in ("internationalization", "unbelievable", "xyzzy", "strengths")] * 3
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    got = merger.count(buf, ends - [len(w) for w in words], ends).tolist()
    assert got == tc.count_texts([w.decode() for w in words], BPE).tolist()


def test_token_count_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (None, None, 6), (1, "hello world", 7), (2, "é " * 2000, 8)], "doc_id bigint, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df, BPE).collect()))
    assert got[:3] == [(0, 0, 0, False), (1, 11, 2, False), (1, 11, 2, False)] and got[3][1] == 6000 and got[3][3]
    assert tc.token_counts(df.limit(0), BPE).count() == 0


def test_ids_and_decoding_are_the_librarys():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), sc.codec(PIECES)
    for text in texts(2, "ab  the\n\t▁你🙂é<s>0ሴ̀") + ["", " ", "  a", "<unk>", "a" * 3000, "ab" * 500 + "你" * 100, "\x00a"]:
        ids, first, last = own.encode(text)
        want = lib.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, np.uint32).tolist() == want
        assert own.decode(ids) == lib.decode(want)
        size = len(text.encode())  # the spans tile the text
        assert first[0] == 0 and last[-1] == size and (first[1:] == last[:-1]).all()
    rnd = random.Random(3)
    for _ in range(500):  # ids that no text gives
        order = [rnd.choice([1, 2, rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(10)]
        assert own.decode(np.array(order, np.uint32).tobytes()) == lib.decode(order)


def test_normalisation_through_a_compiled_map_is_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    with open(PIECES, "rb") as f:
        own = sc.Codec(f.read())
    own.map, own.squeeze = sc.CharMap(spec.normalizer_spec.precompiled_charsmap), True
    for text in texts(4, " ﬁ①Ａ　é́Å　㍿a  \t\nｶﾞ", longest=15):
        norm, source = own.normalise(text)
        assert norm == lib.normalize(text)
        assert len(source) == len(norm.encode()) + 1 and source == sorted(source) and source[-1] <= len(text.encode())


def test_spans_are_the_bytes_of_their_pieces():
    own = sc.codec(PIECES)
    for text in texts(5, "ab  the\n▁你é", n=300) + ["the house " * 20_000]:
        ids, first, last = own.encode(text)
        data = text.encode()
        for i, a, b in zip(np.frombuffer(ids, np.uint32).tolist()[1:-1], first[1:-1].tolist(), last[1:-1].tolist()):
            if own.kind[i] == sc.NORMAL and sc.MARK not in text:
                assert data[a:b].decode() in [p.replace(sc.MARK, " ") for p in (own.piece[i], own.piece[i].removeprefix(sc.MARK))]
        # the general normaliser gives the same alignment as the shortcut for a model without a map
        if sc.MARK not in text:
            norm, source = own.normalise(text)
            stop = np.cumsum(own.widths(norm, np.frombuffer(ids, np.uint32)[1:-1]), dtype=np.int64)
            assert np.array(source)[stop].tolist() == last[1:-1].tolist()


def test_very_long_words_and_texts():
    from tokenizers import Tokenizer

    lib, rnd = Tokenizer.from_file(BPE), random.Random(7)
    cases = ["a" * 100_000, "".join(rnd.choices("abcdefghij", k=60_000)), "x" + "".join(rnd.choices("éà漢字ü", k=20_000)) + " end", "the house " * 60_000, "ab" * 1_500]
    assert tc.count_texts(cases, BPE).tolist() == [len(e) for e in lib.encode_batch(cases, add_special_tokens=False)]


def test_codec_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (None, None, 6), (1, "hello world", 7)], "doc_id bigint, text string, starts int")
    rows = sc.encode_decode(df, PIECES, keep=True)
    assert rows.columns == ["doc_id", "text", "ids_le", "starts", "ends", "spans_sha256", "decoded"]
    assert all(r.spans_sha256 == sc.spans_digest(np.array(r.starts), np.array(r.ends)) for r in rows.collect())
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in sc.digests(sc.encode_decode(df, PIECES)).collect())
    empty, said = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"hello world").hexdigest()
    assert got == [(0, 2, empty), (1, 5, said), (1, 5, said)]
    assert sc.encode_decode(df.limit(0), PIECES).count() == 0


def test_slices_cover_all_texts():
    cut = list(slices(["aa", "b" * 9, "", "c", "d"], 4))
    assert [k for a, b in cut for k in range(a, b)] == [0, 1, 2, 3, 4]
