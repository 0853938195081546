import hashlib
import random

import numpy as np

import corpus_pipeline as cp
from tallymark.llm import decontamination as dc
from tallymark.llm import secret_scan as ss
from tallymark.llm import sentencepiece_codec as sc
from tallymark.llm import simhash_vptree as sv
from tallymark.llm import toxicity_chain as tc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def fixture(seed):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(vocab, k=n))
    bench = [(k, prose(20)) for k in range(6)] + [(6, None), (None, "x y")]
    docs = []
    for k in range(160):
        text = prose(rnd.randint(5, 60))
        if k % 9 == 0:
            text += " idiotic fool"
        if k % 10 == 1:
            text += " " + bench[k % 6][1] + " end"
        if k % 11 == 2:
            text += " token=abcdefABCDEF0123456789"
        docs.append((k, text, "en", "s", len(text)))
    docs += [(200 + k, docs[k][1], "en", "t", docs[k][4]) for k in range(0, 40, 3)]
    docs += [docs[5], (None, "lonely words here without any id at all", "en", None, 5), (300, None, None, None, None), (301, "", "en", "s", 0)]
    labels = [(k, 1, int(k % 9 == 0)) for k in range(160) if k % 2 == 0]
    return docs, labels, bench


def brute(docs, chain, bench):
    docs = [d for d in docs if chain.predict(d[1] or "")[1] < tc.TOXIC]
    fps = sv.fingerprints([d[1] or "" for d in docs])
    forest = sv.Forest(len(docs))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    forest.join(i, j)
    best = {}
    for d, c in zip(docs, forest.label.tolist()):
        order = (d[0] is None, d[0] or 0)
        if c not in best or order < best[c][0]:
            best[c] = (order, d)
    docs = [d for _, d in best.values()]
    matcher = dc.Matcher([b for b in bench if None not in b])
    docs = [d for d in docs if not matcher.find(d[1] or "")]
    codec = sc.codec(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    out = []
    for doc_id, text, *_ in docs:
        said, at = "", 0
        for start, _, _, end in sorted(brute_spans(text)):
            if start >= at:
                said += text[at:start] + "[SECRET]"
            at = max(at, end)
        said += (text or "")[at:]
        ids = codec.encode(said)[0]
        out.append((doc_id is None, doc_id or 0, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
    return sorted(out)


def brute_spans(text):
    import re

    return [(m.start(), 0, k, m.end()) for k, p in (ss.BASE | ss.ADDED).items() for m in re.finditer(p, text or "") if len(m[2] if k == "assign" else m[0]) >= ss.LEAST.get(k, 0)]


def test_stages_equal_brute_force(spark, tmp_path):
    docs, labels, bench = fixture(1)
    frame = spark.createDataFrame(docs, DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    told.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = frame
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == brute(docs, tc.chain_for(frame, told), bench)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
