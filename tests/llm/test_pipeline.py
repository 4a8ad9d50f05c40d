import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from docloom.llm import mixing


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "the", "or", "ti", "re", "on", "ea", "st"]) for _ in range(rng.randrange(1, 4)))
    good = [" ".join(word() for _ in range(rng.randrange(40, 90))) for _ in range(160)]
    bad = [" ".join(word() + rng.choice(["###", "&&&", "$$$"]) for _ in range(60)) for _ in range(60)]
    near = [g + " more" for g in good[:10]]
    secret = [" ".join(word() for _ in range(50)) + ' token = "3f786850e387550fdab836ed7e6dc881de23001b" end' for _ in range(5)]
    texts = good + bad + near + good[20:25] + secret + [None, "", "short text"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 160)) for i in range(220)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = {r.doc_id: r for r in docs.collect()}
    start = 160 + 60 + 10 + 5
    assert set(kept) >= set(range(160)) and set(kept) <= {*range(160), *range(start, start + 5)}
    assert all("3f786850" not in r.text and r.n_chars == len(r.text) for r in kept.values())
    assert len(kept) == docs.count()
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(out) == set(kept)
    for i, r in out.items():
        ids = np.array(tok.encode(kept[i].text, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert np.frombuffer(r.ids, "<u4").tolist() == ids.tolist()


def test_rows_carry_the_mix(spark, tmp_path, monkeypatch):
    """Slots of the last stage's rows, read from files in any order, follow the target weights."""
    rng = random.Random(7)
    rows = [(i, f"{i} " + "word " * rng.choice([300, 900, 8000]), "en", rng.choice(["a"] * 6 + ["b", "b", None]), 0) for i in range(150)]
    rows += [(None, "x", "en", "a", 1), (None, None, "en", None, 0), (7, "", "en", "b", 0), (7, "", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "STAGES", P.STAGES[-2:])
    out = P.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights = mixing.root_weights(docs)
    assert len(out) == len(rows)
    want = [(r.doc_id, r.slot, r.block) for r in mixing.schedule(docs, weights).collect()]
    assert sorted(map(str, ((r.doc_id, r.slot, r.block_no) for r in out))) == sorted(map(str, want))
    shares = mixing.shares(weights, mixing.PERIOD)
    source = {i: s for i, _, _, s, _ in rows if i is not None}
    taken = mixing.pattern(shares, mixing.PERIOD)
    assert all(taken[r.slot % mixing.PERIOD] == source[r.doc_id] for r in out if r.doc_id is not None)
    assert all(abs(r.block_no * mixing.PERIOD - shares[source[r.doc_id]] * r.slot) <= mixing.PERIOD for r in out if r.doc_id is not None)
    slots = [r.slot for r in P.tokens(spark, docs, str(tmp_path)).collect()]
    assert slots == sorted(slots) and len(set(slots)) > 20
