"""The agenda encoder against the sentencepiece library."""

from hashlib import sha256

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from newswarden.llm import sp_bpe
from newswarden.llm.queries import SP_MODEL

TEXTS = ["", None, " ", "  ", "Hello world", "  two  spaces   here  ", "▁mark ▁ x▁", "naïve café 漢字 🙂 \u0000 x", "a" * 5000, "word " * 3000, "line\nline\n\n\ttab", "1234567890 " * 10, "ab" * 40 + " é" * 60]


def test_against_library(spark):
    model = sp_bpe.load(SP_MODEL)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    rows = sp_bpe.encode_digests(docs, SP_MODEL, keep_ids=True).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        want = model.library.encode(TEXTS[r.doc_id % len(TEXTS)] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want and r.n_tokens == len(want)
        assert r.ids_sha256 == sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(model.library.decode(want).encode()).hexdigest()
    back = {r.doc_id: r.text for r in sp_bpe.decode_ids(sp_bpe.encode_digests(docs, SP_MODEL, keep_ids=True), SP_MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(TEXTS))
    assert sp_bpe.encode_digests(docs.limit(0), SP_MODEL).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=80), min_size=1, max_size=8))
def test_any_text(texts):
    model = sp_bpe.load(SP_MODEL)
    for lo, hi, ids, bounds in model.encode(pa.array(texts)):
        raw, ends = model.decode(ids, bounds)
        for r in range(hi - lo):
            want = model.library.encode(texts[lo + r])
            assert ids[bounds[r] : bounds[r + 1]].tolist() == want
            assert raw[ends[r, 0] : ends[r, 1]].tobytes().decode() == model.library.decode(want)
