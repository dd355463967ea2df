"""Screening gives memory back between batches."""

import unicodedata

import pyarrow as pa
from notelake.functions import text


def test_composed_texts_are_not_copied():
    for t in ("plain", "déjà vu", "中文", ""):
        assert text._composed(t) is t
    for t in ("é", "ﬁ ① ½", "ＡＢＣ"):
        assert text._composed(t) == unicodedata.normalize("NFKC", t) != t
    assert text._composed(None) is None


def test_unused_memory_goes_back():
    kept = pa.array(["a"])
    del kept
    text.given_back()
    assert pa.default_memory_pool().bytes_allocated() >= 0
